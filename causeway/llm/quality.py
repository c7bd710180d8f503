"""Per-document text statistics and fixed-threshold rules (problem 10).

Markup that is no text (templates, placeholders, comments, references, tags, headings, category
lines) is cut first. What is left is looked at line by line and word by word with vectorized string
kernels over Arrow batches; nothing is done per row in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed values of the published rules for web text: quality filters by word counts, mean word
#: length, symbols, bullets, ellipses, alphabetic words and stop words, and lines that end in a mark
#: that ends a sentence.
LEAST_WORDS = 50
MOST_WORDS = 100_000
MEAN_WORD_LENGTH = (3.0, 10.0)
MOST_SYMBOLS_PER_WORD = 0.1
MOST_ELLIPSIS_LINES = 0.3
LEAST_ALPHABETIC_WORDS = 0.8
LEAST_COMMON_WORDS = 2

#: A document is prose if more than this share of the characters left is in paragraphs, up to the end
#: of their last sentence, that pass every rule; one that has exactly half of something else is not.
LEAST_PROSE_SHARE = 0.5

_CUT_FIRST = (r"(?s)<!--.*?-->", r"(?is)<ref[^<>]*/>", r"(?is)<ref[^<>]*>.*?</ref>", r"(?is)<sup[^<>]*>\s*\[[^\[\]]*\]\s*</sup>", r"(?i)</?(?:noinclude|includeonly|onlyinclude|nowiki)>")
_HOLDERS = r"\{\{\{[^{}]*\}\}\}"
_TEMPLATES = r"\{\{[^{}]*\}\}"
#: What is left of templates that were never closed, or whose opening is gone.
_TORN = r"^(?:\|\s*[\w -]{1,30}=.*|\{\{[^{}]*|\}\})$"
_HEADING = r"^=.*=$"
_CATEGORY = r"(?i)\[\[\s*(?:category|kategorie|cat[ée]gorie|categor[íi]a)\s*:[^\[\]\n]*\]\]"
_CELL = r"(?i)<t[dh]\b[^<>\n]*>"
_TAG = r"</?[A-Za-z][^<>\n]*>"
_LINK = r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]"

_BULLET = r"^\s*(?:[*#:;•·–—-]|\(?\d{1,3}[.)]\s|[a-zA-Z][.)]\s)"
_TABLE = r"^\s*(?:\||!|\{\|)|\|\||!!\s"
_ENDS = r"""[.!?…:]["'”»)\]]*\s*$"""
_SENTENCE_END = r"[.!?…](?:\s|$)"
_ELLIPSIS = r"(?:\.\.\.|…)\s*$"

STATS = (
    "words bigint, mean_word_length double, symbol_share double, lines bigint, punctuated_share double, bullet_share double, "
    "ellipsis_share double, alphabetic_share double, common_share double, prose_share double, is_prose boolean, reasons string"
)


def strip_markup(texts: pa.Array) -> pa.Array:
    """The texts without what doesn't count."""
    for pattern in _CUT_FIRST:
        texts = pc.replace_substring_regex(texts, pattern, "")
    # templates inside templates, deepest first, until nothing changes
    while True:
        open_at = pc.match_substring(texts, "}}")
        if not pc.any(open_at).as_py():
            break
        # only texts that still have a template are scanned again
        rows = np.flatnonzero(open_at.to_numpy(zero_copy_only=False))
        some = texts.take(pa.array(rows))
        cut = pc.replace_substring_regex(pc.replace_substring_regex(some, _HOLDERS, ""), _TEMPLATES, "")
        if pc.all(pc.equal(cut, some)).as_py():
            break
        texts = pc.replace_with_mask(texts, open_at, cut)
    texts = pc.replace_substring_regex(texts, _CELL, "||")
    texts = pc.replace_substring_regex(texts, _TAG, " ")
    texts = pc.replace_substring_regex(texts, _CATEGORY, "")
    texts = pc.replace_substring_regex(texts, _LINK, r"\1")
    return pc.replace_substring(pc.replace_substring(texts, "'''", ""), "''", "")


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines that count, trimmed, the number of the text each is in, and whether it directly follows another one."""
    split = pc.split_pattern(pc.replace_substring(texts, "\r", "\n"), "\n")
    lines, doc = pc.utf8_trim_whitespace(split.flatten()), _owners(split)
    kept = (pc.binary_length(lines).to_numpy(zero_copy_only=False) > 0) & ~_flags(lines, _HEADING) & ~_flags(lines, _TORN)
    follows = np.diff(np.flatnonzero(kept), prepend=-2) == 1
    follows[1:] &= np.diff(doc[kept]) == 0
    return lines.filter(pa.array(kept)), doc[kept], follows


def _flags(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def _counts(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def _owners(lists: pa.Array) -> np.ndarray:
    """For each flattened value, the number of its list from 0, in a slice too."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


class Scorer:
    """Statistics of batches of texts, given the common words of each language."""

    def __init__(self, common: list[tuple[str, str]]):
        self.words = pa.array(sorted({word.lower() for _, word in common}), pa.large_string())

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        n_docs = len(texts)
        lines, doc, follows = lines_of(strip_markup(pc.fill_null(texts.cast(pa.large_string()), "")))
        size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.float64)
        n_lines = len(lines)

        tokens = pc.utf8_split_whitespace(lines)
        token_line = _owners(tokens)
        coded = pc.dictionary_encode(tokens.flatten())
        which = coded.indices.to_numpy(zero_copy_only=False)
        # each distinct token is looked at once
        bare = pc.utf8_lower(pc.utf8_trim(coded.dictionary, """.,;:!?"'()[]{}«»„“”‘’…-–—/*|"""))
        length = pc.utf8_length(bare).to_numpy(zero_copy_only=False).astype(np.float64)[which]
        known = pc.is_in(bare, value_set=self.words).to_numpy(zero_copy_only=False)[which]
        # a word is a token with a letter; figures and marks by themselves are not
        lettered = _flags(bare, r"\p{L}")[which]
        per_line = lambda w=None: np.bincount(token_line, weights=w, minlength=n_lines).astype(np.float64)
        n_tokens, n_words, in_words = per_line(), per_line(lettered), per_line(length * lettered)
        common = per_line(known)

        bullet, table = _flags(lines, _BULLET), _flags(lines, _TABLE)
        ends, ellipsis = _flags(lines, _ENDS), _flags(lines, _ELLIPSIS)
        symbols = _counts(lines, r"[^\p{L}\p{N}\s.,;:'’()\"-]").astype(np.float64)
        # lines wrapped by the writer are one paragraph: one that ends no sentence goes on in the next
        free = ~bullet & ~table
        opens = np.ones(n_lines, bool)
        opens[1:] = ~(follows & free)[1:] | ~(free & ~ends)[:-1]
        block = np.cumsum(opens) - 1
        n_blocks = int(block[-1]) + 1 if n_lines else 0
        per_block = lambda w: np.bincount(block, weights=w, minlength=n_blocks).astype(np.float64)
        last_end = np.full(n_blocks, -1)
        np.maximum.at(last_end, block, np.where(_counts(lines, _SENTENCE_END) > 0, np.arange(n_lines), -1))
        block_words, block_tokens = per_block(n_words), per_block(n_tokens)
        block_length = _ratio(per_block(in_words), block_words)
        # the published rules, paragraph by paragraph; what follows the last end of a sentence is no sentence
        broken = {
            "unended": np.arange(n_lines) > last_end[block],
            "bullets": ~free,
            "word_length": ((block_length < MEAN_WORD_LENGTH[0]) | (block_length > MEAN_WORD_LENGTH[1]))[block],
            "symbols": (per_block(symbols) > MOST_SYMBOLS_PER_WORD * block_tokens)[block],
            "alphabetic": (block_words < LEAST_ALPHABETIC_WORDS * block_tokens)[block],
            "common_words": (per_block(common) < LEAST_COMMON_WORDS)[block],
        }
        prose = ~np.logical_or.reduce(list(broken.values()))
        per_doc = lambda w=None: np.bincount(doc, weights=w, minlength=n_docs).astype(np.float64)
        chars, words, tokens_in, all_lines = per_doc(size), per_doc(n_words), per_doc(n_tokens), per_doc()
        stats = {
            "words": words.astype(np.int64),
            "mean_word_length": _ratio(per_doc(in_words), words),
            "symbol_share": _ratio(per_doc(symbols), chars),
            "lines": all_lines.astype(np.int64),
            "punctuated_share": _ratio(per_doc(ends), all_lines),
            "bullet_share": _ratio(per_doc(bullet), all_lines),
            "ellipsis_share": _ratio(per_doc(ellipsis), all_lines),
            "alphabetic_share": _ratio(words, tokens_in),
            "common_share": _ratio(per_doc(common), words),
            "prose_share": _ratio(per_doc(size * prose), chars),
        }
        failed = {
            "empty": chars == 0,
            "not_prose": (chars > 0) & (stats["prose_share"] <= LEAST_PROSE_SHARE),
            **{name: (chars > 0) & (per_doc(size * flags) >= LEAST_PROSE_SHARE * chars) for name, flags in broken.items()},
            "few_words": words < LEAST_WORDS,
            "many_words": words > MOST_WORDS,
            "ellipses": stats["ellipsis_share"] > MOST_ELLIPSIS_LINES,
        }
        stats["is_prose"] = ~(failed["empty"] | failed["not_prose"])
        # texts that fail the same rules share one string
        code = sum((flags.astype(np.int64) << k for k, flags in enumerate(failed.values())), np.zeros(n_docs, np.int64))
        kinds, which_kind = np.unique(code, return_inverse=True)
        joined = pa.array([",".join(name for k, name in enumerate(failed) if kind >> k & 1) for kind in kinds], pa.string())
        stats["reasons"] = joined.take(pa.array(which_kind))
        return stats


#: A list of common words is small by nature; a longer one is refused.
MOST_COMMON_WORDS = 10_000


def common_words(words: DataFrame) -> list[tuple[str, str]]:
    """The (language, word) pairs of a table, without nulls."""
    found = words.select("lang", "word").dropna().distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(found) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    return sorted((r.lang, r.word) for r in found)


def text_quality(documents: DataFrame, common_words: list[tuple[str, str]], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, statistics..., is_prose, reasons): one row per row of ``documents``.

    The published rules are applied to paragraphs: sentences that end, no bullets or cells, the mean
    word length, symbols per word, the share of words with letters, and at least two common words of
    any language, whatever ``lang`` says. ``is_prose`` is false for a text of which nothing is left,
    and if at least half of its characters are in paragraphs that fail a rule. ``reasons`` lists, in a
    fixed order, separated by commas, ``empty`` or ``not_prose``, every rule that paragraphs with at
    least half of the characters fail, and the rules on whole texts (number of words, lines that end
    in an ellipsis), which are recorded only, as short stubs are prose too.

    ``common_words`` are (language, word) pairs, a fixed small list. Null and empty texts fail as ``empty`` with zeros.
    Texts are taken whole. Rows with a null id are kept. An empty table gives no rows.
    """
    key = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(common_words)
        for batch in batches:
            for piece in _pieces(batch):
                stats = scorer.score(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(v) if isinstance(v, np.ndarray) else v for v in stats.values()]], names=["doc_id", *stats])

    return documents.select(doc_id, text).mapInArrow(run, f"doc_id {key}, {STATS}").withColumnRenamed("doc_id", doc_id)


#: Bytes of text looked at at once, to bound a Python worker's memory; a longer text is a piece by itself.
PIECE_BYTES = 8_000_000


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PIECE_BYTES of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero(np.diff(ends // PIECE_BYTES, prepend=0))
    bounds = [0, *[int(c) for c in cut if c], batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)
