"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files and the one used by default.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A word with the blanks before it, or blanks at the end. The pattern above never joins a word to
#: the blank behind it, so the token counts of these parts add up to the text's.
_PART = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Parts up to this length are remembered, so many at most, in a worker.
REMEMBERED_LENGTH, REMEMBERED_PARTS = 48, 500_000


def load(path: str):
    """The tokenizer of a rank file, read from ``path`` on the worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class PartCounts(dict):
    """Token counts of parts, made when first asked for."""

    def __init__(self, path: str):
        self.encode = load(path).encode_ordinary

    def __missing__(self, part: str) -> int:
        count = len(self.encode(part))
        if len(part) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_PARTS:
                self.clear()
            self[part] = count
        return count

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, _PART.findall(text))) if text else 0


_COUNTS: dict[str, PartCounts] = {}


def counter(path: str) -> PartCounts:
    """The counts of a vocabulary, kept for the life of a worker."""
    if path not in _COUNTS:
        _COUNTS[path] = PartCounts(path)
    return _COUNTS[path]


def token_counts(documents: DataFrame, *, keep: list[str], text: str = "text", path: str = f"{TOKENIZER_DIR}/{VOCABULARY}", extra: dict[str, Column] | None = None) -> DataFrame:
    """``keep``, then ``extra`` columns, and ``tokens``: the length of the whole text, 0 for null and empty ones.

    Text that looks like a special token is ordinary text.
    """
    extra = extra or {}
    rows = documents.select(*keep, *[c.alias(n) for n, c in extra.items()], F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).of
        for batch in batches:
            counts = [count(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "tokens"])

    return rows.mapInArrow(run, f"{schema}, tokens bigint")
