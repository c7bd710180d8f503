"""The llm operators against brute force, with nulls, ties, copies, empty tables and extra columns."""

import itertools
import math
import os
import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm.mixing import budgets, mixture, weighted_lengths
from causeway.llm.packing import difference, fill_report, least_windows, pack, pack_documents
from causeway.llm.percentiles import RELATIVE_ERROR, merge, percentiles, sketch
from causeway.llm.quality import Scorer, text_quality
from causeway.llm.runs import collapse_runs
from causeway.llm.tokens import TOKENIZER_DIR, VOCABULARY, counter, load, token_counts
from causeway.scratch import Scratch

VOCAB = f"{TOKENIZER_DIR}/{VOCABULARY}"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file")


@pytest.fixture
def small_shards(monkeypatch):
    import causeway.skew

    monkeypatch.setattr(causeway.skew, "unit_rows", lambda total, floor=0: 3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_percentiles_keep_their_bound(spark):
    rnd = random.Random(5)
    values = [rnd.choice([-1, 1]) * int(math.exp(rnd.uniform(0, 25))) for _ in range(800)] + [0] * 40 + [1, -1, None, None]
    data = [(k % 3 if k % 7 else None, k % 5, v, "x") for k, v in enumerate(values)]
    df = spark.createDataFrame(data, "grp bigint, piece bigint, v bigint, n string")
    qs = [0.0, 0.01, 0.3, 0.5, 0.9, 1.0]
    whole = sketch(df, ["grp"], F.col("v"))
    pieces = merge(sketch(df, ["grp", "piece"], F.col("v")), ["grp"])
    assert rows(whole) == rows(pieces)
    got = {(r.grp, r.q): r for r in percentiles(whole, ["grp"], qs).collect()}
    for grp in {d[0] for d in data}:
        mine = sorted(d[2] for d in data if d[0] == grp and d[2] is not None)
        for q in qs:
            true = mine[math.floor(q * (len(mine) - 1))]
            assert got[grp, q].n == len(mine)
            assert abs(got[grp, q].value - true) <= RELATIVE_ERROR * abs(true) * (1 + 1e-9)
    every = percentiles(merge(whole, []), [], [0.5]).collect()
    assert len(every) == 1 and every[0].n == len(values) - 2
    assert rows(percentiles(sketch(df.limit(0), ["grp"], F.col("v")), ["grp"], qs)) == []
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1e-300,), (-5e-324,)], "v double")
    got = [r.value for r in percentiles(sketch(ends, [], F.col("v")), [], [0, 1]).collect()]
    assert sorted(got) == [float("-inf"), float("inf")]


@pytest.mark.parametrize("small", [False, True])
def test_runs(spark, request, small):
    if small:
        request.getfixturevalue("small_shards")
    rnd = random.Random(7)
    data = []
    for k in range(160):
        data.append((k, rnd.choice([1, 1, 1, 2, None]), rnd.choice([5, 5, 5, 6, None]), rnd.choice(["a", "a", "A", "b", None]), rnd.choice([None, *range(30)])))
    data += [(1000 + k, 9, 5, "a", k // 3) for k in range(40)]  # one long run with ties
    df = spark.createDataFrame([(*d, "z") for d in data + data[:25]], "id bigint, task bigint, resource bigint, op string, ts bigint, entity string")
    got = collapse_runs(df, Scratch(spark), len(data), entity="task", row_id="id", ts="ts", alike=[F.col("resource"), F.lower("op")])
    want = []
    for task in {d[1] for d in data if d[1] is not None}:
        mine = sorted((d for d in data if d[1] == task and d[4] is not None), key=lambda d: (d[4], d[0]))
        same = lambda a, b: None not in (a[2], b[2], a[3], b[3]) and a[2] == b[2] and a[3].lower() == b[3].lower()
        group = []
        for d in mine:
            if group and same(group[-1], d):
                group.append(d)
            else:
                group = [d]
                want.append((task, group))
    want = [(t, g[0][0], g[-1][0], len(g), g[-1][4] - g[0][4]) for t, g in want if len(g) > 1]
    assert rows(got) == sorted(want, key=repr)
    empty = collapse_runs(df.limit(0), Scratch(spark), 0, entity="task", row_id="id", ts="ts", alike=[F.col("resource")])
    assert rows(empty) == []


def test_difference_and_pack():
    rnd = np.random.default_rng(2)
    assert difference(np.array([8, 7, 6, 5, 4]), 2)[1].tolist() == [16, 14]  # the known result of two-way differencing
    for _ in range(40):
        sizes = np.sort(rnd.integers(1, 60, rnd.integers(1, 40)))[::-1]
        ways = int(rnd.integers(1, 12))
        windows, sums = difference(sizes, ways)
        assert np.bincount(windows, sizes, ways).astype(int).tolist() == sums.tolist()
        windows, used = pack(sizes, 64)
        assert np.bincount(windows, sizes, used).max() <= 64 and used >= least_windows(sizes, 64) >= math.ceil(sizes.sum() / 64)
    for _ in range(30):  # the bound against all packings
        sizes = rnd.integers(1, 11, 6)
        best = min(len(set(a)) for a in itertools.product(range(6), repeat=6) if np.bincount(a, sizes, 6).max() <= 12)
        assert least_windows(sizes, 12) <= best


def test_pack_documents(spark):
    rnd = random.Random(4)
    data = [(k, rnd.choice([0, 3, 10, 10, 64, 65, 128, 500, rnd.randrange(1, 90)]), "x") for k in range(300)] + [(None, 5, "x"), (999, None, "x")]
    lengths = spark.createDataFrame(data, "doc_id bigint, tokens bigint, container string")
    capacities = spark.createDataFrame([("s", 64), ("l", 256), ("l", 256)], "pack_name string, capacity_tokens int")
    packed = pack_documents(lengths, capacities, chunk_containers=8)
    got = packed.collect()
    for name, capacity in (("s", 64), ("l", 256)):
        mine = [r for r in got if r.pack_name == name]
        held, parts = {}, {}
        for r in mine:
            held[r.container] = held.get(r.container, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append((r.start_token, r.tokens))
        assert max(held.values()) <= capacity
        assert set(parts) == {d[0] for d in data if d[0] is not None and d[1]}
        for doc, tokens, _ in data:
            if doc is not None and tokens:
                at = 0
                for start, size in sorted(parts[doc]):
                    assert start == at
                    at += size
                assert at == tokens and (len(parts[doc]) == 1 or tokens > capacity)
                assert len(parts[doc]) == math.ceil(tokens / capacity)
    report = {r.pack_name: r for r in fill_report(packed, capacities).collect()}
    assert report["l"].fill > 0.9 and report["l"].tokens == sum(d[1] or 0 for d in data if d[0] is not None)
    assert rows(pack_documents(lengths, capacities, chunk_containers=8)) == rows(packed)
    assert pack_documents(lengths.limit(0), capacities).count() == 0
    with pytest.raises(ValueError):
        pack_documents(lengths, spark.createDataFrame([("s", 0)], "pack_name string, capacity_tokens int"))


@needs_vocabulary
def test_token_counts(spark):
    encode = load(VOCAB).encode_ordinary
    rnd = random.Random(9)
    alphabet = ["a", "B", "é", "ß", "1", "²", "½", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "'s", "'ll", "_", "<|endoftext|>", "—", ".", "日本", "𝒳", "́"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(400)] + ["", " ", "\n\n", "h" * 30_000, "word " * 20_000]
    assert [counter(VOCAB).of(t) for t in texts] == [len(encode(t)) for t in texts]
    df = spark.createDataFrame([(1, "one two", 5), (2, None, 5), (3, "", 5)], "doc_id bigint, text string, tokens int").select("doc_id", "text")
    assert rows(token_counts(df, keep=["doc_id"])) == [(1, 2), (2, 0), (3, 0)]


def test_budgets():
    plan = budgets({"a": 100, "b": 50, "x": 9}, [("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], None)
    assert set(plan) == {"a", "b"}
    total = {s: e * {"a": 100, "b": 50}[s] + r for s, (_, e, r) in plan.items()}
    assert total["a"] == 100 and abs(total["b"] - 80) <= 1
    capped = budgets({"a": 100, "b": 50}, [("a", 0.5, 1), ("b", 0.5, 1)], 1000)
    assert (capped["a"][1:], capped["b"][1:]) == ((1, 0), (1, 0))
    assert budgets({}, [("a", 1.0, 1)], None) == {}


@pytest.mark.parametrize("slice_rows", [50_000, 7])
def test_mixture(spark, slice_rows):
    rnd = random.Random(11)
    data = [(k, rnd.choice(["a"] * 6 + ["b", "c", None, "unlisted"]), rnd.choice([0, *range(1, 40)]), rnd.choice([None, -1.0, 0.0, 0.3, 1.0]), "x") for k in range(600)] + [(None, "a", 5, 1.0, "x")]
    lengths = spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint, weight double, rest string").drop("rest")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("gone", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture(lengths, targets, slice_rows=slice_rows)
    got = mixed.collect()
    repeats = {"a": 1, "b": 4, "c": 2}
    tokens = {d[0]: d[2] for d in data}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.repeats <= repeats[r.source] for r in got)
    assert {r.doc_id: r.tokens for r in got} == {r.doc_id: tokens[r.doc_id] for r in got}
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"a", "b", "c", "gone"}
    for s in repeats:
        used = sum(r.tokens * r.repeats for r in got if r.source == s)
        assert by[s].tokens == used and 0 <= by[s].budget_tokens - used < 40
        assert by[s].most_repeats <= repeats[s]
        # complete epochs come before the part: counts differ by one at most
        mine = [r.repeats for r in got if r.source == s]
        assert max(mine) - min(mine) <= 1
    whole = sum(r.tokens for r in by.values())
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9 and by["gone"].tokens == 0 and whole > 0
    assert abs(by["b"].actual_share - 0.3 / 0.9) < 0.05
    again, _ = mixture(lengths, targets, slice_rows=slice_rows)
    assert rows(again) == rows(mixed)
    none, empty = mixture(lengths.limit(0), targets)
    assert none.count() == 0 and {r.actual_share for r in empty.collect()} == {None}


def test_mixture_prefers_weight(spark):
    lengths = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("bigint").alias("tokens"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.2).alias("weight"))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mixture(lengths, targets, total_tokens=8000)[0].collect()
    heavy = sum(r.doc_id % 2 == 0 for r in got)
    assert len(got) == 800 and 620 < heavy < 710  # 800 * 5 / 6 at first, less as heavy ones run out


COMMON = [("en", w) for w in "the of and in to a is was it by which with from".split()] + [("de", w) for w in "der die das und in ist von mit ein".split()]
PROSE = "The mill was built by the council in 1820, and it is the largest of its kind in the valley. "
CASES = [
    (PROSE, True),
    ("{{Infobox place\n| name = {{unit|5}}\n| area = 3\n}}\n\n" + PROSE + "\n\n[[Category:Mills]]", True),
    ("\n".join(textwrap.wrap(PROSE * 3, 72)), True),
    ("Der Hof ist ein Teil von Aldorf und mit der Stadt verbunden.", True),
    (PROSE + "<!-- a note --><ref name=\"x\">The rest of it</ref>", True),
    (None, False),
    ("", False),
    ("  \n \n", False),
    ("#REDIRECT [[Mill]]", False),
    ("{{stub}}\n{{row|a|5}}", False),
    ("* the old mill\n* the new mill\n* a bridge of stone", False),
    ("{| class=\"wikitable\"\n! Name !! Size\n|-\n| The mill || 5\n|}", False),
    ("<table>\n<tr><td>the mill</td><td>5</td></tr>\n</table>", False),
    ("1;2;the;4\n5;6;of;8", False),
    ("the in and 5 mill of was stone a to bridge it by which from the of " * 4, False),
    ("HELLO!!!!!!!!!!!!!\nHELLO!!!!!!!!", False),
    ("QkFTRTY0" * 60, False),
    ("{{{name}}} ({{{year}}})\n[[Category:{{{region}}}]]", False),
    ("== The heading of it ==", False),
    (PROSE * 3000, True),
    (PROSE + "\n* " + "[[Some item]] " * 40, False),
]


def test_quality(spark):
    df = spark.createDataFrame([(k, t, "wrong", 1) for k, (t, _) in enumerate(CASES)] + [(None, PROSE, None, 1)], "doc_id bigint, text string, lang string, words int").drop("words").withColumn("reasons", F.lit("extra"))
    got = text_quality(df, COMMON).collect()
    assert len(got) == len(CASES) + 1
    by = {r.doc_id: r for r in got}
    assert [by[k].is_prose for k in range(len(CASES))] == [want for _, want in CASES]
    assert by[5].reasons == "empty,few_words" and by[5].words == 0
    assert by[0].words == 19 and by[0].punctuated_share == 1.0 and by[0].reasons == "few_words"
    assert by[10].bullet_share == 1.0 and "bullets" in by[10].reasons and "not_prose" in by[10].reasons
    assert by[19].words == 19 * 3000
    assert text_quality(df.limit(0), COMMON).count() == 0


def test_quality_does_not_depend_on_batches():
    import pyarrow as pa

    texts = pa.array([t for t, _ in CASES] * 3)
    whole = Scorer(COMMON).score(texts)
    for k in range(0, len(texts), 5):
        part = Scorer(COMMON).score(texts.slice(k, 5))
        for name in whole:
            assert list(map(str, whole[name][k : k + 5])) == list(map(str, part[name])), name


@needs_vocabulary
def test_weighted_lengths(spark):
    df = spark.createDataFrame([(1, PROSE, "a"), (2, "* x", "a"), (3, None, None)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in weighted_lengths(df, COMMON).collect()}
    assert got[1].weight == 1.0 and got[2].weight == pytest.approx(0.1) and got[3].tokens == 0


def test_deep_templates_and_ended_sentences():
    deep = lambda n: "{{a " * n + "x" + "}}" * n
    texts = [PROSE + deep(n) for n in (2, 14, 60)] + [PROSE + "<sup>[Aldorf 1918]</sup>", PROSE + "Alpha, Beta, Gamma, and so", PROSE + "\n" + "Alpha, Beta, Gamma, " * 12]
    import pyarrow as pa

    got = Scorer(COMMON).score(pa.array(texts))
    assert got["is_prose"].tolist() == [True, True, True, True, True, False]
    assert got["prose_share"][:4].tolist() == [1.0] * 4 and 0.5 < got["prose_share"][4] <= 1.0
    assert "unended" in got["reasons"].to_pylist()[5]


def test_answers_keep_the_stated_bound(spark, tmp_path):
    from causeway.llm.queries import p2_percentiles

    rnd = random.Random(8)
    polls = [(k, k % 5, k, k + took) for k, took in enumerate([*range(0, 700), *(int(math.exp(rnd.uniform(0, 26))) for _ in range(900)), -58, -1])]
    spark.createDataFrame(polls, "id bigint, task bigint, start_ts bigint, end_ts bigint").write.parquet(f"{tmp_path}/polls.parquet")
    for r in p2_percentiles(spark, str(tmp_path)).collect():
        mine = sorted(e - s for _, t, s, e in polls if r.key is None or t == r.key)
        true = mine[math.floor(r.q * (len(mine) - 1))]
        assert r.n == len(mine) and abs(r.value - true) <= RELATIVE_ERROR * abs(true)


def test_shards_of_unequal_weights_are_even(spark):
    from causeway.skew import assign_shards, shard_cuts

    keyed = spark.range(20_000).withColumn("source", F.lit("a")).withColumn("_key", -F.log((F.pmod(F.xxhash64("id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / F.when(F.col("id") % 2 == 0, 0.1).otherwise(1.0))
    cuts = shard_cuts(keyed, "source", ["_key", "id"], 20_000, 1_000)
    sizes = [r[1] for r in assign_shards(keyed, cuts, "source", ["_key", "id"]).groupBy("_shard").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_chunks_are_bounded_in_items(spark):
    lengths = spark.range(900).select(F.col("id").alias("doc_id"), F.lit(1).cast("bigint").alias("tokens"))
    capacities = spark.createDataFrame([("s", 1000)], "pack_name string, capacity_tokens int")
    got = pack_documents(lengths, capacities, chunk_items=100).collect()
    chunks = {}
    for r in got:
        chunks.setdefault(r.container.split("-")[0], []).append(r.doc_id)
    assert len(got) == 900 and len(chunks) == 9 and max(map(len, chunks.values())) < 200
