import random
from collections import Counter
from fractions import Fraction

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.llm import mixing, oracles, quality


def words_of(text):
    return (text or "").encode().split()


def brute(text):
    text, ws = text or "", words_of(text)
    keys = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    seen = Counter(keys)
    covered = {i + k for i, key in enumerate(keys) if seen[key] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    chars = sum(len(w.decode()) for w in ws)
    return len(ws), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 40, "l1 a\nl1 a\n\nl1 a\nl2",
    "the cat sat on the mat and looked at the dog by the door " * 3, "é ü ß 中文 | * #", "word\x0bnext\x0clast\x1cend",
    "The end of the story is here and nothing of it was for us to tell.\n" + "q" * 100_000,
]


def mess(seed, n=80):
    r = random.Random(seed)
    return [" ".join(r.choice("a b c the of d\n e f* g".split(" ")) for _ in range(r.randrange(60))) for _ in range(n)]


def test_quality_counts_against_brute_force(spark):
    texts = TEXTS + mess(1)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    rows = {r["doc_id"]: r for r in quality.score(docs).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert not rows[10]["kept"] and not rows[0]["kept"] and not rows[6]["kept"]  # a word of 100 letters and no stop words, no text, one word
    prose = "The cat of the house sat by the door and it was not to go out for a walk with us, so we sat down in the garden."
    assert quality.score(spark.createDataFrame([(1, prose)], "doc_id long, text string")).first()["kept"]
    assert quality.score(docs.limit(0)).count() == 0
    assert quality.keep(docs).columns == docs.columns


def test_quality_equals_its_sql(spark):
    texts = TEXTS + mess(2)
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(oracles.OP1).fetchdf().sort_values("doc_id").reset_index(drop=True)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality.score(docs).toPandas()[list(want.columns)].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def targets(sizes):
    """The contract word by word: shares by weight, excess over three times the size reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        aim = {s: Fraction(rest * weight[s], w) for s in free}
        over = [s for s in free if aim[s] > 3 * sizes[s]]
        if not over:
            return fixed | aim
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(3)
    rows = []
    for i in range(3000):
        source = r.choice(["a"] * 20 + ["b", "B", "é", "tiny", None])
        n = 0 if r.random() < 0.05 else r.randrange(1, 200) if source != "tiny" else 3
        rows.append((i, None if r.random() < 0.01 else "w " * n, source))
    rows += [(-5, "x y z " * 5000, "b"), (None, "a b c", "a"), (7, "a b", "a"), (7, "a b", "a"), (9000, None, "only nulls")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for clash in ("size", "place", "taken", "shard", "row", "_mix_row", "mix_row"):
        docs = docs.withColumn(clash, F.lit("x"))
    return rows, docs, mixing.mix(docs).toPandas()


def test_mix_targets_and_limits(mixed):
    rows, _, got = mixed
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    aim = targets(sizes)
    assert len(got) == len(rows)
    for s, part in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert (part["source_size"] == sizes[s]).all()
        assert part["target"].iloc[0] == pytest.approx(float(aim[s]), rel=1e-9)
        assert abs(part["taken"].sum() - float(aim[s])) <= 3 * mixing.BLOCK
    assert (got["taken"] <= 3 * got["size"]).all()


def test_mix_is_stable_and_equals_its_sql(spark, mixed):
    rows, docs, got = mixed
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken", "target"]
    order = lambda f: f[key].sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(again))
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, "doc_id long, text string, source string").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(oracles.OP10).fetchdf()
    pd.testing.assert_frame_equal(order(got.astype({"doc_id": "Int64"})), order(want.astype({"doc_id": "Int64"})), check_dtype=False)


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_draws_use_each_block_once_a_pass(spark):
    sizes = spark.createDataFrame([("a", 64 * 100), ("b", 64 * 7 + 3), ("c", 10)], "source string, source_size long")
    plan = mixing.targets(sizes)
    slots = mixing.draws(plan).toPandas()
    assert not slots.duplicated(["shard", "slot"]).any() and (slots.groupby("shard")["slot"].max() + 1 == slots.groupby("shard").size()).all()
    for r in plan.collect():
        own = slots[slots["place"] == r["place"]]["block"].value_counts()
        assert own.sum() == r["n_slots"] and own.max() <= -(-r["n_slots"] // r["n_blocks"]) and own.index.max() < r["n_blocks"]


def test_mixed_documents_follow_the_shares(mixed, spark):
    _, docs, got = mixed
    out = mixing.mixed_documents(docs).cache()
    assert out.columns == docs.columns
    words = out.selectExpr("source", "size(array_remove(split(text, ' '), '')) AS n").groupBy("source").sum("n").collect()
    mix = mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).collect()
    have, want = {r[0]: r[1] for r in words}, {r[0]: r[1] for r in mix}
    longest = {r[0]: r[1] for r in got.groupby("source", dropna=False)["size"].max().reset_index().itertuples(index=False)}
    longest = {None if pd.isna(s) else s: n for s, n in longest.items()}
    for source in want:
        assert abs(have.get(source, 0) - want[source]) <= longest[source], source
    assert abs(have["a"] - want["a"]) < 0.01 * want["a"]


def test_null_and_repeated_ids_neither_multiply_nor_vanish(spark):
    rows = [(None, f"w{i} x y", "s") for i in range(20)] + [(1, "a b c", "s"), (1, "d e f", "s"), (1, "d e f", "s"), (2, "g h i", "s")]
    out = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert Counter(map(tuple, out.collect())) == Counter(rows)  # one source: its target is its size


def test_one_long_document_beside_many_short_ones(spark):
    rows = [(i, "w " * 10, "many") for i in range(1000)] + [(5000, "v " * 3000, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {r[0]: r[1] for r in mixing.mixed_documents(docs).groupBy("source").agg(F.sum((F.length("text") / 2).cast("long"))).collect()}
    assert words["one"] == 3000 and abs(words["many"] - 13000 * 5 / 7) <= mixing.BLOCK  # 13,000 words, 2 of 7 for the one: 3,714


def test_shards_draw_multinomial_counts(spark):
    sizes = spark.createDataFrame([("a", 64 * 40_000), ("b", 64 * 9_000), ("c", 64 * 50)], "source string, source_size long")
    plan = mixing.targets(sizes)
    slots = {r["place"]: r["n_slots"] for r in plan.collect()}
    counts = mixing.shard_counts(plan).toPandas().pivot(index="shard", columns="place", values="n").fillna(0)
    total = sum(slots.values())
    assert counts.sum().to_dict() == slots and len(counts) == round(total / mixing.SHARD)
    size = counts.sum(axis=1)
    assert abs(size.mean() - mixing.SHARD) < 20 and 10 < size.std() < 90
    for place, n in slots.items():
        share = n / total
        spread = (counts[place] - size * share) / (size * share * (1 - share)) ** 0.5
        assert abs(spread.mean()) < 0.5 and 0.6 < spread.std() < 1.5, place
    drawn = mixing.draws(plan).groupBy("shard", "place").count().toPandas().pivot(index="shard", columns="place", values="count").fillna(0)
    assert (drawn == counts).all().all()


def test_shards_hold_the_words_that_are_taken(spark):
    r = random.Random(5)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(r.randrange(0, 90))), r.choice(["a", "a", "a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.shards(docs).collect()
    texts = {i: t.split() for i, t, _ in rows}
    given, blocks = Counter(), {}
    for p in found:
        ws = p["text"].split()
        given[p["doc_id"]] += len(ws)
        assert " ".join(ws) in " ".join(texts[p["doc_id"]])
        blocks.setdefault((p["shard"], p["slot"]), []).append((p["at"], len(ws), p["source"]))
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]} == dict(given)
    for parts in blocks.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:]))
        assert len({s for *_, s in parts}) == 1 and sum(n for _, n, _ in parts) <= mixing.BLOCK
