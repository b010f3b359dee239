import random

import pytest

from geoloom.llm import neardup


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, percent):
    sets = sets_of(rows)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            met = len(sets[a] & sets[b])
            if met and 100 * met >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs = []
    for _ in range(60):
        docs.append(text(r.randrange(3, 200)))
    for size, edits in ((40, 1), (30, 2), (30, 3), (25, 5), (3, 1), (2, 1)):  # groups of near copies, some without their original
        base = text(150)
        if size != 30:
            docs.append(base)
        for _ in range(size):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            docs.append(copy)
    for _ in range(50):  # a common passage in otherwise different texts
        docs.append(text(25) + passage + text(r.randrange(10, 40)))
    chain = text(120)
    for _ in range(25):  # each like the one before, the ends unlike
        chain = chain[3:] + text(3)
        docs.append(list(chain))
    docs += [docs[70]] * 15 + [list(map(str.upper, docs[70]))] * 2
    r.shuffle(docs)
    rows = [(i * 3 + 1, " ".join(d)) for i, d in enumerate(docs)]
    return rows + [(100_000, None), (100_001, ""), (100_002, " \n"), (100_003, "one two"), (100_004, "One  TWO"), (100_005, "É é")]


@pytest.mark.parametrize("percent", [85, 80, 60])
def test_components_against_brute_force(spark, percent):
    rows = corpus(percent)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_shingles int, mark string")
    got = neardup.near_duplicates(docs, percent).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_dealt_keys_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 4)
    rows = corpus(7)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 80)


def test_keep_one_loses_no_text(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, text("a"), "x"), (1, text("b"), "y"), (1, text("a"), "z"), (None, text("c"), "x"), (None, text("c"), "x"), (2, text("a") + " z", "w"), (3, None, "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = neardup.keep_one(docs, 80)
    assert out.columns == docs.columns
    want = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("c")), (3, None), (4, "")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, want))
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_edges_of_the_input(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, None, True), (5, 5, True), (5, 5, True), (9, 5, False), (9, 5, False)]
    assert sorted((r["doc_id"] or 0) for r in neardup.keep_one(docs).collect()) == [0, 5]


def test_long_text(spark):
    long = " ".join(f"v{i}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short one here and there")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 85).collect()}
    assert got == {1: (119_996, 1), 2: (119_997, 1), 3: (1, 3)}
