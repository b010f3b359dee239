import hashlib
import random

import pytest

import corpus_pipeline
from geoloom.llm import mixing, quality

EN = "the of and to in is was for that with as by".split()
FR = "le la de et un est pour que dans les des sur".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    rows = []

    def text(words, n=80):
        return " ".join(r.choice(words) if r.random() < 0.3 else "".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    for i in range(150):
        fr = i % 3 == 0
        rows.append((i, text(FR if fr else EN), "fr" if fr else "en", f"s{i % 4}", 5))
    base = rows[10][1]
    rows += [(200, base, "en", "s1", 5), (201, base + " tail", "en", "s2", 5), (202, "bad*** text### " * 30, "en", "s1", 5)]
    rows += [(203, None, "en", None, None), (204, "short", None, "s0", 1), (205, "10 20 30 40 50 60 70 80 90 100 110 120", "en", "s0", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.mode("overwrite").parquet(f"{folder}/out_{len(ids)}")
        docs = spark.read.parquet(f"{folder}/out_{len(ids)}")
        ids[name] = [r[0] for r in docs.select("doc_id").collect()]
        if name != "byte-level BPE":
            assert docs.columns == columns
        assert set(ids[name]) <= {r[0] for r in before.select("doc_id").collect()}
    assert list(ids) == ["quality rules", "language ID", "MinHash near-dedup", "mixing sources", "byte-level BPE"]
    assert set(ids["quality rules"]) & {202, 203, 204} == set() and set(range(150)) <= set(ids["quality rules"])
    assert 205 in ids["quality rules"] and 205 not in ids["language ID"] and set(range(150)) <= set(ids["language ID"])
    assert 10 in ids["MinHash near-dedup"] and not {200, 201} & set(ids["MinHash near-dedup"]) and len(ids["MinHash near-dedup"]) == 150
    assert len(ids["byte-level BPE"]) == len(ids["mixing sources"])


def test_run_keeps_rows_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    text = {r["doc_id"]: r["text"] for r in docs}
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in out)


def test_stage_one_equals_scores(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r[0] for r in quality.score(docs).filter("kept").select("doc_id").collect()}
    assert kept == {r[0] for r in quality.keep(docs).select("doc_id").collect()}
    assert mixing.mix(docs).count() == docs.count()
