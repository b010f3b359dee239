import html
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.llm import ann, extract, langid, lm, lm_match

SYLLABLES = {
    "aa": "ka ro mi tu sen vol par".split(), "bb": "xy wq zeh gru plo dri".split(), "cc": "émé çao lùi nèr tô".split(),
}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = []
    for i in range(900):
        lang = r.choice("aa aa aa bb cc".split())
        rows.append((i, prose(r, lang, r.randrange(5, 80)), lang if r.random() < 0.9 else None))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 .. 4", None), (1003, prose(r, "bb", 60_000), "bb"), (None, "ka ro", "aa"), (3, rows[3][1], rows[3][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("key", F.lit(1))


def test_language_of_held_out_texts(docs):
    out = langid.with_language(docs, langid.fit(docs)).withColumn("held", langid.held_out()).collect()
    assert len(out) == docs.count()
    known = [r for r in out if r["held"] and r["lang"] and r["text"]]
    assert len(known) > 100 and sum(r["lang"] == r["lang_pred"] for r in known) >= 0.98 * len(known)
    assert all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "bb"
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)


def test_language_without_labels(spark):
    schema = "doc_id long, text string, lang string, lang_pred int"
    none = spark.createDataFrame([(1, "abc", None, 3)], schema)
    rows = langid.with_language(none, langid.fit(none)).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]
    empty = spark.createDataFrame([], schema)
    assert langid.with_language(empty, langid.fit(empty)).count() == 0


def test_scores_add_up_over_segments():
    r = random.Random(5)
    text = prose(r, "aa", 3000)
    logs = np.random.default_rng(0).normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    size, langid.SEGMENT = langid.SEGMENT, 1000
    try:
        sums, lettered = langid.scores(["", text, None, "12"], logs)
        parts, _ = langid.scores([text[i : i + 1000] for i in range(0, len(text), 1000)], logs)
    finally:
        langid.SEGMENT = size
    assert lettered.tolist() == [False, True, False, False]
    np.testing.assert_allclose(sums[1], parts.sum(axis=0))


def test_lm_base_against_brute_force(spark, docs):
    got = lm.lm_scores(docs, top=50).collect()
    rows = docs.collect()
    held = {r["doc_id"]: zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 1 for r in rows}
    toks = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for r in rows if not held[r["doc_id"]] for w in toks(r["text"]))
    n, v = sum(c.values()), len(c)
    want = {r["doc_id"]: (len(toks(r["text"])), sum(c[w] > 0 for w in toks(r["text"])), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(r["text"]))) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        a, b, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], a, b, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    test = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in test) > 1.15 * sum(r["base_score"] for r in test)
    noise = lm.lm_scores(docs.unionByName(spark.createDataFrame([(5007, "q9 zz0 %% 77x k_k !!", "aa", "x", 1)], docs.schema))).filter("doc_id = 5007").first()
    assert noise["score"] / noise["n_tokens"] < 2 * sum(r["score"] for r in test) / sum(r["n_tokens"] for r in test)


def test_lm_probabilities_add_up_to_one():
    """Of the 256 bytes that may come first, by counts from a few words and weights that have been learnt from them."""
    code, times = lm.Code([b"ab abc b ab ca"]), np.array([40, 20, 20, 20])
    known = lm.Group(lm._pack(b" ".join([b"ab", b"abc", b"b", lm.END])), lm._pack(times), code)
    known.contexts()
    counts = lm.compact(*known.n)
    table = [dict(zip(k.tolist(), counts[at])) for k, at in zip(known.own.keys(known.rows, known.node), known.at)]
    mixer = lm.Mixer().merged(sum(lm.learn(known, np.stack([counts[at] for at in known.at])).sums() for _ in range(3)))
    total = 0.0
    for b in range(256):
        word = lm.END if b == 10 else bytes([b]) + b"x" if b != 32 else b""
        group = lm.Group(lm._pack(word), lm._pack(np.array([1])), code)
        at = np.flatnonzero((group.rows == np.flatnonzero(group.own.hashes[0] == group.own.hashes[0][group.own.use[0]])[0]))
        codes = np.array([[own.get(k, 0) for k in keys] for own, keys in zip(table, group.own.keys(group.rows, group.node))])
        p = mixer.refined(mixer.mixed(*lm.predictions(codes, 2)), group.node)
        total += np.prod(np.where(group.bit == 1, p, 1 - p)[at])
    assert total == pytest.approx(1, abs=1e-6)


def copied(seed=8):
    """Texts of which some share passages, some are copies; in order of id."""
    r = random.Random(seed)
    passage = prose(r, "aa", 120)
    rows = [(i, prose(r, r.choice(["aa", "bb"]), r.randrange(0, 150))) for i in range(120)]
    rows += [(200 + i, prose(r, "aa", r.randrange(5, 40)) + " " + passage + " " + prose(r, "aa", r.randrange(0, 40))) for i in range(12)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 60, 2)] + [(300, rows[0][1])] * 2
    return rows


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_lm_decisions_against_brute_force(spark):
    rows = copied()
    docs = spark.createDataFrame([(i, t, not is_held(i)) for i, t in rows], "id long, text string, train boolean")
    met = {(bytes(r["key"]), r["i"]): r for r in lm_match.candidates(lm.read(docs)[1]).collect()}
    found = []  # (key, train, i, near context, far context, segment) as plain tuples of tokens
    for i, t in rows:
        words = lm.tokens(t.encode())
        h = lm.keys_of(words).view(np.uint64)
        begins = lm_match.segments(h, np.zeros(1, np.int64))[0].tolist()
        for k, (x, y) in enumerate(zip(begins, begins[1:] + [len(words)])):
            far = tuple(words[max(0, x - j - 4) : max(0, x - j)] for j in (0, 4, 8))
            found.append((lm_match.xxhash.xxh3_128_digest(t.encode() + b"\0" + str(i).encode()), not is_held(i), k + 1, tuple(words[max(0, x - 4) : x]), str(far), tuple(words[x:y])))
    want = set()
    for n, (key, train, k, a, b, s) in enumerate(found):
        others = [(x[3], x[4], x[5]) for j, x in enumerate(found) if x[1] and j != n]
        after = Counter(x[2] for x in others if x[0] == a)
        if after:
            top = max(after.values())
            r = met[key, k]
            near = sum(after.values()) - top
            choices = {(s == c, top, near, *(lambda g: (g[c], sum(g.values()) - g[c]))(Counter(x[2] for x in others if x[1] == b))) for c in after if after[c] == top}
            assert (r["hit"], r["m"], r["o"], r["mb"], r["ob"]) in choices
            want.add((key, k))
    assert met.keys() == want and sum(r["hit"] for r in met.values()) > 100


def test_lm_scores_are_the_sum_of_decisions_and_words(spark):
    rows = copied(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame([(i, t, not is_held(i)) for i, t in rows], "id long, text string, train boolean")
    counts, places = lm.read(train)
    counts = counts.cache()
    code = lm.Code([], lm.byte_counts(counts))
    words = lm.counted(lm.groups_of(counts, counts.count()), code, counts.count())
    known = {r["k"]: r for r in lm.word_scores(words, code, spark.sparkContext.broadcast(lm.mixer_of(words))).collect()}
    runs = {bytes(r["key"]): r for r in lm_match.decisions(places).collect()}
    want = {}
    for i, t in rows:
        ws = lm.tokens(t.encode())
        h = lm.keys_of(ws)
        begins = [*lm_match.segments(h.view(np.uint64), np.zeros(1, np.int64))[0].tolist(), len(ws)]
        run = runs.get(lm_match.xxhash.xxh3_128_digest(t.encode() + b"\0" + str(i).encode()))
        done = {w for k in (run["hits"] if run else ()) for w in range(begins[k - 1], begins[k])}
        each = [known[x]["score" if is_held(i) else "own"] for x in h.tolist()]
        want[i] = sum(x for w, x in enumerate(each) if w not in done) + (run["run_score"] if run else 0)
    for top in (10, 1_000_000):
        for r in lm.lm_scores(docs, top=top).collect():
            assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-6), r["doc_id"]
    bits = {r["doc_id"]: r["bits_per_byte"] for r in lm.lm_scores(docs).collect()}
    twice = [i for i in range(0, 60, 2) if len(rows[i][1]) > 300 and not is_held(300 + i)]
    once = [i for i in range(1, 60, 2) if len(rows[i][1]) > 300]
    assert max(bits[i] for i in twice) < min(bits[i] for i in once)


def test_lm_of_nothing(spark):
    schema = "doc_id long, text string"
    assert lm.lm_scores(spark.createDataFrame([], schema)).count() == 0
    row = lm.lm_scores(spark.createDataFrame([(1, None)], schema)).first()
    assert (row["n_tokens"], row["n_known"] in (0, 1)) == (1, True)


def page(main, extra="", cls="story"):
    return (
        "<html><head><title>t</title><style>p{}</style><script>var a='</p><p>no</p>'</script></head><body>"
        "<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class='ad'>Buy this now, it is cheap and good.</div>"
        f"<div class='{cls} c12'>{main}</div><div class='comments'><p>Nice post, dear friend, I liked it a lot!</p></div>{extra}"
        "<aside>More stories for you to read</aside><footer>&copy; someone</footer></body></html>"
    )


def test_extraction_by_consensus(spark):
    body = "<h1>Head</h1><p>One &amp; <b>two</b>\n  three &eacute;<br>four</p><!-- no --><p>Five<p>Six"
    long = "".join(f"<p>Paragraph {i} of a longer text with some words.</p>" for i in range(5))
    odd = page("<p>Tiny.</p>", "<div class='teaser'><p>" + "Another block that is longer than the story. " * 5 + "</p></div>")
    rows = [(i, f"http://a.example/{i}", page(long)) for i in range(8)]
    rows += [(20, "http://a.example/x", page(body)), (21, "http://a.example/y", odd), (22, None, "just text &lt;b&gt;"), (23, "http://b.example", None), (24, "u", ""), (24, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for clash in ("path", "host", "text", "repeated"):
        pages = pages.withColumn(clash, F.lit("x"))
    got = {r["page_id"]: r for r in extract.extract(pages).collect()}
    assert got[20]["text"] == "Head\nOne & two three é four\nFive\nSix"
    assert got[21]["text"] == "Tiny."
    assert got[22]["text"] == "just text <b>"
    assert got[23]["text"] == got[24]["text"] == "" and got[23]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract.extract(pages).count() == len(rows)
    assert extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<" * 5000, "<p" * 3000, "<div>" * 3000 + "x", "<a href='" * 500, "<script>" + "x" * 100, "<p>" + "w " * 200_000 + "</p>", "</b></p></div>x<b>y"])
def test_broken_and_long_pages(html):
    extract.votes(html)
    assert isinstance(extract.main_text(html, "div"), str)


def test_extraction_loses_no_article_text():
    text = lambda body: extract.main_text(f"<html><body><nav>menu</nav><article>{body}</article></body></html>", None)
    assert text("<p>The formula <math><mi>x</mi>=2</math> holds.</p>") == "The formula x=2 holds."
    assert text("<p>One <script>var x='</p>'</script>two <object>three</object></p>") == "One two three"
    prose = "This long paragraph of an article has a class that only looks like one of a widget or of a box."
    assert text(f"<p class='social-history'>{prose}</p>") == prose
    assert text(f"<p>Lead.</p><div class='widget-theory'><p>{prose}</p></div>") == f"Lead.\n{prose}"
    assert text("<p>Lead.</p><div class='share-buttons'><a href=x>Mail</a> <a href=y>Print</a></div><div class='ad-slot'>Buy this, it is a very good thing to have at home and it is cheap as well.</div>") == "Lead."


def test_repeated_suspects_are_boilerplate(spark):
    page = "<body><article><p>{}</p><div class='widget-box'><p>{}</p></div></article></body>"
    same, other = "All our readers may write to us at any time of the day or of the night.", "Only this page has such a block, and it is a part of what the page has to say."
    rows = [(i, f"http://h.example/{i}", page.format(f"Article number {i} is about this and that.", same)) for i in range(3)]
    rows += [(9, "http://h.example/9", page.format("Another article.", other))]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == f"Another article.\n{other}" and got[0] == "Article number 0 is about this and that."


def test_sectioned_articles_are_whole(spark):
    sections = "".join(f"<section><h2>Part {k}</h2><p>{'Some words of this part. ' * 20}</p></section>" for k in range(4))
    body = f"<body><nav>x</nav><article><h1>Title</h1><p>Lead.</p>{sections}<p>End.</p></article><footer>f</footer></body>"
    plain = f"<body><div class=all><div class=post><p>{'First words. ' * 30}</p></div><p>Between.</p><div class=post><p>{'More words. ' * 30}</p></div></div></body>"
    rows = [(i, "http://s.example/", body) for i in range(3)] + [(5, "http://t.example/", plain)]
    got = {r["page_id"]: r["text"].split("\n") for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0][:2] == ["Title", "Lead."] and got[0][-1] == "End." and len(got[0]) == 11
    assert len(got[5]) == 3 and got[5][1] == "Between."


@pytest.mark.parametrize("html", ["<div>x" * 20_000, "<div>" * 20_000 + "</section>" * 20_000, "<h1><div>" + "<b>" * 20_000 + "</h1>" * 20_000, "<ul><li>" * 20_000, "<td>" * 20_000, "<p>" * 20_000])
def test_parsing_is_linear(html):
    began = time.perf_counter()
    extract.votes(html)
    extract.main_text(html, None)
    assert time.perf_counter() - began < 4


def test_extraction_of_planted_articles():
    """Token F1 against the articles of the test table's pages, cut out by their own tags."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/pages.parquet")
    met = had = got = 0
    for page in table.column("html").to_pylist():
        article = re.search(r"<article>(.*)</article>", page or "", re.S)
        if article:
            want = Counter(re.sub(r"<[^>]*>", " ", html.unescape(re.sub(r"<(?=/?[a-z0-9]+>)", "\x00", article[1])).replace("<", "\x01").replace("\x00", "<")).replace("\x01", "<").split())
            found = Counter(extract.main_text(page, None).split())
            met, had, got = met + (want & found).total(), had + want.total(), got + found.total()
    assert had > 10_000 and 2 * met / (had + got) > 0.98


def brute_nearest(rows, top=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    n = np.linalg.norm(x, axis=1)
    out = {}
    for k, q in enumerate(ids):
        if q % 50 == 0:
            s = (x * x[k]).sum(axis=1) / (n * n[k])
            out[int(q)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:top]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] * (i % 2) + rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(5000, [1.0] * 16), (5001, [1.0] * 16), (5002, [2.0] * 16), (5003, [0.0] * 16), (5004, None), (5005, [1.0, None] + [0.0] * 14), (5006, [math.nan] * 16), (5007, [math.inf] + [1.0] * 15), (5008, [1.0] * 7), (None, [1.0] * 16)]
    want = brute_nearest(rows)
    got: dict = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [i for i, _ in got[5000][:2]] == [5001, 5002]
    exact = {q: dict(brute_nearest(rows, 10**6)[q]) for q in (0, 5000)}
    assert all(s == pytest.approx(exact[q][i], abs=1e-12) for q in exact for i, s in got[q])


def test_neighbours_recall_with_a_sampled_index(spark, monkeypatch):
    monkeypatch.setattr(ann, "FIT_ROWS", 4000)
    monkeypatch.setattr(ann, "CHUNK", 512)  # lists are split in chunks
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 1.5
    rows = [(i, (centres[i % 40 if i % 3 else 0] + rng.normal(size=16)).tolist()) for i in range(20_500)]  # a third in one list's reach
    want = brute_nearest(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("id", "v", "list", "rank", "score")})
    got = Counter((r["query_id"], r["vec_id"]) for r in ann.nearest(frame, lambda i: i % 50 == 0).collect())
    hits = sum(got[q, i] for q in want for i, _ in want[q])
    assert sum(got.values()) == 5 * len(want) and hits >= 0.9 * 5 * len(want)


def test_neighbours_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema), lambda i: i % 50 == 0).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (0, [1.0, 0.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(spark.createDataFrame(rows, schema), lambda i: i % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]


def test_lm_contexts_are_counted_without_a_table_of_fixed_size(spark):
    r = random.Random(3)
    words = {prose(r, "aa", 1).encode()[:r.randrange(1, 12)]: r.randrange(0, 4) for _ in range(1200)}
    words |= {lm.END: 5, b"karo" * 2500: 1, b"x" * 9000 + b"karo": 2}
    code = lm.Code([b"ab abc b ab ca"])
    rows = spark.createDataFrame([(bytearray(w), c) for w, c in words.items()], "word binary, c long")
    got = lm.counted(lm.groups_of(rows, len(words), 100), code, 200_000).filter("words IS NOT NULL").collect()
    assert len(got) > 20, "words must fall in many groups"
    want, seen = Counter(), []
    for g in got:
        group = lm.Group(g["words"], g["times"], code)
        seen.append((g, [list(zip([i] * len(k), k.tolist())) for i, k in enumerate(group.own.keys(group.rows, group.node))]))
        for keys in seen[-1][1]:
            for key, bit, weight in zip(keys, group.bit.tolist(), group.weight.tolist()):
                want[key, bit] += weight
    for g, contexts in seen:
        codes = lm._unpack(g["codes"], np.uint16).reshape(len(lm.CONTEXTS), -1)
        for keys, own in zip(contexts, codes):
            n = np.array([[want[k, b] for k in keys] for b in (0, 1)])
            np.testing.assert_array_equal(own, lm.compact(*n))
    assert {w for g in got for w in lm.Group(g["words"], g["times"], code).words} == set(words)


def test_lm_tokens_of_blocks():
    texts = [None, "", "a", " a  b\n", "  ", "x\x0by\x0cz\x1ce", "É A b", "A B c\u3000d"]
    found = lm.Tokens(pa.array(texts, pa.string()))
    for t, x, y in zip(texts, found.starts, found.ends):
        assert [found.words[k] for k in found.codes[x:y]] == lm.tokens((t or "").encode())
    assert not len(lm.Tokens(pa.array([], pa.string())).codes)


def test_lm_byte_counts(spark):
    seen = lm.byte_counts(spark.createDataFrame([(bytearray(b"zq"), 7), (bytearray(b"z"), 0), (bytearray(lm.END), 2)], "word binary, c long"))
    assert (seen[ord("z")], seen[ord("q")], seen[ord(" ")], seen[10], seen.sum()) == (7, 7, 7, 2, 23)


def row_counts(spark, rows):
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0)
    return Counter(r["query_id"] for r in found.collect())


def test_neighbours_come_back_in_full(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(2000)]  # noise: true neighbours lie in lists that aren't probed
    assert row_counts(spark, rows) == {q: 5 for q in range(0, 2000, 50)}
    few = [(i, rng.normal(size=16).tolist()) for i in range(4)]
    assert row_counts(spark, few) == {0: 3}


def test_neighbours_count_a_repeated_candidate_once(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    near = (np.array(rows[50][1]) + 0.01).tolist()
    rows += [(1001, near)] * 6
    assert row_counts(spark, rows) == {q: 5 for q in range(0, 300, 50)}
    index = ann.Index(np.array([i for i, _ in rows]), np.array([v for _, v in rows]), len(rows), 5)
    bound = index.asked(np.array([50]), np.array([rows[50][1]]), 5)[1][0]
    assert bound == pytest.approx(2 - 2 * brute_nearest(rows[:300] + [(1001, near)])[50][4][1], abs=1e-4)
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = list(ann.search_chunk(x[50:51], [4.1], [50], x, ids, index.rotation, 5))
    assert [i for _, i, _ in got] == [i for i, _ in brute_nearest(rows[:300] + [(1001, near)])[50]]
