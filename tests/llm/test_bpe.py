import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoloom.llm import binary_out, bpe, encode, token_count

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = [
    None, "", " ", "  ", "\n", " \n x", "a  b", "a \n b", "x\n\ny", "it's we'll I'D '' 's", "tab\tx \t y", "a\xa0b \xa0 c",
    "é ü ß 中文 字", "emoji 😀 here", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y z", "1²½ 一二 x1y2", "᠎a ᠎",
    "a\x1cb \x1d c", "trailing ", " leading", "₹ 5", "word\n word", "  a b", "é x", "\x00 a\x00", "...!!! ??",
    "a" * 3000, " " * 3000, "ab " * 3000,
]


def mess(seed, n=300):
    r = random.Random(seed)
    letters = "abcdeXYZ  \n\t'.,;!0123éß中😀\xa0"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_cached_encoder_equals_library(library):
    count = bpe.CachedBpe(JSON, len, sum, pieces=50, chunks=20)
    ids = bpe.serializer(JSON, 2)
    for text in HARD + mess(1) + mess(2):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert count(text) == len(want), repr(text)
        assert np.frombuffer(ids(text), "<u2").tolist() == want, repr(text)


def frame(spark, texts):
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_token_counts(spark, library):
    texts = HARD + mess(3) + ["same", "same"]
    got = {r["doc_id"]: r for r in token_count.token_counts(frame(spark, texts), JSON).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024)
    assert token_count.token_counts(frame(spark, []), JSON).count() == 0


def test_length_table_compares_keys():
    table = token_count.LengthTable({" the": 1, "é": 2, "": 0})
    assert (table(" the"), table("é"), table(" thex"), table("")) == (1, 2, None, 0)
    assert token_count.LengthTable({})("x") is None


def test_encode_digests_and_round_trip(spark):
    own = encode.encoding(RANKS, public_tokenizers.PATTERN)
    long = "word here, " * 20_000 + "x" * 1000 + " y" * 40_000
    texts = HARD + mess(4) + [long]
    got = {r["doc_id"]: r for r in encode.digests(frame(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = own.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    ids = encode.token_ids(frame(spark, texts), RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["data"]) for r in encode.decoded(ids, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    assert encode.digests(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", [" " * 600_000, "a" * 600_000, "\n" * 500_000 + "x", "!" * 400_000, "a1" * 200_000])
def test_very_long_texts_without_boundaries(text):
    ids = encode.encode(text, RANKS, public_tokenizers.PATTERN)
    assert encode.decode(ids, RANKS, public_tokenizers.PATTERN) == text.encode()
    assert len(ids) == bpe.counter(JSON)(text)


def test_token_id_files(spark, tmp_path, library):
    texts = HARD + mess(5)
    docs = frame(spark, texts)
    to = str(tmp_path / "ids")
    binary_out.write_ids(docs.repartition(5), JSON, to)
    got = binary_out.read_digests(spark, to).orderBy("doc_id").collect()
    start = 0
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert binary_out.read_document(spark, to, 9) == library.encode(texts[9], add_special_tokens=False).ids + [0]


def test_token_id_files_of_few_or_no_rows(spark):
    assert binary_out.round_trip(frame(spark, []), JSON).count() == 0
    rows = binary_out.round_trip(spark.createDataFrame([(None, "b"), (3, None), (3, "x")], "doc_id long, text string"), JSON)
    assert [(r["doc_id"], r["start"]) for r in rows.orderBy("start").collect()] == [(None, 0), (3, 2), (3, 3)]
