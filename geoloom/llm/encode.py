"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file.

Long texts are cut at safe boundaries, where a letter, a space and a letter meet: the pattern always begins a
match at that space, whatever stands around it. Null and empty texts have no ids. Each row is encoded by itself;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts beyond so many characters are cut into pieces of about this size.
PIECE = 50_000


@lru_cache(2)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file (a base64 token and its rank in each line)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _boundary():
    import regex

    return regex.compile(r"(?<=\p{L}) (?=\p{L})")


@lru_cache(2)
def _matches(pattern: str):
    import regex

    return regex.compile(pattern)


def pieces(text: str, size: int = PIECE):
    """Parts of text that encode by themselves as they do together."""
    at = 0
    while len(text) - at > size:
        cut = _boundary().search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    """Ids of a text, the same as those of one call over the whole."""
    if not text:
        return []
    own = encoding(path, pattern)
    if len(text) <= PIECE:
        return own.encode_ordinary(text)
    ids: list[int] = []
    for part in pieces(text):
        if len(part) <= 4 * PIECE:
            ids += own.encode_ordinary(part)
        else:  # no safe boundary for long: the matches one at a time, so the library's regex can't run out of stack
            for m in _matches(pattern).finditer(part):
                ids += own._encode_single_piece(m.group())
    return ids


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The bytes of ids; ids that split a character give its raw bytes."""
    return encoding(path, pattern).decode_bytes(ids)


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and its array of token ids for each row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [encode(t, path, pattern) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    out = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decoded(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the bytes that its ids stand for; null ids give no bytes."""
    ids = ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = [decode(x or [], path, pattern) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], ["id", "data"])

    out = ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, data binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, SHA-256 of the decimal ids and of the bytes they decode to, for each row, in one pass."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text, path, pattern)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
