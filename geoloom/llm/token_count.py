"""Token counts without moving a pre-token: a broadcast table of frequent lengths, then the worker's own cache.

Tier one is a compact hash table (sorted 64-bit hashes, offsets, key bytes, lengths) of the pre-tokens that are
frequent in a sample of texts drawn by a hash of their ids. A worker asks it first for each pre-token: those that are a
blank and a word are unfolded once to a dictionary, others are found in its arrays; keys are compared, so a collision
can't give a wrong length. Tier two, for what the table lacks, is the cache of each Python worker, filled by the
tokenizers library. Which tier answers never changes a count.

Null and empty texts: 0 bytes, 0 tokens, within the limit. Repeated rows each get their row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import drawn

LIMIT = 1024
#: The table is fitted on so many texts of at most so many characters; at most so many entries are broadcast.
FIT_TEXTS, FIT_CHARS, FIT_ENTRIES = 512, 64_000, 65_536


class LengthTable:
    """An immutable hash table from pre-token to token count, held in four numpy arrays."""

    def __init__(self, lengths: dict[str, int]):
        rows = sorted((xxhash.xxh3_64_intdigest(k := piece.encode()), k, n) for piece, n in lengths.items())
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.ends = np.cumsum([len(r[1]) for r in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
        self.keys = b"".join(r[1] for r in rows)
        self.counts = np.array([r[2] for r in rows], np.int32)

    def words(self) -> dict[str, int]:
        """The lengths of entries that are a blank and a word, by word."""
        starts = np.r_[0, self.ends[:-1]].tolist()
        entries = ((self.keys[a:b].decode(), n) for a, b, n in zip(starts, self.ends.tolist(), self.counts.tolist()))
        return {k[1:]: n for k, n in entries if k[:1] == " " and k[1:].isalpha() and max(k) < bpe.STABLE_LETTERS}

    def __call__(self, piece: str) -> int | None:
        key = piece.encode()
        i = int(self.hashes.searchsorted(np.uint64(xxhash.xxh3_64_intdigest(key))))
        if i < len(self.hashes) and self.keys[self.ends[i] - len(key) : self.ends[i]] == key:
            return int(self.counts[i])
        return None


def fit_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> LengthTable:
    """The lengths of the pre-tokens that occur most in a bounded number of bounded texts, drawn by a hash of the id."""
    encoder, seen = bpe.counter(path), Counter()
    for text in drawn(docs, id_col, text_col, FIT_TEXTS, FIT_CHARS):
        seen.update(encoder.split.findall(text))
    return LengthTable({p: encoder.piece[p] for p, _ in seen.most_common(FIT_ENTRIES) if encoder._plain(p)})


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit for each row of docs, by the tokenizer file at path."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(fit_table(docs, path, id_col, text_col))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encode = bpe.counter(path)
        if encode.known is not table.value:
            encode.known = table.value
            encode.front = bpe.Front(encode.known.words(), encode.chunk)
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                    pa.array(map(encode, texts.to_pylist()), pa.int64()),
                ],
                ["id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    counted = docs.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
