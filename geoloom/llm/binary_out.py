"""Token-id files: each document's id array compressed by itself with a shared zstandard dictionary.

A data set is a folder of two parquet tables, so Spark's committer makes writes atomic and retried tasks safe:
`dictionary` (one row: dictionary hash, dictionary, bytes an id) and `segments`. A segment row holds a payload of
documents compressed one after another, and their index: doc ids, end offsets in the payload, token counts, the
segment's shard, its number there, the tokens before it in its shard and the dictionary's hash. One document is
read by decompressing its slice of one payload. Shards follow one another in ascending doc_id.

Null and empty texts are the end id alone. Null ids come first; equal ids follow their texts. An empty table gives
a data set without segments. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import drawn, shared_dir

END_ID = 0
#: The dictionary is trained on the id arrays of about so many texts (drawn by a hash of the id) of at most so many characters.
FIT_TEXTS, FIT_CHARS, DICTIONARY_BYTES = 512, 64_000, 65_536
LEVEL, SEGMENT_BYTES = 1, 4 << 20
SEGMENT = (
    "shard int, number int, tokens_before long, dictionary_hash string, doc_ids array<{id}>, ends array<long>,"
    " n_tokens array<long>, payload binary"
)


def id_width(path: str) -> int:
    """Bytes that an id of the tokenizer file needs: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, width: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A zstandard dictionary of bounded size; raw samples where there are too few to train on."""
    encode = bpe.serializer(path, width)
    samples = [encode(text) for text in drawn(docs, id_col, text_col, FIT_TEXTS, FIT_CHARS)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def write_ids(docs: DataFrame, path: str, to: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs by the tokenizer file at path and writes the data set `to`."""
    spark = docs.sparkSession
    width = id_width(path)
    data = train_dictionary(docs, path, width, id_col, text_col)
    mark = xxhash.xxh3_128_hexdigest(data)
    spark.createDataFrame([(mark, data, width)], "dictionary_hash string, data binary, width int").coalesce(
        1
    ).write.parquet(f"{to}/dictionary")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = docs.repartitionByRange("id").sortWithinPartitions("id", "text")

    def pack(batches):
        import pyarrow as pa

        encode, squeeze = bpe.serializer(path, width), zstandard.ZstdCompressor(level=LEVEL, **_dictionary(data))
        end = np.array([END_ID], f"<u{width}").tobytes()
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        ids, ends, counts, parts, size = [], [], [], [], 0

        def segment():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([mark]), pa.array([ids], pa.list_(kind)), pa.array([ends], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary()),
                ],
                ["shard", "number", "tokens_before", "dictionary_hash", "doc_ids", "ends", "n_tokens", "payload"],
            )

        for batch in batches:
            kind = batch.column("id").type
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                raw = encode(text) + end
                parts.append(squeeze.compress(raw))
                size += len(parts[-1])
                ids.append(key)
                ends.append(size)
                counts.append(len(raw) // width)
                if size >= SEGMENT_BYTES:
                    yield segment()
                    number, before = number + 1, before + sum(counts)
                    ids, ends, counts, parts, size = [], [], [], [], 0
        if ids:
            yield segment()

    ordered.mapInArrow(pack, SEGMENT.format(id=docs.schema["id"].dataType.simpleString())).write.option(
        "compression", "none"
    ).parquet(f"{to}/segments")


def _opened(spark: SparkSession, path: str) -> tuple[bytes, int, str]:
    mark, data, width = spark.read.parquet(f"{path}/dictionary").first()
    if xxhash.xxh3_128_hexdigest(data) != mark:
        raise ValueError("the dictionary doesn't match its hash")
    return bytes(data), width, mark


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files alone, per document: id, start (ids of all documents before it), n_tokens and ids_crc32."""
    data, width, mark = _opened(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    per_shard = segments.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sizes = dict(per_shard.groupBy("shard").agg(F.sum("n")).collect())  # a row for each shard file
    starts, total = {}, 0
    for shard in sorted(sizes):
        starts[shard], total = total, total + sizes[shard]

    def read(batches):
        import pyarrow as pa

        expand = zstandard.ZstdDecompressor(**_dictionary(data))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != mark:
                    raise ValueError("a segment was written with another dictionary")
                at, start, found = 0, starts[row["shard"]] + row["tokens_before"], []
                for end in row["ends"]:
                    ids = np.frombuffer(expand.decompress(row["payload"][at:end]), f"<u{width}").astype("<u4")
                    found.append((start, len(ids), zlib.crc32(ids.tobytes())))
                    at, start = end, start + len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], batch.column("doc_ids").type.value_type),
                        *(pa.array(x, pa.int64()) for x in zip(*found)),
                    ],
                    ["id", "start", "n_tokens", "ids_crc32"],
                )

    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    out = segments.mapInArrow(read, f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def read_document(spark: SparkSession, path: str, key, occurrence: int = 0) -> list[int]:
    """The ids of one document: only its slice of one payload is decompressed."""
    data, width, _ = _opened(spark, path)
    row = (
        spark.read.parquet(f"{path}/segments").filter(F.array_contains("doc_ids", key))
        .orderBy("shard", "number").limit(occurrence + 1).collect()
    )
    places = [(r, i) for r in row for i, x in enumerate(r["doc_ids"]) if x == key]
    r, i = places[occurrence]
    part = bytes(r["payload"])[r["ends"][i - 1] if i else 0 : r["ends"][i]]
    return np.frombuffer(zstandard.ZstdDecompressor(**_dictionary(data)).decompress(part), f"<u{width}").tolist()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write_ids to a fresh shared folder, then read_digests from it."""
    to = shared_dir(docs.sparkSession)
    write_ids(docs, path, to, id_col, text_col)
    return read_digests(docs.sparkSession, to, id_col)
