"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Text is reduced to lower-case letters and blanks. The model is fitted on a sample of labelled rows, chosen by a
hash of the id: about FIT_DOCS documents a language (all of a rarer one), a documented bound; it is a matrix of
BUCKETS log probabilities a language, broadcast and summed in numpy over whole texts. Texts beyond SEGMENT
characters are scored in segments whose sums are added, so memory stays bounded.

Texts that are null or hold no letter are `und` with score 0; so is everything if there is no labelled row. Equal
scores go to the language that comes first by code point. Only text decides; an input column that has the name of
a result column is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

UNKNOWN = "und"
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
FIT_DOCS = 2000
FIT_PARTS = 4
SEGMENT = 1 << 20
SMOOTHING = 0.5


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> code point of its lower case, or a blank for what isn't a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _segments(texts: list[str | None]):
    """Lists of (row, letters) of about SEGMENT characters together."""
    found, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), SEGMENT):
            part = _letters()[np.frombuffer(text[at : at + SEGMENT].encode("utf-32-le"), np.uint32)]
            found.append((row, part))
            size += len(part)
            if size >= SEGMENT:
                yield found
                found, size = [], 0
    if found:
        yield found


def _buckets(part: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place of part."""
    m = len(part) - n + 1
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h ^= part[i : m + i]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 16)


def counts(texts: list[str | None]) -> np.ndarray:
    """Occurrences of each bucket in all texts together."""
    total = np.zeros(BUCKETS, np.int64)
    for group in _segments(texts):
        for _, part in group:
            for n in GRAMS:
                if len(part) >= n:
                    total += np.bincount(_buckets(part, n), minlength=BUCKETS)
    return total


def scores(texts: list[str | None], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log probabilities, a row for each text, and whether the text holds a letter."""
    sums, lettered = np.zeros((len(texts), logs.shape[1])), np.zeros(len(texts), bool)
    for group in _segments(texts):
        for row, part in group:
            lettered[row] |= bool((part != 32).any())
        for n in GRAMS:
            long = [(row, part) for row, part in group if len(part) >= n]
            if not long:
                continue
            found = [_buckets(part, n) for _, part in long]
            starts = np.cumsum([0, *(len(x) for x in found[:-1])])
            each = np.add.reduceat(logs[np.concatenate(found)], starts, axis=0, dtype=np.float64)
            np.add.at(sums, [row for row, _ in long], each)
    return sums, lettered


class Model:
    """Languages in code point order, their log priors and the matrix of log probabilities."""

    def __init__(self, totals: dict[str, np.ndarray], docs: dict[str, int]):
        self.languages = sorted(totals)
        table = np.array([totals[x] for x in self.languages], np.float64).reshape(-1, BUCKETS) + SMOOTHING
        self.logs = np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32))
        n = np.array([docs[x] for x in self.languages], np.float64)
        self.priors = np.log(n / n.sum()) if len(n) else n

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        sums, lettered = scores(texts, self.logs)
        sums += self.priors
        best = sums.argmax(axis=1)
        chance = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, np.where(lettered, chance, 0.0).tolist()


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 0 mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = FIT_DOCS) -> Model:
    """The model of the labelled rows of docs that aren't held out."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    known = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not known:
        return Model({}, {})
    share = F.create_map(*(F.lit(x) for lang, n in known.items() for x in (lang, min(1.0, most / n))))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(place < F.element_at(share, F.col("lang")))
    dealt = sample.select("text", "lang").repartition(len(known) * FIT_PARTS, "lang", F.pmod(F.xxhash64("id"), F.lit(FIT_PARTS)))

    def count(batches):
        import pyarrow as pa

        found: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                found[lang] = found.get(lang, 0) + counts(texts)
        for lang, n in found.items():
            at = n.nonzero()[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([n[at].tolist()], pa.list_(pa.int64()))],
                ["lang", "at", "n"],
            )

    totals = {lang: np.zeros(BUCKETS, np.int64) for lang in known}
    for lang, at, n in dealt.mapInArrow(count, "lang string, at array<int>, n array<long>").collect():  # languages x parts
        totals[lang][at] += n
    return Model(totals, known)


def with_language(docs: DataFrame, model: Model, text_col: str = "text", lang_col="lang_pred", score_col="score") -> DataFrame:
    """docs with the predicted language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(docs[c] for c in docs.columns if c not in (lang_col, score_col)))
    at = kept.columns.index(text_col)
    schema = StructType([*kept.schema.fields]).add(lang_col, StringType()).add(score_col, DoubleType())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, chances = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(chances, pa.float64())],
                [*batch.schema.names, lang_col, score_col],
            )

    return kept.mapInArrow(run, schema)
