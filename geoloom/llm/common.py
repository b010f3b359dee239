"""Shared pieces of the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise as cut
from ..session import shared_path as shared_dir

__all__ = ["Memo", "SPACE_PATTERN", "WORD_PATTERN", "cut", "drawn", "fresh", "let", "shared_dir", "small_batches", "table", "words"]

#: Fixed value: the word class of every operator here, a run without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the input folder, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, limit: int = 8 << 20):
    """Jobs run within hand rows to Python workers in Arrow batches of about limit bytes, so that their memory doesn't
    depend on how long rows are; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, f"{limit}b")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def let(value: Column, body) -> Column:
    """body(x) with x bound once to value.

    Catalyst may paste a projection's expression into every place that mentions it, also inside lambdas,
    where it would be computed again for each element; a lambda variable is computed once.
    """
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), "")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has such a column (names are compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def drawn(docs: DataFrame, id_col: str, text_col: str, n: int, chars: int) -> list[str]:
    """About n texts (2 n at most) of 1 to `chars` characters, drawn from all rows by a hash of their ids."""
    total = max(docs.count(), 1)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30))
    some = docs.filter(place < int(min(1.0, n / total) * (1 << 30))).filter(F.length(text_col).between(1, chars))
    return [r[0] for r in some.select(F.col(text_col)).limit(2 * n).collect()]


class Memo(dict):
    """A dictionary that makes what it lacks, and starts anew when it holds `most` entries."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        made = self.make(key)
        if len(key) <= 64:
            self[key] = made
        return made
