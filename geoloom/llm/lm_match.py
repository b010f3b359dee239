"""Segments of texts as decisions of the language model: does a text go on as its context went on before?

Places are where the hash of the ORDERS[0] tokens before has SPAN_BITS leading zeros, so repeated passages have them at
the same words. The tokens from one place to the next are a segment, the last ending with the text. A context's candidate
is the segment that followed it most often in training, without the row at hand (ties: the smaller hash); a context not
seen elsewhere in training makes no decision. Counts are by context over all training documents, no table of fixed size.

Predictors of a decision: how often the candidate followed the context of ORDERS[0] tokens; how often that of ORDERS[1]
tokens; how often decisions after the same last two decisions and with as much evidence were hits. Mixing weights are
gated by the last two decisions; both they and the map learn from all training decisions, summed by quantised counts.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Tokens that contexts see, a multiple of the first each; a place is every 2^SPAN_BITS-th on average.
ORDERS, SPAN_BITS = (4, 12), 4
#: Quantised counts are below CODES, so the table of distinct decisions has STATES * CODES^4 rows at most.
CODES, STATES = 16, 9
EPOCHS = 200
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def sums(values: np.ndarray, begins: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The sum of values over each segment; begins are where segments, texts where texts begin."""
    cuts = np.union1d(begins, texts)
    return np.add.reduceat(values, cuts)[np.searchsorted(cuts, begins)] if len(begins) else np.zeros(0, values.dtype)


def segments(h: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, ...]:
    """begins, contexts of ORDERS[0] and of ORDERS[1] tokens, and hashes of the segments of some texts.

    h holds the hashes of the texts' tokens, one text after another; texts says where each begins.
    """
    n, order = len(h), ORDERS[0]
    place = np.arange(n) - np.repeat(texts, np.diff(np.r_[texts, n]))
    near = np.zeros(n, np.uint64)
    for i in range(order):
        near *= _A
        near[i:] += np.where(place[i:] >= i, h[: n - i], 0)
    near = _mix(near)
    last = np.zeros(n, bool)
    last[np.r_[texts[1:], n] - 1] = True
    at = np.flatnonzero((near >> np.uint64(64 - SPAN_BITS) == 0) & ~last)
    far = near[at].copy()
    for back in range(order, ORDERS[1], order):
        far = far * _A + np.where(place[at] >= back, near[np.maximum(at - back, 0)], 0)
    begins = at + 1
    cuts = np.union1d(begins, texts)
    place = np.arange(n) - np.repeat(cuts, np.diff(np.r_[cuts, n]))
    terms = _mix(h + (place.astype(np.uint64) + np.uint64(1)) * _A)
    return begins, near[at], _mix(far), sums(terms, begins, texts)


def keys_of(part) -> object:
    """A 128-bit hash of each row of id and text: rows that share it have the same decisions."""
    import pyarrow as pa

    texts = part.column("text").cast(pa.binary()).to_pylist()
    made = [xxhash.xxh3_128_digest((data or b"") + b"\0" + str(key).encode()) for key, data in zip(part.column("id").to_pylist(), texts)]
    return pa.array(made, pa.binary())


def candidates(rows: DataFrame) -> DataFrame:
    """key, train, i (from 1), hit, m, o, mb, ob: for each decision whether it is a hit, and how often its candidate and
    others followed the near and the far context in training elsewhere. rows: key, train and arrays a, b, s."""
    each = rows.select("key", "train", F.posexplode(F.arrays_zip("a", "b", "s")).alias("i", "x"))
    rows = each.select("key", "train", (F.col("i") + 1).alias("i"), "x.a", "x.b", "x.s")
    seen = rows.groupBy("a").agg(F.count("*").alias("n"), F.count_if("train").alias("t")).filter("n > 1 AND t > 0").select("a")
    rows = cut(rows.join(seen, "a", "left_semi"))
    followed = cut(rows.filter("train").groupBy("a", "s").agg(F.count("*").alias("n")))
    order = W.partitionBy("a").orderBy(F.col("n").desc(), "s")
    best = followed.withColumn("r", F.row_number().over(order)).filter("r <= 2").groupBy("a").agg(
        *(F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("s", "n"))
    )
    best = best.join(followed.groupBy("a").agg(F.sum("n").alias("total")), "a")
    own = F.col("train").cast("long")
    n1 = F.col("n1") - F.when(F.col("s") == F.col("s1"), own).otherwise(0)
    n2 = F.coalesce(F.col("n2") - F.when(F.col("s") == F.col("s2"), own).otherwise(0), F.lit(0))
    first = (n1 > n2) | ((n1 == n2) & (F.col("s1") < F.coalesce("s2", "s1") + F.when(F.col("s2").isNull(), 1).otherwise(0)))
    met = rows.join(best, "a").select(
        "key", "train", "i", "b", (F.col("total") - own).alias("total"), F.when(first, F.col("s1")).otherwise(F.col("s2")).alias("candidate"),
        F.greatest(n1, n2).alias("m"), (F.col("s") == F.when(first, F.col("s1")).otherwise(F.col("s2"))).alias("hit"),
    ).filter("m > 0")
    far = rows.filter("train").groupBy("b", F.col("s").alias("candidate")).agg(F.count("*").alias("nb"))
    all_far = far.groupBy("b").agg(F.sum("nb").alias("tb"))
    met = met.join(far, ["b", "candidate"], "left").join(all_far, "b", "left")
    mb = F.coalesce(F.col("nb") - (F.col("train") & F.col("hit")).cast("long"), F.lit(0))
    ob = F.coalesce(F.col("tb") - own, F.lit(0)) - mb
    return cut(met.select("key", "train", "i", "hit", "m", (F.col("total") - F.col("m")).alias("o"), mb.alias("mb"), ob.alias("ob")).dropDuplicates(["key", "i"]))


def _code(n):
    return F.least(F.floor(F.log2(n + 1) * 2), F.lit(CODES - 1)).cast("int")


def learnt(table: list) -> np.ndarray:
    """P(hit) of each row (state, m, o, mb, ob codes, training hits, training misses) by a mixer that learns from all rows."""
    from .lm import EVEN, Mixer, _stretch

    x = np.array(table, np.int64).reshape(-1, 7)
    count = 2.0 ** (np.arange(CODES) / 2) - 1
    state, (m, o, mb, ob) = x[:, 0], (count[x[:, i]] for i in range(1, 5))
    history = (state * CODES + x[:, 1]) * CODES + x[:, 3]
    hits, misses = (np.bincount(history, x[:, i], STATES * CODES * CODES) for i in (5, 6))
    xs = [_stretch((a + EVEN) / (a + b + 2 * EVEN)) for a, b in ((m, o), (mb, ob), (hits[history], misses[history]))] + [np.ones(len(x))]
    mixer, both = Mixer(len(xs), STATES, STATES), [np.r_[c, c] for c in xs]
    bit, gate, times = np.repeat([1, 0], len(x)), np.r_[state, state], np.r_[x[:, 5], x[:, 6]].astype(np.float64)
    for epoch in range(EPOCHS):
        mixer.learn(both, gate, gate, bit, times, note=epoch == EPOCHS - 1)
    return mixer.refined(mixer.mixed(xs, state), state)


def decisions(rows: DataFrame) -> DataFrame:
    """key, run_score, hits: log10 probability of a row's decisions, and the numbers of the segments that they write.

    rows has key, train and arrays a, b, s of segments. A row without decisions is left out.
    """
    met = candidates(rows)
    before = W.partitionBy("key").orderBy("i")

    def last(k):
        there = F.lag("i", k).over(before) == F.col("i") - k
        return F.when(there, F.when(F.lag("hit", k).over(before), 2).otherwise(1)).otherwise(0)

    coded = cut(
        met.select("key", "train", "i", "hit", (last(1) * 3 + last(2)).alias("state"), *(_code(F.col(c)).alias(c) for c in ("m", "o", "mb", "ob")))
    )
    names = ["state", "m", "o", "mb", "ob"]
    table = coded.groupBy(*names).agg(F.count_if(F.col("train") & F.col("hit")), F.count_if(F.col("train") & ~F.col("hit"))).collect()
    schema = "state int, m int, o int, mb int, ob int, p double"
    found = rows.sparkSession.createDataFrame([(*r[:5], float(p)) for r, p in zip(table, learnt(table))] if table else [], schema)
    return coded.join(F.broadcast(found), names).groupBy("key").agg(
        F.sum(F.when(F.col("hit"), F.log10("p")).otherwise(F.log10(1 - F.col("p")))).alias("run_score"),
        F.collect_list(F.when(F.col("hit"), F.col("i"))).alias("hits"),
    )
