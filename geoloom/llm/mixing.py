"""Mixing sources to target weights, with DataFrame functions only.

1. Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; a source's target stops at `MOST`
   times its size and the excess is reshared by weight: the level of this water fill rises in a few sums over sources.
2. Packing: a source's documents, in the order of a hash of their ids, form one stream of words, cut into blocks of
   BLOCK words (the last may be short). Positions are two-level prefix sums, so no source is summed in one task.
3. Draws: the mix has one slot a block of target. Each slot of a source is thrown at an output shard by a polynomial
   hash; the slots counted by shard and source are the draw. Given a shard's size (about SHARD slots), its counts are
   multinomial by target shares, on condition that all shards add up to the targets (independent draws would miss a
   small source's target by a tenth).
4. A shard's slots of a source take the ranks that follow those of the shards before; rank r takes block a*r + c mod
   its number of blocks, a prime with it and both fixed by source and pass: each pass over the source uses every block
   once. Slots and documents' parts are joined by block index; what a document gives to slots is what is taken of it.

No document is taken more than MOST times, as a source has at most MOST times as many slots as blocks. Null and
blank texts have size 0 and are never taken. Repeated rows, equal ids and null ids are documents of their own. A
source without words has target 0; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import numbered
from .common import cut, fresh, words

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARD = 1024
#: Words of a source's stream in a bucket, and shards in a bucket of shards, that one task sums at most.
BUCKET_WORDS, BUCKET_SHARDS = 1 << 19, 1 << 12
#: Slots that one row of the table of draws unfolds to, and rows of it that a task unfolds.
CHUNK, CHUNKS = 16_384, 8
#: Sources up to so many are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Primes, and one for lines whose products with the others would pass 2^63.
PRIMES = (1_500_450_271, 1_610_612_741, 1_879_048_201, 2_147_483_629, 2_147_483_647)
LARGE_PRIME = 2_305_843_009_213_693_951
#: The hash polynomial's coefficients, and its field.
COEFFICIENTS, FIELD = (1_103_515_245, 826_366_247, 69_069_069, 1_664_525_113), 2_147_483_647
#: Parts of a document's copy.
PARTS = 1 << 20


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also place, weight, target, n_blocks, n_slots; one row for each source."""
    ordered = numbered(sizes.select("source", "source_size", F.col("source").isNull().alias("none")), "place", "none", "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighed = ordered.drop("none").withColumn("weight", weight)
    ratio, most = MOST * F.col("source_size") / F.col("weight"), MOST * F.col("source_size")
    everything = weighed.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    level = everything["n"] / everything["w"] if everything["w"] else 0.0
    while True:
        capped = weighed.filter(ratio < level).agg(F.coalesce(F.sum(most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if not capped[1] or (risen := (everything["n"] - capped[0]) / (everything["w"] - capped[1])) <= level:
            break
        level = risen
    target = F.when(ratio < level, most.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return weighed.select(
        "source", "place", "source_size", "weight", target.alias("target"),
        F.ceil(F.col("source_size") / BLOCK).cast("long").alias("n_blocks"),
    ).withColumn(
        # a block holds source_size / n_blocks words on average: less than BLOCK in a source of a few
        "n_slots",
        F.when(
            F.col("source_size") > 0,
            F.least(F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5).cast("long"), MOST * F.col("n_blocks")),
        ).otherwise(F.lit(0).cast("long")),
    )


def permuted(at: Column, n: Column, prime: Column, shift: Column) -> Column:
    """(prime * at + shift) mod n for 0 <= at < n; in decimals where the product may pass 2^63."""
    small = ((prime % n) * at + shift % n) % n
    large = (
        (F.lit(LARGE_PRIME) % n).cast("decimal(19,0)") * at.cast("decimal(19,0)") + (shift % n).cast("decimal(19,0)")
    ) % n.cast("decimal(19,0)")
    return F.when(n < 1 << 30, small).otherwise(large.cast("long"))


def prime(key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p) for p in PRIMES)), (key % len(PRIMES) + 1).cast("int")).cast("long")


def thrown(at: Column, seed: int) -> Column:
    """A polynomial of at over a prime field: 0 to FIELD - 1, four values of it independent."""
    field, x = F.lit(FIELD).cast("long"), at % FIELD
    value = F.lit(COEFFICIENTS[0]).cast("long")
    for c in COEFFICIENTS[1:]:
        value = (value * x + F.lit(c + seed).cast("long")) % field
    return (value + F.floor(at / FIELD).cast("long") * 7919) % field


def prefixed(rows: DataFrame, group: str, bucket: str, order: list, amount: str, name: str) -> DataFrame:
    """rows with the sum of amount over the rows before, within group in the order of bucket and then order."""
    sums = rows.groupBy(group, bucket).agg(F.sum(amount).alias("_sum"))
    shift = F.sum("_sum").over(W.partitionBy(group).orderBy(bucket)) - F.col("_sum")
    inside = W.partitionBy(group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(amount).over(inside) - F.col(amount))
    return local.join(sums.select(group, bucket, shift.alias("_shift")), [group, bucket]).withColumn(
        name, F.col("_shift") + F.col("_local")
    ).drop("_shift", "_local")


def shard_counts(plan: DataFrame, seed: int = 0) -> DataFrame:
    """shard, place, n: how many slots of a source each shard drew; with the source's n_blocks."""
    total, places = plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count("*")).first()
    shards = max(1, round(total / SHARD))
    line = plan.filter("n_slots > 0").select(
        "place", "n_blocks", "n_slots", F.lit(0).alias("one"), F.floor(F.col("place") / BUCKET_SHARDS).alias("bucket")
    )
    line = prefixed(line, "one", "bucket", ["place"], "n_slots", "from")
    tasks = min(100_000, max(1, -(-(total // CHUNK + places) // CHUNKS)))
    chunks = line.select(
        "place", "n_blocks", "n_slots", "from",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / CHUNK).cast("long"))).alias("chunk"),
    ).repartition(tasks, "place", "chunk")
    first = F.col("chunk") * CHUNK
    slots = chunks.select(
        "place", "n_blocks",
        F.explode(F.sequence(F.col("from") + first, F.col("from") + F.least(first + CHUNK, F.col("n_slots")) - 1)).alias("at"),
    )
    shard = F.floor(thrown(F.col("at"), seed) * F.lit(shards).cast("long") / F.lit(FIELD)).cast("long")
    return slots.groupBy(shard.alias("shard"), "place").agg(F.count("*").alias("n"), F.first("n_blocks").alias("n_blocks"))


def draws(plan: DataFrame, seed: int = 0) -> DataFrame:
    """shard, slot (its number in the shard), place, block for each slot of the mix, from the counts by shard."""
    counts = shard_counts(plan, seed).withColumn("bucket", F.floor(F.col("shard") / BUCKET_SHARDS))
    ranks = prefixed(counts, "place", "bucket", ["shard"], "n", "before").select(
        "shard", "place", "n_blocks", F.explode(F.sequence("before", F.col("before") + F.col("n") - 1)).alias("r")
    )
    turn = F.floor(F.col("r") / F.col("n_blocks")).cast("long")
    block = permuted(
        F.col("r") % F.col("n_blocks"), F.col("n_blocks"), prime(F.col("place") * 3 + turn + seed),
        F.col("place") * 7919 + turn * 104_729 + seed * 1_299_709,
    )
    mixed_up = W.partitionBy("shard").orderBy(thrown(F.col("r") * 31 + F.col("place"), seed + 1), "place", "r")
    return ranks.select("shard", (F.row_number().over(mixed_up) - 1).alias("slot"), "place", block.alias("block"))


def _stream(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """id, source, size, and h and tie, which order a source's stream."""
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    of_id = F.pmod(F.floor((key % FIELD) * 1_597_334_677 / F.lit(65_536)).cast("long"), F.lit(1 << 30))
    of_text = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
    return [
        key.alias("id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"),
        F.when(key.isNull(), of_text).otherwise(of_id).alias("h"), F.xxhash64(text).alias("tie"),
    ]


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row of _stream with its source's row of plan and its first word's position in the source's stream."""
    known = plan.count() <= BROADCAST_SOURCES
    plan = plan.select(F.col("source").alias("_source"), "place", "source_size", "target")
    found = rows.join(F.broadcast(plan) if known else plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    buckets = 1 + F.floor(F.col("source_size") / BUCKET_WORDS).cast("long")
    found = found.withColumn("bucket", F.shiftright(F.col("h") * buckets, 30))
    order = ["h", F.col("id").asc_nulls_first(), "size", "tie"]
    numbers = W.partitionBy("place", "bucket").orderBy(*order)
    return prefixed(found.withColumn("nth", F.row_number().over(numbers)), "place", "bucket", ["nth"], "size", "start")


def pieces(at: DataFrame, slots: DataFrame, *keep: str) -> DataFrame:
    """keep, shard, slot, first, n: the words first.. of a document that a slot takes; a row without a slot if none does."""
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    parts = at.select(*keep, "place", "start", "size", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))).alias("block"))
    begin = F.greatest("start", F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    parts = parts.select(
        *keep, "place", "block", (begin - F.col("start")).alias("first"), (end - begin).alias("n"),
        (begin - F.col("block") * BLOCK).alias("at"),
    )
    # merged by sort: counts of slots compress so well in the exchange that they would be taken for a small side
    return parts.join(slots.hint("merge"), ["place", "block"], "left").drop("place", "block")


def _taken(rows: DataFrame, seed: int, *keep: str) -> DataFrame:
    """rows of _stream with source_size, target, start's order and taken."""
    plan = cut(targets(cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))))
    at = placed(rows, plan).withColumnRenamed("place", "own").withColumn("place", F.col("own"))
    keys = ["own", "bucket", "nth", "id", "source", "h", "tie", "words", "source_size", "target", *keep]
    parts = pieces(at.withColumn("words", F.col("size")), draws(plan, seed), *keys)
    given = F.when(F.col("shard").isNotNull(), F.col("n")).otherwise(F.lit(0))
    return parts.groupBy(*keys).agg(F.sum(given).cast("long").alias("taken")).withColumnRenamed("words", "size")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """id, source, size, source_size, target and taken (words the mix takes, repeats counted) for each row.

    id_col holds whole numbers (or null).
    """
    taken = _taken(cut(docs.select(*_stream(id_col, text_col, source_col))), seed)
    return taken.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, str]:
    """docs with a number for each row, the rows of _stream with it as row, and its column; one table, written once."""
    row = fresh(docs, "mix_row")
    stream = fresh(docs, "mix_stream")
    written = cut(docs.withColumns({row: F.monotonically_increasing_id(), stream: F.struct(*_stream(id_col, text_col, source_col))}))
    return written.drop(stream), written.select(f"{stream}.*", F.col(row).alias("row")), row


def shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """The mix itself: shard, slot, at, source, id, text, where a slot's block is its texts in the order of at."""
    docs, rows, row = _keyed(docs, id_col, text_col, source_col)
    plan = cut(targets(cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))))
    found = pieces(placed(rows, plan), draws(plan, seed), "row", "id", "source").filter("shard IS NOT NULL")
    texts = docs.select(F.col(row).alias("row"), words(F.col(text_col)).alias("words"))
    text = F.array_join(F.slice("words", F.col("first").cast("int") + 1, F.col("n").cast("int")), " ")
    return found.join(texts, "row").select("shard", "slot", "at", "source", F.col("id").alias(id_col), text.alias("text"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """docs in the mix's proportions: a row stands as often as its words are taken, rounded along its source.

    A source's rows stand in a line from long to short, each as long as taken / size; a row has a copy for each half
    that its piece of the line covers, so a source is off by half a copy in all, not by a coin toss a document. A
    source of a few long documents misses its target by up to half of one. Rows are told apart by themselves: equal
    and null ids are neither lost nor multiplied.
    """
    docs, rows, row = _keyed(docs, id_col, text_col, source_col)
    taken = _taken(rows, seed, "row").filter("size > 0")
    kind = 64 - F.floor(F.log2("size")).cast("long")
    line = taken.select(
        "own", "row", "h", "size", F.floor(F.col("taken") * PARTS / F.col("size")).cast("long").alias("share"),
        (kind * F.lit(1 << 40) + F.col("bucket")).alias("bucket"),
    )
    line = prefixed(line, "own", "bucket", [F.col("size").desc(), "h", "row"], "share", "before")
    reached = lambda x: F.floor((x + PARTS // 2) / PARTS)
    n = (reached(F.col("before") + F.col("share")) - reached(F.col("before"))).cast("int")
    copies = line.select(F.col("row").alias(row), F.sequence(F.lit(1), n).alias("_copies"), n.alias("_n")).filter("_n > 0")
    copies = copies.select(row, F.explode("_copies"))
    return docs.join(copies.select(row), row).drop(row)
