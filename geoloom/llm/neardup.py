"""Near-duplicate documents: bottom-k sketches from one hash function.

1. A document's set is its distinct 5-word shingles (lower-cased A-Z); each is one 63-bit hash, and the k smallest
   hashes are the sketch. Documents of equal sets form one class, so copies never meet in pairs.
2. Inverted lists: of the retained values that several classes hold, each class enters the lists of its rarest
   ones only. Two sketches that share the `least` values a similar pair must share meet in at least one list
   (prefix filter over one order of the values).
3. Overlaps: each list pairs its members with its hub, the member whose values are the most common, as an original's
   are among its copies. Pairs of other members are not formed: of two members linked with the hub none is needed, and
   two others can only be similar if what sets them apart from the hub overlaps. So the differences from the hub make
   inverted lists of their own (again with a prefix filter, by position), and those give the remaining pairs.
4. A pair stays if the estimate from the sketch of the union (the k smallest of both) is within Z deviations of
   the threshold; exact Jaccard on full sets decides.
5. Components by large-star and small-star rounds, each written to the shared folder.

Step 3 is exact: with D the symmetric difference from the hub, x and y are similar iff |D_x ^ D_y| <= r (|x| + |y|)
for r = (1 - t) / (1 + t), so they share at least (|D_x| + |D_y| - r (|x| + |y|)) / 2 elements of D. Where that is not
positive, one of them is linked with the hub, and the linked member of least |D| - r |.| stands for all such.

Null, empty and blank texts: an empty set, linked with nothing. Texts of fewer words than a shingle are one shingle.
Rows with a null id take no part: component null, kept. Rows that share an id count as linked. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, cut, fresh, small_batches

WORDS = 5
K = 64
#: Deviations of the estimate that a pair may fall below the threshold.
Z = 5.0
#: Rows of one key that a task joins with the key's set; keys of more are dealt to several, up to HOT_KEYS by broadcast.
PART, HOT_KEYS = 256, 100_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)

_hashes = Memo(xxhash.xxh3_64_intdigest, 200_000)


def shingles(data: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a UTF-8 text's shingles."""
    tokens = (data or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens)) >> 1] if tokens else [], np.int64)
    each = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = len(each) - words + 1
    h = each[:n].copy()
    for i in range(1, words):
        h *= FACTOR
        h += each[i : n + i]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return np.unique(h >> np.uint64(1)).astype(np.int64)


def _by_row(docs: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow of make(id, bytes, *rest) -> row or None over id, text and further columns."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()]
            columns += [c.to_pylist() for c in batch.columns[2:]]
            rows = [r for r in map(make, *columns) if r is not None]
            made = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(made, types)], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    return docs.mapInArrow(run, schema)


def sketched(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """id, n_shingles, mark (128-bit hash of the set) and sketch for each row of (id, text)."""

    def make(key, data):
        s = shingles(data, words)
        return key, len(s), xxhash.xxh3_128_digest(s.tobytes()), s[:k]

    return _by_row(docs, make, "id long, n_shingles long, mark binary, sketch array<long>")


def lists(classes: DataFrame, least: float, k: int = K) -> DataFrame:
    """value, rep, n, pop: the inverted lists that each class enters; pop says how common its values are."""
    held = classes.select("rep", "n", F.explode("sketch").alias("value"))
    common = held.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    need = F.ceil(F.lit(least) * F.least(F.lit(k), "n") - 1e-9).cast("int")
    shared = held.join(common, "value").groupBy("rep").agg(
        F.first("n").alias("n"), F.sum("df").alias("pop"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values")
    )
    prefix = F.slice("values", 1, F.size("values") - need + 1)
    return shared.filter(F.size("values") >= need).select("rep", "n", "pop", F.explode(prefix).alias("x")).select(
        "x.value", "rep", "n", "pop"
    )


def full_sets(named: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """rep, items: the whole sets of the classes named, as sorted 64-bit numbers in bytes; written once."""

    def full(key, data, mark):
        s = shingles(data, words)
        return (key, s.tobytes()) if xxhash.xxh3_128_digest(s.tobytes()) == bytes(mark) else None

    wanted = docs.join(named.select("rep", "mark"), docs["id"] == F.col("rep")).select("id", "text", "mark")
    return cut(_by_row(wanted, full, "rep long, items binary").dropDuplicates(["rep"]))


def _set(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int64)


def hot_keys(keys: DataFrame) -> DataFrame | None:
    """_key, _parts of the values of keys (one column) that more than PART rows hold; None if there are none."""
    hot = keys.toDF("_key").groupBy("_key").agg(F.floor(F.count("*") / PART).cast("int").alias("_parts"))
    hot = cut(hot.filter("_parts > 0"))
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= HOT_KEYS else hot


def spread(rows: DataFrame, key: str, other: str, values: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows joined with values on key; a hot key is dealt by other to parts that hold its values each."""
    if hot is None:
        return rows.join(values, key)
    dealt = rows.join(hot, F.col(key) == F.col("_key"), "left").drop("_key")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(0)) + 1).cast("int")).drop("_parts")
    copied = values.join(hot, F.col(key) == F.col("_key"), "left").drop("_key")
    copied = copied.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(0))))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def similar(pairs: DataFrame, named: DataFrame, sets: DataFrame, percent: int, least: float, k: int = K):
    """The (a, b) of pairs whose full sets have at least percent Jaccard similarity."""
    known = named.select("rep", "n", "sketch")
    hot = hot_keys(pairs.select(F.explode(F.array("a", "b"))))
    both = spread(spread(pairs, "a", "b", known.toDF("a", "na", "sa"), hot), "b", "a", known.toDF("b", "nb", "sb"), hot)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    met = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    ratio = percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb")
    near = cut(both.filter(ratio).filter(met >= F.lit(least) * F.size(union) - 1e-9).select("a", "b"))
    whole = spread(spread(near, "a", "b", sets.toDF("a", "xa"), hot), "b", "a", sets.toDF("b", "xb"), hot).select("a", "b", "xa", "xb")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for xa, xb in zip(batch.column("xa"), batch.column("xb")):
                a, b = _set(xa), _set(xb)
                met = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * met >= percent * (len(a) + len(b) - met))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return whole.mapInArrow(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of edges (a, b), by alternating stars."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if now == state:
            break
        state = now
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least)
        edges = cut(small.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def hub_pairs(index: DataFrame) -> DataFrame:
    """hub, rep: each list's members with the one whose values are the most common."""
    order = F.struct((-F.col("pop")).alias("p"), "rep")
    hubs = index.groupBy("value").agg(F.min(order).alias("hub")).select("value", F.col("hub.rep").alias("hub"))
    return index.join(hubs, "value").filter("rep <> hub").select("hub", "rep").distinct()


def further(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of members (hub, rep, linked) of one hub that may be similar, those linked with it left out."""
    t = percent / 100
    r = (1 - t) / (1 + t)
    joined = spread(members, "hub", "rep", sets.toDF("hub", "xh"), hot_keys(members.select("hub"))).join(sets.toDF("rep", "xr"), "rep")
    joined = joined.select("hub", "rep", "linked", "xh", "xr")

    def differ(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, apart = [], []
            for h, x in zip(batch.column("xh"), batch.column("xr")):
                sizes.append(len(_set(x)))
                apart.append(np.setxor1d(_set(h), _set(x), assume_unique=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("hub"), batch.column("rep"), batch.column("linked"), pa.array(sizes, pa.int64()), pa.array(apart, pa.list_(pa.int64()))],
                ["hub", "rep", "linked", "n", "apart"],
            )

    d = cut(joined.mapInArrow(differ, "hub long, rep long, linked boolean, n long, apart array<long>"))
    d = d.withColumn("d", F.size("apart").cast("long"))
    # the linked member that stands for all whose difference is small enough together with another's
    slack = F.col("d") - r * F.col("n")
    low = d.filter("linked").groupBy("hub").agg(F.min(F.struct(slack.alias("s"), "rep")).alias("m")).select("hub", F.col("m.s").alias("s"), F.col("m.rep").alias("m"))
    near = d.filter("NOT linked").join(low, "hub").filter(F.col("s") + slack <= 1e-6).select(F.least("rep", "m").alias("a"), F.greatest("rep", "m").alias("b"))
    held = d.select("hub", "rep", F.explode("apart").alias("e"))
    common = held.groupBy("hub", "e").agg(F.count("*").alias("df")).filter("df > 1")
    shared = held.join(common, ["hub", "e"]).groupBy("hub", "rep").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    ranked = d.drop("apart").join(shared, ["hub", "rep"]).withColumn("alone", F.col("d") - F.size("es"))
    # places in the order of rarity; none beyond the longest prefix that any partner can ask for
    longest = F.floor(r * F.col("n") * (1 + 1 / t) + 2).cast("int")
    first = F.slice("es", 1, F.greatest(longest - F.col("alone").cast("int"), F.lit(0)))
    rows = ranked.select("hub", "rep", "linked", "n", "d", "alone", F.posexplode(first).alias("i", "x")).select(
        "hub", F.col("x.e").alias("e"), "rep", "linked", "n", "d", (F.col("alone") + F.col("i") + 1).alias("at")
    )
    x, y = (rows.toDF("hub", "e", *(f"{c}_{s}" for c in ("rep", "linked", "n", "d", "at"))) for s in "xy")
    c = F.col
    need = F.greatest(F.ceil((c("d_x") + c("d_y") - r * (c("n_x") + c("n_y"))) / 2 - 1e-6), F.lit(1))
    may = (c("at_x") <= c("d_x") - need + 1) & (c("at_y") <= c("d_y") - need + 1) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    met = x.join(y, ["hub", "e"]).filter((c("rep_x") < c("rep_y")) & ~(c("linked_x") & c("linked_y")) & may)
    return met.select(c("rep_x").alias("a"), c("rep_y").alias("b")).union(near).distinct()


def links(index: DataFrame, named: DataFrame, sets: DataFrame, percent: int, least: float, k: int = K) -> DataFrame:
    """a, b: similar pairs that meet in a list of index, but for pairs that two others link."""
    pairs = cut(hub_pairs(index))
    ends = lambda p: p.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    found = cut(similar(ends(pairs).distinct(), named, sets, percent, least, k))
    both = found.select("a", "b").union(found.select("b", "a")).toDF("hub", "rep").withColumn("l", F.lit(True))
    told = cut(pairs.join(both, ["hub", "rep"], "left").select("hub", "rep", F.coalesce("l", F.lit(False)).alias("linked")))
    # hubs of one member, or of linked ones only, are done
    open_ = told.groupBy("hub").agg(F.count("*").alias("n"), F.bool_and("linked").alias("all")).filter("n > 1 AND NOT all").select("hub")
    members = cut(told.join(open_, "hub"))
    if members.isEmpty():
        return found
    more = cut(further(members, sets, percent).join(ends(pairs), ["a", "b"], "left_anti"))
    return found.union(similar(more, named, sets, percent, least, k))


def near_duplicates(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS
) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links) and kept (id = component_id) for each row.

    Two documents are linked if 100 * intersection >= percent * union of their sets.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    t = percent / 100
    least = t - Z * math.sqrt(t * (1 - t) / k)
    with small_batches(docs.sparkSession):
        rows = cut(sketched(docs, k, words))
        classes = cut(
            rows.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("mark")
            .agg(F.min(F.struct("id", "sketch")).alias("m"), F.first("n_shingles").alias("n"), F.count("*").alias("size"))
            .select(F.col("m.id").alias("rep"), "n", "mark", "size", F.col("m.sketch").alias("sketch"))
        )
        index = cut(lists(classes, least, k))
        named = classes.join(index.select("rep").distinct(), "rep", "left_semi")
        found = components(links(index, named, full_sets(named, docs, words), percent, least, k))
    moved = classes.select("mark", "rep", "size").join(
        found, F.col("rep") == F.col("node"), "left",
    )
    moved = moved.filter("size > 1 OR component IS NOT NULL").select("mark", F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "n_shingles", "mark").join(moved, "mark", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are: of each group the one of the smallest id.

    Rows are told apart by themselves: equal ids don't link rows; of a group's rows of the smallest id, the one read
    first stays. Rows without words and rows with a null id take no part and stay.
    """
    row = fresh(docs, "dup_row")
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(docs.filter(F.col(id_col).isNotNull()).select(row, text_col), percent, row, text_col)
    groups = cut(groups.select(F.col(row).alias("_row"), "component_id", "kept"))
    grouped = groups.join(groups.filter("NOT kept").select("component_id").distinct(), "component_id", "left_semi")
    ids = docs.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"))
    members = cut(grouped.join(ids, "_row").select("component_id", F.struct("_id", "_row").alias("m")))
    first = members.groupBy("component_id").agg(F.min("m").alias("f"))
    gone = members.select(F.col("m._row").alias(row)).join(first.select(F.col("f._row").alias(row)), row, "left_anti")
    return docs.join(gone, row, "left_anti").drop(row)
