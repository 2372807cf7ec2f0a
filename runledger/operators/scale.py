"""Building blocks that stay distributed when one key holds a third of all rows.

* `ordered_scan`   running sum/min/max (and rank) inside groups, in two levels: buckets of the sort key are
                   aggregated, the bucket totals are scanned, and only rows of one bucket share a task.
* `order_stats`    exact order statistics and quantiles: histograms between a group's own bounds narrow the span of each
                   wanted rank until it is small, and only the distinct values of those spans are sorted.
* `label_by_hash_rank`  exact stratified split / sampling: whole hash buckets are labelled without moving their
                   rows, only rows of buckets that straddle a cut are ranked.
* `stage`          writes an intermediate result to the cluster's checkpoint folder and reads it back: its size is
                   then known (`fits_broadcast` counts it from file metadata), and a lost executor does not re-run
                   what came before.

`stage` runs a job when it is called, hence so do the functions built on it, also when only a plan is asked for; a caller with
many steps on one table should stage that table first. `staging` deletes what was staged inside it.

A side is broadcast only after `fits_broadcast`; beyond that limit the same result comes from a shuffle join whose
big side was first merged to distinct values, or salted.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions.hashing import order_hash

BROADCAST_ROWS = 100_000
#: Bytes of the Parquet files of a broadcast side.
BROADCAST_BYTES = 4 << 20
#: Bytes of input that one core should have at least before a table is left in its few splits.
BYTES_PER_CORE = 4 << 20

_staged: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster (spark.checkpoint.dir); local sessions without one get a temporary folder as that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="runledger-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/runledger/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write and read back a small table; cuts lineage and gives the optimizer its real size."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete on exit what was staged inside; results must have been written or collected by then."""
    first = len(_staged)
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        while len(_staged) > first:
            path = hadoop(_staged.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size of a table, from file sizes; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """Give a table of few bytes, hence few input splits, one partition per core.

    Meant for small or single-file inputs under work that is heavy per row; a large table stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < cores * BYTES_PER_CORE else df


def fits_broadcast(staged: DataFrame) -> bool:
    """Whether a staged table is small enough, in bytes and rows, to copy to every executor."""
    return planned_bytes(staged) <= BROADCAST_BYTES and staged.count() <= BROADCAST_ROWS


def group_key(by: list[str]) -> Column:
    """One non-null key for any grouping; a null member of the struct is an ordinary group value."""
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))


def group_values(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Group key `_g` and double `_v` of the rows that have a value; NaN counts as missing."""
    values = df.select(group_key(by).alias("_g"), value.cast("double").alias("_v"))
    return values.where(F.col("_v").isNotNull() & ~F.isnan("_v"))


#: Rows that a task should scan in order, and keys that are sampled for each bound between two such tasks.
SCAN_ROWS, SAMPLED = 500_000, 64


def with_order_bucket(df: DataFrame, order: list[str], name: str = "_b") -> DataFrame:
    """Adds the bucket of each row, monotone in `order`: about one for every SCAN_ROWS rows, none with more than twice as many.

    Bounds are sampled from the whole sort key, so keys that lie close together, or one value in many rows that a later column of
    `order` tells apart, are cut like any others; only rows equal in all of `order` share a bucket by necessity. Buckets are
    counted, and one that came out too large is sampled again by itself. The bounds, one for each bucket, stand in a sorted array
    that every row searches by halving. A table of up to SCAN_ROWS rows has one bucket and costs a count.
    """
    rows = df.count()
    if rows <= SCAN_ROWS:
        return df.withColumn(name, F.lit(0).cast("long"))
    key = F.struct(*[F.col(c) for c in order])
    bounds = stage(_every_nth(df.select(key.alias("k")), SAMPLED, SAMPLED * rows / SCAN_ROWS / rows), "bounds")
    while True:
        found = _search(df, key, bounds, name)
        sizes = found.groupBy(name).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        heavy = stage(sizes.where((F.col("n") > 2 * SCAN_ROWS) & (F.col("low") < F.col("high"))).select(name), "heavy-buckets")
        if heavy.isEmpty():
            return found
        inside = found.join(F.broadcast(heavy), name).select(key.alias("k"))  # fewer than rows / SCAN_ROWS names
        more = _every_nth(inside, SAMPLED, min(1.0, 4 * SAMPLED / SCAN_ROWS))
        # the largest key too, so that a bucket of two values is cut as well
        ends = inside.agg(F.max("k").alias("k")).where("k is not null")
        bounds = stage(bounds.union(more).union(ends).distinct(), "bounds")


def _every_nth(keys: DataFrame, n: int, share: float) -> DataFrame:
    """Every n-th of a sample of the keys `k`, in their order; a distributed sort, no task holds the sample."""
    sample = keys.sample(min(1.0, share), 17).orderBy("k").withColumn("_i", F.monotonically_increasing_id())
    inside = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))  # the position within its partition
    return sample.where(inside % n == n - 1).select("k").distinct()


def _search(df: DataFrame, key: Column, bounds: DataFrame, name: str) -> DataFrame:
    """Adds the number of bounds that each row's key reaches, by binary search in the sorted array of all bounds."""
    number = bounds.count()
    listed = bounds.agg(F.array_sort(F.collect_list("k")).alias("k")).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, number.bit_length())))])
    halving = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.col("_key") >= F.get("_bounds", at + step - 1), at + step).otherwise(at))
    searched = df.withColumns({"_key": key, "_bounds": listed}).withColumn(name, halving.cast("long"))
    return searched.drop("_key", "_bounds")


_SCANS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda local, before: local + F.coalesce(before, F.lit(0))),
    "min": (F.min, lambda local, before: F.least(local, before)),
    "max": (F.max, lambda local, before: F.greatest(local, before)),
}


def ordered_scan(df: DataFrame, by: list[str], bucket: Column | None, order: list[str],
                 running: dict[str, tuple[str, Column]], descending: bool = False) -> DataFrame:
    """Add inclusive running aggregates `running[name] = (sum|min|max, column)` within `by`, along `order`.

    Equal to one window over `by`, but a task holds the rows of one (group, bucket) only: bucket totals are scanned first, then
    the rows of each bucket. `bucket` must be non-null and monotone in the order; without one, buckets are those of
    `with_order_bucket`, whose number grows with the table. Rows are shuffled once: the join with the bucket offsets uses the same
    partitioning as the in-bucket window.
    """
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    bucketed = with_order_bucket(df, order) if bucket is None else df.withColumn("_b", bucket)
    keyed = bucketed.withColumn("_g", group_key(by))
    totals = keyed.groupBy("_g", "_b").agg(*[_SCANS[k][0](c).alias(f"_{n}") for n, (k, c) in running.items()])
    earlier = Window.partitionBy("_g").orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_g", "_b", *[_SCANS[k][0](f"_{n}").over(earlier).alias(f"_before_{n}") for n, (k, _) in running.items()]
    )
    inside = (
        Window.partitionBy("_g", "_b").orderBy(*[turn(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = keyed.withColumns({f"_local_{n}": _SCANS[k][0](c).over(inside) for n, (k, c) in running.items()})
    joined = local.join(offsets, ["_g", "_b"])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_SCANS[k][1](F.col(f"_local_{n}"), F.col(f"_before_{n}")).alias(n) for n, (k, _) in running.items()],
    )


def ordered_rank(df: DataFrame, by: list[str], bucket: Column | None, order: list[str], name: str = "rank",
                 descending: bool = False) -> DataFrame:
    """1-based position within `by` along `order` (which must end in a unique key)."""
    one = F.lit(1).cast("long")
    return ordered_scan(df, by, bucket, order, {name: ("sum", one)}, descending)


#: Buckets of a histogram between the bounds of a span, and rows of a span that one task may sort.
LEVEL = 1_024
SMALL = 500_000


def order_stats(df: DataFrame, by: list[str], value: Column, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact order statistics of the non-null values per group: by..., n, one column per entry of `ranks`.

    `ranks[name](n)` is the 0-based position wanted in a group of n values. Each rank lies in a span of values, at first the
    whole group's. A span of more than SMALL rows and one value is cut into LEVEL equal steps between its own bounds, and the
    step that holds the rank becomes the span; so a round divides the span by LEVEL wherever the values lie, and values close
    together or far outliers only cost a round. Each round is one scan with a partial aggregate.
    """
    values = group_values(df, by, value)
    spans = values.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), pick(F.col("n")).cast("long").alias("r")) for k, pick in ranks.items()])
    spans = spans.withColumn("_w", wanted).select("_g", "n", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("n").alias("_c"), "_w")
    spans = stage(spans, "spans")
    while True:
        wide = spans.where((F.col("_c") > SMALL) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        rows = _in_spans(values, wide)
        low, high, v = (F.greatest(F.least(F.col(c), F.lit(1.7e308)), F.lit(-1.7e308)) / 4 for c in ("_lo", "_hi", "_v"))
        step = F.least(F.floor((v - low) / (high - low) * LEVEL), F.lit(LEVEL - 1)).cast("int")
        counted = rows.groupBy("_g", F.col("_lo").alias("_from"), step.alias("_b")).agg(
            F.sum("_m").alias("_k"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        earlier = Window.partitionBy("_g", "_from").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_e", F.coalesce(F.sum("_k").over(earlier), F.lit(0)))
        cut = placed.join(wide, (placed["_g"] == wide["_g"]) & (placed["_from"] == wide["_lo"])).drop(placed["_g"])
        ranked = cut.select("_g", "n", (F.col("_before") + F.col("_e")).alias("_start"), "_k", "_l", "_h", F.explode("_w").alias("w"))
        ranked = ranked.where((F.col("w.r") >= F.col("_start")) & (F.col("w.r") < F.col("_start") + F.col("_k")))
        finer = ranked.groupBy("_g", "n", F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), F.col("_start").alias("_before"),
                               F.col("_k").alias("_c")).agg(F.collect_list("w").alias("_w"))
        done = spans.where((F.col("_c") <= SMALL) | (F.col("_lo") >= F.col("_hi")))
        spans = stage(done.union(finer), "spans")
    rows = _in_spans(values, spans.where("_lo < _hi"))
    counted = rows.groupBy("_g", "_lo", "_v").agg(F.sum("_m").alias("_k"))
    upto = Window.partitionBy("_g", "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counted.withColumn("_end", F.sum("_k").over(upto))
    several = ends.join(spans.where("_lo < _hi"), ["_g", "_lo"]).withColumn("_end", F.col("_before") + F.col("_end"))
    found = several.select("_g", "n", "_v", "_end", "_k", F.explode("_w").alias("w"))
    found = found.where((F.col("w.r") >= F.col("_end") - F.col("_k")) & (F.col("w.r") < F.col("_end"))).select("_g", "n", "_v", "w")
    single = spans.where("_lo >= _hi").select("_g", "n", F.col("_lo").alias("_v"), F.explode("_w").alias("w"))
    picks = [F.max(F.when(F.col("w.name") == k, F.col("_v"))).alias(k) for k in ranks]
    out = found.union(single).groupBy("_g", "n").agg(*picks)
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in by], "n", *ranks)


def _in_spans(values: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (_g, _v, copies _m, _lo, _hi) of the values inside a span; the spans of a group are disjoint and few."""
    listed = stage(spans.groupBy("_g").agg(F.collect_list(F.struct("_lo", "_hi")).alias("_s")), "span-lists")
    joined = merged_with_stats(values, listed).withColumnRenamed("_c", "_m")
    inside = F.filter("_s", lambda s: (s["_lo"] <= F.col("_v")) & (F.col("_v") <= s["_hi"]))
    return joined.select("_g", "_v", "_m", F.inline(inside))


def quantiles(df: DataFrame, by: list[str], value: Column, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation: by..., n, one column per entry of `qs`."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in qs.items():
        ranks[f"{name}__lo"] = lambda n, q=q: F.floor((n - 1) * F.lit(float(q)))
        ranks[f"{name}__hi"] = lambda n, q=q: F.ceil((n - 1) * F.lit(float(q)))
    stats = order_stats(df, by, value, ranks)
    out, last = [], F.col("n") - 1
    for name, q in qs.items():
        at, lo = last * F.lit(float(q)), F.col(f"{name}__lo")
        out.append((lo + (F.col(f"{name}__hi") - lo) * (at - F.floor(at))).alias(name))
    return stats.select(*by, "n", *out)


def label_by_hash_rank(df: DataFrame, by: list[str], ids: list[str], seed: int | str,
                       cuts: list[tuple[str, Callable[[Column], Column]]], rest: str | None = None,
                       name: str = "part", digits: int = 3) -> DataFrame:
    """Label rows by their place in the hash order of their group.

    A row with 1-based place p in a group of n rows gets the first label whose `cut(n) >= p`, else `rest`;
    without `rest` the remaining rows are dropped. Cuts must not decrease.

    Buckets are the first `digits` hex digits of the order hash, hence even for any id distribution.
    """
    keyed = df.withColumns({"_g": group_key(by), "_h": order_hash(seed, *[F.col(c) for c in ids])})
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    whole = Window.partitionBy("_g")
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy("_g", "_b").agg(F.count("*").alias("_c")).select(
        "_g", "_b", "_c",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_c").over(whole).alias("_n"),
    )

    def label(place: Column) -> Column:
        expr = F
        for text, cut in cuts:
            expr = expr.when(place <= cut(F.col("_n")), F.lit(text))
        return expr.otherwise(F.lit(rest))

    plan = buckets.select(
        "_g", "_b", "_before", "_n",
        label(F.col("_before") + 1).alias("_first"),
        label(F.col("_before") + F.col("_c")).alias("_last"),
    ).where(F.col("_first").isNotNull())
    plan = stage(plan, "hash-rank")
    joined = keyed.join(plan, ["_g", "_b"])
    uniform = F.col("_first").eqNullSafe(F.col("_last"))
    columns = [F.col(c) for c in df.columns]
    direct = joined.where(uniform).select(*columns, F.col("_first").alias(name))
    inside = Window.partitionBy("_g", "_b").orderBy("_h", *ids)
    edge = joined.where(~uniform).withColumn("_place", F.col("_before") + F.row_number().over(inside))
    edge = edge.select(*columns, label(F.col("_place")).alias(name)).where(F.col(name).isNotNull())
    return direct.unionByName(edge)


def salted_join(big: DataFrame, staged: DataFrame, on: list[str], salt_from: list[str], salts: int = 32) -> DataFrame:
    """Inner join with a staged table of one row per key.

    Broadcast when the staged table is small. Otherwise it is repeated `salts` times and the rows of a hot key
    spread over as many tasks by the hash of `salt_from`, which should differ between the rows of a key. That join is a
    shuffle join by hint: the optimizer's size of the repeated table leaves the repeats out, so it would broadcast it.
    """
    if fits_broadcast(staged):
        return big.join(F.broadcast(staged), on)
    repeated = staged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int")
    return big.withColumn("_salt", salt).join(repeated.hint("merge"), [*on, "_salt"]).drop("_salt")


def merged_with_stats(values: DataFrame, staged: DataFrame) -> DataFrame:
    """Values (_g, _v) with their copies `_c` and the statistics of their group from a staged table keyed by _g."""
    if fits_broadcast(staged):
        return values.withColumn("_c", F.lit(1).cast("long")).join(F.broadcast(staged), ["_g"])
    merged = values.groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    return salted_join(merged, staged, ["_g"], ["_v"])
