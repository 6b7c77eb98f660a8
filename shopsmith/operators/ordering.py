"""Global positions, samples and batches without a single-partition window.

The building block: range-sort by the order key, number rows inside each sorted
partition, count rows per partition (one number per partition, so what reaches
the driver is bounded by the partition count, not the data), and add the running
offset of the row's partition.  ``places`` does so with the key columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

_LOCAL_BITS = 33  # monotonically_increasing_id puts the partition id above bit 33


def _order_cols(order) -> list[Column]:
    if isinstance(order, (str, Column)):
        order = [order]
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _numbered(df: DataFrame, cols: list[Column], name: str, partitions: int | None) -> DataFrame:
    """``df`` range-sorted by ``cols`` and written once, with the row's global place."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The ids must not change between the counting pass and the numbering pass.
    rows = staged(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
                  .withColumn("__mid", F.monotonically_increasing_id()), "places")
    part = F.shiftright(F.col("__mid"), _LOCAL_BITS)
    # Rows per range partition: one number per partition (bounded by `n`, not by
    # the data), turned into running offsets and applied as a literal array.
    counts = dict(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, running = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(running)
        running += counts.get(p, 0)
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets or [0]]), (part + 1).cast("int"))
    local = F.col("__mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return rows.withColumn(name, off + local).drop("__mid")


def places(df: DataFrame, keys: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """(keys, __copy, ``name``): the 0-based place of every row of ``df`` in the order of
    ``keys``, from the key columns alone.  Rows that repeat a key are its copies 1, 2, ..."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    copies = counted.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__copy"))
    return _numbered(copies, [F.col(c) for c in [*keys, "__copy"]], name, partitions)


def at_places(df: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """The rows of ``df`` whose places are in ``ranks`` (of ``places``), with what ``ranks``
    says of them.  Whole rows are shuffled once, by their keys, and never written; where no
    key repeats, rows need no number among their copies."""
    names = [c for c in ranks.columns if c not in keys]
    renamed = ranks.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *names)
    on = F.col(keys[0]).eqNullSafe(F.col("__r0"))
    for i, k in enumerate(keys[1:], 1):
        on = on & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    own = df
    if not ranks.filter("__copy > 1").isEmpty():
        own = df.withColumn("__own", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))).cast("long"))
        on = on & (F.col("__own") == F.col("__copy"))
    return own.join(renamed, on).select(*[F.col(f"`{c}`") for c in df.columns], *[c for c in names if c != "__copy"])


def with_index(df: DataFrame, order, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """Add a 0-based ``name`` column numbering rows by ``order``.

    ``order`` must be a total order (add a unique tie-breaker) so the index is
    the same on every run and every partition count.  The rows are written once; for wide
    rows ordered by plain columns use ``places`` and ``at_places``, which write keys only.
    """
    return _numbered(df, _order_cols(order), name, partitions)


def _key_names(order) -> list[str] | None:
    """The column names of an order by plain ascending columns, else None."""
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return order if all(isinstance(c, str) for c in order) else None


def even_sample(df: DataFrame, n: int, order) -> DataFrame:
    """L1: rows 0, step, 2*step, ... (n of them) with step = total // n; n >= total keeps all.

    The places come from the key columns alone; ``df`` is joined with the n chosen keys."""
    if n is None or n <= 0:
        raise ValueError("sample size must be positive")
    total = df.count()  # one scalar
    if n >= total:
        return df
    step = total // n
    chosen = (F.col("__i") % step == 0) & (F.col("__i") < n * step)
    keys = _key_names(order)
    if keys is None:
        return with_index(df, order, "__i").filter(chosen).drop("__i")
    return at_places(df, keys, places(df, keys, "__i").filter(chosen)).drop("__i")


def first_n(df: DataFrame, n: int, order) -> DataFrame:
    """L2: first n records by order (TakeOrdered, a top-k per partition then merge)."""
    return df.orderBy(*_order_cols(order)).limit(n)


def batches(df: DataFrame, order, size: int = 100, name: str = "batch_id") -> DataFrame:
    """L4: consecutive groups of ``size`` rows by ``order``; the places come from the key
    columns alone, whole rows are only shuffled to meet them."""
    keys = _key_names(order)
    idx = with_index(df, order, "__i") if keys is None else at_places(df, keys, places(df, keys, "__i"))
    return (idx.withColumn(name, F.floor(F.col("__i") / size).cast("bigint"))
            .withColumn("batch_pos", (F.col("__i") % size).cast("int")).drop("__i"))


def assign_ids(df: DataFrame, preserved: str | Column | None, existing_max: int,
               order, name: str = "id") -> DataFrame:
    """Keep a preserved id; otherwise ``base + position + 1`` among the rows
    without one, positions taken by the business-key order, where ``base`` is the
    larger of ``existing_max`` and the highest preserved id."""
    pres = F.col(preserved) if isinstance(preserved, str) else preserved
    base_value = int(existing_max or 0)
    if pres is None:
        missing, kept = df, None
    else:
        missing = df.filter(pres.isNull())
        kept = df.filter(pres.isNotNull()).withColumn(name, pres.cast("bigint"))
        # one pass: the highest preserved id (new ids start above it, so they never
        # collide) and whether any row needs a new id at all
        stats = df.agg(F.max(pres.cast("bigint")).alias("m"), F.count_if(pres.isNull()).alias("n")).first()
        base_value = max(base_value, int(stats["m"] or 0))
        if stats["n"] == 0:
            return kept
    base = F.lit(base_value)
    new = with_index(missing, order, "__i").withColumn(
        name, (base + F.col("__i") + 1).cast("bigint")).drop("__i")
    return new if kept is None else kept.unionByName(new)


def dedupe_first_seen(df: DataFrame, key, order, keep: list[str] | None = None) -> DataFrame:
    """Keep the first occurrence per key (grouped ``min_by``, no global window)."""
    keys = [key] if isinstance(key, str) else list(key)
    order_cols = _order_cols(order)
    keep = keep or [c for c in df.columns if c not in keys]
    order_struct = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order_cols)])
    payload = F.struct(*[F.col(c) for c in keep])
    return (df.groupBy(*keys)
            .agg(F.min_by(payload, order_struct).alias("__first"))
            .select(*keys, "__first.*"))
