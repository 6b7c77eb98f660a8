"""Validation and attempt logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .ordering import with_index

# Required fields per platform entity.
REQUIRED = {
    "Department": ["Name"],
    "Category": ["Name", "FatherCategoryId"],
    "Brand": ["Name"],
    "Product": ["Name", "CategoryId", "BrandId"],
    "SKU": ["ProductId", "Name", "EAN", "IsActive"],
    "Specification": ["Name", "CategoryId", "FieldId"],
}


def record_problem(url="url", product="product"):
    """First failing rule of a record, null when valid.  A page that could not be
    parsed has no product; one without any name is none that could be loaded."""
    return (F.when(F.col(url).isNull(), F.lit("missing 'url' field"))
            .when(F.col(product).isNull(), F.lit("missing 'product' field"))
            .when(F.trim(F.coalesce(F.col(f"{product}.Name"), F.lit(""))) == "", F.lit("missing product name")))


def valid_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with reason)."""
    r = records.withColumn("reason", record_problem())
    return r.filter(F.col("reason").isNull()).drop("reason"), r.filter(F.col("reason").isNotNull())


#: JSON types of request fields, as Spark names the type of a parsed value.
TYPES = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)",
         "array": "ARRAY.*", "object": "OBJECT.*"}


def check_required(payloads: DataFrame, entity: str, payload_col: str = "payload",
                   types: dict[str, str] | None = None) -> DataFrame:
    """Names of missing required fields of a JSON payload and the first
    message (``Missing required field: X``).  With ``types`` (field -> a key of ``TYPES``)
    a field that is present in another type is reported next (a JSON null counts as one)."""
    fields = REQUIRED[entity]
    p = F.col(payload_col)
    missing = F.filter(F.array(*[F.when(F.get_json_object(p, f"$.{f}").isNull(), F.lit(f)) for f in fields]),
                       lambda x: x.isNotNull())
    out = payloads.withColumn("missing", missing)
    value = F.try_parse_json(p)
    wrong = [F.when(~F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant")).rlike(f"^{TYPES[t]}$"),
                    F.lit(f"Field '{f}' must be of type {t}")) for f, t in (types or {}).items()]
    return out.withColumn("error", F.coalesce(
        F.when(F.size("missing") > 0, F.concat(F.lit("Missing required field: "), F.col("missing")[0])), *wrong))


#: Outbox entities that have required fields, under their platform names.
_ENTITIES = {"department": "Department", "category": "Category", "brand": "Brand", "product": "Product", "sku": "SKU"}
#: JSON types that the required fields of a request have (keys of ``TYPES``).
REQUEST_TYPES = {"Name": "string", "FatherCategoryId": "integer", "CategoryId": "integer", "BrandId": "integer",
                 "ProductId": "integer", "EAN": "string", "IsActive": "boolean"}


def outbox_problems(outbox: DataFrame) -> DataFrame:
    """B15 on every request body of an outbox: (entity, key, error) of those not fit to send:
    a required field is missing, else the first one of another type."""
    checked = outbox.filter(F.col("entity").isin(list(_ENTITIES)))

    def problem(value):
        return reduce(lambda error, e: F.when(F.col("entity") == e, one(value, _ENTITIES[e])).otherwise(error), _ENTITIES, F.lit(None).cast("string"))

    def one(value, name):
        field = lambda f: F.try_variant_get(value, f"$.{f}", "variant")
        missing = [F.when(field(f).isNull() | F.is_variant_null(field(f)), F.lit(f"Missing required field: {f}")) for f in REQUIRED[name]]
        wrong = [F.when(~F.schema_of_variant(field(f)).rlike(f"^{TYPES[REQUEST_TYPES[f]]}$"), F.lit(f"Field '{f}' must be of type {REQUEST_TYPES[f]}"))
                 for f in REQUIRED[name]]
        return F.coalesce(*missing, *wrong)

    # A body is built and parsed once: as a lambda variable it is bound for all the tests of it,
    # and the filter stays above the explode, where it cannot repeat them.
    tested = checked.select("entity", "key", F.explode_outer(F.transform(F.array(F.try_parse_json("payload")), problem)).alias("error"))
    return tested.filter("error is not null")


def _carried(elements: DataFrame, n: int, size: int) -> DataFrame:
    """``elements`` (i from 0 to n - 1, first, last, closed, count, and more) with what the
    elements before each of them leave behind: ``in_run``, ``in_count``.

    An element stands for a stretch of attempts: the runs it begins and ends in, the limits
    counted in its last run since the last reset in it, and whether that count is closed to
    the left (a reset, or another run before).  Two neighbours make one such element, so a
    prefix is found in a tree: groups of ``size`` elements are scanned, each group is one
    element of the level above, and no scan covers more than ``size`` rows at any length.
    """
    e = elements.withColumn("g", F.floor(F.col("i") / size))
    w = Window.partitionBy("g").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    head = F.row_number().over(w) == 1
    parted = ~head & ~F.lag("last").over(w).eqNullSafe(F.col("first"))
    e = e.withColumn("seg", F.sum((F.col("closed") | parted).cast("int")).over(upto))
    e = e.withColumn("sum", F.sum("count").over(Window.partitionBy("g", "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    prior = lambda c: F.lag(c).over(w)
    e = e.withColumns({"head": head, "in_run": prior("last"), "in_closed": prior("seg") > 0, "in_count": prior("sum")})
    kept = [c for c in elements.columns if c not in ("in_run", "in_count")]
    if n <= size:
        return e.select(*kept, "in_run", "in_count")
    groups = e.groupBy("g").agg(F.min_by("first", "i").alias("first"), F.max_by(F.struct("last", (F.col("seg") > 0).alias("closed"), F.col("sum").alias("count")), "i").alias("t"))
    groups = staged(groups.select(F.col("g").alias("i"), "first", "t.*"), "scan-groups")
    above = _carried(groups, -(-n // size), size).select(F.col("i").alias("g"), F.col("first").alias("g_first"), F.col("in_run").alias("g_run"), F.col("in_count").alias("g_count"))
    j = e.join(above, "g")
    # the group's own start is open to the left: what its elements count goes on from before
    goes_on = F.col("g_count").isNotNull() & F.col("g_run").eqNullSafe(F.col("g_first"))
    count = (F.when(F.col("head"), F.col("g_count")).when(F.col("in_closed") | ~goes_on, F.col("in_count"))
             .otherwise(F.col("in_count") + F.col("g_count")))
    return j.select(*kept, F.when(F.col("head"), F.col("g_run")).otherwise(F.col("in_run")).alias("in_run"), count.alias("in_count"))


def attempt_cutoff(attempts: DataFrame, max_consecutive: int = 3, run: str = "run_id", pos: str = "pos",
                   outcome: str = "outcome", chunk_size: int = 4096) -> DataFrame:
    """A run stops at the attempt that makes ``max_consecutive`` rate limits in
    a row (an ``ok`` or another error resets the count, ``non_200`` leaves it);
    later attempts are ``not_attempted``.

    A parallel prefix scan: attempts are numbered in the order (run, position), whatever
    values positions have, and scanned in a tree of groups of ``chunk_size`` rows, so a run
    that holds most rows is spread like any other.
    """
    rows = with_index(attempts.select(F.col(run).alias("first"), F.col(pos).alias("p"), F.col(outcome).alias("o")), ["first", "p", "o"], "i")
    element = rows.select("i", "first", F.col("first").alias("last"), F.col("o").isin("ok", "other_error").alias("closed"),
                          (F.col("o") == "rate_limit").cast("long").alias("count"), "p", "o")
    a = _carried(element.withColumn("closed", F.coalesce("closed", F.lit(False))).withColumn("count", F.coalesce("count", F.lit(0).cast("long"))), rows.count(), chunk_size)
    goes_on = ~F.col("closed") & F.col("in_count").isNotNull() & F.col("in_run").eqNullSafe(F.col("first"))
    a = staged(a.select(F.col("first").alias(run), F.col("p").alias(pos), F.col("o").alias(outcome),
                        F.when(goes_on, F.col("in_count") + F.col("count")).otherwise(F.col("count")).alias("consecutive_limits")), "attempts")
    # written, so that the join below has two plain exchanges and a hot run is split
    stop = staged(a.filter(F.col("consecutive_limits") >= max_consecutive).groupBy(run).agg(F.min(pos).alias("__stop")), "attempt-stops")
    a = a.join(stop, run, "left")
    status = F.when(F.col("__stop").isNotNull() & (F.col(pos) > F.col("__stop")), F.lit("not_attempted")) \
        .otherwise(F.col(outcome))
    return a.select(run, pos, outcome, "consecutive_limits", status.alias("status"),
                    (F.col(pos) == F.col("__stop")).alias("stopped_here"))


def retry_schedule(attempts: DataFrame, key: str, order: str, initial: float = 2.0, factor: float = 2.0,
                   max_wait: float = 120.0, max_retries: int = 5, chunk_size: int = 4096) -> DataFrame:
    """Wait before retry k is ``min(initial * factor^k, max_wait)``; after
    ``max_retries`` retries the request gives up.  k is the attempt's position
    within its key; a hot key is numbered in chunks of ``chunk_size`` positions
    (local row numbers plus the count of earlier chunks), so no window sorts a
    whole key."""
    a = attempts.withColumn("__chunk", F.floor(F.col(order) / chunk_size))
    a = a.withColumn("__local", F.row_number().over(Window.partitionBy(key, "__chunk").orderBy(order)) - 1)
    per = a.groupBy(key, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__chunk")
                               .rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(key, "__chunk", F.coalesce(before, F.lit(0)).alias("__before"))
    k = F.col("__before") + F.col("__local")
    return a.join(per, [key, "__chunk"]).withColumn("retry", k).drop("__chunk", "__local", "__before").withColumn(
        "wait_sec", F.when(F.col("retry") < max_retries,
                           F.least(F.lit(initial) * F.pow(F.lit(factor), F.col("retry")), F.lit(max_wait)))) \
        .withColumn("gives_up", F.col("retry") >= max_retries)
