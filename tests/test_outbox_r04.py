"""the outbox at a size where its checksum leaves 64 bits and its files must be many."""
import glob

from pyspark.sql import functions as F

from shopsmith.operators import images as I
from shopsmith.plans.catalog import Catalog
from shopsmith.sources import stages as ST

OUTBOX = "entity string, load_order int, key long, payload string"


def test_sum_beyond_64_bits(spark):
    """Some 4 billion requests: the sum of their bits overflowed."""
    rows = [("a", 2**62), ("a", 2**62), ("a", 2**62 + 5), ("b", 7), ("b", 2**63 - 8), ("c", 2**63 - 1), ("c", 2**63 - 1), ("c", 3)]
    got = spark.createDataFrame(rows, "g string, n long").groupBy("g").agg(ST.sum_64(F.col("n")).alias("s"))
    assert dict(got.dtypes)["s"] == "bigint"
    assert {r["g"]: r["s"] for r in got.collect()} == {"a": 3 * 2**62 + 5 - 2**64, "b": 2**63 - 1, "c": 1}


def test_digest_is_the_plain_sum_while_it_fits(spark):
    rows = [("a", 1, k, '{"n":%d}' % k) for k in range(50)] + [(None, 1, None, None), ("b", 1, 3, None)]
    out = spark.createDataFrame(rows, OUTBOX)
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", "key", "payload")), 1, 8), 16, 10).cast("long")
    plain = out.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum(bits).alias("checksum"))
    assert sorted(map(str, ST.outbox_digest(out).collect())) == sorted(map(str, plain.collect()))


def test_outbox_files_are_bounded_and_read_by_entity(spark, tmp_path, monkeypatch):
    """A gzipped file is one task: all requests of a task went into one, whatever their number."""
    monkeypatch.setattr(ST, "FILE_REQUESTS", 10)
    rows = ([("inventory", 7000, k, "{}") for k in range(25)] + [("sku", 4000, 1, '{"a":"é\\n"}')]
            + [("x/{y}*", 1, 5, "{}"), (None, 2, 6, None)])
    out = spark.createDataFrame(rows, OUTBOX).coalesce(1)
    ST.write_outbox(out, str(tmp_path / "box"))
    assert len(glob.glob(f"{tmp_path}/box/entity=inventory/part-*.json.gz")) == 3
    back = ST.read_outbox(spark, str(tmp_path / "box")).select(*out.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, out.collect()))


def test_extensions_are_read_once_a_record(spark):
    """The expressions of an image's extension ran for every SKU of its record."""
    skus = spark.createDataFrame([(1, 10, "u"), (2, 10, "u"), (3, 11, "v"), (4, 12, None)], "id long, product_id long, url string")
    records = spark.createDataFrame([("u", ["https://h/a.PNG?x=1", None, "b"]), ("v", None), (None, ["c.gif"])], "url string, images array<string>")
    plan = I.image_plan(skus, records)
    above = plan._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "file_name" in above and "regexp" not in above
    assert sorted((r["sku_id"], r["seq"], r["source_url"] or "", r["file_name"], r["is_main"]) for r in plan.collect()) == [
        (s, n, u, f"{s}_{n}{e}", n == 1) for s in (1, 2) for n, u, e in ((1, "https://h/a.PNG?x=1", ".png"), (2, "", ".jpg"), (3, "b", ".jpg"))]


def test_inventory_is_dealt_out_by_rows(spark):
    """SKUs in one small file were paired with every warehouse by one task."""
    c = Catalog(spark, "none")
    c.__dict__["skus"] = spark.range(1000).coalesce(1)
    c.inputs.__dict__["warehouses"] = spark.createDataFrame([("1_1",), ("1_2",), (None,)], "id string")
    # of tables as small as these Spark may broadcast either
    plan = c.inventory._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {4 * spark.sparkContext.defaultParallelism}, true" in plan
    assert c.inventory.distinct().count() == 2000
