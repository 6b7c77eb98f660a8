"""Invariants of the catalog chain and the driver contract."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from shopsmith.plans.catalog import Catalog
from shopsmith.plans.workflow import run_workflow
from shopsmith.sources.fixtures import CatalogInputs
from shopsmith.streaming import pages as SP
from shopsmith.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_catalog_invariants(spark):
    c = Catalog.of(spark, SF)
    n_rec = c.records.count()
    assert c.products.count() + c.product_rejects.count() == n_rec
    # parents exist
    t = c.tree
    orphans = t.filter(F.col("parent_id") != 0).join(t.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    assert orphans.count() == 0
    # every SKU x warehouse once
    inv = c.inventory
    assert inv.count() == c.skus.count() * c.inputs.warehouses.count()
    assert inv.groupBy("sku_id", "warehouse_id").count().filter("count > 1").count() == 0
    # at most one main image per SKU
    assert c.image_plan.filter("is_main").groupBy("sku_id").count().filter("count > 1").count() == 0
    # ids unique
    assert c.products.groupBy("id").count().filter("count > 1").count() == 0
    assert c.skus.groupBy("id").count().filter("count > 1").count() == 0


def test_workflow_from_pages(spark):
    ci = CatalogInputs(spark, SF)
    res = run_workflow(ci.product_pages, ci.existing_categories, ci.existing_brands, ci.warehouses, key="page_id")
    s = res.summary.first()
    n_default = ci.products.filter(F.col("brand") == "Default").count()
    assert s["products"] == ci.products.count() - n_default
    assert s["images_associated"] == 2 * s["products"] and s["images_failed"] == 0


def test_upsert_twice_is_once(spark):
    target = scratch_path(spark, "t-upsert")
    b = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    SP.upsert_batch(spark, b, target, 1)
    first = sorted(SP.latest_snapshot(spark, target).collect())
    SP.upsert_batch(spark, b, target, 1)
    assert sorted(SP.latest_snapshot(spark, target).collect()) == first


def test_stream_two_drops_equal_one_batch(spark):
    ci = CatalogInputs(spark, SF)
    pages = ci.product_pages.select("url", "status", F.lit("text/html").alias("content_type"), "html",
                                    F.col("page_id").cast("long").alias("page_id"))
    base = scratch_path(spark, "t-stream")
    pages.filter("page_id % 2 = 0").write.parquet(f"{base}/in/d=1")
    SP.stream_pages(spark, f"{base}/in", f"{base}/out", f"{base}/ck")
    pages.filter("page_id % 2 = 1").write.parquet(f"{base}/in/d=2")
    SP.stream_pages(spark, f"{base}/in", f"{base}/out", f"{base}/ck")
    SP.stream_pages(spark, f"{base}/in", f"{base}/out", f"{base}/ck")  # nothing new
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == pages.count()
    assert out.select("url").distinct().count() == pages.count()
    assert out.select("batch_id").distinct().count() == 2


def test_ids_do_not_depend_on_partition_count(spark):
    from shopsmith.plans.catalog import Catalog as Cat
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            c = Cat(spark, SF)
            out.append((sorted(c.tree.select("id", "path").collect()),
                        sorted(c.skus.select("id", "product_id", "pos").collect()),
                        sorted(c.products.select("id", "url", "category_id", "brand_id").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


def test_rerun_of_a_stage_gives_the_same_data(spark):
    from shopsmith.sources import stages as ST
    c = Catalog.of(spark, SF)
    base = scratch_path(spark, "t-rerun")
    ST.write_stage(c.skus, "products_skus", base)
    first = sorted(ST.load_stage(spark, "products_skus", base).collect())
    ST.write_stage(Catalog(spark, SF).skus, "products_skus", base)   # rebuilt from scratch
    assert sorted(ST.load_stage(spark, "products_skus", base).collect()) == first


def test_outbox_payloads_have_required_fields(spark):
    from shopsmith.operators.quality import check_required
    from shopsmith.sources.stages import export_payloads
    c = Catalog.of(spark, SF)
    out = export_payloads({"tree": c.tree, "brands": c.brands, "products": c.products, "skus": c.skus,
                           "images": c.image_plan, "prices": c.prices, "inventory": c.inventory})
    names = {"department": "Department", "category": "Category", "brand": "Brand", "product": "Product",
             "sku": "SKU"}
    for entity, schema_name in names.items():
        part = out.filter(F.col("entity") == entity)
        bad = check_required(part, schema_name).filter(F.col("error").isNotNull())
        assert bad.count() == 0, (entity, bad.first())
    # load order: departments before categories (by level) before products before SKUs
    order = dict(out.groupBy("entity").agg(F.min("load_order")).collect())
    assert order["product"] < order["sku"] < order["image"] < order["price"] < order["inventory"]
