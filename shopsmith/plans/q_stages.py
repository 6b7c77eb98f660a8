"""Sources, stage files, resume, streaming and the whole workflow
(A1, A7-A10, J13, S1, S2, E13, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.report import one_row
from ..session import folder_names, remove_path, scratch_path
from ..sources import stages as ST
from ..sources import tables as TB
from ..streaming import keyed as KT
from ..streaming import pages as SP
from .catalog import Catalog
from .workflow import run_workflow
from .q_images import _BASE, _CATEGORY_BODY, _PLAN, _PRODUCT_BODY, _SKU_BODY, _V
from .registry import query


def _cat(spark, sf):
    return Catalog.of(spark, sf)


@query("read_pages", """
select url from pages union all select url from v_products where product_key % 9 <> 4""", ("v_products",))
def q_read_pages(spark, sf):
    """A1: captured pages (no status column: all answered) plus shop pages where every
    9th answered 404; only 200s are kept."""
    c = _cat(spark, sf)
    path = scratch_path(spark, "pages")
    shop = c.inputs.product_pages.withColumn(
        "status", F.when(F.col("page_id") % 9 == 4, 404).otherwise(200))
    shop.select("url", "status", F.lit("text/html").alias("content_type"), "html").write.parquet(path + "/shop")
    captured = TB.read_pages(spark, f"{sf}/pages.parquet").select("url")
    return captured.unionByName(TB.read_pages(spark, path + "/shop").select("url"))


@query("read_product_records", """
select url, name, brand, cast((select count(*) from v_skus s where s.product_key = p.product_key) as integer) as n_skus
from v_products p""", ("v_products", "v_skus"))
def q_read_product_records(spark, sf):
    """Records written as JSON lines (splittable) and read back with the fixed schema."""
    c = _cat(spark, sf)
    path = scratch_path(spark, "records")
    c.records.drop("product_key").write.json(path)
    r = TB.read_product_records(spark, path, document=False)
    return r.select("url", F.col("product.Name").alias("name"), F.col("brand.Name").alias("brand"),
                    F.size("skus").alias("n_skus"))


@query("read_existing_catalog", "select id, parent_id, name from v_existing_categories", ("v_existing_categories",))
def q_read_existing_catalog(spark, sf):
    """An export where the parent field goes by three names and ids are text."""
    c = _cat(spark, sf).inputs.existing_categories
    path = scratch_path(spark, "existing")
    m = F.col("id") % 3
    parent_key = F.when(m == 0, "FatherCategoryId").when(m == 1, "FatherCategoryID").otherwise("ParentId")
    out = c.select(F.to_json(F.create_map(F.lit("Id"), F.col("id").cast("string"), F.lit("Name"), F.col("name"),
                                          parent_key, F.col("parent_id").cast("string"))).alias("value"))
    out.write.text(path)
    return TB.read_existing_catalog(spark, path)


@query("write_load_stage", "select count(*) as n, count(distinct url) as urls from v_products", ("v_products",))
def q_write_load_stage(spark, sf):
    """Save the extraction stage under its numbered name and load it back."""
    c = _cat(spark, sf)
    base = scratch_path(spark, "stages")
    ST.write_stage(c.records, "extraction", base)
    back = ST.load_stage(spark, "extraction", base)
    missing = ST.load_stage(spark, "images", base)
    assert missing is None
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"))


@query("pending", "select url from v_products where product_key % 2 = 1", ("v_products",))
def q_pending(spark, sf):
    """Resume: only records not yet in the saved stage."""
    c = _cat(spark, sf)
    base = scratch_path(spark, "resume")
    ST.write_stage(c.records.filter(F.col("product_key") % 2 == 0).select("url"), "extraction", base)
    done = ST.load_stage(spark, "extraction", base)
    return ST.pending(c.records.select("url"), done, "url")


_DIGEST = "cast(sum(cast('0x' || substr(md5(cast(key as varchar) || '|' || payload), 1, 8) as bigint)) as bigint)"


@query("write_outbox", f"""with {_BASE}, {_PLAN},
outbox as (select 'department' as entity, id as key, {_CATEGORY_BODY.format(father="'null'")} as payload from tree2 where level = 1 and created
union all select 'category', id, {_CATEGORY_BODY.format(father="cast(parent_id as varchar)")} from tree2 where level > 1 and created
union all select 'brand', id, '{{"Name":"' || name || '","Active":true,"Text":null,"Keywords":null,"SiteTitle":"' || name || '"}}' from bdim where created
union all select 'product', id, {_PRODUCT_BODY} from prod
union all select 'sku', id, {_SKU_BODY} from skids
union all select 'image', sku_id, '{{"url":"https://files.example.com/shop/catalog-images/main/images/' || file_name || '","name":"' || file_name
  || '","isMain":' || case when is_main then 'true' else 'false' end || ',"label":"' || file_name || '"}}' from plan
union all select 'price', id, '{{"markup":0,"costPrice":' || cast(price as varchar) || '}}' from skids
union all select 'inventory', s.id, '{{"warehouseId":"' || w.id || '","unlimitedQuantity":false,"quantity":100}}' from skids s, v_warehouses w)
select entity, count(*) as n, {_DIGEST} as checksum from outbox group by entity""", _V)
def q_write_outbox(spark, sf):
    """A10 sink: every request written as JSON lines per entity and read back: how many of
    each entity, and a checksum over their texts."""
    c = _cat(spark, sf)
    out = ST.export_payloads({"tree": c.tree, "brands": c.brands, "products": c.products, "skus": c.skus,
                              "images": c.image_plan, "prices": c.prices, "inventory": c.inventory})
    path = scratch_path(spark, "outbox")
    ST.write_outbox(out, path)
    return ST.outbox_digest(ST.read_outbox(spark, path))


@query("resumed_workflow", """
with p as (select * from v_products where brand <> 'Default')
select (select count(*) from p where product_key % 2 = 0) as products_first, (select count(*) from p) as products,
  true as kept_same, true as rebuilt_changed, true as rebuilt_broken""", ("v_products",))
def q_resumed_workflow(spark, sf):
    """A9 in E13: a run over half the pages, a second over the same (nothing is built again),
    one over all pages (what depends on them is), and one after a stage lost its manifest."""
    c = _cat(spark, sf).inputs
    base = scratch_path(spark, "resumed")

    def go(pages):
        r = run_workflow(pages, c.existing_categories, c.existing_brands, c.warehouses, key="page_id", stage_dir=base)
        return r.products.count(), {n: folder_names(spark, f"{base}/{n}") for n in folder_names(spark, base)}

    half = c.product_pages.filter(F.col("page_id") % 2 == 0)
    n_half, first = go(half)
    _, again = go(half)
    n_all, changed = go(c.product_pages)
    broken = next(n for n in changed if n.endswith("_category_tree"))
    remove_path(spark, f"{base}/{broken}/manifest")
    n_mended, mended = go(c.product_pages)
    same = [n for n in changed if changed[n] == mended[n]]
    return spark.createDataFrame([(n_half, n_mended, first == again, not any(first[n] == changed[n] for n in first),
                                   n_all == n_mended and broken not in same and len(same) == len(changed) - 1)],
                                 "products_first long, products long, kept_same boolean, rebuilt_changed boolean, rebuilt_broken boolean")


@query("stream_pages", """
select url, name, cast(case when product_key % 2 = 0 then 0 else 1 end as integer) as batch_id from v_products""",
       ("v_products",))
def q_stream_pages(spark, sf):
    """Shop pages arrive in two drops; the second run only processes the new files."""
    c = _cat(spark, sf)
    base = scratch_path(spark, "stream")
    pages = c.inputs.product_pages.select("url", "status", F.lit("text/html").alias("content_type"), "html",
                                          F.col("page_id").cast("long").alias("page_id"))
    pages.filter(F.col("page_id") % 2 == 0).write.parquet(f"{base}/in/drop=1")
    SP.stream_pages(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    pages.filter(F.col("page_id") % 2 == 1).write.parquet(f"{base}/in/drop=2")
    SP.stream_pages(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    out = spark.read.parquet(f"{base}/out")
    return out.select("url", F.col("product.Name").alias("name"), "batch_id")


@query("stream_upsert", """
select id, name, true as is_active, true as is_visible from v_existing_products
union all select product_key, name, true, true from v_products where product_key % 3 <> 0""",
       ("v_products", "v_existing_products"))
def q_stream_upsert(spark, sf):
    """Existing products as the start of the keyed table, then new product rows arriving
    as files in two drops and folded in by a file stream (one micro-batch per drop):
    existing rows kept and switched on, new ones inserted; the second batch compacts."""
    c = _cat(spark, sf)
    base = scratch_path(spark, "upsert")
    target = f"{base}/table"
    KT.create_keyed(c.inputs.existing_products.select("id", "name", "is_active", "is_visible"), target, buckets=8)
    new = c.inputs.products.select(F.col("product_key").alias("id"), "name")
    for drop, parity in ((1, 0), (2, 1)):
        new.filter(F.col("id") % 2 == parity).write.parquet(f"{base}/in/drop={drop}")
        source = spark.readStream.schema("id long, name string").parquet(f"{base}/in")
        KT.stream_upsert(spark, source.select("id", "name"), target, f"{base}/ckpt", most_deltas=1)
    return KT.read_keyed(spark, target)


@query("stream_ids", """
with first as (select url, product_key % 3 as part from v_products)
select url, cast(100 + row_number() over (order by case when part = 0 then 0 else 1 end, url) as bigint) as id,
  cast(case when part = 0 then 1 else 2 end as bigint) as drop_no from first""", ("v_products",))
def q_stream_ids(spark, sf):
    """E2 for pages that arrive later (S1): a third of the shop pages in the first drop, all
    of them (so those again) in the second; every page keeps the id it got first."""
    c = _cat(spark, sf)
    base = scratch_path(spark, "stream-ids")
    pages = c.inputs.product_pages.select("url", "status", F.lit("text/html").alias("content_type"), "html",
                                          F.col("page_id").cast("long").alias("page_id"))
    for drop, rows in ((1, pages.filter(F.col("page_id") % 3 == 0)), (2, pages)):
        rows.write.parquet(f"{base}/in/drop={drop}")
        SP.stream_pages(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", registry=f"{base}/ids", first_id=101)
    # the same id in every drop, else a page shows twice
    return spark.read.parquet(f"{base}/out").groupBy("url", "id").agg((F.min("batch_id") + 1).cast("long").alias("drop_no"))


@query("run_workflow", """
with cats as (select distinct l1, l2 from v_products)
select (select count(distinct l1) from v_products) as departments, (select count(*) from cats) as categories,
  (select count(distinct brand) from v_products where brand <> 'Default') as brands,
  (select count(*) from v_products where brand <> 'Default') as products,
  (select count(*) from v_products where brand <> 'Default') as skus,
  (select count(*) from v_products where brand <> 'Default') as skus_active,
  (select 2 * count(*) from v_products where brand <> 'Default') as images_associated, cast(0 as bigint) as images_failed,
  (select count(*) from v_products where brand <> 'Default') as prices,
  (select count(*) from v_products, v_warehouses where brand <> 'Default') as inventory_rows""",
       ("v_products", "v_warehouses"))
def q_run_workflow(spark, sf):
    """Shop pages to load requests; the one-row execution summary."""
    c = _cat(spark, sf).inputs
    res = run_workflow(c.product_pages, c.existing_categories, c.existing_brands, c.warehouses,
                       existing_products=c.existing_products, key="page_id")
    return res.summary


@query("run_workflow_outcomes", """
with p as (select product_key as k from v_products where brand <> 'Default'),
i as (select k, seq, (k + seq) % 3 = 0 or (k % 10 = 0) as failed from p cross join (values (1), (2)) t(seq))
select (select count(*) from p) as products, (select count(distinct k) from i where not failed) as skus_active,
  (select count(*) from i where not failed) as images_associated, (select count(*) from i where failed) as images_failed,
  (select count(distinct k) from i where not failed) as active_requests, cast(0 as bigint) as problems,
  (select 2 * count(*) from p) as spec_values, (select count(*) from (select distinct l1, l2 from v_products where brand <> 'Default') c) * 2 as spec_fields_created""", ("v_products",))
def q_run_workflow_outcomes(spark, sf):
    """E13 with an image host that fails some images (E5, E8) and specifications loaded into
    a catalog without fields (E11): counts from the summaries and from the requests."""
    c = _cat(spark, sf).inputs
    k = F.col("product_key")
    failed = ((k + F.col("seq")) % 3 == 0) | (k % 10 == 0)
    outcomes = c.products.select("product_key", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).select(
        k.alias("sku_id"), "seq", F.when(failed, "failed").otherwise("associated").alias("status"), F.when(failed, "HTTP 500").alias("error"))
    none = spark.createDataFrame([], "category_id long, name string, id long, field_type string")
    res = run_workflow(c.product_pages, c.existing_categories, c.existing_brands, c.warehouses, outcomes=outcomes, key="page_id", spec_fields=none)
    active = res.outbox.filter("entity = 'sku' and get_json_object(payload, '$.IsActive') = 'true'")
    return one_row(res.summary.select("products", "skus_active", "images_associated", "images_failed"),
                   active.agg(F.count(F.lit(1)).alias("active_requests")), res.outbox_problems.agg(F.count(F.lit(1)).alias("problems")),
                   res.outbox.agg(F.count_if(F.col("entity") == "spec_value").alias("spec_values")),
                   res.catalog_summary.select("spec_fields_created"))


@query("load_order", """
select * from (values ('department', 0), ('category', 1002), ('brand', 2000), ('product', 3000), ('sku', 4000),
  ('image', 5000), ('price', 6000), ('inventory', 7000)) t(entity, first_order)""")
def q_load_order(spark, sf):
    """The first load position of every entity in the workflow's outbox (a run
    against a catalog that only has second-level categories, so every entity kind
    is requested).  The workflow's stages are built once per session and folder."""
    cat = _cat(spark, sf)
    if "load_order_run" not in cat.memo:
        c = cat.inputs
        cat.memo["load_order_run"] = run_workflow(
            c.product_pages, c.existing_categories.filter(F.col("parent_id") > 0), c.existing_brands,
            c.warehouses, key="page_id")
    res = cat.memo["load_order_run"]
    return res.outbox.groupBy("entity").agg(F.min("load_order").alias("first_order"))
