"""Image, price, stock and outbox queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as I
from ..operators.stock import sku_inventory
from ..sources import stages as S
from .catalog import Catalog
from .q_catalog import _BRANDS, _CAT_VIEWS, _PATHS, _PRODUCTS, _SKUS
from .registry import query

_V = _CAT_VIEWS + ("v_products", "v_existing_brands", "v_skus", "v_images", "v_outcomes", "v_warehouses")
_BASE = f"{_PATHS}, {_BRANDS}, {_PRODUCTS}, {_SKUS}"
_EXT = """case when e in ('.jpg', '.jpeg') then '.jpg' when e in ('.png', '.webp', '.gif', '.svg') then e else '.jpg' end"""
_PLAN = f"""
plan0 as (select s.id as sku_id, s.product_id, i.seq, i.image_url as source_url,
            lower(regexp_replace(regexp_extract(split_part(split_part(i.image_url, '?', 1), '#', 1),
              '[^./](\\.[^./]*)$', 1), '-\\d+[wWhH]?[xX]\\d+[wWhH]?', '', 'g')) as e
          from skids s join v_images i on i.product_key = s.product_id),
plan as (select sku_id, product_id, seq, source_url, cast(sku_id as varchar) || '_' || cast(seq as varchar) || {_EXT}
           as file_name, seq = 1 as is_main from plan0),
res as (select p.sku_id, p.seq, case when o.status in ('associated', 'already_exists', 'failed') then o.status
            else 'failed' end as status,
          case when coalesce(o.status, '') not in ('associated', 'already_exists')
            then left(coalesce(o.error, 'no outcome recorded'), 200) end as error
        from plan p left join v_outcomes o on o.sku_id = p.sku_id and o.seq = p.seq),
st0 as (select s.id as sku_id, count(r.seq) as total_images,
          count(*) filter (where r.status in ('associated', 'already_exists')) as total_associated,
          count(*) filter (where r.status = 'failed') as total_failed
        from skids s left join res r on r.sku_id = s.id group by s.id),
st as (select *, case when total_images = 0 then 'no_images' when total_associated = 0 then 'failed'
                 else 'completed' end as status from st0)"""


def _cat(spark, sf):
    return Catalog.of(spark, sf)


@query("image_plan", f"with {_BASE}, {_PLAN} select sku_id, seq, file_name, is_main, "
       "'https://files.example.com/shop/catalog-images/main/images/' || file_name as hosted_url from plan", _V)
def q_image_plan(spark, sf):
    return _cat(spark, sf).image_plan.select("sku_id", "seq", "file_name", "is_main", "hosted_url")


@query("image_results", f"with {_BASE}, {_PLAN} select sku_id, seq, status, error from res", _V)
def q_image_results(spark, sf):
    return _cat(spark, sf).image_results.select("sku_id", "seq", "status", "error")


@query("sku_image_status", f"with {_BASE}, {_PLAN} select * from st", _V)
def q_sku_image_status(spark, sf):
    return _cat(spark, sf).sku_image_status


@query("image_summary", f"""with {_BASE}, {_PLAN}
select count(*) as total_skus, cast(sum(total_images) as bigint) as total_images,
  cast(sum(total_associated) as bigint) as total_associated, cast(sum(total_failed) as bigint) as total_failed, count(*) filter (where status = 'completed') as skus_completed,
  count(*) filter (where status = 'failed') as skus_failed, count(*) filter (where status = 'no_images') as skus_no_images
from st""", _V)
def q_image_summary(spark, sf):
    return I.image_summary(_cat(spark, sf).sku_image_status)


@query("failed_images", f"with {_BASE}, {_PLAN} select sku_id, seq from plan "
       "where sku_id in (select sku_id from st where status = 'failed')", _V)
def q_failed_images(spark, sf):
    c = _cat(spark, sf)
    return I.failed_images(c.sku_image_status, c.image_plan).select("sku_id", "seq")


@query("activate_skus", f"with {_BASE}, {_PLAN} select sku_id as id, total_associated > 0 as is_active from st", _V)
def q_activate_skus(spark, sf):
    return _cat(spark, sf).active_skus.select("id", "is_active")


@query("sku_prices", f"""with {_BASE}
select id as sku_id, 0 as markup, cast(price as decimal(12,2)) as cost_price from skids""", _V)
def q_sku_prices(spark, sf):
    p = _cat(spark, sf).prices
    return p.select("sku_id", "markup", F.col("cost_price").cast("decimal(12,2)").alias("cost_price"))


@query("sku_inventory", f"""with {_BASE}
select s.id as sku_id, w.id as warehouse_id, 100 as quantity, false as unlimited from skids s, v_warehouses w""", _V)
def q_sku_inventory(spark, sf):
    return _cat(spark, sf).inventory


@query("enrich_images", f"""with {_BASE},
ns as (select product_id, count(*) as n from skids group by 1),
ni as (select product_key, count(*) as n from v_images group by 1),
j as (select p.url, pr.id as product_id, coalesce(ns.n, 0) as n_skus, coalesce(ni.n, 0) as n_images
      from v_products p left join prod pr on pr.id = p.product_key left join ns on ns.product_id = pr.id
      left join ni on ni.product_key = p.product_key)
select url, product_id, case when product_id is null then 'no_product' when n_skus = 0 then 'no_sku'
  when n_images = 0 then 'no_images' end as reason from j""", _V)
def q_enrich_images(spark, sf):
    c = _cat(spark, sf)
    ok, rej = I.enrich_images(c.records, c.products, c.skus)
    return ok.select("url", "product_id", F.lit(None).cast("string").alias("reason")).unionByName(rej)


@query("top_images", """
with k as (select product_key, count(*) as n_kept, string_agg(image_url, '|' order by r, seq) as kept_urls from (
  select product_key, r, seq, image_url, row_number() over (partition by product_key order by r, seq) as rn
  from v_images, (values (1), (2), (3)) t(r)) x where rn <= 10 group by product_key)
select p.product_key, coalesce(k.n_kept, 0) as n_kept, coalesce(k.kept_urls, '') as kept_urls
from v_products p left join k using (product_key)""", ("v_products", "v_images"))
def q_top_images(spark, sf):
    """L3 on galleries listed three times over (up to 12 entries): first 10 kept."""
    r = _cat(spark, sf).records
    kept = I.top_images(F.concat("images", "images", "images"))
    return r.select("product_key", F.size(kept).cast("long").alias("n_kept"), F.array_join(kept, "|").alias("kept_urls"))


@query("export_payloads", f"""with {_BASE}, {_PLAN}
select 'department' as entity, cast(0 as integer) as load_order, count(*) as n from tree2 where level = 1 and created
union all select 'category', cast(1000 + level as integer), count(*) from tree2 where level > 1 and created group by level
union all select 'brand', 2000, count(*) from bdim where created
union all select 'product', 3000, count(*) from prod
union all select 'sku', 4000, count(*) from skids
union all select 'image', 5000, count(*) from plan
union all select 'price', 6000, count(*) from skids
union all select 'inventory', 7000, count(*) from skids, v_warehouses""", _V)
def q_export_payloads(spark, sf):
    c = _cat(spark, sf)
    out = S.export_payloads({"tree": c.tree, "brands": c.brands, "products": c.products, "skus": c.skus,
                             "images": c.image_plan, "prices": c.prices, "inventory": c.inventory})
    valid = out.filter(F.get_json_object("payload", "$").isNotNull())
    return valid.groupBy("entity", "load_order").agg(F.count(F.lit(1)).alias("n")) \
        .filter((F.col("entity") != "department") | (F.col("n") > 0))


_CATEGORY_BODY = """'{{"Name":"' || name || '","FatherCategoryId":' || {father} || ',"Title":"' || name || '","Description":null,"Keywords":null,'
 || '"Active":true,"IsActive":true,"ShowInStoreFront":true,"ActiveStoreFrontLink":true,"GlobalCategoryId":1}}'"""


_PRODUCT_BODY = """'{"Name":"' || name || '","CategoryId":' || cast(category_id as varchar) || ',"BrandId":' || cast(brand_id as varchar)
  || ',"Description":"About ' || name || '.","ShortDescription":"About ' || name || '.","ReleaseDate":null,"KeyWords":null,"Title":"' || name
  || '","IsActive":true,"IsVisible":true,"ShowWithoutStock":true,"Score":null,"Id":' || cast(id as varchar) || '}'"""
_SKU_BODY = """'{"Id":' || cast(id as varchar) || ',"ProductId":' || cast(product_id as varchar) || ',"Name":"' || name
  || '","EAN":"EAN' || cast(product_id as varchar) || '","IsActive":false,' || case when ref_id is null then '' else '"RefId":"' || ref_id || '",' end
  || '"PackagedHeight":1,"PackagedWidth":1,"PackagedLength":1,"PackagedWeightKg":1,"Height":1,"Width":1,"Length":1,"WeightKg":1}'"""


@query("outbox_bodies", f"""with {_BASE}
select 'department' as entity, id as key, {_CATEGORY_BODY.format(father="'null'")} as payload from tree2 where level = 1 and created
union all select 'category', id, {_CATEGORY_BODY.format(father="cast(parent_id as varchar)")} from tree2 where level > 1 and created
union all select 'brand', id, '{{"Name":"' || name || '","Active":true,"Text":null,"Keywords":null,"SiteTitle":"' || name || '"}}' from bdim where created
union all select 'product', id, {_PRODUCT_BODY} from prod
union all select 'sku', id, {_SKU_BODY} from skids""", _V)
def q_outbox_bodies(spark, sf):
    """A10: the text of every tree, brand, product and SKU request."""
    c = _cat(spark, sf)
    out = S.export_payloads({"tree": c.tree, "brands": c.brands, "products": c.products, "skus": c.skus})
    return out.select("entity", "key", "payload")


@query("sku_stock", f"""with {_BASE}
select s.id as sku_id, w.id as warehouse_id, cast(case when s.id % 9 = 0 then 0 else s.id % 50 end as integer) as quantity, false as unlimited
from skids s, v_warehouses w where length(w.id) = 3""", _V)
def q_sku_stock(spark, sf):
    """J7 with a quantity per SKU (every 9th has none: 0), in the warehouses with short ids."""
    c = _cat(spark, sf)
    stocked = c.skus.withColumn("stock", F.when(F.col("id") % 9 != 0, F.col("id") % 50))
    return sku_inventory(stocked, c.inputs.warehouses.filter(F.length("id") == 3), quantity_col="stock")
