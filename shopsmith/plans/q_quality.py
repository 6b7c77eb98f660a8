"""Validation, attempt logs, model hooks, specifications and reports
(B14, B15, W4, W5, C7, U1, U2, J10, E11, G2, G5, G6, G8)."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..operators import model as M
from ..operators import quality as Q
from ..operators import report as R
from ..operators import specs as SP
from ..operators import html as H
from ..operators.products import flatten_products
from ..operators.urlsets import classify_url
from ..session import staged
from .catalog import Catalog
from .q_catalog import _BRANDS, _CAT_VIEWS, _PATHS, _PRODUCTS, _SKUS
from ..sources.stages import answer_references, export_payloads, spec_requests
from .q_html import _DUCK_KEPT
from .q_images import _PLAN
from .q_urls import _DUCK_URLS as _DUCK_URLS_CLASSIFIED
from .registry import query

_V = _CAT_VIEWS + ("v_products", "v_existing_brands", "v_skus", "v_images", "v_outcomes", "v_warehouses",
                   "v_existing_products", "v_specs")
_BASE = f"{_PATHS}, {_BRANDS}, {_PRODUCTS}, {_SKUS}"


def _cat(spark, sf):
    return Catalog.of(spark, sf)


@query("valid_records", """
select url, case when product_key % 97 = 0 then 'missing ''product'' field' end as reason from v_products""",
       ("v_products",))
def q_valid_records(spark, sf):
    """B14 on records where every 97th lost its product part."""
    r = _cat(spark, sf).records
    r = r.withColumn("product", F.when(F.col("product_key") % 97 == 0, F.lit(None)).otherwise(F.col("product")))
    ok, bad = Q.valid_records(r)
    return ok.select("url", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("url", "reason"))


@query("valid_pages", """
select url, case when product_key % 97 = 0 then 'missing ''product'' field' when product_key % 89 = 0 then 'missing product name' end as reason
from v_products""", ("v_products",))
def q_valid_pages(spark, sf):
    """B14 on extracted records: pages without a body and pages without any name are rejected."""
    # extracted once for both results
    ok, bad = Q.valid_records(staged(H.extract_products(_cat(spark, sf).inputs.broken_pages, key="page_id"), "page-records"))
    return ok.select("url", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("url", "reason"))


@query("check_required", f"""with {_BASE}
select url, case when category_id is null then 'Missing required field: CategoryId'
  when brand_id is null then 'Missing required field: BrandId' end as error from pb""", _V)
def q_check_required(spark, sf):
    """B15 on product payloads of every record, before rejects are split off."""
    c = _cat(spark, sf)
    from ..operators.tree import product_paths, resolve_brand, resolve_category
    paths = product_paths(c.records)
    cat = resolve_category(paths, c.tree)
    br = resolve_brand(c.records.select("url", F.trim(F.coalesce(F.col("brand.Name"), F.lit("Default")))
                                        .alias("brand_name")), c.brands)
    p = c.records.select("url", F.col("product.Name").alias("Name")).join(cat, "url").join(br, "url")
    payloads = p.select("url", F.to_json(F.struct("Name", F.col("category_id").alias("CategoryId"),
                                                  F.col("brand_id").alias("BrandId"))).alias("payload"))
    return Q.check_required(payloads, "Product").select("url", "error")


_W4_SQL = """
with a as (select run_id, pos, outcome, case when outcome in ('ok', 'other_error') then 1 else 0 end as rst,
             case when outcome = 'rate_limit' then 1 else 0 end as rl from v_attempts),
b as (select *, sum(rst) over (partition by run_id order by pos rows unbounded preceding) as isl from a),
c as (select *, cast(sum(rl) over (partition by run_id, isl order by pos rows unbounded preceding) as bigint) as consecutive_limits from b),
s as (select run_id, min(pos) as stop from c where consecutive_limits >= 3 group by run_id)
select c.run_id, c.pos, c.outcome, c.consecutive_limits,
  case when s.stop is not null and c.pos > s.stop then 'not_attempted' else c.outcome end as status,
  c.pos = s.stop as stopped_here
from c left join s using (run_id)"""


@query("attempt_cutoff", _W4_SQL, ("v_attempts",))
def q_attempt_cutoff(spark, sf):
    return Q.attempt_cutoff(_cat(spark, sf).inputs.attempts)


@query("attempt_cutoff_chunked", _W4_SQL, ("v_attempts",))
def q_attempt_cutoff_chunked(spark, sf):
    """W4 with tiny chunks so the carried counts across chunks are exercised."""
    return Q.attempt_cutoff(_cat(spark, sf).inputs.attempts, chunk_size=7)


@query("retry_schedule", """
select run_id, pos, r as retry, case when r < 5 then least(2.0 * pow(2.0, r), 120.0) end as wait_sec, r >= 5 as gives_up
from (select run_id, pos, row_number() over (partition by run_id order by pos) - 1 as r from v_attempts
      where outcome = 'rate_limit') t""", ("v_attempts",))
def q_retry_schedule(spark, sf):
    a = _cat(spark, sf).inputs.attempts.filter(F.col("outcome") == "rate_limit")
    return Q.retry_schedule(a, "run_id", "pos").select("run_id", "pos", "retry", "wait_sec", "gives_up")


@query("parse_model_json", """
select p.url, p.name, cast(coalesce(s.n, 0) as integer) as n_skus,
  cast(coalesce(i.n, 0) as integer) as n_images, case when p.product_key % 50 = 0 then 'invalid JSON' end as reason
from v_products p left join (select product_key, count(*) as n from v_skus group by 1) s using (product_key)
left join (select product_key, count(*) as n from v_images group by 1) i using (product_key)""",
       ("v_products", "v_skus", "v_images"))
def q_parse_model_json(spark, sf):
    c = _cat(spark, sf)
    good, bad = M.parse_model_json(c.inputs.responses, "url")
    g = good.select("url", F.col("product.Name").alias("name"), F.size("skus").alias("n_skus"),
                    F.size("images").alias("n_images"), F.lit(None).cast("string").alias("reason"))
    recs = c.records.select("url", F.col("product.Name").alias("name"), F.size("skus").alias("n_skus"),
                            F.size("images").alias("n_images"))
    b = bad.select("url", "reason").join(recs, "url")
    return g.unionByName(b.select("url", "name", "n_skus", "n_images", "reason"))


def demo_extractor(html: str, url: str, instructions: str | None) -> str:
    """A deterministic stand-in for a model: reads the page with regular expressions."""
    def grab(p):
        m = re.search(p, html or "")
        return m.group(1) if m else None
    price = grab(r'itemprop="price">[^0-9]*([0-9.]+)<')
    crumbs = re.findall(r'<a href="/[^"]+">([^<]+)</a>', html or "")
    body = {"product": {"Name": grab(r"<h1[^>]*>([^<]*)</h1>"), "ProductId": grab(r'data-product-id="([^"]+)"')},
            "brand": {"Name": grab(r'data-brand="([^"]+)"')},
            "categories": [{"Name": c, "Level": i + 1} for i, c in enumerate(crumbs)],
            "skus": [{"Price": float(price) if price else None}], "images": [], "specifications": []}
    return "```json\n" + json.dumps(body) + "\n```"


@query("model_json_faults", """
select url, cast(50 + 10 * (product_key % 7) as integer) as fault_at, true as shows_place
from v_products where product_key % 5 = 0""", ("v_products",))
def q_model_json_faults(spark, sf):
    """C7 on answers with a fault at a known place: a sign that must not be there after a
    value of known length; the context has the text on both sides of it."""
    p = _cat(spark, sf).inputs.products.filter(F.col("product_key") % 5 == 0)
    # 50 characters and a name of known length stand before the sign
    text = F.concat(F.lit('{"product": {"Name": "'), F.expr("repeat('x', cast(10 * (product_key % 7) as int))"),
                    F.lit('", "ProductId": "1234567890"@ , "Title": "'), F.expr("repeat('t', 300)"), F.lit('"}, "skus": []}'))
    _, bad = M.parse_model_json(p.select("url", text.alias("text")), "url")
    shows = F.col("context").contains('1234567890"@ , "Title": "tttt') & (F.length("context") <= 400)
    return bad.select("url", "fault_at", shows.alias("shows_place"))


@query("with_extractor", """
select url, name, brand, price, l1 || '|' || l2 as categories from v_products""", ("v_products",))
def q_with_extractor(spark, sf):
    """U1 with a deterministic extractor function, then C7."""
    c = _cat(spark, sf)
    texts = M.with_extractor(c.inputs.product_pages, demo_extractor, key="page_id")
    good, _ = M.parse_model_json(texts, "url")
    return good.select("url", F.col("product.Name").alias("name"), F.col("brand.Name").alias("brand"),
                       F.col("skus")[0]["Price"].alias("price"),
                       F.array_join(F.transform("categories", lambda x: x["Name"]), "|").alias("categories"))


def demo_reviewer(urls):
    """A deterministic stand-in for a URL-review model; fails on batches holding a '/fr/' URL
    whose number ends in 7, so the retry/skip path runs."""
    if any(re.search(r"/fr/\d*7(?:$|[?#])", u) for u in urls):
        raise RuntimeError("model quota exceeded")
    out = {"definitely_pdp": [], "possibly_pdp": [], "not_pdp": []}
    for u in urls:
        path = re.sub(r"^[a-zA-Z]+://[^/?#]*", "", u.split("#")[0].split("?")[0])
        out["definitely_pdp" if re.search(r"\d{5,}", path) else
            "possibly_pdp" if re.search(r"\d{3,}", path) else "not_pdp"].append(u)
    return out


@query("with_url_reviewer", r"""
with u as (select url from pages union select url from v_products),
b as (select url, (row_number() over (order by url) - 1) // 100 as batch_id from u),
bad as (select distinct batch_id from b where regexp_matches(url, '/fr/\d*7($|[?#])')),
p as (select url, batch_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[a-zA-Z]+://[^/?#]*', '')
        as path from b)
select url, case when batch_id in (select batch_id from bad) then 'rejected'
  when regexp_matches(path, '\d{5,}') then 'definitely_pdp' when regexp_matches(path, '\d{3,}') then 'possibly_pdp'
  else 'not_pdp' end as class from p""", ("v_products",))
def q_with_url_reviewer(spark, sf):
    """URL batches of 100 through a reviewer function; failed batches become rejects."""
    c = _cat(spark, sf)
    from ..sources.tables import table
    urls = table(spark, sf, "pages").select("url").unionByName(c.inputs.products.select("url"))
    ok, bad = M.with_url_reviewer(urls, demo_reviewer, 100, retries=3)
    return ok.select("url", "class").unionByName(bad.select("url", F.lit("rejected").alias("class")))


_SPEC_FIELDS = """
sf as (select id as category_id, 'Size' as name, 1000000 + id as field_id, 'Number' as field_type from tree2 where level = 1
       union all select id, 'Line', 2000000 + id, 'Combo' from tree2 where level = 2 and id % 2 = 0),
anc as (select t.id as category_id, a.id as anc_id, t.level - a.level as distance from tree2 t join tree2 a
        on t.path = a.path or starts_with(t.path, a.path || ' > ') where t.level - a.level <= 5),
best as (select anc.category_id, sf.name, min_by(sf.field_id, anc.distance * 100000000 + sf.field_id) as field_id
         from anc join sf on sf.category_id = anc.anc_id group by 1, 2),
sv as (select p.id as product_id, p.category_id, upper(left(trim(s.name), 1)) || lower(substr(trim(s.name), 2)) as name,
         trim(s.value) as value from prod p join v_specs s on s.product_key = p.id where trim(s.value) <> '')"""


def _spec_fields(tree):
    lv1 = tree.filter(F.col("level") == 1).select(F.col("id").alias("category_id"), F.lit("Size").alias("name"),
                                                  (F.lit(1000000) + F.col("id")).alias("id"),
                                                  F.lit("Number").alias("field_type"))
    lv2 = tree.filter((F.col("level") == 2) & (F.col("id") % 2 == 0)).select(
        F.col("id").alias("category_id"), F.lit("Line").alias("name"), (F.lit(2000000) + F.col("id")).alias("id"),
        F.lit("Combo").alias("field_type"))
    return lv1.unionByName(lv2)


def _resolved(spark, sf):
    c = _cat(spark, sf)
    specs = flatten_products(c.records)["specs"]
    return SP.resolve_spec_fields(specs, c.products, _spec_fields(c.tree), c.tree)


@query("resolve_spec_fields", f"""with {_BASE}, {_SPEC_FIELDS}
select sv.product_id, sv.name, sv.value, b.field_id from sv left join best b using (category_id, name)""", _V)
def q_resolve_spec_fields(spark, sf):
    return _resolved(spark, sf).select("product_id", "name", "value", "field_id")


_RESOLVED_SPECS = f"""{_SPEC_FIELDS},
r as (select sv.*, b.field_id from sv left join best b using (category_id, name)),
mx as (select max(field_id) as m from sf),
nf as (select category_id, name, (select m from mx) + row_number() over (order by category_id, name) as new_id
       from (select distinct category_id, name from r where field_id is null) t)"""
_VALUE_BODY = """'{{"FieldId":' || {field} || ',"FieldValueId":null,"Text":"' || r.value || '"}}'"""
_WAITS = "'\"@spec_field:' || cast(new_id as varchar) || '\"'"


@query("spec_requests", f"""with {_BASE}, {_RESOLVED_SPECS}
select 'spec_field' as entity, 2500 as load_order, new_id as key, '{{"Name":"' || name || '","CategoryId":' || cast(category_id as varchar)
  || ',"FieldTypeId":' || case when name = 'Size' then '4' else '1' end || ',"IsRequired":false,"IsStockKeepingUnit":false,"IsFilter":true,"IsOnProductDetails":true}}' as payload,
  cast(null as bigint) as needs from nf
union all select 'spec_value', 3500, r.product_id, {_VALUE_BODY.format(field="cast(coalesce(r.field_id, new_id * 10) as varchar)")}, null
from r left join nf using (category_id, name) where r.field_id is not null or new_id % 3 <> 0
union all select 'spec_value', 3500, r.product_id, {_VALUE_BODY.format(field=_WAITS)}, new_id
from r join nf using (category_id, name) where r.field_id is null and new_id % 3 = 0""", _V)
def q_spec_requests(spark, sf):
    """E11 in the outbox, both phases: new fields are requested, the platform answers two of
    three with an id of its own, and the values that waited for those get it."""
    c = _cat(spark, sf)
    res = _resolved(spark, sf)
    top = _spec_fields(c.tree).agg(F.max("id").alias("m")).first()["m"]
    vals, new = SP.spec_values(res, {"Size": "Number"}, top)
    asked = spec_requests(vals, new)
    answers = new.filter(F.col("field_id") % 3 != 0).select(F.col("field_id").alias("key"), (F.col("field_id") * 10).alias("id"))
    return answer_references(asked, answers).select("entity", "load_order", "key", "payload", "needs")


@query("spec_values", f"""with {_BASE}, {_SPEC_FIELDS},
r as (select sv.*, b.field_id from sv left join best b using (category_id, name)),
mx as (select max(field_id) as m from sf),
nf as (select category_id, name, (select m from mx) + row_number() over (order by category_id, name) as new_id
       from (select distinct category_id, name from r where field_id is null) t)
select r.product_id, r.name, r.value, coalesce(r.field_id, nf.new_id) as field_id, r.field_id is null as field_created
from r left join nf using (category_id, name)""", _V)
def q_spec_values(spark, sf):
    c = _cat(spark, sf)
    res = _resolved(spark, sf)
    top = _spec_fields(c.tree).agg(F.max("id").alias("m")).first()["m"]
    vals, _ = SP.spec_values(res, {"Size": "Number"}, top)
    return vals.select("product_id", "name", "value", "field_id", "field_created")


@query("catalog_summary", f"""with {_BASE}
select (select count(*) from prod) as total_products,
  (select count(*) from prod where id not in (select id from v_existing_products)) as products_created,
  (select count(*) from skids) as total_skus, (select count(*) from sk where sku_id is null) as skus_assigned_ids""", _V)
def q_catalog_summary(spark, sf):
    c = _cat(spark, sf)
    return R.catalog_summary(c.products, c.skus, c.inputs.existing_products)


@query("execution_summary", f"""with {_BASE}, {_PLAN}
select (select count(*) from tree2 where level = 1) as departments, (select count(*) from tree2 where level > 1) as categories,
  (select count(*) from bdim) as brands, (select count(*) from prod) as products, (select count(*) from st) as skus,
  (select count(*) from st where total_associated > 0) as skus_active,
  (select cast(sum(total_associated) as bigint) from st) as images_associated,
  (select cast(sum(total_failed) as bigint) from st) as images_failed,
  (select count(*) from skids) as prices, (select count(*) from skids, v_warehouses) as inventory_rows""", _V)
def q_execution_summary(spark, sf):
    c = _cat(spark, sf)
    return R.execution_summary(c.tree, c.brands, c.products, c.skus, c.sku_image_status, c.prices, c.inventory)


@query("catalog_structure", f"""with {_PATHS}, {_BRANDS}
select (select count(distinct path[1]) from paths) as departments,
  (select count(*) from (select distinct path[1], unnest(list_slice(path, 2, len(path))) from paths) t) as category_pairs,
  (select count(distinct trim(brand)) from v_products) as brands, (select count(*) from v_products) as total_products,
  (select bool_or(n > 1) from (select product_key, count(*) as n from v_skus group by 1) t) as has_variations,
  (select count(distinct upper(left(trim(name), 1)) || lower(substr(trim(name), 2))) from v_specs) as spec_names,
  'product.Name,product.ProductId,product.Description,brand.Name,categories,specifications' as common_fields""",
       _CAT_VIEWS + ("v_products", "v_existing_brands", "v_skus", "v_specs"))
def q_catalog_structure(spark, sf):
    return R.catalog_structure(_cat(spark, sf).records)


@query("structure_lists", f"""with {_PATHS}, {_BRANDS}
select distinct 'department' as kind, cast(null as varchar) as parent, path[1] as name from paths
union all select distinct 'category', path[1], unnest(list_slice(path, 2, len(path))) from paths
union all select distinct 'brand', null, trim(brand) from v_products where trim(brand) <> ''
union all select distinct 'spec', null, upper(left(trim(name), 1)) || lower(substr(trim(name), 2)) from v_specs where trim(name) <> ''""",
       _CAT_VIEWS + ("v_products", "v_existing_brands", "v_specs"))
def q_structure_lists(spark, sf):
    """G6 content: the distinct departments, categories, brands and spec names."""
    return R.structure_lists(_cat(spark, sf).records)


@query("extraction_metrics", """
select (select count(*) from v_products) as total_products, (select count(distinct url) from pages) as total_urls_found""",
       ("v_products",))
def q_extraction_metrics(spark, sf):
    c = _cat(spark, sf)
    from ..sources.tables import table
    return R.extraction_metrics(c.records, table(spark, sf, "pages").select("url"))


@query("extraction_metrics_cleaning")
def q_extraction_metrics_cleaning(spark, sf):
    """G8 with the C1 size reduction over the captured pages (10,000-character threshold)."""
    from ..sources.tables import table
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    sizes = H.cleaning_sizes(pages, 10000, "page_id")
    return R.extraction_metrics(_cat(spark, sf).records, pages.select("url"), sizes)


@query("extraction_metrics_reduction", f"""
with k as (select length({_DUCK_KEPT}) as n from v_products),
s as (select count(*) as pages, sum(n) as kept, sum(n + length('<!DOCTYPE html><style>p{{}}</style><script>var t="</p>";</script><!-- x --><form action="/cart/add"></form>')) as raw from k)
select pages as total_products, pages as total_urls_found, pages as pages_cleaned, cast(raw as bigint) as chars_before,
  cast(kept as bigint) as chars_after, round(100 * (1 - cast(kept as double) / raw), 1) as reduction_percent from s""", ("v_products",))
def q_extraction_metrics_reduction(spark, sf):
    """G8 with the size reduction in percent, every shop page cleaned."""
    c = _cat(spark, sf)
    pages = c.inputs.product_pages.select("page_id", "url", "html")
    return R.extraction_metrics(c.records, pages.select("url"), H.cleaning_sizes(pages, 0, "page_id"))


@query("outbox_problems", f"""with {_BASE}
select 'product' as entity, id as key, 'Missing required field: Name' as error from prod where id % 10 = 0
union all select 'sku', id, 'Missing required field: EAN' from skids where id % 7 = 0""", _V)
def q_outbox_problems(spark, sf):
    """B15 over the outbox: every 10th product lost its name, every 7th SKU its EAN."""
    c = _cat(spark, sf)
    products = c.products.withColumn("name", F.when(F.col("id") % 10 != 0, F.col("name")))
    skus = c.skus.withColumn("ean", F.when(F.col("id") % 7 != 0, F.col("ean")))
    return Q.outbox_problems(export_payloads({"tree": c.tree, "brands": c.brands, "products": products, "skus": skus}))


@query("outbox_types", f"""with {_BASE}
select 'product' as entity, id as key, 'Field ''CategoryId'' must be of type integer' as error from prod where id % 10 = 0
union all select 'sku', id, 'Field ''Name'' must be of type string' from skids where id % 7 = 0
union all select 'sku', id, 'Field ''IsActive'' must be of type boolean' from skids where id % 7 <> 0 and id % 11 = 0""", _V)
def q_outbox_types(spark, sf):
    """B15 with types over the outbox: category numbers as text, names as numbers, flags as text."""
    c = _cat(spark, sf)
    out = export_payloads({"tree": c.tree, "brands": c.brands, "products": c.products, "skus": c.skus})
    product, sku, k = F.col("entity") == "product", F.col("entity") == "sku", F.col("key")
    wrong = (F.when(product & (k % 10 == 0), F.regexp_replace("payload", r'"CategoryId":(\d+)', '"CategoryId":"$1"'))
             .when(sku & (k % 7 == 0), F.regexp_replace("payload", r'"Name":"[^"]*"', '"Name":5'))
             .when(sku & (k % 11 == 0), F.regexp_replace("payload", r'"IsActive":false', '"IsActive":"no"')))
    return Q.outbox_problems(out.withColumn("payload", F.coalesce(wrong, "payload")))


@query("classify_pages_by_signals", rf"""
with {_DUCK_URLS_CLASSIFIED},
sig as (select url, true as is_product_page from v_products
        union all select url, regexp_matches(html, '<script[^>]*type="application/ld\+json"|property="og:type"[^>]*content="[^"]*(?i:product)|<span[^>]*itemprop="price"|itemtype="[^"]*Product|<form[^>]*action="[^"]*(cart|add)|<button[^>]*class="[^"]*(buy|add-to-cart)')
        from pages)
select s.url, c.class, s.is_product_page from sig s join classified c using (url)""", ("v_products",))
def q_classify_pages_by_signals(spark, sf):
    """B7 + B8 together on every page: URL class next to the page-content verdict."""
    c = _cat(spark, sf)
    p = c.parsed_product_pages.select("url", *H.page_signals()).unionByName(
        c.parsed_pages.select("url", *H.page_signals()))
    return p.select("url", classify_url("url").alias("class"), "is_product_page")


@query("clean_model_json", """
select url, product_key % 50 <> 0 as parses, product_key % 50 <> 0 and product_key % 4 = 1 as was_fenced,
  product_key % 50 <> 0 and product_key % 4 = 3 as had_trailing_comma from v_products""", ("v_products",))
def q_clean_model_json(spark, sf):
    """F18 on raw model answers: unfenced, cut to the object, trailing commas dropped;
    the cleaned text parses for every answer that was not cut off."""
    r = _cat(spark, sf).inputs.responses
    cleaned = r.select("url", "text", M.cleaned_json("text").alias("json"))
    parses = F.get_json_object("json", "$.product.Name").isNotNull()
    return cleaned.select(
        "url", parses.alias("parses"),
        (parses & F.col("text").startswith("```")).alias("was_fenced"),
        (parses & F.col("text").rlike(r",\s*[}\]]")).alias("had_trailing_comma"))
