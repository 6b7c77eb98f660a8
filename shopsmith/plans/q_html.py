"""Page-extraction queries (C1-C8, B3, B5, B7, B10) on shop pages rendered from
``part`` and on the captured ``pages``; the oracle reads the source columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import html as H
from ..operators.crawl import crawl_reach
from .catalog import Catalog
from .registry import query


def _cat(spark, sf):
    return Catalog.of(spark, sf)


def _records(spark, sf):
    c = _cat(spark, sf)
    return c.parsed_product_pages.select("page_id", "url", H.extracted_record().alias("r")).select(
        "page_id", "url", "r.*")


@query("extract_products", """
select product_key as page_id, name, cast(product_key as varchar) as product_id, brand, price,
  2 as n_categories, l1 || '|' || l2 as categories, 2 as n_images, 2 as n_specs,
  name || ' | Shop' as title, 'About ' || name || '.' as description, 1 as n_skus
from v_products""", ("v_products",))
def q_extract_products(spark, sf):
    r = _records(spark, sf)
    return r.select(
        "page_id", F.col("product.Name").alias("name"), F.col("product.ProductId").alias("product_id"),
        F.col("brand.Name").alias("brand"), F.col("skus")[0]["Price"].alias("price"),
        F.size("categories").alias("n_categories"),
        F.array_join(F.transform("categories", lambda c: c["Name"]), "|").alias("categories"),
        F.size("images").alias("n_images"), F.size("specifications").alias("n_specs"),
        F.col("product.Title").alias("title"), F.col("product.Description").alias("description"),
        F.size("skus").alias("n_skus"))


@query("extract_variants", """
select product_key as page_id, v.pos, cast(product_key as varchar) || v.suffix as sku_id, v.name as sku_name,
  cast(cast(price + v.add as decimal(12,2)) as double) as price, cast(cast(price + 3 as decimal(12,2)) as double) as list_price,
  case when product_key % 2 = 0 then l1 || '|' || l2 else l3 end as categories
from v_products, (values (0, '01', 'Small', 1), (1, '02', 'Large', 0)) as v(pos, suffix, name, add)""", ("v_products",))
def q_extract_variants(spark, sf):
    """Pages with variants, a list price, and categories in menus or detail links."""
    parsed = H.parse_pages(_cat(spark, sf).inputs.variant_pages, "page_id")
    r = parsed.select("page_id", H.extracted_record().alias("r"))
    r = r.select("page_id", F.posexplode("r.skus").alias("pos", "s"),
                 F.array_join(F.transform("r.categories", lambda c: c["Name"]), "|").alias("categories"))
    return r.select("page_id", "pos", F.col("s.SkuId").alias("sku_id"), F.col("s.Name").alias("sku_name"),
                    F.col("s.Price").alias("price"), F.col("s.ListPrice").alias("list_price"), "categories")


@query("extract_images", """
select product_key as page_id, 1 as pos, 'https://img.example.com/product/' || cast(product_key as varchar) || '/full/1.jpg' as image_url
from v_products
union all select product_key, 2, 'https://img.example.com/product/' || cast(product_key as varchar) || '/thumb_200x200/1.jpg'
from v_products""", ("v_products",))
def q_extract_images(spark, sf):
    p = _cat(spark, sf).parsed_product_pages
    return p.select("page_id", F.posexplode(H.extracted_images()).alias("pos", "image_url")).withColumn(
        "pos", F.col("pos") + 1)


@query("extract_specs", """
select product_key as page_id, 0 as pos, 'Size' as name, cast(size_no as varchar) as value from v_products
union all select product_key, 1, 'Line', l1 from v_products""", ("v_products",))
def q_extract_specs(spark, sf):
    return H.extract_specs(_cat(spark, sf).parsed_product_pages, "page_id")


@query("extract_categories", """
select product_key as page_id, l1 || '|' || l2 as categories from v_products""", ("v_products",))
def q_extract_categories(spark, sf):
    p = _cat(spark, sf).parsed_product_pages
    c = H.extracted_categories()
    return p.select("page_id", F.array_join(F.transform(c, lambda x: x["Name"]), "|").alias("categories"))


@query("extract_categories_from_path", r"""
with segs as (
  select page_id, list_filter(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1),
         '^/+|/+$', '', 'g'), '/'), lambda s: s <> '' and s not in ('p','product','produto','item')) as s from pages),
flags as (select page_id, s, list_transform(s, lambda x: length(x) > 20 or regexp_matches(x, '-\d{5,}$')) as f from segs),
kept as (select page_id, case when list_position(f, true) is not null then list_slice(s, 1, list_position(f, true) - 1)
                         else s end as k from flags)
select page_id, cast(len(k) as integer) as n_levels from kept""")
def q_extract_categories_from_path(spark, sf):
    """C4 on captured pages without breadcrumbs or meta: the URL path is the last resort."""
    p = _cat(spark, sf).parsed_pages
    return p.select("page_id", F.size(H.extracted_categories()).alias("n_levels"))


@query("product_page_signals", r"""
select 'product' as kind, count(*) as pages, 0 as has_jsonld, count(*) as og_product, count(*) as itemprop_price,
  0 as itemtype_product, count(*) as cart_form, 0 as buy_button, count(*) as product_pages from v_products
union all
select 'captured', count(*),
  count(*) filter (where regexp_matches(html, '<script[^>]*type="application/ld\+json"')),
  count(*) filter (where regexp_matches(html, '<meta[^>]*property="og:type"[^>]*content="[^"]*(?i:product)')),
  count(*) filter (where regexp_matches(html, '<span[^>]*itemprop="price"')),
  count(*) filter (where regexp_matches(html, 'itemtype="[^"]*Product')),
  count(*) filter (where regexp_matches(html, '<form[^>]*action="[^"]*(cart|add)')),
  count(*) filter (where regexp_matches(html, '<button[^>]*class="[^"]*(buy|add-to-cart)')),
  count(*) filter (where regexp_matches(html, '<script[^>]*type="application/ld\+json"|property="og:type"[^>]*content="[^"]*(?i:product)|<span[^>]*itemprop="price"|itemtype="[^"]*Product|<form[^>]*action="[^"]*(cart|add)|<button[^>]*class="[^"]*(buy|add-to-cart)'))
from pages""", ("v_products",))
def q_product_page_signals(spark, sf):
    c = _cat(spark, sf)

    def summary(df, kind):
        s = df.select(*H.page_signals())
        return s.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("pages"),
                     *[F.count_if(col).alias(col) for col in
                       ("has_jsonld", "og_product", "itemprop_price", "itemtype_product", "cart_form", "buy_button")],
                     F.count_if("is_product_page").alias("product_pages"))
    return summary(c.parsed_product_pages, "product").unionByName(summary(c.parsed_pages, "captured"))


_DUCK_PAGE_LINKS = """
with a as (select page_id, url, unnest(generate_series(0, len(h) - 1)) as pos, unnest(h) as href
           from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as h from pages) x),
r as (select page_id, pos, url, case when starts_with(href, '//') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) || ':' || href
       when starts_with(href, '/') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
       when starts_with(href, 'http') then href end as t from a)
select page_id, cast(pos as integer) as pos, split_part(split_part(t, '#', 1), '?', 1) as dst from r
where t is not null and regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"""


@query("page_links", _DUCK_PAGE_LINKS)
def q_page_links(spark, sf):
    return H.page_links(_cat(spark, sf).parsed_pages, "page_id")


@query("crawl_page_links", f"""
with seeds as (select distinct split_part(split_part(url, '#', 1), '?', 1) as node from pages),
found as (select distinct dst as node from ({_DUCK_PAGE_LINKS}) l)
select node, 0 as hop from seeds union all select node, 1 from found where node not in (select node from seeds)""")
def q_crawl_page_links(spark, sf):
    """B3 into E12: the captured pages and everything their own links reach."""
    parsed = _cat(spark, sf).parsed_pages.select("page_id", "url", "doc")
    pages = parsed.select("page_id", U.clean_url("url").alias("node"))
    links = H.page_links(parsed, "page_id").join(pages.withColumnRenamed("node", "src"), "page_id").select("src", "dst", "pos")
    return crawl_reach(links, pages.select("node", F.col("page_id").alias("ord"))).select("node", "hop")


_LINK_PATTERN = r"https?://[^/]+/[a-z]{2,3}"


@query("product_links", f"""
with a as (select page_id, url, unnest(generate_series(0, len(h) - 1)) as pos, unnest(h) as href
           from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as h from pages) x),
r as (select page_id, pos, url, case when starts_with(href, '/') and not starts_with(href, '//') then
        regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href end as t from a),
c as (select page_id, pos, split_part(split_part(t, '#', 1), '?', 1) as dst from r where t is not null)
select page_id, dst, cast(min(pos) as integer) as pos from c where regexp_matches(dst, '^(?:{_LINK_PATTERN})$') group by page_id, dst""")
def q_product_links(spark, sf):
    """B5 with a user pattern (two- or three-letter top-level paths), anchored at the start."""
    return H.product_links(_cat(spark, sf).parsed_pages, "page_id", _LINK_PATTERN + "$")


@query("html_preview", "select page_id, left(html, 1000) as preview from pages")
def q_html_preview(spark, sf):
    from ..sources.tables import table
    return table(spark, sf, "pages").select("page_id", H.html_preview("html").alias("preview"))


@query("needs_cleaning", "select page_id, length(html) > 10000 as needs_cleaning from pages")
def q_needs_cleaning(spark, sf):
    from ..sources.tables import table
    p = table(spark, sf, "pages")
    return p.select("page_id", H.needs_cleaning(p, 10000).alias("needs_cleaning"))


_DUCK_KEPT = """
'<html><head><title>' || name || ' | Shop</title><meta property="og:type" content="product"><meta name="description" content="About '
 || name || '."></head><body><nav class="breadcrumb"><a href="/">Home</a><a href="/' || lower(l1) || '">' || l1 || '</a><a href="/'
 || lower(l1) || '/' || l2 || '">' || l2 || '</a></nav><h1 itemprop="name">' || name || '</h1><div data-product-id="'
 || cast(product_key as varchar) || '" data-brand="' || brand || '"><span itemprop="price">$ '
 || cast(cast(price as decimal(12,2)) as varchar) || '</span></div><div class="product-gallery"><img src="//img.example.com/product/'
 || cast(product_key as varchar) || '/thumb_200x200/1.jpg"><img src="/static/logo.png"></div><table class="specifications"><tr><th>Size</th><td>'
 || cast(size_no as varchar) || '</td></tr><tr><th>Line</th><td>' || l1 || '</td></tr></table></body></html>'"""


@query("clean_html", f"select product_key as page_id, true as cleaned, {_DUCK_KEPT} as html from v_products", ("v_products",))
def q_clean_html(spark, sf):
    """C1 on every shop page: style, script, comment and the empty form go, the rest stays."""
    pages = _cat(spark, sf).inputs.product_pages.select("page_id", "url", "html")
    return H.clean_html(pages, 0, "page_id").select("page_id", "cleaned", "html")


@query("apply_field_rules", """
select product_key as page_id, name || ' | Shop' as name, cast(size_no as double) as price, brand from v_products""",
       ("v_products",))
def q_apply_field_rules(spark, sf):
    """Site rules beat the defaults (title text as name, first spec cell as price)."""
    c = _cat(spark, sf)
    rules = spark.createDataFrame(
        [("shop.example.com", "Name", "title", ""),
         ("shop.example.com", "Price", "table.specifications tr > td", ""),
         ("other.example.com", "Brand", "h1", "")],
        "site string, field string, selector string, attribute string")
    parsed = H.parse_pages(c.inputs.product_pages, "page_id", rules)
    r = parsed.select("page_id", H.extracted_record().alias("r"))
    return r.select("page_id", F.col("r.product.Name").alias("name"), F.col("r.skus")[0]["Price"].alias("price"),
                    F.col("r.brand.Name").alias("brand"))


_GRAPH_SQL = """
select url, case when {on} then name end as name, case when {on} then 'https://img.example.com/product/' || cast(product_key as varchar) || '/ld.jpg' end as image
from v_products"""


def _graph_record(spark, sf, graph):
    r = H.extract_products(_cat(spark, sf).inputs.graph_pages, key="page_id", graph=graph)
    return r.select("url", F.col("product.Name").alias("name"), F.get("images", F.lit(0)).alias("image"))


@query("jsonld_top_level", _GRAPH_SQL.format(on="product_key % 4 = 0"), ("v_products",))
def q_jsonld_top_level(spark, sf):
    """C2, C3 with Q18 as it stands: only a top-level JSON-LD Product counts."""
    return _graph_record(spark, sf, False)


@query("jsonld_graph", _GRAPH_SQL.format(on="true"), ("v_products",))
def q_jsonld_graph(spark, sf):
    """C2, C3 with the flag on: Products in lists, in ``@graph`` and of several types count too."""
    return _graph_record(spark, sf, True)


@query("rule_problems", """
select distinct split_part(split_part(url, '://', 2), '/', 1) as site, field, selector, true as has_problem
from v_products, (values ('Brand', 'div:has(>'), ('Price', null)) t(field, selector)""", ("v_products",))
def q_rule_problems(spark, sf):
    """Of the field rules for the shop pages' sites, those that cannot be applied."""
    sites = _cat(spark, sf).inputs.product_pages.select(U.url_netloc("url").alias("site")).distinct()
    rules = sites.select("site", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(x).cast("string").alias("selector")) for f, x in (
        ("Name", "h1[itemprop='name']"), ("Brand", "div:has(>"), ("Price", None))])).alias("r")).select("site", "r.*")
    return H.rule_problems(rules).select("site", "field", "selector", F.col("problem").isNotNull().alias("has_problem"))
