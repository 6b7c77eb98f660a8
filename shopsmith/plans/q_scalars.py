"""Scalar function queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..sources.tables import table
from .catalog import Catalog
from .registry import duck_title, duck_upper_first, query

_HREF = r'<a href="([^"]*)">([^<]*)</a>'


def _anchors(spark, sf):
    """(page_id, url, pos, href, label) for every anchor in the captured pages."""
    pg = table(spark, sf, "pages")
    a = pg.select("page_id", "url", F.regexp_extract_all("html", F.lit(_HREF), 1).alias("h"),
                  F.regexp_extract_all("html", F.lit(_HREF), 2).alias("t"))
    return a.select("page_id", "url", F.posexplode(F.arrays_zip("h", "t")).alias("pos", "z")).select(
        "page_id", "url", (F.col("pos") + 1).alias("pos"), F.col("z.h").alias("href"), F.col("z.t").alias("label"))


_DUCK_ANCHORS = f"""anchors as (
  select page_id, url, cast(unnest(generate_series(1, len(h))) as integer) as pos, unnest(h) as href, unnest(t) as label
  from (select page_id, url, regexp_extract_all(html, '{_HREF}', 1) as h,
               regexp_extract_all(html, '{_HREF}', 2) as t from pages) x)"""


@query("normalize_category_name", f"""
with {_DUCK_ANCHORS}
select page_id, pos, case when label is null or trim(label) = '' then label else {duck_title('trim(label)')} end as name
from anchors""")
def q_normalize_category_name(spark, sf):
    a = _anchors(spark, sf)
    return a.select("page_id", "pos", X.normalize_category_name("label").alias("name"))


@query("normalize_spec_name", f"""
with {_DUCK_ANCHORS}
select page_id, pos, case when label is null or trim(label) = '' then label
  else {duck_upper_first('trim(label)')} || lower(substr(trim(label), 2)) end as name from anchors
union all select -1 - product_key, seq, {duck_upper_first('trim(name)')} || lower(substr(trim(name), 2)) from v_specs""",
       ("v_specs",))
def q_normalize_spec_name(spark, sf):
    a = _anchors(spark, sf).select("page_id", "pos", X.normalize_spec_name("label").alias("name"))
    s = Catalog.of(spark, sf).inputs.specs.select(
        (-1 - F.col("product_key")).alias("page_id"), F.col("seq").alias("pos"), X.normalize_spec_name("name").alias("name"))
    return a.unionByName(s)


@query("normalize_brand_name", """
select product_key, trim(brand) as brand from v_products""", ("v_products",))
def q_normalize_brand_name(spark, sf):
    p = Catalog.of(spark, sf).inputs.products
    return p.select("product_key", X.normalize_brand_name(F.concat(F.lit("  "), F.col("brand"), F.lit(" "))).alias("brand"))


@query("extract_id", f"""
with {_DUCK_ANCHORS}
select page_id, pos, try_cast(nullif(regexp_extract(href, '(\\d+)', 1), '') as bigint) as id from anchors
union all select page_id, cast(0 as integer), try_cast(nullif(regexp_extract(url, '(\\d+)', 1), '') as bigint) from pages""")
def q_extract_id(spark, sf):
    a = _anchors(spark, sf).select("page_id", "pos", X.extract_id("href").alias("id"))
    p = table(spark, sf, "pages").select("page_id", F.lit(0).alias("pos"), X.extract_id("url").alias("id"))
    return a.unionByName(p)


@query("categories_from_url", f"""
with segs as (
  select page_id, list_filter(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1),
         '^/+|/+$', '', 'g'), '/'), lambda s: s <> '' and s not in ('p','product','produto','item')) as s from pages
  union all
  select product_key + 1000000000, list_filter(string_split(regexp_replace(regexp_extract(url,
         '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/'),
         lambda s: s <> '' and s not in ('p','product','produto','item')) from v_products),
flags as (select page_id, s, list_transform(s, lambda x: length(x) > 20 or regexp_matches(x, '-\\d{{5,}}$')) as f from segs),
kept as (select page_id, case when list_position(f, true) is not null then list_slice(s, 1, list_position(f, true) - 1)
                         else s end as k from flags)
select page_id, cast(len(k) as integer) as n_levels,
  array_to_string(list_transform(k, lambda x: {duck_title("translate(x, '-_', '  ')")}), '|') as names from kept""",
       ("v_products",))
def q_categories_from_url(spark, sf):
    pg = table(spark, sf, "pages").select("page_id", "url")
    pr = Catalog.of(spark, sf).inputs.products.select((F.col("product_key") + 1000000000).alias("page_id"), "url")
    c = pg.unionByName(pr).select("page_id", U.categories_from_url("url").alias("c"))
    return c.select("page_id", F.size("c").alias("n_levels"),
                    F.array_join(F.transform("c", lambda x: x["Name"]), "|").alias("names"))


@query("clean_url", "select page_id, split_part(split_part(url, '#', 1), '?', 1) as url from pages")
def q_clean_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.clean_url("url").alias("url"))


_DUCK_RESOLVE = r"""
resolved as (select page_id, pos, href, url,
  case when starts_with(href, '//') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) || ':' || href
       when starts_with(href, '/') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
       when starts_with(href, 'http') then href end as target from anchors)"""


@query("resolve_href", f"with {_DUCK_ANCHORS}, {_DUCK_RESOLVE} select page_id, pos, target from resolved")
def q_resolve_href(spark, sf):
    a = _anchors(spark, sf)
    return a.select("page_id", "pos", U.resolve_href("href", "url").alias("target"))


@query("same_site", f"""
with {_DUCK_ANCHORS}, {_DUCK_RESOLVE}
select page_id, pos, coalesce(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')
  = coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') as same_site
from resolved where target is not null""")
def q_same_site(spark, sf):
    a = _anchors(spark, sf).withColumn("target", U.resolve_href("href", "url")).filter(F.col("target").isNotNull())
    return a.select("page_id", "pos", U.same_site("target", "url").alias("same_site"))


_PROD_RE = r".*[-/]\d{5,}\.html?$|.*/p/[^/]+$|.*/product/[^/]+$|.*/produto/[^/]+$"


@query("is_product_url", f"""
select product_key as id, regexp_matches(url, '^(?:{_PROD_RE})') as is_product from v_products
union all select -1 - page_id, regexp_matches(url, '^(?:{_PROD_RE})') from pages""", ("v_products",))
def q_is_product_url(spark, sf):
    p = Catalog.of(spark, sf).inputs.products.select(F.col("product_key").alias("id"), "url")
    g = table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("id"), "url")
    return p.unionByName(g).select("id", U.is_product_url("url").alias("is_product"))


@query("is_image_url", """
select product_key, seq, (regexp_matches(lower(image_url), '\\.jpg|\\.jpeg|\\.png|\\.webp|\\.gif|\\.svg|/image|/img|/photo|/picture|/media|/product')
  and not regexp_matches(lower(image_url), 'logo|icon|favicon|banner|ad|advertisement|placeholder')) as is_image
from v_images""", ("v_images",))
def q_is_image_url(spark, sf):
    i = Catalog.of(spark, sf).inputs.images
    return i.select("product_key", "seq", U.is_image_url("image_url").alias("is_image"))


@query("is_rate_limited", """
select doc_id, regexp_matches(lower(text), '429|rate limit|quota|too many requests|resource exhausted|resource_exhausted')
  as rate_limited from documents""")
def q_is_rate_limited(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", U.is_rate_limited("text").alias("rate_limited"))


@query("resolve_image_url", """
select product_key, seq, case when starts_with(u, '//') then 'https:' || u
  when starts_with(u, '/') then 'https://shop.example.com' || u
  else split_part(split_part(u, '#', 1), '?', 1) end as image_url from (
  select product_key, seq, case seq % 3 when 0 then substr(image_url, 7) when 1 then substr(image_url, 24) else image_url end as u
  from v_images) t""", ("v_images",))
def q_resolve_image_url(spark, sf):
    """Image references written three ways (protocol-relative, rooted, absolute)."""
    i = Catalog.of(spark, sf).inputs.images
    u = (F.when(F.col("seq") % 3 == 0, F.substring("image_url", 7, 1 << 30))
         .when(F.col("seq") % 3 == 1, F.substring("image_url", 24, 1 << 30)).otherwise(F.col("image_url")))
    return i.select("product_key", "seq",
                    U.resolve_image_url(u, F.concat(F.lit("https://shop.example.com/"), F.lower(F.lit("x")))).alias("image_url"))


@query("full_size_url", """
select product_key, regexp_replace('//img.example.com/product/' || cast(product_key as varchar) || '/thumb_200x200/1.jpg',
  '(thumb|thumbnail|small|medium)[_\\-/]?\\d+x\\d+', 'full', 'gi') as image_url from v_products""", ("v_products",))
def q_full_size_url(spark, sf):
    p = Catalog.of(spark, sf).inputs.products
    src = F.concat(F.lit("//img.example.com/product/"), F.col("product_key").cast("string"), F.lit("/thumb_200x200/1.jpg"))
    return p.select("product_key", U.full_size_url(src).alias("image_url"))


@query("srcset_urls", """
select product_key, seq, array_to_string(list_transform(list_filter(list_filter(list_transform(string_split(s, ','), lambda p: trim(p)),
   lambda p: p <> ''), lambda p: contains(p, 'x') or contains(lower(p), 'w')), lambda p: string_split_regex(p, '\\s+')[1]), '|') as urls
from (select product_key, seq, image_url || ' 600w, , ' || replace(image_url, '/product/', '/zoom/') || ' 2x, '
      || image_url || '?big' as s from v_images) t""", ("v_images",))
def q_srcset_urls(spark, sf):
    i = Catalog.of(spark, sf).inputs.images
    s = F.concat(F.col("image_url"), F.lit(" 600w, , "), F.regexp_replace("image_url", "/product/", "/zoom/"),
                 F.lit(" 2x, "), F.col("image_url"), F.lit("?big"))
    return i.select("product_key", "seq", F.array_join(U.srcset_urls(s), "|").alias("urls"))


@query("image_extension", """
select product_key, seq, case
  when e in ('.jpg', '.jpeg') then '.jpg' when e in ('.png', '.webp', '.gif', '.svg') then e else '.jpg' end as ext
from (select product_key, seq, lower(regexp_replace(regexp_extract(split_part(split_part(image_url, '?', 1), '#', 1),
   '[^./](\\.[^./]*)$', 1), '-\\d+[wWhH]?[xX]\\d+[wWhH]?', '', 'g')) as e from v_images) t""", ("v_images",))
def q_image_extension(spark, sf):
    i = Catalog.of(spark, sf).inputs.images
    return i.select("product_key", "seq", U.image_extension("image_url").alias("ext"))


@query("parse_price", """
select product_key, price as parsed from v_products""", ("v_products",))
def q_parse_price(spark, sf):
    p = Catalog.of(spark, sf).inputs.products
    txt = F.concat(F.lit("$ "), F.format_number("price", 2))
    return p.select("product_key", X.parse_price(txt).alias("parsed"))


@query("sku_price", """
select sku_id, coalesce(nullif(price, 0), 0) as price, coalesce(nullif(list_price, 0), nullif(price, 0), 0) as list_price
from v_skus""", ("v_skus",))
def q_sku_price(spark, sf):
    s = Catalog.of(spark, sf).inputs.skus
    return s.select("sku_id", X.sku_price("price").alias("price"), X.sku_list_price("list_price", "price").alias("list_price"))


@query("short_description", """
select doc_id, coalesce(nullif(left(text, 200), ''), '') as short_description from documents""")
def q_short_description(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.short_description(F.lit(None).cast("string"), "text").alias("short_description"))


@query("seo_title_keywords", f"""
with lv as (select product_key, max(case when level = 1 then name end) as c1,
              string_agg(name, ', ' order by level) as cats from v_categories group by product_key)
select p.product_key, p.name || ' | ' || coalesce(lv.c1 || ' | ', '') || p.brand as seo_title,
       p.name || ', ' || p.brand || ', ' || lv.cats as keywords
from v_products p join lv using (product_key)""", ("v_products", "v_categories"))
def q_seo_title_keywords(spark, sf):
    r = Catalog.of(spark, sf).records
    c1 = F.filter("categories", lambda c: c["Level"] == 1)
    cats = F.array_join(F.transform("categories", lambda c: c["Name"]), ", ")
    return r.select("product_key",
                    X.seo_title(F.col("product.Title"), F.col("product.Name"), F.try_element_at(c1, F.lit(1))["Name"],
                                F.col("brand.Name")).alias("seo_title"),
                    X.keywords(F.col("product.KeyWords"), F.col("product.Name"), F.col("brand.Name"), cats)
                    .alias("keywords"))


@query("field_type_id", """
select product_key, seq, case t when 'Text' then 1 when 'Number' then 2 when 'Toggle' then 3 when 'Combo' then 4
  when 'Radio' then 5 when 'Color' then 6 when 'Date' then 7 else 1 end as field_type_id
from (select product_key, seq, case name when 'SIZE' then 'Number' when ' line ' then 'Combo' else 'Swatch' end as t
      from v_specs) s""", ("v_specs",))
def q_field_type_id(spark, sf):
    s = Catalog.of(spark, sf).inputs.specs
    t = F.when(F.col("name") == "SIZE", "Number").when(F.col("name") == " line ", "Combo").otherwise("Swatch")
    return s.select("product_key", "seq", X.field_type_id(t).alias("field_type_id"))


@query("field_type_overrides", """
select n_nationkey, n_name as field, upper(left(t, 1)) || lower(substr(t, 2)) as field_type from (
  select n_nationkey, n_name, case n_nationkey % 3 when 0 then 'combo' when 1 then 'NUMBER' else 'Text' end as t
  from nation) x""")
def q_field_type_overrides(spark, sf):
    n = table(spark, sf, "nation")
    t = F.when(F.col("n_nationkey") % 3 == 0, "combo").when(F.col("n_nationkey") % 3 == 1, "NUMBER").otherwise("Text")
    txt = F.concat(F.lit("Field Type Overrides: "), F.col("n_name"), F.lit("="), t)
    m = n.select("n_nationkey", X.field_type_overrides(txt).alias("m"))
    return m.select("n_nationkey", F.explode("m").alias("field", "field_type"))


@query("ensure_scheme", """
select page_id, url from pages""")
def q_ensure_scheme(spark, sf):
    """Entered site addresses with the scheme left off on https pages."""
    p = table(spark, sf, "pages")
    typed = F.when(F.col("url").startswith("https://"), F.substring("url", 9, 1 << 30)).otherwise(F.col("url"))
    return p.select("page_id", U.ensure_scheme(typed).alias("url"))
