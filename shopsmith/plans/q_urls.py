"""URL-side queries: sitemaps, classification, set operations, ordering, crawls
(A2-A6, B8, B9, G7, G9, T1-T3, L1, L2, L4, W1, W2, E2, E12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl as C
from ..operators import ordering as O
from ..operators import urlsets as S
from ..operators.tree import merge_tree
from ..sources import sitemaps as SM
from ..sources.tables import table
from .catalog import Catalog
from .registry import query


def _cat(spark, sf):
    return Catalog.of(spark, sf)


_SITE = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_DUCK_SITES = f"""
pg as (select page_id, url, {_SITE} as site, page_id // 1000 as chunk from pages),
files as (select distinct site, site || '/sitemap-pages-' || cast(chunk as varchar) || '.xml' as file from pg)"""


@query("sitemap_urls", f"""with {_DUCK_SITES}
select site || '/sitemap-pages-' || cast(chunk as varchar) || '.xml' as sitemap_url, url from pg""")
def q_sitemap_urls(spark, sf):
    return SM.sitemap_urls(_cat(spark, sf).inputs.sitemaps)


@query("sitemap_index_refs", f"""with {_DUCK_SITES}
select site || case when length(site) % 3 = 2 then '/sitemap.xml' else '/sitemap_index.xml' end as sitemap_url,
  file as child_url from files where length(site) % 3 in (0, 2)""")
def q_sitemap_index_refs(spark, sf):
    sm = _cat(spark, sf).inputs.sitemaps.filter(F.col("status") == 200)
    return SM.sitemap_index_refs(sm)


@query("robots_sitemaps", f"with {_DUCK_SITES} select site, file as sitemap_url from files")
def q_robots_sitemaps(spark, sf):
    sm = _cat(spark, sf).inputs.sitemaps.filter(F.col("sitemap_url").endswith("/robots.txt"))
    return SM.robots_sitemaps(sm)


@query("pick_site_entry", f"""with {_DUCK_SITES}
select distinct site, site || case length(site) % 3 when 2 then '/sitemap.xml' when 0 then '/sitemap_index.xml'
  else '/robots.txt' end as entry_url, cast(case length(site) % 3 when 2 then 1 when 0 then 2 else 4 end as bigint) as entry_rank
from pg""")
def q_pick_site_entry(spark, sf):
    return SM.pick_site_entry(_cat(spark, sf).inputs.sitemaps)


@query("expand_sitemaps", "select distinct url from pages")
def q_expand_sitemaps(spark, sf):
    """Entry per site, robots references, index expansion, distinct URLs."""
    return SM.site_urls(_cat(spark, sf).inputs.sitemaps)


_PROD_RE = r".*[-/]\d{5,}\.html?$|.*/p/[^/]+$|.*/product/[^/]+$|.*/produto/[^/]+$"
_DUCK_URLS = """
urls as (select url from pages union select url from v_products),
px as (select url, lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1),
          '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) as path from urls),
cl as (select url, path, regexp_replace(path, '/+$', '') || '/' as sl, len(list_filter(string_split(path, '/'), lambda s: s <> '')) as segs from px),
classified as (select url, path, case
  when segs = 0 or contains(sl, '/category/') or contains(sl, '/categoria/') or contains(sl, '/about/')
       or contains(sl, '/contact/') or contains(sl, '/home/') or contains(sl, '/index') then 'not_pdp'
  when regexp_matches(url, '^(?:__RE__)') or regexp_matches(path, '\\d{5,}')
       or (contains(sl, '/product/') and not ends_with(sl, '/product/')) or (contains(sl, '/p/') and not ends_with(sl, '/p/'))
       or (contains(sl, '/item/') and not ends_with(sl, '/item/'))
       or (contains(sl, '/produto/') and not ends_with(sl, '/produto/')) then 'definitely_pdp'
  when regexp_matches(path, '\\d{3,}') or segs >= 3 then 'possibly_pdp' else 'not_pdp' end as class from cl)""".replace(
    "__RE__", _PROD_RE)


def _all_urls(spark, sf):
    p = table(spark, sf, "pages").select("url")
    return p.unionByName(_cat(spark, sf).inputs.products.select("url")).distinct()


@query("classify_urls", f"with {_DUCK_URLS} select url, class from classified", ("v_products",))
def q_classify_urls(spark, sf):
    return S.classify_urls(_all_urls(spark, sf)).select("url", "class")


@query("url_pattern_summary", f"""with {_DUCK_URLS}
select class, regexp_replace(path, '\\d+', '{{n}}', 'g') as template, count(*) as n_urls from classified group by 1, 2""",
       ("v_products",))
def q_url_pattern_summary(spark, sf):
    return S.url_pattern_summary(S.classify_urls(_all_urls(spark, sf)))


@query("union_pdp", f"with {_DUCK_URLS} select distinct url from classified where class in ('definitely_pdp', 'possibly_pdp')",
       ("v_products",))
def q_union_pdp(spark, sf):
    return S.union_pdp(S.classify_urls(_all_urls(spark, sf)))


@query("unclassified", f"with {_DUCK_URLS} select url from urls where url not in (select url from classified)",
       ("v_products",))
def q_unclassified(spark, sf):
    urls = _all_urls(spark, sf)
    return S.unclassified(urls, S.classify_urls(urls))


@query("dedupe_urls", "select distinct split_part(split_part(url, '#', 1), '?', 1) as url from pages")
def q_dedupe_urls(spark, sf):
    p = table(spark, sf, "pages").select(U.clean_url("url").alias("url"))
    return S.dedupe_urls(p)


@query("override_urls", """
select distinct url from (select url from pages union all select url from v_products where product_key % 7 = 0) t
where url not in (select url from pages where page_id % 5 = 0)""", ("v_products",))
def q_override_urls(spark, sf):
    """Add the product URLs named by a reviewer (every 7th), drop the excluded pages (every 5th)."""
    pages = table(spark, sf, "pages")
    include = _cat(spark, sf).inputs.products.filter(F.col("product_key") % 7 == 0).select("url")
    exclude = pages.filter(F.col("page_id") % 5 == 0).select("url")
    return S.override_urls(pages.select("url"), include, exclude)


@query("even_sample", """
with i as (select url, row_number() over (order by url) - 1 as idx, count(*) over () as total from v_products)
select url from i where idx % (total // 37) = 0 and idx < 37 * (total // 37)""", ("v_products",))
def q_even_sample(spark, sf):
    """L1: 37 records spread evenly over the product URLs."""
    return O.even_sample(_cat(spark, sf).inputs.products.select("url"), 37, "url")


@query("first_n", "select url from v_products order by url limit 25", ("v_products",))
def q_first_n(spark, sf):
    return O.first_n(_cat(spark, sf).inputs.products.select("url"), 25, "url")


@query("batches", """
select url, cast((row_number() over (order by url) - 1) // 100 as bigint) as batch_id,
  cast((row_number() over (order by url) - 1) % 100 as integer) as batch_pos from v_products""", ("v_products",))
def q_batches(spark, sf):
    return O.batches(_cat(spark, sf).inputs.products.select("url"), "url", 100)


@query("assign_ids", f"""
with h as (select distinct {_SITE} as site from pages)
select site, (select max(page_id) from pages) + row_number() over (order by site) as id from h""")
def q_assign_ids(spark, sf):
    """New ids for the captured sites after the highest page id, in site order."""
    pages = table(spark, sf, "pages")
    sites = pages.select(U.url_root("url").alias("site")).distinct()
    top = pages.agg(F.max("page_id").alias("m")).first()["m"]
    return O.assign_ids(sites, None, top, "site", "id")


@query("dedupe_first_seen", """
with a as (select page_id, unnest(generate_series(0, len(h) - 1)) as pos, unnest(h) as href
           from (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as h from pages) x)
select href, min_by(page_id, page_id * 100000 + pos) as page_id, cast(min_by(pos, page_id * 100000 + pos) as integer) as pos
from a group by href""")
def q_dedupe_first_seen(spark, sf):
    """Each link target once, at its first (page, position)."""
    p = _cat(spark, sf).parsed_pages
    links = p.select("page_id", F.explode("doc.links").alias("l")).select(
        "page_id", F.col("l.pos").alias("pos"), F.col("l.href").alias("href"))
    return O.dedupe_first_seen(links, "href", ["page_id", "pos"])


@query("listing_harvest", """
with recursive seen as (select category_no, product_key, min(page) as fp from v_listing group by 1, 2),
gain as (select distinct category_no, fp as page from seen),
walk(category_no, page) as (
  select distinct category_no, 0 from v_listing
  union all
  select w.category_no, w.page + 1 from walk w join gain g on g.category_no = w.category_no and g.page = w.page + 1
  where not exists (select 1 from v_listing x where x.category_no = g.category_no and x.page = g.page and x.status <> 200))
select product_key, min_by(category_no, category_no * 1000 + page) as category_no,
       min_by(page, category_no * 1000 + page) as page
from v_listing join walk using (category_no, page) group by product_key""", ("v_listing",))
def q_listing_harvest(spark, sf):
    kept = C.listing_harvest(_cat(spark, sf).inputs.listing)
    return C.harvest_first_seen(kept)


_WALK = """
with recursive seen as (select category_no, product_key, min(page) as fp from v_listing where status = 200 group by 1, 2),
gain as (select distinct category_no, fp as page from seen),
walk(category_no, page) as (
  select distinct category_no, 0 from v_listing
  union all
  select w.category_no, w.page + 1 from walk w join gain g on g.category_no = w.category_no and g.page = w.page + 1)"""


@query("listing_harvest_pages", f"""{_WALK},
kept as (select 'https://shop.example.com/c/' || cast(category_no as varchar) || case when category_no % 2 = 0 then '' else '?sort=new' end as category_url,
  page, 'https://shop.example.com/p/item-' || cast(product_key as varchar) as item from v_listing join walk using (category_no, page) where status = 200)
select item, min(struct_pack(c := category_url, p := page)).c as category_url, min(struct_pack(c := category_url, p := page)).p as page
from kept group by item""", ("v_listing",))
def q_listing_harvest_pages(spark, sf):
    """W1 from captured listing pages: page numbers and categories from the URLs, product
    links by B5, the walk per category, each product once at its first place."""
    listing = C.listing_from_pages(_cat(spark, sf).inputs.listing_pages)
    kept = C.listing_harvest(listing, category="category_url", page="page", item="item", status="status")
    return C.harvest_first_seen(kept.select("category_url", "page", "item"), "category_url", "page", "item")


@query("unclassified_rest", f"with {_DUCK_URLS} select url from urls where length(url) % 3 = 0", ("v_products",))
def q_unclassified_rest(spark, sf):
    """T2 where a reviewer left URLs out: those whose length is a multiple of three."""
    urls = _all_urls(spark, sf)
    return S.unclassified(urls, S.classify_urls(urls).filter(F.length("url") % 3 != 0))


# hops of all reachable pages; a page keeps its first hop, so the recursion ends by itself
_DUCK_HOPS = """h(node, hop) using key (node) as (
  select 0::bigint, 0 union
  select l.dst, min(h.hop) + 1 from h join v_links l on l.src = h.node
  where l.dst not in (select node from recurring.h) group by l.dst)"""


@query("crawl_reach", f"with recursive {_DUCK_HOPS} select node, hop from h", ("v_links",))
def q_crawl_reach(spark, sf):
    """E12 from page 0 without a page cap: every reachable page with its hop."""
    c = _cat(spark, sf)
    seeds = spark.range(1).select(F.lit(0).cast("bigint").alias("node"), F.lit(0).alias("ord"))
    r = C.crawl_reach(c.inputs.links, seeds)
    return r.select("node", "hop")


@query("merge_tree", """
with old as (select id, name from v_existing_categories),
new as (select id + 100 as id, upper(name) as name from v_existing_l1)
select id, name from new union all select id, name from old where id not in (select id from new)""",
       ("v_existing_categories", "v_existing_l1"))
def q_merge_tree(spark, sf):
    """A newer listing of categories replaces rows with the same id."""
    c = _cat(spark, sf).inputs
    old = c.existing_categories.select("id", "name")
    new = c.existing_l1.select((F.col("id") + 100).alias("id"), F.upper("name").alias("name"))
    return merge_tree(old, new, "id")


@query("crawl_reach_capped", f"""
with recursive {_DUCK_HOPS},
hops as (select node, hop from h),
k(node, hop, key) as (
  select 0::bigint, 0, []::bigint[]
  union all
  select l.dst, k.hop + 1, min(list_append(k.key, l.pos::bigint))
  from k join v_links l on l.src = k.node join hops on hops.node = l.dst and hops.hop = k.hop + 1
  group by l.dst, k.hop + 1),
ranked as (select node, row_number() over (order by hop, key) - 1 as visit_rank from k),
vis as (select node, visit_rank from ranked where visit_rank < 100)
select node, visit_rank, true as visited from vis
union all
select distinct l.dst, null, false from v_links l join vis on vis.node = l.src
where l.dst not in (select node from vis)""", ("v_links",))
def q_crawl_reach_capped(spark, sf):
    """E12 with the page cap: the first 100 pages in FIFO order from page 0 are visited,
    and every page they link to is reported as discovered.  (The oracle ranks each
    page by its hop and the smallest link-position path that reaches it.)"""
    c = _cat(spark, sf)
    seeds = spark.range(1).select(F.lit(0).cast("bigint").alias("node"), F.lit(0).alias("ord"))
    return C.crawl_reach(c.inputs.links, seeds, max_pages=100).select("node", "visit_rank", "visited")
