"""Sitemap and robots sources.

Bodies are parsed with ``from_xml`` in PERMISSIVE mode: a malformed body gives a
corrupt-record marker instead of failing the job, and falls back to a
``<loc>`` regular expression.  Index files are expanded level by level with
joins (no per-URL fetching: bodies are a captured table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_root
from ..session import staged

_XML_SCHEMA = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _corrupt_record string"
_XML_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
# Where a site's sitemap is looked for, in order.
ENTRY_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/robots.txt"]


def _parsed(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.select("sitemap_url", "body", F.from_xml("body", _XML_SCHEMA, _XML_OPTS).alias("x"))


def _malformed(x):
    return x.isNull() | x["_corrupt_record"].isNotNull()


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """A2: (sitemap_url, url) for every ``<url><loc>``; malformed XML falls back to
    the ``<loc>...</loc>`` pattern."""
    return _urls(_parsed(sitemaps))


def _urls(p: DataFrame) -> DataFrame:
    good = p.filter(~_malformed(F.col("x"))).select(
        "sitemap_url", F.explode(F.transform("x.url", lambda u: u["loc"])).alias("url"))
    bad = p.filter(_malformed(F.col("x")) & F.col("body").isNotNull()).select(
        "sitemap_url", F.explode(F.regexp_extract_all("body", F.lit("<loc>(.+?)</loc>"), 1)).alias("url"))
    return good.unionByName(bad).filter(F.col("url").isNotNull() & (F.col("url") != ""))


def sitemap_index_refs(sitemaps: DataFrame) -> DataFrame:
    """A3: (sitemap_url, child_url) for every ``<sitemap><loc>`` of an index."""
    return _refs(_parsed(sitemaps))


def _refs(p: DataFrame) -> DataFrame:
    p = p.filter(~_malformed(F.col("x")))
    return p.select("sitemap_url", F.explode(F.transform("x.sitemap", lambda s: s["loc"])).alias("child_url")) \
        .filter(F.col("child_url").isNotNull() & (F.col("child_url") != ""))


def robots_sitemaps(robots: DataFrame, url_col: str = "sitemap_url", body_col: str = "body") -> DataFrame:
    """A4: ``Sitemap: <url>`` lines of robots files (case-insensitive), trimmed."""
    refs = F.regexp_extract_all(F.col(body_col), F.lit(r"(?i)Sitemap:[ \t]*([^\r\n]+)"), 1)
    return robots.select(url_root(url_col).alias("site"), F.explode(refs).alias("sitemap_url")).select(
        "site", F.trim("sitemap_url").alias("sitemap_url"))


def expand_sitemaps(sitemaps: DataFrame, roots: DataFrame) -> DataFrame:
    """A5: from root sitemap URLs follow index references to child bodies and
    collect page URLs; one join per level until a level brings no new sitemap (the
    visited anti-join ends cycles); result deduplicated."""
    bodies = sitemaps.filter(F.coalesce(F.col("status"), F.lit(200)) == 200) if "status" in sitemaps.columns \
        else sitemaps
    bodies = bodies.select("sitemap_url", "body")
    # every body is parsed once and stored; the level loop only joins the references
    parsed = staged(_parsed(bodies), "sitemaps")
    refs = staged(_refs(parsed), "sitemap-refs")
    frontier = roots.select(F.trim("sitemap_url").alias("sitemap_url")).distinct()
    visited = frontier
    while True:
        nxt = (refs.join(frontier, "sitemap_url", "left_semi").select(F.col("child_url").alias("sitemap_url"))
               .distinct().join(visited, "sitemap_url", "left_anti"))
        nxt = staged(nxt, "sitemap-level")
        if nxt.isEmpty():
            break
        visited = visited.unionByName(nxt)
        frontier = nxt
    return _urls(parsed).join(visited, "sitemap_url", "left_semi").select("url").distinct()


def pick_site_entry(sitemaps: DataFrame) -> DataFrame:
    """Per site, the first of sitemap.xml, sitemap_index.xml, sitemaps.xml,
    robots.txt that answered 200."""
    rank = F.array_position(F.array(*[F.lit(p) for p in ENTRY_PATHS]),
                            F.regexp_extract("sitemap_url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/.*)$", 1))
    ok = sitemaps.filter((F.coalesce(F.col("status"), F.lit(200)) == 200) & (rank > 0))
    return ok.groupBy(url_root("sitemap_url").alias("site")).agg(
        F.min_by("sitemap_url", rank).alias("entry_url"), F.min(rank).alias("entry_rank"))


def site_urls(sitemaps: DataFrame) -> DataFrame:
    """A4-A6 together: per site pick the entry; robots entries point to their sitemaps;
    expand everything reachable; distinct URLs."""
    entry = pick_site_entry(sitemaps)
    robots = sitemaps.join(entry.select(F.col("entry_url").alias("sitemap_url")), "sitemap_url", "left_semi") \
        .filter(F.col("sitemap_url").endswith("/robots.txt"))
    roots = (entry.filter(~F.col("entry_url").endswith("/robots.txt")).select(F.col("entry_url").alias("sitemap_url"))
             .unionByName(robots_sitemaps(robots).select("sitemap_url")))
    return expand_sitemaps(sitemaps, roots)
