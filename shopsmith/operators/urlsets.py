"""URL tables: classification, overrides and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Path markers of pages that are not product pages, and of product pages.
NON_PDP_TOKENS = ["/category/", "/categoria/", "/about/", "/contact/", "/home/", "/index"]
PDP_TOKENS = ["/product/", "/p/", "/item/", "/produto/"]
CLASSES = ["definitely_pdp", "possibly_pdp", "not_pdp"]


def _path(url_col):
    return F.lower(F.coalesce(U.url_path(U.clean_url(url_col)), F.lit("")))


def classify_url(url_col, pattern: str | None = None):
    """B8 as rules: non-product markers or the site root -> not_pdp; product
    pattern, product path marker or a 5+ digit id -> definitely_pdp; a 3+ digit
    number or a path three or more segments deep -> possibly_pdp; else not_pdp."""
    u = F.col(url_col) if isinstance(url_col, str) else url_col
    path = _path(u)
    slashed = F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))
    segs = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    non = F.lit(False)
    for t in NON_PDP_TOKENS:
        non = non | slashed.contains(t)
    pdp = U.is_product_url(u, pattern) | path.rlike(r"\d{5,}")
    for t in PDP_TOKENS:
        pdp = pdp | (slashed.contains(t) & ~slashed.endswith(t))
    return (F.when((segs == 0) | non, "not_pdp").when(pdp, "definitely_pdp")
            .when(path.rlike(r"\d{3,}") | (segs >= 3), "possibly_pdp").otherwise("not_pdp"))


def classify_urls(urls: DataFrame, url_col: str = "url", pattern: str | None = None) -> DataFrame:
    return urls.withColumn("class", classify_url(url_col, pattern))


def dedupe_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Set semantics."""
    return urls.select(url_col).distinct()


def override_urls(urls: DataFrame, include: DataFrame | None, exclude: DataFrame | None,
                  url_col: str = "url") -> DataFrame:
    """Add explicit URLs, remove explicit URLs (case kept, Q21)."""
    out = urls.select(url_col)
    if include is not None:
        out = out.unionByName(include.select(url_col))
    out = out.distinct()
    if exclude is not None:
        out = out.join(exclude.select(url_col).distinct(), url_col, "left_anti")
    return out


def union_pdp(classified: DataFrame, url_col: str = "url") -> DataFrame:
    """Definitely ∪ possibly, as a set."""
    d = classified.filter(F.col("class") == "definitely_pdp").select(url_col)
    p = classified.filter(F.col("class") == "possibly_pdp").select(url_col)
    return d.unionByName(p).distinct()


def unclassified(urls: DataFrame, classified: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs without a class (must be empty)."""
    return urls.select(url_col).join(classified.filter(F.col("class").isin(*CLASSES)).select(url_col),
                                     url_col, "left_anti")


def url_template(url_col):
    """Path with every digit run replaced by ``{n}``."""
    u = F.col(url_col) if isinstance(url_col, str) else url_col
    return F.regexp_replace(_path(u), r"\d+", "{n}")


def url_pattern_summary(classified: DataFrame, url_col: str = "url") -> DataFrame:
    """How many URLs per (class, path template)."""
    return classified.groupBy("class", url_template(url_col).alias("template")).agg(
        F.count(F.lit(1)).alias("n_urls"))
