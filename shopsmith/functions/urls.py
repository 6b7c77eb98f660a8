"""Scalar URL and image-URL functions.

All are Spark SQL expressions.  URLs are split with one regular expression
instead of ``parse_url`` because captured hrefs contain characters that a
strict parser rejects but browsers (and lenient parsers) accept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title_case

ColumnOrName = Column | str

URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_scheme(c: ColumnOrName) -> Column:
    return F.nullif(F.regexp_extract(_c(c), URL_PARTS, 1), F.lit(""))


def url_netloc(c: ColumnOrName) -> Column:
    """Whole authority (host and port, as written)."""
    u = _c(c)
    return F.when(u.rlike(URL_PARTS), F.regexp_extract(u, URL_PARTS, 2))


def url_path(c: ColumnOrName) -> Column:
    u = _c(c)
    return F.when(u.rlike(URL_PARTS), F.regexp_extract(u, URL_PARTS, 3))


def url_root(c: ColumnOrName) -> Column:
    """``scheme://netloc`` of a URL."""
    return F.nullif(F.regexp_extract(_c(c), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit(""))


def clean_url(c: ColumnOrName) -> Column:
    """B1: cut ``#fragment`` then ``?query``."""
    return F.split_part(F.split_part(_c(c), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))


def remove_dot_segments(path: ColumnOrName) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path the way a URL join does."""
    p = _c(path)
    segs = F.split(p, "/")
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segs, -1)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(folded, "/")
    joined = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(p.contains("/."), joined).otherwise(p)


def resolve_href(href: ColumnOrName, page_url: ColumnOrName) -> Column:
    """B2: ``//x`` takes the page scheme; ``/x`` joins to the page root (dot
    segments folded); ``http...`` is kept; anything else gives null."""
    h, u = _c(href), _c(page_url)
    rooted_path = F.regexp_extract(h, r"^([^?#]*)", 1)
    rooted_rest = F.substring(h, F.length(rooted_path) + 1, 1 << 30)
    return (F.when(h.startswith("//"), F.concat(url_scheme(u), F.lit(":"), h))
            .when(h.startswith("/"), F.concat(url_root(u), remove_dot_segments(rooted_path), rooted_rest))
            .when(h.startswith("http"), h))


def same_site(url: ColumnOrName, page_url: ColumnOrName) -> Column:
    """Equal netloc (case-sensitive, port included)."""
    return F.coalesce(url_netloc(url), F.lit("")) == F.coalesce(url_netloc(page_url), F.lit(""))


# The default product-URL patterns (id before .htm(l), /p/, /product/, /produto/ slug).
DEFAULT_PRODUCT_PATTERN = (r".*[-/]\d{5,}\.html?$|.*/p/[^/]+$|.*/product/[^/]+$|.*/produto/[^/]+$")


def is_product_url(c: ColumnOrName, pattern: str | None = None) -> Column:
    """The pattern must match from the start of the URL."""
    pat = pattern or DEFAULT_PRODUCT_PATTERN
    return F.coalesce(_c(c).rlike(f"^(?:{pat})"), F.lit(False))


# Image URL markers.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".svg"]
IMAGE_PATH_WORDS = ["/image", "/img", "/photo", "/picture", "/media", "/product"]
IMAGE_EXCLUDE_WORDS = ["logo", "icon", "favicon", "banner", "ad", "advertisement", "placeholder"]


def _any_of(words) -> str:
    return "|".join(re.escape(w) for w in words)


def is_image_url(c: ColumnOrName, exclude_words=None) -> Column:
    """Image extension or image-like path word, and none of the excluded words."""
    low = F.lower(_c(c))
    excl = IMAGE_EXCLUDE_WORDS if exclude_words is None else exclude_words
    ok = low.rlike(_any_of(IMAGE_EXTENSIONS + IMAGE_PATH_WORDS))
    if excl:
        ok = ok & ~low.rlike(_any_of(excl))
    return F.coalesce(ok, F.lit(False))


# Rate-limit markers in error messages.
RATE_LIMIT_MARKERS = ["429", "rate limit", "quota", "too many requests", "resource exhausted", "resource_exhausted"]


def is_rate_limited(msg: ColumnOrName, status: ColumnOrName | None = None) -> Column:
    """B13."""
    hit = F.coalesce(F.lower(_c(msg)).rlike(_any_of(RATE_LIMIT_MARKERS)), F.lit(False))
    if status is not None:
        hit = hit | F.coalesce(_c(status) == 429, F.lit(False))
    return hit


# Path segments that are not categories.
NON_CATEGORY_SEGMENTS = ["p", "product", "produto", "item"]


def categories_from_url(c: ColumnOrName) -> Column:
    """categories from URL path segments; stop at a product slug (longer than
    20 characters or ending in ``-`` + 5 digits); ``-``/``_`` become spaces, title case;
    Level = position among the kept segments."""
    path = F.regexp_replace(F.coalesce(url_path(c), F.lit("")), r"^/+|/+$", "")
    segs = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.isin(*NON_CATEGORY_SEGMENTS))
    stop = F.transform(segs, lambda s: (F.length(s) > 20) | s.rlike(r"-\d{5,}$"))
    first_stop = F.array_position(stop, True)
    kept = F.when(first_stop > 0, F.slice(segs, 1, first_stop - 1)).otherwise(segs)
    return F.transform(kept, lambda s, i: F.struct(
        title_case(F.translate(s, "-_", "  ")).alias("Name"), (i + 1).cast("int").alias("Level")))


def ensure_scheme(c: ColumnOrName) -> Column:
    """F17."""
    u = strip_ws(_c(c))
    return F.when(u.rlike(r"^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def resolve_image_url(c: ColumnOrName, base_url: ColumnOrName) -> Column:
    """``//x`` -> https; ``/x`` joins to the page (query kept); otherwise query and
    fragment removed; a relative path without ``/`` joins to the page folder (Q19)."""
    u, b = _c(c), _c(base_url)
    rel_dir = F.regexp_extract(clean_url(b), r"^(.*/)", 1)
    rooted_path = F.regexp_extract(u, r"^([^?#]*)", 1)
    rest = F.substring(u, F.length(rooted_path) + 1, 1 << 30)
    return (F.when(u.isNull() | (u == ""), F.lit(None).cast("string"))
            .when(u.startswith("//"), F.concat(F.lit("https:"), u))
            .when(u.startswith("/"), F.concat(url_root(b), remove_dot_segments(rooted_path), rest))
            .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), clean_url(u))
            .otherwise(F.concat(rel_dir, clean_url(u))))


# Size markers in image URLs and file names.
THUMBNAIL_SIZE = r"(?i)(thumb|thumbnail|small|medium)[_\-/]?\d+x\d+"
FILE_NAME_SIZE = r"(?i)-\d+[wh]?x\d+[wh]?"


def full_size_url(c: ColumnOrName) -> Column:
    """thumbnail size markers become ``full``."""
    return F.regexp_replace(_c(c), THUMBNAIL_SIZE, "full")


def srcset_urls(c: ColumnOrName, need_descriptor: bool = True) -> Column:
    """F8: first token of each comma piece; with ``need_descriptor`` the piece must
    contain ``x`` or ``w``/``W``; empty pieces are skipped (Q17)."""
    pieces = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), strip_ws), lambda p: p != "")
    if need_descriptor:
        pieces = F.filter(pieces, lambda p: p.contains("x") | F.lower(p).contains("w"))
    return F.transform(pieces, lambda p: F.split(p, r"\s+")[0])


def image_extension(c: ColumnOrName) -> Column:
    """extension of the URL path (dimension suffix removed), mapped to one of
    .jpg .png .webp .gif .svg; anything else .jpg."""
    path = F.coalesce(url_path(c), F.regexp_extract(_c(c), r"^([^?#]*)", 1))
    last = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(last, r"[^.](\.[^.]*)$", 1)
    ext = F.lower(F.regexp_replace(ext, FILE_NAME_SIZE, ""))
    return (F.when(ext.isin(".jpg", ".jpeg"), ".jpg").when(ext == ".png", ".png").when(ext == ".webp", ".webp")
            .when(ext == ".gif", ".gif").when(ext == ".svg", ".svg").otherwise(".jpg"))
