"""Scalar functions against hand cases and against Python as a second oracle."""
from urllib.parse import urljoin, urlparse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopsmith.functions import text as X
from shopsmith.functions import urls as U
from conftest import one_col


def apply(spark, fn, values, typ="string"):
    df = one_col(spark, values, typ=typ).withColumn("i", F.monotonically_increasing_id())
    out = df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


def test_category_name_cases(spark):
    got = apply(spark, X.normalize_category_name, ["d'agua 3d-x éa FIXAÇÃO", "   ", None, "FIXAÇÃO", " shoes  "])
    assert got == ["D'Agua 3D-X Éa Fixação", "   ", None, "Fixação", "Shoes"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ éÉçß'-3 _.", min_size=1, max_size=12), min_size=1, max_size=8))
def test_category_name_matches_python_title(spark, values):
    got = apply(spark, X.normalize_category_name, values)
    exp = [v if not v.strip() else v.strip().title() for v in values]
    assert got == exp


def test_spec_name(spark):
    got = apply(spark, X.normalize_spec_name, [" material", "X", "  ", "PESO líquido"])
    assert got == ["Material", "X", "  ", "Peso líquido"]


def test_extract_id(spark):
    vals = ["42", " 42 ", "SKU-10010801x7", "abc", "+5", "1_000", "12345678901234567890", None, "-7"]
    got = apply(spark, X.extract_id, vals)
    assert got == [42, 42, 10010801, None, 5, 1000, None, None, -7]


def test_parse_price(spark):
    got = apply(spark, X.parse_price, ["R$ 1,299.90", "$ 900.10", "free", None, "12"])
    assert got == [1299.9, 900.1, 0.0, 0.0, 12.0]


def test_field_type_overrides_label_is_stripped(spark):
    df = one_col(spark, ["Field Type Overrides: Material=Combo, Peso: number", "no overrides here"])
    got = [r["m"] for r in df.select(X.field_type_overrides("s").alias("m")).collect()]
    assert got[0] == {"Material": "Combo", "Peso": "Number"}
    assert got[1] is None


def test_categories_from_url(spark):
    df = one_col(spark, ["https://h/p/elementos-de-fixacao/parafusos/x-12345",
                         "https://h/" + "a" * 20 + "/" + "b" * 21 + "/c", "https://h/", "https://h/produto/a_b/"])
    got = [[(c["Name"], c["Level"]) for c in r["c"]] for r in df.select(U.categories_from_url("s").alias("c")).collect()]
    assert got[0] == [("Elementos De Fixacao", 1), ("Parafusos", 2)]
    assert got[1] == [("A" + "a" * 19, 1)]
    assert got[2] == []
    assert got[3] == [("A B", 1)]


HREFS = ["//h2/x", "/x", "/a/../b", "x.html", "#a", "mailto:a@b", "/a/./b/", "/a/b/..", "http://h/x?y#z",
         "/für/The,", "/../up"]


def py_resolve(href, page):
    p = urlparse(page)
    if href.startswith("//"):
        return f"{p.scheme}:{href}"
    if href.startswith("/"):
        return urljoin(f"{p.scheme}://{p.netloc}", href)
    if href.startswith("http"):
        return href
    return None


def test_resolve_href_matches_urljoin(spark):
    page = "https://shop.example.com:8080/cat/page?x=1"
    df = spark.createDataFrame([(h, page) for h in HREFS], "h string, u string")
    got = [r["t"] for r in df.select(U.resolve_href("h", "u").alias("t")).collect()]
    assert got == [py_resolve(h, page) for h in HREFS]


def test_clean_and_same_site(spark):
    df = spark.createDataFrame([("https://a.com:80/x?q#f", "https://a.com:80/y"), ("https://a.com/x", "https://A.com/y")],
                               "a string, b string")
    got = df.select(U.clean_url("a").alias("c"), U.same_site("a", "b").alias("s")).collect()
    assert [(r["c"], r["s"]) for r in got] == [("https://a.com:80/x", True), ("https://a.com/x", False)]


def test_is_product_url(spark):
    vals = ["https://s/x-12345.html", "https://s/p/slug", "https://s/product/x", "https://s/produto/y",
            "https://s/cat/", "https://s/p/a/b"]
    assert apply(spark, U.is_product_url, vals) == [True, True, True, True, False, False]
    # a user pattern must match from the start (not mid-string)
    got = apply(spark, lambda c: U.is_product_url(c, r"/item/\d+"), ["https://s/item/12", "/item/12"])
    assert got == [False, True]


def test_image_url_rules(spark):
    got = apply(spark, U.is_image_url, ["https://s/uploads/a.jpg", "https://s/logo.png", "https://s/media/1",
                                        "https://s/x.txt"])
    assert got == [False, False, True, False]
    got = apply(spark, lambda c: U.is_image_url(c, exclude_words=["logo"]), ["https://s/uploads/a.jpg"])
    assert got == [True]


def test_image_helpers(spark):
    df = one_col(spark, ["//h/a.jpg", "/a.jpg?x=1", "a.jpg?x=1", "https://h/thumb_200x200/1.jpg", "https://h/x.PNG",
                         "https://h/a.jpg-1200Wx1200H", "https://h/a.bmp"])
    base = F.lit("https://shop.com/dir/page.html")
    out = df.select(U.resolve_image_url("s", base).alias("r"), U.full_size_url("s").alias("f"),
                    U.image_extension("s").alias("e")).collect()
    assert [r["r"] for r in out][:3] == ["https://h/a.jpg", "https://shop.com/a.jpg?x=1", "https://shop.com/dir/a.jpg"]
    assert out[3]["f"] == "https://h/full/1.jpg"
    assert [r["e"] for r in out][4:] == [".png", ".jpg", ".jpg"]


def test_srcset(spark):
    df = one_col(spark, ["a.jpg 1x, , b.jpg 2x, c.jpg", "d.jpg 640w"])
    got = [r["u"] for r in df.select(U.srcset_urls("s").alias("u")).collect()]
    assert got == [["a.jpg", "b.jpg"], ["d.jpg"]]


def test_rate_limit(spark):
    df = spark.createDataFrame([("Quota exceeded", 500), ("boom", 429), ("fine", 200), (None, None)], "m string, s int")
    got = [r["r"] for r in df.select(U.is_rate_limited("m", "s").alias("r")).collect()]
    assert got == [True, True, False, False]


def test_model_json_cleaning(spark):
    df = one_col(spark, ['```json\n{"a": [1, 2,], }\n```', 'Sure: {"a": 1} thanks', "no json"])
    from shopsmith.operators.model import cleaned_json
    got = [r["j"] for r in df.select(cleaned_json("s").alias("j")).collect()]
    assert got == ['{"a": [1, 2]}', '{"a": 1}', ""]


def py_extract_id(v):
    """The id rule written plainly: whole integer text (sign, digit groups with _), else
    the first digit run; beyond BIGINT -> None."""
    import re
    if v is None:
        return None
    s = v.strip()
    if re.fullmatch(r"[+-]?\d+(_\d+)*", s):
        n = int(s)
    else:
        m = re.search(r"\d+", s)
        if not m:
            return None
        n = int(m.group(0))
    return n if -(2 ** 63) <= n < 2 ** 63 else None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="0123456789 _+-abcX", min_size=0, max_size=22), min_size=1, max_size=8))
def test_extract_id_matches_plain_rule(spark, values):
    assert apply(spark, X.extract_id, values) == [py_extract_id(v) for v in values]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", "", "c.d", "x%20y"]), min_size=1, max_size=6),
                min_size=1, max_size=6))
def test_rooted_hrefs_match_urljoin(spark, seg_lists):
    page = "https://shop.example.com:8443/dir/page.html"
    hrefs = ["/" + "/".join(s) for s in seg_lists]
    df = spark.createDataFrame([(h, page) for h in hrefs], "h string, u string")
    got = [r["t"] for r in df.select(U.resolve_href("h", "u").alias("t")).collect()]
    assert got == [py_resolve(h, page) for h in hrefs]


CATEGORY_CASES = {
    "/p/shoes/air-max": ["Shoes", "Air Max"],
    "/item/x_y/12345/3d-print": ["X Y", "12345", "3D Print"],
    "/shoes/ab-123456/air-max": ["Shoes"],
    "//shoes//" + "a" * 21 + "/x": ["Shoes"],
    "/Élan": ["Élan"],
    "/p/item/": [],
}


def test_categories_from_url_cases(spark):
    df = spark.createDataFrame([("https://shop.example.com" + k, v) for k, v in CATEGORY_CASES.items()],
                               "u string, want array<string>")
    for r in df.select("u", "want", U.categories_from_url("u").alias("c")).collect():
        assert [c["Name"] for c in r["c"]] == r["want"], r["u"]
        assert [c["Level"] for c in r["c"]] == list(range(1, len(r["want"]) + 1))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["p", "item", "shoes", "air-max", "x_y", "ab-123456", "a" * 21, "3d-print"]), max_size=5),
       st.lists(st.sampled_from(["shoes", "tail"]), max_size=2))
def test_categories_of_a_longer_url_extend_the_shorter(spark, head, tail):
    urls = ["https://s/" + "/".join(head), "https://s/" + "/".join(head + tail)]
    short, long = apply(spark, U.categories_from_url, urls)
    assert long[:len(short)] == short and len(long) <= len(short) + len(tail)


IMAGE_CASES = [  # path, extension, is an image
    ("/img/a.jpg?w=1", ".jpg", True), ("/static/b.c.JPEG", ".jpg", True), ("/uploads/pic.webp-1200Wx1200H", ".webp", False),
    ("/x.y/pic.bmp", ".jpg", False), ("/p/.hidden", ".jpg", False), ("/p/a.jpg-800x600#f", ".jpg", True),
    ("/media/a.svg", ".svg", True), ("/media/logo.png", ".png", False), ("/p/a?x=.png", ".jpg", True),
    ("/static/a.gif", ".gif", True), ("/uploads/a.png", ".png", False),  # "ad" in uploads
]


def test_image_rules_cases(spark):
    df = spark.createDataFrame([("https://cdn.example.com" + u, e, ok) for u, e, ok in IMAGE_CASES], "u string, e string, ok boolean")
    for r in df.select("u", "e", "ok", U.image_extension("u").alias("ge"), U.is_image_url("u").alias("gok")).collect():
        assert (r["ge"], r["gok"]) == (r["e"], r["ok"]), r["u"]
