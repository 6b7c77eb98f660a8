"""The record stages of load_order (F21): what is shared is computed once, and rows that
repeat nothing are not shuffled."""

from shopsmith.operators import html as H
from shopsmith.operators import htmldom
from shopsmith.operators import products as P
from shopsmith.operators import tree as T


def test_only_repeated_keys_are_compared(spark):
    schema = "url string, product struct<Name:string>, n int"
    rows = [("a", ("x",), 1), ("a", ("y",), 0), ("b", None, 5), (None, ("p",), 1), (None, ("q",), 2)]
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(str, P.products_last_wins(df).collect()))
    assert sorted(map(str, P.last_of_repeated(df).collect())) == want and len(want) == 3
    once = P.last_of_repeated(df.filter("n = 5 or n = 2"))
    assert sorted(map(str, once.collect())) == [str(r) for r in want if "n=5" in str(r) or "n=2" in str(r)]
    assert "Aggregate" not in once._jdf.queryExecution().executedPlan().toString()


def test_products_meet_categories_without_a_shuffle_by_key(spark):
    schema = ("url string, product struct<Name:string,ProductId:string,Description:string,ShortDescription:string,Title:string,"
              "KeyWords:string,ShowWithoutStock:boolean>, categories array<struct<Name:string,Level:int>>, brand struct<Name:string>")
    product = lambda i: ("n", str(i), None, None, None, None, None)
    tools, other = [("Tools", 1), ("Saws", 2)], [("Other", 1)]
    df = spark.createDataFrame([("u1", product(1), tools, ("Acme",)), ("u2", product(2), tools, ("ACME ",)),
                                ("u3", product(3), other, ("Acme",)), (None, product(4), tools, ("Acme",)),
                                ("u5", product(5), tools, ("None such",)), ("u6", product(6), [], ("Acme",))], schema)
    tree = spark.createDataFrame([(1, ["Tools"], 1), (2, ["Tools", "Saws"], 2)], "id long, path_arr array<string>, level int")
    brands = spark.createDataFrame([(7, "Acme")], "id long, name string")
    got = {r["product_id_text"]: (r["category_id"], r["brand_id"], r["reason"]) for r in P.product_rows(df, tree, brands).collect()}
    assert got == {"1": (2, 7, None), "2": (2, 7, None), "3": (None, 7, "no_category"), "4": (None, None, "no_category"),
                   "5": (2, None, "no_brand"), "6": (None, 7, "no_category")}
    paths = spark.createDataFrame([(["tools", "saws"],)] * 9, "lp array<string>")
    assert T.path_categories(paths, tree).collect() == [(["tools", "saws"], 2)]


def test_titles_scripts_and_comments_stay_in_the_run(monkeypatch):
    page = ('<html><head><title>A</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><h1>A</h1>'
            '<title>a &amp; b</title><script>a<!-- b --></script></body></html>')
    calls = []
    plain = htmldom._Builder.parse_starttag
    monkeypatch.setattr(htmldom._Builder, "parse_starttag", lambda self, i: calls.append(i) or plain(self, i))
    root = htmldom.parse(page)
    assert [n.text(skip=()) for n in root.by_tag["script"]] == ['var t="</p>";', "a<!-- b -->"]
    assert [n.text() for n in root.by_tag["title"]] == ["A", "a & b"] and root.by_tag["h1"][0].text() == "A"
    assert calls[:2] == [0, page.index("<title>a &amp;")]  # the run ends where the standard library's rules begin


def test_selectors_that_cannot_match_are_not_tried_again(monkeypatch):
    page = '<html><body class="shop-page"><div class="photo-box"><img src="/a.jpg"></div></body></html>'
    first = H.parse_page(page)
    tried = []
    select = htmldom.select
    monkeypatch.setattr(htmldom, "select", lambda root, sel: tried.append(sel) or select(root, sel))
    assert H.parse_page(page) == first and len(tried) < 3
    assert H.parse_page(page.replace("photo-box", "my-product-photo-x"))["image_facts"][0]["value"] == "/a.jpg"
