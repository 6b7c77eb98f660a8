"""Stage registry (A9), typed request checks (B15), specification requests (E11), fault
places in JSON (C7), listing pages (W1) and record checks (B14)."""
import json
import random

from pyspark.sql import functions as F

from shopsmith.functions.text import json_fault
from shopsmith.operators import crawl as C
from shopsmith.operators import html as H
from shopsmith.operators import quality as Q
from shopsmith.session import folder_names, path_exists, scratch_path
from shopsmith.sources import stages as ST


def test_a_half_written_stage_is_absent(spark):
    base = scratch_path(spark, "t-half")
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    path = ST.stage_path(base, "extraction")
    df.write.parquet(f"{path}/data-lost")  # killed before the manifest
    assert ST.load_stage(spark, "extraction", base) is None
    ST.write_stage(df, "extraction", base)
    assert ST.load_stage(spark, "extraction", base).collect() == df.collect()
    assert len(folder_names(spark, path)) == 2  # the leftover went
    # a folder that Spark did not finish writing
    df.write.parquet(f"{base}/plain")
    assert ST.load_stage(spark, "plain", base).count() == 1
    from shopsmith.session import remove_path
    remove_path(spark, f"{base}/plain/_SUCCESS")
    assert path_exists(spark, f"{base}/plain") and ST.load_stage(spark, "plain", base) is None


def test_an_empty_stage_loads_with_its_columns(spark):
    base = scratch_path(spark, "t-empty")
    df = spark.createDataFrame([], "id long, tags array<struct<a:int,b:string>>")
    ST.write_stage(df, "images", base)
    got = ST.load_stage(spark, "images", base)
    assert got.count() == 0 and got.schema.simpleString() == df.schema.simpleString()


def test_changed_inputs_are_noticed(spark):
    base = scratch_path(spark, "t-mark")
    one = spark.createDataFrame([(1, {"k": "v"}), (2, None)], "id long, m map<string,string>")
    mark = ST.content_mark(one, None)
    assert mark == ST.content_mark(one.orderBy(F.desc("id")).repartition(3), None)
    assert mark != ST.content_mark(one.unionByName(one), None) and mark != ST.content_mark(one.limit(1), None)
    assert mark != ST.content_mark(one.withColumnRenamed("id", "i"), None) and mark != ST.content_mark(one)
    ST.write_stage(one, "report", base, mark)
    assert ST.load_stage(spark, "report", base, mark).count() == 2 and ST.load_stage(spark, "report", base).count() == 2
    assert ST.load_stage(spark, "report", base, "other") is None


def test_a_workflow_notices_other_pages(spark):
    from shopsmith.plans.workflow import run_workflow
    from shopsmith.sources.fixtures import CatalogInputs
    ci = CatalogInputs(spark, "/root/testdata/sf0.001")
    base = scratch_path(spark, "t-notice")
    few = ci.product_pages.filter("page_id < 9")
    renamed = few.withColumn("html", F.replace("html", F.lit('itemprop="name">'), F.lit('itemprop="name">New ')))

    def names(pages, **more):
        got = run_workflow(pages, ci.existing_categories, ci.existing_brands, ci.warehouses, key="page_id", stage_dir=base, **more).products
        return sorted(r["name"] for r in got.collect())

    first = names(few)
    assert names(renamed) == first                      # the bodies were not asked for
    assert names(renamed, mark_bodies=True) == sorted(f"New {n}" for n in first)
    assert names(few, mark_bodies=True) == first
    assert len(names(few.filter("page_id < 5"))) < len(first)


def test_request_types(spark):
    rows = [("product", 1, '{"Name":"a","CategoryId":1,"BrandId":2}'), ("product", 2, '{"Name":"a","CategoryId":"1","BrandId":2}'),
            ("product", 3, '{"Name":null,"CategoryId":"1"}'), ("category", 4, '{"Name":"c","FatherCategoryId":1.5}'),
            ("department", 5, '{"Name":"d","FatherCategoryId":null}'), ("sku", 6, "no json"), ("image", 7, "{}"), ("brand", 8, None),
            ("sku", 9, '{"ProductId":1,"Name":"n","EAN":"e","IsActive":"yes"}')]
    got = {r["key"]: r["error"] for r in Q.outbox_problems(spark.createDataFrame(rows, "entity string, key long, payload string")).collect()}
    assert got == {2: "Field 'CategoryId' must be of type integer", 3: "Missing required field: Name", 4: "Field 'FatherCategoryId' must be of type integer",
                   6: "Missing required field: ProductId", 8: "Missing required field: Name", 9: "Field 'IsActive' must be of type boolean"}


def test_values_wait_for_their_fields(spark):
    values = spark.createDataFrame([(1, 5, "Size", 'a "b"', 70, "Text", False), (1, 5, "Line", "x", 900, "Text", True), (2, 6, "Fit", "@spec_field:900", 901, "Text", True)],
                                   "product_id long, category_id long, name string, value string, field_id long, field_type string, field_created boolean")
    fields = spark.createDataFrame([(900, 5, "Line", 1), (901, 6, "Fit", 1)], "field_id long, category_id long, name string, field_type_id int")
    out = ST.spec_requests(values, fields)
    answers = spark.createDataFrame([(900, 12), (900, 11), (901, None)], "key long, id long")
    got = {(r["key"], json.loads(r["payload"])["Text"]): (json.loads(r["payload"])["FieldId"], r["needs"])
           for r in ST.answer_references(out, answers).filter("entity = 'spec_value'").collect()}
    assert got == {(1, 'a "b"'): (70, None), (1, "x"): (11, None), (2, "@spec_field:900"): ("@spec_field:901", 901)}
    made = out.filter("entity = 'spec_field' and key = 900").first()
    assert json.loads(made["payload"]) == {"Name": "Line", "CategoryId": 5, "FieldTypeId": 1, "IsRequired": False, "IsStockKeepingUnit": False,
                                           "IsFilter": True, "IsOnProductDetails": True} and made["load_order"] == 2500


def test_json_fault_agrees_with_a_parser(spark):
    rnd = random.Random(3)

    def value(depth=0):
        k = rnd.randrange(8 if depth < 3 else 5)
        if k < 2:
            return rnd.choice([0, 1.5, -3, 1e20, True, None])
        if k < 5:
            return rnd.choice(['a"b', "x\\y", "", "é{}[],:", "line\nbreak", "u\u0001"])
        return [value(depth + 1) for _ in range(rnd.randrange(4))] if k < 6 else {str(i): value(depth + 1) for i in range(rnd.randrange(4))}

    rows = []
    for i in range(300):
        s = json.dumps(value(), ensure_ascii=rnd.random() < .5, indent=rnd.choice([None, 1]))
        if i % 3:
            p = rnd.randrange(len(s) + 1)
            s = s[:p] + rnd.choice(["", '"', "}", ",", ":", "[", "\\", "q", " 1 ", "\n"]) + s[p + rnd.randrange(2):]
        rows.append((i, s))
    rows += [(1000, '{"a": "' + "x" * 50_000 + '", "b": [' + '"\\"", ' * 5_000 + '] ]}')]
    got = {r["i"]: r["f"] for r in spark.createDataFrame(rows, "i int, s string").select("i", json_fault("s").alias("f")).collect()}
    for i, s in rows[:-1]:
        try:
            json.loads(s)
            assert got[i] is None, s
        except json.JSONDecodeError:
            assert got[i] is not None and 0 <= got[i] <= len(s), s
    assert got[1000] == rows[-1][1].rindex("] ]")  # a value must follow the last comma


def test_listing_pages_name_their_category(spark):
    rows = [("https://s.com/c?page=1", 200, '<a href="/p/a">a</a><a href="/p/b?x=1">b</a><a href="https://o.com/p/z">z</a>'),
            ("https://s.com/c?page=2", 503, None), ("https://s.com/c?page=2", 200, '<img data-href="/p/c">'), ("https://s.com/c?page=3#x", 200, "<p>none</p>"),
            ("https://s.com/d?page=1&sort=new", None, '<div data-product-url="/p/d"></div>'), ("https://s.com/d?sort=new&page=2", 404, '<a href="/p/e">e</a>'),
            ("https://s.com/e?pages=4", 200, '<a href="/p/f">f</a>')]
    got = {(r["category_url"], r["page"], r["item"]) for r in C.listing_from_pages(spark.createDataFrame(rows, "url string, status int, html string")).collect()}
    assert got == {("https://s.com/c", 1, "https://s.com/p/a"), ("https://s.com/c", 1, "https://s.com/p/b"), ("https://s.com/c", 2, "https://s.com/p/c"),
                   ("https://s.com/c#x", 3, None), ("https://s.com/d?sort=new", 1, "https://s.com/p/d"), ("https://s.com/d?sort=new", 2, None)}


def test_pages_that_cannot_be_read_are_rejected(spark):
    pages = spark.createDataFrame([("https://s.com/1", None), ("https://s.com/2", "<p>no name</p>"), ("https://s.com/3", "<h1>Name</h1>"), (None, "<h1>x</h1>")], "url string, html string")
    good, bad = Q.valid_records(H.extract_products(pages))
    assert [r["url"] for r in good.collect()] == ["https://s.com/3"]
    assert {r["url"]: r["reason"] for r in bad.collect()} == {"https://s.com/1": "missing 'product' field", "https://s.com/2": "missing product name", None: "missing 'url' field"}


def test_rules_that_cannot_be_applied_are_reported(spark):
    rules = spark.createDataFrame([("s", "Name", "h1.title", None), ("s", "Brand", "a:hover(", "x"), ("t", "Price", None, None)], "site string, field string, selector string, attribute string")
    assert {(r["site"], r["field"]) for r in H.rule_problems(rules).collect()} == {("s", "Brand"), ("t", "Price")}
