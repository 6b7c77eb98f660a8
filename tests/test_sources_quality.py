"""Readers, stage files, model hooks and URL classification."""
import json

from pyspark.sql import functions as F

from shopsmith.operators import model as M
from shopsmith.operators import quality as Q
from shopsmith.operators import specs as SP
from shopsmith.operators import urlsets as S
from shopsmith.session import scratch_path
from shopsmith.sources import stages as ST
from shopsmith.sources import tables as TB


def _write_text(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def test_existing_catalog_shapes(spark):
    path = scratch_path(spark, "t-existing")
    _write_text(spark, path, [
        json.dumps({"Id": "1", "Name": "Fashion", "FatherCategoryId": None}),
        json.dumps([{"id": 2, "name": "Shoes", "FatherCategoryID": "1"}, {"Id": 3, "Name": "Bad", "ParentId": "x"}]),
        json.dumps({"items": [{"Id": "4", "Name": "Boots", "ParentId": 2}]}),
    ])
    got = sorted(tuple(r) for r in TB.read_existing_catalog(spark, path).collect())
    assert got == [(1, 0, "Fashion"), (2, 1, "Shoes"), (3, 0, "Bad"), (4, 2, "Boots")]


def test_record_document_and_old_category_field(spark):
    path = scratch_path(spark, "t-doc")
    doc = {"target_url": "https://s.com", "products": [
        {"url": "u1", "product": {"Name": "A"}, "categories": [{"Name": "X", "Level": 1}]},
        {"url": "u2", "product": {"Name": "B"}, "category": {"Name": "Y", "Level": 1}}]}
    spark.createDataFrame([(json.dumps(doc, indent=2),)], "value string").coalesce(1).write.text(path)
    recs = {r["url"]: [c["Name"] for c in r["categories"]] for r in TB.read_product_records(spark, path).collect()}
    assert recs == {"u1": ["X"], "u2": ["Y"]}


def test_stage_fallback_and_pending(spark):
    base = scratch_path(spark, "t-stage")
    df = spark.createDataFrame([("a",), ("b",)], "url string")
    assert ST.load_stage(spark, "extraction", base) is None
    df.filter("url = 'a'").write.parquet(f"{base}/mapping_custom")
    assert ST.load_stage(spark, "mapping_custom", base).count() == 1   # unnumbered name
    ST.write_stage(df.filter("url = 'a'"), "extraction", base)
    done = ST.load_stage(spark, "extraction", base)
    assert [r["url"] for r in ST.pending(df, done, "url").collect()] == ["b"]


def test_model_json_rejects_keep_context(spark):
    good_text = json.dumps({"product": {"Name": "A"}, "skus": []})
    rows = [("u1", "```json\n" + good_text + "\n```"), ("u2", good_text[: len(good_text) // 2]), ("u3", "no json here")]
    df = spark.createDataFrame(rows, "url string, text string")
    good, bad = M.parse_model_json(df)
    assert [r["url"] for r in good.collect()] == ["u1"]
    reasons = {r["url"]: (r["reason"], r["context"]) for r in bad.collect()}
    assert reasons["u3"][0] == "no JSON object"
    # cut before any closing brace: no object at all; the context is the raw text
    assert reasons["u2"] == ("no JSON object", good_text[: len(good_text) // 2])
    # cut after an inner object closed: an object-like span that does not parse
    cut = '{"product": {"Name": "A"}, "skus": [{"Name": "x"}'
    _, bad2 = M.parse_model_json(spark.createDataFrame([("u4", cut)], "url string, text string"))
    assert [(r["reason"], r["context"]) for r in bad2.collect()] == [("invalid JSON", cut)]


def test_url_reviewer_retries_then_rejects(spark):
    calls = {"n": 0}

    def flaky(urls):
        if any("bad" in u for u in urls):
            raise RuntimeError("quota")
        return {"not_pdp": urls}

    urls = spark.createDataFrame([(f"https://s.com/{i}",) for i in range(5)] + [("https://s.com/bad",)], "url string")
    ok, rejected = M.with_url_reviewer(urls, flaky, batch_size=3, retries=3)
    assert calls["n"] == 0
    assert ok.count() + rejected.count() == 6
    assert "https://s.com/bad" in [r["url"] for r in rejected.collect()]
    assert set(r["error"] for r in rejected.collect()) == {"quota"}


def test_classification_rules(spark):
    urls = ["https://s.com/", "https://s.com/category/shoes", "https://s.com/p/air-max", "https://s.com/x-123456.html",
            "https://s.com/a/b/c", "https://s.com/sale/123", "https://s.com/about", "https://s.com/item/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["class"] for r in S.classify_urls(df).collect()}
    assert got == {"https://s.com/": "not_pdp", "https://s.com/category/shoes": "not_pdp",
                   "https://s.com/p/air-max": "definitely_pdp", "https://s.com/x-123456.html": "definitely_pdp",
                   "https://s.com/a/b/c": "possibly_pdp", "https://s.com/sale/123": "possibly_pdp",
                   "https://s.com/about": "not_pdp", "https://s.com/item/": "not_pdp"}
    assert S.unclassified(df, S.classify_urls(df)).count() == 0


def test_spec_fields_nearest_ancestor(spark):
    tree = spark.createDataFrame([(1, ["A"]), (2, ["A", "B"]), (3, ["A", "B", "C"])], "id long, path_arr array<string>")
    fields = spark.createDataFrame([(1, "material", 10, "Text"), (2, "SIZE", 20, "Number")],
                                   "category_id long, name string, id long, field_type string")
    prods = spark.createDataFrame([("u", 7, 3)], "url string, id long, category_id long")
    specs = spark.createDataFrame([("u", " Material ", "Wood"), ("u", "size", "42"), ("u", "Color", "red"),
                                   ("u", "Empty", " ")], "url string, name string, value string")
    res = SP.resolve_spec_fields(specs, prods, fields, tree)
    got = {r["name"]: (r["field_id"], r["distance"]) for r in res.collect()}
    assert got == {"Material": (10, 2), "Size": (20, 1), "Color": (None, None)}
    vals, new = SP.spec_values(res, {"color": "Color"}, 20)
    assert [(r["name"], r["field_id"], r["field_type"]) for r in new.collect()] == [("Color", 21, "Color")]


def test_required_fields_and_types(spark):
    rows = [(1, '{"Name": "a", "CategoryId": 1, "BrandId": 2}'), (2, '{"Name": "a", "CategoryId": "1", "BrandId": 2}'),
            (3, '{"Name": "a", "CategoryId": 1}'), (4, '{"Name": 5, "CategoryId": 1, "BrandId": 2.5}'), (5, "not json"), (6, None)]
    df = spark.createDataFrame(rows, "id int, payload string")
    got = {r["id"]: r["error"] for r in Q.check_required(df, "Product", types={"Name": "string", "CategoryId": "integer", "BrandId": "number"}).collect()}
    assert got == {1: None, 2: "Field 'CategoryId' must be of type integer", 3: "Missing required field: BrandId",
                   4: "Field 'Name' must be of type string", 5: "Missing required field: Name", 6: "Missing required field: Name"}
