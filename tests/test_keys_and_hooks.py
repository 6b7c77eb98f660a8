"""One row per URL and id; models asked once; existing rows kept whole; exact request bodies."""
import json

from pyspark.sql import functions as F

from shopsmith.operators import model as M
from shopsmith.operators import products as P
from shopsmith.plans.workflow import run_workflow
from shopsmith.session import scratch_path
from shopsmith.sources.fixtures import CatalogInputs
from shopsmith.streaming import pages as SP

SF = "/root/testdata/sf0.001"


def test_repeated_captures_give_one_product_and_a_rerun_resumes(spark):
    ci = CatalogInputs(spark, SF)
    few = ci.product_pages.filter("page_id < 12").withColumn("at", F.lit(1))
    twice = few.unionByName(few.withColumn("at", F.lit(2)).withColumn("html", F.replace("html", F.lit("About "), F.lit("Re "))))
    base = scratch_path(spark, "t-run")
    args = (ci.existing_categories, ci.existing_brands, ci.warehouses)
    res = run_workflow(twice, *args, key="page_id", stage_dir=base, order="at",
                       existing_skus=spark.createDataFrame([(7, "old", 9)], "id long, name string, product_id long"))
    n = few.count() - ci.products.filter("product_key < 12 and brand = 'Default'").count()
    assert res.products.count() == n == res.products.select("url").distinct().count() == res.skus.count()
    assert res.products.filter("description like 'Re %'").count() == n
    assert res.catalog_skus.groupBy("action").count().count() >= 1
    broken = twice.withColumn("html", F.raise_error(F.lit("pages must not be read again")))
    assert run_workflow(broken, *args, key="page_id", stage_dir=base, order="at").products.count() == n


def test_repeated_ids(spark):
    from shopsmith.sources.tables import RECORD
    rec = lambda u, pid, sku: {"url": u, "product": {"Name": u, "ProductId": pid}, "categories": [{"Name": "A", "Level": 1}],
                               "brand": {"Name": "B"}, "skus": [{"Name": "s", "SkuId": sku}], "images": [], "specifications": []}
    recs = spark.createDataFrame([rec("u1", "5", "50"), rec("u2", "5", "51"), rec("u3", None, "50")], RECORD)
    tree = spark.createDataFrame([(1, "A", 1, ["A"])], "id long, name string, level int, path_arr array<string>")
    brands = spark.createDataFrame([(1, "B")], "id long, name string")
    ok, bad = P.build_products(recs, tree, brands)
    assert sorted((r["url"], r["id"]) for r in ok.collect()) == [("u1", 5), ("u3", 6)]
    assert [(r["url"], r["reason"]) for r in bad.collect()] == [("u2", "duplicate_id")]
    assert sorted((r["url"], r["id"]) for r in P.build_skus(recs, ok).collect()) == [("u1", 50), ("u3", 51)]


def test_reviewer_returns_every_url_once_and_is_asked_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def reviewer(urls):
        calls.add(1)
        return {"not_pdp": urls[:2], "definitely_pdp": urls[1:3] + ["https://elsewhere"]}
    urls = spark.createDataFrame([(f"u{i}",) for i in range(6)], "url string")
    ok, bad = M.with_url_reviewer(urls, reviewer)
    assert sorted((r["url"], r["class"]) for r in ok.collect()) == [("u0", "not_pdp"), ("u1", "definitely_pdp"), ("u2", "definitely_pdp")]
    assert sorted((r["url"], r["error"]) for r in bad.collect()) == [(f"u{i}", "unclassified") for i in (3, 4, 5)]
    assert calls.value == 1


def test_model_answers_with_other_scalar_types(spark):
    text = json.dumps({"product": {"Name": "A", "ProductId": 77, "IsActive": "true"}, "categories": [{"Name": "C", "Level": "2"}],
                       "skus": [{"Price": "R$ 99.90", "ListPrice": 120, "SkuId": 5}]})
    good, bad = M.parse_model_json(spark.createDataFrame([("u", text)], "url string, text string"))
    r = good.first()
    assert bad.count() == 0 and r["product"]["ProductId"] == "77" and r["product"]["IsActive"] is True
    assert r["categories"][0]["Level"] == 2 and (r["skus"][0]["Price"], r["skus"][0]["ListPrice"]) == (99.9, 120.0)


def test_upserts_go_by_presence_and_keep_whole_rows(spark):
    new = spark.createDataFrame([(1, "n", "x"), (2, "m", "y")], "id long, name string, title string")
    old = spark.createDataFrame([(1, None, False, False, 9), (3, "o", False, True, 8)],
                                "id long, name string, is_active boolean, is_visible boolean, stock int")
    got = {r["id"]: r.asDict() for r in P.upsert_products(new.withColumn("is_active", F.lit(True)).withColumn("is_visible", F.lit(True)), old).collect()}
    assert got[1]["action"] == "kept_existing" and got[1]["name"] is None and got[1]["is_active"] and got[1]["stock"] == 9
    assert got[2]["action"] == "inserted" and got[2]["title"] == "y" and got[3]["action"] == "untouched" and not got[3]["is_active"]
    target = scratch_path(spark, "t-null")
    SP.upsert_batch(spark, spark.createDataFrame([(1, None, 1)], "id long, name string, at int"), target, 1, order="at")
    SP.upsert_batch(spark, spark.createDataFrame([(1, "late", 1), (2, "b", 2), (2, "a", 3)], "id long, name string, at int"), target, 2, order="at")
    assert sorted((r["id"], r["name"]) for r in SP.latest_snapshot(spark, target).collect()) == [(1, None), (2, "a")]


def test_request_bodies(spark):
    from shopsmith.sources.stages import export_payloads
    tree = spark.createDataFrame([(1, 0, "A", 1, True), (2, 1, "B", 2, True)], "id long, parent_id long, name string, level int, created boolean")
    brands = spark.createDataFrame([(4, "N", True)], "id long, name string, created boolean")
    out = {r["entity"]: json.loads(r["payload"]) for r in export_payloads({"tree": tree, "brands": brands}).collect()}
    want = {"Name": "B", "FatherCategoryId": 1, "Title": "B", "Description": None, "Keywords": None, "Active": True, "IsActive": True,
            "ShowInStoreFront": True, "ActiveStoreFrontLink": True, "GlobalCategoryId": 1}
    assert out["category"] == want and out["department"] == want | {"Name": "A", "Title": "A", "FatherCategoryId": None}
    assert out["brand"] == {"Name": "N", "Active": True, "Text": None, "Keywords": None, "SiteTitle": "N"}
