"""Steps that grew faster than their input: what they broadcast, repeat, write or sort."""
import contextlib
import glob
import io

from pyspark.sql import functions as F

from shopsmith.operators import crawl as C
from shopsmith.operators import images as I
from shopsmith.operators import products as P
from shopsmith.operators import quality as Q
from shopsmith.sources import stages as ST
from shopsmith.streaming import pages as SP


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_listing_is_parsed_once_and_not_broadcast(spark):
    """the links of the pages were parsed for every use and went through the driver."""
    page = "".join(f'<a href="/p/item-{i}">x</a>' for i in range(3))
    pages = spark.createDataFrame(
        [("https://s.com/c/1?page=1", 200, page), ("https://s.com/c/1?page=2", 500, page), ("https://s.com/c/2?page=1", 200, "")],
        "url string, status int, html string")
    listing = C.listing_from_pages(pages)
    assert "MapInPandas" not in plan_text(listing)
    assert sorted((r["category_url"], r["item"] or "") for r in listing.collect()) == [
        ("https://s.com/c/1", ""), *[("https://s.com/c/1", f"https://s.com/p/item-{i}") for i in range(3)], ("https://s.com/c/2", "")]
    kept = C.listing_harvest(listing, category="category_url", page="page", item="item")
    assert "BroadcastHashJoin" not in plan_text(kept)
    assert kept.count() == 3


def test_outbox_files_are_compressed_and_whole(spark, tmp_path):
    """requests as plain text took many times the disk."""
    rows = [("sku", 1, 10, '{"a":1}', None), ("inventory", 2, 11, '{"b":2}', None), ("other", 3, 12, "{}", None),
            ("spec_value", 4, 13, '{"c":"@spec_field:9"}', 9)]
    out = spark.createDataFrame(rows, "entity string, load_order int, key long, payload string, needs long")
    ST.write_outbox(out, str(tmp_path / "box"))
    files = glob.glob(f"{tmp_path}/box/**/part-*", recursive=True)
    assert files and all(f.endswith(".json.gz") for f in files)
    back = ST.read_outbox(spark, str(tmp_path / "box")).select(*out.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    ST.write_outbox(out.limit(0), str(tmp_path / "box"))
    assert ST.read_outbox(spark, str(tmp_path / "box")).count() == 0


def test_ids_are_registered_without_parsing(spark, tmp_path, monkeypatch):
    """a batch's pages were parsed once for their ids and once more for their records."""
    seen = []
    real = SP.register_ids
    monkeypatch.setattr(SP, "register_ids", lambda keys, *a: (seen.append(plan_text(keys)), real(keys, *a))[1])
    rows = [(f"https://s.com/p/{i}", 200 if i else 404, "text/html", "<h1>a</h1>", i) for i in range(4)]
    spark.createDataFrame(rows, "url string, status int, content_type string, html string, page_id long").write.parquet(f"{tmp_path}/in/a")
    SP.stream_pages(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ckpt", registry=f"{tmp_path}/ids", first_id=7)
    assert seen and all("MapInPandas" not in p and "MapInArrow" not in p for p in seen)
    got = {(r["url"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(f"https://s.com/p/{i}", 6 + i) for i in (1, 2, 3)}


def test_request_bodies_are_parsed_once(spark):
    """Each test of a body, and the filter below them, built and parsed it again."""
    rows = [("sku", 1, '{"ProductId":1,"Name":"a","EAN":"e","IsActive":false}'), ("sku", 2, '{"ProductId":"1","Name":"a","EAN":"e","IsActive":false}'),
            ("product", 3, '{"Name":null,"CategoryId":1,"BrandId":1}'), ("brand", 4, "no json"), ("price", 5, "{}"), ("department", 6, None)]
    outbox = spark.createDataFrame(rows, "entity string, key long, payload string")
    found = Q.outbox_problems(outbox)
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("parse_json") + optimized.count("parseJson") == 1
    assert {(r["key"], r["error"]) for r in found.collect()} == {
        (2, "Field 'ProductId' must be of type integer"), (3, "Missing required field: Name"), (4, "Missing required field: Name"),
        (6, "Missing required field: Name")}


def test_rows_with_unique_ids_are_not_shuffled_for_them(spark):
    """Whole rows were sorted and joined by id although no id repeats."""
    df = spark.createDataFrame([("a", 5), ("b", None), ("c", 6)], "url string, i long")
    plain = P.first_of_id(df, "i", ["url"])
    assert "Exchange" not in plan_text(plain)
    assert [r["repeats_id"] for r in plain.collect()] == [False] * 3
    twice = P.first_of_id(df.unionByName(spark.createDataFrame([("d", 5), ("e", None)], "url string, i long")), "i", ["url"])
    assert {r["url"]: r["repeats_id"] for r in twice.collect()} == {"a": False, "b": False, "c": False, "d": True, "e": False}


def test_outcomes_are_sorted_once(spark):
    """outcomes were sorted before the shuffle and after it."""
    plan = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "sku_id long, seq int")
    outcomes = spark.createDataFrame([(1, 1, "failed", "x"), (1, 1, "associated", None), (1, 2, "failed", "y" * 300)],
                                     "sku_id long, seq int, status string, error string")
    res = I.image_results(plan, outcomes)
    assert "BroadcastHashJoin" not in plan_text(res)
    assert sorted((r["sku_id"], r["seq"], r["status"], len(r["error"] or "")) for r in res.collect()) == [
        (1, 1, "associated", 0), (1, 2, "failed", 200), (2, 1, "failed", len("no outcome recorded"))]
