"""Nothing is dropped silently: long crawls, deep sitemaps and trees, many images, late outcomes."""
from shopsmith.operators import crawl as C
from shopsmith.operators import images as I
from shopsmith.operators import tree as T
from shopsmith.sources import sitemaps as SM
from shopsmith.sources.fixtures import CatalogInputs


def test_crawl_follows_a_chain_of_70_hops(spark):
    links = spark.createDataFrame([(i, i + 1, 0) for i in range(70)], "src long, dst long, pos int").coalesce(1)
    seeds = spark.createDataFrame([(0, 0)], "node long, ord int")
    assert C.crawl_reach(links, seeds).agg({"hop": "max"}).first()[0] == 70


def test_listing_walk_has_no_default_page_cap(spark):
    rows = [(1, p, p, 200) for p in range(1, 31)] + [(1, 32, 99, 200), (2, 2, 7, 200)]
    df = spark.createDataFrame(rows, "category_no long, page int, product_key long, status int")
    kept = C.listing_harvest(df).collect()
    assert sorted(r["page"] for r in kept) == list(range(1, 31))
    assert C.listing_harvest(df, 20).count() == 20


def test_nine_sitemap_levels_and_a_loop(spark):
    def index(to):
        return f"<sitemapindex><sitemap><loc>{to}</loc></sitemap></sitemapindex>"
    rows = [(f"https://s/{i}.xml", index(f"https://s/{i + 1}.xml")) for i in range(9)]
    rows[4] = ("https://s/4.xml", "<sitemapindex><sitemap><loc>https://s/5.xml</loc></sitemap>"
                                  "<sitemap><loc>https://s/0.xml</loc></sitemap></sitemapindex>")
    rows.append(("https://s/9.xml", "<urlset><url><loc>https://s/page</loc></url></urlset>"))
    sm = spark.createDataFrame(rows, "sitemap_url string, body string")
    roots = spark.createDataFrame([("https://s/0.xml",)], "sitemap_url string")
    assert [r["url"] for r in SM.expand_sitemaps(sm, roots).collect()] == ["https://s/page"]


def test_every_category_has_a_path(spark):
    chain = [(i, i - 1, f"c{i}") for i in range(1, 34)]
    odd = [(100, 999, "lost"), (101, 100, "child"), (200, 201, "a"), (201, 200, "b"), (202, 200, "below"), (300, None, "top")]
    got = {r["id"]: r for r in T.tree_paths(spark.createDataFrame(chain + odd, "id long, parent_id long, name string")).collect()}
    assert len(got) == 39 and got[33]["level"] == 33
    assert [got[i]["reason"] for i in (33, 300, 100, 101, 200, 201, 202)] == \
        [None, None, "missing_parent", "missing_parent", "cycle", "cycle", "cycle"]
    assert got[101]["path_arr"] == ["#999", "Lost", "Child"] and got[101]["root_id"] == 100


def test_all_images_are_planned(spark):
    recs = spark.createDataFrame([("u", [f"https://i/{k}.png" for k in range(12)])], "url string, images array<string>")
    skus = spark.createDataFrame([(5, 1, "u")], "id long, product_id long, url string")
    plan = I.image_plan(skus, recs)
    assert plan.count() == 12
    tries = spark.createDataFrame([(5, 1, "failed", "x", 1), (5, 1, "associated", None, 2), (5, 2, "associated", None, 1),
                                   (5, 2, "failed", "late", 2)],
                                  "sku_id long, seq int, status string, error string, at int")
    got = {r["seq"]: (r["status"], r["error"]) for r in I.image_results(plan, tries, "at").collect()}
    assert len(got) == 12 and got[1] == ("associated", None) and got[2] == ("failed", "late")
    assert I.image_results(plan, tries.drop("at")).filter("seq = 2").first()["status"] == "associated"


def test_keys_of_large_tables_stay_apart(spark, tmp_path):
    part = spark.createDataFrame([(k, "a b", "T", "B", 1.0, 1) for k in (1_000_000, 10_000_000, 10_000_001)],
                                 "p_partkey long, p_name string, p_type string, p_brand string, p_retailprice double, p_size int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert CatalogInputs(spark, str(tmp_path)).products.select("url").distinct().count() == 3
