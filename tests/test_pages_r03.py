"""Findings of round 3 on pages: how they are dealt out, parsed and handed on."""
import random
from html.parser import HTMLParser

from shopsmith.operators import html as H
from shopsmith.operators import htmldom as D
from shopsmith.plans.catalog import Catalog
from shopsmith.plans.q_quality import q_valid_pages
from shopsmith.session import deal
from tests.test_scale_r03 import plan_text


class Plain(D._Builder):
    """Every tag is the standard library's."""
    parse_starttag = HTMLParser.parse_starttag


def shape(parser, page):
    b = parser()
    b.feed(page)
    b.close()
    return b.comments, b.root.facts, [(n.tag, n.attrs, [c if isinstance(c, str) else c.place for c in n.children])
                                      for n in b.root.iter()]


def test_plain_tags_make_the_same_tree():
    """runs of plain tags are read at once; odd ones stay with the standard library."""
    bits = ['<a href="x">', "<a href='y'>", '<A HREF="Q&amp;1" class="b c">', "</a>", "</ A>", "<br/>", "<br />", "<img src=x>",
            '<img src="a" data-lazy="l&lt"/>', "text", "&amp;", "&", "<", "a < b", "<script>", "</script>", "<style>p{}", "</style>",
            "<!-- c -->", "<!doctype html>", "<title>", "</title>", "<textarea>", '<a a="1" a="2" A="3">', "<li checked>", '<a href="open',
            '<li data-x="1"data-y="2">', "<a\x0bhref='1'>", '<a\fhref="1">', "<x:y z='1'>", "</x:y>", '<p / a="1">', "</div\n>", "<?pi?>", "é", "\n"]
    draw = random.Random(3)
    for _ in range(3000):
        page = "".join(draw.choice(bits) for _ in range(draw.randint(1, 20)))
        assert shape(D._Builder, page) == shape(Plain, page), page


def test_runs_of_plain_tags_are_read_at_once(monkeypatch):
    """the standard library took most of a page's time, a tag at a time."""
    calls = []
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i, old=HTMLParser.parse_starttag: calls.append(i) or old(self, i))
    root = D.parse('<div class="a"><p>x</p><table>' + '<tr><td>1</td><td>2</td></tr>' * 50 + "</table></div>")
    assert not calls and len(D.select(root, "div.a td")) == 100


def test_rendered_pages_are_dealt_out_by_their_number(spark):
    """A table of many bytes but few row groups gave few tasks all pages."""
    df = spark.range(1000, numPartitions=64).select("id")
    assert deal(df, rows=10).rdd.getNumPartitions() == 100
    cores = spark.sparkContext.defaultParallelism
    assert deal(spark.range(10)).rdd.getNumPartitions() == 4 * cores
    assert deal(spark.range(0)).count() == 0


def test_parsed_pages_keep_nulls_keys_and_maps(spark):
    """pages are handed on as Arrow columns."""
    pages = spark.createDataFrame([(None, "u1", '<meta name="k" content="v"><h1>é</h1>'), (7, None, None), (7, "u2", "")], "page_id long, url string, html string")
    got = {(r["page_id"], r["url"]): r["doc"] for r in H.parse_pages(pages, key="page_id").collect()}
    assert got[(None, "u1")]["meta"] == {"k": "v"} and got[(None, "u1")]["h1"] == "é"
    assert got[(7, None)]["ok"] is False and got[(7, None)]["title"] is None and got[(7, None)]["meta"] == {}
    assert got[(7, "u2")]["ok"] is True and got[(7, "u2")]["links"] == []


def test_valid_pages_extracts_once(spark, tmp_path):
    """pages were parsed and extracted for the valid ones, and again for the rejects."""
    part = [(k, f"a b{k}", "B#1", "PROMO", 1, 1.0) for k in (1, 89, 97)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    out = q_valid_pages(spark, str(tmp_path))
    assert "MapInArrow" not in plan_text(out) and "MapInPandas" not in plan_text(out)
    assert sorted(r["reason"] or "" for r in out.collect()) == ["", "missing 'product' field", "missing product name"]
    assert Catalog.of(spark, str(tmp_path)).inputs.broken_pages.count() == 3


def test_skus_are_shuffled_by_their_number(spark, tmp_path, monkeypatch):
    """a record's numbers take few bytes, so partitions joined by bytes had to spill."""
    from shopsmith import session
    from shopsmith.sources import fixtures
    assert session.partitions_for(spark.range(1000), rows=10) == 100
    assert session.partitions_for(spark.range(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(fixtures, "partitions_for", lambda df: 7)
    spark.createDataFrame([(k, f"a b{k}", "B#1", "PROMO", 2, 1.0) for k in range(5)], "p_partkey long, p_name string, p_brand string, "
                          "p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k % 5, k % 3, 2.0) for k in range(30)], "l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    inputs = fixtures.CatalogInputs(spark, str(tmp_path))
    assert inputs.skus.rdd.getNumPartitions() == inputs.records.rdd.getNumPartitions() == 7
    assert inputs.skus.count() == 12 and inputs.records.count() == 5
