"""Sitemap sources: namespaced, plain, index of index, malformed, empty."""
from shopsmith.sources import sitemaps as SM

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_sitemap_forms(spark):
    rows = [
        ("https://a.com/sitemap.xml", 200, f"<sitemapindex {NS}><sitemap><loc>https://a.com/idx2.xml</loc></sitemap></sitemapindex>"),
        ("https://a.com/idx2.xml", 200, "<sitemapindex><sitemap><loc> https://a.com/s1.xml </loc></sitemap></sitemapindex>"),
        ("https://a.com/s1.xml", 200, f"<urlset {NS}><url><loc>https://a.com/p/1</loc></url></urlset>"),
        ("https://b.com/sitemap.xml", 404, "nope"),
        ("https://b.com/robots.txt", 200, "User-agent: *\nSITEMAP: https://b.com/s.xml\n"),
        ("https://b.com/s.xml", 200, "<urlset><url><loc>https://b.com/x?a=1&b=2</loc></url><url><loc>https://b.com/y</loc></url>"),
        ("https://c.com/sitemap.xml", 200, ""),
    ]
    sm = spark.createDataFrame(rows, "sitemap_url string, status int, body string")
    urls = sorted(r["url"] for r in SM.sitemap_urls(sm).collect())
    assert urls == ["https://a.com/p/1", "https://b.com/x?a=1&b=2", "https://b.com/y"]
    entries = {r["site"]: r["entry_url"] for r in SM.pick_site_entry(sm).collect()}
    assert entries == {"https://a.com": "https://a.com/sitemap.xml", "https://b.com": "https://b.com/robots.txt",
                       "https://c.com": "https://c.com/sitemap.xml"}
    all_urls = sorted(r["url"] for r in SM.site_urls(sm).collect())
    assert all_urls == urls
