"""Catalog inputs derived by Spark from the driver's star tables.

The driver ships TPC-H-like tables; the catalog build needs shop pages,
nested product records, an existing catalog, warehouses and so on.  These
builders derive them with ordinary joins and aggregations so every query's
work grows with the given tables.  The derivation rules are fixed values shared
with the DuckDB oracle (see ``oracle.py``); the odd conditions create the
edge cases the build has to handle (Default brand, missing levels, products
without SKUs, null and zero prices, 0-4 images, missing outcomes, ...).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from ..session import deal, partitions_for
from ..operators.ordering import with_index


class CatalogInputs:
    """Lazily built inputs for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    # ------------------------------------------------------------ flat views
    @cached_property
    def products(self) -> DataFrame:
        p = self.t("part")
        key = F.col("p_partkey")
        url = F.concat(
            F.lit("https://shop.example.com/"), F.lower("p_type"), F.lit("/"),
            F.regexp_replace("p_name", " ", "-"), F.lit("-"),
            F.lpad(key.cast("string"), 12, "0"), F.lit(".html"))
        return p.select(
            key.alias("product_key"), url.alias("url"), F.col("p_name").alias("name"),
            F.when(key % 50 == 7, F.lit("Default")).otherwise(F.col("p_brand")).alias("brand"),
            F.col("p_retailprice").cast("double").alias("price"),
            F.col("p_size").alias("size_no"),
            F.col("p_type").alias("l1"),
            F.split_part("p_name", F.lit(" "), F.lit(2)).alias("l2"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("l3"))

    @cached_property
    def categories(self) -> DataFrame:
        p = self.products
        k = F.col("product_key")
        lv1 = p.filter(k % 20 != 11).select("product_key", F.lit(1).alias("level"), F.col("l1").alias("name"))
        lv2 = p.filter(k % 20 != 9).select("product_key", F.lit(2).alias("level"), F.col("l2").alias("name"))
        lv3 = p.filter((k % 20 != 9) & (k % 4 != 1)).select(
            "product_key", F.lit(3).alias("level"), F.col("l3").alias("name"))
        return lv1.unionByName(lv2).unionByName(lv3)

    @cached_property
    def _ranges(self) -> int:
        return partitions_for(self.t("lineitem"))

    @cached_property
    def skus(self) -> DataFrame:
        # as many partitions as rows ask for: these numbers take few bytes, and the lists and
        # texts made of them many, so partitions joined by their bytes would have to spill
        li = self.t("lineitem").select("l_partkey", "l_suppkey", "l_extendedprice").filter(
            F.col("l_partkey") % 10 != 3).repartition(self._ranges, "l_partkey")
        part = self.t("part").select("p_partkey", "p_retailprice")
        # both sides meet by part once; the groups, and lists of a part's SKUs, stay there
        g = (li.join(part.hint("merge"), li.l_partkey == part.p_partkey)
             .groupBy("l_partkey", "l_suppkey")
             .agg(F.min("p_retailprice").alias("min_price"), F.max("l_extendedprice").alias("list_price")))
        sel = (F.col("l_partkey") + F.col("l_suppkey")) % 9
        return g.select(
            F.col("l_partkey").alias("product_key"),
            (F.col("l_partkey") * 100_000_000 + F.col("l_suppkey")).alias("sku_id"),
            F.col("l_suppkey").alias("variant_no"),
            F.when(sel == 0, F.lit(None).cast("double")).when(sel == 1, F.lit(0.0))
            .otherwise(F.col("min_price")).alias("price"),
            F.col("list_price"))

    @cached_property
    def images(self) -> DataFrame:
        p = self.products.select("product_key", "size_no").filter(F.col("size_no") % 5 >= 1)
        # 0-4 images per product; sequence generated per row, no cross join
        seqs = p.select("product_key", F.explode(F.sequence(F.lit(1), F.col("size_no") % 5)).alias("seq"))
        suffix = (F.when(F.col("seq") == 2, F.lit(".PNG?w=1200"))
                  .when(F.col("seq") == 3, F.lit("-1200Wx1200H.webp")).otherwise(F.lit(".jpeg")))
        return seqs.select(
            "product_key", "seq",
            F.concat(F.lit("https://img.example.com/product/"), F.col("product_key").cast("string"),
                     F.lit("/"), F.col("seq").cast("string"), suffix).alias("image_url"))

    @cached_property
    def specs(self) -> DataFrame:
        p = self.products
        a = p.select("product_key", F.lit(1).alias("seq"), F.lit("SIZE").alias("name"),
                     F.col("size_no").cast("string").alias("value"))
        b = p.select("product_key", F.lit(2).alias("seq"), F.lit(" line ").alias("name"), F.col("l1").alias("value"))
        c = p.filter(F.col("product_key") % 2 == 0).select(
            "product_key", F.lit(3).alias("seq"), F.lit("finish").alias("name"), F.lit("").alias("value"))
        return a.unionByName(b).unionByName(c)

    @cached_property
    def warehouses(self) -> DataFrame:
        # one per nation with suppliers: reads all of them and stays a dimension at any scale
        return self.t("supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("name")).select(
            F.concat(F.lit("1_"), F.col("s_nationkey").cast("string")).alias("id"), "name")

    @cached_property
    def existing_l1(self) -> DataFrame:
        d = self.products.filter(F.col("l1") != "PROMO").select("l1").distinct()
        return with_index(d, "l1", "i").select(
            (F.col("i") + 1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("parent_id"),
            F.col("l1").alias("name"))

    @cached_property
    def existing_l2(self) -> DataFrame:
        d = self.products.filter(F.length("l2") % 2 == 0).select("l1", "l2").distinct()
        e = self.existing_l1
        j = d.join(e, d.l1 == e.name).select(F.col("id").alias("parent_id"), F.col("l2").alias("name"))
        return with_index(j, ["parent_id", "name"], "i").select(
            (F.col("i") + 101).cast("bigint").alias("id"), "parent_id", "name")

    @cached_property
    def existing_categories(self) -> DataFrame:
        return self.existing_l1.unionByName(self.existing_l2)

    @cached_property
    def existing_brands(self) -> DataFrame:
        d = self.t("part").select("p_brand").distinct().filter(F.length("p_brand") == 8)
        return with_index(d, "p_brand", "i").select(
            (F.col("i") + 1).cast("bigint").alias("id"), F.upper("p_brand").alias("name"))

    @cached_property
    def existing_products(self) -> DataFrame:
        p = self.products
        return p.filter(F.col("product_key") % 3 == 0).select(
            F.col("product_key").alias("id"), F.concat(F.lit("old "), F.col("name")).alias("name"),
            (F.col("product_key") % 2 == 0).alias("is_active"), F.lit(False).alias("is_visible"))

    @cached_property
    def outcomes(self) -> DataFrame:
        s = self.skus.select("sku_id", "product_key")
        i = self.images.select("product_key", "seq")
        m = (F.col("sku_id") + F.col("seq")) % 7
        return (s.join(i, "product_key")
                .filter((F.col("sku_id") + F.col("seq")) % 11 != 0)
                .select("sku_id", "seq",
                        F.when(m == 0, "failed").when(m == 1, "already_exists").otherwise("associated")
                        .alias("status"),
                        F.when(m == 0, F.concat(F.lit("HTTP 500 for sku "), F.col("sku_id").cast("string")))
                        .alias("error")))

    @cached_property
    def listing(self) -> DataFrame:
        li = self.t("lineitem")
        return li.select(
            F.col("l_suppkey").alias("category_no"), F.col("l_linenumber").alias("page"),
            F.col("l_partkey").alias("product_key"),
            F.when((F.col("l_suppkey") + F.col("l_linenumber")) % 13 == 0, 500).otherwise(200).alias("status"),
        ).distinct()

    @cached_property
    def links(self) -> DataFrame:
        pg = self.t("pages").select("page_id")
        pid = F.col("page_id")
        cand = (pg.select(pid.alias("src"), (2 * pid + 1).alias("dst"), F.lit(1).alias("pos"))
                .unionByName(pg.select(pid.alias("src"), (2 * pid + 2).alias("dst"), F.lit(2).alias("pos")))
                .unionByName(pg.select(pid.alias("src"), ((pid * 7 + 3) % 40).alias("dst"), F.lit(3).alias("pos"))))
        return (cand.join(pg.withColumnRenamed("page_id", "dst"), "dst", "left_semi")
                .groupBy("src", "dst").agg(F.min("pos").alias("pos")))

    @cached_property
    def attempts(self) -> DataFrame:
        e = self.t("events")
        return e.select(
            F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"),
            F.when(F.col("event_type") == "error", "rate_limit").when(F.col("event_type") == "click", "non_200")
            .when(F.col("event_type") == "signup", "other_error").otherwise("ok").alias("outcome"))

    # ------------------------------------------------------------ nested records
    @cached_property
    def records(self) -> DataFrame:
        """One nested product record per product, as an extractor would emit it.

        The tables with a few rows a product are unioned side by side (each fills its own
        column) and grouped once by product.  The many SKUs are listed by themselves, as
        numbers, where they lie after their own join, and get their texts in the lists."""
        lists = self.skus.groupBy(F.col("product_key").alias("s_key")).agg(
            F.array_sort(F.collect_list(F.struct("sku_id", "variant_no", "price", "list_price"))).alias("s"))
        sku = lambda x: F.struct(
            F.concat(F.lit("Variant "), x["variant_no"].cast("string")).alias("Name"),
            x["sku_id"].cast("string").alias("SkuId"),
            F.lit(None).cast("string").alias("EAN"),
            F.lit(None).cast("boolean").alias("IsActive"),
            F.lit(None).cast("boolean").alias("activeIfPossible"),
            F.when(x["variant_no"] % 2 == 0, F.concat(F.lit("REF-"), x["sku_id"].cast("string"))).alias("RefId"),
            x["price"].alias("Price"), x["list_price"].alias("ListPrice"))
        parts = {
            "p": self.products.select("product_key", F.struct("url", "name", "brand").alias("v")),
            "c": self.categories.select("product_key", F.struct(F.col("level").alias("Level"),
                                                               F.col("name").alias("Name")).alias("v")),
            "i": self.images.select("product_key", F.struct("seq", "image_url").alias("v")),
            "sp": self.specs.select("product_key", F.struct("seq", "name", "value").alias("v")),
        }
        types = {k: df.schema["v"].dataType for k, df in parts.items()}
        aligned = [df.select("product_key", *[(F.col("v") if k == name else F.lit(None).cast(types[k])).alias(k)
                                              for k in parts]) for name, df in parts.items()]
        u = aligned[0]
        for df in aligned[1:]:
            u = u.unionByName(df)
        g = u.repartition(self._ranges, "product_key").groupBy("product_key").agg(
            F.max("p").alias("p"), *[F.array_sort(F.collect_list(k)).alias(k) for k in ("c", "i", "sp")])
        j = g.filter(F.col("p").isNotNull()).select("product_key", "p.*", "c", "i", "sp").join(
            lists.hint("merge"), F.col("product_key") == F.col("s_key"), "left")
        return j.select(
            "product_key", "url",
            F.struct(F.col("name").alias("Name"), F.col("product_key").cast("string").alias("ProductId"),
                     F.concat(F.lit("About "), F.col("name"), F.lit(".")).alias("Description"),
                     F.lit(None).cast("string").alias("ShortDescription"),
                     F.lit(None).cast("string").alias("KeyWords"),
                     F.lit(None).cast("string").alias("Title"),
                     F.lit(None).cast("boolean").alias("IsActive"),
                     F.lit(None).cast("boolean").alias("ShowWithoutStock")).alias("product"),
            F.coalesce(F.transform("c", lambda x: F.struct(x["Name"].alias("Name"), x["Level"].alias("Level"))),
                       F.array().cast("array<struct<Name:string,Level:int>>")).alias("categories"),
            F.struct(F.col("brand").alias("Name")).alias("brand"),
            F.coalesce(F.transform("s", sku),
                       F.array().cast(
                           "array<struct<Name:string,SkuId:string,EAN:string,IsActive:boolean,"
                           "activeIfPossible:boolean,RefId:string,Price:double,ListPrice:double>>"))
            .alias("skus"),
            F.coalesce(F.transform("i", lambda x: x["image_url"]), F.array().cast("array<string>")).alias("images"),
            F.coalesce(F.transform("sp", lambda x: F.struct(x["name"].alias("Name"), x["value"].alias("Value"))),
                       F.array().cast("array<struct<Name:string,Value:string>>")).alias("specifications"))

    # ------------------------------------------------------------ pages
    @cached_property
    def product_pages(self) -> DataFrame:
        """Shop product pages rendered from ``part`` columns; Spark has to parse them back.
        The narrow rows are dealt out, so that the wide pages need not be."""
        p = deal(self.products)
        s = lambda c: F.col(c).cast("string")
        html = F.concat(
            F.lit('<!DOCTYPE html><html><head><title>'), F.col("name"),
            F.lit(' | Shop</title><meta property="og:type" content="product"><meta name="description" content="About '),
            F.col("name"),
            F.lit('."><style>p{}</style><script>var t="</p>";</script></head><body><nav class="breadcrumb">'
                  '<a href="/">Home</a><a href="/'), F.lower("l1"), F.lit('">'), F.col("l1"),
            F.lit('</a><a href="/'), F.lower("l1"), F.lit("/"), F.col("l2"), F.lit('">'), F.col("l2"),
            F.lit('</a></nav><!-- x --><h1 itemprop="name">'), F.col("name"),
            F.lit('</h1><div data-product-id="'), s("product_key"), F.lit('" data-brand="'), F.col("brand"),
            F.lit('"><span itemprop="price">$ '), F.col("price").cast("decimal(12,2)").cast("string"),
            F.lit('</span></div><div class="product-gallery"><img src="//img.example.com/product/'),
            s("product_key"),
            F.lit('/thumb_200x200/1.jpg"><img src="/static/logo.png"></div><table class="specifications">'
                  '<tr><th>Size</th><td>'), s("size_no"),
            F.lit('</td></tr><tr><th>Line</th><td>'), F.col("l1"),
            F.lit('</td></tr></table><form action="/cart/add"></form></body></html>'))
        return p.select(F.col("product_key").alias("page_id"), "url", F.lit(200).alias("status"),
                        html.alias("html"))

    @cached_property
    def variant_pages(self) -> DataFrame:
        """Pages of another shop layout, from ``part``: two variants, a list price, no
        breadcrumb; every other page marks its categories in the menu, the rest link one
        in the detail section."""
        p = deal(self.products)
        k = F.col("product_key").cast("string")
        money = lambda add: (F.col("price") + add).cast("decimal(12,2)").cast("string")
        menu = F.concat(F.lit('<nav class="main-menu"><ul><li class="active"><a href="/a">'), F.col("l1"),
                        F.lit('</a></li><li><a href="/b">Other</a></li><li class="active"><a href="/c">'), F.col("l2"),
                        F.lit("</a></li></ul></nav>"))
        detail = F.concat(F.lit('<section class="product-details"><a rel="category" href="/c">'), F.col("l3"), F.lit("</a></section>"))
        html = F.concat(
            F.lit("<html><head><title>"), F.col("name"), F.lit("</title></head><body>"),
            F.when(F.col("product_key") % 2 == 0, menu).otherwise(F.lit("")),
            F.lit("<h1>"), F.col("name"), F.lit('</h1><div data-product-id="'), k, F.lit('"><span class="price">$ '), money(0),
            F.lit('</span><span class="list-price">$ '), money(3), F.lit('</span></div><select><option data-sku-id="'), k,
            F.lit('01" data-price="'), money(1), F.lit('">Small</option><option data-sku-id="'), k,
            F.lit('02">Large</option></select>'), F.when(F.col("product_key") % 2 == 1, detail).otherwise(F.lit("")),
            F.lit("</body></html>"))
        return p.select(F.col("product_key").alias("page_id"), "url", html.alias("html"))

    @cached_property
    def broken_pages(self) -> DataFrame:
        """Shop pages of which every 97th was captured without a body and every 89th lost
        its title and headings."""
        k = F.col("page_id")
        bare = F.regexp_replace("html", r"(?s)<title>.*?</title>|<h1.*?</h1>", "")
        return self.product_pages.withColumn("html", F.when(k % 97 != 0, F.when(k % 89 == 0, bare).otherwise(F.col("html"))))

    @cached_property
    def graph_pages(self) -> DataFrame:
        """Pages with nothing but JSON-LD, from ``part``: by product number the product is the
        top object, one of a list, a node of an ``@graph``, or a node of several types there."""
        p = deal(self.products)
        k = F.col("product_key")
        about = F.concat(F.lit('"name":"'), F.col("name"), F.lit('","productID":"'), k.cast("string"), F.lit('","image":["https://img.example.com/product/'),
                         k.cast("string"), F.lit('/ld.jpg"]}'))
        crumb = F.lit('{"@type":"BreadcrumbList","name":"Shop"}')
        product = F.concat(F.lit('{"@type":"Product",'), about)
        typed = F.concat(F.lit('{"@type":["Thing","Product"],'), about)
        graph = lambda node: F.concat(F.lit('{"@context":"https://schema.org","@graph":['), crumb, F.lit(","), node, F.lit("]}"))
        script = (F.when(k % 4 == 0, product).when(k % 4 == 1, F.concat(F.lit("["), crumb, F.lit(","), product, F.lit("]")))
                  .when(k % 4 == 2, graph(product)).otherwise(graph(typed)))
        html = F.concat(F.lit('<html><head><script type="application/ld+json">'), script, F.lit("</script></head><body></body></html>"))
        return p.select(k.alias("page_id"), "url", html.alias("html"))

    @cached_property
    def listing_pages(self) -> DataFrame:
        """Listing pages rendered from ``lineitem``: a category per supplier, a page per line
        number, its parts as links, image targets or data attributes, with a pager."""
        k = F.col("product_key").cast("string")
        target = F.concat(F.lit("/p/item-"), k)
        tag = (F.when(F.col("product_key") % 3 == 0, F.concat(F.lit('<img src="/x.png" data-href="'), target, F.lit('">')))
               .when(F.col("product_key") % 3 == 1, F.concat(F.lit('<a href="https://shop.example.com'), target, F.lit('?ref=list#top">See</a>')))
               .otherwise(F.concat(F.lit('<div data-product-url="'), target, F.lit('"></div>'))))
        pages = self.listing.groupBy("category_no", "page", "status").agg(F.array_join(F.array_sort(F.collect_list(tag)), "").alias("tags"))
        number = F.concat(F.lit("page="), F.col("page").cast("string"))
        # every other category has a parameter of its own beside the page
        tail = F.when(F.col("category_no") % 2 == 0, F.concat(F.lit("?"), number)).otherwise(F.concat(F.lit("?sort=new&"), number))
        url = F.concat(F.lit("https://shop.example.com/c/"), F.col("category_no").cast("string"), tail)
        html = F.concat(F.lit('<html><body><a href="/about">About</a><a href="?page='), (F.col("page") + 1).cast("string"), F.lit('">Next</a><a href="https://other.example.org/p/away">x</a>'),
                        F.when(F.col("status") == 200, F.col("tags")).otherwise(F.lit("")), F.lit("</body></html>"))
        return pages.select(url.alias("url"), "status", html.alias("html"))

    @cached_property
    def sitemaps(self) -> DataFrame:
        """Captured sitemap answers per site: chunked urlsets of its pages (1,000 URLs
        per file), an index, robots.txt, and 404s; which entry answers depends on
        the site (``length(site) % 3``); every other site writes raw ``&`` (malformed XML)."""
        pg = self.t("pages").select("page_id", "url")
        site = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        chunk_url = F.concat(F.col("site"), F.lit("/sitemap-pages-"), F.col("chunk").cast("string"), F.lit(".xml"))
        pg = pg.select(site.alias("site"), F.floor(F.col("page_id") / 1000).alias("chunk"), "page_id", "url")
        raw = F.length("site") % 2 == 0
        loc = F.when(raw, F.col("url")).otherwise(F.regexp_replace("url", "&", "&amp;"))
        entry = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>"))
        chunks = pg.groupBy("site", "chunk").agg(
            F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("es"))
        urlsets = chunks.select(
            "site", chunk_url.alias("sitemap_url"), F.lit(200).alias("status"),
            F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                     F.array_join(F.transform("es", lambda x: x["e"]), ""), F.lit("</urlset>")).alias("body"))
        per_site = chunks.groupBy("site").agg(F.array_sort(F.collect_list(chunk_url)).alias("files"))
        kind = F.length("site") % 3
        index_body = F.concat(
            F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.array_join(F.transform("files", lambda f: F.concat(F.lit("<sitemap><loc>"), f,
                                                                 F.lit("</loc></sitemap>"))), ""),
            F.lit("</sitemapindex>"))
        robots_body = F.concat(F.lit("User-agent: *\nDisallow: /cart\n"),
                               F.array_join(F.transform("files", lambda f: F.concat(F.lit("sitemap: "), f)), "\n"),
                               F.lit("\n"))
        not_found = F.lit("Not Found")

        def row(path, ok, body):
            return per_site.select("site", F.concat("site", F.lit(path)).alias("sitemap_url"),
                                   F.when(ok, 200).otherwise(404).alias("status"),
                                   F.when(ok, body).otherwise(not_found).alias("body"))
        out = (urlsets.unionByName(row("/sitemap.xml", kind == 2, index_body))
               .unionByName(row("/sitemap_index.xml", kind == 0, index_body))
               .unionByName(row("/sitemaps.xml", F.lit(False), not_found))
               .unionByName(row("/robots.txt", F.lit(True), robots_body)))
        return out.select("sitemap_url", "status",
                          F.when(F.col("sitemap_url").endswith(".txt"), "text/plain")
                          .otherwise("application/xml").alias("content_type"), "body")

    @cached_property
    def responses(self) -> DataFrame:
        """Raw model answers for the product records, wrapped the ways models answer:
        plain, fenced, with text around, with a trailing comma; every 50th is cut off."""
        r = self.records
        j = F.to_json(F.struct(*[c for c in r.columns if c not in ("product_key", "url")]))
        k = F.col("product_key")
        text = (F.when(k % 50 == 0, F.left(j, F.floor(F.length(j) / 2).cast("int")))
                .when(k % 4 == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
                .when(k % 4 == 2, F.concat(F.lit("Here is the product:\n"), j, F.lit("\nDone.")))
                .when(k % 4 == 3, F.regexp_replace(j, r"\}$", ",}"))
                .otherwise(j))
        return r.select("product_key", "url", text.alias("text"))
