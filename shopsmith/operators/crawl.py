"""Order-dependent crawls re-expressed as set logic.

W1 walks listing pages 1..n per category and stops at the first page that
failed, is missing, is empty or brings nothing new: that stop page is a
grouped ``min`` instead of a loop.  E12 is a breadth-first reach over a link
table: one join per hop, a seen-set anti-join, and a rank carried from hop
to hop that reproduces the FIFO visiting order for the page cap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path, staged
from .html import parse_pages, product_links
from .ordering import dedupe_first_seen, with_index


def listing_harvest(listing: DataFrame, max_pages: int | None = None, category: str = "category_no",
                    page: str = "page", item: str = "product_key", status: str = "status") -> DataFrame:
    """(category, page, item) rows of listing pages -> items kept per category:
    pages before the stop page, where stop = first page that is missing, not 200,
    empty, or adds no item unseen in earlier pages of the category.  ``max_pages``
    (none by default) also ends a walk.

    Merge joins throughout: Spark guesses the pages and their new items far smaller than they
    are, and a broadcast of them would go through the driver."""
    l = listing.filter(F.col(page) >= 1)
    if max_pages is not None:
        l = l.filter(F.col(page) <= max_pages)
    pages = l.groupBy(category, page).agg(
        F.max(F.coalesce(F.col(status), F.lit(200))).alias("status"),
        F.count(F.col(item)).alias("n_items"))
    firsts = l.filter(F.col(item).isNotNull()).groupBy(category, item).agg(F.min(page).alias("first_page"))
    new = firsts.groupBy(category, F.col("first_page").alias(page)).agg(F.count(F.lit(1)).alias("n_new"))
    # pages that add something; the walk stops at the first page after one of them (or
    # after page 0) that is not one of them itself
    good = (pages.filter((F.col("status") == 200) & (F.col("n_items") > 0)).join(new.hint("merge"), [category, page])
            .select(category, page))
    after = (l.select(category).distinct().withColumn(page, F.lit(0)).unionByName(good)
             .select(category, (F.col(page) + 1).alias(page)))
    stop = after.join(good.hint("merge"), [category, page], "left_anti").groupBy(category).agg(F.min(page).alias("stop_page"))
    kept = l.join(stop.hint("merge"), category).filter(F.col(page) < F.col("stop_page")).filter(F.col(item).isNotNull())
    return kept.drop("stop_page")


def listing_from_pages(pages: DataFrame, pattern: str | None = None) -> DataFrame:
    """B5 for W1: captured listing pages (url, status, html) -> (category_url, page, item,
    pos, status), one row per product link and one with a null item for a page without any.

    The page number is the URL's ``page`` parameter, the category the URL without it; other
    pages are none of a listing.  A page captured several times counts once, answered
    captures first.  The rows are written once, since a harvest reads them several times.
    """
    number = F.regexp_extract("url", r"[?&]page=(\d+)(?:[&#]|$)", 1)
    listed = pages.withColumn("page", F.nullif(number, F.lit("")).try_cast("int"))
    listed = listed.filter(F.col("page").isNotNull()).withColumn("status", F.coalesce("status", F.lit(200)))
    once = listed.groupBy("url").agg(F.min_by(F.struct("page", "status", "html"), F.struct((F.col("status") != 200), "status", "html")).alias("r")).select("url", "r.*")
    links = product_links(parse_pages(once.filter("status = 200").select("url", "html"), key="url"), "url", pattern)
    # a page's links are exploded from it, so Spark takes them for no more than the pages: no broadcast
    rows = once.select("url", "page", "status").join(links.select("url", F.col("dst").alias("item"), "pos").hint("merge"), "url", "left")
    # the parameter goes, with the sign before it, or its sign moves to the next one
    plain = F.regexp_replace(F.regexp_replace("url", r"([?&])page=\d+&", "$1"), r"[?&]page=\d+(?=#|$)", "")
    return staged(rows.select(plain.alias("category_url"), "page", "item", "pos", "status"), "listing")


def harvest_first_seen(kept: DataFrame, category: str = "category_no", page: str = "page",
                       item: str = "product_key", pos: str | None = None) -> DataFrame:
    """W1 global dedupe: each item once, at its first (category, page[, pos])."""
    order = [category, page] + ([pos] if pos else [])
    return dedupe_first_seen(kept.select(item, *order), item, order, keep=order)


class _Seen:
    """Rows found so far as a few written tables: a new one joins the one before it while
    that is not twice as large, so there are about log2(rows) of them, each row is rewritten
    that often, and a long crawl does not open a file per hop for every hop."""

    def __init__(self):
        self.tables: list[tuple[DataFrame, str, int]] = []

    def add(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Write ``rows``: (they, read back; their number)."""
        table, path, n = self._write(rows)
        self.tables.append((table, path, n))
        return table, n

    def settle(self) -> None:
        """Join what is small; tables handed out before are gone afterwards."""
        while len(self.tables) > 1 and self.tables[-2][2] <= 2 * self.tables[-1][2]:
            (a, pa, _), (b, pb, _) = self.tables.pop(-2), self.tables.pop()
            self.tables.append(self._write(a.unionByName(b)))
            remove_path(a.sparkSession, pa)
            remove_path(a.sparkSession, pb)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for t, _, _ in self.tables])

    @staticmethod
    def _write(rows: DataFrame) -> tuple[DataFrame, str, int]:
        path = scratch_path(rows.sparkSession, "crawl")
        rows.write.parquet(path)
        table = rows.sparkSession.read.schema(rows.schema).parquet(path)
        return table, path, table.count()


#: New nodes of a hop that one task numbers.
_PLACE_ROWS = 100_000


def _visiting_order(links: DataFrame, seeds: DataFrame, max_pages: int, ok_nodes: DataFrame | None) -> DataFrame:
    """(node, rank, hop) of the nodes reached until ``max_pages`` of them are ranked (the last
    hop may go beyond).  A node's key is its first parent's rank and the link's position
    there, one long and one number at any depth: ranks within a hop follow the keys, and a
    hop's ranks follow those of the hop before, which is the order of a FIFO queue."""
    spark = links.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = seeds.groupBy("node").agg(F.min(F.struct(F.lit(-1).cast("long").alias("parent"), F.col("ord").cast("long").alias("pos"))).alias("key"))
    seen, total, hop, before = _Seen(), 0, 0, 1
    while True:
        # numbered by a range sort, in as many partitions as the frontier before suggests
        parts = min(most, 1 + before // _PLACE_ROWS)
        placed = with_index(found.select("node", "key.*"), ["parent", "pos", "node"], "place", parts)
        frontier, n = seen.add(placed.select("node", (F.col("place") + total).alias("rank"), F.lit(hop).alias("hop")))
        total, before = total + n, n
        if n == 0 or total >= max_pages:
            return seen.all()
        src = frontier if ok_nodes is None else frontier.join(ok_nodes.select("node"), "node", "left_semi")
        reached = links.join(src.select(F.col("node").alias("src"), F.col("rank").alias("parent")), "src").select(
            F.col("dst").alias("node"), F.struct("parent", F.col("pos").cast("long").alias("pos")).alias("key"))
        fresh = reached.groupBy("node").agg(F.min("key").alias("key")).join(seen.all().select("node"), "node", "left_anti")
        found = staged(fresh, "crawl-found")
        seen.settle()
        hop += 1


def crawl_reach(links: DataFrame, seeds: DataFrame, max_pages: int | None = None,
                ok_nodes: DataFrame | None = None) -> DataFrame:
    """Breadth-first from ``seeds`` (node, ord) over ``links`` (src, dst, pos) until
    no new node is found, or ``max_pages`` (the visiting order's cap; none by default).

    Returns (node, hop, visit_rank, visited): every visited node (FIFO rank below
    ``max_pages``) and every node discovered from a visited, answering node; without
    ``max_pages`` every node is visited and unranked.  Each hop is one join and an
    anti-join with what was seen.
    """
    spark = links.sparkSession
    if max_pages is None:
        path, hop = scratch_path(spark, "crawl"), 0
        found = seeds.select("node").distinct()
        schema = found.schema
        with_hop = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", hop int"
        while True:
            # a hop's new nodes are written once, as one folder; nothing seen before is rewritten
            found.write.parquet(f"{path}/hop={hop}")
            frontier = spark.read.schema(schema).parquet(f"{path}/hop={hop}")
            seen = spark.read.schema(with_hop).parquet(path)
            if frontier.isEmpty():
                break
            src = frontier if ok_nodes is None else frontier.join(ok_nodes.select("node"), "node", "left_semi")
            reached = links.join(src.withColumnRenamed("node", "src"), "src")
            found = reached.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
            hop += 1
        return seen.select("node", "hop", F.lit(None).cast("long").alias("visit_rank"), F.lit(True).alias("visited"))
    seen = _visiting_order(links, seeds, max_pages, ok_nodes)
    visited = seen.filter(F.col("rank") < max_pages)
    vsrc = visited if ok_nodes is None else visited.join(ok_nodes.select("node"), "node", "left_semi")
    discovered = (links.join(vsrc.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"))
                  .distinct().join(visited.select("node"), "node", "left_anti")
                  .join(seen.select("node", "hop"), "node", "left"))
    return (visited.select("node", "hop", F.col("rank").alias("visit_rank"), F.lit(True).alias("visited"))
            .unionByName(discovered.select("node", "hop", F.lit(None).cast("long").alias("visit_rank"),
                                           F.lit(False).alias("visited"))))
