"""Image planning and outcomes.

A SKU's plan is a many-to-one join of SKUs to their product's image list
followed by a ``posexplode``; the first-10 rule (L3) belongs to page extraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import image_extension

MAX_IMAGES = 10


def top_images(images: Column | str, k: int = MAX_IMAGES) -> Column:
    """L3: first ``k`` images of a page, inside the array (no shuffle)."""
    c = F.col(images) if isinstance(images, str) else images
    return F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, k)


def repo_slug(repo: str) -> str:
    """``owner/repo`` from either ``owner/repo`` or a full repository URL."""
    if repo.startswith("http"):
        parts = [p for p in repo.split("://", 1)[1].split("/")[1:] if p]
        if len(parts) < 2:
            raise ValueError(f"repository needs owner and name: {repo}")
        return f"{parts[0]}/{parts[1].replace('.git', '')}"
    return repo


def image_plan(skus: DataFrame, records: DataFrame, host_base: str = "https://files.example.com",
               repo: str = "shop/catalog-images", branch: str = "main", folder: str = "images",
               key: str = "url") -> DataFrame:
    """Per SKU, every image of its product: sequence from 1, file name
    ``{sku}_{seq}{ext}``, first is main, hosted URL under base/owner/repo/branch/folder."""
    # extensions are read from a record's images, not again for each of its SKUs
    imgs = records.select(key, F.transform("images", lambda u: F.struct(u.alias("source_url"), image_extension(u).alias("ext"))).alias("imgs"))
    # a record is one row, so its side is hashed and the many SKUs need no sort by URL
    j = skus.select(F.col("id").alias("sku_id"), "product_id", key).join(imgs.hint("shuffle_hash"), key)
    e = j.select("sku_id", "product_id", F.posexplode("imgs").alias("pos", "i")).select(
        "sku_id", "product_id", "pos", "i.source_url", "i.ext")
    seq = (F.col("pos") + 1).cast("int")
    name = F.concat(F.col("sku_id").cast("string"), F.lit("_"), seq.cast("string"), F.col("ext"))
    prefix = "/".join([host_base.rstrip("/"), repo_slug(repo), branch, folder.strip("/")])
    return e.select("sku_id", "product_id", seq.alias("seq"), "source_url", name.alias("file_name"),
                    (seq == 1).alias("is_main"), F.concat(F.lit(prefix + "/"), name).alias("hosted_url"))


def enrich_images(records: DataFrame, products: DataFrame, skus: DataFrame,
                  key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Records joined to loaded products by URL; misses go to rejects with a
    reason (no_product, no_sku, no_images)."""
    r = records.select(key, F.size(F.coalesce("images", F.array())).alias("n_images"))
    p = products.select(key, F.col("id").alias("product_id"))
    n_sku = skus.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_skus"))
    j = r.join(p.hint("merge"), key, "left").join(n_sku.hint("merge"), "product_id", "left")
    reason = (F.when(F.col("product_id").isNull(), "no_product")
              .when(F.coalesce("n_skus", F.lit(0)) == 0, "no_sku")
              .when(F.col("n_images") == 0, "no_images"))
    j = j.withColumn("reason", reason)
    return (j.filter(F.col("reason").isNull()).drop("reason"),
            j.filter(F.col("reason").isNotNull()).select(key, "product_id", "reason"))


def image_results(plan: DataFrame, outcomes: DataFrame, order: str | None = None) -> DataFrame:
    """Outcome per planned image; a missing or empty outcome is a failure;
    errors cut to 200 characters.  Of several outcomes for one image the latest counts
    (highest ``order`` column; without one, an association before a failure)."""
    rank = F.col(order) if order else F.col("status").isin("associated", "already_exists")
    last = F.max_by(F.struct("status", "error"), F.struct(rank.alias("r"), "status", "error"))
    # dealt out first: hardly any image has two outcomes, so they are sorted once, for the
    # groups and the join, and not before the shuffle as well
    o = outcomes.repartition("sku_id", "seq").groupBy("sku_id", "seq").agg(last.alias("o")).select(
        "sku_id", "seq", F.col("o.status").alias("o_status"), F.col("o.error").alias("o_error"))
    j = plan.join(o.hint("merge"), ["sku_id", "seq"], "left")
    status = F.coalesce(F.when(F.col("o_status").isin("associated", "already_exists", "failed"), F.col("o_status")),
                        F.lit("failed"))
    err = F.when(status == "failed", F.left(F.coalesce(F.col("o_error"), F.lit("no outcome recorded")), F.lit(200)))
    return j.withColumn("status", status).withColumn("error", err).drop("o_status", "o_error")


def sku_image_status(skus: DataFrame, results: DataFrame) -> DataFrame:
    """Per SKU planned / associated / failed counts and a status:
    ``no_images`` when nothing was planned, ``failed`` when none associated,
    else ``completed``."""
    agg = results.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("total_images"),
        F.count_if(F.col("status").isin("associated", "already_exists")).alias("total_associated"),
        F.count_if(F.col("status") == "failed").alias("total_failed"))
    s = skus.select(F.col("id").alias("sku_id")).join(agg.hint("merge"), "sku_id", "left").fillna(
        0, subset=["total_images", "total_associated", "total_failed"])
    status = (F.when(F.col("total_images") == 0, "no_images").when(F.col("total_associated") == 0, "failed")
              .otherwise("completed"))
    return s.withColumn("status", status)


def image_summary(status: DataFrame) -> DataFrame:
    """Totals over all SKUs."""
    return status.agg(
        F.count(F.lit(1)).alias("total_skus"), F.sum("total_images").alias("total_images"),
        F.sum("total_associated").alias("total_associated"), F.sum("total_failed").alias("total_failed"),
        F.count_if(F.col("status") == "completed").alias("skus_completed"),
        F.count_if(F.col("status") == "failed").alias("skus_failed"),
        F.count_if(F.col("status") == "no_images").alias("skus_no_images"))


def failed_images(status: DataFrame, plan: DataFrame) -> DataFrame:
    """The planned images of SKUs whose image step failed, to redo (only those)."""
    bad = status.filter(F.col("status") == "failed").select("sku_id")
    return plan.join(bad.hint("merge"), "sku_id", "left_semi")
