"""The catalog build as a chain of DataFrame stages over one data folder.

``Catalog`` wires the operators together (records -> tree -> products -> SKUs
-> images -> prices -> inventory) and keeps each stage's DataFrame so later
stages and reports reuse the same plan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import deal, staged
from ..sources.fixtures import CatalogInputs
from ..operators import tree as T
from ..operators import products as P

_CACHE: dict = {}
#: SKUs that a task pairs with every warehouse.
PAIRED_SKUS = 100_000


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.inputs = CatalogInputs(spark, sf_dir)
        self.memo: dict = {}  # other stage results built once per session and folder

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Catalog":
        key = (spark.sparkContext.applicationId, id(spark), sf_dir)
        cached = _CACHE.get(key)
        if cached is None or cached.spark is not spark:
            cached = _CACHE[key] = cls(spark, sf_dir)
        return cached

    @cached_property
    def records(self) -> DataFrame:
        # the nested records feed every stage: materialise them once
        return staged(self.inputs.records, "records")

    @cached_property
    def tree(self) -> DataFrame:
        return staged(T.build_category_tree(self.records, self.inputs.existing_categories), "tree")

    @cached_property
    def brands(self) -> DataFrame:
        return staged(T.build_brand_dim(self.records, self.inputs.existing_brands), "brands")

    @cached_property
    def _products(self):
        max_id = self.inputs.existing_products.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        # build_products, resolved once for both results
        rows = staged(P.product_rows(self.records, self.tree, self.brands), "product-rows")
        return staged(P.numbered_products(rows, max_id), "products"), P.product_rejects(rows)

    @property
    def products(self) -> DataFrame:
        return self._products[0]

    @property
    def product_rejects(self) -> DataFrame:
        return self._products[1]

    @cached_property
    def skus(self) -> DataFrame:
        # build_skus writes its rows down itself; the image plan and outcomes are not written,
        # so a reader computes the columns it needs
        return P.build_skus(self.records, self.products)

    # ------------------------------------------------------------ images, price, stock
    @cached_property
    def image_plan(self) -> DataFrame:
        from ..operators.images import image_plan
        return image_plan(self.skus, self.records)

    @cached_property
    def image_results(self) -> DataFrame:
        from ..operators.images import image_results
        return image_results(self.image_plan, self.inputs.outcomes)

    @cached_property
    def sku_image_status(self) -> DataFrame:
        from ..operators.images import sku_image_status
        return staged(sku_image_status(self.skus, self.image_results), "sku-status")

    @cached_property
    def active_skus(self) -> DataFrame:
        return P.activate_skus(self.skus, self.sku_image_status)

    @cached_property
    def prices(self) -> DataFrame:
        return P.sku_prices(self.skus)

    @cached_property
    def inventory(self) -> DataFrame:
        from ..operators.stock import sku_inventory
        # a SKU is a few bytes and as many rows as there are warehouses: dealt out by number
        return sku_inventory(deal(self.skus.select("id"), PAIRED_SKUS), self.inputs.warehouses)

    # ------------------------------------------------------------ parsed pages (one Python pass each)
    @cached_property
    def parsed_product_pages(self) -> DataFrame:
        from ..operators.html import parse_pages
        return staged(parse_pages(self.inputs.product_pages, key="page_id"), "parsed-products")

    @cached_property
    def parsed_pages(self) -> DataFrame:
        from ..operators.html import parse_pages
        return staged(parse_pages(self.inputs.t("pages"), key="page_id"), "parsed-pages")
