"""Inventory rows (J7): every SKU in every warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The platform's default warehouse and stock quantity.
DEFAULT_WAREHOUSE = "1_1"
DEFAULT_QUANTITY = 100


def sku_inventory(skus: DataFrame, warehouses: DataFrame, quantity: int = DEFAULT_QUANTITY,
                  quantity_col: str | None = None) -> DataFrame:
    """One row per (SKU, warehouse).  Warehouses without an id are skipped;
    with none at all the default warehouse is used.  The quantity is fixed, or
    taken from ``quantity_col`` of the SKU (missing -> 0).

    The output is |SKUs| x |warehouses| by definition.  No side is hinted: Spark broadcasts the
    warehouses when their measured size allows.
    """
    wh = warehouses.select(F.col("id").cast("string").alias("warehouse_id")).filter(
        F.col("warehouse_id").isNotNull() & (F.col("warehouse_id") != "")).distinct()
    if wh.isEmpty():
        wh = skus.sparkSession.createDataFrame([(DEFAULT_WAREHOUSE,)], "warehouse_id string")
    qty = (F.coalesce(F.col(quantity_col).cast("int"), F.lit(0)) if quantity_col
           else F.lit(quantity))
    s = skus.select(F.col("id").alias("sku_id"), qty.alias("quantity"))
    return (s.crossJoin(wh)
            .select("sku_id", "warehouse_id", "quantity", F.lit(False).alias("unlimited")))
