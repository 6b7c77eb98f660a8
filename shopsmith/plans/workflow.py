"""The full workflow as one Spark job chain.

pages -> HTML pass (C3) -> valid records (B14) -> tree and brands (E9) ->
products (E3) -> SKUs (E4) -> image plan (W3) -> outcomes (E8) -> per-SKU
status (G3) -> active SKUs (E5) -> prices (E6) -> inventory (J7) -> summary (G5)
specification values (E11), and the outbox of load requests in load order (A10, W7).  Stage outputs are
Parquet tables in a shared folder, so a lost executor recomputes only the
current stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import html as H
from ..operators import images as I
from ..operators import products as P
from ..operators import quality as Q
from ..operators import report as R
from ..operators import specs as S
from ..operators import tree as T
from ..operators.stock import sku_inventory
from ..session import staged
from ..sources.stages import content_mark, export_payloads, load_stage, spec_requests, text_mark, write_stage


@dataclass
class WorkflowResult:
    records: DataFrame
    record_rejects: DataFrame
    tree: DataFrame
    brands: DataFrame
    products: DataFrame
    product_rejects: DataFrame
    skus: DataFrame
    image_plan: DataFrame
    image_results: DataFrame
    sku_status: DataFrame
    prices: DataFrame
    inventory: DataFrame
    summary: DataFrame
    outbox: DataFrame
    image_rejects: DataFrame     # J8: records whose images cannot be planned, with a reason
    catalog_products: DataFrame  # J11: the catalog after the load
    catalog_skus: DataFrame      # J12
    outbox_problems: DataFrame   # B15: request bodies without a required field, or with one of another type
    spec_values: DataFrame | None      # E11: values of products, with their fields
    new_spec_fields: DataFrame | None  # E11: fields this run requests
    catalog_summary: DataFrame         # G2
    rule_problems: DataFrame | None    # C6: field rules no page can be read with


#: Part of every stage's mark: raise it when a stage computes something else than before.
STAGES_VERSION = 1


def run_workflow(pages: DataFrame, existing_categories: DataFrame, existing_brands: DataFrame,
                 warehouses: DataFrame, outcomes: DataFrame | None = None, existing_products: DataFrame | None = None,
                 rules: DataFrame | None = None, key: str = "url", existing_skus: DataFrame | None = None,
                 stage_dir: str | None = None, order: str | None = None, spec_fields: DataFrame | None = None,
                 spec_types: dict[str, str] | None = None, mark_bodies: bool = False) -> WorkflowResult:
    """E13.  ``outcomes`` (sku_id, seq, status, error) come from the image host;
    without them every planned image counts as associated.  A URL captured several
    times counts once: the capture with the highest ``order`` column (W6).  With
    ``spec_fields`` (category_id, name, id, field_type; may be empty) specification values
    are loaded too, and fields that no category on the way up has are requested, of the type
    ``spec_types`` names or Text (E11).

    Stages are Parquet tables; with ``stage_dir`` (a shared folder for this run) they are
    kept there under their numbers and a second run goes on after the last finished one.  A
    stage is built again if anything it is made from, stage or input, is not what it was; a
    page is known by all its columns but the wide ``html``, unless ``mark_bodies`` asks for
    another pass over the bodies.
    """
    spark = pages.sparkSession
    sources = {"pages": (pages if mark_bodies else pages.drop("html"),), "rules": (rules,), "categories": (existing_categories,), "known_brands": (existing_brands,),
               "known_products": (existing_products,), "known_skus": (existing_skus,), "outcomes": (outcomes,), "known_fields": (spec_fields,)}
    marks: dict[str, str] = {}

    def mark(name: str) -> str:
        if name not in marks:
            marks[name] = content_mark(*sources[name])
        return marks[name]

    def step(name: str, needs: list[str], build, *options) -> DataFrame:
        if stage_dir is None:
            return staged(build(), name)
        inputs = marks[name] = text_mark(STAGES_VERSION, name, *options, *map(mark, needs))
        done = load_stage(spark, name, stage_dir, inputs)
        if done is None:
            write_stage(build(), name, stage_dir, inputs)
            done = load_stage(spark, name, stage_dir, inputs)
        return done

    def extract() -> DataFrame:
        last = pages
        if order:
            last = pages.join(pages.groupBy("url").agg(F.max(order).alias(order)), ["url", order], "left_semi")
        recs = H.extract_products(last, key=key, rules=rules)
        recs = P.last_of_repeated(staged(recs.drop(key) if key != "url" else recs, "extracted"))
        return recs.withColumn("skus", P.fill_sku_ids("skus", "product.ProductId"))

    def top(df: DataFrame | None) -> int:
        return 0 if df is None else df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]

    recs = step("extraction", ["pages", "rules"], extract, key, order)
    good, bad = Q.valid_records(recs)
    tree = step("category_tree", ["extraction", "categories"], lambda: T.build_category_tree(good, existing_categories))
    brands = step("brands", ["extraction", "known_brands"], lambda: T.build_brand_dim(good, existing_brands))
    rows = step("resolved_products", ["extraction", "category_tree", "brands"], lambda: P.product_rows(good, tree, brands))
    products = step("products", ["resolved_products", "known_products"], lambda: P.numbered_products(rows, top(existing_products)))
    prejects = P.product_rejects(rows)
    skus = step("products_skus", ["extraction", "products", "known_skus"], lambda: P.build_skus(good, products, top(existing_skus)))
    plan = step("images", ["extraction", "products_skus"], lambda: I.image_plan(skus, good))
    if outcomes is None:
        outcomes = plan.select("sku_id", "seq", F.lit("associated").alias("status"),
                               F.lit(None).cast("string").alias("error"))
    results = I.image_results(plan, outcomes)
    status = step("execution", ["products_skus", "images", "outcomes"], lambda: I.sku_image_status(skus, results))
    active = P.activate_skus(skus, status)
    prices = P.sku_prices(skus)
    inventory = sku_inventory(skus, warehouses)
    summary = R.execution_summary(tree, brands, products, skus, status, prices, inventory)
    outbox = export_payloads({"tree": tree, "brands": brands, "products": products, "skus": active,
                              "images": plan, "prices": prices, "inventory": inventory}).withColumn("needs", F.lit(None).cast("long"))
    values = new_fields = None
    if spec_fields is not None:
        specs = P.flatten_products(good)["specs"]
        resolved = step("spec_fields", ["extraction", "products", "category_tree", "known_fields"],
                        lambda: S.resolve_spec_fields(specs, products, spec_fields, tree))
        new_fields = step("new_spec_fields", ["spec_fields", "known_fields"], lambda: S.new_spec_fields(resolved, spec_types, top(spec_fields)),
                          sorted((spec_types or {}).items()))
        values = S.with_new_fields(resolved, new_fields)
        outbox = outbox.unionByName(spec_requests(values, new_fields))
    return WorkflowResult(
        good, bad, tree, brands, products, prejects, active, plan, results, status, prices, inventory, summary, outbox,
        outbox_problems=Q.outbox_problems(outbox),
        image_rejects=I.enrich_images(good, products, skus)[1],
        catalog_products=products if existing_products is None else P.upsert_products(products, existing_products),
        catalog_skus=active if existing_skus is None else P.upsert_skus(active, existing_skus),
        spec_values=values, new_spec_fields=new_fields,
        catalog_summary=R.catalog_summary(products, skus, existing_products, new_fields),
        rule_problems=None if rules is None else H.rule_problems(rules))
