"""Category tree and brand dimension.

A category is identified by its full path of normalised names, so "the same
name under another parent" is a different node and resolution is one equi-join
on path arrays instead of a level-by-level walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_brand_name, normalize_category_name, strip
from ..session import staged
from .ordering import assign_ids

# Category names that are not real levels ("Início" is kept on purpose).
ROOT_LEVEL_NAMES = ["home", "root", "default"]
PATH_SEP = " > "


def skip_root_levels(categories: Column | str) -> Column:
    """Drop ``home``/``root``/``default`` (any case) and empty names."""
    c = F.col(categories) if isinstance(categories, str) else categories
    return F.filter(c, lambda x: x["Name"].isNotNull() & (strip(x["Name"]) != "")
                    & ~F.lower(strip(x["Name"])).isin(*ROOT_LEVEL_NAMES))


def category_path(categories: Column | str = "categories") -> Column:
    """Cleaned, normalised path of a record's category list."""
    return F.transform(skip_root_levels(categories), lambda x: normalize_category_name(x["Name"]))


def product_paths(records: DataFrame, key: str = "url") -> DataFrame:
    return records.select(key, category_path("categories").alias("path"))


def _prefixes(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))), lambda n: F.slice(path, 1, n))


def build_departments(records: DataFrame) -> DataFrame:
    """Distinct normalised first category."""
    p = category_path("categories")
    return (records.select(F.element_at(p, 1).alias("name")).filter(F.col("name").isNotNull())
            .distinct())


def build_category_nodes(records: DataFrame) -> DataFrame:
    """Every distinct path prefix is a node; a one-entry list is its department."""
    # lists that records share are cleaned once
    paths = records.select("categories").distinct().select(category_path("categories").alias("path")).filter(F.size("path") > 0)
    nodes = paths.select(F.explode(_prefixes(F.col("path"))).alias("path_arr")).distinct()
    return nodes.select(
        "path_arr",
        F.element_at("path_arr", -1).alias("name"),
        F.size("path_arr").alias("level"),
        F.slice("path_arr", 1, F.size("path_arr") - 1).alias("parent_path"),
        F.array_join("path_arr", PATH_SEP).alias("path"))


def build_brands(records: DataFrame) -> DataFrame:
    """Distinct trimmed brand names, not empty and not ``Default``."""
    b = normalize_brand_name(F.col("brand.Name"))
    return (records.select(b.alias("name")).filter(F.col("name").isNotNull() & (F.col("name") != "")
                                                    & (F.col("name") != "Default")).distinct())


def tree_paths(categories: DataFrame) -> DataFrame:
    """Parent links -> full normalised path, level, root id and reason.

    Breadth-first over levels, one join of the next level against the current one,
    until a level is empty.  Every category comes back: one whose parent is not in
    the table starts a tree of its own (reason ``missing_parent``, also for what is
    below it), one that no tree reaches lies on or below a loop (``cycle``, root id
    null).  Both have ``#<parent id>`` as the first path entry, so no product path
    matches them.  Of rows with one id, the one with the least (parent, name) counts.
    """
    base = (categories.groupBy("id").agg(F.min(F.struct(F.coalesce("parent_id", F.lit(0)).cast("bigint").alias("parent_id"),
                                                        "name")).alias("r")).select("id", "r.*"))
    base = staged(base, "categories")
    own = normalize_category_name("name")
    apart = F.array(F.concat(F.lit("#"), F.col("parent_id").cast("string")), own)
    known = base.select(F.col("id").alias("parent_id"))
    orphan = base.filter("parent_id <> 0").join(known, "parent_id", "left_anti")
    level = (base.filter("parent_id = 0").select("id", "parent_id", "name", F.array(own).alias("path_arr"),
                                                 F.col("id").alias("root_id"), F.lit(None).cast("string").alias("reason"))
             .unionByName(orphan.select("id", "parent_id", "name", apart.alias("path_arr"), F.col("id").alias("root_id"),
                                        F.lit("missing_parent").alias("reason"))))
    out = level
    while True:
        above = level.select(F.col("id").alias("parent_id"), F.col("path_arr").alias("above"), "root_id", "reason")
        level = staged(base.join(above, "parent_id").select(
            "id", "parent_id", "name", F.concat("above", F.array(own)).alias("path_arr"), "root_id", "reason"), "tree-level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    loops = base.join(out.select("id"), "id", "left_anti").select(
        "id", "parent_id", "name", apart.alias("path_arr"), F.lit(None).cast(base.schema["id"].dataType).alias("root_id"),
        F.lit("cycle").alias("reason"))
    return out.unionByName(loops).select(
        "id", "parent_id", "name", F.size("path_arr").alias("level"), "path_arr",
        F.array_join("path_arr", PATH_SEP).alias("path"), "root_id", "reason")


def match_existing_categories(nodes: DataFrame, existing_paths: DataFrame) -> DataFrame:
    """Reuse an existing node with the same (parent path, name); else created."""
    ex = existing_paths.select(F.col("path_arr").alias("ex_path"), F.col("id").alias("existing_id"))
    # several existing nodes can carry the same path; keep the lowest id
    ex = ex.groupBy("ex_path").agg(F.min("existing_id").alias("existing_id"))
    j = nodes.join(ex, nodes.path_arr == ex.ex_path, "left").drop("ex_path")
    return j.withColumn("created", F.col("existing_id").isNull())


def match_existing_brands(brands: DataFrame, existing: DataFrame) -> DataFrame:
    """Reuse an existing brand with the same trimmed name, else created."""
    ex = (existing.select(strip("name").alias("name"), F.col("id").alias("existing_id"))
          .groupBy("name").agg(F.min("existing_id").alias("existing_id")))
    return brands.join(ex, "name", "left").withColumn("created", F.col("existing_id").isNull())


def build_category_tree(records: DataFrame, existing_categories: DataFrame) -> DataFrame:
    """The whole tree the products need: reuse or create every node, new ids
    after the highest existing id in (level, path) order, parents linked by path."""
    nodes = build_category_nodes(records)
    ex = tree_paths(existing_categories)
    matched = staged(match_existing_categories(nodes, ex), "category-nodes")  # numbered in several passes
    max_id = existing_categories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    with_ids = assign_ids(matched, "existing_id", max_id.first()["m"], ["level", "path"], "id")
    parents = with_ids.select(F.col("path_arr").alias("parent_path"), F.col("id").alias("parent_id"))
    tree = with_ids.join(parents, "parent_path", "left")
    return tree.select(
        "id", F.coalesce("parent_id", F.lit(0).cast("bigint")).alias("parent_id"), "name", "level", "path",
        "path_arr", "created", F.lit(True).alias("is_active"), F.lit(True).alias("is_visible"))


def build_brand_dim(records: DataFrame, existing_brands: DataFrame) -> DataFrame:
    """E9 (brands): reuse or create, new ids after the highest existing id by name."""
    m = staged(match_existing_brands(build_brands(records), existing_brands), "brand-names")
    max_id = existing_brands.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    return assign_ids(m, "existing_id", max_id, ["name"], "id").select("id", "name", "created")


def resolve_category(paths: DataFrame, tree: DataFrame, key: str = "url") -> DataFrame:
    """J3 + J4: category id per product (null without a ``key``): that of its path."""
    p = paths.select(key, lower_path("path").alias("lp"))
    known = F.when(F.col(key).isNotNull(), F.col("category_id"))
    return p.join(path_categories(p, tree), "lp", "left").select(key, known.alias("category_id"))


def lower_path(path: Column | str) -> Column:
    return F.transform(path, F.lower)


def path_categories(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """(lp, category_id) for every path ``lp`` of ``paths`` (lower case) that has a category;
    a path that many products share is resolved once.

    J3: start at the first path entry that is a department (case-insensitive),
    then take the deepest contiguous match.  Every contiguous sub-path of the
    path is joined to the tree paths once: a sub-path matches only if
    all levels above it match (path equality) and, since tree paths begin at a
    department, the smallest matching start is the first department in the
    list; the answer is the longest match at that start.
    J4: with no department in the list (so no J3 match at all) the whole path
    must exist below some department; the lowest department id wins.
    """
    t = tree.select("id", lower_path("path_arr").alias("lpath"), "level")
    lp = staged(paths.select("lp").filter(F.size("lp") > 0).distinct(), "paths")
    n = F.size("lp")
    subs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(
        F.sequence(F.lit(1), n - i), lambda m: F.struct(i.alias("i"), m.alias("m"), F.slice("lp", i + 1, m).alias("sp")))))
    cand = lp.select("lp", F.explode(subs).alias("s")).select("lp", "s.i", "s.m", F.col("s.sp").alias("lpath"))
    # one node per lower-cased path (lowest id): smallest start, then longest match
    tl = t.groupBy("lpath").agg(F.min("id").alias("id"))
    # both fit 32 bits, so one long ranks every (start, length)
    rank = F.col("m").cast("long") - F.col("i").cast("long") * F.lit(1 << 32)
    direct = cand.join(tl, "lpath").groupBy("lp").agg(F.max_by("id", rank).alias("direct_id"))
    roots = t.filter(F.col("level") == 1).groupBy(F.element_at("lpath", 1).alias("root")).agg(
        F.min("id").alias("root_id"))
    # J4 candidates: per tail path the node under the lowest department
    tails = (t.filter(F.col("level") >= 2)
             .select(F.col("id").alias("any_id"), F.slice("lpath", 2, F.col("level")).alias("lp"),
                     F.element_at("lpath", 1).alias("root"))
             .join(roots, "root")
             .groupBy("lp").agg(F.min_by("any_id", F.struct("root_id", "any_id")).alias("any_id")))
    found = lp.join(direct, "lp", "left").join(tails, "lp", "left").select(
        "lp", F.coalesce("direct_id", "any_id").alias("category_id")).filter(F.col("category_id").isNotNull())
    # written down, so that readers know its size
    return staged(found, "path-categories")


def resolve_brand(products: DataFrame, brands: DataFrame, key: str = "url",
                  brand_col: str = "brand_name") -> DataFrame:
    """Case-insensitive trimmed match, lowest id on ties."""
    p = products.select(key, F.lower(strip(brand_col)).alias("bkey"))
    return p.join(brand_keys(brands), "bkey", "left").select(key, "brand_id")


def brand_keys(brands: DataFrame) -> DataFrame:
    """(bkey, brand_id): the lowest id of every brand name in lower case."""
    return (brands.select(F.lower(strip("name")).alias("bkey"), F.col("id").alias("brand_id"))
            .groupBy("bkey").agg(F.min("brand_id").alias("brand_id")))


def missing_tail(paths: DataFrame, tree: DataFrame, key: str = "url") -> DataFrame:
    """Longest prefix already in the tree and the levels still to create."""
    t = tree.select(F.col("path_arr").alias("prefix"), F.col("id").alias("node_id"))
    p = paths.filter(F.size("path") > 0)
    pref = p.select(key, "path", F.explode(_prefixes(F.col("path"))).alias("prefix"))
    t = t.groupBy("prefix").agg(F.min("node_id").alias("node_id"))
    hit = (pref.join(t, "prefix")
           .groupBy(key).agg(F.max(F.size("prefix")).alias("depth"),
                             F.max_by("node_id", F.size("prefix")).alias("node_id")))
    j = p.join(hit, key, "left")
    depth = F.coalesce(F.col("depth"), F.lit(0))
    return j.select(key, "path", F.coalesce(F.col("node_id"), F.lit(0).cast("bigint")).alias("parent_id"),
                    depth.alias("matched_levels"),
                    F.slice("path", depth + 1, F.size("path")).alias("missing"))


def merge_tree(old: DataFrame, new: DataFrame, key: str | list[str] = "path") -> DataFrame:
    """Dict-update semantics: a row of ``new`` replaces the row of ``old`` with the same key."""
    keys = [key] if isinstance(key, str) else key
    cols = [c for c in old.columns]
    both = (old.select(*cols).withColumn("__prio", F.lit(0))
            .unionByName(new.select(*cols).withColumn("__prio", F.lit(1))))
    rest = [c for c in cols if c not in keys]
    return (both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__prio").alias("__r"))
            .select(*keys, "__r.*"))


def ensure_categories(paths: DataFrame, tree: DataFrame, key: str = "url") -> DataFrame:
    """Add only the nodes some product lacks (new ids after the tree's max),
    merge them into the tree, and return the grown tree."""
    miss = missing_tail(paths, tree, key).filter(F.size("missing") > 0)
    nodes = (miss.select(F.explode(_prefixes(F.col("path"))).alias("path_arr"))
             .select("path_arr").distinct()
             .join(tree.select("path_arr"), "path_arr", "left_anti"))
    nodes = nodes.select("path_arr", F.element_at("path_arr", -1).alias("name"), F.size("path_arr").alias("level"),
                         F.slice("path_arr", 1, F.size("path_arr") - 1).alias("parent_path"),
                         F.array_join("path_arr", PATH_SEP).alias("path"))
    max_id = tree.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new = assign_ids(nodes, None, max_id, ["level", "path"], "id")
    lookup = (tree.select(F.col("path_arr").alias("parent_path"), F.col("id").alias("parent_id"))
              .unionByName(new.select(F.col("path_arr").alias("parent_path"), F.col("id").alias("parent_id"))))
    new = new.join(lookup, "parent_path", "left").select(
        "id", F.coalesce("parent_id", F.lit(0).cast("bigint")).alias("parent_id"), "name", "level", "path",
        "path_arr", F.lit(True).alias("created"), F.lit(True).alias("is_active"), F.lit(True).alias("is_visible"))
    return merge_tree(tree.select(*new.columns), new, "path")


def tree_summary(tree: DataFrame, brands: DataFrame) -> DataFrame:
    """G1: totals and created counts."""
    t = tree.agg(
        F.count_if(F.col("level") == 1).alias("departments"),
        F.count_if((F.col("level") == 1) & F.col("created")).alias("departments_created"),
        F.count_if(F.col("level") > 1).alias("categories"),
        F.count_if((F.col("level") > 1) & F.col("created")).alias("categories_created"))
    b = brands.agg(F.count(F.lit(1)).alias("brands"), F.count_if("created").alias("brands_created"))
    from .report import one_row
    return one_row(t, b)
