"""Catalog-building queries: tree, brands, products, SKUs (with DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import products as P
from ..operators import tree as T
from .catalog import Catalog
from .registry import duck_title, query

# ----------------------------------------------------------------- oracle pieces
# Normalised product paths, tree nodes, existing paths and the final tree with ids,
# written directly against the flat views.
_PATHS = f"""
cats as (select product_key, level, {duck_title('trim(name)')} as nname from v_categories
         where name is not null and trim(name) <> '' and lower(trim(name)) not in ('home','root','default')),
paths as (select product_key, list(nname order by level) as path from cats group by product_key),
nodes as (select distinct array_to_string(list_slice(path, 1, n), ' > ') as path, cast(n as integer) as level,
                 path[n] as name, array_to_string(list_slice(path, 1, n - 1), ' > ') as parent_path
          from (select path, unnest(range(1, len(path) + 1)) as n from paths) x),
expaths as (select id, {duck_title('trim(name)')} as path from v_existing_l1
            union all select c.id, {duck_title('trim(p.name)')} || ' > ' || {duck_title('trim(c.name)')}
            from v_existing_l2 c join v_existing_l1 p on c.parent_id = p.id),
exbest as (select path, min(id) as id from expaths group by path),
maxid as (select coalesce(max(id), 0) as m from v_existing_categories),
numbered as (select n.*, e.id as existing_id,
               row_number() over (partition by e.id is null order by n.level, n.path) as rn
             from nodes n left join exbest e on e.path = n.path),
tree as (select coalesce(existing_id, (select m from maxid) + rn) as id, path, level, name, parent_path,
                existing_id is null as created from numbered),
tree2 as (select t.id, coalesce(p.id, 0) as parent_id, t.name, t.level, t.path, t.created
          from tree t left join tree p on p.path = t.parent_path)"""

_BRANDS = """
brands as (select distinct trim(brand) as name from v_products where brand is not null and trim(brand) <> ''
           and trim(brand) <> 'Default'),
exb as (select trim(name) as name, min(id) as id from v_existing_brands group by 1),
bmax as (select coalesce(max(id), 0) as m from v_existing_brands),
bnum as (select b.name, e.id as existing_id,
           row_number() over (partition by e.id is null order by b.name) as rn from brands b left join exb e using (name)),
bdim as (select coalesce(existing_id, (select m from bmax) + rn) as id, name, existing_id is null as created from bnum)"""

# products: full path resolves (every product's first entry is a department of the
# tree built from the same records); brand by lower-cased name, lowest id.
_PRODUCTS = """
pcat as (select p.product_key, t.id as category_id from paths p
         join tree2 t on t.path = array_to_string(p.path, ' > ')),
bl as (select lower(name) as k, min(id) as id from bdim group by 1),
pb as (select product_key, p.url, p.name, c.category_id, b.id as brand_id from v_products p
       left join pcat c using (product_key) left join bl b on b.k = lower(trim(p.brand))),
prod as (select product_key as id, url, name, category_id, brand_id from pb
         where category_id is not null and brand_id is not null)"""

_SKUS = """
sk as (select p.id as product_id, p.url, s.sku_id, 'Variant ' || cast(s.variant_no as varchar) as name,
          case when s.variant_no % 2 = 0 then 'REF-' || cast(s.sku_id as varchar) else cast(s.sku_id as varchar) end
            as ref_id,
          coalesce(nullif(s.price, 0), 0) as price, coalesce(nullif(s.list_price, 0), nullif(s.price, 0), 0) as list_price
        from prod p join v_skus s on s.product_key = p.id
        union all
        select p.id, p.url, null, 'Default', null, 0.0, 0.0 from prod p
        where not exists (select 1 from v_skus s where s.product_key = p.id)),
skmax as (select coalesce(max(sku_id), 0) as m from sk),
skids as (select coalesce(sku_id, (select m from skmax)
            + row_number() over (partition by sku_id is null order by product_id)) as id, * exclude (sku_id) from sk)"""

_CAT_VIEWS = ("v_categories", "v_existing_categories")


def _cat(spark, sf):
    return Catalog.of(spark, sf)


@query("catalog_by_department", f"""
with {_PATHS}, {_BRANDS}, {_PRODUCTS}, {_SKUS}
select t.name as department, count(distinct s.product_id) as n_products, count(*) as n_skus,
       cast(sum(cast(s.price as decimal(12,2))) as decimal(18,2)) as total_price
from skids s join prod p on p.id = s.product_id join tree2 c on c.id = p.category_id
join tree2 t on t.path = split_part(c.path, ' > ', 1)
group by t.name""", _CAT_VIEWS + ("v_products", "v_existing_brands", "v_skus"))
def catalog_by_department(spark, sf):
    """Flagship: products per department with SKU count and total price."""
    c = _cat(spark, sf)
    tree = c.tree.select(F.col("id").alias("category_id"), F.element_at("path_arr", 1).alias("department"))
    prod = c.products.select(F.col("id").alias("product_id"), "category_id").join(tree, "category_id")
    sk = c.skus.select("product_id", "price").join(prod, "product_id")
    return sk.groupBy("department").agg(
        F.count_distinct("product_id").alias("n_products"), F.count(F.lit(1)).alias("n_skus"),
        F.sum(F.col("price").cast("decimal(12,2)")).cast("decimal(18,2)").alias("total_price"))


@query("skip_root_levels", f"""
select product_key, cast(count(*) as integer) as n_levels from v_categories
where name is not null and trim(name) <> '' and lower(trim(name)) not in ('home','root','default')
group by product_key""", ("v_categories",))
def q_skip_root_levels(spark, sf):
    r = _cat(spark, sf).records
    return r.select("product_key", F.size(T.skip_root_levels("categories")).alias("n_levels"))


@query("build_departments", f"with {_PATHS} select distinct path[1] as name from paths", ("v_categories",))
def q_build_departments(spark, sf):
    return T.build_departments(_cat(spark, sf).records)


@query("build_category_nodes", f"with {_PATHS} select path, level, name from nodes", ("v_categories",))
def q_build_category_nodes(spark, sf):
    return T.build_category_nodes(_cat(spark, sf).records).select("path", "level", "name")


@query("build_categories", f"""with {_PATHS}
select path, parent_path, name, level from nodes where level >= 2
union all select path, null, name, 1 from nodes n where level = 1
  and exists (select 1 from paths p where len(p.path) = 1 and p.path[1] = n.name)""", ("v_categories",))
def q_build_categories(spark, sf):
    """Categories under their parent path; a one-entry list makes its department the category."""
    nodes = T.build_category_nodes(_cat(spark, sf).records)
    single = T.product_paths(_cat(spark, sf).records).filter(F.size("path") == 1).select(
        F.col("path").alias("path_arr")).distinct()
    deep = nodes.filter(F.col("level") >= 2).select(
        "path", F.array_join("parent_path", T.PATH_SEP).alias("parent_path"), "name", "level")
    dept_as_cat = nodes.join(single, "path_arr", "left_semi").select(
        "path", F.lit(None).cast("string").alias("parent_path"), "name", "level")
    return deep.unionByName(dept_as_cat)


@query("build_brands", f"with {_BRANDS} select name from brands", ("v_products", "v_existing_brands"))
def q_build_brands(spark, sf):
    return T.build_brands(_cat(spark, sf).records)


@query("tree_paths", f"""
with {_PATHS} select id, path, case when position(' > ' in path) > 0 then 2 else 1 end as level from expaths""",
       _CAT_VIEWS)
def q_tree_paths(spark, sf):
    ex = T.tree_paths(_cat(spark, sf).inputs.existing_categories)
    return ex.select("id", "path", "level")


@query("match_existing_categories", f"""
with {_PATHS} select n.path, e.id as existing_id, e.id is null as created from nodes n left join exbest e using (path)""",
       _CAT_VIEWS)
def q_match_existing_categories(spark, sf):
    c = _cat(spark, sf)
    m = T.match_existing_categories(T.build_category_nodes(c.records), T.tree_paths(c.inputs.existing_categories))
    return m.select("path", "existing_id", "created")


@query("build_category_tree", f"with {_PATHS} select id, parent_id, name, level, path, created from tree2",
       _CAT_VIEWS)
def q_build_category_tree(spark, sf):
    return _cat(spark, sf).tree.select("id", "parent_id", "name", "level", "path", "created")


@query("match_existing_brands", f"with {_BRANDS} select b.name, e.id as existing_id, e.id is null as created "
       "from brands b left join exb e using (name)", ("v_products", "v_existing_brands"))
def q_match_existing_brands(spark, sf):
    c = _cat(spark, sf)
    return T.match_existing_brands(T.build_brands(c.records), c.inputs.existing_brands)


@query("build_brand_dim", f"with {_BRANDS} select id, name, created from bdim", ("v_products", "v_existing_brands"))
def q_build_brand_dim(spark, sf):
    return _cat(spark, sf).brands


@query("tree_summary", f"""
with {_PATHS}, {_BRANDS}
select (select count(*) from tree2 where level = 1) as departments,
       (select count(*) from tree2 where level = 1 and created) as departments_created,
       (select count(*) from tree2 where level > 1) as categories,
       (select count(*) from tree2 where level > 1 and created) as categories_created,
       (select count(*) from bdim) as brands, (select count(*) from bdim where created) as brands_created""",
       _CAT_VIEWS + ("v_products", "v_existing_brands"))
def q_tree_summary(spark, sf):
    c = _cat(spark, sf)
    return T.tree_summary(c.tree, c.brands)


@query("resolve_category", f"with {_PATHS}, {_BRANDS}, {_PRODUCTS} select url, category_id from pb",
       _CAT_VIEWS + ("v_products", "v_existing_brands"))
def q_resolve_category(spark, sf):
    c = _cat(spark, sf)
    return T.resolve_category(T.product_paths(c.records), c.tree)


@query("resolve_category_any_root", f"""
with {_PATHS},
sub as (select id, path from tree2 where level >= 2),
roots as (select id as root_id, path as root from tree2 where level = 1),
cand as (select s.id, r.root_id, substr(s.path, length(r.root) + 4) as tail
         from sub s join roots r on split_part(s.path, ' > ', 1) = r.root),
p2 as (select product_key, p.url, array_to_string(list_slice(path, 2, len(path)), ' > ') as tail
       from paths join v_products p using (product_key) where len(path) >= 2
       and lower(path[2]) not in (select lower(name) from tree2 where level = 1))
select url, min_by(id, root_id * 1000000000 + id) as category_id from p2 join cand using (tail) group by url""",
       _CAT_VIEWS + ("v_products",))
def q_resolve_category_any_root(spark, sf):
    """J4 on paths whose department was cut off: the rest must exist below some department."""
    c = _cat(spark, sf)
    paths = T.product_paths(c.records).filter(F.size("path") >= 2).select(
        "url", F.slice("path", 2, F.size("path")).alias("path"))
    depts = c.tree.filter(F.col("level") == 1).select(F.lower("name").alias("d"))
    # drop paths whose new first entry is itself a department so only the any-root rule applies
    first = paths.select("url", F.lower(F.element_at("path", 1)).alias("d"))
    paths = paths.join(first.join(depts, "d", "left_semi").select("url"), "url", "left_anti")
    return T.resolve_category(paths, c.tree).filter(F.col("category_id").isNotNull())


@query("resolve_brand", f"with {_PATHS}, {_BRANDS}, {_PRODUCTS} select url, brand_id from pb",
       _CAT_VIEWS + ("v_products", "v_existing_brands"))
def q_resolve_brand(spark, sf):
    c = _cat(spark, sf)
    base = c.records.select("url", F.trim(F.coalesce(F.col("brand.Name"), F.lit("Default"))).alias("brand_name"))
    return T.resolve_brand(base, c.brands)


@query("build_products", f"with {_PATHS}, {_BRANDS}, {_PRODUCTS} select id, url, name, category_id, brand_id, "
       "true as is_active, true as is_visible from prod", _CAT_VIEWS + ("v_products", "v_existing_brands"))
def q_build_products(spark, sf):
    return _cat(spark, sf).products.select("id", "url", "name", "category_id", "brand_id", "is_active", "is_visible")


@query("product_rejects", f"""
with {_PATHS}, {_BRANDS}, {_PRODUCTS}
select url, name, case when category_id is null then 'no_category' else 'no_brand' end as reason from pb
where category_id is null or brand_id is null""", _CAT_VIEWS + ("v_products", "v_existing_brands"))
def q_product_rejects(spark, sf):
    return _cat(spark, sf).product_rejects


@query("build_skus", f"""
with {_PATHS}, {_BRANDS}, {_PRODUCTS}, {_SKUS}
select id, product_id, name, ref_id, 'EAN' || cast(product_id as varchar) as ean,
       cast(price as decimal(12,2)) as price, cast(list_price as decimal(12,2)) as list_price, false as is_active
from skids""", _CAT_VIEWS + ("v_products", "v_existing_brands", "v_skus"))
def q_build_skus(spark, sf):
    s = _cat(spark, sf).skus
    return s.select("id", "product_id", "name", "ref_id", "ean", F.col("price").cast("decimal(12,2)").alias("price"),
                    F.col("list_price").cast("decimal(12,2)").alias("list_price"), "is_active")


@query("flatten_products", """
select (select count(*) from v_products) as products, (select count(*) from v_categories) as product_categories,
       (select count(*) from v_skus) as skus, (select count(*) from v_specs) as specs,
       (select count(*) from v_images) as images""",
       ("v_products", "v_categories", "v_skus", "v_specs", "v_images"))
def q_flatten_products(spark, sf):
    parts = P.flatten_products(_cat(spark, sf).records)
    aggs = [parts[k].agg(F.count(F.lit(1)).alias(k)) for k in
            ("products", "product_categories", "skus", "specs", "images")]
    from ..operators.report import one_row
    return one_row(*aggs)


@query("missing_tail", f"""
with {_PATHS},
pre as (select product_key, path, n, array_to_string(list_slice(path, 1, n), ' > ') as pp
        from (select product_key, path, unnest(range(1, len(path) + 1)) as n from paths) x),
hit as (select product_key, max(n) as depth, max_by(e.id, n) as node_id from pre join exbest e on e.path = pre.pp
        group by product_key)
select p.url, coalesce(h.node_id, 0) as parent_id, cast(coalesce(h.depth, 0) as integer) as matched_levels,
       array_to_string(list_slice(x.path, coalesce(h.depth, 0) + 1, len(x.path)), ' > ') as missing
from paths x join v_products p using (product_key) left join hit h using (product_key)""",
       _CAT_VIEWS + ("v_products",))
def q_missing_tail(spark, sf):
    c = _cat(spark, sf)
    ex = T.tree_paths(c.inputs.existing_categories)
    m = T.missing_tail(T.product_paths(c.records), ex)
    return m.select("url", "parent_id", "matched_levels", F.array_join("missing", " > ").alias("missing"))


@query("ensure_categories", f"""
with {_PATHS},
known as (select path from expaths),
newn as (select n.path, n.level from nodes n where n.path not in (select path from known)),
mx as (select coalesce(max(id), 0) as m from v_existing_categories)
select id, path, false as created from expaths
union all select (select m from mx) + row_number() over (order by level, path), path, true from newn""",
       _CAT_VIEWS)
def q_ensure_categories(spark, sf):
    c = _cat(spark, sf)
    ex = T.tree_paths(c.inputs.existing_categories).withColumn("created", F.lit(False)) \
        .withColumn("is_active", F.lit(True)).withColumn("is_visible", F.lit(True))
    grown = T.ensure_categories(T.product_paths(c.records), ex.select(
        "id", "parent_id", "name", "level", "path", "path_arr", "created", "is_active", "is_visible"))
    return grown.select("id", "path", "created")


@query("upsert_products", f"""
with {_PATHS}, {_BRANDS}, {_PRODUCTS}
select coalesce(n.id, e.id) as id, coalesce(e.name, n.name) as name,
       case when n.id is not null then true else e.is_active end as is_active,
       case when n.id is not null then true else e.is_visible end as is_visible,
       case when e.id is null then 'inserted' when n.id is not null then 'kept_existing' else 'untouched' end as action
from prod n full outer join v_existing_products e on e.id = n.id""",
       _CAT_VIEWS + ("v_products", "v_existing_brands", "v_existing_products"))
def q_upsert_products(spark, sf):
    c = _cat(spark, sf)
    return P.upsert_products(c.products, c.inputs.existing_products).select("id", "name", "is_active", "is_visible", "action")


@query("products_last_wins", """
select product_key, max_by(sku_id, sku_id) as sku_id, max_by(variant_no, sku_id) as variant_no from v_skus
group by product_key""", ("v_skus",))
def q_products_last_wins(spark, sf):
    """W6 over SKU rows keyed by product: the latest (highest order) row wins."""
    s = _cat(spark, sf).inputs.skus.select("product_key", "sku_id", "variant_no", F.col("sku_id").alias("ord"))
    return P.products_last_wins(s, "ord", key="product_key").select("product_key", "sku_id", "variant_no")


@query("fill_sku_ids", """
select product_key, cast(row_number() over (partition by product_key order by sku_id) - 1 as integer) as pos,
  cast(sku_id as varchar) as sku_id, cast(product_key as varchar) as ean,
  case when variant_no % 2 = 0 then 'REF-' || cast(sku_id as varchar) else cast(product_key as varchar) end as ref_id,
  false as is_active, true as active_if_possible
from v_skus""", ("v_skus",))
def q_fill_sku_ids(spark, sf):
    r = _cat(spark, sf).records
    filled = r.select("product_key", P.fill_sku_ids("skus", F.col("product.ProductId")).alias("s"))
    return filled.select("product_key", F.posexplode("s").alias("pos", "x")).select(
        "product_key", "pos", F.col("x.SkuId").alias("sku_id"), F.col("x.EAN").alias("ean"),
        F.col("x.RefId").alias("ref_id"), F.col("x.IsActive").alias("is_active"),
        F.col("x.activeIfPossible").alias("active_if_possible"))


@query("upsert_skus", f"""
with {_PATHS}, {_BRANDS}, {_PRODUCTS}, {_SKUS},
ex as (select sku_id as id, 'old Variant ' || cast(variant_no as varchar) as name, product_key as product_id
       from v_skus where product_key % 3 = 0)
select coalesce(n.id, e.id) as id, coalesce(e.name, n.name) as name, coalesce(e.product_id, n.product_id) as product_id,
  case when e.id is null then 'inserted' when n.id is not null then 'kept_existing' else 'untouched' end as action
from skids n full outer join ex e on e.id = n.id""", _CAT_VIEWS + ("v_products", "v_existing_brands", "v_skus"))
def q_upsert_skus(spark, sf):
    c = _cat(spark, sf)
    ex = c.inputs.skus.filter(F.col("product_key") % 3 == 0).select(
        F.col("sku_id").alias("id"), F.concat(F.lit("old Variant "), F.col("variant_no").cast("string")).alias("name"),
        F.col("product_key").alias("product_id"))
    return P.upsert_skus(c.skus, ex).select("id", "name", "product_id", "action")
