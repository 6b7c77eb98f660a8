"""Category tree resolution cases."""
from pyspark.sql import functions as F

from shopsmith.operators import tree as T


def recs(spark, rows):
    data = [(u, [{"Name": n, "Level": i + 1} for i, n in enumerate(names)], {"Name": "Acme"}) for u, names in rows]
    return spark.createDataFrame(data, "url string, categories array<struct<Name:string,Level:int>>, "
                                       "brand struct<Name:string>")


def tree_of(spark, paths, start_id=1):
    nodes, i = {}, start_id
    for p in paths:
        for n in range(1, len(p) + 1):
            k = tuple(p[:n])
            if k not in nodes:
                nodes[k] = i
                i += 1
    data = [(i, nodes.get(k[:-1], 0), k[-1], len(k), " > ".join(k), list(k)) for k, i in nodes.items()]
    return spark.createDataFrame(data, "id long, parent_id long, name string, level int, path string, "
                                       "path_arr array<string>"), nodes


def resolve(spark, tree, rows):
    r = recs(spark, rows)
    out = T.resolve_category(T.product_paths(r), tree).collect()
    return {x["url"]: x["category_id"] for x in out}


def test_resolution_rules(spark):
    tree, ids = tree_of(spark, [["Fashion", "Shoes", "Boots"], ["Tools", "Shoes"], ["Home Deco", "Lamps"]])
    got = resolve(spark, tree, [
        ("gap", ["Fashion", "Bags", "Boots"]),          # stops at the first miss
        ("second", ["Sale", "Fashion", "Shoes"]),       # department second in the list
        ("home", ["Home", "Fashion", "Shoes", "Boots"]),  # Home skipped
        ("case", ["FASHION", "shoes"]),                 # case-insensitive
        ("other_parent", ["Tools", "Shoes"]),           # same name under two parents
        ("none", ["Garden"]),
        ("any_root", ["Shoes", "Boots"]),               # no department: whole path under some department
    ])
    assert got["gap"] == ids[("Fashion",)]
    assert got["second"] == ids[("Fashion", "Shoes")]
    assert got["home"] == ids[("Fashion", "Shoes", "Boots")]
    assert got["case"] == ids[("Fashion", "Shoes")]
    assert got["other_parent"] == ids[("Tools", "Shoes")]
    assert got["none"] is None
    assert got["any_root"] == ids[("Fashion", "Shoes", "Boots")]


def test_skip_root_levels_keeps_inicio(spark):
    r = recs(spark, [("u", ["home", " ROOT ", "Default", "", "Início", "x"])])
    got = r.select(F.transform(T.skip_root_levels("categories"), lambda c: c["Name"]).alias("n")).first()["n"]
    assert got == ["Início", "x"]


def test_missing_tail_and_ensure(spark):
    tree, ids = tree_of(spark, [["Fashion", "Shoes"]])
    tree = tree.withColumn("created", F.lit(False)).withColumn("is_active", F.lit(True)) \
        .withColumn("is_visible", F.lit(True))
    r = recs(spark, [("a", ["Fashion", "Shoes", "Boots", "Winter"]), ("b", ["Garden", "Tools"]),
                     ("c", ["Fashion", "Shoes"])])
    miss = {x["url"]: (x["parent_id"], x["matched_levels"], x["missing"])
            for x in T.missing_tail(T.product_paths(r), tree).collect()}
    assert miss["a"] == (ids[("Fashion", "Shoes")], 2, ["Boots", "Winter"])
    assert miss["b"] == (0, 0, ["Garden", "Tools"])
    assert miss["c"] == (ids[("Fashion", "Shoes")], 2, [])
    grown = T.ensure_categories(T.product_paths(r), tree.select(
        "id", "parent_id", "name", "level", "path", "path_arr", "created", "is_active", "is_visible"))
    g = {x["path"]: (x["id"], x["parent_id"], x["created"]) for x in grown.collect()}
    assert len(g) == 6
    # parents exist and new ids follow the old maximum
    assert g["Fashion > Shoes > Boots"][1] == ids[("Fashion", "Shoes")]
    assert g["Garden > Tools"][1] == g["Garden"][0]
    assert min(v[0] for k, v in g.items() if v[2]) == max(ids.values()) + 1
    # resolving again now reaches the deepest level
    again = T.resolve_category(T.product_paths(r), grown).collect()
    assert {x["url"]: x["category_id"] for x in again}["a"] == g["Fashion > Shoes > Boots > Winter"][0]


def test_build_tree_reuses_existing_by_parent_path(spark):
    existing = spark.createDataFrame([(1, 0, "FASHION"), (2, 1, "shoes"), (3, 0, "Tools"), (4, 3, "Bags")],
                                     "id long, parent_id long, name string")
    r = recs(spark, [("a", ["Fashion", "Shoes"]), ("b", ["Fashion", "Bags"]), ("c", ["Tools"])])
    t = {x["path"]: (x["id"], x["parent_id"], x["created"]) for x in T.build_category_tree(r, existing).collect()}
    assert t["Fashion"] == (1, 0, False)
    assert t["Fashion > Shoes"] == (2, 1, False)
    assert t["Fashion > Bags"] == (5, 1, True)      # 'Bags' exists, but under Tools (Q2)
    assert t["Tools"] == (3, 0, False)


def test_brands(spark):
    r = spark.createDataFrame([("a", {"Name": " Acme "}), ("b", {"Name": "ACME"}), ("c", {"Name": "Default"}),
                               ("d", {"Name": None})], "url string, brand struct<Name:string>")
    ex = spark.createDataFrame([(7, "Acme")], "id long, name string")
    dim = {x["name"]: (x["id"], x["created"]) for x in T.build_brand_dim(r, ex).collect()}
    assert dim == {"Acme": (7, False), "ACME": (8, True)}
    p = spark.createDataFrame([("x", "acme "), ("y", "Nope")], "url string, brand_name string")
    res = {x["url"]: x["brand_id"] for x in T.resolve_brand(p, T.build_brand_dim(r, ex)).collect()}
    assert res == {"x": 7, "y": None}
