"""Ordered operators as set logic, checked against small sequential versions."""
import random

import pytest
from pyspark.sql import functions as F

from shopsmith.operators import crawl as C
from shopsmith.operators import ordering as O
from shopsmith.operators import quality as Q


def test_with_index_independent_of_partitioning(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("k"))
    a = {r["k"]: r["i"] for r in O.with_index(df.repartition(1), "k", "i", partitions=1).collect()}
    b = {r["k"]: r["i"] for r in O.with_index(df.repartition(7), "k", "i", partitions=7).collect()}
    assert a == b == {k: k for k in range(500)}


@pytest.mark.parametrize("n,exp", [(3, [0, 3, 6]), (4, [0, 2, 4, 6]), (7, list(range(7))), (10, list(range(10))),
                                   (15, list(range(10)))])
def test_even_sample(spark, n, exp):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert sorted(r["k"] for r in O.even_sample(df, n, "k").collect()) == exp


def test_even_sample_rejects_non_positive(spark):
    with pytest.raises(ValueError):
        O.even_sample(spark.range(3), 0, "id")


def test_batches_and_ids(spark):
    df = spark.range(250).withColumnRenamed("id", "k")
    b = O.batches(df, "k", 100).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in b] == [100, 100, 50]
    pres = spark.createDataFrame([(1, 10), (2, None), (3, None), (4, 3)], "k long, p long")
    ids = {r["k"]: r["id"] for r in O.assign_ids(pres, "p", 5, "k").collect()}
    assert ids == {1: 10, 4: 3, 2: 11, 3: 12}


def seq_cutoff(outcomes, limit=3):
    n, stop, out = 0, None, []
    for i, o in enumerate(outcomes):
        if stop is not None:
            out.append("not_attempted")
            continue
        if o == "rate_limit":
            n += 1
        elif o in ("ok", "other_error"):
            n = 0
        out.append(o)
        if n >= limit:
            stop = i
    return out


@pytest.mark.parametrize("chunk", [2, 3, 4096])
def test_attempt_cutoff_against_sequential(spark, chunk):
    rnd = random.Random(7)
    runs = {r: [rnd.choice(["rate_limit", "rate_limit", "ok", "non_200", "other_error"]) for _ in range(30)]
            for r in range(12)}
    runs[99] = ["rate_limit", "rate_limit", "ok", "rate_limit", "non_200", "rate_limit", "rate_limit", "ok"]
    data = [(r, p, o) for r, seq in runs.items() for p, o in enumerate(seq)]
    df = spark.createDataFrame(data, "run_id long, pos long, outcome string")
    got = {}
    for row in Q.attempt_cutoff(df, chunk_size=chunk).collect():
        got.setdefault(row["run_id"], {})[row["pos"]] = row["status"]
    for r, seq in runs.items():
        assert [got[r][p] for p in range(len(seq))] == seq_cutoff(seq), r


def test_listing_harvest_cases(spark):
    rows = [  # category 1: page 3 repeats page 2 -> stop at 3
        (1, 1, 10, 200), (1, 1, 11, 200), (1, 2, 12, 200), (1, 3, 12, 200), (1, 4, 13, 200),
        # category 2: 500 on page 2
        (2, 1, 20, 200), (2, 2, 21, 500), (2, 3, 22, 200),
        # category 3: page 2 missing
        (3, 1, 30, 200), (3, 3, 31, 200),
        # category 4: also lists 10 (dedupe keeps category 1)
        (4, 1, 10, 200), (4, 1, 40, 200)]
    df = spark.createDataFrame(rows, "category_no long, page int, product_key long, status int")
    kept = C.harvest_first_seen(C.listing_harvest(df, 20))
    got = {r["product_key"]: (r["category_no"], r["page"]) for r in kept.collect()}
    assert got == {10: (1, 1), 11: (1, 1), 12: (1, 2), 20: (2, 1), 30: (3, 1), 40: (4, 1)}


def seq_crawl(links, seed, max_pages):
    out = {}
    for s, d, p in sorted(links, key=lambda x: (x[0], x[2])):
        out.setdefault(s, []).append(d)
    queue, visited, found, count = [seed], [], set(), 0
    while queue and count < max_pages:
        cur = queue.pop(0)
        if cur in visited:
            continue
        visited.append(cur)
        count += 1
        found.add(cur)
        for d in out.get(cur, []):
            found.add(d)
            if d not in visited:
                queue.append(d)
    return visited, found


@pytest.mark.parametrize("cap", [1, 5, 17, 1000])
def test_crawl_reach_matches_fifo_walk(spark, cap):
    rnd = random.Random(cap)
    links = sorted({(s, rnd.randrange(60), p) for s in range(60) for p in range(rnd.randrange(4))})
    links = [(s, d, p) for s, d, p in links]
    ldf = spark.createDataFrame(links, "src long, dst long, pos int")
    seeds = spark.createDataFrame([(0, 0)], "node long, ord int")
    res = C.crawl_reach(ldf, seeds, max_pages=cap).collect()
    visited, found = seq_crawl(links, 0, cap)
    got_visited = [r["node"] for r in sorted((r for r in res if r["visited"]), key=lambda r: r["visit_rank"])]
    assert got_visited == visited
    assert {r["node"] for r in res} == found


def seq_harvest(pages_by_cat, max_pages=20):
    """The listing walk written as the loop it replaces."""
    out = []
    for cat in sorted(pages_by_cat):
        seen, last = [], -1
        for page in range(1, max_pages + 1):
            entry = pages_by_cat[cat].get(page)
            if entry is None or entry[0] != 200 or not entry[1]:
                break
            for item in entry[1]:
                if item not in seen:
                    seen.append(item)
            if len(seen) == last:
                break
            last = len(seen)
        out += [(cat, item) for item in seen]
    first = {}
    for cat, item in out:
        first.setdefault(item, cat)
    return first


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_listing_harvest_against_loop(spark, seed):
    rnd = random.Random(seed)
    pages_by_cat, rows = {}, []
    for cat in range(8):
        pages_by_cat[cat] = {}
        for page in range(1, rnd.randrange(2, 9)):
            if rnd.random() < 0.1:
                continue  # missing page
            status = 500 if rnd.random() < 0.1 else 200
            items = sorted({rnd.randrange(30) for _ in range(rnd.randrange(1, 5))})
            pages_by_cat[cat][page] = (status, items)
            rows += [(cat, page, it, status) for it in items]
    df = spark.createDataFrame(rows, "category_no long, page int, product_key long, status int")
    got = {r["product_key"]: r["category_no"] for r in C.harvest_first_seen(C.listing_harvest(df, 20)).collect()}
    assert got == seq_harvest(pages_by_cat)


def test_retry_numbering_across_chunks(spark):
    rnd = random.Random(5)
    rows = [(k, p) for k in range(6) for p in sorted(rnd.sample(range(200), rnd.randrange(1, 40)))]
    rows += [(99, p) for p in range(0, 300, 2)]  # one hot key
    df = spark.createDataFrame(rows, "key long, pos long")
    small = {(r["key"], r["pos"]): (r["retry"], r["wait_sec"], r["gives_up"])
             for r in Q.retry_schedule(df, "key", "pos", chunk_size=3).collect()}
    exp = {}
    for k in {r[0] for r in rows}:
        for i, p in enumerate(sorted(p for kk, p in rows if kk == k)):
            exp[(k, p)] = (i, min(2.0 * 2.0 ** i, 120.0) if i < 5 else None, i >= 5)
    assert small == exp


def test_places_write_keys_only(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"), F.repeat(F.lit("x"), 500).alias("wide"))
    ranks = O.places(df, ["k"], "i")
    assert ranks.columns == ["k", "__copy", "i"]
    assert {(r["k"], r["batch_id"], r["batch_pos"]) for r in O.batches(df, "k", 30).collect()} == {(k, k // 30, k % 30) for k in range(100)}


def test_repeated_and_null_keys_have_places_of_their_own(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (1, "b"), (2, "d"), (None, "e")], "k long, v string")
    got = O.batches(df, "k", 2).collect()
    assert sorted((r["batch_id"], r["batch_pos"]) for r in got) == [(b, p) for b in range(3) for p in range(2)]
    assert sorted(r["v"] for r in got) == sorted("abcbde") and [r["k"] for r in got if r["batch_id"] == 0] == [None, None]
    assert O.even_sample(df, 3, "k").count() == 3
    assert O.batches(df.filter("false"), "k", 2).count() == 0


def test_cutoff_of_one_long_sparse_run(spark):
    """One run of far-apart positions over three levels of groups, beside short ones."""
    rnd = random.Random(11)
    runs = {5: [rnd.choice(["rate_limit", "non_200", "non_200", "ok"]) for _ in range(900)] + ["non_200"] * 700 + ["rate_limit"] * 3 + ["ok"] * 40}
    runs |= {r: [rnd.choice(["rate_limit", "ok", None]) for _ in range(rnd.randrange(1, 9))] for r in (1, 2, 3, 6, 7, 8)}
    data = [(r, p * 1_000_003, o) for r, seq in runs.items() for p, o in enumerate(seq)]
    got = Q.attempt_cutoff(spark.createDataFrame(data, "run_id long, pos long, outcome string"), max_consecutive=40, chunk_size=10).collect()
    for r, seq in runs.items():
        n, want = 0, []
        for o in seq:
            n = n + 1 if o == "rate_limit" else 0 if o in ("ok", "other_error") else n
            want.append(n)
        assert [x["consecutive_limits"] for x in sorted((x for x in got if x["run_id"] == r), key=lambda x: x["pos"])] == want


def test_capped_crawl_of_a_long_chain(spark):
    """The key stays one rank and one position however deep the crawl goes."""
    links = spark.createDataFrame([(i, i + 1, 0) for i in range(60)] + [(i, i + 1000, 1) for i in range(60)], "src long, dst long, pos int").coalesce(1)
    seeds = spark.createDataFrame([(0, 0)], "node long, ord int")
    order = C._visiting_order(links, seeds, 10_000, None)
    assert order.columns == ["node", "rank", "hop"] and [t.simpleString() for t in (order.schema["rank"].dataType, order.schema["hop"].dataType)] == ["bigint", "int"]
    got = [r["node"] for r in sorted(order.collect(), key=lambda r: r["rank"])]
    assert got == [0] + [x for i in range(60) for x in (i + 1, i + 1000)]
