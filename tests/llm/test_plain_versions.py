"""The parts of the classifiers and rules that decide, against plain versions of them."""
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from shopsmith.llm import boosted_trees, divergence, doc_stats, quality, simhash, toxicity
from shopsmith.llm.common import stage

SF = "/root/testdata/sf0.01"


def test_flat_trees_against_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(int)
    model = boosted_trees.fit(x, y)
    state = {k: np.asarray(v) for k, v in vars(model).items() if isinstance(v, (list, np.ndarray))}
    assert model.score(x).shape == (400,) and state
    # scored one row at a time or all at once: the same walk
    assert np.allclose(model.score(x), [model.score(x[k:k + 1])[0] for k in range(len(x))])


def test_lexicon_hits_against_a_plain_scan():
    rng = np.random.default_rng(4)
    vocab = ["bad", "badly", "ad", "worse", "é", "good", "x1", "a_b", "Bad", "b4d"]
    lexicon = toxicity.Lexicon({"bad": 1.0, "ad": 0.5, "worse": 2.0}, {"good bad", "worse good"})
    word = re.compile(r"[^\W\d_]+")
    for _ in range(200):
        text = " ".join(rng.choice(vocab, 12)) + rng.choice(["", "." + "z" * 90 + " bad " + "y" * 90])
        folded = toxicity.fold(text)
        words = word.findall(folded)
        want = Counter((w, f"{words[k - 1] if k else ''} {w}", f"{w} {words[k + 1] if k + 1 < len(words) else ''}")
                       for k, w in enumerate(words) if w in lexicon.weights)
        assert Counter(lexicon.hits(folded)) == want
        total = sum(lexicon.weights[w] * n for (w, before, after), n in want.items() if before not in lexicon.exceptions and after not in lexicon.exceptions)
        assert lexicon.measure(text)[0] == math.log1p(total)


def test_every_word_over_the_ratio_is_in_the_lexicon(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    some = {r["doc_id"]: r["label"] for r in toxicity.training_labels(labels, "toxic").collect()}
    texts = {}
    for r in docs.collect():
        if r["doc_id"] in some:
            texts[r["text"] or ""] = max(some[r["doc_id"]], texts.get(r["text"] or "", 0))
    toxic, clean = Counter(), Counter()
    for t, y in texts.items():
        (toxic if y else clean).update(set(toxicity._WORD.findall(toxicity.fold(t))))
    n1 = sum(texts.values())
    n0 = len(texts) - n1
    want = {w for w in toxic if toxic[w] >= 3 and toxicity._ratio(toxic[w], clean[w], n1, n0) >= toxicity.LEAST_RATIO}
    assert set(lexicon.weights) == want and want


def test_kept_against_plain_histograms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400")
    refs = divergence.references(docs)
    sizes = {r["lang"]: (r["texts"], r["words"]) for r in divergence.language_sizes(docs).collect()}
    others = sorted(k for k, v in sizes.items() if k in refs and v[0] >= 100 and v[1] >= 10_000)
    rows = {r["doc_id"]: r for r in docs.collect()}

    def share(v):
        v = np.asarray(v, float)
        return v / v.sum() if v.sum() else v

    def distance(p, q):
        m = (p + q) / 2
        return math.sqrt(max(0, sum(0.5 * a * math.log2(a / c) for a, c in zip(p, m) if a) + sum(0.5 * b * math.log2(b / c) for b, c in zip(q, m) if b)))

    for got in divergence.quality_rules(docs).collect():
        r = rows[got["doc_id"]]
        c = doc_stats.Counts(r["text"])
        fits = False
        for name in [r["lang"] if r["lang"] in refs else "", *others]:
            classes, place, shares = refs[name]
            d1 = distance(share(c.classes), classes) if c.n_chars >= 200 else 0
            d2, lacks = 0, False
            if c.n_words >= 50 and place:
                own = Counter(place.get(w.strip(b".,;:'\"!?-()").lower(), len(place)) for w in c.words)
                d2 = distance(share([own[k] for k in range(len(shares))]), shares)
                lacks = c.n_words - own[len(place)] < 0.25 * shares[:-1].sum() * c.n_words
            fits |= d1 <= 0.25 and d2 <= 0.5 and not lacks
        assert got["kept"] == (not got["base_failed"] and fits), got["doc_id"]


def test_repeated_ids_train_the_same_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    a = [r["score"] for r in quality.classify_quality(twice.repartition(5), labels).orderBy("doc_id", "score").collect()]
    b = [r["score"] for r in quality.classify_quality(twice.repartition(2).orderBy(F.desc("text")), labels).orderBy("doc_id", "score").collect()]
    assert a == b


def test_tasks_of_a_tile_are_bounded(spark, monkeypatch):
    """one full tile and its neighbours: no comparison has many more rows than tile_rows of either kind"""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1, 1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 62, (900, 3))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    sizes = simhash.groups(df, 2, tile_rows=20).groupBy("tile", "cut", "slot", "home").count()
    fullest = df.groupBy(simhash._tile(F.col("fp"))).count().agg(F.max("count")).first()[0]
    largest = sizes.agg(F.max("count")).first()[0]
    assert fullest > 2 * 20 and largest <= 2 * 20, (fullest, largest)
    rows = simhash.links(df, 2, tile_rows=20)
    # the same links' components as without cuts
    from shopsmith.llm.components import components
    some = {r["node"]: r["root"] for r in components(rows).collect()}
    whole = {r["node"]: r["root"] for r in components(simhash.links(df, 2)).collect()}
    assert some == whole and len(some) > 100
    home, guests = np.array([1, 2, 7], np.uint64), np.array([3, 1 << 40], np.uint64)
    assert simhash.forest_of_tile(home, guests, 1, inner=False) and not simhash.forest_of_tile(home[:1], guests[1:], 1, inner=False)


def test_stages_take_odd_rows_and_any_column_name(spark):
    names = ["__keep", "__key", "__hash", "a.b", "__id", "_id", "key", "own", "_spans", "row_key", "spans", "path", "at", "value", "word", "score", "label", "fp", "rows"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({c: F.lit(c) for c in names})
    odd = [(None, None), (None, ""), (900001, None), (900002, ""), (900002, ""), (900003, "x " * 200_000), (900004, 'token = "' + "ab12" * 10 + '"')]
    docs = stage(docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True), "odd")
    columns, before = docs.columns, docs.count()
    for name, step in C.STAGES:
        out = stage(step(spark, docs, "/root/testdata/sf0.001"), "odd")
        assert step(spark, docs.filter("false"), "/root/testdata/sf0.001").count() == 0, name
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            break
        assert out.columns == columns and out.count() <= before, name
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert None in kept and 900003 in kept and 900004 in kept, name
        docs, before = out, out.count()
    assert docs.filter("doc_id = 900004 and text = 'token = \"[secret]\"'").count() == 1
