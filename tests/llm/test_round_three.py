"""Resampling, exact duplicates and ranked search against plain versions, with edge rows."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopsmith.llm import exact_blocks, lexical, resampling

#: Extra columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, id string, name string, `key` string, n string, score string, terms string, `a.b` string, _id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *("x" * 8)) for i, t in rows], SCHEMA)


def words(rng, n, vocab=300):
    return " ".join(f"w{x}" for x in rng.integers(0, vocab, n))


EDGE = [(None, None), (None, "alone without id"), (7, None), (8, ""), (8, ""), (9, " \t\n "), (10, "Ünï-cödé ÀB a\x00b"), (11, "one " * 30_000)]


# ---- exact duplicates
def plain_groups(rows):
    whole = [re.sub("[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (i, _), w in zip(rows, whole):
        groups[w].append(i)
    out, seen = [], set()
    for (i, _), w in zip(rows, whole):
        ids = [x for x in groups[w] if x is not None]
        keep = min(ids) if ids else None
        first = (i, w) not in seen
        seen.add((i, w))
        out.append((i, keep, len(groups[w]), i == keep and first, hashlib.sha256(w.encode()).hexdigest()))
    return sorted(out, key=str)


def block_rows(rng):
    base = [words(rng, int(n)) for n in rng.integers(1, 120, 12)]
    rows = [(i, base[i % 12]) for i in range(40)]
    rows += [(100 + i, b + " tail") for i, b in enumerate(base)] + [(200 + i, b.replace(" ", "\n\t ")) for i, b in enumerate(base)]
    rows += [(300, "a" * 64), (301, "a" * 63), (302, "a" * 65), (303, "a" * 64), (304, "a" * 128), (305, "ab" * 32), (306, " lead"), (307, "lead")]
    return rows + EDGE + [(None, base[0]), (3, base[3]), (None, "two without id"), (None, "two without id")]


def test_exact_duplicates_against_grouping(spark):
    rows = block_rows(np.random.default_rng(1))
    for chars in (1, 7, 64, 4096):
        got = exact_blocks.exact_duplicates(docs_of(spark, rows), block_chars=chars)
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()), key=str) == plain_groups(rows)


def test_blocks_whose_hashes_collide_keep_their_own_names(spark):
    rows = block_rows(np.random.default_rng(2))
    got = exact_blocks.exact_duplicates(docs_of(spark, rows), block_chars=64, hash_of=lambda b: F.length(b).cast("long") % 3)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()), key=str) == plain_groups(rows)


def test_dropping_duplicates_keeps_columns(spark):
    rows = block_rows(np.random.default_rng(3))
    kept = exact_blocks.drop_exact_duplicates(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, []).columns
    want = sorted((r[0] for r in plain_groups(rows) if r[3]), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want
    assert exact_blocks.drop_exact_duplicates(docs_of(spark, [])).count() == 0
    assert exact_blocks.exact_duplicates(docs_of(spark, [])).count() == 0


# ---- resampling
def plain_runs(text, n):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_resample(rows, target, n, buckets, least, percent, seed):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(map(bucket, plain_runs(text, n)[1]))
    for text in target:
        t.update(map(bucket, plain_runs(text, n)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        w, runs = plain_runs(text, n)
        weight = sum(gain[bucket(r)] for r in runs)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(w), len(runs), weight, score, None])
    able = sorted((r for r in out if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (3, 97)])
def test_resampling_against_plain(spark, n, buckets):
    rng = np.random.default_rng(n)
    rows = [(i, words(rng, int(k))) for i, k in enumerate(rng.integers(0, 80, 60))] + EDGE + [(3, "Same ID other text " * 9), (3, "Same ID other text " * 9)]
    target = [words(rng, 60, 40) for _ in range(5)] + [None, ""]
    aim = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = resampling.resample(docs_of(spark, rows), aim, run_words=n, buckets=buckets, percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(rows, target, n, buckets, 20, 30, 2024)


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs_of(spark, []), empty).count() == 0
    assert {r["rank"] for r in resampling.resample(docs_of(spark, [(1, "a b"), (2, None)]), empty).collect()} == {None}


# ---- ranked search
def plain_terms(text):
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, top):
    docs = [(i, collections.Counter(plain_terms(t))) for i, t in rows]
    big_n, big_l = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    asked, out = collections.defaultdict(set), []
    for item, text in items:
        asked[item].update(plain_terms(text))
    for item, want in asked.items():
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * big_n // big_l if c else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * sum(1 for _, x in docs if t in x) + 1)))
                        * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in want if t in c)
            if score > 0 and i is not None and item is not None:
                found.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:top])]
    return sorted(out)


def search_rows(rng):
    rows = [(i, words(rng, int(k), 120)) for i, k in enumerate(rng.integers(1, 60, 150))]
    rows += [(500 + i, rows[4][1]) for i in range(15)] + [(5, rows[4][1].upper())] + EDGE
    items = [(k, words(rng, int(m), 150)) for k, m in enumerate((1, 3, 8, 30, 90, 200))]
    return rows, items + [(10, None), (11, ""), (12, "nowhere at all"), (None, "w1"), (3, "w5 w6"), (13, rows[4][1])]


@pytest.mark.parametrize("top,segment,block", [(10, 4096, 50_000), (3, 7, 40), (10, 16, 1)])
def test_search_against_plain(spark, top, segment, block):
    rows, items = search_rows(np.random.default_rng(top))
    table = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    got = lexical.search(docs_of(spark, rows).repartition(3), table, top=top, segment=segment, block_terms=block)
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == plain_search(rows, items, top)


def test_search_without_rows(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs_of(spark, [(1, "a")]), none).count() == 0
    assert lexical.search(docs_of(spark, []), some).count() == 0


def test_groups_below_the_bound_are_not_scored(monkeypatch):
    scored = []
    real = lexical.Segment.scores
    monkeypatch.setattr(lexical.Segment, "scores", lambda self, rows, docs: (scored.append(len(docs)), real(self, rows, docs))[1])
    n = 1000
    terms = np.concatenate([[0, 1] if d < 20 else [1] for d in range(n)]).astype(np.int32)
    part = lexical.Segment(np.arange(n), np.full(n, 5), np.array([2 if d < 20 else 1 for d in range(n)]), terms, np.ones(len(terms), np.int64),
                           np.array([5000, 10]), np.full(n, 100))
    best = part.search(np.array([0, 1]), [], 10)
    assert [d for _, d in best] == list(range(10)) and sum(scored) == 20
