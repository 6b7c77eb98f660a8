"""Quality rules by distribution divergence: a document's character-class and common-word
histograms against those of its language, by Jensen-Shannon distance.

The references are exact counts over all documents; a task hands its counts on before they
outgrow its memory.  A document is compared with its own language and, where that does not
fit, with the others; it is kept if one language fits both ways
and the document has enough of its common words.  Texts below the length
guards are not judged by histogram.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_lists, stage
from .doc_stats import CLASSES, Counts, class_bytes

#: Rules of the base part.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
#: Distances (0 to 1) above which a histogram does not fit.
CLASS_DISTANCE, WORD_DISTANCE = 0.25, 0.50
#: A document's least share of common words, as a part of the reference's share of them: no
#: distance tells a text without any where they are a small part of the language.
LEAST_COMMON = 0.25
#: Length guards: characters for classes, words for the common words.
LEAST_CHARS, LEAST_HISTOGRAM_WORDS = 200, 50
#: Common words of a reference; distinct words and bytes of text counted at a time in a task.
COMMON_WORDS, TASK_WORDS, TASK_BYTES = 64, 100_000, 1 << 26
#: References: the languages with most words; others are compared with all documents'.
MOST_LANGUAGES = 1_000
#: Distinct texts and words of a language that gets a reference of its own (smaller ones are
#: compared with all documents'), and of one whose reference other languages may fit.
LEAST_OWN, LEAST_FOR_OTHERS = (20, 1_000), (100, 10_000)


def bare(word: bytes) -> bytes:
    """Lower-cased (ASCII), without full stops and the like at its ends."""
    return word.strip(b".,;:'\"!?-()").lower()


class _Counter:
    """Per task: class bytes and word counts by language, handed on whenever they reach
    ``task_words`` words or stand for TASK_BYTES of text; Spark adds them up."""

    task_words = TASK_WORDS

    def __init__(self):
        self.clear()

    def clear(self):
        self.words: dict[str, Counter[bytes]] = {}
        self.classes: dict[str, np.ndarray] = {}
        self.held = self.seen = 0

    def __call__(self, rows):
        out = {"lang": [], "kind": [], "name": [], "n": []}
        for lang, text in zip(rows["lang"], rows["text"]):
            lang = lang or ""
            raw = (text or "").encode("utf-8")
            c = class_bytes(np.bincount(np.frombuffer(raw, np.uint8), minlength=256))
            self.classes[lang] = self.classes.get(lang, 0) + c
            words = self.words.setdefault(lang, Counter())
            before = len(words)
            words.update(map(bare, raw.split()))
            self.held += len(words) - before
            self.seen += len(raw)
            if self.held > self.task_words or self.seen > TASK_BYTES:
                self.hand_on(out)
        return out

    def hand_on(self, out):
        for lang, words in self.words.items():
            rows = [("word", w.decode("utf-8"), n) for w, n in words.items()]
            rows += [("class", name, int(n)) for name, n in zip(CLASSES, self.classes[lang])]
            rows.append(("words", "", words.total()))
            for c, values in zip(("kind", "name", "n"), zip(*rows)):
                out[c] += values
            out["lang"] += [lang] * len(rows)
        self.clear()

    def finish(self):
        out = {"lang": [], "kind": [], "name": [], "n": []}
        self.hand_on(out)
        return out


def language_sizes(docs: DataFrame) -> DataFrame:
    """lang, texts, words: distinct texts of every language and the words in them, copies
    counted once."""
    one = (docs.filter("lang <> '' and text is not null")
           .select("lang", F.xxhash64("text").alias("key"), F.size(F.split(F.trim("text"), r"\s+")).alias("n")).distinct())
    return stage(one.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n").alias("words")), "language-sizes")


def _at_least(sizes: DataFrame, least: tuple[int, int]) -> DataFrame:
    return sizes.filter((F.col("texts") >= least[0]) & (F.col("words") >= least[1])).select("lang")


def references(docs: DataFrame, common: int = COMMON_WORDS, task_words: int = TASK_WORDS, sizes: DataFrame | None = None) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """language -> (class shares, common word -> place, word shares with all others last) of
    the languages of LEAST_OWN; under "" the reference of all documents.  At most MOST_LANGUAGES x ``common`` numbers
    reach the driver."""
    counter = type("Counter", (_Counter,), {"task_words": task_words})
    counted = map_lists(docs.select("lang", "text"), counter, "lang string, kind string, name string, n long")
    per_lang = counted.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    per_lang = stage(per_lang, "language-counts")
    enough = _at_least(language_sizes(docs) if sizes is None else sizes, LEAST_OWN)
    large = (per_lang.filter("kind = 'words'").join(enough, "lang", "left_semi").select("lang", F.col("n").alias("total"))
             .orderBy(F.desc("total"), "lang").limit(MOST_LANGUAGES))
    every = per_lang.groupBy("kind", "name").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "kind", "name", "n")
    both = per_lang.filter("lang <> ''").join(F.broadcast(large.select("lang")), "lang", "left_semi").unionByName(every)
    # at most MOST_LANGUAGES + 1 rows
    totals = both.filter("kind = 'words'").select("lang", F.col("n").alias("total"))
    # a word of at least 1/2000 of a language's words: at most 2000 a language to order
    frequent = both.filter("kind = 'word' and name <> ''").join(F.broadcast(totals), "lang").filter("n * 2000 >= total")
    best = frequent.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "name"))).filter(F.col("at") <= common)
    rows = best.select("lang", "kind", "name", "n").unionByName(both.filter("kind <> 'word'")).collect()
    out = {}
    for lang in sorted({r["lang"] for r in rows}):
        own = [r for r in rows if r["lang"] == lang]
        total = next((r["n"] for r in own if r["kind"] == "words"), 0)
        by_class = {r["name"]: r["n"] for r in own if r["kind"] == "class"}
        words = sorted((r["name"], r["n"]) for r in own if r["kind"] == "word")
        shares = np.array([n for _, n in words] + [max(0, total - sum(n for _, n in words))], float)
        out[lang] = (_shares(np.array([by_class.get(c, 0) for c in CLASSES], float)),
                     {w.encode(): k for k, (w, _) in enumerate(words)}, _shares(shares))
    return out


def _shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum()
    return counts / total if total else counts


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two histograms of shares: root of the divergence in bits, 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, terms.sum() / 2)))


def distances(counts: Counts, reference) -> tuple[float, float]:
    """(class distance, common-word distance); 0 where a length guard holds."""
    classes, place, shares = reference
    d_class = jensen_shannon(_shares(counts.classes), classes) if counts.n_chars >= LEAST_CHARS else 0.0
    if counts.n_words < LEAST_HISTOGRAM_WORDS or not place:
        return d_class, 0.0
    own = np.zeros(len(shares))
    rest = len(place)
    for w in counts.words:
        own[place.get(bare(w), rest)] += 1
    return d_class, jensen_shannon(_shares(own), shares)


def lacks_common_words(counts: Counts, reference) -> bool:
    """Fewer common words than LEAST_COMMON of the reference's share?  False where a guard holds."""
    _, place, shares = reference
    if counts.n_words < LEAST_HISTOGRAM_WORDS or not place:
        return False
    return sum(bare(w) in place for w in counts.words) < LEAST_COMMON * shares[:-1].sum() * counts.n_words


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance (to the language that fits best), kept.

    Null or empty text: no words, so the base rule fails.  A null or unknown language is
    compared with the reference of all documents first, as is one too small for its own.  Repeated rows are judged each;
    other columns are ignored; an empty table gives none.
    """
    sizes = language_sizes(docs)
    known = references(docs, sizes=sizes)
    # of these, at most MOST_LANGUAGES
    others = sorted(r["lang"] for r in _at_least(sizes, LEAST_FOR_OTHERS).filter(F.col("lang").isin(list(known))).collect())

    def run(rows):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {"doc_id": rows["doc_id"]} | {c: [] for c in (*names, "base_failed", "class_distance", "word_distance", "kept")}
        for lang, text in zip(rows["lang"], rows["text"]):
            c = Counts(text)
            for n in names:
                out[n].append(getattr(c, n))
            failed = c.n_words < LEAST_WORDS or 100 * c.n_repeat_words > MOST_REPEAT_PERCENT * c.n_words
            best, fits = None, False
            first = lang if lang in known else ""
            for name in [first, *(k for k in others if k != first)] if known else []:
                d = distances(c, known[name])
                ratio = max(d[0] / CLASS_DISTANCE, d[1] / WORD_DISTANCE)
                if best is None or ratio < best[0]:
                    best = (ratio, d)
                if ratio <= 1 and not lacks_common_words(c, known[name]):
                    fits = True
                    break
            out["base_failed"].append(failed)
            out["class_distance"].append(best[1][0] if best else 0.0)
            out["word_distance"].append(best[1][1] if best else 0.0)
            out["kept"].append(not failed and (fits or best is None))
        return out

    return map_lists(docs.select("doc_id", "lang", "text"), run,
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     "base_failed boolean, class_distance double, word_distance double, kept boolean")
