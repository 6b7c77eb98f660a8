"""Model hooks and model output parsing.

The model itself is a user function; Spark only feeds it Arrow batches
(``mapInPandas``) or bounded batches of URLs (``applyInPandas`` on batch ids of
at most ``batch_size`` rows), then parses the text it returns with built-in
JSON functions.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import drop_trailing_commas, first_json_object, json_fault, parse_price, strip_code_fence
from ..session import spread, staged
from ..sources.tables import RECORD
from .ordering import batches

_ANSWER = T.StructType([f for f in RECORD.fields if f.name != "url"])


def _as_text(t: T.DataType) -> T.DataType:
    """The same shape with every leaf a string: models quote numbers or not as they like."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in t.fields])
    return T.ArrayType(_as_text(t.elementType)) if isinstance(t, T.ArrayType) else T.StringType()


def _typed(c: Column, t: T.DataType) -> Column:
    """``c`` (of ``_as_text(t)``) with its leaves as ``t`` has them; prices by F10."""
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_typed(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _typed(x, t.elementType))
    if isinstance(t, T.DoubleType):
        return F.when(c.isNotNull(), F.coalesce(c.try_cast("double"), parse_price(c)))
    return c if isinstance(t, T.StringType) else c.try_cast(t)


_PARSE_SCHEMA = T.StructType(_as_text(_ANSWER).fields + [T.StructField("_corrupt_record", T.StringType())])


def cleaned_json(text_col: str = "text"):
    """F18 chain: unfence, cut to the outer object, drop trailing commas."""
    return drop_trailing_commas(first_json_object(strip_code_fence(F.col(text_col))))


def parse_model_json(responses: DataFrame, key: str = "url", text_col: str = "text",
                     context: int = 200) -> tuple[DataFrame, DataFrame]:
    """(records, rejects).  A response that is not one complete JSON object is
    rejected with its text, the place (``fault_at``) in the cleaned object where it stops
    being JSON and up to ``context`` characters on either side; without an object the
    context is the end of the text.  Nothing is guessed shut (Q24).  A field of
    another scalar type (a price as text, an id as number) is converted; one that
    cannot be is null (prices 0, as F10)."""
    c = responses.select(key, text_col, cleaned_json(text_col).alias("__json"))
    raw = F.from_json("__json", _PARSE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})

    def judged(r: Column) -> Column:
        bad = (F.col("__json") == "") | r.isNull() | r["_corrupt_record"].isNotNull() | r["product"].isNull()
        record = F.struct(*[(F.coalesce(_typed(r["categories"], _ANSWER["categories"].dataType), F.when(
            r["category"].isNotNull(), F.array(_typed(r["category"], _ANSWER["category"].dataType)))) if f.name == "categories"
            else _typed(r[f.name], f.dataType)).alias(f.name) for f in _ANSWER.fields if f.name != "category"])
        return F.struct(F.coalesce(bad, F.lit(True)).alias("bad"), F.when(~F.coalesce(bad, F.lit(True)), record).alias("record"))

    # bound to a lambda variable, a text is parsed once; written, both results come from that
    parsed = c.withColumn("__p", F.get(F.transform(F.array(raw), judged), F.lit(0)))
    only_bad = lambda name: F.when(F.col("__p.bad"), F.col(name)).alias(name)
    parsed = staged(parsed.select(key, only_bad(text_col), only_bad("__json"), "__p"), "model-records")
    good = parsed.filter("not __p.bad").select(key, "__p.record.*")
    # an object that is JSON but has no product has no fault; its context is its end
    rejects = parsed.filter("__p.bad").select(key, text_col, F.nullif(F.col("__json"), F.lit("")).alias("__json")).withColumn("fault_at", json_fault("__json"))
    place = F.substring("__json", F.greatest(F.col("fault_at") - context, F.lit(0)) + 1, F.least(F.col("fault_at"), F.lit(context)) + context)
    rejects = rejects.select(
        key, text_col, F.when(F.col("__json").isNull(), "no JSON object").otherwise("invalid JSON").alias("reason"),
        F.coalesce(place, F.right(F.coalesce("__json", F.col(text_col)), F.lit(context))).alias("context"), "fault_at")
    return good, rejects


def with_extractor(pages: DataFrame, fn, key: str = "url", instructions: str | None = None,
                   pages_per_batch: int = 64) -> DataFrame:
    """The user's model maps (html, url, instructions) to JSON text, one Arrow
    batch of pages at a time; the result goes to ``parse_model_json``.  Answers are
    stored once, so a page is asked once however often they are read."""
    p = pages.select(*dict.fromkeys([key, "url"]), "html")
    schema = T.StructType([f for f in p.schema.fields if f.name != "html"] + [T.StructField("text", T.StringType())])

    def run(it):
        for pdf in it:
            for start in range(0, len(pdf), pages_per_batch):
                part = pdf.iloc[start:start + pages_per_batch]
                texts = [fn(h, u, instructions) for h, u in zip(part["html"], part["url"])]
                out = part.drop(columns=["html"]).copy()
                out["text"] = texts
                yield out

    return staged(spread(p).mapInPandas(run, schema), "model-answers")


#: Of several classes for a URL the first of these counts.
CLASS_PRIORITY = ["definitely_pdp", "possibly_pdp", "not_pdp"]


def with_url_reviewer(urls: DataFrame, fn, batch_size: int = 100, retries: int = 3, url_col: str = "url",
                      wait: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The user's model classifies up to ``batch_size`` URLs per call and
    returns {class: [urls]}; a batch that still fails after ``retries`` tries is
    skipped and its URLs go to rejects, as do URLs the answer leaves out
    (``unclassified``).  Every URL comes back once: of several classes the first of
    ``CLASS_PRIORITY``, then the answer's order, counts.  Batches come from
    ``with_index``, so each group holds at most ``batch_size`` rows; answers are
    stored once, so a batch is asked once."""
    b = batches(urls.select(url_col).distinct(), url_col, batch_size)
    schema = "batch_id long, url string, class string, error string"
    columns = ["batch_id", "url", "class", "error"]

    def review(pdf: pd.DataFrame) -> pd.DataFrame:
        bid = int(pdf["batch_id"].iloc[0])
        items = list(pdf[url_col])
        err = None
        for attempt in range(retries):
            try:
                answer = fn(items)
                ranked = [c for c in CLASS_PRIORITY if c in answer] + [c for c in answer if c not in CLASS_PRIORITY]
                named = {}
                for cls in ranked:
                    for u in answer[cls]:
                        named.setdefault(u, cls)
                return pd.DataFrame([(bid, u, named.get(u), None if u in named else "unclassified") for u in items],
                                    columns=columns)
            except Exception as e:  # noqa: BLE001
                err = str(e)[:200]
                if wait:
                    time.sleep(wait * (2 ** attempt))
        return pd.DataFrame([(bid, u, None, err) for u in items], columns=columns)

    out = staged(b.groupBy("batch_id").applyInPandas(review, schema), "reviews")
    out = out.withColumnRenamed("url", url_col) if url_col != "url" else out
    return out.filter(F.col("class").isNotNull()).drop("error"), out.filter(F.col("class").isNull())
