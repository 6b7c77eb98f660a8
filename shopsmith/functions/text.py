"""Scalar text functions (F1-F4, F10-F16, F18), all built from Spark SQL
functions so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Python ``str.strip()`` for whitespace."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def _is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


# Python's title(): a letter starts a word when the previous character is not a
# cased letter.  Cut the string into runs of cased letters / everything else and
# capitalise the first letter of each run.
_RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def _title_first(ch: Column) -> Column:
    # title-case mapping differs from upper-case for the sharp s
    return F.when(ch == "ß", F.lit("Ss")).otherwise(F.upper(ch))


def title_case(c: ColumnOrName) -> Column:
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(_RUNS), 1)
    return F.array_join(F.transform(
        runs, lambda p: F.concat(_title_first(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), "")


def normalize_category_name(c: ColumnOrName) -> Column:
    """trim + title case; blank or null returned unchanged."""
    c = _c(c)
    return F.when(_is_blank(c), c).otherwise(title_case(strip(c)))


def normalize_spec_name(c: ColumnOrName) -> Column:
    """trim, first character upper, the rest lower; blank unchanged."""
    c = _c(c)
    s = strip(c)
    return F.when(_is_blank(c), c).otherwise(
        F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, 2, 1 << 30))))


def normalize_brand_name(c: ColumnOrName) -> Column:
    """trim, case kept."""
    c = _c(c)
    return F.when(c.isNull() | (c == ""), c).otherwise(strip(c))


def extract_id(c: ColumnOrName) -> Column:
    """whole integer text (sign and digit-group ``_`` allowed), else the first
    digit run, else null; values beyond BIGINT give null."""
    s = strip(_c(c).cast("string"))
    whole = F.when(s.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(s, "_", ""))
    first_run = F.regexp_extract(s, r"(\d+)", 1)
    return F.coalesce(
        whole.try_cast("bigint"),
        F.when(whole.isNull() & (first_run != ""), first_run.try_cast("bigint")))


def parse_price(c: ColumnOrName, decimal_sep: str = ".") -> Column:
    """number from price text; currency signs and thousands separators
    removed; missing or unreadable -> 0.0."""
    s = _c(c).cast("string")
    if decimal_sep == ",":
        s = F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")
    else:
        s = F.regexp_replace(s, ",", "")
    num = F.regexp_extract(s, r"(-?\d+(?:\.\d+)?)", 1)
    return F.coalesce(F.when(num != "", num.try_cast("double")), F.lit(0.0))


def nonzero(c: ColumnOrName) -> Column:
    c = _c(c)
    return F.when(c != 0, c)


def sku_price(price: ColumnOrName) -> Column:
    """``Price or 0``."""
    return F.coalesce(nonzero(price), F.lit(0.0)).cast("double")


def sku_list_price(list_price: ColumnOrName, price: ColumnOrName) -> Column:
    """``ListPrice or Price or 0`` (0 counts as missing)."""
    return F.coalesce(nonzero(list_price), nonzero(price), F.lit(0.0)).cast("double")


def short_description(short: ColumnOrName, description: ColumnOrName) -> Column:
    """given short text, else first 200 characters of the description, else ''."""
    short, description = _c(short), _c(description)
    return F.coalesce(F.when(short != "", short),
                      F.when(description != "", F.left(description, F.lit(200))), F.lit(""))


def seo_title(meta_title: ColumnOrName, name: ColumnOrName, category: ColumnOrName,
              brand: ColumnOrName) -> Column:
    """meta title, else ``Name | Category | Brand`` (missing parts skipped)."""
    mt = _c(meta_title)
    return F.coalesce(F.when(strip(mt) != "", strip(mt)),
                      F.concat_ws(" | ", _c(name), _c(category), _c(brand)))


def keywords(meta_keywords: ColumnOrName, name: ColumnOrName, brand: ColumnOrName,
             categories: ColumnOrName) -> Column:
    """meta keywords, else name, brand and category names joined by ', '."""
    mk = _c(meta_keywords)
    return F.coalesce(F.when(strip(mk) != "", strip(mk)),
                      F.concat_ws(", ", _c(name), _c(brand), _c(categories)))


# Platform field type ids by type name.
FIELD_TYPE_IDS = {"Text": 1, "Number": 2, "Toggle": 3, "Combo": 4, "Radio": 5, "Color": 6, "Date": 7}


def field_type_id(c: ColumnOrName) -> Column:
    """id of a specification field type, 1 (Text) for anything unknown."""
    m = F.create_map(*[x for k, v in FIELD_TYPE_IDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(c)), F.lit(1))


def field_type_overrides(c: ColumnOrName) -> Column:
    """F16: ``name=Type`` / ``name: Type`` pairs from free text, only when it speaks
    of a field type; a leading ``...Overrides:`` label is removed first."""
    s = _c(c)
    body = F.regexp_replace(s, r"(?i)^.*?field\s*type\s*overrides?\s*[:\-]?", "")
    pair = r"(\w+)\s*[=:]\s*(\w+)"
    names = F.regexp_extract_all(body, F.lit(pair), 1)
    types = F.transform(F.regexp_extract_all(body, F.lit(pair), 2),
                        lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 1 << 30))))
    return F.when(F.lower(s).contains("field type"), F.map_from_arrays(names, types))


def strip_code_fence(c: ColumnOrName) -> Column:
    """drop a surrounding markdown code fence."""
    s = strip(_c(c))
    return strip(F.regexp_replace(F.regexp_replace(s, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def first_json_object(c: ColumnOrName) -> Column:
    """text from the first ``{`` to the last ``}``."""
    return F.regexp_extract(_c(c), r"(?s)(\{.*\})", 1)


def drop_trailing_commas(c: ColumnOrName) -> Column:
    """``,}`` and ``,]`` -> ``}`` / ``]``."""
    return F.regexp_replace(_c(c), r",\s*([}\]])", "$1")


#: Pieces of a JSON text: an escaped character, one sign of the grammar, or what lies between.
_JSON_PIECES = r"""(?s)\\u[0-9A-Fa-f]{4}|\\.|["{}\[\]:,]|[^\\"{}\[\]:,]++|\\"""
_JSON_SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"
_JSON_BLANK = r"^[\x20\t\r\n]*$"


def json_fault(c) -> Column:
    """0-based place of the first character at which a text stops being one JSON value (its
    length where it just ends too early), null if it is one.

    One fold over the pieces of the text.  The state is what may come next and the open
    brackets: V a value, A a value or ``]``, K a key or ``}``, k a key, C a colon, E a comma
    or the closing bracket, D nothing more, s in a key, S in a string value.
    """
    text = F.col(c) if isinstance(c, str) else c
    state = "struct<at:int,fault:int,want:string,open:string>"

    def step(a, piece):
        want, stack = a["want"], a["open"]
        top, end = F.right(stack, F.lit(1)), F.when(F.length(stack) == 0, "D").otherwise("E")
        below = F.substring(stack, F.lit(1), F.length(stack) - 1)
        closed = F.when(F.length(stack) == 1, "D").otherwise("E")
        value_may = want.isin("V", "A")
        bare = F.regexp_replace(piece, r"^[\x20\t\r\n]+|[\x20\t\r\n]+$", "")
        blanks = F.length(piece) - F.length(F.regexp_replace(piece, r"^[\x20\t\r\n]+", ""))
        control = F.regexp_instr(piece, F.lit(r"[\x00-\x1F]"))
        # (what is wanted next, open brackets, offset of a fault in the piece)
        go = lambda w, o=stack: F.struct(w.alias("want"), o.alias("open"), F.lit(None).cast("int").alias("off"))
        bad = lambda off=F.lit(0): F.struct(want.alias("want"), stack.alias("open"), off.cast("int").alias("off"))
        inside = (F.when(piece == '"', go(F.when(want == "s", F.lit("C")).otherwise(end)))
                  .when(piece == "\\", bad())
                  .when(F.substring(piece, 1, 1) == "\\", F.when(piece.rlike(r"""^\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})$"""), go(want)).otherwise(bad()))
                  .when(control > 0, bad(control - 1)).otherwise(go(want)))
        outside = (F.when(piece.rlike(_JSON_BLANK), go(want))
                   .when(piece == '"', F.when(want.isin("K", "k"), go(F.lit("s"))).when(value_may, go(F.lit("S"))).otherwise(bad()))
                   .when(piece == "{", F.when(value_may, go(F.lit("K"), F.concat(stack, F.lit("{")))).otherwise(bad()))
                   .when(piece == "[", F.when(value_may, go(F.lit("A"), F.concat(stack, F.lit("[")))).otherwise(bad()))
                   .when(piece == "}", F.when((top == "{") & want.isin("K", "E"), go(closed, below)).otherwise(bad()))
                   .when(piece == "]", F.when((top == "[") & want.isin("A", "E"), go(closed, below)).otherwise(bad()))
                   .when(piece == ":", F.when(want == "C", go(F.lit("V"))).otherwise(bad()))
                   .when(piece == ",", F.when(want == "E", go(F.when(top == "{", F.lit("k")).otherwise(F.lit("V")))).otherwise(bad()))
                   .otherwise(F.when(value_may & bare.rlike(_JSON_SCALAR), go(end)).otherwise(bad(blanks))))
        nxt = F.get(F.transform(F.array(F.when(want.isin("s", "S"), inside).otherwise(outside)), lambda n: F.struct(
            (a["at"] + F.length(piece)).alias("at"), (a["at"] + n["off"]).alias("fault"), n["want"].alias("want"), n["open"].alias("open"))), F.lit(0))
        return F.when(a["fault"].isNotNull(), a).otherwise(nxt.cast(state))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault"), F.lit("V").alias("want"), F.lit("").alias("open")).cast(state)
    return F.aggregate(F.regexp_extract_all(text, F.lit(_JSON_PIECES), F.lit(0)), start, step,
                       lambda a: F.when(a["fault"].isNotNull(), a["fault"]).when(a["want"] != "D", a["at"]))
