"""Secret scans with a random forest that removes false positives, in DataFrame operations
only (the forest is Spark ML's, fitted and applied in the JVM).

Texts are split at white space once; candidates are runs of key-like characters, what is
assigned to a secret's name or follows ``Bearer``, and the lines of private keys.  The forest
sees a candidate's length, its character classes and the transitions between them, how much of
it dictionary words cover, its path and its neighbouring words, and it alone decides.  It is
fitted on labelled findings.  Where nobody labelled any, ``evidence`` labels part of the
table's candidates for training (by key formats, which the forest never sees, and by the place
they stand in), and ``seed_texts`` adds findings of every form whose labels are known.

All patterns read a word from left to right without going back over it, so the time grows with
the text's length, whatever stands in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, stage
from .labelled import fold

#: Findings of the table that the forest is fitted on at most, half of each class (a hash
#: chooses among more), and seed texts of each form.
MAX_TRAIN, SEEDS_EACH = 20_000, 40
TREES, DEPTH, SEED, THRESHOLD = 40, 10, 42, 0.5
#: Least length of a run that stands alone, and of one that is a plain word (letters of one case,
#: or capitalised); what is assigned to a name may be of any length.
LEAST_LENGTH, LEAST_WORD = 12, 16
_PLAIN_WORD = r"^[^A-Za-z0-9]*+[A-Za-z]?(?:[a-z]*+|[A-Z]*+)[^A-Za-z0-9]*+$"
_C = "A-Za-z0-9+/_\\-"
_W = r"\x20\x09-\x0D"
_WORDS, _SPACED_WORDS = f"[^{_W}]++", f"[{_W}]*+[^{_W}]++"
#: What secrets are assigned to, and words that go with made-up ones; both
#: at the edges of words, where a change of case (``authToken``) is an edge.
_EDGE = "(?![a-z]|(?<=[A-Z])[A-Z])"
_NAMES = (rf"(?:(?i:passw(?:or)?d|passphrase|pwd)s?{_EDGE}"
          r"|(?<![A-Za-z])(?i:(?:access|auth|api|refresh|session|bearer)?token|(?:client)?secret|credential|auth|authorization|bearer"
          rf"|(?:api|access|private|secret)[_.\-]?key)s?{_EDGE}"
          r"|(?<=[a-z0-9])(?:Token|Secret|Credential|Auth|ApiKey|AccessKey|PrivateKey|SecretKey)s?(?![a-z]))")
_MADE_UP = (r"(?i)(?<![a-z@.])(?:example|sample|dummy|test|fake|placeholder|mock|fixture)s?(?![a-z]|\.[a-z])"
            r"|changeme|x{6}|(?<=[a-z0-9])example$")
_SIGN = r"""\\?["'`]?\]?(?:=>|:=|={1,3}|:(?![:/]))"""
_KEY = r"(?<![\w.\-])([\w.\-]++)"
#: Key, opening quote and value of an assignment inside a word.
_PAIR = rf"""{_KEY}{_SIGN}\\?(["'`]?)([^\s"'`,;]++)"""
#: A key at the end of a word, with its sign or, where the sign is a word of its own, without.
_KEY_SIGN, _KEY_END, _LONE_SIGN = rf"{_KEY}{_SIGN}$", rf"""{_KEY}\\?["'`]?\]?$""", rf"^{_SIGN}$"
_BEARER = r"""^["'(]*+(?i:bearer)$"""
#: What a text with a candidate has.
_MAY = rf"[=:]|(?<![{_C}])[{_C}]{{{LEAST_LENGTH}}}|(?i:bearer)"
#: Key formats that prove a secret wherever they stand; only labels for training use them.
_FORMATS = (r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w\-]{20,}"
            r"|xox[abeprs]-[\w\-]{10,}|(?:sk|rk)_(?:live|test)_\w{16,}|sk-[A-Za-z0-9_\-]{20,}|AIza[\w\-]{35}|npm_[A-Za-z0-9]{36}"
            r"|hf_[A-Za-z0-9]{30,}|eyJ[\w\-]{8,})$")
#: Unquoted values that are code, references or nothing: calls, variables, attributes, blanks.
_CODE = r"(?i)^(?:null|none|nil|true|false|undefined|[$<{(\[%*#].*|\w++\(.*|[a-z_]\w*+(?:\.[a-z_]\w*+)++|\W*+)$"
FEATURES = ["length", "digits", "uppers", "lowers", "signs", "others", "distinct", "up_down", "to_digit", "from_digit", "clusters", "hex",
            "only_digits", "covered", "path_depth", "path_made_up", "named", "assigned", "equals", "quoted", "code", "bearer", "key_block",
            "made_up", "before_length", "after_length"]


def candidates(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, text_key (hash of the text), path, at (word number), part (number in the word),
    value, kind (pair, after, bearer or run), quoted, equals, key_block (1 between a private
    key's BEGIN and END, 0.5 after a BEGIN without END), word, before, before2, before3, after.

    ``path`` is the column ``path`` or else ``source``, or empty.  Null and empty texts have none.
    """
    path = next((F.col(c) for c in ("path", "source") if c in docs.columns), F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text")
    base = base.filter(F.col("text").rlike(_MAY if least_length >= LEAST_LENGTH else r"[=:]|(?i:bearer)|" + rf"[{_C}]{{{least_length}}}"))

    def look(words: Column) -> Column:
        near = lambda i, k: F.coalesce(F.get(words, i + k), F.lit(""))
        places = lambda test: F.filter(F.transform(words, lambda w, i: F.when(test(w, i), i)), lambda i: i.isNotNull())
        # a private key begins after the last word of its first line
        head = lambda w, i: F.concat_ws(" ", near(i, -4), near(i, -3), near(i, -2), near(i, -1), w)
        begins = F.when(F.exists(words, lambda w: w.contains("-----BEGIN")),
                        places(lambda w, i: w.rlike("(?:KEY|BLOCK)-----") & head(w, i).rlike(r"-----BEGIN [^-]*PRIVATE|-----BEGIN PRIVATE") & ~w.startswith("-----END")))
        ends = F.when(F.size(begins) > 0, places(lambda w, i: w.contains("-----END")))
        numbered = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))

        def with_marks(marks: Column) -> Column:
            def block(i):
                opened = F.array_max(F.filter(marks["begins"], lambda b: b <= i))
                closed = F.exists(marks["ends"], lambda e: (e >= opened) & (e < i))
                return F.when(opened.isNotNull() & ~closed, F.when(F.exists(marks["ends"], lambda e: e >= i), 1.0).otherwise(0.5)).otherwise(0.0)

            def wanted(s):
                prev = near(s["at"], -1)
                sign = F.right(prev, F.lit(1)).isin("=", ":", ">") | (F.lower(prev).contains("bearer"))
                line = (F.size(marks["begins"]) > 0) & s["word"].rlike(r"^[A-Za-z0-9+/]{4,}+={0,2}$")
                long = (F.length(s["word"]) >= least_length) & ((F.length(s["word"]) >= LEAST_WORD) | ~s["word"].rlike(_PLAIN_WORD))
                return long | s["word"].rlike("[=:]") | sign | F.coalesce(line, F.lit(False))

            return F.transform(F.filter(numbered, wanted), lambda s: F.struct(
                s["at"], s["word"], near(s["at"], -1).alias("before"), near(s["at"], -2).alias("before2"), near(s["at"], -3).alias("before3"), near(s["at"], 1).alias("after"),
                F.when(F.size(marks["begins"]) > 0, block(s["at"])).otherwise(0.0).alias("key_block")))

        return F.flatten(F.transform(F.array(F.struct(begins.alias("begins"), ends.alias("ends"))), with_marks))

    # the words are bound to a lambda variable, so a text is split once
    found = F.transform(F.array(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))), look)
    rows = base.select("doc_id", "text_key", "path", F.explode(F.flatten(found)).alias("c")).select("doc_id", "text_key", "path", "c.*")

    # inside the word: pairs of a query string apart, then the runs in what no pair's value covers
    group = lambda k: lambda p: F.regexp_extract_all(p, F.lit(_PAIR), F.lit(k))
    pieces = F.split("word", r"&(?=[\w.\-]++=)")
    zipped = F.transform(pieces, lambda p: F.arrays_zip(group(1)(p).alias("key"), group(2)(p).alias("quote"), group(3)(p).alias("value")))
    is_name = lambda key: key.rlike(_NAMES)
    pairs = F.when(F.col("word").rlike("[=:]"), F.filter(F.flatten(zipped), lambda p: is_name(p["key"])))
    sign_before = F.right("before", F.lit(1)).isin("=", ":", ">")
    key_before = F.when(sign_before, F.coalesce(F.nullif(F.regexp_extract("before", _KEY_SIGN, 1), F.lit("")),
                                                F.when(F.col("before").rlike(_LONE_SIGN), F.regexp_extract("before2", _KEY_END, 1))))
    first_value = F.regexp_extract("word", r"""^["'`(]*+([^\s"'`,;]++)""", 1)
    bearer_value = F.regexp_extract("word", rf"""^["'`(]*+([{_C}.~]{{{LEAST_LENGTH},}}+={{0,2}})""", 1)
    bare = F.regexp_replace("word", r"\\[nrt]", " ")
    run = F.when(F.col("key_block") == 1, rf"(?<![{_C}])[{_C}]{{4,}}+={{0,2}}").otherwise(rf"(?<![{_C}])[{_C}]{{{least_length},}}+={{0,2}}")
    rows = rows.withColumns({
        "pairs": F.coalesce(pairs, F.array().cast("array<struct<key:string,quote:string,value:string>>")),
        "next": F.when(F.coalesce(is_name(key_before), F.lit(False)) & ~F.col("before").rlike(_BEARER), first_value),
        "token": F.when(F.col("before").rlike(_BEARER), bearer_value), "runs": F.regexp_extract_all(bare, run, F.lit(0))})
    # an unquoted value ends before closing signs; a private key's own BEGIN and END lines are none
    plain = lambda v, q: F.when(q != "", v).otherwise(F.regexp_replace(v, r"(?<![.!?:)}\]|#$%&*])[.!?:)}\]|#$%&*]++$", ""))
    one = lambda value, kind, quoted, equals: F.struct(value.alias("value"), F.lit(kind).alias("kind"), quoted.alias("quoted"), equals.alias("equals"))
    quote_first = F.col("word").rlike(r"""^\\?["'`]""")
    own = F.concat(
        F.transform("pairs", lambda p: one(plain(p["value"], p["quote"]), "pair", (p["quote"] != ""), F.col("word").contains("="))),
        F.when(F.coalesce("next", F.lit("")) != "", F.array(one(F.when(quote_first, F.col("next")).otherwise(plain(F.col("next"), F.lit(""))), "after", quote_first, F.col("before").contains("=")))).otherwise(F.array()),
        F.when(F.coalesce("token", F.lit("")) != "", F.array(one(F.col("token"), "bearer", quote_first, F.lit(False)))).otherwise(F.array()))
    named = rows.withColumn("own", own).withColumn("all", F.concat("own", F.transform(
        F.filter("runs", lambda r: ~F.exists("own", lambda o: o["value"].contains(r)) & ~r.rlike(r"^(.)\1*+$|-----")
                 & ((F.length(r) >= LEAST_WORD) | (F.col("key_block") > 0) | ~r.rlike(_PLAIN_WORD))),
        lambda r: one(r, "run", quote_first, F.lit(False)))))
    values = named.select("doc_id", "text_key", "path", "at", "key_block", "word", "before", "before2", "before3", "after", F.posexplode("all").alias("part", "v"))
    return values.select("doc_id", "text_key", "path", "at", "part", "v.*", "key_block", "word", "before", "before2", "before3", "after").filter("value <> ''")


def coverage(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """value, covered: share of a value's characters in letter runs (3 or more) that are
    words of ``dictionary`` (one column: lower-case words)."""
    known = dictionary.select(F.col(dictionary.columns[0]).alias("run")).filter("run is not null").distinct()
    runs = (found.select("value").distinct()
            .select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{3,})"))).alias("run")))
    return (runs.join(known, "run").groupBy("value")
            .agg((F.sum(F.length("run")) / F.first(F.length("value"))).alias("covered")))


def with_features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    n = F.length("value")
    count = lambda pattern: (F.regexp_count("value", F.lit(pattern)) / n)
    flag = lambda c: c.cast("double")
    around = F.concat_ws(" ", F.right("before2", F.lit(200)), F.right("before", F.lit(200)), F.col("word"))
    near = F.concat_ws(" ", "before3", "before2", "before", "word", "after")
    assigned = F.col("kind").isin("pair", "after")
    cols = {
        "length": n.cast("double"), "digits": count("[0-9]"), "uppers": count("[A-Z]"), "lowers": count("[a-z]"),
        "signs": count("[+/_\\-=]"), "others": count("[^A-Za-z0-9+/_\\-=]"), "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "up_down": count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"), "to_digit": count("(?<=[A-Za-z])(?=[0-9])"),
        "from_digit": count("(?<=[0-9])(?=[A-Za-z])"), "clusters": count("(?i)[bcdfghjklmnpqrstvwxz]{5}"),
        "hex": flag(F.col("value").rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")),
        "only_digits": flag(F.col("value").rlike("^[0-9]++$")), "covered": F.coalesce("covered", F.lit(0.0)),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"), "path_made_up": flag(F.col("path").rlike(_MADE_UP)),
        "named": flag(around.rlike(_NAMES)), "assigned": flag(assigned), "equals": flag(F.col("equals")), "quoted": flag(F.col("quoted")),
        "code": flag(F.col("value").rlike(_CODE) & ~F.col("quoted")), "bearer": flag(F.col("kind") == "bearer"),
        "made_up": flag(near.rlike(_MADE_UP)), "before_length": F.least(F.length("before"), F.lit(100)).cast("double"),
        "after_length": F.least(F.length("after"), F.lit(100)).cast("double"),
    }
    return found.join(coverage(found, dictionary), "value", "left").withColumns(cols)


def evidence() -> Column:
    """1 for a candidate that is a secret as far as its format and place tell, 0 for one that
    is none, null where they do not: of a candidate with its features."""
    value, assigned = F.col("value"), F.col("assigned") > 0
    letters = value.rlike("^[A-Za-z]++$") & ~value.rlike("[a-z][A-Z]")
    made_up = (F.col("made_up") > 0) | value.rlike(_MADE_UP)
    stated = assigned & (F.col("code") == 0) & ((F.col("quoted") > 0) | (F.col("only_digits") == 0) & ((F.col("equals") > 0) | ~letters))
    proven = ((F.col("key_block") == 1) & (F.col("length") >= 16) | value.rlike(_FORMATS) | (F.col("bearer") > 0) & ~letters & (F.col("only_digits") == 0) | stated)
    # numbers, hashes, lower-case words, slugs and paths, dictionary words, UUIDs
    nothing = (assigned | (F.col("hex") > 0) | letters | (F.col("covered") >= 0.5)
               | value.rlike("^[A-Za-z_-]++$") & (value.rlike(_NAMES) | ~value.rlike("[a-z]"))
               | value.rlike(r"^[0-9+/_\-=]++$|^[a-z0-9_\-/+]*[a-z]{4}[a-z0-9_\-/+]*$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"))
    return F.when(made_up, 0.0).when(proven, 1.0).when(nothing & (F.col("key_block") == 0), 0.0)


def seed_texts(spark: SparkSession, each: int = SEEDS_EACH) -> DataFrame:
    """doc_id, text, planted, label: texts of every form, ``each`` of a form, around one value
    (drawn by hash from its number) whose label is known.  The words are those of the forms."""
    # the characters of a drawn value, 64 and more of each alphabet
    sha = lambda k: F.sha2(F.concat_ws(":", F.lit("seed"), F.lit(k), F.col("id").cast("string")), 512)
    base64 = lambda k: F.translate(F.base64(F.unhex(sha(k))), "+/=\n\r", "xY9")
    upper = lambda k: F.translate(F.upper(base64(k)), "019", "ABC")
    lower = lambda k: F.translate(F.lower(base64(k)), "0123456789", "abcdefghij")
    n = lambda least, most, k: (F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(most - least + 1)) + least).cast("int")
    cut = lambda s, size: F.substring(s, F.lit(1), size if isinstance(size, Column) else F.lit(size))
    pick = lambda words, k: F.element_at(F.split(F.lit(words), " "), (F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(len(words.split()))) + 1).cast("int"))
    digits = lambda k: F.translate(sha(k), "abcdef", "123456")
    plain = "with the this from their under after before about other water could where which right small"
    name = pick("password passwd token api_key secret client_secret access_token DB_PASSWORD authToken SECRET_KEY", 1)
    uuid = F.concat_ws("-", cut(sha(2), 8), F.substring(sha(2), 9, 4), F.substring(sha(2), 13, 4), F.substring(sha(2), 17, 4), F.substring(sha(2), 21, 12))
    slug = F.replace(F.concat_ws("-", pick(plain, 4), pick(plain, 5), pick(plain, 6), pick(plain, 7)), F.lit("-"), pick("/ - _", 3))
    long_word = F.concat(pick(plain, 8), pick(plain, 9), pick(plain, 10), pick(plain, 11))
    mixed = F.concat(cut(lower(12), n(2, 6, 12)), pick("! - . & # 7 42", 13), cut(base64(14), n(2, 8, 14)))
    phrase = F.concat_ws("-", pick(plain, 15), pick(plain, 16), cut(lower(17), n(3, 7, 17)))
    short = cut(lower(18), n(1, 9, 18))
    w = lambda k: pick(plain, 20 + k)
    q = pick("\" '", 19)
    fake = pick("example dummy sample fake placeholder mock", 30)
    fixed = F.lit
    # value, text before it, text after it, label
    forms = [
        (F.concat(fixed("AKIA"), cut(upper(31), 16)), F.concat_ws(" ", w(1), w(2), fixed("")), F.concat(fixed(" "), w(3)), 1),
        (F.concat(pick("ghp_ gho_ npm_ hf_", 32), cut(base64(33), 36)), F.concat_ws(" ", w(1), w(2), fixed("")), F.concat(fixed(" "), w(3)), 1),
        (F.concat(pick("sk_live_ sk- glpat- xoxb-", 34), cut(base64(35), n(24, 48, 35))), F.concat(w(1), fixed(" ")), F.concat(fixed(" "), w(3)), 1),
        (F.concat(fixed("AIza"), cut(base64(36), 35)), F.concat(w(1), fixed(" ")), F.concat(fixed(" "), w(3)), 1),
        (cut(base64(37), n(20, 60, 37)), F.concat(w(1), fixed(" Authorization: Bearer ")), F.concat(fixed(" "), w(3)), 1),
        (cut(base64(38), n(20, 60, 38)), F.concat(w(1), fixed(" Bearer ")), F.concat(fixed(" "), w(3)), 1),
        (cut(sha(39), 40), F.concat(w(1), fixed(" "), name, fixed(" = \"")), F.concat(fixed("\" "), w(3)), 1),
        (cut(base64(40), n(12, 40, 40)), F.concat(w(1), fixed(" "), name, fixed("="), q), F.concat(q, fixed(" "), w(3)), 1),
        (mixed, F.concat(w(1), fixed(" "), name, fixed("=")), F.concat(fixed(" "), w(3)), 1),
        (mixed, F.concat(w(1), fixed(" {\"user\":\"tom\",\""), name, fixed("\":\"")), fixed("\"}"), 1),
        (phrase, F.concat(w(1), fixed(" "), name, fixed(" = "), q), F.concat(q, fixed(" "), w(3)), 1),
        (short, F.concat(w(1), fixed(" "), name, fixed(" = "), q), F.concat(q, fixed(" "), w(3)), 1),
        (short, F.concat(fixed("https://host.org/login?"), pick("token secret password api_key", 41), fixed("=")), fixed("&user=tom"), 1),
        (cut(base64(42), n(16, 40, 42)), F.concat(w(1), fixed(" "), name, fixed(": ")), F.concat(fixed(" "), w(3)), 1),
        (cut(base64(43), 64), F.concat(w(1), fixed("\n-----BEGIN RSA PRIVATE KEY-----\n")), F.concat(fixed("\n"), cut(base64(44), 64), fixed("\n-----END RSA PRIVATE KEY-----\n"), w(3)), 1),
        (cut(base64(45), n(4, 60, 45)), F.concat(w(1), fixed("\n-----BEGIN PRIVATE KEY-----\n"), cut(base64(46), 64), fixed("\n")), F.concat(fixed("\n-----END PRIVATE KEY-----\n"), w(3)), 1),
        (cut(sha(47), 40), F.concat(pick("commit revision checksum sha1 hash", 48), fixed(" ")), F.concat(fixed(" "), w(3)), 0),
        (cut(sha(49), pick("32 64", 50).cast("int")), F.concat(w(1), fixed(" "), pick("md5: digest: etag= sum:", 51), fixed(" ")), F.concat(fixed(" "), w(3)), 0),
        (uuid, F.concat(w(1), fixed(" "), pick("id: uuid= request for", 52), fixed(" ")), F.concat(fixed(" "), w(3)), 0),
        (slug, F.concat(w(1), fixed(" ")), F.concat(fixed(" "), w(3)), 0),
        (F.concat_ws("/", w(1), w(2), F.concat(w(3), fixed("-"), cut(digits(53), 4))), F.concat(w(4), fixed(" ")), F.concat(fixed(" "), w(5)), 0),
        (long_word, F.concat(w(1), fixed(" ")), F.concat(fixed(" "), w(3)), 0),
        (F.upper(long_word), F.concat(w(1), fixed(" ")), F.concat(fixed(" "), w(3)), 0),
        (cut(lower(54), n(12, 24, 54)), F.concat(w(1), fixed(" ")), F.concat(pick("\u0020 , .", 55), fixed(" "), w(3)), 0),
        (cut(digits(56), n(12, 20, 56)), F.concat(w(1), fixed(" ")), F.concat(pick("### , . $$$", 57), fixed(" "), w(3)), 0),
        (F.upper(F.concat_ws("_", w(1), w(2), w(3))), F.concat(w(4), fixed(" ")), fixed(" = 12"), 0),
        (pick("CLIENT_SECRET DATABASE_PASSWORD ACCESS_TOKEN_VALUE API_KEY_PRODUCTION client-secret-name SecretAccessKey accessTokenValue", 64), F.concat(w(1), fixed(" ")),
         F.concat(fixed(" = "), q, short, q), 0),
        (F.concat(w(1), fixed("_"), w(2), fixed("("), w(3), fixed(")")), F.concat(w(4), fixed(" "), name, fixed(" = ")), F.concat(fixed(" "), w(5)), 0),
        (F.concat(w(1), fixed("."), w(2)), F.concat(w(4), fixed(" "), name, fixed(" = ")), F.concat(fixed(" "), w(5)), 0),
        (pick("null None true undefined false", 58), F.concat(w(4), fixed(" "), name, fixed("=")), F.concat(fixed(" "), w(5)), 0),
        (F.when(F.col("id") % 2 == 0, w(1)).otherwise(cut(lower(63), n(3, 10, 63))), F.concat(fixed("the "), pick("password secret token passphrase", 59), fixed(": ")), F.concat(fixed(" "), w(2), fixed(" "), w(3)), 0),
        (cut(lower(65), n(2, 12, 65)), F.concat(w(1), fixed(" "), name, fixed(": ")), F.concat(fixed(" "), w(3), fixed(" "), w(2)), 0),
        (cut(sha(60), 40), F.concat(fake, fixed(" "), name, fixed(" = \"")), F.concat(fixed("\" "), w(3)), 0),
        (cut(base64(61), n(16, 40, 61)), F.concat(w(1), fixed(" "), name, fixed("=\"")), F.concat(fixed("\" "), fake), 0),
        (F.concat(fake, fixed("-"), cut(base64(62), n(4, 12, 62))), F.concat(w(1), fixed(" "), name, fixed("=\"")), F.concat(fixed("\" "), w(3)), 0),
    ]
    ids = spark.range(each)
    parts = [ids.select((F.col("id") * 1000 + k).alias("doc_id"), F.concat(before, value, after).alias("text"), value.alias("planted"),
                        F.lit(float(label)).alias("label"), F.element_at(F.array(F.lit(""), F.lit("src/app"), F.lit("docs/a/b")), (F.col("id") % 3 + 1).cast("int")).alias("path"))
             for k, (value, before, after, label) in enumerate(forms)]
    return reduce(DataFrame.unionByName, parts)


def seed_findings(dictionary: DataFrame, each: int = SEEDS_EACH) -> DataFrame:
    """Labelled candidates, with their features, of ``seed_texts``."""
    texts = stage(seed_texts(dictionary.sparkSession, each), "secret-seeds")
    words = dictionary.select(F.col(dictionary.columns[0]).alias("word")).unionByName(dictionary_of(texts.filter("label = 0 and planted rlike '^[a-z]+$'").select("text")))
    found = with_features(candidates(texts.select("doc_id", "text", "path")), words)
    known = texts.select("doc_id", "planted", "label")
    return found.join(known, "doc_id").filter(F.col("planted").contains(F.col("value")) | F.col("value").contains(F.col("planted"))).drop("planted")


def rule_labels(features: DataFrame) -> DataFrame:
    """Labelled findings where nobody labelled any: by ``evidence``; fold 0 is left out."""
    return features.filter(fold() != 0).withColumn("label", evidence())


def train(labelled: DataFrame, most: int = MAX_TRAIN, seeds: DataFrame | None = None):
    """A fitted forest, or the share of secrets where the whole table has one class only (or
    no row).  Each class gives up to half of ``most`` findings, chosen by hash, and the same
    weight in all; ``seeds`` are all used and weigh half as much as the findings do."""
    rows = labelled.filter("label is not null").select(*FEATURES, "label", F.xxhash64("doc_id", "at", "part", "value").alias("pick"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    each = max(1, most // 2)
    # a bounded sample of each class: one ordered partition, so fits repeat
    parts = [(rows.filter(F.col("label") == k).orderBy("pick", *FEATURES).limit(each), min(n, each), 1.0) for k, n in sorted(counts.items())]
    if seeds is not None:
        known = seeds.select(*FEATURES, "label", F.xxhash64("doc_id", "at", "part", "value").alias("pick"))
        sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
        parts += [(known.filter(F.col("label") == k), n, 0.5) for k, n in sorted(sizes.items())]
    elif len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.0
    total = sum(n for _, n, _ in parts)
    some = reduce(DataFrame.unionByName, [p.withColumn("weight", F.lit(share * total / (len(parts) * n))) for p, n, share in parts]).orderBy("pick", *FEATURES)
    some = stage(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(some.coalesce(1)).select("x", "label", "weight"), "secret-train")
    return RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                  featureSubsetStrategy="onethird").fit(some)


def scan(docs: DataFrame, dictionary: DataFrame, findings=rule_labels, threshold: float = THRESHOLD, most: int = MAX_TRAIN,
         least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, text_key, path, at, part, value, score, is_secret of every candidate; the forest
    alone gives the score.

    ``findings``: a function from the candidates with their features to labelled ones; with
    labelled findings of one's own, the forest is fitted on those and nothing else.
    Null or empty text: no candidates.  Repeated rows are reported each; a null doc_id is
    reported but not trained on; other columns are ignored; an empty table gives none.
    """
    found = stage(candidates(docs, least_length), "secret-runs")  # the texts are searched once
    features = stage(with_features(found, dictionary), "secret-candidates")
    seeds = stage(seed_findings(dictionary), "secret-seed-findings") if findings is rule_labels else None
    model = train(findings(features), most, seeds)
    if isinstance(model, float):
        scored = features.withColumn("score", F.lit(model))
    else:
        scored = (model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features))
                  .withColumn("score", vector_to_array("probability")[1]))
    return scored.select("doc_id", "text_key", "path", "at", "part", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every value of ``found`` that is a secret replaced where it was found, a
    value of LEAST_LENGTH characters or more also wherever else in the same text it is a
    candidate; all rows and columns stay.

    Null and empty texts stay as they are; repeated rows are all cleaned; a null doc_id does
    not matter, as texts are known by a hash; columns may have any name; an empty table stays one.
    """
    own, key = free_names(docs, "own", "key")
    # the words that hold a secret, and what to replace in them: longest first
    secret = found.filter("is_secret").select("text_key", "at", "value")
    values = secret.filter(F.length("value") >= LEAST_LENGTH).select("text_key", "value").distinct()
    places = secret.unionByName(found.select("text_key", "at", "value").join(values, ["text_key", "value"]).select("text_key", "at", "value"))
    long = F.length("value") >= LEAST_LENGTH
    edged = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace("value", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    marked = stage(places.groupBy("text_key", "at").agg(F.sort_array(F.collect_set(F.struct(
        F.length("value").alias("n"), "value", F.when(~long, edged).alias("edged"))), asc=False).alias("gone")), "secret-words")
    # the texts with a secret, once each, word by word: a word goes with the white space before it
    may = F.coalesce(F.col("text").rlike(_MAY), F.lit(False))
    keyed = docs.filter(may).withColumn(own, F.xxhash64("text"))
    texts = keyed.select(F.col(own).alias("text_key"), "text").join(marked.select("text_key").distinct().hint("merge"), "text_key", "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    words = texts.select("text_key", F.posexplode(F.concat(F.regexp_extract_all("text", F.lit(_SPACED_WORDS), F.lit(0)),
                                                           F.array(F.regexp_extract("text", rf"(?<![{_W}])[{_W}]*+\z", 0)))).alias("at", "word"))
    clean = F.aggregate("gone", F.col("word"), lambda t, v: F.when(v["edged"].isNull(), F.replace(t, v["value"], F.lit(mark)))
                        .otherwise(F.regexp_replace(t, v["edged"], F.lit(mark))))
    done = words.join(marked.hint("merge"), ["text_key", "at"], "left").select("text_key", "at", F.when(F.col("gone").isNull(), F.col("word")).otherwise(clean).alias("word"))
    whole = done.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words")).select(
        F.col("text_key").alias(key), F.array_join(F.col("words.word"), "").alias(key + "_text"))
    joined = keyed.join(whole.hint("merge"), F.col(own) == F.col(key), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return (joined.withColumn("text", F.coalesce(key + "_text", "text")).select(*columns)
            .unionAll(docs.filter(~may).select(*columns)))


def dictionary_of(texts: DataFrame, column: str = "text") -> DataFrame:
    """Lower-case words of three letters or more in a text column."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit("([a-z]{3,})"))).alias("word")).distinct()
