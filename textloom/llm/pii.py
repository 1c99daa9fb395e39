"""Personal data by bootstrapped contextual extraction, in built-in functions only.

1. Base: matches of one pattern per kind, leftmost and non-overlapping, with checks (``KINDS``). Java
   and other regex engines read them alike: they use ASCII classes only. The forms here are possessive
   and start at run starts, which changes no match but keeps the scan linear and off the stack.
2. Instances: every base match, and every other token of five characters or more with a digit or ``@``, and
   every group of numbers (with spaces, points, hyphens or brackets between them) that the base rejects:
   identifiers whose kind is unknown. Patterns of an instance: the two words before it, and the word
   before with the word after, lower-cased, out of the 80 characters before and the 40 after it. These are
   cut out in the scan, along with the match. The time is linear in a text's length but for the test which
   unknown tokens base matches overlap: of n matches in one text it looks at n to the power 1.5.
3. The pattern-instance graph is scored until no new value is accepted. A value's confidence of a kind is 1 if the base
   has it, else what its patterns give: 1 - product(1 - score). A pattern's score for a kind is the
   confidence of its distinct values, summed, over their number plus one; it counts only with
   ``least_seeds`` confident values, so one pattern needs several witnesses.
4. Unknown instances whose confidence reaches ``accept`` are found spans of that kind. Base spans stay.

Texts are scanned once and stay where they are; the graph holds instances only. Aggregates by pattern combine on the map side.

Defined results: null and empty texts have no spans; repeated rows are judged each, alike; a null id
stays null; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import free, materialize, table, text_or_empty

_LOCAL = "A-Za-z0-9._%+-"
#: kind: pattern. The checks are in ``_valid``.
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text may have a match.
_GATE = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": lambda t: t.rlike(r"\+[0-9]")}
_TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S{5,}+(?!\S)"
_GROUP = r"(?<![\w.@+-])\+?(?:\([0-9]{1,9}\)|[0-9]{1,9})(?:[\x20.-](?:\([0-9]{1,9}\)|[0-9]{1,9})){1,9}+(?![\w@])"

SPAN = "struct<kind:string,start:int,end:int,value:string>"
#: With the text around it.
_SEEN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"
BEFORE, AFTER = 80, 40
#: Matches that are put together at a time, so that arrays are not copied over and over.
_AT_ONCE = 128


def _matches(t: Column, pattern: str, kind: str | None, gate: Column) -> Column:
    """Spans of all matches, in code points, with the text around them, from the texts between and of the
    matches: each is looked at a fixed number of times."""
    none = F.array().cast(f"array<{_SEEN}>")
    found, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    # a match has four characters or more, so a few of the next pieces hold what comes after it
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda v, b: F.struct(v.alias("v"), b.alias("b")))
    more = F.zip_with(F.slice(between, F.lit(2), F.size(found)), F.concat(F.slice(found, F.lit(2), F.size(found)), F.array(F.lit(""))), lambda b, v: F.concat(F.left(b, F.lit(AFTER)), F.when(F.length(b) < AFTER, F.left(v, F.lit(AFTER))).otherwise("")))

    def step(more: Column):
        def one(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["b"])
            end = start + F.length(x["v"])
            before = F.right(F.concat(acc["tail"], F.right(x["b"], F.lit(BEFORE))), F.lit(BEFORE))
            after = F.left(F.array_join(F.slice(more, acc["n"] + 1, AFTER // 4), ""), F.lit(AFTER))
            span = F.struct(F.lit(kind).cast("string").alias("kind"), start.alias("start"), end.alias("end"), x["v"].alias("value"), before.alias("before"), after.alias("after"))
            tail = F.right(F.concat(before, F.right(x["v"], F.lit(BEFORE))), F.lit(BEFORE))
            return F.struct((acc["n"] + 1).alias("n"), end.alias("at"), tail.alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

        return one

    def whole(x: Column) -> Column:
        pairs, more = x["pairs"], x["more"]
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<array<{_SEEN}>>").alias("out"))

        def block(acc: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(pairs, k * _AT_ONCE + 1, _AT_ONCE), F.struct(acc["n"].alias("n"), acc["at"].alias("at"), acc["tail"].alias("tail"), none.alias("out")), step(more))
            return F.get(F.transform(F.array(own), lambda o: F.struct(o["n"].alias("n"), o["at"].alias("at"), o["tail"].alias("tail"), F.concat(acc["out"], F.array(o["out"])).alias("out"))), F.lit(0))

        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _AT_ONCE).cast("int"))
        return F.when(F.size(pairs) > 0, F.aggregate(blocks, zero, block, lambda a: F.flatten(a["out"]))).otherwise(none)

    return F.when(gate, F.get(F.transform(F.array(F.struct(pairs.alias("pairs"), more.alias("more"))), whole), F.lit(0))).otherwise(none)


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        # from the right, every second digit counts double, less 9 where that has two digits
        doubled = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
        return F.length(digits).between(13, 19) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _base(t: Column) -> Column:
    def valid(kind: str):
        return lambda s: _valid(kind, s["value"])

    return F.concat(*(F.filter(_matches(t, p, k, _GATE[k](t)), valid(k)) for k, p in KINDS.items()))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(t: Column) -> Column:
    """The base, by kind as listed, then start."""
    return _plain(_base(t))


def _patterns(s: Column) -> Column:
    """Of an instance: the two words before it, and the word before with the word after."""
    before = F.regexp_replace(F.lower(s["before"]), r"\s+", " ")
    after = F.regexp_extract(F.lower(s["after"]), r"^\S?\s+(\S+)", 1)
    left2, left1 = F.regexp_extract(before, r"(\S+ \S+) \S?$", 1), F.regexp_extract(before, r"(\S+) \S?$", 1)
    return F.array_compact(F.array(F.when(left2 != "", F.concat(left2, F.lit(" _"))), F.when((left1 != "") & (after != ""), F.concat(left1, F.lit(" _ "), after))))


def _apart(spans: Column, others: Column) -> Column:
    """Spans that none of the others overlaps. The others are looked through in blocks of about the root of
    their number, each with its own first start and last end."""
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def blocks(xs: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda k: F.slice(xs, k * size + 1, size))
        return F.transform(cut, lambda x: F.struct(F.array_min(F.transform(x, lambda s: s["start"])).alias("start"), F.array_max(F.transform(x, lambda s: s["end"])).alias("end"), x.alias("own")))

    def kept(x: Column) -> Column:
        return F.filter(x["spans"], lambda s: ~F.exists(x["blocks"], lambda b: meets(s, b) & F.exists(b["own"], lambda o: meets(s, o))))

    some = F.when((F.size(spans) > 0) & (F.size(others) > 0), F.get(F.transform(F.array(F.struct(spans.alias("spans"), blocks(others).alias("blocks"))), kept), F.lit(0)))
    return F.coalesce(some, spans)


def extract_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_seeds: int = 3, accept: float = 0.6) -> DataFrame:
    """One row per document: id, ``base`` and ``found``, arrays of (kind, start, end, value)."""
    t = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    seen = t.withColumn("base", _base(F.col("t")))
    token = _matches(F.col("t"), _TOKEN, None, F.col("t").rlike("[0-9@]"))
    group = _matches(F.col("t"), _GROUP, None, F.col("t").rlike(r"[0-9][\x20.-]\(?[0-9]"))
    seen = seen.withColumn("groups", _apart(group, F.col("base")))
    seen = seen.withColumn("tokens", F.concat("groups", _apart(token, F.concat("base", "groups"))))
    slim = materialize(seen.select("id", "h", "base", "tokens"), "scanned")
    one = slim.select("id", "h", F.explode(F.concat("base", "tokens")).alias("s"))
    own = materialize(one.select("id", "h", "s.kind", "s.start", "s.end", "s.value", _patterns(F.col("s")).alias("patterns")), "instances")
    edges = materialize(own.select("value", "kind", F.explode("patterns").alias("pattern")).distinct(), "edges")
    sure = materialize(edges.where("kind is not null").select("value", "kind").distinct().withColumn("c", F.lit(1.0)), "confident")
    confident, accepted = sure, 0
    while True:
        scores = _pattern_scores(edges, confident, least_seeds)
        given = edges.where("kind is null").select("value", "pattern").join(scores, "pattern").groupBy("value", F.col("k").alias("kind")).agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("c"))
        before, confident = confident, materialize(sure.unionByName(given), "confident")
        n = confident.where(f"c < 1.0 and c >= {accept}").select("value").distinct().count()
        if before is not sure:
            free(before)
        if n <= accepted:
            break
        accepted = n
    best = confident.where(f"c < 1.0 and c >= {accept}").groupBy("value").agg(F.max_by("kind", F.struct("c", "kind")).alias("k"))
    hits = own.where("kind is null").join(best, "value").groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct(F.col("k").alias("kind"), "start", "end", "value"))).alias("found"))
    hits = hits.select(F.col("id").alias("i2"), F.col("h").alias("h2"), "found")
    out = slim.select("id", "h", _plain(F.col("base")).alias("base")).join(hits, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def _pattern_scores(edges: DataFrame, confident: DataFrame, least_seeds: int) -> DataFrame:
    """(pattern, k, score) of patterns with enough confident values."""
    total = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    sure = edges.select("pattern", "value").distinct().join(confident.withColumnRenamed("kind", "k"), "value").groupBy("pattern", "k").agg(F.sum("c").alias("c"), F.count_if(F.col("c") >= 0.5).alias("m"))
    return sure.where(F.col("m") >= least_seeds).join(total, "pattern").select("pattern", "k", (F.col("c") / (F.col("n") + 1)).alias("score"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start; comma-joined."""
    rank = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: counts and digest of the base, all spans."""
    df = extract_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(count, KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "found")).alias("spans"), F.size("found").alias("n_found"))
