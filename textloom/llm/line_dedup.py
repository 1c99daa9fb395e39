"""Line dedup by winnowing over line hashes, in built-in functions only.

A line ends at a line break or, so that passages inside long lines are found too, after a sentence
(``.``, ``!`` or ``?`` with a space). Lines are compared without the white space around them; blank
ones do not count. A window is the fewest lines in a row from some line on (forward) or up to some
line (backward) that have ``min_words`` words together.

Lines are rows, in order of their documents; what a window holds is a frame of a range of words, so
all work is linear in the lines and runs in generated code.

1. Fingerprints: each line has the digest of the fewest lines from it on that have ``SHINGLE`` words.
   Of each forward window the least such digest that lies in it whole is a fingerprint. Whatever run
   of ``min_words`` words is repeated holds a whole window, so both places have its fingerprint (the
   winnowing guarantee).
2. Fingerprints found in two places or more, and the documents they are in, go into Bloom filters
   (within ``max_bits``; beyond, all documents and windows go on, with the same result).
3. Extension both ways: in those documents, forward windows whose fingerprint is repeated, and
   backward windows that begin with such a one, are keyed by a digest of all their lines and the fingerprint (64 bits each).
   Every line of a repeated run lies in a forward or a backward window inside that run, so the windows
   together reach exactly as far as the run does.
4. The first place of each digest, by (id, text hash, line), is found by an aggregate; windows with
   an earlier place are later repeats. Their union is deleted. No pairs of places are formed.

So a line is deleted if and only if it lies in a run of lines with at least ``min_words`` words that
occurs, line by line, somewhere earlier: in an earlier document or earlier in its own.

Defined results: null and empty texts have no lines and stay as they are (null becomes empty);
repeated rows with the same id and text are one place and treated alike; a null id comes first;
a document may become empty, but no row goes; an empty table gives an empty one; other columns are
kept, whatever they are called, but for ``n_lines`` and ``n_deleted``, which are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, packed, quoted, table, text_or_empty
from textloom.llm.url_filter import bloom_filter_parts

MIN_WORDS = 25
BOUNDARY = r"(?<=\n)|(?<=[.!?] )"
#: Words of the shingles of lines that fingerprints are made of.
SHINGLE = 5

_MARK = "\x01"
_DOC = ("_ld_id", "_ld_h")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = text_or_empty(F.col(quoted(text_col)))
    return docs.select(packed(docs.drop(text_col)), F.col(quoted(id_col)).alias("_ld_id"), t.alias("_ld_t"), _first(F.xxhash64(t)).alias("_ld_h"))


def _pieces(t: str, boundary: str) -> Column:
    """The text cut at the boundaries. For the usual ones plain replacements put a mark in, which is
    several times faster than looking behind at each character; a text with the mark in it is cut by the
    pattern."""
    slow = F.split(t, boundary)
    if boundary != BOUNDARY:
        return slow
    marked = F.col(t)
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    return F.when(F.contains(F.col(t), F.lit(_MARK)), slow).otherwise(F.split(marked, _MARK))


def _lines(base: DataFrame, boundary: str, once: bool) -> DataFrame:
    """(_ld_id, _ld_h, p, k, w, i, s, all): lines that are not blank, with their number among all, a hash
    turned by their place, words, number among these, words before them, and the words of the document;
    each document once (``once``: there are no others)."""
    tabs = F.contains("_ld_t", F.lit("\t")) | F.contains("_ld_t", F.lit("\r")) if boundary == BOUNDARY else F.lit(True)
    base = base.withColumn("odd", _first(tabs))
    u = base.select(*_DOC, "odd", F.posexplode(_pieces("_ld_t", boundary)).alias("p", "x"))
    # of the white space that counts only a line break at the end is in a line, but for odd texts
    plain = F.when(F.endswith("x", F.lit("\n")), F.trim(F.left("x", F.length("x") - 1))).otherwise(F.trim("x"))
    u = u.withColumn("y", F.when(F.col("odd"), F.expr("btrim(x, ' \\n\\r\\t')")).otherwise(plain)).where("y != ''")
    u = u.select(*_DOC, "p", F.xxhash64("y").alias("k"), (F.octet_length("y") - F.octet_length(F.replace("y", F.lit(" "), F.lit(""))) + 1).alias("w"))
    order = Window.partitionBy(*_DOC).orderBy("p")
    if not once:
        u = u.withColumn("before", F.lag("p").over(order)).where("before is null or before != p").drop("before")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order, so that it shares the others' pass
    u = u.withColumns({"i": F.row_number().over(order), "s": F.sum("w").over(upto) - F.col("w"), "all": F.sum("w").over(every)})
    return u.withColumn("k", _turned(F.col("k"), F.col("i")))


def _first(c: Column) -> Column:
    """A value by way of an array, as generated code would else make it again for every line of a text."""
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def _turned(k: Column, by: Column, left: bool = True) -> Column:
    """``k`` with its bits turned."""
    a, b = (by % 64, 64 - by % 64) if left else (64 - by % 64, by % 64)
    return F.call_function("shiftleft", k, a).bitwiseOR(F.call_function("shiftrightunsigned", k, b))


def _digest(k: str, frame, first: Column) -> Column:
    """Of the lines of a frame, in order: each hash turned by its place, all turned back by the first."""
    return _turned(F.bit_xor(k).over(frame), first, left=False)


def _ahead(words: int):
    """The lines that begin within so many words from here."""
    return Window.partitionBy(*_DOC).orderBy("s").rangeBetween(0, words - 1)


def _shingled(min_words: int) -> tuple[Column, object]:
    """The digest of the fewest lines from here on that have ``SHINGLE`` words, and the frame of those
    that lie in a window whole."""
    shingle = min(SHINGLE, min_words)
    return F.xxhash64(_digest("k", _ahead(shingle), F.col("i"))), _ahead(min_words - shingle + 1)


def _marks(lines: DataFrame, min_words: int) -> DataFrame:
    """(m, _ld_id, _ld_h): the fingerprints of all windows, each place once."""
    g, inside = _shingled(min_words)
    marks = lines.withColumn("g", g).withColumns({"m": F.min("g").over(inside), "at": F.min_by("s", "g").over(inside)}).where(F.col("s") + min_words <= F.col("all"))
    # the place of the least digest never moves back, so equal ones are neighbours
    marks = marks.withColumn("before", F.lag("at").over(Window.partitionBy(*_DOC).orderBy("s"))).where("before is null or before != at")
    return marks.select("m", *_DOC)


def _windows(lines: DataFrame, min_words: int, repeated) -> DataFrame:
    """(_ld_id, _ld_h, d, m, s, e): digest, fingerprint, first and last line number of the windows in
    question. The fingerprint of a backward window is that of the forward one that begins with it."""
    g, inside = _shingled(min_words)
    ahead = _ahead(min_words)
    w = lines.withColumns({"g": g, "d": _digest("k", ahead, F.col("i")), "e": F.max("p").over(ahead), "f": F.col("s") + F.col("w")})
    w = w.withColumn("m", F.min("g").over(inside)).withColumn("r", (F.col("s") + min_words <= F.col("all")) & repeated(F.col("m")))
    back = Window.partitionBy(*_DOC).orderBy("f").rangeBetween(1 - min_words, 0)
    # the first line of a backward window has the least number: both numbers and ``r`` in one value
    w = w.withColumn("q", F.col("i") * F.lit(1 << 33) + F.col("p") * F.lit(2) + F.col("r").cast("int"))
    w = w.withColumns({"q": F.min("q").over(back), "be": F.min("e").over(back), "bd": F.bit_xor("k").over(back), "bm": F.first("m").over(back)})
    i, p, first = F.shiftright("q", 33).cast("int"), F.col("p"), (F.shiftright("q", 1) % F.lit(1 << 32)).cast("int")
    span = lambda d, m, s, e: F.struct(d.alias("d"), m.alias("m"), s.alias("s"), e.alias("e"))
    # a backward window that is a forward one too is there already
    w = w.withColumn("ends", (F.col("q") % 2 == 1) & (F.col("f") >= min_words) & (F.col("be") != p)).where("r or ends")
    both = F.array_compact(F.array(F.when(F.col("r"), span(F.col("d"), F.col("m"), p, F.col("e"))), F.when(F.col("ends"), span(_turned(F.col("bd"), i, False), F.col("bm"), first, p))))
    return w.select(*_DOC, F.explode(both).alias("x")).select(*_DOC, "x.*")


def later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, boundary: str = BOUNDARY, max_bits: int = 1 << 28) -> DataFrame:
    """(_ld_id, _ld_h, runs): of each document that has any, the runs to delete, as first and last
    line number, disjoint and in order."""
    base = _prepared(docs, id_col, text_col).select(*_DOC, "_ld_t")
    once = base.groupBy("_ld_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    marks = materialize(_marks(_lines(base, boundary, once), min_words), "marks")
    repeated = materialize(marks.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select(F.col("m").alias("key")), "repeated")
    words, maybe = bloom_filter_parts(repeated, max_bits)
    hit = (lambda m: maybe(m, words)) if maybe else (lambda m: F.lit(True))
    if maybe:
        found = materialize(marks.where(hit(F.col("m"))).select(F.xxhash64(*_DOC).alias("key")).distinct(), "found")
        some, may = bloom_filter_parts(found, max_bits)
        base = base.where(may(F.xxhash64(*_DOC), some)) if may else base
    places = materialize(_windows(_lines(base, boundary, once), min_words, hit), "places")
    place = F.struct("_ld_id", "_ld_h", "s")
    firsts = places.groupBy("d", "m").agg(F.min(place).alias("top"), F.max(place).alias("end")).where("top != end").select("d", "m", "top")
    later = places.join(firsts, ["d", "m"]).where(~(F.col("_ld_id").eqNullSafe(F.col("top._ld_id")) & (F.col("_ld_h") == F.col("top._ld_h")) & (F.col("s") == F.col("top.s"))))
    order = Window.partitionBy(*_DOC).orderBy("s", "e")
    upto = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.select(*_DOC, "s", "e").distinct().withColumn("new", F.coalesce((F.col("s") > upto + 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*_DOC, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))


#: The pieces between the runs, each stretch in one go.
_LEFT = """array_join(transform(sequence(0, size(_ld_runs)), j -> array_join(slice(_ld_u, if(j = 0, 1, _ld_runs[greatest(j - 1, 0)].e + 2),
  greatest(0, if(j = size(_ld_runs), size(_ld_u), _ld_runs[least(j, size(_ld_runs) - 1)].s) - if(j = 0, 0, _ld_runs[greatest(j - 1, 0)].e + 1))), '')), '')"""


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, boundary: str = BOUNDARY, max_bits: int = 1 << 28) -> DataFrame:
    """``docs`` with ``text_col`` without its later repeated runs, and ``n_lines``, ``n_deleted``."""
    runs = materialize(later_runs(docs, id_col, text_col, min_words, boundary, max_bits), "runs")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    base = _prepared(docs, id_col, text_col)
    words, maybe = bloom_filter_parts(runs.select(F.xxhash64(*_DOC).alias("key")), max_bits)
    if maybe:  # only texts that may lose something move
        base = base.withColumn("_ld_f", words).withColumn("_ld_m", maybe(F.xxhash64(*_DOC), F.col("_ld_f"))).drop("_ld_f")
        rest, base = base.where("not _ld_m"), base.where("_ld_m")
    else:
        rest = None
    to = runs.select(F.col("_ld_id").alias("_ld_i2"), F.col("_ld_h").alias("_ld_h2"), F.col("runs").alias("_ld_runs"))
    base = base.join(to.hint("shuffle_hash"), F.col("_ld_id").eqNullSafe(F.col("_ld_i2")) & (F.col("_ld_h") == F.col("_ld_h2")), "left").drop("_ld_i2", "_ld_h2")
    base = base.withColumn("_ld_u", _pieces("_ld_t", boundary))
    gone = F.coalesce(F.aggregate("_ld_runs", F.lit(0), lambda a, r: a + r["e"] - r["s"] + 1), F.lit(0))
    n = F.size("_ld_u") - F.when(F.element_at("_ld_u", -1) == "", 1).otherwise(0)

    def shaped(df: DataFrame, text: Column, n: Column, gone: Column) -> DataFrame:
        return df.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in keep), n.cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"))

    out = shaped(base, F.when(F.col("_ld_runs").isNull(), F.col("_ld_t")).otherwise(F.expr(_LEFT)), n, gone)
    return out if rest is None else out.unionByName(shaped(rest, F.col("_ld_t"), _count("_ld_t", boundary), F.lit(0)))


def _count(t: str, boundary: str) -> Column:
    """How many pieces a text has that are not empty."""
    if boundary != BOUNDARY:
        u = F.split(t, boundary)
        return F.size(u) - F.when(F.element_at(u, -1) == "", 1).otherwise(0)
    ends, last = F.lit(0), F.lit(False)
    for end in ("\n", ". ", "! ", "? "):
        ends = ends + (F.octet_length(t) - F.octet_length(F.replace(F.col(t), F.lit(end), F.lit("")))) / len(end)
        last = last | F.endswith(F.col(t), F.lit(end))
    return ends + F.when(last | (F.col(t) == ""), 0).otherwise(1)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later repeated runs."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The definition: every window as a list of lines, its first place, the union of the others.
OP10_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
u as (select doc_id, t, unnest(list_zip(p, range(len(p)))) as z
      from (select doc_id, t, list_filter(string_split(regexp_replace(t, '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)), lambda x: x != '') as p from d)),
lines as (select doc_id, t, z[1] as x, cast(z[2] as int) as p, trim(z[1], chr(32) || chr(10) || chr(13) || chr(9)) as y from u),
kept as (select doc_id, md5(t) as h, p, y, length(y) - length(replace(y, ' ', '')) + 1 as w from lines where y != ''),
c as (select *, sum(w) over (partition by doc_id, h order by p) as upto, row_number() over (partition by doc_id, h order by p) as i from kept),
ends as (select a.doc_id, a.h, a.i as s, min(b.i) as e from c a join c b on a.doc_id = b.doc_id and a.h = b.h and b.i >= a.i and b.i < a.i + {MIN_WORDS} and b.upto - a.upto + a.w >= {MIN_WORDS} group by all
         union
         select a.doc_id, a.h, max(b.i) as s, a.i as e from c a join c b on a.doc_id = b.doc_id and a.h = b.h and b.i <= a.i and b.i > a.i - {MIN_WORDS} and a.upto - b.upto + b.w >= {MIN_WORDS} group by a.doc_id, a.h, a.i),
win as (select ends.doc_id, ends.h, s, min(p) as ps, max(p) as pe, md5(string_agg(y, chr(10) order by i)) as k
        from ends join c on c.doc_id = ends.doc_id and c.h = ends.h and c.i between s and e group by ends.doc_id, ends.h, s, e),
later as (select doc_id, h, ps, pe from win qualify row_number() over (partition by k order by doc_id, h, s) > 1),
gone as (select distinct lines.doc_id, lines.t, p from lines join later on lines.doc_id = later.doc_id and md5(lines.t) = later.h and p between ps and pe)
select d.doc_id,
       coalesce((select string_agg(l.x, '' order by l.p) from lines l left join gone g on g.doc_id = l.doc_id and g.t = l.t and g.p = l.p where l.doc_id = d.doc_id and l.t = d.t and g.p is null), '') as text,
       (select count(*) from lines l where l.doc_id = d.doc_id and l.t = d.t) as n_lines,
       (select count(*) from gone g where g.doc_id = d.doc_id and g.t = d.t) as n_deleted
from d
"""
