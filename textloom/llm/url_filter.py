"""URL filter by a Bloom filter cascade: exact membership in a block list without joins.

Level 1 encodes the listed keys. Level 2 encodes those keys of the corpus that are not listed but
that level 1 lets through; level 3 the listed keys that level 2 lets through; and so on until a
level lets nothing wrong through. A key of the universe that was used is then judged exactly: walk
the levels until one says no; an odd number of levels passed means listed.

The universe is every key that the urls of the corpus can ask for: the host and its parent domains.
Filters are arrays of 64-bit words held in one-row tables and read through scalar subqueries, so a
lookup is an expression inside the scan's stage. Everything runs on built-in functions.

Size: a filter has at most ``max_bits`` bits (16 MB). A list that needs more falls back to a left
semi join on the keys, which gives the same result.

Defined results: a null url or one without ``://`` has an empty host and path, and is allowed;
repeated rows are judged each; an empty list allows everything; other columns are kept, whatever they
are called, but for ``host``, ``path``, ``rule``, ``verdict``, which are the operator's own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize, packed, quoted, table, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``action`` for a host with its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: The block list of the registered query: host keys; subdomains are listed with them.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_keys(host: Column) -> Column:
    """The host and its parent domains: ``a.b.c`` gives ``[a.b.c, b.c, c]``; an empty host none."""
    parts = F.split(host, r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


@dataclass
class Cascade:
    """``levels``: (one-row table with the words ``bits``, number of bits, hashes, seed)."""

    levels: list[tuple[DataFrame, int, int, int]] = field(default_factory=list)
    listed: DataFrame | None = None  # set where the list is too large for filters

    def words(self) -> dict[str, Column]:
        """The levels' words as columns, to be added beside the keys before ``contains``."""
        return {f"_level{k}": x[0].scalar() for k, x in enumerate(self.levels)}

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(_maybe(key, F.col(f"_level{k}"), *self.levels[k][1:]), verdict).otherwise(F.lit(k % 2 == 1))
        return verdict


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """Bit numbers by double hashing; each level has its own seed."""
    a, b = F.xxhash64(key, F.lit(seed)), F.xxhash64(F.lit(seed), key)
    return [F.pmod(F.pmod(a, F.lit(bits)) + F.lit(i) * F.pmod(b, F.lit(bits)), F.lit(bits)) for i in range(hashes)]


def _maybe(key: Column, words: Column, bits: int, hashes: int, seed: int) -> Column:
    out = F.lit(True)
    for p in _positions(key, bits, hashes, seed):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        out = out & (F.call_function("shiftright", word, F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def _filter_table(keys: DataFrame, bits: int, hashes: int, seed: int) -> DataFrame:
    """The words of a filter over ``key``, as one row written to the shared folder."""
    spark = keys.sparkSession
    p = F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed)))
    words = keys.select(p.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
    every = spark.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    one = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bits"))
    return materialize(one, "bloom")


def build_cascade(listed: DataFrame, universe: DataFrame, fpp: float = 0.01, max_bits: int = 1 << 27, max_levels: int = 64) -> Cascade:
    """A cascade over column ``key`` of ``listed`` that is exact for column ``key`` of ``universe``.

    Both are reduced to distinct keys; listed keys that no url asks for need no place. Only counts
    come to the driver. After ``max_levels`` (never seen: each level shrinks by ``fpp``) it raises.
    """
    keys = universe.select("key").where(F.col("key").isNotNull()).distinct().join(listed.select(F.col("key")).distinct().withColumn("is_listed", F.lit(True)), "key", "left").select("key", F.coalesce("is_listed", F.lit(False)).alias("is_listed"))
    keys = materialize(keys, "keys")
    inside, outside = keys.where("is_listed").select("key"), keys.where("not is_listed").select("key")
    n = inside.count()
    out = Cascade()
    if n == 0:
        return out
    if _bits(n, fpp) > max_bits:
        out.listed = inside
        return out
    encode, against = inside, outside
    for seed in range(max_levels):
        bits, hashes = _bits(n, fpp), max(1, round(-math.log2(fpp)))
        level = (_filter_table(encode, bits, hashes, seed), bits, hashes, seed)
        out.levels.append(level)
        wrong = materialize(against.where(_maybe(F.col("key"), level[0].scalar(), *level[1:])), "wrong")
        n = wrong.count()
        if n == 0:
            return out
        encode, against = wrong, encode
    raise RuntimeError("the cascade did not end")


def bloom_filter_parts(keys: DataFrame, max_bits: int = 1 << 27, fpp: float = 0.01):
    """The words of a Bloom filter over column ``key`` as a scalar column, and a function from a key
    and that column to whether the key may be in it; (None, None) where it needs over ``max_bits``."""
    bits, hashes = _bits(max(1, keys.count()), fpp), max(1, round(-math.log2(fpp)))
    if bits > max_bits:
        return None, None
    words = _filter_table(keys, bits, hashes, 0)
    return words.scalar(), lambda key, column: _maybe(key, column, bits, hashes, 0)


def bloom_filter(keys: DataFrame, max_bits: int = 1 << 27):
    """A function from a column to whether it may be among column ``key`` of ``keys``, or None."""
    words, maybe = bloom_filter_parts(keys, max_bits)
    return (lambda key: maybe(key, words)) if maybe else None


def _bits(n: int, fpp: float) -> int:
    return 64 * max(1, math.ceil(-n * math.log(fpp) / math.log(2) ** 2 / 64))


def judge_urls(urls: DataFrame, url_col: str, listed: DataFrame, rules: Sequence[Rule] = RULES, **cascade: float) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest rule that fits decides; else the block list: a url whose host or a parent domain is
    listed is blocked, any other allowed.
    """
    url = F.col(quoted(url_col))
    df = urls.select(packed(urls), url_host(url).alias("host"), url_path(url).alias("path"))
    universe = df.select("host").distinct().select(F.explode(host_keys(F.col("host"))).alias("key"))
    c = build_cascade(listed, universe, **cascade)
    if c.listed is not None:
        hosts = df.select("host").distinct().withColumn("key", F.explode(host_keys(F.col("host")))).join(c.listed, "key", "left_semi").select("host").distinct()
        df = df.join(hosts.withColumn("_hit", F.lit(True)), "host", "left")
        hit = F.coalesce("_hit", F.lit(False))
    else:
        df = df.withColumns(c.words()) if c.levels else df
        hit = F.exists(host_keys(F.col("host")), c.contains) if c.levels else F.lit(False)
    rule, action = F.lit(None).cast("string"), F.when(hit, "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, action = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.action)).otherwise(action)
    own = ("host", "path", "rule", "verdict")
    return df.withColumn("rule", rule).withColumn("verdict", action).select(*unpacked([x for x in urls.columns if x not in own]), *own)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under RULES and LISTED."""
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url", listed).select("page_id", "host", "path", "rule", "verdict")


_FITS = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
_LISTED = " or ".join(f"host = '{k}' or ends_with(host, '.{k}')" for k in LISTED)
_ORDER = sorted(RULES, key=lambda r: -len(r.text))
OP1_SQL = f"""
with u as (
  select page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages)
select page_id, host, path,
       case {" ".join(f"when {_FITS.format(h=r.host, p=r.path)} then '{r.text}'" for r in _ORDER)} end as rule,
       case {" ".join(f"when {_FITS.format(h=r.host, p=r.path)} then '{r.action}'" for r in _ORDER)}
            when {_LISTED} then 'block' else 'allow' end as verdict
from u
"""
