"""Benchmark decontamination: every training passage queries an inverted index of the test items.

Definition: a document is cut into passages of twice the longest item's words, half overlapping, so any
run as long as an item lies in one. The overlap of a unit (an item, its question: all but the last
sentence, or its answer: the last) with a document is the largest share of the unit's five-word
shingles that one passage has. An item leaks into a document if its own overlap reaches ``overlap``, or
both that of its question and that of its answer do, wherever in the document each of them stands.

1. Index of units (items, and questions of items that have an answer): BM25 impacts of a unit's terms,
   as shares of the unit's score for its own text. Document frequencies and the mean length are those
   of all items. A unit's threshold is ``threshold``, or less where a passage that reaches ``overlap``
   could score less: so many words as can be missing then may be its best ones (``_lost``). So
   retrieval loses none that verification would find, and does not depend on what else is indexed.
   Impacts are divided by the threshold, which so is 1 for all. Units are sorted by length and laid in
   blocks; each term has its largest impact of each block it is in (sparse).
2. For each passage that has any term without which no unit of some block reaches 1, the sum of its
   terms' block maxima bounds the scores of each block; blocks under 1 are skipped. In the others, WAND
   over the posting lists: lists in order of their next unit, the pivot is the first at which the
   bounds together reach 1, only pivots are scored. All units that reach 1 are retrieved.
3. Verification by shingles in the passage; hits of an item are combined by document, and the answer of
   an item whose question is found is looked for in all passages.

Items come to the driver and to the tasks in parts of at most ``part_words`` words (about 30 bytes
each); hits of a part are written before the next one's. Only the vocabulary of the items and their
document frequencies are on the driver at once. No exchange: hits come from the scan. Words are runs of
letters, digits and ``_``, lower-cased.

Defined results: null and empty texts have no hits; items without words are never hit; an item,
question or answer of fewer than five words is one shingle of all its words; an item of one sentence
has no answer; repeated rows and items are hit each; empty tables give no rows; extra columns are
ignored; columns of the documents are not renamed, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import materialize, table, text_or_empty

WORDS, OVERLAP, THRESHOLD = 5, 0.8, 0.6
K1, B = 1.2, 0.75
BLOCK, PART_WORDS = 2, 4_000_000
#: Passages and blocks whose bounds are summed at once.
BINS = 1 << 18
_word = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def shingles(words: list) -> set[tuple]:
    """Of five words; of all of them where there are fewer."""
    return {tuple(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))} if words else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; a text of one sentence is all question."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


class Statistics:
    """Of all items: how many have a term, how many there are, their mean and largest length."""

    def __init__(self, texts) -> None:
        self.df: Counter[str] = Counter()
        self.items = self.words = self.longest = 0
        for t in texts:
            words = words_of(t or "")
            if words:
                self.df.update(set(words))
                self.items += 1
                self.words += len(words)
                self.longest = max(self.longest, len(words))

    def impacts(self, words: list[str]) -> dict[str, float]:
        """BM25 of each term, as a share of all of them together."""
        mean, out = self.words / max(1, self.items), {}
        for t, n in Counter(words).items():
            idf = math.log(1 + (self.items - self.df[t] + 0.5) / (self.df[t] + 0.5))
            out[t] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean))
        own = sum(out.values())
        return {t: x / own for t, x in out.items()}


def _lost(words: list[str], overlap: float) -> int:
    """So many different words of a unit at most does a passage lack that reaches ``overlap``: as many as
    shingle places can be missing, if the shingles that occur most often are the missing ones."""
    n = min(WORDS, len(words))
    times = sorted(Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)).values(), reverse=True)
    return sum(times[: int((1 - overlap) * len(times) + 1e-9)])


class Index:
    """Items (id, text) by BM25, with sparse block maxima; arrays only but for the vocabulary."""

    def __init__(self, items: list[tuple], statistics: Statistics | None = None, overlap: float = OVERLAP, threshold: float = THRESHOLD, block: int = BLOCK) -> None:
        statistics = statistics or Statistics(t for _, t in items)
        self.overlap, self.step = overlap, max(1, statistics.longest)
        self.ids, self.term = [i for i, _ in items], {}
        units, self.texts = [], []  # (words, item); codes of item, question, answer
        for n, (_, text) in enumerate(items):
            q, a = question_and_answer(text or "")
            own = [words_of(x) for x in (text or "", q, a)]
            self.texts.append(tuple(np.array([self.term.setdefault(w, len(self.term)) for w in words], np.int32) for words in own))
            units += [(words, n) for words in (own[0], own[1] if own[2] else []) if words]
        units.sort(key=lambda u: len(u[0]))
        self.item = np.array([u[1] for u in units], np.int64)
        self.least = np.ones(len(units))
        self.block, self.blocks = block, -(-len(units) // block)
        post = []
        for u, (words, _) in enumerate(units):
            share = statistics.impacts(words)
            best = sorted(share.values(), reverse=True)
            self.least[u] = max(1e-3, min(threshold, 1 - sum(best[: _lost(words, overlap)])))
            post += [(self.term[t], u, x / self.least[u]) for t, x in share.items()]
        post.sort()
        code, unit, impact = (np.array(c, t) for c, t in zip(zip(*post) if post else ((), (), ()), (np.int64, np.int64, np.float64)))
        self.at = np.searchsorted(code, np.arange(len(self.term) + 2))  # the last term is any other word
        self.unit, self.impact = unit, impact
        # block maxima: postings are in order of units, so those of a block stand together
        edge = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(unit // block, prepend=-1) != 0))
        self.top = np.maximum.reduceat(impact, edge) if len(edge) else impact
        self.top_block, top_code = unit[edge] // block, code[edge]
        self.top_at = np.searchsorted(top_code, np.arange(len(self.term) + 2))
        # the most usual terms of a block whose maxima stay under 1 together can't make a hit alone
        df = np.array([statistics.df[t] for t in self.term], np.int64)
        order = np.lexsort((top_code, -df[top_code], self.top_block)) if len(edge) else np.zeros(0, np.int64)
        total = np.cumsum(self.top[order])
        start = np.searchsorted(self.top_block[order], np.arange(self.blocks))
        before = np.concatenate([[0.0], total])[start][self.top_block[order]] if len(order) else total
        self.needed = np.zeros(len(self.term) + 1, bool)
        self.needed[top_code[order][total - before >= 1 - 1e-6]] = True

    def retrieve(self, terms: list[int], blocks: np.ndarray, least: float = 1 - 1e-6) -> dict[int, float]:
        """Every unit of the blocks that reaches ``least``, with its score."""
        out: dict[int, float] = {}
        lists = []
        for t in terms:
            own = slice(self.at[t], self.at[t + 1])
            wanted = blocks[self.unit[own] // self.block]
            if wanted.any():
                tops = slice(self.top_at[t], self.top_at[t + 1])
                maxima = {b: x for b, x in zip(self.top_block[tops].tolist(), self.top[tops].tolist()) if blocks[b]}
                lists.append([list(zip(self.unit[own][wanted].tolist(), self.impact[own][wanted].tolist())), 0, max(maxima.values()), maxima])
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            total, pivot = 0.0, None
            for x in lists:
                total += x[2]
                if total >= least:
                    pivot = x[0][x[1]][0]
                    break
            if pivot is None:
                break
            here = pivot // self.block
            if lists[0][0][lists[0][1]][0] == pivot:
                same = [x for x in lists if x[0][x[1]][0] == pivot]
                if sum(x[3][here] for x in same) >= least:  # the block's own maxima
                    score = sum(x[0][x[1]][1] for x in same)
                    if score >= least:
                        out[pivot] = score
                for x in same:
                    x[1] += 1
            else:
                for x in lists:
                    if x[0][x[1]][0] >= pivot:
                        break
                    while x[1] < len(x[0]) and x[0][x[1]][0] < pivot:
                        x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0])]
        return out

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, dict[int, float]]]:
        """(number, units retrieved) of the passages of a document's term codes."""
        if not self.needed[codes].any():
            return
        terms, at = len(self.term), np.flatnonzero(codes < len(self.term))
        several = max(1, BINS // max(1, self.blocks))
        for p in range(0, -(-len(codes) // self.step), several):
            # terms of the passages from p on, each once in a passage
            lo, hi = np.searchsorted(at, (p * self.step, (p + several + 1) * self.step))
            place, code = at[lo:hi] // self.step - p, codes[at[lo:hi]]
            key = np.concatenate([place * terms + code, (place - 1) * terms + code])
            key = np.unique(key[(key >= 0) & (key < several * terms)])
            own, code = key // terms, key % terms
            n = self.top_at[code + 1] - self.top_at[code]
            entry = np.repeat(self.top_at[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            bound = np.bincount(np.repeat(own, n) * self.blocks + self.top_block[entry], self.top[entry])
            high = np.flatnonzero(bound >= 1 - 1e-6)
            for k in np.unique(high // self.blocks).tolist():
                blocks = np.zeros(self.blocks, bool)
                blocks[high[high // self.blocks == k] % self.blocks] = True
                if got := self.retrieve(code[own == k].tolist(), blocks):
                    yield p + k, got

    def share(self, unit: np.ndarray, codes: np.ndarray) -> tuple[float, int]:
        """A unit's overlap, and the start of the first passage that has it."""
        own = shingles(unit.tolist())
        if not own:
            return 0.0, 0
        n = min(WORDS, len(unit))
        here = np.isin(codes, unit)
        run = np.convolve(here, np.ones(n, int), "valid") == n if len(codes) >= n else here[:0]
        has: dict[int, set] = {}
        for k in np.flatnonzero(run).tolist():
            s = tuple(codes[k : k + n].tolist())
            if s in own:
                for p in (k // self.step, k // self.step - 1):
                    if p >= 0 and k + n <= (p + 2) * self.step:
                        has.setdefault(p, set()).add(s)
        share, p = max(((len(x) / len(own), -p) for p, x in has.items()), default=(0.0, 0))
        return share, -p * self.step

    def hits(self, text: str) -> list[tuple]:
        """(item id, score, overlap, question's, answer's, start word) of items that leak."""
        words = words_of(text)
        codes = np.fromiter(map(self.term.get, words, repeat(len(self.term))), np.int64, len(words))
        found: dict[int, float] = {}
        for _, got in self.candidates(codes):
            for u, score in got.items():
                n = int(self.item[u])
                found[n] = max(found.get(n, 0.0), score * self.least[u])
        out = []
        for n, score in sorted(found.items()):
            whole, question, answer = self.texts[n]
            share, at = self.share(whole, codes)
            q, q_at = self.share(question, codes)
            r, _ = self.share(answer, codes)
            if share >= self.overlap or (q >= self.overlap and r >= self.overlap):
                out.append((self.ids[n], min(1.0, score), share, q, r, at if share >= self.overlap else q_at))
        return out


def _parts(items: DataFrame, item_col: str, text_col: str, overlap: float, threshold: float, part_words: int) -> Iterator[Index]:
    """Indexes of all items, one part on the driver at a time; statistics first."""
    rows = items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    statistics = Statistics(r["t"] for r in rows.toLocalIterator())
    part, n = [], 0
    for r in rows.toLocalIterator():
        part.append((r["i"], r["t"]))
        n += len(words_of(r["t"] or ""))
        if n >= part_words:
            yield Index(part, statistics, overlap, threshold)
            part, n = [], 0
    if part:
        yield Index(part, statistics, overlap, threshold)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", overlap: float = OVERLAP, threshold: float = THRESHOLD, part_words: int = PART_WORDS) -> DataFrame:
    """One row per document and item that leaks into it: ids, ``score`` (the best
    share of a unit's own BM25 score), ``overlap``, ``question_overlap``, ``answer_overlap``, ``word`` (passage start)."""
    own, item = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = f"id {own.simpleString()}, item {item.simpleString()}, score double, overlap double, question_overlap double, answer_overlap double, word bigint"
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    out, last = None, None
    for index in _parts(items, item_col, item_text_col, overlap, threshold, part_words):
        if last is not None:  # more than one part: each one's hits are written before the next
            done = materialize(last, "leaks")
            out = done if out is None else out.union(done)
        last = rows.mapInArrow(_run(index, to_arrow_type(own), to_arrow_type(item)), schema)
    if last is None:
        last = docs.sparkSession.createDataFrame([], schema)
    return (last if out is None else out.union(last)).withColumnsRenamed({"id": id_col, "item": item_col})


def _run(index: Index, own: pa.DataType, item: pa.DataType):
    names = ["id", "item", "score", "overlap", "question_overlap", "answer_overlap", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [item, pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [(i, hit) for i, t in enumerate(part.column(1).to_pylist()) for hit in index.hits(t)]
                if found:
                    cols = [pa.array(c, t) for c, t in zip(zip(*(hit for _, hit in found)), types)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _ in found], pa.int64())), *cols], names=names)

    return run


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", overlap: float = OVERLAP, threshold: float = THRESHOLD, part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; rows are judged where they stand."""
    keep = None
    for index in _parts(items, item_col, item_text_col, overlap, threshold, part_words):
        ok = _no_hit(index)(text_or_empty(text_col))
        keep = ok if keep is None else keep & ok
    return docs if keep is None else docs.where(keep)


def _no_hit(index: Index):
    @F.pandas_udf("boolean")
    def no_hit(texts: pd.Series) -> pd.Series:
        return pd.Series([not index.hits(t) for t in texts], dtype=bool)

    return no_hit


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
