"""Decontamination against its whole definition, by brute force."""

import random

import numpy as np

from pyspark.sql import functions as F

from textloom.llm import decontaminate as D

VOCABULARY = [f"w{k}" for k in range(60)]


def brute(texts, items, overlap=D.OVERLAP):
    """{(document, item): (overlap, question's, answer's)} over all passages of all documents."""
    longest = max((len(D.words_of(x or "")) for _, x in items), default=1)
    out = {}
    for i, t in texts:
        words = D.words_of(t or "")
        passages = [words[a : a + 2 * longest] for a in range(0, len(words), longest)]

        def share(unit, passages=passages):
            own = D.shingles(D.words_of(unit))
            n = min(D.WORDS, len(D.words_of(unit)))
            return max((len(own & {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}) / len(own) for p in passages), default=0.0) if own else 0.0

        for j, x in items:
            q, a = D.question_and_answer(x or "")
            got = (share(x or ""), share(q), share(a))
            if got[0] >= overlap or min(got[1:]) >= overlap:
                out[i, j] = tuple(round(v, 9) for v in got)
    return out


def made(rng):
    say = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(k, ". ".join(say(rng.randint(1, 24)).capitalize() for _ in range(rng.randint(1, 4))) + ".") for k in range(40)]
    items += [(40, None), (41, ""), (42, "w1"), (43, "w2 w3. w4"), (44, items[3][1]), (45, "w5 " * 30)]
    texts = [(0, None), (1, ""), (2, "w1"), (3, "...")]
    for k in range(120):
        words = say(rng.randint(1, 500)).split()
        for _ in range(rng.randint(0, 3)):
            item = (rng.choice(items)[1] or "").split()
            if len(item) > 6 and rng.random() < 0.6:  # part of it, or with other words
                kind = rng.randint(0, 2)
                if kind == 0:
                    item = item[: rng.randint(len(item) // 2, len(item))]
                elif kind == 1:
                    item[rng.randrange(len(item))] = "other"
                else:
                    at = rng.randrange(len(item))
                    item = item[at:] + say(rng.randint(1, 300)).split() + item[:at]
            at = rng.randint(0, len(words))
            words[at:at] = item
        texts.append((100 + k, " ".join(words)))
    return texts + texts[10:13], items


def test_whole_definition_and_any_parts(spark):
    for seed, parts in ((1, (150, D.PART_WORDS)), (2, (D.PART_WORDS,))):
        texts, items = made(random.Random(seed))
        df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id int, text string, id string, item string").repartition(3)
        of = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, id int")
        expected = brute(texts, items)
        assert len(expected) > 60 and any(max(x[0], 0) < D.OVERLAP for x in expected.values())
        for words in parts:
            got = D.leaks(df, of, part_words=words).collect()
            assert {(r["doc_id"], r["item_id"]): tuple(round(r[c], 9) for c in ("overlap", "question_overlap", "answer_overlap")) for r in got} == expected
            assert len(got) == sum((i, j) in expected for i, _ in texts for j, _ in items)
            left = D.clean(df, of, part_words=words)
            assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in texts if not any((i, j) in expected for j, _ in items))


def test_question_and_answer_far_apart(spark):
    rng = random.Random(4)
    say = lambda n, k: " ".join(f"{k}{rng.randrange(5000)}" for _ in range(n))
    items = [(k, f"{say(20, 'q')}? {say(18, 'a')}") for k in range(100)]
    texts = [(k, f"{say(30, 'x')} {' '.join(D.question_and_answer(t)[0].split())} {say(600, 'x')} {D.question_and_answer(t)[1]} {say(9, 'x')}") for k, t in items]
    got = D.leaks(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, k) for k, _ in items}


def test_empty_tables(spark):
    texts, items = made(random.Random(3))
    df, of = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert D.leaks(df.limit(0), of).count() == 0 and D.leaks(df, of.limit(0)).count() == 0 and D.clean(df, of.limit(0)).count() == len(texts)


def test_wand_retrieves_all_over_the_threshold():
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 9)) for _ in range(rng.randint(3, 30)))) for k in range(60)]
    index = D.Index(items)
    for _ in range(60):
        terms = sorted({index.term[t] for t in rng.sample(sorted(index.term), 60)})
        scores = {}
        for t in terms:
            for u, x in zip(index.unit[index.at[t] : index.at[t + 1]].tolist(), index.impact[index.at[t] : index.at[t + 1]].tolist()):
                scores[u] = scores.get(u, 0) + x
        for least in (0.2, 0.5, 1 - 1e-6):
            got = index.retrieve(terms, np.ones(index.blocks, bool), least)
            assert {u: round(x, 9) for u, x in got.items()} == {u: round(x, 9) for u, x in scores.items() if x >= least}


def test_registered_query(spark, tmp_path):
    texts, items = made(random.Random(5))
    spark.createDataFrame(texts, "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = D.op2_decontaminate(spark, str(tmp_path))
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == set(brute(texts, items)) and out.where(F.col("score") > 1).count() == 0
