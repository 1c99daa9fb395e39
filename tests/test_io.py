"""Readers, normalisers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import analytics, joins
from textloom.operators import vector as V
from textloom.plans import config as C
from textloom.plans import prompts
from textloom.sources import readers, writers
from textloom.streaming import incremental


def test_tolerant_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a"}\n\n// note\nnot json\n{"id": "b", "k": 3}\n')
    rows, bad = readers.tolerant_json_lines(spark, str(p), "id string, k int", comments=True)
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("a", None), ("b", 3)] and bad.count() == 1
    assert readers.eval_set(spark, str(p)).count() == 2
    (tmp_path / "empty.jsonl").write_text("// nothing\n")
    with pytest.raises(ValueError):
        readers.eval_set(spark, str(tmp_path / "empty.jsonl"))


def test_json_array(spark, tmp_path):
    assert readers.json_array(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "e.json").write_text("[]")
    assert readers.json_array(spark, str(tmp_path / "e.json")) is None
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "score": "x"}, {"id": "2", "score": "5"}]))
    got = readers.padded(readers.json_array(spark, str(tmp_path / "a.json"), readers.RAW_ITEM), source="s").orderBy("id").collect()
    assert [(r["score"], r["source"]) for r in got] == [(None, "s"), (5, "s")]
    assert readers.json_array(spark, str(tmp_path / "a.json")).columns == ["id", "score"]
    (tmp_path / "bad.json").write_text("[{]")
    with pytest.warns(UserWarning, match="do not fit"):
        assert readers.json_array(spark, str(tmp_path / "bad.json"), "id string") is None


def test_normalisers(spark):
    blog = spark.createDataFrame([(None, None, None, "  ", "t"), ("x" * 600, "d", "u", None, " body ")], readers.RAW_BLOG)
    assert [(len(r["title"]), r["text"]) for r in readers.from_blog(blog).collect()] == [(500, "body")]
    x = spark.createDataFrame([("a" * 24, "", "", False, False), ("a" * 25, "", "", None, None), ("a" * 30, "", "", True, False)], readers.RAW_X)
    assert [len(r["text"]) for r in readers.from_x(x).collect()] == [25]
    li = spark.createDataFrame([("b" * 121, "now")], readers.RAW_LINKEDIN)
    assert readers.from_linkedin(li).first()["title"] == "b" * 120 + "..."
    assert readers.unify(readers.from_x(x), readers.from_x(x)).count() == 1


def test_best_subtitle(spark):
    df = spark.createDataFrame([("v", "a.de.vtt"), ("v", "a.en-orig.vtt"), ("v", "a.en.vtt")], "video_id string, name string")
    assert readers.best_vtt(df).first()["name"] == "a.en.vtt"


def test_whole_files(spark, tmp_path):
    for n in "ba":
        (tmp_path / f"{n}.md").write_text(f"# {n}\n\ntext")
    (tmp_path / "_skip.md").write_text("x")
    assert [r["body"][:3] for r in readers.markdown(spark, str(tmp_path)).collect()] == ["# a", "# b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id int, text string")
    for write, read in ((writers.json_dir, lambda p: spark.read.schema("id int, text string").json(p)), (writers.parquet, spark.read.parquet), (writers.text_lines, lambda p: spark.read.schema("id int, text string").json(p))):
        p = str(tmp_path / write.__name__)
        write(df, p)
        assert sorted(map(tuple, read(p).collect()), key=str) == [(1, "é"), (2, None)]
    got = writers.promote(df, str(tmp_path / "ready"), "k")
    assert got["approx_rows"] == 2 and got["source_parts"] and got["dataset_bytes"] > 0 and got["ready_at"].endswith("Z")
    assert json.loads((tmp_path / "ready_READY").read_text()) == got
    writers.json_document(df.where("id = 1"), str(tmp_path / "one.json"))
    writers.json_document(df.where("id = 1"), str(tmp_path / "one.json"))
    assert json.loads((tmp_path / "one.json").read_text()) == {"id": 1, "text": "é"}
    assert not list(tmp_path.glob("*.tmp"))
    with pytest.raises(ValueError):
        writers.json_document(df, str(tmp_path / "two.json"))
    writers.instruction_lines(df.withColumn("source", F.lit("blog")), "text", "source", str(tmp_path / "i"))
    assert {r["instruction"] for r in spark.read.json(str(tmp_path / "i")).collect()} == {C.SOURCE_INSTRUCTIONS["blog"]}


def test_vector_collection(spark, tmp_path):
    kind = "vec_id int, embedding array<float>"
    p = str(tmp_path / "c")
    assert writers.read_collection(spark, p) is None
    assert writers.upsert(spark.createDataFrame([(1, [1.0]), (2, []), (4, None)], kind), p, "vec_id") == {"written": 1, "skipped": 2}
    assert writers.upsert(spark.createDataFrame([(1, [2.0]), (3, [3.0])], kind), p, "vec_id") == {"written": 2, "skipped": 0}
    assert sorted(map(tuple, writers.read_collection(spark, p).collect())) == [(1, [2.0]), (3, [3.0])]
    # a run that breaks off leaves the old version
    broken = spark.createDataFrame([(7, [7.0])], kind).withColumn("vec_id", F.expr("raise_error('no')").cast("int"))
    with pytest.raises(Exception, match="no"):
        writers.upsert(broken, p, "vec_id")
    assert sorted(map(tuple, writers.read_collection(spark, p).collect())) == [(1, [2.0]), (3, [3.0])]
    assert V.rebuild(spark.createDataFrame([(1, "a b"), (2, " ")], "vec_id int, t string"), "vec_id", "t", V.HashingEmbedder(8), p) == {"written": 1, "skipped": 1}
    assert [r["vec_id"] for r in writers.read_collection(spark, p).collect()] == [1]


def test_marker_is_watched(spark, tmp_path):
    seen, marker, state = [], str(tmp_path / "m"), str(tmp_path / "s")
    assert incremental.watch(spark, marker, state, seen.append, once=True) == 0
    writers.replace_file(spark, marker, '{"ready_at": "1"}')
    assert [incremental.watch(spark, marker, state, seen.append, once=True) for _ in range(2)] == [1, 0]
    assert incremental.watch(spark, marker, state, seen.append, once=True, force=True) == 1
    writers.replace_file(spark, marker, '{"ready_at": "2"}')

    def fail(_):
        raise OSError("broken")

    with pytest.raises(OSError, match="broken"):
        incremental.watch(spark, marker, state, fail, once=True)
    writers.replace_file(spark, state, "no json")
    assert incremental.watch(spark, marker, state, seen.append, once=True) == 1 and [x["ready_at"] for x in seen] == ["1", "1", "2"]

    def stop(_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        incremental.watch(spark, marker, state, seen.append, sleep=stop)


def test_retries_breaker_and_schedule():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return 5

    assert incremental.with_retries(call, sleep=waits.append) == 5 and waits == [3.0, 6.0]
    with pytest.raises(OSError, match="again"):
        calls.clear() or incremental.with_retries(call, tries=2, sleep=waits.append)
    b = incremental.Breaker(3)
    assert [b.note(False) for _ in range(3)] == [True, True, False]
    c = incremental.Breaker(3)
    assert c.note(True) and all(c.note(False) for _ in range(9))
    assert incremental.due(None, "2024-01-07T00:00:00Z") and not incremental.due("2024-01-07T01:00:00Z", "2024-01-13T23:00:00Z") and incremental.due("2024-01-06T23:00:00Z", "2024-01-07T00:00:00Z")
    assert not incremental.due(None, "2024-01-07T00:00:00Z", "None") and incremental.due(None, "2024-01-07T00:00:00Z", "@once") and not incremental.due("2024-01-01T00:00:00Z", "2024-02-07T00:00:00Z", "@once")


def test_stream_takes_new_files_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for batch in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in batch], "id int").write.mode("append").parquet(src)
        incremental.run_once(incremental.new_ids(incremental.read_new(spark, src, "id int"), "id"), out, mark)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_lineage(spark):
    out = spark.createDataFrame([(1, "abc"), (2, "zzz"), (3, "abcdefgh"), (4, "q" * 80)], "out_id int, output string")
    cat = spark.createDataFrame([("s1", "abc"), ("s2", "abcd"), ("s3", "abcde"), ("s4", "q" * 100)], "src string, body string")
    assert sorted(map(tuple, joins.match_lineage(out, cat).collect())) == [(1, "s1", "exact"), (2, None, "none"), (3, "s3", "inside"), (4, "s4", "starts")]
    assert joins.match_lineage(out, cat.where("src <> 's1'")).where("out_id = 1").first()["src"] == "s3"


def test_context_budget(spark):
    rows = [("q", 1, "a", "x" * 60), ("q", 2, "b", "  "), ("q", 3, "c", "y" * 60), ("q", 4, "d", "z" * 60)]
    df = spark.createDataFrame(rows, "q string, r int, d string, t string")
    got = V.context(df, "q", "r", "d", "t", 150).first()["context"]
    assert got.startswith("[Chunk 1 — doc_id=a]\n" + "x" * 60) and "doc_id=b" not in got and got.endswith("...") and "doc_id=d" not in got


class Broken:
    def embed(self, texts):
        raise ValueError("no model")


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id int, t string")
    assert {r["id"]: len(r["embedding"]) for r in V.embed(df, "id", "t", V.HashingEmbedder(8)).collect()} == {1: 8, 2: 0, 3: 8}
    waits = []
    with pytest.raises(RuntimeError, match="3 tries: no model"):
        V.embed_batch(Broken(), ["a"], tries=3, jitter=0, sleep=waits.append)
    assert waits == [1.5, 3.0]

    class Short:
        def embed(self, texts):
            return [[1.0]]

    with pytest.raises(RuntimeError, match="1 vectors for 2 texts"):
        V.embed_batch(Short(), ["a", "b"], tries=1)


def test_embedding_that_fails(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, t string")
    none = type("None_", (), {"embed": lambda self, texts: []})
    assert [r["embedding"] for r in V.embed(df, "id", "t", none(), tries=1).collect()] == [[]]
    with pytest.raises(Exception, match="0 vectors for 1 texts"):
        V.embed(df, "id", "t", none(), tries=1, failed="raise").collect()


def test_prompts():
    profile = {"top_words": ["a", "b"], "themes": ["t"]}
    text = prompts.build_prompt(profile, {"output_type": "post", "length_target_words": [1, 2], "banned": ["x"]}, "ctx", {"topic": "T"})
    assert "Topic: T" in text and "1-2 words" in text and "ctx" in text
    assert prompts.query_text("a", "b", "c") == "a. b. Audience: c."
    assert prompts.persona_query("q", profile) == "q t a b"
    with pytest.raises(KeyError):
        prompts.load_spec({"a": {}}, "b")
    got = prompts.trace(V.EchoGenerator(), profile, {}, {"id": "1", "topic": "T"}, [{"doc_id": "d", "source": "s", "text": "c"}])
    assert got["contexts"] == ["c"] and got["answer"] == "Topic: T" and got["id"] == "1"
    assert prompts.generate(V.EchoGenerator(), "x\ny", 2, len) == "y"
    assert '"tone": 0' in prompts.judge_prompt("a", ("tone",))
    older = prompts.format_prompt("T", "blog_post", {"style": {"characteristic_words": ["w"]}, "rhetorical_patterns": ["p"]}, {"constraints": {"min_words": 7}, "structure": ["s"]}, [{"text": "c" * 900}, {"text": ""}, {"text": "d"}])
    assert "c" * 500 + "\n---\nd\n" in older and "c" * 501 not in older and "Word count: 7-500. Structure: s." in older and older.endswith("Now write a blog post about: T\n\n### Response:\n")
    assert "(no context available)" in prompts.format_prompt("T", "x", {}, {}, [])


def test_validation_gate(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        analytics.require_rows(df, F.col("id") >= 0, 20)
    assert analytics.require_rows(df, F.col("id") > 0, 2) == 2


def test_anchor_texts(spark):
    body = "word " * 40
    rows = [(1, None, body + "\nRelated Posts\nx"), (2, " ", body + "\nRelated Posts\ny"), (3, "short", body), (4, "other " * 33, None)]
    got = readers.anchor_texts(spark.createDataFrame(rows, "n int, output string, text string"), "n").collect()
    assert [(r["n"], r["anchor"]) for r in got] == [(1, body.strip()), (4, ("other " * 33).strip())]
