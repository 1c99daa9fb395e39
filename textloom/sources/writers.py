"""Sinks. Single files and markers go through the Hadoop file system of their path."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import quality


def parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def json_dir(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def text_lines(df: DataFrame, path: str, one_file: bool = False, mode: str = "overwrite") -> None:
    """Rows as JSON lines; ``one_file`` is for exports that need a single part."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    (lines.repartition(1) if one_file else lines).write.mode(mode).text(path)


def completion_lines(df: DataFrame, body: str, path: str) -> None:
    text_lines(df.select(F.col(body).alias("text")), path)


def instruction_lines(df: DataFrame, body: str, source: str, path: str) -> None:
    """Posts as (instruction by source, empty input, output)."""
    text_lines(df.select(quality.source_instruction(source).alias("instruction"), F.lit("").alias("input"), F.col(body).alias("output")), path)


def view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def _file(spark: SparkSession, path: str):
    """(file system, path) of a path, wherever it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_file(spark: SparkSession, path: str, content: str) -> None:
    """Write beside, then take the old one's place in one step, where the file system has such."""
    jvm = spark.sparkContext._jvm
    fs, to = _file(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(content.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(to), rename)


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def json_document(df: DataFrame, path: str) -> None:
    """A table of one row as one JSON file."""
    rows = df.select(F.to_json(F.struct(*df.columns))).take(2)
    if len(rows) != 1:
        raise ValueError("one row is needed")
    replace_file(df.sparkSession, path, rows[0][0])


def read_collection(spark: SparkSession, path: str) -> DataFrame | None:
    """The version of a collection that its pointer names; None before the first."""
    pointer = read_file(spark, f"{path}/_CURRENT")
    return spark.read.parquet(f"{path}/{pointer}") if pointer else None


def replace_collection(new: DataFrame, path: str) -> dict[str, int]:
    """Write the rows that have a vector as a new version of a collection, then turn its pointer: a crash
    leaves the old version whole. Versions before the old one go. ``written`` and ``skipped`` rows."""
    spark, version = new.sparkSession, f"v-{uuid.uuid4().hex}"
    old = read_file(spark, f"{path}/_CURRENT")
    fits = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    seen = F.count_if(fits).alias("written"), F.count_if(~fits).alias("skipped")
    new.where(fits).write.parquet(f"{path}/{version}")
    written = spark.read.parquet(f"{path}/{version}").count()
    replace_file(spark, f"{path}/_CURRENT", version)
    fs, p = _file(spark, path)
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, old):
            fs.delete(status.getPath(), True)
    total = new.agg(*seen).first()
    return {"written": written, "skipped": total["skipped"]}


def upsert(new: DataFrame, path: str, key: str) -> dict[str, int]:
    """Merge into a collection, last write wins; rows without a vector are not written but counted."""
    from textloom.operators.analytics import collection_upsert

    fits = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    old = read_collection(new.sparkSession, path)
    skipped = new.where(~fits).count()
    good = new.where(fits)
    done = replace_collection(collection_upsert(old, good, key) if old is not None else good, path)
    return done | {"skipped": skipped}


READY = "_READY"


def promote(df: DataFrame, path: str, dataset: str) -> dict:
    """Write training lines, then the marker beside them that says they are ready and what they are."""
    text_lines(df, path)
    spark: SparkSession = df.sparkSession
    lines = spark.read.text(path).withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -1))
    got = lines.agg(F.count("*").alias("approx_rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("dataset_bytes"), F.array_sort(F.collect_set("part")).alias("source_parts")).first()
    if not got["source_parts"]:
        raise RuntimeError(f"no training lines in {path}")
    marker = {"ready_at": datetime.datetime.now(datetime.UTC).isoformat().replace("+00:00", "Z"), "dataset_key": dataset, **got.asDict()}
    replace_file(spark, f"{path.rstrip('/')}{READY}", json.dumps(marker, indent=2))
    return marker
