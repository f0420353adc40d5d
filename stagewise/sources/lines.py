"""Text formats of samples, ratings, documents and models as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Lines of files below a path; ``pattern`` is a regex on file names."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.where(F.input_file_name().rlike(pattern)) if pattern else lines


def parse_libsvm(line: Column) -> Column:
    """``label idx:val ...`` (separators space, tab, colon) as struct<y, x: array<struct<fea, val>>>.

    Indices become 0-based; of repeated indices the last wins; pairs that are no
    numbers are dropped; an empty line is null.
    """
    parts = F.split(F.trim(line), r"[ \t:]+")
    pairs = F.transform(F.sequence(F.lit(1), F.floor((F.size(parts) - 1) / 2).cast("int")), lambda i: F.struct((F.get(parts, (2 * i - 1).cast("int")).try_cast("int") - 1).alias("fea"), F.get(parts, (2 * i).cast("int")).try_cast("double").alias("val")))
    pairs = F.when(F.size(parts) >= 3, pairs).otherwise(F.array().cast("array<struct<fea:int,val:double>>"))
    good = F.filter(pairs, lambda p: p["fea"].isNotNull() & p["val"].isNotNull())
    # in the order of index and place, the last of an index is followed by another index
    placed = F.array_sort(F.transform(good, lambda p, i: F.struct(p["fea"].alias("fea"), i.alias("i"), p["val"].alias("val"))))
    ends = F.zip_with(placed, F.slice(placed, F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0))), lambda p, q: F.struct(p["fea"].alias("fea"), p["val"].alias("val"), (q.isNull() | (p["fea"] != q["fea"])).alias("last")))
    last = F.transform(F.filter(ends, lambda p: p["last"]), lambda p: F.struct(p["fea"].alias("fea"), p["val"].alias("val")))
    return F.when(F.trim(line) != "", F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("y"), F.array_sort(last).alias("x")))


def parse_tsv(line: Column, num_features: int) -> Column:
    """``f0 ... f(n-1) label`` as struct<y, x: array<double>>; of several labels the last wins."""
    parts = F.transform(F.split(F.trim(line), r"[ \t]+"), lambda p: p.try_cast("double"))
    return F.struct(F.element_at(parts, -1).alias("y"), F.slice(parts, 1, num_features).alias("x"))


def parse_rating(line: Column, num_users: int) -> Column:
    """``user item rating``; item ids follow the user ids in one id space."""
    parts = F.split(F.trim(line), r"[ \t]+")
    return F.struct(parts[0].cast("bigint").alias("user"), (parts[1].cast("bigint") + num_users).alias("item"), parts[2].cast("double").alias("rating"))


def parse_bag_of_words(line: Column) -> Column:
    """``doc word:freq ...`` (words from 1) as struct<doc_id, words>, words 0-based and repeated."""
    parts = F.split(F.trim(line), " ")
    words = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.array_repeat(F.split(p, ":")[0].cast("int") - 1, F.split(p, ":")[1].cast("int")))
    return F.struct(parts[0].cast("bigint").alias("doc_id"), F.flatten(words).alias("words"))


def parse_model(line: Column) -> Column:
    """Weights of one line, separated by commas or spaces."""
    return F.transform(F.split(F.trim(line), "[, ]+"), lambda w: w.cast("double"))


_HEAD, _PAIR = np.dtype([("y", "<f4"), ("n", "<u4")]), np.dtype([("index", "<i4"), ("value", "<f4")])


def encode_binary(samples: DataFrame) -> DataFrame:
    """(id, y, x) as (id, record): little-endian float y, count, then (int index from 1, float value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            offsets, pairs = np.asarray(x.offsets), x.values
            body = np.empty(len(pairs), dtype=_PAIR)
            body["index"], body["value"] = np.asarray(pairs.field("fea")) + 1, np.asarray(pairs.field("val"))
            head = np.empty(batch.num_rows, dtype=_HEAD)
            head["y"], head["n"] = np.asarray(batch.column("y")), np.diff(offsets)
            records = [h.tobytes() + body[a:b].tobytes() for h, a, b in zip(head, offsets.tolist(), offsets[1:].tolist())]
            yield pa.record_batch([batch.column("id"), pa.array(records, pa.binary())], ["id", "record"])

    return samples.select("id", "y", "x").mapInArrow(run, "id bigint, record binary")


def decode_binary(records: DataFrame) -> DataFrame:
    """The samples of ``encode_binary``; a record may hold several samples behind each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for key, raw in zip(batch.column("id").to_pylist(), batch.column("record").to_pylist()):
                at = 0
                while at < len(raw):
                    y, n = np.frombuffer(raw, _HEAD, 1, at)[0]
                    parts.append((key, y, np.frombuffer(raw, _PAIR, n, at + 8)))
                    at += 8 + 8 * int(n)
            size = [len(p) for _, _, p in parts]
            body = np.concatenate([p for _, _, p in parts]) if parts else np.empty(0, _PAIR)
            ids, ys = (np.repeat(np.array([p[i] for p in parts], dtype=kind), size) for i, kind in ((0, np.int64), (1, np.float64)))
            yield pa.record_batch([pa.array(ids), pa.array(ys), pa.array(body["index"] - 1), pa.array(body["value"].astype(np.float64))], ["id", "y", "fea", "val"])

    return records.mapInArrow(run, "id bigint, y double, fea int, val double")


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(id, y, fea, val) of binary sample files below a path; id numbers the files in the order of their names.

    A file is one record of many samples, decoded in one task; ``pattern`` is a regex on file names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("path").rlike(pattern)) if pattern else files
    # names alone reach the driver
    names = spark.createDataFrame(list(enumerate(sorted(r.path for r in files.select("path").collect()))), "id bigint, path string")
    return decode_binary(files.join(F.broadcast(names), "path").select("id", F.col("content").alias("record")))


def write_model(weights: DataFrame, path: str) -> None:
    """One weight per line in key order; files in the order of their names hold ranges of keys."""
    weights.orderBy("key").select(F.col("weight").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """(line, weight) of a model written by line, lines numbered from 0 over files in the order of their names."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("double").alias("weight"))
    sizes = {r.file: r.n for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for file in sorted(sizes):
        starts.append((file, before))
        before += sizes[file]
    # one row a file
    named = spark.createDataFrame(starts, "file string, before bigint")
    place = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    return rows.withColumn("place", place).join(F.broadcast(named), "file").select((F.col("before") + F.col("place")).alias("line"), "weight")
