"""Readers and writers of the corpus' file layouts, all on Spark's own sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share; a folder of the machine only in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexigrid-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: jobs after this one read it, and its lineage ends."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """One object a line.  Strict: a malformed line ends the read; else such lines go and unknown fields are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_by_priority(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """Several JSON-lines folders, the first one's row of a key wins."""
    every = None
    for k, p in enumerate(paths):
        one = read_jsonl(spark, p, schema, strict=False).withColumn("__priority", F.lit(k))
        every = one if every is None else every.unionByName(one)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__priority"))
    return every.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__priority")


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame:
    """Ragged rows: missing last fields are null, surplus ones are dropped."""
    return spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE").option("quote", "").csv(path)


def cues(text: Column) -> Column:
    """WebVTT text -> array of (start, end, text); times in seconds, hours may be missing."""
    pattern = r"((?:\d+:)?\d{2}:\d{2}\.\d{3}) --> ((?:\d+:)?\d{2}:\d{2}\.\d{3})[^\n]*\n([^\n]*)"
    start, end, said = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3))

    def seconds(x: Column) -> Column:
        return F.aggregate(F.split(x, ":"), F.lit(0.0), lambda s, p: s * 60 + p.cast("double"))

    return F.transform(F.arrays_zip(start.alias("a"), end.alias("b"), said.alias("c")), lambda x: F.struct(seconds(x["a"]).alias("start"), seconds(x["b"]).alias("end"), x["c"].alias("text")))


def write_packs(df: DataFrame, path: str, key: Column) -> int:
    """Rows in one folder per key; the rows that are read back must be as many, else the write is refused."""
    df.withColumn("pack", key).write.partitionBy("pack").parquet(path)
    before, after = df.count(), df.sparkSession.read.parquet(path).count()
    if before != after:
        raise ValueError(f"{before} rows in, {after} rows out")
    return after
