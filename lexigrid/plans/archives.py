"""Packs, matrices and archives: written from a table, read back by part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexigrid.registry import query, table
from lexigrid.sources import archives as A
from lexigrid.sources.files import scratch


def _packs(spark, sf):
    """Embeddings as packs of some hundred arrays."""
    folder = scratch(A.registered(spark), "packs")
    v = table(spark, sf, "embeddings").where("embedding is not null")
    A.write_packs(v.select(F.concat(F.lit("v"), F.col("vec_id")).alias("name"), "embedding", "vec_id"), folder, F.expr("vec_id div 100"), "name", "embedding").agg(F.sum("members")).collect()
    return spark.read.format("packs").load(folder)


@query("src_npz_pack", "SELECT (vec_id // 100)::VARCHAR AS pack, 'v' || vec_id AS name, len(embedding)::INTEGER AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE embedding IS NOT NULL")
def src_npz_pack(spark, sf):
    got = _packs(spark, sf)
    return got.select("pack", "name", F.get("shape", F.lit(0)).alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("src_npy", "SELECT 'v' || vec_id AS name, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE embedding IS NOT NULL")
def src_npy(spark, sf):
    """One array a file, found by its path."""
    folder = scratch(spark, "npy")

    def save(frames):
        for frame in frames:
            for i, values in zip(frame["vec_id"], frame["embedding"], strict=True):
                A.replaced(f"{folder}/{i % 16}", f"v{i}.npy", A.array_bytes(np.asarray(values, np.float32)))
            yield frame[["vec_id"]]

    v = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    paths = v.mapInPandas(save, "vec_id long").groupBy((F.col("vec_id") % 16).alias("part")).count().collect()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load([f"{folder}/{r.part}" for r in paths]) if paths else spark.createDataFrame([], "path string, content binary")

    @F.pandas_udf("array<double>")
    def values(content):
        return content.map(lambda b: np.lib.format.read_array(A.io.BytesIO(b)).astype(float).tolist())

    return files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("name"), F.round(F.get(values("content"), F.lit(0)), 6).alias("first"))


DIMS = 16


@query("src_memmap", f"SELECT item, start, n, round(sum(v), 4) AS total FROM (SELECT 'i' || (p_partkey // 7) AS item, min(p_partkey) OVER (PARTITION BY p_partkey // 7) AS start, count(*) OVER (PARTITION BY p_partkey // 7) AS n, CAST(p_size * {DIMS} AS DOUBLE) AS v FROM part) GROUP BY item, start, n")
def src_memmap(spark, sf):
    """Sizes of parts as rows of a matrix of 16-bit floats; items are slices (start, length) of it."""
    A.registered(spark)
    folder = scratch(spark, "matrix")
    rows = table(spark, sf, "part").select("p_partkey", "p_size")
    blocks = 1000

    def save(frame):
        b, out = int(frame["b"].iloc[0]), np.zeros((blocks, DIMS), np.float16)
        out[frame["p_partkey"] - b * blocks] = np.asarray(frame["p_size"])[:, None]
        A.replaced(folder, f"{b:012}.f16", out.tobytes())
        return frame[["b"]].head(1)

    rows.withColumn("b", F.expr(f"p_partkey div {blocks}")).groupBy("b").applyInPandas(save, "b long").agg(F.count("*")).collect()
    matrix = spark.read.format("matrix").option("dims", DIMS).load(folder)
    items = rows.groupBy(F.expr("p_partkey div 7").alias("i")).agg(F.min("p_partkey").alias("start"), F.count("*").alias("n"))
    each = items.select("i", "start", "n", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("row"))
    total = each.join(matrix, "row").groupBy("i", "start", "n").agg(F.sum(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)).alias("total"))
    return total.select(F.concat(F.lit("i"), F.col("i")).alias("item"), "start", "n", F.round("total", 4).alias("total"))


_SPLIT = "CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 < 9 THEN 'val' ELSE 'test' END"


@query("src_zip_splits", f"SELECT (p_partkey // 500)::VARCHAR || '.zip' AS archive, {_SPLIT} AS split, p_brand AS participant, 'clips/' || p_partkey || '.mp4' AS file, p_name AS gloss FROM part")
def src_zip_splits(spark, sf):
    """Parts as lists of clips inside archives: every list under its own name and headers, beside members that are none."""
    A.registered(spark)
    folder = scratch(spark, "splits")
    heads = {"train": ("Video file", "Gloss", "Participant ID"), "val": ("filename", " label ", "user"), "test": ("video_file", "gloss", "participant_id")}

    def members(rows):
        out = {"readme.txt": b"train lists", "clips/0.mp4": b"\x00"}
        for split, some in rows.groupby("split"):
            text = A.io.StringIO()
            w = A.csv.writer(text)
            w.writerow(heads[split])
            w.writerows(zip(some["file"], " " + some["gloss"] + " ", some["participant"], strict=True))
            out[f"lists/{split.upper()}_list.csv"] = text.getvalue().encode()
        return out

    p = table(spark, sf, "part").select(F.expr("p_partkey div 500").alias("k"), F.expr(_SPLIT).alias("split"), F.col("p_brand").alias("participant"), F.concat(F.lit("clips/"), F.col("p_partkey"), F.lit(".mp4")).alias("file"), F.col("p_name").alias("gloss"))
    A.write_archives(p, folder, F.col("k"), members).agg(F.sum("members")).collect()
    return spark.read.format("zip_splits").load(folder)


#: So many members an archive, for all languages together: some 10 MB of text.
A_FILE = 50


@query("src_zip_utf16", "SELECT lang || '.zip' AS archive, count(*) AS lines, sum(length(u)) AS letters FROM (SELECT lang, substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1) AS u FROM documents) GROUP BY lang")
def src_zip_utf16(spark, sf):
    """Documents a line each in UTF-16, archives by language, some hundred documents a member, every second one with a mark."""
    A.registered(spark)
    folder = scratch(spark, "utf16")

    def members(rows):
        return {f"{m}.txt": (b"\xff\xfe" if m % 2 else b"") + "".join(t + "\r\n" for t in some["text"]).encode("utf-16-le") for m, some in rows.groupby("member")}

    d = table(spark, sf, "documents").select("lang", F.expr("doc_id div 100").alias("member"), F.translate("text", "\n\r", "  ").alias("text"))
    A.write_archives(d, folder, F.concat_ws("-", "lang", F.expr(f"member div {A_FILE}")), members).agg(F.sum("members")).collect()
    got = spark.read.format("zip_utf16").load(folder)
    return got.groupBy(F.concat(F.split_part("archive", F.lit("-"), F.lit(1)), F.lit(".zip")).alias("archive")).agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("letters"))
