"""Round trips through the file layouts: what is written comes back as it was."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrid.registry import query, table
from lexigrid.sources import files as S

DOCS = "SELECT doc_id, text, lang FROM documents"


@query("src_jsonl", DOCS)
def src_jsonl(spark, sf):
    path = S.scratch(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.json(path)
    return S.read_jsonl(spark, path, "doc_id long, text string, lang string")


@query("src_jsonl_lenient", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS origin FROM customer")
def src_jsonl_lenient(spark, sf):
    """Two folders with unknown fields; the first one's row of a key wins."""
    first, second = S.scratch(spark, "first"), S.scratch(spark, "second")
    c = table(spark, sf, "customer")
    c.where("c_custkey % 2 = 0").withColumn("origin", F.lit("first")).write.json(first)
    c.withColumn("origin", F.lit("second")).write.json(second)
    return S.read_by_priority(spark, [first, second], "c_custkey long, origin string", "c_custkey")


@query("src_json_doc", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def src_json_doc(spark, sf):
    """Documents that hold an array each, one a user."""
    path = S.scratch(spark, "doc")
    rows = F.to_json(F.collect_list(F.struct("event_id", "value"))).alias("value")
    table(spark, sf, "events").groupBy("user_id").agg(rows).select("user_id", "value").write.json(path)
    got = S.read_jsonl(spark, path, "user_id long, value string")
    return got.select("user_id", F.explode(F.from_json("value", "array<struct<event_id:long,value:double>>"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("src_csv", "SELECT n_nationkey, n_name FROM nation")
def src_csv(spark, sf):
    path = S.scratch(spark, "csv")
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(path)


@query("src_delim", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def src_delim(spark, sf):
    """Every third row lacks its last field."""
    path = S.scratch(spark, "delim")
    last = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    table(spark, sf, "part").select(F.concat_ws("|", "p_partkey", "p_name", last)).write.text(path)
    return S.read_delimited(spark, path, "p_partkey long, p_name string, brand string")


@query("src_html_payload", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS INT) AS links FROM pages")
def src_html_payload(spark, sf):
    links = F.size(F.regexp_extract_all("html", F.lit("<a [^>]*href="), F.lit(0)))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), links.alias("links"))


@query("src_vtt", "SELECT conv_id, turn, CAST(turn AS DOUBLE) AS start, turn + 1.5::DOUBLE AS \"end\", CAST(length(text) AS INT) AS n FROM (SELECT conv_id, turn, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM conversations)")
def src_vtt(spark, sf):
    """Turns written as cues and parsed again; a turn's number is its second."""
    c = table(spark, sf, "conversations").withColumn("text", F.translate("text", "\n\r", "  "))
    clock = lambda x: F.format_string("%02d:%02d", F.floor(x / 60), x % 60)
    line = F.format_string("WEBVTT\n\n%s.000 --> %s.500\n%s\n", clock(F.col("turn")), clock(F.col("turn") + 1), "text")
    got = c.select("conv_id", "turn", F.explode(S.cues(line)).alias("cue"))
    return got.select("conv_id", "turn", "cue.start", "cue.end", F.length("cue.text").alias("n"))


@query("snk_split_files", "SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand")
def snk_split_files(spark, sf):
    path = S.scratch(spark, "split")
    table(spark, sf, "part").select("p_partkey", F.col("p_brand")).write.partitionBy("p_brand").json(path)
    return spark.read.schema("p_partkey long, p_brand string").json(path).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("snk_pack_key", "SELECT lpad(CAST(n_regionkey AS VARCHAR), 3, '0') AS pack, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def snk_pack_key(spark, sf):
    """One pack per zero-padded key."""
    path = S.scratch(spark, "packs")
    S.write_packs(table(spark, sf, "nation"), path, F.concat(F.lit("p"), F.lpad(F.col("n_regionkey").cast("string"), 3, "0")))
    return spark.read.parquet(path).groupBy(F.substring("pack", 2, 3).alias("pack")).agg(F.count("*").alias("n"))


@query("snk_pack_chunk", "SELECT source, chunk, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 100) AS BIGINT) AS chunk FROM documents) GROUP BY ALL")
def snk_pack_chunk(spark, sf):
    """Packs of a hundred rows of a source in order of id."""
    path = S.scratch(spark, "chunks")
    chunk = F.floor((F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1) / 100)
    table(spark, sf, "documents").select("source", "doc_id", chunk.alias("chunk")).write.partitionBy("chunk").parquet(path)
    return spark.read.schema("source string, doc_id long, chunk long").parquet(path).groupBy("source", "chunk").agg(F.count("*").alias("n"))


@query("snk_locked_append", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def snk_locked_append(spark, sf):
    path, r = S.scratch(spark, "append"), table(spark, sf, "region").select("r_regionkey", "r_name")
    for _ in range(2):
        r.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("snk_pg_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def snk_pg_update(spark, sf):
    """Decisions merged into a queue by key; rows without one keep their status."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    decided = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("new"))
    return orders.join(decided, "o_orderkey", "left").select("o_orderkey", F.coalesce("new", "o_orderstatus").alias("status"))


@query("snk_md_tex", "SELECT '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation")
def snk_md_tex(spark, sf):
    return table(spark, sf, "nation").select(F.format_string("| %s | %d |", "n_name", "n_regionkey").alias("line"))


@query("snk_jsonl", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def snk_jsonl(spark, sf):
    """Rows as lines of JSON, letters as they are, read back."""
    path = S.scratch(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.option("ignoreNullFields", False).json(path)
    return S.read_jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("snk_report", "SELECT r_name AS region, CAST(count(*) AS BIGINT) AS nations, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def snk_report(spark, sf):
    """A nested report in a folder for each id: a region with its nations, read back."""
    path = S.scratch(spark, "report")
    r = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = r.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))  # a region's nations
    report = rows.select(F.col("r_regionkey").alias("id"), F.struct(F.col("r_name").alias("region"), F.struct(F.size("names").alias("n"), "names").alias("nations")).alias("report"))
    report.write.partitionBy("id").json(path)
    got = spark.read.schema("report struct<region: string, nations: struct<n: long, names: array<string>>>, id int").json(path)
    return got.select("report.region", F.col("report.nations.n").alias("nations"), F.array_join("report.nations.names", ",").alias("names"))
