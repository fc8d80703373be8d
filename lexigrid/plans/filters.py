"""Filters and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.registry import query, table

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query("f_content", f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) WHERE length(word) > 2 AND word NOT IN {T.STOPWORDS} GROUP BY word")
def f_content(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    return words.where((F.length("word") > 2) & ~F.col("word").isin(*T.STOPWORDS)).groupBy("word").agg(F.count("*").alias("n"))


@query("f_wordshape", "SELECT word FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z][a-z'']*')")
def f_wordshape(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct().where(F.col("word").rlike("^[a-z][a-z']*$") & ~F.col("word").contains("\n"))


REASON = "CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.quality = 0 THEN 'low_quality' WHEN l.toxic = 1 THEN 'toxic' ELSE 'usable' END"


@query("f_usable", f"SELECT {REASON} AS reason, CAST(count(*) AS BIGINT) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def f_usable(spark, sf):
    """The first failing reason of each document, counted."""
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    reason = F.when(F.col("has").isNull(), "unlabelled").when(F.col("quality") == 0, "low_quality").when(F.col("toxic") == 1, "toxic").otherwise("usable")
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f_quality_fallback", """WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_discount, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_orderkey, l_linenumber) AS rn FROM lineitem)
SELECT l_partkey, l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, l_discount > 0.02 AS low_quality FROM r WHERE (l_discount <= 0.02 AND rn <= 3) OR rn = 1""")
def f_quality_fallback(spark, sf):
    """Up to three rows of each key within the limit, or else its best row, flagged."""
    w = Window.partitionBy("l_partkey").orderBy("l_discount", "l_orderkey", "l_linenumber")
    r = table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w)).where("(l_discount <= 0.02 AND rn <= 3) OR rn = 1")
    return r.select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_discount") > 0.02).alias("low_quality"))


@query("f_variant", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_type, '^PROMO') AND p_size > 1")
def f_variant(spark, sf):
    return table(spark, sf, "part").where(~F.col("p_type").rlike("^PROMO") & (F.col("p_size") > 1)).select("p_partkey")


@query("f_flags", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source")
def f_flags(spark, sf):
    """Sources are on unless a flag says 0, false, no, off or nothing."""
    flags = {"src1": "off", "src2": "", "src3": "1", "src4": "yes"}
    off = [k for k, v in flags.items() if v.strip().lower() in ("0", "false", "no", "off", "")]
    return table(spark, sf, "documents").where(~F.col("source").isin(*off)).groupBy("source").agg(F.count("*").alias("n"))


_ASKED = ("Is it HARAM to ", "can i ", "What is a cane in ", "May a muslim ", "is it okay that ", "the halalness of ", "Where do we ", "allowed? ", "a fatwah ")


@query("f_ruling", f"SELECT conv_id, turn, regexp_matches(({list(_ASKED)})[1 + (conv_id * 3 + turn) % {len(_ASKED)}] || coalesce(text, ''), '{T.RULING}', 'i') AS referred FROM conversations WHERE role = 'user'")
def f_ruling(spark, sf):
    """Users' turns as questions, of which some ask for a ruling."""
    begin = F.get(F.array(*map(F.lit, _ASKED)), ((F.col("conv_id") * 3 + F.col("turn")) % len(_ASKED)).cast("int"))
    rows = table(spark, sf, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", T.asks_ruling(F.concat(begin, F.coalesce("text", F.lit("")))).alias("referred"))


@query("f_name", """WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), n AS (SELECT lower(word) AS word, count(*) AS n, count(*) FILTER (WHERE regexp_matches(word, '^[A-Z]')) AS capital FROM w GROUP BY 1)
SELECT word, CAST(n AS BIGINT) AS n, CAST(capital AS BIGINT) AS capital FROM n WHERE n >= 2 AND 10 * capital >= 9 * n""")
def f_name(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    n = w.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("word").rlike("^[A-Z]")).alias("capital"))
    return n.where("n >= 2 AND 10 * capital >= 9 * n")


@query("f_review", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
def f_review(spark, sf):
    """Optional equality filters; 'open' stands for a list of states."""
    wanted = {"o_orderstatus": {"open": ["F", "P"]}.get("open"), "o_orderpriority": ["1-URGENT"], "o_custkey": None}
    orders = table(spark, sf, "orders")
    for column, values in wanted.items():
        orders = orders.where(F.col(column).isin(*values)) if values else orders
    return orders.select("o_orderkey")


_REF = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', ':') WHEN 2 THEN CAST(page_id % 140 AS VARCHAR) || ':' || CAST(page_id % 7 AS VARCHAR) WHEN 3 THEN upper(url) ELSE CAST(page_id AS VARCHAR) || ':x' END"


@query("f_ref_valid", f"SELECT page_id, (regexp_full_match(r, '[a-z]+://[a-z0-9.-]+/.*') AND length(r) BETWEEN 10 AND 200) OR (regexp_full_match(r, '[0-9]+:[0-9]+') AND coalesce(TRY_CAST(regexp_extract(r, '^([0-9]+):([0-9]+)$', 1) AS BIGINT), 0) BETWEEN 1 AND 114 AND coalesce(TRY_CAST(regexp_extract(r, '^([0-9]+):([0-9]+)$', 2) AS BIGINT), 0) >= 1) AS valid FROM (SELECT page_id, {_REF} AS r FROM pages)")
def f_ref_valid(spark, sf):
    """References are urls, or chapter:verse with chapters 1 to 114 and verses from 1; other ones are made of some urls first."""
    ref = F.expr(_REF.replace("VARCHAR", "STRING")).alias("r")
    chapter, verse = (F.regexp_extract("r", "^([0-9]{1,9}):([0-9]{1,9})$", k) for k in (1, 2))
    url = F.col("r").rlike("^[a-z]+://[a-z0-9.-]+/[^\n]*$") & F.length("r").between(10, 200)
    place = F.when(chapter != "", chapter.cast("long").between(1, 114) & (verse.cast("long") >= 1)).otherwise(False)
    return table(spark, sf, "pages").select("page_id", ref).select("page_id", (url | place).alias("valid"))


@query("f_dur", "SELECT CASE WHEN l_quantity < 5 THEN 'short' WHEN l_quantity > 45 THEN 'long' WHEN l_discount > 0.08 THEN 'unseen' ELSE 'ok' END AS reason, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def f_dur(spark, sf):
    reason = F.when(F.col("l_quantity") < 5, "short").when(F.col("l_quantity") > 45, "long").when(F.col("l_discount") > 0.08, "unseen").otherwise("ok")
    return table(spark, sf, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f_body_checks", """WITH s AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), m AS (SELECT user_id, avg(CASE WHEN abs(value - p) > 50 THEN 1.0::DOUBLE ELSE 0 END) AS jumps, avg(CASE WHEN abs(value - p) < 1 THEN 1.0::DOUBLE ELSE 0 END) AS frozen, max(value) AS top FROM s GROUP BY user_id)
SELECT user_id, concat_ws(',', CASE WHEN jumps > 0.2 THEN 'jumps' END, CASE WHEN frozen > 0.01 THEN 'frozen' END, CASE WHEN top > 100 THEN 'range' END) AS flags FROM m""")
def f_body_checks(spark, sf):
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    m = table(spark, sf, "events").withColumn("step", step).groupBy("user_id").agg(share(F.col("step") > 50).alias("jumps"), share(F.col("step") < 1).alias("frozen"), F.max("value").alias("top"))
    flags = F.array_compact(F.array(F.when(F.col("jumps") > 0.2, "jumps"), F.when(F.col("frozen") > 0.01, "frozen"), F.when(F.col("top") > 100, "range")))
    return m.select("user_id", F.array_join(flags, ",").alias("flags"))


@query("f_label_checks", f"""SELECT doc_id, concat_ws(',', CASE WHEN len(w) < 10 THEN 'short' END, CASE WHEN len(list_filter(w, lambda x: length(x) > 12)) * 10 > len(w) THEN 'long_words' END, CASE WHEN lang <> 'en' THEN 'language' END) AS flags FROM (SELECT doc_id, lang, {WORDS} AS w FROM documents)""")
def f_label_checks(spark, sf):
    w = T.words(F.col("text"))
    long = F.size(F.filter(w, lambda x: F.length(x) > 12)) * 10 > F.size(w)
    flags = F.array_compact(F.array(F.when(F.size(w) < 10, "short"), F.when(long, "long_words"), F.when(F.col("lang") != "en", "language")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"))


@query("f_signer_frames", """WITH m AS (SELECT user_id, value, event_id, median(value) OVER (PARTITION BY user_id) AS mid FROM events) SELECT user_id, CAST(count(*) FILTER (WHERE value BETWEEN 0.6 * mid AND 1.6 * mid) AS BIGINT) AS kept FROM m GROUP BY user_id""")
def f_signer_frames(spark, sf):
    e = table(spark, sf, "events")
    mid = e.groupBy("user_id").agg(F.median("value").alias("mid"))
    near = F.col("value").between(F.col("mid") * F.lit(0.6), F.col("mid") * F.lit(1.6))
    return e.join(mid, "user_id").groupBy("user_id").agg(F.count_if(near).alias("kept"))
