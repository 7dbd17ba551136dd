"""Queries of the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import text as T
from .operators import annotate as A
from .operators import windows as N
from .queries_basic import _CONTEXT, _documents, examples
from .registry import query, table


@query("p02_clean", r"SELECT doc_id, regexp_replace(nfc_normalize(text), '^\s+|\s+$', '', 'g') AS text FROM documents")
def _(spark, d):
    # the test texts are in composed form, where both normal forms agree
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


@query("p05_role_content", "SELECT conv_id, string_agg(role || '=' || length(text), ';' ORDER BY turn) AS messages FROM conversations GROUP BY 1")
def _(spark, d):
    m = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    df = _documents(spark, d).select("conv_id", m.alias("m"))
    line = F.transform("m", lambda m: F.concat(m["role"], F.lit("="), F.length(m["content"]).cast("string")))
    return df.select("conv_id", F.array_join(line, ";").alias("messages"))


@query(
    "p10_training_text",
    "SELECT conv_id, text FROM (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1) WHERE text <> ''",
)
def _(spark, d):
    line = F.transform(F.filter("m", lambda m: F.trim(m["text"]) != ""), lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return _documents(spark, d).select("conv_id", F.array_join(line, "\n").alias("text")).where("text <> ''")


@query("p12_quality_filter", "SELECT doc_id FROM documents WHERE length(text) <= 500 AND NOT regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def _(spark, d):
    flag = F.when(F.col("text").rlike(dict(T.PERSONAL)["email"]) | (F.length("text") > 500), "EXCLUDE").otherwise("KEEP")
    return table(spark, d, "documents").withColumn("flag", flag).where("flag <> 'EXCLUDE'").select("doc_id")


@query("d06_total_order", f"WITH {_CONTEXT} SELECT example_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, depth) AS place FROM c")
def _(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn", "depth")
    return examples(spark, d).select("example_id", F.row_number().over(w).cast("long").alias("place"))


@query("d08_fixed_picks", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r IN (1, 5, 9, 13)")
def _(spark, d):
    picks = F.broadcast(spark.createDataFrame([(1,), (5,), (9,), (13,)], "r int"))
    ranked = table(spark, d, "documents").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")))
    return N.first_per_group(ranked, ["lang"], ["doc_id"], 13).join(picks, "r").select("doc_id")


@query(
    "j09_ambiguous_topics",
    "SELECT event_type, user_id, count(DISTINCT props) AS variants FROM events JOIN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 3) USING (user_id) GROUP BY ALL",
)
def _(spark, d):
    e = table(spark, d, "events")
    many = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).where("n > 3").select("user_id")
    return e.join(many, "user_id").groupBy("event_type", "user_id").agg(F.count_distinct("props").alias("variants"))


@query(
    "w04_multiline",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    m AS (SELECT *, sum(contains(line, ',')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS m FROM l)
    SELECT doc_id, m::BIGINT AS message, md5(string_agg(line, chr(10) ORDER BY i)) AS body, count(*) AS n FROM m WHERE m > 0 GROUP BY ALL""",
)
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    run = F.sum(F.col("line").contains(",").cast("int")).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    g = lines.withColumn("message", run).where("message > 0").groupBy("doc_id", "message").agg(F.md5(body).alias("body"), F.count(F.lit(1)).alias("n"))
    return g.select("doc_id", "message", "body", "n")


@query("w05_orphans", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, sum(contains(line, ',')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS m, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE m = 0 AND trim(line) <> '' GROUP BY 1")
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    run = F.sum(F.col("line").contains(",").cast("int")).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("m", run).where((F.col("m") == 0) & (F.trim("line") != "")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("s08_store_scan", "SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'")
    m = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return m.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "l_linenumber")


@query("m03_first_facts", "SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' AND regexp_matches(text, '(?i) of the ') GROUP BY 1")
def _(spark, d):
    from .operators import memory as M

    return M.extract_facts(table(spark, d, "conversations"), "conv_id", "turn", [("of_the", r"(?i) of the ", "fact", "things", "low")]).select("conv_id", "turn")


@query("m13_topk_per_query", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def _(spark, d):
    from .operators import memory as M

    return M.top_k(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey")
