"""Queries of validation and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import params
from .functions import text as T
from .operators import annotate as A
from .operators import profile as P
from .operators import quality as Q
from .operators import windows as N
from .queries_annotate import _PAIRS, _TOKENS, _TOPICS, pairs
from .queries_basic import _CONTEXT, _SPLIT, _documents, examples, split
from .registry import query, table

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
_OUT = "severity, key, place, rule, rule || ' at ' || key AS message"

# --- validation ----------------------------------------------------------------------------------


@query("q01_schema_rules", "SELECT 'ERROR' AS severity, event_id::VARCHAR AS key, 0::BIGINT AS place, 'missing_id' AS rule, 'missing_id at ' || event_id AS message FROM events")
def _(spark, d):
    df = table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), "props")
    return Q.schema_rules(df, "props", ["id"], ["id", "k"])


@query(
    "q01_schema_issues",
    """WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY 1),
    e AS (SELECT conv_id, unnest(range(0, CASE WHEN conv_id % 5 = 0 THEN 1 ELSE len(t) END)) AS place, CASE WHEN conv_id % 5 = 0 THEN 1 ELSE len(t) END AS n FROM c),
    i AS (SELECT conv_id, NULL::BIGINT AS place, 'messages under 2' AS rule FROM e WHERE n < 2 AND conv_id % 11 > 0 GROUP BY conv_id
      UNION ALL SELECT conv_id, NULL, 'no JSON' FROM c WHERE conv_id % 11 = 0
      UNION ALL SELECT conv_id, NULL, 'document has unknown keys' FROM c WHERE conv_id % 7 = 0 AND conv_id % 11 > 0
      UNION ALL SELECT conv_id, NULL, 'persona_id is not of kind string' FROM c WHERE conv_id % 3 = 0 AND conv_id % 11 > 0
      UNION ALL SELECT conv_id, place, 'messages: missing text' FROM e WHERE (conv_id + place) % 4 = 0 AND conv_id % 11 > 0)
    SELECT 'ERROR' AS severity, conv_id::VARCHAR AS key, place, rule, rule || ' at ' || conv_id || coalesce(' element ' || place, '') AS message FROM i""",
)
def _(spark, d):
    """Conversations as JSON documents with faults in some: cut text, a strange key, a number for a string, one message, no text."""
    k = F.col("conv_id")
    m = F.struct("turn", F.col("role").alias("speaker"), "text")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("m"))
    kept = F.when(k % 5 == 0, F.slice("m", 1, 1)).otherwise(F.col("m"))
    said = F.transform(kept, lambda x, i: F.struct(x["speaker"].alias("speaker"), F.when((k + i) % 4 != 0, x["text"]).alias("text")))
    odd = F.when(k % 3 == 0, "7").otherwise('"p"')
    doc = F.concat(F.lit('{"conversation_id": "'), k.cast("string"), F.lit('", "persona_id": '), odd, F.when(k % 7 == 0, ', "extra": 1').otherwise(""), F.lit(', "messages": '), F.to_json(said), F.lit("}"))
    doc = F.when(k % 11 == 0, F.substring(doc, 1, 20)).otherwise(doc)
    return Q.schema_issues(rows.select("conv_id", doc.alias("doc")), "conv_id", "doc", Q.CONVERSATION_RULES)


@query(
    "q02_duplicates",
    f"""SELECT {_OUT} FROM (SELECT 'ERROR' AS severity, user_id::VARCHAR AS key, event_id AS place, 'duplicate_id' AS rule FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1)""",
)
def _(spark, d):
    return Q.duplicate_keys(table(spark, d, "events"), "user_id", "event_id")


@query(
    "q03_array_bounds",
    f"""SELECT {_OUT} FROM (SELECT conv_id::VARCHAR AS key, count(*) AS place, unnest(['too_few', 'too_many']) AS rule, unnest(['ERROR', 'WARNING']) AS severity FROM conversations GROUP BY 1)
    WHERE (rule = 'too_few' AND place < 3) OR (rule = 'too_many' AND place > 6)""",
)
def _(spark, d):
    return Q.array_bounds(_documents(spark, d), "conv_id", "m", 3, 6)


@query(
    "q04_element_checks",
    f"""SELECT {_OUT} FROM (SELECT conv_id::VARCHAR AS key, turn AS place, 'WARNING' AS severity, 'long_text' AS rule FROM conversations WHERE length(text) > 400
    UNION ALL SELECT conv_id::VARCHAR, turn, 'ERROR', 'unknown_speaker' FROM conversations WHERE role NOT IN ('user', 'assistant'))""",
)
def _(spark, d):
    return Q.element_checks(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", ["user", "assistant"], 400)


@query(
    "q05_participants",
    f"""SELECT {_OUT} FROM (SELECT conv_id::VARCHAR AS key, count(*) AS place, 'WARNING' AS severity, 'no_persona' AS rule FROM conversations GROUP BY 1 HAVING NOT bool_or(role = 'assistant') AND count(*) > 1
    UNION ALL SELECT conv_id::VARCHAR, count(*), 'WARNING', 'no_partner' FROM conversations GROUP BY 1 HAVING bool_and(role = 'assistant') AND count(*) > 1)""",
)
def _(spark, d):
    return Q.participants(table(spark, d, "conversations"), "conv_id", F.col("role") == "assistant")


@query("q06_summary", "SELECT count_if(role NOT IN ('user', 'assistant'))::BIGINT AS errors, count_if(length(text) > 400)::BIGINT AS warnings, count_if(role NOT IN ('user', 'assistant')) = 0 AS valid FROM conversations")
def _(spark, d):
    return Q.summary(Q.element_checks(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", ["user", "assistant"], 400))


@query("q07_example_checks", f"WITH {_CONTEXT} SELECT 'WARNING' AS severity, example_id AS key, depth::BIGINT AS place, 'long_target' AS rule, 'long_target at ' || example_id AS message FROM c WHERE length(text) > 300")
def _(spark, d):
    rules = [
        ("ERROR", "too_few", F.size("context") < 1), ("ERROR", "blank", T.strip(F.col("text")) == ""), ("WARNING", "long_target", F.length("text") > 300),
        ("ERROR", "bad_role", F.exists("context", lambda m: ~m["role"].isin("user", "assistant", "system"))), ("ERROR", "leaked_metadata", F.col("text").contains("example_id")),
    ]
    return Q.issues(examples(spark, d), F.col("example_id"), F.col("depth"), rules)


@query("q08_duplicate_in_split", f"WITH {_SPLIT} SELECT split, text, count(*) AS n FROM conversations JOIN g USING (conv_id) GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return split(spark, d).groupBy("split", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("q09_expected_sizes", f"WITH {_SPLIT} SELECT split, count(DISTINCT conv_id) AS n, count(DISTINCT conv_id) = CASE split WHEN 'train' THEN 70 WHEN 'val' THEN 10 ELSE 20 END AS as_expected FROM conversations JOIN g USING (conv_id) GROUP BY 1")
def _(spark, d):
    want = F.when(F.col("split") == "train", 70).when(F.col("split") == "val", 10).otherwise(20)
    return split(spark, d).groupBy("split").agg(F.count_distinct("conv_id").alias("n")).withColumn("as_expected", F.col("n") == want)


@query("q10_completeness", "SELECT count_if(text IS NULL OR trim(text) = '')::BIGINT AS blank, count_if(lang IS NULL)::BIGINT AS no_lang, count_if(n_chars <> length(text))::BIGINT AS changed FROM documents")
def _(spark, d):
    c = F.col
    return Q.consistency(table(spark, d, "documents"), {"blank": c("text").isNotNull() & (F.trim("text") != ""), "no_lang": c("lang").isNotNull(), "changed": c("n_chars") == F.length("text")})


@query("q11_repeats", "SELECT count(*) AS distinct_rows, sum(n - 1)::BIGINT AS surplus FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)")
def _(spark, d):
    return Q.surplus(table(spark, d, "documents"), ["text"])


@query(
    "q12_consistency",
    f"SELECT count_if(contains(text, '?') AND NOT regexp_matches(text, '[?]'))::BIGINT AS flag, count_if(n_chars < {_WORDS})::BIGINT AS lengths, count_if(lower(lang) <> lang)::BIGINT AS lang FROM documents",
)
def _(spark, d):
    c = F.col
    return Q.consistency(table(spark, d, "documents"), {"flag": ~c("text").contains("?") | c("text").rlike("[?]"), "lengths": c("n_chars") >= F.size(T.words(c("text"))), "lang": F.lower("lang") == c("lang")})


_HITS = {x: f"len(list_intersect(list_distinct({_TOK}), [" + ", ".join(f"'{y}'" for y in w) + "]))" for x, w in params.LEXICON.items()}
_LIKELY = f"""h AS (SELECT doc_id, text, lang, n_chars, {', '.join(f"{c} AS h_{x}" for x, c in _HITS.items())} FROM documents),
    r AS (SELECT *, CASE greatest({', '.join(f'h_{x}' for x in _HITS)}) WHEN 0 THEN 'unknown' {' '.join(f"WHEN h_{x} THEN '{x}'" for x in _HITS)} END AS likely FROM h)"""
_AUDIT = f"""{_LIKELY}, c AS (SELECT r.*, quality FROM r LEFT JOIN labels USING (doc_id)),
    a AS (SELECT 'language' AS check_name, count(lang) AS n, count_if(lang <> likely)::BIGINT AS wrong FROM c UNION ALL SELECT 'length', count(n_chars), count_if(n_chars <> length(text)) FROM c
      UNION ALL SELECT 'quality', count(quality), count_if((quality = 1) <> (n_chars >= 200)) FROM c),
    b AS (SELECT *, round(wrong / greatest(n, 1), 4) AS share FROM a)"""


def _audit(spark, d):
    """Stored against recomputed: the language, the length, and the quality label against the rule that short texts are bad."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    c = F.col
    checks = {
        "language": c("lang") == A.likely_language(c("text"), params.LEXICON), "length": c("n_chars") == F.length("text"),
        "quality": (c("quality") == 1) == (c("n_chars") >= 200),
    }
    return Q.label_audit(docs, checks)


@query("q12_label_audit", f'WITH {_AUDIT} SELECT check_name AS "check", n, wrong, share FROM b')
def _(spark, d):
    return _audit(spark, d)


@query(
    "q17_release",
    f"WITH {_AUDIT} SELECT count_if(share > CASE check_name WHEN 'language' THEN 0.5 ELSE 0.0 END) = 0 AS go, coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (share > CASE check_name WHEN 'language' THEN 0.5 ELSE 0.0 END), '') AS failed FROM b",
)
def _(spark, d):
    return Q.release(_audit(spark, d), {"language": 0.5})


@query(
    "q14_suspicious_labels",
    f"""WITH {_LIKELY}, s AS (SELECT doc_id::VARCHAR AS key, 0 AS priority, 'wrong_language' AS category FROM r WHERE lang <> likely UNION ALL SELECT doc_id::VARCHAR, 1, 'no_language' FROM r WHERE likely = 'unknown'
      UNION ALL SELECT doc_id::VARCHAR, 2, 'wrong_length' FROM r WHERE n_chars <> length(text) UNION ALL SELECT doc_id::VARCHAR, 3, 'personal_data' FROM r WHERE contains(text, '@')
      UNION ALL SELECT doc_id::VARCHAR, 4, 'copied' FROM r WHERE md5(text) IN (SELECT md5(text) FROM r GROUP BY 1 HAVING count(*) > 1))
    SELECT key, priority, category FROM s ORDER BY priority, key LIMIT 100""",
)
def _(spark, d):
    c = F.col
    likely = A.likely_language(c("text"), params.LEXICON)
    # what the rules see of a text stands in an array that is exploded, so that it is computed once
    seen = F.struct(likely.alias("likely"), (c("n_chars") != F.length("text")).alias("wrong"), c("text").contains("@").alias("mail"), F.md5("text").alias("h"))
    df = table(spark, d, "documents").select(c("doc_id").alias("key"), "lang", F.inline(F.array(seen)))
    copies = table(spark, d, "documents").groupBy(F.md5("text").alias("h")).count().where("count > 1").select("h", F.lit(True).alias("copied"))
    rules = {"wrong_language": c("lang") != c("likely"), "no_language": c("likely") == "unknown", "wrong_length": c("wrong"), "personal_data": c("mail"), "copied": c("copied")}
    return Q.suspicious_rows(df.join(copies, "h", "left"), rules)


_LEX = "lex(rank, topic, term, weight) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}', {w}::DOUBLE)" for a, b, c, w in params.TOPICS) + ")"


@query("q13_missed_topics", f"WITH {_LEX} SELECT doc_id, string_agg(DISTINCT topic, ',' ORDER BY topic) AS domains FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) JOIN lex USING (term) GROUP BY 1")
def _(spark, d):
    lex = F.broadcast(spark.createDataFrame(params.TOPICS, "rank int, topic string, term string, weight double"))
    t = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return t.join(lex, "term").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("domains"))


@query(
    "q14_suspicious",
    """SELECT key, priority, category FROM (SELECT doc_id::VARCHAR AS key, 0 AS priority, 'secret' AS category FROM documents WHERE contains(text, '@') UNION ALL SELECT doc_id::VARCHAR, 1, 'long' FROM documents WHERE n_chars > 8000) ORDER BY priority, key LIMIT 100""",
)
def _(spark, d):
    df = table(spark, d, "documents").withColumn("key", F.col("doc_id"))
    return Q.suspicious({"secret": df.where(F.col("text").contains("@")), "long": df.where("n_chars > 8000")})


@query("q15_answer_crosscheck", "SELECT count_if(contains(b, '?'))::BIGINT AS after_question, count_if(NOT contains(b, '?'))::BIGINT AS after_other FROM (SELECT role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE role = 'assistant' AND b IS NOT NULL")
def _(spark, d):
    df = table(spark, d, "conversations").withColumn("b", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant' AND b IS NOT NULL")
    return df.agg(F.count_if(F.col("b").contains("?")).alias("after_question"), F.count_if(~F.col("b").contains("?")).alias("after_other"))


@query("q16_unknown_language", r"SELECT count_if(regexp_full_match(trim(text), '[0-9 ]+'))::BIGINT AS digits, count_if(NOT regexp_matches(text, '\p{L}|\p{N}'))::BIGINT AS marks FROM documents")
def _(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").agg(F.count_if(F.trim(c).rlike("^[0-9 ]+$")).alias("digits"), F.count_if(~c.rlike(r"\p{L}|\p{N}")).alias("marks"))


@query("q17_go_no_go", "SELECT count_if(n_chars <> length(text)) = 0 AND count_if(lang IS NULL) = 0 AS go FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(((F.count_if(F.col("n_chars") != F.length("text")) == 0) & (F.count_if(F.col("lang").isNull()) == 0)).alias("go"))


# --- profiles --------------------------------------------------------------------------------------


@query("g01_totals", "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("conv_id").alias("conversations"))


@query("g02_lengths", f"SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, median(length(text)) AS median_chars, round(avg({_WORDS}), 4) AS mean_words, median({_WORDS}) AS median_words FROM conversations GROUP BY 1")
def _(spark, d):
    return P.length_stats(table(spark, d, "conversations"), "text", ["role"])


@query("g03_rates", "SELECT round(count_if(contains(text, '?')) / count(*), 4) AS question, round(count_if(contains(text, '!')) / count(*), 4) AS exclamation FROM documents")
def _(spark, d):
    return P.rates(table(spark, d, "documents"), {"question": F.col("text").contains("?"), "exclamation": F.col("text").contains("!")})


@query("g04_top_tokens", f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOK}) AS term FROM documents) WHERE length(term) > 1 GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def _(spark, d):
    return P.top_k(P.terms(table(spark, d, "documents"), "text"), "term", 20)


@query(
    "g05_top_bigrams",
    f"SELECT t[i] || ' ' || t[i + 1] AS term, count(*) AS n FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT {_TOK} AS t FROM documents)) GROUP BY 1 ORDER BY n DESC, term LIMIT 10",
)
def _(spark, d):
    return P.top_bigrams(table(spark, d, "documents"), "text", 10)


@query("g06_top_symbols", r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{So}\p{Sk}\p{Sm}\p{Sc}]')) AS term FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 10")
def _(spark, d):
    df = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{So}\p{Sk}\p{Sm}\p{Sc}]"), 0)).alias("term"))
    return P.top_k(df, "term", 10)


@query("g07_label_distribution", "SELECT 'quality' AS label, quality AS value, count(*) AS n FROM labels GROUP BY ALL UNION ALL SELECT 'toxic', toxic, count(*) FROM labels GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "label", "value").groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g08_style_profile",
    "SELECT CASE WHEN length(text) <= 50 THEN 'a' WHEN length(text) <= 150 THEN 'b' WHEN length(text) <= 400 THEN 'c' ELSE 'd' END AS bucket, count(*) AS n, round(avg(contains(text, '?')::INT), 4) AS questions FROM conversations WHERE role = 'assistant' GROUP BY 1",
)
def _(spark, d):
    n = F.length("text")
    bucket = F.when(n <= 50, "a").when(n <= 150, "b").when(n <= 400, "c").otherwise("d")
    df = table(spark, d, "conversations").where("role = 'assistant'")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("text").contains("?").cast("int")), 4).alias("questions"))


@query("g09_example_profile", f"WITH {_CONTEXT} SELECT depth, count(*) AS n, count(DISTINCT text) AS targets, count(*) - count(DISTINCT text) AS surplus FROM c GROUP BY 1")
def _(spark, d):
    df = examples(spark, d).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("targets"))
    return df.withColumn("surplus", F.col("n") - F.col("targets"))


@query("g10_raw_audit", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) - count(DISTINCT (user_id, props)) AS repeats FROM events GROUP BY 1")
def _(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), us(F.min("ts")).alias("first_us"), us(F.max("ts")).alias("last_us"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct("user_id", "props"))).alias("repeats"),
    )


@query("g11_multiplicity", f"WITH {_CONTEXT} SELECT m, count(*) AS n FROM (SELECT conv_id, turn, count(*) AS m FROM c GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    return examples(spark, d).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))


_PCT = "round(avg(v), 2) AS mean, round(median(v), 2) AS median, round(quantile_cont(v, 0.25), 2) AS p25, round(quantile_cont(v, 0.75), 2) AS p75, round(quantile_cont(v, 0.9), 2) AS p90, round(quantile_cont(v, 0.95), 2) AS p95, max(v)::DOUBLE AS max"


@query("g12_group_sizes", f"WITH {_SPLIT} SELECT split, {_PCT} FROM (SELECT split, conv_id, count(*)::DOUBLE AS v FROM conversations JOIN g USING (conv_id) GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    return P.percentiles(split(spark, d).groupBy("split", "conv_id").agg(F.count(F.lit(1)).cast("double").alias("v")), "v", ["split"])


@query(
    "g13_dominance",
    """SELECT k, c::BIGINT AS rows, round(c * 100.0 / t, 4) AS percent FROM (SELECT row_number() OVER (ORDER BY n DESC, source) AS r, sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER () AS t, count(*) OVER () AS groups
    FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)), (VALUES (1), (5), (10), (20), (50)) v(k) WHERE r = least(k, groups)""",
)
def _(spark, d):
    return P.dominance(table(spark, d, "documents"), "source", [1, 5, 10, 20, 50])


@query("g14_crosstab", f"WITH {_SPLIT} SELECT split, role, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 4) AS percent FROM conversations JOIN g USING (conv_id) GROUP BY split, role")
def _(spark, d):
    return P.crosstab(split(spark, d), "split", "role")


@query(
    "g15_head_concentration",
    f"""WITH {_SPLIT}, s AS (SELECT text, split FROM conversations JOIN g USING (conv_id)), h AS (SELECT text FROM s GROUP BY 1 ORDER BY count(*) DESC, text LIMIT 20)
    SELECT text, count_if(split = 'train')::BIGINT AS train, count_if(split = 'val')::BIGINT AS val, count_if(split = 'test')::BIGINT AS test FROM s JOIN h USING (text) GROUP BY 1""",
)
def _(spark, d):
    s = split(spark, d)
    head = P.top_k(s, "text", 20).select("text")
    return s.join(F.broadcast(head), "text").groupBy("text").agg(*[F.count_if(F.col("split") == k).alias(k) for k in ("train", "val", "test")])


@query("g16_one_to_many", "SELECT user_id AS prompt, count(DISTINCT props) AS targets FROM events GROUP BY 1 HAVING count(DISTINCT props) > 1 ORDER BY targets DESC, prompt LIMIT 15")
def _(spark, d):
    df = table(spark, d, "events").groupBy(F.col("user_id").alias("prompt")).agg(F.count_distinct("props").alias("targets")).where("targets > 1")
    return df.orderBy(F.desc("targets"), "prompt").limit(15)


@query("g17_artifacts", f"WITH {_SPLIT} SELECT split, count_if(contains(text, '@'))::BIGINT AS artifacts FROM conversations JOIN g USING (conv_id) GROUP BY 1")
def _(spark, d):
    return split(spark, d).groupBy("split").agg(F.count_if(F.col("text").contains("@")).alias("artifacts"))


@query(
    "g18_ambiguous_prompts",
    """SELECT prompt, count(DISTINCT v) AS responses, count(*) AS n FROM (SELECT lower(array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')[1:4], ' ')) AS prompt, md5(text) AS v FROM documents)
    WHERE prompt <> '' GROUP BY 1 HAVING count(DISTINCT v) >= 2 ORDER BY responses DESC, prompt LIMIT 30""",
)
def _(spark, d):
    words = F.slice(F.regexp_extract_all("text", F.lit(T.WORD), 0), 1, 4)
    df = table(spark, d, "documents").select(F.lower(F.array_join(words, " ")).alias("prompt"), F.md5("text").alias("v")).where("prompt <> ''")
    out = df.groupBy("prompt").agg(F.count_distinct("v").alias("responses"), F.count(F.lit(1)).alias("n")).where("responses >= 2")
    return out.orderBy(F.desc("responses"), "prompt").limit(30)


@query("g19_confidence_profile", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query(
    "g18_prompts_of_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), p AS (SELECT line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS response FROM l),
    n AS (SELECT response, trim(regexp_replace(regexp_replace(line, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM p WHERE response IS NOT NULL),
    c AS (SELECT array_to_string(list_transform(string_split(lower(k), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS prompt, response FROM n WHERE k <> '' AND len(string_split(k, ' ')) <= 4)
    SELECT prompt, count(DISTINCT response) AS responses, list_has_any(string_split(lower(prompt), ' '), ['thank', 'home', 'the', 'la', 'der']) AS priority FROM c GROUP BY prompt HAVING count(DISTINCT response) >= 2""",
)
def _(spark, d):
    lines = table(spark, d, "documents").select(F.split("text", "\n").alias("l"))
    both = F.arrays_zip(F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))).alias("prompt"), F.slice("l", F.lit(2), F.size("l")).alias("response"))
    return P.ambiguous_prompts(lines.where(F.size("l") > 1).select(F.inline(both)), "prompt", "response", ["thank", "home", "the", "la", "der"])


@query(
    "g19_topic_confidence",
    f"""WITH {_TOPICS}, {_PAIRS}, hit AS (SELECT k, rank, topic, sum(weight * (CASE WHEN list_contains({_TOKENS.format('prompt')}, term) THEN 1.8 ELSE 0 END
      + CASE WHEN list_contains({_TOKENS.format('target')}, term) THEN 1.3 WHEN list_contains({_TOKENS.format('context')}, term) THEN 0.9 ELSE 0 END)) AS score FROM
      (SELECT k, coalesce(prompt, '') AS prompt, target, context FROM pairs), lex GROUP BY ALL),
    best AS (SELECT k, score, topic FROM hit QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, rank) = 1),
    x AS (SELECT p.k, length(target) AS size, CASE WHEN round(score, 9) < 1.0 THEN CASE WHEN len(list_filter(regexp_split_to_array(target, '\\s+'), lambda x: x <> '')) <= 4 THEN 'casual_chat' ELSE 'other' END ELSE topic END AS topic,
      round(greatest(0.2, least(1.0, score / 5.0)), 4) AS confidence FROM pairs p JOIN best USING (k)),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY confidence DESC, k) AS r FROM x)
    SELECT topic, count(*) AS n, round(avg(confidence::DECIMAL(12,6)), 4) AS mean_confidence, min(confidence) AS least, max(confidence) AS most, round(avg(size), 4) AS mean_score, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent,
      string_agg(k::VARCHAR, ',' ORDER BY r) FILTER (r <= 10) AS samples FROM r GROUP BY topic""",
)
def _(spark, d):
    p = pairs(spark, d)
    x = A.classify_topic(p, "k", "prompt", "target", "context", params.TOPICS).join(p.select("k", F.length("target").alias("size")), "k")
    return P.confidence_profile(x, "topic", "k", "confidence", "size").withColumn("samples", F.array_join(F.transform("samples", lambda k: k.cast("string")), ","))


@query("g20_flag_crosscounts", "SELECT lang, count_if(contains(text, '?'))::BIGINT AS q, count_if(contains(text, '!'))::BIGINT AS e, count_if(contains(text, '?') AND contains(text, '!'))::BIGINT AS qe FROM documents GROUP BY 1")
def _(spark, d):
    q, e = F.col("text").contains("?"), F.col("text").contains("!")
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(q).alias("q"), F.count_if(e).alias("e"), F.count_if(q & e).alias("qe"))


@query("g21_lower_median", "SELECT lang, n_chars AS lower_median FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r = n // 2 + 1")
def _(spark, d):
    return P.lower_median(table(spark, d, "documents"), "n_chars", ["lang"])


@query("g22_percentiles", f"SELECT event_type, {_PCT} FROM (SELECT event_type, value AS v FROM events) GROUP BY 1")
def _(spark, d):
    return P.percentiles(table(spark, d, "events"), "value", ["event_type"])


@query("g25_repetition", "SELECT round((count(*) - count(DISTINCT text)) / count(*), 4) AS repeated FROM documents")
def _(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "documents").agg(F.round((n - F.count_distinct("text")) / n, 4).alias("repeated"))


_RULE = "CASE WHEN regexp_matches(text, '!!|[#*$%&|]{2}') THEN 0 ELSE 1 END"


@query("g26_confusion", f"SELECT quality, count(*) AS n, count_if(quality = p)::BIGINT AS \"right\", round(count_if(quality = p) / count(*), 4) AS accuracy FROM (SELECT quality, {_RULE} AS p FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (quality)")
def _(spark, d):
    p = F.when(F.col("text").rlike("!!|[#*$%&|]{2}"), 0).otherwise(1)
    return P.confusion(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("p", p), "quality", "p")


@query("g27_dashboard", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 4")
def _(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(4).select("o_orderkey", "o_custkey")


@query("g28_span", "SELECT user_id, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0)::BIGINT AS days FROM events GROUP BY 1")
def _(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.floor((us(F.max("ts")) - us(F.min("ts"))) / 86400000000.0).alias("days"))


@query("o01_ordered_messages", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def _(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("o04_priority_sort", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, d):
    return table(spark, d, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey")
