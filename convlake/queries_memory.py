"""Queries of memory tables, decisions and evaluation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import params
from .operators import evaluate as E
from .operators import lifecycle as L
from .operators import memory as M
from .operators import relational as R
from .operators import decide as D
from .operators.neighbours import compared, met_before, search
from .operators.ordered import cuts
from .plans.score import context_analysis, plan_conversations
from .queries_annotate import _AMBIGUITY, _LAST, _STRIP, _UTTER, last_turns, pairs
from .functions import text as T
from .functions.rules import first_match_sql
from .operators import annotate as A
from .registry import query, table

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"

# --- memory ----------------------------------------------------------------------------------------

# the texts of the tables are invented words, so that rules of function words find facts in them beside those of the library
_STANDINS = [*M.RULES, ("of_the", r"(?i) of the ", "fact", "things", "low"), ("de_la", r"(?i) de la ", "fact", "things", "low")]
_HITS = " UNION ALL ".join(
    f"SELECT conv_id, turn, {i} AS no, '{r[0]}' AS content, '{r[2]}' AS memory_type, '{r[3]}' AS topic, '{r[4]}' AS importance FROM u WHERE regexp_matches(text, '{r[1].replace(chr(39), chr(39) * 2)}')"
    for i, r in enumerate(_STANDINS)
)


@query(
    "m01_extract",
    f"""WITH u AS (SELECT * FROM conversations WHERE role IN ('user', 'human') AND NOT regexp_matches(text, '{M.EPHEMERAL}'))
    SELECT conv_id, turn, content, memory_type, topic, importance FROM ({_HITS}) QUALIFY row_number() OVER (PARTITION BY conv_id, content ORDER BY turn, no) = 1""",
)
def _(spark, d):
    return M.extract_facts(table(spark, d, "conversations"), "conv_id", "turn", _STANDINS)


@query("m02_ephemeral", f"SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches(text, '{M.EPHEMERAL}')")
def _(spark, d):
    return table(spark, d, "conversations").where(~F.col("text").rlike(T.portable(M.EPHEMERAL))).select("conv_id", "turn")


_FILL = ", ".join(f"'{x}'" for x in M.FILLERS)


@query("m04_normal_form", f"SELECT doc_id, array_to_string(list_filter({_TOK.format('text')}, lambda x: x NOT IN ({_FILL})), ' ') AS form FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", M.normal_form(F.col("text")).alias("form"))


@query("m05_embedding")
def _(spark, d):
    return M.embed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def letter_model(batches):
    """A model of three figures: characters, vowels and digits of a text."""
    for s in batches:
        yield pd.Series([[float(len(x)), float(len(re.findall("[aeiou]", x))), float(len(re.findall("[0-9]", x)))] for x in s])


@query("m05_plugged_model", "SELECT doc_id, length(t)::DOUBLE AS chars, len(regexp_extract_all(t, '[aeiou]'))::DOUBLE AS vowels, len(regexp_extract_all(t, '[0-9]'))::DOUBLE AS digits FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _(spark, d):
    v = F.col("embedding")
    e = M.embeddings(table(spark, d, "documents"), "doc_id", "text", letter_model)
    return e.select("doc_id", *[v[i].cast("double").alias(c) for i, c in enumerate(("chars", "vowels", "digits"))])


_VEC = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query("m06_cosine", f"WITH {_VEC} SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(a.v, b.v))), 6) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return e.join(b, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("w")), 6).alias("similarity"))


@query("m07_duplicates", f"SELECT min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, array_to_string(list_filter({_TOK.format('text')}, lambda x: x NOT IN ({_FILL})), ' ') AS f FROM documents) GROUP BY f HAVING count(*) > 1")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.md5(M.normal_form(F.col("text"))).alias("f"))
    return df.groupBy("f").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("f")


@query("m08_slots", r"SELECT event_id, regexp_extract(props, '^\{" + '"' + r"(\w+)" + '"' + r": *(\d+)', 1) AS slot, regexp_extract(props, '^\{" + '"' + r"(\w+)" + '"' + r": *(\d+)', 2) AS value FROM events")
def _(spark, d):
    p = r'^\{"(\w+)": *(\d+)'
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", p, 1).alias("slot"), F.regexp_extract("props", p, 2).alias("value"))


@query(
    "m09_upsert_runs",
    """WITH r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS n FROM events)),
    g AS (SELECT user_id, run, min(event_type) AS value, min(event_id) AS created, max(event_id) AS updated, max(value) AS importance, count(*) AS merged FROM r GROUP BY ALL)
    SELECT user_id, value, created, updated, importance, merged, CASE WHEN run = max(run) OVER (PARTITION BY user_id) THEN 'active' ELSE 'superseded' END AS status FROM g""",
)
def _(spark, d):
    df = table(spark, d, "events").withColumn("slot", F.lit("activity")).withColumnsRenamed({"value": "weight"}).withColumn("value", F.col("event_type"))
    out = M.upsert_runs(df, "user_id", "slot", "value", ["event_id"], "weight")
    return out.select("user_id", "value", "created", "updated", "importance", "merged", "status")


# The events table as candidates: some event types answer one question (a slot), the others are remarks.
_VERB = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.VERBS.items()) + " ELSE w END"
_LIFE = f"""c AS (SELECT user_id AS persona, event_id AS pos, CASE WHEN event_type IN ('view', 'error') THEN event_type || ' ' || props ELSE 'I prefer ' || event_type END AS content, event_id % 3 AS rank FROM events),
    f AS (SELECT *, array_to_string(list_transform(list_filter({_TOK.format('content')}, lambda w: w NOT IN ({_FILL})), lambda w: {_VERB}), ' ') AS norm FROM c),
    s AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(norm, '{p}') THEN '{s}'" for s, p in L.SLOTS)} END AS slot,
      CASE {' '.join(f"WHEN regexp_matches(norm, '{p}') THEN regexp_extract(norm, '{p}', 1)" for s, p in L.SLOTS)} END AS value FROM f),
    r AS (SELECT *, CASE WHEN slot IS NULL THEN 0 ELSE sum(new) OVER (PARTITION BY persona, slot ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS run FROM (
      SELECT *, coalesce((value <> lag(value) OVER (PARTITION BY persona, slot ORDER BY pos))::INT, 0) AS new FROM s)),
    g AS (SELECT persona, slot, run, norm, min(pos) AS m_id, arg_min(content, pos) AS content, max(rank) AS rank, max(pos) AS last, count(*) AS merged FROM r GROUP BY ALL),
    h AS (SELECT persona, slot, run, min(m_id) AS head FROM g WHERE slot IS NOT NULL GROUP BY ALL)"""


def _remarks(spark, d, df=None):
    e = table(spark, d, "events") if df is None else df
    odd = F.col("event_type").isin("view", "error")
    content = F.when(odd, F.concat_ws(" ", "event_type", "props")).otherwise(F.concat(F.lit("I prefer "), "event_type"))
    level = F.get(F.array(*map(F.lit, L.RANKS)), (F.col("event_id") % 3).cast("int"))
    return L.candidates(e.withColumns({"content": content, "importance": level}), "user_id", "event_id", "content", "importance")


@query(
    "m09_life_cycle",
    f"""WITH {_LIFE} SELECT g.persona, g.m_id, g.content, g.slot, ['low', 'medium', 'high'][g.rank + 1] AS importance, coalesce(h.head, g.last) AS updated, g.merged,
    CASE WHEN h.head IS NULL THEN 'active' ELSE 'superseded' END AS status, h.head AS superseded_by FROM g LEFT JOIN h ON h.persona = g.persona AND h.slot = g.slot AND h.run = g.run + 1""",
)
def _(spark, d):
    out = L.memories(_remarks(spark, d), cuts(table(spark, d, "events"), "event_id"))
    return out.select("persona", "m_id", "content", "slot", "importance", "updated", "merged", "status", "superseded_by")


ACTIONS_SQL = f"""WITH {_LIFE} SELECT r.persona, r.pos AS "at", g.m_id, CASE WHEN r.run > 0 AND r.pos = h.head THEN 'superseded' WHEN r.pos = g.m_id THEN 'created' ELSE 'merged' END AS action
    FROM r JOIN g ON g.persona = r.persona AND g.slot IS NOT DISTINCT FROM r.slot AND g.run = r.run AND g.norm = r.norm LEFT JOIN h ON h.persona = r.persona AND h.slot = r.slot AND h.run = r.run"""


@query("m09_actions", ACTIONS_SQL)
def _(spark, d):
    return L.actions(_remarks(spark, d), cuts(table(spark, d, "events"), "event_id"))


@query("m10_list", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


_SCORED = f"""{_VEC}, s AS (SELECT q.vec_id AS q_id, m.vec_id AS m_id, m.label, greatest(0, least(1, list_cosine_similarity(q.v, m.v))) AS semantic FROM e q JOIN e m USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> m.vec_id)"""


def _scored(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    m = e.select("label", F.col("vec_id").alias("m_id"), F.col("embedding").alias("m_embedding"))
    return q, m


@query("m11_search_topk", f"WITH {_SCORED} SELECT q_id, m_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(semantic, 9) DESC, m_id) AS rank FROM s) WHERE rank <= 10")
def _(spark, d):
    none = F.lit(None).cast("array<string>")
    q, m = (df.withColumn(f"{x}_words", none) for df, x in zip(_scored(spark, d), "qm"))
    return search(q, m, "label", 10, own=True, cos=1.0, overlap=0.0).select("q_id", "m_id", F.col("rank").cast("long").alias("rank"))


@query(
    "m11_hybrid_search",
    f"""WITH m AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_distinct({_TOK.format("coalesce(text, '')")}) AS t FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
    s AS (SELECT a.vec_id AS q_id, b.vec_id AS m_id, round(0.7 * greatest(0, least(1, list_cosine_similarity(a.v, b.v))) + 0.3 * len(list_intersect(a.t, b.t)) / greatest(1, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 9) AS score
      FROM m a JOIN m b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT q_id, m_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, m_id) AS rank FROM s) WHERE rank <= 10""",
)
def _(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), T.tokens(F.coalesce("text", F.lit(""))).alias("words"))
    e = table(spark, d, "embeddings").join(texts, "vec_id", "left")
    q, m = (e.select("label", F.col("vec_id").alias(f"{x}_id"), F.col("embedding").alias(f"{x}_embedding"), F.array_distinct("words").alias(f"{x}_words")) for x in "qm")
    return search(q.where("q_id % 20 = 0"), m, "label", 10, own=True).select("q_id", "m_id", F.col("rank").cast("long").alias("rank"), "score")


@query("m12_rank", f"WITH {_SCORED} SELECT q_id, m_id, round(least(1, greatest(0, 0.4 * semantic + 0.3 * (m_id % 2) + 0.2 * CASE m_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.2 END + 0.1 * exp(-(m_id % 90) / 30.0))), 6) AS score FROM s")
def _(spark, d):
    q, m = _scored(spark, d)
    weight = F.when(F.col("m_id") % 3 == 0, 1.0).when(F.col("m_id") % 3 == 1, 0.6).otherwise(0.2)
    s = M.score(F.col("semantic"), (F.col("m_id") % 2).cast("double"), weight, (F.col("m_id") % 90).cast("double"))
    return compared(q, m, "label").select("q_id", "m_id", F.round(s, 6).alias("score"))


@query("m14_retrieval_job")
def _(spark, d):
    q, m = _scored(spark, d)
    # the table has vectors only: topic, importance and age as in m12_rank, and every row is active
    weight = F.when(F.col("m_id") % 3 == 0, "high").when(F.col("m_id") % 3 == 1, "medium").otherwise("low")
    m = m.withColumns({"status": F.lit("active"), "m_topic": F.when(F.col("m_id") % 2 == 1, "odd"), "m_importance": weight, "m_age_days": (F.col("m_id") % 90).cast("double")})
    return M.retrieve(q.withColumn("q_topic", F.lit("odd")), m, "label", 5, own=True, blocks=True).select("q_id", "m_id", "rank")


@query("m15_access_times", "SELECT user_id, max(event_id) AS seen FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seen"))
    base = e.groupBy("user_id").agg(F.min("seen").alias("seen"))
    return M.touch(base, e, "user_id", "seen")


@query(
    "m16_selection",
    f"""WITH {_SCORED}, p AS (SELECT *, CASE q_id % 3 WHEN 0 THEN 'casual_chat' WHEN 1 THEN 'odd' ELSE 'even' END AS q_topic, CASE m_id % 4 WHEN 0 THEN 'even' WHEN 1 THEN 'odd' WHEN 2 THEN 'general' END AS m_topic FROM s),
    g AS (SELECT * FROM p WHERE round(semantic, 9) >= 0.1 AND q_id % 7 <> 0 AND (m_topic IS NULL OR CASE WHEN q_topic = 'casual_chat' THEN m_topic IN ('casual_chat', 'general') ELSE m_topic = q_topic END))
    SELECT q_id, string_agg(m_id::VARCHAR, ',' ORDER BY rank) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(semantic, 9) DESC, m_id) AS rank FROM g) WHERE rank <= 2 GROUP BY 1""",
)
def _(spark, d):
    q, m = _scored(spark, d)
    three, four = F.col("q_id") % 3, F.col("m_id") % 4
    q = q.withColumns({
        "q_topic": F.when(three == 0, "casual_chat").when(three == 1, "odd").otherwise("even"),
        "state": F.when(F.col("q_id") % 7 == 0, "closing").otherwise("ongoing"),
    })
    m = m.withColumn("m_topic", F.when(four == 0, "even").when(four == 1, "odd").when(four == 2, "general"))
    chosen = M.select_search(q, m, "label", least=0.1)
    return chosen.select("q_id", F.array_join(F.transform("memory_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("m17_changes", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(spark, d):
    whole = table(spark, d, "customer")
    base = whole.select("c_custkey", "c_acctbal")
    up = whole.where("c_acctbal < 0 AND c_mktsegment <> 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.lit("update").alias("op"))
    gone = whole.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal", F.lit("delete").alias("op"))
    return M.apply_changes(base, up.unionByName(gone), "c_custkey")


# --- decisions and evaluation ------------------------------------------------------------------------

_CTX = f"""{_LAST}, {_UTTER}, c AS (SELECT conv_id, low, intent, before AS activity, n AS depth, n % 3 = 0 AS use_memory,
    CASE WHEN n <= 1 THEN 'opening' ELSE {first_match_sql(f'lower({_STRIP})', params.STATE, 'ongoing')} END AS state, {_AMBIGUITY} AS ambiguity,
    CASE conv_id % 5 WHEN 0 THEN 'time' WHEN 1 THEN 'places' WHEN 2 THEN 'things' WHEN 3 THEN 'people' ELSE 'casual_chat' END AS topic FROM i),
    x AS (SELECT *, {D.first_of_sql(params.STRATEGY_RULES, 'react')} AS strategy, {D.first_of_sql(params.TONE_RULES, 'casual')} AS tone FROM c)"""
_NOUNS = ["order", "plan", "price", "page", "la", "the"]


def _plans(spark, d):
    """Plans of all conversations; the table has no topics and no memories of its own, so they follow from id and length."""
    t, k = F.col("text"), F.col("conv_id") % 5
    topic = F.when(k == 0, "time").when(k == 1, "places").when(k == 2, "things").when(k == 3, "people").otherwise("casual_chat")
    df = D.intent(last_turns(spark, d), t, F.col("before"))
    return D.plan(
        df.select(
            "conv_id", "low", "intent", F.col("before").alias("activity"), F.col("n").alias("depth"), (F.col("n") % 3 == 0).alias("use_memory"),
            A.dialogue_state(t, F.col("n")).alias("state"), A.ambiguity(t, _NOUNS).alias("ambiguity"), topic.alias("topic"),
        )
    )


@query("e01_strategy", f"WITH {_CTX} SELECT conv_id, strategy FROM x")
def _(spark, d):
    return _plans(spark, d).select("conv_id", "strategy")


@query("e02_tone", f"WITH {_CTX} SELECT conv_id, tone FROM x")
def _(spark, d):
    return _plans(spark, d).select("conv_id", "tone")


_SURE = D.confidence("intent", "ambiguity", "depth", "strategy", "use_memory")


@query("e03_confidence", f"WITH {_CTX} SELECT conv_id, ({_SURE})::DOUBLE AS confidence FROM x")
def _(spark, d):
    return _plans(spark, d).select("conv_id", "confidence")


@query("e04_instruction", f"WITH {_CTX} SELECT conv_id, {D.instruction_sql()} AS instruction FROM x")
def _(spark, d):
    return _plans(spark, d).select("conv_id", "instruction")


@query("e05_plan_job")
def _(spark, d):
    turns = table(spark, d, "conversations")
    facts = M.extract_facts(turns, "conv_id", "turn", _STANDINS).select("conv_id", F.col("turn").alias("m_id"), F.col("topic").alias("m_topic"), F.lit(0.6).alias("score"))
    return plan_conversations(turns, facts)


_PAIR = """p AS (SELECT conv_id, turn, a, b FROM (SELECT conv_id, turn, text AS b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) WHERE a IS NOT NULL),
    s AS (SELECT *, list_distinct(regexp_extract_all(lower(a), '[\\p{L}\\p{N}_]+')) AS x, list_distinct(regexp_extract_all(lower(b), '[\\p{L}\\p{N}_]+')) AS y FROM p),
    m AS (SELECT conv_id, turn, least(length(a), length(b)) / greatest(length(a), length(b), 1) AS l, len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1) AS w,
      (regexp_matches(a, '[\\p{So}\\p{Sk}]') = regexp_matches(b, '[\\p{So}\\p{Sk}]'))::INT::DOUBLE AS e, (regexp_matches(a, '[?!]') = regexp_matches(b, '[?!]'))::INT::DOUBLE AS q FROM s)"""


def _similar(spark, d):
    df = pairs(spark, d).where("prompt IS NOT NULL")
    return df.select("conv_id", "turn", *[c.alias(k) for k, c in E.similarity(F.col("prompt"), F.col("target")).items()])


@query("e06_pair_similarity", f"WITH {_PAIR} SELECT conv_id, turn, round(l, 4) AS length_ratio, round(w, 4) AS word_overlap, e AS emoji_match, q AS punctuation_match, round((l + w + e + q) / 4, 4) AS composite FROM m")
def _(spark, d):
    return _similar(spark, d)


@query("e07_similarity_report", f"WITH {_PAIR} SELECT round(avg(round(l, 4)), 4) AS length_ratio, round(avg(round(w, 4)), 4) AS word_overlap, count(*) AS pairs FROM m")
def _(spark, d):
    return _similar(spark, d).agg(F.round(F.avg("length_ratio"), 4).alias("length_ratio"), F.round(F.avg("word_overlap"), 4).alias("word_overlap"), F.count(F.lit(1)).alias("pairs"))


_PRED = "r AS (SELECT doc_id, lang, quality AS expected_quality, CASE WHEN regexp_matches(text, '!!|[#*$%&|]{2}') THEN 0 ELSE 1 END AS quality, CASE WHEN lang = 'en' THEN toxic END AS expected_toxic, CASE WHEN regexp_matches(lower(text), 'moron|idiot|loser|scum') THEN 1 ELSE 0 END AS toxic FROM documents JOIN labels USING (doc_id)), c AS (SELECT *, coalesce(expected_quality = quality, expected_quality IS NULL) AS quality_ok, coalesce(expected_toxic = toxic, expected_toxic IS NULL) AS toxic_ok FROM r)"


def _predicted(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels").withColumnsRenamed({"quality": "expected_quality", "toxic": "t"}), "doc_id")
    low = F.lower("text")
    df = df.select(
        "doc_id", "lang", "expected_quality", F.when(F.col("text").rlike("!!|[#*$%&|]{2}"), 0).otherwise(1).alias("quality"),
        F.when(F.col("lang") == "en", F.col("t")).alias("expected_toxic"), F.when(low.rlike("moron|idiot|loser|scum"), 1).otherwise(0).alias("toxic"),
    )
    return E.correctness(df, ["quality", "toxic"])


@query("e08_correctness", f"WITH {_PRED} SELECT doc_id, quality_ok, toxic_ok FROM c")
def _(spark, d):
    return _predicted(spark, d).select("doc_id", "quality_ok", "toxic_ok")


@query("e09_contamination", f"WITH {_SCORED} SELECT q_id, bool_or(m_id < q_id AND semantic > 0.2) AS contaminated FROM s GROUP BY 1")
def _(spark, d):
    q, m = _scored(spark, d)
    return met_before(q, m, "label", 0.2).withColumnRenamed("met", "contaminated")


@query("e10_error_codes", f"WITH {_PRED} SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT quality_ok THEN 'wrong_quality' END, CASE WHEN NOT toxic_ok THEN 'wrong_toxic' END], lambda x: x IS NOT NULL), ' | ') AS explanation FROM c")
def _(spark, d):
    return E.error_codes(_predicted(spark, d), ["quality", "toxic"]).select("doc_id", "explanation")


@query("g23_summary", f"WITH {_PRED} SELECT lang, count(*) AS cases, round(count_if(quality_ok) / count(*), 4) AS quality_accuracy, round(count_if(toxic_ok) / count(*), 4) AS toxic_accuracy FROM c GROUP BY 1")
def _(spark, d):
    return E.summary(_predicted(spark, d), ["lang"], ["quality", "toxic"])


_MODES = {"full": {}, "no_text": {"quality": 1}, "no_rules": {"quality": 1, "toxic": 0}}


def _sweep(spark, d):
    df = _predicted(spark, d).drop("quality_ok", "toxic_ok")
    return E.summary(E.correctness(E.sweep(df, _MODES), ["quality", "toxic"]), ["mode"], ["quality", "toxic"])


_MODE_SQL = f"""WITH {_PRED}, z AS (SELECT 'full' AS mode, quality_ok, toxic_ok FROM c UNION ALL SELECT 'no_text', expected_quality = 1, toxic_ok FROM c
    UNION ALL SELECT 'no_rules', expected_quality = 1, coalesce(expected_toxic = 0, expected_toxic IS NULL) FROM c),
    y AS (SELECT mode, count(*) AS cases, round(count_if(quality_ok) / count(*), 4) AS quality_accuracy, round(count_if(toxic_ok) / count(*), 4) AS toxic_accuracy FROM z GROUP BY 1)"""


@query("e11_ablation", f"{_MODE_SQL} SELECT * FROM y")
def _(spark, d):
    return _sweep(spark, d)


@query(
    "e12_comparison",
    f"""{_MODE_SQL}, v AS (SELECT mode, unnest(['quality_accuracy', 'toxic_accuracy']) AS metric, unnest([quality_accuracy, toxic_accuracy]) AS v FROM y)
    SELECT metric, max(v) FILTER (mode = 'full') AS "full", max(v) FILTER (mode = 'no_rules') AS baseline, round(max(v) FILTER (mode = 'full') - max(v) FILTER (mode = 'no_rules'), 4) AS delta FROM v GROUP BY 1""",
)
def _(spark, d):
    return E.compare(_sweep(spark, d), "mode", "full", "no_rules", ["quality_accuracy", "toxic_accuracy"])


@query("e13_models", "SELECT lang AS model, count(*) AS n, round(avg(length(text)), 4) AS chars, round((count(*) - count(DISTINCT text)) / count(*), 4) AS repeated FROM documents GROUP BY 1")
def _(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "documents").groupBy(F.col("lang").alias("model")).agg(n.alias("n"), F.round(F.avg(F.length("text")), 4).alias("chars"), F.round((n - F.count_distinct("text")) / n, 4).alias("repeated"))


@query("e14_repeat_runs", "SELECT count(DISTINCT conv_id) AS n, 3::BIGINT AS runs, true AS same FROM conversations")
def _(spark, d):
    return R.same_runs([context_analysis(table(spark, d, "conversations")) for _ in range(3)])


@query("e15_categories", "SELECT source, CASE source WHEN 'src0' THEN 'web' WHEN 'src1' THEN 'books' ELSE 'other' END AS category, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    names = spark.createDataFrame([("src0", "web"), ("src1", "books")], "source string, category string")
    df = table(spark, d, "documents").join(F.broadcast(names), "source", "left")
    return df.groupBy("source", F.coalesce("category", F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("e16_pairs", "SELECT conv_id, turn, prompt, reference FROM (SELECT conv_id, turn, role, text AS reference, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations) WHERE role = 'assistant' AND prompt IS NOT NULL")
def _(spark, d):
    df = table(spark, d, "conversations").withColumn("prompt", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return df.where("role = 'assistant' AND prompt IS NOT NULL").select("conv_id", "turn", "prompt", F.col("text").alias("reference"))


@query("e17_context_sensitivity", "SELECT round(count_if(a.props <> b.props) / count(*), 4) AS rate FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("props").alias("other"))
    return e.join(b, "event_id").agg(F.round(F.count_if(F.col("props") != F.col("other")) / F.count(F.lit(1)), 4).alias("rate"))


@query("e18_category_metrics", "SELECT source, lang, count(*) AS n, round(avg(length(text)), 4) AS chars, round(avg((contains(text, '?'))::INT), 4) AS questions FROM documents GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 4).alias("chars"), F.round(F.avg(F.col("text").contains("?").cast("int")), 4).alias("questions"))


@query("g24_response_metrics", "SELECT round(100.0 * count_if(seen) / count(*), 4) AS memorised, round(avg(length(text)), 4) AS chars FROM (SELECT text, count(*) OVER (PARTITION BY md5(text)) > 1 AS seen FROM documents)")
def _(spark, d):
    df = table(spark, d, "documents").select("text")
    g = df.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    return g.agg(F.round(100.0 * F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("memorised"), F.round(F.sum("c") / F.sum("n"), 4).alias("chars"))
