"""Queries of plans under modes, their evaluation, and sets of responses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import params
from .functions import text as T
from .functions.rules import first_match_sql
from .operators import decide as D
from .operators import evaluate as E
from .operators import memory as M
from .operators import relational as R
from .plans import score as S
from .queries_annotate import _AMBIGUITY, _IN, _STRIP, _TOKENS, _TOPICS, _UTTER
from .queries_profile import _SPLIT, split
from .registry import query, table

#: The texts of the tables are invented words between real function words, so that few facts stand in them: these rules find some.
FACTS = [
    *M.RULES,
    ("of the", r"(?i) of the ", "fact", "things", "low"),
    ("de la", r"(?i) de la ", "fact", "things", "low"),
    ("is in", r"(?i)\b(in|im|dans) (the|an?|der|les?)\b", "fact", "places", "medium"),
    ("is with", r"(?i)\b(with|avec|mit|con) ", "relation", "people", "high"),
    ("that is", r"(?i)\bthat (is|was|of)\b", "fact", "things", "high"),
]

#: One row for each conversation: what `score.context_analysis` gives.
_CONTEXT = f"""SELECT conv_id, text AS last_user_message, low, intent, before AS activity, depth, rate, topic, ambiguity, state FROM (
  WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS before, lag(role) OVER w AS was, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r,
      row_number() OVER w - 1 AS place, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user
      FROM TURNS WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    shape AS (SELECT conv_id, count_if(role IN ('user', 'assistant')) AS depth, CASE WHEN count(*) > 1 THEN round_even(count_if(role <> was) / (count(*) - 1), 4) ELSE 1.0 END AS rate FROM t GROUP BY 1),
    last AS (SELECT conv_id, n, coalesce(CASE WHEN role = 'user' THEN text END, last_user, text) AS text, before FROM t WHERE r = 1), {_UTTER}, {_TOPICS},
    top AS (SELECT conv_id, CASE WHEN score < 1.0 THEN 'casual_chat' ELSE topic END AS topic FROM (SELECT conv_id, rank, topic,
      round(sum(CASE WHEN list_contains({_TOKENS.format('text')}, term) THEN weight * (1 + 2 * place / greatest(n - 1, 1)) * CASE WHEN place = n - 1 THEN 1.2 ELSE 1.0 END ELSE 0 END), 6) AS score
      FROM t, lex GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, rank) = 1)
  SELECT *, {_AMBIGUITY} AS ambiguity, CASE WHEN n <= 1 THEN 'opening' ELSE {first_match_sql(f'lower({_STRIP})', params.STATE, 'ongoing')} END AS state FROM i JOIN top USING (conv_id) JOIN shape USING (conv_id))"""


def context_sql(turns: str = "conversations") -> str:
    return _CONTEXT.replace("TURNS", turns)


def facts_sql(rules: list[tuple]) -> str:
    """conv_id, turn, content, topic, importance of the facts of all conversations."""
    quote = lambda x: x.replace("'", "''")
    table = ", ".join(f"({i}, '{quote(c)}', '{quote(p)}', '{t}', '{w}')" for i, (c, p, _, t, w) in enumerate(rules))
    return f"""SELECT conv_id, turn, content, topic, importance FROM (SELECT * FROM conversations WHERE role IN ('user', 'human') AND NOT regexp_matches(text, '{M.EPHEMERAL}'))
      JOIN (VALUES {table}) v(no, content, pattern, topic, importance) ON regexp_matches(text, pattern) QUALIFY row_number() OVER (PARTITION BY conv_id, content ORDER BY turn, no) = 1"""


def policy_sql(asks: str, keys: str, gate: bool = True, least: float = 0.45) -> str:
    """keys, memory_ids and memory_topics of the two best of the three memories found for each row of `asks`."""
    fit = "(m_topic = '' OR CASE WHEN q_topic IN ('casual_chat', 'other') THEN m_topic IN ('casual_chat', 'general') ELSE m_topic = q_topic END)" if gate else "true"
    q, m = (f"list_distinct({_TOKENS.format(c)})" for c in ("last_user_message", "content"))
    return f"""SELECT {keys}, list(content ORDER BY place) AS memory_ids, list(m_topic ORDER BY place) AS memory_topics FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, content) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, content) AS found FROM (
          SELECT a.*, f.content, f.topic AS m_topic, a.topic AS q_topic, round(0.4 * CASE WHEN len({q}) > 0 AND len({m}) > 0 THEN len(list_intersect({q}, {m})) / len(list_distinct(list_concat({q}, {m}))) ELSE 0 END
            + 0.3 * (f.topic = a.topic)::INT + 0.2 * CASE f.importance WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.2 END + 0.1 * 0.5, 4) AS score
          FROM ({asks}) a JOIN ({facts_sql(FACTS)}) f ON f.conv_id = a.conv_id))
      WHERE found <= 3 AND score >= {least} AND lower(state) <> 'closing' AND {fit}) WHERE place <= 2 GROUP BY ALL"""


def _memories(turns):
    facts = M.extract_facts(turns, "conv_id", "turn", FACTS)
    return facts.select("conv_id", F.col("content").alias("m_id"), F.col("content").alias("m_text"), F.col("topic").alias("m_topic"), F.col("importance").alias("m_importance"))


_SURE = D.confidence("intent", "ambiguity", "depth", "strategy", "use_memory")
_PLAN = f"{D.first_of_sql(params.STRATEGY_RULES, 'react')} AS strategy, {D.first_of_sql(params.TONE_RULES, 'casual')} AS tone"


@query("m01_facts", facts_sql(FACTS))
def _(spark, d):
    return M.extract_facts(table(spark, d, "conversations"), "conv_id", "turn", FACTS).select("conv_id", "turn", "content", "topic", "importance")


@query("a21_context_analysis", f"SELECT conv_id, last_user_message, state, intent, ambiguity, depth, rate::DOUBLE AS rate, topic FROM ({context_sql()})")
def _(spark, d):
    return S.context_analysis(table(spark, d, "conversations")).select("conv_id", "last_user_message", "state", "intent", "ambiguity", "depth", "rate", "topic")


@query(
    "e05_plans",
    f"""WITH c AS ({context_sql()}), p AS ({policy_sql('SELECT * FROM c', 'conv_id')}), x AS (SELECT c.*, coalesce(len(memory_ids) > 0, false) AS use_memory, array_to_string(memory_ids, ',') AS memories FROM c LEFT JOIN p USING (conv_id)),
    y AS (SELECT *, {_PLAN} FROM x) SELECT conv_id, memories, strategy, tone, ({_SURE})::DOUBLE AS confidence, {D.instruction_sql()} AS instruction FROM y""",
)
def _(spark, d):
    turns = table(spark, d, "conversations")
    context = S.context_analysis(turns)
    asks = context.select("conv_id", F.col("conv_id").alias("q_id"), F.col("last_user_message").alias("q_text"), F.col("topic").alias("q_topic"))
    plans = S.plan_conversations(turns, M.retrieve(asks, _memories(turns), "conv_id", 3).select("conv_id", "m_id", "m_topic", "score"))
    return plans.select("conv_id", F.array_join("memory_ids", ",").alias("memories"), "strategy", "tone", "confidence", "instruction")


# --- ablation: predictions from whole conversations against what the user's turns alone say ---------------

_SEEN = _IN([m for m, x in S.MODES.items() if x[0]])
_ASKS = _IN([m for m, x in S.MODES.items() if x[1]])
_PLANS = _IN([m for m, x in S.MODES.items() if x[2]])
_BLANKS = ", ".join(f"CASE WHEN mode IN ({_SEEN}) THEN c.{k} ELSE '{v}' END AS {k}" for k, v in S.BLANK.items())


def _judged_sql(gate: bool = True, least: float = 0.45) -> str:
    return f"""own_turns AS (SELECT * FROM conversations WHERE role = 'user'), c AS ({context_sql()}), facts AS ({facts_sql(FACTS)}),
    w0 AS (SELECT *, false AS use_memory FROM ({context_sql('own_turns')})), w AS (SELECT conv_id, topic AS expected_topic, intent AS expected_intent, {_PLAN.split(' AS strategy')[0]} AS expected_strategy,
      EXISTS (SELECT 1 FROM facts f WHERE f.conv_id = w0.conv_id AND f.topic = w0.topic AND f.importance <> 'low') AS expected_memory FROM w0),
    z AS (SELECT c.* EXCLUDE ({', '.join(S.BLANK)}), {_BLANKS}, mode FROM c, (SELECT unnest([{_IN(S.MODES)}]) AS mode)),
    p AS ({policy_sql(f'SELECT * FROM z WHERE mode IN ({_ASKS})', 'conv_id, mode', gate, least)}),
    x AS (SELECT z.*, memory_topics, coalesce(len(memory_ids) > 0, false) AS use_memory FROM z LEFT JOIN p USING (conv_id, mode)),
    y AS (SELECT * REPLACE (CASE WHEN mode IN ({_PLANS}) THEN strategy ELSE 'react' END AS strategy) FROM (SELECT *, {_PLAN} FROM x)),
    k AS (SELECT *, CASE WHEN depth <= 2 THEN 'ambiguous' ELSE 'dialogue' END AS category FROM y LEFT JOIN w USING (conv_id)),
    o AS (SELECT *, coalesce(topic = expected_topic, expected_topic IS NULL) AS topic_ok, coalesce(intent = expected_intent, expected_intent IS NULL) AS intent_ok,
      coalesce(strategy = expected_strategy, expected_strategy IS NULL) AS strategy_ok, coalesce(use_memory = expected_memory, expected_memory IS NULL) AS memory_ok, ambiguity = 'high' OR category = 'ambiguous' AS unclear,
      use_memory AND topic <> 'casual_chat' AND len(list_filter(memory_topics, lambda t: t <> topic)) > 0 AS contaminated FROM k),
    j AS (SELECT *, NOT unclear OR strategy_ok AS ambiguity_ok, array_to_string(list_filter([CASE WHEN NOT topic_ok THEN 'context' END, CASE WHEN NOT intent_ok THEN 'intent' END, CASE WHEN NOT strategy_ok THEN 'strategy' END,
      CASE WHEN contaminated THEN 'contamination' END, CASE WHEN expected_memory AND NOT use_memory THEN 'memory' END], lambda e: e IS NOT NULL), ' | ') AS explanation FROM o)"""


def _judged(spark, d, gate=True, least=0.45):
    turns = table(spark, d, "conversations")
    memories = _memories(turns)
    plans = S.ablation(S.context_analysis(turns), memories, least=least, gate=gate)
    own = D.plan(S.context_analysis(turns.where("role = 'user'")))
    due = memories.where("m_importance <> 'low'").select("conv_id", F.col("m_topic").alias("topic"), F.lit(True).alias("due")).distinct()
    own = own.join(due, ["conv_id", "topic"], "left")
    want = own.select("conv_id", *[F.col(c).alias(f"expected_{c}") for c in ("topic", "intent", "strategy")], F.coalesce("due", F.lit(False)).alias("expected_memory"))
    category = F.when(F.col("depth") <= 2, "ambiguous").otherwise("dialogue")
    return E.judge(plans.join(want, "conv_id", "left").withColumn("category", category), "ambiguous")


@query("e08_plan_correctness", f"WITH {_judged_sql()} SELECT conv_id, mode, topic_ok, intent_ok, strategy_ok, ambiguity_ok, memory_ok, explanation FROM j")
def _(spark, d):
    return _judged(spark, d).select("conv_id", "mode", "topic_ok", "intent_ok", "strategy_ok", "ambiguity_ok", "memory_ok", "explanation")


@query("e09_topic_contamination", f"WITH {_judged_sql(False, 0.2)} SELECT mode, count(*) AS cases, count_if(use_memory)::BIGINT AS used, count_if(contaminated)::BIGINT AS contaminated FROM j GROUP BY 1")
def _(spark, d):
    """Without the policy's topic gate and with a lower score, as the policy leaves nothing to find."""
    return _judged(spark, d, gate=False, least=0.2).groupBy("mode").agg(F.count(F.lit(1)).alias("cases"), F.count_if("use_memory").alias("used"), F.count_if("contaminated").alias("contaminated"))


_SHARE = lambda a, b: f"round(coalesce({a} / nullif({b}, 0), 1.0), 4)"
_SUMMARY = f"""count(*) AS cases, {', '.join(f"{_SHARE(f'count_if({x}_ok)', 'count(*)')} AS {x}_accuracy" for x in ('topic', 'intent', 'strategy', 'memory'))},
    {_SHARE('count_if(unclear AND ambiguity_ok)', 'count_if(unclear)')} AS ambiguity_accuracy, {_SHARE('count_if(use_memory AND coalesce(expected_memory, true) AND NOT contaminated)', 'count_if(use_memory)')} AS memory_precision,
    {_SHARE('count_if(use_memory AND expected_memory)', 'count_if(expected_memory)')} AS memory_recall, {_SHARE('count_if(contaminated)', 'count(*)')} AS contamination_rate, {_SHARE('count_if(use_memory)', 'count(*)')} AS utilization_rate"""


@query("e11_five_modes", f"WITH {_judged_sql()} SELECT mode, {_SUMMARY} FROM j GROUP BY 1")
def _(spark, d):
    return E.benchmark(_judged(spark, d), ["mode"])


@query("g23_benchmark", f"WITH {_judged_sql()} SELECT category, {_SUMMARY} FROM j WHERE mode = 'full' GROUP BY 1")
def _(spark, d):
    return E.benchmark(_judged(spark, d).where("mode = 'full'"), ["category"])


@query(
    "g23_error_histogram",
    f"WITH {_judged_sql()} SELECT mode, error, count_if(list_contains(string_split(explanation, ' | '), error))::BIGINT AS n FROM j, (SELECT unnest([{_IN(E.ERRORS)}]) AS error) GROUP BY ALL",
)
def _(spark, d):
    return E.error_histogram(_judged(spark, d), ["mode"])


_METRICS = ["topic_accuracy", "intent_accuracy", "strategy_accuracy", "memory_recall"]


@query(
    "e12_modes_compared",
    f"""WITH {_judged_sql()}, y2 AS (SELECT mode, {_SUMMARY} FROM j GROUP BY 1), v AS (SELECT mode, unnest([{_IN(_METRICS)}]) AS metric, unnest([{', '.join(_METRICS)}]) AS v FROM y2)
    SELECT metric, max(v) FILTER (mode = 'full') AS "full", max(v) FILTER (mode = 'persona_only') AS baseline, round(max(v) FILTER (mode = 'full') - max(v) FILTER (mode = 'persona_only'), 4) AS delta FROM v GROUP BY 1""",
)
def _(spark, d):
    return E.compare(E.benchmark(_judged(spark, d), ["mode"]), "mode", "full", "persona_only", _METRICS)


# --- sets of responses: the given reply, the reply to the prompt before, the prompt itself -----------------

_MARKERS = r"as an ai|i cannot|feel free to|\bthat is\b"
_SETS = """r0 AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS prompt, lag(text, 2) OVER w AS earlier, CASE WHEN turn <= 3 THEN 'early' ELSE 'late' END AS category FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT conv_id, turn, category, text AS expected, unnest(['given', 'earlier', 'echo']) AS model, unnest([text, earlier, prompt]) AS response FROM r0 WHERE role = 'assistant' AND prompt IS NOT NULL)"""


def _sets(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    df = table(spark, d, "conversations").withColumns({"prompt": F.lag("text").over(w), "earlier": F.lag("text", 2).over(w), "category": F.when(F.col("turn") <= 3, "early").otherwise("late")})
    one = lambda name, c: F.struct(F.lit(name).alias("model"), F.col(c).alias("response"))
    df = df.where("role = 'assistant' AND prompt IS NOT NULL")
    return df.select("conv_id", "turn", "category", F.col("text").alias("expected"), F.inline(F.array(one("given", "text"), one("earlier", "earlier"), one("echo", "prompt"))))


def _metrics_sql(keys: str) -> str:
    has = lambda xs: f"list_has_any(t, [{_IN(xs)}])"
    percent = lambda c: f"round(count_if({c}) * 100.0 / count(*), 2)"
    low = lambda c: rf"regexp_replace(lower(coalesce({c}, '')), '^\s+|\s+$', '', 'g')"
    return f"""WITH {_SPLIT}, {_SETS}, seen AS (SELECT DISTINCT {low('text')} AS target FROM conversations JOIN g USING (conv_id) WHERE split = 'train' AND role = 'user'),
    l AS (SELECT *, {low('response')} AS low, {low('expected')} AS want FROM r),
    m AS (SELECT *, {_TOKENS.format('low')} AS t, len(list_filter(regexp_split_to_array(low, '\\s+'), lambda x: x <> '')) AS w, regexp_matches(low, '{_MARKERS}') AS formal, low IN (SELECT target FROM seen) AS known FROM l),
    n AS (SELECT *, {has(params.PRIMARY)} AND {has(params.SECONDARY)} AS mixed FROM m)
    SELECT {keys}, count(*) AS cases, {percent("low <> '' AND low = want")} AS exact, round(avg(length(low)), 2) AS chars, round(avg(w), 2) AS words, {percent('mixed')} AS mixed, {percent("regexp_matches(low, '" + T.EMOJI + "')")} AS emoji,
      {percent('NOT formal AND (w <= 15 OR mixed)')} AS casual, {percent("formal OR low = ''")} AS unrelated, {percent("known AND low <> ''")} AS memorised FROM n GROUP BY ALL"""


def _metrics(spark, d, keys):
    seen = split(spark, d).where("split = 'train' AND role = 'user'").select(F.col("text").alias("target"))
    return E.response_metrics(_sets(spark, d), keys, seen, params.PRIMARY, params.SECONDARY, _MARKERS)


@query("e13_responses_by_model", _metrics_sql("model"))
def _(spark, d):
    return _metrics(spark, d, ["model"])


@query("e18_responses_by_category", _metrics_sql("model, category"))
def _(spark, d):
    return _metrics(spark, d, ["model", "category"])


@query(
    "e17_response_sensitivity",
    f"WITH {_SETS} SELECT category, count(*) AS cases, round(count_if(a <> b) * 100.0 / count(*), 2) AS differ FROM (SELECT category, conv_id, turn, max(response) FILTER (model = 'given') AS a, max(response) FILTER (model = 'earlier') AS b FROM r GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return E.sensitivity(_sets(spark, d), ["category"], ["conv_id", "turn"], "model", "given", "earlier")


_JOB = "depth state intent ambiguity topic rate".split()


@query("e14_plan_runs", "SELECT count(DISTINCT conv_id) AS n, 3::BIGINT AS runs, true AS same FROM conversations")
def _(spark, d):
    turns = table(spark, d, "conversations")
    return R.same_runs([S.plan_conversations(turns).select("conv_id", *_JOB, "strategy", "tone", "instruction") for _ in range(3)])
