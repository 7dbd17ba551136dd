"""Scoring of conversations: context, retrieved memories and a response plan, as one batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params
from ..operators import annotate as A
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import memory as M
from ..operators import windows as N

NOUNS = ["order", "plan", "price", "page", "la", "the"]


def context_analysis(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each conversation: topic, state, intent, ambiguity, depth, alternation and the last user text."""
    w = W.partitionBy(key).orderBy(order)
    last = N.last_user(turns, key, order).withColumns(
        {"before": F.lag("text").over(w), "n": F.count(F.lit(1)).over(W.partitionBy(key)), "r": F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))}
    )
    last = last.where("r = 1")
    text = F.coalesce(F.when(F.col("role") == "user", F.col("text")), "last_user", "text")
    last = D.intent(last.withColumn("said", text), F.col("said"), F.col("before"))
    said = F.col("said")
    last = last.select(
        key,
        said.alias("last_user_message"),
        A.dialogue_state(said, F.col("n")).alias("state"),
        "intent",
        A.ambiguity(said, NOUNS).alias("ambiguity"),
        "low",
        F.col("before").alias("activity"),
    )
    shape = N.alternation(turns, key, order).select(key, "depth", "rate")
    return last.join(shape, key).join(A.window_topic(turns, key, order, params.TOPICS), key)


def plan_conversations(turns: DataFrame, ranked: DataFrame | None = None, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One response plan for each conversation.

    ranked: memories found for each (`key`, m_id, m_topic, score), of which the selection policy keeps what fits; none for
    closing conversations. A conversation without a text gets the fallback: state ongoing, intent unknown.
    """
    context = context_analysis(turns, key, order)
    if ranked is not None:
        known = ranked.join(context.select(key, "state", F.col("topic").alias("q_topic")), key)
        chosen = M.select_policy(known, key, by="score", topic="q_topic", state="state")
        context = context.join(chosen, key, "left")
    else:
        context = context.withColumn("memory_ids", F.lit(None).cast("array<long>"))
    context = context.withColumn("use_memory", F.coalesce(F.size("memory_ids") > 0, F.lit(False)))
    return D.plan(context.fillna({"low": "", "state": "ongoing", "intent": "unknown", "ambiguity": "high", "activity": ""}))


# What stands in for the context where a mode has none.
BLANK = {"topic": "casual_chat", "state": "ongoing", "intent": "unknown", "ambiguity": "low", "activity": ""}
#: mode: whether it sees the context, memories and planning.
MODES = {"full": (True, True, True), "no_context": (False, True, True), "no_memory": (True, False, True), "no_planning": (True, True, False), "persona_only": (False, False, False)}


def ablation(context: DataFrame, memories: DataFrame, key: str = "conv_id", k: int = 3, least: float = 0.45, most: int = 2, gate: bool = True, modes: dict[str, tuple] | None = None) -> DataFrame:
    """One plan for each analysed conversation and mode, with memory_ids, memory_topics, use_memory; one pass over the context.

    context: as `context_analysis` gives it. memories: `key`, m_id and what else `memory.retrieve` knows. Rows are repeated for the modes
    before anything that differs between them, so context, candidates and plan are one job. gate: whether the policy asks for the topic
    of the conversation. Without planning strategy and tone are the defaults.
    """
    modes = modes or MODES
    cases = E.sweep(context, {m: {} if seen else BLANK for m, (seen, _, _) in modes.items()})
    asks = cases.where(F.col("mode").isin(*[m for m, x in modes.items() if x[1]]))
    asks = asks.select(key, "state", F.struct(key, "mode").alias("q_id"), F.col("last_user_message").alias("q_text"), F.col("topic").alias("q_topic"))
    found = M.retrieve(asks, memories, key, k)
    chosen = M.select_policy(found, "q_id", least=least, most=most, by="score", topic="q_topic" if gate else None, state="state")
    chosen = chosen.select(F.col("q_id")[key].alias(key), F.col("q_id")["mode"].alias("mode"), "memory_ids", "memory_topics")
    df = cases.join(chosen, [key, "mode"], "left").withColumn("use_memory", F.coalesce(F.size("memory_ids") > 0, F.lit(False)))
    df = D.plan(df.fillna({"low": "", "state": "ongoing", "intent": "unknown", "ambiguity": "high", "activity": ""}))
    plain = F.col("mode").isin(*[m for m, x in modes.items() if not x[2]])
    return df.withColumns({"strategy": F.when(plain, "react").otherwise(F.col("strategy")), "tone": F.when(plain, "casual").otherwise(F.col("tone"))})
