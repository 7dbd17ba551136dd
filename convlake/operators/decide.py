"""Intent, dialogue state, response strategy, tone, confidence and instruction: ordered rules over text and context.

A rule is (label, condition). Conditions are SQL over named columns in which RE(column, 'pattern') asks for a match, and {name}
stands for a word pattern or a topic of the tables in `params`; the same text makes Spark columns and the SQL of tests.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text as T

_RE = re.compile(r"RE\((\w+), '((?:[^']|'')*)'\)")


def filled(condition: str, words: dict[str, str]) -> str:
    """The condition with its names replaced by patterns, quotes doubled."""
    for name, pattern in words.items():
        condition = condition.replace("{" + name + "}", pattern.replace("'", "''"))
    return condition


def condition(text: str, words: dict[str, str]) -> Column:
    return F.expr(_RE.sub(lambda m: f"regexp_like({m[1]}, r\"{m[2].replace(chr(39) * 2, chr(39))}\")", filled(text, words)))


def condition_sql(text: str, words: dict[str, str]) -> str:
    return _RE.sub(lambda m: f"regexp_matches({m[1]}, '{m[2]}')", filled(text, words))


def first_of(rules: list[tuple[str, str]], default: str, words: dict[str, str] | None = None) -> Column:
    """The label of the first rule whose condition holds."""
    words = params.DECISION_WORDS if words is None else words
    out = None
    for label, text in rules:
        out = F.when(condition(text, words), label) if out is None else out.when(condition(text, words), label)
    return F.lit(default) if out is None else out.otherwise(default)


def first_of_sql(rules: list[tuple[str, str]], default: str, words: dict[str, str] | None = None) -> str:
    words = params.DECISION_WORDS if words is None else words
    return "CASE " + " ".join(f"WHEN {condition_sql(c, words)} THEN '{x}'" for x, c in rules) + f" ELSE '{default}' END"


def last_clause(text: Column) -> Column:
    """What follows the last sentence end that has something after it."""
    parts = F.filter(F.transform(F.split(text, r"[.!?;\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), text)


def utterance(df: DataFrame, text: Column, before: Column) -> DataFrame:
    """`df` with what intent rules see: low, clause (its last one), before (the reply it follows) and n_words."""
    low = F.lower(T.strip(F.coalesce(text, F.lit(""))))
    df = df.withColumns({"low": low, "before": F.lower(T.strip(F.coalesce(before, F.lit(""))))})
    return df.withColumns({"clause": last_clause(F.col("low")), "n_words": F.size(T.words(F.col("low")))})


def intent(df: DataFrame, text: Column, before: Column, words: dict[str, str] | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """`df` with low, clause, before, n_words and intent.

    First bare words and short replies to an invitation or a proposal, then requests, plans, invitations, questions (by their last
    clause), assent, dissent, statements, reactions, pleasantries; else a long text informs.
    """
    return utterance(df, text, before).withColumn("intent", first_of(rules or params.INTENT_RULES, "unknown", words))


def example_state(last_user: Column, target: Column, depth: Column, words: dict[str, str] | None = None) -> Column:
    """State of a training example: closing, banter, agreement (target of at most four words), inquiry, opening or ongoing."""
    words = params.DECISION_WORDS if words is None else words
    user, said = F.lower(T.strip(F.coalesce(last_user, F.lit("")))), F.lower(T.strip(F.coalesce(target, F.lit(""))))
    has = lambda c, name: c.rlike(words[name])
    short = F.size(T.words(user)) <= 2
    return (
        F.when(has(said, "leaves") | has(user, "leaves"), "closing")
        .when(has(user, "jokes") | has(said, "jokes"), "banter")
        .when(has(said, "assents") & (F.size(T.words(said)) <= 4), "agreement")
        .when(user.contains("?") | has(user, "asks_first"), "inquiry")
        .when((depth <= 1) & (has(user, "greets") | short), "opening")
        .otherwise("ongoing")
    )


def confidence(intent: str, ambiguity: str, depth: str, strategy: str, memory: str) -> str:
    """Five terms (intent, ambiguity, depth, strategy, memory) as SQL over these columns; their sum, in [0.1, 1], to two places."""
    # The terms in hundredths.
    terms = [
        f"CASE WHEN {intent} IN ('question', 'invitation', 'agreement', 'planning', 'disagreement') THEN 25 WHEN {intent} IN ('information', 'reaction') THEN 20 ELSE 15 END",
        f"CASE WHEN {ambiguity} = 'low' THEN 35 WHEN {ambiguity} = 'medium' THEN 20 ELSE 5 END",
        f"CASE WHEN {depth} >= 3 THEN 15 WHEN {depth} = 2 THEN 10 ELSE 5 END",
        f"CASE WHEN {strategy} IN ('accept', 'decline', 'close_conversation', 'answer', 'provide_information') THEN 15 ELSE 10 END",
        f"CASE WHEN {memory} THEN 10 ELSE 5 END",
    ]
    return f"round(greatest(10, least(100, {' + '.join(terms)})) / 100.0, 2)"


def instruction_sql(columns: dict[str, str] | None = None) -> str:
    """`aim: ...; tone: ...; topic: ...; memories: ...` of a strategy; SQL for either engine."""
    name = {"strategy": "strategy", "tone": "tone", "topic": "topic", "memory": "use_memory"} | (columns or {})
    of = lambda pick, other: f"CASE {name['strategy']} " + " ".join(f"WHEN '{s}' THEN {pick(x)}" for s, x in params.AIMS.items()) + f" ELSE {other} END"
    given, none, off = (f"'{x}'" for x in params.MEMORY_NOTES)
    notes = f"CASE WHEN {name['memory']} THEN {given} ELSE {none} END"
    aim, memory = of(lambda x: f"'{x[0]}'", f"'{params.AIM}'"), of(lambda x: notes if x[1] else off, notes)
    return f"concat('aim: ', {aim}, '; tone: ', {name['tone']}, '; topic: ', {name['topic']}, '; memories: ', {memory})"


def plan(context: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """Strategy, tone, confidence and instruction of analysed conversations.

    context: low (last user text, lower case), intent, state, ambiguity, topic, depth and, where known, use_memory.
    """
    if "use_memory" not in context.columns:
        context = context.withColumn("use_memory", F.lit(False))
    df = context.withColumns({"strategy": first_of(params.STRATEGY_RULES, "react", words), "tone": first_of(params.TONE_RULES, "casual", words)})
    sure = F.expr(confidence("intent", "ambiguity", "depth", "strategy", "use_memory")).cast("double")
    return df.withColumns({"confidence": sure, "instruction": F.expr(instruction_sql())})
