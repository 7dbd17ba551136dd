"""Queries of rule annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import params
from .functions import text as T
from .functions.rules import first_match_sql
from .operators import annotate as A
from .operators import decide as D
from .operators import lexicon as X
from .operators import windows as N
from .registry import query, table

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _language_sql(distinct: bool) -> str:
    words = r"regexp_extract_all(lower(text), '\p{L}+')"
    words = f"list_distinct({words})" if distinct else words
    count = lambda xs: f"len(list_filter(w, lambda x: x IN ({_IN(xs)})))"
    return f"""SELECT doc_id, CASE WHEN len(w) = 0 THEN 'unknown' WHEN p > 0 AND s > 0 THEN CASE WHEN p >= s THEN 'primary' ELSE 'mixed' END
    WHEN p > 0 THEN 'primary' WHEN s > 0 THEN 'secondary' ELSE 'unknown' END AS tag
    FROM (SELECT doc_id, w, {count(params.PRIMARY)} AS p, {count(params.SECONDARY)} AS s FROM (SELECT doc_id, {words} AS w FROM documents))"""


@query("a01_language", _language_sql(True))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", A.language_tag(F.col("text"), params.PRIMARY, params.SECONDARY, True).alias("tag"))


@query("a02_language_all_words", _language_sql(False))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", A.language_tag(F.col("text"), params.PRIMARY, params.SECONDARY, False).alias("tag"))


@query("a03_tone", f"SELECT doc_id, CASE WHEN t <> '' THEN t WHEN length({_STRIP}) <= 4 THEN 'neutral' ELSE 'casual' END AS tone FROM (SELECT doc_id, text, {first_match_sql('lower(text)', params.TONE, '')} AS t FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", A.tone(F.col("text"), params.TONE).alias("tone"))


@query("a04_tone_second", f"SELECT doc_id, CASE WHEN t <> '' THEN t WHEN length({_STRIP}) <= 4 THEN 'neutral' ELSE 'casual' END AS tone FROM (SELECT doc_id, text, {first_match_sql('lower(text)', params.TONE_2, '')} AS t FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", A.tone(F.col("text"), params.TONE_2).alias("tone"))


@query("a05_response_type", f"SELECT conv_id, turn, {first_match_sql(f'lower({_STRIP})', params.RESPONSE, 'answer')} AS kind FROM conversations")
def _(spark, d):
    kind = A.first_match(F.lower(T.strip(F.col("text"))), params.RESPONSE, "answer")
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"))


@query(
    "a06_response_type_second",
    f"""SELECT conv_id, turn, CASE WHEN kind = 'answer' AND NOT contains(coalesce(before, ''), '?') THEN 'statement' ELSE kind END AS kind FROM (
    SELECT conv_id, turn, {first_match_sql(f'lower({_STRIP})', params.RESPONSE_2, 'answer')} AS kind, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations)""",
)
def _(spark, d):
    df = N.last_user(table(spark, d, "conversations"), "conv_id", "turn")
    kind = A.first_match(F.lower(T.strip(F.col("text"))), params.RESPONSE_2, "answer")
    asked = F.coalesce("last_user", F.lit("")).contains("?")
    return df.select("conv_id", "turn", F.when((kind == "answer") & ~asked, "statement").otherwise(kind).alias("kind"))


_KINDS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in T.PERSONAL) + "], lambda x: x IS NOT NULL), ',')"


@query("a07_personal_data", f"SELECT doc_id, {_KINDS} AS kinds FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.personal_data(F.col("text")), ",").alias("kinds"))


_LENGTH = f"""CASE WHEN length({_STRIP}) <= 5 OR NOT regexp_matches({_STRIP}, '\\s') THEN 'very_short' WHEN length({_STRIP}) <= 20 THEN 'short'
    WHEN length({_STRIP}) <= 60 THEN 'medium' ELSE 'long' END"""


@query("a08_length", f"SELECT doc_id, {_LENGTH} AS length_class, length({_STRIP}) AS chars FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.length_class(F.col("text")).alias("length_class"), F.length(T.strip(F.col("text"))).cast("long").alias("chars"))


@query("a09_emoji_count")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.emoji_count(F.col("text")).cast("long").alias("emoji"))


@query("a10_emoji_flag", r"SELECT doc_id, regexp_matches(text, '[\p{So}\p{Sk}\x{1F300}-\x{1FAD6}\x{2600}-\x{27BF}]') AS has_emoji FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_emoji(F.col("text")).alias("has_emoji"))


@query("a11_slang", f"SELECT doc_id, list_has_any(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), [{_IN(params.SLANG)}]) AS has_slang FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.arrays_overlap(T.tokens(F.col("text")), F.array(*map(F.lit, params.SLANG))).alias("has_slang"))


_QUESTION = f"contains(text, '?') OR " + " OR ".join(f"starts_with(lower({_STRIP}), '{o} ')" for o in params.OPENERS)


@query("a12_question", f"SELECT conv_id, turn, {_QUESTION} AS is_question FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_question(F.col("text"), params.OPENERS).alias("is_question"))


@query("a13_behaviour")
def _(spark, d):
    df = N.last_user(table(spark, d, "conversations"), "conv_id", "turn")
    return df.select("conv_id", "turn", A.behaviour(F.col("text"), F.col("last_user")).alias("b")).select("conv_id", "turn", "b.*")


_TOPICS = "lex(rank, topic, term, weight) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}', {w}::DOUBLE)" for a, b, c, w in params.TOPICS) + ")"
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_PAIRS = """pairs AS (SELECT conv_id, turn, conv_id * 1000 + turn AS k, text AS target, lag(text) OVER w AS prompt,
    coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def pairs(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    before = F.array_join(F.collect_list("text").over(w.rowsBetween(W.unboundedPreceding, -1)), " ")
    df = table(spark, d, "conversations")
    return df.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.col("text").alias("target"), F.lag("text").over(w).alias("prompt"), before.alias("context"))


@query(
    "a14_topic",
    f"""WITH {_TOPICS}, {_PAIRS}, hit AS (SELECT k, rank, topic, sum(weight * (CASE WHEN list_contains({_TOKENS.format('prompt')}, term) THEN 1.8 ELSE 0 END
      + CASE WHEN list_contains({_TOKENS.format('target')}, term) THEN 1.3 WHEN list_contains({_TOKENS.format('context')}, term) THEN 0.9 ELSE 0 END)) AS score FROM
      (SELECT k, coalesce(prompt, '') AS prompt, target, context FROM pairs), lex GROUP BY ALL),
    best AS (SELECT k, score, topic FROM hit QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, rank) = 1)
    SELECT p.k, CASE WHEN round(score, 9) < 1.0 THEN CASE WHEN len(list_filter(regexp_split_to_array(target, '\\s+'), lambda x: x <> '')) <= 4 THEN 'casual_chat' ELSE 'other' END ELSE topic END AS topic,
      round(greatest(0.2, least(1.0, score / 5.0)), 4) AS confidence FROM pairs p JOIN best USING (k)""",
)
def _(spark, d):
    return A.classify_topic(pairs(spark, d), "k", "prompt", "target", "context", params.TOPICS)


@query(
    "a15_window_topic",
    f"""WITH {_TOPICS}, t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    r AS (SELECT *, (1 + 2 * i / greatest(n - 1, 1)) * CASE WHEN i = n - 1 THEN 1.2 ELSE 1.0 END AS r FROM t),
    s AS (SELECT conv_id, rank, topic, round(sum(CASE WHEN list_contains({_TOKENS.format('text')}, term) THEN weight * r ELSE 0 END), 6) AS score FROM r, lex GROUP BY ALL)
    SELECT conv_id, CASE WHEN score < 1.0 THEN 'casual_chat' ELSE topic END AS topic FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, rank) = 1""",
)
def _(spark, d):
    return A.window_topic(table(spark, d, "conversations"), "conv_id", "turn", params.TOPICS)


_LAST = f"""last AS (SELECT conv_id, n, text, before FROM (SELECT conv_id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, turn,
    count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1)"""


def last_turns(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    df = table(spark, d, "conversations").withColumns({"before": F.lag("text").over(w), "n": F.count(F.lit(1)).over(W.partitionBy("conv_id")), "r": F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))})
    return df.where("r = 1").select("conv_id", "n", "text", "before")


_WORDS = {k: v.replace("'", "''") for k, v in params.DECISION_WORDS.items()}
_LOW = lambda c: rf"regexp_replace(lower(coalesce({c}, '')), '^\s+|\s+$', '', 'g')"
_COUNT = lambda c: rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"
_HAS = lambda c, name: f"regexp_matches({c}, '{_WORDS[name]}')"


@query(
    "a16_state_example",
    f"""WITH t AS (SELECT conv_id, turn, text, row_number() OVER w - 1 AS depth, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    l AS (SELECT conv_id, turn, depth, {_LOW('before')} AS u, {_LOW('text')} AS s FROM t)
    SELECT conv_id, turn, CASE WHEN {_HAS('s', 'leaves')} OR {_HAS('u', 'leaves')} THEN 'closing' WHEN {_HAS('u', 'jokes')} OR {_HAS('s', 'jokes')} THEN 'banter'
      WHEN {_HAS('s', 'assents')} AND {_COUNT('s')} <= 4 THEN 'agreement' WHEN contains(u, '?') OR {_HAS('u', 'asks_first')} THEN 'inquiry'
      WHEN depth <= 1 AND ({_HAS('u', 'greets')} OR {_COUNT('u')} <= 2) THEN 'opening' ELSE 'ongoing' END AS state FROM l""",
)
def _(spark, d):
    from pyspark.sql import Window as W

    df = N.last_user(table(spark, d, "conversations"), "conv_id", "turn")
    df = df.withColumn("depth", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    return df.select("conv_id", "turn", D.example_state(F.col("last_user"), F.col("text"), F.col("depth")).alias("state"))


@query("a17_state_window", f"WITH {_LAST} SELECT conv_id, CASE WHEN n <= 1 THEN 'opening' ELSE {first_match_sql(f'lower({_STRIP})', params.STATE, 'ongoing')} END AS state FROM last")
def _(spark, d):
    return last_turns(spark, d).select("conv_id", A.dialogue_state(F.col("text"), F.col("n")).alias("state"))


#: low, clause, before and n_words of the last turns, and their intent.
_UTTER = rf"""u0 AS (SELECT conv_id, n, text, {_LOW('text')} AS low, {_LOW('before')} AS before FROM last),
    u AS (SELECT *, {_COUNT('low')} AS n_words, coalesce(list_filter(list_transform(regexp_split_to_array(low, '[.!?;\n]+'), lambda x: trim(x)), lambda x: x <> '')[-1], low) AS clause FROM u0),
    i AS (SELECT *, {D.first_of_sql(params.INTENT_RULES, 'unknown')} AS intent FROM u)"""


@query("a18_intent", f"WITH {_LAST}, {_UTTER} SELECT conv_id, intent FROM i")
def _(spark, d):
    return D.intent(last_turns(spark, d), F.col("text"), F.col("before")).select("conv_id", "intent")


@query(
    "a18_intent_all",
    f"WITH last AS (SELECT conv_id * 1000 + turn AS conv_id, 1 AS n, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), {_UTTER} SELECT conv_id AS k, intent FROM i",
)
def _(spark, d):
    p = pairs(spark, d)
    return D.intent(p, F.col("target"), F.col("prompt")).select("k", "intent")


_NOUNS = ["order", "plan", "price", "page", "la", "the"]
_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
_AMBIGUITY = f"CASE WHEN {_WORDS} <= 2 AND NOT list_has_any({_TOKENS.format('text')}, [{_IN(_NOUNS)}]) THEN 'high' WHEN {_WORDS} <= 5 THEN 'medium' ELSE 'low' END"


@query("a19_ambiguity", f"SELECT doc_id, {_AMBIGUITY} AS ambiguity FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", A.ambiguity(F.col("text"), _NOUNS).alias("ambiguity"))


@query(
    "a20_recent_activity",
    f"WITH {_PAIRS} SELECT k, CASE WHEN contains(lower(context), 'of the') THEN 'first' WHEN contains(lower(context), 'de la') THEN 'second' END AS activity FROM pairs",
)
def _(spark, d):
    return pairs(spark, d).select("k", A.recent_activity(F.col("context"), [("of the", "first"), ("de la", "second")]).alias("activity"))


@query("a21_context_job")
def _(spark, d):
    from .plans.score import context_analysis

    return context_analysis(table(spark, d, "conversations"))


@query("a22_annotate_job")
def _(spark, d):
    from .plans.build_corpus import annotate_examples

    return annotate_examples(N.context_windows(table(spark, d, "conversations")))


@query(
    "a23_style_flags",
    f"""SELECT doc_id, list_has_any(t, [{_IN(params.PRIMARY)}]) AND list_has_any(t, [{_IN(params.SECONDARY)}]) AS code_mixed, list_has_any(t, [{_IN(params.SLANG)}]) AS slang,
    regexp_matches(lower(text), 'as an ai|i cannot|i am unable') AS unsupported FROM (SELECT *, {_TOKENS.format('text')} AS t FROM documents)""",
)
def _(spark, d):
    t = T.tokens(F.col("text"))
    any_of = lambda xs: F.arrays_overlap(t, F.array(*map(F.lit, xs)))
    return table(spark, d, "documents").select(
        "doc_id", (any_of(params.PRIMARY) & any_of(params.SECONDARY)).alias("code_mixed"), any_of(params.SLANG).alias("slang"),
        F.lower("text").rlike("as an ai|i cannot|i am unable").alias("unsupported"),
    )


@query("a24_quality_flag", f"SELECT doc_id, CASE WHEN {_KINDS} <> '' OR length(text) > 500 THEN 'REVIEW' ELSE 'KEEP' END AS flag FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", A.quality_flag(F.col("text")).alias("flag"))


@query("j04_lexicon_join", f"WITH {_TOPICS}, w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT topic, count(*) AS n FROM w JOIN lex USING (term) GROUP BY 1")
def _(spark, d):
    lexicon = F.broadcast(spark.createDataFrame(params.TOPICS, "rank int, topic string, term string, weight double"))
    df = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return df.join(lexicon, "term").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


_PHRASES = "lex(rank, topic, phrase, weight) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}', {w}::DOUBLE)" for a, b, c, w in params.PHRASES) + ")"
_HITS = f"""{_PHRASES}, l AS (SELECT *, {_TOKENS.format('phrase')} AS want FROM lex), t AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents), s AS (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS p FROM t),
    h AS (SELECT doc_id, p - 1 AS place, rank, topic, phrase, weight FROM s JOIN l ON t[p] = want[1] AND t[p:p + len(want) - 1] = want)"""


def _phrases(spark):
    return spark.createDataFrame(params.PHRASES, "rank int, topic string, phrase string, weight double")


@query("j04_phrase_hits", f"WITH {_HITS} SELECT doc_id, phrase, count(*) AS n, min(place)::INT AS first_place FROM h GROUP BY ALL")
def _(spark, d):
    hits = X.phrase_hits(table(spark, d, "documents"), ["doc_id"], "text", _phrases(spark))
    return hits.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))


@query(
    "a14_phrase_topics",
    f"""WITH {_HITS}, g AS (SELECT doc_id, topic, round(sum(weight), 6) AS score, min(rank) AS rank FROM (SELECT DISTINCT doc_id, rank, topic, phrase, weight FROM h) GROUP BY ALL)
    SELECT doc_id, topic, score FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank, topic) = 1""",
)
def _(spark, d):
    return X.phrase_topics(table(spark, d, "documents"), "doc_id", "text", _phrases(spark))


@query("w06_message_type", r"""SELECT page_id, CASE WHEN trim(url) = '' THEN 'empty' WHEN regexp_full_match(trim(url), 'https?://\S+') THEN 'url' ELSE 'text' END AS kind FROM pages""")
def _(spark, d):
    from .sources.chat_export import message_type

    return table(spark, d, "pages").select("page_id", message_type(F.lit("x"), F.col("url")).alias("kind"))


@query("w07_content_flags", r"SELECT doc_id, regexp_matches(text, 'https?://\S+|www\.\S+') AS has_url, regexp_matches(text, '[\x{0900}-\x{097F}]') AS has_devanagari FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(T.URL).alias("has_url"), F.col("text").rlike(T.DEVANAGARI).alias("has_devanagari"))
