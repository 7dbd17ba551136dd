"""Memory tables: extraction, normal form, embeddings, upsert, ranking, retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from ..functions import text as T
from . import neighbours as N
from .relational import cosine

#: (content, pattern, type, topic, importance); default table for the languages of the test data.
RULES = [
    ("likes", r"(?i)\b(i (really )?(like|love|enjoy)|j'aime|ich mag|me gusta)\b", "preference", "things", "medium"),
    ("dislikes", r"(?i)\b(i (dislike|hate|avoid)|je déteste|ich hasse|odio)\b", "preference", "things", "medium"),
    ("prefers", r"(?i)\b(i('d)? (prefer|rather)|je préfère|ich bevorzuge|prefiero)\b", "preference", "things", "medium"),
    ("collects", r"(?i)\b(i collect|je collectionne|ich sammle|colecciono)\b", "preference", "things", "low"),
    ("owns", r"(?i)\b(i (own|bought)|je possède|ich besitze|tengo un[ao]?)\b", "fact", "things", "low"),
    ("lives", r"(?i)\b(i live|j'habite|ich wohne|vivo en)\b", "fact", "places", "high"),
    ("comes from", r"(?i)\b(i('m| am) from|je viens d|ich komme aus|soy de)\b", "fact", "places", "medium"),
    ("works", r"(?i)\b(i work|je travaille|ich arbeite|trabajo (en|de|para))\b", "fact", "places", "high"),
    ("studies", r"(?i)\b(i (study|am studying)|j'étudie|ich studiere|estudio)\b", "fact", "places", "high"),
    ("travels", r"(?i)\b(i('m| am) travell?ing|je voyage|ich reise|viajo)\b", "event", "places", "low"),
    ("moves", r"(?i)\b(i('m| am) moving|je déménage|ich ziehe um|me mudo)\b", "event", "places", "medium"),
    ("name", r"(?i)\b(my name is|je m'appelle|ich heiße|me llamo)\b", "fact", "people", "high"),
    ("has family", r"(?i)\b(my|mon|ma|mein|meine|mi) (brother|sister|mother|father|frère|sœur|mère|père|bruder|schwester|mutter|vater|hermano|hermana|madre|padre)\b", "relation", "people", "medium"),
    ("has a partner", r"(?i)\b(my (wife|husband|partner)|(mon mari|ma femme)|mein mann|meine frau|mi (esposa|esposo))\b", "relation", "people", "high"),
    ("has a friend", r"(?i)\b(my (best )?friend|mon ami|mein freund|mi amig[oa])\b", "relation", "people", "medium"),
    ("has a pet", r"(?i)\b(my|mon|mein|mi) (dog|cat|chien|chat|hund|kater|perro|gato)\b", "relation", "people", "low"),
    ("speaks", r"(?i)\b(i speak|je parle|ich spreche|hablo)\b", "fact", "people", "medium"),
    ("age", r"(?i)\b(i('m| am) [0-9]+ years old|j'ai [0-9]+ ans|ich bin [0-9]+ jahre|tengo [0-9]+ años)\b", "fact", "time", "high"),
    ("birthday", r"(?i)\b(my birthday|mon anniversaire|mein geburtstag|mi cumpleaños)\b", "event", "time", "high"),
    ("has a date", r"(?i)\b(i have (an appointment|a meeting|an exam)|j'ai (un rendez-vous|un examen)|ich habe (einen termin|eine prüfung)|tengo (una cita|un examen))\b", "event", "time", "medium"),
    ("has a habit", r"(?i)\b(i (always|usually|never)|je (.{1,20} )?toujours|ich .{1,20} immer|siempre)\b", "habit", "time", "low"),
]
EPHEMERAL = r"(?i)^\s*(ok|okay|yes|no|thanks|merci|danke|hi|hello)?[.!? ]*\s*$"
FILLERS = ["the", "a", "of", "to", "is", "and"]
IMPORTANCE = {"high": 1.0, "medium": 0.6, "low": 0.2}


def extract_facts(turns: DataFrame, key: str, order: str, rules: list[tuple] = RULES) -> DataFrame:
    """User turns that are not ephemeral: every rule that fits emits; the first of each content in a conversation stays."""
    use = turns.where(F.col("role").isin("user", "human") & ~F.col("text").rlike(T.portable(EPHEMERAL)))
    fields = lambda r, i: F.struct(F.lit(i).alias("rule_no"), F.lit(r[0]).alias("content"), F.lit(r[2]).alias("memory_type"), F.lit(r[3]).alias("topic"), F.lit(r[4]).alias("importance"))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(T.portable(r[1])), fields(r, i)) for i, r in enumerate(rules)]))
    df = use.select(key, order, F.inline(hits))
    w = W.partitionBy(key, "content").orderBy(order, "rule_no")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "rule_no")


def normal_form(content: Column, fillers: list[str] = FILLERS) -> Column:
    """Lower case, without punctuation and filler words."""
    return F.array_join(F.filter(T.tokens(content), lambda w: ~w.isin(*fillers)), " ")


def embed(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """Hashed bag of words: slot hash mod dim, value (hash mod 97) / 100 + 0.1, summed and scaled to length one."""
    t = df.select(key, F.explode(T.tokens(F.col(text))).alias("w"))
    h = F.pmod(F.xxhash64("w"), F.lit(1 << 31))
    slots = t.groupBy(key, F.pmod(h, F.lit(dim)).cast("int").alias("slot")).agg(F.sum(F.pmod(h, F.lit(97)) / 100.0 + 0.1).alias("v"))
    vec = slots.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).cast("float"))
    return vec.select(key, values.alias("embedding"))


def embeddings(df: DataFrame, key: str, text: str, model: Callable[[Iterator[pd.Series]], Iterator[pd.Series]] | None = None, dim: int = 64) -> DataFrame:
    """key, embedding of every row: by `model`, or by `embed` without leaving the engine, with zeros where a text has no words.

    model: gets the texts of a task batch by batch (null: empty), so that it loads its weights once for each task, and gives a series of
    vectors, as long as the batch, for each. Its rows are not moved.
    """
    if model is None:
        zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
        return df.select(key).join(embed(df, key, text, dim), key, "left").withColumn("embedding", F.coalesce("embedding", zeros))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from model(batches)

    return df.select(key, F.pandas_udf(run, ArrayType(FloatType()))(F.coalesce(text, F.lit(""))).alias("embedding"))


def jaccard(a: Column, b: Column) -> Column:
    """Word overlap of two token arrays; 0 if either is empty."""
    both, any_of = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.greatest(any_of, F.lit(1))).otherwise(0.0)


def upsert_runs(events: DataFrame, persona: str, slot: str, value: str, order: list[str], importance: str) -> DataFrame:
    """The table after upserts in order: equal values in a row merge (highest importance, last time); a new value supersedes.

    A, B, A gives three rows of which the last is active.
    """
    w = W.partitionBy(persona, slot).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    df = events.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = df.groupBy(persona, slot, "run").agg(
        F.first(value).alias(value), F.min(F.struct(*order)).alias("_a"), F.max(F.struct(*order)).alias("_z"), F.max(importance).alias("importance"), F.count(F.lit(1)).alias("merged")
    )
    last = F.max("run").over(W.partitionBy(persona, slot))
    return g.withColumns({"created": F.col("_a")[order[0]], "updated": F.col("_z")[order[0]], "status": F.when(F.col("run") == last, "active").otherwise("superseded")}).drop("_a", "_z")


def score(semantic: Column, topical: Column, importance: Column, age_days: Column, decay_days: float = 30.0) -> Column:
    """0.4 semantic + 0.3 topic + 0.2 importance + 0.1 recency, in [0, 1]; recency 0.5 for an unknown age."""
    recency = F.when(age_days.isNotNull(), F.exp(-F.greatest(age_days, F.lit(0.0)) / decay_days)).otherwise(0.5)  # greatest alone would take null for 0
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * semantic + 0.3 * topical + 0.2 * importance + 0.1 * recency))


def top_k(scored: DataFrame, query: str, by: list[Column], k: int) -> DataFrame:
    w = W.partitionBy(query).orderBy(*by)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_text(*choices: Column) -> Column:
    """The first text that is not blank: explicit query, last user message of the context, last user turn, topic."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in choices], F.lit(""))


def _weight() -> Column:
    weight = F.lit(None).cast("double")
    for name, value in IMPORTANCE.items():
        weight = F.when(F.col("m_importance") == name, value).otherwise(weight)
    return F.coalesce(weight, F.lit(0.6))


def _retrieve_blocks(queries: DataFrame, active: DataFrame, persona: str, k: int, own: bool, keywords: dict[str, list[str]]) -> DataFrame:
    words = lambda c: T.tokens(F.coalesce(c, F.lit("")))
    says = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.arrays_overlap(words("q_text"), F.array(*map(F.lit, xs))), F.lit(t.lower())) for t, xs in keywords.items()]))
    q = queries.select(persona, "q_id", "q_embedding", words("q_text").alias("q_words"), F.lower("q_topic").alias("q_topic"), says.alias("says"))
    rest = score(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("m_age_days")) / 0.1
    m = active.select(persona, "m_id", "m_embedding", words("m_text").alias("m_words"), F.lower("m_topic").alias("m_topic"), _weight().alias("weight"), rest.alias("recency"), "m_age_days")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        some = lambda xs: np.array([x is not None and len(x) > 0 for x in xs])
        both = np.outer(some(a["q_embedding"]), some(b["m_embedding"]))
        semantic = N.cosines(a["q_embedding"], b["m_embedding"])
        if not both.all():
            semantic = np.where(both, semantic, N.overlaps(a["q_words"], b["m_words"]))
        topics = {t: (b["m_topic"] == t).to_numpy() for t in b["m_topic"].dropna().unique() if t}
        fit = np.zeros(both.shape, dtype=bool)
        for y, (topic, said) in enumerate(zip(a["q_topic"], a["says"])):
            for t in {topic, *said} & topics.keys():
                fit[y] |= topics[t]
        whole = 0.4 * semantic + 0.3 * fit + 0.2 * b["weight"].to_numpy() + 0.1 * b["recency"].to_numpy()
        whole = N.half_up(np.clip(whole, 0, 1), 4)
        ids, age = b["m_id"].to_numpy(), b["m_age_days"].astype("float64").fillna(-np.inf).to_numpy()
        by = np.argsort(ids, kind="stable")
        by = by[np.argsort(-age[by], kind="stable")]
        out = []
        for y, name in enumerate(a["q_id"]):
            order = by[np.argsort(-whole[y][by], kind="stable")][: k + 1]
            out += [(name, ids[x], semantic[y, x], whole[y, x]) for x in [x for x in order if not (own and ids[x] == name)][:k]]
        return pd.DataFrame(out, columns=["q_id", "m_id", "semantic", "score"])

    kind = StructType([queries.schema["q_id"], active.schema["m_id"], StructField("semantic", DoubleType()), StructField("score", DoubleType())])
    found = N.blocked(q, m, persona, best, kind)
    pairs = queries.join(found, "q_id").join(active, [persona, "m_id"])
    return top_k(pairs, "q_id", [F.desc("score"), F.desc_nulls_last("m_age_days"), F.col("m_id")], k)


def retrieve(queries: DataFrame, memories: DataFrame, persona: str, k: int = 5, own: bool = False, keywords: dict[str, list[str]] | None = None, blocks: bool = False) -> DataFrame:
    """The k best active memories of each query's persona, by `score` to four places, then age (oldest first), then id.

    queries: q_id and, where known, q_embedding, q_text, q_topic; memories: m_id and, where known, m_embedding, m_text,
    m_topic, m_importance, m_age_days, status. Without both embeddings word overlap counts; keywords are words of a query
    that speak for a topic. own: queries are memories themselves, and no query finds itself. blocks: for personas with many memories and
    queries; tasks compare blocks of them and hand on the k best, with the same result; q_id, and m_id within a persona, must be unique.
    """
    active = memories.where("status = 'active'") if "status" in memories.columns else memories
    for name, kind in (("q_embedding", "array<float>"), ("q_text", "string"), ("q_topic", "string")):
        queries = queries if name in queries.columns else queries.withColumn(name, F.lit(None).cast(kind))
    for name, kind in (("m_embedding", "array<float>"), ("m_text", "string"), ("m_topic", "string"), ("m_importance", "string"), ("m_age_days", "double")):
        active = active if name in active.columns else active.withColumn(name, F.lit(None).cast(kind))
    if blocks:
        return _retrieve_blocks(queries, active, persona, k, own, keywords or {})
    pairs = queries.join(active, persona)
    if own:
        pairs = pairs.where(~F.col("q_id").eqNullSafe(F.col("m_id")))
    q_words, m_words = (T.tokens(F.coalesce(c, F.lit(""))) for c in ("q_text", "m_text"))
    both = (F.size("q_embedding") > 0) & (F.size("m_embedding") > 0)
    semantic = F.when(both, cosine(F.col("q_embedding"), F.col("m_embedding"))).otherwise(jaccard(q_words, m_words))
    topic = F.lower("m_topic")
    fit = topic == F.lower("q_topic")
    for name, words in (keywords or {}).items():
        fit = F.coalesce(fit, F.lit(False)) | ((topic == name.lower()) & F.arrays_overlap(q_words, F.array(*[F.lit(w) for w in words])))
    topical = F.when(fit & (topic != ""), 1.0).otherwise(0.0)
    scored = pairs.withColumn("semantic", semantic).withColumn("score", F.round(score(F.col("semantic"), topical, _weight(), F.col("m_age_days")), 4))
    return top_k(scored, "q_id", [F.desc("score"), F.desc_nulls_last("m_age_days"), F.col("m_id")], k)


def search_score(q_embedding: Column, m_embedding: Column, q_words: Column, m_words: Column) -> Column:
    """0.7 times the cosine of the vectors (0 where one is missing) and 0.3 times the word overlap."""
    both = (F.size(q_embedding) > 0) & (F.size(m_embedding) > 0)
    return 0.7 * F.when(both, cosine(q_embedding, m_embedding)).otherwise(0.0) + 0.3 * jaccard(q_words, m_words)


def select_policy(
    ranked: DataFrame, query: str, least: float = 0.45, most: int = 2, by: str = "semantic", topic: str | None = None, state: str | None = None
) -> DataFrame:
    """The first `most` memories of each query at or over `least` by the column `by`: their ids and, where known, topics, as arrays.

    topic: the query's topic; a memory with a topic (m_topic) must have the same one, or for small talk be general itself.
    state: the query's state; closing conversations get none. Rows that a status column calls other than active are left out.
    """
    good = ranked.where(F.col(by) >= least)
    if "status" in ranked.columns:
        good = good.where("status = 'active'")
    if state:
        good = good.where(~F.lower(state).eqNullSafe("closing"))
    if topic:
        wanted, own = F.lower(F.coalesce(topic, F.lit(""))), F.lower(F.coalesce("m_topic", F.lit("")))
        loose = wanted.isin("casual_chat", "other")
        good = good.where((own == "") | F.when(loose, own.isin("casual_chat", "general")).otherwise(own == wanted))
    good = top_k(good, query, [F.desc(by), F.col("m_id")], most)
    given = [c for c in ("m_id", "m_topic") if c in good.columns]
    listed = F.sort_array(F.collect_list(F.struct("rank", *given)))  # of `most` rows
    names = {"m_id": "memory_ids", "m_topic": "memory_topics"}
    return good.groupBy(query).agg(*[listed.getField(c).alias(names[c]) for c in given])


def select_search(queries: DataFrame, memories: DataFrame, persona: str, least: float = 0.45, most: int = 2) -> DataFrame:
    """`select_policy` over all other memories of each query's persona, by cosine to nine places and ties to the smaller m_id.

    queries: persona, q_id, q_embedding, q_topic, state; memories: persona, m_id, m_embedding, m_topic. A query only meets the memories
    whose topic its own allows, block by block.
    """
    wanted, own = F.lower(F.coalesce("q_topic", F.lit(""))), F.lower(F.coalesce("m_topic", F.lit("")))
    fits = F.when(wanted.isin("casual_chat", "other"), F.array(*map(F.lit, ("", "casual_chat", "general")))).otherwise(F.array_distinct(F.array(F.lit(""), wanted)))
    none = F.lit(None).cast("array<string>")
    q = queries.where(~F.lower("state").eqNullSafe("closing")).withColumn("_own", F.explode(fits))
    q, m = (df.where(F.col(persona).isNotNull()).withColumn("_at", F.struct(persona, "_own")) for df in (q, memories.withColumn("_own", own)))
    found = N.search(q.withColumn("q_words", none), m.withColumn("m_words", none), "_at", most, own=True, cos=1.0, overlap=0.0)
    return select_policy(found.drop("rank").withColumnRenamed("score", "semantic"), "q_id", least, most)


def apply_changes(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Updates of rows that exist, and deletes (op = 'delete')."""
    hit = changes.join(base.select(key), key, "left_semi")
    rest = base.join(hit.select(key), key, "left_anti")
    return rest.unionByName(hit.where("op = 'update'").drop("op"))


def touch(base: DataFrame, log: DataFrame, key: str, at: str) -> DataFrame:
    """Latest access time from the log."""
    seen = log.groupBy(key).agg(F.max(at).alias("_at"))
    return base.join(seen, key, "left").withColumn(at, F.greatest(at, "_at")).drop("_at")
