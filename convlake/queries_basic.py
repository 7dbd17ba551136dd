"""Queries of projections, sessions, windows, joins and splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import params
from .functions import text as T
from .operators import relational as R
from .operators import sessions as S
from .operators import splits as D
from .operators import windows as N
from .operators.neighbours import near_rows
from .operators.ordered import cuts
from .registry import query, table

GAP = 720

# --- projections and filters ---------------------------------------------------------------------


@query(
    "p03_normalize",
    r"""SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)),
        lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)) AS text FROM conversations""",
)
def _(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(lines, "\n").alias("text"))


_SPEAKER_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in params.SPEAKERS.items())


@query(
    "p04_normalize_speaker",
    f"""WITH m(raw, speaker) AS (VALUES {_SPEAKER_ROWS})
    SELECT conv_id, turn, CASE WHEN coalesce(trim(role), '') = '' THEN 'user' ELSE coalesce(m.speaker, lower(trim(role))) END AS speaker
    FROM conversations LEFT JOIN m ON m.raw = lower(trim(role))""",
)
def _(spark, d):
    names = spark.createDataFrame(list(params.SPEAKERS.items()), "raw string, speaker string")
    raw = F.lower(T.strip(F.coalesce("role", F.lit(""))))
    df = table(spark, d, "conversations").withColumn("raw", raw).join(F.broadcast(names), "raw", "left")
    speaker = F.when(F.col("raw") == "", "user").otherwise(F.coalesce("speaker", "raw"))
    return df.select("conv_id", "turn", speaker.alias("speaker"))


_MESSAGES = "list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn)"


def _documents(spark, d):
    """Conversations as arrays of messages."""
    m = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m"))


@query(
    "p06_valid_lists",
    """SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id
    HAVING bool_and(role IN ('user', 'assistant', 'system') AND trim(coalesce(text, '')) <> '')""",
)
def _(spark, d):
    fine = lambda m: m["role"].isin("user", "assistant", "system") & (T.strip(F.coalesce(m["text"], F.lit(""))) != "")
    df = _documents(spark, d).where((F.size("m") > 0) & F.forall("m", fine))
    return df.select("conv_id", F.size("m").cast("long").alias("n"))


@query(
    "p07_system_turn",
    """SELECT conv_id, (count(*) + CASE WHEN lower(trim(arg_min(role, turn))) = 'system' THEN 0 ELSE 1 END)::BIGINT AS n,
    CASE WHEN lower(trim(arg_min(role, turn))) = 'system' THEN arg_min(text, turn) ELSE 'You are helpful.' END AS first_text
    FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    put = F.array(F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit("You are helpful.").alias("text")))
    m = F.when(F.lower(T.strip(F.col("m")[0]["role"])) == "system", F.col("m")).otherwise(F.concat(put, F.col("m")))
    df = _documents(spark, d).withColumn("m", m)
    return df.select("conv_id", F.size("m").cast("long").alias("n"), F.col("m")[0]["text"].alias("first_text"))


@query(
    "p08_prompt_text",
    """SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn)
    || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    part = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>"))
    text = F.concat(F.array_join(F.transform("m", part), "\n"), F.lit("\n<|im_start|>assistant\n"))
    return _documents(spark, d).select("conv_id", text.alias("prompt"))


@query(
    "p09_turn_templates",
    """SELECT conv_id, turn, style, CASE style WHEN 'chatml' THEN '<|im_start|>' || role || chr(10) || text || '<|im_end|>'
    WHEN 'llama' THEN '<|' || role || '|>' || chr(10) || text ELSE role || ': ' || text END AS line
    FROM conversations, (VALUES ('chatml'), ('llama'), ('plain')) s(style)""",
)
def _(spark, d):
    df = table(spark, d, "conversations").withColumn("style", F.explode(F.array(*map(F.lit, ("chatml", "llama", "plain")))))
    line = F.when(F.col("style") == "chatml", F.format_string("<|im_start|>%s\n%s<|im_end|>", "role", "text"))
    line = line.when(F.col("style") == "llama", F.format_string("<|%s|>\n%s", "role", "text")).otherwise(F.format_string("%s: %s", "role", "text"))
    return df.select("conv_id", "turn", "style", line.alias("line"))


@query(
    "p11_usable_messages",
    "SELECT event_type AS message_type, count(*) AS n FROM events WHERE event_type <> 'view' AND trim(coalesce(props, '')) <> '' GROUP BY 1",
)
def _(spark, d):
    df = table(spark, d, "events").where((F.col("event_type") != "view") & (T.strip(F.coalesce("props", F.lit(""))) != ""))
    return df.groupBy(F.col("event_type").alias("message_type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_artifact_filter",
    "SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches(text, '(?i)the sync|encrypted')",
)
def _(spark, d):
    return table(spark, d, "conversations").where(~F.col("text").rlike("(?i)the sync|encrypted")).select("conv_id", "turn")


_ORDER_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'DELETED' WHEN 'O' THEN 'ACTIVE' ELSE 'ARCHIVED' END"


def _store(spark, d):
    """customer = persona, orders = conversation, lineitem = message."""
    status = F.when(F.col("o_orderstatus") == "F", "DELETED").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("ARCHIVED")
    conv = table(spark, d, "orders").withColumn("status", status)
    return table(spark, d, "customer"), conv, table(spark, d, "lineitem")


@query("p14_soft_delete", f"SELECT o_orderkey, o_custkey, {_ORDER_STATUS} AS status FROM orders WHERE {_ORDER_STATUS} <> 'DELETED'")
def _(spark, d):
    return R.not_deleted(_store(spark, d)[1]).select("o_orderkey", "o_custkey", "status")


@query("p15_search", "SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), 'build')) AND c_nationkey = 3")
def _(spark, d):
    df = R.search(_store(spark, d)[0], ["c_name", "c_mktsegment"], "00012", "c_nationkey", "all")
    more = R.search(_store(spark, d)[0], ["c_name", "c_mktsegment"], "BUILD", "c_nationkey", "3")
    return df.where("c_nationkey = 3").unionByName(more).select("c_custkey", "c_name").distinct()


@query(
    "p16_drop_empty",
    """SELECT conv_id, count(*) FILTER (role IS NOT NULL AND text IS NOT NULL AND length(trim(text)) > 25)::BIGINT AS n FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    kept = F.filter("m", lambda m: m["role"].isNotNull() & m["text"].isNotNull() & (F.length(T.strip(m["text"])) > 25))
    return _documents(spark, d).select("conv_id", F.size(kept).cast("long").alias("n"))


# --- sessions -------------------------------------------------------------------------------------

_SESSIONS = f"""s AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
    SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)
      > {GAP} * 60000000::BIGINT)::INT, 0) AS new FROM events))"""


def _sessions(spark, d):
    events = table(spark, d, "events")
    return S.sessionize(events, "user_id", "event_id", "ts", GAP, cuts(events, "event_id"))


@query("n01_sessionize", f"WITH {_SESSIONS} SELECT event_id, user_id, session FROM s")
def _(spark, d):
    return _sessions(spark, d).select("event_id", "user_id", "session")


_BURSTS = f"""{_SESSIONS}, b AS (
  SELECT *, sum(nb) OVER (PARTITION BY user_id, session ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS turn FROM (
    SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id, session ORDER BY event_id) THEN 0 ELSE 1 END AS nb FROM s))"""


@query(
    "n02_burst_merge",
    f"""WITH {_BURSTS} SELECT user_id, session, turn::BIGINT AS turn, min(event_type) AS speaker,
    string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id) AS text, arg_min(epoch_us(ts), event_id) AS start_us,
    arg_max(epoch_us(ts), event_id) AS end_us, count(*)::BIGINT AS n FROM b GROUP BY ALL""",
)
def _(spark, d):
    df = _sessions(spark, d).withColumn("line", F.col("event_id").cast("string"))
    out = S.bursts(df, ["user_id", "session"], "event_id", "event_type", "line", "ts", cuts(table(spark, d, "events"), "event_id"))
    return out.select(
        "user_id", "session", "turn", "speaker", "text", S.micros(F.col("start_ts")).alias("start_us"),
        S.micros(F.col("end_ts")).alias("end_us"), F.size("message_ids").cast("long").alias("n"),
    )


_SUMMARY = f"""{_SESSIONS}, y AS (
  SELECT user_id, session, arg_min(epoch_us(ts), event_id) AS a, arg_max(epoch_us(ts), event_id) AS z, count(*) AS n_messages,
    bool_or(event_type = 'purchase') AS p, bool_or(event_type <> 'purchase') AS u FROM s GROUP BY ALL)"""


@query("n03_qualified_sessions", f"WITH {_SUMMARY} SELECT user_id, session, n_messages FROM y WHERE n_messages >= 4 AND p AND u")
def _(spark, d):
    y = S.session_summary(_sessions(spark, d), ["user_id", "session"], "event_id", "ts", F.col("event_type") == "purchase")
    return S.qualified(y, 4).select("user_id", "session", "n_messages")


@query(
    "n04_session_summary",
    f"WITH {_SUMMARY} SELECT user_id, session, n_messages, round(greatest(0, (z - a) / 60000000.0), 4) AS minutes, 'conv-' || lpad(session::VARCHAR, 6, '0') AS name FROM y",
)
def _(spark, d):
    y = S.session_summary(_sessions(spark, d), ["user_id", "session"], "event_id", "ts", F.col("event_type") == "purchase")
    name = F.concat(F.lit("conv-"), F.lpad(F.col("session").cast("string"), 6, "0"))
    return y.select("user_id", "session", "n_messages", F.round("minutes", 4).alias("minutes"), name.alias("name"))


@query("n05_activity_periods", f"WITH {_SESSIONS} SELECT user_id, max(session) + 1 AS periods FROM s GROUP BY 1")
def _(spark, d):
    return _sessions(spark, d).groupBy("user_id").agg((F.max("session") + 1).alias("periods"))


@query(
    "n06_dedup_adjacent",
    """SELECT user_id, count(*) AS n FROM (SELECT *, event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(1) OVER w = 1 AS same
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE NOT coalesce(same, false) GROUP BY 1""",
)
def _(spark, d):
    df = S.drop_adjacent_duplicates(table(spark, d, "events"), ["user_id"], "event_id", ["event_type"])
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("n07_min_turns", "SELECT conv_id, turn FROM conversations QUALIFY count(*) OVER (PARTITION BY conv_id) >= 5")
def _(spark, d):
    return S.min_turns(table(spark, d, "conversations"), "conv_id", 5).select("conv_id", "turn")


# --- windows ---------------------------------------------------------------------------------------

_CONTEXT = """h AS (SELECT *, list(struct_pack(turn := turn, role := role, text := text)) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) AS before FROM conversations
), x AS (SELECT conv_id, turn, text, depth, before[len(before) - 2 * depth + 2 : len(before)] AS context FROM h,
    (VALUES (1), (2), (4), (6)) k(depth) WHERE role = 'assistant' AND len(before) >= 2 * depth - 1
), c AS (SELECT *, conv_id || '_tgt' || turn || '_ctx' || depth AS example_id FROM x WHERE context[1].role = 'user')"""


def examples(spark, d):
    return N.context_windows(table(spark, d, "conversations"))


@query("n08_context_windows", f"WITH {_CONTEXT} SELECT example_id, depth, text, array_to_string(list_transform(context, lambda m: m.text), ' ') AS joined FROM c")
def _(spark, d):
    joined = F.array_join(F.transform("context", lambda m: m["text"]), " ")
    return examples(spark, d).select("example_id", "depth", "text", joined.alias("joined"))


@query(
    "n09_rolling_history",
    """SELECT conv_id, turn, array_to_string(list_transform(before, lambda m: m.role || ': ' || m.text), chr(10)) || chr(10) || 'assistant: ' || text AS example
    FROM (SELECT *, list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before
    FROM conversations) WHERE role = 'assistant' AND len(before) > 0""",
)
def _(spark, d):
    return N.rolling_history(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "example")


@query(
    "n10_last_user",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM conversations""",
)
def _(spark, d):
    return N.last_user(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "last_user")


@query(
    "n11_preceding_context",
    """SELECT conv_id, turn, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations""",
)
def _(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), " ").alias("context"))


_ALTERNATION = """SELECT conv_id, n, switches, CASE WHEN n > 1 THEN round(switches / (n - 1), 4) ELSE 1.0 END AS rate, depth, greatest(1, (depth + 1) // 2)::BIGINT AS exchanges, roles
    FROM (SELECT conv_id, count(*) AS n, coalesce(sum(s), 0)::BIGINT AS switches, count_if(role IN ('user', 'assistant'))::BIGINT AS depth, string_agg(role, ',' ORDER BY turn) AS roles
    FROM (SELECT *, (role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS s FROM conversations) GROUP BY conv_id)"""


@query("n12_alternation", f"SELECT conv_id, n, switches, rate, rate = 1.0 AS strict FROM ({_ALTERNATION})")
def _(spark, d):
    return N.alternation(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "n", "switches", "rate", "strict")


@query("n13_exchanges", f"SELECT conv_id, depth, exchanges, roles FROM ({_ALTERNATION})")
def _(spark, d):
    return N.alternation(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "depth", "exchanges", "roles")


@query("n14_cap", f"WITH {_CONTEXT} SELECT example_id FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, depth) <= 3")
def _(spark, d):
    return N.first_per_group(examples(spark, d), ["conv_id"], ["turn", "depth"], 3).select("example_id")


@query(
    "n15_variants",
    """SELECT user_id, p AS prompt, event_id FROM (SELECT user_id, event_type AS p, lower(props) AS v, min(event_id) AS event_id FROM events GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY user_id, p ORDER BY event_id) <= 10""",
)
def _(spark, d):
    df = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("prompt"), F.lower("props").alias("v")).agg(F.min("event_id").alias("event_id"))
    return N.first_per_group(df, ["user_id", "prompt"], ["event_id"], 10).select("user_id", "prompt", "event_id")


# --- joins -----------------------------------------------------------------------------------------


@query("j01_name_join", "SELECT o_orderkey, coalesce(c_name, 'Unknown Persona') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey")
def _(spark, d):
    persona, conv, _ = _store(spark, d)
    names = persona.where("c_acctbal >= 0").withColumnRenamed("c_custkey", "o_custkey")
    return R.name_join(conv, names, "o_custkey", "c_name", "Unknown Persona").select("o_orderkey", "c_name")


@query(
    "j02_counts",
    f"""SELECT c_custkey, coalesce(n, 0) AS conversations, coalesce(m, 0)::BIGINT AS messages FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE {_ORDER_STATUS} <> 'DELETED' GROUP BY 1) ON o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey AS k, count(*) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = c_custkey""",
)
def _(spark, d):
    persona, conv, message = _store(spark, d)
    conv = conv.withColumnRenamed("o_custkey", "c_custkey")
    # messages first by conversation, so that the large table is reduced before it meets the store
    n = message.groupBy(F.col("l_orderkey").alias("o_orderkey")).count().join(conv, "o_orderkey").groupBy("c_custkey").agg(F.sum("count").alias("messages"))
    df = R.counts_join(persona, R.not_deleted(conv), "c_custkey", "conversations").join(n, "c_custkey", "left")
    return df.select("c_custkey", "conversations", F.coalesce("messages", F.lit(0)).alias("messages"))


@query(
    "j03_existence",
    """SELECT (SELECT count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_conversation,
    (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without,
    (SELECT count(*) FROM (SELECT c_acctbal FROM customer GROUP BY 1 HAVING count(*) > 1)) AS repeated_values""",
)
def _(spark, d):
    persona, conv, _ = _store(spark, d)
    keys = conv.select(F.col("o_custkey").alias("c_custkey"))
    a = persona.join(keys, "c_custkey", "left_semi").agg(F.count(F.lit(1)).alias("with_conversation"))
    b = persona.join(keys, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("without"))
    c = persona.groupBy("c_acctbal").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_values"))
    return a.join(b).join(c)


@query(
    "j06_near_duplicates",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9""",
)
def _(spark, d):
    return near_rows(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.9).select("a", "b")


@query(
    "j06_near_copies",
    """WITH o AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    e AS (FROM o UNION ALL SELECT vec_id + 1000000, label, list_transform(v, lambda x, i: x * (1 + 0.1 * ((i * vec_id) % 7 - 3) / 3.0)) FROM o WHERE vec_id % 5 = 0)
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98""",
)
def _(spark, d):
    """Every fifth vector has a near copy beside it: the table itself has none at 0.98."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    bent = F.transform("v", lambda x, i: x * (1 + 0.1 * (F.pmod((i + 1) * F.col("vec_id"), F.lit(7)) - 3) / 3.0))
    e = e.unionByName(e.where("vec_id % 5 = 0").withColumn("v", bent).withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return near_rows(e, ["label"], "vec_id", "v").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "j07_slot_conflicts",
    """SELECT user_id, event_type AS slot, count(DISTINCT props) AS n_values FROM events WHERE event_type IN ('signup', 'click', 'purchase') GROUP BY ALL HAVING count(DISTINCT props) > 1""",
)
def _(spark, d):
    df = table(spark, d, "events").where(F.col("event_type").isin("signup", "click", "purchase"))
    return df.groupBy("user_id", F.col("event_type").alias("slot")).agg(F.count_distinct("props").alias("n_values")).where("n_values > 1")


@query(
    "j08_reconcile",
    """WITH a AS (SELECT conv_id, turn, length(text) AS v FROM conversations), b AS (SELECT conv_id, turn, length(replace(text, chr(10), '')) AS v FROM conversations WHERE role <> 'system')
    SELECT a.conv_id, a.turn, CASE WHEN b.conv_id IS NULL THEN 'missing' ELSE 'changed' END AS kind
    FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE b.conv_id IS NULL OR a.v <> b.v""",
)
def _(spark, d):
    c = table(spark, d, "conversations")
    other = c.where("role <> 'system'").select("conv_id", "turn", F.length(F.replace("text", F.lit("\n"), F.lit(""))).alias("v"))
    return R.reconcile(c.select("conv_id", "turn", F.length("text").alias("v")), other, ["conv_id", "turn"], "v").select("conv_id", "turn", "kind")


@query(
    "j08_by_place",
    """WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, md5(text) AS text, turn FROM conversations),
    b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, md5(CASE WHEN conv_id % 7 = 0 THEN text || '!' ELSE text END) AS text, turn FROM conversations WHERE conv_id % 5 > 0 OR turn <> 1),
    j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.place, b.place) AS place, a.place AS pa, b.place AS pb, a.text AS ta, b.text AS tb, a.turn AS na, b.turn AS nb FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.place = b.place)
    SELECT conv_id, place, 'missing' AS kind FROM j WHERE pb IS NULL UNION ALL SELECT conv_id, place, 'extra' FROM j WHERE pa IS NULL
    UNION ALL SELECT conv_id, place, 'changed_text' FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL AND ta <> tb UNION ALL SELECT conv_id, place, 'changed_turn' FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL AND na <> nb""",
)
def _(spark, d):
    """Against a copy in which every fifth conversation lacks its second turn, and every seventh has changed texts."""
    c = table(spark, d, "conversations")
    other = c.where("conv_id % 5 > 0 OR turn <> 1").withColumn("text", F.when(F.col("conv_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.by_place(c, other, ["conv_id"], "turn", ["text", "turn"], cuts(c, "turn"))


@query(
    "j13_memorised",
    """SELECT d.doc_id FROM documents d WHERE lower(trim(text)) IN (SELECT lower(trim(text)) FROM documents GROUP BY 1 HAVING count(*) > 1)""",
)
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.lower(F.trim("text")).alias("t"))
    seen = df.groupBy("t").count().where("count > 1")
    return df.join(seen, "t", "left_semi").select("doc_id")


@query(
    "j14_history",
    """SELECT o_orderkey, c_name, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS history FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def _(spark, d):
    persona, conv, message = _store(spark, d)
    h = message.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("h"))
    df = h.join(conv, "o_orderkey").join(persona, F.col("o_custkey") == F.col("c_custkey"))
    return df.select("o_orderkey", "c_name", F.array_join(F.transform("h", lambda x: x.cast("string")), ",").alias("history"))


@query("s09_json_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("s10_fingerprint")
def _(spark, d):
    return R.fingerprint(table(spark, d, "conversations"))


# --- splits ----------------------------------------------------------------------------------------

_SPLIT = """g AS (SELECT conv_id, CASE WHEN r <= n - v - t THEN 'train' WHEN r <= n - t THEN 'val' ELSE 'test' END AS split FROM (
    SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) AS r, count(*) OVER () AS n,
    greatest(1, round_even(count(*) OVER () * 0.1, 0))::BIGINT AS v, greatest(1, round_even(count(*) OVER () * 0.2, 0))::BIGINT AS t
    FROM (SELECT DISTINCT conv_id FROM conversations)))"""


def split(spark, d):
    return D.group_split(table(spark, d, "conversations"), "conv_id", (0.7, 0.1, 0.2))


@query("d01_group_split", f"WITH {_SPLIT} SELECT conv_id, turn, split FROM conversations JOIN g USING (conv_id)")
def _(spark, d):
    return split(spark, d).select("conv_id", "turn", "split")


@query(
    "d02_row_split",
    """SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * 0.8)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.8)) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)""",
)
def _(spark, d):
    return D.row_split(table(spark, d, "documents").select("doc_id"), "doc_id", (0.8, 0.1, 0.1))


@query(
    "d03_split_summary",
    f"""WITH {_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT conv_id) AS ids, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent
    FROM conversations JOIN g USING (conv_id) GROUP BY split""",
)
def _(spark, d):
    return D.split_summary(split(spark, d), "conv_id")


@query(
    "d05_stratified",
    """WITH n AS (SELECT floor(count(*) * 0.5)::BIGINT AS n FROM documents WHERE lang = 'es'), q AS (
      SELECT 'en' AS lang, n - round_even(n * 0.25, 0)::BIGINT - round_even(n * 0.2, 0)::BIGINT - round_even(n * 0.15, 0)::BIGINT AS k FROM n
      UNION ALL SELECT 'fr', round_even(n * 0.25, 0)::BIGINT FROM n UNION ALL SELECT 'de', round_even(n * 0.2, 0)::BIGINT FROM n UNION ALL SELECT 'es', round_even(n * 0.15, 0)::BIGINT FROM n)
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) JOIN q USING (lang) WHERE r <= k""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    total = docs.where("lang = 'es'").count() // 2
    return D.stratified(docs, "lang", "doc_id", {"en": 0.4, "fr": 0.25, "de": 0.2, "es": 0.15}, total)


@query("d07_slices", f"WITH {_SPLIT} SELECT split, conv_id, turn FROM conversations JOIN g USING (conv_id) QUALIFY row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) <= 20")
def _(spark, d):
    return N.first_per_group(split(spark, d), ["split"], ["conv_id", "turn"], 20).select("split", "conv_id", "turn")


@query("j10_leakage", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS splits FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def _(spark, d):
    df = table(spark, d, "events").where(F.col("event_type").isin("click", "purchase"))
    return R.leakage(df, "user_id", "event_type").select("user_id", F.array_join("splits", ",").alias("splits"))


@query("j11_subset", f"WITH {_SPLIT} SELECT count(*) FILTER (split = 'train') AS inside, count(*) FILTER (split <> 'train') AS outside FROM conversations JOIN g USING (conv_id) WHERE turn = 1")
def _(spark, d):
    s = split(spark, d)
    picked = s.where("turn = 1").select("conv_id", "turn")
    train = s.where("split = 'train'").select("conv_id", "turn")
    a = picked.join(train, ["conv_id", "turn"], "left_semi").agg(F.count(F.lit(1)).alias("inside"))
    b = picked.exceptAll(train).agg(F.count(F.lit(1)).alias("outside"))
    return a.join(b)


@query("j12_union", f"WITH {_SPLIT} SELECT split AS part, count(*) AS n FROM conversations JOIN g USING (conv_id) GROUP BY 1")
def _(spark, d):
    s = split(spark, d)
    return R.tag_union({k: s.where(F.col("split") == k).drop("split") for k in ("train", "val", "test")}, "part").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "entry_windows",
    f"""WITH {_CONTEXT} SELECT depth::BIGINT AS depth, CASE WHEN length(trim(text)) <= 5 OR NOT regexp_matches(trim(text), '\\s') THEN 'very_short'
    WHEN length(trim(text)) <= 20 THEN 'short' WHEN length(trim(text)) <= 60 THEN 'medium' ELSE 'long' END AS length_class,
    count(*) AS n, count_if(contains(text, '?'))::BIGINT AS questions FROM c GROUP BY ALL""",
)
def _(spark, d):
    kept = S.drop_adjacent_duplicates(table(spark, d, "conversations"), ["conv_id"], "turn", ["role", "text"])
    df = N.context_windows(kept).withColumn("length_class", T.length_class(F.col("text")))
    return df.groupBy(F.col("depth").cast("long").alias("depth"), "length_class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").contains("?")).alias("questions")
    )
