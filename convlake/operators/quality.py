"""Validation: every check gives issue rows (severity, key, place, rule, message)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

LEVELS = ("ERROR", "WARNING")


def issues(df: DataFrame, key: Column, place: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row for each (severity, rule, condition) that holds."""
    hit = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, c in rules]))
    df = df.select(key.cast("string").alias("key"), place.cast("long").alias("place"), F.inline(hit))
    return df.withColumn("message", F.concat_ws(" ", "rule", F.lit("at"), "key"))


def duplicate_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """Missing keys, and second and later occurrences."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    df = df.withColumn("_n", n)
    missing = F.col(key).isNull() | (T.strip(F.col(key).cast("string")) == "")
    return issues(df, F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(order), [("ERROR", "missing_id", missing), ("ERROR", "duplicate_id", ~missing & (F.col("_n") > 1))])


def array_bounds(df: DataFrame, key: str, messages: str, least: int = 2, most: int = 500) -> DataFrame:
    n = F.size(messages)
    return issues(df, F.col(key), n, [("ERROR", "not_a_list", F.col(messages).isNull()), ("ERROR", "too_few", n < least), ("WARNING", "too_many", n > most)])


def element_checks(df: DataFrame, key: str, place: str, speaker: str, text: str, allowed: list[str] | None, longest: int = 5000) -> DataFrame:
    t, s = F.col(text), F.col(speaker)
    rules = [
        ("ERROR", "missing_speaker", s.isNull() | (T.strip(s) == "")),
        ("ERROR", "null_text", t.isNull()),
        ("ERROR", "blank_text", T.strip(t) == ""),
        ("WARNING", "long_text", F.length(t) > longest),
    ]
    if allowed is not None:
        rules.append(("ERROR", "unknown_speaker", ~s.isin(*allowed)))
    return issues(df, F.col(key), F.col(place), rules)


def participants(df: DataFrame, key: str, persona: Column) -> DataFrame:
    g = df.groupBy(key).agg(F.bool_or(persona).alias("p"), F.bool_or(~persona).alias("u"), F.count(F.lit(1)).alias("n"))
    return issues(g, F.col(key), F.col("n"), [("WARNING", "no_persona", ~F.col("p") & (F.col("n") > 1)), ("WARNING", "no_partner", ~F.col("u") & (F.col("n") > 1))])


def summary(found: DataFrame) -> DataFrame:
    """valid (no error) and totals."""
    e = F.count_if(F.col("severity") == "ERROR")
    return found.agg(e.alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"), (e == 0).alias("valid"))


def surplus(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, and rows beyond the first of each."""
    g = df.groupBy(*columns).count()
    return g.agg(F.count(F.lit(1)).alias("distinct_rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"))


def consistency(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that fail each named check."""
    return df.agg(*[F.count_if(~c).alias(n) for n, c in checks.items()])


def label_audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, n, wrong, share: for each named comparison of a stored with a recomputed label, rows where it can be made and where it fails; one pass."""
    both = [x for name, c in checks.items() for x in (F.count_if(c.isNotNull()).alias(f"{name}_n"), F.count_if(~c).alias(f"{name}_w"))]
    one = df.agg(*both)
    rows = [F.struct(F.lit(k).alias("check"), F.col(f"{k}_n").alias("n"), F.col(f"{k}_w").alias("wrong"), F.round(F.col(f"{k}_w") / F.greatest(F.col(f"{k}_n"), F.lit(1)), 4).alias("share")) for k in checks]
    return one.select(F.inline(F.array(*rows)))


def release(audit: DataFrame, limits: dict[str, float], default: float = 0.0) -> DataFrame:
    """go, failed: whether every check's share of wrong rows is within its limit, and the names of those that are not."""
    limit = F.coalesce(*[F.when(F.col("check") == k, F.lit(v)) for k, v in limits.items()], F.lit(default))
    over = F.sort_array(F.collect_list(F.when(F.col("share") > limit, F.col("check"))))
    return audit.agg(over.alias("failed")).select((F.size("failed") == 0).alias("go"), F.array_join("failed", ",").alias("failed"))


def suspicious(parts: dict[str, DataFrame], most: int = 100) -> DataFrame:
    """Categories in their order, then by key, cut at `most` rows."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        df = df.select(F.col("key").cast("string").alias("key"), F.lit(i).alias("priority"), F.lit(name).alias("category"))
        out = df if out is None else out.unionByName(df)
    return out.orderBy("priority", "key").limit(most)


def suspicious_rows(df: DataFrame, rules: dict[str, Column], most: int = 100) -> DataFrame:
    """`suspicious` in one pass: a row of `df` (key and what the rules see) for each rule that holds."""
    hits = [F.when(rule, F.struct(F.lit(i).alias("priority"), F.lit(name).alias("category"))) for i, (name, rule) in enumerate(rules.items())]
    out = df.select(F.col("key").cast("string").alias("key"), F.inline(F.array_compact(F.array(*hits))))
    return out.orderBy("priority", "key").limit(most)


def schema_rules(df: DataFrame, column: str, required: list[str], allowed: list[str]) -> DataFrame:
    """Missing and unknown keys of JSON objects in `column`."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    parsed = F.json_object_keys(column).isNotNull()
    rules = [("ERROR", "not_an_object", ~parsed)]
    rules += [("ERROR", f"missing_{k}", parsed & ~F.array_contains(keys, k)) for k in required]
    rules.append(("ERROR", "unknown_key", F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0))
    return issues(df, F.col("key"), F.lit(0), rules)


@dataclass(frozen=True)
class Field:
    """A rule for the value at a path ("" is the whole, "a.b" a nested key) of a JSON document, or of an element of an array.

    kind: object, array, string, integer, number or boolean. least, most: of a number, of a string's length, of an array's size.
    values: what a string may be. keys: the only keys an object may have. each: rules of an array's elements.
    """

    path: str
    kind: str
    required: bool = False
    least: float | None = None
    most: float | None = None
    values: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    each: tuple["Field", ...] = ()


_KINDS = {"object": "OBJECT<", "array": "ARRAY<", "string": "STRING", "boolean": "BOOLEAN"}


def _value_rules(value: Column, f: Field) -> list[tuple[Column, Column]]:
    """(condition, rule) of what can be wrong with the value at one path."""
    at = f"$.{f.path}" if f.path else "$"
    v = F.try_variant_get(value, at, "variant")
    there = v.isNotNull()
    said = F.schema_of_variant(v)
    fits = said.startswith(_KINDS[f.kind]) if f.kind in _KINDS else said.startswith("BIGINT") | (said.rlike("^(DECIMAL|DOUBLE|FLOAT)") if f.kind == "number" else F.lit(False))
    name = f.path or "document"
    size = {"array": lambda: F.size(v.try_cast("array<variant>")), "string": lambda: F.length(v.try_cast("string"))}.get(f.kind, lambda: v.try_cast("double"))()
    ok = there & fits
    out = [(~there, f"missing {name}")] if f.required else []
    out.append((there & ~fits, f"{name} is not of kind {f.kind}"))
    if f.least is not None:
        out.append((ok & (size < f.least), f"{name} under {f.least:g}"))
    if f.most is not None:
        out.append((ok & (size > f.most), f"{name} over {f.most:g}"))
    if f.values:
        out.append((ok & ~v.try_cast("string").isin(*f.values), f"{name} outside its values"))
    if f.keys:
        out.append((ok & (F.size(F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, f.keys)))) > 0), f"{name} has unknown keys"))
    return [(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in out]


def schema_issues(df: DataFrame, key: str, column: str, fields: list[Field]) -> DataFrame:
    """severity, key, place, rule, message: an issue row for each rule that a JSON document in `column` breaks.

    place: the element's number in its array, else null. A text that is no JSON is one issue; a JSON null is a value of another kind.
    """
    docs = df.select(F.col(key).cast("string").alias("key"), F.try_parse_json(F.col(column)).alias("v"))
    nothing = F.lit(None).cast("long")
    hits = lambda rules: F.inline(F.array_compact(F.array(*[F.when(c, F.struct(r.alias("rule"))) for c, r in rules])))
    whole = [(F.col("v").isNull(), F.lit("no JSON")), *[x for f in fields for x in _value_rules(F.col("v"), f)]]
    whole = [whole[0], *[(F.col("v").isNotNull() & c, r) for c, r in whole[1:]]]
    found = docs.select("key", nothing.alias("place"), hits(whole))
    for f in fields:
        if f.each:
            items = F.try_variant_get("v", f"$.{f.path}", "array<variant>")
            one = docs.select("key", F.posexplode(items).alias("place", "e")).select("key", F.col("place").cast("long").alias("place"), "e")
            found = found.unionByName(one.select("key", "place", hits([(c, F.concat(F.lit(f"{f.path}: "), r)) for e in f.each for c, r in _value_rules(F.col("e"), e)])))
    message = F.concat_ws(" ", "rule", F.lit("at"), "key", F.concat(F.lit("element "), F.col("place").cast("string")))
    return found.select(F.lit("ERROR").alias("severity"), "key", "place", "rule", message.alias("message"))


#: The three document schemas, by the keys and kinds they have.
MESSAGE_RULES = (Field("", "object", keys=("speaker", "text", "timestamp", "metadata")), Field("speaker", "string", True, least=1), Field("text", "string", True))
CONVERSATION_RULES = [
    Field("", "object", keys=("conversation_id", "persona_id", "source", "metadata", "messages")), Field("conversation_id", "string", True, least=1),
    Field("persona_id", "string"), Field("source", "string"), Field("metadata", "object"), Field("messages", "array", True, least=2, each=MESSAGE_RULES),
]
TRAINING_RULES = [
    Field("", "object", keys=("conversation_id", "text", "persona_id", "split", "metadata")), Field("conversation_id", "string", True), Field("text", "string", True, least=1),
    Field("split", "string", values=("train", "val", "test")), Field("metadata", "object"), Field("metadata.num_turns", "integer", least=1),
]
