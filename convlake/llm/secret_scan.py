"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Base spans come from three patterns over every whole text. Candidates are the values of base spans and other long tokens of mixed
letters and digits; those that look like live credentials (long enough, letters and digits, many distinct characters, no words of
examples) are hashed, and the hashes counted over the corpus by distinct owners and distinct repositories of these. A value that
few owners have is taken for a live credential of its owner and adds a `live` span; one that many have is a copied example and adds
none. Base spans stay in either case. Values are never written: tables between steps hold their MD5 only.

Positions are code points, from the lengths of what stands between matches, summed in blocks. Counts are taken over distinct (hash,
owner, repository), so a value that a third of all rows hold is spread over tasks; each distinct text meets the verdicts once. Up to
`few` keys (16 or 32 bytes each) are broadcast after a count, beyond that joins shuffle.

Nulls: a null text is empty and has no spans; a null owner or repository is one of its own. Very long texts and matches are handled
in time linear to the text. Ties: equal live spans count once. Repeated rows each get their row and are one repository. An empty
table gives an empty result. Extra columns are not read; results have the names below beside `id_col`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash
from .quality_rules import let

either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
KEYWORDS = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind, pattern, the value's group, its least characters. A run of at least n characters is what a longest run with n or more is.
BASE = [
    ("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
TOKEN = ("token", r"[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20)
NAMES = [k[0] for k in BASE] + ["live"]
EXAMPLES = "example|sample|dummy|changeme|placeholder|your|test|xxxx|abcdef|123456|0000"


def running(steps: Column, block: int = 64) -> Column:
    """Sums of `steps` up to and with each place; in blocks, so that long arrays do not cost their square."""

    def over(blocks: Column) -> Column:
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
        sums = F.transform(blocks, total)

        def of(parts: Column) -> Column:
            before = F.transform(parts, lambda _, i: total(F.slice(parts, F.lit(1), i)))
            return F.flatten(F.zip_with(blocks, before, lambda xs, b: F.transform(xs, lambda _, i: b + total(F.slice(xs, F.lit(1), i + 1)))))

        return let(sums, of)

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, F.lit(block)))
    return let(cut, over)


def matches(text: Column, no: int, pattern: str, group: int, least: int) -> Column:
    """start, no, end, at (of the value) and value of every match whose value has `least` characters; leftmost, not overlapping."""
    kind = "array<struct<start:int,no:int,end:int,at:int,value:string>>"
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def of(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.transform(found, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i)))

        def spans(ends: Column) -> Column:
            made = F.transform(
                F.arrays_zip(found.alias("m"), (all_of(group) if group else found).alias("v"), ends.alias("e")),
                lambda x: F.struct((x["e"] - F.char_length(x["m"])).alias("start"), F.lit(no).alias("no"), x["e"].alias("end"), (x["e"] - F.char_length(x["v"])).alias("at"), x["v"].alias("value")),
            )
            return F.filter(made, lambda x: F.char_length(x["value"]) >= least)

        return F.when(F.size(found) > 0, let(let(steps, lambda s: running(s)), spans).cast(kind)).otherwise(F.array().cast(kind))

    return let(all_of(0), of)


def looks_live(x: Column) -> Column:
    """Whether a candidate's value reads like a credential: tokens of no base kind need letters of both cases, too."""
    v = x["value"]
    mixed = v.rlike("[0-9][^0-9]*[0-9]") & v.rlike("[A-Za-z][^A-Za-z]*[A-Za-z]") & (x["no"].isin(0, 1, 2) | (v.rlike("[a-z]") & v.rlike("[A-Z]")))
    varied = F.size(F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))) >= 8
    return (F.char_length(v) >= 16) & mixed & ~F.lower(v).rlike(EXAMPLES) & varied


def candidates(text: Column) -> Column:
    """A struct: `base` (start, no, end of base spans, sorted) and `seen` (at, end, hash of what looks live)."""
    base = F.array_sort(F.concat(*[matches(text, i, *k[1:]) for i, k in enumerate(BASE)]))

    def of(spans: Column) -> Column:
        every = F.concat(spans, matches(text, len(BASE), *TOKEN[1:]))
        seen = F.transform(F.filter(every, looks_live), lambda x: F.struct(x["at"].alias("at"), x["end"].alias("end"), F.md5(x["value"]).alias("hash")))
        return F.struct(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["end"].alias("end"))).alias("base"), F.array_distinct(seen).alias("seen"))

    return let(base, of)


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["no"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def ownership(seen: DataFrame) -> DataFrame:
    """hash, owners, repos: distinct owners of each value, and distinct repositories of these."""
    once = seen.select("hash", "owner", "repo").distinct()
    return once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id",
    max_owners: int = 2, max_repos: int = 20, few: int = 500_000,
) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared (what looks live but is widely copied).

    max_owners, max_repos: a value is its owner's if so many have it at most. few: keys that are broadcast at most.
    """
    near = lambda df: F.broadcast(df) if df.count() <= few else df
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(owner).alias("owner"), F.col(repo).alias("repo"), F.xxhash64(body).alias("k"), F.hash(body).alias("g"), candidates(body).alias("_c"))
    rows = stash(rows.select("_id", "owner", "repo", "k", "g", "_c.base", "_c.seen"), "secrets-rows")
    some = rows.where(F.size("seen") > 0)
    live = ownership(some.select("owner", "repo", F.explode("seen.hash").alias("hash"))).where((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    live = stash(live.select("hash"), "secrets-live")
    each = some.select("k", "g", F.inline("seen")).distinct().join(near(live), "hash")
    own = F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), F.lit(len(BASE)).alias("no"), "end")))
    own = stash(each.groupBy("k", "g").agg(own.alias("live")), "secrets-spans")
    none = F.array().cast(own.schema["live"].dataType)
    out = rows.where(F.size("seen") == 0).withColumn("live", none).unionByName(some.join(near(own), ["k", "g"], "left").withColumn("live", F.coalesce("live", none)))
    n = lambda no: F.size(F.filter("base", lambda x: x["no"] == no)).cast("long")
    n_seen = F.size(F.array_distinct(F.transform("seen", lambda x: F.struct(x["at"], x["end"]))))
    return out.select(
        F.col("_id").alias(id_col),
        *[n(i).alias(f"n_{k[0]}") for i, k in enumerate(BASE)],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "live"))).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        (n_seen - F.size("live")).cast("long").alias("n_shared"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def _found(no: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT key, {no} AS no, e - length(m) AS start, e, e - length(v) AS pos, v FROM (
    SELECT key, m[i] AS m, v[i] AS v,
      (list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + list_sum(list_transform(m[1 : i], lambda x: length(x))))::BIGINT AS e
    FROM (
      SELECT key, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v, regexp_split_to_array(text, '{p}') AS gaps
      FROM d WHERE regexp_matches(text, '{p}')
    ), unnest(range(1, len(m) + 1)) AS places(i)
  ) WHERE length(v) >= {least}"""


SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS key, doc_id, source, coalesce(text, '') AS text FROM documents),
f AS MATERIALIZED ({" UNION ALL ".join(_found(i, *k[1:]) for i, k in enumerate([*BASE, TOKEN]))}
), seen AS MATERIALIZED (
  SELECT DISTINCT key, pos, e, md5(v) AS hash FROM f
  WHERE length(v) >= 16 AND regexp_matches(v, '[0-9][^0-9]*[0-9]') AND regexp_matches(v, '[A-Za-z][^A-Za-z]*[A-Za-z]')
    AND (no < 3 OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')))
    AND NOT regexp_matches(lower(v), '{EXAMPLES}') AND len(list_distinct(string_split(v, ''))) >= 8
), once AS (
  SELECT DISTINCT hash, source, doc_id FROM seen JOIN d USING (key)
), own AS (
  SELECT hash FROM (SELECT hash, count(*) AS repos FROM once GROUP BY hash, source) GROUP BY hash HAVING count(*) <= 2 AND sum(repos) <= 20
), live AS MATERIALIZED (
  SELECT DISTINCT key, 3 AS no, pos AS start, e FROM seen JOIN own USING (hash)
), base AS (
  SELECT key, count_if(no = 0) AS n_assign, count_if(no = 1) AS n_access, count_if(no = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex'][no + 1] || ':' || start || ':' || e, ',' ORDER BY start, no) AS spans
  FROM f WHERE no < 3 GROUP BY key
), every AS (
  SELECT key, string_agg(['assign', 'access', 'hex', 'live'][no + 1] || ':' || start || ':' || e, ',' ORDER BY start, no, e) AS spans
  FROM (SELECT key, no, start, e FROM f WHERE no < 3 UNION ALL SELECT key, no, start, e FROM live) GROUP BY key
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans, coalesce(l.n, 0)::BIGINT AS n_live,
  (coalesce(s.n, 0) - coalesce(l.n, 0))::BIGINT AS n_shared
FROM d LEFT JOIN base ON base.key = d.key LEFT JOIN every ON every.key = d.key
  LEFT JOIN (SELECT key, count(*) AS n FROM live GROUP BY key) l ON l.key = d.key
  LEFT JOIN (SELECT key, count(DISTINCT (pos, e)) AS n FROM seen GROUP BY key) s ON s.key = d.key
"""
