"""URL filter by host and path rules, and by a path-template tree where no rule fits.

1. Every host has a tree of path segments. Segments that look variable (digits, hex, long mixed slugs) are wildcards, as are rare
   ones (under `min_support` URLs) of a node with more than `max_children`; that is repeated until no node has such children.
2. Branches of a node that have labels are merged where they are statistically similar: a branch leaves its group if its bad share
   differs from that of the rest of the group by a two-sample test, the worse and the better ones each form a group of their
   own, and those are tested again until no group parts. Merged branches share their counts.
3. Purity (share of bad URLs) is smoothed from the table over templates that hosts share down to the host: from the table's share,
   along the template's nodes with the counts of all hosts, then along them with the host's merged counts; each step weighs what it
   comes from like `weight` URLs. The host as a whole counts only where at least the share `evidence` of its URLs is labelled.
   A template at or over `reject` is blocked. What hosts share is told by registered domains (the last two labels of a host): each
   weighs at most `witness` URLs in a node and in the table's share, a node of fewer than `domains` labelled ones tells other
   hosts nothing, and the table's share counts as `prior_most` at most, so that by itself it need not reject.

Work is on distinct (host, template) counts and nodes, not on URLs, by sums and joins alone; counts combine before each shuffle,
so a host with a third of all URLs costs no more than its distinct templates. Paths of any depth count whole.

Nulls: a null URL or one without "://" has an empty host and path, no rule and the verdict of the empty
template. Repeated rows each get their row. An empty table gives an empty result. Input columns named host, path, rule or
verdict come back with `_in` added to their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stash

#: (rule, verdict) of the registered query.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def host_of(url: Column) -> Column:
    got = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; both null where none fits."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule = verdict = None
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def typed_segments(path: Column) -> Column:
    """The path's segments; variable-looking ones are wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    variable = lambda s: s.rlike(r"[0-9]|%|^[0-9A-Fa-f-]{16,}$") | (F.length(s) > 40)
    return F.transform(segments, lambda s: F.when(variable(s), F.lit("*")).otherwise(s))


def key_of(segments: Column, depth: Column) -> Column:
    """Key of a node: its depth in the tree and the segments above and at it."""
    return F.xxhash64(F.slice(segments, F.lit(1), depth))


def generalise(counts: DataFrame, max_children: int, min_support: int) -> DataFrame:
    """(host, segs, n, labelled, bad) with gen: segs whose rare segments at nodes with very many children are wildcards."""
    rows = counts.withColumn("gen", F.col("segs"))
    node = ["host", "d", "up"]
    while True:
        parts = rows.select("host", "segs", "gen", "n", F.posexplode("gen").alias("d", "seg"))
        parts = parts.withColumn("up", key_of(F.col("gen"), F.col("d")))
        support = stash(parts.groupBy(*node, "seg").agg(F.sum("n").alias("n")), "url-segments")
        many = support.groupBy(*node).agg(F.count(F.lit(1)).alias("children")).where(F.col("children") > max_children)
        rare = support.where((F.col("n") < min_support) & (F.col("seg") != "*")).join(many, node).select(*node, "seg")
        hit = stash(parts.join(rare, [*node, "seg"]).groupBy("host", "segs").agg(F.collect_set("d").alias("at")), "url-wildcards")
        if hit.isEmpty():
            return rows
        wild = F.transform("gen", lambda s, i: F.when(F.array_contains("at", i), F.lit("*")).otherwise(s))
        rows = rows.join(hit, ["host", "segs"], "left").withColumn("gen", F.when(F.col("at").isNull(), F.col("gen")).otherwise(wild))
        rows = stash(rows.drop("at"), "url-templates")


def merge_branches(nodes: DataFrame, z: float) -> DataFrame:
    """host, d, key, m_labelled, m_bad of every labelled node: the counts of the siblings it is merged with."""
    at = nodes.where("labelled > 0").select("host", "d", "key", "up", "labelled", "bad", F.lit("").alias("kin"))
    kin = ["host", "d", "up", "kin"]
    while True:
        sums = at.groupBy(*kin).agg(F.sum("labelled").alias("m_labelled"), F.sum("bad").alias("m_bad"))
        both = at.join(sums, kin)
        rest, share = F.col("m_labelled") - F.col("labelled"), F.col("m_bad") / F.col("m_labelled")
        gap = F.col("bad") / F.col("labelled") - (F.col("m_bad") - F.col("bad")) / F.when(rest > 0, rest)
        noise = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / F.when(rest > 0, rest)))
        side = F.when(gap > z * noise, "+").when(gap < -z * noise, "-").otherwise("=")
        both = stash(both.withColumn("side", side), "url-branches")
        if both.where("side <> '='").isEmpty():
            return both.select("host", "d", "key", "m_labelled", "m_bad")
        at = both.withColumn("kin", F.concat("kin", "side")).drop("side", "m_labelled", "m_bad")


def template_verdicts(
    counts: DataFrame, max_children: int = 32, min_support: int = 20, z: float = 2.58, weight: float = 10.0, reject: float = 0.7,
    evidence: float = 0.5, witness: int | None = None, domains: int = 1, prior_most: float = 1.0,
) -> DataFrame:
    """(host, segs) rows with n, labelled, bad -> host, segs, template, purity, blocked."""
    rows = stash(generalise(counts, max_children, min_support), "url-rows")
    templates = rows.groupBy("host", "gen").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    steps = templates.withColumn("d", F.explode(F.sequence(F.lit(0), F.size("gen"))))
    steps = steps.withColumns({"key": key_of(F.col("gen"), F.col("d")), "up": key_of(F.col("gen"), F.greatest(F.col("d") - 1, F.lit(0)))})
    nodes = steps.groupBy("host", "d", "key", "up").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    nodes = stash(nodes, "url-nodes")
    told_by = nodes.where("labelled > 0").groupBy("d", "key", F.substring_index("host", ".", -2).alias("domain"))
    told_by = told_by.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    if witness is not None:
        capped = F.least(F.col("labelled"), F.lit(witness))
        told_by = told_by.withColumn("bad", F.col("bad") * capped / F.col("labelled")).withColumn("labelled", capped)
    shared = told_by.groupBy("d", "key").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("told_by"))
    shared = stash(shared, "url-shared")
    total = shared.where("d = 0").first()  # of the root, the same node for all hosts
    prior = min(prior_most, (total.all_bad + 1.0) / (total.all_labelled + 2.0) if total else 0.5)
    shared = shared.where(F.col("told_by") >= domains).drop("told_by")
    told = (F.col("d") > 0) | (F.col("labelled") >= evidence * F.col("n"))
    own = nodes.join(merge_branches(nodes, z), ["host", "d", "key"], "left").join(shared, ["d", "key"], "left")
    own = own.select(
        "host", "d", "key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("all_labelled", "all_bad")],
        *[F.when(told, F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("m_labelled", "m_bad")],
    )
    chain = F.sort_array(F.collect_list(F.struct("d", "all_labelled", "all_bad", "m_labelled", "m_bad")))
    found = steps.select("host", "gen", "d", "key").join(own, ["host", "d", "key"]).groupBy("host", "gen").agg(chain.alias("chain"))

    def smooth(start: Column, labelled: str, bad: str, most: float = 1.0) -> Column:
        step = lambda p, c: (c[bad] + weight * p) / (c[labelled] + weight)
        # the root of all hosts is the table's share once more
        return F.aggregate("chain", start, lambda p, c: F.when(c["d"] == 0, F.least(step(p, c), F.lit(most))).otherwise(step(p, c)))

    purity = smooth(smooth(F.lit(prior), "all_labelled", "all_bad", prior_most), "m_labelled", "m_bad")
    found = found.select("host", "gen", purity.alias("purity"))
    out = rows.join(found, ["host", "gen"])
    template = F.concat(F.lit("/"), F.array_join("gen", "/")).alias("template")
    return out.select("host", "segs", template, "purity", (F.round("purity", 12) >= reject).alias("blocked"))


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    rules: list[tuple[str, str]] | None = None,
    label: Column | None = None,
    **options,
) -> DataFrame:
    """`pages` with host, path, rule, verdict (allow or block).

    label: 1 for a URL known to be bad, 0 for a good one, null for others; by default what the rules say.
    options: those of template_verdicts.
    """
    rules = RULES if rules is None else rules
    rule, said = rule_column(F.col("host"), F.col("path"), rules)
    known = F.lit(None).cast("int") if label is None else label.cast("int")
    df = pages.select(F.struct(*pages.columns).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), known.alias("known"))
    df = df.withColumns({"rule": rule, "said": said, "segs": typed_segments(F.col("path"))})
    if label is None:
        df = df.withColumn("known", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    counts = df.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("known").alias("labelled"), F.coalesce(F.sum("known"), F.lit(0)).alias("bad")
    )
    # only the rejected templates are joined back: the rest is the default
    out = template_verdicts(stash(counts, "url-counts"), **options).where("blocked").select("host", "segs", "blocked")
    df = df.join(stash(out, "url-rejected"), ["host", "segs"], "left")
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": F.coalesce("said", method)}
    kept = [F.col("row")[c].alias(c + "_in" if c in made else c) for c in pages.columns]
    return df.select(*kept, *[v.alias(c) for c, v in made.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, witness=20, domains=2, prior_most=0.5).select("page_id", "host", "path", "rule", "verdict")
