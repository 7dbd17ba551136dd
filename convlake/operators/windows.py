"""Context windows over the turns of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..params import DEPTHS


def with_history(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Adds `before`: up to `most` previous turns as (turn, role, text), oldest first."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-most, -1)
    return df.withColumn("before", F.collect_list(F.struct(F.col(order).alias("turn"), "role", "text")).over(w))


def context_windows(df: DataFrame, key: str = "conv_id", order: str = "turn", depths: list[int] | None = None) -> DataFrame:
    """For each persona turn and depth k: the last 2k-1 turns, where they exist and the first is the user's."""
    depths = depths or DEPTHS
    turns = with_history(df, key, order, 2 * max(depths) - 1).where("role = 'assistant'")
    depth = F.explode(F.array(*[F.lit(k) for k in depths])).alias("depth")
    turns = turns.select(key, order, "text", "before", depth)
    need = 2 * F.col("depth") - 1
    turns = turns.where(F.size("before") >= need)
    turns = turns.withColumn("context", F.slice("before", F.size("before") - need + 1, need)).drop("before")
    turns = turns.where(F.col("context")[0]["role"] == "user")
    name = F.concat(F.col(key).cast("string"), F.lit("_tgt"), F.col(order).cast("string"), F.lit("_ctx"), F.col("depth").cast("string"))
    return turns.withColumn("example_id", name)


def rolling_history(df: DataFrame, key: str, order: str, most: int = 10) -> DataFrame:
    """One text for each persona turn with a history: its last `most` turns and itself."""
    turns = with_history(df, key, order, most).where((F.col("role") == "assistant") & (F.size("before") > 0))
    lines = F.transform("before", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return turns.withColumn("example", F.concat_ws("\n", F.array_join(lines, "\n"), F.concat(F.lit("assistant: "), F.col("text"))))


def last_user(df: DataFrame, key: str, order: str):
    """Adds last_user: the latest user text before the turn."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("last_user", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))


def alternation(df: DataFrame, key: str, order: str) -> DataFrame:
    """Turns, switches, the share of switches (1 for a single turn), whether all switch, exchanges and the roles."""
    w = W.partitionBy(key).orderBy(order)
    df = df.withColumn("_s", (F.col("role") != F.lag("role").over(w)).cast("int"))
    roles = F.transform(F.sort_array(F.collect_list(F.struct(order, "role"))), lambda x: x["role"])
    out = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_s"), F.lit(0)).alias("switches"), F.count_if(F.col("role").isin("user", "assistant")).alias("depth"), roles.alias("_r")
    )
    rate = F.when(F.col("n") > 1, F.bround(F.col("switches") / F.greatest(F.col("n") - 1, F.lit(1)), 4)).otherwise(1.0)
    return out.withColumns(
        {"rate": rate, "strict": rate == 1.0, "exchanges": F.greatest(F.lit(1), F.floor((F.col("depth") + 1) / 2)).cast("long"), "roles": F.array_join("_r", ",")}
    ).drop("_r")


def first_per_group(df: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_rank")
