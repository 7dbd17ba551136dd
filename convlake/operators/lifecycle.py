"""Life cycle of memories: candidates in order are created, merged into an equal one, or take the place of what they contradict.

Equal is what has the same normal form (which covers equal content) among a persona's active memories. A slot is a question with one
answer: a candidate that answers it otherwise supersedes every active memory of the slot. Slot and value are read from the normal
form, so equal memories have the same. As all active memories of a slot share a value, those between two changes of the value make
a run; within a run, or without a slot, equal candidates make one memory. A, B, A gives three memories.

The batch form finds runs with `ordered.numbered`, which spreads a hot slot over tasks; the rest are groupings and one join of
neighbouring runs. The streaming form keeps the memories of each persona in parts, and its slots, and gives the same actions.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from .memory import FILLERS
from .ordered import numbered

#: Forms of a verb that mean the same; an input.
VERBS = {"likes": "like", "liked": "like", "prefers": "prefer", "preferred": "prefer", "lives": "live", "lived": "live"}
#: (slot, pattern of the normal form, whose last group is the value); an input.
SLOTS = [
    ("name", "^(?:my name|je m appelle|ich heiße|me llamo) (.+)$"),
    ("home", "^(?:i live in|j habite|ich wohne in|vivo en) (.+)$"),
    ("taste", "^(?:i prefer|je préfère|ich bevorzuge|prefiero) (.+)$"),
]
RANKS = ["low", "medium", "high"]


def normal_form(content: Column, fillers: list[str] = FILLERS, verbs: dict[str, str] = VERBS) -> Column:
    """Lower case, without punctuation and filler words, verb forms brought together."""
    words = F.filter(T.tokens(F.coalesce(content, F.lit(""))), lambda w: ~w.isin(fillers))
    if verbs:
        same = F.create_map(*[F.lit(x) for pair in verbs.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(same, w), w))
    return F.array_join(words, " ")


def slot_of(norm: Column, slots: list[tuple[str, str]] = SLOTS) -> Column:
    """slot and value of the first pattern that fits; null where none does."""
    value = lambda p: F.regexp_extract(norm, p, 1)
    hits = [F.when(norm.rlike(p), F.struct(F.lit(s).alias("slot"), value(p).alias("value"))) for s, p in slots]
    return F.coalesce(*hits) if hits else F.lit(None).cast("struct<slot:string,value:string>")


def candidates(df: DataFrame, persona: str, order: str, content: str, importance: str | None = None, slots: list[tuple[str, str]] = SLOTS, **forms) -> DataFrame:
    """persona, at, content, rank, norm, slot and value. An importance that is null or unknown counts as medium."""
    rank = F.lit(1)
    if importance:
        rank = F.coalesce(*[F.when(F.col(importance) == x, i) for i, x in enumerate(RANKS)], F.lit(1))
    df = df.select(F.col(persona).alias("persona"), F.col(order).alias("at"), F.col(content).alias("content"), rank.alias("rank"))
    df = df.withColumn("norm", normal_form(F.col("content"), **forms)).withColumn("_s", slot_of(F.col("norm"), slots))
    return df.withColumns({"slot": F.col("_s.slot"), "value": F.col("_s.value")}).drop("_s")


def _runs(found: DataFrame, at: list[float] | None) -> DataFrame:
    """Candidates with `run`, the number of the slot's value; 0 without a slot."""
    held = found.where("slot IS NOT NULL")
    held = numbered(held, ["persona", "slot"], "at", ["value"], lambda now, before: now("value") != before("value"), "run", at=at)
    return held.unionByName(found.where("slot IS NULL").withColumn("run", F.lit(0).cast("long")))


def memories(found: DataFrame, at: list[float] | None = None) -> DataFrame:
    """Memories that `candidates` leave: m_id (the first candidate's place), persona, content, slot, value, importance, created, updated,
    merged (candidates in all), status and superseded_by. at: cuts of the order for hot slots (`ordered.cuts`).
    """
    made = _runs(found, at).groupBy("persona", "slot", "run", "norm").agg(
        F.min("at").alias("m_id"), F.min_by("content", "at").alias("content"), F.first("value").alias("value"), F.max("rank").alias("rank"),
        F.max("at").alias("last"), F.count(F.lit(1)).alias("merged"),
    )
    heads = made.where("slot IS NOT NULL").groupBy(F.col("persona").alias("_p"), F.col("slot").alias("_s"), (F.col("run") - 1).alias("_r")).agg(F.min("m_id").alias("superseded_by"))
    after = F.col("persona").eqNullSafe(F.col("_p")) & (F.col("slot") == F.col("_s")) & (F.col("run") == F.col("_r"))
    out = made.join(heads, after, "left")
    label = F.get(F.array(*map(F.lit, RANKS)), F.col("rank"))
    return out.select(
        "persona", "m_id", "content", "slot", "value", label.alias("importance"), F.col("m_id").alias("created"), F.coalesce("superseded_by", "last").alias("updated"),
        "merged", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded").alias("status"), "superseded_by",
    )


def actions(found: DataFrame, at: list[float] | None = None) -> DataFrame:
    """What each candidate did: persona, at, action (created, merged or superseded) and the m_id of its memory."""
    runs = _runs(found, at)
    firsts = runs.groupBy(*[F.col(c).alias(f"_{c}") for c in ("persona", "slot", "run", "norm")]).agg(F.min("at").alias("m_id"))
    heads = runs.where("slot IS NOT NULL AND run > 0").groupBy("persona", "slot", "run").agg(F.min("at").alias("at")).select("persona", "at", F.lit(True).alias("_head"))
    same = F.col("norm") == F.col("_norm")
    for c in ("persona", "slot", "run"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = runs.join(firsts, same).join(heads.withColumnsRenamed({"persona": "_hp", "at": "_ha"}), (F.col("at") == F.col("_ha")) & F.col("persona").eqNullSafe(F.col("_hp")), "left")
    action = F.when(F.col("_head"), "superseded").when(F.col("at") == F.col("m_id"), "created").otherwise("merged")
    return out.select("persona", "at", action.alias("action"), "m_id")


class Keeper(StatefulProcessor):
    """Memories and slots of a persona. A memory counts as active while its slot still has the turn in which it was made.

    Each access to the state is a message to the JVM, so memories lie in parts by a checksum of the normal form, a power of two of them
    and of about `LOAD` memories each: a micro-batch reads and writes once for each part that it touches, not for each row.
    """

    LOAD = 256

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "depth int, n long, slots string")  # slots: value and turn of each, as JSON
        self.parts = handle.getMapState("parts", "part int", "memories string")  # m_id and turn of each normal form, as JSON

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.held.get()
        depth, n, slots = (before[0], before[1], json.loads(before[2])) if before else (0, 0, {})
        parts, changed, did = {} if before else {0: {}}, set(), Row("persona", "at", "action", "m_id")
        for _, at, norm, slot, value in sorted((tuple(r) for r in rows), key=lambda r: r[1]):  # of one micro-batch
            turn, replaced = 0, False
            if slot is not None:
                last, turn = slots.get(slot, (None, -1))
                if last != value:
                    replaced, turn = turn >= 0, turn + 1
                    slots[slot] = value, turn
            p = _part(norm, depth)
            known = parts[p] if p in parts else parts.setdefault(p, self._read(p))
            memory = known.get(norm)
            if memory is not None and memory[1] == turn:
                yield did(key[0], at, "merged", memory[0])
            else:
                n += memory is None
                known[norm] = at, turn
                changed.add(p)
                yield did(key[0], at, "superseded" if replaced else "created", at)
        wide = depth
        while n > self.LOAD << wide:
            wide += 1
        if wide > depth:
            self._spread(parts, depth, wide)
        else:
            for p in changed:
                self._write(p, parts[p])
        now = wide, n, json.dumps(slots)
        if now != before:
            self.held.update(now)

    def _read(self, p: int) -> dict:
        return json.loads(self.parts.getValue((p,))[0])

    def _write(self, p: int, memories: dict) -> None:
        self.parts.updateValue((p,), (json.dumps(memories),))

    def _spread(self, parts: dict[int, dict], depth: int, wide: int) -> None:
        """From 2 ** depth parts to 2 ** wide, one by one; all are written."""
        for p in range(1 << depth):
            cut = {q: {} for q in range(p, 1 << wide, 1 << depth)}
            for norm, memory in (parts.pop(p) if p in parts else self._read(p)).items():
                cut[_part(norm, wide)][norm] = memory
            for q, memories in cut.items():
                self._write(q, memories)

    def close(self) -> None:
        pass


def _part(norm: str, depth: int) -> int:
    return zlib.crc32(norm.encode()) & ((1 << depth) - 1)


def stream_actions(found: DataFrame) -> DataFrame:
    """`actions` of a stream of `candidates` as they come; within a micro-batch in order. Needs the RocksDB state store."""
    kind = f"persona {found.schema['persona'].dataType.simpleString()}, at long, action string, m_id long"
    rows = found.select("persona", F.col("at").cast("long").alias("at"), "norm", "slot", "value")
    return rows.groupBy("persona").transformWithState(statefulProcessor=Keeper(), outputStructType=kind, outputMode="append", timeMode="none")
