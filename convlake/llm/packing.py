"""Mixture-controlled packing of documents into token windows by deficit round-robin.

Every source is a queue. In each round a queue earns a quantum in proportion to its target share, and gives the whole
grains (`grain` tokens) of what it has earned; the rest of what it earned is its deficit and stays for later rounds.
A round's quanta together are one window, and windows are cut from the rounds' stream without a gap, so every
window holds the target shares to within a grain for each source. A queue's gifts up to round r have a closed form,
so a document's pieces follow from its place in its queue alone: the deficits carry over windows and partitions without any task
having to see another's tokens.

1. mapInArrow makes token ids and each document's place in its queue within its task; the table goes to the
   shared folder, so that no text is tokenized twice.
2. Sums by (task, queue) - a small table - give each task its first place in every queue; its window runs over tasks,
   not over documents, so a source with a third of all rows is no hot group.
3. Each row gets its task's offset by a join on that small table, and is cut in place. Tokens are not shuffled by key.

The last tokens that do not fill a window are laid out as windows whose lengths are powers of two, without padding.
Queues are at most `max_queues`; beyond, the largest sources and those with a weight have their own and the others share 64 by hash.

Nulls: a null text is empty, so a document of the end token alone; a null source is a queue. Repeated rows are packed
each. Very long texts are cut over windows. An empty table gives no piece. Extra columns stay out.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import CACHES, lean, small_batches, stash

FIXED = 16  # quanta are in 1/65536 of a token
TAIL = 64
SPACES = re.compile(r"[ \t\n\r]+")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The normalizer and the word split that words can be encoded apart for.
ASSUMED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


@functools.cache
def odd_characters() -> re.Pattern:
    """Finds what the fast way does not take: all but printable ASCII, tab, line ends, and letters that stay one letter in NFC and in lower case."""

    def plain(c: str) -> bool:
        low = c.lower()
        return c.isalpha() and len(low) == 1 and low.isalpha() and low.upper().lower() == low and unicodedata.is_normalized("NFC", c + low) and not unicodedata.decomposition(c).startswith("<")

    # blocks of European alphabets without marks of their own; a Greek sigma is lower-cased by its neighbours
    letters = [chr(c) for c in range(0xA1, 0x530) if plain(chr(c)) and chr(c) not in "Σςσ"]
    return re.compile("[^\x20-\x7e\t\n\r" + "".join(letters) + "]")


class Encoder:
    """Token ids of whole texts as little-endian bytes; white space parts words, so words are looked up once.

    Words of ordinary letters, with punctuation after them, go the fast way; a word with any other character is encoded by the
    tokenizer as it stands, between spaces. Where the tokenizer's file is not of the kind that this holds for, or a text
    has a mark of a special token, the tokenizer encodes whole texts.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made.get("model", {})
        merges = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not (model.get("dropout") or model.get("ignore_merges"))
        special = made.get("added_tokens", [])
        known = all(made.get(k) == v for k, v in ASSUMED.items())
        self.fast = bool(known and merges and not made.get("post_processor") and all("<|" in t["content"] and not t["normalized"] for t in special))
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}  # the generation before: words still in use move to `known`
        self.most = most

    def direct(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in got]

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each one piece of a joined text."""
        out: list[bytes] = []
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            piece = np.array(got.word_ids, dtype=np.int64)
            cuts = np.searchsorted(piece, np.arange(len(part) + 1)).tolist()
            if piece[-1] != len(part) - 1:
                out.extend(self.direct(part))
                continue
            ids = np.array(got.ids, dtype=self.kind).tobytes()
            width = len(ids) // len(piece)
            out.extend(ids[width * a : width * z] for a, z in zip(cuts[:-1], cuts[1:]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.fast:
            return self.direct(texts)
        if len(self.known) > self.most:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        parted: list[list[str] | None] = []
        out: list[bytes | None] = []
        new: set[str] = set()
        odd = odd_characters().search
        for t in texts:
            if "<|" in t:
                parted.append(None)
                out.append(self.direct([t])[0])
                continue
            words = SPACES.split(t) if odd(t) else t.lower().split()
            got = list(map(known.get, words))
            if None in got:
                new.update(w for w, g in zip(words, got) if g is None)
                parted.append(words)
                out.append(None)
            else:
                parted.append(None)
                out.append(b"".join(got))
        self.learn(new, known, older)
        return [b"".join(map(known.__getitem__, w)) if o is None else o for w, o in zip(parted, out)]

    def learn(self, new: set[str], known: dict[str, bytes], older: dict[str, bytes]) -> None:
        """Ids of words that are not known yet: a core of letters and what stands after it are looked up apart."""
        cores: dict[str, tuple[str, str]] = {}
        odd = odd_characters().search
        for w in new:
            if w in older:
                known[w] = older[w]
                continue
            core = w if odd(w) else w.rstrip(PUNCTUATION)
            cores[w] = (core, w[len(core) :]) if core and core[-1].isalpha() else (w, "")
        ask = {x for pair in cores.values() for x in pair if x not in known}
        for x in [x for x in ask if x in older]:
            known[x] = older[x]
            ask.discard(x)
        # lower-case ASCII letters pass the normalizer and the byte level as they are: the merges alone are left
        merge, code = self.tokenizer.model.tokenize, "H" if self.kind == "<u2" else "I"
        plain, rest = [], []
        for x in ask:
            if x.isalpha() and not odd(x):
                if x.isascii() and x.islower():
                    known[x] = array(code, [t.id for t in merge(x)]).tobytes()
                else:
                    plain.append(x)
            else:
                rest.append(x)
        known.update(zip(plain, self.together(plain)))
        known.update(zip(rest, self.direct(rest)))
        for w, (core, end) in cores.items():
            known[w] = known[core] + known[end]


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer's file, which stays in the worker between tasks that tokenize."""
    kept = CACHES.setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


@dataclass
class Schedule:
    """The closed form of the rounds: which stream position a place in a queue has."""

    names: list[str]
    totals: np.ndarray
    window: int
    grain: int
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        total = int(self.totals.sum())
        share = [int(t) for t in self.totals] if self.weights is None else [float(w) for w in self.weights]
        whole = sum(share) or 1
        exact = self.weights is None
        quanta = [
            -(-(s * self.window << FIXED) // whole) if exact else int(s / whole * self.window * (1 << FIXED))
            for s in share
        ]
        self.quanta = np.maximum(np.array(quanta, dtype=np.int64), 1)
        # a queue is dry in the round in which its last token was earned
        self.dry = np.array([-(-(int(t) << FIXED) // int(q)) for t, q in zip(self.totals, self.quanta)], dtype=np.int64)
        self.full = total // self.window * self.window
        rest, sizes = total - self.full, []
        while rest:
            sizes.append(1 << (rest.bit_length() - 1))
            rest -= sizes[-1]
        self.tail = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def given(self, queue, rounds):
        """Tokens that a queue has given before a round."""
        earned = (self.quanta[queue] * np.minimum(rounds, self.dry[queue]) >> FIXED) // self.grain * self.grain
        return np.where(rounds >= self.dry[queue], self.totals[queue], np.minimum(earned, self.totals[queue]))

    def round_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        need = (place // self.grain + 1) * self.grain
        return np.minimum(-(-(need << FIXED) // self.quanta[queue]), self.dry[queue]) - 1

    def pieces(self, queue: np.ndarray, place: np.ndarray, length: np.ndarray):
        """(row, start in row, length, sequence, offset) of all pieces of documents at these places of their queues."""
        row, at, end = np.arange(len(queue)), place.copy(), place + length
        every = np.arange(len(self.totals))
        out = []
        while len(row):
            q = queue[row]
            r = self.round_of(q, at)
            before = self.given(every[None, :], r[:, None])
            after = self.given(every[None, :], r[:, None] + 1)
            gifts = np.cumsum(after - before, axis=1) - (after - before)
            mine = np.arange(len(row))
            stream = before.sum(axis=1) + gifts[mine, q] + at - before[mine, q]
            late = np.clip(np.searchsorted(self.tail, stream - self.full, side="right") - 1, 0, max(len(self.tail) - 2, 0))
            done = stream >= self.full
            first = np.where(done, self.full + self.tail[late], stream // self.window * self.window)
            last = np.where(done, self.full + self.tail[np.minimum(late + 1, len(self.tail) - 1)], first + self.window)
            take = np.minimum(np.minimum(end[row], after[mine, q]) - at, last - stream)
            sequence = np.where(done, self.full // self.window + late, stream // self.window)
            out.append((row, at - place[row], take, sequence, stream - first))
            at = at + take
            more = at < end[row]
            row, at = row[more], at[more]
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 5
        order = np.lexsort((parts[1], parts[0]))
        return [x[order] for x in parts]


def queue_names(docs: DataFrame, source: str, max_queues: int, weights: dict[str, float] | None = None) -> set[str] | None:
    """Sources with a queue of their own, all with a weight among them; None where all have one. Only the largest `max_queues` reach the driver."""
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("q")).count()
    top = [r.q for r in counts.orderBy(F.desc("count"), "q").limit(max_queues + 1).collect()]
    return None if len(top) <= max_queues else set(top[: max_queues - TAIL]) | set(weights or ())


def tokenize(docs: DataFrame, id_col: str, text: str, source: str, path: str, end_id: int, own: set[str] | None) -> DataFrame:
    """id, task, queue, place (in the queue, within the task), n, ids (bytes)."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("queue"))
    mark = "~"
    while any(q.startswith(mark) for q in own or ()):  # no shared queue is named like a source's own
        mark += "~"
    tail = F.concat(F.lit(mark), F.pmod(F.xxhash64("queue"), F.lit(TAIL)).cast("string"))
    if own is not None:
        kept = kept.withColumn("queue", F.when(F.col("queue").isin(sorted(own)), F.col("queue")).otherwise(tail))

    @functools.partial(lean, keeps="encoders")
    def run(batches):
        tokens = encoder(path)
        end = np.array([end_id], dtype=tokens.kind).tobytes()
        width = len(end)
        task, places = TaskContext.get().partitionId(), {}
        for b in batches:
            ids = [x + end for x in tokens.encode([t or "" for t in b.column(1).to_pylist()])]
            n = [len(x) // width for x in ids]
            place = []
            for q, k in zip(b.column(2).to_pylist(), n):
                place.append(places.get(q, 0))
                places[q] = place[-1] + k
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([task] * len(n), pa.int32()), b.column(2), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "task", "queue", "place", "n", "ids"],
            )

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, task int, queue string, place long, n long, ids binary")


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    window: int = 2048,
    grain: int = 256,
    end_id: int = 1,
    weights: dict[str, float] | None = None,
    max_queues: int = 1024,
) -> DataFrame:
    """Pieces: id, queue, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    weights: target share of each source (others 0: they follow once they alone are left); by default the sources'
    own shares of all tokens, which every window can hold to the end.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = queue_names(docs, source, max_queues, weights)
    table = stash(tokenize(docs, id_col, text, source, path, end_id, own), "packing-tokens")
    sums = table.groupBy("task", "queue").agg(F.sum("n").alias("sum"))
    before = W.partitionBy("queue").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = stash(sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))), "packing-offsets")
    totals = {r.queue: r.sum for r in offsets.groupBy("queue").agg(F.sum("sum").alias("sum")).collect()}
    names = sorted(totals)
    share = None if weights is None else np.array([max(float(weights.get(q, 0.0)), 1e-9) for q in names])
    plan = Schedule(names, np.array([totals[q] for q in names], dtype=np.int64), window, grain, share)
    shared = spark.sparkContext.broadcast((plan, {q: i for i, q in enumerate(names)}))
    placed = table.join(offsets.select("task", "queue", "before"), ["task", "queue"])
    placed = placed.select("id", "queue", (F.col("place") + F.col("before")).alias("place"), "n", "ids")

    @lean
    def run(batches):
        plan, number = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            queue = np.array([number[q] for q in b.column(1).to_pylist()], dtype=np.int64)
            place, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            row, start, length, sequence, offset = plan.pieces(queue, place, n)
            ids = b.column(4).to_pylist()
            width = len(ids[0]) // int(n[0])
            wide = [np.frombuffer(x, dtype=f"<u{width}").astype("<u4").tobytes() for x in ids]
            cut = [wide[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist())]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(start), pa.array(length), pa.array(cut, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(offset)],
                names=["id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    kind = placed.schema["id"].dataType.simpleString()
    schema = f"id {kind}, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return digest(pack(docs, public_tokenizers.path("word_bpe_49k.json")))
