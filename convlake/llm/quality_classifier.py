"""Document quality by co-training of a content view and a metadata view.

The content view sees the words of a text, hashed into a vector of fixed size, and figures of how it is written; the metadata view
sees source, language and stated size. Both are logistic regressions, fitted in numpy on the driver. The driver only sees
features of bounded samples: about `labelled` labelled and `pool` unlabelled documents, picked by a hash of the id.

In each round each view ranks the pool by its calibrated score and hands the documents it is surest of, good and bad ones, to the
other view as pseudo-labels. A pseudo-label weighs as much as the view knows more about the document than the share of its
class says, so a view without knowledge hands over labels of no weight. Labels are dealt three ways by id: to fit, to calibrate
the views, and to stack both into one score and set the threshold: the highest at or under one half that rejects at most
`lose` of the good documents there.

All documents are then scored in one pass without a shuffle: figures are DataFrame functions over the whole text, words are hashed
in numpy. Memory is bounded by the Arrow batch.

Nulls: a null text has the figures of an empty one; null metadata is a value of its own. Labels that are null are
ignored, repeated ones averaged. Without labels of both kinds nothing is learned: the score is 1 and everything is kept.
Repeated rows each get their row. An empty table gives an empty result. Extra columns stay out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, SPACE, lean, mix, prefix_hash, small_batches, span_hash, text_chunks
from .quality_rules import SPACES, base_figures, let

TEXT = ["word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct"]
META = ["chars", "source", "lang"]
BINS, SOURCES, LANGS = 16, 1024, 256  # bins of a figure, hashed values of a source and of a language
SIZE = 512  # of a content vector


def features(docs: DataFrame, id_col: str, text: str, source: str, lang: str, n_chars: str, whole: bool = False) -> DataFrame:
    """id and text (with `whole`, a struct of the row alone), then TEXT and META features as doubles."""
    t = F.coalesce(F.col(text), F.lit(""))
    distinct = let(F.split(t, SPACES), lambda w: F.size(F.array_distinct(w)) / F.size(w))
    hashed = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n))
    df = docs.select(
        (F.struct(*docs.columns) if whole else F.col(id_col)).alias("id"),
        t.alias("text"),
        base_figures(F.col(text)).alias("f"),
        F.char_length(t).alias("size"),
        F.regexp_count(t, F.lit("[A-Z]")).alias("upper"),
        F.regexp_count(t, F.lit("[0-9]")).alias("digits"),
        F.regexp_count(t, F.lit("[.,;:!?]")).alias("marks"),
        distinct.alias("distinct"),
        F.log1p(F.coalesce(F.col(n_chars), F.lit(-1)).cast("double") + 1).alias("chars"),
        hashed(source, SOURCES).alias("source"),
        hashed(lang, LANGS).alias("lang"),
    )
    words, size = F.greatest(F.col("f.n_words"), F.lit(1)), F.greatest("size", F.lit(1))
    figures = {
        "word_length": F.col("f.word_chars") / words,
        "symbols": F.col("f.n_symbols") / words,
        "dup_lines": F.col("f.n_dup_lines") / words,
        "repeats": F.col("f.n_repeat_words") / words,
        "upper": F.col("upper") / size,
        "digits": F.col("digits") / size,
        "marks": F.col("marks") / words,
        "distinct": F.col("distinct"),
    }
    return df.select("id", *([] if whole else ["text"]), *[figures[c].cast("double").alias(c) for c in TEXT], *[F.col(c).cast("double") for c in META])


def content(texts: list[str | None]) -> np.ndarray:
    """A unit vector for each whole text: counts of its words, hashed with signs. Without words it is zero."""
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    for first, part in text_chunks(texts):
        lengths = np.fromiter((len(t) + 1 for t in part), dtype=np.int64, count=len(part))
        buf = LOWER_TABLE[np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[buf])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        word = mix(span_hash(prefix_hash(buf), starts, ends), 12)
        of = np.searchsorted(np.cumsum(lengths), starts, side="right")
        place = of * SIZE + (word % np.uint64(SIZE)).astype(np.int64)
        sign = 1.0 - 2.0 * (word >> np.uint64(63)).astype(np.float64)
        out[first : first + len(part)] = np.bincount(place, sign, len(part) * SIZE).reshape(-1, SIZE)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class View:
    """Bins of figures or hashed values, with or without the content vector, and a logistic regression with a calibration line.

    columns: place of a column among the figures, and the number of its hashed values (0: a figure, which is binned).
    """

    columns: list[tuple[int, int]]
    dense: bool
    edges: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 0.0)

    def bins(self, x: np.ndarray) -> None:
        for c, hashed in self.columns:
            self.edges.append(np.zeros(0) if hashed else np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1])))

    def codes(self, x: np.ndarray) -> np.ndarray:
        out, base = np.zeros((len(x), len(self.columns)), dtype=np.int64), 1
        for k, (c, hashed) in enumerate(self.columns):
            out[:, k] = base + (x[:, c].astype(np.int64) if hashed else np.searchsorted(self.edges[k], x[:, c], side="right"))
            base += hashed or BINS + 1
        return out

    def fit(self, x: np.ndarray, v: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 10.0, steps: int = 60) -> None:
        """Descent with adaptive steps from the last weights; the constant is free, all else is drawn to zero."""
        used = weight > 0
        x, v, y, weight = x[used], v[used], y[used], weight[used]
        code = self.codes(x)
        size = 1 + sum(h or BINS + 1 for _, h in self.columns)
        w = np.zeros(size + SIZE * self.dense) if self.weights is None else self.weights
        slope, first, second = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
        total = weight.sum()
        for t in range(1, steps + 1):
            z = w[0] + w[code].sum(axis=1) + (v @ w[size:].astype(np.float32) if self.dense else 0.0)
            gap = weight * (sigmoid(z) - y)
            slope[:size] = np.bincount(code.ravel(), np.repeat(gap, code.shape[1]), size)
            slope[0] = gap.sum()
            if self.dense:
                slope[size:] = gap.astype(np.float32) @ v
            slope[1:] += ridge * w[1:]
            first, second = 0.9 * first + 0.1 * slope / total, 0.99 * second + 0.01 * (slope / total) ** 2
            step = 0.3 * (1 - t / (steps + 1)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
            w = w - step * first / (1 - 0.9**t)
        self.weights = w

    def raw(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        size = 1 + sum(h or BINS + 1 for _, h in self.columns)
        return self.weights[0] + self.weights[self.codes(x)].sum(axis=1) + (v @ self.weights[size:].astype(np.float32) if self.dense else 0.0)

    def score(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.clip(sigmoid(self.scale[0] * self.raw(x, v) + self.scale[1]), 1e-9, 1 - 1e-9)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton steps for a few columns; the last coefficient is the constant."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (p - y) + ridge * w)
    return w


@dataclass
class Judge:
    text: View
    meta: View
    stack: np.ndarray
    threshold: float
    #: Of each round: pseudo-labels that the content view and the metadata view have got, and the sums of their weights.
    rounds: list[tuple[int, int, float, float]] = field(default_factory=list)

    def scores(self, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.score(x, v), self.meta.score(x, v)
        both = np.column_stack((np.log(a / (1 - a)), np.log(b / (1 - b)), np.ones(len(x))))
        return a, b, sigmoid(both @ self.stack)


def co_train(x, v, y, part, pool_x, pool_v, rounds: int, share: float, lose: float) -> Judge:
    """x, v, y: figures, content vectors and labels; part: 0 fits, 1 calibrates, 2 stacks and sets the threshold; pool: unlabelled."""
    views = (View([(k, 0) for k in range(len(TEXT))], True), View([(len(TEXT), 0), (len(TEXT) + 1, SOURCES), (len(TEXT) + 2, LANGS)], False))
    fits, sets, ends = (part == k for k in range(3))
    n, m = int(fits.sum()), len(pool_x)
    all_x, all_v = np.concatenate((x[fits], pool_x)), np.concatenate((v[fits], pool_v))
    label = [np.concatenate((y[fits], np.zeros(m))) for _ in views]
    weight = [np.concatenate((np.ones(n), np.zeros(m))) for _ in views]
    named = [np.zeros(m, dtype=bool) for _ in views]  # pool documents that have been named to a view
    base = float(y[fits].mean())
    log: list[tuple[int, int, float, float]] = []
    for view in views:
        view.bins(all_x)
    most = max(1, int(share * m / 2))
    for r in range(rounds + 1):
        for i, view in enumerate(views):
            view.fit(all_x, all_v, label[i], weight[i])
            view.scale = (1.0, 0.0)
            view.scale = tuple(logistic(view.raw(x[sets], v[sets])[:, None], y[sets], ridge=1.0))
        if r == rounds or not m:
            break
        for i, view in enumerate(views):
            p, other = view.score(pool_x, pool_v), 1 - i
            for said, doubt, usual in ((1, 1 - p, base), (0, p, 1 - base)):
                free = np.flatnonzero(~named[other])
                best = free[np.argsort(doubt[free], kind="stable")][:most]
                named[other][best] = True
                label[other][n + best] = said
                weight[other][n + best] = np.clip((1 - doubt[best] - usual) / max(1 - usual, 1e-9), 0, 1)
        log.append((int(named[0].sum()), int(named[1].sum()), float(weight[0][n:].sum()), float(weight[1][n:].sum())))
    judge = Judge(*views, np.zeros(3), 0.5, log)
    a, b = (view.score(x[ends], v[ends]) for view in views)
    odds = np.column_stack((np.log(a / (1 - a)), np.log(b / (1 - b))))
    judge.stack = logistic(odds, y[ends], ridge=1.0)
    if (against := judge.stack[:2] < 0).any():  # no view speaks against what it is calibrated to say
        odds[:, against] = 0
        judge.stack = np.where(np.append(against, False), 0.0, logistic(odds, y[ends], ridge=1.0))
    good = np.sort(judge.scores(x[ends], v[ends])[2][y[ends] == 1])
    judge.threshold = float(min(0.5, good[int(lose * len(good))]))
    return judge


def vectors(figures: DataFrame) -> DataFrame:
    """`figures` with the content vector in place of the text."""
    names = [c for c in figures.columns if c != "text"]

    @lean
    def run(batches):
        for b in batches:
            made = pa.array([x.tobytes() for x in content(b.column("text").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), made], names=[*names, "vector"])

    fields = ", ".join(f"`{c}` {figures.schema[c].dataType.simpleString()}" for c in names)
    return figures.mapInArrow(run, f"{fields}, vector binary")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label: str = "quality",
    labelled: int = 12_000,
    pool: int = 12_000,
    rounds: int = 3,
    share: float = 0.1,
    lose: float = 0.002,
    **columns: str,
) -> Judge | None:
    """The judge, or None without labels of both kinds. `labelled` and `pool` bound the expected rows on the driver.

    share: so large a part of the pool each view names to the other in a round, half of it good and half bad.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    known = known.agg((F.avg(label) >= 0.5).cast("double").alias("_y"))

    def picked(df: DataFrame, name: str, rows: int, seed: int) -> DataFrame:
        rate = rows / max(df.count(), 1)
        return df.where(F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < rate)

    some = picked(known, "_id", labelled, 1)
    names = columns_of(columns)
    seen = docs.join(F.broadcast(some), F.col(id_col) == F.col("_id")).select(*docs.columns)
    got = vectors(features(seen, id_col, **names)).join(F.broadcast(some), F.col("id") == F.col("_id"))
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10))
    got = got.withColumn("_part", F.when(place < 6, 0).when(place < 8, 1).otherwise(2)).drop("_id").toPandas()
    got = got.sort_values(["id", *TEXT], kind="stable")
    y, part = got["_y"].to_numpy(), got["_part"].to_numpy().copy()
    if any(not ((y == k) & (part == 2)).any() for k in (0, 1)):
        part[part == 2] = 1  # too few labels to part: those that calibrate also stack
    rest = vectors(features(picked(docs, id_col, pool, 2), id_col, **names)).toPandas().sort_values(["id", *TEXT], kind="stable")
    if any(not ((y == k) & (part == q)).any() for k in (0, 1) for q in (0, 1)):
        return None

    def arrays(rows):
        v = np.frombuffer(b"".join(rows["vector"]), dtype=np.float32).reshape(-1, SIZE)
        return rows[[*TEXT, *META]].to_numpy(dtype=np.float64).reshape(-1, len(TEXT) + len(META)), v

    x, v = arrays(got)
    if not (part == 2).any():
        again = part == 1
        x, v, y, part = np.concatenate((x, x[again])), np.concatenate((v, v[again])), np.append(y, y[again]), np.append(part, np.full(again.sum(), 2))
    return co_train(x, v, y, part, *arrays(rest), rounds, share, lose)


def columns_of(columns: dict[str, str]) -> dict[str, str]:
    return {"text": "text", "source": "source", "lang": "lang", "n_chars": "n_chars"} | columns


def _score(figures: DataFrame, judge: Judge | None, inside: str | None = None) -> DataFrame:
    """inside: the field of id that is the text, where it is not a column."""
    shared = figures.sparkSession.sparkContext.broadcast(judge)
    names = ["id", "text_score", "meta_score", "score", "kept"]

    @lean
    def run(batches):
        judge = shared.value
        for b in batches:
            one = np.ones(b.num_rows)
            a = m = s = one
            if judge and b.num_rows:
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in [*TEXT, *META]])
                texts = b.column(0).field(b.column(0).type.get_field_index(inside)) if inside else b.column("text")
                a, m, s = judge.scores(x, content(texts.to_pylist()))
            kept = s >= (judge.threshold if judge else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (a, m, s, kept))], names=names)

    kind = figures.schema["id"].dataType.simpleString()
    return figures.mapInArrow(run, f"id {kind}, text_score double, meta_score double, score double, kept boolean")


def classify(docs: DataFrame, judge: Judge | None, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """id, text_score, meta_score, score (probability of good quality), kept."""
    small_batches(docs.sparkSession)
    return _score(features(docs, id_col, **columns_of(columns)), judge).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, judge: Judge | None, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    small_batches(docs.sparkSession)
    figures = features(docs, id_col, whole=True, **columns_of(columns))
    return _score(figures, judge, columns_of(columns)["text"]).where("kept").select("id.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
