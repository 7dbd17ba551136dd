"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean embedding of its letter 2-, 3- and 4-grams (hashed, with word ends), put through a linear
softmax. Embeddings and weights are trained by stochastic gradient descent in numpy on the driver, over a bounded
sample: at most about `per_lang` documents of each of the `max_langs` most frequent languages (rows, not the corpus,
bound the driver's memory). A held-back fifth of the sample sets the softmax temperature and the rejection
threshold. Prediction reads every whole text in mapInArrow with the model as a broadcast of fixed size
(2**bits x languages floats); there is no shuffle.

Nulls: a null text or one without a letter is `und` with score 0. A null language or id is not learned from; such
rows are still predicted. Where nothing can be learned, everything is `und`. Very long texts are read whole, in
pieces. Repeated rows each get their row. An empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, lean, mix, small_batches

UNKNOWN = "und"
GRAMS = (2, 3, 4)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        table = np.zeros(sys.maxunicode + 1, dtype=bool)
        table[[c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]] = True
        _letters = table
    return _letters


def grams(codes: np.ndarray, bits: int) -> np.ndarray:
    """Hashed n-grams of lower-cased code points in which everything but letters is a blank."""
    out = []
    blank = codes == 32
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(BASE) + codes[k : k + m]
        inner = np.zeros(m, dtype=bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + m]
        if n == 2:
            inner = blank[:m] & blank[1 : 1 + m]
        out.append((mix(h[~inner]) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def pieces(text: str, size: int = 1 << 19):
    """The code points of a whole text, blanked and lower-cased, in pieces that overlap by one n-gram."""
    known = letters()
    for at in range(0, len(text), size):
        raw = text[max(0, at - max(GRAMS) + 1) : at + size].lower()
        codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        codes = np.where(known[codes], codes, np.uint64(32))
        yield np.concatenate(([np.uint64(32)], codes, [np.uint64(32)])) if len(text) <= size else codes


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # [bucket, language]: embedding times weights
    bias: np.ndarray
    temperature: float
    reject: float
    bits: int

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.langs)), 0
        for codes in pieces(text):
            ids = grams(codes, self.bits)
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        x = self.logits(text)
        if x is None:
            return UNKNOWN, 0.0
        p = softmax(x[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(min(max(p[best], 0.0), 1.0))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    texts: list[str],
    langs: list[str],
    bits: int = 16,
    dim: int = 16,
    epochs: int = 4,
    rate: float = 2.0,
    seed: int = 7,
    steps: int = 800,
) -> Model:
    """Stochastic gradient descent over whole texts and short fragments of them: `epochs`, and `steps` at least."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if not names:
        return Model([], np.zeros((1, 0)), np.zeros(0), 1.0, 0.0, bits)
    held = rng.random(len(texts)) < 0.2
    rows, target, aside = [], [], []
    for text, lang, back in zip(texts, langs, held):
        cuts = [text] + [text[s : s + int(rng.integers(20, 200))] for s in rng.integers(0, max(1, len(text) - 20), 2)]
        for cut in cuts:
            parts = [grams(c, bits) for c in pieces(cut)]
            ids, counts = np.unique(np.concatenate(parts) if parts else [], return_counts=True)
            if len(ids):
                rows.append((ids.astype(np.int64), (counts / counts.sum()).astype(np.float32)))
                target.append(names.index(lang))
                aside.append(back)
    emb = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    weight = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    target, aside = np.array(target, dtype=np.int64), np.array(aside, dtype=bool)
    learn = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(rows))

    def means(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([rows[i][0] for i in batch])
        share = np.concatenate([rows[i][1] for i in batch])
        sizes = np.array([len(rows[i][0]) for i in batch])
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.add.reduceat(emb[ids] * share[:, None], at, axis=0), ids, share, np.repeat(np.arange(len(batch)), sizes)

    size = 32
    epochs = max(epochs, -(-steps * size // max(len(learn), 1)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(learn)
        for at in range(0, len(order), size):
            batch = order[at : at + size]
            x, ids, share, of = means(batch)
            p = softmax(x @ weight + bias)
            p[np.arange(len(batch)), target[batch]] -= 1
            back = p @ weight.T
            weight -= step / len(batch) * (x.T @ p)
            bias -= 0.1 * step / len(batch) * p.sum(axis=0)
            np.add.at(emb, ids, -step * share[:, None] * back[of])
    model = Model(names, (emb @ weight).astype(np.float32), bias, 1.0, 0.0, bits)
    check = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
    logits = np.concatenate([means(check[i : i + 256])[0] for i in range(0, len(check), 256)]) @ weight + bias
    truth = target[check]
    # temperature by likelihood, then the lowest threshold over which 99 of 100 held-back texts are right
    spread = np.geomspace(0.2, 5, 33)
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-9).mean() for t in spread]
    model.temperature = float(spread[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    order = np.argsort(-p.max(axis=1))
    right = np.cumsum((p.argmax(axis=1) == truth)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= 0.99)
    model.reject = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return model


def sample(
    labelled: DataFrame, id_col: str, text: str, lang: str, per_lang: int, max_langs: int, longest: int
) -> DataFrame:
    """About `per_lang` rows of each of the `max_langs` most frequent languages, picked by a hash of the id."""
    labelled = labelled.where(F.col(id_col).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rates = (
        labelled.groupBy(F.col(lang).alias("_lang"))
        .count()
        .orderBy(F.desc("count"), "_lang")
        .limit(max_langs)
        .select("_lang", (F.lit(float(per_lang)) / F.col("count")).alias("_rate"))
    )
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    near = labelled.join(F.broadcast(rates), F.col(lang) == F.col("_lang"))
    return near.where((place < F.col("_rate")) & (F.length(text) <= longest)).select(
        F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_lang: int = 1000,
    max_langs: int = 256,
    longest: int = 20_000,
    **options,
) -> Model:
    """A model from a bounded sample of texts of at most `longest` characters; the sample's order is fixed by id."""
    rows = sample(labelled, id_col, text, lang, per_lang, max_langs, longest).toPandas().sort_values(["id", "text"])
    return train(rows["text"].tolist(), rows["lang"].tolist(), **options)


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, lang_pred (best language), score, accepted (score over the calibrated threshold) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text).alias("_text"))

    @lean
    def run(batches):
        for b in batches:
            got = [shared.value.predict(t) for t in b.column(len(keep)).to_pylist()]
            fine = [s >= shared.value.reject and x != UNKNOWN for x, s in got]
            made = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), pa.array(fine, pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                b.columns[: len(keep)] + made, names=[*keep, "lang_pred", "score", "accepted"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])
