"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of code points; A-Z are lowered and ASCII characters other than letters count as
space. Document frequencies come from every training document. The weights are learned by follow the regularised
leader with L1 and L2 penalties on a bounded sample: at most about ``SAMPLE`` labelled rows in all, shared out evenly
among languages and taken by a hash of the id. A fifth of them is held back to fit the temperature that turns the
scores into calibrated probabilities. Prediction reads the whole text and nothing else.

Defined cases: a NULL text or one without a letter is ``und`` with score 0; where nothing could be learned every
document is ``und``; equal texts get equal predictions; an empty table gives an empty table; only the named
columns are read. The number of distinct languages is taken to be small, as they are the classes of the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T

BUCKETS = 1 << 15
SAMPLE = 4096
SCALE = 100.0
_SHIFT = np.uint32(17)
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[:] = 32
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Bucket of every 1-, 2- and 3-gram of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = codes < 128
    codes = np.where(small, _FOLD[np.where(small, codes, 0)], codes)
    parts = [codes * _MULTIPLY[0]]
    if len(codes) > 1:
        parts.append(codes[:-1] * _MULTIPLY[1] + codes[1:] * _MULTIPLY[2])
    if len(codes) > 2:
        parts.append(codes[:-2] * _MULTIPLY[3] + codes[1:-1] * _MULTIPLY[4] + codes[2:] * _MULTIPLY[5])
    found = np.concatenate(parts)
    found ^= found >> np.uint32(15)
    found *= np.uint32(0x2C1B3C6D)
    return (found >> _SHIFT).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents per bucket, documents) over all rows of a one-column table.

    Each task sends its counts in a fixed number of chunks, which are summed chunk by chunk.
    """
    chunks = 32
    size = BUCKETS // chunks

    def count(batches):
        total, rows, seen = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
        for batch in batches:
            for piece in T.slices(batch, 0):
                for text in piece.column(0).to_pylist():
                    if text:
                        seen[ngrams(text)] = True
                        total += seen
                        seen[:] = False
                    rows += 1
        if rows:
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(range(chunks), pa.int32()), "rows": pa.array([rows] * chunks, pa.int64()),
                "counts": pa.array([total[i * size:(i + 1) * size].tobytes() for i in range(chunks)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for counts in table.column("counts").to_pylist():
            total += np.frombuffer(counts, np.int64)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "rows": [sum(table.column("rows").to_pylist())],
                         "counts": pa.array([total.tobytes()], pa.binary())})

    found = (texts.mapInArrow(count, "chunk int, rows long, counts binary").groupBy("chunk")
             .applyInArrow(add, "chunk int, rows long, counts binary").collect())
    frequencies = np.zeros(BUCKETS, np.int64)
    for row in found:
        frequencies[row["chunk"] * size:(row["chunk"] + 1) * size] = np.frombuffer(row["counts"], np.int64)
    return frequencies, found[0]["rows"] if found else 0


class Leader:
    """Follow-the-regularised-leader multinomial regression with an elastic-net penalty."""

    def __init__(self, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.z = np.zeros((BUCKETS + 1, classes))
        self.n = np.zeros((BUCKETS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        pull = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, pull / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores with the least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(scores / np.exp(t))[np.arange(len(labels)), labels]
        return -float(np.log(np.maximum(p, 1e-300)).mean())

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language, times inverse document frequency
    bias: np.ndarray
    heat: float

    def scores(self, text: str) -> np.ndarray:
        found = ngrams(text)
        return self.bias + np.bincount(found, minlength=BUCKETS).astype(np.float32) @ self.weights * (SCALE / len(found))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = softmax(self.scores(text).astype(np.float64) / self.heat)
        best = int(p.argmax())
        return self.languages[best], min(1.0, float(p[best]))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", sample: int = SAMPLE,
        epochs: int = 3) -> Model:
    """A model from the rows of ``train`` whose language is known. Counts cover all of them; see above for the sample."""
    rows = train.filter(F.col(lang).isNotNull()).select(
        F.col(id_column).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    frequencies, total = document_frequencies(rows.select("text"))
    inverse = np.log((1 + total) / (1 + frequencies)) + 1
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, min(1.0, sample / len(languages) / counts[name])).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(draw < share).select(
        "text", "lang", F.xxhash64("id", F.lit(8)).alias("turn"), F.lit(0).alias("__one"))

    def count(batches):
        for batch in batches:
            for piece in T.slices(batch, 0):
                found = [np.unique(ngrams(x or " "), return_counts=True) for x in piece.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(1), piece.column(2), piece.column(3),
                     pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary()),
                     pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())],
                    ["lang", "turn", "__one", "at", "counts"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("turn")
        docs = []
        for r in zip(*[table.column(c).to_pylist() for c in ("lang", "at", "counts")]):
            at, c = np.frombuffer(r[1], "<u4").astype(np.int64), np.frombuffer(r[2], "<u4")
            x = SCALE * c / c.sum() * inverse[at]
            docs.append((np.append(at, BUCKETS), np.append(x, 1.0), languages.index(r[0])))
        held = docs[::5] if len(docs) >= 5 else []
        kept = [d for i, d in enumerate(docs) if i % 5] if held else docs
        model = Leader(len(languages))
        for _ in range(epochs):
            for at, x, label in kept:
                model.learn(at, x, label)
        w = model.weights()
        scores = np.array([x @ w[at] for at, x, _ in held]).reshape(-1, len(languages))
        heat = temperature(scores, np.array([label for _, _, label in held], np.int64))
        return pa.table({"weights": pa.array([w.astype("<f4").tobytes()], pa.binary()), "heat": [heat]})

    found = (chosen.mapInArrow(count, "lang string, turn long, __one int, at binary, counts binary")
             .groupBy("__one").applyInArrow(learn, "weights binary, heat double").collect())
    if not found:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    w = np.frombuffer(found[0]["weights"], "<f4").reshape(BUCKETS + 1, -1)
    return Model(languages, (w[:-1] * inverse[:, None]).astype(np.float32), w[-1].copy(), found[0]["heat"])


def predict(docs: DataFrame, model: Model, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) of every document."""
    part = docs.select(F.col(id_column), F.col(text).alias("__text"))

    @T.tidy
    def label(batches):
        for batch in batches:
            for piece in T.slices(batch, 1):
                found = [model.predict(x) for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([a for a, _ in found], pa.string()),
                     pa.array([b for _, b in found], pa.float64())], [id_column, "lang_pred", "score"])

    return part.mapInArrow(label, f"`{id_column}` {part.schema[0].dataType.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents whose language is recognised with a probability of at least ``least``, with all their columns."""
    at = docs.columns.index(text)

    @T.tidy
    def passing(batches):
        for batch in batches:
            for piece in T.slices(batch, at):
                found = [model.predict(x) for x in piece.column(at).to_pylist()]
                yield piece.filter(pa.array([a != "und" and b >= least for a, b in found]))

    return docs.mapInArrow(passing, docs.schema)


def held_out(id_column: Column, parts: int, part: int) -> Column:
    """Whether the checksum of an id as text falls in ``part`` of ``parts``; a NULL id never does."""
    return F.coalesce(F.crc32(id_column.cast("string")) % parts == part, F.lit(False))
