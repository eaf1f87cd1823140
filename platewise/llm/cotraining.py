"""Quality of documents by co-training two views.

One logistic classifier sees the text (hashed words and the counts of the quality rules), the other the page's
metadata (source, language, length class). Both start from the labelled documents. In every round each labels the
unlabelled documents that it is surest of, and these go to the other as further examples. Then each
view is calibrated on labelled documents held back from training, and their log-odds are added.

At most about ``SAMPLE`` labelled documents, taken by a hash of the id, are learned from, in the driver. All other
documents are candidates: a round counts how sure each view is of each of them, in ``BINS`` steps of the log-odds, and
sets the bar by these counts; equally sure documents are taken together. Tasks learn from the documents over the bar in
lots of ``LOT`` rows, from the weights before, and the weights of all lots and of the labelled documents are averaged
by rows. Labels given in earlier rounds follow from the earlier weights and bars, so none are stored.

Defined cases: a NULL or empty text has no words; NULL metadata are a value of their own; of repeated labels of one
document the smaller counts, a NULL label does not; without labels of both kinds every score is 0.5; an empty table
gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.llm.host_rules import statistics
from platewise.session import cut_lineage

SAMPLE = 8192
WORD_BUCKETS = 2048
DENSE = 6
META_BUCKETS = 512
ROUNDS = 5
SURE = 0.9
BINS = 4096
BIN = 1 / 128  # of log-odds
LOT = 4096


def text_view(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, values) of each text: word shares by hash, then rates of the rule counts, then one."""
    data, offsets = T.buffer_of(column)
    starts, ends, rows = T.words_of(data, offsets)
    buckets = (T.word_hashes(data, starts, ends) >> np.uint64(53)).astype(np.int64)
    stats = statistics(column)
    n = np.maximum(stats["n_words"], 1)
    dense = np.stack((np.log1p(stats["n_words"]) / 5, stats["word_chars"] / n / 5, stats["n_symbols"] / n,
                      stats["n_repeat_words"] / n, np.log1p(stats["n_dup_lines"]), np.ones(len(n))), axis=1)
    cuts = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        at, counts = np.unique(buckets[cuts[i]:cuts[i + 1]], return_counts=True)
        values = np.sqrt(counts / n[i])
        out.append((np.concatenate((at, WORD_BUCKETS + np.arange(DENSE))), np.concatenate((values, dense[i]))))
    return out


def meta_view(*columns: list) -> list[np.ndarray]:
    """Positions of the metadata values of each row, by hash; the last position is always set."""
    out = []
    for values in zip(*columns):
        own = {int(T.mix(np.array([_number(f"{i}={v}")], np.uint64))[0] % np.uint64(META_BUCKETS)) for i, v in enumerate(values)}
        out.append(np.array([*sorted(own), META_BUCKETS], np.int64))
    return out


def _number(value: str) -> int:
    return int.from_bytes(value.encode().ljust(8, b"\0"), "little") % (2**64 - 59)


def regression(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.5, ridge: float = 1e-4,
               start: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression by scaled gradient steps."""
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32) if start is None else start.astype(np.float32)
    squares = np.full(x.shape[1], 1e-8 if start is None else 1e-2, np.float32)
    for _ in range(steps):
        g = x.T @ (sigmoid(x @ w) - y) / len(y) + ridge * w
        squares += g * g
        w -= rate * g / np.sqrt(squares)
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scaling(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate log-odds on labelled rows."""
    x = np.stack((odds / 4, np.ones(len(odds))), axis=1)
    w = regression(x, y, steps=300, ridge=1e-3)
    return float(w[0]) / 4, float(w[1])


def _bin(odds: np.ndarray, sure: float) -> np.ndarray:
    """Step of log-odds in favour above those of ``sure``; below zero if not as sure."""
    return np.clip(np.floor((odds - np.log(sure / (1 - sure))) / BIN), -1, BINS - 1).astype(np.int64)


def given(views: list[np.ndarray], history: list, sure: float) -> list[np.ndarray]:
    """Labels of unlabelled rows for each view after the rounds of ``history`` (weights, bars); below 0 for none."""
    own = [np.full(len(v), -1) for v in views]
    for weights, bars in history:
        for k in (0, 1):
            odds = views[k] @ weights[k]
            free = own[1 - k] < 0
            for value, signed in ((1, odds), (0, -odds)):
                own[1 - k][free & (_bin(signed, sure) >= bars[k, value])] = value
    return own


def sure_counts(views: list[np.ndarray], history: list, weights: list[np.ndarray], sure: float) -> np.ndarray:
    """Rows without a label yet by view, value and step of surety."""
    own, out = given(views, history, sure), np.zeros((2, 2, BINS), np.int64)
    for k in (0, 1):
        odds = (views[k] @ weights[k])[own[1 - k] < 0]
        for value, signed in ((1, odds), (0, -odds)):
            at = _bin(signed, sure)
            out[k, value] = np.bincount(at[at >= 0], minlength=BINS)
    return out


def taught(views: list[np.ndarray], history: list, weights: list[np.ndarray], sure: float) -> list[tuple[np.ndarray, int]]:
    """(weights times rows, rows) of each view after learning from the labels given to it."""
    out = []
    for v, o, w in zip(views, given(views, history, sure), weights):
        n = int((o >= 0).sum())
        out.append((regression(v[o >= 0], o[o >= 0], start=w).astype(np.float64) * n if n else np.zeros(v.shape[1]), n))
    return out


def exchange(views: list[np.ndarray], labels: np.ndarray, held: np.ndarray, pool: int, count, teach, rounds: int,
             sure: float) -> list[tuple[np.ndarray, float, float]]:
    """(weights, slope, shift) of each view, from labelled rows and from ``pool`` others seen by ``count`` and ``teach`` only."""
    known, each = ~held, max(1, pool // (4 * rounds))
    weights = [regression(v[known], labels[known]) for v in views]
    history = []
    for _ in range(rounds if pool else 0):
        counts = count(history, weights)
        over = np.cumsum(counts[:, :, ::-1], axis=2)[:, :, ::-1] >= each
        history.append((weights, np.maximum(over.sum(axis=2) - 1, 0)))
        sums = teach(history, weights)
        weights = [((regression(v[known], labels[known], start=w) * known.sum() + s) / (known.sum() + n)).astype(np.float32)
                   for v, w, (s, n) in zip(views, weights, sums)]
    return [(w, *scaling(v[held] @ w, labels[held])) for v, w in zip(views, weights)]


def cotrain(views: list[np.ndarray], labels: np.ndarray, held: np.ndarray, rounds: int = ROUNDS,
            sure: float = SURE) -> list[tuple[np.ndarray, float, float]]:
    """(weights, slope, shift) of each of two views. A label is 0, 1, or below 0 in the pool; ``held`` rows calibrate."""
    marked = labels >= 0
    rest = [v[~marked] for v in views]
    return exchange([v[marked] for v in views], labels[marked], held[marked], int((~marked).sum()),
                    lambda *x: sure_counts(rest, *x, sure), lambda *x: taught(rest, *x, sure), rounds, sure)


@dataclass
class Model:
    text: tuple[np.ndarray, float, float]
    meta: tuple[np.ndarray, float, float]
    prior: float


def _features(batch: pa.RecordBatch, at: dict[str, int]) -> tuple[list, list]:
    lengths = [None if x is None else int(x).bit_length() for x in batch.column(at["n_chars"]).to_pylist()]
    return text_view(batch.column(at["text"])), meta_view(
        batch.column(at["source"]).to_pylist(), batch.column(at["lang"]).to_pylist(), lengths)


COLUMNS = {"text": 1, "source": 2, "lang": 3, "n_chars": 4}


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("text"), F.col("source").cast("string"), F.col("lang").cast("string"),
                       F.col("n_chars").cast("long"))


def _share(rows: int, sample: int, seed: int):
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return draw < min(1.0, sample / max(rows, 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model of ``docs`` with the labels (doc_id, ``label``); None without labels of both kinds."""
    marks = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.min(F.col(label).cast("int")).alias("label")))
    # the sample's bound holds for the ids and labels that travel with the tasks: no text is shuffled to meet them
    known = dict(marks.filter(_share(marks.count(), sample, 21)).select("doc_id", "label").collect())

    def view(batches):
        for batch in batches:
            for piece in T.slices(batch, 1):
                words, meta = _features(piece, COLUMNS)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([known.get(i) for i in piece.column(0).to_pylist()], pa.int32()),
                     pa.array([a.astype("<u2").tobytes() for a, _ in words], pa.binary()),
                     pa.array([v.astype("<f2").tobytes() for _, v in words], pa.binary()),
                     pa.array([m.astype("<u2").tobytes() for m in meta], pa.binary())],
                    ["doc_id", "label", "at", "value", "meta"])

    features = cut_lineage(_columns(docs).mapInArrow(view, "doc_id long, label int, at binary, value binary, meta binary"))
    marked = sorted((r["doc_id"], r["label"], bytes(r["at"]), bytes(r["value"]), bytes(r["meta"]))
                    for r in features.filter("label IS NOT NULL").collect())
    marks_of = np.array([r[1] for r in marked], np.int64)
    held = np.arange(1, len(marked) + 1) % 4 == 0
    if not all(((marks_of[s] == k).any() for s in (held, ~held) for k in (0, 1))):
        return None
    rest = features.filter("label IS NULL").select("at", "value", "meta")

    def partial(work):
        """``work`` on every lot of the unlabelled rows, added up: a part per task reaches the driver."""

        def run(batches):
            total, held_rows = None, []

            def add(total):
                own = work(_dense(held_rows))
                return own if total is None else [x + y for x, y in zip(total, own)]

            for batch in batches:
                for row in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                    held_rows.append(row)
                    if len(held_rows) == LOT:
                        total, held_rows = add(total), []
            if held_rows:
                total = add(total)
            for i, x in enumerate(total or []):
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "part": [x.astype("<f8").tobytes()]})

        def merge(table: pa.Table) -> pa.Table:
            whole = sum(np.frombuffer(x, "<f8") for x in table.column("part").to_pylist())
            return pa.table({"i": table.column("i").slice(0, 1), "part": [whole.tobytes()]})

        schema = "i int, part binary"
        found = rest.mapInArrow(run, schema).groupBy("i").applyInArrow(merge, schema).collect()
        return [np.frombuffer(r["part"], "<f8") for r in sorted(found, key=lambda r: r["i"])]

    def count(history, weights):
        found = partial(lambda views: [sure_counts(views, history, weights, SURE).reshape(-1)])
        return found[0].reshape(2, 2, BINS)

    def teach(history, weights):
        found = partial(lambda views: [np.append(s, n) for s, n in taught(views, history, weights, SURE)])
        return [(x[:-1], x[-1]) for x in found]

    text, meta = exchange(_dense([r[2:] for r in marked]), marks_of, held, rest.count(), count, teach, ROUNDS, SURE)
    share = float((marks_of == 1).mean())
    return Model(text, meta, float(np.log(share / (1 - share))))


def _dense(rows: list[tuple[bytes, bytes, bytes]]) -> list[np.ndarray]:
    """Both views of rows (at, value, meta)."""
    words, meta = np.zeros((len(rows), WORD_BUCKETS + DENSE), np.float32), np.zeros((len(rows), META_BUCKETS + 1), np.float32)
    for i, (a, v, m) in enumerate(rows):
        words[i, np.frombuffer(a, "<u2")] = np.frombuffer(v, "<f2")
        meta[i, np.frombuffer(m, "<u2")] = 1
    return [words, meta]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text_score, meta_score, score): calibrated probabilities of each view and of both."""

    def measure(batches):
        for batch in batches:
            for piece in T.slices(batch, 1):
                words, meta = _features(piece, COLUMNS)
                if model is None:
                    odds = np.zeros((2, piece.num_rows))
                    both = odds[0]
                else:
                    (w, a, b), (m, c, d) = model.text, model.meta
                    odds = np.array([[a * float(v @ w[i]) + b for i, v in words], [c * float(m[i].sum()) + d for i in meta]])
                    both = odds[0] + odds[1] - model.prior
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(sigmoid(odds[0])), pa.array(sigmoid(odds[1])), pa.array(sigmoid(both))],
                    ["doc_id", "text_score", "meta_score", "score"])

    return _columns(docs).mapInArrow(measure, "doc_id long, text_score double, meta_score double, score double")
