"""Likelihood of whole documents under a gated recurrent network with a class-factored output.

Words are counted over all training documents. The most frequent words, ``HEAD`` of them in a small corpus and more with the
fourth root of its size, are in classes of neighbours in frequency; every other word is in one of the tail classes, one for each
halving of the counts, and so are unseen words. The network
(gated recurrent units, truncated backpropagation through time, all in numpy) predicts the class of the next word
and, for head classes, the word within it. Within a tail class a word has its smoothed share of the class's counts,
so the probabilities of all words and one unseen word add up to one. The network starts as the unigram model.
Documents are scored from first to last word; the state is carried over from window to window and batch to batch.

Counts do not fit in a task, so they never go to one: documents are dealt by hash into blocks of bounded bytes, a block
asks for the counts of its distinct words, and words are counted and asked for in buckets of their hashes. A
document then becomes its list of codes (head word or tail class) and two sums. Training takes every training
document once: each is in one of ``ROUNDS`` rounds, and within it in one of as many groups as there are ``LOT`` tokens. A
group learns from its documents in the order of their ids, and after a round the parameters of all groups are averaged. Rounds,
groups and their order come from ids and texts alone, so the model does not depend on how Spark cuts the data.

Defined cases: NULL counts as the empty text, whose one token is the end; equal rows are scored separately; a NULL id is
a training document and comes first; without training documents every token is unseen; an empty table gives an
empty table; only the id and text columns are read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.llm.jaccard_join import _bits, _split
from platewise.llm.language_id import held_out
from platewise.session import cut_lineage

HEAD, CLASSES, TAIL, HIDDEN = 1024, 32, 8, 24  # of a small corpus, see ``Shape``
WIDTH = HEAD // CLASSES
SMALL = 6 << 20  # bytes of text beyond which the head grows
SMOOTH = 0.1
BLOCK_DOCS, BLOCK_BYTES = 2048, 8 << 20
FLUSH = 1 << 21
END = np.uint64(0x5EED0FE4D0FD0C55)
ROUNDS = 3  # each training document is in one of them
LOT = 1 << 20  # tokens of a group, which learns from them at a time
STREAMS = (32, 192, 256)  # fewest and most streams, updates in a lot before there are more streams
SQUARES = 1e-4
SAFE = 40.0  # scores up to here can be raised to powers as they are
SCORED = 1 << 23  # bytes of codes scored side by side
ABREAST = 512  # streams of a step that stay near the core
TEXTS = 1 << 16  # bytes of texts cut into words at a time
PARTS = 8192  # most tasks of a training round; each sums the parameters of its groups


@dataclass(frozen=True)
class Shape:
    """Sizes of a network: classes of head words, words in each, and tail classes."""

    classes: int = CLASSES
    width: int = WIDTH
    tail: int = TAIL

    @property
    def head(self) -> int:
        return self.classes * self.width

    @property
    def arrays(self) -> dict[str, tuple[int, ...]]:
        return {"embed": (self.head + self.tail, 3 * HIDDEN), "recur": (HIDDEN, 3 * HIDDEN), "shift": (HIDDEN,),
                "class": (HIDDEN + 1, self.classes + self.tail), "word": (self.classes, HIDDEN + 1, self.width)}

    @property
    def size(self) -> int:
        return sum(math.prod(s) for s in self.arrays.values())

    @property
    def dtype(self) -> str:
        return "<u2" if self.head + self.tail <= 1 << 16 else "<u4"


SHAPE = Shape()
SIZE = SHAPE.size


def shape_for(size: int) -> Shape:
    """The head for a corpus of ``size`` bytes: a power of two in the fourth root of the size, classes and words balanced."""
    doublings = round(math.log2(max(size / SMALL, 1)) / 4)
    return Shape(CLASSES << (doublings // 2), WIDTH << (doublings - doublings // 2))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, offsets): the words of every row, each row closed by the end token."""
    data, offsets = T.buffer_of(column)
    starts, ends, rows = T.words_of(data, offsets)
    n_rows = len(offsets) - 1
    sizes = np.bincount(rows, minlength=n_rows) + 1
    out = np.concatenate(([0], np.cumsum(sizes)))
    tokens = np.full(int(out[-1]), END, np.uint64)
    tokens[np.arange(len(starts)) + rows] = T.word_hashes(data, starts, ends)
    return tokens, out


# ---------------------------------------------------------------------------------------------- counts


def word_counts(docs: DataFrame, bits: int, head: int = HEAD) -> DataFrame:
    """(bucket, words, counts, total, top, top_counts): the words of ``docs`` (text) counted per hash bucket."""

    def send(held):
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        rows = [(b, words[x:y].tobytes(), counts[x:y].astype("<i8").tobytes()) for b, x, y in _split(words, bits)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "words", "counts"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for piece in T.slices(batch, 0, TEXTS):
                held.append(tokens_of(piece.column(0))[0])
                size += len(held[-1])
                if size > FLUSH:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def add(table: pa.Table) -> pa.Table:
        words, counts = _merge(table.column("words").to_pylist(), table.column("counts").to_pylist())
        top = np.lexsort((words, -counts))[:head]
        return pa.table({
            "bucket": table.column("bucket").slice(0, 1), "words": pa.array([words.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()), "total": [int(counts.sum())], "distinct": [len(words)],
            "top": pa.array([words[top].view(np.int64).tolist()], pa.list_(pa.int64())),
            "top_counts": pa.array([counts[top].tolist()], pa.list_(pa.int64()))})

    return (docs.mapInArrow(count, "bucket int, words binary, counts binary").groupBy("bucket")
            .applyInArrow(add, "bucket int, words binary, counts binary, total long, distinct long, "
                               "top array<long>, top_counts array<long>"))


def _merge(words: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    all_words = np.concatenate([np.frombuffer(x, np.uint64) for x in words])
    all_counts = np.concatenate([np.frombuffer(x, "<i8") for x in counts])
    order = np.argsort(all_words, kind="stable")
    all_words, all_counts = all_words[order], all_counts[order]
    starts = np.flatnonzero(np.concatenate(([True], all_words[1:] != all_words[:-1])))
    return all_words[starts], np.add.reduceat(all_counts, starts)


@dataclass
class Vocabulary:
    """What the model knows of the corpus counts: the head words and the weight of each tail class."""

    total: int
    distinct: int
    words: np.ndarray  # sorted hashes of the head words
    code: np.ndarray  # their codes: rank by frequency
    counts: np.ndarray  # counts by code
    least: int  # count of the rarest head word
    mass: np.ndarray = field(default_factory=lambda: np.zeros(TAIL))  # smoothed counts of each tail class
    shape: Shape = SHAPE

    def tail_class(self, counts: np.ndarray) -> np.ndarray:
        halvings = np.floor(np.log2(max(self.least, 1) / np.maximum(counts, 0.5)))
        return np.clip(halvings, 0, self.shape.tail - 1).astype(np.int64)

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is head, code) of each token."""
        if not len(self.words):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        at = np.searchsorted(self.words, tokens)
        at[at == len(self.words)] = 0
        return self.words[at] == tokens, self.code[at]


def vocabulary(counts: DataFrame, shape: Shape = SHAPE) -> Vocabulary:
    """The head words and the sums of the tail classes; nothing larger reaches the driver."""
    sums = counts.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    top = (counts.select(F.explode(F.arrays_zip("top", "top_counts")).alias("t"))
           .select(F.col("t.top").alias("word"), F.col("t.top_counts").alias("n"))
           .orderBy(F.desc("n"), "word").limit(shape.head).collect())
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    known = np.array([r["n"] for r in top], np.int64)
    least = int(known[-1]) if len(known) else 1
    tail = max(TAIL, int(math.log2(2 * least)) + 1)  # one class for each halving down to unseen words
    vocab = Vocabulary(sums["n"] or 0, sums["v"] or 0, hashes[order], np.arange(len(hashes))[order], known, least,
                       np.zeros(tail), replace(shape, tail=tail))

    def weigh(batches):
        mass = np.zeros(tail)
        for batch in batches:
            for words, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(own, "<i8")
                rare = own[~vocab.look_up(np.frombuffer(words, np.uint64))[0]]
                mass += np.bincount(vocab.tail_class(rare), rare + SMOOTH, tail)
        yield pa.RecordBatch.from_pydict({"tail": list(range(tail)), "mass": mass.tolist()})

    for r in counts.select("words", "counts").mapInArrow(weigh, "tail long, mass double").groupBy("tail").agg(
            F.sum("mass").alias("mass")).collect():
        vocab.mass[r["tail"]] = r["mass"]
    vocab.mass[vocab.tail_class(np.zeros(1))] += SMOOTH  # one unseen word
    return vocab


def words_by_block(blocks: np.ndarray, sizes: np.ndarray, tokens: np.ndarray):
    """(block, its distinct tokens) of rows that lie one after the other, ``sizes`` tokens each."""
    order = np.argsort(blocks, kind="stable")
    own = sizes[order]
    after = np.cumsum(own)
    tokens = tokens[np.repeat((np.cumsum(sizes) - sizes)[order] - (after - own), own) + np.arange(len(tokens))]
    blocks = blocks[order]
    lasts = np.flatnonzero(np.concatenate((blocks[1:] != blocks[:-1], [True])))
    for block, part in zip(blocks[lasts].tolist(), np.split(tokens, after[lasts[:-1]])):
        yield block, np.unique(part)


def encoded(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, bits: int, rows: int, size: int) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, tail_score, codes) of every row of ``docs`` (id, held_out, text).

    ``rows`` and ``size`` (bytes) of the texts say how many blocks there are.
    """
    n_blocks = max(1, rows // BLOCK_DOCS, size // BLOCK_BYTES)
    placed = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "id", "held_out", "text")
    schema = "bucket int, block int, words binary, counts binary"

    def ask(batches):
        held, size = [], 0

        def send():
            found = []
            for block, words in words_by_block(*map(np.concatenate, zip(*held))):
                words = words[~vocab.look_up(words)[0]]
                found += [(b, block, words[x:y].tobytes(), None) for b, x, y in _split(words, bits)] if len(words) else []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in found], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                ["bucket", "block", "words", "counts"])

        for batch in batches:
            for piece in T.slices(batch, 1, TEXTS):
                tokens, offsets = tokens_of(piece.column(1))
                held.append((piece.column(0).to_numpy(), np.diff(offsets), tokens))
                size += len(tokens)
                if size > FLUSH:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    def answer(table: pa.Table) -> pa.Table:
        rows_of = list(zip(*[table.column(c).to_pylist() for c in ("block", "words", "counts")]))
        known = [(np.frombuffer(w, np.uint64), np.frombuffer(c, "<i8")) for b, w, c in rows_of if b < 0]
        words, own = known[0] if known else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        blocks, asked, given = [], [], []
        for block, wanted, _ in rows_of:
            if block >= 0:
                wanted = np.frombuffer(wanted, np.uint64)
                at = np.searchsorted(words, wanted)
                at[at == len(words)] = 0
                found = np.where(words[at] == wanted, own[at], 0) if len(words) else np.zeros(len(wanted), np.int64)
                keep = found > 0
                blocks.append(block)
                asked.append(wanted[keep].tobytes())
                given.append(found[keep].astype("<i8").tobytes())
        return pa.table({"block": pa.array(blocks, pa.int32()), "words": pa.array(asked, pa.binary()),
                         "counts": pa.array(given, pa.binary())})

    def encode(key, left: pa.Table, right: pa.Table) -> pa.Table:
        words, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if right.num_rows:
            words = np.concatenate([np.frombuffer(x, np.uint64) for x in right.column("words").to_pylist()])
            own = np.concatenate([np.frombuffer(x, "<i8") for x in right.column("counts").to_pylist()])
            order = np.argsort(words, kind="stable")
            words, own = words[order], own[order]
        parts = [_encode(piece, words, own, vocab) for batch in left.to_batches() for piece in T.slices(batch, 3, TEXTS)]
        return pa.Table.from_batches(parts, ENCODED) if parts else ENCODED.empty_table()

    asked = placed.select("block", "text").mapInArrow(ask, schema)
    known = counts.select("bucket", F.lit(-1).alias("block"), "words", "counts")
    answers = asked.unionByName(known).groupBy("bucket").applyInArrow(answer, "block int, words binary, counts binary")
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        encode, "id long, held_out boolean, n_tokens long, n_known long, base_score double, tail_score double, codes binary")


ENCODED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("tail_score", pa.float64()), ("codes", pa.binary())])


def _encode(piece: pa.RecordBatch, words: np.ndarray, own: np.ndarray, vocab: Vocabulary) -> pa.RecordBatch:
    tokens, offsets = tokens_of(piece.column(3))
    head, code = vocab.look_up(tokens)
    counts = np.zeros(len(tokens), np.int64)
    counts[head] = vocab.counts[code[head]]
    tail = np.flatnonzero(~head)
    if len(words):
        at = np.searchsorted(words, tokens[tail])
        at[at == len(words)] = 0
        counts[tail] = np.where(words[at] == tokens[tail], own[at], 0)
    base = np.log10((counts + SMOOTH) / (vocab.total + SMOOTH * (vocab.distinct + 1)))
    share = np.zeros(len(tokens))
    if len(tail):
        kind = vocab.tail_class(counts[tail])
        share[tail] = np.log10((counts[tail] + SMOOTH) / vocab.mass[kind])
        code[tail] = vocab.shape.head + kind
    codes = code.astype(vocab.shape.dtype)
    return pa.RecordBatch.from_arrays(
        [piece.column(1), piece.column(2), pa.array(np.diff(offsets)), pa.array(T.per_row(counts > 0, offsets)),
         pa.array(np.add.reduceat(base, offsets[:-1])), pa.array(np.add.reduceat(share, offsets[:-1])),
         pa.array([codes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], schema=ENCODED)


# ---------------------------------------------------------------------------------------------- network

def views(flat: np.ndarray, shape: Shape = SHAPE) -> dict[str, np.ndarray]:
    """Parameters by name; weights and biases (``_w``, ``_b``) of classes and words also together."""
    out, at = {}, 0
    for name, sizes in shape.arrays.items():
        out[name] = flat[at:at + math.prod(sizes)].reshape(sizes)
        at += math.prod(sizes)
    for name in ("class", "word"):
        out[f"{name}_w"], out[f"{name}_b"] = out[name][..., :HIDDEN, :], out[name][..., HIDDEN, :]
    return out


def initial(vocab: Vocabulary, seed: int = 5) -> np.ndarray:
    """Parameters of a network that ignores its state and gives the unigram probabilities."""
    shape = vocab.shape
    flat = np.zeros(shape.size, np.float32)
    p = views(flat, shape)
    rng = np.random.default_rng(seed)
    p["embed"][:] = rng.normal(0, 0.3, p["embed"].shape)
    p["recur"][:] = rng.normal(0, 0.2, p["recur"].shape)
    counts = np.full(shape.head, SMOOTH)
    counts[:len(vocab.counts)] += vocab.counts
    within = counts.reshape(shape.classes, shape.width)
    p["word_b"][:] = np.log(within / within.sum(axis=1, keepdims=True))
    both = np.concatenate((within.sum(axis=1), np.maximum(vocab.mass, SMOOTH)))
    p["class_b"][:] = np.log(both / both.sum())
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of -x, in place."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def recurrence(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``advance`` needs of the parameters: signs and scales of the inputs of each gate, recurrent weights and shift with them."""
    scale = np.repeat(np.array([-1, -1, -2], p["recur"].dtype), HIDDEN)
    turned = np.ascontiguousarray((p["recur"] * np.repeat(np.array([-1, -1, 1], scale.dtype), HIDDEN)).T)
    return p["embed"], scale[:, None], turned, p["shift"][:, None]


def advance(model: tuple, h: np.ndarray, x: np.ndarray, zr: np.ndarray, n: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Next states [HIDDEN, streams] from states and scaled inputs [3 * HIDDEN, streams]; gates are left in zr, n and inner.

    Streams lie side by side in memory, so that every step works on whole rows.
    """
    g = model[2] @ h
    zr[:] = g[:2 * HIDDEN]
    zr += x[:2 * HIDDEN]
    _sigmoid(zr)
    np.add(g[2 * HIDDEN:], model[3], out=inner)
    np.multiply(zr[HIDDEN:], inner, out=n)
    n *= -2
    n += x[2 * HIDDEN:]
    _sigmoid(n)  # the hyperbolic tangent of x is twice that of 2x, less one
    n *= 2
    n -= 1
    after = h - n
    after *= zr[:HIDDEN]
    after += n
    return after


def inputs_of(model: tuple, codes: np.ndarray) -> np.ndarray:
    """Scaled inputs [..., 3 * HIDDEN, streams] of codes [..., streams]."""
    x = np.take(model[0], codes, axis=0)
    return np.multiply(x.swapaxes(-1, -2), model[1], order="C")


def step(p: dict, h: np.ndarray, code: np.ndarray) -> tuple:
    """(next state, gates) after reading a code."""
    model = recurrence(p)
    zr, n, inner = (np.empty((k * HIDDEN, len(code)), h.dtype) for k in (2, 1, 1))
    after = advance(model, h.T, inputs_of(model, code), zr, n, inner)
    return after.T, (zr[:HIDDEN].T, zr[HIDDEN:].T, n.T, inner.T)


def _softmax(scores: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability at one place, sum) of every row; ``scores`` become probabilities times the sum."""
    if scores.size and max(scores.max(), -scores.min()) > SAFE:
        scores -= scores.max(axis=1, keepdims=True)
    found = scores[np.arange(len(at)), at]
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], scores.dtype)
    return found - np.log(total), total


def output(p: dict, h: np.ndarray, code: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each code given its state; with ``grad`` also adds gradients and returns dh.

    Rows are taken in the order of their classes, so that the words of a class meet its rows as one slice. States get a
    one behind them, which meets the biases.
    """
    classes, _, width = p["word"].shape
    head = classes * width
    kind = np.where(code < head, code // width, code - head + classes).astype(np.uint16 if classes < 1 << 15 else np.int64)
    order = np.argsort(kind, kind="stable")
    full = np.ones((len(h), HIDDEN + 1), h.dtype)
    full[:, :HIDDEN] = np.take(h, order, axis=0)
    kind, code = kind[order].astype(np.int64), code[order]
    scores = full @ p["class"]
    logs, totals = _softmax(scores, kind)
    cuts = np.searchsorted(kind, np.arange(classes + 1))
    known = cuts[-1]
    slices = [(c, slice(cuts[c], cuts[c + 1])) for c in np.flatnonzero(np.diff(cuts)).tolist()]
    words = np.empty((known, width), scores.dtype)
    for c, at in slices:
        np.matmul(full[at], p["word"][c], out=words[at])
    word = code[:known] - kind[:known] * width
    if known:
        own_logs, sums = _softmax(words, word)
        logs[:known] += own_logs
    found = np.empty_like(logs)
    found[order] = logs
    if grad is None:
        return found, None
    # rows of scores and words stay unscaled: what they meet is divided by their sums
    totals, rows = totals[:, None], np.arange(len(kind))
    scores[rows, kind] -= totals[:, 0]
    grad["class"] += (full / totals).T @ scores
    own = scores @ p["class_w"].T
    own /= totals
    if known:
        words[rows[:known], word] -= sums
        sums = sums[:, None]
        shares, within = full[:known] / sums, np.empty((known, HIDDEN), own.dtype)
        for c, at in slices:
            grad["word"][c] += shares[at].T @ words[at]
            np.matmul(words[at], p["word_w"][c].T, out=within[at])
        within /= sums
        own[:known] += within
    back = np.empty_like(own)
    back[order] = own
    return found, back


def log_likelihoods(flat: np.ndarray, docs: list[np.ndarray], window: int = 1 << 13, shape: Shape = SHAPE) -> np.ndarray:
    """Natural log-likelihood of whole code sequences, longest first side by side, the state never cut."""
    p = views(flat, shape)
    model = recurrence(p)
    lengths = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    codes = np.concatenate([docs[i] for i in order] + [np.zeros(0, "<u2")]).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(len(docs))
    h = np.zeros((HIDDEN, len(docs)), np.float32)
    gates = [np.empty((k * HIDDEN, min(len(docs), ABREAST)), np.float32) for k in (2, 1, 1)]
    states, targets, held = [], [], 0

    def flush():
        found, _ = output(p, np.concatenate([x.T for x in states]), np.concatenate(targets))
        out[:len(targets[0])] += np.bincount(np.concatenate([rows[:len(x)] for x in targets]), found, len(targets[0]))

    rows = np.arange(len(docs))
    running = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # documents longer than each place
    for t, active in enumerate(running.tolist()):
        code = codes[begin[:active] + t]
        if active < h.shape[1]:
            h = h[:, :active]
        if active < gates[0].shape[1]:
            gates = [np.empty((len(x), active), np.float32) for x in gates]
        states.append(h)
        targets.append(code)
        held += active
        if active <= ABREAST:
            h = advance(model, h, inputs_of(model, code), *gates)
        else:
            after = np.empty_like(h)
            for start in range(0, active, ABREAST):
                some = slice(start, min(start + ABREAST, active))
                after[:, some] = advance(model, h[:, some], inputs_of(model, code[some]), *[x[:, :some.stop - start] for x in gates])
            h = after
        if held >= window:
            flush()
            states, targets, held = [], [], 0
    if held:
        flush()
    found = np.empty(len(docs))
    found[order] = out
    return found


def learn(flat: np.ndarray, docs: list[np.ndarray], rate: float = 0.2, streams: int | None = None, window: int = 24,
          squares: np.ndarray | None = None, shape: Shape = SHAPE) -> tuple[np.ndarray, int]:
    """(parameters, tokens seen) after one pass of truncated backpropagation over every token of code sequences.

    Documents follow one another in parallel streams, by default more of them for more tokens (``STREAMS``); the state is
    carried from window to window and starts anew with each document. Steps are scaled by the root of the summed squares
    of past gradients, which are added to ``squares``. Inputs of codes that a window does not hold have no gradient there and are
    not visited.
    """
    flat = flat.copy()
    whole = np.concatenate([*docs, np.zeros(0, "<u2")]).astype(np.int64)
    seen = len(whole)
    if not seen:
        return flat, 0
    fresh = np.zeros(seen, bool)
    lengths = np.array([len(d) for d in docs], np.int64)
    fresh[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    least, most, updates = STREAMS
    streams = min(most, max(least, seen // (window * updates))) if streams is None else streams
    streams = max(1, min(streams, seen // window))
    steps = -(-seen // streams)
    spare = steps * streams - seen  # places after the last token, which teach nothing
    whole, fresh = (np.concatenate((x, np.zeros(spare, x.dtype))).reshape(streams, steps) for x in (whole, fresh))
    real = (np.arange(steps * streams) < seen).reshape(streams, steps)
    p, squares = views(flat, shape), np.full(shape.size, SQUARES, np.float32) if squares is None else squares
    gradient = np.empty(shape.size, np.float32)
    grad, past = views(gradient, shape), views(squares, shape)
    dense = slice(p["embed"].size, None)  # all parameters but the inputs of codes
    h = np.zeros((HIDDEN, streams), np.float32)

    def stepped(gradient, squares):
        """The change along a sum of gradients, whose squares are added."""
        gradient /= len(used)
        np.clip(gradient, -1, 1, out=gradient)
        squares += gradient * gradient
        gradient *= rate
        gradient /= np.sqrt(squares)
        return gradient

    for start in range(0, steps, window):
        codes = np.ascontiguousarray(whole[:, start:start + window].T)
        keep = (~fresh[:, start:start + window]).T.astype(np.float32)
        length = len(codes)
        model = recurrence(p)
        x = inputs_of(model, codes)
        before, n, inner = (np.empty((length, HIDDEN, streams), np.float32) for _ in range(3))
        zr = np.empty((length, 2 * HIDDEN, streams), np.float32)
        for t in range(length):
            np.multiply(h, keep[t], out=before[t])
            h = advance(model, before[t], x[t], zr[t], n[t], inner[t])
        gradient[dense] = 0
        used = np.flatnonzero(real[:, start:start + window].T.reshape(-1))
        flat_codes = codes.reshape(-1)
        states = before.transpose(0, 2, 1).reshape(-1, HIDDEN)
        if len(used) == len(states):
            back = output(p, states, flat_codes, grad)[1]
        else:
            back = np.zeros_like(states)
            back[used] = output(p, states[used], flat_codes[used], grad)[1]
        back = np.ascontiguousarray(back.reshape(length, streams, HIDDEN).transpose(0, 2, 1))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        # what the gradient of the state after a step is multiplied by: for the gates' sums, and for the new state before ``r``
        parts = np.empty((length, 4, HIDDEN, streams), np.float32)
        np.multiply(before - n, z * (1 - z), out=parts[:, 0])
        np.multiply(1 - z, 1 - n * n, out=parts[:, 3])
        np.multiply(parts[:, 3], r, out=parts[:, 2])
        np.multiply(parts[:, 2], inner * (1 - r), out=parts[:, 1])
        later = np.zeros_like(h)
        for t in range(length - 1, -1, -1):
            # ``later`` is the gradient of the state after step t
            parts[t] *= later
            later *= z[t]
            later += p["recur"] @ parts[t, :3].reshape(3 * HIDDEN, streams)
            later += back[t]
            later *= keep[t]
        grad["recur"][:] = np.matmul(before, parts[:, :3].reshape(length, 3 * HIDDEN, streams).transpose(0, 2, 1)).sum(axis=0)
        grad["shift"][:] = parts[:, 2].sum(axis=(0, 2))
        order = np.argsort(flat_codes.astype(np.uint16) if shape.dtype == "<u2" else flat_codes, kind="stable")
        ranked = flat_codes[order]
        firsts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        inputs = np.empty((length, streams, 3 * HIDDEN), np.float32)
        inputs[:, :, :2 * HIDDEN] = parts[:, :2].reshape(length, 2 * HIDDEN, streams).transpose(0, 2, 1)
        inputs[:, :, 2 * HIDDEN:] = parts[:, 3].transpose(0, 2, 1)
        met = ranked[firsts]
        sums = np.add.reduceat(np.take(inputs.reshape(-1, 3 * HIDDEN), order, axis=0), firsts)
        own = past["embed"][met]
        p["embed"][met] -= stepped(sums, own)
        past["embed"][met] = own
        flat[dense] -= stepped(gradient[dense], squares[dense])
    return flat, seen


def trained(codes: DataFrame, flat: np.ndarray, rounds: int = ROUNDS, chunks: int = 16, shape: Shape = SHAPE,
            lot: int = LOT) -> np.ndarray:
    """Parameters after ``rounds`` of learning in groups and averaging; every row of ``codes`` (id, codes) is in one round.

    A group holds about ``lot`` tokens. A task takes its groups one by one and sums their parameters, and the sums of
    tasks are added in two levels, always in the same order.
    """
    cuts = [shape.size * i // chunks for i in range(chunks + 1)]
    width = np.dtype(shape.dtype).itemsize
    schema = "chunk int, task int, weight double, part binary"
    tokens = (codes.agg(F.sum(F.octet_length("codes")).alias("n")).first()["n"] or 0) // width
    groups = max(1, round(tokens / rounds / lot))
    tasks = min(groups, PARTS)
    dealt = codes.select("codes", F.pmod(F.xxhash64("id", "codes"), F.lit(groups)).alias("group"), "id",
                         F.pmod(F.xxhash64("id", F.lit(3)), F.lit(rounds)).alias("turn"))
    for turn in range(rounds):
        part = (dealt.filter(F.col("turn") == turn).repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int"))
                .sortWithinPartitions("group", "id", "codes").select("group", "codes"))

        @T.tidy
        def run(batches, flat=flat):
            total, weight, task = np.zeros(shape.size), 0, 0
            for group, docs in _groups(batches, shape.dtype):
                found, seen = learn(flat, docs, shape=shape)
                total += seen * found.astype(np.float64)
                weight += seen
                task = group % tasks
            if weight:
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(range(chunks), pa.int32()), "task": pa.array([task] * chunks, pa.int32()),
                    "weight": [float(weight)] * chunks,
                    "part": pa.array([total[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("task")
            total = sum(np.frombuffer(x) for x in table.column("part").to_pylist())
            return pa.table({"chunk": table.column("chunk").slice(0, 1), "task": table.column("task").slice(0, 1),
                             "weight": [sum(table.column("weight").to_pylist())], "part": pa.array([total.tobytes()], pa.binary())})

        sums = part.mapInArrow(run, schema).groupBy("chunk", F.pmod("task", F.lit(64)).alias("some")).applyInArrow(add, schema)
        found = sums.groupBy("chunk").applyInArrow(add, schema).collect()
        if found:
            flat = np.concatenate([np.frombuffer(r["part"]) / r["weight"] for r in sorted(found, key=lambda r: r["chunk"])])
            flat = flat.astype(np.float32)
    return flat


def _groups(batches, dtype: str):
    """(group, its code sequences) of rows (group, codes) in the order of groups."""
    current, held = None, []
    for batch in batches:
        for group, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if group != current and held:
                yield current, held
                held = []
            current = group
            held.append(np.frombuffer(x, dtype))
    if held:
        yield current, held


def scores(docs: DataFrame, text: str = "text", id_column: str = "doc_id", parts: int = 10, part: int = 0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, in log10."""
    source = docs.select(F.col(id_column).cast("long").alias("id"), held_out(F.col(id_column), parts, part).alias("held_out"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = source.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_bytes = size["bytes"] or 0
    bits, shape = _bits(n_bytes // 40), shape_for(n_bytes)
    counts = cut_lineage(word_counts(source.filter(~F.col("held_out")).select("text"), bits, shape.head))
    vocab = vocabulary(counts, shape)
    codes = cut_lineage(encoded(source, counts, vocab, bits, size["rows"], n_bytes))
    total, shape = vocab.total, vocab.shape
    flat = trained(codes.filter(~F.col("held_out")), initial(vocab), shape=shape)

    @T.tidy
    def score(batches):
        for batch in batches:
            for piece in T.slices(batch, 6, SCORED):
                found = log_likelihoods(flat, [np.frombuffer(x, shape.dtype) for x in piece.column(6).to_pylist()], shape=shape)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:4], pa.array([total] * piece.num_rows, pa.int64()), piece.column(4),
                     pa.array(found / math.log(10) + piece.column(5).to_numpy())],
                    [id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return codes.mapInArrow(score, f"`{id_column}` long, held_out boolean, n_tokens long, n_known long, "
                                   "train_tokens long, base_score double, score double")
