"""Vectors compressed to short codes: the nearest entry of a trained codebook for each of their parts.

Components become whole numbers, floor(4096 * x), so that every distance, sum and mean is exact and independent of the
order of rows. A codebook of ``ENTRIES`` vectors per part position starts from the vectors with the smallest ids and
is refined for ``ROUNDS`` rounds: assign every part to its nearest entry, replace each entry by the floored mean of its
parts. The entries of a round travel with the tasks (parts x entries x width numbers, independent of the rows), and
one row per part, entry and component comes back.

The nearest entry is found through memoised grid cells. A part lies in a box of side 2**CELL_BITS. For each box that
occurs, a task remembers the entries that can be nearest to some point of it: those whose smallest distance to the box
is not above the smallest of all entries' largest distances. Only these are evaluated exactly, so the result, ties
to the lower index included, is that of comparing with every entry. The memory is bounded: a table of ``CACHE`` boxes
is emptied when full.

Defined cases: a vector that is NULL or holds a NULL, NaN or infinite component is dropped; a NULL id is larger than
all others, rows with equal ids are ordered by their numbers; with fewer rows than entries the codebooks are shorter;
an empty table gives no row; further columns are not read. A component beyond +-32768, where squared distances could
leave 64 bits, vectors of differing widths and widths that are no multiple of the number of parts are errors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.session import cut_lineage

SCALE, LIMIT = 4096, 1 << 27
PARTS, ENTRIES, ROUNDS = 8, 16, 6
CELL_BITS = 9
CACHE = 50_000
ROWS = 8192  # vectors that are looked at together in a task


class Cells:
    """The entries of one part position, and which of them can be nearest within each box met so far."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries, self.bits, self.found, self.evaluated = entries, bits, {}, 0

    def candidates(self, boxes: np.ndarray) -> np.ndarray:
        """Which entries are not dominated across each box."""
        low = (boxes << self.bits)[:, None, :]
        high = low + (1 << self.bits) - 1
        below, above = low - self.entries, self.entries - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(low - self.entries), np.abs(high - self.entries)) ** 2).sum(2)
        return least <= most.min(1)[:, None]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every point and the squared distance to it."""
        boxes = np.ascontiguousarray(points >> self.bits)
        keys, first, own = np.unique(boxes.view(f"V{boxes.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        keys = [key.tobytes() for key in keys]
        new = [i for i, key in enumerate(keys) if key not in self.found]
        if len(self.found) + len(new) > CACHE:
            self.found.clear()
            new = list(range(len(keys)))
        if new:
            self.found.update(zip([keys[i] for i in new], self.candidates(boxes[first[new]])))
        row, entry = np.nonzero(np.array([self.found[key] for key in keys])[own.ravel()])
        self.evaluated += len(row)
        distance = ((points[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(len(points)))
        best = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == best[row])  # entries ascend within a row: the first hit is the lowest index
        at = hits[np.searchsorted(row[hits], np.arange(len(points)))]
        return entry[at], best


def numbers_of(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of whole numbers as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors have from {sizes.min()} to {sizes.max()} components")
    matrix = column.flatten().to_numpy().reshape(len(column), -1)
    if matrix.size and not -LIMIT <= matrix.min() <= matrix.max() < LIMIT:
        raise ValueError("a component lies beyond +-32768")
    return matrix


def whole_numbers(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """(*keep, numbers) of the vectors whose components are all there and finite."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.filter(F.col(vector).isNotNull() & finite).select(
        *keep, F.transform(x, lambda v: F.floor(v * SCALE)).cast("array<bigint>").alias("numbers"))


def first_books(numbers: DataFrame, id_column: str, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids."""
    rows = numbers.orderBy(F.col(id_column).asc_nulls_last(), "numbers").select("numbers").limit(entries).collect()
    x = np.array([r[0] for r in rows], np.int64)
    if len(x) and (x.shape[1] % parts or not x.shape[1]):
        raise ValueError(f"{x.shape[1]} components cannot be cut into {parts} equal parts")
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2) if len(x) else np.zeros((parts, 0, 0), np.int64)


def _looked_up(column: pa.Array, books: np.ndarray, cells: list[Cells]):
    """The numbers of a batch by part, the index of each part's nearest entry and its distance."""
    x = numbers_of(column)
    if x.shape[1] != books.shape[0] * books.shape[2]:
        raise ValueError(f"a vector has {x.shape[1]} components, the codebooks have {books.shape[0] * books.shape[2]}")
    x = x.reshape(len(x), books.shape[0], -1)
    found = [cell.nearest(np.ascontiguousarray(x[:, p])) for p, cell in enumerate(cells)]
    return x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def refine(numbers: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the floored mean of the parts nearest to each entry; entries without parts stay."""
    parts, entries, width = books.shape

    def sums(batches):
        cells = [Cells(book) for book in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x, index, _ = _looked_up(batch.column(0).slice(start, ROWS), books, cells)
                for p in range(parts):
                    mine = (index[:, p, None] == np.arange(entries)).astype(np.int64)
                    count[p] += mine.sum(0)
                    total[p] += mine.T @ x[:, p]
        p, e, w = np.nonzero(np.broadcast_to(count[:, :, None], total.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (p, e, w, count[p, e], total[p, e, w])], ["p", "e", "w", "n", "total"])

    found = numbers.select("numbers").mapInArrow(sums, "p long, e long, w long, n long, total long")
    # sums of all tasks in 38 digits: 64 bits hold those of one task only
    new = books.copy()
    for r in found.groupBy("p", "e", "w").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
        new[r["p"], r["e"], r["w"]] = int(r["total"]) // r["n"]
    return new


def fit(numbers: DataFrame, id_column: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) learned from all rows of ``whole_numbers``."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: from 1 to 256 entries")
    books = first_books(numbers, id_column, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = refine(numbers, books)
    return books


def encode(numbers: DataFrame, books: np.ndarray, keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """(*keep, code, error): two hex digits per part, and the squared distance to what the code stands for."""
    n = len(keep)

    def coded(batches):
        cells = [Cells(book) for book in books]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                _, index, distance = _looked_up(piece.column(n), books, cells)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:n], pa.array([row.tobytes().hex() for row in index.astype(np.uint8)], pa.string()),
                     pa.array(distance.sum(1))], [*keep, "code", "error"])

    part = numbers.select(*keep, "numbers")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1])
    return part.mapInArrow(coded, f"{kept}, code string, error long")


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, in the units of the input, at the middle of a number's step."""
    index = np.array([list(bytes.fromhex(code)) for code in codes], np.int64).reshape(len(codes), books.shape[0])
    return (books[np.arange(books.shape[0]), index].reshape(len(codes), -1) + 0.5) / SCALE


def digest_of(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector kept.

    Errors are summed by label before the shuffle and joined back by label, a join whose large partitions Spark
    splits, so a label of a third of all rows does no harm.
    """
    numbers = cut_lineage(whole_numbers(df, vector, (id_column, label)))
    books = fit(numbers, id_column)
    coded = cut_lineage(encode(numbers, books, (id_column, label)))
    sums = coded.groupBy(label).agg(F.sum("error").alias("label_error")).select(F.col(label).alias("own_label"), "label_error")
    return coded.join(sums, F.col(label).eqNullSafe(F.col("own_label")), "left").select(
        id_column, "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
