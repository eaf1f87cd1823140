"""Best-fit packing planned over a histogram of lengths.

All that best fit needs is how many pieces there are of each length, at most ``capacity`` numbers. The plan is made
on those counts: pieces of one length go, many at a time, into the open sequences with the least room that still
holds them. The plan is a list of runs: the pieces with ranks ``first .. last`` of a length take the places of a run
of sequences. Pieces are then ranked within their length and look up their place. The rank comes from counts per
(length, salt) and a window within each, so a length that a third of all pieces share is spread over tasks.

Defined cases: NULL counts as the empty text, which holds the end id alone; repeated rows are packed separately; an
empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.llm.ordering import default_parts
from platewise.llm.wordbpe import encode_texts, texts_of
from platewise.session import cut_lineage

CAPACITY = 4096


def token_pieces(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, text: str = "text",
                 id_column: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids_crc32): every text's ids and the end id, cut only where longer than ``capacity``."""
    part = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text"))
    kind = part.schema["__id"].dataType.simpleString()
    step = 4 * capacity

    @T.tidy
    def cut(batches):
        for batch in batches:
            for rows in T.slices(batch, 1):
                own, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode_texts(tokenizer, texts_of(rows.column(1)), end)):
                    for k, at in enumerate(range(0, len(ids), step)):
                        one = ids[at:at + step]
                        own.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["__id", "piece", "start", "length", "ids_crc32"])

    found = part.mapInArrow(cut, f"__id {kind}, piece int, start long, length long, ids_crc32 long")
    return found.withColumnRenamed("__id", id_column)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, per sequence, first offset), and the number of sequences.

    Lengths are taken from the longest down. Open sequences are kept as runs by their room; a run of which only a
    part is needed is divided. So the work follows the number of lengths and runs, not that of pieces.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in sorted(r for r in rooms if r >= length):
            waiting = rooms.pop(room)
            each = room // length
            while waiting and left:
                first, size = waiting.pop()
                full = min(size, left // each)
                for use, per in ((full, each), (1 if full < size and 0 < left - full * each < each else 0, left - full * each)):
                    if use:
                        runs.append((length, rank, use * per, first, per, capacity - room))
                        rooms.setdefault(room - per * length, []).append((first, use))
                        first, size, left, rank = first + use, size - use, left - use * per, rank + use * per
                if size:
                    waiting.append((first, size))
            if waiting:
                rooms.setdefault(room, []).extend(waiting)
            if not left:
                break
        each = capacity // length
        for use, per in ((left // each, each), (1 if left % each else 0, left % each)):
            if use:
                runs.append((length, rank, use * per, sequences, per, 0))
                rooms.setdefault(capacity - per * length, []).append((sequences, use))
                rank, sequences = rank + use * per, sequences + use
        rooms.pop(0, None)
    return np.array(runs, np.int64).reshape(-1, 6), sequences


def ranked(pieces: DataFrame, order: list[str], salts: int) -> DataFrame:
    """``pieces`` with the 0-based ``rank`` of each within its length, by salted counts and windows."""
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    inside = Window.partitionBy("length", "__salt").orderBy(*order)
    return (salted.withColumn("__local", F.row_number().over(inside)).join(offsets, ["length", "__salt"])
            .withColumn("rank", F.col("__before") + F.col("__local") - 1).drop("__salt", "__before", "__local"))


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``length`` is from 1 to ``capacity``; ``order`` identifies a piece.

    The histogram and the plan on the driver are bounded by ``capacity``, whatever the number of pieces.
    """
    names = list(pieces.columns)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    widest = max(counts.values(), default=0) + 1
    keyed = ranked(pieces, order, default_parts(pieces)).select(*names, "rank")
    at, ends = names.index("length"), runs[:, 0].astype(object) * widest + runs[:, 1]
    starts = np.array(list(ends), np.int64)

    def place(batches):
        for batch in batches:
            length = batch.column(at).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            run = runs[np.searchsorted(starts, length * widest + rank, side="right") - 1]
            within = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(run[:, 3] + within // run[:, 4]),
                 pa.array(run[:, 5] + within % run[:, 4] * length)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return keyed.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, text: str = "text",
                   id_column: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece. Texts are encoded once."""
    pieces = cut_lineage(token_pieces(docs, tokenizer, end, capacity, text, id_column))
    return pack(pieces, [id_column, "piece", "ids_crc32"], capacity)
