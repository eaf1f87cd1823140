"""Byte-level BPE by overlapping chunks, and its decoding.

A text longer than ``chunk`` characters is cut into windows that overlap. Each window is split into pre-tokens and
encoded in a task of its own, from its first character on. Two neighbours are stitched at the first place where both
have a pre-token boundary: the pattern never looks behind, so from a common boundary on both see the same pre-tokens.
A pre-token that touches a window's end is not trusted. Where an overlap has no common boundary, the two windows are
split again as one. Shorter texts are a single window.

Defined cases: NULL counts as the empty text, which has no ids; equal rows are encoded separately and all
returned; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T

CHUNK = 1 << 16
OVERLAP = 1 << 11
CACHE = 300_000


@functools.lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> tuple:
    import regex
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _Ids(encoding), _Ids(encoding), regex.compile(pattern), {i: b for b, i in ranks.items()}


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class _Ids(dict):
    """Ids, as little-endian 32-bit bytes, of what stands between two certain boundaries; emptied when full."""

    def __init__(self, encoding) -> None:
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        ids = _packed(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    """Encoder and decoder of one rank file; every task makes its own."""

    #: Before a space or line feed that follows no other white space, a pre-token always begins.
    UNCERTAIN = re.compile(r"\s[ \n]")

    def __init__(self, path: str, pattern: str) -> None:
        self.ids, self.units, self.pattern, self.bytes_of = _codec(path, pattern)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit bytes."""
        if self.UNCERTAIN.search(text):
            return b"".join(map(self.ids.__getitem__, self.pattern.findall(text)))
        units: list[str] = []
        for i, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            units.append("\n" + first if i else first)
            units.extend([" " + word for word in rest])
        return b"".join(map(self.units.__getitem__, units))

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def window(self, text: str, begin: int, final: bool) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Pre-token boundaries in the whole text, ids before each boundary, and the ids of one window."""
        pieces = self.pattern.findall(text)
        if not final and pieces:
            pieces.pop()  # it touches the end
        found = list(map(self.ids.__getitem__, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(len, found), np.int64, len(pieces)) // 4
        bounds = begin + np.concatenate(([0], np.cumsum(lengths)))
        return bounds, np.concatenate(([0], np.cumsum(counts))), b"".join(found)

    def stitch(self, chunks: Iterable[tuple[int, str, np.ndarray, np.ndarray, bytes, bool]]) -> bytes:
        """Join windows (begin, text, bounds, counts, ids, final) of one text in order."""
        out: list[bytes] = []
        left, cut = None, 0
        for right in chunks:
            if left is not None:
                begin, text, bounds, counts, ids, _ = left
                common = np.intersect1d(bounds[bounds >= max(right[0], cut)], right[2], assume_unique=True)
                if len(common):
                    a, b = (counts[np.searchsorted(bounds, x)] for x in (cut, common[0]))
                    out.append(ids[4 * a:4 * b])
                    cut = int(common[0])
                else:
                    text = text[:right[0] - begin] + right[1]
                    right = (begin, text, *self.window(text, begin, right[5]), right[5])
            left = right
        if left is not None:
            out.append(left[4][4 * left[3][np.searchsorted(left[2], cut)]:])
        return b"".join(out)


def cut_chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str, bool]]:
    """(begin, window, final) of overlapping windows that cover a text."""
    last = max(0, (len(text) - overlap - 1) // chunk)
    return [(i * chunk, text[i * chunk:None if i == last else (i + 1) * chunk + overlap], i == last)
            for i in range(last + 1)]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id_column: str = "doc_id",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids binary): little-endian 32-bit ids of every whole text."""
    part = docs.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = part.schema["__id"].dataType.simpleString()
    long = F.length("__text") > chunk + overlap

    def whole(batches):
        coder = Coder(path, pattern)
        for batch in batches:
            for piece in T.slices(batch, 1):
                ids = [coder.encode(x) for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary())], ["__id", "ids"])

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                for begin, window, final in cut_chunks(row.column(2)[0].as_py(), chunk, overlap):
                    yield pa.RecordBatch.from_pydict({
                        "__row": row.column(0), "__id": row.column(1), "begin": pa.array([begin], pa.int64()),
                        "final": [final], "window": [window]})

    def windows(batches):
        coder = Coder(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                begin, final, window = (row.column(c)[0].as_py() for c in (2, 3, 4))
                bounds, counts, ids = coder.window(window, begin, final)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, *[pa.array([x], pa.binary()) for x in (bounds.tobytes(), counts.tobytes(), ids)]],
                    ["__row", "__id", "begin", "final", "window", "bounds", "counts", "ids"])

    def join(table: pa.Table) -> pa.Table:
        coder = Coder(path, pattern)
        table = table.sort_by("begin")
        chunks = ((r["begin"], r["window"], np.frombuffer(r["bounds"], np.int64), np.frombuffer(r["counts"], np.int64),
                   r["ids"], r["final"]) for i in range(table.num_rows) for r in table.slice(i, 1).to_pylist())
        return pa.table({"__id": table.column("__id").slice(0, 1), "ids": pa.array([coder.stitch(chunks)], pa.binary())})

    short = part.filter(~long).mapInArrow(whole, f"__id {kind}, ids binary")
    pieces = (
        part.filter(long).select(F.monotonically_increasing_id().alias("__row"), "__id", "__text")
        .mapInArrow(cut, f"__row long, __id {kind}, begin long, final boolean, window string")
        .repartition("__row", "begin")
        .mapInArrow(windows, f"__row long, __id {kind}, begin long, final boolean, window string, "
                             "bounds binary, counts binary, ids binary"))
    stitched = pieces.groupBy("__row").applyInArrow(join, f"__id {kind}, ids binary")
    return short.unionByName(stitched).withColumnRenamed("__id", id_column)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary): the bytes of the concatenated tokens of ``encode``'s rows."""
    part = encoded.select(F.col(id_column), "ids")

    def back(batches):
        coder = Coder(path, pattern)
        for batch in batches:
            for piece in T.slices(batch, 1):
                found = [coder.decode(x) for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.binary())],
                                                 [id_column, "ids", "decoded"])

    return part.mapInArrow(back, f"`{id_column}` {part.schema[0].dataType.simpleString()}, ids binary, decoded binary")


def digests(decoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``decode``'s rows."""
    return decoded.select(
        id_column, F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
