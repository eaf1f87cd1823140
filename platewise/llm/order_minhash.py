"""Order MinHash fingerprints: sensitive to edits, not only to content.

Every k-mer of code points is numbered by its occurrence in the text. Each of ``HASHES`` random orders picks the
``TUPLE`` smallest numbered k-mers; they are put back into text order and hashed as one tuple of 16 bits. Two
fingerprints are as alike as the share of their equal tuples, which falls with the edit distance of the texts.

The neighbour in id order comes from range parts: rows are sorted within the task of their id range, and the first
document of each part is also sent to the part before it. So only the number of parts bounds what the driver sees.

Defined cases: NULL counts as the empty text; texts shorter than a k-mer are one k-mer, the empty text has none and
is like other empty texts only; equal ids are ordered by text; a NULL id comes first; an empty table gives no row;
only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.llm.ordering import default_parts, id_bounds, part_of

KMER = 6
TUPLE = 2
HASHES = 64
_BLOCK = 2048
_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(0, 2**31, HASHES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_ROWS = np.arange(HASHES)


def numbered_kmers(codes: np.ndarray, size: int = KMER) -> np.ndarray:
    """A 64-bit hash of each k-mer together with how often it came before."""
    n = len(codes) - size + 1
    if n < 1:
        size, n = len(codes), min(1, len(codes))
    if n < 1:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += wide[i:i + n] * T._ODD[i]
    hashes = T.mix(total)
    # sorted by hash, then place: the low bits of the hash give way to the place
    bits = np.uint64(max(1, int(n).bit_length()))
    placed = np.sort((hashes >> bits << bits) | np.arange(n, dtype=np.uint64))
    kmer, where = placed >> bits, (placed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.arange(n)
    first = at.copy()
    first[1:][kmer[1:] == kmer[:-1]] = 0
    np.maximum.accumulate(first, out=first)
    again = np.flatnonzero(at > first)
    numbered = hashes
    numbered[where[again]] += (again - first[again]).astype(np.uint64) * T._ODD[60]
    return T.mix(numbered)


def fingerprint(text: str) -> np.ndarray:
    """The ``HASHES`` 16-bit tuple hashes of a text; work is done in blocks of k-mers, so memory is bounded."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kmers = numbered_kmers(codes)
    if not len(kmers):
        return np.zeros(HASHES, np.uint16)
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    values, places = [], []
    for start in range(0, len(short), _BLOCK):
        part = short[start:start + _BLOCK][None, :] * _MULTIPLY
        for _ in range(min(TUPLE, part.shape[1])):
            at = part.argmin(axis=1)
            values.append(part[_ROWS, at])
            places.append(at + start)
            part[_ROWS, at] = 0xFFFFFFFF
    value, place = np.stack(values, axis=1), np.stack(places, axis=1)
    if value.shape[1] > TUPLE:
        best = np.argsort(value, axis=1, kind="stable")[:, :TUPLE]
        place = np.take_along_axis(place, best, axis=1)
    chosen = kmers[np.sort(place, axis=1)]
    total = np.zeros(HASHES, np.uint64)
    for i in range(chosen.shape[1]):
        total += chosen[:, i] * T._ODD[20 + i]
    return (T.mix(total) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def with_following(docs: DataFrame, text: str = "text", id_column: str = "doc_id", parts: int | None = None) -> DataFrame:
    """(part, guest, id, text) where each part ends with the first document of the next part as its guest."""
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = id_bounds(source, "id", parts or default_parts(docs))

    def first_ids(batches):
        for batch in batches:
            at = part_of(batch.column(0), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0)], ["part", "id"])

    heads = {r["part"]: (None if r["missing"] else r["id"]) for r in
             source.select("id").mapInArrow(first_ids, "part int, id long").groupBy("part")
             .agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("missing")).collect()}
    order = sorted(heads)
    before = {part: order[i - 1] for i, part in enumerate(order)}

    def place(batches):
        for batch in batches:
            parts_of = part_of(batch.column(0), bounds)
            head = [x == heads[p] for x, p in zip(batch.column(0).to_pylist(), parts_of.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts_of), pa.array([False] * len(head)), *batch.columns], ["part", "guest", "id", "text"])
            guests = batch.filter(pa.array(head))
            if guests.num_rows:
                to = [before[p] for p, h in zip(parts_of.tolist(), head) if h]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array([True] * len(to)), *guests.columns], ["part", "guest", "id", "text"])

    return (source.mapInArrow(place, "part int, guest boolean, id long, text string")
            .repartitionById(len(bounds) + 1, "part")
            .sortWithinPartitions("part", "guest", F.asc_nulls_first("id"), "text"))


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and both likenesses."""
    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def measure(batches):
        held, rows = None, []
        for batch in batches:
            for part, guest, own, content in zip(*[batch.column(i) for i in range(4)]):
                if guest.as_py() and held is None:
                    continue
                content = content.as_py()
                found = fingerprint(content)
                if held is not None:
                    changed = edited(held[1], content)
                    after = fingerprint(changed)
                    rows.append((held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(),
                                 held[2].astype(">u2").tobytes().hex(), after.astype(">u2").tobytes().hex(),
                                 likeness(held[2], after), likeness(held[2], found)))
                held = None if guest.as_py() else (own.as_py(), content, found)
                if len(rows) == 256:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return with_following(docs, text, id_column, parts).mapInArrow(
        measure, f"`{id_column}` long, n_chars long, edited_sha256 string, fingerprint string, "
                 "edited_fingerprint string, near_edited double, near_next double")
