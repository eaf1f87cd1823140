"""Exact duplicates found by sorting contents: equal texts end up side by side and are compared in full.

Documents are dealt to ranges of their normalised bytes by sampled splitters and sorted within each range by Spark's
external sort. The order is: the first ``LEAD`` characters, the SHA-256 digest, all bytes, then the id. A splitter
holds the leading characters, the digest and the id alone, since splitters pass through the driver and must not grow
with the longest text. The id as last part of the order lets a splitter fall within a group of copies, so a text that
a third of all rows share is spread over as many ranges as its share of rows asks for.

Within a range, every text is compared in full with its neighbour; a run of equal ones has a size and an extreme id.
A run that touches neither end of its range is a whole group. The runs at the ends, at most two a range, are summed by
digest over all ranges and joined back by range and digest, so the rows of a group over many ranges stay apart.

Defined cases: NULL counts as the empty text; of equal texts exactly one row stays, the one with the largest (or
smallest) id, and of several such rows with that id one; a NULL id yields to any other; an empty table gives no row;
columns of any name may come along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.llm.wordbpe import texts_of
from platewise.session import cut_lineage

LEAD = 32


def sorted_contents(docs: DataFrame, text: str | Column = "text", id_column: str = "doc_id", keep: str = "largest",
                    extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, content, digest, *extra) in ranges of content; within equal contents the id that stays comes last.

    ``text`` may be an expression that normalises the text. Extra columns come in the order given, under names of
    their own: ``x0``, ``x1`` and so on.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    content = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_column).cast("long").alias("id"), content.alias("content"),
        *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)])
    keyed = read.select("*", F.substring("content", 1, LEAD).alias("lead"), F.unhex(F.sha2("content", 256)).alias("digest"))
    last = F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first()
    return keyed.repartitionByRange("lead", "digest", last).sortWithinPartitions("lead", "digest", "content", last).select(
        "id", "content", "digest", *[f"x{i}" for i in range(len(extra))])


class _Runs:
    """Cuts the sorted rows of a range into runs of equal contents, whatever their batches."""

    def __init__(self):
        self.content, self.ids, self.digest, self.first = None, [], None, True

    def close(self, last: bool = False) -> tuple[list, bytes, bool] | None:
        """The ids of the run that ends here, its digest, and whether it touches an end of the range."""
        if self.content is None:
            return None
        done = self.ids, self.digest, self.first or last
        self.content, self.ids, self.first = None, [], False
        return done

    def start(self, content: bytes, digest: bytes) -> None:
        self.content, self.digest = content, digest


def runs(sorted_docs: DataFrame) -> DataFrame:
    """(id, digest, run_keep, run_size, last, edge, range): every row with the size of its run and the id that stays in it.

    ``last`` marks the run's last row, the one with that id; ``edge`` tells that the run may go on in another range.
    """
    def cut(batches):
        run, own = _Runs(), TaskContext.get().partitionId()
        for batch in batches:
            for piece in T.slices(batch, 1):
                rows = []
                for one, content, digest in zip(piece.column(0).to_pylist(), texts_of(piece.column(1)), piece.column(2).to_pylist()):
                    if content != run.content:
                        rows.append(run.close())
                        run.start(content, digest)
                    run.ids.append(one)
                yield from written(rows, own)
        yield from written([run.close(last=True)], own)

    def written(found, own):
        found = [r for r in found if r is not None]
        if not found:
            return
        sizes = np.array([len(ids) for ids, _, _ in found])
        last = np.zeros(sizes.sum(), bool)
        last[np.cumsum(sizes) - 1] = True
        of = np.repeat(np.arange(len(found)), sizes)
        keep = pa.array([ids[-1] for ids, _, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for ids, _, _ in found for i in ids], pa.int64()),
             pa.array([d for _, d, _ in found], pa.binary()).take(pa.array(of)), keep.take(pa.array(of)),
             pa.array(sizes[of]), pa.array(last), pa.array(np.array([e for _, _, e in found])[of]),
             pa.array([own] * len(of), pa.int32())],
            ["id", "digest", "run_keep", "run_size", "last", "edge", "range"])

    return sorted_docs.select("id", "content", "digest").mapInArrow(
        cut, "id long, digest binary, run_keep long, run_size long, last boolean, edge boolean, range int")


def copies(docs: DataFrame, text: str | Column = "text", id_column: str = "doc_id", keep: str = "largest") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every document, dropped ones included."""
    found = cut_lineage(runs(sorted_contents(docs, text, id_column, keep)))
    extreme = F.max("run_keep") if keep == "largest" else F.min("run_keep")
    heads = found.filter("edge AND last")
    whole = heads.groupBy("digest").agg(extreme.alias("all_keep"), F.sum("run_size").alias("all_size"))
    whole = heads.select("digest", "range").join(whole, "digest").withColumnsRenamed({"digest": "of_digest", "range": "of_range"})
    inner = found.filter("NOT edge").select(
        "id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("last").alias("kept"), "digest")
    ends = found.filter("edge").join(
        whole, (F.col("range") == F.col("of_range")) & (F.col("digest") == F.col("of_digest"))).select(
        "id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"),
        (F.col("last") & F.col("run_keep").eqNullSafe(F.col("all_keep"))).alias("kept"), "digest")
    return inner.unionByName(ends).select(
        F.col("id").alias(id_column), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str | Column = "text", id_column: str = "doc_id", keep: str = "largest") -> DataFrame:
    """One row of each group of equal texts, with all columns and the text as it was given.

    A range hands on the last row of each of its runs; of the few rows from the ends of ranges that share a text, the
    extreme id stays.
    """
    names = docs.columns
    rows = sorted_contents(docs, text, id_column, keep, tuple(names))
    own = [f"x{i}" for i in range(len(names))]
    picked = rows.mapInArrow(_last_rows, ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "content") + ", edge boolean")
    picked = cut_lineage(picked)
    extreme = F.max("id") if keep == "largest" else F.min("id")
    ends = picked.filter("edge")
    stay = ends.groupBy("digest").agg(extreme.alias("all_keep")).withColumnRenamed("digest", "of_digest")
    ends = ends.join(stay, (F.col("digest") == F.col("of_digest")) & F.col("id").eqNullSafe(F.col("all_keep")), "left_semi")
    return picked.filter("NOT edge").select(*own).union(ends.select(*own)).toDF(*names)


def _last_rows(batches):
    """The last row of each run of equal contents of a sorted range, without its content."""
    held, content, first = None, None, True
    for batch in batches:
        for piece in T.slices(batch, 1):
            texts = texts_of(piece.column(1))
            ends = [i for i in range(len(texts) - 1) if texts[i] != texts[i + 1]]
            rows = piece.drop_columns(["content"])
            if held is not None and texts[0] != content:
                yield _marked(held, first)
                first = False
            if first and ends:
                yield _marked(rows.slice(ends[0], 1), True)
                first, ends = False, ends[1:]
            if ends:
                yield _marked(rows.take(pa.array(ends)), False)
            held, content = rows.slice(len(texts) - 1, 1), texts[-1]
    if held is not None:
        yield _marked(held, True)


def _marked(rows: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
    return rows.append_column("edge", pa.array([edge] * rows.num_rows, pa.bool_()))

