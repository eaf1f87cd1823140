"""Audit of how filters interact: what each removes at each place of every order, by contractions of a contingency tensor.

Every document fails or passes each of five filters. Per part of the corpus, documents are counted by the
combination of their verdicts: a tensor of shape 2x2x2x2x2, one axis per filter, index 1 for a failure. Whatever an
audit asks is a contraction of that tensor in which each axis takes the passing half, the failing half or the sum of
both, so that no order of filters is ever run over documents again: 120 orders of five steps are one einsum.

The filters, on whole texts with case-sensitive words: A, under 200 words; B, distinct words under half of the words;
C, A-Z over 3 % of the code points; D, a symbol of ``#$%&*|``; E, identical to the text of a smaller id anywhere.

Texts are read once. What is shuffled per document is an id, a SHA-256 digest of the text and a few flags; the rest
works on counts. Documents that are first of their text are found by aggregating ids by digest, which is summed before
the shuffle, so a text that a third of all rows share costs one row a task. The tensors are built where their part's
counts meet, at most 32 rows each.

Defined cases: a NULL text is the empty text, a NULL part the empty string; a NULL id counts as larger than any other,
and rows with equal ids are never duplicates of each other; several labels of one id count if any of them is 1, labels without id belong to none,
missing ones are 0; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.llm.wordbpe import texts_of
from platewise.session import cut_lineage

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
MEASURES = ["n", "good", "toxic"]
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")
_SYMBOL = re.compile(rb"[#$%&*|]")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUES = bytes(range(0x80, 0xC0))
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: whether a text fails A, B, C and D."""
    words = text.split()
    upper, points = len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _CONTINUES))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * upper > UPPER_PERCENT * points) << 2
            | (_SYMBOL.search(text) is not None) << 3)


def document_failures(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text",
                      id_column: str = "doc_id") -> DataFrame:
    """(part, id, digest, mask, good, toxic) of every document, without its text; mask holds filters A to D."""
    read = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def judge(batches):
        for batch in batches:
            for piece in T.slices(batch, 2):
                texts = texts_of(piece.column(2))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1),
                     pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                     pa.array([text_failures(t) for t in texts], pa.int32())], ["part", "id", "digest", "mask"])

    marks = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    judged = read.mapInArrow(judge, "part string, id long, digest binary, mask int")
    return judged.join(marks, F.col("id") == F.col("label_id"), "left").select(
        "part", "id", "digest", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def tensor_cells(failures: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the cells of the contingency tensors that hold documents; bit 4 of mask is filter E."""
    held = cut_lineage(failures)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    every = held.groupBy("part", "mask").agg(*sums)
    place = F.struct(F.col("id").isNull().alias("late"), F.coalesce("id", F.lit(0)).alias("id"))
    least = held.groupBy("digest").agg(F.min(place).alias("first")).select(F.col("digest").alias("of_digest"), "first.*")
    # the key of this join holds the id, so copies of one text are dealt to many tasks
    first = held.join(least.withColumnRenamed("id", "least_id"), (F.col("digest") == F.col("of_digest"))
                      & (F.coalesce("id", F.lit(0)) == F.col("least_id")) & (F.col("id").isNull() == F.col("late")), "left_semi")
    first = first.groupBy("part", "mask").agg(*sums)
    failing = every.unionByName(first.select("part", "mask", *[(-F.col(m)).alias(m) for m in MEASURES]))
    return first.unionByName(failing.select("part", (F.col("mask") + 16).alias("mask"), *MEASURES)).groupBy("part", "mask").agg(
        *[F.sum(m).alias(m) for m in MEASURES])


def contract(tensors: np.ndarray, choices: np.ndarray) -> np.ndarray:
    """Sums over a stack of tensors (m, 2, 2, 2, 2, 2) of the halves in ``choices`` (r, 5, 2): an array (m, r)."""
    return np.einsum("mabcde,ra,rb,rc,rd,re->mr", tensors, *np.moveaxis(choices, 1, 0))


def choices_of(orders: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """For every order and step, which half of each axis the kept, removed, failing and only-failing documents take."""
    kept, removed, failing, only = [], [], [], []
    for order in orders:
        for step, own in enumerate(order):
            before = order[:step]
            kept.append([PASS if f in before or f == own else ALL for f in range(5)])
            removed.append([PASS if f in before else FAIL if f == own else ALL for f in range(5)])
            failing.append([FAIL if f == own else ALL for f in range(5)])
            only.append([FAIL if f == own else PASS for f in range(5)])
    return {"kept": np.array(kept), "removed": np.array(removed), "failing": np.array(failing), "only": np.array(only)}


def audit_table(tensors: np.ndarray, orders: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The counts of every order and step from the tensors (all, good, toxic) of one part."""
    chosen = choices_of(orders)
    removed = contract(tensors, chosen["removed"])
    own = np.array(orders).ravel()
    by_filter = np.array([removed[0][own == f].sum() for f in range(5)])
    return {
        "kept": contract(tensors[:1], chosen["kept"])[0], "removed": removed[0],
        "redundant": contract(tensors[:1], chosen["failing"])[0] - removed[0],
        "unique_fails": contract(tensors[:1], chosen["only"])[0],
        "good_lost": removed[1], "toxic_lost": removed[2], "shapley": by_filter[own],
    }


def audit(cells: DataFrame) -> DataFrame:
    """One row per part, order of filters and step."""
    orders = list(itertools.permutations(range(5)))
    names = ["".join(FILTERS[f] for f in order) for order in orders for _ in order]
    steps = list(range(1, 6)) * len(orders)

    def contracted(table: pa.Table) -> pa.Table:
        tensors = np.zeros((3, 32), np.int64)
        for i, measure in enumerate(MEASURES):
            tensors[i, table.column("mask").to_numpy()] = table.column(measure).to_numpy()
        # bit f of a mask is axis f: the first axis of the tensor is the lowest bit
        tensors = tensors.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1)
        found = audit_table(tensors, orders)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(names), pa.string()),
                         "filter_order": names, "step": pa.array(steps, pa.int32()),
                         **{k: pa.array(v, pa.int64()) for k, v in found.items()}})

    return cells.groupBy("part").applyInArrow(contracted, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of filters A to E over all documents, per value of ``part``."""
    return audit(tensor_cells(document_failures(docs, labels, part)))
