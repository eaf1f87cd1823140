"""Numpy work inside one similarity cell; imported by tasks, so it stays light."""

from itertools import product

import numpy as np
import pyarrow as pa

from platewise.functions.arrow import matrix_of

DIGITS = 10
STEP = 1024


def codes_of(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Shared integer codes of two text columns; NULL equals NULL."""
    both = pa.chunked_array([*left.chunks, *right.chunks], pa.string()).combine_chunks()
    both = both.fill_null("\u0002").dictionary_encode()
    if isinstance(both, pa.ChunkedArray):
        both = both.combine_chunks()
    codes = both.indices.to_numpy(zero_copy_only=False)
    return codes[: len(left)], codes[len(left):]


def prepared(matrix: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return matrix
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1.0, norm)


def similarities(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Similarity block, rounded so that equal pairs agree between differently cut blocks.

    ``anticosine`` ranks the least similar first.
    """
    if metric == "euclidean":
        square = np.zeros((len(q), len(r)))
        for j in range(q.shape[1]):
            square += (q[:, j][:, None] - r[:, j][None, :]) ** 2
        return np.round(1.0 / (1.0 + np.sqrt(square)), DIGITS)
    return np.round(q @ r.T if metric == "cosine" else -(q @ r.T), DIGITS)


def row_similarities(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of each row of ``q`` to the same row of ``r``, with the rounding of ``similarities``."""
    if metric == "euclidean":
        return np.round(1.0 / (1.0 + np.sqrt(((q - r) ** 2).sum(axis=1))), DIGITS)
    dot = np.einsum("ij,ij->i", q, r)
    return np.round(dot if metric == "cosine" else -dot, DIGITS)


class Cell:
    """Both sides of one cell, walked pool by pool in bounded steps."""

    def __init__(self, left: pa.Table, right: pa.Table, differ: int, disjoint: bool, metric: str):
        self.left, self.right = left, right
        self.metric, self.disjoint = metric, disjoint
        self.q = prepared(matrix_of(left.column("features")), metric)
        self.r = prepared(matrix_of(right.column("features")), metric)
        self.q_id, self.r_id = codes_of(left.column("id"), right.column("id"))
        self.q_pool, self.r_pool = codes_of(left.column("pool"), right.column("pool"))
        self.codes = [codes_of(left.column(f"d{i}"), right.column(f"d{i}")) for i in range(differ)]
        self.q_labels = left.column("labels").to_pylist() if disjoint else None
        self.r_labels = right.column("labels").to_pylist() if disjoint else None

    def steps(self, step: int = STEP, ref_step: int | None = None, rounded: bool = True):
        """(query rows, reference rows, similarities, allowed) per pool and step; all references of a pool at once or in steps."""
        order_q, order_r = np.argsort(self.q_pool, kind="stable"), np.argsort(self.r_pool, kind="stable")
        pools = np.intersect1d(self.q_pool, self.r_pool)
        sorted_q, sorted_r = self.q_pool[order_q], self.r_pool[order_r]
        for pool in pools:
            qs = order_q[np.searchsorted(sorted_q, pool, "left"):np.searchsorted(sorted_q, pool, "right")]
            rs = order_r[np.searchsorted(sorted_r, pool, "left"):np.searchsorted(sorted_r, pool, "right")]
            for start, first in product(range(0, len(qs), step), range(0, len(rs), ref_step or len(rs))):
                part, some = qs[start:start + step], rs[first:first + (ref_step or len(rs))]
                allowed = self.q_id[part][:, None] != self.r_id[some][None, :]
                for mine, theirs in self.codes:
                    allowed &= mine[part][:, None] != theirs[some][None, :]
                if self.disjoint:
                    self.clear_shared(allowed, part, some)
                plain = rounded or self.metric == "euclidean"
                q, r = self.q[part], self.r[some]
                sims = similarities(q, r, self.metric) if plain else q @ r.T if self.metric == "cosine" else -(q @ r.T)
                yield part, some, sims, allowed

    def clear_shared(self, allowed, part, rs):
        holders = {}
        for j, r in enumerate(rs):
            for label in self.r_labels[r] or []:
                holders.setdefault(label, []).append(j)
        for i, q in enumerate(part):
            for label in self.q_labels[q] or []:
                allowed[i, holders.get(label, [])] = False


def count_above(sims, values, ids, anchor_sim, anchor_ref, mode):
    """How many of ``sims`` rank above each anchor, by the tie rule of ``mode``."""
    ordered = np.sort(sims)
    if mode == "positives":
        return len(sims) - np.searchsorted(ordered, anchor_sim, "left")
    above = len(sims) - np.searchsorted(ordered, anchor_sim, "right")
    if mode == "by_id":
        equal = np.searchsorted(ordered, anchor_sim, "right") - np.searchsorted(ordered, anchor_sim, "left")
        for j in np.nonzero(equal)[0]:
            above[j] += sum(ids[t] < anchor_ref[j] for t in np.nonzero(values == anchor_sim[j])[0])
    return above


def precision_of(sims, counts, anchor: str, total: int) -> tuple[int, int, float | None]:
    """(positives, negatives, average precision) from anchors and counts."""
    order = np.argsort(-sims, kind="stable")
    sims, counts = sims[order], counts[order]
    if anchor == "pos":
        n_pos, n_neg = len(sims), total
        place = np.arange(1, n_pos + 1)
        return n_pos, n_neg, float(np.mean(place / (place + counts))) if n_pos and n_neg else None
    n_pos, n_neg = total, len(sims)
    place = np.arange(1, n_pos + 1)
    ahead = np.searchsorted(counts, place, "left")
    return n_pos, n_neg, float(np.mean(place / (place + ahead))) if n_pos and n_neg else None


def holders_of(labels: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """Rows that hold each label."""
    found = {}
    for row, own in enumerate(labels.to_pylist()):
        for label in dict.fromkeys(own or []):
            found.setdefault(label, []).append(row)
    return {label: np.asarray(rows) for label, rows in found.items()}


def complete_precision(positives: np.ndarray, negatives: np.ndarray) -> float:
    """Average precision from all similarities, ``negatives`` in rising order; ties rank positives first."""
    positives = np.sort(positives)
    above = (len(negatives) - np.searchsorted(negatives, positives, "right"))[::-1]
    place = np.arange(1, len(positives) + 1)
    return float(np.mean(place / (place + above)))
