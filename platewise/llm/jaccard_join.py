"""Exact Jaccard join of documents on their sets of word shingles, in regions of the metric space.

The Jaccard distance is a metric, but documents without a common shingle are all at distance one, where no pivot
tells them apart. So the first regions are those of single shingles. Shingles are put into one order for all
documents, widespread ones last; two sets whose similarity reaches the limit share k shingles among the first
``n - ceil(limit * n) + k`` of each, if any two linked sets have so many in common (3 at the given limit). The documents
with the same such shingle form a region, and no link is lost between regions. Equal sets are one class throughout.

A region of few classes is compared as a whole, save pairs that meet by a single shingle, as unrelated texts do more often
the more there are; sizes, and counts of shingles per bucket, rule out most of the others before any set is sent. Large regions are joined by recursion: pivots are compared with every class of the region,
which yields links and distances; each class goes to the Voronoi cell of its nearest pivot, and also to every cell whose
pivot is at most twice the link distance farther, since a partner may live there. Cells whose classes are already
connected are done, the others are regions of their own. Regions that share classes form crowds, and a crowd of bounded
size is joined in one task. For larger ones, as when near copies are a third of all documents, the recursion runs in
rounds over all tasks: pivots are found by pre-aggregated minima and rows meet them in joins that Spark splits, so
no region is ever in one task.

Which shingles are widespread is counted over all documents, and told to the tasks by filters that grow with their
number, up to ``HOT`` of them: one taken for a rare one makes a region that ties documents into crowds that need rounds.
One filter for each power of two of the counts puts the rarer of them first. Others that pass a filter by chance only
come later in the order, which steers the work; any order gives the same links.

Defined cases: NULL, empty and wordless texts have the empty set and are linked with nothing; fewer words than a shingle
are one shingle; equal rows are one class and linked; rows with a NULL id belong to their class, whose label is its
smallest id, or NULL without one; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.llm.components import components
from platewise.session import cut_lineage

PERCENT = 75
WORDS = 5
SMALL = 16
HOT = 1 << 23
PER_BUCKET = 1 << 20
FLUSH = 1 << 20
CROWD_BYTES = 32 << 20
CLASS_BYTES = 8 << 10
_ODD = np.uint64(0x9E3779B97F4A7C15)


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit number of a set; equal sets have the same."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _bits(rows: int) -> int:
    return max(0, min(30, math.ceil(math.log2(max(1, rows / PER_BUCKET)))))


def _split(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted 64-bit keys by their ``bits`` upper bits."""
    if not bits:
        return [(0, 0, len(keys))]
    upper = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], upper[1:] != upper[:-1], [True])))
    return [(int(upper[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def _low(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below the upper ``bits``."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def shingle_classes(numbered: DataFrame, size: int) -> DataFrame:
    """(id, n, class, row) of every row of (id, text, row)."""

    @T.tidy
    def measure(batches):
        for batch in batches:
            for piece in T.slices(batch, 1):
                sets = T.shingle_sets(*T.buffer_of(piece.column(1)), size)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([class_of(s) for s in sets], pa.int64()), piece.column(2)], ["id", "n", "class", "row"])

    return numbered.mapInArrow(measure, "id long, n long, class long, row long")


def widespread(docs: DataFrame, total: int, size: int = WORDS, least: int = SMALL,
               most: int = HOT) -> tuple[list[np.ndarray], int]:
    """Filters of the shingles found in more than ``least`` documents, by the upper bits of their hashes, and how many bits.

    Documents are counted per 32 bits within a bucket of hashes: each task sends sorted arrays, a group adds up one
    bucket of about ``PER_BUCKET`` entries. The first filter holds them all, each further one those whose counts reach
    the next power of two. With more than ``most`` shingles the first are left out.
    """
    bits = _bits(total)

    def send(parts):
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        for bucket, a, b in _split(keys, bits):
            low, n = _low(keys[a:b], bits), counts[a:b]
            yield bucket, low.tobytes(), n.astype("<u4").tobytes() if n.max() > 1 else b""

    @T.tidy
    def count(batches):
        held, rows = [], 0
        for batch in batches:
            for piece in T.slices(batch, 0):
                held += T.shingle_sets(*T.buffer_of(piece.column(0)), size)
                rows = sum(map(len, held))
                if rows > FLUSH:
                    yield _table(list(send(held)))
                    held, rows = [], 0
        if rows:
            yield _table(list(send(held)))

    def _table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "low", "counts"])

    def add(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        low = [np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()]
        n = [np.frombuffer(c, "<u4") if c else np.ones(len(x), np.uint32)
             for x, c in zip(low, table.column("counts").to_pylist())]
        low, n = np.concatenate(low), np.concatenate(n)
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        sums = np.add.reduceat(n.astype(np.int64), starts)
        hot = sums > least
        return pa.table({"key": (low[starts][hot].astype(np.int64) | (bucket << 32)),
                         "octave": np.log2(sums[hot]).astype(np.int32)})

    found = cut_lineage(docs.select("text").mapInArrow(count, "bucket int, low binary, counts binary")
                        .groupBy("bucket").applyInArrow(add, "key long, octave int"))
    octaves = dict(tuple(r) for r in found.groupBy("octave").agg(F.count(F.lit(1))).collect())
    above = [(o, sum(n for x, n in octaves.items() if x >= o)) for o in range(min(octaves, default=0), max(octaves, default=-1) + 1)]
    above = [(o, n) for o, n in above if n <= most]
    if not above:
        return [], bits
    first = above[0][0]
    told = found.filter(F.col("octave") >= first).select("key", (F.col("octave") - first).alias("level"))
    return memberships(told, [n for _, n in above]), bits


def agreeing(percent: int = PERCENT) -> int:
    """How many shingles any two different sets have in common at least if they are linked, 3 at most."""
    return max(1, min(3, -(-percent // max(1, 100 - percent))))


def _prefixes(docs: DataFrame, hot: list[np.ndarray], bits: int, size: int, percent: int, visit, schema: str) -> DataFrame:
    """``visit(held)`` of (class, plain prefix, widespread prefix) triples; a class is taken once per task.

    Prefixes are so long that linked sets share ``agreeing`` shingles among theirs. The more filters of ``hot`` a
    shingle passes, the later it comes.
    """
    more = agreeing(percent) - 1

    @T.tidy
    def walk(batches):
        seen, held, rows = set(), [], 0
        for batch in batches:
            for piece in T.slices(batch, 0):
                sets = T.shingle_sets(*T.buffer_of(piece.column(0)), size)
                keys = (np.concatenate(sets) >> np.uint64(32 - bits)).astype(np.int64)
                levels, stop = levels_of(hot, keys), 0
                for found in sets:
                    start, stop = stop, stop + len(found)
                    own = class_of(found)
                    if not len(found) or own in seen:
                        continue
                    seen.add(own)
                    take = prefix_length(len(found), percent) + more
                    level = levels[start:stop]
                    wide = np.flatnonzero(level)
                    plain = found[level == 0][:take]
                    wide = wide[np.argsort(level[wide], kind="stable")][:take - len(plain)]
                    held.append((own, plain, keys[start:stop][wide]))
                    rows += take
                if rows > FLUSH:
                    yield from visit(held)
                    held, rows = [], 0
        if held:
            yield from visit(held)

    return docs.select("text").mapInArrow(walk, schema)


def plain_regions(docs: DataFrame, hot: list[np.ndarray], bits: int, total: int, size: int, percent: int) -> DataFrame:
    """(region, members, n): the distinct groups of two or more classes with n common plain prefix shingles."""
    own_bits = _bits(total // 4)

    def pack(held):
        keys = np.concatenate([p for _, p, _ in held])
        classes = np.repeat(np.array([c for c, _, _ in held], np.int64), [len(p) for _, p, _ in held])
        order = np.argsort(keys)
        keys, classes = keys[order], classes[order]
        if len(keys):
            rows = [(b, _low(keys[x:y], own_bits).tobytes(), classes[x:y].tobytes()) for b, x, y in _split(keys, own_bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "low", "classes"])

    def group(table: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()])
        classes = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("classes").to_pylist()])
        order = np.lexsort((classes, low))
        low, classes = low[order], classes[order]
        keep = np.concatenate(([True], (low[1:] != low[:-1]) | (classes[1:] != classes[:-1])))
        low, classes = low[keep], classes[keep]
        cuts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True])))
        members, found = {}, collections.Counter()
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                own = class_of(classes[a:b])
                members[own] = classes[a:b]
                found[own] += 1
        return pa.table({"region": pa.array(list(members), pa.int64()),
                         "members": pa.array([m.tolist() for m in members.values()], pa.list_(pa.int64())),
                         "n": pa.array([found[own] for own in members], pa.int64())})

    packed = _prefixes(docs, hot, bits, size, percent, pack, "bucket int, low binary, classes binary")
    return (packed.groupBy("bucket").applyInArrow(group, "region long, members array<long>, n long")
            .groupBy("region").agg(F.first("members").alias("members"), F.sum("n").alias("n")))


def hot_rows(docs: DataFrame, hot: list[np.ndarray], bits: int, size: int, percent: int) -> DataFrame:
    """(region, class) of the widespread shingles among the prefixes."""

    def rows(held):
        for own, _, keys in held:
            if len(keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own], pa.int64()), pa.array([keys.tolist()], pa.list_(pa.int64()))], ["class", "keys"])

    found = _prefixes(docs, hot, bits, size, percent, rows, "class long, keys array<long>").distinct()
    return found.select(F.explode("keys").alias("region"), "class")


def set_pairs(regions: DataFrame, least: int = 1) -> DataFrame:
    """(a, b): the distinct pairs within regions of at most ``SMALL`` members, found with at least ``least`` shingles.

    With ``least`` above one the regions have an ``n``, how many shingles made them.
    """

    def pairs(batches):
        for batch in batches:
            found = collections.Counter()
            for members, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for pair in itertools.combinations(sorted(members), 2):
                    found[pair] += n
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found.values(), pa.int64())], ["a", "b", "n"])

    n = F.col("n") if least > 1 else F.lit(1).cast("long").alias("n")
    found = regions.select("members", n).mapInArrow(pairs, "a long, b long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("a", "b")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, united) of class pairs; ``sets`` is (class, shingles binary)."""
    both = (pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y"))

    def measure(batches):
        for batch in batches:
            common, united = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common.append(overlap(x, y))
                united.append(len(x) + len(y) - common[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(united, pa.int64())],
                ["a", "b", "common", "united"])

    return both.mapInArrow(measure, "a long, b long, common long, united long")


def membership(values: DataFrame, rows: int) -> np.ndarray:
    """A filter that holds every value of the only column of ``values``, ``rows`` of them, and others by chance."""
    return memberships(values.select("*", F.lit(0)), [rows])[0]


def memberships(values: DataFrame, rows: list[int]) -> list[np.ndarray]:
    """Filters of (value, level): the k-th holds the ``rows[k]`` values of at least that level, and others by chance.

    A filter has 16 to 32 bits for a value, so about one other in a hundred passes; 64 MB are the most.
    """
    sizes = [1 << max(6, min(29, (16 * n - 1).bit_length())) for n in rows]

    def mark(batches):
        filters = [np.zeros(size // 8, np.uint8) for size in sizes]
        for batch in batches:
            found, level = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, (bits, size) in enumerate(zip(filters, sizes)):
                for turn in (0, 1):
                    at = _places(found[level >= k], size, turn)
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary()) for bits in filters], names)

    names = [f"f{k}" for k in range(len(sizes))]
    total = [np.zeros(size // 8, np.uint8) for size in sizes]
    for row in values.coalesce(8).mapInArrow(mark, ", ".join(f"{name} binary" for name in names)).toLocalIterator():
        for bits, name in zip(total, names):
            bits |= np.frombuffer(row[name], np.uint8)
    return total


def holds(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` pass a filter."""
    passed = np.ones(len(values), bool)
    for turn in (0, 1):
        left = np.flatnonzero(passed)
        at = _places(values[left], 8 * len(bits), turn)
        passed[left] = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return passed


def levels_of(filters: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """How many filters each of ``values`` passes, one after the other."""
    levels = np.zeros(len(values), np.int8)
    for k, bits in enumerate(filters):
        left = np.flatnonzero(levels == k)
        levels[left] += holds(bits, values[left])
    return levels


def _places(values: np.ndarray, size: int, turn: int) -> np.ndarray:
    """Where a value is marked, by the lower or the mixed upper bits of what is a hash already."""
    hashed = values.astype(np.int64).view(np.uint64)
    if turn:
        return ((hashed * _ODD) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)
    return (hashed & np.uint64(size - 1)).astype(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each of about as many buckets, in a byte each; empty where a byte is too small.

    Merging shingles into buckets only adds to what two sets have in common, so the weighted Jaccard similarity of the
    counts is never below the similarity of the sets.
    """
    if not len(shingles):
        return b""
    size = 1 << (len(shingles).bit_length() - 1)
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_common(x: bytes, y: bytes) -> int | None:
    """An upper bound of what two sets have in common, from their sketches."""
    if not len(x) or not len(y):
        return None
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, size).sum(axis=0), y.reshape(-1, size).sum(axis=0)).sum())


def class_views(docs: DataFrame, needed: DataFrame, size: int, view, name: str) -> DataFrame:
    """(class, ``name`` binary): ``view`` of the set of each needed class, made where its documents are read.

    Only sets that may be needed leave the tasks; one copy of each is kept.
    """
    bits = membership(needed.select("class"), needed.count())

    @T.tidy
    def measure(batches):
        seen = set()
        for batch in batches:
            for piece in T.slices(batch, 0):
                sets = T.shingle_sets(*T.buffer_of(piece.column(0)), size)
                own = np.array([class_of(s) for s in sets], np.int64)
                found = [(c, view(s)) for c, s, m in zip(own.tolist(), sets, holds(bits, own)) if m and c not in seen]
                seen.update(c for c, _ in found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], ["class", name])

    found = docs.select("text").mapInArrow(measure, f"class long, {name} binary")
    return found.join(needed, "class", "left_semi").dropDuplicates(["class"])


def classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def likely(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that neither the sizes of their sets nor their sketches rule out."""
    sizes = classes.groupBy("class").agg(F.min("n").alias("n"))
    near = cut_lineage(
        pairs.join(sizes.select(F.col("class").alias("a"), F.col("n").alias("x")), "a")
        .join(sizes.select(F.col("class").alias("b"), F.col("n").alias("y")), "b")
        .filter(F.least("x", "y") * 100 >= F.greatest("x", "y") * percent))
    sketches = cut_lineage(class_views(docs, cut_lineage(classes_of(near)), size, sketch, "sketch"))
    both = (near.join(sketches.select(F.col("class").alias("a"), F.col("sketch").alias("p")), "a")
            .join(sketches.select(F.col("class").alias("b"), F.col("sketch").alias("q")), "b").select("a", "b", "x", "y", "p", "q"))

    def possible(batches):
        for batch in batches:
            keep = []
            for x, y, p, q in zip(*[batch.column(i).to_pylist() for i in range(2, 6)]):
                common = most_common(p, q)
                keep.append(common is None or common * 100 >= (x + y - common) * percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(possible, "a long, b long")


def merged(rows: DataFrame) -> DataFrame:
    """Regions with the same members as one: a region is named after its members, whoever found it."""
    names = rows.groupBy("region").agg(
        F.xxhash64(F.expr("bit_xor(xxhash64(class))"), F.count(F.lit(1))).alias("name"), F.count(F.lit(1)).alias("n"))
    return (rows.join(names.filter("n > 1"), "region")
            .select(F.col("name").alias("region"), "class", F.col("n").cast("long").alias("n")).distinct())


def linked(distances: DataFrame, percent: int) -> DataFrame:
    return distances.filter(F.col("common") * 100 >= F.col("united") * percent).select("a", "b")


def crowds(rows: DataFrame) -> DataFrame:
    """(crowd, class): regions (region, class) that share classes are one crowd."""
    least = rows.groupBy("region").agg(F.min("class").alias("b"))
    edges = rows.join(least, "region").select(F.col("class").alias("a"), "b")
    found = components(edges)
    return found.select(F.col("root").alias("crowd"), F.col("node").alias("class"))


def metric_links(sets: list[np.ndarray], percent: int = PERCENT, pivots: int = 6, few: int = 24,
                 seed: int = 1) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that the links between ``sets`` connect, by recursion on Voronoi cells.

    A pivot is compared with every member of its cell. A member goes on to the cell of its nearest pivot and to those
    within the window of the triangle inequality. A cell that is one component is done, one that the windows do not
    divide keeps its members and gets further pivots, and few members are compared pair by pair.
    """
    limit = 1 - percent / 100
    root = list(range(len(sets)))
    links: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def distance(i: int, j: int) -> float:
        x, y = sets[i], sets[j]
        common = overlap(x, y)
        united = len(x) + len(y) - common
        if common * 100 >= united * percent and find(i) != find(j):
            root[find(i)] = find(j)
            links.append((i, j))
        return 1 - common / united

    def comparable(i: int, j: int) -> bool:
        return find(i) != find(j) and min(len(sets[i]), len(sets[j])) * 100 >= max(len(sets[i]), len(sets[j])) * percent

    rng = np.random.default_rng(seed)
    open_cells = [(np.arange(len(sets)), np.zeros((len(sets), 0)))]
    while open_cells:
        members, known = open_cells.pop()
        names = np.array([find(i) for i in members])
        if len(members) < 2 or (names == names[0]).all():
            continue
        if len(members) <= few:
            for x in range(len(members)):
                for y in range(x):
                    if comparable(members[x], members[y]) and not (np.abs(known[x] - known[y]) > limit + 1e-9).any():
                        distance(members[x], members[y])
            continue
        values, counts = np.unique(names, return_counts=True)
        minor = np.flatnonzero(names != values[counts.argmax()])
        chosen = rng.permutation(minor)[:pivots]
        if known.shape[1] >= 4 * pivots:  # enough windows: pivots only meet what these leave open
            for c in chosen:
                near = np.flatnonzero((np.abs(known - known[c]) <= limit + 1e-9).all(axis=1))
                for x in near:
                    if comparable(members[x], members[c]):
                        distance(members[x], members[c])
            rest = np.setdiff1d(np.arange(len(members)), chosen)
            open_cells.append((members[rest], known[rest]))
            continue
        table = np.array([[0.0 if x == c else distance(members[x], members[c]) for c in chosen] for x in range(len(members))])
        rest = np.setdiff1d(np.arange(len(members)), chosen)
        members, known, table = members[rest], known[rest], table[rest]
        inside = table <= table.min(axis=1, keepdims=True) + 2 * limit + 1e-9
        known = np.concatenate((known, table), axis=1)
        if inside.sum() > 1.5 * len(members):
            open_cells.append((members, known))
        else:
            open_cells += [(members[inside[:, k]], known[inside[:, k]]) for k in range(len(chosen))]
    return links


def crowd_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) within crowds (crowd, class) of bounded size, each in one task."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        classes = table.column("class").to_pylist()
        found = metric_links([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")], percent)
        return pa.table({"a": pa.array([classes[i] for i, _ in found], pa.int64()),
                         "b": pa.array([classes[j] for _, j in found], pa.int64())})

    return members.join(sets, "class").select("crowd", "class", "shingles").groupBy("crowd").applyInArrow(join, "a long, b long")


def voronoi_links(rows: DataFrame, sets: DataFrame, percent: int = PERCENT, links: DataFrame | None = None,
                  pivots: int = 4, crowd_bytes: int | None = None) -> DataFrame:
    """Links that connect what is to be connected within regions of any size (region, class).

    Not every link is listed: those between classes that others already connect may be left out. Regions that share
    classes form crowds; a crowd whose sets have at most ``crowd_bytes`` is joined in one task. The regions of larger
    crowds are joined in rounds of pivots over all tasks, by the same rules.
    """
    limit = 1 - percent / 100
    crowd_bytes = CROWD_BYTES if crowd_bytes is None else crowd_bytes
    links = links if links is not None else rows.sparkSession.createDataFrame([], "a long, b long")
    crowd = cut_lineage(crowds(rows))
    own = F.greatest(F.length("shingles"), F.lit(CLASS_BYTES)).alias("size")  # so many small sets are not one task's either
    size = crowd.join(sets.select("class", own), "class").groupBy("crowd").agg(F.sum("size").alias("size"))
    sized = cut_lineage(crowd.join(size, "crowd"))
    links = cut_lineage(links.union(crowd_links(sized.filter(F.col("size") <= crowd_bytes), sets, percent)))
    huge = sized.filter(F.col("size") > crowd_bytes).select("class")
    rows = cut_lineage(merged(rows.join(huge, "class", "left_semi")))
    if rows.limit(1).count():
        sets = cut_lineage(sets.join(huge, "class", "left_semi"))  # every round sends them
    while rows.limit(1).count():
        few = (rows.filter(F.col("n") <= SMALL).groupBy("region").agg(F.collect_list("class").alias("members")))
        roots = components(links)
        named = (rows.filter(F.col("n") > SMALL).join(roots, F.col("class") == F.col("node"), "left")
                 .select("region", "class", "n", F.coalesce("root", "class").alias("root")))
        parts = named.groupBy("region", "root").agg(F.count(F.lit(1)).alias("k"))
        major = parts.groupBy("region").agg(F.max(F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
        named = cut_lineage(named.join(major.filter("roots > 1").select("region", F.col("most.root").alias("major")), "region"))
        found = named.filter("root <> major").groupBy("region").agg(*[
            F.min(F.struct(F.xxhash64("class", F.lit(i)).alias("turn"), "class")).alias(f"p{i}") for i in range(pivots)])
        centres = found.select("region", F.explode(F.array_distinct(F.array(*[f"p{i}.class" for i in range(pivots)]))).alias("pivot"))
        met = cut_lineage(named.select("region", "class", "n").join(centres, "region"))
        pairs = met.filter("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
        distances = cut_lineage(compared(pairs, sets))
        links = cut_lineage(links.union(linked(distances, percent))
                            .union(linked(compared(set_pairs(few), sets), percent)).distinct())
        roots = components(links)
        # a pivot has met everything in its region and leaves it: it has no distance from itself
        apart = (met.join(distances.select(F.col("a").alias("class"), F.col("b").alias("pivot"),
                                           (1 - F.col("common") / F.col("united")).alias("d")), ["class", "pivot"], "left")
                 .withColumn("d", F.coalesce("d", F.lit(-1.0))))
        nearest = apart.groupBy("region", "class").agg(F.min("d").alias("near")).filter("near >= 0")
        ring = F.floor(F.col("d") / limit).cast("int")
        cells = cut_lineage(
            apart.join(nearest, ["region", "class"]).filter(F.col("d") <= F.col("near") + 2 * limit + 1e-9)
            .withColumn("own", F.explode(F.array(F.lit(0), F.lit(1))))
            .select("region", "n", F.xxhash64("region", "pivot", ring + F.col("own")).alias("cell"), "class", (F.col("own") == 0).alias("own")))
        natives = cells.groupBy("region", "cell", "n").agg(F.count(F.lit(1)).alias("k"), F.max("own").alias("own")).filter("own")
        divided = natives.groupBy("region").agg((F.sum("k") <= 1.5 * F.max("n")).alias("divided"))
        kept = cells.join(natives.select("cell"), "cell", "left_semi").join(divided, "region").select(
            F.when(F.col("divided"), F.col("cell")).otherwise(F.col("region")).alias("region"), "class").distinct()
        labelled = kept.join(roots, F.col("class") == F.col("node"), "left").select(
            "region", "class", F.coalesce("root", "class").alias("root"))
        unsettled = labelled.groupBy("region").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
        rows = cut_lineage(merged(labelled.join(unsettled, "region").select("region", "class")))
        pivots = min(4 * pivots, 256)
    return links


def rooted(docs: DataFrame, text: str = "text", id_column: str = "doc_id", percent: int = PERCENT,
           size: int = WORDS) -> DataFrame:
    """(row, id, n, root) of every document: equal roots are connected, an empty set has none.

    ``row`` is the place of the document in the scan of ``docs``.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    classes = cut_lineage(shingle_classes(source.withColumn("row", F.monotonically_increasing_id()), size))
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot, bits = widespread(source, total, size)
    regions = cut_lineage(plain_regions(source, hot, bits, total, size, percent))
    large = regions.filter(F.size("members") > SMALL).select("region", F.explode("members").alias("class"))
    if len(hot):
        large = large.union(hot_rows(source, hot, bits, size, percent))
    large = cut_lineage(merged(large).select("region", "class"))
    # two shared shingles may have the same key in a bucket, so one less than what linked sets share is asked for
    small = set_pairs(regions.filter(F.size("members") <= SMALL), max(1, agreeing(percent) - 1))
    pairs = cut_lineage(likely(source, classes, small, size, percent))
    needed = cut_lineage(classes_of(pairs).union(large.select("class")).distinct())
    sets = cut_lineage(class_views(source, needed, size, np.ndarray.tobytes, "shingles"))
    links = cut_lineage(linked(compared(pairs, sets), percent))
    roots = components(voronoi_links(large, sets, percent, links)).select(F.col("node").alias("__node"), "root")
    return classes.join(roots, F.col("class") == F.col("__node"), "left").select(
        "row", "id", "n", F.when(F.col("n") > 0, F.coalesce("root", "class")).alias("root"))


def link_components(docs: DataFrame, text: str = "text", id_column: str = "doc_id", percent: int = PERCENT,
                    size: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    rows = cut_lineage(rooted(docs, text, id_column, percent, size))
    labels = rows.groupBy(F.col("root").alias("__root")).agg(F.min("id").alias("component"))
    return rows.join(labels, F.col("root") == F.col("__root"), "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def drop_linked(docs: DataFrame, text: str = "text", id_column: str = "doc_id", percent: int = PERCENT,
                size: int = WORDS) -> DataFrame:
    """``docs`` with all columns, of each component only the document with the smallest id."""
    names = list(docs.columns)
    rows = cut_lineage(rooted(docs, text, id_column, percent, size).filter(F.col("root").isNotNull()))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select(
        F.col("first.row").alias("row"))
    place, gone = T.free_name(names, "place"), T.free_name(names, "dropped")
    dropped = cut_lineage(rows.join(first, "row", "left_anti").select(F.col("row").alias(gone)))
    numbered = docs.withColumn(place, F.monotonically_increasing_id())
    return numbered.join(dropped, F.col(place) == F.col(gone), "left_anti").select(*names)
