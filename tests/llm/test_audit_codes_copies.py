"""The filter audit, vector codes and exact duplicates against brute-force versions, and on odd inputs."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import content_sort, filter_audit, vector_codes

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, digest string, content string, lead int, "
          "part string, mask string, first string, x0 string, edge string, range string, n int")
SPACE = " \t\n\r\x0b\x0c"


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)

    def prose(n, alphabet="abcdefghij"):
        return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))) for _ in range(n))

    texts = [None, "", "", " \t\n", "one", "Ünï ß 漢字", "A" * 40, prose(250), prose(250) + " $", prose(230).upper(), "a b " * 150,
             prose(40_000), "x" * 200_000, "the same " * 20 + "end", "x" * 40, "x" * 40 + "y", "x" * 40 + "z", "tail\x85 \x1cw"]
    texts += [prose(rng.randrange(150, 320)) + rng.choice(["", " #", " UPPER CASE WORDS"]) for _ in range(60)]
    texts += texts[8:30] + ["copy of very many"] * 300 + [texts[7]] * 5
    out = [(i * 7 - 50, t, [None, "", "en", "de", "junk"][i % 5], "s", 1) for i, t in enumerate(texts)]
    out += [out[20], out[20], out[90], (None, texts[7], "en", "s", 1), (None, texts[7], "de", "s", 1), (None, "alone", None, None, None),
            (None, None, None, None, None), (out[7][0], texts[7], "other", "s", 2)]
    rng.shuffle(out)
    return [r + ("i", "d", "c", 1, "p", "m", "f", "x", "e", "r", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------------------------------- 11 filter audit


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    ids = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            ids[r[1] or ""].append(r[0])
    parts = collections.defaultdict(list)
    for r in rows:
        text = r[1] or ""
        words = words_of(text)
        fails = {f for f, failed in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": any(r[0] is None or i < r[0] for i in ids[text])}.items() if failed}
        parts[r[2] or ""].append((fails, r[0] in good, r[0] in toxic))
    out, removed_by = [], collections.Counter()
    for part, held in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = list(held)
            for step, f in enumerate(order, 1):
                gone, before = [d for d in left if f in d[0]], len(held)
                left = [d for d in left if f not in d[0]]
                failing = [d for d in held if f in d[0]]
                removed_by[part, f] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                            sum(d[0] == {f} for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone)))
                assert before >= len(left)
    return sorted((r + (removed_by[r[0], r[1][r[2] - 1]],) for r in out), key=repr)


def test_filter_audit_agrees_with_running_every_order(spark, docs, rows):
    labels = [(i * 7 - 50, i % 3 % 2, i % 4 == 1) for i in range(60)] + [(-1, None, None), (None, 1, 1), (-50, 1, 0), (-50, 0, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    table = spark.createDataFrame([r + ("a", 1) for r in labels], "doc_id long, quality int, toxic int, id string, mask int")
    found = as_rows(filter_audit.filter_audit(docs, table))
    assert found == brute_audit(rows, labels)
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_text_failures():
    text_failures = filter_audit.text_failures
    assert text_failures(b"") == 1
    assert text_failures(" ".join(f"w{i}" for i in range(200)).encode()) == 0
    assert text_failures(" ".join(["a", "b"] * 100).encode()) == 2
    assert text_failures(("ab " * 1).encode() + b"A") & 4 == 4
    assert text_failures(("é" * 97 + "ABC").encode()) & 4 == 0 and text_failures(("é" * 96 + "ABC").encode()) & 4 == 4
    assert text_failures(b"5 |") & 8 == 8


def test_contractions_equal_sums_over_cells():
    rng = np.random.default_rng(5)
    tensors = rng.integers(0, 100, (3, 2, 2, 2, 2, 2))
    orders = [(2, 0, 4, 1, 3), (0, 1, 2, 3, 4)]
    choices = filter_audit.choices_of(orders)
    got = filter_audit.contract(tensors, choices["removed"])
    for i, (order, step) in enumerate((o, s) for o in orders for s in range(5)):
        total = np.zeros(3, np.int64)
        for cell in itertools.product((0, 1), repeat=5):
            if all(cell[f] == 0 for f in order[:step]) and cell[order[step]] == 1:
                total += tensors[(slice(None), *cell)]
        assert got[:, i].tolist() == total.tolist()


def test_filter_audit_of_nothing(spark, empty, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty, labels).collect() == []
    assert as_rows(filter_audit.filter_audit(docs, labels)) == brute_audit(rows, [])


# ------------------------------------------------------------------------------------------- 12 vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v in cut:
                groups[nearest(v[p], books[p])[1]].append(v[p])
            for e, members in groups.items():
                books[p][e] = [sum(xs) // len(members) for xs in zip(*members)]
    best = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in b) for b in best]
    by_label = collections.Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in b), error, by_label[label], digest)
                   for (i, _, label), b, error in zip(kept, best, errors)), key=repr)


def vectors(n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (5, width))
    rows = [(int(i) * 3 - 10, (centres[i % 5] + rng.normal(0, spread / 3, width)).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(1, None, 1), (2, [None] + [0.0] * (width - 1), 1), (3, [float("nan")] * width, 2), (4, [float("inf")] * width, 2),
             (None, rows[0][1], None), (None, rows[1][1], 1), rows[5], rows[5], (-10, rows[6][1], 9)]
    return rows


@pytest.mark.parametrize("n, width, seed", [(150, 16, 1), (60, 64, 2), (7, 8, 3), (80, 8, 4)])
def test_vector_codes_agree_with_comparing_all_entries(spark, n, width, seed):
    rows = vectors(n, width, seed)
    df = spark.createDataFrame([r + ("x", 1) for r in rows], "vec_id long, embedding array<double>, label int, numbers string, code int")
    assert as_rows(vector_codes.compress(df.repartition(3))) == brute_codes(rows)


def test_vector_codes_ties_and_hot_vectors(spark):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(40)] + [(100 + i, [0.5] * 8, 0) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert as_rows(vector_codes.compress(df)) == brute_codes(rows)


def test_vector_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 12, 1)], schema))
    with pytest.raises(Exception, match="32768"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], schema)).collect()


@pytest.mark.parametrize("bits", [1, 4, 9, 14])
def test_cells_never_lose_the_nearest_entry(bits):
    rng = np.random.default_rng(bits)
    entries = rng.integers(-1500, 1500, (16, 4))
    entries[7] = entries[3]
    points = np.concatenate([rng.integers(-3000, 3000, (3000, 4)), entries, (entries[:8] + entries[8:]) // 2])
    cells = vector_codes.Cells(entries, bits)
    index, distance = cells.nearest(points)
    full = ((points[:, None] - entries) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (distance == full.min(1)).all()
    if bits < 10:
        assert cells.evaluated < 0.7 * full.size  # dominated entries are not looked at
    before = len(cells.found)
    cells.nearest(points)
    assert len(cells.found) == before


def test_codes_are_read_back_as_vectors(spark):
    rows = [(i, np.random.default_rng(i).normal(0, 0.3, 16).tolist(), 0) for i in range(16)]
    numbers = vector_codes.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    books = vector_codes.fit(numbers, rounds=0)
    coded = sorted(vector_codes.encode(numbers, books).collect())
    again = vector_codes.decode([r["code"] for r in coded], books)
    assert [r["error"] for r in coded] == [0] * 16
    assert np.abs(again - np.array([r[1] for r in rows])).max() <= 0.5 / 4096 + 1e-12


# ------------------------------------------------------------------------------------------- 13 exact duplicates


def brute_copies(rows, keep=max):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        stays = keep(real) if real else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [[i, stays, len(ids), False, digest] for i in ids]
        next(r for r in out[-len(ids):] if r[0] == stays)[3] = True
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_copies_agree_with_grouping_whole_texts(spark, docs, rows, parts):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_rows(content_sort.copies(docs)) == brute_copies(rows)
        assert as_rows(content_sort.copies(docs, keep="smallest")) == brute_copies(rows, min)
        if parts == 40:
            found = content_sort.runs(content_sort.sorted_contents(docs))
            spread = found.groupBy("digest").agg(F.count_distinct("range").alias("n")).agg(F.max("n")).first()[0]
            assert spread > 3  # the large group of copies lies in several ranges
        for keep, pick in (("largest", max), ("smallest", min)):
            left = content_sort.drop_copies(docs, keep=keep)
            assert left.schema == docs.schema
            expected = sorted((r[0], r[4]) for r in brute_copies(rows, pick) if r[3] and r[0] is not None)
            got = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in left.collect()]
            assert sorted(g for g in got if g[0] is not None) == expected
            assert len(got) == len({r[1] or "" for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_copies_after_normalisation(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in content_sort.copies(df, F.lower("text")).collect()}
    assert found == {1: (2, False), 2: (2, True), 3: (3, True), 4: (5, False), 5: (5, True)}
    left = {r["doc_id"]: r["text"] for r in content_sort.drop_copies(df, F.lower("text"), keep="smallest").collect()}
    assert left == {1: "A b", 3: "c", 4: None}


def test_copies_of_nothing(empty):
    assert content_sort.copies(empty).collect() == []
    assert content_sort.drop_copies(empty).collect() == []
    with pytest.raises(ValueError):
        content_sort.copies(empty, keep="any")
