"""Every text operator against a brute-force version, and on the odd inputs whose results its docstring defines."""

import collections
import functools
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platewise.llm import (
    chunked_bpe, components, cotraining, gated_lm, histogram_packing, host_rules, jaccard_join, language_id,
    order_minhash, repair_shards, trie_counts,
)
from platewise.llm import text as T
from platewise.llm.ordering import id_bounds
from platewise.llm.wordbpe import encode_texts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACES = " \t\n\r\x0b\x0c"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, class string, region int, "
          "part string, length string, rank int, score string, ids string, kept string, label string")


def split_words(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def sentence(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Odd and ordinary documents: NULLs, empty and very long texts, repeated rows, near copies, other scripts."""
    rng = random.Random(4)
    texts = [None, "", "   \n\t ", "one", "Two words", "漢字かな 日本語のテキスト", "1234 5678 !!", "é́ É ß İ ſ\x85x\x1cy",
             "a\n\nb\n a\nb\na", "the end " * 300, sentence(rng, 30_000)]
    base = [sentence(rng, rng.randrange(20, 200)) for _ in range(30)]
    for text in base[:12]:
        words = text.split(" ")
        for _ in range(rng.randrange(1, 4)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    hub = sentence(rng, 120).split(" ")  # many near copies with different texts
    for i in range(40):
        copy = list(hub)
        copy[i] = f"x{i}"
        if i % 3 == 0:
            copy[60 + i] = f"y{i}"
        texts.append(" ".join(copy))
    shared = sentence(rng, 60)  # a passage of otherwise different documents
    texts += [shared + " " + sentence(rng, 90) for _ in range(30)]
    texts += base + [t.upper() for t in base[:5]] + ["Nur deutsche Wörter und mehr davon " * 4, "les mots français étaient là " * 4] * 5
    out = []
    for i, text in enumerate(texts):
        lang = None if i % 11 == 3 else ("de" if text and "deutsch" in text else "fr" if text and "mots" in text else "en")
        out.append((3 * i - 7, text, lang, None if i % 13 == 5 else f"src{i % 3}", None if text is None else len(text)))
    out += [out[20], out[20], (None, base[0], "en", "src0", None), (None, None, None, None, None), (out[40][0], "same id", "en", "src1", 7)]
    rng.shuffle(out)
    return [r + ("i", "c", 1, "p", "l", 1, "s", "ids", "k", "lab") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------------------------------- words and hashes


def test_words_and_windows_agree_with_split():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é漢" + SPACES + "\x85\x1c") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "x"]
    column = pa.array([*texts, None])
    data, offsets = T.buffer_of(column)
    starts, ends, rows = T.words_of(data, offsets)
    found = collections.defaultdict(list)
    for a, b, r in zip(starts, ends, rows):
        found[r].append(bytes(data[a:b]).decode())
    assert [found[i] for i in range(len(texts))] == [split_words(t) for t in texts]
    hashes = T.word_hashes(data, starts, ends)
    lowered = ["".join(c.lower() if "A" <= c <= "Z" else c for c in bytes(data[a:b]).decode()) for a, b in zip(starts, ends)]
    assert len(set(hashes.tolist())) == len(set(lowered))
    # a slice of an array with an offset reads the same rows
    part = pa.RecordBatch.from_arrays([column], ["t"]).slice(5, 50)
    again, where = T.buffer_of(part.column(0))
    assert bytes(again).decode() == "".join(texts[5:55]) and len(where) == 51


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "", "b" * 100, "c"]})
    parts = list(T.slices(batch, 0, limit=12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert list(T.slices(batch.slice(0, 0), 0)) == []


# ------------------------------------------------------------------------------------------- 1 fingerprints


def test_order_minhash_follows_id_order(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = collections.Counter()
    for i, row in enumerate(order):
        text, following = row[1] or "", order[(i + 1) % len(order)][1] or ""
        changed = order_minhash.edited(text, following)
        a, b, c = (order_minhash.fingerprint(x) for x in (text, changed, following))
        expected[(row[0], len(text), hashlib.sha256(changed.encode()).hexdigest(), a.astype(">u2").tobytes().hex(),
                  b.astype(">u2").tobytes().hex(), order_minhash.likeness(a, b), order_minhash.likeness(a, c))] += 1
    for parts in (1, 7):
        found = order_minhash.fingerprints(docs, parts=parts)
        assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert collections.Counter(tuple(r) for r in found.collect()) == expected


def test_order_minhash_is_the_selection_of_smallest_numbered_kmers():
    text = sentence(random.Random(2), 900)
    kmers = order_minhash.numbered_kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert len(set(kmers.tolist())) == len(kmers) == len(text) - order_minhash.KMER + 1
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    expected = []
    for j in range(order_minhash.HASHES):
        values = short * order_minhash._MULTIPLY[j, 0]
        best = sorted(sorted(range(len(values)), key=lambda i: (values[i], i))[:order_minhash.TUPLE])
        total = sum(int(kmers[i]) * int(T._ODD[20 + k]) for k, i in enumerate(best)) % 2**64
        expected.append(int(T.mix(np.array([total], np.uint64))[0]) >> 48)
    assert order_minhash.fingerprint(text).tolist() == expected


def test_order_minhash_sees_order_and_edits():
    rng = random.Random(3)
    a, b = sentence(rng, 300), sentence(rng, 300)
    fp = order_minhash.fingerprint
    near = order_minhash.likeness
    assert near(fp(a), fp(a)) == 1 and near(fp(""), fp("")) == 1 and near(fp(a), fp(b)) < 0.1
    assert near(fp(a), fp(a[:700] + "x" + a[700:])) > 0.85
    half = len(a) // 2
    assert near(fp(a), fp(a[half:] + a[:half])) < 0.8  # the same k-mers, moved


def test_order_minhash_of_nothing(empty):
    assert order_minhash.fingerprints(empty).collect() == []


# ------------------------------------------------------------------------------------------- 2 token counts


def best_count(word, scores):
    longest, floor = max(map(len, scores)), min(scores.values()) - 10_000_000
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * floor, -best[end - 1][1] * -1 + size)]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_trie_counts_equal_plain_segmentation(docs, rows):
    scores = trie_counts.vocabulary(PIECES)
    found = collections.Counter(tuple(r) for r in trie_counts.token_counts(docs, PIECES).collect())
    known = {}
    expected = collections.Counter()
    for row in rows:
        words = split_words(row[1] or "")
        for w in words:
            if w not in known:
                known[w] = best_count("▁" + w, scores)
        expected[(row[0], len(words), sum(known[w] for w in words))] += 1
    assert found == expected


def test_trie_counts_equal_a_unigram_library():
    from tokenizers import Tokenizer, models

    scores = trie_counts.zipf_scores(["▁the", "▁", "th", "e", "he", "t", "h", "in", "ing", "g", "n", "i", "a", "▁a", "nd", "d"])
    model = Tokenizer(models.Unigram([("?", -99.0)] + [(p, s / 1e6) for p, s in scores.items()], 0))
    rng = random.Random(5)
    words = {"▁" + "".join(rng.choice("theinga d".replace(" ", "")) for _ in range(rng.randrange(12))) for _ in range(300)}
    found = trie_counts.trie_counts(words, scores)
    for w in words:
        ids = [i - 1 for i in model.encode(w).ids]
        pieces = list(scores)
        mine = sum(scores[pieces[i]] for i in ids)
        best = max_score(w, scores)
        assert abs(mine - best) <= len(w) and (found[w] == len(ids) or mine == best)


def max_score(word, scores):
    best = [0]
    for end in range(1, len(word) + 1):
        best.append(max(best[s] + scores[word[s:end]] for s in range(end) if word[s:end] in scores))
    return best[-1]


def test_trie_counts_of_nothing(empty):
    assert trie_counts.token_counts(empty, PIECES).collect() == []


# ------------------------------------------------------------------------------------------- 3 language


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    apart = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.filter(~apart))
    found = language_id.predict(docs.filter(apart), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    assert [int(r["held_out"]) for r in docs.select("doc_id", apart.alias("held_out")).orderBy("doc_id").limit(50).collect()] == [
        int(zlib.crc32(str(i).encode()) % 4 == 2) for i in range(50)]
    weights = model.weights
    assert (weights == 0).mean() > 0.3  # the penalty leaves most rare features out


def test_language_id_defined_cases(docs, rows, empty):
    model = language_id.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    found = collections.Counter(tuple(r) for r in language_id.predict(docs, model).collect())
    assert found == collections.Counter((r[0], *model.predict(r[1])) for r in rows)
    for text in (None, "", "1234 5678 !!", "  "):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("漢字")[0] != "und"
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(model.predict(r[1])[1] >= 0.5 for r in rows)
    nothing = language_id.fit(empty)
    assert language_id.predict(empty, nothing).collect() == [] and nothing.predict("text") == ("und", 0.0)
    assert language_id.keep_known(empty, nothing).collect() == []


def test_temperature_mends_confidence():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 4000)
    logits = rng.normal(0, 1, (4000, 3))
    logits[np.arange(4000), labels] += 1.5
    heat = language_id.temperature(logits * 5, labels)
    assert 3 < heat < 8


# ------------------------------------------------------------------------------------------- 4 Jaccard join


def brute_components(rows, percent=75):
    sets = []
    for row in rows:
        words = split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in row[1] or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sets, groups


def test_jaccard_join_equals_all_pairs(docs, rows):
    sets, groups = brute_components(rows)
    expected = collections.Counter()
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            expected[(rows[i][0], len(sets[i]), least if sets[i] else rows[i][0])] += 1
    found = jaccard_join.link_components(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert collections.Counter(tuple(r) for r in found.collect()) == expected
    left = jaccard_join.drop_linked(docs)
    assert left.columns == docs.columns
    assert left.count() == len([g for g in groups.values() if sets[g[0]]]) + sum(not s for s in sets)


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.link_components(empty).collect() == []
    assert jaccard_join.drop_linked(empty).collect() == []


@pytest.mark.parametrize("crowd_bytes", [0, 1 << 20])
def test_voronoi_regions_find_what_all_pairs_find(spark, monkeypatch, crowd_bytes):
    """One region of 120 sets in several loose clusters: joined in one task, and in rounds of pivots over all tasks."""
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rng = np.random.default_rng(8)
    sets = []
    for cluster in range(6):
        core = rng.integers(1, 2**62, 60, dtype=np.uint64)
        for _ in range(20):
            keep = rng.permutation(60)[:rng.integers(44, 60)]
            sets.append(np.unique(np.concatenate((core[keep], rng.integers(1, 2**62, 3, dtype=np.uint64)))))
    table = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "class long, shingles binary")
    regions = spark.createDataFrame([(r, i) for r in (1, 2) for i in range(len(sets))], "region long, class long")
    found = dict(components.components(jaccard_join.voronoi_links(regions, table, crowd_bytes=crowd_bytes)).collect())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = jaccard_join.overlap(sets[i], sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert [found.get(i, i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]
    assert 6 <= len({find(i) for i in range(len(sets))}) < 60


def test_all_widespread_shingles_are_told(spark):
    """17 texts share 270,000 shingles: were some taken for rare ones, each would make a large region."""
    common = " ".join(f"w{i}" for i in range(270_000))
    table = spark.createDataFrame([(i, f"{common} own{i}") for i in range(17)], "doc_id long, text string").repartition(4)
    total = 17 * 269_997
    hot, bits = jaccard_join.widespread(table, total)
    regions = jaccard_join.plain_regions(table, hot, bits, total, 5, 75)
    assert regions.filter(F.size("members") > jaccard_join.SMALL).count() == 0


def test_rarer_ones_of_widespread_shingles_come_first(spark):
    """Half of each text is a line of all 200 texts, half a passage of 20: regions are made by the passages."""
    line = " ".join(f"line{i}" for i in range(64))
    table = spark.createDataFrame(
        [(i, f"{line} | {i} | " + " ".join(f"p{i % 10}x{k}" for k in range(64))) for i in range(200)], "doc_id long, text string")
    hot, bits = jaccard_join.widespread(table, 200 * 126)
    regions = jaccard_join.hot_rows(table, hot, bits, 5, 75).groupBy("region").count().collect()
    assert 10 <= len(regions) and max(r["count"] for r in regions) < 100


def test_texts_that_share_one_shingle_are_not_compared(spark, monkeypatch):
    """100 texts of eight words, five each with one run of five in common, and a copy of each with a word more."""
    texts = [f"a{i} r{i % 20} b c d e b{i} c{i}" for i in range(100)]
    texts += [f"{t} more" for t in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    monkeypatch.setattr(jaccard_join, "SMALL", 30)
    monkeypatch.setattr(jaccard_join, "likely", lambda docs, classes, pairs, *args: seen.append(pairs.count()) or pairs)
    found = dict((r[0], r[2]) for r in jaccard_join.link_components(table).collect())
    assert found == {i: i % 100 for i in range(200)}
    assert seen == [100]


@pytest.mark.parametrize("percent", [50, 67, 90])
def test_jaccard_join_of_few_words_at_any_limit(spark, percent):
    """Sets of one to nine shingles, where the prefixes of linked sets are shortest."""
    rng = np.random.default_rng(percent)
    rows = [(i, " ".join(f"w{w}" for w in range(s, s + n))) for i, (s, n) in enumerate(
        zip(rng.integers(0, 40, 120).tolist(), rng.integers(1, 14, 120).tolist()))]
    _, groups = brute_components(rows, percent)
    expected = {i: min(members) for members in groups.values() for i in members}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.link_components(table, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 700, 5000):
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: int(len(a) * 0.9)], rng.integers(1, 2**63, 1 + n // 2, dtype=np.uint64))))
        bound = jaccard_join.most_common(jaccard_join.sketch(a), jaccard_join.sketch(b))
        assert bound is None or bound >= jaccard_join.overlap(a, b)
        assert jaccard_join.overlap(a, b) == len(np.intersect1d(a, b))
    assert jaccard_join.sketch(np.arange(300, dtype=np.uint64) * np.uint64(1 << 40)) == b""


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (201, 202), (202, 201)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 201: 201, 202: 201}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ------------------------------------------------------------------------------------------- 5 language model


def lower_tokens(text):
    return [w.encode() for w in split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))] + [None]


def test_gated_lm_counts_and_scores(docs, rows):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    counts = collections.Counter()
    for row, apart in zip(rows, held):
        if not apart:
            counts.update(lower_tokens(row[1]))
    n, v = sum(counts.values()), len(counts)
    expected = collections.defaultdict(list)
    for row, apart in zip(rows, held):
        tokens = lower_tokens(row[1])
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        expected[row[0]].append((apart, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    found = collections.defaultdict(list)
    scored = gated_lm.scores(docs).collect()
    for r in scored:
        found[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert {k: sorted(x) for k, x in found.items()} == {k: sorted(x) for k, x in expected.items()}


def test_gated_lm_of_nothing(empty):
    assert gated_lm.scores(empty).collect() == []


def small_vocabulary():
    counts = np.arange(gated_lm.HEAD, 0, -1) * 3
    vocab = gated_lm.Vocabulary(int(counts.sum()), 2000, np.arange(gated_lm.HEAD, dtype=np.uint64), np.arange(gated_lm.HEAD), counts, 3)
    vocab.mass[:] = 50.0
    return vocab


def test_gated_lm_is_a_distribution_and_learns():
    flat = gated_lm.initial(small_vocabulary())
    rng = np.random.default_rng(3)
    docs = [np.array([1, 5, 9, 700, 3] * int(rng.integers(4, 30)), "<u2") for _ in range(60)]
    before = gated_lm.log_likelihoods(flat, docs).sum()
    for _ in range(3):
        flat, seen = gated_lm.learn(flat, docs)
    assert seen > 0 and gated_lm.log_likelihoods(flat, docs).sum() > before * 0.5
    p = gated_lm.views(flat)
    h = rng.normal(0, 0.5, (1, gated_lm.HIDDEN)).astype(np.float32)
    every = np.arange(gated_lm.HEAD + gated_lm.TAIL)
    total = np.exp(gated_lm.output(p, np.repeat(h, len(every), axis=0), every)[0]).sum()
    assert abs(total - 1) < 1e-3


def test_gated_lm_carries_its_state_through_a_document():
    flat, _ = gated_lm.learn(gated_lm.initial(small_vocabulary()), [np.arange(400, dtype="<u2")] * 5)
    docs = [np.arange(n, dtype="<u2") % 1000 for n in (1, 7, 350, 90)] + [np.zeros(0, "<u2")]
    p = gated_lm.views(flat)
    expected = []
    for doc in docs:
        h, total = np.zeros((1, gated_lm.HIDDEN), np.float32), 0.0
        for code in doc.astype(np.int64):
            total += float(gated_lm.output(p, h, np.array([code]))[0][0])
            h, _ = gated_lm.step(p, h, np.array([code]))
        expected.append(total)
    for window in (8, 1 << 14):
        assert np.allclose(gated_lm.log_likelihoods(flat, docs, window), expected, rtol=1e-4)


def test_gated_lm_learns_from_every_document(spark):
    """Documents that a sample of 3 in 32 by the hash of the id would leave out teach the network, to the last token."""
    doc = np.array([1, 5, 9, 700, 3] * 20, "<u2")
    left_out = spark.range(400).filter("pmod(xxhash64(id, 3), 32) >= 3").withColumn("codes", F.lit(doc.tobytes()))
    start = gated_lm.initial(small_vocabulary())
    found = gated_lm.trained(left_out, start)
    assert gated_lm.log_likelihoods(found, [doc])[0] > gated_lm.log_likelihoods(start, [doc])[0] * 0.7
    rounds = [left_out.filter(f"pmod(xxhash64(id, 3), {gated_lm.ROUNDS}) = {i}").count() for i in range(gated_lm.ROUNDS)]
    assert sum(rounds) == left_out.count() and min(rounds) > 0
    for n in (1, 23, 25, 5003):
        changed, seen = gated_lm.learn(start, [np.zeros(n - 1, "<u2"), np.array([900], "<u2")])
        word, before = (gated_lm.views(f)["word_b"][900 // gated_lm.WIDTH, 900 % gated_lm.WIDTH] for f in (changed, start))
        assert seen == n and word > before


def test_gated_lm_gradient():
    rng = np.random.default_rng(4)
    flat = gated_lm.initial(small_vocabulary()).astype(np.float64)
    h, code = rng.normal(0, 1, (6, gated_lm.HIDDEN)), np.array([0, 31, 32, 1023, 1024, 1030])
    gradient = np.zeros(gated_lm.SIZE)
    gated_lm.output(gated_lm.views(flat), h, code, gated_lm.views(gradient))
    for at in rng.choice(np.flatnonzero(gradient), 20):
        up, down = flat.copy(), flat.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        slope = (gated_lm.output(gated_lm.views(down), h, code)[0].sum() - gated_lm.output(gated_lm.views(up), h, code)[0].sum()) / 2e-5
        assert abs(slope - gradient[at]) < 1e-4


# ------------------------------------------------------------------------------------------- 6 shards


@functools.cache
def library_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def library_ids(text, end):
    return library_tokenizer().encode(text or "", add_special_tokens=False).ids + [end]


def test_word_encoding_equals_the_library():
    rng = random.Random(6)
    marks = ["a", "É", "é", " ", "\n", "\t", "'s", "'", "1", "漢", " ", "\x85", "\x1c", "\x0b", "<|endoftext|>", "<|startoftext|>", "<|", "|>",
             "ſ", "Σ", "İ", "%", "&&", "the", " of", ".", "don't", "THE", "ÀÿñÑ", "ß", "×", "÷", "µª", "¼²", "\u0301"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(2000)]
    for text, ids in zip(texts, encode_texts(WORD_BPE, [t.encode() for t in texts], 2)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(text, 2), text


def test_shards_read_back_in_id_order(spark, docs, rows, empty, tmp_path):
    folder = str(tmp_path / "shards")
    repair_shards.write_shards(docs, folder, WORD_BPE, parts=4, shard=5000)
    ids = [library_ids(r[1], 2) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    found = sorted(repair_shards.read_shards(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [rows[i][0] for i in order]
    start = 0
    for r in found:
        got = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == start and r["n_tokens"] == len(got)
        start += len(got)
    assert collections.Counter((r["doc_id"], r["ids"]) for r in found) == collections.Counter(
        (row[0], np.array(x, "<u4").tobytes()) for row, x in zip(rows, ids))
    digests = {(r["start"], r["ids_crc32"]) for r in repair_shards.read_digests(spark, folder).collect()}
    assert digests == {(r["start"], zlib.crc32(r["ids"])) for r in found}
    shards = spark.read.parquet(folder).collect()
    assert len(shards) > 4 and any(len(s["rules"]) for s in shards)
    nothing = str(tmp_path / "nothing")
    repair_shards.write_shards(empty, nothing, WORD_BPE)
    assert repair_shards.read_digests(spark, nothing).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_grammar_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    ids, last = (rng.zipf(1.4, n) % 300).astype(np.uint32), rng.random(n) < 0.05
    last[-1] = True
    symbols, ends, rules, base = repair_shards.compress(ids, last)
    lengths = repair_shards.rule_lengths(rules, base)
    grammar = repair_shards.Grammar(rules, lengths, base)
    assert (grammar.expand(symbols) == ids).all() and len(symbols) <= n
    places, tokens = (np.concatenate(([0], np.flatnonzero(x) + 1)) for x in (ends, last))
    for a, b, c, d in zip(places[:-1], places[1:], tokens[:-1], tokens[1:]):
        assert (grammar.expand(symbols[a:b]) == ids[c:d]).all()
    assert n < 5000 or len(symbols) < 0.8 * n


def test_grammar_leaves_no_frequent_pair():
    """A passage of 64 ids copied 100 times among 200,000 ids becomes one symbol, and no pair is left 4 times."""
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 40_000, 200_000).astype(np.uint32)
    for at in range(100):
        ids[at * 2000:at * 2000 + 64] = np.arange(41_000, 41_064)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    symbols, _, rules, base = repair_shards.compress(ids, last)
    lengths = repair_shards.rule_lengths(rules, base)
    assert (repair_shards.Grammar(rules, lengths, base).expand(symbols) == ids).all() and lengths.max() >= 64
    counts = np.unique((symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:], return_counts=True)[1]
    assert counts.max() < 4


def test_grammar_of_runs():
    ids = np.full(101, 7, np.uint32)
    last = np.zeros(101, bool)
    last[-1] = True
    symbols, _, rules, base = repair_shards.compress(ids, last)
    assert (repair_shards.Grammar(rules, repair_shards.rule_lengths(rules, base), base).expand(symbols) == ids).all()
    assert len(symbols) < 20


# ------------------------------------------------------------------------------------------- 7 quality


def test_cotraining_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = cotraining.score(docs, cotraining.fit(docs, labels)).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] > 0.5) == (r["quality"] == 1) for r in found]) > 0.95
    assert all(0 <= r[c] <= 1 for r in found for c in ("score", "text_score", "meta_score"))


def test_cotraining_passes_labels_between_views():
    """Few labels, of which the second view sees little: what the first view is sure of must reach it."""
    rng = np.random.default_rng(9)
    n = 3000
    truth = rng.integers(0, 2, n)
    first = np.stack((truth * 2.0 - 1 + rng.normal(0, 0.4, n), np.ones(n)), axis=1)
    second = np.concatenate((np.eye(40)[rng.integers(0, 20, n) * 2 + truth], np.ones((n, 1))), axis=1)
    labels = np.where(np.arange(n) < 40, truth, -1)
    held = np.arange(n) % 2 == 1
    held[40:] = False
    alone = cotraining.regression(second[(labels >= 0) & ~held], labels[(labels >= 0) & ~held])
    (_, _, _), (w, _, _) = cotraining.cotrain([first, second], labels, held)
    rest = labels < 0

    def right(weights):
        return ((second[rest] @ weights > 0) == truth[rest]).mean()

    assert right(w) > right(alone) + 0.05


def test_cotraining_takes_pseudo_labels_from_all_documents(spark, monkeypatch):
    """However small the sample of labelled rows, every other document is a candidate in every round."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen, exchange = [], cotraining.exchange

    def watched(views, marks, held, pool, *rest):
        seen.append((len(marks), pool))
        return exchange(views, marks, held, pool, *rest)

    monkeypatch.setattr(cotraining, "exchange", watched)
    assert cotraining.fit(docs, labels, sample=60) is not None
    assert seen[0][0] < 120 and sum(seen[0]) == docs.count()


def test_cotraining_defined_cases(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in cotraining.score(docs, cotraining.fit(docs, none)).collect()} == {0.5}
    marks = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)] + [(rows[0][0], None), (None, 1)], "doc_id long, quality int")
    found = cotraining.score(docs, cotraining.fit(docs, marks)).collect()
    assert len(found) == len(rows) and all(np.isfinite(r["score"]) for r in found)
    assert cotraining.score(empty, cotraining.fit(empty, marks)).collect() == []


# ------------------------------------------------------------------------------------------- 8 packing


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("capacity", [8, 50, 4096])
def test_plan_is_best_fit(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else min(7, capacity) for _ in range(rng.randrange(300))]
        runs, sequences = histogram_packing.plan(collections.Counter(lengths), capacity)
        used = collections.defaultdict(list)
        for length, rank, n, first, per, offset in runs.tolist():
            for i in range(n):
                used[first + i // per].append((offset + i % per * length, length))
        assert sum(map(len, used.values())) == len(lengths)
        assert sequences == plain_best_fit(lengths, capacity) == len(used)
        for places in used.values():
            end = 0
            for at, length in sorted(places):
                assert at == end
                end += length
            assert end <= capacity


def test_packed_documents(docs, rows, empty):
    found = histogram_packing.pack_documents(docs, WORD_BPE, capacity=256).collect()
    pieces = collections.Counter()
    for row in rows:
        ids = library_ids(row[1], 1)
        for k in range(0, len(ids), 256):
            part = np.array(ids[k:k + 256], "<u4")
            pieces[(row[0], k // 256, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == pieces
    used = collections.defaultdict(list)
    for r in found:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 256
    assert len(used) == plain_best_fit([r["length"] for r in found], 256)
    assert histogram_packing.pack_documents(empty, WORD_BPE).collect() == []


# ------------------------------------------------------------------------------------------- 9 byte-level encoding


def tiktoken_encoding():
    return chunked_bpe.Coder(BYTE_BPE, public_tokenizers.PATTERN).ids.encoding


def test_stitched_chunks_equal_the_whole():
    coder, library = chunked_bpe.Coder(BYTE_BPE, public_tokenizers.PATTERN), tiktoken_encoding()
    rng = random.Random(7)
    for k in range(400):
        text = "".join(rng.choice(["a", "b", " ", "1", "\n", "\t", "'s", "'", ".", "é", "漢", "  "]) for _ in range(rng.randrange(300)))
        text += "a" * rng.randrange(200) * (k % 3 == 0) + " " * rng.randrange(90) * (k % 4 == 0) + "x" * (k % 2)
        chunks = [(b, w, *coder.window(w, b, f), f) for b, w, f in chunked_bpe.cut_chunks(text, 40, 8)]
        expected = np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert coder.stitch(chunks) == coder.encode(text) == expected
        assert coder.decode(expected) == text.encode()


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_encoded_documents(docs, rows, empty, chunk):
    library = tiktoken_encoding()
    encoded = chunked_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN, chunk=chunk, overlap=16)
    found = chunked_bpe.digests(chunked_bpe.decode(encoded, BYTE_BPE, public_tokenizers.PATTERN))
    expected = collections.Counter()
    for row in rows:
        text = row[1] or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        expected[(row[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in found.collect()) == expected
    assert chunked_bpe.encode(empty, BYTE_BPE, public_tokenizers.PATTERN).collect() == []


# ------------------------------------------------------------------------------------------- 10 rules


def brute_rules(text):
    text = text or ""
    words = split_words(text)
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if split_words(line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_host_rules_equal_plain_counts(docs, rows, empty):
    found = host_rules.host_verdicts(docs)
    counts = collections.Counter(tuple(r) for r in found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert counts == collections.Counter((r[0], *brute_rules(r[1])) for r in rows)
    assert host_rules.host_verdicts(empty).collect() == []


def test_a_bad_host_loses_its_good_documents(spark):
    rng = random.Random(8)
    good, bad = sentence(rng, 80), "too short"
    rows = [(i, good if i % 10 else bad, f"good{i % 4}") for i in range(200)]
    rows += [(1000 + i, bad if i % 10 else good, "bad") for i in range(100)]
    rows += [(2000, good, None), (2001, bad, None), (2002, bad, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in host_rules.host_verdicts(docs).filter("kept").collect()}
    assert kept == {i for i in range(200) if i % 10} | {2000}
    left = host_rules.drop_rejected(docs.withColumnRenamed("source", "source"))
    assert left.columns == ["doc_id", "text", "source"] and {r["doc_id"] for r in left.collect()} == kept


def test_id_bounds_cover_extremes(spark):
    ids = spark.createDataFrame([(i,) for i in [-2**62, 0, 5, 5, 5, None, 2**62]], "id long")
    assert len(id_bounds(ids, "id", 4)) <= 3 and len(id_bounds(ids.limit(0), "id", 4)) == 0


# ------------------------------------------------------------------------------------------- pipeline


def test_pipeline_equals_its_stages_by_hand(spark, docs, rows, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit(source.filter(~language_id.held_out(F.col("doc_id"), 4, 2)))
    left = [r for r in rows if model.predict(r[1])[1] >= 0.5]
    stats = [(r, brute_rules(r[1])[-1]) for r in left]
    hosts = collections.defaultdict(list)
    for r, failed in stats:
        hosts[r[3]].append(failed)
    rates = {h: sum(x) / len(x) for h, x in hosts.items() if h is not None}
    mean = np.mean(list(rates.values()))
    between = np.mean([v * v for v in rates.values()]) - mean**2 - mean * (1 - mean) * np.mean([1 / len(hosts[h]) for h in rates])
    weight = min(max(mean * (1 - mean) / between - 1, 1), 10_000) if between > 0 else 10_000
    bad = {h for h in rates if (sum(hosts[h]) + mean * weight) / (len(hosts[h]) + weight) > 0.5}
    left = [r for r, failed in stats if not failed and r[3] not in bad]
    sets, groups = brute_components(left)
    expected = collections.Counter()
    for members in groups.values():
        first = min(members, key=lambda i: (left[i][0] is None, left[i][0] or 0))
        expected[(left[first][0], len(library_ids(left[first][1], 1)))] += 1
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    totals = collections.Counter()
    for r in found:
        totals[r["doc_id"]] += r["length"]
    assert collections.Counter((k, v) for k, v in totals.items()) == expected
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "jaccard_join", "packing"]


def test_stages_leave_columns_of_any_name_alone(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "h", 1, 2, 3, 4, 5, 6) for i in range(3)] + [(9, "short", "h", 1, 2, 3, 4, 5, 6)]
    rows.append((10, rows[0][1], "h", 1, 2, 3, 4, 5, 6))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bad_host int, BAD_HOST_ int, place int, Dropped int, "
                                     "__bad_host int, __place int")
    assert [r["doc_id"] for r in host_rules.drop_rejected(df).orderBy("doc_id").collect()] == [0, 1, 2, 10]
    left = jaccard_join.drop_linked(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 9]


def test_tidy_releases_after_the_last_batch():
    done = list(T.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2])))
    assert done == [2, 3] and len(T._powers[0]) == 1


def test_word_table_is_emptied_when_it_holds_too_many_bytes(monkeypatch):
    from platewise.llm import wordbpe

    wordbpe._table.cache_clear()
    texts = [f"word{i} other{i} w{i % 7}".encode() for i in range(300)]
    want = encode_texts(WORD_BPE, texts, 1)
    wordbpe._table.cache_clear()
    monkeypatch.setattr(wordbpe, "CACHE_BYTES", 3000)
    assert [encode_texts(WORD_BPE, [t], 1)[0] for t in texts] == want
    table = wordbpe._table(WORD_BPE)
    assert table.held <= 3000 and 0 < len(table.ids) < 20
    wordbpe._table.cache_clear()


def test_strings_of_added_tokens_are_those_tokens_as_in_the_library():
    for text in ("<|endoftext|>", "x<|startoftext|>y", "A <|endoftext|><|endoftext|> B", "<|ENDOFTEXT|>", "<|endoftext", "no marks"):
        ids = np.frombuffer(encode_texts(WORD_BPE, [text.encode()], 7)[0], "<u4").tolist()
        assert ids == library_ids(text, 7)
    assert np.frombuffer(encode_texts(WORD_BPE, [b"<|endoftext|>"], 7)[0], "<u4").tolist() == [49407, 7]


@pytest.mark.parametrize("bits, count", [(1, 9), (5, 0), (17, 1001), (32, 7)])
def test_packed_bits_round_trip(bits, count):
    values = np.random.default_rng(bits).integers(0, 1 << bits, count, dtype=np.uint64).astype(np.uint32)
    packed = repair_shards.pack_bits(values, bits)
    assert len(packed) == -(-bits * count // 8)
    assert repair_shards.unpack_bits(packed, bits, count).tolist() == values.tolist()


def test_a_shard_of_given_documents_is_smaller_than_its_plain_ids():
    """Symbols, rules and lengths, against ids of two bytes; every rule is used, and none but inner ones fewer than 3 times."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()][:4000]
    docs = [np.frombuffer(x, "<u4") for x in encode_texts(WORD_BPE, [t.encode() for t in texts], 2)]
    ids, last = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, ends, rules, base = repair_shards.compress(ids, last)
    lengths = repair_shards.rule_lengths(rules, base)
    bits, length_bits = repair_shards.bits_for(base + len(rules)), repair_shards.bits_for(int(lengths.max()) + 1)
    size = sum(len(repair_shards.pack_bits(x, b)) for x, b in ((symbols, bits), (rules.ravel(), bits), (lengths, length_bits)))
    assert size < 0.65 * 2 * len(ids)
    assert (repair_shards.Grammar(rules, lengths, base).expand(symbols) == ids).all() and ends.sum() == len(docs)
    in_symbols = np.bincount(symbols[symbols >= base] - base, minlength=len(rules))
    in_rules = np.bincount(rules[rules >= base] - base, minlength=len(rules))
    assert ((in_symbols >= repair_shards.USES) | (in_rules > 0)).all()


def test_gated_lm_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.integers(0, 1030, 60).astype("<u2").tobytes()) for i in range(90)]
    codes = spark.createDataFrame(data, "id long, codes binary")
    start = gated_lm.initial(small_vocabulary())
    one, many = (gated_lm.trained(codes.repartition(n), start, lot=600) for n in (1, 7))
    assert not np.array_equal(one, start) and np.array_equal(one, many)


def test_gated_lm_grows_with_the_corpus():
    sizes = [gated_lm.shape_for(n) for n in (0, 10 ** 6, 5 * 10 ** 8, 3 * 10 ** 10, 10 ** 14)]
    assert [s.head for s in sizes] == [1024, 1024, 4096, 8192, 65536]
    assert sizes[-1].dtype == "<u4" and sizes[0].dtype == "<u2" and sizes[0].size == gated_lm.SIZE


def test_rounds_over_new_pairs_find_what_rounds_over_all_pairs_find(monkeypatch):
    rng = np.random.default_rng(5)
    cases = []
    for size in (2, 50, 400, 3000):
        ids = rng.integers(0, 4, size).astype(np.uint32)
        last = rng.random(size) < 0.05
        last[-1] = True
        cases.append((ids, last))
    found = [repair_shards.compress(*case) for case in cases]
    every = repair_shards.frequent
    monkeypatch.setattr(repair_shards, "frequent", lambda symbols, last, enough, since=0: every(symbols, last, enough))
    for case, got in zip(cases, found):
        assert all(np.array_equal(a, b) for a, b in zip(got, repair_shards.compress(*case)))


def test_common_words_outlive_a_full_word_table(monkeypatch):
    from platewise.llm import wordbpe

    wordbpe._table.cache_clear()
    monkeypatch.setattr(wordbpe, "CACHE_BYTES", 4000)
    seen, encode = [], wordbpe._encode_words
    monkeypatch.setattr(wordbpe, "_encode_words", lambda path, words, known: (seen.extend(words), encode(path, words, known))[1])
    texts = [f"common word{i} café, {i}!".encode() for i in range(200)]
    for text in texts:
        ids = np.frombuffer(encode_texts(WORD_BPE, [text, b"", b" \t"], 1)[0], "<u4").tolist()
        assert ids == library_ids(text.decode(), 1)
        assert wordbpe._table(WORD_BPE).held <= 4000
    assert seen.count(b"common") == 1 and len(set(seen)) > 200
    wordbpe._table.cache_clear()


def test_plain_words_are_cut_into_letters_and_marks(monkeypatch):
    """A word is encoded once, whatever marks stand around it; what the split cuts otherwise stays whole."""
    from platewise.llm import wordbpe

    wordbpe._table.cache_clear()
    seen, encode = [], wordbpe._encode_words
    monkeypatch.setattr(wordbpe, "_encode_words", lambda path, words, known: (seen.extend(words), encode(path, words, known))[1])
    texts = ["Lorem, lorem. (lorem) -- \"LOREM\"; lorem... lorem-Ärger/ärger ÷Ä× straße, 'til don't 'sun x1y 3,5 áb",
             "", " \t", "Ã", "è÷é ×", "!", "ÿÿ!ÿ", "привет, lorem\x7f,  x \u0085y", "lorem's ''s '' '", "a\x00b \x01,", "中文,字"]
    found = encode_texts(WORD_BPE, [t.encode() for t in texts], 1)
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(text, 1), text
    assert seen.count(b"lorem") == 1 and seen.count(b",") == 1 and b"lorem," not in seen and b"don't" in seen
    wordbpe._table.cache_clear()


def test_every_plain_letter_is_encoded_as_the_library_does():
    plain = [chr(c) for c in (*range(0xC0, 0x100),)]
    text = " ".join([*plain, *(f"a{x}b{x}" for x in plain), "".join(x for x in plain if x not in "×÷")])
    assert np.frombuffer(encode_texts(WORD_BPE, [text.encode()], 1)[0], "<u4").tolist() == library_ids(text, 1)


def test_gated_lm_learns_along_its_gradient():
    """The squares of the first step are those of the gradient through all steps of a document, of every kind of parameter."""
    rng = np.random.default_rng(6)
    flat = gated_lm.initial(small_vocabulary())
    flat[:] += rng.normal(0, 0.1, len(flat)).astype(np.float32)
    doc = rng.choice([3, 40, 700, 1023, 1026], 20).astype("<u2")
    squares = np.full(len(flat), 1e-30, np.float32)
    gated_lm.learn(flat, [doc[:12], doc[12:]], squares=squares)
    found, total = gated_lm.views(np.sqrt(squares)), lambda x: gated_lm.log_likelihoods(x, [doc[:12], doc[12:]]).sum() / len(doc)
    for name in ("embed", "recur", "shift", "class_w", "class_b", "word_w", "word_b"):
        at = np.unravel_index(np.argmax(found[name]), found[name].shape)
        up, down = flat.copy(), flat.copy()
        gated_lm.views(up)[name][at] += 0.02
        gated_lm.views(down)[name][at] -= 0.02
        assert np.isclose(abs(total(up) - total(down)) / 0.04, found[name][at], rtol=0.02), name
    assert not np.sqrt(squares[:3 * gated_lm.HIDDEN]).max() > 1e-14  # a code that is not met teaches nothing


def test_gated_lm_scores_documents_abreast_in_blocks(monkeypatch):
    rng = np.random.default_rng(7)
    flat = gated_lm.initial(small_vocabulary())
    docs = [rng.integers(0, 1030, n).astype("<u2") for n in (1, 9, 0, 30, 30, 4, 17, 90)]
    whole = gated_lm.log_likelihoods(flat, docs)
    monkeypatch.setattr(gated_lm, "ABREAST", 3)
    assert np.allclose(gated_lm.log_likelihoods(flat, docs), whole, rtol=1e-5) and whole[2] == 0


def test_softmax_of_large_scores():
    scores = np.array([[300.0, 0.0], [0.0, -300.0], [1.0, 1.0]], np.float32)
    logs, totals = gated_lm._softmax(scores, np.array([1, 1, 0]))
    assert np.allclose(logs, [-300, -300, -np.log(2)]) and np.isfinite(totals).all()


def test_words_by_block():
    rng = np.random.default_rng(8)
    for n in (1, 2, 300):
        blocks, sizes = rng.integers(0, 1 + n // 4, n), rng.integers(1, 9, n)
        tokens = rng.integers(0, 30, sizes.sum()).astype(np.uint64)
        of = np.repeat(blocks, sizes)
        found = {block: words.tolist() for block, words in gated_lm.words_by_block(blocks, sizes, tokens)}
        assert found == {block: np.unique(tokens[of == block]).tolist() for block in np.unique(blocks).tolist()}


def test_frequent_pairs_of_small_and_of_large_symbols():
    """Pair and place in one number where they fit 64 bits, and apart where they do not, find the same."""
    rng = np.random.default_rng(9)
    for size in (2, 40, 3000):
        ids, last = rng.integers(0, 6, size).astype(np.uint32), rng.random(size) < 0.1
        for enough, since in ((1, 0), (4, 0), (4, 3)):
            at, number, pairs = repair_shards.frequent(ids, last, enough, since)
            expected = collections.defaultdict(list)
            for i in range(size - 1):
                if not last[i] and max(ids[i], ids[i + 1]) >= since:
                    expected[int(ids[i]), int(ids[i + 1])].append(i)
            expected = {k: x for k, x in expected.items() if len(x) >= enough}
            assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs] == sorted(expected)
            assert at.tolist() == sorted(itertools.chain(*expected.values()))
            assert all(i in expected[int(pairs[n]) >> 32, int(pairs[n]) & 0xFFFFFFFF] for i, n in zip(at.tolist(), number.tolist()))
            shift = np.uint32(1 << 31)
            wide = repair_shards.frequent(ids + shift, last, enough, since + (1 << 31) if since else 0)
            assert np.array_equal(wide[0], at) and np.array_equal(wide[1], number)


def test_levels_of_rules_are_those_of_one_by_one():
    rng = np.random.default_rng(10)
    ids = rng.integers(0, 4, 5000).astype(np.uint32)
    last = np.arange(5000) == 4999
    rules, base = repair_shards.compress(ids, last)[2:]
    runs = repair_shards.levels(rules, base)
    assert len(runs) > 1 and [r.start for r in runs] + [len(rules)] == [0] + [r.stop for r in runs]
    assert all((rules[r] < base + r.start).all() for r in runs)
    lengths = []
    for left, right in rules.tolist():
        lengths.append(sum(lengths[x - base] if x >= base else 1 for x in (left, right)))
    assert repair_shards.rule_lengths(rules, base).tolist() == lengths
    assert repair_shards.levels(np.zeros((0, 2), np.uint32), 4) == [] and not len(repair_shards.rule_lengths(np.zeros((0, 2), np.uint32), 4))
