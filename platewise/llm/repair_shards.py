"""Token-id files in ascending id order, each shard compressed by a Re-Pair grammar.

Texts are encoded where they are read; the ids go to the task of their id range, where they are sorted and cut into
shards of about ``SHARD`` ids. In each shard the frequent pairs of neighbouring symbols are replaced by
nonterminals, round after round. A pair never crosses the end of a document, so that each document is a run of whole
symbols: it is decoded by itself from the rules, their expansion lengths and its place in the sequence.

The file format is a Parquet row per shard (see ``SCHEMA``), written by Spark, so a lost task leaves nothing behind
and any store that Spark reaches will do. ``start`` counts ids within the part; the totals of the parts, one
number each, give the place in the whole corpus.

Defined cases: NULL counts as the empty text, which holds the end id alone; a NULL document id comes first;
equal ids are ordered by their token ids; an empty table gives no shard and no row; only the id and text columns
are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.llm.ordering import default_parts, id_bounds, part_of
from platewise.llm.wordbpe import encode_texts, texts_of

SHARD = 1 << 20
SCHEMA = ("part int, shard int, start long, n_tokens long, doc_ids array<long>, doc_tokens binary, doc_symbols binary, "
          "base int, n_rules int, n_symbols long, bits int, length_bits int, rules binary, lengths binary, symbols binary")
TEXTS = 1 << 21  # bytes of texts encoded at a time: the more, the fewer distinct words are looked up
SLOT_BITS = 18  # counts of slots that stay near the core
USES, STEP = 3, 4


def bits_for(values: int) -> int:
    """Bits of a whole number below ``values``."""
    return max(1, int(values - 1).bit_length())


def slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS)


def frequent(symbols: np.ndarray, last: np.ndarray, enough: int, since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, number, pairs): where pairs found ``enough`` times begin, and which of ``pairs`` each is.

    Only pairs with a symbol from ``since`` on are looked at. Pairs in slots of a hash that are not found so often are passed
    over, the others are sorted and counted.
    """
    if since:
        new = symbols >= since
        at = np.flatnonzero((new[:-1] | new[1:]) & ~last[:-1])
        slot = slots(symbols[at], symbols[at + 1])
        at = at[(np.bincount(slot, minlength=1 << SLOT_BITS) >= enough)[slot]]
    else:
        slot = slots(symbols[:-1], symbols[1:])
        at = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= enough)[slot] & ~last[:-1])
    left, right = symbols[at].astype(np.uint64), symbols[at + 1]
    wide, far = bits_for(int(symbols.max()) + 1), bits_for(len(symbols))
    if 2 * wide + far > 64:
        pairs, back, counts = np.unique((left << np.uint64(32)) | right, return_inverse=True, return_counts=True)
        good = counts >= enough
        chosen = good[back]
        return at[chosen], (np.cumsum(good) - 1)[back[chosen]], pairs[good]
    # pair and place in one number: sorting values is far cheaper than sorting their order
    keys = (((left << np.uint64(wide)) | right) << np.uint64(far)) | at.astype(np.uint64)
    keys.sort()
    pairs = keys >> np.uint64(far)
    firsts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
    counts = np.diff(firsts, append=len(pairs))
    good = counts >= enough
    pairs, counts = pairs[firsts[good]], counts[good]
    places = keys[np.repeat(good, np.diff(firsts, append=len(keys)))] & np.uint64((1 << far) - 1)
    both = (places << np.uint64(32)) | np.repeat(np.arange(len(pairs), dtype=np.uint64), counts)
    both.sort()
    pairs = ((pairs >> np.uint64(wide)) << np.uint64(32)) | (pairs & np.uint64((1 << wide) - 1))
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64), pairs


def compress(ids: np.ndarray, last: np.ndarray, share: int = 4096, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, last, rules [n, 2], base): symbols from ``base`` on stand for a pair of earlier symbols.

    A round replaces every pair found often enough, except where it would overlap the replacement before it. Enough is
    ``symbols / share`` times at first and a ``STEP``-th of that whenever no pair is left, down to ``least``, where rounds go on
    until no pair is found so often. Every place of such a pair is replaced or loses a symbol to the replacement before
    it, so in the next round only pairs with a new symbol can be found so often. Rules that save nothing are taken back.
    ``last`` marks the last symbol of each document.
    """
    symbols, last = ids.astype(np.uint32), last.copy()
    base = int(symbols.max()) + 1 if len(symbols) else 0
    rules = np.zeros((0, 2), np.uint32)
    enough, since = max(least, len(symbols) // share), 0
    while len(symbols) > 1:
        at, number, pairs = frequent(symbols, last, enough, since)
        if not len(at):
            if enough == least:
                break
            enough, since = max(least, enough // STEP), 0
            continue
        since = base + len(rules)
        fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - begin) % 2 == 0
        at, number = at[take], number[take]
        symbols[at] = (base + len(rules) + number).astype(np.uint32)
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        rules = np.concatenate((rules, np.stack(
            ((pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)), axis=1)))
    return (*worthwhile(symbols, last, rules, base), base)


def levels(rules: np.ndarray, base: int) -> list[slice]:
    """Runs of rules none of which stands in a rule of its own run, in order."""
    latest = rules.max(axis=1).astype(np.int64) - base if len(rules) else np.zeros(0, np.int64)
    out, start = [], 0
    while start < len(latest):
        later = np.flatnonzero(latest[start:] >= start)
        stop = start + int(later[0]) if len(later) else len(latest)
        out.append(slice(start, stop))
        start = stop
    return out


def worthwhile(symbols: np.ndarray, last: np.ndarray, rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the rules that stand in the symbols alone and fewer than ``USES`` times: those cost what they save."""
    uses = np.bincount(symbols[symbols >= base] - base, minlength=len(rules))
    kept, pairs = np.zeros(len(rules), bool), rules.astype(np.int64) - base
    for own in reversed(levels(rules, base)):
        kept[own] |= uses[own] >= USES
        needed = kept[own]
        inner = pairs[own][needed].ravel()
        kept[inner[inner >= 0]] = True
        inner, more = pairs[own][~needed].ravel(), np.repeat(uses[own][~needed], 2)
        np.add.at(uses, inner[inner >= 0], more[inner >= 0])
    while True:
        gone = np.zeros(len(symbols), bool)
        ruled = symbols >= base
        gone[ruled] = ~kept[symbols[ruled] - base]
        if not gone.any():
            break
        wide = np.repeat(np.arange(len(symbols)), 1 + gone)
        second = np.concatenate(([False], wide[1:] == wide[:-1]))
        inner = gone[wide]
        fresh = symbols[wide]
        fresh[inner] = rules[fresh[inner] - base, second[inner].astype(np.int64)]
        ends = last[wide]
        ends[inner & ~second] = False
        symbols, last = fresh, ends
    place = np.concatenate((np.arange(base), base + np.cumsum(kept) - 1)).astype(np.uint32)
    return place[symbols] if len(symbols) else symbols, last, place[rules[kept]].reshape(-1, 2)


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Whole numbers below 2**bits, ``bits`` bits each."""
    wide = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits:]).tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits:] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each nonterminal expands to."""
    out = np.ones(len(rules) + 1, np.int64)  # the last place is that of any id
    inner = np.maximum(rules.astype(np.int64) - base, -1)
    for own in levels(rules, base):
        out[own] = out[inner[own]].sum(axis=1)
    return out[:-1].astype(np.uint32)


class Grammar:
    """Decoder of one shard's symbols."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int) -> None:
        self.base = base
        self.starts = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
        # all expansions at once: symbols that are not ids yet are replaced by their pairs, level by level
        flat, pairs = rules.ravel(), rules.astype(np.uint32)
        while len(flat) and (open_ := flat >= base).any():
            wide = np.repeat(np.arange(len(flat)), 1 + open_)
            second = np.concatenate(([False], wide[1:] == wide[:-1]))
            inner = open_[wide]
            fresh = flat[wide]
            fresh[inner] = pairs[fresh[inner] - base, second[inner].astype(np.int64)]
            flat = fresh
        self.flat = flat.astype(np.uint32)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Token ids of any run of symbols."""
        rule = symbols.astype(np.int64) - self.base
        plain = rule < 0
        rule[plain] = 0
        sizes = np.where(plain, 1, np.diff(self.starts)[rule] if len(self.starts) > 1 else 1)
        begin = np.cumsum(sizes) - sizes
        source = np.repeat(np.where(plain, 0, self.starts[rule]) - begin, sizes) + np.arange(int(sizes.sum()))
        literal = np.repeat(plain, sizes)
        if not len(self.flat):
            return symbols.astype(np.uint32)
        source[literal] = 0
        out = self.flat[source]
        out[literal] = symbols[plain]
        return out


def _shard(part: int, number: int, start: int, doc_ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, ends, rules, base = compress(ids, last)
    lengths = rule_lengths(rules, base)
    bits, length_bits = bits_for(base + len(rules)), bits_for(int(lengths.max()) + 1 if len(lengths) else 1)
    doc_symbols = np.concatenate(([0], np.flatnonzero(ends) + 1))
    row = {"part": part, "shard": number, "start": start, "n_tokens": len(ids), "doc_ids": doc_ids,
           "doc_tokens": np.concatenate(([0], np.cumsum(sizes))).astype("<i8").tobytes(),
           "doc_symbols": doc_symbols.astype("<i8").tobytes(), "base": base, "n_rules": len(rules), "n_symbols": len(symbols), "bits": bits,
           "length_bits": length_bits, "rules": pack_bits(rules.ravel(), bits), "lengths": pack_bits(lengths, length_bits),
           "symbols": pack_bits(symbols, bits)}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


_ARROW = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.binary()), ("doc_symbols", pa.binary()), ("base", pa.int32()),
    ("n_rules", pa.int32()), ("n_symbols", pa.int64()), ("bits", pa.int32()), ("length_bits", pa.int32()), ("rules", pa.binary()),
    ("lengths", pa.binary()), ("symbols", pa.binary())])


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, text: str = "text",
                 id_column: str = "doc_id", parts: int | None = None, shard: int = SHARD) -> None:
    """Encode all texts and write their shards to ``folder`` in ascending id order."""
    part = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    bounds = id_bounds(part, "id", parts or default_parts(docs))

    @T.tidy
    def encode(batches):
        for batch in batches:
            for piece in T.slices(batch, 1, TEXTS):
                encoded = encode_texts(tokenizer, texts_of(piece.column(1)), end)
                found = [np.frombuffer(x, "<u4") for x in encoded]
                small = [x.max() < 1 << 16 for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_of(piece.column(0), bounds)), piece.column(0),
                     pa.array([2 if s else 4 for s in small], pa.int32()),
                     pa.array([(x.astype("<u2") if s else x).tobytes() for x, s in zip(found, small)], pa.binary())],
                    ["part", "id", "width", "ids"])

    def pack(batches):
        number = start = size = 0
        doc_ids, found, own = [], [], 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                own = row[0]
                ids = np.frombuffer(row[3], f"<u{row[2]}").astype(np.uint32)
                if found and size + len(ids) > shard:
                    yield _shard(own, number, start, doc_ids, found)
                    number, start, size, doc_ids, found = number + 1, start + size, 0, [], []
                doc_ids.append(row[1])
                found.append(ids)
                size += len(ids)
        if found:
            yield _shard(own, number, start, doc_ids, found)

    placed = part.mapInArrow(encode, "part int, id long, width int, ids binary")
    (placed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(F.asc_nulls_first("id"), "ids")
     .mapInArrow(pack, SCHEMA).write.mode("errorifexists").parquet(folder))


def read_shards(spark: SparkSession, folder: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary) of every document, decoded from the files."""
    return _read(spark, folder, id_column, digest=False)


def read_digests(spark: SparkSession, folder: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    return _read(spark, folder, id_column, digest=True)


def _read(spark: SparkSession, folder: str, id_column: str, digest: bool) -> DataFrame:
    shards = spark.read.schema(SCHEMA).parquet(folder)
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(totals):
        before[part] = total
        total += totals[part]
    last = "ids_crc32" if digest else "ids"

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grammar = Grammar(unpack_bits(row["rules"], row["bits"], 2 * row["n_rules"]).reshape(-1, 2),
                                  unpack_bits(row["lengths"], row["length_bits"], row["n_rules"]), row["base"])
                # the whole shard at once; one document alone is the symbols between its two places
                every = grammar.expand(unpack_bits(row["symbols"], row["bits"], row["n_symbols"])).astype("<u4").tobytes()
                tokens = np.frombuffer(row["doc_tokens"], "<i8")
                ids = [every[4 * a:4 * b] for a, b in zip(tokens[:-1], tokens[1:])]
                found = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(tokens[:-1] + row["start"] + before[row["part"]]),
                     pa.array(np.diff(tokens)), found], [id_column, "start", "n_tokens", last])

    return shards.mapInArrow(decode, f"`{id_column}` long, start long, n_tokens long, {last} "
                                     + ("long" if digest else "binary"))
