"""Quality rules judged per document and per host.

Word, line and symbol statistics are taken from every whole text. A document fails the base rule when it has
fewer than 50 words or when more than half of its words lie in repeated three-word windows. Failures are counted
per host, each host's rate is shrunk towards a beta prior fitted to all hosts by moments, and hosts whose shrunk
rate is above a limit lose all their documents.

Defined cases: a NULL or empty text has no words and fails; a document without host is judged alone; equal rows
each count; an empty table gives an empty table. Only the id, text and host columns are read, so further columns
of any name do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.session import cut_lineage

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated_words(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Words per row that lie in a three-word window found twice or more in the row."""
    found, at = T.windows(hashes, rows, 3)
    if not len(at):
        return np.zeros(n_rows, np.int64)
    keys = T.mix(found + rows[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[at[twice] + i] = True
    return np.bincount(rows[covered], minlength=n_rows)


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of every text of an Arrow column."""
    data, offsets = T.buffer_of(column)
    n_rows = len(offsets) - 1
    starts, ends, rows = T.words_of(data, offsets)
    inside = ~T.SPACE[data] & ((data & 0xC0) != 0x80)
    raw = data.tobytes()
    return {
        "n_words": np.bincount(rows, minlength=n_rows),
        "word_chars": T.per_row(inside, offsets),
        "n_symbols": T.per_row(_SYMBOL[data], offsets),
        "n_dup_lines": np.array([_repeated_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64),
        "n_repeat_words": _repeated_words(T.word_hashes(data, starts, ends, lower=False), rows, n_rows),
    }


def fails(stats: dict[str, np.ndarray], min_words: int = 50, repeat_share: int = 50) -> np.ndarray:
    """The base rule: too short, or too much of the text in repeated windows."""
    n = stats["n_words"]
    return (n < min_words) | (100 * stats["n_repeat_words"] > repeat_share * n)


def rule_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Columns ``keep``, the five counts and ``base_failed`` of every document."""
    part = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))

    @T.tidy
    def measure(batches):
        for batch in batches:
            for piece in T.slices(batch, len(keep)):
                stats = statistics(piece.column(len(keep)))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:len(keep)], *[pa.array(v, pa.int64()) for v in stats.values()],
                     pa.array(fails(stats))], [*keep, *stats, "base_failed"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1])
    return part.mapInArrow(measure, f"{kept}, {STATS}, base_failed boolean")


def host_rates(stats: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """(host, host_docs, host_failures, host_rate): failure rates shrunk by an empirical beta prior.

    The prior's mean is the mean rate of hosts; its weight follows from the variance of rates beyond what
    binomial noise explains, held between 1 and 10,000 documents. The prior is one row made by an aggregation.
    """
    counts = (
        stats.filter(F.col(host).isNotNull()).groupBy(host)
        .agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures"))
        .withColumn("__rate", F.col("host_failures") / F.col("host_docs"))
    )
    moments = counts.agg(
        F.avg("__rate").alias("mean"), F.avg(F.col("__rate") * F.col("__rate")).alias("square"),
        F.avg(1 / F.col("host_docs")).alias("inverse")).first()
    mean = moments["mean"] or 0.0
    noise = mean * (1 - mean)
    between = (moments["square"] or 0.0) - mean * mean - noise * (moments["inverse"] or 0.0)
    weight = min(max(noise / between - 1, 1.0), 10_000.0) if between > 0 else 10_000.0
    return counts.select(
        host, "host_docs", "host_failures",
        ((F.col("host_failures") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))).alias("host_rate"))


def host_verdicts(docs: DataFrame, text: str = "text", id_column: str = "doc_id", host: str = "source",
                  limit: float = 0.5, salts: int = 32) -> DataFrame:
    """Every document's statistics with ``kept``: false where the base rule or the host's rate says so.

    The join back is salted, so a host with a third of all documents is spread over ``salts`` tasks.
    """
    stats = cut_lineage(rule_statistics(docs, text, (id_column, host)))
    rates = host_rates(stats, host).select(
        F.col(host).alias("__host"), "host_docs", "host_failures", (F.col("host_rate") > limit).alias("__bad"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    salted = stats.withColumn("__own_salt", F.pmod(F.xxhash64(id_column, "n_words", "word_chars"), F.lit(salts)).cast("int"))
    joined = salted.join(rates, (F.col(host) == F.col("__host")) & (F.col("__own_salt") == F.col("__salt")), "left")
    verdict = ~(F.col("base_failed") | F.coalesce(F.col("__bad"), F.lit(False)))
    return joined.withColumn("kept", verdict).drop("__host", "__salt", "__own_salt", "__bad")


def drop_rejected(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5) -> DataFrame:
    """The documents that pass, with all their columns; rejected hosts are a table of their own that is joined."""
    names = list(docs.columns)
    rates = host_rates(cut_lineage(rule_statistics(docs, text, (host,))), host)
    own = T.free_name(names, "bad_host")
    bad = cut_lineage(rates.filter(F.col("host_rate") > limit).select(F.col(host).alias(own)))
    at = names.index(text)

    @T.tidy
    def passing(batches):
        for batch in batches:
            for piece in T.slices(batch, at):
                yield piece.filter(pa.array(~fails(statistics(piece.column(at)))))

    good = docs.mapInArrow(passing, docs.schema)
    return good.join(bad, F.col(host) == F.col(own), "left_anti").select(*names)
