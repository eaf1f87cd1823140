"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from platewise.llm import (
    chunked_bpe, content_sort, cotraining, filter_audit, gated_lm, histogram_packing, host_rules, jaccard_join, language_id,
    order_minhash, repair_shards, trie_counts, vector_codes,
)
from platewise.session import shared_folder

QUERIES = {}
SQL = {}


def register(name, sql=None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


@register("op6_repair_shards")
def op6_repair_shards(spark, sf_dir):
    folder = new_folder(spark)
    repair_shards.write_shards(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return repair_shards.read_digests(spark, folder)


@register("op8_histogram_packing")
def op8_histogram_packing(spark, sf_dir):
    return histogram_packing.pack_documents(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=1)


@register("op9_chunked_bpe")
def op9_chunked_bpe(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = chunked_bpe.encode(documents(spark, sf_dir), path, pattern)
    return chunked_bpe.digests(chunked_bpe.decode(encoded, path, pattern))


OP10_SQL = """
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
base AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM base, unnest(range(1, n_words - 1)) AS r(i)),
often AS (SELECT doc_id, g FROM tri GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS p FROM tri JOIN often USING (doc_id, g), unnest([0, 1, 2]) AS s(k)),
again AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
stats AS (SELECT b.doc_id, source, n_words, word_chars, n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM base b LEFT JOIN again a ON a.doc_id = b.doc_id),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS x FROM failed WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(x / n) AS mean, avg((x / n) * (x / n)) AS square, avg(1.0 / n) AS inverse FROM hosts),
prior AS (SELECT mean, CASE WHEN between_ > 0 THEN least(greatest(mean * (1 - mean) / between_ - 1, 1.0), 10000.0)
    ELSE 10000.0 END AS weight FROM (
  SELECT mean, square - mean * mean - mean * (1 - mean) * inverse AS between_ FROM m)),
bad AS (SELECT source FROM hosts, prior WHERE (x + mean * weight) / (n + weight) > 0.5)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM failed"""


@register("op10_host_rules", OP10_SQL)
def op10_host_rules(spark, sf_dir):
    return host_rules.host_verdicts(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op1_order_minhash")
def op1_order_minhash(spark, sf_dir):
    return order_minhash.fingerprints(documents(spark, sf_dir))


@register("op3_language_id")
def op3_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    apart = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.filter(~apart))
    return language_id.predict(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS r(i)
       WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
          WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS root FROM documents UNION SELECT y AS d, root FROM reach JOIN links ON x = d)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT d, min(root) AS root FROM reach GROUP BY d) r ON r.d = d.doc_id"""


@register("op4_jaccard_join", OP4_SQL)
def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.link_components(documents(spark, sf_dir))


@register("op5_gated_lm")
def op5_gated_lm(spark, sf_dir):
    return gated_lm.scores(documents(spark, sf_dir))


@register("op2_trie_counts")
def op2_trie_counts(spark, sf_dir):
    return trie_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@register("op7_cotraining")
def op7_cotraining(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return cotraining.score(docs, cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP11_SQL = """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN length(t) > length(translate(t, '#$%&*|', '')) THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM v a, v b, v c, v d, v e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
met AS (SELECT *, contains(fails, own) AS failing, translate(fails, before, '') = fails AS there FROM cells, steps),
sums AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN there AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN there AND failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failing AND NOT there THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN there AND failing THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN there AND failing THEN toxic ELSE 0 END) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums"""


@register("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _op12_sql() -> str:
    """Six rounds written one after the other: no recursion is needed for a fixed number of rounds."""
    nearest = """
a{i} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (
  SELECT vec_id, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d,
    row_number() OVER (PARTITION BY vec_id, x.p ORDER BY sum((x.v - b.v) * (x.v - b.v)), b.e) AS r
  FROM x JOIN b{i} b ON b.p = x.p AND b.q = x.q GROUP BY vec_id, x.p, b.e) WHERE r = 1)"""
    moved = """
b{j} AS MATERIALIZED (SELECT b.p, b.e, b.q, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (
  SELECT x.p, a.e, x.q, (sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS v
  FROM x JOIN a{i} a ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY x.p, a.e, x.q) m ON m.p = b.p AND m.e = b.e AND m.q = b.q)"""
    rounds = ",".join((nearest + "," + moved).format(i=i, j=i + 1) for i in range(6))
    return f"""
WITH kept AS (SELECT vec_id, label, embedding AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(z) // 8) AS p, (i - 1) % (len(z) // 8) AS q,
    CAST(floor(4096 * CAST(z[i] AS DOUBLE)) AS BIGINT) AS v FROM kept, unnest(range(1, len(z) + 1)) AS r(i)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16),
b0 AS MATERIALIZED (SELECT x.p, f.e, x.q, x.v FROM x JOIN first f ON f.vec_id = x.vec_id),{rounds},{nearest.format(i=6)},
codes AS (SELECT vec_id, string_agg(format('{{:02x}}', CAST(e AS INT)), '' ORDER BY p) AS code, sum(d) AS error FROM a6 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, q)) AS digest FROM b6)
SELECT c.vec_id, c.code, CAST(c.error AS BIGINT) AS error,
  CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM codes c JOIN kept k ON k.vec_id = c.vec_id, books"""


@register("op12_vector_codes", _op12_sql())
def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""


@register("op13_content_sort", OP13_SQL)
def op13_content_sort(spark, sf_dir):
    return content_sort.copies(documents(spark, sf_dir))
