"""The corpus operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import boosting, hard_negatives, html_text, mixing, near_dups, neighbours, packing, prefix_trie, rules, set_join, sharding, store, toxicity
from gridframe.llm.common import staged_path, table
from gridframe.llm.labelled import fold, training_sample

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def op1_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    mixed = mixing.weighted_fair_mix(docs, "size")
    return mixed.select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("size") * F.col("__copies")).alias("taken"),
    )


OP1_SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM by_source),
weighted AS (SELECT *, (rnk - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio, sum(source_size) OVER () AS total,
         CAST((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
           / CAST(sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, rnk, total,
         CASE WHEN level >= ratio THEN CAST(cap AS DOUBLE)
              ELSE weight * (SELECT level FROM levels WHERE level < ratio ORDER BY ratio, rnk LIMIT 1) END AS target
  FROM levels),
queue AS (
  SELECT doc_id, size, source_size, rnk, total, target, md5('0:' || doc_id) AS h,
         sum(size) OVER (PARTITION BY rnk ORDER BY md5('0:' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
copies AS (
  SELECT *, CAST(epoch * source_size + cum AS DOUBLE) / target AS finish
  FROM queue, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0),
run AS (
  SELECT doc_id, size, total, sum(size) OVER (ORDER BY finish, rnk, epoch, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM copies),
mix AS (SELECT doc_id, sum(size) AS taken FROM run WHERE so_far <= total GROUP BY doc_id)
SELECT queue.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM queue LEFT JOIN mix ON queue.doc_id = mix.doc_id
"""


def scored(rows: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    return rows.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


#: Labelled documents that a classifier is fitted on, at most.
TOXICITY_ROWS, QUALITY_ROWS = 12_000, 20_000


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = training_sample(table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2, TOXICITY_ROWS)
    model = toxicity.fit(toxicity.sample_texts(docs, training))
    return scored(toxicity.score(docs, model), 4, 2, 0.3)


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


LINKED_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= PERCENT * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other),
roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN roots ON roots.doc_id = d.doc_id
"""
OP3_SQL = LINKED_SQL.replace("PERCENT", "85")


#: Pages that the extractor's weights are fitted on, at most.
LABELLED_PAGES = 1000


def op4_best_run_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    weights = html_text.fit_weights(html_text.labelled_items(pages, LABELLED_PAGES))
    return html_text.main_texts(pages, weights, also=("url",))


def op5_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.host_rules(table(spark, sf_dir, "documents"), F.col("source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS t FROM split WHERE len(w) >= 3),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM places) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM split) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(text) - len(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n - l.u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM split s LEFT JOIN covered c ON c.r = s.r LEFT JOIN lines l ON l.r = s.r),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
ruled AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 3 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS failed FROM judged),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM ruled GROUP BY source),
moments AS (
  SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(f) AS DOUBLE) AS f, count(*) AS h, CAST(sum(CAST(CAST(f * f AS DOUBLE) / n AS DECIMAL(30, 9))) AS DOUBLE) AS q, CAST(sum(n * n) AS DOUBLE) AS s FROM hosts),
rates AS (SELECT *, CASE WHEN f > 0 AND f < n THEN f / n ELSE (f + 0.5) / (n + 1) END AS p FROM moments),
spread AS (SELECT *, CASE WHEN h > 1 AND n - s / n > 0 THEN (q - f * f / n - (h - 1) * (f - q) / greatest(1, n - h)) / (n - s / n) ELSE 0 END AS extra FROM rates),
prior AS (SELECT p, CASE WHEN extra > 0 THEN least(100, greatest(1, p * (1 - p) / extra - 1)) ELSE 100 END AS weight FROM spread),
shrunk AS (SELECT source, n, p, weight, (f + p * weight) / (n + weight) AS rate FROM hosts, prior),
verdicts AS (SELECT source, rate - 1.645 * sqrt(rate * (1 - rate) / (n + weight + 1)) > 2 * p / (1 + p) AS strict FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (strict AND failed) AS kept
FROM ruled JOIN verdicts ON ruled.source IS NOT DISTINCT FROM verdicts.source
"""


def op8_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = training_sample(table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1, QUALITY_ROWS)
    return scored(boosting.quality_scores(table(spark, sf_dir, "documents"), training), 3, 1, 0.5)


def op9_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "token-store")
    store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return store.read_sums(spark, path)


def op10_nnls_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def op11_family_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("long")
    shared = F.crc32(conv.cast("string").cast("binary")) % 4
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), "conv_id", conv - conv % 20, shared, most_shared=3)


OP11_SQL = r"""
WITH codes AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
shared AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM ids, codes),
turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
rebuilt AS (
  SELECT s.conv_id, t.p, 0 AS own, t.role, t.text FROM shared s JOIN turns t ON t.conv_id = s.base AND t.p <= s.h
  UNION ALL SELECT s.conv_id, t.p, 1, t.role, t.text FROM shared s JOIN turns t ON t.conv_id = s.conv_id AND t.p > s.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS depth, role, text, len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM rebuilt),
paths AS (
  SELECT conv_id, depth, words, array_agg(length(role) || ':' || role || length(text) || ':' || text) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node FROM placed
  UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM ids),
ended AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY node),
ends AS (SELECT node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM paths p JOIN ended e ON e.conv_id = p.conv_id AND e.depth = p.depth GROUP BY node),
children AS (SELECT node[1:len(node) - 1] AS node, count(*) AS n FROM nodes WHERE len(node) > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
below AS (
  SELECT p.node, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM full_nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes n JOIN below b ON b.node = n.node LEFT JOIN ends e ON e.node = n.node LEFT JOIN nodes u ON len(n.node) > 0 AND u.node = n.node[1:len(n.node) - 1]
"""


def op12_bounded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
usual AS (SELECT len(e) AS dim FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
part AS (SELECT v.* FROM v, usual WHERE len(e) = dim),
pairs AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM part a JOIN part b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS n FROM pairs WHERE same) WHERE n <= 5),
found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.other ORDER BY x.score DESC, x.vec_id, x.other) AS rank, x.vec_id AS negative_id, p.score AS positive_score, x.score AS negative_score
  FROM positives p JOIN pairs x ON x.r = p.r AND NOT x.same AND 80 * p.score <= 100 * x.score AND x.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""


def op13_set_skipping_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_join(table(spark, sf_dir, "documents"), percent=80).drop("kept")


OP13_SQL = f"SELECT * EXCLUDE (kept) FROM ({LINKED_SQL.replace('PERCENT', '80')})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fair_mix": op1_fair_mix,
    "op2_toxicity": op2_toxicity,
    "op3_circulant_minhash": op3_circulant_minhash,
    "op4_best_run_html": op4_best_run_html,
    "op5_multiprobe_search": op5_multiprobe_search,
    "op6_histogram_shards": op6_histogram_shards,
    "op7_host_rules": op7_host_rules,
    "op8_boosted_quality": op8_boosted_quality,
    "op9_chunk_store": op9_chunk_store,
    "op10_nnls_pack": op10_nnls_pack,
    "op11_family_trie": op11_family_trie,
    "op12_bounded_lists": op12_bounded_lists,
    "op13_set_skipping_join": op13_set_skipping_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_fair_mix": OP1_SQL,
    "op3_circulant_minhash": OP3_SQL,
    "op7_host_rules": OP7_SQL,
    "op11_family_trie": OP11_SQL,
    "op12_bounded_lists": OP12_SQL,
    "op13_set_skipping_join": OP13_SQL,
}
