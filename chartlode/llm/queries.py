"""The queries op1 to op10 over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlode.llm import common, decontam, html_extract, langid, lm, merkle, minhash, packing, periodic, quality_classifier, quality_rules, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (poor), 1 (good but toxic) and 2 (good and clean), from the two labels."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    return quality_classifier.grade(documents, quality_classifier.train(documents, ratings))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.digests(spark, path).withColumnRenamed("record_id", "page_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tokens = common.materialize(lm.tokenized(documents), "tokens")
    return lm.score_tokens(tokens, lm.train_tokens(tokens))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.train(documents))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering deletes the line ends of every other document's text."""
    documents = table(spark, sf_dir, "documents")
    cut = F.when(common.crc_mod("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    altered = merkle.leaf_hash(*[F.col(c) for c in merkle.FIELDS if c != "text"], cut)
    found = merkle.manifest(documents, carry={"altered": altered}).withColumn("folded_root", merkle.folded(F.col("altered"), F.col("proof")))
    proof = F.sha2(merkle.siblings(F.col("proof")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by the crc32 of its id) goes on periodically from some word on."""
    words, h = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    df = documents.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("ws"))
    df = df.withColumn("n", F.size("ws")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    df = df.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("ws", source(i).cast("int"))), " ")
    return df.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    runs = F.col("runs")
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.aggregate(runs, F.get(runs, F.lit(0)), better)
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS found FROM w),
n AS (SELECT doc_id, len(found)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, md5_number(unnest(found)) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n_shingles + nb.n_shingles - k)),
sides AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (SELECT u, u AS r FROM sides UNION SELECT sides.u, reach.r FROM reach JOIN sides ON sides.v = reach.u),
least AS (SELECT u, min(r) AS r FROM reach GROUP BY u)
SELECT doc_id, n_shingles, coalesce(r, doc_id) AS component_id, coalesce(r, doc_id) = doc_id AS kept FROM n LEFT JOIN least ON u = doc_id
"""

OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, m, p, array_to_string(ws[p:p + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM w, lens)),
occ AS (SELECT doc_id, item_id, pos.m, p FROM pos JOIN win ON win.m = pos.m AND win.g = pos.g),
hit AS (SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS h FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce('g' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    list_reduce(flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: [ascii(substr(doc_id::VARCHAR, j, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295) AS c,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS cut FROM documents),
leaves AS (SELECT doc_id, grp, i, n, c, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) AS other FROM t),
up AS (
  SELECT grp, 0::BIGINT AS k, i, n, leaf AS node FROM leaves
  UNION ALL
  SELECT grp, k + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY grp, k, i // 3, n),
subs AS (SELECT grp, k AS depth, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0::BIGINT AS k, i, n, subroot AS node FROM subs
  UNION ALL
  SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 3, n),
steps AS (
  SELECT doc_id, u.k, string_agg(u.node, '' ORDER BY u.i) FILTER (u.i < l.i // (3 ** u.k)::BIGINT) AS b, string_agg(u.node, '' ORDER BY u.i) FILTER (u.i > l.i // (3 ** u.k)::BIGINT) AS a
  FROM leaves l JOIN up u ON u.grp = l.grp AND u.n > 1 AND u.i // 3 = l.i // (3 ** (u.k + 1))::BIGINT GROUP BY doc_id, u.k
  UNION ALL
  SELECT doc_id, s.depth + u.k, string_agg(u.node, '' ORDER BY u.i) FILTER (u.i < s.i // (3 ** u.k)::BIGINT), string_agg(u.node, '' ORDER BY u.i) FILTER (u.i > s.i // (3 ** u.k)::BIGINT)
  FROM leaves l JOIN subs s ON s.grp = l.grp JOIN top u ON u.n > 1 AND u.i // 3 = s.i // (3 ** (u.k + 1))::BIGINT GROUP BY doc_id, s.depth, u.k),
fold AS (
  SELECT doc_id, 0::BIGINT AS k, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN other ELSE leaf END AS node FROM leaves
  UNION ALL
  SELECT f.doc_id, f.k + 1, sha256(coalesce(b, '') || node || coalesce(a, '')) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k),
ends AS (SELECT doc_id, arg_max(node, k) AS folded_root FROM fold GROUP BY doc_id),
proofs AS (SELECT doc_id, string_agg(coalesce(b, '') || coalesce(a, ''), '' ORDER BY k) AS proof FROM steps GROUP BY doc_id)
SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = (SELECT node FROM top WHERE n = 1) AS verified
FROM leaves JOIN subs USING (grp) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_decontamination": op5_decontamination,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
}

ORACLES = {"op2_warc": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op5_decontamination": OP5_SQL, "op11_merkle_manifest": OP11_SQL}
