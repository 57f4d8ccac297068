"""Fuzzy matching and vector retrieval over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.functions.text import drug_head, normalize_name, query_name
from chartlode.operators import fuzzy, vectors
from chartlode.plans.views import Register, Tables

query = Register()

# A registry of the distinct part names, and names with an edit each.
NAMES = "SELECT p_name AS name, min(p_partkey) AS ordinal FROM part GROUP BY 1"
TYPOS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN concat(substr(p_name, 1, 3), substr(p_name, 5)) WHEN 2 THEN concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr(p_name, 3))
WHEN 3 THEN concat(upper(p_name), 'x') WHEN 4 THEN concat(p_name, ' zzzzzzz') ELSE substr(p_name, 1, 3) END AS raw FROM part"""


def registry(t: Tables) -> DataFrame:
    t.read("part").createOrReplaceTempView("part")
    return t.spark.sql(NAMES)


def typos(t: Tables) -> DataFrame:
    t.read("part").createOrReplaceTempView("part")
    return t.spark.sql(TYPOS)


BEST = """WITH r AS ({names}), q AS (SELECT DISTINCT lower(raw) AS query FROM ({typos})),
p AS (SELECT query, name, ordinal, damerau_levenshtein(query, name) AS d, greatest(1, floor(length(query) * {cap})) AS cap FROM q, r),
b AS (SELECT query, name AS key, d AS distance FROM p WHERE d <= cap AND length(query) > {short} OR d = 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, ordinal) = 1)
SELECT query, CASE WHEN key IS NULL THEN 'unverified' ELSE 'matched' END AS status, key, distance::INT AS distance FROM q LEFT JOIN b USING (query)"""


@query("FUZ-01", "", f"WITH r AS ({NAMES}) SELECT lower(name) AS key, min(ordinal) AS record FROM r GROUP BY 1")
def fuz_01(t: Tables) -> DataFrame:
    return fuzzy.key_index(registry(t), normalize_name).select("key", "record")


@query("FUZ-02", "", f"""WITH r AS ({NAMES}), k AS (SELECT name AS key, ordinal AS record, 0 AS kind FROM r UNION ALL SELECT split_part(name, ' ', 1), ordinal, 1 FROM r UNION ALL SELECT split_part(name, ' ', 2), ordinal, 1 FROM r)
SELECT key, record FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY kind, record) = 1""")
def fuz_02(t: Tables) -> DataFrame:
    return fuzzy.key_index(registry(t).withColumn("synonyms", F.split("name", " ")), normalize_name, synonyms="synonyms").select("key", "record")


@query("FUZ-03", "", BEST.format(names=NAMES, typos=TYPOS, cap=0.35, short=0))
def fuz_03(t: Tables) -> DataFrame:
    asked = typos(t).select(normalize_name(F.col("raw")).alias("query"))
    return fuzzy.match(asked, fuzzy.key_index(registry(t), normalize_name), max_edit_ratio=0.35, ratio_floor=0).select("query", "status", "key", "distance")


@query("FUZ-04", "", BEST.format(names=NAMES, typos=TYPOS, cap=0.35, short=3))
def fuz_04(t: Tables) -> DataFrame:
    asked = typos(t).select(normalize_name(F.col("raw")).alias("query"))
    return fuzzy.match(asked, fuzzy.key_index(registry(t), normalize_name), max_edit_ratio=0.35, ratio_floor=0, short=3).select("query", "status", "key", "distance")


def likeness_sql(a: str, b: str) -> str:
    """FUZ-06 for DuckDB: the common subsequence of texts of up to 60 letters, a bit for each letter of a."""
    masks = f"list_transform(string_split({b}, ''), lambda y: coalesce(list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, i::INT + 1, 1) = y THEN (1::BIGINT << i::INT) ELSE 0 END)), 0)::BIGINT)"
    every = f"((1::BIGINT << length({a})::INT) - 1)"
    return f"200.0 * (length({a}) - bit_count(list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {every}, {every}))) / (length({a}) + length({b}))"


def floored_sql(kind: str, cap: float, floor: int, short: int) -> str:
    """FUZ-05 for DuckDB, all pairs."""
    return f"""SELECT query, CASE WHEN l >= {floor} THEN 'matched' ELSE 'unverified' END AS status, CASE WHEN l >= {floor} THEN key END AS key, CASE WHEN l >= {floor} THEN record END AS record, distance::INT AS distance, coalesce(l, 0)::DOUBLE AS ratio, '{kind}' AS kind
FROM q LEFT JOIN (SELECT query, name AS key, ordinal AS record, d AS distance, {likeness_sql("query", "name")} AS l FROM (SELECT query, name, ordinal, damerau_levenshtein(query, name) AS d FROM q, r)
WHERE d <= greatest(1, floor(length(query) * {cap})) AND length(query) > {short} OR d = 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, ordinal) = 1) USING (query)"""


@query("FUZ-05", "", f"WITH r AS ({NAMES}), q AS (SELECT DISTINCT lower(raw) AS query FROM ({TYPOS})) {floored_sql('analyte', 0.35, 75, 3)} UNION ALL {floored_sql('drug', 0.40, 70, 0)}")
def fuz_05(t: Tables) -> DataFrame:
    """Both thresholds, with the ratio floor."""
    index = fuzzy.key_index(registry(t), normalize_name)
    one = fuzzy.match(typos(t).select(query_name(F.col("raw")).alias("query")), index, max_edit_ratio=0.35, ratio_floor=75, short=3)
    two = fuzzy.match(typos(t).select(normalize_name(F.col("raw")).alias("query")), index, max_edit_ratio=0.40, ratio_floor=70)
    return one.withColumn("kind", F.lit("analyte")).unionByName(two.withColumn("kind", F.lit("drug")))


@query("FUZ-07", "", f"""WITH r AS ({NAMES}), l AS (SELECT DISTINCT concat(raw, ', ', id % 9, ' mg') AS line, lower(raw) AS head FROM ({TYPOS})),
a AS (SELECT DISTINCT head AS query FROM l UNION SELECT split_part(head, ' ', 1) FROM l),
p AS (SELECT query, name, ordinal, damerau_levenshtein(query, name) AS d FROM a, r WHERE damerau_levenshtein(query, name) <= greatest(1, floor(length(query) * 0.4))),
b AS (SELECT query, name AS key, d FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, ordinal) = 1)
SELECT line, CASE WHEN coalesce(h.key, w.key) IS NULL THEN 'unverified' ELSE 'matched' END AS status, coalesce(h.key, w.key) AS key FROM l LEFT JOIN b h ON h.query = head LEFT JOIN b w ON w.query = split_part(head, ' ', 1)""")
def fuz_07(t: Tables) -> DataFrame:
    lines = typos(t).select(F.concat("raw", F.lit(", "), F.col("id") % 9, F.lit(" mg")).alias("line"))
    return fuzzy.match_free_text(lines, fuzzy.key_index(registry(t), normalize_name), normalize_name, drug_head, max_edit_ratio=0.4, ratio_floor=0).select("line", "status", "key")


@query("FUZ-08", "", f"""WITH r AS ({NAMES}), q AS (SELECT DISTINCT lower(raw) AS query FROM ({TYPOS})), p AS (SELECT query, name, ordinal, damerau_levenshtein(query, name) AS d FROM q, r WHERE damerau_levenshtein(query, name) <= greatest(3, length(query) // 4)),
b AS (SELECT query, name AS key FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, ordinal) = 1) SELECT query, key FROM q LEFT JOIN b USING (query)""")
def fuz_08(t: Tables) -> DataFrame:
    return fuzzy.match_panel(typos(t).select(F.col("raw").alias("query")), fuzzy.key_index(registry(t), normalize_name))


@query("FUZ-06", "", f"SELECT id, ({likeness_sql('lower(raw)', 'p_name')})::DOUBLE AS ratio FROM ({TYPOS}) JOIN part ON p_partkey = id")
def fuz_06(t: Tables) -> DataFrame:
    pairs = typos(t).join(t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id")
    return pairs.select("id", fuzzy.likeness_udf(F.lower("raw"), "name").alias("ratio"))


@query("FUZ-09")
def fuz_09(t: Tables) -> DataFrame:
    pairs = typos(t).join(t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id")
    return pairs.select("id", fuzzy.token_set_udf("raw", "name").alias("ratio"))


@query("FUZ-10", "", f"SELECT id, len(list_intersect(list_distinct(string_split(p_name, ' ')), string_split_regex(trim(lower(raw)), '\\s+'))) / len(list_distinct(string_split(p_name, ' '))) AS score FROM ({TYPOS}) JOIN part ON p_partkey = id")
def fuz_10(t: Tables) -> DataFrame:
    pairs = typos(t).join(t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id")
    return pairs.select("id", fuzzy.name_score(F.col("name"), F.col("raw")).alias("score"))


@query("JOIN-08", "", BEST.format(names=NAMES, typos=TYPOS, cap=0.2, short=0).replace("SELECT query, CASE", "SELECT id, raw, status, key FROM (" + TYPOS + ") JOIN (SELECT query, CASE") + ") m ON m.query = lower(raw)")
def join_08(t: Tables) -> DataFrame:
    rows = typos(t).withColumn("query", normalize_name(F.col("raw")))
    return rows.join(fuzzy.match(rows, fuzzy.key_index(registry(t), normalize_name), max_edit_ratio=0.2, ratio_floor=0), "query").select("id", "raw", "status", "key")


# Vectors: the queries are the rows whose id is divisible by 20.
HITS = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query_id, vec_id AS id, list_distance(e, embedding::DOUBLE[]) AS d FROM q, embeddings),
h AS (SELECT query_id, id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS place FROM d QUALIFY place <= 25)"""


def asked(t: Tables) -> DataFrame:
    return t.read("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("TOP-06", "", f"{HITS} SELECT query_id, id, distance FROM h")
def top_06(t: Tables) -> DataFrame:
    return vectors.nearest(t.chunks(), asked(t), 25).select("query_id", "id", F.round("distance", 6).alias("distance"))


@query("VEC-02", "chunks", f"{HITS} SELECT * FROM (SELECT query_id, id, distance, ref_key, row_number() OVER (PARTITION BY query_id ORDER BY h.place) AS place FROM h JOIN chunks ON chunk_id = id WHERE source = 'drug' AND user_id IS NULL) x WHERE x.place <= 5")
def vec_02(t: Tables) -> DataFrame:
    return vectors.search(t.chunks(), asked(t), 5, source="drug").select("query_id", "id", F.round("distance", 6).alias("distance"), "ref_key", "place")


@query("VEC-03", "", "SELECT a.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_03(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    squares = F.zip_with("embedding", "other", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("id"), F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)), 6).alias("distance"))


@query("VEC-04", "chunks", f"{HITS} SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY h.place) AS place FROM h JOIN chunks ON chunk_id = id WHERE user_id IS NULL OR user_id = 3) x WHERE x.place <= 5")
def vec_04(t: Tables) -> DataFrame:
    return vectors.search(t.chunks(), asked(t), 5, user_id=3).select("query_id", "id", "place")


@query("JOIN-05", "chunks", f"{HITS} SELECT query_id, id, source, ref_key FROM h JOIN chunks ON chunk_id = id")
def join_05(t: Tables) -> DataFrame:
    return vectors.nearest(t.chunks(), asked(t), 25).join(t.chunks().select(F.col("chunk_id").alias("id"), "source", "ref_key"), "id").select("query_id", "id", "source", "ref_key")


@query("VEC-06", "chunks", f"""{HITS}, w AS (SELECT query_id, source AS want FROM q JOIN chunks ON chunk_id = query_id), f AS (SELECT query_id, min(CASE WHEN source = want THEN h.place END) AS rank, min(distance) AS top FROM h JOIN chunks ON chunk_id = id JOIN w USING (query_id) WHERE h.place BETWEEN 1 AND 10 GROUP BY 1)
SELECT count(*) AS queries, round(avg((rank IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(top), 6) AS mean_top1 FROM w LEFT JOIN f USING (query_id)""")
def vec_06(t: Tables) -> DataFrame:
    hits = vectors.nearest(t.chunks(), asked(t), 25).join(t.chunks().select(F.col("chunk_id").alias("id"), "source"), "id")
    wanted = asked(t).select("query_id").join(t.chunks().select(F.col("chunk_id").alias("query_id"), F.col("source").alias("want")), "query_id")
    return vectors.retrieval_quality(hits, wanted, 10)


@query("VEC-01", "", "SELECT CASE WHEN vec_id % 3 = 0 THEN vec_id + 1000000 ELSE vec_id END AS chunk_id, 'k' || vec_id AS ref_key FROM embeddings UNION ALL SELECT vec_id + 1000000, 'n' || vec_id FROM embeddings WHERE vec_id % 30 = 0")
def vec_01(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    old = e.select(F.col("vec_id").alias("chunk_id"), F.lit("drug").alias("source"), F.concat(F.lit("k"), "vec_id").alias("ref_key"), "embedding")
    new = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 1_000_000).alias("chunk_id"), F.lit("drug").alias("source"), F.concat(F.lit("k"), "vec_id").alias("ref_key"), "embedding")
    more = new.where("(chunk_id - 1000000) % 30 = 0").withColumn("ref_key", F.concat(F.lit("n"), F.col("chunk_id") - 1_000_000))
    return vectors.upsert_chunks(old, new.unionByName(more), 64).select("chunk_id", "ref_key")


@query("VEC-05")
def vec_05(t: Tables) -> DataFrame:
    """The injected function stands in for a model: lengths and vowels."""
    return vectors.embedded(t.read("benchmark"), lambda texts: [[float(len(x)), float(sum(c in "aeiou" for c in x))] for x in texts])


@query("VEC-07", "", "SELECT p_partkey AS ordinal, concat('drug:', p_name) AS ref_key, concat_ws('. ', p_name, p_type, nullif(p_brand, '')) AS text FROM part")
def vec_07(t: Tables) -> DataFrame:
    from chartlode.functions.text import joined

    return t.read("part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("drug:"), "p_name").alias("ref_key"), joined(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("text"))


@query("VEC-08", "users labs reports", """WITH l AS (SELECT user_id, string_agg(analyte_name, ', ' ORDER BY analyte_name) AS b FROM (SELECT DISTINCT user_id, analyte_name FROM labs WHERE ref_high IS NOT NULL AND value_num > ref_high) GROUP BY 1), r AS (SELECT user_id, max(diagnosis) AS b FROM reports GROUP BY 1)
SELECT user_id, concat_ws(chr(10) || chr(10), display_name, l.b, r.b) AS context FROM users LEFT JOIN l USING (user_id) LEFT JOIN r USING (user_id)""")
def vec_08(t: Tables) -> DataFrame:
    high = t.labs().where("ref_high IS NOT NULL AND value_num > ref_high").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("analyte_name")), ", ").alias("block"))
    return vectors.context_blocks(t.users().select("user_id", F.col("display_name").alias("block")), high, t.reports().groupBy("user_id").agg(F.max("diagnosis").alias("block")))
