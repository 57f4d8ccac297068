"""The health data model over the driver's tables: each view as a DataFrame and as DuckDB SQL.

A view only projects and joins what is there, so every operator can run and be compared without medical data. Events are metrics,
orders are documents, order lines are laboratory results and reports, customers are users, embeddings are chunk vectors.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Order lines that a task works on at most, by their mean. Spark cuts shuffles by compressed bytes, of which 64 MB may be millions of lines.
LINES_A_TASK = 500_000


class Tables:
    """The driver's tables and the views over them, each read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> int:
        """How many tasks of LINES_A_TASK the order lines make; the footers of their files tell it."""
        return -(-self.read("lineitem").count() // LINES_A_TASK)

    def dealt(self, lines: DataFrame, key: str, times: int = 1) -> DataFrame:
        """Order lines, or what is made of each, dealt by key over tasks() tasks where the cores alone would get more each. times: over so many times the tasks, where each line becomes so many rows there."""
        n = self.tasks * times
        return lines.repartition(n, key) if n > self.spark.sparkContext.defaultParallelism else lines

    def metrics(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id", "user_id", "CASE WHEN event_id % 3 = 0 THEN 'watch' ELSE 'phone' END AS provider", "event_type AS metric", "ts AS taken_at", "value AS value_num", "props AS value_json",
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat(event_type, '/u') END AS unit",
        )

    def activities(self) -> DataFrame:
        return self.read("events").where("event_type IN ('view', 'purchase')").selectExpr(
            "user_id", "CASE WHEN event_id % 3 = 0 THEN 'watch' ELSE 'phone' END AS provider", "CAST(event_id AS STRING) AS external_id", "event_type AS activity_type", "ts AS started_at",
            "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 7200 AS DOUBLE) END AS duration_s", "CAST((event_id * 37) % 20000 AS DOUBLE) AS distance_m",
            "CAST(60 + event_id % 120 AS DOUBLE) AS avg_hr", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 900 AS DOUBLE) END AS calories",
        )

    def documents(self) -> DataFrame:
        people = self.read("customer").join(F.broadcast(self.read("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
        return self.read("orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left").selectExpr(
            "o_orderkey AS id", "o_custkey AS user_id", "o_orderpriority AS doc_type", "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS status", "concat('Report ', o_orderkey % 50) AS title",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '' ELSE n_name END AS clinic", "concat(o_custkey % 10, '-', o_orderkey % 40) AS file_sha256", "o_orderdate AS created_at",
            "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS verified_at", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS delivered_at", "CAST(o_totalprice AS BIGINT) AS stage_started_at",
        )

    def labs(self, times: int = 1) -> DataFrame:
        lines = self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        lines = self.dealt(lines, "l_orderkey", times).join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.selectExpr(
            "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id", "l_orderkey AS document_id", "o_custkey AS user_id", "p_name AS analyte_name",
            "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE initcap(p_name) END AS analyte_canonical", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS value_num",
            "CASE WHEN l_linenumber = 7 THEN 'negative' END AS value_text", "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_returnflag END AS unit",
            "CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS ref_low", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS ref_high",
            "l_shipdate AS taken_at", "p_brand AS analyte_group", "CASE WHEN l_partkey % 4 = 0 THEN 'unverified' ELSE 'matched' END AS match_status",
        )

    def reports(self) -> DataFrame:
        who = self.read("supplier").join(F.broadcast(self.read("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
        lines = self.read("lineitem").where("l_linenumber = 1").join(who, F.col("l_suppkey") == F.col("s_suppkey")).join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.selectExpr(
            "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id", "l_orderkey AS document_id", "o_custkey AS user_id", "concat(l_linestatus, ' finding ', l_partkey % 30) AS diagnosis",
            "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE s_name END AS doctor_name", "n_name AS department", "CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_shipdate END AS visit_date",
            "array(concat('drug ', l_partkey % 40, ', 5 mg'), concat('drug ', l_suppkey % 40, ' (tablets)')) AS medications",
        )

    def users(self) -> DataFrame:
        return self.read("customer").selectExpr("c_custkey AS user_id", "c_name AS display_name", "CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'user' END AS role", "c_mktsegment AS segment", "c_acctbal AS balance")

    def chunks(self) -> DataFrame:
        return self.read("embeddings").selectExpr("vec_id AS chunk_id", "CASE WHEN label < 4 THEN 'drug' WHEN label < 7 THEN 'analyte' ELSE 'health' END AS source", "CASE WHEN label >= 7 THEN vec_id % 20 END AS user_id", "concat(label, ':', vec_id) AS ref_key", "embedding")

    def raw(self) -> DataFrame:
        """Texts as forms and models write them, made of line items."""
        return self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(*[f"{e} AS {n}" for n, e in RAW.items()])


#: Expressions that both engines read alike.
RAW = {
    "id": "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber",
    "doc": "l_orderkey",
    "name": "concat(CASE l_linenumber % 6 WHEN 0 THEN '  Ёлка ' WHEN 1 THEN '' WHEN 2 THEN 'Общий  ' ELSE 'x ' END, p_name, CASE l_suppkey % 7 WHEN 0 THEN ' (общ. число), %' WHEN 1 THEN ', абс.' WHEN 2 THEN '::' WHEN 3 THEN ', отн., %' WHEN 4 THEN '  ' ELSE '' END)",
    "value": "CASE l_linenumber WHEN 1 THEN concat(CAST(l_quantity AS INT), ',', l_partkey % 10) WHEN 2 THEN concat(CAST(l_quantity AS INT), '*') WHEN 3 THEN concat('< ', CAST(l_quantity AS INT)) WHEN 4 THEN 'не обнаружено' WHEN 5 THEN concat(' -', l_partkey % 90, ' мм/ч') WHEN 6 THEN '' ELSE concat(l_suppkey, '.0 %') END",
    "ref": "CASE l_partkey % 8 WHEN 0 THEN concat(p_size, ' - ', p_size + 10) WHEN 1 THEN concat('< ', p_size) WHEN 2 THEN concat('≥', p_size, ',5') WHEN 3 THEN concat('до ', p_size) WHEN 4 THEN concat(p_size, ',5–', p_size + 7) WHEN 5 THEN '1 010 - 1 023' WHEN 6 THEN '' ELSE concat('норма ', p_size, ' - ', p_size + 3, ' ед') END",
    "unit": "CASE l_suppkey % 11 WHEN 0 THEN 'г/л' WHEN 1 THEN '10⁹/л' WHEN 2 THEN ' G/L ' WHEN 3 THEN '| г/л |' WHEN 4 THEN '% (note)' WHEN 5 THEN 'Отрицательный  Отрицательный КП' WHEN 6 THEN 'x10^12/l' WHEN 7 THEN NULL WHEN 8 THEN 'мкг/дл' WHEN 9 THEN '(x)' ELSE 'ммоль/л кр.' END",
    "day": "CASE l_linenumber % 5 WHEN 0 THEN concat(lpad(concat('', l_partkey % 28 + 1), 2, '0'), '.', lpad(concat('', l_suppkey % 12 + 1), 2, '0'), '.20', lpad(concat('', l_orderkey % 30), 2, '0')) WHEN 1 THEN concat('20', lpad(concat('', l_orderkey % 30), 2, '0'), '-', lpad(concat('', l_suppkey % 12 + 1), 2, '0'), '-', lpad(concat('', l_partkey % 28 + 1), 2, '0')) WHEN 2 THEN concat(l_partkey % 28 + 1, ' ', CASE l_suppkey % 3 WHEN 0 THEN 'марта' WHEN 1 THEN 'мая' ELSE 'декабря' END, ' 2021 г.') WHEN 3 THEN concat(l_partkey % 28 + 1, '/', l_suppkey % 12 + 1, '/2019') ELSE 'вчера' END",
    "low": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END",
    "high": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size + 10 AS DOUBLE) END",
    "num": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END",
}

#: The same views for DuckDB.
SQL = {
    "metrics": """SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'watch' ELSE 'phone' END AS provider, event_type AS metric, ts AS taken_at, value AS value_num, props AS value_json,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type || '/u' END AS unit FROM events""",
    "activities": """SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'watch' ELSE 'phone' END AS provider, event_id::VARCHAR AS external_id, event_type AS activity_type, ts AS started_at,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 7200)::DOUBLE END AS duration_s, ((event_id * 37) % 20000)::DOUBLE AS distance_m,
  (60 + event_id % 120)::DOUBLE AS avg_hr, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 900)::DOUBLE END AS calories FROM events WHERE event_type IN ('view', 'purchase')""",
    "docs": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS doc_type, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS status, 'Report ' || (o_orderkey % 50) AS title,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '' ELSE n_name END AS clinic, (o_custkey % 10) || '-' || (o_orderkey % 40) AS file_sha256, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS verified_at, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS delivered_at, trunc(o_totalprice)::BIGINT AS stage_started_at
  FROM orders LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey""",
    "labs": """SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, l_orderkey AS document_id, o_custkey AS user_id, p_name AS analyte_name,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS analyte_canonical,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS value_num, CASE WHEN l_linenumber = 7 THEN 'negative' END AS value_text, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_returnflag END AS unit,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size::DOUBLE / 2 END AS ref_low, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size::DOUBLE END AS ref_high, l_shipdate AS taken_at, p_brand AS analyte_group,
  CASE WHEN l_partkey % 4 = 0 THEN 'unverified' ELSE 'matched' END AS match_status FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "reports": """SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, l_orderkey AS document_id, o_custkey AS user_id, l_linestatus || ' finding ' || (l_partkey % 30) AS diagnosis,
  CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE s_name END AS doctor_name, n_name AS department, CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_shipdate END AS visit_date,
  ['drug ' || (l_partkey % 40) || ', 5 mg', 'drug ' || (l_suppkey % 40) || ' (tablets)'] AS medications
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1""",
    "users": """SELECT c_custkey AS user_id, c_name AS display_name, CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'user' END AS role, c_mktsegment AS segment, c_acctbal AS balance FROM customer""",
    "chunks": """SELECT vec_id AS chunk_id, CASE WHEN label < 4 THEN 'drug' WHEN label < 7 THEN 'analyte' ELSE 'health' END AS source, CASE WHEN label >= 7 THEN vec_id % 20 END AS user_id, label || ':' || vec_id AS ref_key, embedding FROM embeddings""",
}


SQL["raw"] = f"SELECT {', '.join(f'{e} AS {n}' for n, e in RAW.items())} FROM lineitem JOIN part ON l_partkey = p_partkey"


def sql(views: str, body: str) -> str:
    """body with the named views (apart by spaces) defined before it. A body that begins with WITH goes on from there."""
    made = ", ".join(f"{v} AS ({SQL[v]})" for v in views.split())
    body = body.strip()
    if not made:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {made}, {body[15:]}"
    return f"WITH {made}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {made} {body}"


class Register:
    """Queries and their SQL by the inventory's name."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, views: str = "", body: str | None = None):
        def add(function):
            self.queries[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
            if body is not None:
                self.oracles[name] = sql(views, body)
            return function

        return add
