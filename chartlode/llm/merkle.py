"""Merkle manifest of a dataset: a hash tree for each group of rows and one over the groups, with a proof for each row.

A level of a tree is a window: partitioned by the parent's number, its whole frame's ordered list is what the parent hashes, and has each
node's siblings; one row of each parent goes on to the next level. Several levels share an exchange, by blocks of neighbouring
nodes; a block carries its rows' proofs so far and ends as one node. So exchanges grow with the logarithm of a group's size to a
base of some hundreds, and no task has more of a group than its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlode.llm.common import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that share an exchange.
LEVELS = 5

PATH = "array<struct<before:string,after:string>>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields in order: '-' for a null, else its length in UTF-8 bytes, ':' and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one string."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (grp, row, node and the columns of order) with at, the row's number from 0 in its group, and n, the group's size.

    Rows are dealt by ranges of group and order and numbered there; what stands before in the group is added from the ranges' counts.
    Rows that are equal in all of that are told apart by a number that is written with them."""
    tied = materialize(nodes.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    keys = ["grp", *order, "tie"]
    sorted_ = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("m", F.monotonically_increasing_id())
    placed = materialize(sorted_.select("grp", "row", "node", F.shiftright("m", 33).alias("part"), F.expr("m & 8589934591").alias("place")), "sorted")
    parts = placed.groupBy("grp", "part").agg(F.min("place").alias("least"), F.count("*").alias("k"))
    own = Window.partitionBy("grp")
    before = F.coalesce(F.sum("k").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("grp", "part", (before - F.col("least")).alias("shift"), F.sum("k").over(own).alias("n"))
    return placed.join(parts, ["grp", "part"]).select("grp", "n", (F.col("place") + F.col("shift")).alias("at"), "node", "row")


def climbed(nodes: DataFrame, width: int) -> DataFrame:
    """LEVELS levels up: grp, n, at and node of each block, and its members, with their proofs so far.

    nodes: grp, n, at, node, row. A group of one node stays as it is."""
    df = nodes.select("grp", "n", "at", "node", F.array(F.struct("row", F.expr(f"cast(array() as {PATH})").alias("path"))).alias("members"), F.expr(f"at div {width**LEVELS}").alias("block"))
    df = df.repartition("grp", "block")
    for _ in range(LEVELS):
        df = df.withColumn("parent", F.expr(f"at div {width}"))
        frame = Window.partitionBy("grp", "block", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumn("run", F.collect_list(F.struct("node", "members")).over(frame)).where(f"at = parent * {width}")
        sides = f"transform(run, (c, i) -> struct(c.members AS members, array(struct(array_join(slice(run.node, 1, i), '') AS before, array_join(slice(run.node, i + 2, {width}), '') AS after)) AS s))"
        members = F.expr(f"flatten(transform({sides}, c -> transform(c.members, m -> struct(m.row AS row, concat(m.path, c.s) AS path))))")
        many = F.col("n") > 1
        df = df.select(
            "grp", "block", F.col("parent").alias("at"), F.when(many, F.sha2(F.array_join("run.node", ""), 256)).otherwise(F.col("node")).alias("node"),
            F.when(many, members).otherwise(F.col("members")).alias("members"), F.expr(f"(n + {width - 1}) div {width}").alias("n"),
        )
    return df.drop("block")


def ascent(nodes: DataFrame, order: list[str], width: int) -> list[DataFrame]:
    """The blocks of nodes, those of the blocks, and so on until each group is one."""
    nodes = materialize(numbered(nodes, order), "numbered")
    size, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    while not levels or size > 1:
        levels.append(materialize(climbed(nodes, width), "blocks"))
        nodes = levels[-1].select("grp", "n", "at", "node", F.struct("at").alias("row"))
        size = -(-size // width**LEVELS)
    return levels


def descent(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """row, proof and more of each leaf. above: grp, at (0), path and more for each group."""
    more = [c for c in above.columns if c not in ("grp", "at", "path")]
    for k, level in reversed(list(enumerate(levels))):
        rows = level.select("grp", "at", "members").join(above, ["grp", "at"]).select("grp", "path", *more, F.explode("members").alias("m"))
        above = rows.select("grp", *([F.col("m.row.at").alias("at")] if k else [F.col("m.row").alias("row")]), F.concat("m.path", "path").alias("path"), *more)
    return above.drop("grp")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, *, id_col: str = "doc_id", group_col: str = "source", width: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of each row; carry: more columns, made of those of docs.

    A leaf is the leaf_hash() of fields. A group's leaves, by id, are hashed by runs of width (the last may be shorter) until one is
    left, its subroot; a lone leaf is that itself. The subroots, by group (null first, then by UTF-8 bytes), are hashed likewise up to
    the root. proof: for each level, the siblings before and after, joined. Null ids come first, rows with one id are ordered by leaf,
    rows that are equal in all fields in any way. An empty table has no rows and no root; other columns don't matter."""
    if width < 2:
        raise ValueError("a node hashes two at least")
    row = F.struct(F.col(id_col).alias("doc_id"), *[c.alias(name) for name, c in (carry or {}).items()])
    group = F.coalesce(F.concat(F.lit("g"), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(group.alias("grp"), F.col(id_col).alias("id"), row.alias("row"), leaf_hash(*[F.col(f) for f in fields]).alias("node"))
    levels = ascent(leaves.withColumn("row", F.struct("node", "row")), ["id", "node"], width)
    subroots = levels[-1].select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.struct("grp", "node").alias("row"), "node")
    tops = ascent(subroots, ["id"], width)
    root = tops[-1].select("grp", "at", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("node").alias("root"))
    groups = descent(tops, root).select(F.col("row.grp").alias("grp"), F.lit(0).cast("long").alias("at"), "path", F.col("row.node").alias("subroot"), "root")
    return descent(levels, groups).select("row.row.*", F.col("row.node").alias("leaf"), "subroot", "root", F.col("path").alias("proof"))
