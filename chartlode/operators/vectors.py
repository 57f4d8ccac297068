"""Vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell at most, on either side; vectors that are multiplied at once.
QUERIES, CHUNKS, BLOCK = 32_768, 65_536, 2048


def best_of(names: np.ndarray, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest vectors to each row of asked, ties by id.

    One matrix product a block gives all squared distances, but for rounding. What may be among the k best by them is measured
    again, difference by difference, so the answer is that of plain distances."""
    q_norm = (asked**2).sum(axis=1)
    rows, found_ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    worst = np.full(len(asked), np.inf)
    for low in range(0, len(ids), BLOCK):
        x, own = vectors[low : low + BLOCK], ids[low : low + BLOCK]
        x_norm = (x**2).sum(axis=1)
        new_rows, new_at = [], []
        for top in range(0, len(asked), BLOCK):
            part = asked[top : top + BLOCK]
            d = q_norm[top : top + BLOCK, None] + x_norm - 2 * (part @ x.T)
            slack = 1e-9 * (q_norm[top : top + BLOCK] + x_norm.max()) + 1e-12
            limit = worst[top : top + BLOCK]
            if d.shape[1] > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero(d <= (limit + slack)[:, None])
            new_rows.append(r + top)
            new_at.append(c)
        r, c = np.concatenate(new_rows), np.concatenate(new_at)
        exact = np.concatenate([((asked[r[i : i + 65_536]] - x[c[i : i + 65_536]]) ** 2).sum(axis=1) for i in range(0, len(r), 65_536)] or [np.zeros(0)])
        rows, found_ids, found = np.concatenate([rows, r]), np.concatenate([found_ids, own[c]]), np.concatenate([found, exact])
        order = np.lexsort((found_ids, found, rows))
        rows, found_ids, found = rows[order], found_ids[order], found[order]
        first = np.searchsorted(rows, rows)  # where each query's rows begin
        keep = np.arange(len(rows)) - first < k
        rows, found_ids, found = rows[keep], found_ids[keep], found[keep]
        full = np.flatnonzero(np.bincount(rows, minlength=len(asked)) == k)
        worst[full] = found[np.searchsorted(rows, full, "right") - 1]
    return names[rows], found_ids, np.sqrt(found)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", *, cell: tuple[int, int] = (QUERIES, CHUNKS)) -> DataFrame:
    """TOP-06, VEC-03. query_id, id, distance, place: the k nearest chunks (L2, ties by id) of each query.

    Queries and chunks are dealt by id into groups of at most about cell rows; each pair of groups is a cell of one task, where
    they are multiplied block by block. A chunk is sent once for each group of queries and a query once for each group of
    chunks; a cell gives k rows a query. The driver gets two counts. Null vectors are left out; all have one length, ids are unique."""
    if k < 1 or min(cell) < 1:
        raise ValueError("k and a cell's sides are 1 at least")
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(vector_col).alias("v"))
    pool = chunks.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    groups, cells = (-(-df.count() // most) or 1 for df, most in ((asked, cell[0]), (pool, cell[1])))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")  # noqa: E731 - cogroup hashes 1 and 1L apart, so both sides' keys are ints
    left = asked.select("*", dealt("query_id", groups).alias("g"), every(cells).alias("c"))
    right = pool.select("*", dealt("id", cells).alias("c"), every(groups).alias("g"))

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), -1).astype(np.float64)
        names, ids, far = best_of(q.column("query_id").to_numpy(), matrix(q), x.column("id").to_numpy(), matrix(x), k)
        return pa.table({"query_id": names, "id": ids, "distance": far})

    found = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInArrow(run, "query_id long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def search(chunks: DataFrame, queries: DataFrame, top_k: int, *, source: str | None = None, user_id: int | None = None, oversample: int = 5, prefilter: bool = False) -> DataFrame:
    """VEC-02, VEC-04, JOIN-05. The oversample * top_k nearest of all chunks, then those of the source that the user may see, then the first top_k.

    That may leave fewer than top_k; prefilter filters before it searches."""
    seen = F.col("user_id").isNull() | (F.lit(False) if user_id is None else F.col("user_id") == user_id)
    allowed = seen if source is None else seen & (F.col("source") == source)
    pool = chunks.where(allowed) if prefilter else chunks
    hits = nearest(pool, queries, oversample * top_k)
    joined = hits.join(chunks.select(F.col("chunk_id").alias("id"), "source", "user_id", "ref_key"), "id").where(allowed)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return joined.withColumn("place", place).where(F.col("place") <= top_k)


def upsert_chunks(old: DataFrame, new: DataFrame, length: int) -> DataFrame:
    """VEC-01. Chunks by (source, ref_key), the new ones winning; a vector of another length is an error."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == length, F.col("embedding")).otherwise(F.raise_error("a vector of another length")))
    both = old.withColumn("_new", F.lit(0)).unionByName(checked.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("source", "ref_key").orderBy(F.desc("_new"), F.desc("chunk_id")))).where("_n = 1").drop("_n", "_new")


def retrieval_quality(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """VEC-06. hit@k, mean reciprocal rank and mean distance of the first hit, over all queries. wanted: query_id, want (a source)."""
    first = hits.where(F.col("place") <= k).join(wanted, "query_id").groupBy("query_id").agg(F.min(F.when(F.col("source") == F.col("want"), F.col("place"))).alias("rank"), F.min("distance").alias("top"))
    every = wanted.join(first, "query_id", "left")
    return every.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("top"), 6).alias("mean_top1"))


def embedded(df: DataFrame, embed, text_col: str = "text", batch: int = 64) -> DataFrame:
    """VEC-05. df with embedding: embed, a function of a list of texts, called on batches of so many, in order."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for low in range(0, len(frame), batch):
                own = embed(frame[text_col].iloc[low : low + batch].tolist())
                if len(own) != len(frame.iloc[low : low + batch]):
                    raise ValueError("as many vectors as texts are wanted")
                vectors += own
            yield frame.assign(embedding=vectors)

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", embedding array<float>")


def context_blocks(profile: DataFrame, *blocks: DataFrame) -> DataFrame:
    """VEC-08. Per user, the blocks (user_id, block) that aren't empty in the order given, a blank line between."""
    every = profile.select("user_id", F.lit(0).alias("n"), "block")
    for n, b in enumerate(blocks, 1):
        every = every.unionByName(b.select("user_id", F.lit(n).alias("n"), "block"))
    parts = F.array_sort(F.collect_list(F.struct("n", "block")))
    return every.where(F.coalesce("block", F.lit("")) != "").groupBy("user_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context"))
