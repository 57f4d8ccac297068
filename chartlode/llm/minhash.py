"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Only shingle sets are compared. Documents with equal sets form a class at once; one representative of each goes on. Candidates
come from signature bands; a band's documents are compared with its pivot first, and only what is still in another component
is compared with the others. So a group of thousands of copies costs about as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlode.llm.common import WordHashes, as_bytes, docs_of, materialize, mixed, slices, windows_hash

#: The permuted universe has 2**UNIVERSE places.
UNIVERSE = 20
#: What stands for a shingle set.
KEY = ["n_shingles", "set_a", "set_b"]
#: Rows of either side of a block in which all are compared.
BLOCK = 256


def shingles(text: bytes | None, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles, A-Z lowered; one for a text of fewer words; none for no words."""
    return np.unique(windows_hash(hashes.of(text.lower().split()), n)) if text else np.zeros(0, np.uint64)


@lru_cache(maxsize=2)
def permutation(coordinates: int, seed: int = 5) -> np.ndarray:
    """Rows of consecutive places of the second permutation, wrapped around: row i holds its values under all the shifts at place i."""
    p = np.random.default_rng(seed).permutation(1 << UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: coordinates - 1]]), coordinates)


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash. The first permutation (a bijective mix) sends each shingle to a place; coordinate k is the least value there of the second, shifted by k."""
    rows = permutation(coordinates)
    places = (mixed(found ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - UNIVERSE)).astype(np.int64)
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 1024):
        np.minimum(least, rows[places[i : i + 1024]].min(axis=0), out=least)
    return least


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that stand for the set), bands (a hash for each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = WordHashes(), np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in slices(batches):
            sizes, a, b, keys = [], [], [], []
            for text in as_bytes(batch):
                found = shingles(text, hashes, n)
                sizes.append(len(found))
                a.append(int(mixed(found).sum(dtype=np.uint64)))
                b.append(int(mixed(found ^ np.uint64(0x1234567)).sum(dtype=np.uint64)))
                if len(found):
                    own = mixed(signature(found, bands * rows).reshape(bands, rows).astype(np.uint64) + weights)
                    keys.append(mixed(own.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).astype(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(a, np.uint64).astype(np.int64)), pa.array(np.array(b, np.uint64).astype(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union holds for the full shingle sets.

    texts: text by unique doc_id. Both joins are of written tables, so that Spark can split an id that very many pairs share;
    a task keeps the set of the last b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, last_set = WordHashes(), None, None
        for batch in slices(batches):
            b_ids, ok = batch.column("b").to_pylist(), []
            for text_a, b, text_b in zip(as_bytes(batch, "text_a"), b_ids, as_bytes(batch, "text_b"), strict=True):
                if b != last:
                    last, last_set = b, shingles(text_b, hashes, n)
                own = shingles(text_a, hashes, n)
                both = len(np.intersect1d(own, last_set, assume_unique=True))
                ok.append(100 * both >= percent * (len(own) + len(last_set) - both))
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)) for x in (batch.column("a"), batch.column("b"))], ["a", "b"])

    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """doc_id, component (the least id reachable) of every id in links (a, b).

    Every link leads from the larger to the smaller id. A round joins the smaller neighbours of an id to its least one, which
    becomes its parent, and then lets every link lead to the parent of where it led. Each changed link leads to a smaller id than before, so
    the rounds end, in a star about the least id of each component; chains are halved in a round."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        own = links.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        down = own.select("a", F.col("m").alias("b"), F.lit(False).alias("moved")).union(own.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved")))
        links = materialize(down.groupBy("a", "b").agg(F.max("moved").alias("moved")), "links")
        parents = materialize(links.groupBy("a").agg(F.min("b").alias("parent")), "parents")
        jumped = links.join(parents.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("parent", "b").alias("b"), (F.col("moved") | F.col("parent").isNotNull()).alias("moved"))
        links = materialize(jumped, "links")
        if not links.where("moved").head(1):
            break
    return links.select(F.col("a").alias("doc_id"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def fine(texts: DataFrame, n: int, bits: int) -> DataFrame:
    """doc_id, text, n_shingles and bits: the lowest bit of each of so many circulant coordinates, as words of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            found = [shingles(t, hashes, n) for t in as_bytes(batch)]
            words = [np.packbits((signature(f, bits) & 1).astype(np.uint8)).view(np.int64) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array([len(f) for f in found], pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["doc_id", "text", "n_shingles", "bits"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n_shingles long, bits array<long>")


def most_apart(percent: int, bits: int, deviations: float = 5.5) -> int:
    """So many bits differ at most between the sketches of two sets that link: a bit differs with probability (1 - Jaccard) / 2."""
    p = (1 - percent / 100) / 2
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def plausible(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column, percent: int, apart: int) -> Column:
    """What no pair that links fails: sizes near enough, and (but for one link in 10**7) sketches near enough."""
    differ = F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, k: total + k)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (differ <= apart)


def across(rows: DataFrame, percent: int, apart: int) -> DataFrame:
    """The plausible pairs (a, b) of few (side 0) and member (side 1) of different components in each block (bucket, i, j) of about BLOCK of either at most, each pair once or, if both are few, twice."""

    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, component, size, few = (t.column(c).to_numpy() for c in ("node", "component", "n_shingles", "side"))
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        x, y = np.flatnonzero(few == 0), np.flatnonzero(few == 1)
        if not len(x) or not len(y):
            return node[:0], node[:0]
        near = 100 * np.minimum(size[x][:, None], size[y][None, :]) >= percent * np.maximum(size[x][:, None], size[y][None, :])
        i, j = np.nonzero(near & (component[x][:, None] != component[y][None, :]))
        i, j = x[i], y[j]
        # A pair that shares several bands is compared in the first of them alone.
        first = (bands[i] == bands[j]).argmax(axis=1) if len(i) else i
        own = bands[i, first] == t.column("bucket")[0].as_py()
        i, j = i[own], j[own]
        ok = np.concatenate([np.bitwise_count(bits[i[k : k + 65_536]] ^ bits[j[k : k + 65_536]]).sum(axis=1) for k in range(0, len(i), 65_536)] or [np.zeros(0)]) <= apart
        return np.minimum(node[i[ok]], node[j[ok]]), np.maximum(node[i[ok]], node[j[ok]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chained(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not held.num_rows:
                continue
            key = np.stack([held.column(c).to_numpy() for c in ("bucket", "i", "j")])
            ends = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), *([held.num_rows] if batch is None else [])]
            start, out = 0, []
            for end in ends:
                out.append(pairs(held.slice(start, end - start)))
                start = end
            held = held.slice(start)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in out])) for k in (0, 1)], ["a", "b"])

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 85, bands: int = 20, rows: int = 4, bits: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of df.

    Documents link where 100 * intersection >= percent * union of their distinct shingles of so many words (A-Z lowered, words
    apart by ASCII white space); a text of fewer words is one shingle; a null or empty text has none and links with nothing.
    component_id is the least id reachable, kept whether it is the row's own. Rows that repeat an id are one document: each
    gets its own n_shingles, all the component of the id. A null id gives a null component and is kept. Ids are whole numbers, since groups are named by
    the least one; others are an error. Other columns of df
    are not read; an empty table gives an empty table.

    A pair of Jaccard s shares a band with probability 1 - (1 - s**rows)**bands: 1 - 4e-7 at s = 0.85 by default; no pair,
    bucket or group is capped. Candidates are sifted by finer sketches of so many bits before texts are compared, and text
    moves only for what is left."""
    docs = docs_of(df, id_col, text_col)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sketches = materialize(sketch(docs, shingle, bands, rows), "sketches")
    real = sketches.where("doc_id is not null and n_shingles > 0")
    sets = real.groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    sets = materialize(sets, "sets")
    # An id with several texts stands in several sets; only then are the representatives numbered by (id, set).
    repeated = bool(sketches.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1))
    node = F.xxhash64("rep", "set_a", "set_b") if repeated else F.col("rep")
    held = sets.select(node.alias("node"), "rep", "n_shingles", "set_a", "bands")
    entries = held.select("node", F.explode("bands").alias("bucket"))
    # What is joined to a frequent bucket is written first: Spark then splits that bucket's rows over tasks.
    full = materialize(entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "full")
    entries = materialize(entries.join(full, "bucket"), "entries")
    # The pivot of a band is the member that meets most others over all its bands: the same one in most bands of a group of near copies.
    weights = entries.groupBy("node").agg(F.sum("members").alias("weight"))
    pivots = materialize(entries.join(weights, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot")), "pivots")
    tried = entries.join(pivots, "bucket").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    met = entries.select("node").distinct()
    nodes = held.join(met, "node") if repeated else met.withColumn("rep", F.col("node")).withColumn("set_a", F.lit(0))
    texts = materialize(fine(texts_of(docs, nodes, repeated, shingle), shingle, bits), "texts")
    sketched, apart = texts.drop("text"), most_apart(percent, bits)
    one = sketched.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("bits").alias("bits_a"))
    two = sketched.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("bits").alias("bits_b"))
    tried = tried.join(one, "a").join(two, "b").where(plausible(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), percent, apart)).select("a", "b")
    links = materialize(verify(materialize(tried, "tried"), texts, shingle, percent), "verified")

    # Bands that still meet several components: the members outside their largest one against all members, block by block.
    placed = entries.join(components(links).withColumnRenamed("doc_id", "node"), "node", "left").select("node", "bucket", F.coalesce("component", "node").alias("component"))
    placed = materialize(placed, "placed")
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("members"), F.max("n").alias("most")).where("members > most")
    main = main.select("bucket", "main", F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int").alias("few_blocks"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    unsettled = placed.join(materialize(main, "main"), "bucket")
    unsettled = materialize(unsettled.join(sketched.withColumnRenamed("doc_id", "node"), "node").join(held.select("node", "bands"), "node"), "unsettled")
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    few = unsettled.where("component <> main").select("bucket", "node", "component", "n_shingles", "bits", "bands", own("few_blocks").alias("i"), F.lit(0).alias("side"), every("blocks").alias("j"))
    members = unsettled.select("bucket", "node", "component", "n_shingles", "bits", "bands", own("blocks").alias("j"), F.lit(1).alias("side"), every("few_blocks").alias("i"))
    rest = materialize(across(few.unionByName(members), percent, apart).distinct(), "rest")
    links = links.union(verify(rest, texts, shingle, percent))

    if repeated:
        ids = held.select("node", "rep")
        links = links.join(ids.select(F.col("node").alias("a"), F.col("rep").alias("id_a")), "a").join(ids.select(F.col("node").alias("b"), F.col("rep").alias("id_b")), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        # An id with several sets links their representatives.
        many = real.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
        links = links.union(real.join(many, "doc_id").join(sets.select(*KEY, "rep"), KEY).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    groups = components(links).withColumnRenamed("doc_id", "rep")
    named = materialize(sets.select(*KEY, "rep").join(groups, "rep", "left").select(*KEY, F.coalesce("component", "rep").alias("component")), "named")
    # Sets without shingles are in no row of named, nor are null ids to be named.
    out = sketches.join(named, KEY, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def texts_of(docs: DataFrame, nodes: DataFrame, repeated: bool, n: int) -> DataFrame:
    """doc_id (a node) and text of the nodes (node, rep, set_a).

    An id that is unique has the text of its only row; where ids repeat, the rows are told apart by their sets again."""
    own = docs.join(nodes.select(F.col("rep").alias("doc_id"), "node", "set_a"), "doc_id")
    if not repeated:
        return own.select(F.col("node").alias("doc_id"), "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            a = [int(mixed(shingles(t, hashes, n)).sum(dtype=np.uint64)) for t in as_bytes(batch)]
            ok = pa.array(np.array(a, np.uint64).astype(np.int64) == batch.column("set_a").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(ok), batch.column("text").filter(ok)], ["doc_id", "text"])

    return own.select("node", "text", "set_a").mapInArrow(same, "doc_id long, text string").dropDuplicates(["doc_id"])
