"""Best-fit packing of tokenized documents into fixed-length sequences, by exact-complement hashing.

Pieces are only ever told apart by their length, so the plan is made from the histogram of lengths (as many entries as a
sequence has tokens, whatever the size of the corpus). Spark tokenizes, counts, ranks the pieces of each length and looks each
rank up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartlode.llm.common import docs_of, materialize, slices

PIECES = "piece int, start long, length long, ids_crc32 long, part int, place long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None):
    """Function from text to ids. vocabulary: a tokenizers JSON file; ranks: the same vocabulary for tiktoken, which gives equal ids in a quarter of the time (the tests compare them), or None. Texts that hold a special token's string take the first."""
    import base64
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(vocabulary)
    encode_slow = lambda text: slow.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return encode_slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return lambda text: encode_slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def pieces_of(docs: DataFrame, vocabulary: str, ranks: str | None, size: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """A row for each piece, with the partition that made it and its place among that partition's pieces of equal length.

    keep_ids: also the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocabulary, ranks), TaskContext.get().partitionId(), defaultdict(int)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % size or size if len(ids) > size else len(ids)
                for k, start in enumerate([0, *range(first, len(ids), size)]):
                    piece = ids[start : start + (size if k else first)]
                    out.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes()), part, seen[len(piece)], *([piece.astype(np.int32)] if keep_ids else [])))
                    seen[len(piece)] += 1
            columns = list(zip(*out, strict=True))
            types = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[: len(columns)], strict=True)], names[: len(columns)])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + PIECES + (", ids array<int>" if keep_ids else ""))


class Sums:
    """Which lengths are left, how many, and the combinations of one, two and three of them by their sum."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.left = size, np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def of(self, gap: int, most: int, kind: int) -> Iterator[list[int]]:
        """Combinations of so many (kind) lengths, none over most, whose sum is gap, longest first; of lengths that are left when it is asked for.

        A pair is found by the complement of its longer length, a triple by the pairs under the complement of its longest."""
        if kind == 1:
            if gap <= most and self.left[gap]:
                yield [gap]
            return
        low, high = -(-gap // kind), min(most, gap - kind + 1)
        longest = np.arange(high, low - 1, -1)
        if kind == 2:
            longest = longest[(self.left[longest] > 0) & (self.left[gap - longest] > 0)]
        for b in longest[self.left[longest] > 0].tolist():
            for rest in self.of(gap - b, b, kind - 1) if self.left[b] else ():
                yield [b, *rest]

    def take(self, lengths: list[int]) -> int:
        """As many of the pattern as its scarcest length allows, which are gone then."""
        need = [(x, lengths.count(x)) for x in set(lengths)]
        n = min(int(self.left[x]) // k for x, k in need)
        for x, k in need if n else ():
            self.left[x] -= n * k
        return n


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns (how many sequences, lengths of their pieces) that use each length as often as counts has it.

    Each length, longest first, is an anchor, whose gap is looked up among the single lengths, then the sums of two, then those
    of three; a combination that fills it exactly is taken as often as its scarcest length allows. What is left goes best-fit.
    Exact fills can use up short pieces that other gaps need. So those of a range of anchors stay only if the best fit of what
    they leave ends with no more sequences in all than before; else its halves are tried."""
    sums = Sums(counts, size)
    patterns: list[tuple[int, list[int]]] = [(n, [size])] if (n := sums.take([size])) else []
    fewest = sum(n for n, _ in patterns) + sum(n for n, _ in best_fit(sums.left, size))

    def fill(anchors: list[int], kind: int) -> None:
        nonlocal fewest
        before, made = sums.left.copy(), len(patterns)
        for a in anchors:
            for combination in sums.of(size - a, a, kind) if sums.left[a] else ():
                if n := sums.take([a, *combination]):
                    patterns.append((n, [a, *combination]))
                if not sums.left[a]:
                    break
        if len(patterns) == made:
            return
        total = sum(n for n, _ in patterns) + sum(n for n, _ in best_fit(sums.left, size))
        if total <= fewest:
            fewest = total
            return
        sums.left[:] = before
        del patterns[made:]
        if len(anchors) > 1:
            fill(anchors[: len(anchors) // 2], kind)
            fill(anchors[len(anchors) // 2 :], kind)

    for kind in (1, 2, 3):
        fill(list(range(size - 1, 0, -1)), kind)
    return patterns + best_fit(sums.left, size)


def best_fit(left: np.ndarray, size: int) -> list[tuple[int, list[int]]]:
    """Patterns of best fit, longest first: each piece goes to the sequence with the smallest gap that holds it."""
    patterns: list[tuple[int, list[int]]] = []
    open_: dict[int, list[list]] = defaultdict(list)  # by gap: [how many, lengths] of the sequences begun
    gaps: list[int] = []  # the gaps in order
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = min(n, size // length)
                many = n // each
                begun, rest = [many, [length] * each], size - each * length
                n -= many * each
            else:
                gap = gaps[at]
                many, lengths = open_[gap].pop()
                used = min(many, n)
                if used < many:
                    open_[gap].append([many - used, lengths])
                elif not open_[gap]:
                    del gaps[at]
                begun, rest = [used, [*lengths, length]], gap - length
                n -= used
            if not rest:
                patterns.append((begun[0], begun[1]))
                continue
            if not open_[rest]:
                insort(gaps, rest)
            open_[rest].append(begun)
    return patterns + [(n, lengths) for group in open_.values() for n, lengths in group]


def intervals(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which rank on, the first sequence, the offset there."""
    rank: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for n, lengths in patterns:
        offset = 0
        for x in lengths:
            out[x].append((rank[x], base, offset))
            rank[x] += n
            offset += x
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, ranks: str | None = None, size: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most size tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids). A document is its
    ids followed by end_id; only documents over size ids are cut, into pieces of size whose first may be shorter.
    A null or empty text is the end_id alone. Repeated rows are packed each by itself; a null id stays null. An empty table
    gives an empty table. Other columns of df are not read. vocabulary and ranks: see encoder()."""
    pieces = materialize(pieces_of(docs_of(df, id_col, text_col), vocabulary, ranks, size, end_id, keep_ids), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(by_part.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("before")), "starts")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size entries at most
    table = df.sparkSession.sparkContext.broadcast(intervals(plan(counts, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = length == x
                first, base, shift = table.value[int(x)]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], shift[k]
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    own = [c for c in pieces.columns if c not in ("part", "place")]
    ranked = pieces.join(starts.drop("n"), ["part", "length"]).select(*own, (F.col("before") + F.col("place")).alias("rank"))
    schema = ", ".join(f"{c} {t}" for c, t in ranked.drop("rank").dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)
