"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive benchmark words; a document is scanned with a shift table over blocks of two words,
so that most positions are never looked at; where the shift is 0, the suffix's bucket names the patterns to compare in full.

The benchmark is cut into blocks of a bounded number of windows. Tasks build a block's tables from its words; what the driver
sends out at a time is the words of a few blocks.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.llm.common import as_bytes, docs_of, judged, materialize, slices, verdicts

#: Upper case to lower case; every ASCII byte that is neither a digit nor a letter to a space. Bytes of other characters stay.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lowered."""
    return text.translate(FOLD).split() if text else []


class WuManber:
    """Search for word sequences of one common length."""

    def __init__(self, patterns: dict[tuple[int, ...], list[int]], bits: int = 16):
        """patterns: word numbers (from 1) to the items that hold them."""
        self.m = m = len(next(iter(patterns)))
        self.block = min(2, m)
        self.mask = (1 << bits) - 1
        self.shift = np.full(1 << bits, m - self.block + 1, np.int64)
        self.buckets: dict[int, dict[tuple[int, ...], list]] = defaultdict(lambda: defaultdict(list))
        for words, items in patterns.items():
            keys = self.keys(np.array(words, np.int64)).tolist()
            for j, key in enumerate(keys):
                self.shift[key] = min(self.shift[key], len(keys) - 1 - j)
            self.buckets[keys[-1]][words[:2]].append((words, items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Table place of the block that ends at each word, from the first whole block on."""
        return (words if self.block == 1 else words[:-1] * 40_503 + words[1:]) & self.mask

    def find(self, words: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence."""
        m, block = self.m, self.block
        if len(words) < m:
            return
        keys = self.keys(words)
        shifts = self.shift[keys]
        if shifts[m - block :].all():
            return
        steps, keys, listed = shifts.tolist(), keys.tolist(), words.tolist()
        i, n = m - block, len(steps)
        while i < n:
            step = steps[i]
            if step:
                i += step
                continue
            start = i + block - m
            for pattern, items in self.buckets[keys[i]].get(tuple(listed[start : start + 2][:m]), ()):
                if tuple(listed[start : start + m]) == pattern:
                    yield start, items
            i += 1


class Matcher:
    """The searches of one block of the benchmark, one for each pattern length. pieces: (item, its words apart by spaces)."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
        for item, words in pieces:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words.split(b" ")]
            n = min(window, len(own))
            for i in range(len(own) - n + 1):
                found = by_length[n][tuple(own[i : i + n])]
                if not found or found[-1] != item:
                    found.append(item)
        self.searches = [WuManber(dict(p), max(16, len(p).bit_length() + 2)) for p in by_length.values()]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of words and the items that occur."""
        get = self.numbers.get
        own = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        spans, items = [], set()
        for search in self.searches:
            for start, found in search.find(own):
                spans.append((start, start + search.m))
                items.update(found)
        return spans, items


def pieces_of(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """item, piece, words, n: the items' words, cut into pieces of at most so many windows (n) that overlap by window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch), strict=True):
                words = words_of(text)
                total = max(1, len(words) - window + 1) if words else 0
                for k, start in enumerate(range(0, total, most)):
                    n = min(most, total - start)
                    rows.append((item, k, b" ".join(words[start : start + n + window - 1]), n))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = {"item": pa.string(), "piece": pa.int64(), "words": pa.binary(), "n": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    return benchmark.mapInArrow(run, "item string, piece long, words binary, n long")


def merged(spans: list) -> list[list[int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


_built: dict[tuple[str, int], Matcher] = {}


def matcher(shared, name: str, k: int, window: int) -> Matcher:
    """The tables of block k of what was sent out under a name of its own; a worker keeps those that it has built last."""
    key = (name, k)
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(shared.value[k], window)
    return _built[key]


def search(docs: DataFrame, shared, n_blocks: int, window: int, hold_bytes: int, first: bool, last: bool) -> DataFrame:
    """docs through so many blocks. What earlier calls have found comes in as the columns spans and items, unless first.

    A task holds hold_bytes of text, or 256 rows where there is one block, while it goes through the blocks."""
    name = uuid.uuid4().hex

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for batch in slices(batches):
            held.append(batch)
            size += batch.column("text").nbytes
            if n_blocks == 1 or size > hold_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            spans = [[[] for _ in range(b.num_rows)] if first else [x or [] for x in b.column("spans").to_pylist()] for b in group]
            items = [[set() for _ in range(b.num_rows)] if first else [set(x or ()) for x in b.column("items").to_pylist()] for b in group]
            counts = [[0] * b.num_rows for b in group]
            for k in range(n_blocks):
                table = matcher(shared, name, k, window)
                for g, batch in enumerate(group):
                    for row, text in enumerate(as_bytes(batch)):
                        words = words_of(text)
                        more, found = table.find(words)
                        spans[g][row] += more
                        items[g][row] |= found
                        counts[g][row] = len(words)
            for g, batch in enumerate(group):
                whole = [merged(s) for s in spans[g]]
                ids = [sorted(x) for x in items[g]]
                out = {"spans": pa.array(whole, pa.list_(pa.list_(pa.int64())))}
                if last:
                    hits = [sum(e - s for s, e in w) for w in whole]
                    out |= {"n_words": pa.array(counts[g], pa.int64()), "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array(map(len, ids), pa.int64()), "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]), "contaminated": pa.array([h > 0 for h in hits], pa.bool_())}
                else:
                    out |= {"text": batch.column("text"), "items": pa.array(ids, pa.list_(pa.string()))}
                yield verdicts(batch, out)

    found = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else "text string, items array<string>"
    return judged(docs, run, f"spans array<array<long>>, {found}")


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_windows: int = 100_000, block_bytes: int = 8 << 20, pass_blocks: int = 8, hold_bytes: int = 32 << 20, carry: bool = False) -> DataFrame:
    """Where benchmark windows occur in documents.

    One row per row of df: doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated, and spans:
    the merged hit spans as [first word, end). Texts are taken whole. A null or empty text has no words and isn't
    contaminated; items without words or id match nothing; an item of fewer words than window is one window; ties and
    repeated rows on either side count as themselves, repeated item ids once. An empty benchmark contaminates nothing. Other
    columns of df are not read, but with carry the row comes along as a struct `row`.

    The benchmark's windows are dealt by hash over blocks of about block_windows windows and block_bytes of words. A worker
    has the tables of one block at a time. pass_blocks blocks are sent out for one pass over the documents; a larger benchmark
    takes more passes, between which the documents are written with what has been found."""
    spark = df.sparkSession
    items = docs_of(benchmark, item_col, item_text_col).where("text is not null and doc_id is not null").select(F.col("doc_id").cast("string").alias("item"), "text")
    pieces = materialize(pieces_of(items, window, block_windows), "windows")
    total = pieces.agg(F.sum("n").alias("n"), F.sum(F.octet_length("words")).alias("size")).first()
    n_blocks = max(1, math.ceil((total["n"] or 0) / block_windows), math.ceil((total["size"] or 0) / block_bytes))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(n_blocks)))
    docs = docs_of(df, id_col, text_col, carry=carry)
    for low in range(0, n_blocks, pass_blocks):
        own = range(low, min(low + pass_blocks, n_blocks))
        blocks: list[list[tuple[str, bytes]]] = [[] for _ in own]
        for r in pieces.where(F.col("block").between(own[0], own[-1])).toLocalIterator():  # pass_blocks times the bounds of a block
            blocks[r["block"] - low].append((r["item"], bytes(r["words"])))
        last = own[-1] == n_blocks - 1
        docs = search(docs, spark.sparkContext.broadcast(blocks), len(blocks), window, hold_bytes, low == 0, last)
        if not last:
            docs = materialize(docs, "searched")
    return docs
