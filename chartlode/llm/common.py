"""Helpers that the training-data operators share: shared storage, Arrow batches, word hashing."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one where that is unset, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set, and executors don't see the driver's folders")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="chartlode-")
        base = _local[app]
    return f"{base.rstrip('/')}/chartlode"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def docs_of(df: DataFrame, id_col: str, text_col: str, *more: str, carry: bool = False) -> DataFrame:
    """Only the named columns, as doc_id, text and the rest: no other column of the input can clash with those that an operator makes.

    carry: also the whole row of df, as a struct named row."""
    whole = [F.struct("*").alias("row")] if carry else []
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in more], *whole)


def judged(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], verdict: str) -> DataFrame:
    """docs through run, whose batches have doc_id and the columns of verdict (DDL), and row where docs carries it."""
    fields = [f for f in docs.schema if f.name in ("doc_id", "row")]
    return docs.mapInArrow(run, StructType([fields[0], *StructType.fromDDL(verdict), *fields[1:]]))


def verdicts(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch that judged() wants of columns, for the rows of batch."""
    own = {"doc_id": batch.column("doc_id"), **columns}
    if "row" in batch.schema.names:
        own["row"] = batch.column("row")
    return pa.RecordBatch.from_arrays(list(own.values()), list(own))


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n. Null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of each word seen; a bounded cache of a pure function."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Numbered(dict):
    """A number for each word seen, 0 for the first; hashes has their 64-bit hashes, new the words that learn() hasn't met yet."""

    def __init__(self):
        super().__init__()
        self.new, self.hashes = [], np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def learn(self, listed: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The numbers of the words of all texts in a row, which text each is of, and the words that are new."""
        sizes = [len(words) for words in listed]
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(listed)), np.int32, sum(sizes))
        new, self.new = self.new, []
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return numbers, np.repeat(np.arange(len(listed)), sizes), new


class Cached(dict):
    """Bounded cache of a pure function of one argument."""

    def __init__(self, function, limit: int = 200_000):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finisher on 64-bit integers (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_hash(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each n consecutive word hashes; of the whole sequence if it is shorter; nothing for no words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    return out


def held_out_crc(doc_id: object, n: int) -> int:
    """crc_mod() for one id in Python."""
    return zlib.crc32(str(doc_id).encode()) % n
