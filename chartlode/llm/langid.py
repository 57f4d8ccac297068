"""Language identification by hyperdimensional profiles.

Each symbol has a random vector of +1 and -1. An n-gram is the product (binding) of its symbols' vectors, each rotated by its
place; a document is the sum (bundle) of its n-grams; a language's prototype is the sum over its documents, each scaled to
length 1. A document goes to the prototype of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.llm.common import crc_mod, docs_of, judged, slices, verdicts

#: Symbols: 0 what separates words, 1-26 a-z, the rest other letters by their code point.
SYMBOLS = 96
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of each code point: letters only, in lower case."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ord(ch.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2_654_435_761 % 2**32 % (SYMBOLS - 27)
    return table


_table: np.ndarray | None = None


def grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes over the letters of a text, words set apart by one separator, and their counts."""
    global _table
    if _table is None:
        _table = symbol_table()
    s = _table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate([[0], s, [0]])
    s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])].astype(np.int64)
    s = np.concatenate([s, np.zeros(max(0, n - len(s)), np.int64)])
    code = s[: len(s) - n + 1].copy()
    for j in range(1, n):
        code = code * SYMBOLS + s[j : len(s) - n + 1 + j]
    return np.unique(code, return_counts=True)


class Profiles:
    """Symbol vectors from a seed, and document vectors."""

    def __init__(self, dim: int = 1024, n: int = 3, seed: int = 7):
        self.dim, self.n = dim, n
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
        self.rotated = [np.ascontiguousarray(np.roll(letters, n - 1 - j, axis=1)) for j in range(n)]
        self.known: dict[int, int] = {}
        self.vectors = np.zeros((0, dim), np.float32)

    def bound(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dim), np.int8)
        for j in range(self.n):
            out *= self.rotated[j][codes // SYMBOLS ** (self.n - 1 - j) % SYMBOLS]
        return out

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of length 1 (0 for texts without a letter) and whether a text has a letter.

        The n-grams of a few texts are bound once and summed by one matrix product."""
        found = [grams(t or "", self.n) for t in texts]
        has = np.array([len(c) > 0 for c, _ in found], bool)
        codes = np.unique(np.concatenate([c for c, _ in found])) if found else np.zeros(0, np.int64)
        out = np.zeros((len(texts), self.dim), np.float32)
        for low in range(0, len(codes), 8192):
            part = codes[low : low + 8192]
            counts = np.zeros((len(texts), len(part)), np.float32)
            for k, (c, n) in enumerate(found):
                a, b = np.searchsorted(c, (part[0], part[-1] + 1))
                counts[k, np.searchsorted(part, c[a:b])] = n[a:b]
            out += counts @ self.bound(part).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), has


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, folds: int = 5, held_fold: int = 0, per_language: int = 1000, most_languages: int = 1000, dim: int = 1024, n: int = 3) -> tuple[list[str], np.ndarray]:
    """Prototypes from rows with text, language and id whose crc32(id) modulo folds isn't held_fold.

    Of each language, about per_language documents are taken, by a hash of their ids: the bound on the rows that the fit
    reads. Each task bundles its own documents; the vectors of tasks are summed place by place in Spark, in a tree, so that one a language
    comes back, however many tasks there are. Only the most_languages most frequent languages (ties: in order) are learned, a bound
    on what the driver and each task hold. Returns the languages, in order, and their prototypes; none for an empty table."""
    docs = docs_of(df, id_col, text_col, lang_col).withColumnRenamed(lang_col, "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held_fold))
    sizes = docs.groupBy("lang").count()
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A frequent language is thinned to per_language documents as expected, a rare one is taken whole. There are at most most_languages rates.
    rates = sizes.orderBy(F.desc("count"), "lang").limit(most_languages).select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("rate"))
    chosen = docs.join(F.broadcast(rates), "lang").where(share < F.col("rate")).select("text", F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dim, n), {}
        for batch in slices(batches, 64):
            vectors, _ = profiles.documents(batch.column("text").to_pylist())
            for lang, v in zip(batch.column("lang").to_pylist(), vectors, strict=True):
                sums[lang] = sums.get(lang, 0) + np.rint(v.astype(np.float64) * 2**32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column("lang").to_pylist(), batch.column("v").to_pylist(), strict=True):
                totals[lang] = totals.get(lang, 0) + np.frombuffer(v, np.int64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["lang", "v"])

    sums = chosen.mapInArrow(run, "lang string, v binary")
    # A language's vectors are dealt over 64 partial sums first, and one task adds those up; in whole numbers, so that their order is all the same.
    parts = sums.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(64))).repartition("lang", "part").select("lang", "v").mapInArrow(add, "lang string, v binary")
    totals = {r["lang"]: np.frombuffer(r["v"], np.int64).astype(np.float64) for r in parts.repartition("lang").mapInArrow(add, "lang string, v binary").collect()}
    langs = sorted(totals)
    protos = np.array([totals[x] / max(np.linalg.norm(totals[x]), 1e-9) for x in langs], np.float32).reshape(len(langs), dim)
    return langs, protos


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, held_fold: int = 0, n: int = 3, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of df, from its whole text.

    score is the cosine brought to 0..1. A text that is null or without a letter is `und` with score 0, as is every text
    under a model of no languages. Ties go to the first language in order. held_out is false for a null id. Repeated rows
    each get a row; other columns of df are not read, but with carry the row comes along as a struct `row`."""
    langs, protos = model
    shared = df.sparkSession.sparkContext.broadcast((langs, protos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        profiles = Profiles(vectors.shape[1], n)
        for batch in slices(batches, 64):
            own, has = profiles.documents(batch.column("text").to_pylist())
            if names:
                cosines = own @ vectors.T
                best = cosines.argmax(axis=1)
                found = [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                score = np.where(has, np.clip((1 + cosines.max(axis=1)) / 2, 0, 1), 0).astype(np.float64)
            else:
                found, score = [UNKNOWN] * len(has), np.zeros(len(has))
            yield verdicts(batch, {"held_out": batch.column("held_out"), "lang_pred": pa.array(found, pa.string()), "score": pa.array(score)})

    docs = docs_of(df, id_col, text_col, carry=carry).withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == held_fold, F.lit(False)))
    return judged(docs, run, "held_out boolean, lang_pred string, score double")
