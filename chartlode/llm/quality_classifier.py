"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight for each hashed feature, shared by all grades, and ordered thresholds.
The features are word frequencies and the bucketed shape of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.llm.common import Cached, as_bytes, crc_mod, docs_of, slices

BITS = 17
#: Traits of a whole text.
TRAITS = 7
SIGNS = b"#*$%&|<>{}[]=_/\\"


def bucket(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token) >> (64 - BITS)


def features(text: bytes | None, buckets: Cached) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values: each word its share, each trait of the whole text 1."""
    words = text.lower().split() if text else []
    n = len(words)
    size = max(1, len(text or b""))
    lines = (text or b"").split(b"\n")
    level = lambda x, steps: int(steps * x)
    traits = [
        b"\x00words%d" % n.bit_length(),
        b"\x00length%d" % level((size - n) / max(1, n), 1),
        b"\x00signs%d" % level(min(1, (size - len((text or b"").translate(None, SIGNS))) / size), 20),
        b"\x00digits%d" % level((size - len((text or b"").translate(None, b"0123456789"))) / size, 20),
        b"\x00distinct%d" % level(len(set(words)) / max(1, n), 10),
        b"\x00lines%d" % level(len(set(lines)) / len(lines), 10),
        b"\x00stops%d" % level(sum(w.endswith((b".", b"!", b"?")) for w in words) / max(1, n), 40),
    ]
    return values_of(np.fromiter(map(buckets.__getitem__, [*words, *traits]), np.int64, n + TRAITS))


def values_of(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text, its traits last, and their values."""
    n = len(index) - TRAITS
    return index, np.concatenate([np.full(n, 1 / max(1, n)), np.ones(TRAITS)])


class CumulativeLink:
    """weights, and the ordered thresholds between grades 0..k."""

    def __init__(self, grades: int):
        self.weights, self.thresholds = np.zeros(1 << BITS), np.linspace(-1, 1, grades - 1) if grades > 1 else np.zeros(0)

    @staticmethod
    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def at_most(self, f: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k from -1 (0) to the last grade (1), by rows."""
        middle = self.sigmoid(self.thresholds[None, :] - f[:, None])
        return np.hstack([np.zeros((len(f), 1)), middle, np.ones((len(f), 1))])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> None:
        """Maximum likelihood by Adagrad. The thresholds move freely and are put in order after each step."""
        rng, seen, seen_t = np.random.default_rng(seed), np.full(len(self.weights), 1e-4), np.full(len(self.thresholds), 1e-2)
        first = np.bincount(grades, minlength=len(self.thresholds) + 1).cumsum()[:-1] / max(1, len(grades))
        self.thresholds = np.log(np.clip(first, 0.005, 0.995) / (1 - np.clip(first, 0.005, 0.995)))
        for _ in range(epochs if len(self.thresholds) else 0):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), batch):
                own = order[start : start + batch]
                index, values = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                ends = np.cumsum([len(rows[i][0]) for i in own])
                row = np.repeat(np.arange(len(own)), np.diff(ends, prepend=0))
                f = np.bincount(row, self.weights[index] * values, len(own))
                c, y, at = self.at_most(f), grades[own], np.arange(len(own))
                slope = c * (1 - c)
                p = np.maximum(c[at, y + 1] - c[at, y], 1e-6)
                df = (slope[at, y + 1] - slope[at, y]) / p  # of the negative log likelihood, by f
                g = np.bincount(index, df[row] * values, len(self.weights)) / len(own) + decay * self.weights
                seen += g * g
                self.weights -= rate * g / np.sqrt(seen)
                gt = np.zeros(len(self.thresholds) + 2)
                np.add.at(gt, y + 1, -slope[at, y + 1] / p)
                np.add.at(gt, y, slope[at, y] / p)
                gt = gt[1:-1] / len(own)
                seen_t += gt * gt
                self.thresholds = np.sort(self.thresholds - 0.3 * rate * gt / np.sqrt(seen_t))

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], tail: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, P(grade >= tail)."""
        c = self.at_most(np.array([self.weights[i] @ v for i, v in rows]))
        return (1 - c[:, 1:-1]).sum(axis=1), 1 - c[:, min(tail, c.shape[1] - 1)]


def train(df: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rating_id_col: str = "doc_id", grade_col: str = "grade", folds: int = 4, held_fold: int = 2, max_rows: int = 6000, max_chars: int = 200_000, max_words: int = 4_000_000) -> CumulativeLink:
    """Fit on max_rows rated rows at most (those of the least hashes) whose crc32(id) modulo folds isn't held_fold.

    Grades are 0, 1, 2, ...; an id that is rated twice has its lowest grade; null ids and grades and texts over max_chars
    aren't learned from. Tasks hash the texts; what comes to the driver is numbers, of max_words words in all at most: of longer
    samples, whole texts are taken in the order of their ids until the next one would pass it. Without rows every weight is 0."""
    rated = ratings.select(F.col(rating_id_col).alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).where((F.col("grade") >= 0) & (crc_mod("doc_id", folds) != held_fold))
    chosen = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs_of(df, id_col, text_col).join(F.broadcast(chosen), "doc_id").where(F.length("text") <= max_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Cached(bucket)
        for batch in slices(batches):
            found = [features(t, buckets) for t in as_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([len(i) for i, _ in found], pa.int64()), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary())], ["doc_id", "grade", "n", "places"])

    rows, grades, held = [], [], 0
    hashed = sample.mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, grade int, n long, places binary")
    for r in hashed.orderBy("doc_id", "places").limit(max_rows).toLocalIterator():
        if (held := held + r["n"]) > max_words:
            break
        rows.append(values_of(np.frombuffer(r["places"], np.int32)))
        grades.append(r["grade"])
    model = CumulativeLink(max(grades, default=1) + 1)
    model.fit(rows, np.array(grades, int))
    return model


def grade(df: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text", *, tail: int = 1, least: float = 0.5, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, expected_grade, p_tail = P(grade >= tail), kept (p_tail >= least) of each row's whole text.

    A null or empty text is scored by its (absent) traits like any other. Repeated rows each get a row, held_out is false
    for a null id, other columns of df are not read, an empty table gives an empty one."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, buckets = shared.value, Cached(bucket)
        for batch in slices(batches):
            expected, p = own.score([features(t, buckets) for t in as_bytes(batch)], tail)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(expected), pa.array(p), pa.array(p >= least)], ["doc_id", "held_out", "expected_grade", "p_tail", "kept"])

    docs = docs_of(df, id_col, text_col).withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == held_fold, F.lit(False)))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, expected_grade double, p_tail double, kept boolean")
