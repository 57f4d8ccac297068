"""Toxicity by a convolutional text classifier.

Words are the mean of hashed embeddings of the word, two prefixes and a suffix; filters of widths 1 to 3 slide over them; the
largest value of each filter over the whole text goes into a logistic output. Trained in numpy; the output is shifted by a
threshold that is calibrated for each language, the language being told from the text's bytes alone.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.llm.common import as_bytes, crc_mod, docs_of, held_out_crc, judged, slices, verdicts

BITS, DIM, WIDTHS, FILTERS = 19, 8, (1, 2, 3), 6
#: Every ASCII byte but letters and digits to a space, A-Z lowered.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
PIECES = 4


def pieces_of(word: bytes) -> list[int]:
    hash_ = xxhash.xxh3_64_intdigest
    return [h >> (64 - BITS) for h in (hash_(word), hash_(b"<4" + word[:4]), hash_(b"<6" + word[:6]), hash_(b"5>" + word[-5:]))]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Words(dict):
    """Number of each word seen, with the hashed pieces of each; cleared by the user between texts."""

    def __init__(self):
        super().__init__()
        self.pieces: list[list[int]] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self.pieces)
        self.pieces.append(pieces_of(word))
        return self[word]


class Network:
    """Embeddings, filters and output; vectors() and the rest work on whole texts."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # the first filter of each width starts on the first dimension, which starts on log odds
            f[:, :, 0] = 0
            f[:, 0, 0] = 1 / len(f)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out[0] = 1
        self.shift = np.float32(0)
        self.languages, self.centroids, self.thresholds = [], np.zeros((0, 256), np.float32), np.zeros(0)
        self.learned = False

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter over the text (0 at least) and where its window begins. x: word vectors."""
        if not len(x):
            return np.zeros(len(self.out), np.float32), np.zeros(len(self.out), np.int64)
        x = np.concatenate([x, np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
        values, places = [], []
        n = len(x) - max(WIDTHS) + 1
        for f in self.filters:
            z = x[:n] @ f[0]
            for j in range(1, len(f)):
                z += x[j : n + j] @ f[j]
            at = z.argmax(axis=0)
            values.append(z[at, np.arange(FILTERS)])
            places.append(at)
        return np.maximum(np.concatenate(values) + self.bias, 0), np.concatenate(places)

    def logit(self, x: np.ndarray) -> float:
        return float(self.pooled(x)[0] @ self.out + self.shift)

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 4, batch: int = 16, rate: float = 0.02, seed: int = 2) -> None:
        """texts: pieces of each word (words x PIECES). Adagrad on the cross-entropy, both labels weighing the same in sum."""
        self.learned = True
        positive = max(1, int(y.sum()))
        share = positive / max(2, len(y))
        toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for t, label in zip(texts, y, strict=True):
            (toxic if label else clean)[np.unique(t)] += 1
        self.embedding[:, 0] = np.log((toxic + 4 * share) / (clean + 4 * (1 - share)) * (1 - share) / share)
        tops = np.array([self.logit(self.embedding[t].mean(axis=1)) if len(t) else 0 for t in texts])
        self.shift = np.float32(-(np.median(tops[y == 1]) + np.median(tops[y == 0])) / 2)
        rng = np.random.default_rng(seed)
        seen = {"e": np.full((1 << BITS, 1), 0.1, np.float32), "f": [np.full_like(f, 0.1) for f in self.filters], "b": np.full_like(self.bias, 0.1), "o": np.full_like(self.out, 0.1), "s": 0.1}
        weight = np.where(y == 1, 0.5 / share, 0.5 / max(1e-9, 1 - share))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), batch):
                grad = {"f": [np.zeros_like(f) for f in self.filters], "b": np.zeros_like(self.bias), "o": np.zeros_like(self.out), "s": 0.0}
                rows, steps = [], []
                for i in order[start : start + batch]:
                    t = texts[i]
                    x = self.embedding[t].mean(axis=1) if len(t) else np.zeros((0, DIM), np.float32)
                    top, at = self.pooled(x)
                    d = weight[i] * (1 / (1 + np.exp(-np.clip(top @ self.out + self.shift, -30, 30))) - y[i]) / batch
                    grad["o"] += d * top
                    grad["s"] += d
                    live = d * self.out * (top > 0)
                    grad["b"] += live
                    for k, f in enumerate(self.filters):
                        for c in range(FILTERS):
                            g = live[k * FILTERS + c]
                            if g:
                                p = at[k * FILTERS + c]
                                for j in range(min(len(f), len(x) - p)):
                                    grad["f"][k][j, :, c] += g * x[p + j]
                                    rows.append(t[p + j])
                                    steps.append(g * f[j, :, c] / PIECES)
                for k, f in enumerate(self.filters):
                    seen["f"][k] += grad["f"][k] ** 2
                    f -= rate * grad["f"][k] / np.sqrt(seen["f"][k])
                for key, value in (("b", self.bias), ("o", self.out)):
                    seen[key] += grad[key] ** 2
                    value -= rate * grad[key] / np.sqrt(seen[key])
                seen["s"] += grad["s"] ** 2
                self.shift -= np.float32(rate * grad["s"] / np.sqrt(seen["s"]))
                if rows:
                    flat, each = np.concatenate(rows), np.repeat(np.array(steps, np.float32), PIECES, axis=0)
                    own, inverse = np.unique(flat, return_inverse=True)
                    g = np.stack([np.bincount(inverse, each[:, c], len(own)) for c in range(DIM)], axis=1).astype(np.float32)
                    seen["e"][own] += (g**2).sum(axis=1, keepdims=True)
                    self.embedding[own] -= rate * g / np.sqrt(seen["e"][own])

    def calibrate(self, logits: np.ndarray, y: np.ndarray, langs: list[str], shares: np.ndarray, weight: float = 15) -> None:
        """For each language the threshold of most F1 over its own rows, drawn to that of all rows: the latter weighs as much as weight rows of the language's rarer label."""

        def best(own: np.ndarray) -> float:
            order = np.argsort(-logits[own])
            z, hits = logits[own][order], np.cumsum(y[own][order])
            f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
            k = int(f1.argmax())
            return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)

        everything = best(np.arange(len(y))) if 0 < y.sum() < len(y) else 0.0
        self.languages = sorted(set(langs))
        names = np.array(langs)
        self.centroids = np.array([shares[names == x].mean(axis=0) for x in self.languages], np.float32).reshape(-1, 256)
        self.thresholds = np.full(max(1, len(self.languages)), everything)
        for k, x in enumerate(self.languages):
            own = np.flatnonzero(names == x)
            if n := min(y[own].sum(), (1 - y[own]).sum()):
                self.thresholds[k] = (n * best(own) + weight * everything) / (n + weight)

    def scores(self, logits: np.ndarray, shares: np.ndarray, at: float) -> np.ndarray:
        """The logits as 0..1, a language's threshold being brought to at. 0 from a network that has learned nothing."""
        if not self.learned:
            return np.zeros(len(logits))
        which = (shares @ self.centroids.T).argmax(axis=1) if len(self.languages) > 1 else np.zeros(len(logits), int)
        z = logits - self.thresholds[which] if len(self.thresholds) else logits
        return 1 / (1 + np.exp(-np.clip(z + np.log(at / (1 - at)), -40, 40)))


def byte_shares(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of the bytes of a text: their product is the likeness of two texts' letters."""
    if not text:
        return np.zeros(256, np.float32)
    n = np.bincount(np.frombuffer(text.translate(FOLD), np.uint8), minlength=256)
    n[0x20] = 0
    return np.sqrt(n / max(1, n.sum())).astype(np.float32)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, label_id_col: str = "doc_id", label_col: str = "toxic", folds: int = 4, held_fold: int = 2, max_toxic: int = 3000, max_clean: int = 5000, max_words: int = 4_000_000) -> Network:
    """Fit on labelled rows whose crc32(id) modulo folds isn't held_fold, a third of which calibrates.

    max_toxic and max_clean bound the rows (those of the least hashes), max_words the words in all of them: whole texts are
    taken in the order of their hashes as far as they fit in. One task fits, so that no text comes to the driver. An
    id that is labelled twice is toxic if either label is; null ids, labels and texts teach nothing. lang only groups the
    calibration rows by language and is told from bytes later. Without labels of both kinds nothing is learned: every score is 0, and no row is toxic."""
    rated = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (crc_mod("doc_id", folds) != held_fold))
    rated = rated.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = [rated.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in ((1, max_toxic), (0, max_clean))]
    docs = docs_of(df, id_col, text_col, lang_col).withColumnRenamed(lang_col, "lang")
    sample = docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").where("text is not null")
    sample = sample.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "label")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_toxic + max_clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(batches, folds, held_fold, max_words))], pa.binary())], ["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").head(1)
    return pickle.loads(found[0]["model"]) if found else Network()


def fitted(batches: Iterator[pa.RecordBatch], folds: int, held_fold: int, max_words: int) -> Network:
    """The network of the rows doc_id, text, lang, label."""
    words, y, shares, langs, later = Words(), [], [], [], []
    flat, ends = array("i"), [0]  # one block for all texts
    for batch in slices(batches):
        for doc, text, lang, label in zip(batch.column("doc_id").to_pylist(), as_bytes(batch), batch.column("lang").to_pylist(), batch.column("label").to_pylist(), strict=True):
            own = words_of(text)
            if ends[-1] + len(own) > max_words:
                continue
            for w in own:
                flat.extend(words.pieces[words[w]])
            ends.append(len(flat) // PIECES)
            words.clear()
            words.pieces.clear()
            y.append(label)
            shares.append(byte_shares(text))
            langs.append(lang)
            later.append(held_out_crc(doc, folds) == (held_fold + 1) % folds)
    held = np.frombuffer(flat, np.int32).reshape(-1, PIECES)
    texts = [held[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    net, y, later = Network(), np.array(y, int), np.array(later, bool)
    early = np.flatnonzero(~later)
    if 0 < y[early].sum() < len(early):
        net.fit([texts[i] for i in early], y[early])
        use = np.flatnonzero(later) if 0 < y[later].sum() < later.sum() else early
        net.calibrate(np.array([net.logit(net.embedding[texts[i]].mean(axis=1)) for i in use]), y[use], [langs[i] for i in use], np.array([shares[i] for i in use]))
    return net


def score(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", *, at: float = 0.3, folds: int = 4, held_fold: int = 2, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from score at on) of each row's whole text.

    A null or empty text has no words: its filters are 0 and its score is that of such a text. Repeated rows each get a row;
    held_out is false for a null id; other columns of df are not read, but with carry the row comes along as a struct `row`; an
    empty table gives an empty one."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = shared.value, Words()
        table = np.zeros((0, DIM), np.float32)
        for batch in slices(batches):
            logits, shares = [], []
            for text in as_bytes(batch):
                if len(words) > 200_000:
                    words.clear()
                    words.pieces.clear()
                    table = table[:0]
                split = words_of(text)
                numbers = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
                if len(words.pieces) > len(table):
                    new = np.array(words.pieces[len(table) :], np.int64)
                    if len(new) < 2000 and len(table) > 4000:  # rows for a text's own new words; joined to the table when there are many
                        more = own.embedding[new].mean(axis=1)
                        x = np.empty((len(numbers), DIM), np.float32)
                        old = numbers < len(table)
                        x[old], x[~old] = table[numbers[old]], more[numbers[~old] - len(table)]
                        logits.append(own.logit(x))
                        shares.append(byte_shares(text))
                        continue
                    table = np.concatenate([table, own.embedding[new].mean(axis=1)])
                logits.append(own.logit(table[numbers]))
                shares.append(byte_shares(text))
            found = own.scores(np.array(logits), np.array(shares), at)
            yield verdicts(batch, {"held_out": batch.column("held_out"), "score": pa.array(found.astype(np.float64)), "predicted": pa.array((found >= at).astype(np.int32))})

    docs = docs_of(df, id_col, text_col, carry=carry).withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == held_fold, F.lit(False)))
    return judged(docs, run, "held_out boolean, score double, predicted int")
