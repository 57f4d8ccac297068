"""Language-model scores by masked pseudo-likelihood.

A small network predicts each token from the two tokens before and the two after it; a document's score is the sum of the log
probabilities of all its tokens, each with its neighbours on both sides known. Tokens are words hashed to VOCABULARY ids;
the output is a softmax over classes of ids, times one over the ids of the class.

Training is data-parallel over the whole corpus: in each round every task starts from the same weights, takes gradient steps on
every stride-th token of its own documents, and the weights are averaged in a tree of Spark tasks. The rounds together take
every token as a target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.llm.common import Cached, as_bytes, docs_of, materialize, slices

VOCABULARY, CLASSES, HIDDEN, OFFSETS = 2048, 32, 16, (-2, -1, 1, 2)
MEMBERS, EDGE = VOCABULARY // CLASSES, VOCABULARY
SHAPES = {"e": (len(OFFSETS), VOCABULARY + 1, HIDDEN), "b": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wm": (CLASSES, HIDDEN, MEMBERS), "bm": (CLASSES, MEMBERS)}
SIZE = sum(math.prod(s) for s in SHAPES.values())
#: How many weight vectors one task of the averaging tree adds up.
FAN_IN = 16
#: How many tokens are scored at once: what is computed for them stays in a core's cache.
SCORED = 4096
ONES, PLACES = np.ones(max(CLASSES, MEMBERS), np.float32), np.arange(SCORED)


def token(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % VOCABULARY


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def start(seed: int = 4) -> np.ndarray:
    """First weights: small, every token as likely as any other."""
    flat = np.random.default_rng(seed).normal(0, 0.05, SIZE).astype(np.float32)
    w = unpack(flat)
    w["bc"][:] = w["bm"][:] = 0
    return flat


def set_biases(w: dict[str, np.ndarray], counts: np.ndarray) -> None:
    """Token frequencies as output biases."""
    n = (counts + 0.5).reshape(CLASSES, MEMBERS)
    w["bc"][:] = np.log(n.sum(axis=1) / n.sum())
    w["bm"][:] = np.log(n / n.sum(axis=1, keepdims=True))


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts in a row, and the neighbours of each (EDGE beyond a text's ends)."""
    pad = np.full(2, EDGE, np.int32)
    flat = np.concatenate([pad, *[x for t in texts for x in (t, pad)]])
    at = np.flatnonzero(flat != EDGE)
    return flat[at], np.stack([flat[at + o] for o in OFFSETS])


def hidden(w: dict[str, np.ndarray], near: np.ndarray) -> np.ndarray:
    h = w["e"][0].take(near[0], axis=0)
    h += w["b"]
    for k in range(1, len(OFFSETS)):
        h += w["e"][k].take(near[k], axis=0)
    return np.tanh(h, out=h)


def exponents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, each row of which may have been shifted, its exponents, and their sums by row. Rows are shifted by their largest number only where one would leave the range of 32 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(x)
        total = e @ ONES[: x.shape[1]]
    if not (total.min() > 1e-30 and total.max() < 1e30):
        x = x - x.max(axis=1, keepdims=True)
        e = np.exp(x)
        total = e @ ONES[: x.shape[1]]
    return x, e, total


def chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at its place."""
    x, _, total = exponents(x)
    return x.ravel().take(PLACES[: len(x)] * x.shape[1] + at) - np.log(total)


def slopes(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The softmax of each row, less 1 at its place, divided by n."""
    _, e, total = exponents(x)
    e *= (1 / (n * total))[:, None]
    e.ravel()[np.arange(0, e.size, e.shape[1]) + at] -= 1 / n
    return e


def starts(x: np.ndarray) -> np.ndarray:
    """Where a new number begins."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def by_value(x: np.ndarray) -> np.ndarray:
    """The stable order of small numbers: as 16 bits they are sorted by their digits."""
    return np.argsort(x.astype(np.int16), kind="stable")


def groups(classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = by_value(classes)
    ends = np.cumsum(np.bincount(classes, minlength=CLASSES))
    for c in range(CLASSES):
        if len(own := order[ends[c - 1] if c else 0 : ends[c]]):
            yield c, own


def log_p(w: dict[str, np.ndarray], tokens: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Log probability of each token given its neighbours."""
    out = np.empty(len(tokens), np.float32)
    for low in range(0, len(tokens), SCORED):
        t = tokens[low : low + SCORED]
        h, c, m = hidden(w, near[:, low : low + SCORED]), t // MEMBERS, t % MEMBERS
        own = chosen(h @ w["wc"] + w["bc"], c)
        for k, at in groups(c):
            own[at] += chosen(h.take(at, axis=0) @ w["wm"][k] + w["bm"][k], m[at])
        out[low : low + SCORED] = own
    return out


def step(w: dict[str, np.ndarray], seen: dict[str, np.ndarray], tokens: np.ndarray, near: np.ndarray, rate: float) -> None:
    """One Adagrad step on the mean negative log probability."""
    n = len(tokens)
    order = by_value(tokens // MEMBERS)
    tokens, near = tokens[order], near.take(order, axis=1)
    h, c, m = hidden(w, near), tokens // MEMBERS, tokens % MEMBERS
    d = slopes(h @ w["wc"] + w["bc"], c, n)
    g = {"wc": h.T @ d, "bc": d.sum(axis=0)}
    dh = d @ w["wc"].T
    # Tokens stand by class, so each class has its own rows, which nothing pads.
    ends = np.cumsum(np.bincount(c, minlength=CLASSES)).tolist()
    spans = [(k, low, high) for k, (low, high) in enumerate(zip([0, *ends], ends, strict=False)) if low < high]
    d = np.empty((n, MEMBERS), np.float32)
    for k, low, high in spans:
        np.dot(h[low:high], w["wm"][k], out=d[low:high])
    d += w["bm"].take(c, axis=0)
    d = slopes(d, m, n)
    back, g["wm"], g["bm"] = np.empty((n, HIDDEN), np.float32), np.zeros(SHAPES["wm"], np.float32), np.zeros(SHAPES["bm"], np.float32)
    for k, low, high in spans:
        own = d[low:high]
        np.dot(own, w["wm"][k].T, out=back[low:high])
        np.dot(h[low:high].T, own, out=g["wm"][k])
    g["bm"][[k for k, _, _ in spans]] = np.add.reduceat(d, [low for _, low, _ in spans], axis=0)
    dh += back
    dh *= 1 - h * h
    g["b"] = dh.sum(axis=0)
    for name, x in g.items():
        total = x * x
        total += seen[name]
        seen[name][...] = total
        x *= rate
        x /= np.sqrt(total, out=total)
        w[name] -= x
    # The embeddings of all offsets in one table; each row that occurs gets the sum of its places.
    rows = (near + np.arange(len(OFFSETS), dtype=near.dtype)[:, None] * (VOCABULARY + 1)).ravel()
    order = by_value(rows)
    rows = rows.take(order)
    first = starts(rows)
    # Most rows occur once; only the others are sums.
    sizes = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=sizes[:-1])
    sizes[-1] = len(rows) - first[-1]
    places = order % n
    x = dh.take(places.take(first), axis=0)
    if len(many := np.flatnonzero(sizes > 1)):
        of_many = np.flatnonzero(np.repeat(sizes > 1, sizes))
        sums = np.cumsum(sizes.take(many))
        x[many] = np.add.reduceat(dh.take(places.take(of_many), axis=0), sums - sizes.take(many))
    rows = rows[first]
    e, e_seen = (v["e"].reshape(-1, HIDDEN) for v in (w, seen))
    total = e_seen.take(rows, axis=0) + x * x
    e_seen[rows] = total
    x *= rate
    x /= np.sqrt(total, out=total)
    e[rows] -= x


def tokens_of(batch: pa.RecordBatch, ids: Cached) -> list[np.ndarray]:
    """Tokens of each whole text: words apart by ASCII white space, A-Z lowered."""
    out = []
    for text in as_bytes(batch):
        words = text.lower().split() if text else []
        out.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
    return out


def tokenized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and the tokens of each text as 16-bit numbers (none for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Cached(token)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.astype(np.uint16).tobytes() for t in tokens_of(batch, ids)], pa.binary())], ["doc_id", "tokens"])

    docs = docs_of(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens binary")


def texts_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint16).astype(np.int32) for t in as_bytes(batch, "tokens") if t]


def frequencies(tokens: DataFrame) -> np.ndarray:
    """How often each token occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(VOCABULARY, np.int64)
        for batch in slices(batches):
            if texts := texts_of(batch):
                sums += np.bincount(np.concatenate(texts), minlength=VOCABULARY)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["token", "n"])

    counts = np.zeros(VOCABULARY, np.int64)
    for row in tokens.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[row["token"]] = row["n"]
    return counts


def targets(texts: list[np.ndarray], shift: int, stride: int) -> np.ndarray:
    """Places, among the texts' tokens in a row, of every stride-th token of each text: shifts 0 to stride - 1 together are all."""
    sizes = np.array([len(t) for t in texts])
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.flatnonzero(place % stride == shift)


def train_round(docs: DataFrame, weights: np.ndarray, shift: int, stride: int, batch_size: int, rate: float) -> np.ndarray:
    """The tasks' weights after their steps, averaged by how many tokens they have seen; as given if there are none.

    docs: tokens. Weights travel as 16-bit floats; those of the tasks go straight into the first level of the averaging tree."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, total = shared.value.copy(), 0
        w = unpack(flat)
        seen = {name: np.full(shape, 1e-3, np.float32) for name, shape in SHAPES.items()}
        for batch in slices(batches):
            texts = texts_of(batch)
            if not texts:
                continue
            tokens, near = contexts(texts)
            at = np.random.default_rng(shift).permutation(targets(texts, shift, stride))
            for low in range(0, len(at), batch_size):
                own = at[low : low + batch_size]
                step(w, seen, tokens[own], near[:, own], rate * len(own) / batch_size)
            total += len(tokens)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(total)]), pa.array([flat.astype(np.float16).tobytes()], pa.binary())], ["part", "n", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for p, m, w in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("w"), strict=True):
                n, total = sums.get(p, (0.0, 0))
                sums[p] = n + m, total + m * np.frombuffer(w.as_buffer(), np.float16).astype(np.float64)
        for p, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([n]), pa.array([(total / n).astype(np.float16).tobytes()], pa.binary())], ["part", "n", "w"])

    schema = "part long, n double, w binary"
    # Groups are formed by number, so that each level has a FAN_IN-th of the one before however Spark deals the rows.
    level, rows = docs.mapInArrow(run, schema), docs.rdd.getNumPartitions()
    while True:
        rows = max(1, math.ceil(rows / FAN_IN))
        grouped = level.withColumn("part", F.floor(F.col("part") / FAN_IN))
        level = materialize(grouped.repartition(rows, "part").mapInArrow(add, schema), "weights")
        if rows == 1:
            break
    last = level.head(1)
    return np.frombuffer(last[0]["w"], np.float16).astype(np.float32) if last else weights


def train_tokens(tokens: DataFrame, *, rounds: int = 2, stride: int = 2, batch_size: int = 512, rate: float = 0.05) -> np.ndarray:
    """Weights from all documents, tokenized(): gradients from every stride-th token of every document, other ones each round.

    tokens is read once for each round and once before, so it should be written first. So stride rounds take every token as a
    target once; fewer would leave some out and are an error. No rounds give the first weights. The biases start from the
    frequencies of the tokens of all documents."""
    if 0 < rounds < stride:
        raise ValueError("fewer rounds than the stride leave tokens out")
    weights = start()
    if not rounds:
        return weights
    own = tokens.select("tokens")
    set_biases(unpack(weights), frequencies(own))
    for k in range(rounds):
        weights = train_round(own, weights, k % stride, stride, batch_size, rate)
    return weights


def score_tokens(tokens: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood (the sum over all tokens), mean_log_p (null without tokens) of each row of tokenized().

    A null or empty text has no tokens and the sum 0. Repeated rows each get a row; an empty table gives an empty one."""
    shared = tokens.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = unpack(shared.value)
        for batch in slices(batches, 128):
            texts = [np.frombuffer(t or b"", np.uint16).astype(np.int32) for t in as_bytes(batch, "tokens")]
            sizes = np.array([len(t) for t in texts], np.int64)
            sums = np.zeros(len(texts))
            if sizes.any():
                sums = np.bincount(np.repeat(np.arange(len(texts)), sizes), log_p(w, *contexts(texts)), len(texts))
            mean = [s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(sums), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_p"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, n_tokens long, pseudo_log_likelihood double, mean_log_p double")


def train(df: DataFrame, text_col: str = "text", **how) -> np.ndarray:
    """train_tokens() of the texts of df, whose tokens are written once."""
    return train_tokens(materialize(tokenized(df.select(F.col(text_col).alias("text"), F.lit(0).alias("doc_id")), "doc_id", "text"), "tokens"), **how)


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score_tokens() of the texts of df; other columns of df are not read."""
    return score_tokens(tokenized(df, id_col, text_col), weights)
