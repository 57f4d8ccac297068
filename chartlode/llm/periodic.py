"""Periodic runs of words: stretches that repeat themselves at least three times.

A lag is a distance between equal words. For each lag up to a third of a text the number of equal words at that distance is counted
exactly: by the autocorrelation of a word's places for frequent words (FFT), by differences of its places for the others. Only lags
with enough equal words for a run are scanned for islands of them. All of a batch's texts are counted together, so a short text
costs no Python loop of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chartlode.llm.common import as_bytes, docs_of, judged, verdicts

#: Bytes of text that are looked at together, and floats of a block of Fourier transforms.
BATCH_BYTES, FFT_FLOATS = 1 << 20, 1 << 21

Run = tuple[int, int, int]


def least_matches(lags: np.ndarray, least: int, times: int) -> np.ndarray:
    """Equal words at these lags that a run with such a period has at least."""
    return np.maximum(least - lags, (times - 1) * lags)


def lag_counts(words: np.ndarray, starts: np.ndarray, times: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end (starts: where each begins, and the end), the pairs of equal words at each lag up to n // times, exact.

    Gives counts and where each text's own begin in it (at lag 0). words: a number for each word, any text's own or shared."""
    sizes = np.diff(starts)
    limits = sizes // times
    base = np.concatenate([[0], np.cumsum(limits + 1)])
    counts = np.zeros(base[-1], np.int64)
    if not len(words):
        return counts, base
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((words, text))  # stable: places ascend within a word of a text
    place = order - starts[text[order]]
    fresh = np.flatnonzero((np.diff(words[order], prepend=-1) != 0) | (np.diff(text[order], prepend=-1) != 0))
    ends = np.append(fresh[1:], len(order))
    owner, size = text[order[fresh]], ends - fresh
    heavy = size > np.maximum(32, 2 * np.sqrt(sizes[owner]))

    # Rare words: the k-th next place of the same word, for growing k, as long as it is near enough.
    at = np.flatnonzero(np.repeat(~heavy & (size > 1), size))
    end, of = np.repeat(ends, size)[at], np.repeat(owner, size)[at]
    waiting, held, k = [], 0, 1
    while len(at):
        on = at + k < end
        at, end, of = at[on], end[on], of[on]
        lag = place[at + k] - place[at]
        near = lag <= limits[of]
        at, end, of = at[near], end[near], of[near]
        waiting.append(base[of] + lag[near])
        held += len(at)
        if held > len(counts) or not len(at):
            np.add.at(counts, np.concatenate(waiting), 1)
            waiting, held = [], 0
        k += 1

    # Frequent words: their places' power spectra add up to that of all lags.
    of_text = defaultdict(list)
    for j in np.flatnonzero(heavy):
        of_text[int(owner[j])].append(j)
    for i, own in of_text.items():
        n = int(sizes[i] + limits[i])
        n += n % 2
        spectrum, rows = np.zeros(n // 2 + 1), max(1, FFT_FLOATS // n)
        for low in range(0, len(own), rows):
            block = own[low : low + rows]
            places = np.zeros((len(block), n))
            for r, j in enumerate(block):
                places[r, place[fresh[j] : ends[j]]] = 1
            f = np.fft.rfft(places, axis=1)
            spectrum += (f.real**2 + f.imag**2).sum(axis=0)
        counts[base[i] : base[i + 1]] += np.rint(np.fft.irfft(spectrum, n)[: limits[i] + 1]).astype(np.int64)
    return counts, base


def islands(words: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """First and one past the last place of each stretch of at least so many words equal to the one lag before them.

    A long island covers a whole block of lag words at a multiple of lag, so blocks are looked into first, word by word at once."""
    n = len(words)
    if lag >= 32 and least >= 2 * lag:
        blocks = np.arange(0, n - 2 * lag + 1, lag)
        for j in range(lag if lag < 64 else 64):
            blocks = blocks[words[blocks + j] == words[blocks + j + lag]]
            if not len(blocks):
                return
    edges = np.flatnonzero(np.diff(np.concatenate([[False], words[:-lag] == words[lag:], [False]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= least:
            yield a, b


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = 24, times: int = 3) -> list[Run]:
    """(start, length, period) of every run, by start, then period. counts: lag_counts() of this text.

    A run is taken at its least period. At a multiple of it the same stretch is one island again; the run's equal words are taken off
    such lags' counts, so a lag is only scanned if what is left is enough for another."""
    left, found = counts.copy(), {}
    lags = np.arange(1, len(left))
    enough = least_matches(lags, least, times)
    for lag in lags[left[1:] >= enough].tolist():
        if left[lag] < enough[lag - 1]:
            continue
        for a, b in islands(words, lag, int(enough[lag - 1])):
            length = b - a + lag
            if found.setdefault((a, length), lag) == lag:
                more = np.arange(2 * lag, min(length, len(left)), lag)
                left[more] -= length - more
    return sorted((a, n, q) for (a, n), q in found.items())


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words are in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for a, length, q in runs:
        change[a + q] += 1
        change[a + length] -= 1
    return np.cumsum(change)[:n] == 0


def periodic(texts: list[bytes | None], least: int = 24, times: int = 3) -> Iterator[tuple[int, list[Run], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    split = [(t or b"").split() for t in texts]  # bytes are split at space and \x09-\x0D
    starts = np.cumsum([0, *map(len, split)])
    words = np.fromiter((number[w] for own in split for w in own), np.int64, starts[-1])
    counts, base = lag_counts(words, starts, times)
    enough = np.concatenate([least_matches(np.arange(x), least, times) for x in np.diff(base)] or [np.zeros(0)])
    enough[base[:-1]] = len(words) + least + 1  # lag 0
    promising = np.zeros(len(texts), bool)
    promising[np.searchsorted(base, np.flatnonzero(counts >= enough), "right") - 1] = True
    for i, own in enumerate(split):
        runs = runs_of(words[starts[i] : starts[i + 1]], counts[base[i] : base[i + 1]], least, times) if promising[i] else []
        kept = [own[j] for j in np.flatnonzero(kept_words(len(own), runs))] if runs else own
        yield len(own), runs, b" ".join(kept)


def periodic_runs(docs: DataFrame, *, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of each row; with carry also the row.

    Words are what stands between ASCII white space. A run is a stretch of at least max(least, times * period) words in which each
    equals the one a period before, with no smaller period, that can't be made longer on either side. The collapsed text has the
    words, joined by one space, that no run contains after its first period. A null, empty or blank text has no words and no runs.
    Repeated rows and null ids are kept as they are; other columns don't matter. least and times are 2 at least."""
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pa.compute.binary_length(whole.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // BATCH_BYTES
            for low, high in zip(starts := np.flatnonzero(np.diff(group, prepend=-1)), [*starts[1:], len(group)], strict=True):
                batch = whole.slice(low, high - low)
                n, runs, collapsed = zip(*periodic(as_bytes(batch), least, times), strict=True)
                runs = [[{"start": a, "length": m, "period": q} for a, m, q in own] for own in runs]
                yield verdicts(batch, {"n_words": pa.array(n, pa.int64()), "runs": pa.array(runs, kind), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())})

    return judged(docs_of(docs, id_col, text_col, carry=carry), run, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
