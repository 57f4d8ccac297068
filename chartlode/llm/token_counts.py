"""Token counts of whole texts: batches of encodings whose lengths alone leave the task.

A text is cut before a space that ends a word. No tokenizer for which safe_cut() allows that joins anything across such a place, so the
parts' counts add up to the text's. Parts repeat (they are mostly single words), so each batch asks the tokenizer for those that
it hasn't counted lately.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.llm.common import docs_of, judged, verdicts

#: A space before a word and after a character that every version of Unicode counts as printable and that no normal form joins with a space: ASCII,
#: and letters of Latin, Greek, Cyrillic, Chinese, Japanese and Korean writing.
CUT = re.compile("(?<=[!-~À-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-яぁ-ゖァ-ヺ一-龥가-힣]) (?=\\S)")
#: Characters of a text that are cut up at once, bytes that are encoded at once, and how much is remembered (each part counts as 64 and its length).
STRETCH, BATCH_BYTES, REMEMBERED = 1 << 17, 1 << 18, 48 << 20

Counter = Callable[[list[str]], list[int]]


def safe_cut(vocabulary: str) -> bool:
    """Whether texts may be cut at CUT for this JSON file of tokenizers: words are split by the byte-level pattern, in which a space only ever begins a token, nothing is normalized, and no added token holds or swallows a space."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in spec.get("added_tokens", []))
    return plain and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


@lru_cache(maxsize=4)
def counter(vocabulary: str) -> tuple[Counter, Counter, bool]:
    """Two functions from texts to their numbers of tokens, one for texts and one for what follows the space of a cut; and whether texts may be cut.

    vocabulary: .json is read by tokenizers, .model by sentencepiece. Neither truncates, pads or adds tokens."""
    if vocabulary.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        count = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
        # Every text gets a space in front, as what follows a cut must; spaces are kept, and no piece goes on after one.
        kept = pieces.encode(" a  b", out_type=str) and "".join(pieces.encode(" a  b", out_type=str)) == "▁▁a▁▁b"
        names = (pieces.id_to_piece(i).lstrip("▁") for i in range(pieces.get_piece_size()))
        return count, count, bool(kept) and not any("▁" in name for name in names)
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    words = Tokenizer.from_file(vocabulary)
    words.no_truncation()
    words.no_padding()
    count = lambda texts: [len(e) for e in words.encode_batch_fast(texts, add_special_tokens=False)]
    return count, lambda texts: count([" " + t for t in texts]), safe_cut(vocabulary)


def stretches(text: str, cut: bool) -> Iterator[list[str]]:
    """The parts of a text, about STRETCH characters of them at a time. The first part of all begins the text; each other one follows a space."""
    at = 0
    while cut and len(text) - at > STRETCH and (m := CUT.search(text, at + STRETCH)):
        yield CUT.split(text[at : m.start()])
        at = m.end()
    yield CUT.split(text[at:]) if cut else [text[at:]]


class Lengths:
    """The number of tokens of each part, remembered."""

    def __init__(self, count: Counter):
        self.count, self.known, self.size = count, {}, 0

    def of(self, parts: set[str]) -> dict[str, int]:
        """A dictionary that has the counts of these parts at least. New ones are encoded by batches of about BATCH_BYTES."""
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        batch, size = [], 0
        for part in parts.difference(self.known):
            batch.append(part)
            size += len(part.encode())
            self.size += 64 + len(part)
            if size >= BATCH_BYTES:
                self.known.update(zip(batch, self.count(batch), strict=True))
                batch, size = [], 0
        if batch:
            self.known.update(zip(batch, self.count(batch), strict=True))
        return self.known


def counted(texts: list[str], first: Lengths, rest: Lengths, cut: bool) -> np.ndarray:
    """The number of tokens of each text."""
    out, waiting, size = np.zeros(len(texts), np.int64), [], 0

    def settle() -> None:
        one = first.of({parts[0] for _, new, parts in waiting if new})
        more = rest.of({p for _, new, parts in waiting for p in parts[new:]})
        for i, new, parts in waiting:
            out[i] += (one[parts[0]] if new else 0) + sum(map(more.__getitem__, parts[new:]))
        waiting.clear()

    for i, text in enumerate(texts):
        for k, parts in enumerate(stretches(text, cut)):
            waiting.append((i, k == 0, parts))
            size += sum(map(len, parts))
            if size >= 8 * STRETCH:
                settle()
                size = 0
    settle()
    return out


def token_counts(docs: DataFrame, vocabulary: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs; with carry also the row.

    The count is the library's own for the whole text, with special tokens' strings in texts taken as it does by default. A null
    or empty text has no bytes and no tokens. Repeated rows and null ids are kept as they are; other columns don't matter. A text
    without a place to cut is encoded whole, however long it is. vocabulary must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text, of_rest, cut = counter(vocabulary)
        first, rest = Lengths(of_text), Lengths(of_rest)
        for whole in batches:
            sizes = pa.compute.binary_length(whole.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // (8 * STRETCH)  # rows of about as many bytes
            for low, high in zip(starts := np.flatnonzero(np.diff(group, prepend=-1)), [*starts[1:], len(group)], strict=True):
                batch = whole.slice(low, high - low)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                yield verdicts(batch, {"n_bytes": pa.array(sizes[low:high]), "n_tokens": pa.array(counted(texts, first, rest, cut))})

    found = judged(docs_of(docs, id_col, text_col, carry=carry), run, "n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
