import hashlib
import random
import re
import string

import pytest

from chartlode.llm import decontam

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            own = words(t)
            n = min(window, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == own[i : i + n]:
                        hit.update(range(j, j + n))
                        if item is not None:
                            found.add(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bounds", [{}, {"block_bytes": 40, "hold_bytes": 5000}, {"block_windows": 9, "pass_blocks": 3, "hold_bytes": 0}])
def test_hits_equal_those_of_direct_search(spark, odd, texts, bounds):
    rng = random.Random(8)
    docs = [(d, t) for d, t, *_ in texts if d != 207]
    items = [(1, "the same row"), (1, "another under one id"), (2, None), (3, " .,! "), (4, "ONE"), (12, "No, id!"), (13, "no id")]
    for k in range(12):
        w = (rng.choice([t for _, t in docs if t]) or "").split()
        at = rng.randrange(len(w))
        items.append((20 + k, " - ".join(w[at : at + rng.randint(3, 25)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(odd.where("doc_id is null or doc_id <> 207"), bench, window=6, **bounds).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute(docs, items, 6)
    assert all(sum(e - s for s, e in r.spans) == r.n_hit for r in got)


def test_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(empty, none).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(odd, none).collect())


def test_shifts_never_skip_an_occurrence():
    rng = random.Random(2)
    import numpy as np

    for _ in range(200):
        m = rng.randint(1, 5)
        patterns = {tuple(rng.randint(1, 4) for _ in range(m)): [k] for k in range(4)}
        text = np.array([rng.randint(0, 4) for _ in range(60)])
        got = sorted((s, i) for s, i in decontam.WuManber(patterns, bits=8).find(text))
        assert got == sorted((j, v) for j in range(61 - m) for p, v in patterns.items() if tuple(text[j : j + m]) == p)
