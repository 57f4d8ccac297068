import re
import string

import numpy as np
import pytest

import corpus_pipeline
from chartlode.llm import minhash
from chartlode.llm.common import WordHashes


def brute(rows, n=5, percent=85):
    """Sets, and the least id reachable, by comparing every pair."""
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    nodes = []
    for doc, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(lower)) if w]
        nodes.append((doc, {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()))
    parent = {d: d for d, _ in nodes if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in nodes), key=str)


def test_groups_equal_those_of_all_pairs(odd, texts):
    got = minhash.near_duplicates(odd).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute([(d, t) for d, t, *_ in texts])
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("members", [3, 400])
def test_a_large_group_of_near_copies_is_one_component(spark, members):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(members):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            own[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    if members < 100:
        assert got == set(brute(rows))
    else:  # all pairs by their hashed sets
        hashes = WordHashes()
        sets = [minhash.shingles(t.encode(), hashes) for _, t in rows]
        parent = list(range(members))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(members):
            for b in range(a):
                k = len(np.intersect1d(sets[a], sets[b]))
                if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
        assert got == {(k, len(sets[k]), find(k)) for k in range(members)}


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[500:])
    same = (minhash.signature(a, 1024) == minhash.signature(b, 1024)).mean()
    assert abs(same - 500 / 1500) < 0.06


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 60)]
    got = {r.doc_id: r.component for r in minhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 if k < 100 else 100 for k in [*range(31), *range(100, 160)]}


def test_an_empty_table_has_no_groups(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_the_pipeline_drops_copies_from_a_similarity_of_80_percent(spark):
    # The last 10 of 104 words differ: 90 of 110 shingles are common. With 12 it is 88 of 112, too few.
    rows = []
    for k in range(10):
        words = [f"w{k}x{i}" for i in range(104)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words[:94], *[f"v{k}x{i}" for i in range(10)]])), (3 * k + 2, " ".join([*words[:92], *[f"u{k}x{i}" for i in range(12)]]))]
    docs = spark.createDataFrame([(d, t, "aa", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()}
    assert left == {3 * k + j for k in range(10) for j in (0, 2)}
