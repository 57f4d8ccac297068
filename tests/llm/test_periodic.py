import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartlode.llm import periodic, queries


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w, least=24, times=3):
    """Every stretch that lag after lag can't be made longer, kept at its least period."""
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        t = 0
        while t < n - p:
            s = t
            while t < n - p and w[t] == w[t + p]:
                t += 1
            if t - s + p >= max(least, times * p):
                out.setdefault((s, t - s + p), p)
            t += t == s
    return sorted((a, length, p) for (a, length), p in out.items())


def plain_collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(a + q <= i < a + n for a, n, q in runs))


periods = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(periods, max_size=4), st.integers(2, 30), st.integers(2, 4))
def test_runs_equal_plain_ones(texts, least, times):
    texts = [" ".join(str(x) for unit, k in own for x in unit * k) for own in texts]
    for text, (n, runs, collapsed) in zip(texts, periodic.periodic([t.encode() for t in texts], least, times), strict=True):
        w = words_of(text)
        assert n == len(w)
        assert runs == plain_runs(w, least, times)
        assert collapsed.decode() == plain_collapsed(w, runs)


@pytest.mark.parametrize("kinds", [1, 2, 40, 4000])
def test_counts_of_frequent_and_rare_words_are_exact(kinds, monkeypatch):
    monkeypatch.setattr(periodic, "FFT_FLOATS", 5000)
    rng = np.random.default_rng(kinds)
    parts = [rng.integers(0, kinds, n) ** 2 // kinds for n in (0, 1, 3000, 2, 700, 0)]
    starts = np.cumsum([0, *map(len, parts)])
    counts, base = periodic.lag_counts(np.concatenate(parts), starts)
    for i, w in enumerate(parts):
        assert counts[base[i] + 1 : base[i + 1]].tolist() == [int((w[:-p] == w[p:]).sum()) for p in range(1, len(w) // 3 + 1)]


def test_long_texts_take_time_in_proportion():
    rng = random.Random(2)
    for text in ("x " * 400_000, " ".join(rng.choice("ab") for _ in range(150_000)), " ".join([str(rng.random()) for _ in range(40_000)] * 4)):
        ((n, runs, _),) = periodic.periodic([text.encode()])
        assert n == len(text.split())
        assert all(n >= a + m and m >= max(24, 3 * q) for a, m, q in runs)


def test_operator_on_odd_rows(odd, texts, empty):
    rows = periodic.periodic_runs(odd, least=4, times=2).collect()
    got = sorted((str(r.doc_id), r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in rows)
    want = []
    for doc, text, *_ in texts:
        w = words_of(text)
        runs = plain_runs(w, 4, 2) if len(w) < 1000 else list(periodic.periodic([text.encode()], 4, 2))[0][1]
        want.append((str(doc), len(w), runs, plain_collapsed(w, runs)))
    assert got == sorted(want)
    assert periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(odd, times=1)


def test_query_equals_a_plain_version(spark, tmp_path, texts):
    from fractions import Fraction

    rng = random.Random(5)
    rows = [r for r in texts if not r[1] or len(r[1]) < 20_000] + [(1000 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 300))), None, None, 0) for k in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect())))
    want, planted = [], 0
    for doc, text, *_ in rows:
        w = words_of(text)
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if doc is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], planted + 1
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(plain_collapsed(w, runs))))
    assert planted > 5
    assert got == sorted(map(repr, want))
