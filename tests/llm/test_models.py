"""The trained operators: edge cases, held-out accuracy, and brute-force versions of what they compute."""

import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlode.llm import html_extract, langid, lm, quality_classifier, quality_rules, toxicity
from chartlode.llm.common import Cached, Numbered, WordHashes

LANGS = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwé"}


def made(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of three languages; bad words make one toxic, signs make it poor."""
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        lang = rng.choice(sorted(LANGS))
        text = made(rng, LANGS[lang], rng.randint(60, 120)).split()
        toxic, poor = rng.random() < 0.25, rng.random() < 0.3
        for _ in range(toxic * 2):
            text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "idiots", "trashy"]))
        if poor:
            text = [w + "***" for w in text]
        rows.append((k, " ".join(text), lang))
        labels.append((k, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_language_profiles_on_held_out_rows(labelled, odd, empty, texts):
    docs, _, rows, _ = labelled
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {k for k, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[k].lang_pred == rows[k][2] for k in held]) > 0.99
    out = langid.predict(odd, model).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (200, 201, 202, 205)} == {"und"}
    assert langid.predict(empty, model).count() == 0
    assert langid.train(empty)[0] == [] and {r.lang_pred for r in langid.predict(odd, langid.train(empty)).collect()} == {"und"}


def test_documents_are_sums_of_bound_letters():
    p = langid.Profiles(dim=256, n=3)
    got, has = p.documents(["ab é1", "...", None])
    total = np.zeros(256)
    s = [0, 1, 2, 0, langid.symbol_table()[ord("é")], 0]
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        total += p.rotated[0][a].astype(float) * p.rotated[1][b] * p.rotated[2][c]
    assert list(has) == [True, False, False]
    assert np.allclose(got[0], total / np.linalg.norm(total), atol=1e-5) and not got[1:].any()


def test_toxicity_on_held_out_rows(labelled, odd, empty, texts):
    docs, labels, _, truth = labelled
    net = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    toxic = {k: t for k, _, t in truth}
    held = [k for k in toxic if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r.held_out} == set(held)
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    assert np.mean([got[k].predicted == toxic[k] for k in held]) > 0.97
    out = toxicity.score(odd, net).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty, net).count() == 0
    none = labels.where("false")
    assert len({r.score for r in toxicity.score(odd, toxicity.train(odd, none)).where("doc_id in (200, 201)").collect()}) == 1


def test_pooling_takes_the_largest_window():
    net = toxicity.Network(3)
    x = np.random.default_rng(0).normal(size=(9, toxicity.DIM)).astype(np.float32)
    top, at = net.pooled(x)
    padded = np.vstack([x, np.zeros((2, toxicity.DIM))])
    for k, f in enumerate(net.filters):
        for c in range(toxicity.FILTERS):
            z = [sum(padded[i + j] @ f[j, :, c] for j in range(len(f))) for i in range(9)]
            assert top[k * toxicity.FILTERS + c] == pytest.approx(max(0, max(z)), abs=1e-4)
            assert at[k * toxicity.FILTERS + c] == int(np.argmax(z))


def test_quality_grades_on_held_out_rows(labelled, odd, empty, texts):
    docs, labels, _, truth = labelled
    ratings = labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    model = quality_classifier.train(docs, ratings)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = {r.doc_id: r for r in quality_classifier.grade(docs, model).collect()}
    held = [(k, q) for k, q, _ in truth if got[k].held_out]
    assert np.mean([got[k].kept == bool(q) for k, q in held]) > 0.97
    assert all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    assert len(quality_classifier.grade(odd, model).collect()) == len(texts)
    assert quality_classifier.grade(empty, model).count() == 0
    assert {r.kept for r in quality_classifier.grade(odd, quality_classifier.train(empty, ratings)).collect()} == {True}


def test_quality_training_keeps_its_bounds(labelled, spark):
    """The fit is that of the chosen rows, by loops; bounds cut whole rows."""
    docs, labels, rows, truth = labelled
    ratings = labels.select("doc_id", F.col("quality").alias("grade"))
    free = [(k, q) for k, q, _ in truth if zlib.crc32(str(k).encode()) % 4 != 2]
    ids = [r.doc_id for r in spark.createDataFrame([(k,) for k, _ in free], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()]
    grades, buckets = dict(free), Cached(quality_classifier.bucket)

    def plain(chosen):
        m = quality_classifier.CumulativeLink(max(grades[k] for k in chosen) + 1)
        m.fit([quality_classifier.features(rows[k][1].encode(), buckets) for k in chosen], np.array([grades[k] for k in chosen]))
        return m

    got, want = quality_classifier.train(docs, ratings, max_rows=40), plain(sorted(ids))
    assert np.allclose(got.weights, want.weights) and np.allclose(got.thresholds, want.thresholds)
    by_row = {r.doc_id: r for r in quality_classifier.grade(docs, got).collect()}
    for k in (0, 1, 2, 3):
        index, values = quality_classifier.features(rows[k][1].encode(), buckets)
        f = sum(want.weights[i] * v for i, v in zip(index, values, strict=True))
        p = [1 / (1 + math.exp(f - t)) for t in want.thresholds]
        assert by_row[k].expected_grade == pytest.approx(sum(1 - x for x in p)) and by_row[k].p_tail == pytest.approx(1 - p[0])
    sizes = np.cumsum([len(quality_classifier.features(rows[k][1].encode(), buckets)[0]) for k in sorted(ids)])
    few = quality_classifier.train(docs, ratings, max_rows=40, max_words=int(sizes[20]))
    assert np.allclose(few.weights, plain(sorted(ids)[:21]).weights)
    short = [k for k in sorted(ids) if len(rows[k][1]) <= 150]
    assert np.allclose(quality_classifier.train(docs, ratings, max_rows=40, max_chars=150).weights, plain(short).weights if short else 0)


def test_languages_by_a_plain_version_and_within_bounds(labelled, spark):
    docs, _, rows, _ = labelled
    profiles, sums = langid.Profiles(), {}
    for k, text, lang in rows:
        if lang is not None and zlib.crc32(str(k).encode()) % 5 != 0:
            sums[lang] = sums.get(lang, 0) + profiles.documents([text])[0][0].astype(np.float64)
    names = sorted(sums)
    model = langid.train(docs, per_language=10**6)
    assert model[0] == names
    for r in langid.predict(docs, model).collect():
        v = profiles.documents([rows[r.doc_id][1]])[0][0]
        cosines = [float(v @ sums[x] / np.linalg.norm(sums[x])) for x in names]
        assert r.score == pytest.approx((1 + max(cosines)) / 2, abs=1e-5) and cosines[names.index(r.lang_pred)] == pytest.approx(max(cosines), abs=1e-5)
    again = langid.train(docs.repartition(7), per_language=10**6)
    assert again[0] == names and np.allclose(again[1], model[1], atol=1e-6)
    dirty = docs.union(spark.createDataFrame([(10_000 + k, "abc def", f"x{k}") for k in range(50)], "doc_id long, text string, lang string"))
    assert langid.train(dirty, most_languages=len(names))[0] == names
    thin = langid.train(docs, per_language=3)
    assert set(thin[0]) <= set(names) and not np.allclose(thin[1][0], model[1][names.index(thin[0][0])])
    tied = docs.sparkSession.createDataFrame([(k, "same words", x) for k, x in ((1, "b"), (2, "a"), (3, "b"), (4, "a"))], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(tied, langid.train(tied)).collect()} == {"a"}


def test_cumulative_links_gradient():
    """The step's gradient is that of the negative log likelihood."""
    m = quality_classifier.CumulativeLink(3)
    m.thresholds = np.array([-0.4, 0.9])
    f, y = np.array([0.3]), 1

    def loss(x):
        c = m.at_most(np.array([x]))[0]
        return -math.log(c[y + 1] - c[y])

    c = m.at_most(f)[0]
    slope = c * (1 - c)
    assert (slope[y + 1] - slope[y]) / (c[y + 1] - c[y]) == pytest.approx((loss(0.3 + 1e-6) - loss(0.3 - 1e-6)) / 2e-6, abs=1e-4)


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            again += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit)


def test_plain_counts_and_bands(spark, odd, empty, texts):
    more = [(400, "a b c a b c\na b\n \n \na b\n", "en"), (401, "é £ #*$%&|<> x x x x x", None), (402, "line\rline\x0bx\nline\rline\x0bx", "english")]
    df = odd.select("doc_id", "text", "lang", "kept", "score").where("doc_id is null or doc_id not in (206, 207)").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = quality_rules.quality_rules(df, min_words=20).collect()
    want = sorted([(d, *brute_measures(t)) for d, t, *_ in texts if d not in (206, 207)] + [(d, *brute_measures(t)) for d, t, _ in more], key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.log_ppl is not None and r.low <= r.log_ppl <= r.high)
    assert quality_rules.quality_rules(empty).count() == 0


def test_bands_reject_what_is_unlike_the_language(spark):
    rng = random.Random(4)
    known = {lang: made(rng, LANGS[lang], 60).split() for lang in LANGS}
    rows = [(k, " ".join(rng.choice(known["aa"]) for _ in range(80)), "aa") for k in range(60)] + [(k, " ".join(rng.choice(known["bb"]) for _ in range(80)), "bb") for k in range(100, 160)]
    rows += [(900, made(rng, "stuvwxyz0123456789%&@!?éß", 80), "aa"), (901, " ".join(["ab"] * 3 + [f"ab{'a' * (k % 3)}" for k in range(80)]), "aa")]
    rows += [(500 + k, rows[0][1], "aa") for k in range(200)]  # copies don't narrow the band
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[900].kept and got[900].log_ppl > got[900].high
    assert all(got[k].kept for k in [*range(60), *range(100, 160), 500])


def plain_kneser_ney(counts, symbols, sequence):
    """P(last of sequence | the rest) by the textbook's formula, over a dict of counts of tuples."""

    def discount(level, c):
        n = [sum(v == k for v in level.values()) for k in range(5)]
        if 0 in n[1:]:
            return (0, 0.5, 0.75, 0.9)[min(c, 3)]
        y, k = n[1] / (n[1] + 2 * n[2]), min(c, 3)
        return min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if k else 0

    if not sequence:
        return 1 / symbols
    shorter = Counter(g[1:] for g in counts)
    rest = {g: c for g, c in counts.items() if g[:-1] == sequence[:-1]}
    below = plain_kneser_ney(shorter, symbols, sequence[1:]) if len(sequence) > 1 else 1 / symbols
    if not rest:
        return below
    total, c = sum(rest.values()), counts.get(sequence, 0)
    return max(c - discount(counts, c), 0) / total + sum(discount(counts, k) for k in rest.values()) / total * below


@pytest.mark.parametrize(("symbols", "order", "n"), [(5, 3, 400), (7, 2, 90), (4, 1, 30), (6, 2, 3)])
def test_kneser_ney_equals_the_formula_and_sums_to_one(symbols, order, n):
    rng = random.Random(symbols)
    text = [min(int(rng.expovariate(0.7)), symbols - 2) for _ in range(n)]
    counts = Counter(tuple(text[i : i + order]) for i in range(len(text) - order + 1))
    code = lambda g: sum(x * symbols ** (len(g) - 1 - k) for k, x in enumerate(g))
    table = sorted((code(g), c) for g, c in counts.items())
    model = quality_rules.KneserNey(np.array([k for k, _ in table]), np.array([c for _, c in table]), symbols, order)
    import itertools

    for context in itertools.product(range(symbols), repeat=order - 1):
        p = np.exp(model.log_p(np.array([code((*context, x)) for x in range(symbols)])))
        assert p.sum() == pytest.approx(1, abs=1e-5)
        for x in range(symbols):
            assert p[x] == pytest.approx(plain_kneser_ney(counts, symbols, (*context, x)), abs=1e-5)


def test_perplexity_is_that_of_a_plain_count_and_sees_word_order(spark):
    rng = random.Random(8)
    nouns, verbs = made(rng, "abcdef", 12).split(), made(rng, "uvwxyz", 12).split()
    rows = [(k, " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(50)), "aa") for k in range(60)]
    words = rows[0][1].split()
    rows.append((99, " ".join(sorted(words)), "aa"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert not got[99].kept and got[99].log_ppl > got[99].high and all(got[k].kept for k in range(60))

    # The whole again from dicts and sets: a pair counts once for each class before it, without what the document alone has given.
    counts = quality_rules.count_grams(docs)
    split = [quality_rules.buckets_of(WordHashes().of([w.encode() for w in t.split()]), "aa").tolist() for _, t, _ in rows]
    seen = [{((a, b), z % 64) for z, a, b in zip([0, 0, *t], [0, *t], t, strict=False)} for t in split]
    codes, _ = quality_rules.grams_of([w.encode() for _, t, _ in rows for w in t.split()])
    assert counts[0].tolist() == np.bincount(codes, minlength=quality_rules.SPELLED).tolist()
    pairs = Counter(g for g, _ in set().union(*seen))
    rest = Counter(g for g, _ in set().union(*seen[1:]))
    assert {divmod(int(c), quality_rules.BUCKETS): int(counts[1][c]).bit_count() for c in np.flatnonzero(counts[1])} == pairs
    n = [sum(v == k for v in pairs.values()) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if all(n[1:]) else 0
    cut = [0, *[min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]] if y else [0, 0.5, 0.75, 0.9]
    shorter, single, total = Counter(g[1:] for g in pairs), Counter(), 0.0
    for (_, b), c in pairs.items():
        single[b] += c
    for a, b in zip([0, *split[0]], split[0], strict=False):
        known = {g: c for g, c in rest.items() if g[0] == a}
        p = plain_kneser_ney(shorter, quality_rules.BUCKETS, (b,))
        if known:
            c = rest[a, b]
            p = (c - cut[min(c, 3)] + sum(cut[min(v, 3)] for v in known.values()) * p) / sum(known.values())
        total += math.log(p) - math.log((single[b] + 0.5) / (sum(single.values()) + 0.5 * quality_rules.BUCKETS))
    model = quality_rules.Model(*counts)
    total += sum(model.words([w.encode()])[0] for w in words)
    assert got[0].log_ppl == pytest.approx(-total / (sum(map(len, words)) + len(words)), abs=1e-4)


def test_pseudo_likelihood_prefers_word_order_of_the_corpus(spark, odd, empty, texts):
    rng = random.Random(9)
    rows = [(k, " ".join(f"{a} {b}x {b}y {a}" for a, b in ((rng.choice("pqrs"), rng.choice("klmn")) for _ in range(60)))) for k in range(60)]
    shuffled = []
    for k, t in rows[:20]:
        w = t.split()
        rng.shuffle(w)
        shuffled.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    weights = lm.train(df, rounds=6, stride=2, batch_size=64, rate=0.1)
    both = {r.doc_id: r for r in lm.score(df.union(spark.createDataFrame(shuffled, df.schema)), weights).collect()}
    assert all(both[k].mean_log_p > both[1000 + k].mean_log_p for k in range(20))
    assert np.mean([both[k].mean_log_p for k in range(20)]) > np.mean([r.mean_log_p for r in lm.score(df, lm.train(df, rounds=0)).collect()])
    out = lm.score(odd, weights).collect()
    assert len(out) == len(texts)
    assert {(r.n_tokens, r.pseudo_log_likelihood, r.mean_log_p) for r in out if r.doc_id in (200, 201, 202)} == {(0, 0.0, None)}
    assert lm.score(empty, lm.train(empty)).count() == 0


def test_training_takes_every_token_as_a_target_and_counts_all_documents(spark):
    sizes = [5, 1, 2, 7]
    texts = [np.zeros(n, np.int32) for n in sizes]
    taken = np.concatenate([lm.targets(texts, shift, 2) for shift in range(2)])
    assert sorted(taken) == list(range(sum(sizes)))
    # The word of the last documents only comes after the first slice of 256.
    rows = [(k, "aa bb" if k < 300 else "cc") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = lm.frequencies(lm.tokenized(df))
    assert {lm.token(w): counts[lm.token(w)] for w in (b"aa", b"bb", b"cc")} == {lm.token(b"aa"): 300, lm.token(b"bb"): 300, lm.token(b"cc"): 100}
    with pytest.raises(ValueError):
        lm.train(df, rounds=2, stride=16)


def test_registered_training_predicts_each_place_of_a_text(spark):
    # Words 16 apart: a stride of 16 with shifts 0 and 8 never saw the other places as targets.
    rng = random.Random(3)
    pairs = [(f"l{k}", f"m{k}", f"r{k}") for k in range(40)]
    rows = [(k, " ".join((["pad"] * 3 + [x for _ in range(40) for x in (*rng.choice(pairs), *["pad"] * 13)])[:640])) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    scored = {r.doc_id: r.mean_log_p for r in lm.score(df, lm.train(df)).collect()}
    # Better than frequencies alone, the bound of a model that learns nothing from neighbours.
    n = np.array(list(Counter(w for _, t in rows for w in t.split()).values()))
    assert np.mean(list(scored.values())) > (n / n.sum() * np.log(n / n.sum())).sum()


def test_scores_equal_a_plain_version_of_the_network(spark):
    import math

    text = "a b c a d b a"
    df = spark.createDataFrame([(1, text), (2, "a"), (2, None), (3, "")], "doc_id int, text string")
    rng = np.random.default_rng(5)
    flat = rng.normal(0, 0.5, lm.SIZE).astype(np.float32)
    w = lm.unpack(flat)
    got = sorted(((r.doc_id, r.n_tokens, r.pseudo_log_likelihood) for r in lm.score(df, flat).collect()))

    def plain(words):
        ids, total = [lm.token(x.encode()) for x in words], 0.0
        for k, t in enumerate(ids):
            near = [ids[k + o] if 0 <= k + o < len(ids) else lm.EDGE for o in lm.OFFSETS]
            h = [math.tanh(float(w["b"][j]) + sum(float(w["e"][i][v][j]) for i, v in enumerate(near))) for j in range(lm.HIDDEN)]
            c, m = divmod(t, lm.MEMBERS)
            for x, bias, at in ((w["wc"], w["bc"], c), (w["wm"][c], w["bm"][c], m)):
                z = [sum(h[j] * float(x[j][q]) for j in range(lm.HIDDEN)) + float(bias[q]) for q in range(len(bias))]
                total += z[at] - math.log(sum(map(math.exp, z)))
        return total

    assert [x[:2] for x in got] == [(1, 7), (2, 0), (2, 1), (3, 0)]
    assert [x[2] for x in got] == pytest.approx([plain(text.split()), 0, plain(["a"]), 0], abs=1e-3)


def test_token_probabilities_are_a_distribution_and_steps_go_downhill():
    rng = np.random.default_rng(0)
    w = lm.unpack(lm.start())
    lm.set_biases(w, rng.integers(0, 50, lm.VOCABULARY))
    near = np.tile(rng.integers(0, lm.VOCABULARY + 1, (4, 1)), lm.VOCABULARY)
    assert np.exp(lm.log_p(w, np.arange(lm.VOCABULARY), near).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    tokens, near = rng.integers(0, lm.VOCABULARY, 200), rng.integers(0, lm.VOCABULARY, (4, 200))
    before = lm.log_p(w, tokens, near).mean()
    seen = {k: np.full(s, 1e-3, np.float32) for k, s in lm.SHAPES.items()}
    for _ in range(5):
        lm.step(w, seen, tokens, near, 0.05)
    assert lm.log_p(w, tokens, near).mean() > before


FIELD = lru_cache(html_extract.train)

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body class="a>b">
<header><p>Site</p></header><nav><ul><li><a href="/x">Home</a><li><a href="/y">More news here</a></ul></nav><div class="cookie notice">We use cookies.</div>
<article><h1>The  head&nbsp;line</h1><p>First <b>bold</b> par&eacute;graph with 1 &lt; 2<br>and more text in it.<p>Second one, unclosed.
<aside class="sidebar"><p>Related: things to read</p></aside><ul><li>An item of the list.<li>Another item there.</ul><p>Last.</p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Bob</p><p>I liked this article very much indeed.</p></div></section>
<form class="newsletter"><label>Subscribe</label><button>Sign up</button></form><footer>&copy; 2020 Site. All rights reserved</footer></body>"""


def test_extraction_of_a_page_and_odd_ones(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "<article><p>unclosed & <b>bare"), (None, "u", "<div class=ad>x</div>"), (7, "u", "<" * 1000 + "a'" * 500), (8, "u", "<article>" + "<p>word word word.</p>" * 3000 + "</article>"), (1, "u", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("text", "n_chars")})
    got = html_extract.extract(df).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "The head line\n\nFirst bold parégraph with 1 < 2 and more text in it.\n\nSecond one, unclosed.\n\nAn item of the list.\n\nAnother item there.\n\nLast."
    assert text[2] == text[3] == text[4] == text[None] == "" and text[5] == "unclosed & bare"
    assert text[8].count("word word word.") == 3000
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.where("false")).count() == 0


#: Pages by hand, with class names, nesting and parts that no training page has: the html and the main text.
BY_HAND = [
    (
        """<body><div id=wrap><div class="topline menu-list"><ul><li><a href=/a>Start</a><li><a href=/b>Contact us</a></ul></div><main class="page-main"><h1>Rivers of the north</h1>
<p>The river rises in the hills and runs to the sea in two days.</p><table class=facts><tbody><tr><th>Length<td><table><tr><td>310 km<td>in all</table></table>
<dl><dt>Source<dd>A spring under the old mill.<dt>Mouth<dd>The bay of the three towns.</dl><p>Boats go up as far as the first weir.</p></main>
<div class="reader comments"><div class=comment><p>Ann</p><p>My father fished there as a boy, every summer.</p></div></div><footer>© 1999 The valley press. All rights reserved.</footer></div></body>""",
        ["Rivers of the north", "The river rises in the hills and runs to the sea in two days.", "Length", "310 km", "in all", "Source", "A spring under the old mill.", "Mouth", "The bay of the three towns.", "Boats go up as far as the first weir."],
    ),
    (
        """<html><body><header class=branding><p>The Daily Post</p></header><article class="story long"><h2>A loaf in an hour</h2><p>Mix the flour and the water with a spoon, then wait.</p>
<section class="comments"><h3>Comments</h3><ol><li class=comment><p>Bob</p><p>It worked for me with rye flour too.</p></ol></section></article>
<form class=search><label>Find</label><button>Go</button></form></body></html>""",
        ["A loaf in an hour", "Mix the flour and the water with a spoon, then wait."],
    ),
    (
        """<BODY><DIV CLASS="Cookie-Consent"><P>We and our partners use cookies. Accept?</P></DIV><MAIN><H1>Minutes of the meeting</H1><UL><LI>The minutes of May were read.<LI>The roof is to be mended.</UL>
<BLOCKQUOTE><P>The roof can't wait another winter.</P></BLOCKQUOTE><PRE>Votes: 7 to 2</PRE></MAIN><ASIDE CLASS=trending><H4>Most read</H4><UL><LI><A HREF=/z>Ten roofs</A></UL></ASIDE></BODY>""",
        ["Minutes of the meeting", "The minutes of May were read.", "The roof is to be mended.", "The roof can't wait another winter.", "Votes: 7 to 2"],
    ),
    (  # names that say nothing, and text in bare div
        """<body><div class="css-1ab2"><div class="css-9">The council met on Monday to hear what had been done about the bridge since last spring.</div><div class="css-9">Residents asked when the road would open again.</div></div></body>""",
        ["The council met on Monday to hear what had been done about the bridge since last spring.", "Residents asked when the road would open again."],
    ),
    (
        """<body><div class="c-hdr"><a href="/">Home</a> <a href="/n">News</a></div><div class="x1"><p>First paragraph of a real article that goes on for a while.</p><p>Second paragraph, which says a little more about the matter at hand.</p></div><div class="ftr">© 2021 The Herald. All rights reserved.</div></body>""",
        ["First paragraph of a real article that goes on for a while.", "Second paragraph, which says a little more about the matter at hand."],
    ),
    (
        """<body><noscript>Please enable JavaScript to view this page.</noscript><article><h1>Title here</h1><p>The text of the article is here for all to read.</p></article></body>""",
        ["Title here", "The text of the article is here for all to read."],
    ),
    (  # a table that lays out the page
        """<body><table><tr><td><a href="/">Home</a></td><td><a href="/b">News</a></td><td><a href="/c">About us</a></td></tr><tr><td colspan=3>The ferry leaves at six in the morning and comes back in the evening, if the weather allows it.<p>Tickets are sold on board by the mate, who takes coins alone.</p></td></tr></table></body>""",
        ["The ferry leaves at six in the morning and comes back in the evening, if the weather allows it.", "Tickets are sold on board by the mate, who takes coins alone."],
    ),
]


@pytest.mark.parametrize(("page", "want"), BY_HAND)
def test_extraction_of_pages_by_hand(page, want):
    assert html_extract.main_text(page, FIELD()).split("\n\n") == want


@pytest.mark.parametrize("part", ["<a ", "<div>x", "<a '", "<!-- ", "<script>x", "</p><p>x", "<li>x", "<b><p>x", "<div class=aa%s>x", "<style></stylex ", "<table><td>x", "<", "&", "<p x='>"])
def test_a_page_takes_time_in_proportion_to_its_length(part):
    import time

    names = (f"n{''.join(random.Random(k).choices('abcdefgh', k=6))}" for k in range(10**6))
    page = "".join(part % next(names) if "%s" in part else part for _ in range(1_000_000 // len(part)))
    began = time.process_time()
    html_extract.main_text(page, FIELD())
    assert time.process_time() - began < 30


def test_notes_are_seen_wherever_they_stand_in_a_block():
    early, late = (html_extract.blocks_of(f"<p>{t}</p>")[0] for t in ("cookie " + "word " * 100, "word " * 100 + "cookie"))
    assert html_extract.text_features(early)[3] == html_extract.text_features(late)[3]


def test_extraction_on_held_out_layouts():
    field = html_extract.train()
    hits = total = 0
    for blocks, labels in html_extract.labelled_pages(120, seed=77):
        got = field.decode(blocks)
        hits += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert hits / total > 0.97


def test_slope_of_the_likelihood_is_its_derivative():
    field, rng = html_extract.Field(), np.random.default_rng(1)
    field.weights, field.moves = rng.normal(size=6), rng.normal(size=(2, 2))
    features, labels = [np.array([0, 3]), np.array([1, 3, 5]), np.array([2]), np.array([4, 0])], np.array([0, 1, 1, 0])
    import itertools

    def value(path):
        return sum(field.weights[f].sum() for f, y in zip(features, path, strict=True) if y) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))

    whole, g, gm = field.slope(features, labels)
    assert whole == pytest.approx(value(labels) - np.log(sum(np.exp(value(p)) for p in itertools.product((0, 1), repeat=4))))
    for array, slope in ((field.weights, g), (field.moves, gm)):
        for at in np.ndindex(array.shape):
            array[at] += 1e-5
            more = field.slope(features, labels)[0]
            array[at] -= 2e-5
            less = field.slope(features, labels)[0]
            array[at] += 1e-5
            assert slope[at] == pytest.approx((more - less) / 2e-5, abs=1e-6)


def test_kept_scores_are_sums_of_the_features():
    field = FIELD()
    for page, _ in BY_HAND:
        blocks = html_extract.blocks_of(page, field.numbers, field.paths)
        assert field.scores(blocks) == pytest.approx([field.value(f) for f in html_extract.page_features(blocks)])


def test_viterbi_finds_the_best_path():
    field = html_extract.train(html_extract.labelled_pages(20, seed=1))
    blocks, _ = max(html_extract.labelled_pages(20, seed=2), key=lambda p: -abs(len(p[0]) - 9))
    scores = field.scores(blocks)

    def value(labels):
        return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))

    import itertools

    assert value(field.decode(blocks)) == pytest.approx(max(value(p) for p in itertools.product((0, 1), repeat=len(blocks))))


def test_caches_are_bounded_and_pure():
    c = Cached(lambda x: x * 2, limit=3)
    assert [c[k % 5] for k in range(20)] == [k % 5 * 2 for k in range(20)] and len(c) <= 3


def test_a_step_holds_no_more_than_its_own_tokens():
    """Tokens of one class: padding all classes to the largest took 32 times the memory."""
    import tracemalloc

    weights = lm.start()
    w, seen = lm.unpack(weights), {name: np.full(shape, 1e-3, np.float32) for name, shape in lm.SHAPES.items()}
    tokens, near = np.arange(4096, dtype=np.int32) % lm.MEMBERS, np.zeros((4, 4096), np.int32)
    tracemalloc.start()
    lm.step(w, seen, tokens, near, 0.05)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8_000_000 and np.isfinite(weights).all()


def test_rows_of_embeddings_are_ordered_as_16_bit_numbers():
    most = len(lm.OFFSETS) * (lm.VOCABULARY + 1)
    assert most < 2**15
    x = np.random.default_rng(1).integers(0, most, 5_000).astype(np.int32)
    assert (lm.by_value(x) == np.argsort(x, kind="stable")).all()


def test_repeats_and_numbers_over_many_texts_equal_those_of_each(texts):
    listed = [(t or "").encode().split() for _, t, *_ in texts] + ["a b c d a b c".encode().split(), b"a b c".split()]
    words = Numbered()
    first, _, new = words.learn(listed)
    numbers, doc, again = words.learn(listed)
    assert first.tolist() == numbers.tolist() and again == [] and new == list(words) and len(set(new)) == len(new)
    assert [new[k] for k in numbers] == [w for own in listed for w in own]
    assert words.hashes[numbers].tolist() == [x for own in listed for x in WordHashes().of(own).tolist()]
    hit = quality_rules.by_text(quality_rules.in_repeats(words.hashes[numbers], doc), doc, len(listed))
    assert [int(h.sum()) for h in hit] == [brute_measures(" ".join(w.decode() for w in own))[4] for own in listed]
    # The classes of a text's pairs are the same whether it stands alone or among others.
    own = quality_rules.by_text(quality_rules.buckets_of(words.hashes[numbers], "aa"), doc, len(listed))
    codes, times, mask, of = quality_rules.pairs_of(own)
    for k, t in enumerate(own):
        if len(t):
            alone = quality_rules.pairs_of([t])
            assert all((x[of == k] == y).all() for x, y in zip((codes, times, mask), alone, strict=False))
            pairs = Counter(zip([0, *t.tolist()], t.tolist(), strict=False))
            assert {divmod(c, quality_rules.BUCKETS): n for c, n in zip(alone[0].tolist(), alone[1].tolist(), strict=True)} == pairs


def test_slopes_and_logs_of_a_softmax_within_and_beyond_the_range_of_floats():
    rng = np.random.default_rng(3)
    for scale in (1, 300, 3000):  # beyond 88 an exponent leaves 32 bits
        x, at = rng.normal(0, scale, (50, lm.MEMBERS)).astype(np.float32), rng.integers(0, lm.MEMBERS, 50)
        z = x.astype(float) - x.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        want = z[np.arange(50), at] - np.log(np.exp(z).sum(axis=1))
        assert lm.chosen(x.copy(), at) == pytest.approx(want, rel=1e-4, abs=1e-4)
        p[np.arange(50), at] -= 1
        assert lm.slopes(x.copy(), at, 50) == pytest.approx(p / 50, abs=1e-6)
    assert lm.starts(np.array([2, 2, 5, 7, 7, 7])).tolist() == [0, 2, 3]
