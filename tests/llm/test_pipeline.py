"""The pipeline as a whole beside its operators, one row at a time."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_minhash import brute
from test_models import LANGS, made

import corpus_pipeline
from chartlode.llm import decontam, langid, packing, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, score double, spans string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of three languages with toxic ones, copies, benchmark passages, repeated and null ids, nulls and columns that clash."""
    rng, rows, labels = random.Random(12), [], []
    passage = made(rng, LANGS["aa"], 14)
    for k in range(240):
        lang = rng.choice(sorted(LANGS))
        text = made(rng, LANGS[lang], rng.randint(40, 90)).split()
        bad = rng.random() < 0.25
        for _ in range(2 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "idiots"]))
        rows.append((k, " ".join(text), lang))
        labels.append((k, 1, int(bad)))
    clean = next(t for (k, t, _), (_, _, bad) in zip(rows, labels, strict=True) if not bad)
    words = clean.split()
    near = [" ".join([*words[:-1], "odd"]), " ".join(["odd", *words[1:]])]
    rows += [(900, clean, "aa"), (900, clean, "aa"), (None, clean, None), (None, clean + " idiots scumbag idiots", None), (901, near[0], "aa"), (902, near[1], None)]
    # One id with a clean, a toxic and a contaminated row.
    rows += [(950, made(rng, LANGS["bb"], 50), "bb"), (950, made(rng, LANGS["bb"], 50) + " idiots scumbag", "bb"), (950, made(rng, LANGS["aa"], 30) + " " + passage, "aa")]
    rows += [(960, None, "aa"), (961, "", "aa"), (962, " \n", None), (963, "123 ...", "aa"), (964, "abc", "aa"), (965, made(rng, LANGS["cc"], 4000), "cc")]
    path = tmp_path_factory.mktemp("sf")
    table = [(d, t, lang, "s", None if t is None else len(t), "k", "r", 0.5, "x") for d, t, lang in rows]
    spark.createDataFrame(table, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_each_stage_keeps_the_rows_that_a_plain_version_keeps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    text_of = columns.index("text")
    model = langid.train(docs)
    names, prototypes = model
    found, has = langid.Profiles().documents([r.text for r in docs.collect()])
    want = Counter(tuple(r) for r, ok in zip(docs.collect(), has, strict=True) if ok)
    one = corpus_pipeline.language(spark, docs, folder)
    assert one.columns == columns and rows_of(one) == want and len(names) == len(LANGS)

    net = toxicity.train(one, spark.read.parquet(f"{folder}/labels.parquet"))
    want = Counter()
    for r in one.collect():
        text = r.text.encode()
        pieces = np.array([toxicity.pieces_of(w) for w in toxicity.words_of(text)], np.int64).reshape(-1, toxicity.PIECES)
        score = net.scores(np.array([net.logit(net.embedding[pieces].mean(axis=1))]), np.array([toxicity.byte_shares(text)]), 0.3)[0]
        want[tuple(r)] += int(score < 0.3)
    two = corpus_pipeline.toxic(spark, one, folder)
    assert two.columns == columns and rows_of(two) == +want
    assert {r.text for r in two.where("doc_id = 950").collect()} != {r.text for r in one.where("doc_id = 950").collect()}

    three = corpus_pipeline.dedup(spark, two, folder)
    texts = [r.text for r in two.collect()]
    group = {i: c for i, _, c in brute(list(enumerate(texts)), percent=80)}
    assert three.columns == columns and not rows_of(three) - rows_of(two)
    kept = Counter(group[texts.index(r.text)] for r in three.collect())
    assert kept == Counter(set(group.values()))

    four = corpus_pipeline.decontaminate(spark, three, folder)
    passage = decontam.words_of(spark.read.parquet(f"{folder}/benchmark.parquet").where("text is not null").first()["text"].encode())
    windows = {tuple(passage[i : i + 10]) for i in range(len(passage) - 9)}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [decontam.words_of(t.encode())] for i in range(len(w) - 9))
    want = Counter(tuple(r) for r in three.collect() if not hit(r[text_of]))
    assert four.columns == columns and rows_of(four) == want and sum(want.values()) < three.count()

    five = corpus_pipeline.pack(spark, four, folder)
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), None)
    lengths, got = Counter(), Counter()
    for r in four.collect():
        lengths[r.doc_id] += len(encode(r.text)) + 1
    for r in five.collect():
        got[r.doc_id] += r.length
        assert r.offset + r.length <= 1024
    assert got == lengths


def test_the_whole_pipeline_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("name", "stage"), [("labels", "toxicity"), ("benchmark", "decontaminate")])
def test_a_stage_without_its_other_table_keeps_all(spark, folder, tmp_path, name, stage):
    """Nothing is toxic where no label is known, and nothing is contaminated by an empty benchmark."""
    spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert got.count() == docs.count()


def test_every_operator_is_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
