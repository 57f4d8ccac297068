import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chartlode.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes, width):
    """Root of the nodes and, for each, its siblings by level as (before, after)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] // width * width
            p.append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + width])))
            at[i] //= width
        nodes = [h(*nodes[i : i + width]) for i in range(0, len(nodes), width)]
    return nodes[0], paths


def plain_manifest(rows, width):
    """rows: doc_id, text, lang, source, n_chars."""
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        groups[source].append(((doc is not None, doc or 0), leaf((doc, source, lang, n, text)), doc))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:2])
        trees[s] = plain_tree([x[1] for x in groups[s]], width)
    root, tops = plain_tree([trees[s][0] for s in order], width)
    return [(doc, own, trees[s][0], root, path + top) for s, top in zip(order, tops, strict=True) for (_, own, doc), path in zip(groups[s], trees[s][1], strict=True)]


def got(df, **kw):
    return [(r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in merkle.manifest(df, **kw).collect()]


@pytest.mark.parametrize(("width", "levels"), [(3, 5), (2, 2), (4, 1)])
def test_manifest_equals_a_plain_one_on_odd_rows(odd, texts, monkeypatch, width, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [*texts]
    want = plain_manifest(rows, width)
    assert sorted(map(repr, got(odd, width=width))) == sorted(map(repr, want))


def test_many_groups_a_hot_group_and_a_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(k, f"t{k}", None, None if k % 2 else f"s{k % 41}", k) for k in range(700)] + [(7, "same", "x", "s1", 4)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert sorted(map(repr, got(df))) == sorted(map(repr, plain_manifest(rows, 3)))


def test_proofs_fold_to_the_root_and_show_what_was_changed(odd, texts):
    other = merkle.leaf_hash(*[F.col(c) for c in merkle.FIELDS if c != "text"], F.translate("text", "\n", ""))
    rows = merkle.manifest(odd, carry={"other": other}).withColumns({"root2": merkle.folded(F.col("leaf"), F.col("proof")), "root3": merkle.folded(F.col("other"), F.col("proof")), "all": merkle.siblings(F.col("proof"))}).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.root2 == r.root
        assert (r.root3 == r.root) == (r.other == r.leaf)
        assert r["all"] == "".join(s.before + s.after for s in r.proof)
    assert any(r.other != r.leaf for r in rows)


def test_one_row_and_no_row(spark, empty):
    one = spark.createDataFrame([(4, "a", None, None, 1)], empty.schema)
    assert got(one) == [(4, own := leaf((4, None, None, 1, "a")), own, own, [])]
    assert got(empty) == []
    with pytest.raises(ValueError):
        merkle.manifest(one, width=1)
