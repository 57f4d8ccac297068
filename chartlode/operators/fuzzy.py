"""Fuzzy matching of noisy names against a registry.

Names without an exact key first meet the keys within a few edits, through an index of deletions: two strings that are d edits apart
are the same after d deletions at most from each, a swap of neighbours counting as one edit. Such a join's candidates are the matches
and little else, however large the registry is, and no piece of a name is a hot key. Only names without any key so near are compared
with all keys of a length within their cap, which is dealt into cells of both sides; bags of letters sift those pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlode.operators.storage import materialize


def damerau(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions."""
    big = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        rows[i + 1][1] = i
    for j in range(len(b) + 1):
        rows[1][j + 1] = j
    for i, x in enumerate(a, 1):
        same = 0
        for j, y in enumerate(b, 1):
            k, at = last.get(y, 0), same
            if x == y:
                same = j
            rows[i + 1][j + 1] = min(rows[i][j] + (x != y), rows[i + 1][j] + 1, rows[i][j + 1] + 1, rows[k][at] + (i - k - 1) + 1 + (j - at - 1))
        last[x] = i
    return rows[-1][-1]


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def likeness(a: str, b: str) -> float:
    """FUZ-06. 0 to 100: twice the common subsequence's share of both lengths."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_likeness(a: str, b: str) -> float:
    """FUZ-09. The best likeness of the shared words, and those with either side's other words."""
    x, y = set(a.lower().split()), set(b.lower().split())
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (both + " " + s if both else s for s in (left, right))
    return max(likeness(one, two), likeness(both, one) if both else 0, likeness(both, two) if both else 0)


def bags(words: pd.Series) -> np.ndarray:
    """How often each of 64 classes of characters is in each word."""
    out = np.zeros((len(words), 64), np.int16)
    for i, w in enumerate(words):
        np.add.at(out[i], [ord(c) & 63 for c in w], 1)
    return out


def within(a: pd.Series, b: pd.Series, cap: pd.Series) -> pd.Series:
    """The distance of each pair of words if it is cap at most, else null. An edit adds one character and takes one away at most, so words whose bags differ more aren't compared."""
    (ia, xs), (ib, ys) = pd.factorize(a), pd.factorize(b)
    far = np.empty(len(a), np.int16)
    left, right = bags(xs), bags(ys)
    for low in range(0, len(a), 4096):
        d = left[ia[low : low + 4096]] - right[ib[low : low + 4096]]
        far[low : low + 4096] = np.maximum(np.where(d > 0, d, 0).sum(axis=1), np.where(d < 0, -d, 0).sum(axis=1))
    found = (damerau(x, y) if f <= c else None for x, y, c, f in zip(a, b, cap, far, strict=True))
    return pd.Series([d if d is not None and d <= c else None for d, c in zip(found, cap, strict=True)], dtype="Int32")


within_udf = F.pandas_udf(within, T.IntegerType())


@F.pandas_udf(T.DoubleType())
def likeness_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_likeness(x, y) for x, y in zip(a, b, strict=True)])


def key_index(registry: DataFrame, normalize, name: str = "name", synonyms: str | None = None, ordinal: str = "ordinal") -> DataFrame:
    """FUZ-01, FUZ-02. key, record (its ordinal): the first record keeps a key; synonyms only take keys that no name has."""
    keys = registry.select(normalize(F.col(name)).alias("key"), F.col(ordinal).alias("record"), F.lit(0).alias("kind"), F.lit(0).alias("place"))
    if synonyms:
        more = registry.select(F.col(ordinal).alias("record"), F.posexplode(synonyms).alias("place", "s"))
        keys = keys.unionByName(more.select(normalize(F.col("s")).alias("key"), "record", F.lit(1).alias("kind"), "place"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("kind", "record", "place"))
    first = keys.where(F.coalesce("key", F.lit("")) != "").withColumn("rank", rank).where("rank = 1")
    return first.select("key", "record", (F.col("kind") * F.lit(1 << 40) + F.col("record")).alias("order"))


#: Edits that the index of deletions covers, for words of up to so many letters, and for longer ones.
NEAR, LONG, NEAR_LONG = 2, 40, 1


def near_edits(word: Column) -> Column:
    return F.when(F.length(word) <= LONG, NEAR).otherwise(NEAR_LONG)


def deletions(df: DataFrame, word: str, most: Column) -> DataFrame:
    """df with piece: a hash of each string that up to most (NEAR at most) deletions leave of word, once each."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    df = df.withColumn("_1", F.when(most > 0, F.array_distinct(less(F.col(word)))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_2", F.when(most > 1, F.array_distinct(F.flatten(F.transform("_1", less)))).otherwise(F.array().cast("array<string>")))
    pieces = F.array_distinct(F.transform(F.concat(F.array(word), "_1", "_2"), lambda s: F.xxhash64(s)))
    return df.withColumn("piece", F.explode(pieces)).drop("_1", "_2")


def closest(asked: DataFrame, index: DataFrame, cells: int = 16) -> DataFrame:
    """query, key, record, distance: the key of least Damerau-Levenshtein distance up to each query's cap, of equals that of least order. asked: query, cap, distinct."""
    best = F.min_by(F.struct("key", "record", "distance"), F.struct("distance", "order")).alias("b")
    # No string longer than LONG and NEAR_LONG is near a shorter query than LONG by more than NEAR_LONG, so both sides delete alike.
    reach = F.least("cap", near_edits(F.col("query")))
    words = deletions(asked.select("query", reach.alias("cap")), "query", F.col("cap"))
    keys = deletions(index, "key", F.when(F.length("key") <= LONG + NEAR, NEAR).otherwise(NEAR_LONG))
    pairs = words.join(keys, "piece").where(F.abs(F.length("query") - F.length("key")) <= F.col("cap")).groupBy("query", "key").agg(*[F.first(c).alias(c) for c in ("cap", "record", "order")])
    near = pairs.withColumn("distance", within_udf("query", "key", "cap")).where("distance is not null")
    near = materialize(near.groupBy("query").agg(best).select("query", "b.*"), "near")
    # The rest: by length, each query in all cells of a length, each key in one.
    open_ = asked.where(F.col("cap") > near_edits(F.col("query"))).join(near, "query", "left_anti")
    spread = open_.withColumn("n", F.explode(F.sequence(F.greatest(F.length("query") - F.col("cap"), F.lit(1)), F.length("query") + F.col("cap"))))
    spread = spread.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    dealt = index.select("key", "record", "order", F.length("key").alias("n"), F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int").alias("cell"))
    far = spread.join(dealt, ["n", "cell"]).where(F.levenshtein("query", "key", 1 << 20) <= 2 * F.col("cap"))
    far = far.withColumn("distance", within_udf("query", "key", "cap")).where("distance is not null")
    return near.unionByName(far.groupBy("query").agg(best).select("query", "b.*"))


def match(queries: DataFrame, index: DataFrame, *, max_edit_ratio: float, ratio_floor: float, short: int = 0, query: str = "query") -> DataFrame:
    """FUZ-03, FUZ-04, JOIN-08. Each distinct query with status, key, record, distance and ratio.

    An exact key matches with distance 0 and ratio 100. A query of at most short characters matches exactly or not at all.
    Another takes the key of least Damerau-Levenshtein distance up to max(1, floor(length * max_edit_ratio)), the first one of
    equals; if its ratio is under ratio_floor the query is unverified, keeping distance and ratio. Null and '' are unverified."""
    asked = queries.select(F.col(query).alias("query")).distinct()
    exact = materialize(asked.join(index.select(F.col("key").alias("query"), F.col("record").alias("r0")), "query", "left"), "exact")
    cap = F.greatest(F.lit(1), F.floor(F.length("query") * max_edit_ratio).cast("int"))
    open_ = exact.where(F.col("r0").isNull() & (F.length("query") > short)).select("query", cap.alias("cap"))
    best = closest(open_, index).select("query", "key", "record", F.col("distance").alias("d")).withColumn("l", likeness_udf("query", "key"))
    out = exact.join(best, "query", "left")
    hit = F.col("r0").isNotNull()
    matched = hit | F.coalesce(F.col("l") >= ratio_floor, F.lit(False))
    return out.select("query", F.when(matched, "matched").otherwise("unverified").alias("status"), F.when(hit, F.col("query")).otherwise(F.when(matched, F.col("key"))).alias("key"), F.when(hit, F.col("r0")).otherwise(F.when(matched, F.col("record"))).alias("record"), F.when(hit, 0).otherwise(F.col("d")).alias("distance"), F.when(hit, 100.0).otherwise(F.coalesce("l", F.lit(0.0))).alias("ratio"))


def match_free_text(lines: DataFrame, index: DataFrame, normalize, head, *, max_edit_ratio: float, ratio_floor: float, line: str = "line") -> DataFrame:
    """FUZ-07. Each distinct line by its head, else by the head's first word."""
    heads = lines.select(F.col(line).alias("line")).distinct().withColumn("head", normalize(head(F.col("line")))).withColumn("word", F.split_part("head", F.lit(" "), F.lit(1)))
    asked = heads.select(F.col("head").alias("query")).union(heads.select("word")).distinct()
    found = match(asked, index, max_edit_ratio=max_edit_ratio, ratio_floor=ratio_floor)
    side = lambda key: found.select(F.col("query").alias(key), F.struct("status", "key", "record", "distance").alias(f"m_{key}"))
    both = heads.join(side("head"), "head", "left").join(side("word"), "word", "left")
    best = F.when((F.col("m_head.status") == "matched") | ~F.contains("head", F.lit(" ")), F.col("m_head")).otherwise(F.col("m_word"))
    return both.select("line", best.alias("m")).select("line", "m.*")


def match_panel(queries: DataFrame, index: DataFrame, query: str = "query", synonyms: DataFrame | None = None) -> DataFrame:
    """FUZ-08. query, key: the key that synonyms (synonym, key) has for the query, else the closest key, with a cap of max(3, length div 4) and no ratio floor.

    A synonym's key is taken as it stands, whether it is in the index or not; of several that of least text."""
    asked = queries.select(F.trim(F.lower(query)).alias("query")).distinct()
    if synonyms is not None:
        named = synonyms.groupBy(F.trim(F.lower("synonym")).alias("query")).agg(F.min("key").alias("named"))
        asked = materialize(asked.join(named, "query", "left"), "asked")
    else:
        asked = asked.withColumn("named", F.lit(None).cast("string"))
    cap = F.greatest(F.lit(3), F.floor(F.length("query") / 4).cast("int"))
    exact = asked.where("named is null").join(index.select(F.col("key").alias("query"), F.col("key").alias("same")), "query", "left")
    found = closest(exact.where("same is null and length(query) > 0").select("query", cap.alias("cap")), index).select("query", F.col("key").alias("found"))
    every = asked.join(index.select(F.col("key").alias("query"), F.col("key").alias("same")), "query", "left").join(found, "query", "left")
    return every.select("query", F.coalesce("named", "same", "found").alias("key"))


# Gases of a breath test, longer names first.
GASES = ("h2+2ch4", "ch4", "h2", "o2")
BREATH_TEST = "сибр"


def name_likeness(expected: str, actual: str) -> float:
    """FUZ-10. Share of the expected name's words that the actual one has; a breath test's row is told by its minutes and its gas."""
    x, y = (s.lower().replace("ё", "е") for s in (expected, actual))
    minutes, gas = re.search(r"(\d+)\s*минут", x), next((g for g in GASES if g in x), None)
    if BREATH_TEST in x and minutes and gas and (hits := (minutes[1] in y) + (gas in y)):
        return hits / 2
    words = set(x.split())
    return len(words & set(y.split())) / len(words) if words else 0.0


def name_score(expected: Column, actual: Column) -> Column:
    """FUZ-10 as a column, see name_likeness()."""
    x, y = (F.replace(F.lower(c), F.lit("ё"), F.lit("е")) for c in (expected, actual))
    words = F.array_remove(F.array_distinct(F.split(x, r"\s+")), "")
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, F.split(y, r"\s+"))) / F.size(words)).otherwise(0.0)
    minutes = F.nullif(F.regexp_extract(x, r"(\d+)\s*минут", 1), F.lit(""))
    gas = F.coalesce(*[F.when(F.contains(x, F.lit(g)), g) for g in GASES])
    hits = F.when(F.contains(x, F.lit(BREATH_TEST)), F.contains(y, minutes).cast("int") + F.contains(y, gas).cast("int"))
    return F.when(hits > 0, hits / 2).otherwise(share)
