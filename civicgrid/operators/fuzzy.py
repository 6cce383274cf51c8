"""Names matched by similarity inside a district.

Both sides are reduced to distinct (district, name) first, and no district is compared all against all.

For the weighted score (the default) every comparison it takes the best of asks for common letter pairs: two strings of p and q
letters at ratio r hold an ordered common part of r (p + q) / 2 letters, which indels cut into pieces, so at least
(1.5 r - 1)(p + q) - 1 pairs of neighbouring letters are common. Letter pairs stand in one global order, rarest first, and the shorter
name files only as many of them as must include a common one (prefix filter); the longer name files all. Pairs of the name as it is
and pairs of its words with a blank on either side, in any order of words, are filed apart, each with its own bound. Names too short for
a pair file their rarest letters instead. What meets must then pass, in the JVM, a bound on lengths and on the letters that one
name has and the other lacks. One comparison needs no likeness at all: a common word makes names of quite different length agree at
a fixed score. There every name meets, per word and length, only the rows that can decide: the smallest id and the two ends of the areas.
Where names recur in many districts they meet by name alone, if that makes fewer pairs. A pair of names is scored once for all districts.

For the plain edit score at most k edits destroy 2k letter pairs, so of any 2k + 1 pairs taken in one fixed order at least one survives
on both sides.
"""

from __future__ import annotations

import math
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import LONG_PARTIAL_SCALE, PARTIAL_SCALE, TOKEN_SCALE, weighted_ratio_column
from .state import checkpoint

C = F.col


def _numbered(parts: list[str]) -> list[str]:
    """Each element with its occurrence number, so repeated ones count as different."""
    seen: dict[str, int] = {}
    out = []
    for x in parts:
        seen[x] = seen.get(x, 0) + 1
        out.append(f"{x}#{seen[x]}")
    return out


def _windows(name: str) -> list[str]:
    return [name[i:i + 2] for i in range(max(len(name) - 1, 1))]


def _pairs(name: Column) -> Column:
    """The letter pairs of a name, numbered, as a column."""
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))
    return F.transform(parts, lambda g, i: F.concat(
        g, F.lit("#"), F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


# ---- weighted score

def _profiles(names: DataFrame, threshold: float) -> DataFrame:
    """``district``, ``name``, ``long`` and ``short`` lengths, ``mask`` of its letters, and ``filed``: per kind of key the keys, the
    length that decides which name is the shorter one, and how many keys must be common (0: this kind says nothing)."""
    t = threshold / 100
    word, part = t / TOKEN_SCALE, t / PARTIAL_SCALE
    letters = min(t, part / (2 - part))  # share of the shorter name's letters that the other one has

    def need(share: float, length: int) -> int:
        return max(math.ceil(length * (3 * share - 2) - 1 - 1e-9), 0)

    def profile(name: str) -> tuple:
        words = name.split()
        short = len(" ".join(dict.fromkeys(words)))
        raw, padded = _numbered(_windows(name)), _numbered([w for x in words for w in _windows(f" {x} ")])
        alone = _numbered(["".join(words)[i] for i in range(sum(map(len, words)))])
        tiny = need(t, len(name)) < 1 or need(word, short) < 1
        mask = 0
        for x in alone:
            mask |= 1 << (zlib.crc32(x.encode()) & 63)
        return len(name), short, mask - (mask >> 63 << 64), words, [
            ("r", raw, len(name), need(t, len(name))), ("w", padded, short, need(word, short)),
            ("l", alone, 0, max(math.ceil(short * letters - 1e-9), 1) if tiny else 0)]

    # names are distinct: a plain helper per name
    @F.pandas_udf("long int, short int, mask bigint, _words array<string>, "
                  "filed array<struct<kind:string,keys:array<string>,size:int,need:int>>")
    def profiled(name: pd.Series) -> pd.DataFrame:
        rows = [profile(n) for n in name]
        return pd.DataFrame({
            **{c: [r[i] for r in rows] for i, c in enumerate(("long", "short", "mask", "_words"))},
            "filed": [[dict(zip(("kind", "keys", "size", "need"), f)) for f in r[4]] for r in rows]})

    return names.select("district", "name", profiled("name").alias("p")).select("district", "name", "p.*")


def _filed(profiles: DataFrame, frequency: DataFrame) -> DataFrame:
    """One row per name and key; ``early`` where the key is among those that must include a common one."""
    each = profiles.select("district", "name", "long", "short", "mask", F.explode("filed").alias("f"))
    each = each.select("district", "name", "long", "short", "mask", "f.kind", "f.size", "f.need", F.size("f.keys").alias("_n"),
                       F.explode("f.keys").alias("key"))
    ranked = each.join(frequency, ["kind", "key"], "left").withColumn("_at", F.row_number().over(
        W.partitionBy("district", "name", "kind").orderBy(F.coalesce("n_names", F.lit(0)), "key")))
    return ranked.withColumn("early", (C("need") > 0) & (C("_at") <= C("_n") - C("need") + 1)).drop("n_names", "_at", "_n", "need")


def _meetings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(district, l_name, r_name) that may reach the threshold by common letters. ``left``, ``right``: profiles."""
    frequency = right.select(F.explode("filed").alias("f")).select("f.kind", F.explode("f.keys").alias("key")).groupBy(
        "kind", "key").agg(F.count(F.lit(1)).alias("n_names"))
    sides = []
    for profiles, side in ((left, "l"), (right, "r")):
        filed = _filed(profiles, frequency)
        # written: each side is read twice, and keys and their order are costly
        sides.append(checkpoint(filed.select("district", "kind", "key", *[C(c).alias(f"{side}_{c}") for c in (
            "name", "long", "short", "mask", "size", "early")])))
    lk, rk = sides
    on = ["district", "kind", "key"]
    by_left = lk.filter("l_early").join(rk, on).filter("l_size <= r_size")
    by_right = lk.join(rk.filter("r_early"), on).filter("r_size <= l_size")
    t = threshold / 100
    part = t / PARTIAL_SCALE
    least = F.ceil(F.least("l_short", "r_short") * F.lit(min(t, part / (2 - part))) - 1e-9)
    met = by_left.unionByName(by_right).filter(F.greatest("l_long", "r_long") <= 8 * F.least("l_long", "r_long"))
    missing = [C(f"{a}_long") - F.bit_count(C(f"{a}_mask").bitwiseAND(F.bitwise_not(C(f"{b}_mask")))) for a, b in ("lr", "rl")]
    return met.filter((missing[0] >= least) & (missing[1] >= least)).select("district", "l_name", "r_name")


def _common_words(left: DataFrame, right: DataFrame, ids: DataFrame) -> DataFrame:
    """Names of quite different length with a common word: per word and length the right names that can decide.

    ``ids``: district, name, id, area, one row per right row.
    """
    ends = ids.groupBy("district", "name").agg(F.min("id").alias("id"), F.min("area").alias("lo"), F.max("area").alias("hi"))
    rows = right.select("district", "name", C("long").alias("r_long"), F.explode(F.array_distinct("_words")).alias("word")).join(
        ends, ["district", "name"])
    chosen = rows.groupBy("district", "word", "r_long").agg(F.array(
        F.min_by("name", "id"), F.min_by("name", F.struct("lo", "id")), F.max_by("name", F.struct("hi", "id"))).alias("names"))
    words = left.select("district", C("name").alias("l_name"), C("long").alias("l_long"), F.explode(F.array_distinct("_words")).alias("word"))
    most, least = F.greatest("l_long", "r_long"), F.least("l_long", "r_long")
    met = words.join(chosen, ["district", "word"]).filter((2 * most >= 3 * least) & (most <= 8 * least))
    return met.select("district", "l_name", F.explode(F.array_distinct("names")).alias("r_name"))


def _shared_names(left: DataFrame, right: DataFrame) -> bool:
    """Whether names recur over districts so much that fewer pairs meet by name alone than district by district."""
    def counts(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy("district").agg(F.count(F.lit(1)).cast("double").alias(n))

    inside = counts(left, "l").join(counts(right, "r"), "district").agg(F.sum(C("l") * C("r")).alias("n")).first().n or 0.0
    return float(left.select("name").distinct().count()) * right.select("name").distinct().count() < inside


def _weighted_pairs(left: DataFrame, right: DataFrame, threshold: float, area: str | None) -> DataFrame:
    if threshold / 100 * 3 - 2 <= 0.1 or threshold / 100 <= LONG_PARTIAL_SCALE:
        raise ValueError("the weighted score needs a threshold of at least 70")
    ln, rn = (checkpoint(x.select("district", "name").filter("trim(name) <> ''").distinct()) for x in (left, right))
    lone = _shared_names(ln, rn)
    tasks = int(ln.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def profiles(names: DataFrame) -> DataFrame:
        names = names.select(F.lit("").alias("district"), "name").distinct() if lone else names
        return checkpoint(_profiles(names.repartition(tasks, "name"), threshold))

    lp, rp = profiles(ln), profiles(rn)
    pairs = _meetings(lp, rp, threshold).select("l_name", "r_name")
    if threshold <= 100 * TOKEN_SCALE * PARTIAL_SCALE:
        ids = right.select("district", "name", "id", F.coalesce(C(area), F.lit("")).alias("area") if area else F.lit("").alias("area"))
        sides = [n.join(p.drop("district").dropDuplicates(["name"]), "name") for n, p in ((ln, lp), (rn, rp))]
        pairs = pairs.unionByName(_common_words(*sides, ids).select("l_name", "r_name"))
    # A pair of names is scored once for all districts; few bytes are much work, so their number says how many tasks. They are dealt by
    # a hash: by the names themselves the shuffle of the distinct step would serve, and that one may be merged into few tasks.
    pairs = pairs.distinct().repartition(tasks, F.xxhash64("l_name", "r_name"))
    scored = checkpoint(pairs.withColumn("score", weighted_ratio_column(C("l_name"), C("r_name"))).filter(C("score") >= threshold))
    return scored.join(ln.withColumnRenamed("name", "l_name"), "l_name").join(
        rn.withColumnRenamed("name", "r_name"), ["district", "r_name"]).select("district", "l_name", "r_name", "score")


# ---- edit score

def _edit_keys(name: Column, threshold: float) -> Column:
    """Letter pairs that must meet: the first 2k + 1 in hash order; names too short for that file under themselves."""
    # The longer name is at most len * 100 / threshold letters, which bounds the edits.
    k = F.floor(F.length(name) * F.lit((100.0 - threshold) / threshold) + 1e-9).cast("int")
    grams = F.array_sort(F.transform(_pairs(name), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    short = F.length(name) - 1 - 2 * k < 1
    chosen = F.transform(F.slice(grams, F.lit(1), 2 * k + 1), lambda x: x["g"])
    return F.when(short, F.array(F.lit("*"))).otherwise(chosen)


def _score_pairs(left: DataFrame, right: DataFrame, threshold: float, strict: bool, area: str | None = None) -> DataFrame:
    """(district, l_name, r_name, score) of distinct names with score >= threshold."""
    if strict:
        return _weighted_pairs(left, right, threshold, area)
    ln = left.select("district", C("name").alias("l_name")).filter("trim(l_name) <> ''").distinct()
    rn = right.select("district", C("name").alias("r_name")).filter("trim(r_name) <> ''").distinct()
    lk = ln.withColumn("_g", F.explode(_edit_keys(C("l_name"), threshold)))
    rk = rn.withColumn("_g", F.explode(_edit_keys(C("r_name"), threshold)))
    tight = lk.filter("_g <> '*'").join(rk.filter("_g <> '*'"), ["district", "_g"])
    # Names short enough to lose every pair meet by length instead: few edits keep lengths close.
    few = _short_pairs(ln, rn, lk, rk)
    pairs = tight.select("district", "l_name", "r_name").unionByName(few).distinct()
    longest = F.greatest(F.length("l_name"), F.length("r_name"))
    score = (F.lit(1.0) - F.levenshtein("l_name", "r_name") / longest) * 100.0
    return pairs.withColumn("score", score).filter(C("score") >= threshold)


def _short_pairs(ln: DataFrame, rn: DataFrame, lk: DataFrame, rk: DataFrame) -> DataFrame:
    """Names of which one side is too short for the pair filter: matched on a shared letter."""
    ls = lk.filter("_g = '*'").select("district", "l_name")
    rs = rk.filter("_g = '*'").select("district", "r_name")

    def letters(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("_c", F.explode(F.array_distinct(F.split(C(name), ""))))

    a = letters(ls, "l_name").join(letters(rn, "r_name"), ["district", "_c"]).select("district", "l_name", "r_name")
    b = letters(ln, "l_name").join(letters(rs, "r_name"), ["district", "_c"]).select("district", "l_name", "r_name")
    return a.unionByName(b)


def best_match(left: DataFrame, right: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """Best right row per left row: id, match_id, score. The smallest right id wins ties; no match gives no row.

    ``left``: id, district, name. ``right``: id, district, name. ``strict``: the weighted score; else the plain edit score.
    """
    scored = _score_pairs(left, right, threshold, strict)
    first = right.groupBy("district", C("name").alias("r_name")).agg(F.min("id").alias("match_id"))
    best = scored.join(first, ["district", "r_name"]).groupBy("district", "l_name").agg(
        F.max_by(F.struct("match_id", "score"), F.struct("score", -C("match_id"))).alias("_b"))
    return left.select("id", "district", C("name").alias("l_name")).join(best, ["district", "l_name"]).select(
        "id", "_b.match_id", "_b.score")


def match_either(left: DataFrame, right: DataFrame, threshold: float, first: str, second: str,
                 strict: bool = True) -> DataFrame:
    """Match on ``first``; rows without a match try ``second``: id, match_id, score, match_field."""
    a = best_match(left.withColumn("name", C(first)), right, threshold, strict).withColumn("match_field", F.lit(first))
    rest = left.join(a.select("id"), "id", "left_anti")
    b = best_match(rest.withColumn("name", C(second)), right, threshold, strict).withColumn("match_field", F.lit(second))
    return a.unionByName(b)


def unambiguous_link(left: DataFrame, right: DataFrame, threshold: float, area: str, strict: bool = True) -> DataFrame:
    """Links that leave no doubt: all best hits lie in one ``area`` and no right row is claimed twice."""
    scored = _score_pairs(left, right, threshold, strict, area)
    top = scored.groupBy("district", "l_name").agg(F.max("score").alias("score"))
    hits = scored.join(top, ["district", "l_name", "score"]).join(
        right.select("district", C("name").alias("r_name"), C("id").alias("match_id"), area), ["district", "r_name"])
    one = hits.groupBy("district", "l_name", "score").agg(
        F.min("match_id").alias("match_id"), F.count_distinct(F.coalesce(area, F.lit(""))).alias("_areas")
    ).filter("_areas = 1")
    links = left.select("id", "district", C("name").alias("l_name")).join(one, ["district", "l_name"]).select(
        "id", "match_id", "score")
    single = links.groupBy("match_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("match_id")
    return links.join(single, "match_id").select("id", "match_id", "score")
