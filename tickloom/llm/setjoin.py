"""All similar pairs between set-valued records, by an extended-prefix join.

Tokens are ordered from rare to frequent over all different sets. A pair |r| <= |s| counts if
common / union >= ``jaccard``, or common >= ``least`` and common / |r| >= ``contained``. Either way r
lacks at most k of its tokens in s, so of its k + L rarest tokens (the L-prefix) at least L are in
s; for the Jaccard case they are in the L-prefix of s too. Each record has its own L:

    * Where the prefix stays among rare tokens (at most ``often`` sets hold one), L is that of
      1 .. ``short`` with the least cost: postings to read, and sets to verify when at least L of
      so many independent tokens meet (a Poisson tail). Keys are single tokens.
    * Where it reaches frequent tokens, these are keys only in pairs. Tokens fall into m groups by
      a hash, L is m + 1, and any L shared tokens hold a rare one or two of one group. Only pairs
      inside a group are keys, and m grows with the set, so a set of n tokens has about n keys and
      not n * n. m belongs to a class of sizes, so both sides know it.

A candidate has shared enough keys for L shared tokens, and the places of each shared key leave
room for the overlap needed. Verification intersects the two sets. The containment case reads
whole sets on the longer side, but only those frequent tokens that some prefix holds. A pair of
frequent tokens that go together is as hot as they are: its longer sides are split into parts of
``part`` sets or fewer, and the shorter sides meet each part.

Records with equal sets form a class (by the SHA-256 of the sorted set), and only classes are
joined; members come back at the end. Joins are sorted merges, which spill; none depends on a
broadcast. ``often``, ``short`` and ``part`` change the work, never the result.

Defined results for odd input: NULL ids, and tokens with a NULL part, are left out; NULL and empty
sets match nothing; repeated tokens count once; several rows of one id are one set (their union);
records with the same set match whatever its size; empty table: no rows. Thresholds of a half or
less, and ``least`` below 2, are refused.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import meet
from tickloom.session import cut_lineage


def _at_least(share: Fraction, n: str) -> str:
    """ceil(share * n) in whole numbers."""
    return f"({share.numerator} * {n} + {share.denominator - 1}) div {share.denominator}"


def classes(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, token): members (id, class) and sets (class, tokens, n, members)."""
    sets = tokens.where("id is not null and token is not null").distinct().groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    known = cut_lineage(sets.withColumn("same", F.unhex(F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256))))
    unique = cut_lineage(known.groupBy("same").agg(F.first("tokens").alias("tokens"), F.count("*").alias("members")).withColumn("n", F.size("tokens")).withColumn("class", F.monotonically_increasing_id()))
    sizes = unique.select("same", "class", F.col("members").alias("n"))
    return meet(known.select("id", "same"), sizes, "same", known.count()).select("id", "class"), unique.drop("same")


def _groups(least_size: str, share: Fraction, least: int = 0) -> str:
    """m of a class of sizes from its least size: a third of the tokens that may be missing."""
    need = f"greatest({least}, {_at_least(share, least_size)})"
    return f"cast(greatest(1, least(({least_size} - {need}) div 3, {need} - 1)) as int)"


def _length(k: str, need: str, m: str, often: int, short: int, n_sets: int) -> Column:
    """L of a record with its tokens in ``t``."""

    def cost(length: Column) -> Column:
        read = F.aggregate(F.slice("t", 1, F.expr(k).cast("int") + length), F.lit(0.0), lambda a, x: a + x["df"])
        rate = read / max(1, n_sets)
        fewer = F.lit(1.0) + F.when(length > 1, rate).otherwise(0) + F.when(length > 2, rate * rate / 2).otherwise(0) + F.when(length > 3, rate * rate * rate / 6).otherwise(0)
        return read + F.col("n") * n_sets * F.greatest(F.lit(0.0), 1 - F.exp(-rate) * fewer)

    rare = F.filter(F.sequence(F.lit(1), F.least(F.lit(short), F.expr(need).cast("int"))), lambda x: F.element_at("t", (F.expr(k) + x).cast("int"))["df"] <= often)
    best = F.array_min(F.transform(rare, lambda x: F.struct(cost(x).alias("cost"), x.alias("length"))))["length"]
    return F.coalesce(best, F.expr(m) + 1).cast("int")


def _singles(p: str) -> Column:
    return F.transform(F.filter(p, lambda x: ~x["often"]), lambda x: F.struct(F.lit(-1).alias("size"), x["token"].alias("a"), x["token"].alias("b"), x["at"].alias("at"), x["df"].alias("df")))


def _pairs(p: str, size: Column, m: Column) -> Column:
    """Pairs of frequent tokens of one group; ``at`` is the later place, ``df`` the lower frequency."""
    mine = F.transform(F.filter(p, lambda x: x["often"]), lambda x: F.struct(x["token"].alias("token"), x["at"].alias("at"), x["df"].alias("df"), F.pmod(F.xxhash64(x["token"]), m).alias("g")))
    return F.flatten(
        F.transform(
            mine,
            lambda x: F.transform(
                F.filter(mine, lambda y: (y["g"] == x["g"]) & (y["at"] > x["at"])),
                lambda y: F.struct(size.cast("int").alias("size"), x["token"].alias("a"), y["token"].alias("b"), y["at"].alias("at"), x["df"].alias("df")),
            ),
        )
    )


def _met(probe: DataFrame, index: DataFrame, part: int, counts: Column) -> DataFrame:
    """(r, s) of probes and indexed sets that share enough keys. A hot key's index is in parts."""
    parts = F.when(F.col("k.size") < 0, 1).otherwise(F.ceil(F.col("k.df") / part)).cast("int")
    flat = lambda rows, at, salt: rows.withColumn("salt", salt).select("*", "k.size", "k.a", "k.b", F.col("k.at").alias(at)).drop("k")
    left = flat(probe, "r_at", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = flat(index, "s_at", F.pmod(F.xxhash64("s"), parts).cast("int"))
    met = left.join(right.hint("merge"), ["size", "a", "b", "salt"]).where("r_n < s_n or (r_n = s_n and r < s)").where(counts)
    shared = met.groupBy("r", "s").agg(F.count("*").alias("shared"), F.first("asked").alias("asked"))
    return shared.where("shared >= asked").select("r", "s")


def similar_classes(sets: DataFrame, *, jaccard: Fraction = Fraction(7, 10), contained: Fraction = Fraction(9, 10), least: int = 5, often: int = 256, short: int = 3, part: int = 1 << 16) -> DataFrame:
    """(left, right, common, n_left, n_right) of similar different classes, |left| <= |right|."""
    if not (jaccard > Fraction(1, 2) and contained > Fraction(1, 2) and least >= 2 and 1 <= short <= 4):
        raise ValueError("thresholds must be above a half, least at least 2 and short from 1 to 4")
    n_sets, n_postings = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    postings = sets.select("class", F.explode("tokens").alias("token"))
    df = postings.groupBy("token").agg(F.count("*").alias("df")).withColumn("n", F.col("df"))
    # sorted by frequency, ties by the token, so every set has its tokens in the same order
    ordered = cut_lineage(meet(postings, df, "token", n_postings).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).withColumn("n", F.size("t")).withColumn("size", F.length(F.bin("n")).cast("int") - 1))
    low = "shiftleft(1L, size)"
    ways = {"j": (_at_least(jaccard, "n"), _groups(low, jaccard)), "c": (f"greatest({least}, {_at_least(contained, 'n')})", _groups(low, contained, least))}

    def prefix(upto: Column) -> Column:
        return F.transform(F.slice("t", 1, F.least(upto, F.col("n")).cast("int")), lambda x, i: F.struct(x["token"].alias("token"), (i + 1).alias("at"), x["df"].alias("df"), (x["df"] > often).alias("often")))

    def probes(way: str, rows: DataFrame) -> DataFrame:
        need, m = ways[way]
        k = f"(n - {need})"
        sized = rows.withColumns({"m": F.expr(m), "need": F.expr(need)}).withColumn("length", _length(k, need, m, often, short, n_sets))
        held = sized.withColumn("p", prefix(F.expr(k) + F.col("length")))
        slack = F.least("m", F.size(F.filter("p", lambda x: x["often"])))
        # as many keys as L shared tokens give at least: up to m of them may be frequent ones alone in their groups
        return held.select(F.col("class").alias("r"), F.col("n").alias("r_n"), "size", "m", "length", "p", F.greatest(F.lit(1), F.col("length") - slack).alias("asked"))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("r", "r_n", "length", "asked", F.explode(F.concat(_singles("p"), _pairs("p", F.col("size"), F.col("m")))).alias("k"))

    # Jaccard: prefixes on both sides, the longer set at most 1 / jaccard times the shorter one
    below = math.ceil(math.log2(1 / float(jaccard)))
    indexed = ordered.where("n >= 2").withColumn("upto", F.expr(f"n - {_at_least(jaccard, 'n')} + greatest({short}, {ways['j'][1]} + 1)")).withColumn("p", prefix(F.col("upto")))
    pairs_j = indexed.withColumn("z", F.explode(F.sequence(F.greatest(F.lit(1), F.col("size") - below), F.col("size")))).withColumn("zm", F.expr(_groups("shiftleft(1L, z)", jaccard)))
    base = [F.col("class").alias("s"), F.col("n").alias("s_n")]
    index_j = indexed.select(*base, F.explode(_singles("p")).alias("k")).unionByName(pairs_j.select(*base, F.explode(_pairs("p", F.col("z"), F.col("zm"))).alias("k")))
    joint = jaccard / (1 + jaccard)  # common >= jaccard * union is common >= joint * (|r| + |s|)
    fits = F.expr(
        f"{jaccard.numerator} * s_n <= {jaccard.denominator} * r_n and s_at <= s_n - {_at_least(jaccard, 's_n')} + length"
        f" and {joint.denominator} * (least(r_at, s_at) + least(r_n - r_at, s_n - s_at)) >= {joint.numerator} * (r_n + s_n)"
    )
    by_jaccard = _met(keyed(probes("j", ordered.where("n >= 2"))), index_j, part, fits)

    # containment: prefixes of the shorter side, whole sets of the longer one
    large = ordered.where(F.col("n") >= least)
    probes_c = probes("c", large)
    wanted = probes_c.select("size", F.explode(F.filter("p", lambda x: x["often"])).alias("x")).select(F.col("size").alias("z"), "x.token").distinct()
    often_in = large.select("class", "n", "size", F.explode(F.filter("t", lambda x: x["df"] > often)).alias("x")).select("class", "n", "size", "x.df", "x.token")
    asked_for = often_in.join(wanted.hint("merge"), "token").where("z <= size").groupBy("class", "n", "z").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("f"))
    found = asked_for.withColumn("p", F.transform("f", lambda x, i: F.struct(x["token"].alias("token"), (i + 1).alias("at"), x["df"].alias("df"), F.lit(True).alias("often")))).withColumn("zm", F.expr(_groups("shiftleft(1L, z)", contained, least)))
    index_c = large.withColumn("p", prefix(F.col("n"))).select(*base, F.explode(_singles("p")).alias("k")).unionByName(found.select(*base, F.explode(_pairs("p", F.col("z"), F.col("zm"))).alias("k")))
    by_containment = _met(keyed(probes_c), index_c, part, F.lit(True))

    shared = by_jaccard.unionByName(by_containment).distinct()
    whole = ordered.select("class", F.transform("t", lambda x: x["token"]).alias("tokens"))
    verified = (
        shared.join(whole.withColumnsRenamed({"class": "r", "tokens": "left_tokens"}).hint("merge"), "r").join(whole.withColumnsRenamed({"class": "s", "tokens": "right_tokens"}).hint("merge"), "s")
        .select(F.col("r").alias("left"), F.col("s").alias("right"), F.size(F.array_intersect("left_tokens", "right_tokens")).alias("common"), F.size("left_tokens").alias("n_left"), F.size("right_tokens").alias("n_right"))
    )
    return verified.where(f"{jaccard.denominator} * common >= {jaccard.numerator} * (n_left + n_right - common) or (common >= {least} and {contained.denominator} * common >= {contained.numerator} * n_left)")


def similar_pairs(tokens: DataFrame, **options) -> DataFrame:
    """(left_id, right_id), the smaller id first, of all similar records; copies of a set included."""
    members, sets = classes(tokens)
    between = similar_classes(sets, **options).select("left", "right")
    a, b = members.select(F.col("id").alias("a"), F.col("class").alias("left")), members.select(F.col("id").alias("b"), F.col("class").alias("right"))
    within = a.join(b, F.col("left") == F.col("right")).where("a < b")
    pairs = between.join(a, "left").join(b, "right").select("a", "b").unionByName(within.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def class_pairs(tokens: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Copies not expanded: pairs (left_id, right_id, common) of class representatives, the least id of each
    class, and membership (id, representative) of every record."""
    members, sets = classes(tokens)
    named = members.groupBy("class").agg(F.min("id").alias("representative"), F.count("*").alias("n"))
    heads = cut_lineage(named)
    a, b = heads.select(F.col("class").alias("left"), F.col("representative").alias("a")), heads.select(F.col("class").alias("right"), F.col("representative").alias("b"))
    pairs = similar_classes(sets, **options).join(a, "left").join(b, "right").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "common")
    return pairs, meet(members, heads, "class", members.count()).select("id", "representative")


def similar_counts(tokens: DataFrame, **options) -> DataFrame:
    """One row for each record: its class and the number of records it is similar to, copies not expanded."""
    members, sets = classes(tokens)
    between = similar_classes(sets, **options).select("left", "right")
    sizes = sets.select(F.col("class").alias("right"), "members")
    both = between.unionByName(between.select(F.col("right").alias("left"), F.col("left").alias("right")))
    linked = both.join(sizes, "right").groupBy(F.col("left").alias("class")).agg(F.sum("members").alias("others"), F.count("*").alias("class_links"))
    counts = sets.select("class", "members").join(linked, "class", "left").select("class", "members", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("class_links", F.lit(0)).alias("class_links"))
    return members.join(counts, "class").select("id", "class", "members", "links", "class_links")


def entry_tokens(candidates: DataFrame) -> DataFrame:
    """(id, token) of candidates: an entry with its side as one number; a NULL part leaves the element out."""
    return (
        candidates.where("candidate_id is not null and entry_indices is not null and trade_sides is not null")
        .select(F.col("candidate_id").alias("id"), F.explode(F.arrays_zip(F.col("entry_indices").alias("e"), F.col("trade_sides").alias("s"))).alias("x"))
        .where("x.e is not null and x.s is not null")
        .select("id", (F.col("x.e").cast("bigint") * 256 + F.col("x.s").cast("bigint") + 128).alias("token"))
    )
