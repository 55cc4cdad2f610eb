"""Mixing sources to target weights by Pareto order sampling (Rosen 1997), in DataFrame operations only.

Every source gets a target of words: shares by weight of the words of the whole corpus, where no
source takes more than `most` times its own size; what is cut off is shared again by weight. Within a
source a document's expected copies go with the number of binary digits of its size (a document of
1,000 words, 10 digits, is expected 10/7 times as often as one of 100), up to `most`, at the level at
which expected words add up to the target. The whole part of that number is allocated for certain;
the fraction p is the document's inclusion probability. Documents get a random u from a hash of
seed, doc_id and text, and are ranked by odds(u) / odds(p), smallest first: documents of one source have
different p, so the odds decide. The sample's size is fixed in words: long documents first (over their
source's mean size; up to the words expected of them), then the short ones up to what is left of the
target, each time at the rank whose running total comes nearest. So a source misses its target by
about half a short document's size.

Plan. One pass counts words, and the choice works on narrow rows without texts. No source is
collected or ordered in one task: ranks are cut into bins, the bins' sums give the bin in
which the total is reached, that bin is cut again, three times by 128, and only what is left (a
two-millionth of a source) is ordered. What comes out is a limit for each source, a few bytes, and a
document's copies follow from its own rank and that limit: texts aren't shuffled. Sources meet their
limits in a join that Spark may broadcast by its size or split by skew. Targets and weights order the
sources themselves, a narrow row each.

Defined results. Null, empty or blank texts have size 0 and are taken 0 times. A null source is a
source like others, the last in order. Rows are units of their own. Repeats of one row have one rank; where
they stand at the limit, as many of them are taken as come nearest, and it doesn't matter which. Rows that agree in doc_id
and text but differ elsewhere are ordered by a hash of the whole row. If no text has a word every
target is 0. An empty table gives no rows. Other columns are carried whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, identity, load, numbered, pick, place, repeated

#: Bits of a rank, bits of it that one level of bins takes, and levels.
RANK, BITS, LEVELS = 52, 7, 3
UNIT = float(2**RANK)


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A whole number from 0 to 2**52 - 1: the first 13 hexadecimal digits of an md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, most: float = 3.0, weights: DataFrame | None = None) -> DataFrame:
    """(source, n, source_size, target) from (source, size). weights: (source, weight); else 1, 2, 3, repeating."""
    own = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    if weights is None:
        order = W.orderBy(F.col("source").asc_nulls_last())  # as many rows as there are sources
        own = own.withColumn("weight", (1 + (F.row_number().over(order) - 1) % 3).cast("double"))
    else:
        own = own.alias("o").join(weights.alias("w"), F.expr("o.source <=> w.source")).select("o.*", F.col("w.weight").cast("double").alias("weight"))
    # The fixed point of sharing again: sources are capped in ascending order of most * size / weight.
    own = own.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy()
    own = own.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    own = own.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return own.select("source", "n", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def _named(source: str) -> Column:
    """A source as a key that isn't null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def expected(sizes: DataFrame, goals: DataFrame, most: float, scratch: Scratch) -> DataFrame:
    """(group, digits, whole, p) from (group, digits, size) and (group, target): what is expected of documents of a
    size's number of digits. A row for each, so a window has as many rows as there are numbers of digits."""
    # written down, or Spark deals out the tasks' own sums by source
    by = scratch.cut(sizes.where("size > 0").groupBy("group", "digits").agg(F.sum("size").alias("words")), "digits").join(goals.select("group", "target"), "group")
    down = W.partitionBy("group").orderBy(F.desc("digits"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("digits")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    by = by.withColumn("level", (F.col("target") - most * above) / rest)
    # the longest documents that aren't at `most` yet set the level; without any, all are
    level = F.max(F.when(F.col("level") * F.col("digits") <= most, F.struct("digits", "level"))).over(W.partitionBy("group"))["level"]
    number = F.least(F.lit(float(most)), F.coalesce(level, F.lit(float(most))) * F.col("digits"))
    by = by.select("group", "digits", number.alias("number"))
    by = by.withColumn("number", F.when(F.abs(F.col("number") - F.round("number")) < 1e-9, F.round("number")).otherwise(F.col("number")))
    return by.select("group", "digits", F.floor("number").alias("whole"), (F.col("number") - F.floor("number")).alias("p"))


def rank_of(u: Column, p: Column) -> Column:
    """odds(u) / odds(p), q, as the whole number q / (1 + q) * 2**52, which has the same order."""
    x = (u + 0.5) / UNIT
    q = (x / (1 - x)) / (p / (1 - p))
    return F.least(F.floor(q / (1 + q) * UNIT), F.lit(2**RANK - 1)).cast("long")


def _limit(rows: DataFrame, goals: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(group, rank, a, b, m, r, got) from rows (group, rank, a, b, size) and (group, goal): rows before the limit are taken,
    and r of the m that stand at it; got is the words of these. Groups whose total stays below their goal have rank null."""
    at = goals.select("group", "goal", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("base"))
    every = rows.groupBy("group").agg(F.sum("size").alias("all")).join(goals, "group")
    short = every.where("all <= goal").select("group", "all")
    for level in range(1, LEVELS + 1):
        shift = RANK - BITS * level
        near = rows.join(at, "group").where(F.shiftright("rank", shift + BITS) == F.col("edge"))
        sums = scratch.cut(near.groupBy("group", "goal", "base", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words")), "bins")
        upto = F.sum("words").over(W.partitionBy("group").orderBy("bin"))  # 128 rows of a group at most
        sums = sums.withColumn("upto", F.col("base") + upto)
        edge = sums.where("upto > goal").groupBy("group").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("base"), "goal")).alias("e"))
        at = scratch.cut(edge.select("group", "e.goal", F.col("e.bin").alias("edge"), F.col("e.base").alias("base")), f"{name}{level}")
    near = rows.join(at, "group").where(F.shiftright("rank", shift) == F.col("edge"))
    ties = near.groupBy("group", "goal", "base", "rank", "a", "b", "size").agg(F.count("*").alias("m"))
    upto = F.sum(F.col("m") * F.col("size")).over(W.partitionBy("group").orderBy("rank", "a", "b"))
    ties = ties.withColumn("upto", F.col("base") + upto).where("upto > goal")
    ties = ties.groupBy("group").agg(F.min(F.struct("rank", "a", "b", "m", "size", "goal", "upto")).alias("t")).select("group", "t.*")
    before = F.col("upto") - F.col("m") * F.col("size")
    r = F.greatest(F.floor((F.col("goal") - before) / F.col("size") + 0.5), F.lit(0)).cast("long")
    ties = ties.select("group", "rank", "a", "b", "m", r.alias("r"), (before + r * F.col("size")).alias("got"))
    none = [F.lit(None).cast("long").alias(c) for c in ("rank", "a", "b", "m", "r")]
    return scratch.cut(ties.unionByName(short.select("group", *none, F.col("all").alias("got"))), name)


MEASURES = ("group", "source", "size", "digits", "u", "a", "b")


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """The columns of docs as _0, _1, .. and what the choice needs of them."""
    rows = numbered(docs)
    doc_id, text, source = (F.col(f"_{place(docs, c)}") for c in ("doc_id", "text", "source"))
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    a, b = identity(rows)
    rows = rows.select(*rows.columns, source.cast("string").alias("source"), size.alias("size"), draw(doc_id, text, seed).alias("u"), a.alias("a"), b.alias("b"))
    return rows.select("*", _named("source").alias("group"), F.length(F.bin("size")).alias("digits"))


class Mix:
    """Targets and limits of the sources of docs, and what follows from them for each row."""

    def __init__(self, docs: DataFrame, most: float, seed: int, weights: DataFrame | None):
        self.scratch = scratch = Scratch(docs.sparkSession, "mixing")
        self.rows = _measured(docs, seed)
        doc_id = F.col(f"_{place(docs, 'doc_id')}").alias("doc_id")
        self.narrow = scratch.cut(self.rows.select(doc_id, *MEASURES), "sizes")
        goals = targets(self.narrow.select("source", "size"), most, weights)
        self.goals = scratch.cut(goals.select(_named("source").alias("group"), "n", "source_size", "target"), "goals")
        self.hopes = scratch.cut(expected(self.narrow, self.goals, most, scratch), "expected")
        left = self.ranked(self.narrow).where("p > 0").select("group", "long", "rank", "a", "b", "size", "p", "source_size", "target")
        hoped = scratch.cut(left.groupBy("group", "long").agg(F.sum(F.col("size") * F.col("p")).alias("goal")), "hoped")
        longs = _limit(left.where("long"), hoped.where("long").select("group", "goal"), scratch, "long")
        goal = hoped.groupBy("group").agg(F.sum("goal").alias("goal")).join(longs.select("group", "got"), "group", "left")
        goal = scratch.cut(goal.select("group", (F.col("goal") - F.coalesce("got", F.lit(0))).alias("goal")), "goal")  # of known size, or documents are dealt by source
        shorts = _limit(left.where("NOT long"), goal, scratch, "short")
        both = longs.withColumn("long", F.lit(True)).unionByName(shorts.withColumn("long", F.lit(False)))
        scratch.only(self.narrow, self.goals, self.hopes, longs, shorts)
        self.limits = both.select("group", "long", *(F.col(c).alias(f"l_{c}") for c in ("rank", "a", "b", "m", "r")))

    def ranked(self, rows: DataFrame) -> DataFrame:
        """rows with n, source_size, target, whole, p, long and rank."""
        out = rows.join(self.goals, "group").join(self.hopes, ["group", "digits"], "left")
        out = out.withColumn("whole", F.coalesce(F.when(F.col("size") > 0, F.col("whole")), F.lit(0)).cast("long")).withColumn("p", F.coalesce(F.when(F.col("size") > 0, F.col("p")), F.lit(0.0)))
        out = out.withColumn("long", F.col("size") * F.col("n") > F.col("source_size"))
        return out.withColumn("rank", F.when(F.col("p") > 0, rank_of(F.col("u"), F.col("p"))))

    def placed(self, rows: DataFrame, *cols: str) -> DataFrame:
        """(cols, source_size, target, copies) of each of rows. Repeats at a limit are put together and told apart by number."""
        out = self.ranked(rows).join(self.limits, ["group", "long"], "left")
        own, limit = F.struct("rank", "a", "b"), F.struct("l_rank", "l_a", "l_b")
        split = F.coalesce((own == limit) & (F.col("l_r") > 0) & (F.col("l_r") < F.col("l_m")), F.lit(False))
        taken = (F.col("p") > 0) & (F.col("l_rank").isNull() | (own < limit) | ((own == limit) & (F.col("l_r") == F.col("l_m"))))
        given = [*cols, "source_size", "target"]
        apart = out.where(~split).select(*given, (F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")).alias("copies"))
        ties = self.limits.where("l_r > 0 AND l_r < l_m")
        if ties.isEmpty():
            return apart
        once = out.where(split).groupBy("group", "long").agg(F.first(F.struct(*given, "whole")).alias("row"), F.max("l_m").alias("m"), F.max("l_r").alias("r"))
        each = repeated(once, "m").select("row.*", "nth", "r").withColumn("copies", F.col("whole") + (F.col("nth") < F.col("r")).cast("long"))
        return apart.unionByName(each.select(*given, "copies"))


def copies(docs: DataFrame, most: float = 3, seed: int = 10, weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of docs (doc_id, text, source)."""
    mix = Mix(pick(docs, "doc_id", "text", "source"), most, seed, weights)
    return mix.placed(mix.narrow, "doc_id", "size").select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, most: float = 3, seed: int = 10, weights: DataFrame | None = None) -> DataFrame:
    """docs with each row as often as the mix takes it; rows that it doesn't take go."""
    mix, cols = Mix(docs, most, seed, weights), [f"_{i}" for i in range(len(docs.columns))]
    rows = mix.placed(mix.rows, *cols).where("copies > 0")
    return rows.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth")).select(*cols).toDF(*docs.columns)


def op10_mix(spark, sf_dir: str) -> DataFrame:
    """How often each document is taken for a mix of sources by weight 1, 2, 3."""
    return copies(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
