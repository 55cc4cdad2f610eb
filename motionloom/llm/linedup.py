"""Line dedup: a suffix array over sequences of line ids by distributed prefix doubling; the intervals of its longest
common prefixes reveal the repeated runs of lines, and later copies are deleted.

A run is `run` consecutive lines or more of one document that also start earlier, in an earlier
document (by doc_id) or further up in the same. One line is a run by itself if it has `words` words or more (parted by
spaces), or if it is all of its document; empty lines never are. All lines of a run's later copies go; what is judged is
the input, not what is left. Lines are what a newline separates.

Plan. A line's id is its md5; ids are written once, without the lines. Lines that occur once can't be in a repeated run and leave first. A suffix starts at each of the
others; its rank is the number of suffixes before all those that agree with it so far. A doubling step takes the suffixes
that aren't told apart yet and orders them, within their rank, by the rank of the suffix `width` lines on; so the common
prefix is twice as long after each step, until no run of lines repeats that is longer (as many steps as the longest
repeated run has binary digits). Distinct pairs of ranks are sorted in ranges and counted up range by
range, so no task sees all of them, and a hot pair costs a row for each task. The sorted suffixes meet their predecessors,
and their common prefix is measured from the longest step down, where ranks are equal. Where it is shorter than `run`
an interval ends; the first document and line of an interval stay, its other suffixes are later copies. Each step is
written to the shared folder. Positions of a hot line are joined to its one rank (skew join).

The longest run that a document has in common with another place, or with another part of itself, is the largest common prefix of its
suffixes.

Defined results. Null texts have no lines and stay null; an empty text is one empty line. Rows with a
null doc_id are left as they are. Rows of one doc_id are one document, with the text of smallest md5;
each row comes back with its result. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, load, one_each, partitions, spread

RUN, WORDS = 2, 50


def counted_up(rows: DataFrame, order: list[str], scratch: Scratch, weight: Column | None = None) -> DataFrame:
    """rows with `before`: how many rows, or how much weight, come before each of them in that order. Ranges are sorted and
    counted by themselves; only their totals, a row for each range, meet in one task."""
    cols = rows.columns
    t = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    t = scratch.cut(t.select(*cols, (F.lit(1) if weight is None else weight).cast("long").alias("_n"), F.monotonically_increasing_id().alias("_at")), "sorted")
    t = t.select(*cols, "_n", "_at", F.shiftright("_at", 33).alias("_range"))
    total = t.groupBy("_range").agg(F.sum("_n").alias("_n"))
    total = total.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_base"))
    if weight is None:
        own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        own = F.sum("_n").over(W.partitionBy("_range").orderBy("_at")) - F.col("_n")
    return t.withColumn("_own", own).join(total, "_range").select(*cols, (F.col("_base") + F.col("_own")).alias("before"))


def doubled(lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, pos, rank) of all positions of (doc, pos, id) whose line occurs more than once, in suffix order; and for k = 0, 1, ..
    the same of those whose next 2**k lines occur more than once, where equal ranks are equal lines."""
    again = lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    heads = counted_up(again, ["id"], scratch, F.col("n")).select("id", F.col("before").alias("rank"))
    now = scratch.cut(lines.join(heads, "id").select("doc", "pos", "rank"), "width")
    levels, done, width = [now], [], 1
    while True:
        every = now.select("doc", (F.col("pos") - width).alias("pos"), F.col("rank").alias("next"), F.lit(True).alias("open"))
        for d in done:
            every = every.unionByName(d.select("doc", (F.col("pos") - width).alias("pos"), F.col("rank").alias("next"), F.lit(False).alias("open")))
        # what comes next may be a line that occurs once, or nothing: these are told apart from all others
        pairs = now.join(every, ["doc", "pos"], "left").select("doc", "pos", "rank", F.coalesce("next", F.lit(-1)).alias("next"), F.coalesce("open", F.lit(False)).alias("open"))
        pairs = scratch.cut(pairs, "pairs")
        kinds = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.max("open").alias("open"))
        kinds = scratch.cut(counted_up(kinds, ["rank", "next"], scratch, F.col("n")), "kinds")
        first = kinds.groupBy("rank").agg(F.min("before").alias("first"))
        names = kinds.join(first, "rank").select("rank", "next", (F.col("rank") + F.col("before") - F.col("first")).alias("name"), (F.col("open") & (F.col("n") > 1)).alias("more"))
        after = scratch.cut(pairs.join(names, ["rank", "next"]).select("doc", "pos", F.col("name").alias("rank"), "more"), "width")
        scratch.drop(pairs, kinds)
        done.append(after.where("NOT more").drop("more"))
        now = after.where("more").drop("more")
        if now.isEmpty():
            break
        levels.append(now)
        width *= 2
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every, levels


def suffix_array(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(index, doc, pos, doc2, lcp) of the suffixes of (doc, pos, id) that start with a line which occurs more than once, in suffix
    order; lcp is the number of lines that a suffix has in common with the one before it, which is one of doc2."""
    every, levels = doubled(lines, scratch)
    order = scratch.cut(counted_up(every, ["rank", "doc", "pos"], scratch).select(F.col("before").alias("index"), "doc", "pos"), "order")
    last = order.select((F.col("index") + 1).alias("index"), F.col("doc").alias("doc2"), F.col("pos").alias("pos2"))
    pairs = scratch.cut(order.join(last, "index", "left").withColumn("lcp", F.lit(0)), "lcp")
    for k in reversed(range(len(levels))):
        a, b = (levels[k].select(F.col("doc").alias(f"d{x}"), F.col("pos").alias(f"p{x}"), F.col("rank").alias(f"r{x}")) for x in "ab")
        joined = pairs.join(a, F.expr("doc = da AND pos + lcp = pa"), "left").join(b, F.expr("doc2 = db AND pos2 + lcp = pb"), "left")
        longer = scratch.cut(joined.select("index", "doc", "pos", "doc2", "pos2", (F.col("lcp") + F.when(F.col("ra") == F.col("rb"), 1 << k).otherwise(0)).alias("lcp")), "lcp")
        scratch.drop(pairs)
        pairs = longer
    return pairs.select("index", "doc", "pos", "doc2", "lcp")


def longest_runs(array: DataFrame) -> DataFrame:
    """(doc, longest): the lines of the longest run of a document that also starts elsewhere, there or in another one. The suffix that has most in
    common with another stands beside it in the array, so both of two neighbours have their common prefix."""
    both = array.where("lcp > 0").select("lcp", F.explode(F.array("doc", "doc2")).alias("doc"))
    return both.groupBy("doc").agg(F.max("lcp").cast("long").alias("longest"))


def later_copies(array: DataFrame, run: int, scratch: Scratch) -> DataFrame:
    """(doc, pos) of the suffixes in intervals of common prefixes of `run` lines or more, but for the first of each interval."""
    near = counted_up(array, ["index"], scratch, (F.col("lcp") < run).cast("long"))
    near = scratch.cut(near.select("doc", "pos", (F.col("before") + (F.col("lcp") < run).cast("long")).alias("interval")), "intervals")
    # the first ones leave by their own place, so no large interval is joined to one row
    first = near.groupBy("interval").agg(F.min(F.struct("doc", "pos")).alias("first")).select("first.doc", "first.pos")
    return near.select("doc", "pos").join(first, ["doc", "pos"], "left_anti")


def removed_lines(docs: DataFrame, run: int, words: int, scratch: Scratch) -> DataFrame:
    """(doc, runs, longest): of each document that has a line in common with another place, its maximal removed runs as (first, last), in order, and
    the lines of its longest run that is elsewhere, too."""
    # three selects: what is asked of the array is asked below the explode, which then carries numbers alone from line to line
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("lines"))
    lines = lines.select("doc", (F.size("lines") == 1).alias("whole"), "lines").select("doc", "whole", F.posexplode("lines").alias("pos", "line"))
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    alone = (F.col("line") != "") & (F.col("whole") | (spaces >= words - 1))
    # written once, as what follows reads them three times and the texts are long
    lines = scratch.cut(lines.select("doc", "pos", F.unhex(F.md5("line")).alias("id"), alone.alias("alone")), "lines")
    array = scratch.cut(suffix_array(lines.drop("alone"), scratch), "array")
    gone = later_copies(array, run, scratch).withColumn("size", F.lit(run))
    if run > 1:
        single = later_copies(array, 1, scratch).join(lines.where("alone").select("doc", "pos"), ["doc", "pos"])
        gone = gone.unionByName(single.withColumn("size", F.lit(1)))
    gone = gone.groupBy("doc", "pos").agg(F.max("size").alias("size"))
    own = W.partitionBy("doc").orderBy("pos")  # positions of one document
    reach = F.max(F.col("pos") + F.col("size")).over(own.rowsBetween(W.unboundedPreceding, -1))
    islands = gone.withColumn("new", F.coalesce((F.col("pos") > reach).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(own))
    runs = islands.groupBy("doc", "island").agg(F.min("pos").alias("first"), (F.max(F.col("pos") + F.col("size")) - 1).alias("last"))
    runs = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    return longest_runs(array).join(runs, "doc", "left")


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, text, n_lines, runs, longest) for each row of docs: the text that is left, the runs that were removed, and the lines of the longest run that
    also starts elsewhere (0: none)."""
    scratch = Scratch(docs.sparkSession, "lines")
    own, again = one_each(docs)
    runs = scratch.cut(removed_lines(own, run, words, scratch), "runs")
    scratch.only(runs)
    # texts are dealt out by doc_id at every size: few runs would be broadcast, and what small inputs take of disk and time would say nothing of large ones
    rows = own.join(runs.hint("merge"), own["doc_id"] == runs["doc"], "left").select("doc_id", "text", F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")).alias("runs"), F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))
    # the lines between removed runs, as stretches, so the work goes with lines and runs and not with their product
    rows = rows.select("*", F.split("text", "\n").alias("lines"))
    run = lambda k: F.try_element_at("runs", k)
    gap = lambda k: F.slice("lines", F.coalesce(run(k)["last"] + 2, F.lit(1)), F.coalesce(run(k + 1)["first"], F.size("lines")) - F.coalesce(run(k)["last"] + 1, F.lit(0)))
    stay = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda k: F.when(k == 0, F.slice("lines", 1, run(F.lit(1))["first"])).otherwise(gap(k))))
    rows = rows.select("doc_id", F.when(F.size("runs") > 0, F.array_join(stay, "\n")).otherwise(F.col("text")).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), "runs", "longest")
    return spread(docs, rows) if again else rows


def op5_linedup(spark, sf_dir: str) -> DataFrame:
    """All documents without later copies of runs of two lines or more, or of one line of 50 words or all of a document."""
    out = dedup_lines(load(spark, sf_dir, "documents"))
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.select("doc_id", "n_lines", gone.alias("n_removed"), F.size("runs").cast("long").alias("n_runs"), F.col("longest").alias("longest_run"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))
