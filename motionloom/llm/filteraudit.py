"""Filter interaction audit: what each filter removes in every order of the filters, by decision diagrams.

A document's failures are a mask, a bit for each filter; of each part, masks are counted with three weights: documents,
those labelled good, and those labelled toxic. A decision diagram (Bryant 1986) over the filters is built of a part's
counts: a level for each filter, from each node an edge for documents that pass it and one for those that fail,
nodes of the same function put together, and weights at the leaves and, as sums, at all nodes. The way from the
root along passing edges is an order's run: the node that it reaches is what is kept so far, the failing child of
this node is what the next filter removes. Another order comes from swapping two adjacent levels, which changes
nodes of these two levels alone (Rudell 1993), and all orders from one swap each (Steinhaus, Johnson, Trotter).

Plan. One pass over the texts gives a narrow row for each document: part, digest of the text, failures that the
text alone decides. Labels meet these rows by doc_id. Rows of one digest, part, failures and labels are put together, in tasks
first, to their number and their smallest doc_id, so a hot text is a row for each task; a digest's smallest doc_id then says
which of them fail E. These counts are summed by part and mask, 2**filters rows a part at most, and a diagram is built for each part.

Defined results. A null text is an empty one, and a null part the part ''. A text is identical where its sha256 is. Rows with
a null doc_id have no labels, aren't smaller than any, and don't fail E. Rows repeated whole are documents by themselves, none
smaller than the other. Where a doc_id has several labels, one that says 1 decides. An empty table gives no rows. Other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, load, pick

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
Weights = tuple[int, int, int]


class Diagram:
    """A reduced diagram with a node on every level of each path. A node is a number; down[level] gives its children for pass and
    fail, weights its sums over all masks below it. Leaves stand on the level after the last."""

    def __init__(self, counts: dict[int, Weights], order: list[int]):
        self.order, self.weights = list(order), []
        self.down: list[dict[int, tuple[int, int]]] = [{} for _ in order]
        self.known: list[dict[tuple, int]] = [{} for _ in range(len(order) + 1)]
        self.counts = counts
        self.root = self._build(0, 0)

    def _leaf(self, w: Weights) -> int:
        at = self.known[-1].get(w)
        if at is None:
            at = self.known[-1][w] = len(self.weights)
            self.weights.append(w)
        return at

    def _node(self, level: int, low: int, high: int) -> int:
        at = self.known[level].get((low, high))
        if at is None:
            at = self.known[level][low, high] = len(self.weights)
            self.weights.append(tuple(a + b for a, b in zip(self.weights[low], self.weights[high], strict=True)))
            self.down[level][at] = (low, high)
        return at

    def _build(self, level: int, mask: int) -> int:
        if level == len(self.order):
            return self._leaf(self.counts.get(mask, (0, 0, 0)))
        return self._node(level, self._build(level + 1, mask), self._build(level + 1, mask | 1 << self.order[level]))

    def swap(self, level: int) -> None:
        """Exchanges two adjacent levels. Nodes of the upper one stay the functions that they are, so nothing above changes."""
        upper, lower = self.down[level], self.down[level + 1]
        self.order[level : level + 2] = self.order[level + 1], self.order[level]
        self.down[level + 1], self.known[level + 1], self.known[level] = {}, {}, {}
        for at, (low, high) in upper.items():
            (pp, pf), (fp, ff) = lower[low], lower[high]
            new = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            upper[at] = new
            self.known[level][new] = at

    def steps(self) -> Iterator[tuple[int, Weights, Weights]]:
        """Of each filter in this order, what is kept after it and what it removes."""
        at = self.root
        for level, f in enumerate(self.order):
            at, gone = self.down[level][at]
            yield f, self.weights[at], self.weights[gone]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of the swaps that lead through all orders of n things, one after another."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:  # the last thing runs through all places, then the others make a step
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # where the last thing stands first, the others are one place on
        down = not down


def audit_part(counts: dict[int, Weights], filters: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders and steps."""
    n = len(filters)
    diagram = Diagram(counts, list(range(n)))
    failing = [sum(w[0] for m, w in counts.items() if m >> f & 1) for f in range(n)]
    rows, shapley, alone = [], [0] * n, [0] * n

    def note() -> None:
        name = "".join(filters[f] for f in diagram.order)
        for step, (f, kept, gone) in enumerate(diagram.steps(), 1):
            rows.append((name, step, f, kept[0], gone))
            shapley[f] += gone[0]
            if step == n:  # what the last filter removes fails nothing else
                alone[f] = gone[0]

    note()
    for level in adjacent_swaps(n):
        diagram.swap(level)
        note()
    return [(name, step, kept, gone[0], failing[f] - gone[0], alone[f], gone[1], gone[2], shapley[f]) for name, step, f, kept, gone in rows]


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audit(filters: str, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        counts = {r["mask"]: (r["n"], r["good"], r["toxic"]) for r in table.to_pylist()}
        part = table["part"][0].as_py()
        rows = [(part, *r) for r in audit_part(counts, filters)]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """RESULT of (part, mask, good, toxic, n): n documents whose mask has bit k where filter k fails; good and toxic are booleans. A part's
    orders are the factorial of the filters' number, so these should be few."""
    if not 1 <= len(filters) <= 8:
        raise ValueError("one to eight filters")
    part = F.coalesce(F.col("part"), F.lit("")).alias("part")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = masks.groupBy(part, "mask").agg(F.sum("n").alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))
    return counts.groupBy("part").applyInArrow(_audit(filters, arrow_schema(RESULT)), RESULT)


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D of a text that isn't null: few words, repetitive, upper case, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    return [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def failures(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, mask, good, toxic, n) of docs (doc_id, text, lang), with labels (doc_id, quality, toxic)."""
    docs = pick(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("part"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    narrow = scratch.cut(docs.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("mask")), "narrow")
    one = F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    known = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*one)
    rows = narrow.where("doc_id IS NOT NULL").join(known.hint("merge"), "doc_id", "left")
    rows = rows.select("doc_id", "digest", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    kind = ("digest", "part", "mask", "good", "toxic")
    # dealt out by doc_id already, so this is no exchange; in the next step tasks put a hot text's rows together before they are dealt out
    each = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("m"))
    kinds = each.groupBy(*kind).agg(F.sum("m").alias("n"), F.min(F.struct("doc_id", "m")).alias("low"))
    kinds = scratch.cut(kinds.select(*kind, "n", F.col("low.doc_id").alias("low"), F.col("low.m").alias("m")), "kinds")
    first = kinds.groupBy("digest").agg(F.min("low").alias("first"))
    kinds = kinds.join(first.hint("merge"), "digest").withColumn("m", F.when(F.col("low") == F.col("first"), F.col("m")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("m").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("m")).alias("n")))).alias("s")
    known = kinds.select("part", "good", "toxic", split).select("part", "s.mask", "good", "toxic", "s.n").where("n > 0")
    none = narrow.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n"))
    return known.unionByName(none.select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n"))


def op12_filters(spark, sf_dir: str) -> DataFrame:
    """Five filters of all documents in all 120 orders, by language."""
    scratch = Scratch(spark, "filters")
    return audit(failures(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), scratch))
