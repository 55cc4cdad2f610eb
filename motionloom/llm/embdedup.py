"""Embedding near-dedup: iterative quantisation (Gong & Lazebnik 2011), multi-index Hamming tables (Norouzi, Punjani & Fleet
2012), reranking by the original vectors, connected components.

Fit. On a bounded sample of unit vectors (about `sample`, by a hash, of each of the `fitted` commonest lengths), principal axes about
their mean and a rotation that is improved in turn with the signs it gives, so that bits are balanced and few projections lie near 0. Every vector gets
`bits` projections as whole numbers (units of 1/4096) and their signs as its code, in one pass.

Retrieve. Vectors of one label and code are a cell; a cell keeps the smallest size of each projection among its members. A code
is cut into tables of some bits, about the binary logarithm of the largest label's cells. In each table a cell stands at its own bits and
asks at all bits that its projections may have crossed. That loses nothing: two unit vectors with cosine c are
sqrt(2 - 2c) apart, so the projections where their signs differ have sizes whose squares sum to less than that squared; one of
both has at most half of it, and in one of the tables its share or less. So each cell asks, in each table, at every set of flipped
bits whose sizes stay within that share, and the cells of a pair meet in some table. Cells that meet pass on as a pair if their sizes allow
the cosine at all, which few do that aren't near.

Rerank. Members of a pair of cells are compared by cosine in double precision, in blocks of `block` members a side that are dealt out
each by itself, hot cells in many; a block gives the number of links of each member and edges that span its components, never
the links themselves. The same vectors of one label are put together before all this, and count by their number. What stays
quadratic is the work on members of cells that are near each other, whose links are counted exactly, and the pairs of cells of one
dense cloud that its codes split.

The fit touches speed alone: with any rotation links and components are the same. Measured against all pairs, recall is 1.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with nothing:
n_links 0, a component of their own, kept. Vectors of different lengths don't link. A null vec_id links with nothing, its
component is null, and it is kept. Rows of one vec_id are one vector, by the smallest hash of what they hold, and each comes back with its
result. Vectors are scaled by their largest component first, so any finite size is right. An empty table gives no rows. Other columns play
no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, load, pick
from .graph import components

#: Vectors that a rotation is fitted on, lengths that get one, bits of a code, members of a block, and rounds of the fit.
SAMPLE, FITTED, BITS, BLOCK, ROUNDS = 10_000, 16, 64, 256, 40
#: Projections are whole numbers of 1 / UNIT.
UNIT = 4096


def unit_vectors(flat: np.ndarray, n: int) -> np.ndarray:
    """Rows of length 1. Scaled by their largest component first, so that no square overflows or vanishes."""
    x = flat.astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_rotation(x: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): projections are (x - mean) @ axes, whose columns are orthonormal."""
    mean = x.mean(axis=0)
    c = x - mean
    bits = min(bits, x.shape[1])
    _, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, ::-1][:, :bits]
    p = c @ axes
    turn = np.linalg.qr(np.random.Generator(np.random.PCG64(13)).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(p @ turn >= 0, 1.0, -1.0).T @ p)
        turn = (u @ v).T
    return mean, axes @ turn


def _fit(bits: int, schema: pa.Schema):
    """The rotation of one length of vectors, from its bounded sample."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("cls")
        mean, axes = fit_rotation(unit_vectors(rows["v"].combine_chunks().flatten().to_numpy(), rows.num_rows), bits)
        return pa.Table.from_arrays([table["dims"].slice(0, 1), pa.array([mean.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(axes).tobytes()], pa.binary())], schema=schema)

    return run


def _coded(sent, bits: int, schema: pa.Schema):
    """Code and projections behind rows (dims, v, ..). Lengths without a rotation take their first components as they are."""

    def run(batches):
        turns = {d: (np.frombuffer(mean), np.frombuffer(axes).reshape(d, -1)) for d, mean, axes in sent.value}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            code, p = [b""] * len(dims), [None] * len(dims)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = unit_vectors(batch.column(1).take(pa.array(rows)).flatten().to_numpy(), len(rows))
                mean, axes = turns.get(d, (0.0, None))
                whole = np.rint((x[:, :bits] if axes is None else (x - mean) @ axes) * UNIT).astype(np.int16)
                signs = np.packbits(whole >= 0, axis=1, bitorder="little")
                for r, a, s in zip(rows.tolist(), whole, signs, strict=True):
                    code[r], p[r] = s.tobytes(), a
            cols = [*(batch.column(k) for k in range(2, batch.num_columns)), batch.column(0), pa.array(code, pa.binary()), pa.array(p, pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def reach(cosine: float, bits: int) -> float:
    """Squared distance of projections in whole units that a pair of that cosine can have: rounding moves each by half a unit at most
    and a sign by another."""
    return (UNIT * np.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 2 * np.sqrt(bits)) ** 2


def crossings(sizes: np.ndarray, most: float) -> np.ndarray:
    """All sets of bits, as masks, whose squared sizes sum to `most` or less; the empty one is first."""
    masks, sums = np.zeros(1, np.int64), np.zeros(1)
    square = sizes.astype(np.float64) ** 2
    for bit in np.argsort(square, kind="stable").tolist():
        if square[bit] > most:
            break
        more = sums + square[bit]
        fine = more <= most
        masks, sums = np.concatenate([masks, masks[fine] | 1 << bit]), np.concatenate([sums, more[fine]])
    return masks


def _signs(codes: list[bytes], bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")[:, :bits]


def table_bits(bits: int, tables: int) -> list[slice]:
    """The bits of each table, as equal in number as can be."""
    edges = [bits * t // tables for t in range(tables + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _places(cosine: float, width: int, schema: pa.Schema):
    """Of cells (dims, label, cell, code, low): where each stands (own) and asks, as (dims, label, spot, cell, own); spot is table and bits."""

    def run(batches):
        for batch in batches:
            for dims, label, cell, code, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, signs = np.array(low, np.int64), _signs([code], len(low))[0].astype(np.int64)
                parts = table_bits(len(low), max(min(3, len(low)), len(low) // width))
                most = reach(cosine, len(low)) / 2 / len(parts)
                spots = []
                for t, part in enumerate(parts):
                    here = int(signs[part] @ (1 << np.arange(part.stop - part.start)))
                    spots.append((crossings(sizes[part], most) ^ here) + (t << 32))
                own = np.concatenate([np.arange(len(x)) == 0 for x in spots])
                same = [pa.repeat(pa.scalar(x, schema.field(k).type), len(own)) for k, x in ((0, dims), (1, label), (3, cell))]
                yield pa.RecordBatch.from_arrays([same[0], same[1], pa.array(np.concatenate(spots), pa.int64()), same[2], pa.array(own)], schema=schema)

    return run


def _near(cosine: float, schema: pa.Schema):
    """Pairs of cells (a, b, their codes, their sizes) whose projections allow that cosine."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(4).value_lengths().to_numpy()
            keep = np.zeros(len(sizes), bool)
            for bits in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == bits)
                some = batch.take(pa.array(rows))
                apart = _signs(some.column(2).to_pylist(), bits) != _signs(some.column(3).to_pylist(), bits)
                low = sum(some.column(k).flatten().to_numpy().astype(np.float64).reshape(len(rows), bits) for k in (4, 5))
                keep[rows] = (low * low * apart).sum(axis=1) <= reach(cosine, bits)
            m = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(m) for k in (0, 1)], schema=schema)

    return run


def spanning(near: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links, the smallest index that each row reaches."""
    low = np.arange(len(near))
    while True:
        after = np.where(near, low[None, :], len(near)).min(axis=1, initial=len(near))
        after = np.minimum(low, after)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def _compare(cosine: float, schema: pa.Schema):
    """Of a block (cls, n, right, v): links of each member, weighted by copies, and the member that its component in the block starts with.
    With right members in it, each left one meets each right one; without, all members meet each other."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("right", "ascending"), ("cls", "ascending")])
        cls, n, right = (table[c].to_numpy(zero_copy_only=False) for c in ("cls", "n", "right"))
        x = unit_vectors(table["v"].combine_chunks().flatten().to_numpy(), len(cls))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        near |= near.T
        if right.any():
            near &= right[:, None] != right[None, :]
        links = near @ n
        root = cls[spanning(near)]
        some = links > 0
        return pa.Table.from_arrays([pa.array(cls[some]), pa.array(links[some]), pa.array(root[some])], schema=schema)

    return run


def rotations(same: DataFrame, bits: int, sample: int, fitted: int, scratch: Scratch) -> list[tuple]:
    """(dims, mean, axes) of the commonest lengths of (cls, dims, v), at most `fitted` of them and of 4,096 components."""
    lengths = same.groupBy("dims").agg(F.count("*").alias("many")).where("dims <= 4096").orderBy(F.desc("many"), "dims").limit(fitted)
    most = F.least(F.lit(sample), F.ceil(F.lit(1 << 24) / F.col("dims")))
    some = same.join(F.broadcast(lengths), "dims").where(F.pmod(F.xxhash64("cls", F.lit(5)), F.col("many")) < most)
    ddl = "dims int, mean binary, axes binary"
    rows = some.select("dims", "cls", "v").groupBy("dims").applyInArrow(_fit(bits, arrow_schema(ddl)), ddl).collect()
    return [(r.dims, bytes(r.mean), bytes(r.axes)) for r in rows]


def near_cells(coded: DataFrame, cosine: float, bits: int, width: int | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(dims, label, code, cell, k) of the cells of coded (cls, label, dims, code, p) with their members' number, and (a, b) of cells that may hold a pair,
    a the smaller one; a cell of several members is near itself."""
    smallest = [F.min(F.abs(F.get("p", F.lit(i)))).alias(f"_{i}") for i in range(bits)]
    cells = coded.groupBy("dims", "label", "code").agg(F.min("cls").alias("cell"), F.count("*").alias("k"), *smallest)
    low = F.filter(F.array(*(f"_{i}" for i in range(bits))), lambda x: x.isNotNull())
    cells = scratch.cut(cells.select("dims", "label", "cell", "code", "k", low.alias("low")), "cells")
    if width is None:
        many = cells.groupBy("dims", "label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        width = max(8, int(many).bit_length() + 2)
    # few tables ask at many places, many tables at crowded ones; three at least
    ddl = "dims int, label string, spot long, cell long, own boolean"
    places = scratch.cut(cells.select("dims", "label", "cell", "code", "low").mapInArrow(_places(cosine, width, arrow_schema(ddl)), ddl), "places")
    at = ["dims", "label", "spot"]
    stands = places.where("own").select(*at, F.col("cell").alias("b"))
    met = places.select(*at, F.col("cell").alias("a")).join(stands.hint("merge"), at).where("a <> b")
    met = scratch.cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    scratch.drop(places)
    held = cells.select("cell", "code", "low")
    both = met.join(held.toDF("a", "code_a", "low_a").hint("merge"), "a").join(held.toDF("b", "code_b", "low_b").hint("merge"), "b")
    ddl = "a long, b long"
    near = both.select("a", "b", "code_a", "code_b", "low_a", "low_b").mapInArrow(_near(cosine, arrow_schema(ddl)), ddl)
    near = near.unionByName(cells.where("k > 1").select(F.col("cell").alias("a"), F.col("cell").alias("b")))
    return cells.drop("low"), scratch.cut(near, "near")


def compared(members: DataFrame, cells: DataFrame, near: DataFrame, cosine: float, block: int, scratch: Scratch) -> DataFrame:
    """(cls, links, root) for each block in which a member of (cell, cls, n, v) has a link."""
    parts = cells.select("cell", F.ceil(F.col("k") / block).cast("int").alias("parts"))
    pairs = near.join(parts.toDF("a", "na").hint("merge"), "a").join(parts.toDF("b", "nb").hint("merge"), "b")
    pairs = scratch.cut(pairs, "pairs")
    own = members.join(parts.hint("merge"), "cell").select("cell", "cls", "n", "v", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts")).cast("int").alias("part"))
    one = F.col("a") == F.col("b")  # a cell with itself: each two of its parts once
    cols = ("a", "b", "i", "j", "right", "cls", "n", "v")
    left = pairs.join(own.withColumnRenamed("cell", "a").hint("merge"), "a").withColumn("i", F.col("part")).withColumn("right", F.lit(False))
    left = left.withColumn("j", F.explode(F.sequence(F.when(one, F.col("i")).otherwise(0), F.col("nb") - 1)))
    right = pairs.where(~one | (F.col("nb") > 1)).join(own.withColumnRenamed("cell", "b").hint("merge"), "b").withColumn("j", F.col("part")).withColumn("right", F.lit(True))
    right = right.where(~one | (F.col("j") > 0)).withColumn("i", F.explode(F.sequence(F.lit(0), F.when(one, F.col("j") - 1).otherwise(F.col("na") - 1))))
    ddl = "cls long, links long, root long"
    blocks = left.select(*cols).unionByName(right.select(*cols)).groupBy("a", "b", "i", "j")
    return scratch.cut(blocks.applyInArrow(_compare(cosine, arrow_schema(ddl)), ddl), "links")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, bits: int = BITS, sample: int = SAMPLE, fitted: int = FITTED, block: int = BLOCK, width: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label); see the module's text."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    plain = lambda c: c.cast("double") + 0.0  # noqa: E731  -0.0 is 0.0
    rows = pick(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", plain).alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    fine = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    own = rows.where("vec_id IS NOT NULL")
    if not own.groupBy("vec_id").count().where("count > 1").isEmpty():
        own = own.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v", "label"), "label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    own = own.where(fine).withColumn("dims", F.size("v")).withColumns({f"h{k}": F.xxhash64(F.lit(k), "label", "v") for k in (1, 2)})
    own = scratch.cut(own, "vectors")
    # vectors that are equal, with label, are a class with the smallest vec_id
    classes = own.groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n"))
    of = scratch.cut(own.select("vec_id", "h1", "h2").join(classes.hint("merge"), ["h1", "h2"]).select("vec_id", "cls", "n"), "of")
    same = scratch.cut(own.join(of.where("vec_id = cls").hint("merge"), "vec_id").select("cls", "n", "label", "dims", "v"), "classes")

    sent = spark.sparkContext.broadcast(rotations(same, bits, sample, fitted, scratch))
    ddl = "cls long, label string, dims int, code binary, p array<short>"
    coded = same.select("dims", "v", "cls", "label").mapInArrow(_coded(sent, bits, arrow_schema(ddl)), ddl)
    coded = scratch.cut(coded, "coded")
    cells, near = near_cells(coded, cosine, bits, width, scratch)
    # members of cells that are near something
    some = scratch.cut(near.select(F.col("a").alias("cell")).union(near.select(F.col("b").alias("cell"))).distinct(), "some")
    codes = scratch.cut(cells.join(some.hint("merge"), "cell").select("dims", "label", "code", "cell"), "codes")  # so that a hot cell can be split
    inside = coded.join(codes.hint("merge"), ["dims", "label", "code"]).select("cls", "cell")
    members = scratch.cut(inside.join(same.hint("merge"), "cls").select("cell", "cls", "n", "v"), "members")
    links = compared(members, cells, near, cosine, block, scratch)

    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    part = components(links.select(F.col("cls").alias("u"), F.col("root").alias("v")), scratch)
    known = of.join(counts.hint("merge"), "cls", "left").join(part.toDF("cls", "low").hint("merge"), "cls", "left")
    known = scratch.cut(known.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("low", "cls").alias("low")), "known")
    scratch.only(known)
    out = rows.select("vec_id").join(known.hint("merge"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op13_embdedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings of one label, at a cosine of 0.98."""
    return near_vectors(load(spark, sf_dir, "embeddings"))
