"""Exact top-k search on a bit-sliced index (O'Neil & Quass 1997; Rinfret et al. 2001).

Each component of a vector, floor(64 * x), is an attribute; the index holds, for a block of rows and each bit of
each attribute (less the block's smallest value), a bitmap of the rows. A query adds attributes
times its own components by bitmap arithmetic: an attribute's slices enter at the places of the set
bits of the component's size, complemented where it is negative, and carry-save adders reduce all
slices of a place to one. What comes out are the slices of the scores, up to a constant. From the
most significant slice downward, rows are selected as long as no more than k are certain; rows
that tie at the boundary are resolved by exact score and vec_id.

Plan. Rows are packed into blocks of `cells` components by a hash, queries into blocks that are as large as
leaves each core some pairs, 8,192 queries at most. Row blocks are taken in chunks, as many to a chunk as leaves each core some, 256 at
most: a query block meets the row blocks of a chunk one after another in one task, which keeps the k best of each query so far. So
k rows a query and chunk meet in a window by query: queries x k x (row blocks / 256) from about 256 x 8 row blocks a core on. The stated query set
against all rows is the work that was asked for; what is sent is blocks of packed bytes, rows x query blocks. Repeats of one vector are put
together first, and only k of them go on, as a list holds no more.

Defined results. Vectors that are null or hold null or non-finite components take no part, nor do
rows with null vec_id. Vectors of different lengths are compared within equal lengths only. Any finite float has
its place: vectors with components of 2**31 or more in size go in blocks of their own, in whole numbers of
any size, and ranks are always by the exact score; a score that doesn't fit a long is given as the nearest long.
Repeated vec_ids are rows of their own; a query's own
row is every row of its vec_id, and a repeated query id gives its list once (of several vectors, the smallest asks). Ties go to the smaller
vec_id. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, load, partitions, pick

#: Components of a block of rows; fewest and most queries of a block; components from here on need whole numbers of any size.
CELLS, LEAST, MOST, LARGE = 1 << 21, 64, 8192, 2**31
#: Bytes of a score that doesn't fit a long.
WIDE = 300
#: Row blocks that one task takes for a query block, at most.
CHUNK = 256


class SlicedBlock:
    """Bitmaps of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        n, dims = self.rows.shape
        above = self.rows - self.rows.min(axis=0)
        bits = max(1, int(above.max(initial=0)).bit_length())
        self.bits, self.n, self.words = bits, n, -(-n // 64)
        slices = np.zeros((2, dims, bits, self.words * 8), np.uint8)
        for b in range(bits):
            packed = np.packbits((above >> b & 1).astype(np.uint8), axis=0, bitorder="little").T
            slices[0, :, b, : packed.shape[1]] = packed
        slices[1] = ~slices[0]
        self.slices = slices.view(np.uint64)
        every = np.zeros(self.words * 8, np.uint8)
        ones = np.packbits(np.ones(n, np.uint8), bitorder="little")
        every[: len(ones)] = ones
        self.every = every.view(np.uint64)

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the scores, least significant first, each less the same constant."""
        size, sign = np.abs(query), (query < 0).astype(np.int64)
        top = int(size.max(initial=0)).bit_length()
        places: list[list[np.ndarray]] = [[] for _ in range(top + self.bits + len(query).bit_length() + 1)]
        for t in range(top):
            dims = np.flatnonzero(size >> t & 1)
            if len(dims):
                picked = self.slices[sign[dims], dims]
                for b in range(self.bits):
                    places[t + b].append(picked[:, b])
        out = []
        for p, waiting in enumerate(places):
            x = np.concatenate(waiting) if waiting else np.zeros((1, self.words), np.uint64)
            while len(x) > 1:
                m = len(x) // 3
                if m:
                    a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                    ab = a ^ b
                    places[p + 1].append((a & b) | (c & ab))
                    x = np.concatenate([ab ^ c, x[3 * m :]])
                else:
                    places[p + 1].append((x[:1] & x[1:]))
                    x = x[:1] ^ x[1:]
            out.append(x[0])
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the k highest rows, without those whose id is the query's own."""
        some = self.every.copy()
        a, b = np.searchsorted(self.ids, [own, own + 1])
        for i in range(a, b):
            some[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure, tied = np.zeros(self.words, np.uint64), some
        if int(np.bitwise_count(some).sum()) > k:
            for s in reversed(self.scores(query)):
                with_bit = tied & s
                n = int(np.bitwise_count(sure | with_bit).sum())
                if n > k:
                    tied = with_bit
                else:
                    sure = sure | with_bit
                    tied = tied & ~s
                    if n == k:
                        tied = np.zeros_like(tied)
                        break
        else:
            sure, tied = some, np.zeros_like(some)
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little")[: self.n])
        more = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little")[: self.n])
        rows = np.concatenate([rows, more[: k - len(rows)]])  # rows of equal score, in order of vec_id
        found = self.rows[rows]
        if int(np.abs(found).max(initial=0)) * int(np.abs(query).max(initial=0)) * len(query) >= 2**63:
            found, query = found.astype(object), query.astype(object)
        return self.ids[rows], found @ query


def _pack(schema: pa.Schema):
    """A block's ids and components, each of as many bytes as the largest needs."""

    def run(table: pa.Table) -> pa.Table:
        ids, n = table["vec_id"].to_numpy(), table["n"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if table["large"][0].as_py():
            v = [int(x) for x in v.tolist()]
            width = max(9, max((x.bit_length() for x in v), default=0) // 8 + 1)
            raw = b"".join(x.to_bytes(width, "little", signed=True) for x in v)
        else:
            v = v.astype(np.int64)
            raw = v.astype(np.int16 if np.abs(v).max(initial=0) < 2**15 else np.int64).tobytes()
            width = len(raw) // max(len(v), 1)
        if len(ids):  # repeats
            rows = np.frombuffer(raw, np.uint8).reshape(len(ids), -1)
            ids, raw = np.repeat(ids, n), np.repeat(rows, n, axis=0).tobytes()
        cols = [table["dims"][:1], table["part"][:1], pa.array([width], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([raw], pa.binary())]
        return pa.Table.from_arrays([pa.chunked_array([c.combine_chunks()]) if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=schema)

    return run


def _unpack(width: int, ids: bytes, rows: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    if width in (2, 8):
        v = np.frombuffer(rows, np.int16 if width == 2 else np.int64).astype(np.int64)
    else:
        v = np.array([int.from_bytes(rows[i : i + width], "little", signed=True) for i in range(0, len(rows), width)], object)
    return ids, v.reshape(len(ids), dims)


def best(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of two lists of vec_ids and scores, ties to the smaller vec_id."""
    ids, scores = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(-scores[order], kind="stable")][:k]
    return ids[order], scores[order]


def _rows(asks: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    """The lists of these queries as rows; `wide` has the scores that a long doesn't hold, in bytes that sort like them."""
    ids, scores, wide = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for vec, score in lists:
        if score.dtype == object:
            far = [not -(2**63) < x < 2**63 - 1 for x in score]
            wide += [(x + 2 ** (8 * WIDE - 1)).to_bytes(WIDE, "big") if f else None for x, f in zip(score, far, strict=True)]
            score = np.array([max(-(2**63), min(2**63 - 1, x)) for x in score], np.int64)
        else:
            wide += [None] * len(score)
        ids.append(vec)
        scores.append(score)
    asks = np.repeat(asks, [len(vec) for vec, _ in lists])
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (asks, np.concatenate(ids), np.concatenate(scores))), pa.array(wide, pa.binary())], schema=schema)


def _search(k: int, schema: pa.Schema):
    """Pairs of a row block and a query block, those of one chunk in turn, to the k best rows of each query in the chunk."""

    def run(batches):
        now, asks, queries, lists = None, None, None, []
        for batch in batches:
            for dims, chunk, q, width, ids, rows, q_width, q_ids, q_rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (dims, chunk, q):
                    if now:
                        yield _rows(asks, lists, schema)
                    now = (dims, chunk, q)
                    asks, queries = _unpack(q_width, q_ids, q_rows, dims)
                    lists = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asks)
                block = SlicedBlock(*_unpack(width, ids, rows, dims))
                lists = [best(old, block.top(query, int(own), k), k) for old, own, query in zip(lists, asks, queries, strict=True)]
        if now:
            yield _rows(asks, lists, schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, cells: int = CELLS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, v) vectors of whole numbers, as longs or doubles: the k rows of highest
    inner product with each query."""
    scratch = Scratch(vectors.sparkSession, "topk")
    ddl = "dims int, part long, width int, ids binary, rows binary"
    large = F.exists("v", lambda c: F.abs(c.cast("double")) >= float(LARGE))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return scratch.cut(df.select("vec_id", "v", "n", F.size("v").alias("dims"), large.alias("large")), name)

    def packed(df: DataFrame, n: DataFrame, name: str) -> DataFrame:
        """n: for each dims how many parts rows of small and of large components make (a row for each length of vectors)."""
        salt = F.xxhash64("vec_id", "v")
        part = F.when(F.col("large"), F.col("small_parts") + F.pmod(salt, F.col("large_parts"))).otherwise(F.pmod(salt, F.col("small_parts")))
        rows = df.join(n.select("dims", "small_parts", "large_parts"), "dims").select("vec_id", "v", "n", "dims", "large", part.alias("part"))
        return scratch.cut(rows.groupBy("dims", "part").applyInArrow(_pack(arrow_schema(ddl)), ddl), name)

    parts = lambda amount, per, fewest: F.greatest(F.ceil(F.coalesce(amount, F.lit(0)) / per), F.lit(fewest)).alias
    own = counted(vectors.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("n")), "vectors")
    of_rows = own.groupBy("dims").agg(F.sum(F.when(~F.col("large"), F.col("n"))).alias("s"), F.sum(F.when(F.col("large"), F.col("n"))).alias("l"))
    # blocks of large components have many more slices, so fewer rows
    of_rows = of_rows.select("dims", parts(F.col("s") * F.col("dims"), cells, 1)("small_parts"), parts(F.col("l") * F.col("dims") * 16, cells, 1)("large_parts"))
    asking = counted(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("n", F.lit(1).cast("long")), "asking")
    of_asking = asking.groupBy("dims").agg(F.count_if(~F.col("large")).alias("s"), F.count_if("large").alias("l")).join(of_rows, "dims")
    size = F.least(F.greatest((F.col("s") + F.col("l")) * (F.col("small_parts") + F.col("large_parts")) / (8 * partitions(vectors.sparkSession)), F.lit(least)), F.lit(most))
    of_asking = of_asking.select("dims", parts(F.col("s"), size, 1)("small_parts"), parts(F.col("l"), size, 1)("large_parts"))

    rows = packed(own, of_rows, "rows")
    asked_packed = packed(asking, of_asking, "queries")
    asked = asked_packed.select("dims", F.col("part").alias("q"), *(F.col(c).alias(f"q_{c}") for c in ("width", "ids", "rows")))
    scratch.only(rows, asked_packed)
    # each chunk of row blocks meets each query block under a key of its own, so pairs spread over tasks
    counts = rows.groupBy("dims").agg(F.max("part").alias("last_part")).join(asked.groupBy("dims").agg(F.max("q").alias("last_q")), "dims")
    fair = F.floor((F.col("last_part") + 1) * (F.col("last_q") + 1) / (8 * partitions(vectors.sparkSession)))
    counts = counts.withColumn("chunk_size", F.least(F.greatest(fair, F.lit(1)), F.lit(CHUNK)))
    from_0 = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    each_q = rows.join(counts, "dims").select("dims", F.floor(F.col("part") / F.col("chunk_size")).alias("chunk"), from_0(F.col("last_q")).alias("q"), "width", "ids", "rows")
    each_chunk = asked.join(counts, "dims").select(*asked.columns, from_0(F.floor(F.col("last_part") / F.col("chunk_size"))).alias("chunk"))
    # rows of one key come one after another out of a merge join
    pairs = each_q.join(each_chunk.hint("merge"), ["dims", "chunk", "q"]).select("dims", "chunk", "q", "width", "ids", "rows", "q_width", "q_ids", "q_rows")
    ddl = "query_id long, vec_id long, score long, wide binary"
    found = pairs.mapInArrow(_search(k, arrow_schema(ddl)), ddl)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 highest inner products for every twentieth vector, against all others."""
    rows = pick(load(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double") * 64).alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("x").isNotNull() & F.col("vec_id").isNotNull() & fine)
    # beyond 2**52 a double is whole already
    vectors = rows.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)).alias("v"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))
