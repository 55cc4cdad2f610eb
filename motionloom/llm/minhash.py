"""MinHash near-dedup: many universal hash minima, banding, signature verification, exact confirmation
on the full sets, and connected components by alternating large-star and small-star.

Plan. (1) One pass over the texts gives each document's set size, a 128-bit digest of its set, the
band keys and a one-byte-a-minimum signature. (2) Documents with equal sets are one class, and only
its smallest doc_id goes on, so a group of exact copies costs one row. (3) In each bucket (band, key)
two members are pivots, the one that meets most others in all its buckets and one by a hash, another in each band; every other
member is compared with them: twice as many pairs as members. Pairs whose signatures agree enough are confirmed on the full
sets. (4) Links give components. The buckets whose first pivot is the same make a group, as the buckets of one family mostly
do; a group of three members or more that still holds several components is open: its members outside
of its largest component are compared with all members, exactly, by an inverted index of full sets, in blocks of
`block` members or `cells` shingles a side that are dealt out each by itself; only links that join two components are kept. Groups
of the same members are compared once. So every pair that shares a bucket is compared or already in one component, no
cap is set, and no pair is written down that isn't a link. What an open group costs goes with its members times those outside of
its largest component; groups aren't joined to each other, however they overlap.

Of two sets with similarity s at least 0.85, the banding misses 1 in 5e7, at 0.8 4 in 1e6 (24 bands of 4 minima).
The signature test asks for 6 standard deviations below the limit (at 0.85: 60 of 96 minima agree), and what it turns down in (3)
is compared exactly in (4), unless the bucket has two members: there it misses 1 in 3e8 at the limit.

Defined results. Null doc_id: the row comes back with null component_id and kept true. Rows of one
doc_id are one document with the text of smallest md5; each row comes back with its result. Null, empty or blank
texts: n_shingles 0, a component of their own, kept. An empty table gives no rows. Other columns of
the input play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, binary, constants, load, mix, numbered, one_each, place, spread, steps, texts, word_hashes
from .graph import components

BANDS, ROWS = 24, 4
#: Members of an open group, and shingles of these, that one block holds on either side.
BLOCK, CELLS = 1024, 1 << 22


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    c = constants(7, words + 1)
    n = max(len(h) - words + 1, 0)
    full = np.zeros(n, np.uint64)
    for i in range(words):
        full += h[i : i + n] * c[i]
    full = mix(full)
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:  # the whole sequence is the one shingle
            out.append(mix((h[a:b] * c[: b - a]).sum(dtype=np.uint64, keepdims=True) + c[words : words + 1] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], k: int, seed: int) -> np.ndarray:
    """k minima of each set under universal hashes a*x+b; empty sets have the largest number."""
    a, b = constants(seed, k), constants(seed + 1, k)
    out = np.full((len(sets), k), np.uint64(0xFFFFFFFFFFFFFFFF))
    sizes = np.array([len(s) for s in sets], np.int64)
    i = 0
    some = np.flatnonzero(sizes)
    while i < len(some):
        j = i + 1
        total = sizes[some[i]]
        while j < len(some) and total + sizes[some[j]] <= 32768:
            total += sizes[some[j]]
            j += 1
        rows = some[i:j]
        x = np.concatenate([sets[r] for r in rows])
        starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        y = np.empty_like(x)
        for m in range(k):
            np.multiply(x, a[m], out=y)
            y += b[m]
            out[rows, m] = np.minimum.reduceat(y, starts)
        i = j
    return out


def _sketch(words: int, bands: int, rows: int, seed: int, schema: pa.Schema):
    def run(batches):
        fold = constants(seed + 2, rows)
        for batch in batches:
            data, offsets = binary(batch, "text")
            ids = batch.column(0)
            for i, j in steps(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                m = minima(sets, bands * rows, seed)
                keys = mix((m.reshape(len(sets), bands, rows) * fold).sum(axis=2, dtype=np.uint64))
                sig = (m >> np.uint64(40)).astype(np.uint8)
                sums = np.array([[s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s.copy())) if len(s) else 0] for s in sets], np.uint64).reshape(len(sets), 2)
                cols = [
                    ids.slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sums[:, 0].view(np.int64)),
                    pa.array(sums[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands), pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _pack(batches):
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        text = [z.compress(t or b"") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary())], names=["rep", "packed"])


def _set_of(packed: bytes, words: int) -> np.ndarray:
    text = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return shingle_sets(text, np.array([0, len(text)]), words)[0]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    least, most = sorted((len(a), len(b)))
    if not least or 100 * least < percent * most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (least + most - both)


def _confirm(words: int, percent: int):
    def run(batches):
        last, kept = None, None
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for a, pa_, pb in zip(u, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, kept = a, _set_of(pa_, words)
                ok.append(linked(kept, _set_of(pb, words), percent))
            m = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()).filter(m), pa.array(v, pa.int64()).filter(m)], names=["u", "v"])

    return run


def _across(words: int, percent: int, schema: pa.Schema):
    """Of a block of an open group, links between components: each left set meets all right sets by the rows that hold its shingles."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table["rep"].to_numpy(), table["component"].to_numpy()
        other, right = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("other", "right"))
        order = np.lexsort((ids, right))
        sets = [_set_of(x, words) for x in table["packed"].to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        left, right = order[~right[order]], order[right[order]]
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                x = p
            return x

        out = []
        if len(left) and len(right):
            grams = np.concatenate([sets[r] for r in right])
            owner = np.repeat(np.arange(len(right)), size[right])
            by = np.argsort(grams, kind="stable")
            grams, owner = grams[by], owner[by]
            for x in left.tolist():
                low, high = np.searchsorted(grams, sets[x]), np.searchsorted(grams, sets[x], "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(right))
                # two members outside the largest component meet twice: the smaller one asks
                near = (100 * both >= percent * (size[x] + size[right] - both)) & (comp[right] != comp[x]) & ((ids[right] > ids[x]) | ~other[x])
                for r in right[near].tolist():
                    a, b = top(int(comp[x])), top(int(comp[r]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((int(ids[x]), int(ids[r])))
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema)

    return run


def _joined(groups: DataFrame, part: DataFrame, own: DataFrame, reps: DataFrame, words: int, percent: int, block: int, cells: int, scratch: Scratch) -> DataFrame:
    """The components of part after the links across components of open groups (group, rep) are added."""
    placed = groups.join(part.select(F.col("node").alias("rep"), "component"), "rep", "left").select("group", "rep", F.coalesce("component", "rep").alias("component"))
    placed = scratch.cut(placed.join(reps.select("rep", "n_shingles").hint("merge"), "rep"), "placed")
    of_part = placed.groupBy("group", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("cells"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark"))
    kinds = of_part.groupBy("group").agg(F.sum("n").alias("n"), F.sum("cells").alias("cells"), F.sum("mark").alias("mark"), F.count("*").alias("parts"), F.max(F.struct("n", "component", "cells")).alias("top"))
    parts = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / cells)).cast("int")
    kinds = kinds.where("parts > 1 AND n > 2").select(
        "group", "n", "mark", F.col("top.component").alias("most"), parts(F.col("n"), F.col("cells")).alias("nl"), parts(F.col("n") - F.col("top.n"), F.col("cells") - F.col("top.cells")).alias("nr")
    )
    # of groups with the same members one is enough
    kinds = kinds.groupBy("n", "mark").agg(F.min(F.struct("group", "most", "nl", "nr")).alias("k")).select("k.*")
    kinds = scratch.cut(kinds, "open")
    if kinds.isEmpty():
        return part
    rows = scratch.cut(placed.join(kinds, "group").select("group", "rep", "component", (F.col("component") != F.col("most")).alias("other"), "nl", "nr"), "members")
    named = scratch.cut(rows.select(F.col("rep").alias("doc_id")).distinct(), "named")
    sets = texts(own).join(named, "doc_id").mapInArrow(_pack, "rep long, packed binary")
    sets = scratch.cut(sets, "sets")
    lefts = rows.select("*", F.lit(False).alias("right"), F.pmod(F.xxhash64("rep"), F.col("nl")).cast("int").alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"))
    rights = rows.where("other").select("*", F.lit(True).alias("right"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nr")).cast("int").alias("j")).select("*", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"))
    cols = ("group", "i", "j", "right", "rep", "component", "other")
    both = lefts.select(*cols).unionByName(rights.select(*cols)).join(sets.hint("merge"), "rep")
    more = scratch.cut(both.groupBy("group", "i", "j").applyInArrow(_across(words, percent, arrow_schema("u long, v long")), "u long, v long"), "more")
    if more.isEmpty():
        return part
    return components(part.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), scratch)  # stars already, but for what is new


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, cells: int = CELLS, seed: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; see the module's text."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    own, repeated = one_each(docs)
    agree = int(bands * rows * percent / 100 - 6 * (bands * rows * percent / 100 * (1 - percent / 100)) ** 0.5)
    ddl = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary"
    sketch = scratch.cut(texts(own).mapInArrow(_sketch(words, bands, rows, seed, arrow_schema(ddl)), ddl), "sketch")
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    kinds = some.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("r"))
    reps = scratch.cut(kinds.select("set_a", "set_b", "n_shingles", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands"), F.col("r.sig").alias("sig")), "reps")

    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    # joins of what grows with the input are merge joins at every size: a plan that broadcasts a small table costs another thing than it will
    inside = scratch.cut(banded.join(shared.hint("merge"), ["band", "key"]), "inside")
    met = inside.groupBy("rep").agg(F.sum("n").alias("met"))
    low = lambda *by: F.min_by("rep", F.struct(*by))
    pivots = inside.join(met.hint("merge"), "rep").groupBy("band", "key").agg(F.max_by("rep", F.struct("met", F.xxhash64("rep"))).alias("a"), low(F.xxhash64("rep", "band"), F.col("rep")).alias("b"))
    met = scratch.cut(inside.join(pivots.hint("merge"), ["band", "key"]).select("rep", "a", "b").distinct(), "met")
    groups = scratch.cut(met.select(F.col("a").alias("group"), "rep").distinct(), "groups")
    stars = met.select("rep", F.explode(F.array("a", "b")).alias("pivot")).where("rep <> pivot")
    stars = scratch.cut(stars.select(F.greatest("rep", "pivot").alias("u"), F.least("rep", "pivot").alias("v")).distinct(), "stars")

    signed = reps.select("rep", "sig")
    pairs = stars.join(signed.select(F.col("rep").alias("u"), F.col("sig").alias("su")).hint("merge"), "u").join(signed.select(F.col("rep").alias("v"), F.col("sig").alias("sv")).hint("merge"), "v")
    pairs = scratch.cut(pairs.mapInArrow(_agreeing(agree), "u long, v long"), "pairs")
    # written down, so that their size is known before texts are dealt out to meet them
    members = scratch.cut(pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct(), "members")
    packed = scratch.cut(texts(own).join(members, "doc_id").mapInArrow(_pack, "rep long, packed binary"), "packed")
    full = pairs.join(packed.select(F.col("rep").alias("u"), F.col("packed").alias("pu")).hint("merge"), "u").join(packed.select(F.col("rep").alias("v"), F.col("packed").alias("pv")).hint("merge"), "v").select("v", "u", "pv", "pu")
    links = scratch.cut(full.mapInArrow(_confirm(words, percent), "u long, v long"), "links")
    last = _joined(groups, components(links, scratch), own, reps, words, percent, block, cells, scratch)

    # A class and its documents.
    lowest = reps.select("set_a", "set_b", "n_shingles", "rep").join(last.select(F.col("node").alias("rep"), F.col("component").alias("low")), "rep", "left")
    lowest = lowest.select("set_a", "set_b", "n_shingles", F.coalesce("low", "rep").alias("low"))
    lowest = scratch.cut(lowest, "lowest")
    scratch.only(sketch, lowest)
    out = sketch.select("doc_id", "n_shingles", "set_a", "set_b").join(lowest, ["set_a", "set_b", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return spread(docs, out) if repeated else out


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id, and their columns whatever the names. Rows of one
    doc_id stay or go together; rows with null doc_ids stay."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select("doc_id").distinct()
    rows = numbered(docs)
    return rows.join(gone, rows[f"_{place(docs, 'doc_id')}"] == gone["doc_id"], "left_anti").toDF(*docs.columns)


def _agreeing(agree: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("su", "sv"))
            near = batch.filter(pa.array((a == b).sum(axis=1) >= agree))
            yield near.select(["u", "v"])

    return run


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity 0.85."""
    return near_duplicates(load(spark, sf_dir, "documents"), words=3, percent=85)
