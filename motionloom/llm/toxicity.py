"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes
log-count ratios (Wang & Manning 2012), trained on labelled text.

A feature is an n-gram (4 to 6 characters, A-Z as a-z) that a text has or hasn't. Training takes at
most `most` labelled texts, whole, and of either label at most `most_bytes` / 2; these are the bounds of the sample. The rarer label
goes first, up to half of them; within a label a hash of doc_id chooses, and texts longer than a 64th of `most_bytes` aren't learnt from
unless a label has no other: then its shortest is. So no label that there is ends without a text. The intercept is corrected for the
shares taken. N-grams of at least `least` texts of both labels together whose presence tells the labels
apart (a likelihood ratio above `gain`), for either label, become features, however many there are; where a label has few
texts, both limits shrink with it. The fit is a logistic regression with an
L2 penalty on presence times log-count ratio, by Newton steps until the gradient vanishes.

Plan. Tasks count the sample's n-grams: first in a table of 2**24 slots, a bound that most n-grams of too few texts fail, then those that
are left exactly, by groupBy. The features, with their ratios, go back to the tasks, and what one task fits is the numbers of the features that
each text has. Scoring passes once over the table, without a shuffle.

Defined results. Null and empty texts have no feature: they get the score of the intercept. Rows are
scored one by one, so repeated rows and null doc_ids are no special case (a null doc_id isn't held
out and isn't learnt from). Without labels of both kinds every score is the share of label 1 (0 if
there are none). Labels that are null or not 0 or 1 are not learnt from. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, arrow_schema, binary, constants, load, mix, numbered, partitions, pick, place, steps

GRAMS = (4, 5, 6)
#: Bits of the table that finds a feature's number from an n-gram's hash.
BITS = 22
#: Bits of the table that bounds n-grams' counts, tasks that make one, and how many n-grams are put together at a time.
NEAR, TASKS, MERGE = 24, 16, 1 << 21
#: Scores from here on are label 1.
NOT_TOXIC = 0.5


def gram_hashes(data: np.ndarray, offsets: np.ndarray):
    """For each n: the text's number and the hash of each n-gram of characters within it."""
    lead = (data & 0xC0) != 0x80  # first bytes of UTF-8 characters
    starts = np.flatnonzero(lead)
    if not len(starts):
        return
    size = np.diff(np.append(starts, len(data)))
    low = data[starts].astype(np.uint64)
    low += np.where((low >= 65) & (low <= 90), 32, 0).astype(np.uint64)
    for k in (1, 2, 3):
        more = size > k
        low[more] = (low[more] << np.uint64(8)) | data[starts[more] + k]
    doc = np.searchsorted(offsets, starts, "right") - 1
    c = constants(31, max(GRAMS) + 1)
    tags = c[-1:] * np.arange(max(GRAMS) + 1, dtype=np.uint64)
    char = mix(low)
    total = char * c[0]
    for n in range(2, max(GRAMS) + 1):
        if len(char) < n:
            return
        total = total[: len(char) - n + 1] + char[n - 1 :] * c[n - 1]
        if n in GRAMS:
            same = doc[: len(total)] == doc[n - 1 :]
            yield doc[: len(total)][same], mix(total[same] + tags[n])


def _pack(batches):
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [t or b"" for t in batch.column(2).to_pylist()]
        cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([z.compress(t) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "toxic", "size", "packed"])


def gram_parts(packed: bytes):
    """The n-grams of a text, in parts and with repeats."""
    text = np.frombuffer(zstandard.decompress(packed), np.uint8)
    for _, h in gram_hashes(text, np.array([0, len(text)])):
        yield h


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - NEAR)).astype(np.int64)


def _bound(batches):
    """Of the texts of a task, a table of how many have an n-gram of each slot, up to 255."""
    near = np.zeros(1 << NEAR, np.uint8)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            at = np.concatenate([np.zeros(0, np.int64), *map(slots, gram_parts(packed))])
            now = near[at]
            near[at] = np.where(now < 255, now + 1, now)  # however often a text has it
    yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(near.tobytes(), 1)], pa.binary())], names=["near"])


def _often(least: int):
    """The slots that `least` texts or more have, as bits, from the tables of all tasks."""

    def run(batches):
        near = np.zeros(1 << NEAR, np.uint16)
        for batch in batches:
            for table in batch.column(0).to_pylist():
                near += np.frombuffer(zstandard.decompress(table), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(near >= least).tobytes()], pa.binary())], names=["often"])

    return run


def _counts(often):
    """(gram, p, q): how many texts of label 1 and of label 0 have an n-gram, of those whose slot is often met; of a task's texts."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(often.value, np.uint8)).astype(bool)
        wait: list[tuple[np.ndarray, int]] = []

        def put_together() -> pa.RecordBatch:
            grams, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in wait)]), return_inverse=True)
            one = np.concatenate([np.zeros(0, np.int64), *(np.full(len(g), y) for g, y in wait)])
            p, n = np.bincount(at, one, len(grams)).astype(np.int64), np.bincount(at, minlength=len(grams))
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(p), pa.array(n - p)], names=["gram", "p", "q"])

        for batch in batches:
            for packed, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [h[bits[slots(h)]] for h in gram_parts(packed)]
                wait.append((np.unique(np.concatenate([np.zeros(0, np.uint64), *own])), y))
                if sum(len(g) for g, _ in wait) > MERGE:
                    yield put_together()
                    wait.clear()
        yield put_together()

    return run


def _held(features, schema: pa.Schema):
    """(id, toxic, cols): the numbers of the features that each text has."""

    def run(batches):
        keys = np.frombuffer(features.value, np.uint64)
        shift = np.uint64(64 - BITS)
        slot = np.zeros(1 << BITS, bool)
        slot[(keys >> shift).astype(np.int64)] = True
        for batch in batches:
            cols = []
            for packed in batch.column(2).to_pylist():
                found = [np.zeros(0, np.int64)]
                for h in gram_parts(packed) if len(keys) else ():
                    h = h[slot[h >> shift]]
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    found.append(at[keys[at] == h])
                cols.append(np.unique(np.concatenate(found)).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols, pa.binary())], schema=schema)

    return run


def least_loss(doc: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept at which the logistic loss and the weights' L2 penalty are least.

    Newton steps, each solved by conjugate gradients scaled by the diagonal, so neither the longest
    text nor the commonest feature sets their length. They end when the gradient is a millionth of
    the first one, or when no part of a step lowers the loss any more (the limit of floating point).
    """
    w = np.append(np.zeros(size), np.log(y.sum() / (len(y) - y.sum())))  # the intercept is last
    scores = lambda v: v[-1] + np.bincount(doc, value * v[col], len(y))
    loss = lambda v, s: np.logaddexp(0, s).sum() - y @ s + penalty / 2 * (v[:-1] @ v[:-1])
    now, first = scores(w), None
    while True:
        p = 1 / (1 + np.exp(-np.clip(now, -40, 40)))
        grad = np.append(np.bincount(col, value * (p - y)[doc], size) + penalty * w[:-1], (p - y).sum())
        norm = np.linalg.norm(grad)
        first = norm if first is None else first
        if norm <= 1e-6 * first:
            break
        h = p * (1 - p)
        diag = np.append(np.bincount(col, value**2 * h[doc], size) + penalty, h.sum())
        step, left = np.zeros(size + 1), -grad
        way = left / diag
        rho, goal = left @ way, min(0.1, (norm / first) ** 0.5) * norm
        while np.linalg.norm(left) > goal:
            turn = h * scores(way)
            turn = np.append(np.bincount(col, value * turn[doc], size) + penalty * way[:-1], turn.sum())
            part = rho / (way @ turn)
            step, left = step + part * way, left - part * turn
            rho, old = left @ (left / diag), rho
            way = left / diag + rho / old * way
        move, before, part = scores(step), loss(w, now), 1.0
        while part > 1e-10 and not loss(w + part * step, now + part * move) < before:
            part /= 2
        if part <= 1e-10:
            break
        w, now = w + part * step, now + part * move
    return w[:-1], float(w[-1])


def _fit(ratios, penalty: float):
    """One task over the bounded sample: the intercept and the features' weights."""

    def run(batches):
        rows = sorted((i, y, c) for b in batches for i, y, c in zip(*(c.to_pylist() for c in b.columns), strict=True))
        r, y = np.frombuffer(ratios.value), np.array([x[1] for x in rows], np.float64)
        held = [np.frombuffer(x[2], "<i4") for x in rows]
        doc, col = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held]), np.concatenate(held)
        w, bias = least_loss(doc, col, r[col], y, len(r), penalty)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([(w * r).tobytes()], pa.binary())], names=["bias", "weights"])

    return run


def learnt_from(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int, scratch: Scratch) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """(id, toxic, packed) of the sample, how many documents have each label, and the share of these that is in the sample."""
    own = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    own = scratch.cut(own.groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    have = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    take = {k: min(have[k], max(most - have[1 - k], most // 2)) for k in have}
    zero, one = (own.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(take[k]) for k in (0, 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(zero.unionByName(one)), "id").select("id", "toxic", "text")
    every = scratch.cut(rows.mapInArrow(_pack, "id long, toxic int, size long, packed binary"), "every")
    sizes = every.groupBy("id", "toxic").agg(F.max("size").alias("size"))
    # as many rows as the sample has
    long = F.col("size") > most_bytes // 64
    by = W.partitionBy("toxic").orderBy(long, F.when(long, F.col("size")), F.xxhash64("id"), "id")
    fits = (~long & (F.sum("size").over(by) <= most_bytes / 2)) | (F.row_number().over(by) == 1)
    fits = scratch.cut(sizes.withColumn("fits", fits).select("id", "toxic", "fits"), "fits")
    got = {r["toxic"]: r for r in fits.groupBy("toxic").agg(F.count_if("fits").alias("n"), F.avg(F.col("fits").cast("double")).alias("share")).collect()}
    share = {k: take[k] / have[k] * got[k]["share"] for k in got if have[k]}
    # repeated rows are learnt from once
    sample = every.join(F.broadcast(fits.where("fits").select("id")), "id").groupBy("id", "toxic").agg(F.min("packed").alias("packed"))
    return scratch.cut(sample, "sample"), {k: r["n"] for k, r in got.items()}, share


def train(docs: DataFrame, labels: DataFrame, most: int = 6000, least: int = 8, gain: float = 10.0, penalty: float = 2.0, most_bytes: int = 32 << 20) -> tuple[float, bytes, bytes]:
    """Intercept, hashes of the features and their weights. labels: doc_id and toxic, already without held-out rows.

    At most `most` labelled documents are fitted: of the rarer label all, or as many as half of `most`
    where both labels have more, and of the other as many as are left; each time those of smallest
    xxhash64(doc_id), as long as the texts of one label make no more than half of `most_bytes`. So the rows that are
    broadcast, and what the one fitting task holds, have these bounds.
    """
    spark = docs.sparkSession
    scratch, send = Scratch(spark, "toxicity"), spark.sparkContext.broadcast
    sample, n, share = learnt_from(pick(docs, "doc_id", "text"), labels, most, most_bytes, scratch)
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        scratch.only()
        return 40.0 if n1 else -40.0, b"", b""
    limit = max(2, min(least, -(-min(n1, n0) // 10)))  # texts that an n-gram needs: no more than a tenth of the rarer label
    dealt = sample.repartition(min(TASKS, partitions(spark)), "id")
    often = dealt.select("packed").mapInArrow(_bound, "near binary").repartition(1).mapInArrow(_often(limit), "often binary").first()[0]
    counts = dealt.select("packed", "toxic").mapInArrow(_counts(send(bytes(often))), "gram long, p long, q long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    # the likelihood ratio of presence, against that of an n-gram which all texts of one label have and no other
    part = lambda k, of, share: F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)
    p, q, has = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / (n0 + n1)
    ratio = 2 * (part(p, n1, has) + part(q, n0, has) + part(n1 - p, n1, 1 - has) + part(n0 - q, n0, 1 - has))
    best = 2 * (n1 * math.log((n0 + n1) / n1) + n0 * math.log((n0 + n1) / n0))
    kept = counts.where((p + q >= limit) & (ratio >= min(gain, best / 2)))
    kept = scratch.cut(kept.select("gram", F.log(((p + 1) / (n1 + 2)) / ((q + 1) / (n0 + 2))).alias("r")), "features").toPandas()  # of the sample's n-grams, so bounded with it
    grams = kept["gram"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(grams)
    keys, ratios = grams[by].tobytes(), kept["r"].to_numpy(np.float64)[by].tobytes()
    ddl = "id long, toxic int, cols binary"
    held = scratch.cut(dealt.select("id", "toxic", "packed").mapInArrow(_held(send(keys), arrow_schema(ddl)), ddl), "held")
    got = held.repartition(1).mapInArrow(_fit(send(ratios), penalty), "bias double, weights binary").first()
    scratch.only()
    # of each label another share was taken: back to the labels' own odds
    return got["bias"] + math.log(share[0]) - math.log(share[1]), keys, bytes(got["weights"])


def _score(sent, schema: pa.Schema):
    """Adds the score to the columns of a batch, whose first is the text as bytes."""

    def run(batches):
        bias, keys, weights = sent.value
        feature, weight = np.frombuffer(keys, np.uint64), np.frombuffer(weights, np.float64)
        shift = np.uint64(64 - BITS)
        slot = np.zeros(1 << BITS, bool)
        slot[(feature >> shift).astype(np.int64)] = True
        for batch in batches:
            data, offsets = binary(batch, batch.schema.names[0])
            score = np.full(batch.num_rows, bias)
            if len(feature):
                for i, j in steps(offsets, 1 << 19):
                    for doc, h in gram_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                        likely = np.flatnonzero(slot[h >> shift])
                        doc, h = doc[likely], h[likely]
                        at = np.searchsorted(feature, h)
                        at[at == len(feature)] = 0
                        hit = feature[at] == h
                        pair = np.unique(doc[hit] * len(feature) + at[hit])
                        score[i:j] += np.bincount(pair // len(feature), weight[pair % len(feature)], j - i)
            p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
            cols = [pa.array(p), *(batch.column(i) for i in range(1, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _scores(docs: DataFrame, model: tuple[float, bytes, bytes]) -> DataFrame:
    """The columns of docs as _0, _1, .. and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # no more than the n-grams of `most_bytes` of text
    rows = numbered(docs)
    rows = rows.select(F.col(f"_{place(docs, 'text')}").cast("binary").alias("score"), *rows.columns)
    out = rows.withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(_score(sent, to_arrow_schema(out)), out).select(*rows.columns[1:], "score")


def scored(docs: DataFrame, model: tuple[float, bytes, bytes]) -> DataFrame:
    """docs with one more column at the end, _score."""
    return _scores(docs, model).toDF(*docs.columns, "_score")


def accepted(docs: DataFrame, model: tuple[float, bytes, bytes], below: float = NOT_TOXIC) -> DataFrame:
    """The rows of docs that score below the limit, with their columns whatever the names."""
    return _scores(docs, model).where(F.col("score") < below).drop("score").toDF(*docs.columns)


def held_out(column: str) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; a fifth of the labels is never learnt from."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id")))
    out = scored(pick(docs, "doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= NOT_TOXIC).cast("int").alias("predicted"))
