"""Fill-in-the-middle: a document's units (words of ASCII letters, and every other character by itself) are cut at two
ranks into prefix, middle and suffix, which are put in another order behind markers.

The cuts are found in an indexable skip list (Pugh 1990) over the document's units. Its lanes hold the units of a
height or more; every link carries two widths, the units and the code points that it passes over.
A search for a rank starts in the highest lane and goes down a lane where the next link would pass the rank: the
widths that it has gathered are the rank itself and the code points before it. Heights are coin flips of a hash of
the rank, so all documents share one pattern of lanes, and a search is some steps for each power of four.

Plan. One pass over the texts in tasks, without a shuffle; restoring is another pass over the output. A step works on 1 MB of
texts, or on one longer text, at about twenty times its bytes.

Defined results. A null text is an empty one: plain, with n = 0. Documents are cut by their doc_id, so repeated rows are cut
alike; null doc_ids by the text `1:null`. A text that holds a marker stays plain, so output and form give the text
back exactly. Texts are taken as UTF-8 bytes, of any length. An empty table gives no rows. Other columns play no part in
op11_fim and are carried by fill_in_middle(), whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import binary, load, mix, numbered, pick, place, steps

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents, how many are transformed, and how many of these have the suffix first.
CUT, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the units of texts begin, in bytes and in code points of all texts, each with the end of all; and the number of the
    first unit of each text."""
    lead = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    begin = lead.copy()
    begin[1:] &= ~(letter[1:] & letter[:-1])
    begin[offsets[:-1][np.diff(offsets) > 0]] = True  # no unit goes on from text to text
    starts = np.append(np.flatnonzero(begin), len(data))
    points = np.zeros(len(data) + 1, np.int32 if len(data) < 2**31 else np.int64)
    np.cumsum(lead, out=points[1:])
    return starts, points[starts], np.searchsorted(starts[:-1], offsets)


@lru_cache(maxsize=4)
def pattern(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each lane, from the lowest up: the ranks of its nodes below `size`, and where each stands in the lane below. Rank 0,
    before the first unit, is in all lanes; of other nodes a fourth goes on to the next lane."""
    dice = mix(np.arange(size, dtype=np.uint64) + np.uint64(1))
    ranks, out = np.arange(size), []
    down = ranks
    while True:
        out.append((ranks, down))
        up = (dice[ranks] & np.uint64(3)) == 0
        up[0] = True
        if len(ranks) == 1:
            return out
        down = np.flatnonzero(up)
        ranks = ranks[down]
        dice >>= np.uint64(2)
        if len(out) > 30:  # the hash is used up: the last lane holds rank 0 alone
            ranks, down = ranks[:1], down[:1]


class SkipList:
    """Ranks 0 to n of a text's units; points are their beginnings in code points and the end."""

    def __init__(self, points: np.ndarray):
        n = len(points) - 1
        self.lanes = []
        for ranks, down in pattern(1 << max(8, n.bit_length())):
            some = ranks[: np.searchsorted(ranks, n, "right")]
            self.lanes.append((np.diff(some), np.diff(points[some]), down))  # widths of the links in units and in code points
            if len(some) == 1:
                break

    def find(self, rank: int) -> tuple[int, int]:
        """The widths gathered on the way to a rank: units, which are the rank, and code points."""
        at = unit = point = 0
        for k in range(len(self.lanes) - 1, -1, -1):
            by_unit, by_point, down = self.lanes[k]
            while at < len(by_unit) and unit + by_unit[at] <= rank:
                unit += int(by_unit[at])
                point += int(by_point[at])
                at += 1
            if k:
                at = int(down[at])
        return unit, point


def dice(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits that the document's id decides."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[4 * i : 4 * i + 4], "big") for i in range(4))


def _transform(seed: int, cut: int, suffix_first: int, schema: pa.Schema):
    """(n, form, prefix_chars, middle_chars, output) in place of the first two columns, doc_id and text as bytes."""

    def run(batches):
        for batch in batches:
            data, offsets = binary(batch, batch.schema.names[1])
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i, j in steps(offsets):
                own = data[offsets[i] : offsets[j]]
                starts, points, first = units(own, offsets[i : j + 1] - offsets[i])
                for k in range(j - i):
                    a, b = int(first[k]), int(first[k + 1])
                    n, begin, end = b - a, int(offsets[i + k] - offsets[i]), int(offsets[i + k + 1] - offsets[i])
                    text = own[begin:end].tobytes()
                    h1, h2, h3, h4 = dice(ids[i + k], seed)
                    if not text or h3 % 100 >= cut or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                        rows.append((n, "plain", None, None, text))
                        continue
                    tower = SkipList(points[a : b + 1])
                    (low, before), (high, until) = (tower.find(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                    x, y = int(starts[a + low]) - begin, int(starts[a + high]) - begin
                    head, body, tail = text[:x], text[x:y], text[y:]
                    if h4 % 100 < suffix_first:
                        rows.append((n, "spm", before, until - before, b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, body))))
                    else:
                        rows.append((n, "psm", before, until - before, b"".join((PREFIX, head, SUFFIX, tail, MIDDLE, body))))
            cols = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(list(schema)[:5])]
            cols += [batch.column(c) for c in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def text_of(output: bytes, form: str) -> bytes:
    """The text of an output. Parts hold no marker, and none can begin in a part and end in a marker."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, _, rest = output[len(first) :].partition(second)
    b, _, body = rest.partition(MIDDLE)
    return a + body + b if form == "psm" else b + body + a


def _restore(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            text = pa.array([None if o is None else text_of(o, f) for o, f in rows], pa.binary())
            cols = [text, *(batch.column(c) for c in range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


NEW = "_n long, _form string, _prefix_chars long, _middle_chars long, _output binary"


def _cut(rows: DataFrame, doc_id: str, text: str, seed: int, cut: int, suffix_first: int) -> DataFrame:
    """The new columns before those of rows, whose names don't begin like theirs."""
    sent = rows.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_bytes"), *rows.columns)
    schema = rows.sparkSession.createDataFrame([], NEW).schema
    for f in rows.schema:
        schema = schema.add(f)
    return sent.mapInArrow(_transform(seed, cut, suffix_first, to_arrow_schema(schema)), schema)


def fill_in_middle(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output (a string) at the end."""
    rows = numbered(docs)
    out = _cut(rows, f"_{place(docs, 'doc_id')}", f"_{place(docs, 'text')}", seed, cut, suffix_first)
    new = [F.col("_n"), F.col("_form"), F.col("_prefix_chars"), F.col("_middle_chars"), F.col("_output").cast("string")]
    return out.select(*rows.columns, *new).toDF(*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output")


def restored(outputs: DataFrame) -> DataFrame:
    """The columns of outputs (output, form, ..), with the exact text as bytes before them; null where the output is."""
    rows = numbered(outputs)
    sent = rows.select(F.col(f"_{place(outputs, 'output')}").cast("binary").alias("_bytes"), F.col(f"_{place(outputs, 'form')}").alias("_form"), *rows.columns)
    schema = rows.sparkSession.createDataFrame([], "text binary").schema
    for f in rows.schema:
        schema = schema.add(f)
    return sent.mapInArrow(_restore(to_arrow_schema(schema)), schema).toDF("text", *outputs.columns)


def op11_fim(spark, sf_dir: str) -> DataFrame:
    """All documents cut for filling in the middle, as digests of the output and of the text that is made of it again."""
    out = fill_in_middle(pick(load(spark, sf_dir, "documents"), "doc_id", "text"))
    out = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", F.sha2("output", 256).alias("output_sha256"))
    return restored(out).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("text", 256).alias("restored_sha256"))
