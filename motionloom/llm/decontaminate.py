"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Words are the runs [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z as a-z. The automaton (Blumer et al.
1985) of all items is streamed over each text: at every word it has the longest stretch of words,
ending there, that some item holds. A stretch of `window` words or more is an occurrence of windows
of those items; an item shorter than that counts when all of it occurs. Words that no item has reset
the automaton, so only runs of known words are streamed.

Plan. Items with equal words are one item with several ids. They are dealt out by a hash, and a task makes
automata of at most `most` words each, which it writes to the shared folder; the driver gets their paths
alone. A task over documents takes blocks of `block` bytes of text and streams each past one automaton
after another, so it holds one automaton and one block however large the benchmark is (a single automaton
stays loaded). An automaton's memory goes with its words and ids: items that end in a state are a stretch of one
array, not a set for each state. An item longer than `most` is cut into parts that overlap by window-1 words.
The ids of all copies of an item are listed by every row that holds it, as the result asks for them.

Defined results. Null, empty and wordless texts: no words, no hits. Rows are judged one by one, so
repeated rows, ties and null doc_ids are no special case. Items without words never occur; items
with null item_id mark words but aren't counted or listed. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.stores import opened
from .common import Scratch, arrow_schema, load, numbered, pick, place, small_batches

#: Words and ids of one automaton; bytes of text that pass the automata at a time.
MOST, BLOCK = 200_000, 16 << 20

#: A-Z to a-z; ASCII other than letters and digits to spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of sequences of words. After a word, `state` stands for the longest stretch
    that ends there; `found` gives the items whose windows end there and the longest such window."""

    def __init__(self, items: list[tuple[list[str], list[bytes], int]], window: int):
        """items: ids, words, and how many words of it make a window (its length, if that is less)."""
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int]] = []
        for number, (_, words, _) in enumerate(items):
            last = 0
            for w in words:
                last = self._add(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, number))
        # states in depth-first order of their links: the ends below a state are one stretch
        below: list[list[int]] = [[] for _ in self.len]
        for state in range(1, len(self.len)):
            below[self.link[state]].append(state)
        own: list[list[int]] = [[] for _ in self.len]
        for state, number in ends:
            if items[number][2] >= window:
                own[state].append(number)
        self.low, self.high, order, way = [0] * len(self.len), [0] * len(self.len), [], [0]
        while way:
            state = way.pop()
            if state < 0:
                self.high[~state] = len(order)
                continue
            self.low[state] = len(order)
            order += own[state]
            way.append(~state)
            way += below[state]
        self.ends = array("i", order)
        short: dict[int, list[tuple[int, int]]] = {}
        for number, (_, words, need) in enumerate(items):
            if 0 < need < window:
                s = 0
                for w in words:
                    s = self.next[s][self.ids[w]]
                short.setdefault(s, []).append((len(words), number))
        self.window, self.items = window, [x[0] for x in items]
        self.short = short
        self.least = min([window] + [x[2] for x in items if x[1]])

    def _add(self, p: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.len
        q = nxt[p].get(c)
        if q is not None:
            if size[p] + 1 == size[q]:
                return q
            return self._clone(p, c, q)
        cur = len(size)
        nxt.append({})
        size.append(size[p] + 1)
        link.append(0)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if size[p] + 1 == size[q] else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.len
        new = len(size)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, known: list[int], numbers: set[int], seen: set[int]):
        """(end, words) of the longest window-or-more stretch or whole short item that ends at each word. seen: states
        whose items are in numbers."""
        nxt, link, size, window, short = self.next, self.link, self.len, self.window, self.short
        s = length = 0
        for i, c in enumerate(known):
            while s and c not in nxt[s]:
                s = link[s]
                length = size[s]
            if c in nxt[s]:
                s = nxt[s][c]
                length += 1
            best = 0
            t, n = s, length
            if length >= window:
                best = length
                while size[link[t]] >= window:
                    t = link[t]
                if t not in seen:
                    seen.add(t)
                    numbers.update(self.ends[self.low[t] : self.high[t]])
                t = link[t]
                n = size[t]
            while short and t > 0:
                for size_of, number in short.get(t, ()):
                    if size_of <= n:
                        numbers.add(number)
                        best = max(best, size_of)
                t = link[t]
                n = size[t]
            if best:
                yield i, best


def united(spans: list[int], found: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted([*zip(spans[::2], spans[1::2], strict=True), *found]):
        if out and out[-1] >= a:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


@lru_cache(maxsize=1)
def loaded(path: str) -> Automaton:
    """The automaton of a file; a worker holds one at a time."""
    store, at = opened(path)
    with store.open_input_file(at) as f:
        out = Automaton.__new__(Automaton)
        vars(out).update(pickle.loads(zstandard.decompress(f.read())))
        return out


def _stream(paths: list[str], block: int, schema: pa.Schema):
    """Adds what the automata find to the columns spans, items and n_words, the first ones after the text; the others pass."""

    def found(texts: list[bytes | None]):
        words = [words_of(t or b"") for t in texts]
        spans, items = [[] for _ in texts], [set() for _ in texts]
        for path in paths:
            automaton = loaded(path)
            get, least = automaton.ids.get, automaton.least
            for k, own in enumerate(words):
                ids = np.array([get(w, -1) for w in own], np.int64)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
                numbers: set[int] = set()
                seen: set[int] = set()
                here: list[tuple[int, int]] = []
                for a, b in edge.reshape(-1, 2).tolist():
                    if b - a >= least:
                        for i, n in automaton.matches(ids[a:b].tolist(), numbers, seen):
                            here.append((a + i + 1 - n, a + i + 1))
                if here:
                    spans[k] = united(spans[k], here)
                    for n in numbers:
                        items[k].update(automaton.items[n])
        return spans, [sorted(x) for x in items], [len(w) for w in words]

    def run(batches):
        for batch in batches:
            texts, i = batch.column(0), 0
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, size[i] + block, "right")) - 1)
                part = batch.slice(i, j - i)
                spans, items, n_words = found(part.column(0).to_pylist())
                cols = [part.column(0), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(n_words, pa.int64())]
                cols += [part.column(k) for k in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                i = j

    return run


def _normal(batches):
    for batch in batches:
        words = [words_of(t or b"") for t in batch.column(1).to_pylist()]
        cols = [batch.column(0), pa.array([b" ".join(w) for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["item", "words", "n"])


def _build(folder: str, window: int, most: int, schema: pa.Schema):
    """Automata of a bucket of items, each of at most `most` words, as files."""

    def run(table: pa.Table) -> pa.Table:
        paths: list[str] = []
        store, root = opened(folder)
        store.create_dir(root, recursive=True)

        def write(group) -> None:
            name = f"{table['bucket'][0].as_py():06d}-{len(paths):04d}.automaton"
            temp = f"{root}/{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as f:
                f.write(zstandard.compress(pickle.dumps(vars(Automaton(group, window)), pickle.HIGHEST_PROTOCOL), 1))
            store.move(temp, f"{root}/{name}")
            paths.append(f"{folder}/{name}")

        group, total = [], 0
        for text, ids in sorted(zip(table["words"].to_pylist(), table["items"].to_pylist(), strict=True)):
            words = text.split()
            need, ids = min(window, len(words)), sorted(str(i) for i in ids)
            for part in [words[i : i + most] for i in range(0, max(len(words) - window + 1, 1), max(most - window + 1, 1))]:
                if group and total + len(part) + len(ids) > most:
                    write(group)
                    group, total = [], 0
                group.append((ids, part, need))
                total += len(part) + len(ids)
        write(group)
        return pa.Table.from_arrays([pa.array(paths)], schema=schema)

    return run


def automata(benchmark: DataFrame, window: int = 10, most: int = MOST) -> list[str]:
    """Writes the automata of all items, each of at most `most` words and ids, and returns their paths in order."""
    scratch = Scratch(benchmark.sparkSession, "automata")
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("binary").alias("text"))
    items = items.mapInArrow(_normal, "item long, words binary, n long").where("n > 0")
    items = scratch.cut(items.groupBy("words", "n").agg(F.collect_set("item").alias("items")), "items")  # nulls aren't collected
    total = items.agg(F.sum(F.col("n") + F.size("items"))).first()[0] or 0
    buckets = -(-2 * total // most)
    rows = items.withColumn("bucket", F.pmod(F.xxhash64("words"), F.lit(max(buckets, 1))))
    made = rows.groupBy("bucket").applyInArrow(_build(scratch.path("files"), window, most, arrow_schema("path string")), "path string")
    paths = sorted(r["path"] for r in made.collect())  # one for each automaton
    scratch.drop(items)
    return paths


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Columns _text (bytes), _spans (starts and ends of hit runs of words), _items (ids of occurring items, sorted as
    strings), _words and _hit (numbers of words), then the columns of docs as _0, _1, .. whatever their names."""
    small_batches(docs.sparkSession)
    rows = numbered(docs)
    more = [F.array().cast("array<int>").alias("_spans"), F.array().cast("array<string>").alias("_items"), F.lit(0).cast("long").alias("_words")]
    text = F.col(f"_{place(docs, 'text')}").cast("binary").alias("_text")
    out = rows.select(text, *more, *rows.columns).schema
    rows = rows.select(text, *rows.columns).mapInArrow(_stream(automata(benchmark, window, most), block, to_arrow_schema(out)), out)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("sign"))
    return rows.withColumn("_hit", F.aggregate("_spans", start, lambda s, x: F.struct((s.n + s.sign * x).alias("n"), (-s.sign).alias("sign")), lambda s: s.n))


def flags(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for each row of docs."""
    out = contamination(pick(docs, "doc_id", "text"), benchmark, window, most)
    return out.select(F.col("_0").alias("doc_id"), F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The texts without the given runs of words; null where there are none."""
    out = []
    for t, runs in zip(text, spans, strict=True):
        if not len(runs):
            out.append(None)
            continue
        t = bytes(t)
        at = [m.span() for m in re.finditer(rb"[^ ]+", t.translate(NORMAL))]
        last, kept = 0, []
        for a, b in zip(runs[::2], runs[1::2], strict=True):
            kept.append(t[last : at[a][0]])
            last = at[b - 1][1]
        out.append(b"".join([*kept, t[last:]]).decode("utf-8", "replace"))
    return pd.Series(out, dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5, most: int = MOST) -> DataFrame:
    """docs without contamination: a row with more than `coverage` of its words hit goes; of the others the hit
    runs are cut from the text (and n_chars, if there is one, is counted again). Clean rows stay as they are."""
    out = contamination(docs, benchmark, window, most).where(F.col("_hit") <= coverage * F.col("_words"))
    out = out.withColumn("_clean", F.pandas_udf(without, "string")("_text", "_spans"))
    cols = [F.col(f"_{i}") for i in range(len(docs.columns))]
    text = place(docs, "text")
    cols[text] = F.coalesce(F.col("_clean"), cols[text])
    if "n_chars" in docs.columns:
        at = place(docs, "n_chars")
        cols[at] = F.when(F.col("_clean").isNotNull(), F.length("_clean").cast(docs.schema.fields[at].dataType)).otherwise(cols[at])
    return out.select(*(c.alias(f"_{i}") for i, c in enumerate(cols))).toDF(*docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of benchmark items."""
    out = flags(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
