"""Suffix-array dedup of byte strings by two-stage suffix sorting (Itoh & Tanaka 1999).

A byte of a document goes if a string of `size` bytes that covers it also starts in a document of smaller
doc_id; matches don't cross documents, and the input is judged, not what is left.

Plan. Windows of `size` bytes are dealt out by content: a window's key is the least hash of its GRAM-byte
substrings, so equal windows have equal keys, and neighbouring windows mostly share one (a segment).
(1) Texts are packed and dealt to parts by doc_id, once. Each part sends its distinct keys, a few bytes
each, to buckets; a bucket sends back to each part the keys that several documents have. (2) Each
part finds its segments under such keys. Segments that several of its documents have are sorted
as in (3), each once; what that finds is removed there and then, and only those of the smallest doc_id go on. Segments go, with their
text, to buckets by key. (3) A bucket puts equal segments together and sorts the suffixes of all
segments whose key several documents have, equal ones once: suffixes smaller than their successors are sorted
directly, to a depth beyond `size`, the rest is induced by bucket scans; adjacent common prefixes
give the intervals of equal windows, and the least doc_id of an interval keeps its bytes. (4) The
parts cut what was found from their texts.
So a passage that a third of all documents hold costs a row for each part, not for each document. What
is equal is found by a hash and then compared byte for byte, so that the sort sees it once; texts that only share the hash go to the
sort as different ones. What is removed comes from the sort's intervals alone.
The edges of such a passage differ in all documents: a key of more than HOT documents is split, each
window going on by itself under a hash of all its bytes. That limit changes the plan and no result.
A part sends a packed row to each bucket that it has keys for, so rows are as many as parts x buckets (a bucket for eight parts),
and never more than keys, one for 16 bytes of text: in proportion to the input from about 30 TB on.

Defined results. Null and empty texts: nothing to remove. Rows with a null doc_id are left as they are
and aren't compared. Rows of one doc_id are one document, with the text of smallest md5; each row
comes back with its result. Texts are judged as UTF-8 bytes, so a cut can fall within a character.
An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, constants, load, mix, one_each, partitions, spread

GRAM = 20
HOT = 4096
PART_BYTES = 8 << 20
_ROLL = constants(91, 256)


def window_keys(data: np.ndarray, size: int) -> np.ndarray:
    """The key of the window that starts at each byte (as many as len(data) - size + 1), 48 bits."""
    h, width = _ROLL[data], 1
    base = int(constants(92, 1)[0])

    def power(n: int) -> np.uint64:
        return np.uint64(pow(base, n, 1 << 64))

    single = h
    for bit in bin(GRAM)[3:]:
        h = h[:-width] * power(width) + h[width:]
        width *= 2
        if bit == "1":
            h = h[:-1] * power(1) + single[width:]
            width += 1
    h = mix(h)
    span, done = size - GRAM + 1, 1
    while done < span:
        step = min(done, span - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return mix(h) >> np.uint64(16)


class Part:
    """Texts of a part one after another, and their segments: runs of windows with one key in one text."""

    def __init__(self, packed: list[bytes], size: int):
        z = zstandard.ZstdDecompressor()
        texts = [z.decompress(p) for p in packed]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        del texts
        n = len(self.data) - size + 1
        if n <= 0:
            self.first = self.count = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        starts, counts, docs, keys = [], [], [], []
        for d in range(len(self.offsets) - 1):
            a, b = int(self.offsets[d]), int(self.offsets[d + 1]) - size + 1
            if b <= a:
                continue
            # long texts in pieces, which overlap by what a window needs
            for lo in range(a, b, 1 << 20):
                hi = min(b, lo + (1 << 20))
                k = window_keys(self.data[lo : hi + size - 1], size)
                at = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
                starts.append(at + lo)
                counts.append(np.diff(np.append(at, hi - lo)))
                keys.append(k[at])
                docs.append(np.full(len(at), d))
        self.first, self.count, self.doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, counts, docs))
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each stretch of equal numbers."""
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True)) if len(x) else []


def bytes_of(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after another."""
    if not len(first):
        return np.zeros(0, np.uint8)
    ends = np.cumsum(length)
    at = np.ones(int(ends[-1]), np.int64)
    at[0] = first[0]
    at[ends[:-1]] = first[1:] - (first[:-1] + length[:-1]) + 1
    return data[np.cumsum(at)]


def hashes_of(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each of the consecutive stretches of data."""
    if not len(length):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(starts, length)
    return mix(np.add.reduceat(_ROLL[data] * constants(93, int(length.max()))[place], starts) + length.astype(np.uint64))


def as_before(data: np.ndarray, first: np.ndarray, length: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which of the ranges marked in `same` have byte for byte what the range before them has."""
    rows = np.flatnonzero(same)
    rows = rows[length[rows] == length[rows - 1]]
    out, upto, i = np.zeros(len(same), bool), np.cumsum(length[rows]), 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + (4 << 20), "right")))
        some = rows[i:j]
        equal = bytes_of(data, first[some], length[some]) == bytes_of(data, first[some - 1], length[some])
        out[some] = np.logical_and.reduceat(equal, np.cumsum(length[some]) - length[some])
        i = j
    return out


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers as zstandard of their bytes, place by place: small numbers then cost little."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_numbers(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def runs_of(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of documents, those that touch or overlap put together."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    if not len(doc):
        return doc, first, last
    base = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (int(last.max()) + 2)
    reach = np.maximum.accumulate(last + base)
    new = np.append(True, (first + base)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], first[at], np.maximum.reduceat(last, at)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a text of bytes 1.. with ends marked 0, in order of their first `depth` bytes at least (up to
    the first 0). Two-stage: suffixes smaller than their successors are sorted directly, the others induced."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    nearest = np.searchsorted(change, np.arange(n))
    after = np.where(nearest < len(change), text[np.minimum(change[np.minimum(nearest, max(len(change) - 1, 0))] + 1, n - 1)] if len(change) else 0, 0)
    direct = (after > text) & (text > 0)
    induced = (text > 0) & ~direct
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    word = np.zeros(n + 8, np.uint64)
    word[:n] = text
    done = 1
    while done < 8:  # eight bytes from each place on
        word[: len(word) - done] = (word[: len(word) - done] << np.uint64(8 * done)) | word[done:]
        done *= 2
    short = np.flatnonzero(left < 8)
    word[short] &= ~((np.uint64(1) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))) - np.uint64(1))
    word[ends] = 0

    def words(at: np.ndarray, k: int) -> np.ndarray:
        ok = left[at] > 8 * k
        return np.where(ok, word[np.where(ok, at + 8 * k, 0)], 0)

    order = np.flatnonzero(direct)
    order = order[np.argsort(word[order], kind="stable")]
    group = np.cumsum(np.append(False, word[order][1:] != word[order][:-1])) if len(order) else order
    for k in range(1, -(-depth // 8)):
        same = np.append(False, group[1:] == group[:-1])
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        w = words(order[tied], k)
        inner = np.lexsort((w, group[tied]))
        order[tied], w = order[tied][inner], w[inner]
        g = group[tied]  # ascending, and the sort keeps groups in place
        split = np.zeros(len(order), np.int64)
        split[tied[1:]] = (w[1:] != w[:-1]) & (g[1:] == g[:-1])
        group = group + np.cumsum(split)
    counts = np.bincount(text, minlength=257)
    start = np.cumsum(counts) - counts
    head = start.copy()
    out = np.zeros(n, np.int64)
    n_direct = np.bincount(text[direct], minlength=257)
    tail = start + counts - n_direct
    offset = np.cumsum(n_direct) - n_direct
    for c in np.flatnonzero(n_direct).tolist():
        out[tail[c] : tail[c] + n_direct[c]] = order[offset[c] : offset[c] + n_direct[c]]
    out[: counts[0]] = ends

    def induce(block: np.ndarray) -> None:
        before = block - 1
        before = before[before >= 0]
        before = before[induced[before]]
        if len(before):
            c = text[before]
            by = np.argsort(c, kind="stable")
            before, c = before[by], c[by].astype(np.int64)
            number = np.bincount(c, minlength=257)
            out[head[c] + np.arange(len(c)) - (np.cumsum(number) - number)[c]] = before
            head[:] += number

    induce(out[: counts[0]])
    for c in np.flatnonzero(counts).tolist():
        if c:
            at = int(start[c])
            while at < head[c]:
                at, block = int(head[c]), out[at : head[c]]
                induce(block)
            induce(out[tail[c] : tail[c] + n_direct[c]])
    return out


def least_owner(data: np.ndarray, length: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """For each window of the stretches of data (as many as length - size + 1 of each, in turn), the least owner of an
    equal window."""
    letters = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.uint8)
    code[letters] = np.arange(1, len(letters) + 1)
    ends = np.cumsum(length + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = code[data]
    order = suffix_order(text, size)
    number = np.repeat(np.arange(len(length)), length + 1)
    left = ends[number] - np.arange(len(text))
    order = order[left[order] >= size]
    equal = np.ones(max(len(order) - 1, 0), bool)  # the adjacent common prefix is `size` or more
    for k in range(size):
        at = np.flatnonzero(equal)
        if not len(at):
            break
        equal[at] = text[order[at] + k] == text[order[at + 1] + k]
    at = np.flatnonzero(np.append(True, ~equal)) if len(order) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(owner[number[order]], at) if len(order) else owner[:0]
    out = np.full(len(text), np.iinfo(owner.dtype).max, owner.dtype)
    out[order] = np.repeat(least, np.diff(np.append(at, len(order))))
    return out[left >= size]


def seen_before(data: np.ndarray, length: np.ndarray, least: np.ndarray, which: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the ranges that the suffix order finds in a smaller document. data: different segments, one after
    another, with the least document of each; which, doc: the rows that have them, each with the number of its segment."""
    if not len(length):
        return (np.zeros(0, np.int64),) * 3
    windows = length - size + 1
    owner, bound = least_owner(data, length, least, size), np.repeat(least, windows)
    number, base = np.repeat(np.arange(len(windows)), windows), np.cumsum(windows) - windows
    later, out = doc > least[which], []
    # all later rows of a segment lose the same, what its least document has; that one loses what smaller ones have
    for hit, rows in ((owner <= bound, np.flatnonzero(later)), (owner < bound, np.flatnonzero(~later))):
        at = np.flatnonzero(hit)
        new = np.append(True, (np.diff(at) != 1) | (np.diff(number[at]) != 0))[: len(at)]
        first, last, segment = at[new], at[np.append(new[1:], True)[: len(at)]], number[at[new]]
        n = np.bincount(segment, minlength=len(windows))
        each = n[which[rows]]
        run = np.arange(each.sum()) + np.repeat((np.cumsum(n) - n)[which[rows]] - (np.cumsum(each) - each), each)
        out.append((np.repeat(rows, each), (first - base[segment])[run], (last - base[segment])[run] + size))
    rows, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    return rows, first, last


def _pack(batches):
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(t or b"") for t in batch.column(2).to_pylist()], pa.binary())], names=["part", "doc_id", "packed"])


def _keys(size: int, buckets: int, schema: pa.Schema):
    """Of each part: its distinct keys by bucket, with the number of its documents that have each (255 at most)."""

    def run(table: pa.Table) -> pa.Table:
        part = Part(table["packed"].to_pylist(), size)
        doc_key = np.lexsort((part.doc, part.key))
        key, doc = part.key[doc_key], part.doc[doc_key]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        other = new | np.append(True, doc[1:] != doc[:-1])[: len(key)]
        at = np.flatnonzero(new)
        docs = np.add.reduceat(other.astype(np.int64), at) if len(at) else at
        key = key[at]
        bucket = (mix(key.copy()) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        key, docs, bucket = key[by], docs[by], bucket[by]
        rows = [(int(bucket[a]), pack_numbers(np.diff(key[a:b], prepend=np.uint64(0))), zstandard.compress(np.minimum(docs[a:b], 255).astype(np.uint8).tobytes(), 1)) for a, b in stretches(bucket)]
        number = table["part"][0].as_py() if table.num_rows else 0
        return pa.Table.from_arrays([pa.array([number] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary())))], schema=schema)

    return run


def _shared(schema: pa.Schema):
    """Of a bucket of keys: for each part, those of its keys that several documents have; hot ones are marked."""

    def run(table: pa.Table) -> pa.Table:
        parts = table["part"].to_pylist()
        keys = [np.cumsum(unpack_numbers(k), dtype=np.uint64) for k in table["keys"].to_pylist()]
        docs = np.concatenate([np.frombuffer(zstandard.decompress(d), np.uint8) for d in table["docs"].to_pylist()]).astype(np.int64)
        all_keys = np.concatenate(keys)
        owner = np.repeat(np.arange(len(parts)), [len(k) for k in keys])
        order = np.argsort(all_keys, kind="stable")
        sorted_keys = all_keys[order]
        at = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
        total = np.repeat(np.add.reduceat(docs[order], at), np.diff(np.append(at, len(order))))
        keep = total > 1
        order, total = order[keep], total[keep]
        by = np.argsort(owner[order], kind="stable")  # keys stay in order within a part
        order, total = order[by], total[by]
        rows = []
        ends = np.searchsorted(owner[order], np.arange(len(parts) + 1))
        for i, number in enumerate(parts):
            a, b = ends[i], ends[i + 1]
            if b > a:
                rows.append((number, pack_numbers(np.diff(all_keys[order[a:b]], prepend=np.uint64(0))), zstandard.compress((total[a:b] > HOT).tobytes(), 1)))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], schema=schema)

    return run


def _segments(size: int, buckets: int, schema: pa.Schema):
    """Of a part: its segments under shared keys, equal ones once, by bucket (part null); and, for the part itself
    (bucket null), what is removed already."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            part = Part(left["packed"].to_pylist(), size)
            ids = left["doc_id"].to_numpy()
            shared = np.concatenate([np.cumsum(unpack_numbers(k), dtype=np.uint64) for k in right["keys"].to_pylist()])
            hot = np.concatenate([np.frombuffer(zstandard.decompress(k), bool) for k in right["hot"].to_pylist()])
            order = np.argsort(shared)
            shared, hot = shared[order], hot[order]
            at = np.minimum(np.searchsorted(shared, part.key), len(shared) - 1)
            own = shared[at] == part.key
            first, count, doc, key, hot = part.first[own], part.count[own], part.doc[own], part.key[own], hot[at[own]]
            if hot.any():  # each window of these by itself
                more = np.repeat(np.flatnonzero(hot), count[hot])
                step = np.arange(len(more)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
                lone = first[more] + step
                new = mix(hashes_of(bytes_of(part.data, lone, np.full(len(lone), size)), np.full(len(lone), size))) >> np.uint64(16)
                first, count, doc, key = (np.concatenate([x[~hot], y]) for x, y in ((first, lone), (count, np.ones(len(lone), np.int64)), (doc, doc[more]), (key, new)))
            length = count + size - 1
            content = hashes_of(bytes_of(part.data, first, length), length)
            owner = ids[doc]
            order = np.lexsort((owner, content, key))
            same = np.append(False, (key[order][1:] == key[order][:-1]) & (content[order][1:] == content[order][:-1]))[: len(order)]
            new = ~as_before(part.data, first[order], length[order], same)
            which, least = np.cumsum(new) - 1, owner[order][new]
            late = owner[order] > least[which]
            again = np.unique(which[late])  # segments that several documents of the part have
            reps, gone = order[new][again], order[late]
            row, a, b = seen_before(bytes_of(part.data, first[reps], length[reps]), length[reps], least[again], np.searchsorted(again, which[late]), owner[gone], size)
            at = first[gone] - part.offsets[doc[gone]]
            d, a, b = runs_of(doc[gone][row], at[row] + a, at[row] + b)
            number = left["part"][0].as_py()
            rows.append((None, number, pack_numbers(ids[d]), pack_numbers(a), pack_numbers(b), None, None))
            order = order[~late]
            bucket = (mix(key[order]) % np.uint64(buckets)).astype(np.int64)
            order = order[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            for x, y in stretches(bucket):
                s = order[x:y]
                text = zstandard.compress(bytes_of(part.data, first[s], length[s]).tobytes(), 3)
                rows.append((int(bucket[x]), number, pack_numbers(ids[doc[s]]), pack_numbers(first[s] - part.offsets[doc[s]]), pack_numbers(length[s]), pack_numbers(np.diff(key[s], prepend=np.uint64(0))), text))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], schema=schema)

    return run


def _matches(size: int, schema: pa.Schema):
    """Of a bucket of segments: the ranges of documents that go."""

    def run(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() is None:  # found within parts
            return table.select(["part", "docs", "first", "last"]).cast(schema)
        cols = {c: [unpack_numbers(x) for x in table[c].to_pylist()] for c in ("docs", "first", "last", "keys")}
        part = np.repeat(np.array(table["part"].to_pylist()), [len(x) for x in cols["docs"]])
        key = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in cols["keys"]])
        doc, first, length = (np.concatenate(cols[c]).view(np.int64) for c in ("docs", "first", "last"))
        data = np.frombuffer(b"".join(zstandard.decompress(x) for x in table["text"].to_pylist()), np.uint8)
        starts = np.cumsum(length) - length
        content = hashes_of(data, length)
        order = np.lexsort((doc, content, key))
        k, c, d = key[order], content[order], doc[order]
        new = ~as_before(data, starts[order], length[order], np.append(False, (k[1:] == k[:-1]) & (c[1:] == c[:-1])))
        at = np.flatnonzero(new)
        which = np.cumsum(new) - 1  # the number of its text
        key_of = np.cumsum(np.append(True, k[1:] != k[:-1])[: len(k)]) - 1
        rows = np.flatnonzero(np.bincount(key_of)[key_of] > 1)  # what is alone under its key has no equal
        some = np.unique(which[rows])
        s = order[at[some]]
        row, a, b = seen_before(bytes_of(data, starts[s], length[s]), length[s], d[at[some]], np.searchsorted(some, which[rows]), d[rows], size)
        who = order[rows[row]]
        part, doc, first, last = part[who], doc[who], first[who] + a, first[who] + b
        by = np.argsort(part, kind="stable")
        part, doc, first, last = part[by], doc[by], first[by], last[by]
        rows = []
        for a, b in stretches(part):
            x, y, z = runs_of(doc[a:b], first[a:b], last[a:b])
            rows.append((int(part[a]), pack_numbers(x), pack_numbers(y), pack_numbers(z)))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 3))], schema=schema)

    return run


def _cut(schema: pa.Schema):
    """Of a part: each document with what is left of it and the runs that go."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if right.num_rows:
            doc, first, last = runs_of(*(np.concatenate([unpack_numbers(x) for x in right[c].to_pylist()]).view(np.int64) for c in ("docs", "first", "last")))
            for a, b in stretches(doc):
                found[int(doc[a])] = (first[a:b], last[a:b])
        z = zstandard.ZstdDecompressor()
        out = [[], [], [], []]
        for doc, packed in zip(left["doc_id"].to_pylist(), left["packed"].to_pylist(), strict=True):
            text = z.decompress(packed)
            first, last = found.get(doc, ((), ()))
            edges = [0, *(int(x) for pair in zip(first, last, strict=True) for x in pair), len(text)]
            out[0].append(doc)
            out[1].append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            out[2].append(len(text))
            out[3].append(edges[1:-1])
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def dedup_bytes(docs: DataFrame, size: int = 50, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, kept, n_bytes, runs) for each row of docs: the bytes that are left, and the starts and ends of removed runs."""
    spark = docs.sparkSession
    if size < GRAM:
        raise ValueError(f"strings of less than {GRAM} bytes are not supported")
    own, repeated = one_each(docs)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-total // part_bytes), partitions(spark))
    text = F.col("text").cast("binary").alias("text")
    doc = F.col("doc_id").cast("long")
    named = own.where("doc_id IS NOT NULL")
    packed = named.select(F.pmod(F.xxhash64(doc), F.lit(parts)).alias("part"), doc.alias("doc_id"), text).mapInArrow(_pack, "part long, doc_id long, packed binary").repartition(parts, "part")
    ddl = "part long, bucket long, keys binary, docs binary"
    keys = packed.groupBy("part").applyInArrow(_keys(size, max(parts // 8, partitions(spark)), arrow_schema(ddl)), ddl)
    ddl = "part long, keys binary, hot binary"
    shared = keys.groupBy("bucket").applyInArrow(_shared(arrow_schema(ddl)), ddl)
    ddl = "bucket long, part long, docs binary, first binary, last binary, keys binary, text binary"
    segments = packed.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_segments(size, parts, arrow_schema(ddl)), ddl)
    ddl = "part long, docs binary, first binary, last binary"
    salted = F.when(F.col("bucket").isNull(), -1 - F.col("part")).otherwise(F.col("bucket")).alias("_at")
    matches = segments.groupBy(salted).applyInArrow(_matches(size, arrow_schema(ddl)), ddl)
    ddl = "doc_id long, kept binary, n_bytes long, runs array<int>"
    out = packed.groupBy("part").cogroup(matches.groupBy("part")).applyInArrow(_cut(arrow_schema(ddl)), ddl)
    bare = own.where("doc_id IS NULL").select(doc.alias("doc_id"), F.coalesce(text, F.lit(b"")).alias("kept"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.array().cast("array<int>").alias("runs"))
    out = out.unionByName(bare)
    return spread(docs, out) if repeated else out


def op9_suffix(spark, sf_dir: str) -> DataFrame:
    """All documents without strings of 50 bytes that an earlier document has."""
    out = dedup_bytes(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), (F.size("runs") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
