"""Token ids as binary files: independent zstandard frames, one for each document, with a trailing seek
table and a checksum of each frame, so that readers decompress only the documents they are asked for.

A file holds, in ascending order of doc_id: the frames (ids as little-endian unsigned integers of 16
bits, or 32 where the vocabulary needs them); a skippable frame with the width of an id and the
doc_ids; and the seek table of the public seekable format, a skippable frame with the sizes of each
frame, packed and not, and the low half of the XXH64 of what is in it. Any zstandard reader can
decompress the whole; TokenFile goes to single documents.

Plan. The texts are dealt out by ranges of doc_id and crc32 (one shuffle) and sorted; a task encodes its range
and writes one file of about `file_bytes`, so the number of files grows with the corpus. The files' totals, a row for each, give the first position of each file; reading
back is a task for each file. A task that runs again writes the same bytes under the same name.

The tokenizer drops white space, so the ids of a text are those of its parts between spaces, each
encoded by the library once and then held in a cache bounded in entries and in their length; a text with the beginning of a special token
is encoded as a whole and not kept, and so is every text if the tokenizer has other rules. A task encodes about a megabyte of texts, or one
longer text, at a time: Arrow splits it and finds its different words, words of Latin letters go to the library's model without the
normalizer and the pre-tokenizer, which would only lower them, and the words' ids are dealt out by Arrow.

Defined results. A text of any length is one frame, made in one task that holds its ids. Null and empty texts have the end id alone. Null doc_ids come first; rows of one
doc_id follow each other in order of the text's crc32, and each is a document of its own. An empty
table gives no file and no rows. Other columns play no part.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from functools import lru_cache
from operator import attrgetter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stores import opened
from .common import STEP, Scratch, arrow_schema, binary, load, partitions, steps, texts

# Fixed values of the public formats: magic numbers of the skippable frames and the seek table.
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Entries of the cache of encoded parts, characters of the longest part that is kept, and bytes of a file's part of the table.
CACHE, KEPT, FILE_BYTES = 500_000, 64, 128 << 20
#: Normalizer and pre-tokenizer of the tokenizer whose texts can be divided into words.
RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def spaced(data: bytes) -> bytes:
    """The text with a space wherever Latin letters, digits and ASCII punctuation other than ' meet, as the tokenizer splits
    there anyway: words then meet the cache without what is around them."""
    a = np.frombuffer(data, np.uint8)
    kind = _KIND[a]
    lead = np.flatnonzero((a[:-1] >= 0xC3) & (a[:-1] <= 0xC8))  # U+00C0 to U+023F: letters but for the signs of product and quotient; a capital I with dot ends in a mark once lowered
    pair = a[lead].astype(np.uint16) << 8 | a[lead + 1]
    lead = lead[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)]
    kind[lead] = kind[lead + 1] = 1
    at = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    return np.insert(a, at, 32).tobytes() if len(at) else data


_KIND = np.array([1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 if 32 < c < 127 and c != 39 else 0 for c in range(128)] + [0] * 128, np.uint8)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\r", b"abcdefghijklmnopqrstuvwxyz   ")


def lowered(data: bytes) -> bytes | None:
    """The text with a-z for A-Z and spaces for line ends and tabs, or None where that could change its ids: the tokenizer composes
    characters before it lowers them, so neither form may have anything to compose; a special token may begin with <|."""
    if b"<|" in data:
        return None
    low = data.translate(_LOWER)
    try:
        return low if data.isascii() or all(is_normalized("NFC", t.decode()) for t in (data, low)) else None
    except UnicodeDecodeError:
        return None


def split(texts: list[bytes]) -> tuple[list[str], pa.Array]:
    """The different stretches between spaces of lowered texts, and which of them each stretch is; a line end follows each text."""
    data = spaced(b" \n ".join(texts) + b" \n")
    one = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data))
    words = pc.split_pattern(one, " ").values.dictionary_encode()
    return words.dictionary.to_pylist(), words.indices


class Encoder:
    """Ids of texts as bytes of one width."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.end = np.array([end], self.type).tobytes()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        # other tokenizers than those that lower, split and mark as here get every text whole
        self.divides = (rules["normalizer"], rules["pre_tokenizer"]) == RULES and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        # a line end is no part of a divided text and stands for the end of one
        self.fixed = {"": b"", "\n": self.end} if self.divides else {}
        self.cache: dict[str, bytes] = dict(self.fixed)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # letters below U+0250, lowered, as the vocabulary spells their bytes
        self.bytes = {c: level.pre_tokenize_str(chr(c).lower())[0][0] for c in range(0x250) if chr(c).isalpha()}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words. Those of Latin letters, which the tokenizer lowers letter by letter and doesn't split, go to its model at once."""
        out: dict[str, bytes] = {}
        tokenize, number, code, rest = self.model.tokenize, attrgetter("id"), self.code, []
        for w in words:
            if self.divides and w.isalpha() and (w.isascii() or (max(w) < "\u0250" and "\u0130" not in w)):
                out[w] = array(code, [*map(number, tokenize(w.lower() if w.isascii() else w.translate(self.bytes)))]).tobytes()
            else:
                rest.append(w)
        for some in batched(rest):
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[w] = array(code, e.ids).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        cache = self.cache
        low = [lowered(t) if self.divides else None for t in texts]
        words, which = split([t for t in low if t is not None])
        odd = [self.parts(t) for t, x in zip(texts, low, strict=True) if x is None]
        new = self.learn(list(set(words).union(*odd).difference(cache)))
        cache.update(new)
        ids = pa.array([*map(cache.__getitem__, words)], pa.large_binary()).take(which)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.flatnonzero(which.to_numpy() == words.index("\n")) + 1].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        plain, other = map(slice, [0, *ends], ends), iter(odd)
        out = [b"".join([*map(cache.__getitem__, next(other)), self.end]) if t is None else raw[next(plain)].tobytes() for t in low]
        for w in new:
            if len(w) > KEPT:
                del cache[w]
        if len(cache) > CACHE:  # begin anew, with words of this step
            self.cache = self.fixed | {w: cache[w] for w in words[: CACHE // 4] if w in cache}
        return out

    def parts(self, data: bytes) -> list[str]:
        """A text that isn't lowered: between its spaces, or whole where a special token may begin or the tokenizer is another."""
        text = data.decode("utf-8", "replace")
        return text.replace("\n", " ").split(" ") if self.divides and "<|" not in text else [text]


def batched(words: list[str], most: int = 4096):
    """Runs of words, so many and about a megabyte of them at most; a longer word is a run of its own."""
    i = 0
    while i < len(words):
        size = 0
        for j in range(i, min(len(words), i + most)):
            size += len(words[j])
            if size > STEP and j > i:
                break
        else:
            j = min(len(words), i + most)
        yield words[i:j]
        i = j


@lru_cache(maxsize=1)
def encoder_of(path: str, end: int) -> Encoder:
    """One encoder for all tasks of a worker: the vocabulary is read once, and words that were met stay in its bounded cache."""
    return Encoder(path, end)


def _write(folder: str, tokenizer: str, end: int, schema: pa.Schema):
    def run(batches):
        from xxhash import xxh64_intdigest

        encoder = out = None
        z = zstandard.ZstdCompressor(level=3, write_checksum=True)
        ids, null, table, total = array("q"), bytearray(), bytearray(), 0
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.tokens"
        store, path = opened(name)
        temp = f"{path}.{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = encoder_of(tokenizer, end)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(temp)
            for i, j in steps(binary(batch, "text")[1]):
                some = batch.slice(i, j - i)
                for raw in encoder.encode([t or b"" for t in some.column(1).to_pylist()]):
                    frame = z.compress(raw)
                    out.write(frame)
                    table += struct.pack("<III", len(frame), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF)
                    total += len(raw) // encoder.type.itemsize
                ids.frombytes(some.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
                null += some.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
        if out is not None:
            index = struct.pack("<BQ", encoder.type.itemsize, len(ids)) + ids.tobytes() + bytes(null)
            out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
            table += struct.pack("<III", len(index) + 8, 0, 0)
            out.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + bytes(table) + struct.pack("<IBI", len(table) // 12, 0x80, SEEK_END))
            out.close()
            store.move(temp, path)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], schema=schema)

    return run


class TokenFile:
    """Reads single documents of a file by their place in it; doc_ids says whose they are."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_END or flags != 0x80:
            raise ValueError(f"{uri} has no seek table")
        raw = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.table = np.frombuffer(raw, "<u4").reshape(n, 3)[:-1]
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = self.file.read_at(size - 9 - 12 * n - 8 - int(self.at[-1]), int(self.at[-1]))[8:]
        width, count = struct.unpack("<BQ", index[:9])
        self.type = np.dtype(f"<u{width}")
        self.doc_ids = pa.array(np.frombuffer(index[9 : 9 + 8 * count], "<i8"), pa.int64(), mask=np.frombuffer(index[9 + 8 * count : 9 + 9 * count], bool))
        self.z = zstandard.ZstdDecompressor()

    def read(self, i: int) -> np.ndarray:
        from xxhash import xxh64_intdigest

        frame = self.file.read_at(int(self.table[i, 0]), int(self.at[i]))
        raw = self.z.decompress(frame, max_output_size=int(self.table[i, 1]))
        if xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.table[i, 2]):
            raise ValueError(f"the checksum of document {i} is wrong")
        return np.frombuffer(raw, self.type)


def _read(rows: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(uri)
                for low in range(0, len(file.doc_ids), rows):
                    ids = [file.read(i) for i in range(low, min(low + rows, len(file.doc_ids)))]
                    counts = np.array([len(x) for x in ids], np.int64)
                    sums = np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], np.int64)
                    yield pa.RecordBatch.from_arrays([file.doc_ids.slice(low, len(ids)), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(sums)], schema=schema)
                    start += int(counts.sum())

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int, files: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files to the shared folder and returns (path, start, n_docs, n_tokens) of each, in order. Without `files`, one for
    each `file_bytes` of the table by Spark's statistics (of text, where there are none), and one for each of Spark's shuffle partitions at least."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    rows = texts(docs)
    if files is None:
        size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        size = int(str(size))
        if size > 1 << 60:  # Spark doesn't know
            size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        files = max(partitions(spark), -(-size // file_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32("text")]  # both, so that rows of one doc_id or none are several ranges
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ddl = "part int, path string, n_docs long, n_tokens long"
    made = scratch.cut(rows.mapInArrow(_write(scratch.path("files"), tokenizer, end, arrow_schema(ddl)), ddl), "manifest")
    before = F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens")  # as many rows as there are files
    return scratch.cut(made.select("path", before.alias("start"), "n_docs", "n_tokens"), "index")


def read_tokens(index: DataFrame, rows: int = 1024) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files, so many documents at a time."""
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return index.select("path", "start").repartition(partitions(index.sparkSession)).mapInArrow(_read(rows, arrow_schema(ddl)), ddl)


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents as token files, and what is read back from these."""
    import public_tokenizers

    return read_tokens(write_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1))
