"""Helpers that the corpus operators share: scratch tables, Arrow buffers, hashes of words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType, VariantType

#: Bytes of text that one vectorised step works on.
STEP = 1 << 20


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Long texts otherwise make Arrow batches of 64 MB, on both sides of the boundary and for each core."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").strip().lower().removesuffix("b")
    size = int(now.rstrip("kmgt")) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(now[-1], 0)
    if size <= 0 or size > most:
        spark.conf.set(name, str(most))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def place(docs: DataFrame, name: str) -> int:
    """Where a column is: the one of exactly this name, else one of another case."""
    names = docs.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the columns _0, _1, ..: whatever names it has, even repeated ones or names with dots, clash with nothing.
    toDF(*docs.columns) gives the names back."""
    return docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """These columns alone, by exact name where there is one."""
    return numbered(docs).select(*(F.col(f"_{place(docs, n)}").alias(n) for n in names))


def identity(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all of a row. Rows that agree in both are repeats of one row: doubles go by their text
    (-0.0 isn't 0.0), nested values by their JSON, and nulls count."""
    parts = []
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType | MapType | StructType | VariantType):
            c = F.to_json(F.struct(c), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
        elif isinstance(f.dataType, FloatType | DoubleType):
            c = c.cast("string")
        parts.append(c)
    nulls = [c.isNull() for c in parts]
    return [F.xxhash64(F.lit(salt), *parts, *nulls) for salt in (71, 72)]


def repeated(rows: DataFrame, n: str, chunk: int = 1024) -> DataFrame:
    """Each row n times, with nth from 0. Rows of many repeats are dealt out anew in chunks, so no task makes them all."""
    parts = partitions(rows.sparkSession)
    some = rows.where(F.col(n) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk))))
    some = some.repartition(parts, F.xxhash64(F.col("_chunk"), F.col(rows.columns[0])))
    last = F.least(F.col(n), (F.col("_chunk") + 1) * chunk) - 1
    return some.withColumn("nth", F.explode(F.sequence(F.col("_chunk") * chunk, last))).drop("_chunk")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one if Spark
    runs in one process; on a cluster, where executors wouldn't see it, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor is then no reason to compute them again."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.made: list[DataFrame] = []

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        self.made.append(out)
        return out

    def only(self, *keep: DataFrame) -> None:
        """Removes all tables but these, which a result still reads."""
        self.drop(*(df for df in self.made if not any(df is k for k in keep)))
        self.made = list(keep)

    def drop(self, *dfs: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in dfs:
            if p := getattr(df, "_scratch", None):
                at = jvm.org.apache.hadoop.fs.Path(p)
                at.getFileSystem(conf).delete(at, True)


def binary(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as one array of bytes and the offsets of its rows; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offsets, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP):
    """Ranges of rows with at most so many bytes each; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(seed << 32)) | np.uint64(1)


_BYTE = constants(11, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(10, int(n - 1).bit_length())
    if size not in _POWERS:
        p = np.full(size, np.uint64(0x5851F42D4C957F2D) | np.uint64(1))
        p[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(p)
    return _POWERS[size][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+, A-Z as a-z, of each text in turn, and how many words each text has."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data), bool)
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = True
    first[1:] |= ~inside[:-1]
    starts = np.flatnonzero(first & inside)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    value = _BYTE[_LOWER[data]]
    value[~inside] = 0
    word = np.cumsum(first & inside) - 1
    at = np.arange(len(data)) - starts[np.maximum(word, 0)]
    at[word < 0] = 0
    at[~inside] = 0
    value *= powers(int(at.max()) + 1)[at]
    h = mix(np.add.reduceat(value, starts))
    counts = np.diff(np.searchsorted(starts, offsets))
    return h, counts


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def texts(docs: DataFrame, *more) -> DataFrame:
    """doc_id and the text as bytes, and nothing else that the table may have."""
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def one_each(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id and text with one row for each doc_id that isn't null, and whether rows had to be put together.

    Of several rows the text with the smallest md5 stands for all. Ids are usually unique: then
    the texts aren't shuffled.
    """
    docs = pick(docs, "doc_id", "text")
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        return docs, False
    one = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by("text", F.md5("text")).alias("text"))
    return one.unionByName(docs.where("doc_id IS NULL")), True


def spread(docs: DataFrame, result: DataFrame) -> DataFrame:
    """A result row for each row of docs, after one_each()."""
    ids = pick(docs, "doc_id").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(result, "doc_id").select(result.columns).unionByName(result.where("doc_id IS NULL"))
