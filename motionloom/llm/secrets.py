"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, named by its sha256. A ledger holds a row for each blob and
version of the rules that was scanned, with what was found. A scan looks only at blobs that the
ledger has no row for, adds their rows, and joins findings to all paths that hold the blob.

Plan. A task passes a blob on once, compressed, however many of its rows hold it; a shuffle by name
leaves one of each, less those of the ledger. So a hot blob costs a row for each task, and the texts
are shuffled once. Paths and findings then meet by name, where Spark can split a hot one (skew join).

Rules (version 1), leftmost and non-overlapping for each kind; positions are code points, end exclusive:
assign, access and hex. Rule-set 1 has no further kinds, so all spans are these.

Defined results. A null text is the empty blob: no findings. Repeated rows, ties and null doc_ids are
paths like others: a row each. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, load, pick

RULES = 1
# The patterns, and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6
KINDS = ("assign", "access", "hex")
LASTING = "spark.motionloom.secrets.ledger"
LEDGER = "blob binary, rules int, kinds array<string>, starts array<int>, ends array<int>"


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in order. A run that is too short can't hold a longer one, so ACCESS and
    HEX ask for the length at once; a failing assignment uses its characters up, so ASSIGN doesn't."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _once(batches):
    """Each blob of a task once, compressed."""
    seen: set[bytes] = set()
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs, texts = [], []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if blob not in seen:
                seen.add(blob)
                blobs.append(blob)
                texts.append(z.compress(text))
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(texts, pa.binary())], names=["blob", "packed"])


def _scan(schema: pa.Schema):
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            kinds, starts, ends = [], [], []
            for packed in batch.column(1).to_pylist():
                found = find(z.decompress(packed).decode("utf-8", "replace"))
                kinds.append([KINDS[k] for _, k, _ in found])
                starts.append([s for s, _, _ in found])
                ends.append([e for _, _, e in found])
            cols = [batch.column(0), pa.array([RULES] * len(kinds)), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def named(docs: DataFrame) -> DataFrame:
    """(path, blob, text) of (doc_id, text)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return pick(docs, "doc_id", "text").select(F.col("doc_id").alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows: (blob, rules, kinds, starts, ends) of each blob of `versions` (path, blob, text) that
    `ledger` has no row for under these rules. Written to the shared folder, so it is scanned once."""
    return Scratch(versions.sparkSession, "secrets").cut(_scanned(versions, ledger), "ledger")


def _scanned(versions: DataFrame, ledger: DataFrame | None) -> DataFrame:
    blobs = versions.select("blob", "text").mapInArrow(_once, "blob binary, packed binary")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == RULES).select("blob"), "blob", "left_anti")
    return blobs.dropDuplicates(["blob"]).mapInArrow(_scan(arrow_schema(LEDGER)), LEDGER)


def update(versions: DataFrame, path: str) -> DataFrame:
    """The ledger at `path` after a scan of what it has no row for; it is begun where there is none. Rows are only ever added, and
    an addition that is cut short adds nothing, so the next call scans the same blobs again."""
    spark = versions.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.schema(LEDGER).parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    _scanned(versions, known).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, kinds, starts, ends) for each row of versions. Two scans at a time may both have added a blob: it counts once."""
    own = ledger.where(F.col("rules") == RULES).drop("rules").dropDuplicates(["blob"])
    return versions.select("path", "blob").join(own, "blob").drop("blob")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents. The setting spark.motionloom.secrets.ledger names a ledger that lasts: then what an earlier call scanned
    isn't scanned again. Without it a ledger is begun for this call."""
    versions = named(load(spark, sf_dir, "documents"))
    ledger = spark.conf.get(LASTING, None) or Scratch(spark, "secrets").path("ledger")
    found = findings(versions, update(versions, ledger))
    spans = F.array_join(F.transform(F.sequence(F.lit(1), F.size("kinds")), lambda i: F.concat_ws(":", F.element_at("kinds", i), F.element_at("starts", i), F.element_at("ends", i))), ",")
    spans = F.when(F.size("kinds") > 0, spans).otherwise("")
    count = [F.expr(f"CAST(size(filter(kinds, k -> k = '{name}')) AS BIGINT)").alias(f"n_{name}") for name in KINDS]
    out = found.select(F.col("path").alias("doc_id"), *count, spans.alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")
