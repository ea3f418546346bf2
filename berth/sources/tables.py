"""Typed sources and sinks.

Schemas are declared, never inferred. Snapshots are written below the
shared checkpoint folder, partitioned, with dynamic partition overwrite so a
batch rewrites only the partitions it touches.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from berth.session import shared_dir

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS, DT, BIN = T.TimestampType(), T.DateType(), T.BinaryType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


FLAGS = T.ArrayType(_st(("severity", S), ("message", S)))
FIELDS = T.ArrayType(_st(("key", S), ("label", S), ("value", S), ("importance", S), ("status", S)))

# The reference's four tables (ids are strings; JSONB sections are typed).
SCHEMAS: dict[str, T.StructType] = {
    "sessions": _st(("session_id", S), ("created_at", TS)),
    "extractions": _st(
        ("id", S), ("session_id", S), ("file_name", S), ("file_hash", S), ("mime_type", S),
        ("document_type", S), ("document_name", S), ("category", S), ("applicable_role", S),
        ("is_required", B), ("confidence", S), ("detection_reason", S),
        ("holder_name", S), ("date_of_birth", S), ("nationality", S), ("passport_number", S),
        ("sirb_number", S), ("rank", S), ("date_of_issue", DT), ("date_of_expiry", DT),
        ("is_expired", B), ("fitness_result", S), ("drug_test_result", S),
        ("issuing_authority", S), ("regulation_reference", S),
        ("fields", FIELDS),
        ("validity", _st(("dateOfIssue", S), ("dateOfExpiry", S), ("isExpired", B),
                         ("daysUntilExpiry", L), ("revalidationRequired", B))),
        ("compliance", _st(("issuingAuthority", S), ("regulationReference", S), ("imoModelCourse", S),
                           ("recognizedAuthority", B), ("limitations", S))),
        ("medical_data", _st(("fitnessResult", S), ("drugTestResult", S), ("restrictions", S),
                             ("specialNotes", S), ("expiryDate", S))),
        ("flags", FLAGS), ("summary", S), ("raw_llm_response", S), ("processing_time_ms", I),
        ("status", S), ("error_code", S), ("error_message", S), ("retry_count", I),
        ("prompt_version", S), ("created_at", TS)),
    "jobs": _st(
        ("job_id", S), ("session_id", S), ("extraction_id", S), ("file_name", S), ("file_hash", S),
        ("mime_type", S), ("file_data", BIN), ("status", S), ("error_code", S), ("error_message", S),
        ("retryable", B), ("retry_count", I), ("queued_at", TS), ("started_at", TS),
        ("completed_at", TS), ("webhook_url", S), ("webhook_delivered_at", TS),
        ("webhook_attempts", I), ("webhook_last_error", S)),
    "validations": _st(
        ("validation_id", S), ("session_id", S), ("overall_status", S), ("overall_score", I),
        ("result_json", S), ("created_at", TS), ("prompt_version", S), ("llm_provider", S),
        ("llm_model", S)),
    # driver tables
    "region": _st(("r_regionkey", I), ("r_name", S)),
    "nation": _st(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _st(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                    ("c_mktsegment", S)),
    "orders": _st(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                  ("o_orderdate", T.TimestampNTZType()), ("o_orderpriority", S)),
    "events": _st(("event_id", L), ("ts", T.TimestampNTZType()), ("user_id", L), ("event_type", S),
                  ("value", D), ("props", S)),
    "documents": _st(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Parquet scan with the declared schema (no inference, no footer merge)."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


# S2 -----------------------------------------------------------------------

def intake_files(src: DataFrame) -> DataFrame:
    """Bytes, name, MIME, size, SHA-256 hex and base64 per file. ``src``
    has ``content`` (binary) plus optional ``file_name`` / ``mime_type``."""
    df = src
    if "file_name" not in df.columns:
        df = df.withColumn("file_name", F.lit(None).cast("string"))
    if "mime_type" not in df.columns:
        df = df.withColumn("mime_type", F.lit(None).cast("string"))
    c = F.col("content")
    return df.withColumns({
        "size_bytes": F.octet_length(c).cast("long"),
        "file_hash": F.sha2(c, 256),
        "content_b64": F.translate(F.base64(c), "\r\n", ""),
    })


# Suffixes of the accepted types; anything else is plain bytes.
MIME_BY_SUFFIX = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "pdf": "application/pdf"}
MIME_OTHER = "application/octet-stream"


def mime_by_suffix(file_name: str) -> Column:
    """MIME type by the name's suffix, in any case; without one, plain bytes."""
    suffix = F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)\z", 1))
    known = F.create_map(*[F.lit(x) for kv in MIME_BY_SUFFIX.items() for x in kv])
    return F.coalesce(F.try_element_at(known, suffix), F.lit(MIME_OTHER))


READ_BYTES = 16 << 20  # contents that a reading task holds at once, besides its longest file
SHARDS = 256  # subfolders of landed files, each listed by a task


def _hidden(name: str) -> bool:
    """As Spark's file sources have it."""
    return ((name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")) and not name.startswith(
        ("_common_metadata", "_metadata"))


def _found(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path) of the files below a folder, listed and dealt out by tasks: one
    lists the folder itself, the others its subfolders, each whole. No list of
    files is made on the driver."""
    def names(found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    def shown(infos: list[pa_fs.FileInfo], root: str) -> list[str]:
        return [f.path for f in infos if f.is_file and fnmatch.fnmatchcase(f.base_name, glob)
                and not any(_hidden(p) for p in f.path[len(root):].split("/") if p)]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa_fs.FileSystem.from_uri(path)
        for b in batches:
            for _ in range(b.num_rows):
                infos = fs.get_file_info(pa_fs.FileSelector(root))
                yield names(shown(infos, root) + [f.path + "/" for f in infos if not f.is_file and not _hidden(f.base_name)])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa_fs.FileSystem.from_uri(path)
        for b in batches:
            for p in b.column("path").to_pylist():
                yield names(shown(fs.get_file_info(pa_fs.FileSelector(p[:-1], recursive=True)), p[:-1]) if p.endswith("/") else [p])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spark.range(0, 1, 1, 1).mapInArrow(top, "path string").repartition(n).mapInArrow(below, "path string")


def _contents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(content, path) of the files below a folder, read by the tasks that
    listed them, some at a time."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa_fs.FileSystem.from_uri(path)
        for b in batches:
            held, at, size = [], [], 0
            for p in b.column("path").to_pylist():
                with fs.open_input_file(p) as f:
                    held.append(f.read())
                at.append(p)
                size += len(held[-1])
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(at, pa.string())], names=["content", "path"])
                    held, at, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(at, pa.string())], names=["content", "path"])
    return _found(spark, path, glob).mapInArrow(read, "content binary, path string")


def read_binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Directory of uploaded files, empty ones too -> intake rows (a file is
    one row, listed and read in tasks). Spark's ``binaryFile`` source leaves
    empty files out, keeps every file's status on the driver and makes a task
    of some 30 of them. ``glob`` picks by name; hidden files are no uploads."""
    named = _contents(spark, path, glob).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return intake_files(named.select("file_name", mime_by_suffix("file_name").alias("mime_type"), "content", "path"))


def land_files(files: DataFrame, path: str) -> None:
    """Write ``files(file_name, content)`` as one file each into subfolders of
    ``path`` (by the name's CRC-32), from the tasks; of files of one name one
    stays. A task that runs again writes the same files again. The store is
    any that pyarrow opens by its URI."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa_fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        made = set()
        for b in batches:
            for name, content in zip(b.column("file_name").to_pylist(), b.column("content").to_pylist(), strict=True):
                folder = f"{root}/{zlib.crc32(str(name).encode()) % SHARDS:02x}"
                if folder not in made:
                    fs.create_dir(folder)
                    made.add(folder)
                with fs.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
    files.select("file_name", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


# S4 -----------------------------------------------------------------------

def write_snapshot(df: DataFrame, path: str, partition_cols: list[str],
                   sort_cols: list[str] | None = None, max_records_per_file: int = 5_000_000) -> None:
    """Partitioned Parquet, rewriting only the partitions present in ``df``.

    No shuffle by the partition column (a value holding a third of the rows
    would become one task): every task sorts its rows by partition value (one
    open writer at a time) and then ``sort_cols`` (tight min/max stats for
    skipping, e.g. ``session_id``), capping file size by record count."""
    (df.sortWithinPartitions(*partition_cols, *(sort_cols or []))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .option("maxRecordsPerFile", max_records_per_file)
       .partitionBy(*partition_cols).parquet(path))


def snapshot_path(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"snapshots/{name}")
