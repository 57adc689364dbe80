"""What the operators of this subpackage share: the shared folder for cut
lineage, worker imports, and numpy text primitives that work on whole texts.

Words are `[^\\x20\\x09-\\x0D]+` everywhere, which is what ``bytes.split()``
yields on UTF-8, so no regular expression is needed for them in Python.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word definitions, as a character class of Java and of RE2.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on; bounds a task's memory.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch sent to Python; with long texts 10,000 are too many.
ARROW_ROWS = 256
ARROW_BYTES = 32 << 20


def prepare(spark: SparkSession, most_bytes: int = ARROW_BYTES) -> None:
    """Let Python workers import this package, and keep Arrow batches small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # Read when a plan runs, which is after this returns; so they stay set for the session. Smaller settings are left as they are.
    for key, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", most_bytes)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().removesuffix("b"))
        if not 0 < now <= value:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Larger Arrow batches for plans that run inside, over short rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; below the warehouse, which is shared too, only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write Parquet into the shared folder and read it again.

    A lost executor then costs a re-read, never a recomputation of the past. The
    table is removed when it is released, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of `materialise` that nothing will read again."""
    for t in tables:
        fs, place = _file_system(t.sparkSession, t.stored_at)
        fs.delete(place, True)


def trim() -> None:
    """Give memory that this Python worker has freed back to the system; workers are kept and would hold it beside the next task's."""
    pa.default_memory_pool().release_unused()
    if (freed := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # of glibc
        freed(0)


def sweep_shuffles(spark: SparkSession) -> None:
    """Have Spark remove shuffle files that nothing refers to; else they stay until the driver's heap happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def as_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that no working column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo: the split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function from a RecordBatch to a dict of columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield as_batch(fn(batch), out)

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def encoded(texts: list[str | None], lower: bool = False) -> list[bytes]:
    """UTF-8 of each text, null as empty; lower only changes A-Z."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    return [r.lower() for r in raw] if lower else raw


# --- word hashes without a Python object per word ---------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        for key, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, b, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a well-known public mixing function)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf) + 1)
    out = np.empty(len(buf) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_TABLE[buf] * up[: len(buf)], dtype=np.uint64, out=out[1:])
    return out


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte buffer."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.diff(np.concatenate(([True], _SPACE[buf], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _hash_segment(raw: bytes) -> np.ndarray:
    buf = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = word_spans(buf)
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = prefix_sums(buf)
    _, down = powers(len(buf) + 1)
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def word_hashes(raw: bytes, most: int = CHUNK_BYTES) -> np.ndarray:
    """64-bit hash of each word of one text, in order; a text of more than `most` bytes is cut at white space."""
    if len(raw) <= most:
        return _hash_segment(raw)
    parts, at = [], 0
    while at < len(raw):
        end = at + most
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_hash_segment(raw[at:end]))
        at = end
    return np.concatenate(parts)


def grouped_word_hashes(raws: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts of about `most` bytes: first, past-last, all word hashes, words per text."""
    i = 0
    while i < len(raws):
        j, size = i, 0
        while j < len(raws) and (j == i or size + len(raws[j]) < most):
            size += len(raws[j]) + 1
            j += 1
        if j - i == 1:
            h = word_hashes(raws[i], most)
            yield i, j, h, np.array([len(h)], dtype=np.int64)
        else:
            joined = b"\n".join(raws[i:j])
            buf = np.frombuffer(joined, dtype=np.uint8)
            starts, ends = word_spans(buf)
            lengths = np.fromiter((len(r) + 1 for r in raws[i:j]), dtype=np.int64, count=j - i)
            cuts = np.concatenate(([0], np.cumsum(lengths)))
            per = np.diff(np.searchsorted(starts, cuts))
            if len(starts):
                sums = prefix_sums(buf)
                _, down = powers(len(buf) + 1)
                h = mix((sums[ends] - sums[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))
            else:
                h = np.empty(0, np.uint64)
            yield i, j, h, per
        i = j


def sums_by(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs of the given lengths (empty runs give 0)."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(per)
    return total[ends] - total[ends - per]
