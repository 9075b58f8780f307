"""Pieces that several corpus operators share: scratch tables, column checks and vectorised word fingerprints.

Scratch tables are Parquet files under ``spark.checkpoint.dir`` (shared by the driver and all executors), or under the folder that
``setCheckpointDir`` named, so a lost executor never loses them. Where there is neither, a folder of our own is made on a local
master, as in tests; on any other master that is an error.

Fingerprints are 64-bit polynomial hashes over bytes, finished with a bijective mixer. Two different words (or word
windows) share one with probability about 2**-64 per pair; where a method needs more, it uses two of them.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            return named.get().rstrip("/")
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """The rows of df, written once as a Parquet scratch table and read from there: this cuts lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that no later result reads."""
    for t in tables:
        if path := getattr(t, "_lodestone_path", None):
            _delete(t.sparkSession, path)


def swept(spark: SparkSession) -> None:
    """Shuffle files and broadcasts of finished jobs go once the driver's JVM has collected what refers to them. An iteration of many jobs
    asks for that between its rounds, so that neither the executors' disks nor the driver's heap fill up with them."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows from now on, where the session has Spark's default: texts may be long, and a Python worker
    keeps the memory that its largest batch took."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- word fingerprints

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: ASCII letters and digits, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        for k, b in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a run of texts: byte buffer (lower-cased A-Z), starts, ends, fingerprints, and the first word of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.buf = buf = LOWER[buf]
        inside = kind[buf]
        # a break between texts also ends a word
        edge = np.empty(len(buf) + 1, bool)
        edge[0], edge[-1] = (inside[0], inside[-1]) if len(buf) else (False, False)
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        starts = np.flatnonzero(edge[:-1] & inside) if len(buf) else np.empty(0, np.int64)
        ends = np.flatnonzero(edge[1:] & inside) + 1 if len(buf) else np.empty(0, np.int64)
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(buf))])
        cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends = starts, ends
        up, down = _power(len(buf) + 1)
        total = np.empty(len(buf) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_LETTER[buf] * up[: len(buf)], out=total[1:])
        self._total, self._down = total, down
        self.hash = mix((total[ends] - total[starts]) * down[starts])
        self.first = np.searchsorted(starts, offsets)  # of each text, and the end

    def beginnings(self, which: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the first `size` bytes of the words `which`, unlike those of whole words."""
        a = self.starts[which]
        return mix((self._total[a + size] - self._total[a]) * self._down[a] + np.uint64(0x5851F42D4C957F2D))

    def windows(self, k: int, seed: int = 0) -> np.ndarray:
        """Fingerprints of k words from each position on; those of the last k - 1 words run past the end and mean nothing."""
        h = self.hash
        n = len(h)
        out = np.full(n, np.uint64(0x2545F4914F6CDD1D + 2 * seed), np.uint64)
        for j in range(min(k, n)):
            part = h[j:] if j else h
            out[: n - j] = (out[: n - j] + part) * np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
        return mix(out)


def segments(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; null is empty; a longer text is a run by itself."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    if column.null_count:  # a null may stand over bytes
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if (lengths != np.diff(offsets)).any():
            yield from segments(pa.array([v if v is not None else b"" for v in column.to_pylist()], pa.large_binary()), most)
            return
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def as_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def ragged(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat, kind)).cast(pa.list_(kind))


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start .. start + count - 1 of each run, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
