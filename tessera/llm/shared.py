"""What the operators share: written tables that cut lineage, bounded filters, Arrow helpers."""

from __future__ import annotations

import atexit
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset (tests), a temporary one of a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: lost executors cost no recomputation of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_removed, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def clear(table: DataFrame) -> None:
    """Removes the files of a table from ``staged`` that nothing reads any more, before the session ends."""
    _removed(table.sparkSession, table.staged_at)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        return


#: Bytes of an Arrow batch between the JVM and Python, in sessions that have Spark's default: long texts then don't pile up.
BATCH, _BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, in a session with small Arrow batches."""
    if spark.conf.get(_BATCH_KEY) in ("67108864", "67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH_KEY, str(BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores before them until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (xor-shift and multiply, twice)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bits of a Bloom filter: a fixed size whatever the input; a full one only lets more rows through.
BLOOM_BITS = 1 << 26


def bloom_of(keys: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter (two probes) over the one long column of ``keys``, OR-ed on the executors; the driver gets ``bits / 8`` bytes."""
    pieces = 16
    size = bits // 8 // pieces

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _probes(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.bitwise_or.at(out, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        full = [i for i in range(pieces) if out[i * size : (i + 1) * size].any()]
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(out[i * size : (i + 1) * size], 1) for i in full], pa.binary())], ["piece", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint8)
                have[i] = part.copy() if i not in have else have[i] | part
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([zlib.compress(v, 1) for v in have.values()], pa.binary())], ["piece", "bits"])

    schema = "piece int, bits binary"
    found = keys.mapInArrow(fill, schema).repartition(pieces, "piece").mapInArrow(joined, schema).collect()  # at most `pieces` rows of fixed size
    out = np.zeros(bits // 8, np.uint8)
    for r in found:
        out[r.piece * size : (r.piece + 1) * size] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def in_bloom(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a key may be in the filter."""
    found = np.ones(len(keys), bool)
    for at in _probes(keys.view(np.uint64), len(bloom) * 8):
        found &= (bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return found


def added_up(rows: DataFrame, pieces: int) -> np.ndarray:
    """Sums the compressed int64 arrays in (piece int, sums binary) by piece on the executors; the driver gets the total, whose size its caller bounds."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.int64)
                have[i] = have[i] + part if i in have else part
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in have.values()], pa.binary())], ["piece", "sums"])

    found = {r.piece: np.frombuffer(zlib.decompress(r.sums), np.int64) for r in rows.repartition(pieces, "piece").mapInArrow(total, "piece int, sums binary").collect()}
    one = next(iter(found.values()), np.zeros(0, np.int64))
    return np.concatenate([found.get(i, np.zeros_like(one)) for i in range(pieces)])
