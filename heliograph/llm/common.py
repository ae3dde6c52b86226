"""Helpers shared by the operators: written tables, file ids, text buffers and vector hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where the session names none and all runs on
    one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="heliograph-")
    return _OWN_DIR[app]


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(rows: DataFrame) -> DataFrame:
    """The same rows, each built once: what follows is neither merged with what stands before (which would
    evaluate it again for each use) nor pushed below it."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_row")).select("_row.*")


def bitmap(marks: list[int]) -> tuple[Column, int]:
    """A table of bits, one set for each mark, as one constant, and the number of its words as a power of two."""
    power = min(16, max(6, (len(marks)).bit_length()))
    table = [0] * (1 << power)
    for h in marks:
        u = h & (2**64 - 1)
        table[u >> (64 - power)] |= 1 << (u & 63)
    return F.split(F.lit(",".join(str(x - 2**64 if x >= 2**63 else x) for x in table)), ",").cast("array<bigint>"), power


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text buffers


class TextBatch:
    """The UTF-8 bytes of an Arrow string column, laid end to end. A null counts as empty.

    data: uint8 bytes; start: n + 1 offsets of the texts in data.
    """

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
        lo, hi = int(off[0]), int(off[-1])
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.n = n
        self.data = raw[lo:hi]
        self.start = off - lo


#: Odd multipliers of the hashes (fixed values).
_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64, at least n of each."""
    if len(_POW[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, base in enumerate((_P, inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW[0], _POW[1]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span data[begin:end]."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = (total[end] - total[begin]) * inverse[begin]
    return mix(h + (end - begin).astype(np.uint64) * _M2)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


#: Bytes of white space between words: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(batch: TextBatch, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of the text that it stands in."""
    data = batch.data if data is None else data
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    letter = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[batch.start] = True  # a text's first byte never continues a word of the text before
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | first[1:-1]
    stop = letter.copy()
    stop[:-1] &= ~letter[1:] | first[1:-1]
    b, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return b, e, np.searchsorted(batch.start, b, side="right") - 1


def count_by(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def with_text(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, and the text; other columns of any name stay out."""
    return df.select(*columns, F.col("text").cast("string").alias("text"))
