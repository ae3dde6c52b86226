"""Training-order materialisation: fixed-stride binary shards in a keyed random order.

Texts are encoded and laid end to end, an end mark after each, and cut into sequences of `length`
tokens. (The default encoding is a text's UTF-8 bytes, with 0xFF as end mark and 0xFE as filling,
which never occur in UTF-8: one byte a token. Pass `encode` and a wider `dtype` for other token ids.)
Each input partition fills up its last sequence, so every partition's sequences have known ordinals
once the counts of the partitions before it are known: nothing is sorted.

A keyed Feistel network over the least even number of bits that holds all ordinals, walked along its
cycle until it lands among them, gives each ordinal its slot: a bijection that anyone can compute. A
shard is a range of slots. Each map task sends one compressed row to each shard; a shard's task lays its
sequences at slot x stride, and writes one file under a temporary name, moved when complete, so that
repeated tasks do no harm. Slot s is at byte (s mod per_shard) x stride of shard s div per_shard, so
that a reader resumes from a slot number alone. Beside each shard the same task writes the index of its
sequences (Parquet), in the same way: Spark's own writers take no part, and only Arrow has to open the path.

Null and empty texts are an end mark alone. Null ids are left out of a sequence's list of ids. No rows
give no shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import TextBatch, mix, parts, read_table, table_path
from heliograph.llm.textscan import runs

END, FILL = 0xFF, 0xFE

#: The index of a shard: one row per sequence.
INDEX = "slot bigint, shard bigint, offset bigint, n_tokens bigint, crc32 bigint, doc_ids array<bigint>"
_INDEX = pa.schema([(k, pa.int64()) for k in ("slot", "shard", "offset", "n_tokens", "crc32")] + [("doc_ids", pa.list_(pa.int64()))])


def permute(ordinal: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each ordinal below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(rounds, dtype=np.uint64) + np.uint64(key % (1 << 63)) * np.uint64(2))
    out = ordinal.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[walking] = x = (left << np.uint64(half)) | right
        walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def utf8_tokens(batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, each followed by the end mark, and the tokens of each text."""
    size = np.diff(batch.start) + 1
    out = np.full(int(size.sum()), END, np.uint8)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(size) - 1] = False
    out[keep] = batch.data
    return out, size


def _put(where: fs.FileSystem, folder: str, name: str, data: bytes | pa.Buffer) -> None:
    rough = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(rough) as out:
        out.write(data)
    where.move(rough, f"{folder}/{name}")


def write_shards(
    documents: DataFrame,
    path: str,
    length: int = 2048,
    per_shard: int = 2048,
    key: int = 20_240_601,
    encode: Callable[[TextBatch], tuple[np.ndarray, np.ndarray]] = utf8_tokens,
    tokens: str | F.Column | None = None,
    dtype: str = "uint8",
    fill: int = FILL,
) -> DataFrame:
    """Write shards, their indexes and a manifest under path. documents must be read from files, so that its partitions
    are the same in both passes (this is verified). tokens: a column of each text's number of tokens, end
    mark included, where it is not its bytes and one.

    Returns one row per sequence: slot, shard, offset (bytes), n_tokens (without filling), crc32 (of the
    record), doc_ids (of the texts it holds parts of)."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = (F.octet_length(text) + 1) if tokens is None else (F.col(tokens) if isinstance(tokens, str) else tokens)
    rows = documents.select("doc_id", "text")
    counted = documents.select(each.cast("long").alias("n")).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n")).collect()
    base, n = {}, 0
    for r in sorted(counted):  # one number for each input partition
        base[r.p] = (n, r.n)
        n += -(-r.n // length)
    known = spark.sparkContext.broadcast(base)
    kind = np.dtype(dtype)
    stride = length * kind.itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, promised = known.value.get(part, (0, 0))
        held = np.zeros(0, kind)
        ids: list[tuple[int, int, int | None]] = []  # begin and end in the partition's stream, id
        done = total = 0

        def send(flush: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, done
            whole = len(held) // length
            if flush and len(held) % length:
                held = np.concatenate([held, np.full(length - len(held) % length, fill, kind)])
                whole += 1
            if not whole:
                return
            slot = permute(np.arange(first + done, first + done + whole), n, key)
            body = held[: whole * length].reshape(whole, length)
            inside: list[list[int]] = [[] for _ in range(whole)]
            for lo, hi, d in ids:
                for k in range(max(0, lo // length - done), min(whole - 1, (hi - 1) // length - done) + 1):
                    if d is not None:
                        inside[k].append(d)
            shard = slot // per_shard
            out: dict[str, list] = {"shard": [], "slots": [], "body": [], "sizes": [], "ids": [], "n_ids": []}
            for s in np.unique(shard):
                own = np.flatnonzero(shard == s)
                out["shard"].append(int(s))
                out["slots"].append(slot[own].tobytes())
                out["body"].append(zstandard.ZstdCompressor(level=3).compress(body[own].tobytes()))
                out["sizes"].append(np.minimum(length, np.maximum(0, total - (done + own) * length)).astype(np.int64).tobytes())
                out["ids"].append(np.array([d for k in own for d in inside[k]], np.int64).tobytes())
                out["n_ids"].append(np.array([len(inside[k]) for k in own], np.int64).tobytes())
            held = held[whole * length :]
            done += whole
            ids = [x for x in ids if x[1] > done * length]
            yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("slots", "body", "sizes", "ids", "n_ids"))], list(out))

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, run in runs(batch.column(1), 1 << 23):
                data, size = encode(run)
                stop = total + np.cumsum(size)
                ids += zip((stop - size).tolist(), stop.tolist(), doc_ids[at : at + run.n], strict=True)
                total = int(stop[-1])
                held = np.concatenate([held, data.astype(kind, copy=False)])
                if len(held) >= 1 << 23:
                    yield from send(False)
        yield from send(True)
        if total != promised:
            raise ValueError(f"partition {part} has {total} tokens, and had {promised} when they were counted")

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        there = min(per_shard, n - shard * per_shard)
        data = np.zeros((there, length), kind)
        slots, sizes, doc_ids = [], [], []
        for r in group.itertuples(index=False):
            slot = np.frombuffer(r.slots, np.int64)
            data[slot - shard * per_shard] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.body), kind).reshape(-1, length)
            slots.append(slot)
            sizes.append(np.frombuffer(r.sizes, np.int64))
            flat, at = np.frombuffer(r.ids, np.int64), 0
            for k in np.frombuffer(r.n_ids, np.int64):
                doc_ids.append(flat[at : at + k].tolist())
                at += k
        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        slot = np.concatenate(slots)
        mark = [zlib.crc32(data[s - shard * per_shard].tobytes()) for s in slot.tolist()]
        index = pd.DataFrame({"slot": slot, "shard": shard, "offset": (slot - shard * per_shard) * stride, "n_tokens": np.concatenate(sizes), "crc32": mark, "doc_ids": doc_ids}).sort_values("slot")
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_pandas(index, _INDEX, preserve_index=False), sink, compression="zstd")
        _put(where, folder, f"index-{shard:08d}.parquet", sink.getvalue())
        _put(where, folder, f"shard-{shard:08d}.bin", data.tobytes())
        return pd.DataFrame({"shard": [shard], "n": [len(slot)]})

    sent = rows.mapInArrow(cut, "shard bigint, slots binary, body binary, sizes binary, ids binary, n_ids binary")
    shards = -(-n // per_shard)
    laid = sent.repartition(max(1, min(shards, max(parts(spark), shards // 16))), "shard").groupBy("shard")
    done = laid.applyInPandas(lay, "shard bigint, n bigint").agg(F.count("*").alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if (done.shards, done.n) != (shards, n):
        raise ValueError(f"{done.shards} shards with {done.n} sequences were written, of {shards} with {n}")
    where, folder = fs.FileSystem.from_uri(path) if shards else (None, None)
    if where is not None:
        with where.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"sequences": n, "length": length, "dtype": dtype, "per_shard": per_shard, "stride": stride, "key": key, "fill": fill}).encode())
    return _index(spark, path, n, shards)


def _index(spark: SparkSession, path: str, n: int, shards: int, rows: int = 1 << 16) -> DataFrame:
    """The indexes of all shards, about `rows` of them a partition."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                with where.open_input_file(f"{folder}/index-{shard:08d}.parquet") as f:
                    yield from pq.read_table(f, schema=_INDEX).to_batches()

    return spark.range(0, shards, 1, max(1, min(shards, -(-n // rows)))).mapInArrow(read, INDEX)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows that write_shards gave back when it wrote path."""
    where, folder = fs.FileSystem.from_uri(path)
    with where.open_input_stream(f"{folder}/manifest.json") as f:
        m = json.loads(f.read())
    return _index(spark, path, m["sequences"], -(-m["sequences"] // m["per_shard"]))


def read_sequences(path: str, first: int, count: int) -> Iterator[np.ndarray]:
    """The sequences of slots first, first + 1, ... in training order."""
    where, folder = fs.FileSystem.from_uri(path)
    with where.open_input_stream(f"{folder}/manifest.json") as f:
        m = json.loads(f.read())
    slot, stop = first, min(m["sequences"], first + count)
    while slot < stop:
        shard, at = divmod(slot, m["per_shard"])
        here = min(stop - slot, m["per_shard"] - at)
        with where.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
            f.seek(at * m["stride"])
            yield from np.frombuffer(f.read(here * m["stride"]), m["dtype"]).reshape(here, m["length"])
        slot += here


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(read_table(spark, sf_dir, "documents"), table_path(spark, "shards"))


QUERIES = {"op7_training_order": op7_training_order}
ORACLES: dict[str, str] = {}
