"""K-d tree sharding: split at weighted medians along the widest metadata dimension, down to the target bytes.

Dimensions: text size, language, source and id, each scaled to 20 bits over its range (nulls come first; of a
string the six bytes that follow what all of the column's strings begin with give the place, the whole string's hash
parts strings equal in these). A node splits along the dimension whose range within the node
is the widest part of its range over all rows; ties go to the first named. Each row's key on that
dimension is the scaled value followed by 40 hashed bits of its string and of its own, so that rows equal in it can be
parted. The weighted median of the keys is found without sorting or moving rows: one pass sums the
bytes of every node in 4096 steps of the key, the step that holds the median becomes the range of the
next pass, until that step weighs next to nothing. All nodes of a level share a pass. Nodes, steps and
cuts stay in tables; the driver sees counts only. The rows' nodes are written once a level.

With a target, every leaf above it splits again, others do not; a leaf of one row, or of rows that no key
parts, stays as it is. With a number of shards, a node of m shards is cut where m // 2 of m parts of its bytes lie.

Rows are numbered within a shard (slot) by the counts of hash buckets, so no shard is one task.
Null texts have size 1 and the checksum 0; a long text counts by its whole size and is one row. Repeated rows are
parted by their place in the written table; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.common import materialize, read_table

DIMS = ("size", "lang", "source", "doc_id")
_STEPS = 12  # bits of a key that a pass tells apart
_KEY = 60


SMALL = 500_000


def _place(c: str, kind: str, shared: int) -> Column:
    """A value's place on its dimension as a double; shared: bytes that all strings begin with."""
    if kind == "string":
        return F.coalesce(F.conv(F.rpad(F.substring(F.hex(c), 2 * shared + 1, 12), 12, "0"), 16, 10).cast("double"), F.lit(0.0))
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _keys(table: DataFrame, dims: list[str]) -> DataFrame:
    """Adds the key of each dimension: 20 bits of its place, 40 hashed bits."""
    kinds = dict(table.dtypes)
    texts = [d for d in dims if kinds[d] == "string"]
    shared = dict.fromkeys(dims, 0)
    if texts:
        ends = table.agg(*(f(d) for d in texts for f in (F.min, F.max))).first()
        for k, d in enumerate(texts):
            shared[d] = len(os.path.commonprefix([(ends[2 * k + j] or "").encode() for j in (0, 1)]))
    places = {d: _place(d, kinds[d], shared[d]) for d in dims}
    ends = table.agg(*(f(places[d]) for d in dims for f in (F.min, F.max))).first()
    own = F.xxhash64("_uid")
    out = {}
    for k, d in enumerate(dims):
        lo, hi = ends[2 * k] or 0.0, ends[2 * k + 1] or 0.0
        scaled = F.floor((places[d] - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(2.0**20 - 1)).cast("long")
        tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64(d), 44), 20) + F.shiftrightunsigned(own, 44) if d in texts else F.shiftrightunsigned(own, 24)
        out[f"_k{k}"] = F.shiftleft(scaled, 40) + tie
    return table.withColumns(out)


def kd_shards(rows: DataFrame, target: int | None = None, shards: int = 8, small: int = SMALL) -> DataFrame:
    """rows: size and the dimensions. Adds shard, from 0: of `shards` shards of near equal bytes, or as many as it
    takes until leaves reach the target bytes. Up to `small` nodes are broadcast, more are joined by a shuffle."""
    dims = [d for d in DIMS if d in rows.columns]
    uids = materialize(rows.withColumn("_uid", F.monotonically_increasing_id()), "kd_rows")
    start = {"_node": F.lit(1).cast("long"), "_m": F.lit(shards).cast("long"), "_first": F.lit(0).cast("long"), "_was": F.lit(None).cast("long")}
    table = materialize(_keys(uids, dims).select("_uid", "size", *(f"_k{k}" for k in range(len(dims)))).withColumns(start), "kd_nodes")
    at = F.coalesce(*(F.when(F.col("dim") == k, F.col(f"_k{k}")) for k in range(len(dims))))
    place = [F.shiftright(F.col(f"_k{k}"), 40) for k in range(len(dims))]
    while True:
        nodes = table.groupBy("_node", "_m", "_first", "_was").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.array(*(F.max(p) - F.min(p) for p in place)).alias("wide"))
        if target:
            nodes = nodes.withColumn("_m", F.when((F.col("w") > target) & (F.col("n") > 1) & (F.col("_was").isNull() | (F.col("w") < F.col("_was"))), 2).otherwise(1))
        dim = (F.array_position("wide", F.array_max("wide")) - 1).cast("int").alias("dim")
        zero = F.lit(0).cast("long")
        going = materialize(nodes.filter("_m > 1").select("_node", F.col("_m").cast("long").alias("m"), "w", dim, zero.alias("low"), zero.alias("before"), F.lit(False).alias("done")), "kd_going")
        number = going.count()
        if not number:
            break
        few = F.broadcast if number <= small else (lambda df: df)
        half = F.floor(F.col("m") / 2).cast("long")
        bits = _KEY
        while bits > 0:
            bits -= _STEPS
            pick = going.filter("not done")
            step = table.select("_node", "size", *(f"_k{k}" for k in range(len(dims)))).join(few(pick.select("_node", "dim", "low")), "_node").withColumn("_s", F.shiftright(at - F.col("low"), bits)).filter(f"_s between 0 and {(1 << _STEPS) - 1}")
            sums = step.groupBy("_node", "_s").agg(F.sum("size").alias("ws"))
            sums = sums.withColumn("upto", F.sum("ws").over(Window.partitionBy("_node").orderBy("_s")))
            chosen = sums.join(few(pick), "_node").filter((F.col("before") + F.col("upto")) * F.col("m") > F.col("w") * half)
            chosen = chosen.groupBy("_node", "m", "w", "dim", "low", "before").agg(F.min(F.struct("_s", "ws", "upto")).alias("x"))
            before = F.col("before") + F.col("x.upto") - F.col("x.ws")
            done = (F.col("x.ws") * 10_000 <= F.col("w")) | F.lit(bits == 0)
            # the nearer end of a step that weighs next to nothing
            after = F.when(done & ((2 * before + F.col("x.ws")) * F.col("m") < 2 * F.col("w") * half), F.lit(1 << bits)).otherwise(0)
            moved = chosen.select("_node", "m", "w", "dim", (F.col("low") + F.shiftleft(F.col("x._s"), bits) + after).cast("long").alias("low"), before.alias("before"), done.alias("done"))
            going = materialize(going.filter("done").unionByName(moved), "kd_going")
            if going.filter("not done").isEmpty():
                break
        cut = few(going.select("_node", "m", "w", "dim", "low"))
        right = (at >= F.col("low")).cast("long")
        split = F.col("m").isNotNull()
        own = F.when(right == 1, F.col("m") - half).otherwise(half)
        table = materialize(
            table.join(cut, "_node", "left").select(
                "_uid", "size", *(f"_k{k}" for k in range(len(dims))), F.when(split, F.col("_node") * 2 + right).otherwise(F.col("_node")).alias("_node"),
                F.when(split, own).otherwise(F.col("_m")).alias("_m"), F.when(split, F.col("_first") + half * right).otherwise(F.col("_first")).alias("_first"), F.when(split, F.col("w")).otherwise(F.col("_was")).alias("_was"),
            ),
            "kd_nodes",
        )
    if target:  # one row for each leaf
        leaves = table.select("_node").distinct()
        leaves = materialize(leaves.withColumn("shard", F.row_number().over(Window.orderBy("_node")) - 1), "kd_leaves")
        found = table.select("_uid", "_node").join(F.broadcast(leaves) if leaves.count() <= small else leaves, "_node").drop("_node")
    else:
        found = table.select("_uid", F.col("_first").cast("int").alias("shard"))
    return uids.join(found, "_uid")


def number_slots(rows: DataFrame, by: str = "_uid", small: int = SMALL) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard, without gaps. rows: shard and a unique column."""
    buckets = max(1, min(4096, rows.count() // 2000))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    offsets = materialize(counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_o")), "kd_offsets")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_b").orderBy(by)))
    return ranked.join(F.broadcast(offsets) if offsets.count() <= small else offsets, ["shard", "_b"]).withColumn("slot", F.col("_o") + F.col("_r") - 1).drop("_b", "_r", "_o")


def shard_documents(documents: DataFrame, shards: int = 8, target: int | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, shard, slot for each row of documents."""
    text = F.col("text").cast("string")
    meta = documents.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    out = number_slots(materialize(kd_shards(meta, target, shards), "kd_shards"))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_kd_sharding": op2_kd_sharding}
ORACLES: dict[str, str] = {}
