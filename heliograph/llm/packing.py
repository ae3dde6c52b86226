"""Best-fit packing into bins of several permitted lengths.

Texts are cut into pieces of at most the largest length (every full piece fills a bin by itself) and
the pieces dealt by hash into shards of about `shard_rows`. A shard packs its pieces, longest first,
each into the fullest open bin that still holds it. Where none does, a bin is opened whose size costs
least for each token that it is expected to hold: for each permitted length, the piece and the largest
waiting pieces that fit after it are laid in one by one, and the length's cost is divided by their
sum. In the end each bin shrinks to the least permitted length that holds its contents.

A shard holds lengths and ids, never texts; the number of shards grows with the rows. Null and empty
texts are one piece of the end mark alone. Repeated rows, and ids that are null, are packed like any
others: pieces are told apart by where they stand.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import materialize, parts, read_table

LENGTHS = (512, 1024, 2048, 4096)


def default_cost(length: int) -> float:
    """A linear share for each token, a quadratic one for attention, and a fixed one for each bin."""
    return 64.0 + length * (1.0 + length / 16384.0)


def pack(lengths: np.ndarray, permitted: Sequence[int], cost: Callable[[int], float] = default_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece (lengths, longest first): its bin and its offset; and each bin's final length."""
    sizes = sorted(permitted)
    price = [cost(s) for s in sizes]
    n = len(lengths)
    distinct, counts = np.unique(lengths, return_counts=True)
    kinds, left = distinct.tolist(), dict(zip(distinct.tolist(), counts.tolist(), strict=True))
    open_bins: list[tuple[int, int]] = []  # (room, -bin), sorted
    used: list[int] = []
    in_bin, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def expected(size: int, first: int) -> int:
        room, total = size - first, first
        at = bisect_right(kinds, min(room, first)) - 1
        while at >= 0 and room > 0:
            kind = kinds[at]
            take = min(left[kind], room // kind) if kind <= room else 0
            room -= take * kind
            total += take * kind
            at = min(at - 1, bisect_right(kinds, room) - 1)
        return total

    for k in range(n):
        size = int(lengths[k])
        left[size] -= 1
        if left[size] == 0:
            kinds.pop(bisect_right(kinds, size) - 1)
        at = bisect_right(open_bins, (size, -n - 1))
        if at < len(open_bins):
            room, bin_id = open_bins.pop(at)
            bin_id = -bin_id
        else:
            fits = [j for j, s in enumerate(sizes) if s >= size]
            best = min(fits, key=lambda j: (price[j] / max(1, expected(sizes[j], size)), sizes[j]))
            room, bin_id = sizes[best], len(used)
            used.append(0)
        in_bin[k], offset[k] = bin_id, used[bin_id]
        used[bin_id] += size
        if room > size:
            insort(open_bins, (room - size, -bin_id))
    final = np.array([sizes[np.searchsorted(sizes, u)] for u in used], np.int64)
    return in_bin, offset, final


def best_fit(rows: DataFrame, length: str, permitted: Sequence[int] = LENGTHS, shard_rows: int = 2048, cost: Callable[[int], float] = default_cost) -> DataFrame:
    """rows: doc_id and a length column (0 or more; null counts as 0). One row for each piece: doc_id,
    piece, start, length, shard, bin, offset and bin_length."""
    top = max(permitted)
    tokens = F.coalesce(F.col(length).cast("long"), F.lit(0)) + 1  # the end mark
    pieces = rows.select("doc_id", tokens.alias("_n")).select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {top}"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.col("_n") - F.col("piece") * top, F.lit(top)).alias("length"))
    pieces = materialize(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    # a row's number in its file splits equal rows; the table is written, so that it stays the same
    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        group["bin"], group["offset"], final = pack(group["length"].to_numpy(), permitted, cost)
        group["bin_length"] = final[group["bin"].to_numpy()]
        return group[["doc_id", "piece", "start", "length", "shard", "bin", "offset", "bin_length"]]

    out = spread.repartition(min(shards, max(parts(rows.sparkSession), shards // 64)), "shard").groupBy("shard")
    return out.applyInPandas(shard, f"doc_id {kind}, piece bigint, start bigint, length bigint, shard bigint, bin bigint, offset bigint, bin_length bigint")


def n_tokens() -> F.Column:
    """Words of the text, parted by ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def pack_documents(documents: DataFrame, permitted: Sequence[int] = LENGTHS) -> DataFrame:
    return best_fit(documents.select("doc_id", n_tokens().alias("n")), "n", permitted)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLES: dict[str, str] = {}
