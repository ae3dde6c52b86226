"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the presence of its character 3-, 4- and 5-grams (a-z and A-Z folded),
hashed into 2**20 buckets. On the training rows each bucket gets the log ratio of its smoothed
document frequency among toxic rows to that among clean rows; the buckets whose ratio is most
significant are kept, and a ridge logistic regression is fitted on presence x ratio. How many are kept is
chosen among `keep` by the loss on a fifth of the training rows (by hash of the text, so that copies stay
together) that a first fit does not see; ties go to fewer. Every whole
text is scored in one pass without a shuffle; the model (a table of 2**20 floats) is broadcast.

Only the fit sees a bounded sample: at most `max_rows` labelled rows of each class, those with
the smallest hash of doc_id. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.common import TextBatch, materialize, read_table, with_text
from heliograph.llm.textscan import code_points, runs

BUCKETS = 1 << 20
ORDERS = (3, 4, 5)


@dataclass
class Model:
    weight: np.ndarray  # float32 by bucket, 0 where a bucket is not used
    bias: float


def _codes(run: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, A-Z folded, and the offset of each text."""
    cp, start = code_points(run)
    return cp + (((cp >= 65) & (cp <= 90)).astype(np.uint32) << 5), start


def _gram_buckets(cp: np.ndarray, n: int) -> np.ndarray:
    if len(cp) < n:
        return np.zeros(0, np.uint32)
    h = np.full(len(cp) - n + 1, n, np.uint32)
    for k in range(n):
        h = (h + cp[k : len(cp) - n + 1 + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def _hits(run: TextBatch, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (row, bucket) of the buckets in use."""
    cp, start = _codes(run)
    found = []
    for n in ORDERS:
        b = _gram_buckets(cp, n)
        at = np.flatnonzero(used[b])
        doc = np.searchsorted(start, at, side="right") - 1
        inside = at + n <= start[doc + 1]
        found.append(doc[inside] * BUCKETS + b[at[inside]])
    pairs = np.unique(np.concatenate(found))
    return pairs // BUCKETS, pairs % BUCKETS


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 2000, keep: tuple[int, ...] = (300, 1000, 2000), ridge: float = 1e-3, steps: int = 300) -> Model:
    """Fit on labelled rows. labels: doc_id and toxic (1 or 0; other values and nulls are left out;
    of repeated rows the largest counts). Without rows of both classes every score is the base rate,
    0.5 at no rows."""
    clean = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = clean.filter("toxic = 1").orderBy(*order).limit(max_rows).unionByName(clean.filter("toxic = 0").orderBy(*order).limit(max_rows))
    # at most 2 * max_rows rows of two numbers: broadcast, so that no text is shuffled
    part = (F.pmod(F.xxhash64(F.col("text"), F.lit(7)), F.lit(5)) == 0).cast("int")
    rows = with_text(documents, "doc_id").join(F.broadcast(chosen), "doc_id").select((F.col("toxic") + 2 * part).cast("int").alias("toxic"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.ones(BUCKETS, bool)
        for batch in batches:
            toxic = batch.column(0).to_pylist()
            for at, run in runs(batch.column(1)):
                doc, bucket = _hits(run, every)
                cut = np.searchsorted(doc, np.arange(run.n + 1))
                yield pa.RecordBatch.from_arrays([pa.array(toxic[at : at + run.n], pa.int32()), pa.array([bucket[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in range(run.n)], pa.binary())], ["toxic", "buckets"])

    # the driver gets sums by bucket, then the kept buckets of each row: never whole feature lists
    table = materialize(rows.mapInArrow(extract, "toxic int, buckets binary"), "toxicity_rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((4, BUCKETS), np.int32), np.zeros(4, np.int64)  # by toxic + 2 where the row is held for the choice
        for batch in batches:
            for t, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[t, np.frombuffer(b, np.int32)] += 1  # a row's buckets are distinct
                n[t] += 1
        used = np.flatnonzero(sums.any(0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([used.tobytes()], pa.binary()), pa.array([sums[:, used].tobytes()], pa.binary())], ["n", "used", "sums"])

    seen, in_class = np.zeros(4, np.int64), np.zeros((4, BUCKETS), np.int32)  # a bucket has one count a row at most
    for r in table.coalesce(4).mapInArrow(count, "n binary, used binary, sums binary").toLocalIterator():
        seen += np.frombuffer(r.n, np.int64)
        used = np.frombuffer(r.used, np.int32)
        in_class[:, used] += np.frombuffer(r.sums, np.int32).reshape(4, -1)
    n_neg, n_pos = seen[0] + seen[2], seen[1] + seen[3]
    if not (n_neg and n_pos):
        rate = (n_pos + 1) / (seen.sum() + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))))
    whole = _surest(in_class[0] + in_class[2], in_class[1] + in_class[3], n_neg, n_pos, max(keep))
    choose = bool(len(keep) > 1 and seen.all())
    inner = _surest(in_class[0], in_class[1], seen[0], seen[1], max(keep)) if choose else whole
    both = np.union1d(whole[0], inner[0])
    slot = np.full(BUCKETS, -1, np.int32)
    slot[both] = np.arange(len(both))
    held = documents.sparkSession.sparkContext.broadcast(slot)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [s[s >= 0].tobytes() for s in (held.value[np.frombuffer(b, np.int32)] for b in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.binary())], ["toxic", "slots"])

    got = table.mapInArrow(kept, "toxic int, slots binary").collect()
    got.sort(key=lambda r: (r.toxic, bytes(r.slots)))  # the same model whatever order the rows came in
    mark = np.array([r.toxic for r in got], np.int64)
    cols = [np.frombuffer(r.slots, np.int32) for r in got]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = both[np.concatenate(cols)] if cols else np.zeros(0, np.int64)
    size = max(keep)
    if choose:
        train, rest = mark < 2, mark >= 2
        losses = []
        for k in sorted(keep):
            weight, bias = _regress(row, col, mark % 2, train, inner[0][:k], inner[1][:k], ridge, steps)
            z = np.clip(np.bincount(row, weights=weight[col], minlength=len(mark)) + bias, -40, 40)[rest]
            y = mark[rest] % 2
            loss = np.log1p(np.exp(-np.where(y == 1, z, -z)))
            losses.append((round(float(loss[y == 1].mean() + loss[y == 0].mean()), 6), k))
        size = min(losses)[1]
    weight, bias = _regress(row, col, mark % 2, np.ones(len(mark), bool), whole[0][:size], whole[1][:size], ridge, steps)
    return Model(weight.astype(np.float32), float(bias))


def _surest(in_neg: np.ndarray, in_pos: np.ndarray, n_neg: int, n_pos: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the most significant log-count ratios, the surest first, and their ratios."""
    ratio = np.log((in_pos + 1) / (n_pos + 2)) - np.log((in_neg + 1) / (n_neg + 2))
    sure = np.abs(ratio) / np.sqrt(1 / (in_pos + 1) + 1 / (in_neg + 1))
    best = np.argsort(-sure, kind="stable")[:keep]
    return best, ratio[best]


def _regress(row: np.ndarray, col: np.ndarray, y: np.ndarray, used: np.ndarray, best: np.ndarray, r: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the bias: a logistic regression of y on presence (row, col) x ratio r of the
    buckets `best`, over the used rows, both classes weighing the same."""
    slot = np.full(BUCKETS, -1, np.int64)
    slot[best] = np.arange(len(best))
    inside = (slot[col] >= 0) & used[row]
    row, col = row[inside], slot[col[inside]]
    w, bias = np.zeros(len(best)), 0.0
    m_w, v_w, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / max(1, (y[used] == 1).sum()), 0.5 / max(1, (y[used] == 0).sum())) * used
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=(w * r)[col], minlength=len(y)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance
        gw = np.bincount(col, weights=g[row], minlength=len(w)) * r + ridge * w
        gb = g.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * gw, 0.999 * v_w + 0.001 * gw * gw
        m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.999 * v_b + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.02 * (m_w / a) / (np.sqrt(v_w / c) + 1e-8)
        bias -= 0.02 * (m_b / a) / (np.sqrt(v_b / c) + 1e-8)
    weight = np.zeros(BUCKETS)
    weight[best] = w * r
    return weight, bias


def score(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of documents, and score (0 to 1, higher: likelier toxic) and predicted (1 if score
    is at least the threshold). A null text counts as empty; an empty text has the bias alone.
    Columns named score or predicted are replaced. No shuffle; rows keep their number."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(model)
    base = documents.drop("score", "predicted")
    at = base.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = held.value.weight, held.value.bias
        used = weight != 0
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, run in runs(batch.column(at)):
                doc, bucket = _hits(run, used)
                z = np.bincount(doc, weights=weight[bucket].astype(np.float64), minlength=run.n) + bias
                scores[first : first + run.n] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return base.mapInArrow(apply, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = fit(documents, training_labels(read_table(spark, sf_dir, "labels")))
    return score(with_text(documents, "doc_id"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
