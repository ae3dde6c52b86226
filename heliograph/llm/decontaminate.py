"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text is a row of words: runs of characters other than ASCII separators, A-Z folded. Each run of
`k` words has a hash, and of every `window - k + 1` neighbouring hashes the least (of equal ones the last)
is a fingerprint, kept once however many windows share it: about two in five positions. Which it is
depends on the window's words alone, so any `window` words that two texts share in a row hold a
fingerprint at the same place in both. Training and benchmark fingerprints are joined; each hit is
extended word by word to either side, the words themselves are compared, and it counts if `window`
words match. So every shared run of `window` words is found, and nothing else.

An item of fewer than `window` words, but not none, is one run of its own length (there are at most
`window - 1` such lengths): such runs are looked up by hash and joined on their words.

The benchmark's fingerprints are looked up in a table of bits, then broadcast, only if they number at most
`small`; beyond that training fingerprints are joined by a shuffle. Items that share a passage are one row
of it until the end. A null text has no words; very long texts are walked once; a repeated row gets its
own result; rows are told apart by doc_id and the text's hash, null ids included. Empty tables give no hits.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import bitmap, held, materialize, read_table

WINDOW = 8
K = 5
SMALL = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fold(text: Column) -> Column:
    """A-Z to a-z, nothing else. lower() is the same, and faster, where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text: split by separators; the empty strings at either end are removed."""
    return F.array_remove(F.split(fold(F.coalesce(text.cast("string"), F.lit(""))), _BETWEEN), "")


def _gram(i: Column, length: int) -> Column:
    """The hash of the words from place i."""
    return F.xxhash64(*(F.get("v", i + j) for j in range(length)))


def _marked(marks: list[int] | None, h: Column) -> Column:
    if marks is None:
        return F.lit(True)
    table, power = bitmap(marks)
    word = F.get(table, F.shiftrightunsigned(h, 64 - power).cast("int"))
    return F.call_function("bit_get", word, h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _places(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _least_of_a_window(i: Column, span: int) -> Column:
    """Is the hash g[i] the least of some `span` neighbouring ones, the last of equal ones."""
    own = F.get("g", i)

    def reach(step: int, left: int) -> Column:
        """How many neighbours on one side it beats, up to span - 1."""
        if left == span:
            return F.lit(0)
        other = F.get("g", i + step * left)
        return F.when(other > own if step > 0 else other >= own, F.lit(1) + reach(step, left + 1)).otherwise(F.lit(0))

    return reach(-1, 1) + reach(1, 1) >= span - 1


def fingerprints(texts: DataFrame, k: int, window: int, *ids: str, marks: list[int] | None = None) -> DataFrame:
    """ids, s (first word), fp of the fingerprints of texts (v: their words), and around: the words from window - k
    before s to window - k after the k-gram (null beyond the ends). With marks, only those whose bit is set."""
    rows = held(texts.withColumn("g", F.transform(_places(F.when(F.size("v") >= window, F.size("v") - k).otherwise(-1)), lambda i: _gram(i, k))))
    chosen = F.filter(_places(F.size("g") - 1), lambda i: _marked(marks, F.get("g", i)) & _least_of_a_window(i, window - k + 1))
    rows = held(rows.withColumn("at", chosen)).select(*ids, "v", "g", F.explode("at").alias("s"))
    around = F.array(*(F.when(F.col("s") + j >= 0, F.get("v", F.col("s") + j)) for j in range(k - window, window)))
    return rows.select(*ids, "s", F.get("g", F.col("s")).alias("fp"), around.alias("around"))


def _extended(step: int, k: int, window: int) -> Column:
    """How many words match on one side of a hit, up to window - k."""
    first = window - k - 1 if step < 0 else window
    out = F.lit(0)
    for j in reversed(range(window - k)):
        at = F.lit(first + step * j)
        out = F.when(F.get("around", at) == F.get("theirs", at), F.lit(1) + out).otherwise(F.lit(0))
    return out


def _runs(texts: DataFrame, n: int, marks: list[int] | None, *ids: str) -> DataFrame:
    """ids, s, run: the runs of n words, as text; with marks, only those whose bit is set."""
    at = F.filter(_places(F.size("v") - n), lambda i: _marked(marks, _gram(i, n)))
    rows = held(texts.withColumn("at", at)).select(*ids, "v", F.explode("at").alias("s"))
    return rows.select(*ids, "s", F.array_join(F.slice("v", F.col("s") + 1, n), " ").alias("run"))


def _worded(rows: DataFrame, *ids: str) -> DataFrame:
    """ids and v, the words of text."""
    return held(rows.select(*ids, words_of(F.col("text")).alias("v")))


def _hits(documents: DataFrame, benchmark: DataFrame, window: int, k: int, small: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, th (the text's hash), passage, first, last: the hits, each with the first and the last start of its
    matching windows (len words each); and passage, item_id."""
    items = materialize(_worded(benchmark, "item_id"), "benchmark_words")
    own = fingerprints(items, k, window, "item_id")
    own = own.select("item_id", "fp", F.col("around").alias("theirs"), F.xxhash64("fp", F.transform("around", lambda x: F.coalesce(x, F.lit(""))), F.transform("around", lambda x: x.isNull().cast("int"))).alias("passage"))
    own = materialize(own, "benchmark_fingerprints")
    known = own.select("passage", "fp", "theirs").dropDuplicates(["passage"])
    few = known.count() <= small
    marks = [r.fp for r in known.select("fp").distinct().collect()] if few else None
    bounded = F.broadcast if few else (lambda df: df)
    texts = _worded(documents.select("doc_id", "text", F.xxhash64("text").alias("th")), "doc_id", "th")
    met = fingerprints(texts, k, window, "doc_id", "th", marks=marks).join(bounded(known), "fp")
    # the words of the k-gram itself, then those on either side
    core = functools.reduce(lambda a, b: a & b, (F.get("around", F.lit(j)) == F.get("theirs", F.lit(j)) for j in range(window - k, window)))
    met = met.filter(core).withColumns({"before": _extended(-1, k, window), "behind": _extended(1, k, window)}).filter(F.col("before") + F.col("behind") >= window - k)
    found = met.select("doc_id", "th", "passage", (F.col("s") - F.col("before")).alias("first"), (F.col("s") + F.col("behind") - (window - k)).alias("last"), F.lit(window).alias("len"))
    passages = own.select("passage", "item_id")
    short = items.filter(F.size("v").between(1, window - 1)).select("item_id", F.size("v").alias("n"), F.array_join("v", " ").alias("run"))
    short = materialize(short.withColumn("passage", F.xxhash64("n", "run")), "benchmark_short")
    for n in sorted(r.n for r in short.select("n").distinct().collect()):  # at most window - 1 lengths
        mine = short.filter(F.col("n") == n).select("passage", "run").distinct()
        few = mine.count() <= small
        hashed = mine.select(F.xxhash64(*(F.get(F.split("run", " "), F.lit(j)) for j in range(n))).alias("h"))
        every = _runs(texts, n, [r.h for r in hashed.collect()] if few else None, "doc_id", "th")
        hit = every.join(F.broadcast(mine) if few else mine, "run")
        found = found.unionByName(hit.select("doc_id", "th", "passage", F.col("s").alias("first"), F.col("s").alias("last"), F.lit(n).alias("len")))
    return found, passages.unionByName(short.select("passage", "item_id")).distinct()


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, small: int = SMALL) -> DataFrame:
    """One row for each document (doc_id, th) with a hit: spans (array of struct<s, len>, by s, in words),
    n_hit (words inside any span), item_ids (sorted as strings)."""
    hits, passages = _hits(documents, benchmark, window, k, small)
    hits = materialize(hits, "decontaminate")
    items = hits.select("doc_id", "th", "passage").distinct().join(passages, "passage").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    # of one start and length the widest reach
    reach = (F.col("last") - F.col("first") + F.col("len")).alias("len")
    spans = hits.select("doc_id", "th", F.col("first").alias("s"), reach).groupBy("doc_id", "th", "s").agg(F.max("len").alias("len"))
    spans = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("s", "len"))).alias("spans"))
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["s"] + x["len"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["s"] + x["len"] - F.greatest(a["upto"], x["s"]))).alias("n")),
        lambda a: a["n"],
    )
    spans = spans.withColumn("n_hit", step)
    same = spans["doc_id"].eqNullSafe(items["doc_id"]) & (spans["th"] == items["th"])
    return spans.join(items, same).select(spans["doc_id"], spans["th"], "spans", "n_hit", "item_ids")


def decontaminate(documents: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the comma-joined item_ids) and
    contaminated (n_items >= least_items)."""
    found = find(documents, benchmark)
    every = documents.select("doc_id", F.xxhash64("text").alias("th"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    same = every["doc_id"].eqNullSafe(found["doc_id"]) & (every["th"] == found["th"])
    out = every.join(found, same, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        every["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size(ids) >= least_items).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """documents without those of `least_items` items or more; from the others' texts the hit words are cut,
    with the separators after them. Other columns, and rows without hits, stay as they are."""
    found = find(documents, benchmark).select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), F.size("item_ids").alias("_n"), "spans")
    # the words of a text with what follows each, so that the rest can be put together again
    rows = documents.join(found, documents["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(documents["text"]) == F.col("_th")), "left")
    rows = rows.filter(F.coalesce(F.col("_n"), F.lit(0)) < least_items)
    body = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    text = F.col("text").cast("string")
    hit = F.col("_n").isNotNull()
    # first what stands before the first word, then each word with its separators; a fold keeps positions
    pieces = F.when(hit, F.regexp_extract_all(F.regexp_replace(text, "[A-Z]", "a"), F.lit(f"(?:{body})++(?!{body})" + r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*+"), F.lit(0)))
    rows = rows.withColumn("_len", F.transform(pieces, lambda p: F.length(p)))
    rows = rows.withColumn("_lead", F.when(hit, F.length(text) - F.aggregate("_len", F.lit(0), lambda a, x: a + x)))
    rows = rows.withColumn(
        "_kept",
        F.aggregate(
            F.transform("_len", lambda n, i: F.struct(n.alias("n"), i.alias("i"))),
            F.struct((F.col("_lead") + 1).alias("at"), F.substring(text, F.lit(1), F.col("_lead")).alias("out")),
            lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.when(F.exists("spans", lambda s: (s["s"] <= x["i"]) & (x["i"] < s["s"] + s["len"])), a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"], x["n"]))).alias("out")),
            lambda a: a["out"],
        ),
    )
    return rows.withColumn("text", F.when(hit, F.col("_kept")).otherwise(F.col("text"))).select(*documents.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 8) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM runs),
dr AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS run
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT r, s, dr.n, item_id FROM dr JOIN runs ON dr.run = runs.run AND dr.n = runs.n),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY r),
hi AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(len(ids), 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": SQL}
