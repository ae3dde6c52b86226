"""Quality rules: perplexity under an n-gram model with modified Kneser-Ney smoothing.

The model is over 5-grams of symbols, one model a language: letters a-z without case, digits as one, white
space as one, ASCII punctuation in four kinds, and every other code point by itself (from U+1000 they share
2048 symbols by hash). Twelve bits a symbol make a 5-gram an exact 60-bit key. What tasks count and Spark
sums grows with the corpus. Models without these classes of ASCII part the labelled junk of the driver's tables
less well, as bars and brackets are then single rare symbols (README).

1. Every task counts the 5-grams of all its texts; Spark sums them by language and 5-gram. All of them make the
   model, however rare.
2. Lower orders use continuation counts; the discounts D1, D2, D3+ of each order come from its counts of counts. A
   model of at most `small` 5-grams is collected and broadcast: the arrays of each order are kept sorted by hash and
   searched by bisection. A larger one is computed in tables, order by order (a key meets at most 4096 rows in each of
   their joins); only 5-grams of at least 1 / small of all positions, which are `small` at most, are then
   broadcast with their probabilities, and a text's other 5-grams are looked up by a join. Both ways give the same.
3. A second pass scores every whole text: mean negative log probability, whose exponent is the
   perplexity. The bands of a language come from the quartiles of its log perplexities over all
   documents that pass the base rules (see judge).

A null text has no words; a null lang is a language of its own (''). Texts of fewer than five code
points have no perplexity, and no verdict against them but the base rules'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import TextBatch, materialize, read_table
from heliograph.llm.textscan import base_statistics, code_points, runs

BITS = 12
ORDER = 5
#: 5-grams that may be collected and broadcast.
SMALL = 2_000_000
#: Languages whose bands may be broadcast.
FEW = 10_000


def _ascii() -> np.ndarray:
    """ASCII symbols: letters without case, one for digits, one for white space, four for punctuation."""
    table = np.full(128, 31, np.int64)
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = np.arange(26)
    table[ord("0") : ord("9") + 1] = 26
    for k, marks in enumerate((" \t\n\v\f\r", ".,;:!?", "'\"()[]{}-/", "#*$%&|<>")):
        table[[ord(c) for c in marks]] = 27 + k
    return table


_ASCII = _ascii()


def symbols(cp: np.ndarray) -> np.ndarray:
    """Code points as 12-bit symbols."""
    c = cp.astype(np.int64)
    return np.where(c < 128, _ASCII[np.minimum(c, 127)], np.where(c < 4096, c, 2048 + ((c * 0x9E3779B1 >> 7) & 2047)))


def grams(run: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """The key of the 5-gram at each code point, and the text it lies in."""
    cp, start = code_points(run)
    if len(cp) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = symbols(cp)
    m = len(c) - ORDER + 1
    g = np.zeros(m, np.int64)
    for k in range(ORDER):
        g = (g << BITS) | c[k : m + k]
    doc = np.repeat(np.arange(run.n), np.diff(start))
    inside = doc[:m] == doc[ORDER - 1 :]
    return g[inside], doc[:m][inside]


def count_grams(documents: DataFrame) -> DataFrame:
    """lang, gram, n over all texts. Each task sends each of its grams once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def fold(held: list) -> list:
            keys = np.concatenate([k for k, _ in held])
            n = np.concatenate([v for _, v in held])
            uniq, inverse = np.unique(keys, return_inverse=True)
            return [(uniq, np.bincount(inverse, weights=n).astype(np.int64))]

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for at, run in runs(batch.column(1)):
                g, doc = grams(run)
                names, code = np.unique(langs[at : at + run.n], return_inverse=True)
                each = code[doc]
                for k, lang in enumerate(names):
                    uniq, n = np.unique(g[each == k], return_counts=True)
                    held = found.setdefault(lang, [])
                    held.append((uniq, n))
                    if len(held) >= 16:
                        held[:] = fold(held)
        for lang, held in found.items():
            uniq, n = fold(held)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(uniq), pa.string()), pa.array(uniq), pa.array(n)], ["lang", "gram", "n"])

    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _order(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One order's discounted counts: the share of each key (count less discount over its context's
    total), and each context's weight for the order below. keys are sorted."""
    ones = [max(1, int((n == k).sum())) for k in (1, 2, 3, 4)]
    y = ones[0] / (ones[0] + 2 * ones[1])
    d = np.clip([0, 1 - 2 * y * ones[1] / ones[0], 2 - 3 * y * ones[2] / ones[1], 3 - 4 * y * ones[3] / ones[2]], [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])
    cut = d[np.minimum(n, 3)]
    context, place = np.unique(keys >> BITS, return_inverse=True)
    total = np.bincount(place, weights=n)
    return np.maximum(n - cut, 1e-9) / total[place], context, np.bincount(place, weights=cut) / total, place


def kneser_ney(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 1 up: sorted keys, their log probabilities, sorted contexts, their log
    weights of backing off. keys: the sorted distinct 5-grams with their counts n."""
    levels = [(keys.astype(np.int64), n.astype(np.int64))]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
        low, cont = np.unique(levels[-1][0] & ((1 << (BITS * order)) - 1), return_counts=True)
        levels.append((low, cont))
    model: list = []
    for key, count in reversed(levels):
        share, context, weight, place = _order(key, count)
        if model:
            low_keys, low_p = model[-1][0], np.exp(model[-1][1])
            below = low_p[np.searchsorted(low_keys, key & ((1 << (BITS * len(model))) - 1))]
        else:
            below = 1.0 / (1 << BITS)
        model.append((key, np.log(share + weight[place] * below), context, np.log(np.maximum(weight, 1e-12))))
    return model


def log_probability(model: list, g: np.ndarray) -> np.ndarray:
    """Log probability of each 5-gram's last character; unseen ones back off to shorter contexts."""
    out = np.zeros(len(g))
    left = np.arange(len(g))
    for order in range(ORDER, 0, -1):
        keys, logp, contexts, backoff = model[order - 1]
        k = g[left] & ((1 << (BITS * order)) - 1)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hit = keys[at] == k
        out[left[hit]] += logp[at[hit]]
        left, k = left[~hit], k[~hit]
        at = np.minimum(np.searchsorted(contexts, k >> BITS), len(contexts) - 1)
        out[left] += np.where(contexts[at] == k >> BITS, backoff[at], 0)
    out[left] += np.log(1.0 / (1 << BITS))
    return out


class Model(dict):
    """By language, the orders that kneser_ney makes; or, of a model beyond `small`, the sorted frequent 5-grams with
    their log probabilities, and in `tables` all orders (see in_tables)."""

    tables: list[tuple[DataFrame, DataFrame]] | None = None


def _by_language(table: pa.Table, key: str, value: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each language's keys, sorted, and their values."""
    lang = table.column("lang").combine_chunks().dictionary_encode()
    names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    keys, values = table.column(key).to_numpy(), table.column(value).to_numpy()
    for k, name in enumerate(names):
        own = np.flatnonzero(code == k)
        own = own[np.argsort(keys[own], kind="stable")]
        yield name, keys[own], values[own]


def in_tables(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """kneser_ney in tables. For each order from 1 up: lang, key, n, p of what was seen; lang, context, weight."""
    level = counts.select("lang", F.col("gram").alias("key"), "n")
    levels = []
    for order in range(ORDER, 0, -1):
        if levels:  # continuation counts: distinct characters before
            level = levels[-1].groupBy("lang", _low("key", order).alias("key")).agg(F.count("*").alias("n"))
        levels.append(materialize(level, f"quality_order{order}"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for order, level in enumerate(reversed(levels), 1):
        ones = level.groupBy("lang").agg(*(F.greatest(F.lit(1), F.count_if(F.col("n") == k)).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        d = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05 * k)), F.lit(0.95 * k)).alias(f"d{k}") for k in (1, 2, 3)]
        cuts = materialize(ones.select("lang", *d), "quality_discounts")
        rows = level.join(F.broadcast(cuts) if cuts.count() <= FEW else cuts, "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("lang", "key", "n", cut.alias("cut"), F.shiftright("key", BITS).alias("context"), _low("key", order - 1).alias("low"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"))
        contexts = materialize(contexts, f"quality_contexts{order}")
        rows = rows.join(contexts, ["lang", "context"])
        below = F.lit(1.0 / (1 << BITS))
        if out:
            rows = rows.join(out[-1][0].select("lang", F.col("key").alias("low"), F.col("p").alias("below")), ["lang", "low"])
            below = F.col("below")
        p = F.greatest(F.col("n") - F.col("cut"), F.lit(1e-9)) / F.col("total") + F.col("weight") * below
        out.append((materialize(rows.select("lang", "key", "n", p.alias("p")), f"quality_seen{order}"), contexts.select("lang", "context", "weight")))
    return out


def _low(key: str, order: int) -> F.Column:
    """The last `order` symbols of a key."""
    return F.col(key).bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def look_up(tables: list[tuple[DataFrame, DataFrame]], keys: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, key, p of the distinct rows keys (lang, key): the probability of each key's last character. Unseen keys back
    off to shorter contexts."""
    if order == 0:
        return keys.withColumn("p", F.lit(1.0 / (1 << BITS)))
    seen, contexts = tables[order - 1]
    rows = materialize(keys.join(seen.select("lang", "key", "p"), ["lang", "key"], "left"), "quality_looked_up")
    unseen = rows.filter("p is null").select("lang", "key", _low("key", order - 1).alias("low"), F.shiftright("key", BITS).alias("context"))
    if unseen.isEmpty():
        return rows
    lower = look_up(tables, unseen.select("lang", F.col("low").alias("key")).distinct(), order - 1).select("lang", F.col("key").alias("low"), F.col("p").alias("below"))
    met = unseen.join(lower, ["lang", "low"]).join(contexts, ["lang", "context"], "left")
    return rows.filter("p is not null").unionByName(met.select("lang", "key", (F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p")))


def fit(documents: DataFrame, share: float = 0.0, small: int = SMALL) -> Model:
    """The model of each language, from all texts. With a share, of the 5-grams that make up that part of all
    positions at least."""
    counts = materialize(count_grams(documents), "quality_grams")
    positions = counts.agg(F.sum("n")).first()[0] or 0
    if share:
        counts = counts.filter(F.col("n") >= share * positions)
    model = Model()
    if counts.count() <= small:
        for name, keys, n in _by_language(counts.toArrow(), "gram", "n"):
            model[name] = kneser_ney(keys, n)
        return model
    model.tables = in_tables(counts)
    often = model.tables[-1][0].filter(F.col("n") * small >= positions)
    for name, keys, logp in _by_language(often.select("lang", "key", F.log("p").alias("logp")).toArrow(), "key", "logp"):
        model[name] = (keys, logp)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, the base statistics and log_perplexity (null for texts under five code points)."""
    held = documents.sparkSession.sparkContext.broadcast(dict(model))
    whole = model.tables is None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for at, run in runs(batch.column(2)):
                g, doc = grams(run)
                kinds, code = np.unique(langs[at : at + run.n], return_inverse=True)
                loss = np.zeros(run.n)
                each = code[doc]
                rest = np.zeros(len(g), bool)  # 5-grams to be looked up in the tables
                for k, lang in enumerate(kinds):
                    own = each == k
                    if lang in held.value and own.any():
                        uniq, inverse = np.unique(g[own], return_inverse=True)
                        if whole:
                            logp = log_probability(held.value[lang], uniq)
                        else:
                            keys, values = held.value[lang]
                            place = np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)
                            found = keys[place] == uniq
                            logp = np.where(found, values[place], 0)
                            rest[own] = ~found[inverse]
                        loss -= np.bincount(doc[own], weights=logp[inverse], minlength=run.n)
                    elif whole:  # nothing is known of this language
                        loss += np.bincount(doc[own], minlength=run.n) * np.log(1 << BITS)
                    else:
                        rest |= own
                size = np.bincount(doc, minlength=run.n)
                stats = base_statistics(run)
                columns = [batch.column(0).slice(at, run.n), batch.column(1).slice(at, run.n), *(pa.array(stats[k]) for k in names)]
                if whole:
                    mean = pa.array(loss / np.maximum(size, 1), pa.float64(), mask=size == 0)
                    yield pa.RecordBatch.from_arrays([*columns, mean], ["doc_id", "lang", *names, "log_perplexity"])
                else:
                    start = np.concatenate([[0], np.cumsum(np.bincount(doc[rest], minlength=run.n))])
                    lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(g[rest]))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(loss), pa.array(size), lists], ["doc_id", "lang", *names, "loss", "size", "rest"])

    texts = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    if whole:
        return texts.mapInArrow(apply, f"{schema}, log_perplexity double")
    rows = texts.mapInArrow(apply, f"{schema}, loss double, size bigint, rest array<bigint>").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "quality_open")
    rest = rows.select("row", "lang", F.explode("rest").alias("key"))
    met = look_up(model.tables, rest.select("lang", "key").distinct())
    sums = rest.join(met, ["lang", "key"]).groupBy("row").agg((-F.sum(F.log("p"))).alias("more"))
    loss = F.col("loss") + F.coalesce("more", F.lit(0.0))
    out = rows.drop("rest").join(sums, "row", "left").withColumn("log_perplexity", F.when(F.col("size") > 0, loss / F.col("size")))
    return out.drop("row", "loss", "size", "more")


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def judge(documents: DataFrame, below: float = 1.0, least_below: float = 0.085, above: float = 2.0, least_above: float = 0.06, small: int = SMALL) -> DataFrame:
    """doc_id, lang, base statistics, base_failed, perplexity, its bands, and kept: passes the base
    rules and lies between the bands. One row per document, in no order.

    The bands of a language are the quartiles of its log perplexities, moved out by `below` and `above`
    times their distance, by `least_below` and `least_above` at least, and by one standard error of a
    mean over the text's characters. The lower band is near: junk repeats itself and is predictable,
    while prose is never much more predictable than its language. The upper band follows the
    measured spread; it costs some prose that turns to another language midway."""
    rows = materialize(score(documents, fit(documents, small=small)).withColumn("base_failed", base_failed()), "quality")
    q = rows.filter("not base_failed and log_perplexity is not null").groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10000).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    bands = q.select(F.col("lang").alias("of"), (lo - F.greatest((hi - lo) * below, F.lit(least_below))).alias("lo"), (hi + F.greatest((hi - lo) * above, F.lit(least_above))).alias("hi"))
    error = F.lit(1.0) / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    bands = materialize(bands, "quality_bands")
    out = rows.join(F.broadcast(bands) if bands.count() <= FEW else bands, rows["lang"] == bands["of"], "left").withColumns({"perplexity": F.exp("log_perplexity"), "lower": F.exp(F.col("lo") - error), "upper": F.exp(F.col("hi") + error)}).drop("of", "lo", "hi", "log_perplexity")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(True)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "perplexity", "lower", "upper")


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES: dict[str, str] = {}
