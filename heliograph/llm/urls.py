r"""URL filter by the ratio of two character models. DataFrame functions only.

Rules judge the urls that they fit; a url's host is what follows the first `://` up to `/`, `?`, `#` or
the end (A-Z folded), its path then up to `?`, `#` or the end. Of several rules the longest decides.

The others are judged by two variable-order Markov models, one of accepted and one of rejected urls,
learnt from the urls that rules judge (host and path, digits as `0`). Each character is predicted from
the up to `order` before it; an order's estimate is mixed with the next lower one's by Witten-Bell
weights, down to a uniform one, so that contexts never seen pass all weight on. A url's score is
the mean difference of log probability (accepted less rejected) over its characters, so that length
plays no part. The threshold is calibrated on urls kept from the models (a fifth, by hash): of the
scores in steps of 1/100, the one that parts accepted from rejected best.

Grams are summed before they are joined; scores of grams are broadcast only if they number at most
`small`, and joined by a shuffle beyond. A null url, or one without `://`, has an empty host and path and
no characters: its score is 0. Without urls of both classes every score is 0, and 0 is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import materialize, read_table

#: (verdict, host, path): fixed values.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
START = "\x02"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds host, path, rule (as host + path, else null) and ruled (the rule's verdict, else null)."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest comes last, and wins
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return out.withColumns({"rule": rule, "ruled": ruled})


def _grams(order: int) -> Column:
    """The runs of order + 1 characters that end at each character of the text `t`, padded at its start."""
    padded = F.concat(F.lit(START * order), F.col("t"))
    return F.when(F.length("t") > 0, F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring(padded, i, F.lit(order + 1)))).otherwise(F.array().cast("array<string>"))


def model(counts: DataFrame, order: int) -> DataFrame:
    """gram, diff: log probability of each gram's last character, accepted less rejected.

    counts: gram, accepted, rejected: occurrences in the urls of each class (0 where only seen elsewhere)."""
    prob = None
    for k in range(order + 1):  # from no context up
        own = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("g")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        context = own.groupBy(F.substring("g", 1, k).alias("c")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
        own = own.withColumn("c", F.substring("g", 1, k)).join(context, "c")
        if prob is None:
            own = own.withColumns({"pa": F.lit(1.0 / 256), "pr": F.lit(1.0 / 256)})
        else:
            low = prob.select(F.col("g").alias("s"), "pa", "pr")
            own = own.join(low, F.substring("g", 2, k) == F.col("s")).drop("s")

        def mixed(n: str, total: str, types: str, below: str) -> Column:
            return F.when(F.col(total) > 0, (F.col(n) + F.col(types) * F.col(below)) / (F.col(total) + F.col(types))).otherwise(F.col(below))

        prob = materialize(own.select("g", mixed("a", "na", "ta", "pa").alias("pa"), mixed("r", "nr", "tr", "pr").alias("pr")), f"url_order{k}")
    return prob.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("diff"))


def judge(pages: DataFrame, rules: tuple = RULES, order: int = 4, small: int = 500_000) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score. One row for each row of pages."""
    judged = with_rule(pages.select("page_id", "url"), rules)
    text = F.regexp_replace(F.lower(F.concat("host", "path")), "[0-9]", "0")
    # equal hosts and paths are scored once
    rows = judged.withColumn("t", text)
    texts = rows.groupBy("t", "ruled").agg(F.count("*").alias("n"))
    texts = materialize(texts.withColumn("held", F.pmod(F.xxhash64("t"), F.lit(5)) == 0), "urls")
    learn = F.when(F.col("held"), F.lit(0)).otherwise(F.col("n"))
    accepted, rejected = (F.when(F.col("ruled") == v, learn).otherwise(F.lit(0)) for v in ("allow", "block"))
    each = texts.select(accepted.alias("a"), rejected.alias("r"), F.explode(_grams(order)).alias("gram"))
    counts = materialize(each.groupBy("gram").agg(F.sum("a").alias("accepted"), F.sum("r").alias("rejected")), "url_grams")
    seen = counts.agg(F.coalesce(F.sum("accepted"), F.lit(0)), F.coalesce(F.sum("rejected"), F.lit(0)), F.count("*")).first()
    if not (seen[0] and seen[1]):
        out = rows.withColumn("score", F.lit(0.0))
        threshold = 0.0
    else:
        diff = materialize(model(counts, order), "url_model")
        grams = texts.select("t").distinct().select("t", F.explode(_grams(order)).alias("gram"))
        scores = grams.join(F.broadcast(diff) if seen[2] <= small else diff, "gram").groupBy("t").agg(F.round(F.avg("diff"), 6).alias("score"))
        scores = materialize(scores.select(F.col("t").alias("of"), "score"), "url_scores")
        known = texts.filter("ruled is not null and held").join(scores, F.col("t") == F.col("of")).groupBy(F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "score")) * 100).alias("step")).pivot("ruled", ["allow", "block"]).agg(F.sum("n"))
        threshold = _threshold([(r.step, r.allow or 0, r.block or 0) for r in known.collect()])  # 4001 steps at most
        out = rows.join(scores, rows["t"] == scores["of"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _threshold(steps: list[tuple[int, int, int]]) -> float:
    """The score from which urls are allowed, with the largest sum of both classes' shares judged right."""
    allow, block = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not (allow and block):
        return 0.0
    best, at, below_a, below_b = -1.0, 0.0, 0, 0
    for step, a, b in [*sorted(steps), (10**6, 0, 0)]:
        right = (allow - below_a) / allow + below_b / block
        if right > best and step < 10**6:
            best, at = right, step / 100
        below_a, below_b = below_a + a, below_b + b
    return at


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES: dict[str, str] = {}
