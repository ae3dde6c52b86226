r"""Personal data: base patterns, and identifiers found by bootstrapped contexts. DataFrame functions only.

Base kinds are regular expressions, leftmost and non-overlapping, with a check on each match; a match
that fails is dropped without retry. Possessive quantifiers keep each search linear and free of
recursion on very long runs; they match the same text. Positions are code points: the text is split by
the same expression, and each match starts after the pieces and matches before it.

The bootstrap reads a text as pieces: runs without white space, cut after `=` and `:`. A piece is what its
enclosing punctuation leaves (its core, a candidate identifier) between a lead and a trail; its patterns are
`L1` (the piece before, and the lead), `L2` (two pieces before), `R1` and `R2` (trail and the pieces
after), in lower case, with punctuation kept.

1. Seeds are the base matches, and hexadecimal runs of 32 digits or more, which are no identifiers by form
   alone: they are reported only where their context says so. Their
   patterns with `support` distinct seeds or more go on (copies of a text are one).
2. A pass over all texts counts how often these patterns occur beside any piece whatever. A pattern's trust
   is the sum of the squared scores of the instances in its uses, over all its occurrences and `doubt` more: a frequent
   word stands beside a seed by chance only, and has next to none. Patterns of less than `least` are dropped.
3. A second pass collects the other patterns' occurrences: the graph of patterns and instances. An
   instance's score is 1 for a seed, else the mean over its occurrences in the graph of the best trust
   there; places without such a pattern say nothing. After `rounds` passes of trust and scores, instances
   of `confident` or more become seeds, and so on until none is added.
4. New seeds are looked up in all texts. Those that mostly stand outside the graph are dropped again; the
   contexts of the others go through the same steps, until there are none.

Unseen identifiers (kind `id`) are all occurrences of found instances, and every core beside a pattern whose
trust is confident, as long as they do not overlap a base match. Ties do not matter: all scores are thresholds.

Unknown cores score by the patterns that they score in turn. So in a pattern's sum they count by the square
of their score, and the passes between additions are few: a pattern becomes confident by itself only if
about seven in ten of its occurrences are seeds.

A null text is empty. Texts without matches have empty spans. Repeated rows each get their own result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import bitmap, held, materialize, read_table

#: The base patterns (fixed values), written with possessive quantifiers. A match of email starts where its
#: run of characters starts or where the last match ended; the digits' kinds start no run in its middle.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
ORDER = ("email", "ip", "card", "phone", "id")
#: A piece with the white space after it, and what encloses an identifier.
PIECE = r"[^\x20\x09-\x0D=:]*+[=:]*+[\x20\x09-\x0D]*+"
LEAD = "\"'()[]{}<>,;!?|*`#"
TRAIL = LEAD + ".=:"
#: Seeds that only their context makes identifiers.
SECRET = r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
SMALL = 500_000
SPAN = "array<struct<start:bigint,stop:bigint,match:string>>"


def _luhn(digits: Column) -> Column:
    """Of a string of digits: is its Luhn sum a multiple of ten."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def running(lengths: Column, block: int = 256) -> Column:
    """For an array of lengths the sum of those before each: in blocks, as an array grown by one copies itself."""
    zero = F.lit(0).cast("long")

    def walk(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    first = walk(F.transform(blocks, lambda x: F.aggregate(x, zero, lambda s, v: s + v)), zero)
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(blocks, first, walk))).otherwise(F.array().cast("array<bigint>"))


def _add_spans(rows: DataFrame, regex: str, name: str, hint: str) -> DataFrame:
    """Adds name: start, stop and text of each match of regex in t (none where t lacks the hint).

    In steps, each a column, so that no lambda builds its array anew."""
    has = F.col("t").rlike(hint)
    rows = rows.withColumn("_m", F.when(has, F.regexp_extract_all("t", F.lit(regex), F.lit(0))))
    rows = rows.withColumn("_p", F.when(F.size("_m") > 0, F.transform(F.slice(F.split("t", regex, -1), F.lit(1), F.size("_m")), lambda p: F.length(p).cast("long"))))
    rows = rows.withColumn("_w", F.when(F.size("_m") > 0, F.zip_with("_p", "_m", lambda p, m: p + F.length(m))))
    rows = rows.withColumn("_o", F.when(F.size("_m") > 0, F.zip_with(running(F.col("_w")), "_p", lambda o, p: o + p)))
    found = F.zip_with("_o", "_m", lambda o, m: F.struct(o.alias("start"), (o + F.length(m)).alias("stop"), m.alias("match")))
    return rows.withColumn(name, F.coalesce(F.when(F.size("_m") > 0, found), F.array().cast(SPAN))).drop("_m", "_p", "_w", "_o")


_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}


def base_spans(documents: DataFrame, *ids: str) -> DataFrame:
    """ids, t (the text, empty for null) and base: array of struct<start, rank, kind, stop, match>, by start, then kind."""
    rows = documents.select(*ids, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    for kind, regex in KINDS.items():
        rows = _add_spans(rows, regex, f"s_{kind}", _HINTS[kind])

    def kept(rank: int, kind: str) -> Column:
        held = F.filter(f"s_{kind}", lambda x: _holds(kind, x["match"]))
        return F.transform(held, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["stop"], x["match"]))

    every = F.concat(*(kept(i, k) for i, k in enumerate(KINDS)))
    return rows.withColumn("base", F.array_sort(every)).drop(*(f"s_{k}" for k in KINDS))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


_SPACES = " \t\n\x0b\f\r"


def _folded(text: Column) -> Column:
    """In lower case, where that keeps the length, so that positions stay; else as it is."""
    low = F.lower(text)
    return F.when((F.octet_length(text) == F.length(text)) | (F.length(low) == F.length(text)), low).otherwise(text)


def _patterns(lead: Column, before: Column, before2: Column, trail: Column, after: Column, after2: Column) -> Column:
    """The patterns of one place: of each kind, the pieces (near and far) and the punctuation; null where it has
    no such piece. Arguments: folded and trimmed."""

    def pattern(kind: str, near: Column, far: Column, mark: Column, there: Column) -> Column:
        return F.when(there, F.struct(F.lit(kind).alias("kind"), near.alias("near"), far.alias("far"), mark.alias("mark")))

    none = F.lit("")
    return F.array(
        pattern("L1", before, none, lead, before != ""), pattern("L2", before, before2, lead, (before != "") & (before2 != "")),
        pattern("R1", after, none, trail, after != ""), pattern("R2", after, after2, trail, (after != "") & (after2 != "")),
    )


REACH = 120


def _around(seeds: str) -> Column:
    """Of each span in `seeds`: match, and what stands within REACH code points before (b) and after (a), and
    whether that is cut."""
    return F.transform(
        seeds,
        lambda x: F.struct(
            x["match"].alias("match"),
            F.substring("t", F.greatest(x["start"] - REACH, F.lit(0)).cast("int") + 1, F.least(x["start"], F.lit(REACH)).cast("int")).alias("b"), (x["start"] > REACH).alias("cut_b"),
            F.substring("t", x["stop"].cast("int") + 1, F.lit(REACH)).alias("a"), (F.length("t") - x["stop"] > REACH).alias("cut_a"),
        ),
    )


def _places(rows: DataFrame) -> DataFrame:
    """match and patterns of each of the seeds (near: what _around gives), one row each. A piece that begins or
    ends beyond REACH is none."""
    each = rows.select(F.explode("near").alias("x")).select("x.match", _folded(F.col("x.b")).alias("b"), "x.cut_b", _folded(F.col("x.a")).alias("a"), "x.cut_a")
    each = held(each)
    every = lambda c: F.filter(F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)), lambda p: p != "")
    each = held(each.withColumns({"b": every("b"), "a": every("a")}))
    each = each.withColumns({"b": F.when(F.col("cut_b"), F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0)))).otherwise(F.col("b")), "a": F.when(F.col("cut_a"), F.slice("a", F.lit(1), F.greatest(F.size("a") - 1, F.lit(0)))).otherwise(F.col("a"))})
    each = held(each)
    open_ = F.coalesce(F.get("b", F.size("b") - 1), F.lit("")).rlike(r"[^\x20\x09-\x0D=:]\z")
    each = each.withColumn("lead", F.when(open_, F.get("b", F.size("b") - 1)).otherwise("")).withColumn("last", F.size("b") - 1 - open_.cast("int"))
    each = held(each)
    piece = lambda c, i: F.coalesce(F.rtrim(F.get(c, i), F.lit(_SPACES)), F.lit(""))
    before, before2, after, after2 = piece("b", F.col("last")), piece("b", F.col("last") - 1), piece("a", F.lit(1)), piece("a", F.lit(2))
    each = held(each.select("match", "lead", before.alias("before"), before2.alias("before2"), piece("a", F.lit(0)).alias("trail"), after.alias("after"), after2.alias("after2")))
    return each.select("match", _patterns(*(F.col(c) for c in ("lead", "before", "before2", "trail", "after", "after2"))).alias("patterns"))


PATTERN = ["kind", "near", "far", "mark"]


def _hit(hashes: list[int], h: Column) -> Column:
    """Is this hash's bit set in the table of the hashes."""
    table, power = bitmap(hashes)
    return F.call_function("bit_get", F.get(table, F.shiftrightunsigned(h, 64 - power).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _beside(kind: str, i: Column, column: str = "c") -> tuple[Column, ...]:
    """The pieces (or their hashes) that a pattern of this kind names, of the place i."""
    step = -1 if kind[0] == "L" else 1
    return tuple(F.get(column, i + step * k) for k in range(1, int(kind[1]) + 1))


def _tables(patterns: DataFrame) -> dict[str, list[int]]:
    """By kind the hashes of the pieces that patterns name: for at most `small` patterns."""
    rows = patterns.select("kind", F.when(F.col("kind").endswith("1"), F.xxhash64("near")).otherwise(F.xxhash64(F.xxhash64("near"), F.xxhash64("far"))).alias("h")).distinct().collect()
    return {kind: [r.h for r in rows if r.kind == kind] for kind in sorted({r.kind for r in rows})}


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds h, the hashes of the pieces c: each is computed once, however many tests look at it."""
    return held(rows.withColumn("h", F.transform("c", lambda x: F.xxhash64(x))))


def _pieces(texts: DataFrame, *ids: str) -> DataFrame:
    """ids, t, f (t folded) and c, its pieces without white space."""
    rows = held(texts.select(*ids, "t", _folded(F.col("t")).alias("f")))
    cut = F.when(F.contains("f", F.lit("=")) | F.contains("f", F.lit(":")), F.regexp_replace("f", r"([=:])(?=[^\x20\x09-\x0D=:])", "$1 ")).otherwise(F.col("f"))
    return held(rows.select(*ids, "t", "f", F.split(cut, r"[\x20\x09-\x0D]+").alias("c")))


def _lead(piece: Column) -> Column:
    return F.length(piece) - F.length(F.ltrim(piece, F.lit(LEAD)))


def _core_size(piece: Column) -> Column:
    return F.length(F.rtrim(F.ltrim(piece, F.lit(LEAD)), F.lit(TRAIL)))


def _key(kind: str, i: Column) -> Column:
    """The hash of the pieces that a pattern of this kind names, as _tables has it."""
    pieces = _beside(kind, i, "h")
    return F.xxhash64(*pieces) if kind[1] == "2" else pieces[0]


def _number(kind: str, i: Column) -> Column:
    """The hash of the pattern of this kind at the place i."""
    own, pieces = F.get("c", i), _beside(kind, i)
    mark = F.substring(own, F.lit(1), _lead(own)) if kind[0] == "L" else F.substring(own, F.lit(1) + F.length(F.rtrim(own, F.lit(TRAIL))), F.length(own))
    return F.xxhash64(F.lit(kind), pieces[0], pieces[1] if kind[1] == "2" else F.lit(""), mark)


def _totals(texts: DataFrame, tables: dict[str, list[int]]) -> DataFrame:
    """pattern (its hash), total: how often each pattern whose pieces are in the tables stands beside any core. One
    number for each place goes on: this pass meets the most frequent words."""
    rows = _hashed(_pieces(texts))
    every = F.sequence(F.lit(0), F.size("c") - 1)

    def marks(kind: str, hashes: list[int]) -> Column:
        return F.transform(F.filter(every, lambda i: _hit(hashes, _key(kind, i)) & (_core_size(F.get("c", i)) > 0)), lambda i: _number(kind, i))

    return rows.select(F.explode(F.concat(*(marks(k, t) for k, t in tables.items()))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("total"))


def _occurrences(texts: DataFrame, keep, *ids: str) -> DataFrame:
    """ids, start, stop, match and patterns of the cores at the places of c that `keep` allows (None: all).
    keep: the columns to add one by one, the last of which is i, the places."""
    rows = _pieces(texts, *ids)
    for name, column in keep or [("i", F.sequence(F.lit(0), F.size("c") - 1))]:
        rows = held(rows.withColumn(name, column))
    rows = rows.filter(F.size("i") > 0)
    # the offsets of these places only: from each to the next the pieces with their white space are joined
    rows = held(rows.withColumn("p", F.regexp_extract_all("f", F.lit(PIECE), F.lit(0))))
    step = F.zip_with("i", F.concat(F.array(F.lit(0)), F.slice("i", F.lit(1), F.size("i") - 1)), lambda x, before: F.length(F.array_join(F.slice("p", before + 1, x - before), "")).cast("long"))
    rows = held(rows.withColumn("w", step))
    rows = held(rows.withColumn("o", F.zip_with(running(F.col("w")), "w", lambda a, w: a + w)))
    rows = rows.select(*ids, "t", "c", F.explode(F.arrays_zip("i", "o")).alias("x"))
    at = lambda k: F.coalesce(F.when(F.col("x.i") + k >= 0, F.get("c", F.col("x.i") + k)), F.lit(""))
    rows = held(rows.select(*ids, "t", "x.o", at(-2).alias("b2"), at(-1).alias("b1"), at(0).alias("own"), at(1).alias("a1"), at(2).alias("a2")))
    rows = held(rows.withColumns({"lead": _lead(F.col("own")), "size": _core_size(F.col("own"))})).filter("size > 0")
    start = F.col("o") + F.col("lead")
    mark, trail = F.substring("own", F.lit(1), F.col("lead")), F.substring("own", F.col("lead") + F.col("size") + 1, F.length("own"))
    return rows.select(*ids, start.alias("start"), (start + F.col("size")).alias("stop"), F.substring("t", start.cast("int") + 1, F.col("size")).alias("match"), _patterns(mark, F.col("b1"), F.col("b2"), trail, F.col("a1"), F.col("a2")).alias("patterns"))


def _named(patterns: DataFrame) -> list[tuple[str, Column]]:
    """The places of these patterns (at most `small`): by one test of each piece those that patterns name, then by
    the whole patterns the places on either side."""
    rows = patterns.select("kind", F.xxhash64("near").alias("near"), "pattern").collect()
    near = sorted({r.near for r in rows})
    pieces = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda k: _hit(near, F.get("h", k)))
    sides = F.array_sort(F.array_distinct(F.flatten(F.transform("i", lambda i: F.array(i - 1, i + 1)))))
    gates = _tables(patterns)
    tables = {kind: [r.pattern for r in rows if r.kind == kind] for kind in gates}
    # the pieces' hashes rule out most places before any text is looked at
    holds = lambda i: (i >= 0) & (i < F.size("c")) & functools.reduce(lambda a, b: a | b, (_hit(gates[kind], _key(kind, i)) & _hit(t, _number(kind, i)) for kind, t in tables.items()))
    return [("h", F.transform("c", lambda x: F.xxhash64(x))), ("i", pieces), ("i", F.when(F.size("i") > 0, F.filter(sides, holds)).otherwise(F.col("i")))]


def _holding(hashes: list[int]) -> list[tuple[str, Column]]:
    """The places whose core has one of the hashes."""
    cores = F.transform("c", lambda x: F.xxhash64(F.rtrim(F.ltrim(x, F.lit(LEAD)), F.lit(TRAIL))))
    return [("h", cores), ("i", F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda k: _hit(hashes, F.get("h", k))))]


def _contexts(places: DataFrame) -> DataFrame:
    """match and pattern (its four columns) of each use."""
    return places.select("match", F.explode("patterns").alias("x")).filter("x is not null").select("match", "x.*")


def discover(texts: DataFrame, places: DataFrame, *ids: str, rounds: int = 3, confident: float = 0.9, support: int = 5, least: float = 0.1, doubt: float = 1.0, small: int = SMALL) -> DataFrame:
    """ids, start, stop and match of every identifier that the contexts of the seeds lead to (they may overlap
    base matches). texts: ids and t; places: the seeds' uses. Up to `small` patterns are looked up in constant
    tables of bits and broadcast; beyond that all places are joined by a shuffle."""
    seeds = materialize(places.select("match").distinct(), "pii_seeds")
    uses = materialize(_contexts(places), "pii_uses")
    known = out = None
    while True:
        fresh = uses.groupBy(*PATTERN, "match").agg(F.count("*").alias("n")).groupBy(*PATTERN).agg(F.sum("n").alias("seen"), F.count("*").alias("kinds")).filter(F.col("kinds") >= support).drop("kinds")
        fresh = materialize(fresh if known is None else fresh.join(known, PATTERN, "left_anti"), "pii_fresh")
        number = fresh.count()
        if not number:
            break
        known = fresh.select(*PATTERN) if known is None else known.unionByName(fresh.select(*PATTERN))
        few = number <= small
        bounded = F.broadcast if few else (lambda df: df)
        fresh = fresh.withColumn("pattern", F.xxhash64(*PATTERN))
        if few:  # a pattern may gain by instances yet unknown, but only from a share of seeds of its own
            total = _totals(texts, _tables(fresh)).join(F.broadcast(fresh.select("pattern")), "pattern", "left_semi")
            hopeless = fresh.join(total, "pattern").filter(F.col("seen") < F.lit(least) * (F.col("total") + doubt)).select("pattern")
            fresh = materialize(fresh.join(F.broadcast(hopeless), "pattern", "left_anti"), "pii_fresh")
            if fresh.isEmpty():
                break
        spots = _occurrences(texts, _named(fresh) if few else None, *ids).withColumn("_n", F.monotonically_increasing_id())
        spots = spots.select(*ids, "_n", "start", "stop", "match", F.explode("patterns").alias("x")).filter("x is not null").select(*ids, "_n", "start", "stop", "match", "x.*")
        spots = materialize(spots.join(bounded(fresh.select(*PATTERN, "pattern")), PATTERN).drop(*PATTERN), "pii_spots")
        mine = materialize(uses.withColumn("pattern", F.xxhash64(*PATTERN)).join(seeds, "match", "left_semi").groupBy("pattern", "match").agg(F.count("*").alias("n")), "pii_mine")
        seen = mine.groupBy("pattern").agg(F.sum("n").alias("seen"))
        live = spots.groupBy("pattern").agg(F.count("*").alias("total")).join(seen, "pattern").filter(F.col("seen") >= F.lit(least) * (F.col("total") + doubt))
        live = materialize(live.select("pattern", F.greatest("total", "seen").alias("total")), "pii_live")
        if live.isEmpty():
            break
        spots = spots.join(live.select("pattern"), "pattern", "left_semi")
        # seeds that are no single core (a phone number of several pieces) are uses of their patterns as well
        edges = spots.groupBy("pattern", "match").agg(F.count("*").alias("n"))
        outer = mine.join(live.select("pattern"), "pattern", "left_semi").join(edges.select("pattern", "match"), ["pattern", "match"], "left_anti")
        edges = materialize(edges.unionByName(outer.select("pattern", "match", "n")), "pii_edges")
        # the occurrences of one instance with the same patterns count together
        together = spots.groupBy("_n", "match").agg(F.sort_array(F.collect_set("pattern")).alias("set")).groupBy("match", "set").agg(F.count("*").alias("n"))
        together = materialize(together.withColumn("g", F.monotonically_increasing_id()), "pii_together")
        sides = together.select("match", "n", "g", F.explode("set").alias("pattern"))
        started = seeds
        while True:
            score = seeds.select("match", F.lit(1.0).alias("score"))
            for _ in range(rounds):
                trust = edges.join(score, "match").groupBy("pattern").agg(F.sum(F.col("n") * F.col("score") * F.col("score")).alias("s"))
                trust = materialize(live.join(trust, "pattern").select("pattern", (F.least("s", "total") / (F.col("total") + doubt)).alias("trust")), "pii_trust")
                best = sides.join(trust, "pattern").groupBy("g", "match", "n").agg(F.max("trust").alias("best"))
                mean = best.groupBy("match").agg((F.sum(F.col("n") * F.col("best")) / F.sum("n")).alias("score"))
                score = materialize(mean.join(seeds, "match", "left_anti").unionByName(seeds.select("match", F.lit(1.0).alias("score"))), "pii_scores")
            added = materialize(score.filter(F.col("score") >= confident).select("match").join(seeds, "match", "left_anti"), "pii_added")
            if added.isEmpty():
                break
            seeds = materialize(seeds.unionByName(added), "pii_seeds")
        sure = spots.join(trust.filter(F.col("trust") >= confident).select("pattern"), "pattern", "left_semi").select(*ids, "start", "stop", "match").distinct()
        out = materialize(sure if out is None else out.unionByName(sure), "pii_sure")
        new = materialize(seeds.join(started, "match", "left_anti"), "pii_new")
        number = new.count()
        if not number:
            break
        # all occurrences of the new seeds, wherever they stand
        hashes = [r.h for r in new.select(F.xxhash64(_folded(F.col("match"))).alias("h")).distinct().collect()] if number <= small else None
        found = _occurrences(texts, None if hashes is None else _holding(hashes), *ids)
        found = materialize(found.join(F.broadcast(new) if number <= small else new, "match", "left_semi"), "pii_found")
        # an instance that mostly stands elsewhere is a word that came beside such a pattern once
        inside = together.groupBy("match").agg(F.sum("n").alias("n")).join(new, "match", "left_semi")
        whole = found.groupBy("match").agg(F.count("*").alias("every"))
        stray = materialize(inside.join(whole, "match", "left").filter(F.col("n") * 2 < F.coalesce("every", F.lit(0))).select("match"), "pii_stray")
        seeds = materialize(seeds.join(stray, "match", "left_anti"), "pii_seeds")
        found = materialize(found.join(stray, "match", "left_anti"), "pii_found")
        if found.isEmpty():
            break
        out = materialize(out.unionByName(found.select(*ids, "start", "stop", "match")), "pii_sure")
        uses = materialize(uses.unionByName(_contexts(found)), "pii_uses")
    if out is None:
        return texts.select(*ids, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.lit("").alias("match")).filter("false")
    return out.distinct()


def spans_of(documents: DataFrame, *ids: str) -> DataFrame:
    """ids, th (the text's hash), base and spans: base spans, and those with the discovered identifiers."""
    rows = documents.select(*ids, F.xxhash64("text").alias("th"), "text")
    rows = _add_spans(base_spans(rows, *ids, "th"), SECRET, "secrets", "[0-9A-Fa-f]{32}")
    free = F.filter("secrets", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    seeds = F.concat(F.transform("base", lambda b: F.struct(b["start"], b["stop"], b["match"])), free)
    keys = [f"k{n}" for n in range(len(ids) + 1)]
    rows = rows.withColumn("seeds", F.when(F.size("secrets") + F.size("base") > 0, seeds))
    base = materialize(rows.select(*ids, "th", "base", F.when(F.size("seeds") > 0, _around("seeds")).alias("near")), "pii")
    places = materialize(_places(base), "pii_places")
    base = base.drop("near")
    texts = documents.select(*(F.col(c).alias(k) for c, k in zip(ids, keys, strict=False)), F.xxhash64("text").alias(keys[-1]), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    extra = discover(texts, places, *keys).groupBy(*keys).agg(F.collect_set(F.struct("start", F.lit(len(ORDER) - 1).alias("rank"), F.lit("id").alias("kind"), "stop", "match")).alias("extra"))
    same = F.lit(True)
    for k, c in zip(keys, (*ids, "th"), strict=True):
        same = same & F.col(k).eqNullSafe(F.col(c))
    out = base.join(extra, same, "left")
    apart = F.filter("extra", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return out.select(*ids, "th", "base", F.array_sort(F.concat("base", F.coalesce(apart, F.slice("base", 1, 0)))).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """documents with each span of its text replaced by [KIND]; overlapping spans are
    replaced as one, by the kind of the first."""
    found = spans_of(documents, "doc_id").select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), F.col("spans").alias("_s")).filter(F.size("_s") > 0).dropDuplicates(["_d", "_th"])
    rows = documents.join(found, documents["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(documents["text"]) == F.col("_th")), "left")
    walk = F.aggregate(
        "_s",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["stop"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(x["stop"].alias("at"), F.concat(a["out"], F.substring("text", a["at"].cast("int") + 1, (x["start"] - a["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, F.length("text"))),
    )
    return rows.withColumn("text", F.when(F.col("_s").isNull(), F.col("text")).otherwise(walk)).drop("_d", "_th", "_s")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans_of(read_table(spark, sf_dir, "documents"), "doc_id")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(k) for k in KINDS]
    return rows.select("doc_id", *count, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
