"""The training-text operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliograph.llm import decontaminate, graph, html, jaccard, packing, pii, quality, sharding, toxicity, training_order, urls
from heliograph.llm.common import shared_dir, table_path
from heliograph.llm.html_pages import Maker

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with copies, near copies, nulls, empty and white-space texts, one long one, and a column named like an output."""
    r = random.Random(5)
    rows = []
    for k in range(60):
        rows.append([k, words(r, r.choice((3, 8, 60, 120)), 5000)])
    base = words(r, 200, 5000)
    for k in range(60, 90):  # near copies
        w = base.split()
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append([k, " ".join(w)])
    rows += [[90, None], [91, ""], [92, " \n\t "], [93, base], [94, base.upper()], [95, words(r, 20000, 10**6)], [96, "one"], [97, "ONE"], [None, "an orphan without an id"], [3, rows[3][1]]]
    return spark.createDataFrame([(d, t, ("en", "de", None)[i % 3], f"s{i % 4}", len(t or "")) for i, (d, t) in enumerate(rows)], DOCS).withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# ------------------------------------------------------------------ 9


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(docs, empty):
    rows = [(r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, len(s), (least.get(find(i)) if s else d)) for i, (d, s) in enumerate(rows))
    assert Counter(tuple(r) for r in jaccard.components_of(docs).collect()) == want
    assert jaccard.components_of(empty).count() == 0
    kept = [r.doc_id for r in jaccard.keep_one(docs).select("doc_id").collect()]
    assert sorted(d for d in kept if d is not None) == sorted({c for _, n, c in want if c is not None})


def test_keep_one_by_row(spark):
    """Null and repeated ids: each group keeps exactly one row, and no row goes for another group's sake."""
    r = random.Random(9)
    a, b, c, d, e, f = (words(r, 60, 5000) for _ in range(6))
    rows = [(1, a), (None, a), (None, b), (None, ""), (None, None), (2, c), (3, c), (3, d), (4, e), (4, f), (None, f), (5, e), (6, b + " tail"), (2, c)]
    rows += [(None, d + " x"), (None, "only"), (None, "only")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = Counter((x.doc_id, x.text) for x in jaccard.keep_one(df).collect())
    want = [(1, a), (6, b + " tail"), (None, ""), (None, None), (2, c), (3, d), (4, e), (4, f), (None, "only")]
    assert got == Counter(want)


def test_small_heavy_prefixes(docs):
    """Whatever tokens count as frequent, and however lists are cut, the components are the same."""
    sizes, roots = jaccard.links(docs, heavy=2)
    plain = {frozenset(g) for g in _groups(jaccard.links(docs)[1])}
    assert {frozenset(g) for g in _groups(roots)} == plain and sizes.count() == docs.count()
    for options in ({"longest": 2}, {"block": 4}, {"heavy": 2, "longest": 3, "block": 3}):
        assert {frozenset(g) for g in _groups(jaccard.links(docs, **options)[1])} == plain, options


def test_jaccard_of_a_group_about_the_threshold(spark):
    """300 versions of one text, most pairs of them just below or above the threshold, against brute force."""
    r = random.Random(11)
    base = words(r, 150, 9000).split()
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = f"y{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(300))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(300):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {k: find(k) for k in range(300)}
    assert 20 < len(set(want.values())) < 280
    assert {x.doc_id: x.component_id for x in jaccard.components_of(df).collect()} == want
    _, roots = jaccard.links(df, heavy=4, block=64)
    assert {len(g) for g in _groups(roots)} == {n for n in Counter(want.values()).values() if n > 1}


def test_combinations_meet():
    """Sets at the threshold share a single token or a combination, for any classes of their tokens."""
    r = np.random.default_rng(3)
    for n in (12, 20, 60, 200):
        for _ in range(40):
            common = r.integers(0, 2**63, n, dtype=np.uint64)
            lost = n - (80 * n + 99) // 100
            own = r.integers(0, 2**63, (2, lost), dtype=np.uint64)
            level_of = lambda t: 2 + ((t >> np.uint64(5)) % np.uint64(2)).astype(np.int8)
            keys = []
            for k in range(2):
                t = np.concatenate([common[: n - lost], own[k]])
                level = level_of(t)
                order = np.lexsort((t, level))
                size_class = jaccard._class_of(n, 80)
                keys.append({s for c in (size_class, size_class + 1) for s in jaccard._combinations(t[order], level[order], lost + 1, c, 80)})
            assert keys[0] & keys[1]


def _groups(roots):
    out = {}
    for r in roots.collect():
        out.setdefault(bytes(r.root), []).append(bytes(r.node))
    return out.values()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 9), (9, 8), (2, 1)], "a int, b int")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 8: 1, 4: 4, 5: 4}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


# ------------------------------------------------------------------ 6


def test_decontamination(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    long = text[95].split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[500:509]) + " Zz"), (10, "ONE"), (11, None), (12, ""), (13, " ".join(text[60].split()[:40])), (13, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    want = []
    for r in docs.collect():
        w, hit, found = split(r.text), set(), set()
        for i, t in items:
            x = split(t)
            n = min(8, len(x))
            windows = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)} if x else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found.add(str(i))
        want.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    assert Counter(tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()) == Counter(want)
    hits = decontaminate.find(docs, bench, small=0)  # both sides shuffled
    assert {r.doc_id: r.n_hit for r in hits.collect()} == {d: h for d, _, h, *_ in want if h}
    cleaned = decontaminate.clean(docs, bench)
    assert cleaned.columns == docs.columns
    again = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(cleaned, bench).collect()}
    assert set(again) == {d for d, *_, bad in want if not bad} and not any(again.values())
    assert {r.doc_id: r.text for r in cleaned.collect()}[5] == text[5]
    assert decontaminate.decontaminate(docs, bench.filter("item_id > 99")).filter("n_items > 0").count() == 0


# ------------------------------------------------------------------ 5


def test_pii(spark, empty):
    texts = ["mail a.b@c-d.example.org, or x@y.z_c@d.e now", "ip 10.0.0.1 1.2.3.4.5 300.1.1.1 001.2.3.255", "card 4041894974608795, 4041 8949 7460 8795 and 4041-8949-7460-8796 4041894974608795 40", "+1 (687) 555-4908 +123 +49 30 1234567890123456", None, "", "é😀 a@b.cd", "1" * 5000 + " " + "1 " * 5000, "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(spark.createDataFrame([(0, texts[0])], "doc_id bigint, text string"))
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    def spans(t):
        found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, x) in enumerate(kinds.items()) for m in re.finditer(x, t or "") if holds(k, m[0])]
        return ",".join(s for *_, s in sorted(found))

    got = pii.spans_of(df, "doc_id").select("doc_id", pii.joined("base").alias("b"), pii.joined("spans").alias("s")).collect()
    assert Counter((r.doc_id, r.b) for r in got) == Counter([*((k, spans(t)) for k, t in enumerate(texts)), (0, spans(texts[0]))])
    assert all(r.s == r.b for r in got)
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[6] == "é😀 [EMAIL]" and red[4] is None and red[8] == "nothing here" and "[CARD]" in red[2]
    assert pii.spans_of(empty, "doc_id").count() == 0


def test_pii_bootstrap(spark):
    """Tokens between the words that surround seeds are identifiers; tokens between other words are not."""
    rows = [(k, f"please mail user{k}@x.example.com today then see page {k} of it") for k in range(30)] + [(99, "please mail agent-77z today then see page 7b of it"), (98, "take 4you home")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.s for r in pii.spans_of(df, "doc_id").select("doc_id", pii.joined("spans").alias("s")).collect()}
    assert got[99] == "id:12:21" and got[98] == "" and got[3].startswith("email:12:") and "id" not in got[3]


def test_pii_contexts(spark):
    """A rare context bars nothing, and one confident side is enough."""
    r = random.Random(4)
    rare = lambda: "".join(r.choice("abcdefghij") for _ in range(12))
    texts = [f"please mail user{k}@x.example.com today {rare()}" for k in range(30)]
    texts += ["please mail agent-77z today"] * 3 + [f"{rare()} agent-77z {rare()}"]
    texts += [f"ssn: user{k}@y.example.com {rare()}" for k in range(30)] + [f"ssn: 77-zz {rare()}"]
    texts += [f"{rare()} page {k} of it" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {x.doc_id: x.s for x in pii.spans_of(df, "doc_id").select("doc_id", pii.joined("spans").alias("s")).collect()}
    at = [k for k, t in enumerate(texts) if re.search("agent-77z|77-zz", t)]
    assert all(found[k].startswith("id:") for k in at)
    assert not any("id" in found[k] for k in range(len(texts)) if k not in at)


def test_pii_frequent_words(spark):
    """A word that mostly stands beside plain words proves nothing, however many seeds stand beside it."""
    texts = [f"and of user{k}@x.example.com the" for k in range(40)] + [f"and of {k} the" for k in (97, 98)] + ["and of course the end"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert pii.spans_of(df, "doc_id").filter("size(spans) > size(base)").count() == 0


def test_pii_secrets(spark):
    """Hexadecimal runs are reported only where the context says so; quotes stay outside; a found identifier is
    found everywhere; one of letters only is found beside a confident pattern."""
    r = random.Random(8)
    secret = lambda: "".join(r.choice("0123456789abcdef") for _ in range(38)) + "a1"
    texts = [f'{words(r, 3)} token = "{secret()}" {words(r, 3)}' for _ in range(30)]
    texts += ['x token = "nodigitshere" y', 'TOKEN = "QQ-ONE" and later (QQ-ONE), too', f"commit {secret()} of {words(r, 2)}", "é" * 200 + ' token = "été7"', None, "", "token =", 'token = "']
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id bigint, text string")
    rows = [(x.doc_id, [(s.start, s.stop, s.match) for s in x.spans]) for x in pii.spans_of(df, "doc_id").collect()]
    assert len(rows) == len(texts) + 1
    got = dict(rows)
    for k, t in enumerate(texts[:30]):
        lo = t.index('"') + 1
        assert got[k] == [(lo, t.rindex('"'), t[lo : t.rindex('"')])]
    assert [m for *_, m in got[30]] == ["nodigitshere"] and [m for *_, m in got[31]] == ["QQ-ONE", "QQ-ONE"]
    assert got[32] == [] and got[33] == [(210, 214, "été7")] and not any(got[k] for k in range(34, 38))


def test_running(spark):
    df = spark.createDataFrame([([r for r in range(n)],) for n in (0, 1, 255, 256, 257, 3000)], "x array<bigint>")
    for x in df.select("x", pii.running(F.col("x")).alias("o")).collect():
        assert x.o == [sum(x.x[:k]) for k in range(len(x.x))]


def test_redact_overlap(spark):
    """A span that starts inside another and ends after it leaves no tail."""
    texts = ["see 10.0.0.4 1111 1111 1111 1113 now", "a 10.0.0.1 b"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    spans = {x.doc_id: x.s for x in pii.spans_of(df, "doc_id").select("doc_id", pii.joined("base").alias("s")).collect()}
    red = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert spans[0].startswith("ip:4:12,card:11:") and red == {0: "see [IP] now", 1: "a [IP] b"}


# ------------------------------------------------------------------ 2, 1, 7


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in docs.collect())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_is_even(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 97).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.lit(0).cast("bigint").alias("n_chars"))
    sizes = [r.s for r in sharding.shard_documents(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.02 * min(sizes)


def _plain_kd(rows, dims, target):
    """Leaves by sorting: rows are (uid, size, values) with distinct numbers in every dimension."""
    lo, hi = ([f(v[k] for _, _, v in rows) for k in range(dims)] for f in (min, max))

    def split(part):
        weight = sum(s for _, s, _ in part)
        if weight <= target or len(part) == 1:
            return [frozenset(u for u, _, _ in part)]
        wide = [(max(v[k] for _, _, v in part) - min(v[k] for _, _, v in part)) / (hi[k] - lo[k]) for k in range(dims)]
        k = max(range(dims), key=lambda d: (wide[d], -d))
        part = sorted(part, key=lambda r: r[2][k])
        before = at = 0
        while 2 * (before + part[at][1]) <= weight:
            before += part[at][1]
            at += 1
        at += 2 * before + part[at][1] < weight
        return split(part[:at]) + split(part[at:])

    return set(split(rows))


def test_sharding_by_target_is_a_kd_tree(spark):
    rng = random.Random(5)
    ids = rng.sample(range(4096), 120)
    sizes = rng.sample(range(10, 2000), 119) + [30_000]  # one row above the target stays alone
    df = spark.createDataFrame([(i, s, f"src-{i:04d}") for i, s in zip(ids, sizes, strict=True)], "doc_id bigint, size bigint, source string").select("doc_id", "size")
    got = {}
    for r in sharding.kd_shards(df, target=9000).collect():
        got.setdefault(r.shard, set()).add(r.doc_id)
    assert sorted(got) == list(range(len(got)))
    want = _plain_kd([(i, s, (s, i)) for i, s in zip(ids, sizes, strict=True)], 2, 9000)
    assert {frozenset(g) for g in got.values()} == want
    same = sharding.kd_shards(spark.createDataFrame([(7, 50)] * 6, "doc_id bigint, size bigint"), target=100)
    assert max(r.w for r in same.groupBy("shard").agg(F.sum("size").alias("w")).collect()) <= 100


def test_sharding_into_any_number_and_by_whole_strings(spark):
    long = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(10).cast("bigint").alias("size"), F.concat(F.lit("https://one.example/"), (F.col("id") % 3).cast("string")).alias("source")).select("size", "source")
    parted = sharding.kd_shards(long, shards=3).groupBy("shard").agg(F.sum("size").alias("w"), F.countDistinct("source").alias("n")).collect()
    assert len(parted) == 3 and all(abs(r.w - 10_000) <= 100 for r in parted)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, (64, 128, 256)).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1
    got, bins = Counter(), {}
    for r in rows:
        got[r.doc_id] += r.length
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert got == sizes
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        used, length = sum(r.length for r in own), own[0].bin_length
        assert used <= length and all(used > s for s in (64, 128, 256) if s < length)
    assert packing.pack_documents(empty).count() == 0


def test_pack_opens_the_cheapest_bin():
    at, offset, final = packing.pack(np.array([60, 60, 8, 4]), (64, 128), cost=float)
    assert at.tolist() == [0, 0, 0, 1] or final.sum() <= 192
    _, _, final = packing.pack(np.array([100, 30, 30, 30]), (128, 256), cost=lambda s: s**2)
    assert final.tolist() == [128, 128]


def test_training_order(spark, docs, tmp_path):
    p = training_order.permute(np.arange(1000), 1000, 3)
    assert sorted(p.tolist()) == list(range(1000)) and p.tolist() != list(range(1000))
    src = table_path(spark, "docs")
    docs.write.parquet(src)
    path = f"file://{tmp_path}/out"
    rows = sorted(training_order.write_shards(spark.read.parquet(src), path, length=256, per_shard=64).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    seqs = list(training_order.read_sequences(path, 0, 10**9))
    assert len(seqs) == len(rows) and np.array_equal(next(training_order.read_sequences(path, 70, 1)), seqs[70])
    streams = sum(int(r.n_tokens) for r in rows)
    assert streams == sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    text = b"".join(bytes(s[:n]) for s, n in zip(seqs, (r.n_tokens for r in rows), strict=True))
    assert Counter(text) == Counter(b"".join((r.text or "").encode() + b"\xff" for r in docs.collect()))


def test_training_order_writes_each_index_beside_its_shard(spark, docs, empty, tmp_path):
    src = table_path(spark, "docs")
    docs.coalesce(1).write.parquet(src)
    tables = Path(shared_dir(spark).removeprefix("file://"), "tables")
    before = set(tables.iterdir())
    path = f"file://{tmp_path}/out"
    got = training_order.write_shards(spark.read.parquet(src), path, length=256, per_shard=64)
    assert set(tables.iterdir()) == before  # no table by Spark's writers
    stream, ids = b"", []  # the one partition's tokens, and the id of the text that each belongs to
    for r in spark.read.parquet(src).collect():
        stream += (own := (r.text or "").encode() + b"\xff")
        ids += [r.doc_id] * len(own)
    n = -(-len(stream) // 256)
    want = {}
    for k, s in enumerate(training_order.permute(np.arange(n), n, 20_240_601).tolist()):
        piece, inside = stream[256 * k : 256 * k + 256], ids[256 * k : 256 * k + 256]
        body = piece.ljust(256, b"\xfe")
        want[s] = (s, s // 64, s % 64 * 256, len(piece), zlib.crc32(body), [d for i, d in enumerate(inside) if d is not None and inside[i - 1 : i] != [d]]), body
    assert sorted(tuple(r) for r in got.collect()) == [want[s][0] for s in range(n)]
    assert [bytes(x) for x in training_order.read_sequences(path, 0, n)] == [want[s][1] for s in range(n)]
    assert sorted(tuple(r) for r in training_order.read_index(spark, path).collect()) == [want[s][0] for s in range(n)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([f"{k}-{s:08d}.{e}" for s in range(-(-n // 64)) for k, e in (("index", "parquet"), ("shard", "bin"))] + ["manifest.json"])
    for s in range(-(-n // 64)):
        rows = pq.read_table(tmp_path / f"out/index-{s:08d}.parquet").to_pylist()
        assert [tuple(r.values()) for r in rows] == [want[k][0] for k in range(64 * s, min(n, 64 * s + 64))]
    empty.write.parquet(none := table_path(spark, "docs"))
    out = training_order.write_shards(spark.read.parquet(none), f"file://{tmp_path}/none")
    assert out.count() == 0 and out.columns == got.columns


# ------------------------------------------------------------------ 3, 4, 8, 10


def test_toxicity(spark, docs, empty):
    r = random.Random(2)
    rows = [(k, words(r, 80) + (" vile" + r.choice("abc") if k % 2 else "")) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(240)] + [(7, None), (None, 1), (4, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, toxicity.training_labels(labels))
    out = toxicity.score(df, model).withColumn("held", toxicity.held_out()).filter("held").collect()
    assert len(out) > 50 and sum(o.predicted == o.doc_id % 2 for o in out) / len(out) > 0.95
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    base = toxicity.fit(df, labels.filter("toxic = 9"))
    assert toxicity.score(df, base).select("score").distinct().collect()[0].score == 0.5
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_of_short_texts(spark):
    """A run of fewer code points than the longest gram has no such gram."""
    for n in range(1, 7):
        df = spark.createDataFrame([(1, "abcdef"[:n])], "doc_id bigint, text string")
        assert toxicity.score(df, toxicity.Model(np.ones(toxicity.BUCKETS, np.float32), 0.0)).count() == 1
        assert [len(toxicity._gram_buckets(np.arange(n, dtype=np.uint32), k)) for k in toxicity.ORDERS] == [max(0, n - k + 1) for k in toxicity.ORDERS]


def test_quality(docs, empty):
    got = {}
    for r in quality.judge(docs).collect():
        got.setdefault(r.doc_id, r)
    for d in docs.collect():
        t, g = d.text or "", got[d.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (g.n_words, g.word_chars, g.n_repeat_words) == (len(w), sum(map(len, w)), len(rep))
        assert g.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (g.base_failed and g.kept)
    assert quality.judge(empty).count() == 0


def test_quality_upper_band(spark):
    """Words parted by bars are less predictable than prose of the same words, and go."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice(("ba", "do", "ki", "lu", "me", "ra", "so", "ti")) for _ in range(r.randrange(2, 6))) for _ in range(3000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(300)) for _ in range(200)] + [" | ".join(r.choice(vocabulary) for _ in range(300)) for _ in range(2)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    rows = quality.judge(df).collect()
    assert {x.doc_id for x in rows if not x.base_failed and x.perplexity > x.upper} == {200, 201}
    assert {x.doc_id for x in rows if x.kept} == set(range(200))
    loose = quality.judge(df, above=8.0, least_above=0.6)
    assert loose.filter("perplexity > upper").count() == 0  # what the far band let through


def test_kneser_ney_sums_to_one():
    r = np.random.default_rng(1)
    keys, n = np.unique(r.integers(0, 12, (4000, 5)) @ (1 << np.array([48, 36, 24, 12, 0])), return_counts=True)
    model = quality.kneser_ney(keys, n)
    for context in (keys[0] >> 12, keys[50] >> 12, (40 << 36) | (41 << 24) | (42 << 12) | 43):
        p = np.exp(quality.log_probability(model, (context << 12) | np.arange(4096)))
        assert abs(p.sum() - 1) < 1e-6 and (p > 0).all()


def brute_perplexity(texts):
    """Modified Kneser-Ney by dictionaries: the mean negative log probability of each text."""
    def fold(c):
        c = ord(c)
        if c >= 128:
            return c
        ch = chr(c).lower()
        if ch.isalpha():
            return ord(ch) - 97
        return 26 if ch.isdigit() else 27 if ch in " \t\n\v\f\r" else 28 if ch in ".,;:!?" else 29 if ch in "'\"()[]{}-/" else 30 if ch in "#*$%&|<>" else 31

    rows = [tuple(map(fold, t)) for t in texts]
    level = {5: Counter(t[i : i + 5] for t in rows for i in range(len(t) - 4))}
    for k in (4, 3, 2, 1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    cut, total, cuts = {}, {}, {}
    for k, counts in level.items():
        ones = [max(1, sum(v == j for v in counts.values())) for j in (1, 2, 3, 4)]
        y = ones[0] / (ones[0] + 2 * ones[1])
        d = [0, min(0.95, max(0.05, 1 - 2 * y * ones[1] / ones[0])), min(1.9, max(0.1, 2 - 3 * y * ones[2] / ones[1])), min(2.85, max(0.15, 3 - 4 * y * ones[3] / ones[2]))]
        cut[k] = {g: d[min(v, 3)] for g, v in counts.items()}
        total[k], cuts[k] = Counter(), Counter()
        for g, v in counts.items():
            total[k][g[:-1]] += v
            cuts[k][g[:-1]] += cut[k][g]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 4096
        below = p(g[1:])
        if g[:-1] not in total[k]:
            return below
        own = max(level[k][g] - cut[k][g], 1e-9) / total[k][g[:-1]] if g in level[k] else 0
        return own + cuts[k][g[:-1]] / total[k][g[:-1]] * below

    return [(-sum(np.log(p(t[i : i + 5])) for i in range(len(t) - 4)) / (len(t) - 4)) if len(t) > 4 else None for t in rows]


def test_perplexity(spark):
    """Against the dictionaries, by language, with other scripts, short texts and a null language."""
    r = random.Random(12)
    texts = [words(r, 40, 30) + r.choice(("", " | 7", "é ß", " \u4e2d\u6587", "")) for _ in range(30)] + ["abc", "", "abcde"]
    rows = [(k, t, None if k % 2 else "en") for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (99, None, "en")], "doc_id bigint, text string, lang string")
    got = {x.doc_id: x.log_perplexity for x in quality.score(df, quality.fit(df)).collect()}
    assert got[99] is None
    for odd in (0, 1):
        own = [(k, t) for k, t, _ in rows if k % 2 == odd]
        folded = ["".join(chr(2048 + ((ord(c) * 0x9E3779B1 >> 7) & 2047)) if ord(c) >= 4096 else c for c in t) for _, t in own]
        for (k, _), want in zip(own, brute_perplexity(folded), strict=True):
            assert (got[k] is None) if want is None else abs(got[k] - want) < 1e-9
    # a share bounds what is kept: the most frequent 5-grams only
    assert sum(len(m[-1][0]) for m in quality.fit(df, share=0.01).values()) <= 100


def test_perplexity_keeps_rare_grams(spark):
    """Twelve million positions: 5-grams that stand in them once belong to the model all the same."""
    df = spark.range(400).selectExpr("id AS doc_id", "if(id = 0, 'quixotry', repeat('banana ', 4300)) AS text", "'en' AS lang")
    rare = quality.grams(quality.TextBatch(pa.array(["quixotry"])))[0]
    assert set(rare) <= set(quality.fit(df)["en"][-1][0])


def test_perplexity_in_tables(spark):
    """A model too large to broadcast gives the same, for its own texts and for others."""
    r = random.Random(5)
    rows = [(k % 50, words(r, 40, 30) + r.choice(("", " | 7", " \u4e2d\u6587")), r.choice(("en", "de", None))) for k in range(60)]
    df = spark.createDataFrame([*rows, (None, "abcde", "en"), (99, None, "en"), (98, "abc", "fr")], "doc_id bigint, text string, lang string")
    other = spark.createDataFrame([(1, "zq#! xq\u4e2d " + words(r, 20, 30), "en"), (2, "some words", "it"), (3, "7 7 7 7 7", "de"), (4, None, "de")], "doc_id bigint, text string, lang string")
    whole, tables = quality.fit(df), quality.fit(df, small=30)
    assert whole.tables is None and tables.tables and 0 < sum(len(keys) for keys, _ in tables.values()) <= 30
    for texts in (df, other):
        a, b = (sorted(quality.score(texts, m).collect(), key=lambda x: str(x[:-1]) + f"{x[-1] or 0:.6f}") for m in (whole, tables))
        assert [x[:-1] for x in a] == [x[:-1] for x in b]
        assert [x[-1] is None for x in a] == [x[-1] is None for x in b]
        assert [x[-1] or 0 for x in a] == pytest.approx([x[-1] or 0 for x in b], abs=1e-9)
    kept = [sorted((str(x.doc_id), x.n_words, x.kept) for x in quality.judge(df, small=n).collect()) for n in (30, quality.SMALL)]
    assert kept[0] == kept[1]


def test_html(spark):
    model = html.train()
    maker, wrong, total = Maker(4242), 0, 0
    for _ in range(150):
        page = maker.page()
        marked, _ = html.page_blocks(page)
        _, x = html.page_blocks(page.replace("\x01", "").replace("\x02", ""))
        p = html.label(model, [x])[0] >= 0.5
        wrong += sum(bool(a) != ("\x01" in t or "\x02" in t) for a, t in zip(p, marked, strict=True))
        total += len(marked)
    assert wrong / total < 0.04
    page = "<html><body><nav><ul><li><a href=/a>home</a></li><li><a href=/b>news</a></li></ul></nav><article><h1>A Title</h1><p>One &amp; two\n three<br>four is here. It goes on, and ends.<p>Second para is longer than the first. It says more.</p></article><footer>&copy; x.example.com all rights</footer><script>var a='<p>no</p>';</script></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", "")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(rows).collect()}
    want = "A Title\nOne & two three four is here. It goes on, and ends.\nSecond para is longer than the first. It says more."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


def test_urls(spark):
    good = [f"https://s{k}.site.com/{w}/{k}" for k in range(60) for w in ("read", "blog")]
    bad = [f"https://win{k}.casino.net/es/bet-{k}" for k in range(120)]
    odd = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y", "http://a.example.com/en/", "http://com", "http://x.net/fr/?q", "x://y.org/blog/5", "http://q.org/es/bet-7", "a://b.net#c://d/"]
    rows = spark.createDataFrame(list(enumerate(good + bad + odd)), "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge(rows).collect()}
    assert len(got) == rows.count()
    at = len(good) + len(bad)
    assert [got[at + k].rule for k in range(len(odd))] == [None, None, None, "www.example.com/en/", "example.com/en/", None, "net/fr/", None, None, None]
    assert (got[at + 3].host, got[at + 3].path, got[at + 3].verdict) == ("www.example.com", "/en/x", "allow")
    assert got[at + 7].score > got[at + 8].score and {r.verdict for r in got.values()} == {"allow", "block"}
    assert urls.judge(rows.filter("page_id < 0")).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    """Each stage against its rule, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
        if name == "jaccard":
            assert jaccard.components_of(out).filter("doc_id <> component_id").count() == 0
        if name == "decontamination":
            assert decontaminate.decontaminate(out, bench).filter("n_hit > 0").count() == 0
        if name == "pii":
            assert out.count() == now.count() and pii.spans_of(out, "doc_id").filter("size(base) > 0").count() == 0
        now = out
    assert now.select("doc_id").distinct().count() == spark.read.parquet(f"{tmp_path}/pii").count()
