"""Exact Jaccard self-join of documents on word shingles, by token-combination prefixes.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents of equal sets are one
class, told by a 128-bit digest; the join is between classes.

Order tokens (shingles): rare, frequent, very frequent, within a class by hash. If two sets have a
Jaccard similarity of t or more, each lacks at most n - ceil(t n) tokens of the other. So a prefix that
keeps, after losing any n - ceil(t n) tokens, one rare token, two frequent tokens of one group or three
very frequent tokens of one group, must share such a token or combination with the other set's prefix: of
the two prefixes the one that ends first lies, as far as it is common, inside the other. Tokens that need
company are dealt into groups, more for larger sets: each group extends the prefix by one or two tokens,
and keeps the number of combinations near that of tokens. Sets too small for combinations use single
tokens. Groups depend on the size class, and as similar sets lie in the same or the next size class, a
set indexes its combinations under both. Any rule that tells a token's class by the token alone gives
the same links; the classes only keep lists short.

1. One pass over all texts gives set sizes, digests, and each chunk's repeated tokens; tokens whose
   counts sum to `heavy` or more are frequent, to `heavy` squared or more very frequent (at most a million
   tokens, the most frequent ones, are broadcast).
2. A second pass indexes prefixes. Rare signatures travel as packed arrays, each to one of many
   parts, which drops those of a single class (nearly all). Combinations travel as rows. Where a single
   token's list turns out longer than `longest`, the token joins the frequent class and the pass is
   repeated, until no list is: this counts tokens that chunks see only once each.
3. Of lists with the same members one stays.
4. Links are sought where they can still join components: first each list's members against one
   pivot, then all pairs of members in different components. A list whose members are in one
   component emits nothing, so that a group of n copies costs n pairs. A task compares the parity
   maps of lists, or of two blocks of a long list, and emits only the pairs that these allow (the maps
   rule out nearly all below the threshold). The pairs are verified on whole sets.

Texts without words (null texts too) have an empty set and link with nothing. Fewer than five words
are one shingle. Repeated rows are copies like any others. Rows keep their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import TextBatch, lower_ascii, materialize, mix, read_table, span_hashes, words
from heliograph.llm.graph import components
from heliograph.llm.textscan import runs

#: Tokens of a chunk: what a task holds before it sends.
CHUNK = 500_000
#: Most frequent tokens that may be broadcast.
MOST_FREQUENT = 1_000_000
#: Most classes whose texts are picked by a broadcast.
SMALL = 2_000_000


def shingles(run: TextBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) pairs, sorted by text and hash."""
    data = lower_ascii(run.data)
    begin, end, doc = words(run, data)
    h = span_hashes(data, begin, end)
    m = max(0, len(h) - width + 1)
    total = np.zeros(m, np.uint64)
    for k in range(width):
        total = mix(total + h[k : m + k] * np.uint64(2 * k + 3))
    inside = doc[:m] == doc[width - 1 :] if m else np.zeros(0, bool)
    found, of = [total[inside]], [doc[:m][inside]]
    count = np.bincount(doc, minlength=run.n)
    first = np.searchsorted(doc, np.arange(run.n))
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        one = np.full(len(short), size, np.uint64)
        for k in range(size):
            one = mix(one + h[first[short] + k] * np.uint64(2 * k + 5))
        found.append(one)
        of.append(short)
    h, d = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def digests(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes, and two 64-bit sums of each set's mixed tokens (n x 2)."""
    size = np.bincount(doc, minlength=n)
    sums = np.zeros((n, 2), np.uint64)
    for k, salt in enumerate((0x1234567, 0xABCDEF123)):
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=run[1:])
        stop = np.cumsum(size)
        sums[:, k] = mix(run[stop] - run[stop - size] + size.astype(np.uint64))
    return size, sums


#: The least number of bits of a set's parity map.
LEAST = 256


def parity_maps(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each set the parities of the tokens that fall on each bit of a map of two to four bits for each
    token (a power of two, LEAST at least). Two maps differ in no more bits than the sets do in tokens, which
    rules out most pairs without their sets. A map's half added to its other half is the map of half the
    bits, so that maps of any two sets compare."""
    bits = np.maximum(LEAST, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    full = np.zeros(start[-1] // 8, np.uint8)
    place = start[doc] + ((h >> np.uint64(11)).astype(np.int64) & (bits[doc] - 1))
    np.bitwise_xor.at(full, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return [full[lo // 8 : hi // 8].tobytes() for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def _rows(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """The maps at these places, which are of one length, as rows of 64-bit words."""
    taken = column.take(pa.array(at))
    offsets = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset)
    return np.frombuffer(taken.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64).reshape(len(taken), -1)


def _fold(maps: np.ndarray, words_: int) -> np.ndarray:
    return maps if maps.shape[1] == words_ else np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words_), axis=1)


def differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """For each row the bits in which two maps differ, the longer one folded."""
    la, lb = (np.diff(np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset)) for x in (a, b))
    out = np.zeros(len(a), np.int64)
    for x, y in set(zip(la.tolist(), lb.tolist(), strict=True)):
        at = np.flatnonzero((la == x) & (lb == y))
        n = min(x, y) // 8
        for k in range(0, len(at), step := max(1, (1 << 20) // n)):
            part = at[k : k + step]
            out[part] = np.bitwise_count(_fold(_rows(a, part), n) ^ _fold(_rows(b, part), n)).sum(1)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _sizes(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, th (the text's hash), n, cls, map for each document; and token, times for what a chunk repeats."""
    texts = documents.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, n_held, id_type = [], set(), 0, None
        names = ["doc_id", "th", "n", "cls", "map", "token", "times"]

        def counts() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            token, times = token[times > 1].view(np.int64), times[times > 1]
            none = [pa.nulls(len(token), t) for t in (id_type, pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(token), pa.array(times.astype(np.int64))], names)

        for batch in batches:
            id_type = batch.column(0).type
            for at, run in runs(batch.column(2), 1 << 20):
                doc, h = shingles(run, width)
                size, sums = digests(doc, h, run.n)
                cls = _binary(sums)
                maps = parity_maps(doc, h, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, run.n), batch.column(1).slice(at, run.n), pa.array(size.astype(np.int64)), cls, pa.array(maps, pa.binary()), pa.nulls(run.n, pa.int64()), pa.nulls(run.n, pa.int64())], names)
                keys = sums[:, 0].tolist()
                fresh = np.zeros(run.n, bool)
                for k, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        fresh[k] = True
                held.append(h[fresh[doc]])
                n_held += len(held[-1])
                if n_held >= CHUNK:
                    yield counts()
                    held, seen, n_held = [], set(), 0
        if held:
            yield counts()

    return texts.mapInArrow(scan, f"doc_id {kind}, th bigint, n bigint, cls binary, map binary, token bigint, times bigint")


def _need(n: int, percent: int) -> int:
    """Tokens that a prefix must offer: one more than may be missing."""
    return n - (percent * n + 99) // 100 + 1


def _class_of(n: int, percent: int) -> int:
    """Size classes: similar sets lie in the same class or in neighbouring ones."""
    k, top = 0, 1
    while top < n:  # class k holds sizes up to top
        top = max(top + 1, top * 100 // percent)
        k += 1
    return k


def _size_of_class(k: int, percent: int) -> int:
    top = 1
    for _ in range(k):
        top = max(top + 1, top * 100 // percent)
    return top


_MASK = (1 << 64) - 1


def _combinations(tokens: np.ndarray, level: np.ndarray, need: int, size_class: int, percent: int) -> list[int]:
    """Signatures of the tokens (in order; level: how many of one group must meet) of a prefix that must still
    outlast the loss of need - 1 tokens."""
    top = _size_of_class(size_class, percent)
    if top < 16:
        return [(t * 0x9E3779B97F4A7C15 + size_class * 0x1000193) & _MASK for t in tokens[:need].tolist()]
    groups = max(1, top // 20)
    held: dict[tuple[int, int], list[int]] = {}
    for t, k in zip(tokens.tolist(), level.tolist(), strict=True):
        if need <= 0:
            break
        own = held.setdefault((k, (t >> 20) % groups), [])
        need -= len(own) >= k - 1  # a group outlasts the loss of all but k - 1 of its tokens
        own.append(t)
    out = []
    for (k, _), own in held.items():
        for some in combinations(own, k):
            h = size_class * 0x1000193
            for t in some:
                h = ((h ^ t) * 0x9E3779B97F4A7C15 + (t >> 7)) & _MASK
                h ^= h >> 29
            out.append(h * 0xD6E8FEB86659FD93 & _MASK)
    return out


def _pack(values: np.ndarray) -> bytes:
    """Bytes of integers, most significant planes apart, so that zeros cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _cut(sig: np.ndarray, bits: int) -> np.ndarray:
    """A rare signature as the postings show it: the 40 bits after the part's, and the part's number."""
    return (((sig << np.uint64(bits)) >> np.uint64(24)) << np.uint64(24)) | (sig >> np.uint64(64 - bits))


def _index(documents: DataFrame, frequent, long_lists, width: int, percent: int, bits: int) -> DataFrame:
    """Rows of two kinds. part: packed rare signatures of a chunk whose top bits are part. sig: one
    combination of a class (cls, n, rare: per mille of its tokens that are rare).

    frequent: the broadcast frequent tokens, sorted, and the level (2 or 3) of each; long_lists: the broadcast
    signatures, as _cut makes them and sorted, whose tokens are frequent too."""
    texts = documents.select(F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, levels = frequent.value
        long_sigs = long_lists.value
        names = ["part", "sigs", "idx", "classes", "facts", "sig", "cls", "n", "rare"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        seen: set = set()
        sigs: list = []
        idx: list = []
        table: list = []
        facts: list = []
        n_table = n_held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            s, i = np.concatenate(sigs), np.concatenate(idx)
            order = np.argsort(s, kind="stable")
            s, i = s[order], i[order]
            part = (s >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.searchsorted(part, np.arange((1 << bits) + 1))
            t, f = np.concatenate(table), np.concatenate(facts)
            for p in range(1 << bits):
                lo, hi = cut[p], cut[p + 1]
                if lo < hi:
                    used, place = np.unique(i[lo:hi], return_inverse=True)
                    # the 40 bits after the part's come sorted: keep their steps
                    mid = (s[lo:hi] << np.uint64(bits)) >> np.uint64(24)
                    row = [p, _pack(np.diff(mid, prepend=np.uint64(0))), _pack(place.astype(np.uint32)), t[used].tobytes(), _pack(f[used].ravel())]
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(row, kinds, strict=False)), *(pa.nulls(1, k) for k in kinds[5:])], names)

        for batch in batches:
            for _, run in runs(batch.column(0), 1 << 20):
                doc, h = shingles(run, width)
                size, sums = digests(doc, h, run.n)
                fresh = np.zeros(run.n, bool)
                for k, key in enumerate(sums[:, 0].tolist()):
                    if size[k] and key not in seen:
                        seen.add(key)
                        fresh[k] = True
                keep = fresh[doc]
                doc, h = doc[keep], h[keep]
                level = np.ones(len(h), np.int8)
                if len(long_sigs):
                    level[_is_in(_cut(mix(h), bits), long_sigs)] = 2
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    level = np.where(heavy[at] == h, levels[at], level)
                order = np.lexsort((h, level, doc))
                h, level = h[order], level[order]  # doc stays as it is
                often = level > 1
                n_rare = np.bincount(doc[~often], minlength=run.n)
                need = size - (percent * size + 99) // 100 + 1
                rank = np.arange(len(h)) - np.searchsorted(doc, doc)
                pick = ~often & (rank < need[doc])
                sigs.append(mix(h[pick]))
                idx.append(doc[pick].astype(np.int64) + n_table)
                table.append(sums)
                permille = n_rare * 1000 // np.maximum(size, 1)
                facts.append(np.stack([size, permille], 1).astype(np.uint32))
                n_table += run.n
                n_held += len(h)
                out_sig, out_row = [], []
                for k in np.flatnonzero(fresh & (n_rare < need)).tolist():
                    lo = np.searchsorted(doc, k)
                    own, own_level = h[lo + n_rare[k] : lo + size[k]], level[lo + n_rare[k] : lo + size[k]]
                    own_class = _class_of(int(size[k]), percent)
                    for c in (own_class, own_class + 1):
                        s = _combinations(own, own_level, int(need[k] - n_rare[k]), c, percent)
                        out_sig += s
                        out_row += [k] * len(s)
                if out_sig:
                    row = np.array(out_row)
                    cols = [pa.array(np.array(out_sig, np.uint64).view(np.int64)), _binary(sums[row]), pa.array(size[row].astype(np.int64)), pa.array(permille[row].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(row), k) for k in kinds[:5]), *cols], names)
                if n_held >= CHUNK:
                    yield from packed()
                    seen, sigs, idx, table, facts, n_table, n_held = set(), [], [], [], [], 0, 0
        if n_held:
            yield from packed()

    return texts.mapInArrow(scan, "part int, sigs binary, idx binary, classes binary, facts binary, sig bigint, cls binary, n bigint, rare bigint")


def _meets(s: np.ndarray) -> np.ndarray:
    """Which of the sorted values occur more than once."""
    many = np.zeros(len(s), bool)
    same = s[1:] == s[:-1]
    many[1:] |= same
    many[:-1] |= same
    return many


def _postings(index: DataFrame) -> DataFrame:
    """sig, cls, n, rare, one: the classes of each signature of two or more classes (single tokens: one), or of
    any (combinations)."""

    def meet(rows: pa.Table) -> pa.Table:
        sig, cls, fact = [], [], []
        for p in rows.to_batches():
            for sigs, idx, classes, facts in zip(*(p.column(k) for k in (1, 2, 3, 4)), strict=True):  # one packed chunk each
                at = _unpack(idx.as_buffer(), np.uint32)
                sig.append(np.cumsum(_unpack(sigs.as_buffer(), np.uint64), dtype=np.uint64))
                cls.append(np.frombuffer(classes.as_buffer(), np.uint64).reshape(-1, 2)[at])
                fact.append(_unpack(facts.as_buffer(), np.uint32).reshape(-1, 2)[at])
        s, c, f = np.concatenate(sig), np.concatenate(cls), np.concatenate(fact)
        del sig, cls, fact
        order = np.argsort(s, kind="stable")
        s, c, f = s[order], c[order], f[order]
        many = _meets(s)
        s, c, f = s[many], c[many], f[many]
        order = np.lexsort((c[:, 1], c[:, 0], s))
        s, c, f = s[order], c[order], f[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1]).any(1)
        s, c, f = s[new], c[new], f[new]
        many = _meets(s)
        s, c, f = s[many], c[many], f[many]
        part = np.uint64(rows.column(0)[0].as_py())
        return pa.table([pa.array(((s << np.uint64(24)) | part).view(np.int64)), _binary(c) if len(c) else pa.nulls(0, pa.binary()), pa.array(f[:, 0].astype(np.int64)), pa.array(f[:, 1].astype(np.int64)), pa.array(np.ones(len(s), bool))], ["sig", "cls", "n", "rare", "one"])

    rare = index.filter("part is not null").select("part", "sigs", "idx", "classes", "facts").groupBy("part").applyInArrow(meet, "sig bigint, cls binary, n bigint, rare bigint, one boolean")
    often = index.filter("sig is not null").groupBy("sig", "cls").agg(F.first("n").alias("n"), F.first("rare").alias("rare"))
    return rare.unionByName(often.select("sig", "cls", "n", "rare", F.lit(False).alias("one")))


def _sets(documents: DataFrame, classes: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """cls, tokens (sorted hashes) of the needed classes; one text of each is read again.
    classes: cls, th. need: cls."""
    one = materialize(classes.join(need, "cls", "left_semi").select("th"), "needed")
    small = one.count() <= SMALL
    texts = documents.select(F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).join(F.broadcast(one) if small else one, "th", "left_semi").select("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for _, run in runs(batch.column(0), 1 << 20):
                doc, h = shingles(run, width)
                size, sums = digests(doc, h, run.n)
                stop = np.cumsum(size)
                fresh = []
                for k, key in enumerate(sums[:, 0].tolist()):
                    if size[k] and key not in seen:
                        seen.add(key)
                        fresh.append(k)
                yield pa.RecordBatch.from_arrays([_binary(sums[fresh]), pa.array([h[stop[k] - size[k] : stop[k]].tobytes() for k in fresh], pa.binary())], ["cls", "tokens"])

    return materialize(texts.mapInArrow(scan, "cls binary, tokens binary").groupBy("cls").agg(F.first("tokens").alias("tokens")), "sets")


def _verify(pairs: DataFrame, documents: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs a, b whose similarity reaches the percentage. The sets' parity maps rule out most pairs; the
    sets of the rest are read again. classes: cls, n, th, map."""

    def joined(df: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        for side in "ba":
            df = df.join(table.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return df.select("a", "b", *(f"{c}_{side}" for c in columns for side in "ab"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            # similarity p means: common >= p total / (100 + p), so that total - 2 common differ at most
            ok = differ(batch.column(2), batch.column(3)) * (100 + percent) <= total * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            size, data = [], []
            for c in (batch.column(2), batch.column(3)):
                offsets = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset).astype(np.int64)
                size.append(np.diff(offsets) // 8)
                data.append((np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]) // 8))
            at = 0
            while at < batch.num_rows:  # some pairs at once, about a million tokens
                held = np.cumsum(size[0][at:] + size[1][at:])
                to = at + max(1, int(np.searchsorted(held, 1 << 20, side="right")))
                pair = np.concatenate([np.repeat(np.arange(to - at), n[at:to]) for n in size])
                token = np.concatenate([values[start[at] : start[to]] for values, start in data])
                order = np.lexsort((token, pair))
                pair, token = pair[order], token[order]
                twice = (token[1:] == token[:-1]) & (pair[1:] == pair[:-1])  # a set has a token once
                common = np.bincount(pair[1:][twice], minlength=to - at)
                ok[at:to] = 100 * common >= percent * (size[0][at:to] + size[1][at:to] - common)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    likely = materialize(joined(pairs, classes, "map", "n").mapInArrow(near, "a binary, b binary"), "likely")
    if likely.isEmpty():
        return likely
    need = likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    return materialize(joined(likely, _sets(documents, classes, need, width), "tokens").mapInArrow(check, "a binary, b binary"), "links")


def _similar_size(x: str, y: str, percent: int) -> F.Column:
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


#: Members, and bytes of parity maps, of a block.
BLOCK, BLOCK_BYTES = 1024, 2 << 20


def _across(members: DataFrame, maps: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs a, b of members (sig, cls, n, root) of one list in different components, as far as their parity
    maps (cls, map) allow. Lists of one block share tasks; a longer list is dealt into blocks by hash, and a
    task compares the members of two blocks. Nothing but the allowed pairs leaves a task. The maps join last,
    so that they move once."""
    width = F.greatest(F.lit(LEAST // 8), F.pow(F.lit(2), F.ceil(F.log2("n")) - 2))
    size = members.groupBy("sig").agg(F.count("*").alias("m"), F.sum(width).cast("long").alias("bytes"))
    size = materialize(size.select(F.col("sig").alias("of"), "bytes", F.ceil(F.greatest(F.col("m") / block, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "list_sizes")
    shared = size.filter("blocks = 1").agg(F.sum("bytes")).first()[0] or 0
    rows = members.join(size.drop("bytes"), F.col("sig") == F.col("of"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("sig"), F.lit(-(-shared // BLOCK_BYTES) + 1))).otherwise(F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")))
    rows = rows.select(task.alias("task"), "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "n", "root")
    rows = rows.join(maps, "cls").select("task", "sig", "i", "j", "own", "cls", "n", "root", "map")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        _, sig, i, j, own, cls, n, root, maps = (c.chunk(0) for c in rows.columns)
        n, own, i, j = n.to_numpy(), own.to_numpy(), i.to_numpy(), j.to_numpy()
        code = root.dictionary_encode().indices.to_numpy()
        width = np.diff(np.frombuffer(maps.buffers()[1], np.int32, len(maps) + 1, 4 * maps.offset)) // 8
        order = np.lexsort((width, j, i, sig.to_numpy()))
        key = np.stack([sig.to_numpy(), i, j])[:, order]
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        place = np.zeros(len(n), np.int64)
        mats = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            place[at] = np.arange(len(at))
            mats[w] = _rows(maps, at)
        found = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            mine = order[lo:hi]
            first, last = i[mine[0]], j[mine[0]]
            cut = np.flatnonzero(np.diff(width[mine])) + 1
            runs_ = np.split(mine, cut)
            for x in runs_:
                for y in runs_:
                    wx, wy = int(width[x[0]]), int(width[y[0]])
                    if first == last and wx > wy or max(wx, wy) > 2 * min(wx, wy):
                        continue
                    a, b = (x, y) if first == last else (x[own[x] == first], y[own[y] == last])
                    if not (len(a) and len(b)):
                        continue
                    w = min(wx, wy)
                    my = _fold(mats[wy][place[b]], w)
                    for k in range(0, len(a), step := max(1, (1 << 20) // (len(b) * w))):
                        part = a[k : k + step]
                        apart = np.bitwise_count(_fold(mats[wx][place[part]], w)[:, None, :] ^ my[None, :, :]).sum(2)
                        na, nb = n[part][:, None], n[b][None, :]
                        ok = (apart * (100 + percent) <= (na + nb) * (100 - percent)) & (code[part][:, None] != code[b][None, :])
                        ok &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                        if x is y and first == last:
                            ok &= part[:, None] < b[None, :]
                        if ok.any():
                            p, q = np.nonzero(ok)
                            found.append(np.stack([part[p], b[q]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table([cls.take(pa.array(pairs[:, 0])), cls.take(pa.array(pairs[:, 1]))], ["a", "b"])

    both = rows.groupBy("task").applyInArrow(compare, "a binary, b binary")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _lists(documents: DataFrame, frequent, total: int, width: int, percent: int, longest: int) -> DataFrame:
    """The postings, one list for each set of members."""
    spark = documents.sparkSession
    # about 250 000 rare signatures a part
    bits = min(24, max(6, int(np.ceil(np.log2(max(1, total * (101 - percent) / 100 / 250_000))))))
    known = np.zeros(0, np.uint64)
    while True:
        index = materialize(_index(documents, frequent, spark.sparkContext.broadcast(known), width, percent, bits), "prefixes")
        postings = materialize(_postings(index), "postings")
        marks = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
        lists = materialize(postings.groupBy("sig").agg(F.count("*").alias("members"), F.bool_or("one").alias("one"), *marks).filter("members > 1"), "lists")
        room = MOST_FREQUENT - len(known)
        long = lists.filter(F.col("one") & (F.col("members") > longest)).orderBy(F.col("members").desc(), "sig").limit(max(0, room)).select("sig").toArrow()
        if not len(long):
            kept = lists.groupBy("members", "mark0", "mark1").agg(F.min("sig").alias("sig")).select("sig")
            return materialize(postings.join(kept, "sig", "left_semi").select("sig", "cls", "n", "rare"), "postings")
        known = np.union1d(known, long.column("sig").to_numpy().view(np.uint64))


def links(documents: DataFrame, width: int = 5, percent: int = 80, heavy: int = 64, longest: int = 1024, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """sizes (doc_id, th, n, cls) of all documents, and roots (node, root) of the classes that are linked."""
    spark = documents.sparkSession
    scanned = materialize(_sizes(documents, width), "sizes")
    sizes = scanned.filter("th is not null and token is null").select("doc_id", "th", "n", F.expr("if(n > 0, cls, null)").alias("cls"), "map")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    often = scanned.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= heavy)
    often = often.orderBy(F.col("times").desc(), "token").limit(MOST_FREQUENT).toArrow()
    token = often.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    level = np.where(often.column("times").to_numpy() >= heavy * heavy, 3, 2).astype(np.int8)
    frequent = spark.sparkContext.broadcast((token[order], level[order]))
    postings = _lists(documents, frequent, total, width, percent, longest)
    classes = materialize(sizes.filter("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min("th").alias("th"), F.first("map").alias("map")), "class_facts")
    # first each list's members against its pivot, the member with the fewest tokens of its own
    pivot = F.min(F.struct("rare", "cls", "n")).alias("pivot")
    met = postings.join(postings.groupBy("sig").agg(pivot), "sig").filter((F.col("cls") != F.col("pivot.cls")) & _similar_size("n", "pivot.n", percent))
    pairs = materialize(met.select(F.least("cls", "pivot.cls").alias("a"), F.greatest("cls", "pivot.cls").alias("b")).distinct(), "pairs")
    edges = _verify(pairs, documents, classes, width, percent)
    roots = materialize(components(edges), "roots")
    # then all pairs across components
    few = roots.count() <= MOST_FREQUENT
    now = postings.join(F.broadcast(roots) if few else roots, postings["cls"] == roots["node"], "left").select("sig", "cls", "n", F.coalesce("root", "cls").alias("root"))
    now = materialize(now, "members")
    lists = now.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("sig")
    mine = materialize(now.join(lists, "sig"), "open_members")
    pairs = _across(mine, classes.select("cls", "map"), percent, block)
    fresh = _verify(materialize(pairs.distinct(), "pairs"), documents, classes, width, percent)
    if not fresh.isEmpty():
        roots = materialize(components(edges.unionByName(fresh)), "roots")
    return sizes.drop("map"), roots


def components_of(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    sizes, roots = links(documents, width, percent)
    least = sizes.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    least = materialize(least.join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "least"), "class_ids")
    of_root = materialize(least.groupBy("root").agg(F.min("least").alias("component_id")), "component_ids")
    of_class = materialize(least.join(of_root, "root").select(F.col("cls").alias("of"), "component_id"), "classes")
    out = sizes.join(of_class, sizes["cls"] == of_class["of"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """documents without all but one row of each group of linked ones: the row of the least doc_id (rows
    without an id last), of these the one of the least text hash, of rows equal in both any one. Rows are
    dropped by id and text, so a null or repeated id touches no other group. Rows without words, which
    link with nothing, all stay."""
    sizes, roots = links(documents, width, percent)
    rows = sizes.filter("n > 0").join(roots, F.col("cls") == F.col("node"), "left").select("doc_id", "th", F.coalesce("root", "cls").alias("root"))
    rows = rows.groupBy("root", "doc_id", "th").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th"))
    rows = materialize(rows, "linked")
    groups = materialize(rows.groupBy("root").agg(first.alias("kept"), F.sum("times").alias("size")).filter("size > 1").select(F.col("root").alias("of"), "kept"), "groups")
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th"))
    marked = rows.join(groups, F.col("root") == F.col("of")).filter(~is_kept | (F.col("times") > 1))
    marked = materialize(marked.select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), is_kept.alias("_once")), "marked")

    def these(once: bool) -> DataFrame:
        some = marked.filter(F.col("_once") == once).drop("_once")
        return F.broadcast(some) if some.count() <= SMALL else some

    same = documents["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(documents["text"]) == F.col("_th"))
    again = these(True)
    if again.isEmpty():
        return documents.join(these(False), same, "left_anti")
    # the repeats leave with the others, and one of each comes back
    once = documents.join(again, same).dropDuplicates(["_d", "_th"]).select(*documents.columns)
    every = marked.drop("_once")
    every = F.broadcast(every) if every.count() <= SMALL else every
    return documents.join(every, same, "left_anti").unionByName(once)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
