r"""Main text of web pages, by a recurrent labeller of blocks.

A page is cut into leaf blocks: the text between block-level tags (inline tags and <br> stay inside a
block; scripts, styles, comments and other raw content are no text). A block is a vector: its tag
path and the path's class, id and role words, hashed; its words, hashed and averaged; and counts
(words, links, digits, stops, place in the page). A bidirectional LSTM in numpy reads all blocks of a page, so
that each is labelled with the whole page in view. It is trained once per process, from a fixed seed, on
pages of a generator (`html_pages`), and its weights are broadcast; pages are labelled in batches.

The text of the kept blocks: character references decoded, white space turned into one space,
trimmed; empty blocks left out; joined by one \n in page order. A null or empty page gives an empty
text. Each row of pages gives one row.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import read_table
from heliograph.llm.html_pages import Maker

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meta link picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg iframe object canvas math".split())
#: What an opening tag ends of its own kind.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_STOPS = re.compile(r"[.!?;:,]")

PATH, WORDS, FACTS = 96, 48, 8
DIM = PATH + WORDS + FACTS
HIDDEN = 20


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """The leaf blocks of a page in order: tag path (each a tag with its class, id and role words), text
    as it stands (references not decoded, inline tags gone) and the characters within links."""
    path: list[str] = []
    text: list[str] = []
    linked = in_link = at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            linked += len(piece) * (in_link > 0)
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = max(0, in_link + (-1 if closing else 1))
            elif tag in ("br", "wbr"):
                text.append(" ")
            continue
        if text:
            yield tuple(path), "".join(text), linked
            text, linked = [], 0
        in_link = 0
        if closing:
            for k in range(len(path) - 1, -1, -1):
                if path[k].split(" ", 1)[0] == tag:
                    del path[k:]
                    break
            else:
                if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and path and re.match(r"h[1-6]\b", path[-1]):
                    path.pop()
        else:
            ends = _CLOSES.get(tag) or ({"p"} if tag in _ENDS_P else ())
            while path and path[-1].split(" ", 1)[0] in ends:
                path.pop()
            if tag not in _VOID and not m[3].endswith("/"):
                marks = " ".join(x for a in _ATTR.finditer(m[3]) for x in _SPLIT.split((a[2] or a[3] or a[4] or "").lower()) if x)
                path.append(f"{tag} {marks}" if marks else tag)
    if at < len(page):
        text.append(page[at:])
    if text:
        yield tuple(path), "".join(text), linked


@cache
def _one_path(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH, np.float32)
    names = [p.split(" ") for p in path]
    for depth, (tag, *marks) in enumerate(names):
        out[zlib.crc32(tag.encode()) % PATH] = 1
        for w in marks:
            out[zlib.crc32(b"." + w.encode()) % PATH] = 1
        if depth >= len(names) - 2:
            out[zlib.crc32(b"%d>" % (len(names) - depth) + tag.encode()) % PATH] = 1
    return out


def page_blocks(page: str | None) -> tuple[list[str], np.ndarray]:
    """The cleaned text of each block of a page that has any, and the blocks' vectors."""
    texts, rows = [], []
    found = []
    for path, raw, linked in blocks(page or ""):
        if raw.isspace():
            continue
        text = " ".join(_html.unescape(raw).split())
        if text:
            found.append((path, text, linked / max(1, len(raw))))
    n = len(found)
    for k, (path, text, linked) in enumerate(found):
        v = np.zeros(DIM, np.float32)
        v[:PATH] = _one_path(path[-12:])
        words = text.split(" ")
        v[PATH : PATH + WORDS] = np.bincount([zlib.crc32(w.encode("utf-8", "replace")) % WORDS for w in words], minlength=WORDS) / len(words) ** 0.5
        v[PATH + WORDS :] = (min(np.log1p(len(words)), 8) / 4, linked, min(1.0, 4 * len(_STOPS.findall(text)) / len(words)), text[-1] in ".!?", k / n, (n - k) / n, min(1.0, sum(map(str.isdigit, text[:200])) / 20), len(path) / 12)
        texts.append(text)
        rows.append(v)
    return texts, np.array(rows, np.float32).reshape(len(rows), DIM)


# ------------------------------------------------------------------ the labeller


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scan(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """One direction over x (time, batch, DIM): the hidden state at each time, and what the gradient needs."""
    steps, batch = x.shape[:2]
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out, kept = np.zeros((steps, batch, HIDDEN), np.float32), []
    z_in = x @ w + b
    for t in range(steps):
        z = z_in[t] + h @ u
        g = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        a = np.tanh(z[:, 3 * HIDDEN :])
        c_new = f * c + i * a
        th = np.tanh(c_new)
        m = live[t][:, None]
        kept.append((i, f, o, a, c, th, h, m))
        c, h = np.where(m, c_new, c), np.where(m, o * th, h)
        out[t] = h
    return out, kept


def _back(x: np.ndarray, grad: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    dz_all = np.zeros((*grad.shape[:2], 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, a, c, th, h, m = kept[t]
        dh = dh + grad[t]
        d, e = np.where(m, dh, 0), np.where(m, dc, 0)
        e = e + d * o * (1 - th * th)
        dz = np.concatenate([e * a * i * (1 - i), e * c * f * (1 - f), d * th * o * (1 - o), e * i * (1 - a * a)], 1)
        dz_all[t] = dz
        du += h.T @ dz
        dh, dc = np.where(m, 0, dh) + dz @ u.T, np.where(m, e * f, dc)
    return np.tensordot(x, dz_all, ((0, 1), (0, 1))), du, dz_all.sum((0, 1))


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, live = np.zeros((steps, len(pages), DIM), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        live[: len(p), k] = True
    return x, live


def _forward(model: dict, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, tuple]:
    f, kf = _scan(x, live, model["wf"], model["uf"], model["bf"])
    r, kr = _scan(x[::-1], live[::-1], model["wr"], model["ur"], model["br"])
    both = np.concatenate([f, r[::-1], x], 2)
    return both @ model["wo"] + model["bo"], (both, kf, kr)


@cache
def train(pages: int = 900, epochs: int = 9, seed: int = 7, batch: int = 32) -> dict:
    """The weights, the same for the same arguments. Adam on the log loss of all blocks."""
    maker = Maker(seed)
    data = []
    for _ in range(pages):
        page = maker.page()
        texts, x = page_blocks(page)
        y = np.array(["\x01" in t or "\x02" in t for t in texts], np.float32)
        if len(y):
            _, clean = page_blocks(page.replace("\x01", "").replace("\x02", ""))
            if len(clean) == len(y):
                data.append((clean, y))
    rng = np.random.default_rng(seed)
    make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model = {"wf": make(DIM, 4 * HIDDEN), "uf": make(HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32), "wr": make(DIM, 4 * HIDDEN), "ur": make(HIDDEN, 4 * HIDDEN), "br": np.zeros(4 * HIDDEN, np.float32), "wo": make(2 * HIDDEN + DIM), "bo": np.zeros((), np.float32)}
    model["bf"][HIDDEN : 2 * HIDDEN] = model["br"][HIDDEN : 2 * HIDDEN] = 1
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        order = np.concatenate([c[np.argsort([len(data[k][1]) for k in c])] for c in np.array_split(order, max(1, len(order) // 256))])
        for at in range(0, len(order), batch):
            some = [data[k] for k in order[at : at + batch]]
            x, live = _pad([s[0] for s in some])
            y = np.zeros(live.shape, np.float32)
            for k, s in enumerate(some):
                y[: len(s[1]), k] = s[1]
            logit, (both, kf, kr) = _forward(model, x, live)
            d = np.where(live, _sigmoid(logit) - y, 0) / live.sum()
            g = {"wo": np.tensordot(d, both, ((0, 1), (0, 1))), "bo": d.sum()}
            dh = d[:, :, None] * model["wo"][: 2 * HIDDEN]
            g["wf"], g["uf"], g["bf"] = _back(x, dh[:, :, :HIDDEN], kf, model["uf"])
            g["wr"], g["ur"], g["br"] = _back(x[::-1], dh[::-1, :, HIDDEN:], kr, model["ur"])
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k in model:
                gk = g[k] + 1e-5 * model[k]
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
                model[k] = (model[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def label(model: dict, pages: list[np.ndarray], batch: int = 128) -> list[np.ndarray]:
    """Of each page's block vectors: the probability of each block to be the article's."""
    out = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        # as many pages as keep the padded batch small; long pages go alone
        some = order[at : at + max(1, min(batch, 60_000 // len(pages[order[min(len(order), at + batch) - 1]])))]
        x, live = _pad([pages[k] for k in some])
        p = _sigmoid(_forward(model, x, live)[0])
        for j, k in enumerate(some):
            out[k] = p[: len(pages[k]), j]
        at += len(some)
    return out


def extract(pages: DataFrame, keep: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    held = pages.sparkSession.sparkContext.broadcast(train())
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [page_blocks(p) for p in batch.column(2).to_pylist()]
                marks = label(held.value, [x for _, x in found])
                texts = ["\n".join(t for t, p in zip(block, mark, strict=True) if p >= keep) for (block, _), mark in zip(found, marks, strict=True)]
                if _one_path.cache_info().currsize > 50_000:
                    _one_path.cache_clear()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(apply, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
ORACLES: dict[str, str] = {}
