"""Vector passes over a batch of texts: code points, lines, word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from heliograph.llm.common import TextBatch, mix, span_hashes, words


def runs(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, TextBatch]]:
    """The rows in runs of about `size` bytes (one whole text at least), with each run's first row."""
    whole = TextBatch(column)
    at = 0
    while at < whole.n:
        to = max(at + 1, int(np.searchsorted(whole.start, whole.start[at] + size, side="right")) - 1)
        run = TextBatch.__new__(TextBatch)
        run.n, run.start = to - at, whole.start[at : to + 1] - whole.start[at]
        run.data = whole.data[whole.start[at] : whole.start[to]]
        yield at, run
        at = to


def code_points(run: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the offset of each text among them."""
    before = np.zeros(len(run.data) + 1, np.int64)
    np.cumsum((run.data & 0xC0) != 0x80, out=before[1:])
    return np.frombuffer(run.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), before[run.start]


def _flags(values: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in values]] = True
    return out


_SYMBOL = _flags("#*$%&|<>")


def repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is its (doc, h) found twice or more; is it an earlier one's repeat."""
    if not len(h):
        e = np.zeros(0, bool)
        return e, e
    key = mix(h ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.zeros(len(h), bool)
    later[order[1:]] = same
    many = later.copy()
    many[order[:-1]] |= same
    return many, later


def base_statistics(run: TextBatch) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n, data = run.n, run.data
    begin, end, doc = words(run)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": np.bincount(doc, weights=lead[end] - lead[begin], minlength=n).astype(np.int64), "n_symbols": symbols[run.start[1:]] - symbols[run.start[:-1]]}
    # lines: cut at each \n and at each text's end
    breaks = np.flatnonzero(data == 10)
    line_begin = np.concatenate([run.start[:-1], breaks + 1])
    line_end = np.concatenate([run.start[1:], breaks])
    line_begin, line_end = np.sort(line_begin), np.sort(line_end)
    line_doc = np.searchsorted(run.start[1:], line_begin, side="right")
    # an empty text's line begins where the next text begins; a line after a text's last \n may be empty: neither has a word
    filled = np.searchsorted(begin, line_end) > np.searchsorted(begin, line_begin)
    line_begin, line_end, line_doc = line_begin[filled], line_end[filled], line_doc[filled]
    _, later = repeated(line_doc, span_hashes(data, line_begin, line_end))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    h = span_hashes(data, begin, end)
    if len(h) >= 3:
        window = mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + mix(h[2:] * np.uint64(7))))
        inside = doc[:-2] == doc[2:]
        many = np.zeros(len(window), bool)
        many[inside] = repeated(doc[:-2][inside], window[inside])[0]
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[k : len(h) - 2 + k] |= many
        out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return {k: v.astype(np.int64) for k, v in out.items()}
