"""Shingle sets, signatures and comparisons for a batch of texts, inside tasks."""

from __future__ import annotations

import numpy as np

from .common import process_cache
from .runs import Powers, hashes, mix

TREES, DEPTH = 20, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACES = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in a row, edges): the texts'
    words are runs without white space, with A-Z in lower case."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    n = len(data)
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, data), np.int64, n) + 1)])
    space = (raw == 32) | (raw >= 9) & (raw <= 13)
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    word = hashes(raw, starts, ends, process_cache("powers", Powers), which=(0,))[0]
    text_of = np.searchsorted(edges, starts, side="right") - 1
    words = np.bincount(text_of, minlength=n)
    if len(word) >= width:
        h = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            h += word[k:len(word) - width + 1 + k] * _PLACES[k]
        inside = text_of[:len(h)] == text_of[width - 1:]
        h, of = mix(h[inside]), text_of[:len(h)][inside]
    else:
        h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):                                        # the whole sequence as one
        first = np.searchsorted(text_of, short)
        one = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = words[short] > k
            one[has] += word[first[has] + k] * _PLACES[k]
        h = np.concatenate([h, mix(one + words[short].astype(np.uint64) * _ODD)])
        of = np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, np.searchsorted(of, np.arange(n + 1))


def signatures(h: np.ndarray, edges: np.ndarray, k: int = TREES * DEPTH, at_once: int = 1 << 15) -> np.ndarray:
    """k minimum hashes (32 bits) of each set; zeros for an empty one."""
    multipliers = process_cache(f"multipliers {k}", lambda: [
        np.uint64(int(x) | 1) for x in np.random.default_rng(17).integers(1 << 62, 1 << 63, k, dtype=np.uint64)])
    out = np.zeros((len(edges) - 1, k), np.uint32)
    full = np.flatnonzero(edges[1:] > edges[:-1])
    first, last = edges[:-1][full], edges[1:][full]
    i = 0
    while i < len(full):                                  # a few sets at a time, to stay in the cache
        j = max(i + 1, int(np.searchsorted(last, first[i] + at_once)))
        part, starts = h[first[i]:last[j - 1]], first[i:j] - first[i]
        for c, m in enumerate(multipliers):
            out[full[i:j], c] = np.minimum.reduceat((part * m) >> np.uint64(32), starts)
        i = j
    return out


def set_hashes(h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a whole set: two sums of mixed members."""
    sums = []
    for salt in (np.uint64(1), _ODD):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt))])
        sums.append((total[edges[1:]] - total[edges[:-1]]).astype(np.int64))
    return sums[0], sums[1]


def labels(sig: np.ndarray) -> np.ndarray:
    """Label of each tree's first ``DEPTH`` levels."""
    out = np.zeros((len(sig), sig.shape[1] // DEPTH), np.uint64)
    for t in range(out.shape[1]):
        h = np.full(len(sig), (t * int(_ODD)) & ((1 << 64) - 1), np.uint64)
        for d in range(DEPTH):
            h = mix(h + sig[:, t * DEPTH + d].astype(np.uint64) * _PLACES[d])
        out[:, t] = h
    return out.astype(np.int64)
