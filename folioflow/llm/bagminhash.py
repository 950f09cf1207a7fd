"""BagMinHash signatures of weighted sets, many documents at a time in numpy.

A document is a multiset of shingles; the weight of a shingle is how often it occurs. The weight axis is discretised
and covered by the levels [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each (shingle, level) carries one Poisson process
in time, with a rate of M times the level's length, seeded by shingle and level alone; a point has a random component
and, by halving its level again and again, a random position on the weight axis. A document sees the points that lie
below its weight. The first point in each component is the signature, so two documents agree in a component with the
probability of their weighted Jaccard similarity: sum of the minima over sum of the maxima of their weights.

Points are drawn in order of time, and a process is left once it passes the latest first point of its document, so
most shingles cost one or two draws. Draws come in rounds of 1, 2, 4, ... points; a point's value depends on its
place in its process only, never on the document.
"""

from __future__ import annotations

import numpy as np
import xxhash

BANDS, ROWS = 24, 6
M = BANDS * ROWS
SHINGLE = 5
#: Elements whose processes are drawn at once.
PART = 100_000

_U = np.uint64
_GOLD, _C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_COMPONENT, _POSITION = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_SHINGLE_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], _U)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix)."""
    z = (z ^ (z >> _U(30))) * _C1
    z = (z ^ (z >> _U(27))) * _C2
    return z ^ (z >> _U(31))


#: Bytes that are hashed at once; a word longer than that is hashed on its own.
SLICE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5851F42D4C957F2D


def _powers(base: int) -> np.ndarray:
    p = np.full(SLICE, base, _U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


_BYTE = np.where(_SPACE, _U(0), mix(np.arange(1, 257, dtype=_U)))
_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the words of UTF-8 bytes: polynomials over their bytes, summed for all words at once."""
    b, at, places, hashes = np.frombuffer(data, np.uint8), 0, [], []
    while at < len(b):
        part = b[at : at + SLICE]
        gap = _SPACE[part]
        if at + SLICE < len(b) and not _SPACE[b[at + SLICE]]:
            ends = np.flatnonzero(gap)
            if not len(ends):
                end = at + SLICE
                while end < len(b) and not _SPACE[b[end : end + SLICE]].any():
                    end += SLICE
                end = end + int(_SPACE[b[end : end + SLICE]].argmax()) if end < len(b) else len(b)
                places.append(np.array([at]))
                hashes.append(np.array([xxhash.xxh64_intdigest(data[at:end])], _U))
                at = end
                continue
            part, gap = part[: ends[-1] + 1], gap[: ends[-1] + 1]
        begins = np.flatnonzero(~gap & np.append(True, gap[:-1]))
        if len(begins):
            places.append(begins + at)
            hashes.append(mix(np.add.reduceat(_BYTE[part] * _POWERS[: len(part)], begins) * _INVERSE[begins]))
        at += len(part)
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.empty(0, np.int64), np.empty(0, _U))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The hashes of all shingles of each text in sorted order, repeats included; a shorter text is one shingle of all its words."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    places, h = hashed_words(b"\n".join(data))
    first = np.searchsorted(places, np.cumsum([0] + [len(d) + 1 for d in data])).tolist()
    rolled = np.zeros(max(0, len(h) - SHINGLE + 1), _U)
    for i in range(SHINGLE):
        rolled += h[i : len(rolled) + i] * _SHINGLE_MIX[i]
    out = []
    for a, b in zip(first, first[1:]):
        n = b - a
        if n >= SHINGLE:
            s = mix(rolled[a : b - SHINGLE + 1])
            s.sort()
        else:
            s = mix((h[a:b] * _SHINGLE_MIX[:n]).sum(keepdims=True, dtype=_U) + _U(n)) if n else np.empty(0, _U)
        out.append(s)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted arrays with repeats."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    order = both.argsort(kind="stable")
    side = (order >= len(a)).astype(np.int8)
    vals = both[order]
    starts = np.flatnonzero(np.append(True, vals[1:] != vals[:-1]))
    nb = np.add.reduceat(side.astype(np.int64), starts)
    na = np.diff(np.append(starts, len(vals))) - nb
    common = np.minimum(na, nb).sum()
    return float(common / (len(a) + len(b) - common))


def signatures(docs: list[np.ndarray], m: int = M) -> np.ndarray:
    """(documents, m) first points as 64-bit words; documents are sorted shingle arrays and not empty.

    Elements are drawn in parts of at most ``PART``, so that a long document takes no more memory than a short one: a part begins
    with the first points of those before it, which decide how long its processes are followed and nothing else.
    """
    h = np.full(len(docs) * m, np.inf)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for i, s in enumerate(docs):
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        el, w = s[starts], np.diff(np.append(starts, len(s)))
        for k in range(0, len(el), PART):
            held.append((el[k : k + PART], w[k : k + PART], np.full(min(PART, len(el) - k), i, np.int64)))
            size += len(held[-1][0])
            if size >= PART:
                _draw(h, m, *map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        _draw(h, m, *map(np.concatenate, zip(*held)))
    return h.view(_U).reshape(len(docs), m)


def _draw(h: np.ndarray, m: int, el: np.ndarray, w: np.ndarray, doc: np.ndarray) -> None:
    """Lowers the first points ``h`` of all documents' components by the processes of some elements."""
    # one process by element and level whose lower end lies below the weight
    parts, level, low = [], 0, 0
    at = np.arange(len(el))
    while len(at):
        length = 1 if level == 0 else low
        parts.append((mix(el[at] + mix(np.array([level], _U))), doc[at], w[at], np.full(len(at), low), np.full(len(at), float(length))))
        low, level = (1, 1) if level == 0 else (low * 2, level + 1)
        at = at[w[at] > low]
    state, doc, w, lows, length = (np.concatenate(x) for x in zip(*parts))
    now, step, drawn = np.zeros(len(state)), 1, 0
    while len(state):
        j = np.arange(drawn + 1, drawn + step + 1, dtype=_U) * _GOLD
        r = mix(state[:, None] + j[None, :])
        gaps = -np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (length * m)[:, None]
        times = now[:, None] + np.cumsum(gaps, 1)
        component = (mix(r ^ _COMPONENT) >> _U(32)) * _U(m) >> _U(32)
        seen = None
        partly = (lows + length > w) & (length > 1)
        if partly.any():
            # the position by halving: the bits of one draw, read from the top, choose halves
            u = (mix(r[partly] ^ _POSITION) >> _U(11)).astype(np.float64) * 2.0**-53
            seen = np.ones(r.shape, bool)
            seen[partly] = lows[partly][:, None] + np.floor(u * length[partly][:, None]) < w[partly][:, None]
        key = doc[:, None] * m + component.astype(np.int64)
        early = times < h[key]
        if seen is not None:
            early &= seen
        np.minimum.at(h, key[early], times[early])
        latest = h.reshape(-1, m).max(1)
        now = times[:, -1]
        go = now < latest[doc]
        state, doc, w, lows, length, now = state[go], doc[go], w[go], lows[go], length[go], now[go]
        drawn += step
        step = min(step * 2, 256)


def bands(sig: np.ndarray, n: int = BANDS) -> np.ndarray:
    """(documents, n) signed 64-bit bucket keys; the band's number is part of the key."""
    rows = sig.shape[1] // n
    x = np.broadcast_to(np.arange(1, n + 1, dtype=_U) * _C2, (len(sig), n)).copy()
    for k in range(rows):
        x = mix(x * _GOLD + sig[:, k::rows][:, :n])
    return x.view(np.int64)
