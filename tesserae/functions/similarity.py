"""Edit similarity, tiers and containment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Tiers by edit similarity, and the fallback's thresholds.
COPY, NEAR, SUSPECT = 0.80, 0.65, 0.55
CONTAIN_RECALL, CONTAIN_STRONG = 0.35, 0.75
COSINE_RECALL, COSINE_STRONG = 0.55, 0.72
TOP = 3
LABELS = {"copy": "复制", "near": "高度疑似", "suspect": "疑似", "semantic": "改写疑似"}
COLORS = {"copy": "#c0392b", "near": "#e67e22", "suspect": "#f1c40f", "semantic": "#2e86de"}


def longest(a: Column, b: Column) -> Column:
    return F.greatest(F.char_length(a), F.char_length(b))


def fits(a: Column, b: Column) -> Column:
    """Whether the lengths alone leave a tier possible."""
    return 20 * F.abs(F.char_length(a) - F.char_length(b)) < 9 * longest(a, b)


def similarity(d: Column, m: Column) -> Column:
    return F.when(m == 0, F.lit(0.0)).otherwise(1 - d / m)


def tier(d: Column, m: Column) -> Column:
    """The tier of a pair by integers, exact at the borders; null for none."""
    return F.when((5 * d <= m) & (m > 0), "copy").when((20 * d <= 7 * m) & (m > 0), "near").when((20 * d <= 9 * m) & (d < m) & (m > 0), "suspect")


def label(t: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), t)


def color(t: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in COLORS.items() for x in kv)), t)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set of bigrams that the other has."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def heat_color(ratio: Column) -> Column:
    return F.when(ratio >= 0.4, "#c0392b").when(ratio >= 0.2, "#e67e22").when(ratio > 0, "#f1c40f").otherwise("#2ecc71")


def level(ratio: Column) -> Column:
    return F.when(ratio * 100 >= 30, "高").when(ratio * 100 >= 15, "中").otherwise("低")


def _cut_off(a: str, b: str) -> int:
    """Edit distance that ends at the longer length once a row of the table has no value below 0.45 of it."""
    m = max(len(a), len(b))
    if a == b:
        return 0
    if abs(len(a) - len(b)) / max(m, 1) >= 1 - SUSPECT:
        return m
    chars, steps = np.array([ord(c) for c in b], np.int64), np.arange(len(b) + 1)
    row = steps.copy()
    for i, c in enumerate(map(ord, a), 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (chars != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps  # insertions
        if row.min() / m >= 1 - SUSPECT:
            return m
    return int(row[-1])


_U = np.uint64
#: Words of 64 bits that the masks of pairs worked on together have at most, and steps between looks at the limits.
_MASKS, _LOOK = 1 << 20, 32
#: Words of masks, and characters, of the pairs that few patterns form with many texts.
_TABLE, _GRID = 8 << 20, 2 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, one text after another, and the texts' lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), size


def _together(short: list[str], long: list[str], limit: np.ndarray) -> np.ndarray:
    """Edit distances of pairs whose first texts have the same number of words of 64 characters, none of them empty;
    above its limit a pair may give any larger value.

    A column of each pair's table is two bit vectors along the first text; one step takes all pairs a character of the
    second texts further. Pairs stand by the second text's length, so those that are done leave at the end.
    """
    codes, m = _codes(short)
    pair = np.repeat(np.arange(len(short)), m)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(m) - m, m)
    words = int(-(-m.max() // 64))
    keys, entry = np.unique((pair << 21) | codes, return_inverse=True)
    masks = np.zeros((len(keys) + 1, words), _U)  # the last one: a character that the first text lacks
    np.bitwise_or.at(masks, (entry, place >> 6), _U(1) << (place & 63).astype(_U))
    other, n = _codes(long)
    row = np.repeat(np.arange(len(long)), n)
    key = (row << 21) | other
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    at, begin = np.where(keys[at] == key, at, len(keys)), np.cumsum(n) - n
    return _columns(masks, lambda j, own: at[begin[own] + j], m, n, limit)


def _columns(masks: np.ndarray, place: Callable[[int, np.ndarray], np.ndarray], m: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The distances of pairs by the masks of their first texts' characters: place(j, pairs) gives the rows of masks for
    the characters j of the pairs' second texts, m and n are the texts' lengths. Above its limit a pair may give any larger
    value.

    A path within the limit stays in a band about the diagonal, so a step takes only the words that the band of some pair
    meets: above it a column's values count as one more each, below it as one more for each row. Every ``_LOOK`` steps
    pairs whose column lets no path stay within the limit leave."""
    words = masks.shape[1]
    order = np.argsort(-n, kind="stable")
    masks_of = [np.ascontiguousarray(masks[:, w]) for w in range(words)]
    m, n, limit = m[order], n[order], limit[order]
    wide = np.maximum(limit, np.abs(m - n))
    low, high = int(((m - n - wide) // 2).min()), int(((m - n + wide + 1) // 2).max())  # row less column
    last = ((m - 1) & 63).astype(_U)
    up, down = np.full((words, len(n)), ~_U(0)), np.zeros((words, len(n)), _U)
    score, top = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)  # below the lowest word, above the first
    out, where, one = np.zeros(len(n), np.int64), order, _U(1)
    space = np.empty((9, len(n)), _U)
    soon, first, end = max(0, int((limit - np.abs(m - n)).min())), 0, 0
    for j in range(int(n[0])):
        live = len(n)
        while live and n[live - 1] <= j:  # texts that end here
            live -= 1
        if live < len(n):
            out[where[live:]] = score[live:]
            n, m, limit, score, top, last, where = (x[:live] for x in (n, m, limit, score, top, last, where))
            up, down = up[:, :live], down[:, :live]
        if j % _LOOK == 0 and j > soon and live:
            keep = np.flatnonzero(_least(up[first:end], down[first:end], top + j, 64 * first, m, n - j) <= limit)
            if 8 * len(keep) <= 7 * live:
                out[where] = np.iinfo(np.int32).max
                n, m, limit, score, top, last, where = (x[keep] for x in (n, m, limit, score, top, last, where))
                up, down = np.take(up, keep, axis=1), np.take(down, keep, axis=1)
        if not len(n):
            return out
        while end < min(words, (j + high) // 64 + 1):
            score = score + np.minimum(64, m - 64 * end)
            end += 1
        while first < min(end - 1, (j + low) // 64):
            top = top + np.bitwise_count(up[first]).astype(np.int64) - np.bitwise_count(down[first])
            first += 1
        at = place(j, where)
        eq, xv, xh, ph, mh, plus, minus, out_plus, out_minus = space[:, : len(n)]
        plus.fill(1)  # what comes in from the word above
        minus.fill(0)
        for w in range(first, end):
            pv, mv = up[w], down[w]
            np.take(masks_of[w], at, out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=xv)
            eq |= minus
            np.bitwise_and(eq, pv, out=xh)
            xh += pv
            xh ^= pv
            xh |= eq
            np.bitwise_or(xh, pv, out=ph)
            np.invert(ph, out=ph)
            ph |= mv
            np.bitwise_and(pv, xh, out=mh)
            bit = last if w == words - 1 else _U(63)
            np.right_shift(ph, bit, out=out_plus)
            np.right_shift(mh, bit, out=out_minus)
            out_plus &= one
            out_minus &= one
            ph <<= one
            ph |= plus
            mh <<= one
            mh |= minus
            np.bitwise_and(ph, xv, out=mv)
            xv |= ph
            np.invert(xv, out=xv)
            np.bitwise_or(mh, xv, out=pv)
            plus, out_plus, minus, out_minus = out_plus, plus, out_minus, minus
        score = score + plus.view(np.int64) - minus.view(np.int64)
    out[where] = score
    return out


def _least(up: np.ndarray, down: np.ndarray, top: np.ndarray, row: int, m: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What paths through a column of the table come to at least: the column's values, and what is left of both texts.
    up and down are the words below ``row``, whose value is ``top``; rest is what is left of the second texts. Every
    eighth value is looked at: from one row to the next the sum changes by two at most."""
    up, down = np.ascontiguousarray(up).view(np.uint8), np.ascontiguousarray(down).view(np.uint8)
    steps = np.bitwise_count(up).astype(np.int16) - np.bitwise_count(down)
    steps = steps.reshape(len(up), len(m), 8).transpose(1, 0, 2).reshape(len(m), -1)
    best = top + np.abs(m - row - rest)  # of the row above the words
    best = np.where(m < row + 8, best - 6, best)
    value = np.cumsum(steps, axis=1, dtype=np.int32) + top[:, None]
    rows = row + 8 * np.arange(1, steps.shape[1] + 1)
    value += np.abs((m - rest)[:, None] - rows).astype(np.int32)
    value[rows + 8 > m[:, None]] -= 6  # up to seven rows follow the last
    value[rows > m[:, None]] = np.iinfo(np.int32).max
    return np.minimum(best, value.min(axis=1)) - 8


def _one_by_one(a: str, b: str, limit: int) -> int:
    """The same of one pair: a column of the table is two integers of len(a) bits. For few pairs of long texts, where a
    step of :func:`_together` would cost a call for each word."""
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    if not b:
        return n
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, d, rest = mask, 0, n, len(b)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        right = down | ~(d0 | up) & mask
        left = up & d0
        if right & top:
            d += 1
        elif left & top:
            d -= 1
        rest -= 1
        if d - rest > limit:
            return d
        right = (right << 1 | 1) & mask
        left = left << 1 & mask
        up = left | ~(d0 | right) & mask
        down = right & d0
    return d


def bit_distances(a: list[str], b: list[str], limit: np.ndarray) -> np.ndarray:
    """Edit distances of many pairs by bit vectors, in groups of as many words; above its ``limit`` a pair may give any
    larger value."""
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    size = np.fromiter(map(len, short), np.int64, len(short))
    out = np.fromiter(map(len, long), np.int64, len(long))  # of pairs with an empty text
    words = -(-size // 64)
    order = np.argsort(words, kind="stable")
    order = order[words[order] > 0]
    at = 0
    while at < len(order):
        w = words[order[at]]
        same = int(np.searchsorted(words[order], w, side="right"))
        cost = np.cumsum(np.maximum(size[order[at:same]] * w, out[order[at:same]]))
        own = order[at : at + max(1, int(np.searchsorted(cost, _MASKS)))]
        if len(own) * (15 + w) >= 180 * w:
            out[own] = _together([short[i] for i in own], [long[i] for i in own], limit[own])
        else:
            out[own] = [_one_by_one(long[i], short[i], int(limit[i])) for i in own]
        at += len(own)
    return out


#: Columns that :func:`_beyond` takes between looks, pairs it works on together, and fewer pairs than it is worth.
_STEP, _LANES, _FEW = 16, 16384, 2048


def _windows(patterns: list[np.ndarray], width: int, before: int, after: int) -> np.ndarray:
    """Where the characters (numbers below ``width``) stand in each pattern: by pattern, place in steps of eight from
    -8 * before to 8 * after, and character, the 64 places from there on as bits."""
    seen = np.zeros((len(patterns), width, before + after + 9), np.uint8)
    for x, own in zip(seen, patterns, strict=True):
        place = np.arange(len(own))
        fine = own < width
        np.bitwise_or.at(x, (own[fine], before + (place[fine] >> 3)), np.uint8(1) << (place[fine] & 7).astype(np.uint8))
    seen = seen.transpose(0, 2, 1)
    out = np.zeros((len(patterns), before + after + 1, width), _U)
    for b in range(8):
        out |= seen[:, b : b + out.shape[1]].astype(_U) << _U(8 * b)
    return out


def _beyond(patterns: list[np.ndarray], p: np.ndarray, codes: np.ndarray, width: int, begin: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Of pairs (patterns[p], the n characters of codes from begin) those that surely differ by more than their limit; the
    others may. Characters are numbers up to ``width``, which is one that no pattern has.

    A path within the limit k stays on diagonals (row less column) between (m - n - k) / 2 and (m - n + k) / 2. Each pair has
    a window of words of its own about these, which moves down with the columns; what is beside it counts as one more each, so
    values are never too small, and those of paths within the limit are right. After every ``_STEP`` columns a pair
    leaves if no value lets a path stay within the limit; as the values grow, fewer diagonals are left, and where one word
    less holds them, the pair goes on with that."""
    out = np.zeros(len(p), bool)
    m = np.fromiter(map(len, patterns), np.int64, len(patterns))[p]
    low = (m - n - limit) // 2
    words = (limit + 8 + _STEP + 63) // 64
    before, after = int(max(0, (-low).max())) // 8 + 1, int(m.max() + 64 * words.max()) // 8 + _STEP
    table, steps = _windows(patterns, width + 1, before, after).reshape(-1), before + after + 1
    lanes = np.arange(len(p))
    # every run of _STEP characters as one item
    small = np.uint8 if width < 256 else np.int32
    held = np.append(codes.astype(small), np.zeros(_STEP, small))
    runs = np.ndarray(len(codes) + 1, np.dtype((np.void, _STEP * held.itemsize)), held, strides=(held.itemsize,))
    start = np.floor_divide(low, 8)  # the window's first row, in steps of eight
    ones, moved = ~_U(0), _U((1 << _STEP) - 1)
    kind = np.int16 if 4 * (int(m.max()) + int(n.max()) + 64 * int(words.max())) < 1 << 15 else np.int32
    far = np.iinfo(kind).max // 2
    soon = limit - np.abs(m - n)  # before this column no value is large
    # rows up to 0 have no steps, those from 1 on a step each
    at: dict[int, list[tuple]] = {}
    for w in np.unique(words).tolist():
        own = lanes[words == w]
        row = 8 * start[own] + 64 * np.arange(w)[:, None]
        some = np.clip(-row, 0, 63).astype(_U)
        up = np.where(row >= 0, ones, np.where(row <= -64, _U(0), ones << some))
        at.setdefault(w, []).append((own, start[own], np.zeros(len(own), np.int64), np.maximum(0, 8 * start[own]), up, np.zeros_like(up)))
    def run(w: int, state: list[np.ndarray], least: int) -> list[tuple]:
        """Takes pairs with windows of w words on until they are less than ``least``, which it gives back. Others leave: beyond
        their limit (noted in out), at their text's end, or with a word less (noted in at)."""
        own, start, j, top, up, down = state
        up, down, since = up.copy(order="C"), down.copy(order="C"), 0
        one, last_bit, wide = _U(1), _U(63), width + 1
        place, sampled = np.empty((_STEP, len(own)), np.int64), 8 * np.arange(8 * w + 1, dtype=kind)[:, None]
        tables = [table[8 * i * wide :] for i in range(w)]
        while True:
            keep = np.flatnonzero(j + _STEP <= n[own])
            if len(keep) < len(own):
                own, start, j, top, up, down = own[keep], start[keep], j[keep], top[keep], np.take(up, keep, axis=1), np.take(down, keep, axis=1)
            if len(own) < least:
                return [(own, start, j, top, up, down)] if len(own) else []
            np.add(((p[own] * steps + before + start) * wide), runs[begin[own] + j].view(small).reshape(len(own), _STEP).T, out=place[:, : len(own)])
            eq, rows, below, both, fall, cut, minus = np.empty((7, len(own)), _U)
            for c in range(_STEP):
                for i in range(w):
                    pv, mv = up[i], down[i]
                    np.take(tables[i], place[c, : len(own)], out=eq, mode="clip")
                    if i:  # what comes in from the word above: below's and fall's last bits
                        eq |= minus
                    np.bitwise_and(eq, pv, out=rows)
                    rows += pv
                    rows ^= pv
                    rows |= eq
                    rows |= mv  # no step on the diagonal
                    np.bitwise_or(rows, pv, out=both)
                    both ^= mv  # no step up along the row: mv is within rows
                    if i:
                        np.right_shift(below, last_bit, out=cut)
                    if i < w - 1:
                        below, both = both, below
                        np.left_shift(below, one, out=both)
                    else:
                        both <<= one
                    if i:
                        both |= cut
                    np.bitwise_and(rows, pv, out=fall)
                    np.left_shift(fall, one, out=pv)
                    if i:
                        pv |= minus
                    if i < w - 1:
                        np.right_shift(fall, last_bit, out=minus)
                    np.bitwise_and(rows, both, out=eq)
                    np.bitwise_xor(rows, eq, out=mv)
                    both ^= eq
                    pv |= both
            j, top, since = j + _STEP, top + _STEP, since + 1
            if since % 2 if w > 1 else not (j > soon[own]).any():
                leaves = None
            else:
                # row less column, and what the rest of both texts differs by at least; a row is at most four from one looked at
                change = np.bitwise_count(up.view(np.uint8)).view(np.int8) - np.bitwise_count(down.view(np.uint8)).view(np.int8)
                value = np.zeros((8 * w + 1, len(own)), kind)
                value[0] = top
                value[1:] = change.reshape(w, len(own), 8).transpose(0, 2, 1).reshape(8 * w, len(own))
                np.cumsum(value, axis=0, out=value)
                diagonal = (8 * start - j).astype(kind) + sampled
                last = (m - n)[own].astype(kind)
                rest = (limit[own] + 8).astype(kind) - value
                rest -= np.abs(last - diagonal)
                beyond = rest.max(axis=0) < 0
                out[own[beyond]] = True
                leaves = beyond
                if w > 1:  # the diagonals that paths may still take
                    dead = rest < 0
                    rest >>= 1
                    lo, hi = np.minimum(diagonal, last) - rest, np.maximum(diagonal, last) + rest
                    lo[dead], hi[dead] = far, -far
                    lo, hi = lo.min(axis=0).astype(np.int64) - 4, hi.max(axis=0).astype(np.int64) + 4
                    g = np.flatnonzero(~beyond & (hi - lo + 8 + _STEP < 64 * (w - 1)))
                    if len(g):
                        begins = np.maximum(start[g], np.floor_divide(lo[g] + j[g], 8))  # never above the window
                        drop = begins - start[g]
                        taken = drop[:, None] + np.arange(8 * (w - 1))
                        less = []
                        for x, bits in ((up, 255), (down, 0)):
                            held = np.full((len(g), 16 * (w + 1)), bits, np.uint8)
                            held[:, : 8 * w] = np.ascontiguousarray(x[:, g].T).view(np.uint8)
                            less.append(np.take_along_axis(held, taken, axis=1).view(_U).T)
                        at.setdefault(w - 1, []).append((own[g], begins, j[g], value[drop, g].astype(np.int64), *less))
                        leaves = beyond.copy()
                        leaves[g] = True
            if leaves is not None and leaves.any():
                k = np.flatnonzero(~leaves)
                own, start, j, top, up, down = own[k], start[k], j[k], top[k], np.take(up, k, axis=1), np.take(down, k, axis=1)
            # the windows move down
            top = top + np.bitwise_count(up[0] & moved).astype(np.int64) - np.bitwise_count(down[0] & moved)
            start = start + _STEP // 8
            for x, bits in ((up, ~(ones >> _U(_STEP))), (down, _U(0))):
                for i in range(w):
                    x[i] >>= _U(_STEP)
                    x[i] |= x[i + 1] << _U(64 - _STEP) if i < w - 1 else bits

    for w in range(int(words.max()), 0, -1):
        parts = at.pop(w, [])
        if not parts:
            continue
        while parts:  # those that a part's end leaves go on together
            queue = [np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)]
            least = max(1, _LANES // 8) if len(queue[0]) > _LANES else 1
            parts = []
            for a in range(0, len(queue[0]), _LANES):
                parts += run(w, [x[..., a : a + _LANES] for x in queue], least)
    return out


def _surely_beyond(own: np.ndarray, m: np.ndarray, p: np.ndarray, codes: np.ndarray, width: int, begin: np.ndarray, n: np.ndarray, limit: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """:func:`_beyond` of pairs by the patterns' characters (own, m of each), for as many patterns at once as a table of bounded
    size holds; few pairs are not looked at."""
    out = np.zeros(len(p), bool)
    ends = np.cumsum(m)
    place = np.searchsorted(alphabet, own)
    order = np.lexsort((n, p))
    which, first = np.unique(p[order], return_index=True)
    bounds = np.append(first, len(p))
    size = np.cumsum((m[which] + 2 * limit.max(initial=0) + 512) // 8 * (width + 1))  # words of a pattern's table, about
    at = 0
    while at < len(which):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _TABLE // 2)))
        some = order[bounds[at] : bounds[to]]
        if len(some) >= _FEW:
            some = some[np.lexsort((n[some], limit[some] // 64))]
            own_of = [place[ends[i] - m[i] : ends[i]] for i in which[at:to].tolist()]
            out[some] = _beyond(own_of, np.searchsorted(which[at:to], p[some]), codes, width, begin[some], n[some], limit[some])
        at = to
    return out


def tier_distances_to(patterns: list[str], texts: list[str], p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """:func:`tier_distances` of the pairs (patterns[p], texts[t]) where few patterns meet many texts: a pattern's masks
    are made once, and a text's characters are looked up once."""
    own, m = _codes(patterns)
    codes, n = _codes(texts)
    longer = np.maximum(m[p], n[t])
    out = np.where(longer > 0, longer, 0)
    near = np.flatnonzero((20 * np.abs(m[p] - n[t]) < 9 * longer) & (longer > 0))
    if not len(near):
        return out
    d, limit = longer.copy(), 9 * longer // 20
    alphabet = np.unique(own)
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    at = np.where(alphabet[at] == codes, at, len(alphabet)) if len(alphabet) else at
    begin, width = np.cumsum(n) - n, len(alphabet) + 1
    near = near[~_surely_beyond(own, m, p[near], at, len(alphabet), begin[t[near]], n[t[near]], limit[near], alphabet)]
    if not len(near):
        return out
    words = -(-m // 64)
    near = near[np.lexsort((n[t[near]], words[p[near]]))]
    ends = np.append(np.flatnonzero(np.diff(words[p[near]])) + 1, len(near))
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        pairs, w = near[a:b], int(words[p[near[a]]])
        which = np.unique(p[pairs])
        if w == 0 or len(which) * width * w > _TABLE or len(pairs) * (15 + w) < 180 * w:
            d[pairs] = bit_distances([patterns[i] for i in p[pairs]], [texts[i] for i in t[pairs]], limit[pairs])
            continue
        masks = np.zeros((len(which) * width, w), _U)
        for i, x in enumerate(which.tolist()):
            place = np.arange(m[x])
            mine = np.searchsorted(alphabet, own[int(m[:x].sum()) + place])
            np.bitwise_or.at(masks, (i * width + mine, place >> 6), _U(1) << (place & 63).astype(_U))
        row = np.searchsorted(which, p) * width
        size = np.cumsum(n[t[pairs]])
        while len(pairs):
            count = max(1, int(np.searchsorted(size, _GRID)))
            some, pairs = pairs[:count], pairs[count:]
            size = size[count:] - size[count - 1]
            begins, rows = begin[t[some]], row[some]
            d[some] = _columns(masks, lambda j, own, b=begins, r=rows: at[b[own] + j] + r[own], m[p[some]], n[t[some]], limit[some])
    out[near] = np.where(20 * d[near] < 9 * longer[near], d[near], longer[near])
    for i in near[20 * d[near] == 9 * longer[near]].tolist():
        out[i] = _cut_off(patterns[p[i]], texts[t[i]])
    return out


def tier_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Of each pair the edit distance d, or the longer length m where 20 d > 9 m; on the border the row-wise cut-off
    decides."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    m = np.maximum(la, lb)
    out = m.copy()
    near = np.flatnonzero(20 * np.abs(la - lb) < 9 * m)
    if len(near):
        d = bit_distances([a[i] for i in near], [b[i] for i in near], 9 * m[near] // 20)
        out[near] = np.where(20 * d < 9 * m[near], d, m[near])
        for i in near[20 * d == 9 * m[near]].tolist():
            out[i] = _cut_off(a[i], b[i])
    out[m == 0] = 0
    return out


@F.pandas_udf(IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`tier_distances` of a batch of pairs. Sentences may be lines of thousands of characters, where the engine's
    own function, which works cell by cell, takes far longer."""
    return pd.Series(tier_distances(a.tolist(), b.tolist()), dtype="int32")


@F.pandas_udf(IntegerType())
def cut_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """The distance with its row-wise cut-off, where a value beyond the border shows; null for null."""
    return pd.Series([None if x is None or y is None else _cut_off(x, y) for x, y in zip(a, b)], dtype="Int32")
