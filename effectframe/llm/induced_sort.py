"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are larger (L) or smaller (S) than their successor; an S suffix after an L
one is leftmost-smaller (LMS). Sorting the LMS suffixes sorts all others: one pass
over the buckets of first symbols places the L suffixes, one pass back the S
suffixes. The same two passes sort the LMS substrings, whose names make the reduced
string of the recursion. Buckets are handled in spans: as long as no bucket of a span
sends anything into the span, all its entries send their predecessors to the fronts
(or ends) of other buckets in one stable step, and only runs of one symbol need more
steps. So the many rare names of a reduced string cost few steps, and the recursion
is the same at every size.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one counts as S."""
    n = len(text)
    place = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    # For each position the end of its run of one symbol, which decides.
    end = np.minimum.accumulate(place[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = (end == n - 1) | (text[end] < text[np.minimum(end + 1, n - 1)])
    return small


def _put(order: np.ndarray, fill: np.ndarray, items: np.ndarray, symbol: np.ndarray, step: int) -> None:
    """``items`` go to the next free places of their buckets, in this order."""
    by = np.argsort(symbol, kind="stable")
    items, symbol = items[by], symbol[by]
    cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    first = np.zeros(len(cut) + 1, np.int64)
    first[1:] = cut
    count = np.full(len(first), len(symbol))
    count[:-1] = cut
    count -= first
    heads = symbol[first]
    order[np.repeat(fill[heads] - step * first, count) + step * np.arange(len(symbol))] = items
    fill[heads] += step * count


def _push(order: np.ndarray, fill: np.ndarray, came: np.ndarray, text: np.ndarray, wanted: np.ndarray, step: int) -> None:
    """Predecessors of ``came`` for which ``wanted`` is true go to other buckets, in this order."""
    before = came[came > 0] - 1
    before = before[wanted[before]]
    if len(before):
        _put(order, fill, before, text[before], step)


def _run(order: np.ndarray, fill: np.ndarray, came: np.ndarray, text: np.ndarray, lead: np.ndarray, step: int) -> None:
    """What stands before ``came`` in runs of one symbol follows it: all first ones, all second ones and so on."""
    came = came[lead[came] > 0]
    if not len(came):
        return
    count = lead[came]
    back = np.arange(1, count.sum() + 1) - np.repeat(np.cumsum(count) - count, count)
    by = np.argsort(back, kind="stable")
    items = (np.repeat(came, count) - back)[by].astype(np.int32)
    _put(order, fill, items, text[items], step)


def _spans(used: np.ndarray, reach: np.ndarray) -> list[tuple[int, int]]:
    """Ascending symbols cut into spans ``(first, last)`` which send nothing into themselves.

    ``reach`` is the least other symbol each one sends to.
    """
    spans, first, last, least = [], -1, -1, 0
    for symbol, to in zip(used.tolist(), reach[used].tolist(), strict=True):
        if least > symbol:
            last = symbol
            if to < least:
                least = to
            continue
        if first >= 0:
            spans.append((first, last))
        first, last, least = symbol, symbol, to
    spans.append((first, last))
    return spans


def _reach(symbol: np.ndarray, to: np.ndarray, symbols: int) -> np.ndarray:
    """The least ``to`` of each symbol; ``symbols`` where it has none."""
    least = np.full(symbols, symbols, np.int64)
    np.minimum.at(least, symbol.astype(np.int64), to.astype(np.int64))
    return least


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that follows from ``lms``, which is sorted at least by first symbol."""
    n = len(text)
    order = np.full(n, -1, np.int32)
    counts = np.bincount(text, minlength=symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    bounds = np.searchsorted(text[lms], np.arange(symbols + 1))
    used = np.flatnonzero(counts)
    fresh = np.r_[True, text[1:] != text[:-1]]  # starts of runs
    places = np.arange(n, dtype=np.int32)
    lead = places - np.maximum.accumulate(np.where(fresh, places, 0))
    parted = np.append(fresh[1:], False)  # the next symbol is another one
    large, little = ~small & parted, small & parted
    # The LMS suffixes wait at the ends of their buckets until the second pass.
    order[ends[text[lms]] - bounds[text[lms] + 1] + np.arange(len(lms))] = lms
    front = starts.copy()
    sends = np.flatnonzero(large)
    for c, d in _spans(used, _reach(text[sends + 1], text[sends], symbols)):
        came = order[starts[c] : ends[d]]
        known = came[came >= 0]
        _run(order, front, known[~small[known]], text, lead, 1)
        _push(order, front, came[came >= 0], text, large, 1)
    order[small[order]] = -1
    back = ends - 1
    order[0] = n - 1
    _push(order, back, order[:1], text, little, -1)
    # The same spans from above: symbols count downwards.
    top = symbols - 1
    sends = np.flatnonzero(little)
    for high, low in _spans(top - used[::-1], _reach(top - text[sends + 1], top - text[sends], symbols)):
        c, d = top - high, top - low
        came = order[starts[d] : ends[c]][::-1]
        known = came[came >= 0]
        _run(order, back, known[small[known]], text, lead, -1)
        _push(order, back, came, text, little, -1)
    return order


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring, along ``ordered``; equal substrings share a rank."""
    following = np.full(len(text), len(text) - 1, np.int32)
    following[lms[:-1]] = lms[1:]
    length = following[ordered] - ordered + 1
    differ = length[1:] != length[:-1]
    a, b = ordered[:-1], ordered[1:]
    open_ = np.flatnonzero(~differ)
    step = 0
    while len(open_):
        same = text[a[open_] + step] == text[b[open_] + step]
        differ[open_[~same]] = True
        step += 1
        open_ = open_[same]
        open_ = open_[length[open_] > step]
    return np.cumsum(np.r_[False, differ])


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last symbol is a 0 found nowhere else."""
    n = len(text)
    if n <= 2:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    lms = lms.astype(np.int32)
    rough = lms[np.argsort(text[lms], kind="stable")]
    induced = _induce(text, small, rough, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = induced[is_lms[induced]]
    rank = _names(text, lms, ordered)
    if rank[-1] + 1 < len(ordered):
        named = np.empty(n, np.int32)
        named[ordered] = rank
        ordered = lms[suffix_array(named[lms], int(rank[-1]) + 1)]
    return _induce(text, small, ordered, symbols)


def permuted_common_prefixes(words: np.ndarray, before: np.ndarray, limit: int) -> np.ndarray:
    """In text order: how many leading bytes position i shares with position ``before[i]``, up to ``limit``.

    ``words[i]`` packs the eight bytes from i on, the first one lowest; ``before`` is -1
    where a position has no predecessor. At least ``limit`` bytes follow each position.
    """
    common = np.zeros(len(before), np.int32)
    open_ = np.flatnonzero(before >= 0)
    at = 0
    while len(open_) and at < limit:
        here = min(at, max(limit - 8, 0))
        differ = words[open_ + here] ^ words[before[open_] + here]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.bitwise_count(lowest - np.uint64(1)) // 8)).astype(np.int32)
        common[open_] = np.minimum(here + same, limit)
        open_ = open_[differ == 0]
        at += 8
    return common
