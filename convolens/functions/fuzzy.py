"""Fuzzy containment: how well the shorter of two strings fits somewhere in the longer one.

The score is the best normalised insert/delete similarity (0-100) of the shorter string against
any window of the longer one of the same length, windows cut off by either end included.

Where only scores from a floor on matter, most windows are never scored. Of the m - 1 letter pairs of a
string, an unmatched letter of it breaks two at most, and an unmatched letter of the window one. So a window
that reaches the floor holds a known number of the string's pairs. Strings of which the whole text has too few go
first; for the others a running sum over the text finds the windows that hold enough, for many rows at once.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType

_WORD_BITS = 64
_CELLS = 4_000_000
_FLAT_WINDOWS = 100_000
_PAD = np.uint32(0xFFFFFFFF)


def contained(a: Column, b: Column) -> Column:
    """True when the shorter string occurs in the longer one, i.e. the score is exactly 100."""
    return (
        (F.char_length(a) > 0)
        & (F.char_length(b) > 0)
        & (F.contains(b, a) | F.contains(a, b))
    )


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _letters_at(needles: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For every needle and place of the text: the needle's positions of that letter, as bits."""
    k, m = needles.shape
    letters = np.unique(needles)
    masks = np.zeros((k, len(letters) + 1), dtype=np.uint64)
    for at in range(m):
        masks[np.arange(k), np.searchsorted(letters, needles[:, at])] |= np.uint64(1) << np.uint64(at)
    slot = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
    slot[letters[slot] != text] = len(letters)
    return masks[:, slot]


def _common_lengths(needles: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each needle (row) with each window of its length in ``text``.

    The bit-parallel recurrence runs over all windows of all needles at once. Needles beyond one
    machine word use the table recurrence, also over all windows at once.
    """
    k, m = needles.shape
    n = len(text) - m + 1
    if m > _WORD_BITS:
        return np.stack([_long_common_lengths(needle, text, n) for needle in needles])
    at_char = _letters_at(needles, text)
    state = np.full((k, n), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(m):
        hit = state & at_char[:, at:at + n]
        state = (state + hit) | (state - hit)
    used = np.uint64((1 << m) - 1)
    return m - np.bitwise_count(state & used).astype(np.int64)


@lru_cache(maxsize=4096)
def pairs_needed(m: int, floor: float) -> np.ndarray:
    """By window length up to ``m``: letter pairs a window must share to reach the floor; m if it cannot."""
    needed = np.full(m + 1, m)
    for w in range(1, m + 1):
        common = math.ceil(floor * (m + w) / 200)
        while common > 0 and 200.0 * (common - 1) / (m + w) >= floor:
            common -= 1
        if common <= w:
            needed[w] = max(0, m - 1 - 2 * (m - common) - (w - common))
    return needed


@lru_cache(maxsize=64)
def _needs(floor: float) -> np.ndarray:
    """``pairs_needed`` of every length of a string and of a window up to one machine word."""
    table = np.full((_WORD_BITS + 1, _WORD_BITS + 1), _WORD_BITS)
    for m in range(2, _WORD_BITS + 1):
        table[m, :m + 1] = pairs_needed(m, floor)
    return table


@lru_cache(maxsize=4096)
def _needs(m: int, floor: float) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Pairs that a whole window needs, and (width, pairs) of the cut ones that can reach the floor."""
    needed = pairs_needed(m, floor).tolist()
    return needed[m], tuple((w, needed[w]) for w in range(1, m) if needed[w] < m)


def _where(text: str) -> dict[str, list[int]]:
    """The places of every letter pair of a text."""
    places: dict[str, list[int]] = {}
    for i, pair in enumerate(_pairs(text)):
        if pair in places:
            places[pair].append(i)
        else:
            places[pair] = [i]
    return places


def _candidates(parts: list[str], n: int, where: dict[str, list[int]], floor: float) -> list[tuple[int, int]]:
    """Windows of a text of n letters that may reach the floor: begin (below 0 if cut), width.

    A window holds ``need`` pairs of the string if that many places in a row of those that have one lie within it.
    """
    m = len(parts) + 1
    places = sorted(chain.from_iterable(where[pair] for pair in set(parts) if pair in where))
    need, cut = _needs(m, floor)
    if need <= 0:
        found = list(range(n - m + 1))
    else:
        found, after = [], 0
        near = [(first, last) for first, last in zip(places, places[need - 1:]) if last - first <= m - 2]
        for first, last in near:
            low = max(after, last - m + 2)
            found += range(low, min(first, n - m) + 1)
            after = max(after, first + 1)
    out = [(begin, m) for begin in found]
    for width, least in cut:
        if bisect_left(places, width - 1) >= least:
            out.append((width - m, width))
        if len(places) - bisect_left(places, n - width) >= least:
            out.append((n - width, width))
    return out


def window_scores(jobs: list[tuple[str, str, list[tuple[int, int]]]], floor: float) -> np.ndarray:
    """Best score over the given windows of each (shorter string of up to 64 letters, longer text)."""
    best = np.zeros(len(jobs))
    place = {short: i for i, short in enumerate(dict.fromkeys(short for short, _, windows in jobs if windows))}
    texts = list(dict.fromkeys(long for _, long, windows in jobs if windows))
    text = {long: i for i, long in enumerate(texts)}
    rows = [(at, place[short], text[long], len(short), begin, width)
            for at, (short, long, windows) in enumerate(jobs) for begin, width in windows]
    if not rows:
        return best
    owner, needle, source, sizes, begins, widths = np.array(rows).T
    order = np.argsort(-sizes, kind="stable")
    owner, needle, source, sizes, begins, widths = (x[order] for x in (owner, needle, source, sizes, begins, widths))
    known, coded = np.unique(_codes("".join(place)), return_inverse=True)
    masks = np.zeros((len(place), len(known) + 1), dtype=np.uint64)
    at = 0
    for row, short in enumerate(place):
        for bit in range(len(short)):
            masks[row, coded[at + bit]] |= np.uint64(1) << np.uint64(bit)
        at += len(short)
    lengths = np.array([len(long) for long in texts])
    letters = _codes("".join(texts))
    slot = np.minimum(np.searchsorted(known, letters), len(known) - 1)
    slot[known[slot] != letters] = len(known)
    first = (np.cumsum(lengths) - lengths)[source]
    end = lengths[source]
    state = np.full(len(owner), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(sizes[0]):
        live = np.searchsorted(-sizes, -at, side="left")
        spot = begins[:live] + at
        there = (spot >= 0) & (spot < end[:live])
        letter = np.where(there, slot[np.where(there, first[:live] + spot, 0)], len(known))
        now = state[:live]
        hit = now & masks[needle[:live], letter]
        state[:live] = (now + hit) | (now - hit)
    used = np.uint64(np.iinfo(np.uint64).max) >> (np.uint64(64) - sizes.astype(np.uint64))
    common = sizes - np.bitwise_count(state & used).astype(np.int64)
    np.maximum.at(best, owner, 200.0 * common / (sizes + widths))
    return best


def _long_common_lengths(needle: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    m = len(needle)
    best = np.zeros((m + 1, n), dtype=np.int32)
    for at in range(m):
        row, diagonal = text[at:at + n], best[0].copy()
        for i in range(1, m + 1):
            above = best[i].copy()
            best[i] = np.where(needle[i - 1] == row, diagonal + 1, np.maximum(above, best[i - 1]))
            diagonal = above
    return best[m].astype(np.int64)


def _scan(needles: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Best window score of any needle in each text; all needles have one length, no text is shorter.

    The texts lie in one array, with gaps so wide that no window touches two of them.
    """
    m = needles.shape[1]
    gap = np.full(m - 1, _PAD)
    padded = np.concatenate([part for codes in texts for part in (gap, codes)] + [gap])
    ends = np.cumsum([m - 1 + len(codes) for codes in texts])
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.concatenate(([0], np.cumsum(padded != _PAD)))
    lengths = inside[m:] - inside[:-m]
    best = np.zeros(len(texts))
    step = max(1, _CELLS // len(padded))
    for at in range(0, len(needles), step):
        common = _common_lengths(needles[at:at + step], padded).max(axis=0)
        best = np.maximum(best, np.maximum.reduceat(200.0 * common / (m + lengths), starts))
    return best


def _by_length(needles: list[str]) -> dict[int, np.ndarray]:
    groups: dict[int, list[np.ndarray]] = {}
    for needle in needles:
        codes = _codes(needle)
        groups.setdefault(len(codes), []).append(codes)
    return {m: np.stack(group) for m, group in groups.items()}


def best_scores(needles: list[str], texts: list[str]) -> np.ndarray:
    """For every text, the best score of any needle."""
    best = np.zeros(len(texts))
    codes = [_codes(text) for text in texts]
    for m, same in _by_length([needle for needle in dict.fromkeys(needles) if needle]).items():
        fitting = [i for i, text in enumerate(codes) if len(text) >= m]
        if fitting:
            best[fitting] = np.maximum(best[fitting], _scan(same, [codes[i] for i in fitting]))
        for i, text in enumerate(codes):
            if 0 < len(text) <= m:
                best[i] = max(best[i], *(_scan(text[None, :], [needle])[0] for needle in same))
    return best


def _pairs(text: str) -> list[str]:
    return list(map(str.__add__, text, text[1:]))


@lru_cache(maxsize=4096)
def _least_pairs(m: int, floor: float) -> int:
    return int(pairs_needed(m, floor)[1:].min())


def _may_reach(short: list[str], long: dict[str, list[int]], floor: float) -> bool:
    """Whether a text with these letter pairs can hold a window that reaches the floor."""
    return sum(map(long.__contains__, short)) >= _least_pairs(len(short) + 1, floor)


def scores_from(rows: Iterable[tuple[list[str], list[str]]], floor: float) -> Iterator[np.ndarray]:
    """``best_scores`` of many rows of needles and texts; one below the floor may come out lower."""
    held: list[np.ndarray] = []
    jobs: list[tuple[str, str, list[tuple[int, int]]]] = []
    owners: list[tuple[int, int]] = []
    windows = 0

    def settle():
        for (row, text), score in zip(owners, window_scores(jobs, floor).tolist()):
            held[row][text] = max(held[row][text], score)
        return held

    for needles, texts in rows:
        best = np.zeros(len(texts))
        own = [(needle, _pairs(needle)) for needle in dict.fromkeys(needles) if needle]
        for i, text in enumerate(texts):
            there = _where(text)
            for needle, parts in own if text else ():
                if min(len(needle), len(text)) == 1 or min(len(needle), len(text)) > _WORD_BITS:
                    best[i] = max(best[i], best_scores([needle], [text])[0])
                    continue
                ways = []
                if len(needle) <= len(text) and _may_reach(parts, there, floor):
                    ways.append((needle, text, _candidates(parts, len(text), there, floor)))
                if len(text) <= len(needle):
                    ways.append((text, needle, _candidates(_pairs(text), len(needle), _where(needle), floor)))
                for job in ways:
                    if job[2]:
                        jobs.append(job)
                        owners.append((len(held), i))
                        windows += len(job[2])
        held.append(best)
        if windows >= _FLAT_WINDOWS:
            yield from settle()
            held, jobs, owners, windows = [], [], [], 0
    yield from settle()


@F.pandas_udf(DoubleType())
def partial_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Score of two string columns."""
    for left, right in batches:
        yield pd.Series(
            [0.0 if not a or not b else float(best_scores([a], [b])[0]) for a, b in zip(left, right)],
            dtype="float64",
        )


def keyword_scores(needles: Column, texts: Column, floor: float = 0.0) -> Column:
    """Best score over all keywords for each text: (array<string>, array<string>) -> array<double>.

    Scores below the floor may come out lower, and cost far less.
    """
    @F.pandas_udf(ArrayType(DoubleType()))
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, lines in batches:
            rows = ((list(n), list(t)) for n, t in zip(words, lines))
            found = scores_from(rows, floor) if floor > 0 else (best_scores(n, t) for n, t in rows)
            yield pd.Series([scores.tolist() for scores in found])

    return scores(needles, texts)
