"""String similarities as vectorised UDFs: Indel ratios, token ratios, best window, Jaro-Winkler.

The longest common subsequence is found with one machine-word-parallel recurrence (Hyyro, 2004): for a batch
of pairs on arrays of words of 64 bits, a pair a column; for a pair whose shorter side is longer, on Python's
big integers. A pair that occurs again in a batch is computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def _masks(a: str) -> dict[str, int]:
    m: dict[str, int] = {}
    for i, c in enumerate(a):
        m[c] = m.get(c, 0) | 1 << i
    return m


def _lcs(masks: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return n - v.bit_count()


def lcs(a: str, b: str) -> int:
    return _lcs(_masks(a), len(a), b)


def ratio(a: str, b: str) -> float:
    """100 times the share of characters in a longest common subsequence; 100 for two empty strings."""
    n = len(a) + len(b)
    return 100.0 if a == b else 200.0 * lcs(a, b) / n


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared tokens and the shared tokens with either rest; 0 if a side has no token."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if both else 0
    with_left, with_right = shared + gap + len(left), shared + gap + len(right)
    # Shared tokens stand in front on both sides, so only the rests can differ.
    differ = len(left) + len(right) - 2 * lcs(left, right)
    best = 100.0 * (1 - differ / (with_left + with_right))
    if both:
        best = max(best, *(100.0 * (1 - (gap + len(rest)) / (shared + side)) for rest, side in ((left, with_left), (right, with_right))))
    return best


def _best_window(short: str, long: str) -> float:
    n, masks, best = len(short), _masks(short), 0.0
    for end in range(1, len(long) + n):
        w = long[max(0, end - n) : end]
        best = max(best, 200.0 * _lcs(masks, n, w) / (n + len(w)))
        if best == 100.0:
            break
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of its length (shorter at the ends) of the longer."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(*sorted((a, b), key=len))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest per shared leading character, up to 4, from 0.7 on."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Characters of the shorter side that fit a word; words of one array, so that it stays in the cache.
WORD, WORDS = 64, 1 << 15


def _chunks(a: list[str], b: list[str], windows: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of like lengths: their indices (longest a first), lengths of a and b, and masks, a row a character of b."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    order = np.lexsort((m, n))[::-1]
    at = 0
    while at < len(order):
        # As b is not in order across lengths of a, the most of any is reckoned with.
        height = n[order[at]] + m[order[at:]].max() if windows else m[order[at:]].max()
        of = order[at : at + max(1, WORDS // max(1, int(height)))]
        at += len(of)
        x, y = _codes([a[i] for i in of], n[of], 0xFFFFFFFF), _codes([b[i] for i in of], m[of], 0xFFFFFFFE)
        masks = np.zeros(y.shape, np.uint64)
        for i, c in enumerate(x):
            masks |= (y == c).astype(np.uint64) << np.uint64(i)
        yield of, n[of], m[of], masks


def _codes(texts: list[str], lengths: np.ndarray, pad: int) -> np.ndarray:
    """Code points, a column a text; pad is behind its end."""
    most = int(lengths.max())
    codes = np.array(texts, dtype=f"<U{max(1, most)}").view("<u4").reshape(len(texts), -1)[:, :most].T.copy()
    codes[np.arange(most)[:, None] >= lengths] = pad
    return codes


def _step(v: np.ndarray, masks: np.ndarray) -> np.ndarray:
    # Bits beyond a are in no mask and stay set.
    u = v & masks
    return (v + u) | (v ^ u)


def _in_words(short: list[str], whole: Callable[[str, str], float], of_words: Callable, long: list[str], windows: bool) -> np.ndarray:
    """Values of the pairs: of_words of each chunk, or whole of the pair where short is longer than a word."""
    out = np.zeros(len(short))
    fits = [i for i, s in enumerate(short) if len(s) <= WORD]
    for i in () if len(fits) == len(short) else (i for i, s in enumerate(short) if len(s) > WORD):
        out[i] = whole(short[i], long[i])
    at = np.array(fits, np.int64)
    for of, *chunk in _chunks([short[i] for i in fits], [long[i] for i in fits], windows):
        out[at[of]] = of_words(*chunk)
    return out


def lcs_of_many(a: list[str], b: list[str]) -> np.ndarray:
    short, long = [x if len(x) <= len(y) else y for x, y in zip(a, b)], [y if len(x) <= len(y) else x for x, y in zip(a, b)]

    def of_words(n: np.ndarray, m: np.ndarray, masks: np.ndarray) -> np.ndarray:
        v = np.full(len(n), np.iinfo(np.uint64).max)
        for row in masks:
            v = _step(v, row)
        return np.bitwise_count(~v)

    return _in_words(short, lcs, of_words, long, False)


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    def of_words(n: np.ndarray, m: np.ndarray, masks: np.ndarray) -> np.ndarray:
        # All windows at once, a row a window by its end: at a step each takes a character, the longest texts begin.
        most = int(n[0])
        ends = np.arange(1, most + len(masks))[:, None]
        padded = np.zeros((len(ends) + most - 1, len(n)), np.uint64)
        padded[most - 1 : most - 1 + len(masks)] = masks
        v = np.full((len(ends), len(n)), np.iinfo(np.uint64).max)
        for t, begun in enumerate(np.searchsorted(-n, t - most, "right") for t in range(most)):
            v[:, :begun] = _step(v[:, :begun], padded[t : t + len(ends), :begun])
        width = np.maximum(np.minimum(ends, m) - np.maximum(0, ends - n), 0)
        return (200.0 * np.bitwise_count(~v) / (n + width)).max(0)

    return _in_words(short, _best_window, of_words, long, True)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """ratio() of each pair; so the following of theirs."""
    out = np.full(len(a), 100.0)
    if differ := [i for i, (x, y) in enumerate(zip(a, b)) if x != y]:
        x, y = [a[i] for i in differ], [b[i] for i in differ]
        out[differ] = 200.0 * lcs_of_many(x, y) / np.array([len(p) + len(q) for p, q in zip(x, y)])
    return out


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    in_order = {s: " ".join(sorted(s.split())) for s in {*a, *b}}
    return ratios([in_order[s] for s in a], [in_order[s] for s in b])


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    tokens = {s: set(s.split()) for s in {*a, *b}}
    out, at, rest = np.zeros(len(a)), [], []
    for i, (s, t) in enumerate(zip(a, b)):
        x, y = tokens[s], tokens[t]
        if not x or not y:
            continue
        both, left, right = x & y, x - y, y - x
        if both and (not left or not right):
            out[i] = 100.0
            continue
        at.append(i)
        rest.append((sum(map(len, both)) + len(both) - 1 if both else -1, " ".join(sorted(left)), " ".join(sorted(right))))
    if at:
        shared, left, right = zip(*rest)
        some = np.array(shared) >= 0
        shared, gap = np.maximum(shared, 0), some.astype(int)
        n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
        with_left, with_right = shared + gap + n, shared + gap + m
        best = 100.0 * (1 - (n + m - 2 * lcs_of_many(left, right)) / (with_left + with_right))
        alone = np.maximum(100.0 * (1 - (gap + n) / (shared + with_left)), 100.0 * (1 - (gap + m) / (shared + with_right)))
        out[at] = np.where(some, np.maximum(best, alone), best)
    return out


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    out = np.array([100.0 if x == y else 0.0 for x, y in zip(a, b)])
    if at := [i for i, (x, y) in enumerate(zip(a, b)) if x and y and x != y]:
        x, y = zip(*[(a[i], b[i]) if len(a[i]) <= len(b[i]) else (b[i], a[i]) for i in at])
        best = _best_windows(x, y)
        if even := [i for i, (p, q) in enumerate(zip(x, y)) if len(p) == len(q)]:
            best[even] = np.maximum(best[even], _best_windows([y[i] for i in even], [x[i] for i in even]))
        out[at] = best
    return out


def _column(of_pairs: Callable[[list[str], list[str]], np.ndarray]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(FloatType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], int] = {}
        at = [seen.setdefault(pair, len(seen)) for pair in zip(a, b)]
        return pd.Series(of_pairs(*map(list, zip(*seen)))[at] if seen else [], dtype="float32")

    return lambda a, b: run(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def _each(a: list[str], b: list[str]) -> np.ndarray:
    return np.array([jaro_winkler(x, y) for x, y in zip(a, b)])


ratio_of, token_sort_of, token_set_of, partial_of, jaro_winkler_of = map(_column, (ratios, token_sort_ratios, token_set_ratios, partial_ratios, _each))
