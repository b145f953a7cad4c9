"""Text normal forms and similarities that Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

import html
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_title(title: str) -> str:
    """NFKC, case-folded, everything but letters and digits as single spaces."""
    folded = unicodedata.normalize("NFKC", title).casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in folded).split())


def common_length(left: str, right: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one big-integer step per character."""
    if len(left) > len(right):
        left, right = right, left
    places: dict[str, int] = {}
    for i, c in enumerate(left):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(left)) - 1
    row = full
    for c in right:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def indel_ratio(left: str, right: str) -> float:
    """100 times twice the common subsequence over both lengths."""
    whole = len(left) + len(right)
    return 200.0 * common_length(left, right) / whole if whole else 100.0


def folded_similarity(left: str, right: str) -> float:
    """The better of the plain and the word-sorted ratio of two folded titles, to two places; 0 if one is empty."""
    if not left or not right:
        return 0.0
    ordered = indel_ratio(" ".join(sorted(left.split())), " ".join(sorted(right.split())))
    return round(max(indel_ratio(left, right), ordered), 2)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters of the texts as numbers, with the text and the place each is at."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return letters, np.repeat(np.arange(len(texts)), sizes), np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def common_lengths(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """``common_length`` of left[i] and right[j] for many pairs: the same steps over arrays of 64-bit words with carries."""
    letters, n, at = _letters(left)
    known = np.unique(letters)
    width = max(1, -(-max(map(len, left), default=1) // 64))
    # one code more, that of characters no left text has, and of the padding: it hits nothing
    places = np.zeros((len(left), len(known) + 1, width), np.uint64)
    np.add.at(places, (n, np.searchsorted(known, letters), at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    steps = np.full((len(right), max(map(len, right), default=0)), len(known), np.int32)
    letters, n, at = _letters(right)
    if len(known):
        code = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        steps[n, at] = np.where(known[code] == letters, code, len(known))
    out = np.empty(len(i), np.int64)
    for start in range(0, len(i), chunk):
        a, b = i[start : start + chunk], j[start : start + chunk]
        row = [np.full(len(a), 2**64 - 1, np.uint64) for _ in range(width)]
        for k in range(steps.shape[1]):
            here, carry = places[a, steps[b, k]], np.zeros(len(a), np.uint64)
            for w in range(width):
                hit = row[w] & here[:, w]
                part = row[w] + hit
                total = part + carry
                carry = ((part < hit) | (total < part)).astype(np.uint64)
                row[w] = total | (row[w] - hit)
        out[start : start + chunk] = 64 * width - sum(np.bitwise_count(r).astype(np.int64) for r in row)
    return out


#: Titles beyond this length are compared one by one: whole arrays would have as many words for short ones.
LONGEST_IN_ARRAYS = 256


def folded_similarities(left: list[str], right: list[str], chunk: int = 512) -> list[float]:
    """``folded_similarity`` of each left[n] and right[n], over arrays."""
    out = [100.0 if x and x == y else 0.0 for x, y in zip(left, right)]
    open_ = [n for n, (x, y) in enumerate(zip(left, right)) if x and y and x != y]
    for n in (n for n in open_ if max(len(left[n]), len(right[n])) > LONGEST_IN_ARRAYS):
        out[n] = folded_similarity(left[n], right[n])
    # titles of one script and length together: few different characters, little padding
    rest = sorted((n for n in open_ if max(len(left[n]), len(right[n])) <= LONGEST_IN_ARRAYS), key=lambda n: (max(left[n]) >= "\u1000", max(len(left[n]), len(right[n]))))
    ordered = {t: " ".join(sorted(t.split())) for side in (left, right) for t in side}
    for start in range(0, len(rest), chunk):
        part = rest[start : start + chunk]
        x, y = [left[n] for n in part], [right[n] for n in part]
        each, whole = np.arange(len(part)), np.array([len(a) + len(b) for a, b in zip(x, y)])
        plain, sorted_ = common_lengths(x, y, each, each), common_lengths([ordered[t] for t in x], [ordered[t] for t in y], each, each)
        sizes = np.array([sum(len(ordered[t]) for t in pair) for pair in zip(x, y)])
        for n, ratio in zip(part, np.maximum(200.0 * plain / whole, 200.0 * sorted_ / sizes).tolist()):
            out[n] = round(ratio, 2)
    return out


#: Counts of characters that the filter of ``similar_in`` compares: 1 per letter or digit, hashed for others.
FOLDS = 64


def _counts(texts: list[str]) -> np.ndarray:
    letters, n, _ = _letters(texts)
    return np.bincount(n * FOLDS + letters % FOLDS, minlength=len(texts) * FOLDS).reshape(-1, FOLDS)


def _neighbours(texts: list[str]) -> np.ndarray:
    """Counts of two characters in a row, each word between two spaces, hashed: the same in any order of the words."""
    letters, n, _ = _letters([f" {t} " for t in texts])
    inside = n[1:] == n[:-1]
    codes = (letters[:-1].astype(np.int64) * 31 + letters[1:])[inside] % 256
    counts = np.bincount(n[1:][inside] * 256 + codes, minlength=len(texts) * 256).reshape(-1, 256)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int64)


def _in_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of the smaller counts of each row of ``x`` and of ``y``: a product of the matrices that say for each count whether it reaches 1, 2, ..."""
    most = np.minimum(x.max(axis=0), y.max(axis=0))
    if most.sum() > 1024:
        return sum(np.minimum(x[:, k, None], y[None, :, k]) for k in range(FOLDS) if most[k])
    fold = np.repeat(np.arange(FOLDS), most)
    level = np.arange(len(fold)) - np.repeat(np.cumsum(most) - most, most) + 1
    return (x[:, fold] >= level).astype(np.float32) @ (y[:, fold] >= level).astype(np.float32).T


def _within(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray, most: np.ndarray, chunk: int = 16384, stride: int = 12) -> np.ndarray:
    """Whether left[i] and right[j] have at most ``most`` characters outside their longest common subsequence.

    The steps of ``common_lengths``; every ``stride`` of them, pairs are left out that have more characters of
    right[j] behind them without a partner than that allows.
    """
    a, b = (np.array([len(t) for t in side], np.int64) for side in (left, right))
    letters, n, at = _letters(left)
    known = np.unique(letters)
    width, codes = max(1, -(-int(a.max(initial=1)) // 64)), len(known) + 1
    places = np.zeros((width, len(left) * codes), np.uint64)
    np.add.at(places, (at // 64, n * codes + np.searchsorted(known, letters)), np.uint64(1) << (at % 64).astype(np.uint64))
    steps = np.full((int(b.max(initial=0)), len(right)), len(known), np.int64)
    letters, n, at = _letters(right)
    if len(known):
        code = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        steps[at, n] = np.where(known[code] == letters, code, len(known))
    out = np.zeros(len(i), bool)
    for start in range(0, len(i), chunk):
        pair = np.arange(start, min(start + chunk, len(i)))
        x, y = i[pair] * codes, j[pair]
        spare = (most[pair] + b[y] - a[i[pair]]) // 2
        row = [np.full(len(pair), 2**64 - 1, np.uint64) for _ in range(width)]
        for k in range(len(steps)):
            where, carry = x + steps[k].take(y), None
            for w in range(width):
                here = row[w] & places[w].take(where)
                total = row[w] + here
                over = total < here if w + 1 < width else None
                if carry is not None:
                    total += carry
                    # a carry into a word of ones only carries on
                    over = None if over is None else over | (total < carry)
                row[w] = total | (row[w] - here)
                carry = None if over is None else over.astype(np.uint64)
            if (k + 1) % stride == 0 or k + 1 == len(steps):
                met = 64 * width - sum(np.bitwise_count(r).astype(np.int64) for r in row)
                go = np.minimum(k + 1, b[y]) - met <= spare
                if not go.all():
                    pair, x, y, spare, row = pair[go], x[go], y[go], spare[go], [r[go] for r in row]
                    if not len(pair):
                        break
        out[pair] = True
    return out


def similar_in(left: list[str], right: list[str], score: float, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all folded titles whose ``folded_similarity`` can be ``score`` or more: none is lost.

    A similarity of t leaves at most (1 - t) of both lengths outside the common
    subsequence. The differences of the counts of each character and of each two
    neighbours are lower bounds of that, in any order of the words; the rest is computed.
    """
    # similarities are rounded to two places
    least = (score - 0.006) / 100
    b, y = np.array([len(t) for t in right], np.int64), _counts(right)
    q = _neighbours(right)
    right_sorted = [" ".join(sorted(t.split())) for t in right]
    found = []
    for start in range(0, len(left), tile):
        part = left[start : start + tile]
        a = np.array([len(t) for t in part], np.int64)
        p = _neighbours(part)
        whole = (a[:, None] + b[None, :]).astype(np.float32)
        # counts in common, twice, are at least the share of both lengths that may not be outside
        i, j = np.nonzero((2 * _in_common(_counts(part), y) >= whole * np.float32(least - 1e-6) - np.float32(0.01)) & (a[:, None] > 0) & (b[None, :] > 0))
        most = np.floor((1 - least) * (a[i] + b[j]) + 1e-9).astype(np.int64)
        sure = a[i] + b[j] - most <= 2 * np.minimum(a[i], b[j])
        i, j, most = i[sure], j[sure], most[sure]
        # each character outside parts at most three pairs of neighbours
        shared = [np.minimum(p[i[n : n + 4096]], q[j[n : n + 4096]]).sum(axis=1, dtype=np.int64) for n in range(0, len(i), 4096)]
        sure = a[i] + b[j] + 2 - 2 * np.concatenate(shared) <= 3 * most if shared else np.zeros(0, bool)
        i, j, most = i[sure], j[sure], most[sure]
        near = _within(part, right, i, j, most)
        # word-sorted only where the plain order isn't enough
        rest = np.nonzero(~near)[0]
        near[rest] = _within([" ".join(sorted(t.split())) for t in part], right_sorted, i[rest], j[rest], most[rest])
        found.append((i[near] + start, j[near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


@F.pandas_udf(T.StringType())
def normalize_title(title: pd.Series) -> pd.Series:
    """``fold_title`` of each title; null gives ''."""
    return title.fillna("").map(fold_title)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.DoubleType())
def title_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of titles that are folded already; run it on pruned pairs only."""
    return pd.Series(folded_similarities(left.fillna("").tolist(), right.fillna("").tolist()), dtype="float64")


@F.pandas_udf(T.DoubleType())
def plain_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(a or "", b or "") for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.StringType())
def html_entities(text: pd.Series) -> pd.Series:
    """Character references resolved."""
    return text.map(lambda t: None if t is None else html.unescape(t))
