"""A prefix-tree hash forest: persisted, sorted permutations of min-hash signatures.

A signature has ``VALUES`` min-hash values; two texts of similarity s agree in each
with the probability s. Every tree orders the signatures by another permutation of
the values, of which it keeps the first ``DEPTH``, a byte each, as one string. All
texts that share a prefix stand side by side in a tree's sorted array. A search
starts from the longest prefix and widens, one value at a time, until the expected
recall at the wanted similarity reaches the target; since the prefix only gets
shorter, the last range holds all ranges before it, so only that one is read.

The rows of a tree are stored by the range of its shortest prefix that any search may
use (``ROOT`` values) and sorted within it, in runs (``sources.runs``): a batch is
looked up without moving or reading anything of the history but the sorted rows.

Rows also carry a 256-bit sketch (one bit of each value): its Hamming
distance estimates the similarity with a deviation of 0.055, so nearly all chance
candidates fall away inside the join, before any text is fetched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUES = 256
DEPTH = 8
#: Values of the shortest prefix a search may widen to.
ROOT = 4
SKETCH = 256
SKETCHES = tuple(f"s{i}" for i in range(SKETCH // 64))
#: Characters that are hashed at once: bounds the memory of a task, whatever the length of a text.
BLOCK = 1 << 16
_EMPTY = np.iinfo(np.uint64).max
_ROUNDS = 24


def prefix_length(similarity: float, trees: int, recall: float) -> int:
    """The longest prefix (in values) that still reaches ``recall`` at ``similarity`` with so many trees, ROOT at least."""
    length = DEPTH
    while length > ROOT and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = values ^ np.uint64(salt)
        out = out * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(29)
    return out


def _windows(pieces: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``width`` characters, and the piece each is of."""
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(p) for p in pieces])
    n = len(points) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            found = found * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]
    owner = np.repeat(np.arange(len(pieces)), lengths)[:n]
    whole = np.arange(n) + width <= np.cumsum(lengths)[owner]
    return _mixed(found[whole], 0x1F83D9AB), owner[whole]


def distinct_runs(text: str, width: int) -> np.ndarray:
    """Hashes of the different runs of ``width`` characters, sorted."""
    return np.unique(np.concatenate([_windows([text[k : k + BLOCK + width - 1]], width)[0] for k in range(0, max(1, len(text)), BLOCK)]))


def _block_minima(pieces: list[str], width: int) -> np.ndarray:
    """Min-hash values of some pieces: every round throws each hash into one of the bins and
    keeps the smallest of a bin; a bin counts the first round that reached it, so two sets
    agree in a bin with the probability of their similarity. A few rounds fill all bins."""
    out = np.full((len(pieces), VALUES), _EMPTY, np.uint64)
    hashes, owner = _windows(pieces, width)
    flat = out.reshape(-1)
    for turn in range(_ROUNDS):
        if not len(hashes):
            return out
        thrown = _mixed(hashes, (turn + 1) * 0x632BE59BD9B4E019 & _EMPTY)
        place = owner * VALUES + (thrown >> np.uint64(56)).astype(np.int64)
        np.minimum.at(flat, place, (np.uint64(turn) << np.uint64(50)) | ((thrown & np.uint64((1 << 56) - 1)) >> np.uint64(6)))
        open_ = (out == _EMPTY).any(axis=1)[owner]
        hashes, owner = hashes[open_], owner[open_]
    # sets of a few hashes: what is still empty is the plain minimum under the bin's own hash
    for i in np.unique(owner):
        own = np.unique(hashes[owner == i])
        for b in np.nonzero(out[i] == _EMPTY)[0]:
            least = min(_mixed(own[k : k + BLOCK], (int(b) + 99) * 0x632BE59BD9B4E019 & _EMPTY).min() for k in range(0, len(own), BLOCK))
            out[i, b] = (np.uint64(_ROUNDS) << np.uint64(50)) | (least >> np.uint64(14))
    return out


def minima(texts: list[str], width: int) -> np.ndarray:
    """(texts, VALUES): the min-hash values of the distinct runs of ``width`` characters of each text.

    Long texts are cut into overlapping pieces, whose minima are combined.
    """
    out = np.full((len(texts), VALUES), _EMPTY, np.uint64)
    pieces, owners, size = [], [], 0

    def flush() -> None:
        nonlocal pieces, owners, size
        if pieces:
            np.minimum.at(out, np.array(owners), _block_minima(pieces, width))
        pieces, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - width + 1), BLOCK):
            piece = text[start : start + BLOCK + width - 1]
            pieces.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= BLOCK:
                flush()
    flush()
    # the minimum of many values has a run of leading zeros: mix before taking bits
    return _mixed(out, 0x510E527F)


def _permutations(trees: int, seed: int = 20_240_601) -> np.ndarray:
    """(trees, DEPTH): which values a tree orders by; the first ROOT of different trees differ as far as there are values."""
    draw = np.random.default_rng(seed)
    rows = []
    for t in range(trees):
        first = [(t * ROOT + i) % VALUES for i in range(ROOT)]
        rows.append([*first, *draw.permutation([v for v in range(VALUES) if v not in first])[: DEPTH - ROOT]])
    return np.array(rows)


def signed(texts: DataFrame, key: str, text: str, trees: int, width: int) -> DataFrame:
    """(key, trees, s0..s3) of each text: its strings in all trees, and its sketch.

    A text with fewer than ``width`` characters has no runs and gives no row, nor does null.
    """
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, trees array<bigint>, " + ", ".join(f"{s} bigint" for s in SKETCHES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = _permutations(trees)
        for frame in frames:
            frame = frame[frame[text].str.len() >= width]
            if not len(frame):
                continue
            least = minima(list(frame[text]), width)
            octets = (least >> np.uint64(20)).astype(np.uint8)
            strings = np.ascontiguousarray(octets[:, order]).view(">u8")[:, :, 0].astype(np.uint64).view(np.int64)
            sketch = np.packbits((least[:, :SKETCH] >> np.uint64(40)).astype(np.uint8) & 1, axis=1).view(">i8").astype(np.int64)
            yield pd.DataFrame({key: frame[key], "trees": list(strings)} | {s: sketch[:, i] for i, s in enumerate(SKETCHES)})

    return texts.select(key, text).filter(F.col(text).isNotNull()).mapInPandas(run, schema)


def planted(signs: DataFrame, key: str) -> DataFrame:
    """(bucket, low, key, s0..s3): a row per tree. bucket is the tree and its string's first ROOT values, low the others."""
    rows = signs.select(key, *SKETCHES, F.posexplode("trees").alias("tree", "string"))
    bits = 8 * (DEPTH - ROOT)
    bucket = F.expr(f"(CAST(tree AS BIGINT) << {8 * ROOT}) | shiftrightunsigned(string, {bits})")
    return rows.select(bucket.alias("bucket"), F.expr(f"CAST(string & {(1 << bits) - 1} AS BIGINT)").alias("low"), key, *SKETCHES)


def within_prefix(left: str, right: str, length: int) -> F.Column:
    """For two rows of one bucket: whether their strings agree in the first ``length`` values."""
    spare = 8 * (DEPTH - length)
    return F.lit(True) if length <= ROOT else F.expr(f"shiftrightunsigned({left}.low ^ {right}.low, {spare}) = 0")


def sketch_limit(similarity: float, deviations: float = 4.0) -> int:
    """The largest Hamming distance of two sketches that a pair of at least this similarity may show.

    One bit agrees with the probability (1 + s) / 2; a pair at the very limit is lost
    with the probability of so many standard deviations (4: 3 in 100,000).
    """
    p = (1 - similarity) / 2
    return math.floor(SKETCH * p + deviations * math.sqrt(SKETCH * p * (1 - p)))


def close_sketches(left: str, right: str, similarity: float) -> F.Column:
    distance = " + ".join(f"bit_count({left}.s{i} ^ {right}.s{i})" for i in range(SKETCH // 64))
    return F.expr(f"{distance} <= {sketch_limit(similarity)}")
