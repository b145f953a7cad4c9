"""Most similar vectors for every vector: a hash-prefix forest over long bit strings.

Every tree is a sorted array of 64-bit strings, one bit per random plane; two vectors at
cosine c agree in a bit with the probability 1 - arccos(c) / pi. A search descends to the
longest common prefixes, which bound how similar a vector's k-th neighbour is at least,
and then ascends in all trees in step, to the one prefix length at which that neighbour
is found with the wanted recall: long prefixes where vectors are dense, short ones where
they are sparse, and everything that shares the prefix is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TREES = 16
BITS = 64
#: Probability with which a neighbour shares a prefix of the chosen length in one tree at least.
RECALL = 0.98
#: Vectors in a shortest range of more rows than this descend to the longest prefixes first.
DENSE = 512
#: Trees and places on either side that the descent looks at, to bound the k-th similarity.
DESCENT_TREES, DESCENT_REACH = 4, 32
#: Rows of a range that one task holds at once; larger ranges are compared block by block.
BLOCK = 16_384
#: Prefix lengths above the shortest one that the ascent stops at.
STEPS = (0, 2, 4, 7, 11, 16, 23, 32)


def prefix_bits(cosine: float, trees: int, recall: float = RECALL) -> int:
    """The longest prefix that vectors of this cosine share in one of the trees with the probability ``recall``."""
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    least = 1 - (1 - recall) ** (1 / trees)
    return BITS if agree >= 1 else max(1, min(BITS, math.floor(math.log(least) / math.log(agree))))


def trees_for(vectors: int, least: float) -> int:
    """Trees enough that the shortest prefix splits the vectors into ranges of some hundreds each, were they spread evenly."""
    wanted = max(1, math.ceil(math.log2(max(2, vectors)) - 9))
    trees = TREES
    while prefix_bits(least, trees) < wanted and trees < 256:
        trees *= 2
    return trees


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(id, space, vector): vectors that aren't null, have exactly ``dimensions`` values, all finite and not all zero.

    A space is an execution version and a number of dimensions; only vectors of one space are compared.
    """
    sound = (
        "vector IS NOT NULL AND size(vector) = dimensions"
        " AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = float('Infinity')) AND exists(vector, x -> x != 0)"
    )
    return rows.filter(sound).select("id", F.struct("execution_version", "dimensions").alias("space"), "vector")


def _planes(dimensions: int, trees: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, trees * BITS)).astype(np.float32)


def _units(vectors: pd.Series) -> np.ndarray:
    flat = np.stack(vectors.to_numpy()).astype(np.float64)
    flat /= np.abs(flat).max(axis=1, keepdims=True)  # else tiny or huge values under- or overflow when squared
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def hashed(vectors: DataFrame, trees: int) -> DataFrame:
    """(class, space, unit, trees): a long hash string of every vector in every tree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            for size, part in frame.groupby(frame.vector.str.len()):
                units = _units(part.vector).astype(np.float32)
                planes.setdefault(size, _planes(size, trees))
                strings = np.packbits(units @ planes[size] > 0, axis=1).view(">u8").astype(np.uint64).view(np.int64)
                yield pd.DataFrame({"class": part["class"], "space": part.space, "unit": list(units), "trees": list(strings)})

    # equal spaces by 64 bits of hash: they only have to keep apart what can't be compared
    flat = vectors.select("class", F.xxhash64("space.execution_version", "space.dimensions").alias("space"), "vector")
    return flat.mapInPandas(run, "class bigint, space bigint, unit array<float>, trees array<bigint>")


def _best(queries: np.ndarray, data: np.ndarray, of: np.ndarray, to: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple]:
    """The pairs (of, to, cosine), as arrays, of at least ``least`` and, with ties, among the k best of their query here."""
    for start in range(0, len(queries), 512):
        q = queries[start : start + 512]
        near = q @ data.T
        i, j = np.nonzero(near >= least[start : start + 512, None] - 1e-5)
        other = of[start + i] != to[j]
        i, j = i[other], j[other]
        many = np.flatnonzero(np.bincount(i, minlength=len(q)) > k)
        if len(many):
            # the k + 1 best, since a vector may be among its own rows
            best = np.full(len(q), -2.0, np.float32)
            best[many] = np.partition(near[many], len(data) - k - 1, axis=1)[:, len(data) - k - 1] - 1e-6
            kept = near[i, j] >= best[i]
            i, j = i[kept], j[kept]
        cosines = np.einsum("ij,ij->i", q[i].astype(np.float64), data[j].astype(np.float64))
        yield of[start + i], to[j], cosines


def _framed(found: Iterator[tuple], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Many small results as few frames."""
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield pd.DataFrame(dict(zip(("of", "to", "cosine"), map(np.concatenate, zip(*held)))))
            held, n = [], 0
    if held:
        yield pd.DataFrame(dict(zip(("of", "to", "cosine"), map(np.concatenate, zip(*held)))))


def descended(strings: DataFrame, k: int, least: float) -> DataFrame:
    """(of, to, cosine): what stands within DESCENT_REACH places in DESCENT_TREES sorted arrays, the longest common prefixes.

    These only bound the k-th similarity from below, so neighbours lost at the borders
    of partitions lose no result.
    """

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        tail = None
        for frame in frames:
            whole = frame if tail is None else pd.concat([tail, frame], ignore_index=True)
            for _, part in whole.groupby(["space", "tree"], sort=False):
                ids, units = part["class"].to_numpy(), np.stack(part.unit.to_numpy())
                for start in range(0, len(ids), DESCENT_REACH):
                    stop, a, b = start + DESCENT_REACH, max(0, start - DESCENT_REACH), start + 2 * DESCENT_REACH
                    own = ids[start:stop]
                    yield from _best(units[start:stop], units[a:b], own, ids[a:b], np.full(len(own), least, np.float32), k)
            tail = frame.tail(2 * DESCENT_REACH)

    order = ["space", "tree", "string"]
    arrays = strings.filter(F.col("tree") < DESCENT_TREES).repartitionByRange(*order).sortWithinPartitions(*order, "class")
    return arrays.mapInPandas(lambda frames: _framed(near(frames)), "of bigint, to bigint, cosine double")


def _cells(cells: DataFrame, k: int, order: list[str]) -> DataFrame:
    """(of, to, cosine) within each cell: whoever asks (role 2) against the rows (role 1) that share its first ``bits`` bits."""

    def compared(ids, unit, strings, bits, least, role) -> Iterator[tuple]:
        ask, data = (role & 2) > 0, (role & 1) > 0
        if len(ids) < 2 or not ask.any() or not data.any():
            return
        units = np.stack(unit)
        for length in np.unique(bits[ask]):
            prefix = strings >> np.uint64(BITS - length)
            edges = [0, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1), len(prefix)]
            for lo, hi in zip(edges, edges[1:]):
                q = lo + np.flatnonzero(ask[lo:hi] & (bits[lo:hi] == length))
                d = lo + np.flatnonzero(data[lo:hi])
                if len(q) and hi - lo > 1:
                    yield from _best(units[q], units[d], ids[q], ids[d], least[q], k)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        held: list[tuple] = []
        now = None

        def flush() -> Iterator[tuple]:
            whole = held[0] if len(held) == 1 else tuple(map(np.concatenate, zip(*held)))
            held.clear()
            return compared(*whole)

        for frame in frames:
            names = frame["cell"].to_numpy()
            columns = (
                frame["class"].to_numpy(), frame["unit"].to_numpy(), frame["string"].to_numpy().view(np.uint64), frame["bits"].to_numpy(),
                frame["bound"].to_numpy(np.float32), frame["role"].to_numpy(),
            )
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for a, b in zip(edges, edges[1:]):
                if held and names[a] != now:
                    yield from flush()
                now = names[a]
                held.append(tuple(c[a:b] for c in columns))
        if held:
            yield from flush()

    columns = ["cell", "class", "unit", "string", "bits", "bound", "role"]
    return cells.select(*columns).repartition("cell").sortWithinPartitions("cell", *order).mapInPandas(lambda frames: _framed(near(frames)), "of bigint, to bigint, cosine double")


def ascended(strings: DataFrame, k: int, shortest: int) -> DataFrame:
    """(of, to, cosine): each vector's k best in every tree, of all that share its first ``bits`` bits and reach ``bound``.

    ``strings`` has class, space, unit, tree, string, bits, bound. The vectors that share
    the ``shortest`` prefix are one cell, sorted, in which every one's own range is
    looked up. A cell of more than BLOCK rows is formed anew for each length somebody
    asks with, and split into blocks of rows and blocks of those who ask: a task holds
    two blocks at most, nothing is left out.
    """
    ranged = lambda bits: F.xxhash64(F.lit(bits), "space", "tree", F.expr(f"shiftrightunsigned(string, {BITS - bits})"))
    rows = strings.withColumn("cell", ranged(shortest))
    large = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("cell"))
    if large.isEmpty():
        return _cells(rows.withColumn("role", F.lit(3)), k, ["string"])
    found = _cells(rows.join(large, "cell", "left_anti").withColumn("role", F.lit(3)), k, ["string"])
    hot = rows.join(large, "cell", "left_semi").drop("cell")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    place = lambda row, asker, role: F.struct(row.alias("row"), asker.alias("asker"), F.lit(role).alias("role"))
    for bits in sorted(r.bits for r in hot.select("bits").distinct().collect()):  # some of STEPS
        asks = F.col("bits") == bits
        keyed = hot.withColumn("range", ranged(bits))
        sizes = keyed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("q")).filter("n > 1 AND q > 0")
        placed = keyed.join(sizes.select("range", blocks("n").alias("rows"), blocks("q").alias("askers")), "range")
        as_row = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda i: place(own(F.col("rows")), i, 1))
        as_asker = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: place(i, own(F.col("askers")), 2))
        places = F.when(asks, F.concat(as_row, as_asker)).otherwise(as_row)
        cells = placed.withColumn("p", F.explode(places)).withColumns({"cell": F.xxhash64("range", "p.row", "p.asker"), "role": F.col("p.role")})
        found = found.unionByName(_cells(cells, k, ["string"]))
    return found


def candidate_pairs(classes: DataFrame, k: int, least: float, trees: int | None = None) -> DataFrame:
    """(of, to, cosine): pairs of at least ``least``, among them the k most similar of each vector with the probability RECALL.

    First the ranges of the shortest prefix are counted, the length at which a cosine
    of ``least`` is found. Vectors with small ranges ask there. The others descend to
    the longest prefixes first; the k-th cosine found there is a lower bound of the
    true one, and the length for that bound, the same in all trees, is where they ask.
    """
    trees = trees or trees_for(classes.count(), least)
    signs = cut(hashed(classes, trees))
    strings = signs.select("class", "space", "unit", F.posexplode("trees").alias("tree", "string"))
    shortest = prefix_bits(least, trees)
    ranges = strings.select("class", F.xxhash64("space", "tree", F.expr(f"shiftrightunsigned(string, {BITS - shortest})")).alias("range"))
    dense = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DENSE)
    crowded = cut(ranges.join(dense, "range", "left_semi").select("class").distinct())
    lengths = [min(BITS, shortest + s) for s in STEPS]
    # the cosine from which on a length suffices
    grid = [(x, next((c / 1000 for c in range(int(least * 1000), 1001) if prefix_bits(c / 1000, trees) >= x), 2.0)) for x in lengths]
    first = cut(descended(strings.join(crowded, "class", "left_semi"), k, least).dropDuplicates(["of", "to"]))
    order = Window.partitionBy("of").orderBy(F.col("cosine").desc(), "to")
    bounds = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select(F.col("of").alias("class"), F.col("cosine").alias("bound"))
    known = strings.join(bounds, "class", "left").withColumn("bound", F.coalesce("bound", F.lit(least)))
    bits = F.lit(lengths[0])
    for length, enough in grid[1:]:
        bits = F.when(F.col("bound") >= enough, length).otherwise(bits)
    found = first.unionByName(ascended(known.withColumn("bits", bits), k, shortest))
    return found.filter(F.col("cosine") >= least).groupBy("of", "to").agg(F.max("cosine").alias("cosine"))


def most_similar(rows: DataFrame, k: int = 10, least: float = 0.9, trees: int | None = None) -> DataFrame:
    """(id, other_id, cosine, rank): the k most similar vectors of each vector, of those with a cosine of at least ``least``.

    Found by the forest, so a small share is missed (the tests measure the recall
    against brute force); cosines are exact up to rounding. Ties go to the smaller id.

    Vectors that are equal in every value form one class that is searched once. Of a
    class only its k + 1 smallest ids can be among anyone's k most similar, so each
    side of a pair of classes contributes a bounded list, and a class with a third
    of all rows is never paired within itself.

    Unusable vectors (null, wrong length, not finite, all zero) are in no row;
    an empty table gives none. ``id`` must be unique.
    """
    # equal by 128 bits of hash; -0.0 and 0.0 hash alike after adding 0
    plain = usable_vectors(rows).withColumn("vector", F.expr("transform(vector, x -> x + float(0))"))
    keyed = plain.select("id", "space", "vector", F.xxhash64("space", "vector").alias("h1"), F.xxhash64("vector", F.lit(1), "space").alias("h2"))
    same = Window.partitionBy("h1", "h2").orderBy("id")
    heads = keyed.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    classes = heads.filter("place = 1").select(F.col("id").alias("class"), "space", "vector", "h1", "h2")
    toward = candidate_pairs(classes.select("class", "space", "vector"), k, least, trees)
    nearest = Window.partitionBy("of").orderBy(F.col("cosine").desc(), "to")
    toward = toward.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k).drop("n")
    named = classes.select("class", "h1", "h2")
    listed = heads.select("id", "h1", "h2").join(named, ["h1", "h2"]).select(F.col("class").alias("to"), F.col("id").alias("other"))
    own = listed.select(F.col("to").alias("of"), "other", F.lit(1.0).alias("cosine"))
    offered = toward.join(listed, "to").select("of", "other", "cosine").unionByName(own)
    best = Window.partitionBy("of").orderBy(F.col("cosine").desc(), "other")
    lists = (
        offered.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
        .groupBy("of").agg(F.array_sort(F.collect_list(F.struct("n", "other", "cosine"))).alias("list"))
        .filter(F.size("list") > 1)
    )
    members = keyed.select("id", "h1", "h2").join(named.join(lists, F.col("class") == F.col("of")), ["h1", "h2"])
    mine = F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k)
    return members.select("id", F.posexplode(mine).alias("p", "x")).select("id", F.col("x.other").alias("other_id"), F.col("x.cosine").alias("cosine"), (F.col("p") + 1).alias("rank"))


def similar_pairs(rows: DataFrame, k: int = 10, least: float = 0.9) -> DataFrame:
    """(left_id, right_id), smaller first: pairs where one is among the k most similar of the other."""
    found = most_similar(rows, k, least)
    return found.select(F.least("id", "other_id").alias("left_id"), F.greatest("id", "other_id").alias("right_id")).distinct()
