"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected onto many random directions; a pair collides in a projection if one lies in the
window of fixed width centred on the other.  The chance of a collision at the wanted cosine is known, so the
count that a true pair reaches with the wanted recall follows from the binomial law.  Counting every pair would
be quadratic.  Some projections are cut at 0 instead, without sorting: a vector goes to its own half and,
if it lies within a margin above the cut, to the lower half too, so a close pair is apart only if it straddles
the margin.  A table combines several such cuts into cells; as many tables are made as the recall asks for, and
the number of cuts grows with the logarithm of the number of vectors.  Inside a cell, collisions over all projections
are counted, and pairs with enough of them are verified by their cosine in double precision.

Equal vectors are one point with a weight from the start.  A pair that meets more than once is counted in the
first table and cell where it meets, which the projections of the two tell.  No pair is emitted: a task gives
one count per vector and a spanning forest.  A large cell is compared as pairs of blocks in many tasks.

Defined results: a null vector, a vector of zeros, or one with a null or non-finite component has no links and
is its own component, while any other magnitude counts; vectors of different length have no links; a null id is no component id of others; repeated
rows are vectors of their own that link with each other; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import components, stored, table
from benchloom.llm.simhash_dedup import Forest

#: Projections that are counted.
COUNTED = 64
#: Half a window and the margin of a cut, in standard deviations of the difference of a pair at the cosine.
WINDOW, MARGIN = 2.5, 1.0
RECALL = 0.9999
#: Vectors wanted in a cell, and in a block of a large one.
CELL, BLOCK = 256, 2048


def spread_of_pair(cosine: float) -> float:
    """Standard deviation of the difference of two unit vectors at ``cosine`` on a random normal direction."""
    return math.sqrt(2 * (1 - cosine))


def least_count(projections: int, chance: float, recall: float) -> int:
    """The largest count that a pair with this chance of a collision reaches with ``recall``."""
    tail, count = 0.0, 0
    while count < projections:
        tail += math.comb(projections, count) * chance**count * (1 - chance) ** (projections - count)
        if tail > 1 - recall:
            break
        count += 1
    return count


def chance_together(spread: float, margin: float) -> float:
    """Chance that a pair at the cosine is not parted by one cut: it is parted by a gap over the margin."""
    m = margin / spread
    over = math.exp(-m * m / 2) / math.sqrt(2 * math.pi) - m * 0.5 * math.erfc(m / math.sqrt(2))
    return 1 - 2 * spread * over / math.sqrt(2 * math.pi)


class Plan:
    """Directions, cuts and tables for one number of vectors."""

    def __init__(self, dim: int, cosine: float, cuts: int, seed: int):
        spread = spread_of_pair(cosine)
        self.cosine, self.window, self.margin, self.cuts = cosine, WINDOW * spread, MARGIN * spread, cuts
        whole = chance_together(spread, self.margin) ** cuts
        self.tables = 1 if whole > RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - whole))
        chance = math.erf(WINDOW / math.sqrt(2))
        self.count = least_count(COUNTED, chance, RECALL)
        rng = np.random.default_rng(seed)
        self.counted = rng.standard_normal((dim, COUNTED))
        self.cutting = rng.standard_normal((dim, self.tables * cuts))

    def sides(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector and cut, whether it goes to the lower and to the upper side."""
        at = (unit @ self.cutting).reshape(len(unit), self.tables, self.cuts)
        return at <= self.margin, at > 0


@lru_cache(maxsize=8)
def plan_for(dim: int, cosine: float, cuts: int, seed: int) -> Plan:
    return Plan(dim, cosine, cuts, seed)


def _cells(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (place, table, cell) of vectors with these sides."""
    tables, cuts = low.shape[1:]
    place, tab = (a.ravel() for a in np.mgrid[0 : len(low), 0:tables])
    cell = np.zeros(len(place), np.int64)
    for c in range(cuts):
        lower, upper = low[place, tab, c], high[place, tab, c]
        place = np.concatenate([place[lower], place[upper]])
        tab = np.concatenate([tab[lower], tab[upper]])
        cell = np.concatenate([cell[lower] * 2, cell[upper] * 2 + 1])
    return place, tab, cell


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    # Largest component first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(a: np.ndarray, b: np.ndarray, same: bool, plan: Plan, tab: int, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two blocks of a cell that are to be counted here."""
    pa, pb = (a @ plan.counted).astype(np.float32), (b @ plan.counted).astype(np.float32)
    found_x, found_y = [], []
    for i in range(0, len(a), 512):
        for j in range(i if same else 0, len(b), 512):
            left, right = pa[i : i + 512], pb[j : j + 512]
            # Half of the projections first: a pair that cannot reach the count any more is left out.
            hits = np.zeros((len(left), len(right)), np.int16)
            half = COUNTED // 4
            for m in range(half):
                hits += np.abs(left[:, m : m + 1] - right[None, :, m]) <= plan.window
            x, y = np.nonzero(hits >= plan.count - (COUNTED - half))
            if same and i == j:
                x, y = x[x < y], y[x < y]
            more = (np.abs(left[x, half:] - right[y, half:]) <= plan.window).sum(axis=1)
            enough = hits[x, y] + more >= plan.count
            found_x.append(x[enough] + i)
            found_y.append(y[enough] + j)
    x, y = np.concatenate(found_x), np.concatenate(found_y)
    keep = np.einsum("ij,ij->i", a[x], b[y]) >= plan.cosine
    x, y = x[keep], y[keep]
    # Counted where the pair meets first: not in an earlier table, and on the lower side wherever both are there.
    (low_a, high_a), (low_b, high_b) = plan.sides(a), plan.sides(b)
    first = np.ones(len(x), bool)
    for s in range(0, len(x), 1 << 16):
        p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
        both_low, both_high = low_a[p] & low_b[q], high_a[p] & high_b[q]
        before = (both_low | both_high).all(axis=2)[:, :tab].any(axis=1)
        upper = np.array([cell >> (plan.cuts - 1 - c) & 1 for c in range(plan.cuts)], bool)
        first[s : s + (1 << 16)] = ~before & ~(both_low[:, tab, :] & upper).any(axis=1)
    return x[first], y[first]


def _usable(vector) -> bool:
    if vector is None:
        return False
    x = np.array(vector, np.float64)
    return bool(len(x) and np.isfinite(x).all() and x.any())


def link_vectors(rows: DataFrame, cosine: float = 0.95, cell_size: int = CELL, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row (``vec_id``, ``embedding``)."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [_usable(v) for v in frame["embedding"]]
            data = [np.array(v, np.float64).tobytes() if g else None for v, g in zip(frame["embedding"], good)]
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "data": data})

    given = stored(rows.select("vec_id", "embedding").mapInPandas(check, "vec_id long, data binary"), "vectors")
    # Equal vectors are one point; a hot one is summed before the shuffle.
    points = stored(
        given.where("data IS NOT NULL")
        .groupBy("data")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"))
        .withColumn("point", F.monotonically_increasing_id()),
        "points",
    )
    total = points.count()
    cuts = max(1, math.ceil(math.log2(max(total, 2) / cell_size)))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            dims = frame["data"].map(len).to_numpy() // 8
            for dim in np.unique(dims):
                own = np.nonzero(dims == dim)[0]
                plan = plan_for(int(dim), cosine, cuts, seed)
                unit = _unit([np.frombuffer(frame["data"].iloc[i]) for i in own])
                place, tab, cell = _cells(*plan.sides(unit))
                yield pd.DataFrame(
                    {"point": frame["point"].to_numpy()[own[place]], "dim": int(dim), "tab": tab, "cell": cell}
                )

    members = stored(points.select("point", "data").mapInPandas(deal, "point long, dim long, tab long, cell long"), "cells")
    key = ["dim", "tab", "cell"]
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    # A member of block b meets all blocks: it is sent to the pairs (b, c) and (c, b) with the smaller first.
    dealt = (
        members.join(sizes, key)
        .withColumn("b", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("point", *key, "b", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"))
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        dim, tab, cell, i, j = (int(frame[c].iloc[0]) for c in ("dim", "tab", "cell", "i", "j"))
        plan = plan_for(dim, cosine, cuts, seed)
        parts = [frame[frame["b"] == i], frame[frame["b"] == j]] if i != j else [frame, frame]
        if not len(parts[0]) or not len(parts[1]):
            return pd.DataFrame({"point": [], "n": [], "v": []})
        a = _unit([np.frombuffer(d) for d in parts[0]["data"]])
        b = a if i == j else _unit([np.frombuffer(d) for d in parts[1]["data"]])
        x, y = _pairs(a, b, i == j, plan, tab, cell)
        ids = parts[0]["point"].to_numpy(), parts[1]["point"].to_numpy()
        weights = parts[0]["weight"].to_numpy(), parts[1]["weight"].to_numpy()
        near, counts = np.concatenate([ids[0][x], ids[1][y]]), np.concatenate([weights[1][y], weights[0][x]])
        seen, where = np.unique(near, return_inverse=True)
        n = np.bincount(where, weights=counts, minlength=len(seen)).astype(np.int64)
        forest = Forest(len(seen))
        for p, q in zip(where[: len(x)].tolist(), where[len(x) :].tolist()):
            forest.join(p, q)
        roots = seen[[forest.root(p) for p in range(len(seen))]] if len(seen) else seen
        return pd.DataFrame({"point": seen, "n": n, "v": roots})

    found = stored(
        dealt.join(points.select("point", "data", "weight"), "point")
        .groupBy(*key, "i", "j")
        .applyInPandas(compare, "point long, n long, v long"),
        "links",
    )
    counts = found.groupBy("point").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("point").alias("u"), "v"))
    named = (
        points.join(counts, "point", "left")
        .join(groups.withColumnRenamed("node", "point"), "point", "left")
        .withColumn("component", F.coalesce("component", "point"))
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = named.join(smallest, "component").select(
        "data", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    linked = given.where("data IS NOT NULL").join(known, "data").select("vec_id", "n_links", "component_id")
    alone = given.where("data IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark, folder: str) -> DataFrame:
    return link_vectors(table(spark, folder, "embeddings"))


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}
