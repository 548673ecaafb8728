"""Exact centroid clustering with bounds that are loosened by the norm of a total displacement.

Every vector keeps, for each centroid, a lower bound of its distance and the round in which that bound was
evaluated, and an upper bound of the distance to its own centroid with its round.  The driver keeps the history
of all centroids.  A bound evaluated in round t is loosened by how far its centroid has moved from its place in
round t to its place now - the norm of the total displacement, not the sum of the drifts of the rounds between.
Where the loosened lower bound is not above the upper bound, the distances are evaluated again, in whole numbers.

A round is one pass over the stored vectors: a task reads its part, settles what the bounds settle, evaluates
the rest, writes the vectors with their new bounds and, beside them, one row of component sums per cluster.
The driver gets sums per cluster and component only, never vectors.  A lost executor rereads the round before,
which is removed when the next round stands.

Defined results: rows whose vector is null, of another length, or holds null or non-finite components are left
out, and so are those with a component of 2 ** 54 or more, which no whole number of 64 bits holds; distances or
sums beyond a long are null, though compared exactly; repeated rows are vectors of their own; a null id is
hashed as an empty one; fewer vectors than clusters give as many clusters as vectors; other columns are ignored;
no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom.llm.common import discard, stored_at, table

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Largest magnitude of a component that is kept.
LARGEST = float(1 << 54)
LONG = (1 << 63) - 1
#: What rounding may add to or take from a distance or a norm.
SLACK = 1e-6

STATE = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType()),
        T.StructField("upper", T.DoubleType()),
        T.StructField("lower", T.BinaryType()),
        T.StructField("seen", T.BinaryType()),
        # A row of sums has no vector: the cluster, its count, and sums of high and low halves by component.
        T.StructField("n", T.LongType()),
        T.StructField("high", T.ArrayType(T.LongType())),
        T.StructField("low", T.ArrayType(T.LongType())),
    ]
)


def packed(whole: np.ndarray) -> bytes:
    """Whole numbers in the smallest width that holds them; the length tells the width."""
    for kind in ("<i2", "<i4"):
        info = np.iinfo(kind)
        if info.min <= whole.min() and whole.max() <= info.max:
            return whole.astype(kind).tobytes()
    return whole.astype("<i8").tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // dim}").astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c``; Python's whole numbers where 64 bits may not do."""
    rough = ((x.astype(np.float64) - c.astype(np.float64)) ** 2).sum(axis=1)
    gap = x - c
    # Arithmetic modulo 2 ** 64 is right wherever the result itself fits.
    exact = (gap * gap).sum(axis=1)
    large = rough > 9.0e18
    if not large.any():
        return exact
    exact = exact.astype(object)
    for i in np.nonzero(large)[0]:
        exact[i] = sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], c[i]))
    return exact


def root(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64))


def widened(square: np.ndarray) -> np.ndarray:
    """Upper bounds of the distances."""
    return root(square) * (1 + SLACK) + SLACK


def displacements(history: np.ndarray) -> np.ndarray:
    """By round and centroid, the norm of its way from its place in that round to its place now, not too small."""
    way = history.astype(np.float64) - history[-1].astype(np.float64)
    return np.sqrt((way * way).sum(axis=2)) * (1 + SLACK) + SLACK


def evaluate(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs (row, centroid), a bounded number at a time."""
    step = 1 << 15
    found = [squared(x[rows[s : s + step]], centroids[cols[s : s + step]]) for s in range(0, len(rows), step)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Bounds:
    """State of a batch of vectors: own cluster, upper bound of its distance, lower bounds of all, rounds of the bounds."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, seen: np.ndarray):
        self.x, self.cluster, self.upper, self.lower, self.seen = x, cluster, upper, lower, seen
        self.evaluated = 0

    @classmethod
    def new(cls, x: np.ndarray, k: int) -> Bounds:
        """Nothing is known: every lower bound is 0 and the upper bound of centroid 0 has no limit."""
        n = len(x)
        return cls(x, np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k), np.float32), np.zeros((n, k), np.uint8))

    def settle(self, history: np.ndarray) -> None:
        """Assign every vector to its nearest centroid of now (ties: the smaller number)."""
        now, centroids = len(history) - 1, history[-1]
        moved = displacements(history)
        every = np.arange(self.lower.shape[1])
        lower = self.lower - moved[self.seen, every[None, :]]
        lower[np.arange(len(lower)), self.cluster] = np.inf
        upper = self.upper + moved[self.own_seen(), self.cluster]
        # Failures: first the own distance is evaluated, then those of the centroids that still may be nearer.
        failed = np.nonzero((lower <= upper[:, None]).any(axis=1))[0]
        own = evaluate(self.x, failed, self.cluster[failed], centroids)
        self.note(failed, self.cluster[failed], own, now)
        rows, cols = np.nonzero(lower[failed] <= widened(own)[:, None])
        square = evaluate(self.x, failed[rows], cols, centroids)
        self.note(failed[rows], cols, square, now)
        if len(rows):
            # Of a vector's evaluated centroids the nearest, then the smallest number; compared with its own.
            order = np.lexsort((cols, square, rows))
            first = order[np.concatenate([[True], rows[order][1:] != rows[order][:-1]])]
            at, nearest, number = rows[first], square[first], cols[first]
            nearer = (nearest < own[at]) | ((nearest == own[at]) & (number < self.cluster[failed[at]]))
            own = own.astype(object) if square.dtype == object else own
            own[at[nearer]] = nearest[nearer]
            self.cluster[failed[at[nearer]]] = number[nearer]
        self.upper[failed] = widened(own)

    def note(self, rows: np.ndarray, cols: np.ndarray, square: np.ndarray, now: int) -> None:
        """Lower bounds evaluated now; stored ones are rounded down, never up."""
        tight = np.maximum(root(square) * (1 - SLACK) - SLACK, 0).astype("<f4")
        self.lower[rows, cols] = np.nextafter(tight, np.float32(-np.inf)).clip(0)
        self.seen[rows, cols] = now
        self.evaluated += len(rows)

    def own_seen(self) -> np.ndarray:
        return self.seen[np.arange(len(self.seen)), self.cluster]


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low 32 bits, so that sums of many rows stay in 64."""
    return x >> 32, x & 0xFFFFFFFF


def _long(value) -> int | None:
    return int(value) if abs(int(value)) <= LONG else None


def one_round(state: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    """The next state of all vectors, with rows of sums, for the centroids at the end of ``history``; the last
    round has the exact squares of the distances."""
    k, dim = history.shape[1:]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(k, np.int64)
        high, low = np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64)
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack([unpacked(d, dim) for d in frame["data"]])
            if frame["lower"].isna().all():
                bounds = Bounds.new(x, k)
            else:
                lower = np.stack([np.frombuffer(b, "<f4") for b in frame["lower"]])
                seen = np.stack([np.frombuffer(b, np.uint8) for b in frame["seen"]])
                bounds = Bounds(x, frame["cluster"].to_numpy(np.int64), frame["upper"].to_numpy(np.float64).copy(), lower, seen)
            bounds.settle(history)
            square = evaluate(x, np.arange(len(x)), bounds.cluster, history[-1]) if last else []
            up, down = halves(x)
            np.add.at(count, bounds.cluster, 1)
            np.add.at(high, bounds.cluster, up)
            np.add.at(low, bounds.cluster, down)
            yield pd.DataFrame(
                {
                    "vec_id": frame["vec_id"],
                    "data": frame["data"],
                    "cluster": bounds.cluster.astype(np.int32),
                    "distance": pd.array([_long(s) for s in square] if last else [None] * len(frame), "Int64"),
                    "upper": bounds.upper,
                    "lower": [b.tobytes() for b in bounds.lower],
                    "seen": [b.tobytes() for b in bounds.seen],
                    "n": pd.array([None] * len(frame), "Int64"),
                    "high": None,
                    "low": None,
                }
            )
        own = np.nonzero(count)[0]
        if len(own):
            empty = [None] * len(own)
            yield pd.DataFrame(
                {
                    "vec_id": pd.array(empty, "Int64"),
                    "data": empty,
                    "cluster": own.astype(np.int32),
                    "distance": pd.array(empty, "Int64"),
                    "upper": pd.array(empty, "Float64"),
                    "lower": empty,
                    "seen": empty,
                    "n": pd.array(count[own], "Int64"),
                    "high": list(high[own]),
                    "low": list(low[own]),
                }
            )

    return state.mapInPandas(work, STATE)


def centroids_after(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Floored means of the clusters from the rows of sums; an empty cluster's centroid stays."""
    sums = state.where("n IS NOT NULL")
    counts = {r["cluster"]: int(r["n"]) for r in sums.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}
    both = F.posexplode(F.arrays_zip("high", "low")).alias("place", "half")
    total = lambda half: F.sum(F.col(f"half.{half}").cast("decimal(38,0)")).alias(half)
    # One row per cluster and component: 2,560 with the production parameters.
    by_place = sums.select("cluster", both).groupBy("cluster", "place").agg(total("high"), total("low")).collect()
    after = before.copy()
    for r in by_place:
        after[r["cluster"], r["place"]] = ((int(r["high"]) << 32) + int(r["low"])) // counts[r["cluster"]]
    return after


def whole_vectors(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """``vec_id`` and the packed whole numbers of every usable vector."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = []
            for vector in frame["embedding"]:
                # A null component arrives as NaN.
                x = np.array(vector, np.float64) if vector is not None and len(vector) == dim else np.full(dim, np.nan)
                usable = bool(np.isfinite(x).all() and (np.abs(x) < LARGEST).all())
                data.append(packed(np.floor(scale * x).astype(np.int64)) if usable else None)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "data": data})

    return rows.select("vec_id", "embedding").mapInPandas(work, "vec_id long, data binary").where("data IS NOT NULL")


def _name(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def cluster_vectors(
    rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """Every usable vector with its ``cluster``, exact ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``; and the final centroids.  At most 255 rounds (the round of a bound is one byte)."""
    if not 0 <= rounds < 255:
        raise ValueError("rounds must be from 0 to 254")
    spark = rows.sparkSession
    vectors, path = stored_at(whole_vectors(rows, dim, scale), "vectors")
    # The starting centroids: one vector per cluster.
    first = vectors.select(_name(seed).alias("name"), "data").orderBy("name", "data").limit(clusters).collect()
    k = len(first)
    history = np.array([[unpacked(bytes(r["data"]), dim) for r in first]], np.int64).reshape(1, k, dim)
    start = [F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields[2:]]
    state = vectors.select("vec_id", "data", *start)
    if k:
        for at in range(rounds + 1):
            now, written = stored_at(one_round(state.select(STATE.names), history, at == rounds), f"round{at}")
            discard(spark, path)
            path, state = written, now.where("n IS NULL")
            if at < rounds:
                history = np.concatenate([history, centroids_after(now, history[-1])[None]])
    fit = lambda c: F.when(F.abs(c) <= F.lit(LONG).cast("decimal(38,0)"), c.cast("long"))
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    per_cluster = state.groupBy("cluster").agg(whole.alias("s"), F.count_if(F.col("distance").isNull()).alias("over")).collect() if k else []
    total = sum(int(r["s"] or 0) for r in per_cluster)
    none_over = not any(r["over"] for r in per_cluster)
    # One row per cluster.
    notes = [
        (
            r["cluster"],
            _long(r["s"]) if not r["over"] else None,
            _long(total) if none_over else None,
            hashlib.sha256(",".join(map(str, history[-1][r["cluster"]].tolist())).encode()).hexdigest(),
        )
        for r in per_cluster
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    named = state.select("vec_id", "cluster", "distance").join(F.broadcast(spark.createDataFrame(notes, schema)), "cluster")
    return named.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), history[-1]


def op12_centroid_clusters(spark, folder: str) -> DataFrame:
    return cluster_vectors(table(spark, folder, "embeddings"))[0]


def _oracle() -> str:
    """The rounds written out one after the other."""
    near = lambda c: f"""SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d
        FROM v JOIN {c} c ON c.i = v.i GROUP BY v.r, c.k) GROUP BY r"""  # noqa: E731
    parts = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIM}
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT r, i, floor({SCALE} * embedding[i]::double)::hugeint AS x FROM e, range(1, {DIM + 1}) t(i))",
        f"""h AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), r) - 1 AS k FROM e)""",
        f"c0 AS MATERIALIZED (SELECT k, i, x FROM v JOIN h USING (r) WHERE k < {CLUSTERS})",
    ]
    for t in range(ROUNDS):
        parts += [
            f"a{t} AS MATERIALIZED ({near(f'c{t}')})",
            f"""c{t + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (SELECT k, i, (sum(x) - ((sum(x) %
            count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{t} JOIN v USING (r) GROUP BY k, i) m USING (k, i))""",
        ]
    return f"""WITH {", ".join(parts)}, f AS MATERIALIZED ({near(f"c{ROUNDS}")}),
      s AS (SELECT k, sha256(string_agg(x::varchar, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
      SELECT vec_id, k::int AS cluster, d::bigint AS distance, (sum(d) OVER (PARTITION BY k))::bigint AS cluster_inertia,
        (sum(d) OVER ())::bigint AS inertia, centroid_sha256 FROM f JOIN e USING (r) JOIN s USING (k)"""


QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
ORACLES = {"op12_centroid_clusters": _oracle()}
