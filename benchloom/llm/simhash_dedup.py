"""Near duplicates by SimHash, found with vantage-point trees.

Fingerprints of word shingles are made in one scan and collapsed, so equal ones are one point from then on.  A
tree over a bounded sample splits the fingerprints by Hamming distance to vantage points.  At each node a point
within the radius goes left; a point up to ``distance`` beyond it goes both ways, since by the triangle
inequality a partner of a left point lies no further.  So every close pair meets in at least one shard, and no
pair further apart than that has to be looked at.  Each shard goes on splitting in the same way until a few
points are left, which are compared directly.  A shard gives a spanning forest of its pairs, not all of them.

Defined results: words are runs of anything but space and 09-0D; a text without words or a null text has
fingerprint zero, linked like any other; the component of a document is the smallest non-null id reachable;
repeated rows come out as often as they came in; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import components, scaled_parts, stored, table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Points of one shard (copies at the borders aside) and of the sample that the tree is built on, per shard.
SHARD_POINTS = 20_000
SAMPLE_PER_SHARD = 64
#: With more points than so many shards hold, shards grow; a shard of a million points is 8 MB and splits itself.
MOST_SHARDS = 1 << 15
#: Sets of so few points are compared directly.
SMALL = 192


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if over half of the shingle hashes have it."""
    found = WORD.findall((text or "").encode().translate(LOWER))
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        # One buffer of words with single spaces; a shingle is a slice of it.
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(begins[: 1 - words].tolist(), ends[words - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], "<u8")
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(2 * counts > len(hashes))[0].tolist())


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed number)."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([fingerprint(t, words) for t in frame["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(make, "doc_id long, fp long")


def _split(points: np.ndarray, vantage: np.uint64, distance: int) -> tuple[int, np.ndarray]:
    """The radius around ``vantage`` that leaves the smaller larger half, borders counted, and the distances."""
    d = np.bitwise_count(points ^ vantage).astype(np.int64)
    below = np.cumsum(np.bincount(d, minlength=65 + distance))
    left = np.concatenate([below[distance:], np.repeat(below[-1], distance)])[: len(below)]
    worst = np.maximum(left, below[-1] - below)
    return int(np.argmin(worst)), d


def build_tree(sample: np.ndarray, shards: int, distance: int, seed: int = 5) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage, radius, left, right)``; a child below zero is the shard ``-1 - child``."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int, int, int]] = []
    made = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal made
        best = None
        if want > 1 and len(points) > 2:
            for vantage in rng.choice(points, 8):
                radius, d = _split(points, vantage, distance)
                left, right = (d <= radius + distance).sum(), (d > radius).sum()
                if max(left, right) < len(points) and (best is None or left + right < best[0]):
                    best = (left + right, vantage, radius, d)
        if best is None:
            made += 1
            return -made
        _, vantage, radius, d = best
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        near, far = points[d <= radius + distance], points[d > radius]
        share = min(max(round(want * len(near) / (len(near) + len(far))), 1), want - 1)
        nodes[at] = (int(vantage), radius, grow(near, share), grow(far, want - share))
        return at

    grow(sample, shards)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Every shard of every point, as places in ``points`` and shards."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    places, shards, todo = [], [], [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if at < 0:
            places.append(own)
            shards.append(np.full(len(own), -1 - at))
            continue
        vantage, radius, left, right = nodes[at]
        d = np.bitwise_count(points[own] ^ np.uint64(vantage))
        todo += [(left, own[d <= radius + distance]), (right, own[d > radius])]
    return np.concatenate(places), np.concatenate(shards)


def close_pairs(points: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of ``points`` (distinct) at most ``distance`` bits apart, each at least once."""
    rng = np.random.default_rng(len(points))
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) > SMALL:
            best = None
            for vantage in rng.choice(points[own], 4):
                radius, d = _split(points[own], vantage, distance)
                near, far = own[d <= radius + distance], own[d > radius]
                if max(len(near), len(far)) < 0.9 * len(own) and (best is None or len(near) + len(far) < best[0]):
                    best = (len(near) + len(far), near, far)
            if best:
                todo += [best[1], best[2]]
                continue
        # A set that no radius divides is compared block by block.
        for i in range(0, len(own), 1024):
            for j in range(i, len(own), 1024):
                a, b = own[i : i + 1024], own[j : j + 1024]
                x, y = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= distance)
                keep = (x < y) if i == j else slice(None)
                yield a[x[keep]], b[y[keep]]


class Forest:
    """Disjoint sets of places; joining keeps one link per place at most."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> tuple[list[int], list[int]]:
        """Every place that is not a root, and its root."""
        own = [i for i in range(len(self.up)) if self.up[i] != i]
        return own, [self.root(i) for i in own]


def near_groups(prints: DataFrame, distance: int = 2, shard_points: int = SHARD_POINTS) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of every row of ``prints`` (``doc_id``, ``fp``)."""
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    shards = min(scaled_parts(points.count(), shard_points), MOST_SHARDS)
    nodes: list[tuple[int, int, int, int]] = []
    if shards > 1:
        # A random sample of at most SAMPLE_PER_SHARD * MOST_SHARDS points; it only shapes the tree.
        sample = points.orderBy(F.xxhash64("fp", F.lit(1))).limit(shards * SAMPLE_PER_SHARD).select("fp").collect()
        nodes = build_tree(np.array([r[0] for r in sample], np.int64).view(np.uint64), shards, distance)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame["fp"].to_numpy(np.int64).view(np.uint64)
            place, shard = route(nodes, values, distance)
            yield pd.DataFrame({"shard": shard, "fp": frame["fp"].to_numpy()[place]})

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(frame["fp"].to_numpy(np.int64).view(np.uint64))
        forest = Forest(len(values))
        for a, b in close_pairs(values, distance):
            for x, y in zip(a.tolist(), b.tolist()):
                forest.join(x, y)
        own, roots = forest.links()
        signed = values.view(np.int64)
        return pd.DataFrame({"u": signed[own], "v": signed[roots]})

    edges = points.select("fp").mapInPandas(deal, "shard long, fp long").groupBy("shard").applyInPandas(link, "u long, v long")
    groups = components(edges)
    named = (
        groups.join(points, groups["node"] == points["fp"])
        .groupBy("component")
        .agg(F.min("first_id").alias("component_id"))
    )
    classes = (
        points.join(groups.join(named, "component"), points["fp"] == F.col("node"), "left")
        .select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    )
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, ``kept`` of every document."""
    found = near_groups(stored(fingerprints(docs, words), "fingerprints"), distance)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """The documents without near duplicates: of each group the row with the smallest id stays, with all its
    columns.  Rows that repeat that id are copies; one of them stays."""
    marked = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "docs")
    found = near_groups(
        stored(fingerprints(marked.select(F.col("__row").alias("doc_id"), "text"), words), "fingerprints"), distance
    ).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    ids = marked.select("__row", "doc_id").join(found, "__row")
    first = ids.groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row")).alias("m"))
    return marked.join(first.select(F.col("m.__row").alias("__row")), "__row", "left_semi").drop("__row")


def op9_simhash_dedup(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


QUERIES = {"op9_simhash_dedup": op9_simhash_dedup}
