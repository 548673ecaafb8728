"""Benchmark passages in training documents: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of an item is a seed, since an edit leaves no more than the n-grams it does not touch, and those may
be the common ones.  One scan finds the seeds in every document and gathers hits of one item on neighbouring
diagonals to a window.  A window in which too few of the item's words stand cannot reach the score - no more words
match than stand there - and is left out; the item's words are aligned with the words of every other.  The best
alignment of a document and an item counts if its score reaches a share of the score of an exact copy, so edits,
gaps and insertions are tolerated as long as n words in a row are left.

The benchmark goes to the tasks in chunks of bounded size; a larger benchmark takes more scans.  Documents never
move.

Defined results: words are runs of letters and digits in lower case (signs beyond ASCII count as letters); null and empty texts match nothing; an item
with fewer words than an n-gram is one seed; an item without words matches nothing; items with a null id are
compared like others; repeated rows come out as often as they came in; other columns are ignored; an empty table
on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import stored, table
from benchloom.llm.suffix_dedup import CHUNK, _powers

N_GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an exact copy's score.
LEAST_SCORE = 0.5
#: Bytes of benchmark texts in one broadcast.
CHUNK_BYTES = 32 << 20
#: Windows aligned at once.
TOGETHER = 1024

IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    IS_WORD[_c] = True


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and 64-bit hash of every word of at most CHUNK bytes."""
    power, inverse = _powers(CHUNK + 64)
    raw = np.frombuffer(data + b" ", np.uint8)
    edge = np.diff(IS_WORD[raw].astype(np.int8), prepend=0)
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[begin]) * inverse[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return begin, h


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words (a word over a whole piece is cut)."""
    at = 0
    while at < len(data):
        stop = min(at + CHUNK // 2, len(data))
        back = stop
        while stop < len(data) and back > at and IS_WORD[data[back - 1]]:
            back -= 1
        stop = back if back > at else stop
        yield data[at:stop]
        at = stop


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The hash of each word of each text; short texts are hashed together."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        begin, h = _hash_words(b" ".join(p for _, p in held))
        cuts = np.searchsorted(begin, np.cumsum([len(p) + 1 for _, p in held])).tolist()
        for (i, _), a, b in zip(held, [0, *cuts], cuts):
            out[i] = h[a:b]
        held.clear()

    for i, text in enumerate(texts):
        data = text.lower().encode() if isinstance(text, str) else b""
        if len(data) > CHUNK // 2:
            out[i] = np.concatenate([_hash_words(p)[1] for p in _pieces(data)])
            continue
        if size + len(data) + 1 > CHUNK:
            flush()
            size = 0
        held.append((i, data))
        size += len(data) + 1
    if held:
        flush()
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return out ^ np.uint64(n)


class Benchmark:
    """One chunk of items: their words and the n-grams that stand in them."""

    def __init__(self, ids: list, texts: list[str | None], n: int):
        self.ids, self.n = ids, n
        self.words = word_hashes(texts)
        item, place, gram, width = [], [], [], []
        for i, w in enumerate(self.words):
            k = min(n, len(w))
            if k:
                g = grams(w, k)
                item.append(np.full(len(g), i))
                place.append(np.arange(len(g)))
                gram.append(g)
                width.append(k)
        none = [np.zeros(0, np.int64)]
        self.item, self.place = np.concatenate(item or none), np.concatenate(place or none)
        self.widths = sorted(set(width))
        self._index(np.concatenate(gram or [np.zeros(0, np.uint64)]))
        # The items' words by number.
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.numbers = [np.searchsorted(self.known, w) for w in self.words]

    def _index(self, gram: np.ndarray) -> None:
        order = np.argsort(gram, kind="stable")
        self.item, self.place, gram = self.item[order], self.place[order], gram[order]
        self.gram, first = np.unique(gram, return_index=True)
        self.first = np.append(first, len(gram))
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.gram & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` and the numbers of the grams that stand there."""
        places, numbers = [], []
        for k in self.widths:
            g = grams(words, k)
            maybe = np.nonzero(self.table[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])[0]
            spot = np.minimum(np.searchsorted(self.gram, g[maybe]), len(self.gram) - 1)
            hit = self.gram[spot] == g[maybe]
            places.append(maybe[hit])
            numbers.append(spot[hit])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(places or none), np.concatenate(numbers or none)

    def shared(self, words: np.ndarray, windows: list[tuple[int, int, int]]) -> list[int]:
        """Of each window (item, begin, end) in ``words``, how many places of the item hold a word of the window."""
        number = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        number = np.where(self.known[number] == words, number, len(self.known))
        here, out = np.zeros(len(self.known) + 1, bool), []
        for item, begin, end in windows:
            own = number[begin:end]
            here[own] = True
            here[-1] = False
            out.append(int(np.count_nonzero(here[self.numbers[item]])))
            here[own] = False
        return out


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its window, and the window place where it ends."""
    rows, width = max(map(len, items)), max(map(len, windows))
    a = np.zeros((len(items), rows), np.uint64)
    b = np.zeros((len(items), width), np.uint64)
    live = np.zeros((len(items), rows), bool)
    inside = np.zeros((len(items), width), bool)
    for i, (x, y) in enumerate(zip(items, windows)):
        a[i, : len(x)], live[i, : len(x)] = x, True
        b[i, : len(y)], inside[i, : len(y)] = y, True
    slope = (-GAP) * np.arange(width, dtype=np.int32)
    score = np.zeros((len(items), width + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for r in range(rows):
        same = np.where((a[:, r : r + 1] == b) & live[:, r : r + 1] & inside, MATCH, MISMATCH).astype(np.int32)
        now = np.maximum(score[:, :-1] + same, score[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        # A gap in the item: the best score further left, less its length.
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        top = now.argmax(axis=1)
        value = now[np.arange(len(now)), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
        score[:, 1:] = now
    return best, end


def _windows(hits: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From hits (place, gram number): item, begin and end of every window to align."""
    counts = np.diff(bench.first)[hits[1]]
    entry = np.repeat(bench.first[:-1][hits[1]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    item, diagonal = bench.item[entry], np.repeat(hits[0], counts) - bench.place[entry]
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    length = np.array([len(w) for w in bench.words])[item]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > length[1:] // 2)
    start = np.nonzero(new)[0]
    stop = np.append(start[1:], len(item)) - 1
    slack = length[start] // 2
    return item[start], np.maximum(diagonal[start] - slack, 0), diagonal[stop] + length[start] + slack


def contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, least: float = LEAST_SCORE, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` (share of an exact copy's), ``end_word`` of every contaminated document
    and the item it holds.  ``benchmark`` has ``item_id`` and ``text``."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk_bytes))
    out = None
    for c in range(chunks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c) if chunks > 1 else items
        rows = own.collect()  # about chunk_bytes, whatever the size of the benchmark
        bench = Benchmark([r[0] for r in rows], [r[1] for r in rows], n)
        found = _search(spark, texts, bench, least)
        out = found if out is None else out.unionByName(found)
    return out


def _search(spark, texts: DataFrame, bench: Benchmark, least: float) -> DataFrame:
    seeds = spark.sparkContext.broadcast(bench)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = seeds.value
        columns = ["doc_id", "item", "score", "end_word"]
        for frame in frames:
            todo, rows = [], []

            def settle():
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for doc, item, begin, score, end in _aligned(todo, b):
                    share = score / (MATCH * len(b.words[item]))
                    if share >= least and share > best.get((doc, item), (0.0, 0))[0]:
                        best[doc, item] = (share, begin + end)
                rows.extend((frame["doc_id"].iloc[d], i, s, e) for (d, i), (s, e) in best.items())
                todo.clear()

            for d, words in enumerate(word_hashes(frame["text"].tolist())):
                hits = b.find(words)
                if len(hits[0]):
                    windows = list(zip(*(x.tolist() for x in _windows(hits, b))))
                    for (item, begin, end), most in zip(windows, b.shared(words, windows)):
                        if most >= least * len(b.words[item]):
                            todo.append((d, item, begin, words[begin:end]))
                if len(todo) > 8 * TOGETHER:
                    settle()
            settle()
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    names = [(i, v) for i, v in enumerate(bench.ids)]
    found = texts.mapInPandas(search, "doc_id long, item long, score double, end_word long")
    # The chunk's ids: as bounded as the chunk.
    ids = spark.createDataFrame(names, "item long, item_id long")
    return found.join(F.broadcast(ids), "item").select("doc_id", "item_id", F.round("score", 6).alias("score"), "end_word")


def _aligned(todo: list, b: Benchmark) -> Iterator[tuple[int, int, int, int, int]]:
    """Windows of like length are aligned together."""
    todo.sort(key=lambda t: len(t[3]))
    at = 0
    while at < len(todo):
        # Fewer at once where windows are long.
        some = todo[at : at + max(1, min(TOGETHER, (1 << 18) // max(len(todo[at][3]), 1)))]
        limit = 2 * len(some[0][3]) + 64
        some = [t for t in some if len(t[3]) <= limit]
        best, end = align([b.words[t[1]] for t in some], [t[3] for t in some])
        for (doc, item, begin, _), score, e in zip(some, best.tolist(), end.tolist()):
            yield doc, item, begin, score, e
        at += len(some)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    marked = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "docs")
    hit = contaminated(marked.select(F.col("__row").alias("doc_id"), "text"), benchmark)
    hit = hit.select(F.col("doc_id").alias("__row")).distinct()
    return marked.join(hit, "__row", "left_anti").drop("__row")


def op5_decontamination(spark, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
