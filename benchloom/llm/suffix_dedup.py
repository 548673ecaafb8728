"""Exact removal of repeated substrings with a sparse suffix array over all documents.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id.

Sorting all suffixes of the corpus would move fifty times its size.  Only suffixes at anchors are sorted: every
window of ``length`` bytes picks the ``gram``-byte string in it with the least hash, so equal windows pick the
same anchor wherever they stand.  The steps:

1. Hashes of the anchors' grams are gathered; anchors whose gram stands in one document only are left out
   (a hash that two grams share keeps them, which later steps put right).
2. Documents meet their remaining anchors again.  An anchor's context is the part of the text its windows cover.
   Equal contexts of one block of documents are settled there, which keeps hot passages small.
3. A suffix starts at the anchor and goes on, beyond its end, with the bytes before the anchor in reverse order.
   Splitters from a bounded sample range-partition the suffixes by their leading bytes; a hot gram spans many
   buckets.  A bucket is sorted by multikey quicksort, eight bytes to a character, ties going on to the next.
4. The common prefixes of neighbours give, for every shift of the window, classes of equal windows and so the
   smallest document of each.  Grams that reach across a splitter are compared across the boundaries: their
   windows are grouped over all buckets.
5. Documents meet their removed spans.

Defined results: a null text is an empty one; a null id counts as larger than any other; rows that repeat an id
remove nothing from each other; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import scaled_parts, stored, table

#: Bytes of a gram (a multiple of 8).
GRAM = 24
#: Bytes of text in one block of documents, anchors in one bucket, suffixes in one bucket.
BLOCK_BYTES, BUCKET_ANCHORS = 10 << 20, 1_500_000
#: Bytes hashed at once, anchors packed together, and documents of the sample for splitters.
CHUNK = 1 << 18
PACKED_ANCHORS = 500_000
#: Suffixes of a block or bucket that are sorted at once.
SLICE = 150_000
SAMPLE_DOCS = 4_000
NO_ID = np.iinfo(np.int64).max


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes of ``data``."""
    power, inverse = _powers(CHUNK + 64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """In parts: text number, anchor, first and last window start, gram hash - of every anchor of every text."""
    step = CHUNK - length
    parts: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), step):
            piece = t[at : at + step + length - 1]
            if held + len(piece) > CHUNK:
                yield _anchors(parts, length)
                parts, held = [], 0
            parts.append((i, at, piece))
            held += len(piece)
    if parts:
        yield _anchors(parts, length)


def _anchors(parts: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.cumsum(sizes) - sizes
    h = gram_hashes(data, GRAM)
    # The low bits hold the place: a minimum is the leftmost gram with the least leading bits.
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), sizes)
    valid = np.nonzero(part[: len(at)] == part[length - 1 : length - 1 + len(at)])[0]
    at = at[valid]
    first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    where = at[first]
    own = part[where]
    shift = np.array([p[1] for p in parts])[own] - begin[own]
    number = np.array([p[0] for p in parts])[own]
    return number, where + shift, valid[first] + shift, valid[last] + shift, h[where]


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(blobs, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of several blobs of rows, one after another."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    counts = [zstandard.frame_content_size(blob) // width for blob in blobs]
    out = [np.empty(sum(counts), k) for k in kinds]
    begin = 0
    for blob, n in zip(blobs, counts):
        raw, at = zstandard.decompress(blob), 0
        for o, k in zip(out, kinds):
            o[begin : begin + n] = np.frombuffer(raw, k, n, at)
            at += n * np.dtype(k).itemsize
        begin += n
    return out


#: Bits of a gram's hash that a bucket compares, besides those that chose the bucket.  A bucket holds a bounded
#: number of anchors, so few meet by chance at any scale, and those that do are sorted out later.
HASH_BYTES = 5


def _pack_anchors(h: np.ndarray, marks: np.ndarray, number: np.ndarray, at: np.ndarray) -> bytes:
    """Anchors in order of document and place: each document once, then differences."""
    new = np.concatenate([[True], number[1:] != number[:-1]])
    runs = np.diff(np.append(np.nonzero(new)[0], len(number)))
    step = np.where(new, at, np.diff(at, prepend=0)).astype("<i4")
    short = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    planes = [*short.T, *step.view(np.uint8).reshape(-1, 4).T]
    head = np.array([len(runs), len(number)], "<i8")
    return zstandard.compress(
        b"".join(np.ascontiguousarray(a).tobytes() for a in [head, marks[number[new]], runs.astype("<i4"), *planes]), 1
    )


def _unpack_anchors(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, mark and place of every anchor."""
    raw = zstandard.decompress(blob)
    docs, n = np.frombuffer(raw, "<i8", 2).tolist()
    marks = np.frombuffer(raw, "<i8", docs, 16)
    runs = np.frombuffer(raw, "<i4", docs, 16 + 8 * docs)
    planes = np.frombuffer(raw, np.uint8, (HASH_BYTES + 4) * n, 16 + 12 * docs).reshape(HASH_BYTES + 4, n)
    h = np.zeros((n, 8), np.uint8)
    h[:, :HASH_BYTES] = planes[:HASH_BYTES].T
    total = np.cumsum(np.ascontiguousarray(planes[HASH_BYTES:].T).view("<i4")[:, 0].astype(np.int64))
    begin = np.cumsum(runs) - runs
    # Steps start anew with each document: what had been added up before its first place is taken off.
    first = np.ascontiguousarray(planes[HASH_BYTES:, begin].T).view("<i4")[:, 0]
    at = total - np.repeat(total[begin] - first, runs)
    return h.view("<u8")[:, 0], np.repeat(marks, runs), at.astype("<i4")


def _texts(frame: pd.DataFrame) -> list[bytes]:
    return [b"" if t is None else t for t in frame["text"]]


def _ids(frame: pd.DataFrame) -> np.ndarray:
    return frame["id"].to_numpy(np.int64)


def _by(groups: np.ndarray, count: int) -> list[tuple[int, np.ndarray]]:
    """Places of each group, in their order."""
    order = np.argsort(groups, kind="stable")
    cuts = np.searchsorted(groups[order], np.arange(count + 1))
    return [(g, order[cuts[g] : cuts[g + 1]]) for g in range(count) if cuts[g] < cuts[g + 1]]


def _block_of(mark: np.ndarray, blocks: int) -> np.ndarray:
    return ((mark.view(np.uint64) >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words: sorted by a word, only ties go on to the next one."""
    order = np.argsort(words[:, 0], kind="stable")
    rank = np.zeros(len(order), np.int64)
    for depth in range(1, words.shape[1] + 1):
        column = words[order, depth - 1]
        new = np.ones(len(order), bool)
        new[1:] = (column[1:] != column[:-1]) | (rank[1:] != rank[:-1])
        rank = np.cumsum(new)
        if depth == words.shape[1]:
            break
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.nonzero(tied)[0]
        if not len(tied):
            break
        order[tied] = order[tied][np.lexsort((words[order[tied], depth], rank[tied]))]
    return order


def _words(data: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 8-byte words, padded with zeros."""
    width = -(-data.shape[1] // 8) * 8
    padded = np.zeros((len(data), width), np.uint8)
    padded[:, : data.shape[1]] = data
    return padded.view(">u8").astype(np.uint64)


def leading_words(texts: list[bytes], number: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes of every anchor's gram, as numbers in the order of the bytes."""
    sizes = np.array([len(t) for t in texts])
    place = (np.cumsum(sizes) - sizes)[number] + at
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | data[place + i]
    return out


def slices(words: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the words, range by range, each of about ``size``; equal words stay together."""
    order = np.argsort(words, kind="stable")
    cuts = np.searchsorted(words[order], np.unique(words[order[size::size]]))
    return [own for own in np.split(order, cuts) if len(own)]


def _common(data: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before; -1 for the first."""
    differ = data[1:] != data[:-1]
    out = np.where(differ.any(axis=1), differ.argmax(axis=1), data.shape[1])
    return np.concatenate([[-1], out])


def contexts(texts: list[bytes], number: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """For every anchor its suffix bytes, then the bytes before it backward; zeros where no window reaches."""
    reach = length - GRAM
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes + reach
    data = np.concatenate([np.zeros(reach, np.uint8), np.frombuffer(b"".join(texts), np.uint8), np.zeros(length, np.uint8)])
    base = begin[number]
    offsets = np.concatenate([np.arange(length), -1 - np.arange(reach)])
    out = np.empty((len(at), length + reach), np.uint8)
    for s in range(0, len(at), 1 << 13):
        a, b = at[s : s + (1 << 13), None], base[s : s + (1 << 13), None]
        place = a + offsets[None, :]
        inside = (place >= lo[s : s + (1 << 13), None]) & (place < hi[s : s + (1 << 13), None] + length)
        out[s : s + (1 << 13)] = np.where(inside, data[np.where(inside, place + b, 0)], 0)
    return out


def shared_windows(data: np.ndarray, before: np.ndarray, after: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes the least and the largest shift of a window that a smaller document holds too
    (-1: none).  ``before`` and ``after`` are the shifts that windows of the anchor have."""
    reach = length - GRAM
    first = np.full(len(data), -1, np.int64)
    last = np.full(len(data), -1, np.int64)
    right = _common(data[:, :length])
    left_words = _words(data[:, length:])
    left_order = multikey_order(left_words)
    left = _common(data[left_order, length:])
    for shift in range(reach + 1):
        # Rows that agree in the gram and the bytes behind it, and in the bytes before it.
        behind = np.cumsum(right < length - shift)
        ahead = np.empty(len(data), np.int64)
        ahead[left_order] = np.cumsum(left < shift)
        own = np.nonzero((before >= shift) & (after <= shift))[0]
        if len(own) < 2:
            continue
        key = behind[own] * (len(data) + 1) + ahead[own]
        order = np.lexsort((ids[own], key))
        key, sorted_ids = key[order], ids[own][order]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        least = sorted_ids[np.nonzero(start)[0]][np.cumsum(start) - 1]
        hit = own[order[least < sorted_ids]]
        first[hit] = np.where(first[hit] < 0, shift, first[hit])
        last[hit] = shift
    return first, last


SUFFIX = ["<i8", "<i8", "<i4", "u1", "u1"]


def repeated_spans(
    docs: DataFrame,
    length: int = 50,
    block_bytes: int = BLOCK_BYTES,
    bucket_anchors: int = BUCKET_ANCHORS,
    at_once: int = SLICE,
) -> DataFrame:
    """``doc_id``, ``text``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes), ``kept_sha256``."""
    spark = docs.sparkSession
    given = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"),
        "text",
        F.xxhash64("doc_id", "text").alias("mark"),  # with the id it names a row
    )
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = scaled_parts(size, block_bytes)
    buckets = scaled_parts(2 * size // (length - GRAM + 2), bucket_anchors)

    # 1. Anchors whose gram stands in several documents.
    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, marks = _texts(frame), frame["mark"].to_numpy(np.int64)
            held: list[tuple[np.ndarray, ...]] = []

            def emit() -> pd.DataFrame:
                number, at, h = (np.concatenate(c) for c in zip(*held))
                held.clear()
                rest = h // np.uint64(buckets)
                out = [
                    (bucket, _pack_anchors(rest[own], marks, number[own], at[own]))
                    for bucket, own in _by((h % np.uint64(buckets)).astype(np.int64), buckets)
                ]
                return pd.DataFrame(out, columns=["bucket", "data"])

            for number, at, _, _, h in anchors(texts, length):
                held.append((number.astype("<i4"), at.astype("<i4"), h))
                if sum(len(n) for n, _, _ in held) > PACKED_ANCHORS:
                    yield emit()
            if held:
                yield emit()

    def repeated(frame: pd.DataFrame) -> pd.DataFrame:
        h, marks, at = (np.concatenate(c) for c in zip(*map(_unpack_anchors, frame["data"])))
        order = np.argsort(h, kind="stable")
        h, sorted_marks = h[order], marks[order]
        start = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
        several = np.minimum.reduceat(sorted_marks, start) < np.maximum.reduceat(sorted_marks, start)
        own = np.sort(order[np.repeat(several, np.diff(np.append(start, len(h))))])
        marks, at = marks[own], at[own]
        return pd.DataFrame(
            [(b, "anchor", _pack(marks[p], at[p])) for b, p in _by(_block_of(marks, blocks), blocks)],
            columns=["block", "kind", "data"],
        )

    # As bytes, so a worker holds a text once.
    texts_only = given.select("id", F.col("text").cast("binary").alias("text"), "mark")
    wanted = (
        texts_only.mapInPandas(gather, "bucket long, data binary")
        .groupBy("bucket")
        .applyInPandas(repeated, "block long, kind string, data binary")
    )

    # Documents in blocks, packed.
    def pack_docs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, ids, marks = _texts(frame), _ids(frame), frame["mark"].to_numpy(np.int64)
            out = []
            for block, own in _by(_block_of(marks, blocks), blocks):
                sizes = np.array([len(texts[i]) for i in own], np.int64)
                head = np.concatenate([[len(own)], ids[own], marks[own], sizes]).astype("<i8").tobytes()
                out.append((block, zstandard.compress(head + b"".join(texts[i] for i in own), 3)))
            yield pd.DataFrame(out, columns=["block", "data"])

    def unpack_docs(blobs) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        ids, marks, texts = [], [], []
        for blob in blobs:
            raw = zstandard.decompress(blob)
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            head = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
            ids.append(head[0])
            marks.append(head[1])
            at = 8 + 24 * n
            for s in head[2].tolist():
                texts.append(raw[at : at + s])
                at += s
        none = [np.zeros(0, np.int64)]
        return np.concatenate(ids or none), np.concatenate(marks or none), texts

    packed = texts_only.mapInPandas(pack_docs, "block long, data binary")

    # Splitters: leading bytes of the suffixes of a bounded sample of documents.
    every = max(1, rows // SAMPLE_DOCS)

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = _texts(frame)
            for number, at, lo, hi, h in anchors(texts, length):
                some = np.nonzero(h % np.uint64(16) == 0)[0][:4096]
                found = contexts(texts, number[some], at[some], lo[some], hi[some], length)
                yield pd.DataFrame({"suffix": [r.tobytes() for r in found]})

    drawn = texts_only.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(every)) == 0).mapInPandas(sample, "suffix binary")
    drawn = sorted(bytes(r[0]) for r in drawn.limit(200_000).collect())
    splitters = [drawn[len(drawn) * i // buckets] for i in range(1, buckets)] if drawn else []
    shared_grams = {s[:GRAM] for s in splitters}

    # 2. Contexts; equal ones of a block are settled, the others go to the buckets of the suffix order.
    width = 2 * length - GRAM

    def prepare(block_docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "place", "data"]
        if not len(found) or not len(block_docs):
            return pd.DataFrame([], columns=columns)
        ids, marks, texts = unpack_docs(block_docs["data"])
        marks_wanted, at_wanted = _unpack(found["data"], ["<i8", "<i4"])
        order = np.argsort(marks, kind="stable")
        # A wanted anchor as (number of its document among the marks, place).
        known = np.unique(marks)
        wanted_keys = np.unique(np.searchsorted(known, marks_wanted).astype(np.int64) << 32 | at_wanted)
        dense = np.searchsorted(known, marks)
        with_some = np.zeros(len(known), bool)
        with_some[wanted_keys >> 32] = True
        use = [i for i in order.tolist() if with_some[dense[i]]]
        sub = [texts[i] for i in use]
        pieces = []
        for number, at, lo, hi, _ in anchors(sub, length):
            own = np.array(use)[number]
            keys = dense[own] << 32 | at
            spot = np.minimum(np.searchsorted(wanted_keys, keys), len(wanted_keys) - 1)
            keep = wanted_keys[spot] == keys
            pieces.append((number[keep], at[keep], lo[keep], hi[keep]))
        number, at, lo, hi = (np.concatenate(c) for c in zip(*pieces))
        row = np.array(use)[number]
        block = int(block_docs["block"].iloc[0])
        cuts = np.array(splitters, f"S{width}")
        out = []
        # Equal contexts begin with equal bytes, so they are in one slice.
        for part in slices(leading_words(sub, number, at), at_once):
            data = contexts(sub, number[part], at[part], lo[part], hi[part], length)
            before, after = (at[part] - lo[part]).astype(np.uint8), (at[part] - hi[part]).astype(np.uint8)
            whole = np.concatenate([data, before[:, None], after[:, None]], axis=1)
            order = multikey_order(_words(whole))
            whole = whole[order]
            start = np.concatenate([[True], (whole[1:] != whole[:-1]).any(axis=1)])
            del whole
            part = part[order]
            owner = ids[row[part]]
            least = np.minimum.reduceat(owner, np.nonzero(start)[0])[np.cumsum(start) - 1]
            later = owner > least
            gone = part[later]
            if len(gone):
                out.append(("span", block, _pack(marks[row[gone]], lo[gone], hi[gone] + length)))
            stay, part = order[~later], part[~later]
            data, before, after = data[stay], before[stay], after[stay]
            place = np.searchsorted(cuts, data.view(f"S{width}")[:, 0], side="right")
            for bucket, own in _by(place, buckets):
                p = part[own]
                out.append(
                    ("suffix", bucket, _pack(ids[row[p]], marks[row[p]], at[p].astype("<i4"), before[own], after[own], data[own]))
                )
        return pd.DataFrame(out, columns=columns)

    ready = stored(
        packed.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(prepare, "kind string, place long, data binary"),
        "suffixes",
    )

    # 3. and 4. Sort a bucket, find the shared windows.
    def sort_slice(ids, marks, at, before, after, data, out: list[tuple]) -> None:
        order = multikey_order(_words(data))
        ids, marks, at, before, after, data = (a[order] for a in (ids, marks, at, before, after, data))
        same = _common(data[:, :GRAM]) >= GRAM
        start = np.nonzero(~same)[0]
        group = np.cumsum(~same) - 1
        across = np.array([data[s, :GRAM].tobytes() in shared_grams for s in start])[group]
        several = (np.minimum.reduceat(ids, start) < np.maximum.reduceat(ids, start))[group] & ~across
        own = np.nonzero(several)[0]
        if len(own):
            first, last = shared_windows(data[own], before[own], after[own], ids[own], length)
            hit = np.nonzero(first >= 0)[0]
            lo, hi, marks_hit = at[own[hit]] - last[hit], at[own[hit]] - first[hit] + length, marks[own[hit]]
            for block, p in _by(_block_of(marks_hit, blocks), blocks):
                out.append(("span", block, _pack(marks_hit[p], lo[p], hi[p]), None, None))
        for i in np.nonzero(across)[0].tolist():
            left = data[i, length:][::-1]
            text = np.concatenate([left, data[i, :length]]).tobytes()
            reach = length - GRAM
            for shift in range(int(after[i]), int(before[i]) + 1):
                window = text[reach - shift : reach - shift + length]
                block = int(_block_of(marks[i : i + 1], blocks)[0])
                spot = np.array([at[i] - shift], np.int64)
                out.append(("window", block, _pack(marks[i : i + 1], spot, spot + length), window, int(ids[i])))

    def sort_bucket(frame: pd.DataFrame) -> pd.DataFrame:
        kinds = [*SUFFIX, f"V{width}"]
        ids, marks, at, before, after, data = _unpack(frame["data"], kinds)
        data = data.view(np.uint8).reshape(-1, width)
        lead = np.ascontiguousarray(data[:, :8]).view(">u8")[:, 0].astype(np.uint64)
        out = []
        # Suffixes that begin with equal grams are in one slice.
        for part in slices(lead, at_once):
            sort_slice(ids[part], marks[part], at[part].astype(np.int64), before[part], after[part], data[part], out)
        kind, place, packed_spans, window, owner = zip(*out) if out else ((),) * 5
        return pd.DataFrame(
            {"kind": kind, "place": place, "data": packed_spans, "window": window, "id": pd.array(owner, "Int64")}
        )

    sorted_out = stored(
        ready.where("kind = 'suffix'")
        .groupBy("place")
        .applyInPandas(sort_bucket, "kind string, place long, data binary, window binary, id long"),
        "sorted",
    )
    windows = sorted_out.where("kind = 'window'")
    least = windows.groupBy("window").agg(F.min("id").alias("least"))
    across = windows.join(least, "window").where("id > least")
    spans = (
        ready.where("kind = 'span'")
        .select(F.col("place").alias("block"), "data")
        .unionByName(sorted_out.where("kind = 'span'").select(F.col("place").alias("block"), "data"))
        .unionByName(across.select(F.col("place").alias("block"), "data"))
    )

    # 5. Cut the documents.
    def cut(block_docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids, marks, texts = unpack_docs(block_docs["data"])
        m, lo, hi = _unpack(found["data"], ["<i8", "<i8", "<i8"])
        order = np.lexsort((lo, m))
        m, lo, hi = m[order], lo[order], hi[order]
        begin, end = np.searchsorted(m, marks, "left"), np.searchsorted(m, marks, "right")
        out = []
        for i, text in enumerate(texts):
            kept, at, removed, runs = [], 0, 0, 0
            if end[i] > begin[i]:
                l, h = lo[begin[i] : end[i]], np.maximum.accumulate(hi[begin[i] : end[i]])
                new = np.nonzero(np.concatenate([[True], l[1:] > h[:-1]]))[0]
                for a, b in zip(l[new].tolist(), h[np.append(new[1:] - 1, len(h) - 1)].tolist()):
                    kept.append(text[at:a])
                    at, removed, runs = b, removed + b - a, runs + 1
            kept = b"".join([*kept, text[at:]])
            out.append((ids[i], len(text), removed, runs, kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    done = packed.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(
        cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )
    return done.select(F.expr(f"nullif(id, {NO_ID}L)").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def op10_suffix_dedup(spark, folder: str) -> DataFrame:
    return repeated_spans(table(spark, folder, "documents")).drop("kept")


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
