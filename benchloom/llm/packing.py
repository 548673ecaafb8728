"""Bounded-space online best-fit packing of token pieces into sequences of a fixed length.

Every document is tokenized whole and ends with an end id; longer ones are cut into full pieces and a rest.
Pieces are dealt by hash into groups of bounded size.  In a group they come one after another, the longest
first: a piece goes to the open bin with the least free space that holds it, found in a bitset keyed by free
space.  A fixed number of bins is open; when one more is needed, the fullest closes.  Bins that end a group
open and with room are dealt again, as whole items, to fewer groups, so the ends of groups cost no half-empty
sequences.

Defined results: a null text is an empty one (one piece, the end id); rows with a null ``doc_id`` are packed
as well; rows that repeat a ``doc_id`` are documents of their own; other columns are ignored; no rows give no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import scaled_parts, stored, table
from benchloom.llm.token_ids import token_ids

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
#: Tokens packed by one group.
GROUP_TOKENS = 1 << 23
OPEN_BINS = 8192
#: An open bin is dealt again if at least one part in so many of it is free.
ROOM = 16


def cut_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``size`` ids of every document: ``doc_id``, ``copy`` (tells rows of one id apart),
    ``piece``, ``start``, ``length``, ``ids_crc32``."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = token_ids(path), np.array([end_id], "<u4").tobytes()
        for frame in frames:
            rows = []
            for doc, copy, ids in zip(frame["doc_id"], frame["copy"], encoder.encode(frame["text"].tolist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, copy, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    # An id made by the row's place; it is fixed once the pieces are stored.
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("copy")).mapInPandas(cut, PIECES)


class OpenBins:
    """A fixed number of open bins; bit ``f`` of the bitset is set if some open bin has free space ``f``."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.bits, self.count = 0, 0
        self.bins: dict[int, list[int]] = {}
        self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset of an item of ``length``."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_id, free = self.made, self.size
            self.made += 1
        offset = self.size - free
        if free > length:
            self.bits |= 1 << (free - length)
            self.bins.setdefault(free - length, []).append(bin_id)
            self.count += 1
        return bin_id, offset

    def _take(self, free: int) -> int:
        held = self.bins[free]
        bin_id = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id


def _pack_group(size: int, limit: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "order", "item"], ascending=[False, True, True], kind="stable")
        bins = OpenBins(size, limit)
        placed = [bins.put(n) for n in frame["length"].tolist()]
        ids = np.array([p[0] for p in placed], np.int64)
        still = np.zeros(bins.made, bool)
        for held in bins.bins.values():
            still[held] = True
        fill = np.bincount(ids, weights=frame["length"], minlength=bins.made).astype(np.int64)
        return pd.DataFrame(
            {
                "item": frame["item"],
                "bin": (frame["grp"].to_numpy(np.int64) << 32) + ids,
                "offset": [p[1] for p in placed],
                "open": (still & (fill <= size - size // ROOM))[ids],
                "fill": fill[ids],
            }
        )

    return pack


def _round(items: DataFrame, groups: int, size: int, limit: int, seed: int) -> DataFrame:
    """Pack ``item``, ``length`` into bins: ``item``, ``bin``, ``offset``, ``open``, ``fill``."""
    dealt = items.select(
        "item",
        "length",
        F.xxhash64("item", F.lit(seed)).alias("order"),
        F.pmod(F.xxhash64("item", F.lit(seed + 1)), F.lit(groups)).alias("grp"),
    )
    return dealt.groupBy("grp").applyInPandas(
        _pack_group(size, limit), "item long, bin long, offset long, open boolean, fill long"
    )


def pack(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    end_id: int = 0,
    open_bins: int = OPEN_BINS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there."""
    pieces = stored(cut_pieces(docs, path, size, end_id), "pieces")
    # A document has at most one piece that is not full, so the document's number names it.
    full, rest = pieces.where(F.col("length") == size), pieces.where(F.col("length") < size).withColumnRenamed("copy", "item")
    total = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    first = stored(_round(rest, scaled_parts(total, group_tokens), size, open_bins, 11), "bins")
    halfway = first.where("open").groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("length"))
    left = halfway.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    second = _round(halfway, scaled_parts(left, group_tokens), size, open_bins, 23)
    moved = second.select(F.col("item").alias("bin"), F.col("bin").alias("to_bin"), F.col("offset").alias("base"))
    # Even numbers: closed in the first round; odd: bins made of open ones; full pieces lie below zero.
    placed = first.join(moved, "bin", "left").select(
        "item",
        F.when(F.col("to_bin").isNull(), F.col("bin") * 2).otherwise(F.col("to_bin") * 2 + 1).alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return (
        rest.join(placed, "item")
        .select(*keep, "sequence_id", "offset")
        .unionByName(
            full.select(
                *keep,
                (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
                F.lit(0).cast("long").alias("offset"),
            )
        )
    )


def op7_packing(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_packing": op7_packing}
