"""Token ids of whole texts in files of range asymmetric numeral codes, read back in parallel.

Two passes: the ids of every document are counted over the whole table, and one frequency table, scaled to a
power of two, is shared by all files.  Documents are then sorted by ``doc_id`` over the executors; each slice
becomes one file of independent blocks.  In a block many coder states take turns over the ids (interleaving),
so coding and decoding run over whole arrays.  A file ends with its index: for every block the first id, the
place of its bytes and a checksum of its ids - a reader can start at any of these checkpoints - and the ids
and lengths of its documents.

File: ``magic, blocks, index``, then the index' length as 8 bytes.  A block: the states (64 bit), then the
code words (32 bit) in reading order.

Defined results: a null text is an empty one (the end id only); null ids sort first; rows that repeat an id
stay apart; other columns are ignored; no rows give no files and no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.llm.common import scaled_parts, stored, table
from benchloom.llm.token_ids import token_ids
from benchloom.session import new_path

MAGIC = b"RANSTOK1"
#: Frequencies add up to 2 ** SCALE; states stay within [2 ** 31, 2 ** 63).
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 64
STEPS = 256
#: Blocks coded at once.
TOGETHER = 128
#: Bytes of ids in one file.
FILE_BYTES = 16 << 20


def scaled_frequencies(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (ascending) and frequencies of at least 1 that add up to 2 ** SCALE."""
    symbols = np.array(sorted(counts), np.int64)
    if len(symbols) > 1 << SCALE:
        raise ValueError("more symbols than slots")
    given = np.array([counts[s] for s in symbols.tolist()], np.float64)
    spare = (1 << SCALE) - len(symbols)
    exact = given / given.sum() * spare if len(symbols) else given
    freq = 1 + np.floor(exact).astype(np.int64)
    rest = (1 << SCALE) - int(freq.sum())
    if len(symbols):
        order = np.lexsort((symbols, -(exact - np.floor(exact))))
        freq[order[:rest]] += 1
    return symbols, freq


class Coder:
    """Codes blocks of ids with one shared frequency table."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols = symbols
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.slot = np.repeat(np.arange(len(symbols), dtype=np.int32), freq)

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """Blocks of LANES * STEPS ids, the last may be shorter; ``ids`` holds TOGETHER blocks at most."""
        size = LANES * STEPS
        blocks = -(-len(ids) // size)
        place = np.searchsorted(self.symbols, ids)
        padded = np.full(blocks * size, -1, np.int64)
        padded[: len(ids)] = place
        grid = padded.reshape(blocks, STEPS, LANES)
        state = np.full((blocks, LANES), LOW, np.uint64)
        words, owners = [], []
        shift = np.uint64(63 - SCALE)
        for step in range(STEPS - 1, -1, -1):
            at = grid[:, step, :]
            live = at >= 0
            f, c = self.freq[at], self.start[at]
            over = live & (state >= (f << shift))
            words.append((state[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            owners.append(np.nonzero(over)[0].astype(np.int32))
            state = np.where(over, state >> np.uint64(32), state)
            quotient = state // f
            state = np.where(live, (quotient << np.uint64(SCALE)) + (state - quotient * f) + c, state)
        owner = np.concatenate(owners[::-1])
        word = np.concatenate(words[::-1])[np.argsort(owner, kind="stable")]
        ends = np.cumsum(np.bincount(owner, minlength=blocks))
        begins = np.concatenate([[0], ends[:-1]])
        return [state[b].astype("<u8").tobytes() + word[begins[b] : ends[b]].tobytes() for b in range(blocks)]

    def decode(self, blocks: list[bytes], counts: list[int]) -> list[np.ndarray]:
        """The ids of each block; ``counts`` says how many it has."""
        states = np.stack([np.frombuffer(b, "<u8", LANES) for b in blocks]).astype(np.uint64)
        parts = [np.frombuffer(b, "<u4", offset=8 * LANES) for b in blocks]
        lengths = np.array([len(p) for p in parts], np.int64)
        word = np.concatenate([*parts, np.zeros(1, "<u4")]).astype(np.uint64)
        at_word = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        size, number = LANES * STEPS, np.array(counts, np.int64)
        out = np.zeros((len(blocks), STEPS, LANES), np.int64)
        lane = np.arange(LANES)
        mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
        for step in range(-(-int(number.max()) // LANES)):
            live = (step * LANES + lane)[None, :] < number[:, None]
            low = states & mask
            place = self.slot[low.astype(np.int64)]
            out[:, step, :] = self.symbols[place]
            after = self.freq[place] * (states >> scale) + low - self.start[place]
            need = live & (after < LOW)
            ranks = np.cumsum(need, axis=1)
            read = word[np.minimum(at_word[:, None] + ranks - 1, len(word) - 1)]
            after = np.where(need, (after << np.uint64(32)) | read, after)
            states = np.where(live, after, states)
            at_word = at_word + ranks[:, -1]
        flat = out.reshape(len(blocks), size)
        return [flat[i, :n] for i, n in enumerate(counts)]


def file_bytes(coder: Coder, docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file of the format."""
    size = LANES * STEPS
    body, index, at = [MAGIC], [], len(MAGIC)
    for first in range(0, len(ids), size * TOGETHER):
        part = ids[first : first + size * TOGETHER]
        for i, block in enumerate(coder.encode(part)):
            own = part[i * size : (i + 1) * size]
            index.append([first + i * size, len(own), at, len(block), zlib.crc32(own.astype("<u4").tobytes())])
            body.append(block)
            at += len(block)
    head = json.dumps({"blocks": index, "docs": docs, "lengths": lengths}).encode()
    head = zlib.compress(head)
    return b"".join([*body, head, len(head).to_bytes(8, "little")])


class TokenFile:
    """A file's index; ``ids(a, b)`` decodes only the blocks from ``a`` to ``b``."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(data[-8:], "little")
        index = json.loads(zlib.decompress(data[-8 - length : -8]))
        self.data, self.blocks, self.docs, self.lengths = data, index["blocks"], index["docs"], index["lengths"]

    def ids(self, coder: Coder, first: int = 0, last: int | None = None) -> np.ndarray:
        wanted = self.blocks[first:last]
        out = []
        for i in range(0, len(wanted), TOGETHER):
            some = wanted[i : i + TOGETHER]
            found = coder.decode([self.data[b[2] : b[2] + b[3]] for b in some], [b[1] for b in some])
            for block, ids in zip(some, found):
                if zlib.crc32(ids.astype("<u4").tobytes()) != block[4]:
                    raise ValueError(f"the block at id {block[0]} is damaged")
            out += found
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(uri: str, data: bytes) -> None:
    """Under another name first, so that a file is whole or absent; a second attempt writes the same."""
    import uuid

    system, path = _filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as out:
        out.write(data)
    system.move(own, path)


def _read(uri: str) -> bytes:
    system, path = _filesystem(uri)
    with system.open_input_file(path) as file:
        return file.read()


@lru_cache(maxsize=2)
def _shared_coder(uri: str) -> Coder:
    found = json.loads(zlib.decompress(_read(uri)))
    return Coder(np.array(found["symbols"], np.int64), np.array(found["freq"], np.int64))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> DataFrame:
    """Write all ``docs`` below ``folder`` in ascending ``doc_id`` order; returns the manifest: ``file``,
    ``part``, ``docs``, ``tokens`` and ``start`` (ids in the files before)."""
    spark = docs.sparkSession

    def tokenize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = token_ids(path), np.array([end_id], "<u4").tobytes()
        for frame in frames:
            ids = [np.frombuffer(i + end, "<u4") for i in encoder.encode(frame["text"].tolist())]
            small = [i.astype("<u2") if i.max() < 1 << 16 else i for i in ids]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "width": [i.dtype.itemsize for i in small],
                    "ids": [i.tobytes() for i in small],
                }
            )

    tokens = stored(docs.select("doc_id", "text").mapInPandas(tokenize, "doc_id long, width int, ids binary"), "ids")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for frame in frames:
            for width, ids in zip(frame["width"], frame["ids"]):
                more = np.bincount(np.frombuffer(ids, f"<u{width}"))
                if len(more) > len(total):
                    total = np.pad(total, (0, len(more) - len(total)))
                total[: len(more)] += more
        seen = np.nonzero(total)[0]
        yield pd.DataFrame({"symbol": seen, "n": total[seen]})

    # One row per id of the vocabulary at most, however large the table.
    counts = tokens.mapInPandas(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    symbols, freq = scaled_frequencies({r["symbol"]: r["n"] for r in counts})
    shared = f"{folder}/frequencies"
    _write(shared, zlib.compress(json.dumps({"symbols": symbols.tolist(), "freq": freq.tolist()}).encode()))

    size = tokens.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0]
    parts = scaled_parts(size, FILE_BYTES)
    ordered = (
        tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
        .withColumn("part", F.spark_partition_id())
    )

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc_ids, lengths, ids, part = [], [], [], None
        for frame in frames:
            for doc, width, data, part in zip(frame["doc_id"], frame["width"], frame["ids"], frame["part"]):
                doc_ids.append(None if pd.isna(doc) else int(doc))
                ids.append(np.frombuffer(data, f"<u{width}"))
                lengths.append(len(ids[-1]))
        if part is None:
            return
        uri = f"{folder}/part-{part:06d}"
        _write(uri, file_bytes(_shared_coder(shared), doc_ids, lengths, np.concatenate(ids)))
        yield pd.DataFrame({"file": [uri], "part": [part], "docs": [len(lengths)], "tokens": [sum(lengths)]})

    written = stored(ordered.mapInPandas(write, "file string, part int, docs long, tokens long"), "manifest")
    # One row per file: a small table even for a very large corpus.
    rows = sorted(written.collect(), key=lambda r: r["part"])
    starts = np.concatenate([[0], np.cumsum([r["tokens"] for r in rows], dtype=np.int64)])
    return spark.createDataFrame(
        [(r["file"], r["part"], r["docs"], r["tokens"], int(s)) for r, s in zip(rows, starts)],
        "file string, part int, docs long, tokens long, start long",
    )


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The documents in the files of ``manifest``: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, ``ids``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, start in zip(frame["file"], frame["start"]):
                file = TokenFile(_read(uri))
                ids = file.ids(_shared_coder(f"{folder}/frequencies")).astype("<u4")
                ends = np.cumsum(file.lengths)
                own = [ids[e - n : e].tobytes() for e, n in zip(ends, file.lengths)]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(file.docs, "Int64"),
                        "start": start + ends - file.lengths,
                        "n_tokens": file.lengths,
                        "ids_crc32": [zlib.crc32(o) for o in own],
                        "ids": own,
                    }
                )

    files = manifest.count()
    # Sorted by file, one file to a task.
    return (
        manifest.repartitionByRange(max(files, 1), "part")
        .select("file", "start")
        .mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    )


def op6_token_files(spark, folder: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "token-files")
    docs = table(spark, folder, "documents")
    manifest = write_token_files(docs, out, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, out, manifest).drop("ids")


QUERIES = {"op6_token_files": op6_token_files}
