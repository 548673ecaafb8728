"""Writers of exports, training files and status logs."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom.operators.runs import project_fields
from benchloom.operators.training import MESSAGE_BYTES, classify_records, export_manifest, failure_rows, sft_rows


def csv_text(value: Column, kind: T.DataType) -> Column:
    """A value as CSV text: null is empty, numbers in shortest plain form, nested values as JSON."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        text = F.when(whole, value.cast("bigint").cast("string")).otherwise(
            F.when(
                F.contains(value.cast("string"), F.lit("E")),
                F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.?0+$", ""),
            ).otherwise(value.cast("string"))
        )
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def write_json(runs: DataFrame, fields: Sequence[str], path: str) -> None:
    """Chosen fields as JSON lines, null fields kept."""
    project_fields(runs, fields).write.option("ignoreNullFields", False).json(path)


def write_csv(runs: DataFrame, fields: Sequence[str], path: str) -> None:
    rows = project_fields(runs, fields)
    texts = rows.select(*[csv_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema])
    texts.write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


#: Folders that documents of their own are dealt to, so that their files are written and listed by many tasks.
FOLDERS = 64


def _target(uri: str):
    """File system and path of a folder, given as a plain path or with a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_documents(documents: DataFrame, path: str, text: str = "value", ending: str = ".json") -> int:
    """Every row's text as a file of its own below ``path``, in folders; returns the number of files.

    Files are named by their text and, for equal texts, a number, so a repeated task writes the same files.  A null text is an
    empty file.  The tasks write the files themselves: Spark's own writer lists and moves each one in the driver.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _target(path)
        seen, made = Counter(), set()
        for batch in batches:
            for folder, value in zip(batch.column("folder").to_pylist(), batch.column("text").to_pylist()):
                name = hashlib.sha256(data := value or b"").hexdigest()
                if folder not in made:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                seen[name] += 1
                target = f"{root}/{folder}/{name}-{seen[name]}{ending}"
                # Under another name first, so that a file is whole or absent.
                with system.open_output_stream(own := f"{target}.{uuid.uuid4().hex}") as out:
                    out.write(data)
                system.move(own, target)
        yield pa.RecordBatch.from_pydict({"files": [sum(seen.values())]}, pa.schema([("files", pa.int64())]))

    system, root = _target(path)
    system.create_dir(root, recursive=True)
    folder = F.pmod(F.xxhash64(text), F.lit(FOLDERS)).alias("folder")
    dealt = documents.select(folder, F.col(text).cast("binary").alias("text")).repartition(FOLDERS, "folder")
    return dealt.mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


def write_training_split(
    records: DataFrame, messages: DataFrame, path: str, order: str, key: str = "id", limit: int = MESSAGE_BYTES
) -> None:
    """Training files of graded runs: ``sft``, ``failures`` and ``manifest`` folders of JSON lines.

    Each folder is committed as a whole by Spark; the manifest is written last, so a reader that waits
    for it never sees half an export.  The chat format holds a conversation in one line, so here, and
    only here, the messages of one record come together.
    """
    message = F.struct("role", "content", "tool_calls", "tool_call_id", "name")
    chats = (
        sft_rows(records, messages, key)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), message.alias("m")))).alias("_m"))
        .select(F.col(key).alias("_key"), F.transform("_m", lambda x: x["m"]).alias("messages"))
    )
    kept = classify_records(records, messages, key).where(F.col("use") == "sft")
    metadata = F.struct(F.col("passed").alias("pass"), "scored", "trace_path")
    rows = kept.join(chats, F.col(key) == F.col("_key")).select(F.col(key).alias("id"), "messages", metadata.alias("metadata"))
    rows.write.json(f"{path}/sft")
    failure_rows(records, messages, key, limit).write.json(f"{path}/failures")
    export_manifest(records, messages, key, limit).write.json(f"{path}/manifest")


def status_log(events: DataFrame, path: str, checkpoint: str):
    """Streaming sink: one JSON event per line, appended exactly once."""
    return (
        events.writeStream.format("json")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
