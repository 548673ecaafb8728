"""Readers of run files, benchmark items, matrix reports, traces, harness results and file listings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.functions.text import first_non_empty
from benchloom.operators.scoring import harness_entry
from benchloom.operators.training import parse_trace_lines
from benchloom.session import ship

RUN_SCHEMA = "path string, updated_at timestamp, payload string"


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """One row per file below a folder: its text, path and time."""
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("updated_at"),
            F.col("value").alias("text"),
        )
    )


def run_payload(text: Column) -> Column:
    """Payload of a run document: its ``payload`` object, else the object itself; null for anything else."""
    inner = F.get_json_object(text, "$.payload")
    return F.when(
        F.json_object_keys(text).isNotNull(), F.when(F.json_object_keys(inner).isNotNull(), inner).otherwise(text)
    )


def scan_runs(
    spark: SparkSession,
    path: str | None = None,
    default: str = "runs",
    strict: bool = False,
    glob: str = "*.[jJ][sS][oO][nN]",
) -> DataFrame:
    """Run records of a folder tree of JSON files, as (path, updated_at, payload).

    A folder skips bad files; a file named on its own (``strict``) must be good.  The default folder
    may be missing.
    """
    try:
        files = whole_files(spark, path or default, glob)
    except AnalysisException:
        if path is not None:
            raise
        return spark.createDataFrame([], RUN_SCHEMA)
    rows = files.select("path", "updated_at", run_payload(F.col("text")).alias("payload"))
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a run record: "), F.col("path")))
        return rows.withColumn("payload", F.when(F.col("payload").isNull(), bad).otherwise(F.col("payload")))
    return rows.where(F.col("payload").isNotNull())


def scan_run_lines(spark: SparkSession, path: str) -> DataFrame:
    """Run records kept as one JSON object per line: the form for very many runs, splittable and pushed down."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("updated_at"),
        run_payload(F.col("value")).alias("payload"),
    )
    return lines.where(F.col("payload").isNotNull())


def typed_head(runs: DataFrame, fields: Mapping[str, str], payload: str = "payload") -> DataFrame:
    """Named payload fields as typed columns, given as {column: "json path type"}."""
    columns = []
    for name, spec in fields.items():
        path, kind = spec.rsplit(" ", 1)
        columns.append(F.get_json_object(payload, "$." + path).try_cast(kind).alias(name))
    return runs.select("path", "updated_at", *columns)


# ---------------------------------------------------------------- benchmark items


def scan_items(spark: SparkSession, path: str, schema: str, form: str = "") -> DataFrame:
    """Benchmark items from CSV with header, a JSON array (``json``) or JSON lines, by extension unless given.

    Items have one schema, stated by the caller, so nothing is inferred from the data.
    """
    wanted = spark.createDataFrame([], schema).schema
    form = form or {"csv": "csv", "json": "json"}.get(path.rsplit(".", 1)[-1].lower(), "jsonl")
    if form == "csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        rows = reader.option("ignoreLeadingWhiteSpace", False).csv(path)
        rows = rows.withColumnsRenamed({c: c.strip() for c in rows.columns})
        return rows.select(
            *[
                (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
                for f in wanted
            ]
        )
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", form == "json").json(path).select(*wanted.names)


def scan_items_auto(spark: SparkSession, path: str, schema: str, form: str = "") -> DataFrame:
    """Items in a form found out: stated or named JSON lines, else an array when the file starts like one."""
    if form == "jsonl" or path.lower().endswith(".jsonl"):
        return scan_items(spark, path, schema, "jsonl")
    # Only the first line that holds anything decides; it is one row, not the data.
    head = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    return scan_items(spark, path, schema, "json" if head is not None and head.c == "[" else "jsonl")


# Names of the item fields in a remote row.
ROW_ALIASES = {"input": ["question", "input", "prompt"], "gold": ["answer", "gold", "label"]}


def resolve_item_source(
    inline: DataFrame | None = None, files: DataFrame | None = None, remote: DataFrame | None = None
) -> DataFrame:
    """Items (task, input, gold, choices) from inline arrays, item files, and pages of remote rows.

    ``inline`` has (task, items), ``files`` the columns themselves, ``remote`` (task, row) with alias fields.
    """
    parts = []
    if inline is not None:
        parts.append(inline.select("task", F.inline("items")).select("task", "input", "gold", "choices"))
    if files is not None:
        parts.append(files.select("task", "input", "gold", "choices"))
    if remote is not None:
        known = remote.schema["row"].dataType.names

        def pick(role: str) -> Column:
            return first_non_empty([F.col(f"row.{n}") for n in ROW_ALIASES[role] if n in known]).alias(role)

        choices = F.col("row.choices") if "choices" in known else F.lit(None).cast("array<string>")
        parts.append(remote.select("task", pick("input"), pick("gold"), choices.alias("choices")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


# ---------------------------------------------------------------- reports, traces, results, listings


# Fixed value: schema name of a report wrapped with its inventory.
WRAPPED_SCHEMA = "lil-bench-result/"


def scan_matrix(spark: SparkSession, path: str, glob: str = "*.{json,json.gz}") -> DataFrame:
    """Matrix reports as (path, document, hardware); packed files are read as they are, and a wrapped
    report gives its inner one and its inventory."""
    rows = whole_files(spark, path, glob)
    wrapped = F.startswith(F.coalesce(F.get_json_object("text", "$.schema"), F.lit("")), F.lit(WRAPPED_SCHEMA))
    return rows.select(
        "path",
        F.when(wrapped, F.get_json_object("text", "$.results.bench")).otherwise(F.col("text")).alias("document"),
        F.when(wrapped, F.get_json_object("text", "$.hardware")).alias("hardware"),
    ).where(F.col("document").isNotNull())


def scan_traces(
    spark: SparkSession, path: str, limit: int = 4 * 1024 * 1024, glob: str = "*.jsonl"
) -> DataFrame:
    """Trace lines with their file, state and type; bad lines stay and are counted by ``trace_summary``."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    )
    return parse_trace_lines(lines, "line", limit)


def harness_results(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Result of each (folder, task) among harness files (path, text): ``status`` is ok, missing or ambiguous.

    A folder must hold exactly one ``results.json`` or ``results_*.json``.
    """
    named = files.where(F.col("path").rlike(r"/results(?:_[^/]*)?\.json$"))
    counted = named.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("text").alias("_text")
    )
    rows = tasks.join(counted, "folder", "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("ok")
    entry = F.when(F.col("_n") == 1, harness_entry(F.col("_text"), F.col("task")))
    return rows.withColumn("status", status).withColumn("metrics", entry).drop("_n", "_text")


def scan_harness_results(spark: SparkSession, path: str, tasks: DataFrame) -> DataFrame:
    return harness_results(whole_files(spark, path, "results*.json").select("path", "text"), tasks)


def scan_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Listing of a folder tree as (path, folder, file, bytes, modified); file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    )
    return files.select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file"),
        "bytes",
        "modified",
    )


def scan_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Size and SHA-256 of every file below a folder, from its content: one task reads a file, and none may exceed 2 GB."""
    files = _below(spark, "binaryFile", path, glob)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _below(spark: SparkSession, form: str, path: str, glob: str) -> DataFrame:
    reader = spark.read.format(form).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    # Only for text: nothing but a line feed ends a line, so the lines and the size tell every byte.
    return reader.option("lineSep", "\n").load(path)


#: Larger files are hashed by several tasks.
WHOLE = 1 << 27
# Fixed value: endings that Hadoop unpacks, so such a file is not read as it is by lines.
PACKED = r"\.(?:gz|bz2|deflate|snappy|lz4|zst|passthrough)$"
# A prime, and a number below it.
_PRIME, _BASE = 2**255 - 19, int.from_bytes(hashlib.sha256(b"lines").digest(), "big") >> 2


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and digest of the lines of each range of a file; a range is read by one task, in order."""
    found: dict[tuple[str, int], tuple[int, int]] = {}
    sha256, number = hashlib.sha256, int.from_bytes
    for batch in batches:
        file, start, values = batch.column("file"), batch.column("start"), batch.column("value").to_pylist()
        runs = [pc.run_end_encode(c).run_ends.to_pylist() for c in (file, start)]
        at = 0
        for end in sorted({*runs[0], *runs[1]}):
            key = file[at].as_py(), start[at].as_py()
            n, total = found.get(key, (0, 0))
            for value in values[at:end]:
                total = (total * _BASE + number(sha256(value).digest(), "big")) % _PRIME
            found[key] = n + end - at, total
            at = end
    rows = [{"file": f, "start": s, "n": n, "digest": d.to_bytes(32, "big")} for (f, s), (n, d) in found.items()]
    yield pa.RecordBatch.from_pylist(
        rows, pa.schema([("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
    )


def _file_digest(ranges: pd.DataFrame) -> pd.DataFrame:
    """The digest of a file's lines from those of its ranges, however it was cut into them."""
    total = 0
    for n, digest in ranges.sort_values("start")[["n", "digest"]].itertuples(index=False):
        total = (total * pow(_BASE, int(n), _PRIME) + int.from_bytes(digest, "big")) % _PRIME
    return pd.DataFrame({"file": ranges["file"].iloc[:1], "sha256": [f"lines:{total:064x}"]})


def scan_range_hashes(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """``scan_hashes`` for files of any size, to compare two listings made this way.

    A file of more than ``whole`` bytes is read in ranges by many tasks: its hash is ``lines:`` and a polynomial over the SHA-256 of
    its lines, which does not depend on the ranges but is not the file's SHA-256, since that can only be taken in one go.
    A stretch without a line feed stays in one task, and packed files (``PACKED``) are hashed whole.
    """
    ship(spark)
    name = F.col("_metadata.file_path")
    parted = (F.col("_metadata.file_size") > whole) & ~name.rlike(PACKED)
    files = _below(spark, "binaryFile", path, glob)
    small = files.where(~parted).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    lines = _below(spark, "text", path, glob).where(parted)
    lines = lines.select(name.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    ranges = lines.mapInArrow(_line_digests, "file string, start long, n long, digest binary")
    digests = ranges.groupBy("file").applyInPandas(_file_digest, "file string, sha256 string")
    # A file without lines is empty, and so never large.
    large = files.where(parted).select("path", F.col("length").alias("size"), name.alias("file")).join(digests, "file")
    return small.unionByName(large.drop("file"))
