"""File and document inventories."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions.documents import flat_entries


def flatten_documents(documents: DataFrame, key: str, document: str) -> DataFrame:
    """One row per leaf of each JSON document, with field name, value text and value kind."""
    rows = documents.select(key, F.explode(flat_entries(F.col(document))).alias("e"))
    return rows.select(key, "e.field", "e.value", "e.kind")


# ---------------------------------------------------------------- weight files

# Split file names, and which extensions hold weights.
SPLIT_NAME = r"^(.*)-(\d{5})-of-(\d{5})\.gguf$"
WEIGHT_FORMATS = {"safetensors": "safetensors", "bin": "pytorch", "pt": "pytorch", "pth": "pytorch", "gguf": "gguf"}


def split_groups(files: DataFrame, folder: str = "folder", file: str = "file", size: str = "bytes") -> DataFrame:
    """Weight files with split parts put together; ``partial`` when parts are missing."""
    name = F.col(file)
    is_split = name.rlike(SPLIT_NAME)
    rows = files.where(F.lower(name).rlike(r"\.gguf$")).select(
        folder,
        F.when(is_split, F.concat(F.regexp_extract(name, SPLIT_NAME, 1), F.lit(".gguf"))).otherwise(name).alias("model_file"),
        name.alias("_file"),
        F.when(is_split, F.regexp_extract(name, SPLIT_NAME, 3).cast("int")).alias("_total"),
        F.col(size).alias("_size"),
    )
    groups = rows.groupBy(folder, "model_file").agg(
        F.count(F.lit(1)).alias("parts"),
        F.min(F.struct("_file", "_total"))["_total"].alias("expected"),
        F.min("_file").alias("first_file"),
        F.sum("_size").alias("bytes"),
    )
    short = F.coalesce(F.col("parts") != F.col("expected"), F.lit(False))
    return groups.withColumn("status", F.when(short, "partial").otherwise("available"))


def parameter_counts(shards: DataFrame, by: Sequence[str], header: str = "header") -> DataFrame:
    """Element count of all tensors in shard headers; null when a header cannot be read or nothing is counted."""
    tensors = F.from_json(header, "map<string,string>")
    shapes = F.transform(
        F.filter(F.map_entries(tensors), lambda e: e["key"] != "__metadata__"),
        lambda e: F.from_json(e["value"], "struct<shape:array<bigint>>")["shape"],
    )
    counts = F.transform(
        shapes,
        lambda s: F.aggregate(F.coalesce(s, F.array().cast("array<bigint>")), F.lit(1).cast("bigint"), lambda a, d: a * d),
    )
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
    rows = shards.select(*by, F.when(F.json_object_keys(header).isNotNull(), total).alias("_n"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shards"), F.sum("_n").alias("_sum"), F.count_if(F.col("_n").isNull()).alias("_bad")
    )
    return sums.select(
        *by, "shards", F.when((F.col("_bad") == 0) & (F.col("_sum") > 0), F.col("_sum")).alias("parameters")
    )


def inventory_order(entries: DataFrame) -> DataFrame:
    """Entries by name, case ignored, then kind."""
    return entries.orderBy(F.lower("name"), "kind")


def union_inventory(sources: Mapping[str, DataFrame], unreadable: DataFrame | None = None) -> DataFrame:
    """Entries of all sources under their kind; sources that could not be read become status rows."""
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in sources.items()]
    if unreadable is not None:
        parts.append(unreadable.withColumn("status", F.lit("unreadable")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


# ---------------------------------------------------------------- file selection


def _glob_part(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in part[i + 1 :]:
            end = part.index("]", i + 1)
            out += part[i : end + 1]
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_pattern(pattern: str) -> str:
    """Regular expression of a path pattern: ``*`` inside one segment, ``**`` over any number of segments."""
    out, after_text = "", False
    for part in pattern.split("/"):
        if part == "**":
            out += "(?:/[^/]*)*" if after_text else "(?:[^/]*(?:/[^/]*)*)?" if out == "" else ""
            continue
        if out == "":
            out = _glob_part(part)
        elif not after_text:
            # A leading ** may stand for nothing, so its slash is optional with it.
            out = "(?:[^/]*/)*" + _glob_part(part)
        else:
            out += "/" + _glob_part(part)
        after_text = True
    return f"^{out}$"


def select_files(files: DataFrame, name: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Files any include pattern names (all without one) and no exclude pattern does."""

    def any_of(patterns: Sequence[str]) -> Column:
        return F.col(name).rlike("|".join(glob_pattern(p) for p in patterns))

    if include:
        files = files.where(any_of(include))
    return files.where(~any_of(exclude)) if exclude else files


def safe_path(path: Column) -> Column:
    """A relative path without empty, ``.`` or ``..`` parts, back slash, colon or zero byte."""
    return (
        (path != "")
        & ~path.rlike(r"[\\\x00:]")
        & ~path.rlike(r"(?:^|/)(?:\.{1,2})?(?:/|$)")
    )


def check_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Problems of a file list: unsafe names, names used twice, names that are also a folder of others."""
    names = files.groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("_n"))
    unsafe = names.where(~safe_path(F.col("path"))).select("path", F.lit("unsafe").alias("problem"))
    twice = names.where(F.col("_n") > 1).select("path", F.lit("duplicate").alias("problem"))
    parts = F.split("path", "/")
    parents = names.select(
        F.explode(
            F.transform(
                F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)),
                lambda i: F.array_join(F.slice(parts, 1, i), "/"),
            )
        ).alias("path")
    ).distinct()
    folders = names.join(parents, "path", "left_semi").select("path", F.lit("collision").alias("problem"))
    return unsafe.unionByName(twice).unionByName(folders)


def integrity_check(expected: DataFrame, actual: DataFrame, path: str = "path") -> DataFrame:
    """Each expected file as missing, changed (size or hash) or ok."""
    have = actual.select(path, F.col("size").alias("_size"), F.col("sha256").alias("_hash"))
    rows = expected.join(have, path, "left")
    status = (
        F.when(F.col("_size").isNull(), "missing")
        .when((F.col("_size") != F.col("size")) | (F.col("_hash") != F.col("sha256")), "changed")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).drop("_size", "_hash")


def canonical_prompt_match(runs: DataFrame, prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """Runs whose prompt is a known prompt, found by hash; a run needs the prompt's least output tokens."""
    known = prompts.select(
        "prompt_id", F.sha2("text", 256).alias("_hash"), F.col("min_output_tokens").alias("_least")
    )
    rows = runs.withColumn("prompt_hash", F.sha2(text, 256)).join(known, F.col("prompt_hash") == F.col("_hash"), "left")
    verified = F.col("_hash").isNotNull() & (F.coalesce("output_tokens", F.lit(0)) >= F.col("_least"))
    return rows.withColumn("verified", F.coalesce(verified, F.lit(False))).drop("_hash", "_least", text)


# ---------------------------------------------------------------- hardware


def _number(value: Column) -> Column:
    """A number without a fraction of zero: ``24``, ``23.5``."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def hardware_columns(runs: DataFrame) -> DataFrame:
    """Add ``slots`` (normalized cards), ``hw_class`` and ``label`` to runs with hardware fields.

    Fields: gpus (array of struct<name, vram_gb, count>), gpu_name, gpu_count, vram_gb, chip_vendor,
    chip_family, chip_variant, unified_gb, cpu.
    """
    slots = F.filter(
        F.coalesce("gpus", F.array().cast(runs.schema["gpus"].dataType)),
        lambda s: (F.coalesce(s["name"], F.lit("")) != "") | (F.coalesce(s["vram_gb"], F.lit(0.0)) > 0),
    )
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    cards = F.coalesce(F.size("gpus"), F.lit(0)) > 0
    kind = F.when(filled("gpu_name") | cards, "DISCRETE_GPU").when(
        filled("chip_vendor") | filled("chip_family"), "UNIFIED"
    ).otherwise("CPU_ONLY")

    def with_gb(name: Column, gb: Column) -> Column:
        return F.when(gb > 0, F.concat(name, F.lit(" "), _number(gb), F.lit("GB"))).otherwise(name)

    several = F.array_join(
        F.transform("gpus", lambda s: with_gb(F.coalesce(F.nullif(s["name"], F.lit("")), F.lit("GPU")), F.coalesce(s["vram_gb"], F.lit(0.0)))),
        " + ",
    )
    count = F.coalesce("gpu_count", F.lit(0.0))
    counted = F.when(count > 1, F.concat(_number(count), F.lit("x "), F.col("gpu_name"))).otherwise(F.col("gpu_name"))
    chip = F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("chip_vendor", "chip_family", "chip_variant")]))
    label = (
        F.when(cards, several)
        .when(filled("gpu_name"), with_gb(counted, F.coalesce("vram_gb", F.lit(0.0))))
        .when(chip != "", with_gb(chip, F.coalesce("unified_gb", F.lit(0.0))))
        .otherwise(F.coalesce(F.nullif(F.col("cpu"), F.lit("")), F.lit("unknown")))
    )
    return runs.withColumn("slots", slots).withColumn("hw_class", kind).withColumn("label", label)


def hardware_dimension(runs: DataFrame) -> DataFrame:
    """Distinct hardware of runs with class, number of card entries kept (only several are) and run count."""
    rows = hardware_columns(runs)
    kept = F.when(F.size("slots") > 1, F.size("slots")).otherwise(0)
    return rows.groupBy("label", "hw_class", kept.alias("slots")).agg(F.count(F.lit(1)).alias("runs"))


# ---------------------------------------------------------------- text and cells

# Options whose value is a secret, in a command text and as a single argument.
SECRET_OPTION = r"(?i)(--(?:[\w-]*-)?(?:key|token|secret|password))(=|\s+)('[^']*'|\"[^\"]*\"|[^\s-]\S*)"
SECRET_ARGUMENT = r"(?i)^--(?:[\w-]*-)?(?:key|token|secret|password)$"
REDACTED = "<redacted>"


def redact_command(text: Column) -> Column:
    return F.regexp_replace(text, SECRET_OPTION, "$1$2" + REDACTED)


def redact_arguments(argv: Column) -> Column:
    """Argument list with secret values replaced, given as ``--name=value`` or as the next argument."""

    def one(arg: Column, i: Column) -> Column:
        name = F.regexp_extract(arg, "^([^=]*)", 1)
        before = F.when(i > 0, F.try_element_at(argv, i))
        inline = F.contains(arg, F.lit("=")) & name.rlike(SECRET_ARGUMENT)
        follows = F.coalesce(before.rlike(SECRET_ARGUMENT), F.lit(False)) & ~F.startswith(arg, F.lit("--"))
        return F.when(inline, F.concat(name, F.lit("=" + REDACTED))).when(follows, F.lit(REDACTED)).otherwise(arg)

    return F.transform(argv, one)


# Engines whose matrix reports are accepted.
MATRIX_ENGINES = ["vllm", "sglang"]


def trim_cells(reports: DataFrame) -> DataFrame:
    """Cells of matrix reports, one row each, without their heavy parts; reports of other engines give none.

    ``document`` holds a report; only the named cell fields are read, so request samples and loop
    diagnostics are never parsed into columns.
    """
    cell = "context_tokens:bigint,concurrency:bigint,aggregate_tps:double,ttft_ms:double"
    shape = (
        f"struct<metadata:struct<engine:string,version:string>,results:array<struct<{cell}>>,"
        f"burst_results:array<struct<{cell}>>,prefill:map<string,struct<tok_s:double>>>"
    )
    rows = reports.withColumn("_d", F.from_json("document", shape)).where(F.col("_d.metadata.engine").isin(*MATRIX_ENGINES))

    def cells(field: str, phase: str) -> Column:
        empty = F.array().cast(f"array<struct<phase:string,{cell}>>")
        return F.coalesce(
            F.transform(
                F.col(f"_d.{field}"),
                lambda c: F.struct(
                    F.lit(phase).alias("phase"), c["context_tokens"], c["concurrency"], c["aggregate_tps"], c["ttft_ms"]
                ).cast(f"struct<phase:string,{cell}>"),
            ),
            empty,
        )

    prefill = F.coalesce(
        F.transform(
            F.map_entries("_d.prefill"),
            lambda e: F.struct(
                F.lit("prefill").alias("phase"),
                e["key"].try_cast("bigint"),
                F.lit(None).cast("bigint"),
                e["value"]["tok_s"],
                F.lit(None).cast("double"),
            ).cast(f"struct<phase:string,{cell}>"),
        ),
        F.array().cast(f"array<struct<phase:string,{cell}>>"),
    )
    keys = [c for c in reports.columns if c != "document"]
    every = F.concat(prefill, cells("results", "decode"), cells("burst_results", "burst"))
    return rows.select(*keys, F.col("_d.metadata.engine").alias("engine"), F.explode(every).alias("c")).select(
        *keys, "engine", "c.*"
    )
