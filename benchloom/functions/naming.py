"""Names: engines, speculative methods, weight files and quantization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom.functions.text import last_match

# Spellings of the engine names.
ENGINE_ALIASES = {
    "llama.cpp": ["llama", "llama.cpp", "llamacpp", "llama-bench", "llama.cpp-bench"],
    "vllm": ["vllm", "vllm serve", "vllm-bench"],
    "sglang": ["sglang", "sgl", "sglang-bench"],
    "llmd": ["llmd", "zml", "zml/llmd", "zml llmd"],
    "freetoken": ["freetoken", "free-token", "free token"],
    "ninfer": ["ninfer", "n-infer", "n infer"],
    "strata": ["strata", "strata-engine", "strata engine"],
    "e": ["e", "actual", "actual-e", "actual e", "actual-computer", "actual computer"],
}
# Spellings of the speculative methods.
SPEC_ALIASES = {
    "DFlash2": ["dflash2", "dflash-2", "draft-dflash2", "draft-dflash-2"],
    "DFlash": ["dflash", "draft-dflash"],
    "MTP": ["mtp", "draft-mtp"],
}
# What a quantization token looks like and which name parts carry no model name.
QUANT_TOKEN = r"(?:IQ|Q)[0-9][A-Z0-9_]*|(?:(?:NV|MX)FP|BF|F|FP)[0-9]+"
PACKAGING_TOKENS = ["ud", "gguf", "imat", "imatrix"]
GENERIC_MODEL_NAMES = ["default", "model", "local", "local-model", "localmodel", "gguf", "unknown", "custom"]
SPLIT_SUFFIX = r"(?i)-\d{5}-of-\d{5}$"


def _flat(aliases: dict[str, list[str]]) -> dict[str, str]:
    return {spelling: name for name, spellings in aliases.items() for spelling in spellings}


def canonical_engine_name(value: str) -> str:
    return _flat(ENGINE_ALIASES).get(value.strip().lower(), value)


def _lookup(value: Column, aliases: dict[str, list[str]]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _flat(aliases).items() for x in pair])
    return F.try_element_at(table, value)


def canonical_engine(value: Column) -> Column:
    """Canonical engine name; an unknown name stays as it is."""
    return F.coalesce(_lookup(F.lower(F.trim(value)), ENGINE_ALIASES), value)


def known_engine(value: Column) -> Column:
    return _lookup(F.lower(F.trim(value)), ENGINE_ALIASES).isNotNull()


def canonical_spec_method(value: Column, draft_model: Column | None = None) -> Column:
    """Canonical speculative method; a draft model named for the second version decides it."""
    plain = F.lower(F.replace(F.trim(value), F.lit("_"), F.lit("-")))
    name = F.coalesce(_lookup(plain, SPEC_ALIASES), F.trim(value))
    if draft_model is None:
        return name
    draft = F.lower(F.replace(F.coalesce(draft_model, F.lit("")), F.lit("_"), F.lit("-")))
    second = F.contains(draft, F.lit("dflash2")) | F.contains(draft, F.lit("dflash-2"))
    return F.when((name == "DFlash") & plain.isin("dflash", "draft-dflash") & second, "DFlash2").otherwise(name)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def model_name_from_file(path: Column) -> Column:
    """Model name in a weight file name: no split mark, no quantization or packaging at the end."""
    name = F.regexp_replace(stem(F.regexp_extract(path, r"([^\\]*)$", 1)), SPLIT_SUFFIX, "")
    closing = rf"(?i)(?:-(?:{QUANT_TOKEN}|{'|'.join(PACKAGING_TOKENS)}))+$"
    return F.regexp_replace(name, closing, "")


def quantization_from_file(path: Column) -> Column:
    """Last quantization token of a file name, upper case; null without one.

    A token may share its border with the next one, so the search is over name parts.
    """
    found = last_match(stem(path), rf"(?i)(?:^|[-_.])({QUANT_TOKEN})(?:[-_.]|$)", 1)
    return F.upper(found)


def is_repository_name(name: Column) -> Column:
    """A model name or owner/name pair, not a generic alias and not a path."""
    text = F.trim(name)
    slashes = F.char_length(text) - F.char_length(F.replace(text, F.lit("/"), F.lit("")))
    return (
        (text != "")
        & ~F.lower(text).isin(*GENERIC_MODEL_NAMES)
        & ~text.rlike(r"(?i)\.gguf$")
        & ~F.contains(text, F.lit("\\"))
        & (slashes <= 1)
        & ~text.rlike(r"^(?:/|\./|\.\./)")
    )


def normal_file_name(path: Column) -> Column:
    """Lower-case stem with separators made equal and the ``qat`` part left out."""
    parts = F.filter(F.split(F.lower(stem(path)), r"[-_.]+"), lambda p: (p != "") & (p != "qat"))
    return F.array_join(parts, "-")
