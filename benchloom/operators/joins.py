"""Joins between run, task, file and listing tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom.functions import naming
from benchloom.functions.text import collapsed_text, strip


def candidate_task_type(stated: Column, question: Column) -> Column:
    """Task type of a candidate item: the stated one, else from the question id."""
    known = F.lower(stated)
    by_id = F.when(F.contains(F.lower(question), F.lit("cruxeval-i:")), "input_prediction").otherwise(
        "output_prediction"
    )
    return F.when(known != "", known).otherwise(by_id)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key.  The rank filter lets Spark keep one row per key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def join_results_to_checkpoint(entries: DataFrame, results: DataFrame, link: str, id_column: str) -> DataFrame:
    """Results the checkpoint entries point at; the first per id in entry order, rows without id dropped."""
    named = results.where(F.col(id_column).isNotNull() & (F.col(id_column).cast("string") != ""))
    rows = entries.where(F.col(link).isNotNull()).join(named, link)
    return first_per_key(rows, [id_column], ["entry_index", "result_index"])


def missing_shards(datasets: DataFrame, covered: DataFrame, key: str, shard: str = "shard") -> DataFrame:
    """Shards 1..``shard_count`` of each data set that nothing covers."""
    expected = datasets.where(F.col("shard_count") > 0).select(
        key, F.explode(F.sequence(F.lit(1), F.col("shard_count").cast("int"))).alias(shard)
    )
    done = covered.select(key, F.col(shard).cast("int").alias(shard)).distinct()
    return expected.join(done, [key, shard], "left_anti")


def next_missing(datasets: DataFrame, covered: DataFrame, key: str, shard: str = "shard") -> DataFrame:
    """Smallest uncovered shard of each data set that has one."""
    return missing_shards(datasets, covered, key, shard).groupBy(key).agg(F.min(shard).alias("next_shard"))


def coverage_catalog(datasets: DataFrame, covered: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Every data set with covered and missing shard counts, score and next shard to run."""
    done = covered.select(key, F.col("shard").cast("int").alias("shard")).where("shard > 0").distinct()
    counts = done.groupBy(key).agg(F.count(F.lit(1)).alias("covered"))
    gaps = missing_shards(datasets, covered, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("missing"), F.min("shard").alias("next_shard")
    )
    rows = datasets.join(counts, key, "left").join(gaps, key, "left").join(scores, key, "left")
    return rows.withColumn("covered", F.coalesce("covered", F.lit(0))).withColumn(
        "missing", F.coalesce("missing", F.lit(0))
    )


def task_set_diff(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: ``missing`` from or ``extra`` in the actual set."""
    left = actual.select(key).distinct().withColumn("_a", F.lit(True))
    right = expected.select(key).distinct().withColumn("_e", F.lit(True))
    both = left.join(right, key, "full_outer")
    return both.where(F.col("_a").isNull() | F.col("_e").isNull()).select(
        key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("side")
    )


def task_set_summary(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Counts of the two sets and their differences, and whether they match."""
    tagged = actual.select(key, F.lit(1).alias("a"), F.lit(0).alias("e")).unionByName(
        expected.select(key, F.lit(0).alias("a"), F.lit(1).alias("e"))
    )
    sums = tagged.groupBy(key).agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    return sums.agg(
        F.sum("e").alias("expected"),
        F.sum("a").alias("actual"),
        F.count_if(F.col("a") == 0).alias("missing"),
        F.count_if(F.col("e") == 0).alias("extra"),
    ).withColumn(
        "matches", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("actual") == F.col("expected"))
    )


def mark_loaded(inventory: DataFrame, instances: DataFrame, path: str = "path") -> DataFrame:
    """Inventory entries with the instances serving them: one row per instance, or one with none.

    ``loaded`` counts the instances of the entry.  Names stay rows, so a busy entry makes no long list.
    """
    names = instances.select(path, "instance").distinct()
    counts = names.groupBy(path).agg(F.count(F.lit(1)).alias("loaded"))
    rows = inventory.join(names, path, "left").join(counts, path, "left")
    return rows.withColumn("loaded", F.coalesce("loaded", F.lit(0)))


def offers_vs_live(offers: DataFrame, live: DataFrame) -> DataFrame:
    """Offered models with whether they may be served: published weights must be live, case ignored."""
    now = live.select("model", F.lower("weights_id").alias("_live"))
    rows = offers.join(now, "model", "left")
    stated = F.coalesce("weights_id", F.lit(""))
    changed = (stated != "") & (F.lower(stated) != F.coalesce("_live", F.lit("")))
    return rows.withColumn("served", ~changed).drop("_live")


def offer_summary(offers: DataFrame, live: DataFrame) -> DataFrame:
    """Served and changed models of each listing in numbers; ``offers_vs_live`` has them by name."""
    rows = offers_vs_live(offers, live).groupBy("listing", "model").agg(F.min("served").alias("served"))
    return rows.groupBy("listing").agg(
        F.count_if("served").alias("served"), F.count_if(~F.col("served")).alias("changed")
    )


def allowlist_check(rows: DataFrame, name: str, allowed: DataFrame) -> DataFrame:
    """Rows whose name is not allowed; blank names pass, and an empty allowlist allows all."""
    known = allowed.select(F.col(name).alias("_allowed")).where(F.coalesce("_allowed", F.lit("")) != "").distinct()
    any_allowed = known.limit(1).select(F.lit(True).alias("_any"))  # at most one row
    left = rows.where(F.coalesce(F.col(name), F.lit("")) != "").join(
        known, F.col(name) == F.col("_allowed"), "left_anti"
    )
    return left.join(F.broadcast(any_allowed), F.lit(True)).drop("_any")


def source_candidates(files: DataFrame, repository_files: DataFrame) -> DataFrame:
    """Repository holding each file: same name, same name in another case, or same normal name.

    The repository the file name itself points to comes first, then candidates in their order.  All
    name rules agree on the normal name.  Each normal name keeps its best candidate only, and the
    pointed-to repository is looked up by name, so a file name found in very many repositories makes
    no pairs.
    """
    plain = naming.stem(F.col("file"))
    by_name = F.coalesce(
        *[F.nullif(F.regexp_extract(plain, rf"(?i)^(.+?){mark}", 1), F.lit("")) for mark in ("-ud-", "-qat-")]
    )
    wanted = files.select(
        "file",
        naming.normal_file_name(F.col("file")).alias("_n"),
        F.concat(F.lit("unsloth/"), by_name, F.lit("-GGUF")).alias("_guess"),
    ).distinct()
    held = repository_files.select("repository", "place", naming.normal_file_name(F.col("file")).alias("_n"))
    best = held.groupBy("_n").agg(F.min(F.struct("place", "repository"))["repository"].alias("_best"))
    pointed = held.select(F.col("_n").alias("_pn"), F.col("repository").alias("_pointed")).distinct()
    rows = wanted.join(best, "_n").join(
        pointed, (F.col("_n") == F.col("_pn")) & (F.col("_guess") == F.col("_pointed")), "left"
    )
    return rows.select("file", F.coalesce("_pointed", "_best").alias("repository"))


def _segments(text: Column, length: Column, at: Column, parts: int) -> tuple[Column, Column]:
    """Start (one-based) and size of segment ``at`` of a text of ``length`` cut into ``parts``."""
    base = F.floor(length / parts).cast("int")
    longer = length % parts
    start = at * base + F.least(at, longer) + 1
    return start.cast("int"), (base + F.when(at < longer, 1).otherwise(0)).cast("int")


#: Words up to this length are indexed by what is left of them without a few letters, longer ones by pieces.
SHORT_WORD = 12


def _deletions(texts: DataFrame, text: str, reach: int) -> DataFrame:
    """Every text with up to ``reach`` letters deleted: ``_kept``, and ``_marks``, which tell where the deleted ones stood.

    A deleted letter with g kept ones before it has the mark g * (reach + 1), plus one for each deleted before it in the same gap.
    """
    base = reach + 1
    size = F.char_length(text)
    none = F.array().cast("array<int>")
    level = texts.select(text, F.lit("").alias("_done"), F.lit(0).alias("_at"), none.alias("_marks"))
    found = None
    for k in range(reach + 1):
        rest = F.col(text).substr(F.col("_at") + 1, size)
        here = level.select(text, F.concat("_done", rest).alias("_kept"), "_marks")
        found = here if found is None else found.unionByName(here)
        if k == reach:
            break
        # The next letter to go lies behind the ones that went before.
        level = level.where(F.col("_at") < size).withColumn("_p", F.explode(F.sequence(F.col("_at") + 1, size)))
        gap = (F.col("_p") - 1 - k) * base
        last = F.element_at("_marks", -1) if k else F.lit(None)
        same = F.coalesce(F.floor(last / base).cast("int") * base == gap, F.lit(False))
        mark = F.when(same, last + 1).otherwise(gap).cast("int")
        level = level.select(
            text,
            F.concat("_done", F.col(text).substr(F.col("_at") + 1, F.col("_p") - 1 - F.col("_at"))).alias("_done"),
            F.col("_p").alias("_at"),
            F.concat("_marks", F.array(mark)).alias("_marks"),
        )
    return found


def _near_short(asked: DataFrame, words: DataFrame, reach: int) -> DataFrame:
    """``_label``, ``_d``, ``_word``: labels with the short words at most ``reach`` edits away.

    Two texts that keep the same letters differ by no more edits than gaps between those letters hold deleted ones, counted on the
    fuller side of each gap, and the edit distance is the least of these numbers.  It depends on the marks only, so the index
    needs just the first word for each kept text and marks: a key has a few hundred rows at most, however many words share it.
    """
    index = (
        _deletions(words.where(F.char_length("_word") <= SHORT_WORD), "_word", reach)
        .groupBy("_kept", F.col("_marks").alias("_w"))
        .agg(F.min("_word").alias("_word"))
    )
    sought = _deletions(asked.where(F.char_length("_label") <= SHORT_WORD + reach), "_label", reach)
    pairs = sought.join(index, "_kept").withColumn("_d", F.size(F.array_union("_marks", "_w")))
    return pairs.where(F.col("_d") <= reach).select("_label", "_d", "_word")


def nearest_vocab(labels: DataFrame, vocabulary: DataFrame, label: str, word: str, below: int = 4) -> DataFrame:
    """Closest vocabulary word of each label with an edit distance below ``below`` (ties: first by name).

    Short words are found through deleted letters.  A longer word cut into ``below`` pieces keeps at least one piece unchanged
    within ``below - 1`` edits, moved by at most as many places; such words are indexed by (length, piece number, piece) and
    labels look up every piece they could share.  Equal keys instead of all pairs, with nothing lost.
    """
    reach = below - 1
    words = vocabulary.select(F.col(word).alias("_word")).where("_word is not null").distinct()
    asked = labels.select(F.col(label).alias("_label")).where("_label is not null").distinct()
    near = _near_short(asked, words, reach).unionByName(_near_long(asked, words, below))
    return (
        near.groupBy("_label")
        .agg(F.min(F.struct(F.col("_d"), F.col("_word"))).alias("b"))
        .select(F.col("_label").alias(label), F.col("b._word").alias("nearest"), F.col("b._d").alias("distance"))
    )


def _near_long(asked: DataFrame, words: DataFrame, below: int) -> DataFrame:
    reach = below - 1
    words = words.where(F.char_length("_word") > SHORT_WORD)
    pieces = words.select("_word", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("_at"))
    length = F.char_length("_word")
    start, size = _segments(F.col("_word"), length, F.col("_at"), below)
    pieces = pieces.select("_word", "_at", length.alias("_len"), F.substring("_word", start, size).alias("_piece"))

    size_of = F.char_length("_label")
    asked = asked.where(size_of > SHORT_WORD - reach)
    asked = asked.select(
        "_label", F.explode(F.sequence(F.greatest(size_of - reach, F.lit(SHORT_WORD + 1)), size_of + reach)).alias("_len")
    ).select("_label", "_len", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("_at"))
    start, size = _segments(F.col("_label"), F.col("_len"), F.col("_at"), below)
    asked = asked.withColumn("_start", start).withColumn("_size", size)
    asked = asked.select(
        "_label",
        "_len",
        "_at",
        "_size",
        F.explode(F.sequence(F.greatest(F.col("_start") - reach, F.lit(1)), F.col("_start") + reach)).alias("_from"),
    ).where(F.col("_from") + F.col("_size") - 1 <= F.char_length("_label"))
    asked = asked.select(
        "_label", "_len", "_at", F.substring(F.col("_label"), F.col("_from"), F.col("_size")).alias("_piece")
    ).distinct()
    pairs = asked.join(pieces, ["_len", "_at", "_piece"]).withColumn("_d", F.levenshtein("_label", "_word", reach))
    return pairs.where(F.col("_d") >= 0).select("_label", "_d", "_word")


#: Bytes of patterns that one scan of the documents looks for; a worker holds an automaton of about a hundred times that.
PATTERN_BYTES = 1 << 20


def texts_within(
    documents: DataFrame, patterns: DataFrame, document: str, text: str, key: str, pattern: str,
    least_bytes: int = 4, scan_bytes: int = PATTERN_BYTES,
) -> DataFrame:
    """Every pattern that stands anywhere in a document's text, case and outer white space of the pattern ignored: ``document``,
    ``key`` and ``at``, the place of its first occurrence in characters from 1.

    A scan looks for one chunk of patterns of bounded size at once, with an automaton of all of them, so a document's text is read once
    and never moved, whatever the lengths of the patterns and however many of them occur; more patterns take more scans.
    A pattern that stands in a third of all documents is found where they lie.  Patterns below ``least_bytes`` bytes, and
    null texts, are never found; equal patterns are looked for once.
    """
    named = patterns.select(key, F.lower(strip(F.col(pattern))).alias("_pattern")).where(F.octet_length("_pattern") >= least_bytes)
    wanted = named.select("_pattern", F.sha2("_pattern", 256).alias("_name")).distinct()
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("_pattern")), F.lit(0))).first()[0]
    chunks = -(-total // scan_bytes)
    context, found = documents.sparkSession.sparkContext, None
    rows = documents.select(document, F.lower(text).alias("_text")).where("_text IS NOT NULL")
    schema = T.StructType([rows.schema[document], T.StructField("_name", T.StringType()), T.StructField("at", T.IntegerType())])
    for i in range(max(1, chunks)):
        mine = wanted.where(F.pmod(F.xxhash64("_pattern"), F.lit(max(1, chunks))) == i)
        # Of a bounded size: about ``scan_bytes`` of text.
        sent = context.broadcast([(r["_pattern"], r["_name"]) for r in mine.toLocalIterator()])
        here = rows.mapInPandas(_finder(sent, document), schema)
        found = here if found is None else found.unionByName(here)
    names = named.select(key, F.sha2("_pattern", 256).alias("_name"))
    return found.join(names, "_name").select(document, key, "at")


def _finder(sent, document: str):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        if not sent.value:
            return
        known = ahocorasick.Automaton()
        for pattern, name in sent.value:
            known.add_word(pattern, (name, len(pattern)))
        known.make_automaton()
        for frame in frames:
            keys, names, places = [], [], []
            for k, text in zip(frame[document], frame["_text"]):
                first: dict[str, int] = {}
                for end, (name, size) in known.iter(text):
                    first.setdefault(name, end - size + 2)
                keys += [k] * len(first)
                names += first.keys()
                places += first.values()
            yield pd.DataFrame({document: pd.Series(keys, dtype=frame[document].dtype), "_name": pd.Series(names, dtype=object), "at": pd.Series(places, dtype="int32")})

    return find


def gold_in_input(items: DataFrame, golds: DataFrame, key: str, least_bytes: int = 4) -> DataFrame:
    """Items whose own gold answer, kept in a separate table, stands in their input (case ignored)."""
    rows = items.join(golds, key)
    gold = strip(F.col("gold"))
    return rows.where((F.octet_length(gold) >= least_bytes) & F.contains(F.lower("input"), F.lower(gold)))


def holdout_check(
    records: DataFrame, evaluation: DataFrame, key: str, acknowledged: bool, prompt: str | None = None
) -> DataFrame:
    """Training records of evaluation tasks: allowed only when the contamination is acknowledged.

    A record is of an evaluation task if it has its key or, where ``prompt`` names the text in both tables, a prompt that is the
    same but for case and white space.  Empty prompts are the same as none.
    """
    tasks = evaluation.select(F.col(key).alias("_task")).where("_task IS NOT NULL").distinct()
    rows = records.join(tasks, F.col(key) == F.col("_task"), "left")
    derived = F.col("_task").isNotNull()
    if prompt:
        print_of = lambda name: F.when(collapsed_text(F.col(prompt)) != "", F.sha2(collapsed_text(F.col(prompt)), 256)).alias(name)
        prompts = evaluation.select(print_of("_prompt")).where("_prompt IS NOT NULL").distinct()
        rows = rows.withColumn("_own", print_of("_own")).join(prompts, F.col("_own") == F.col("_prompt"), "left")
        derived = derived | F.col("_prompt").isNotNull()
    return rows.withColumn("benchmark_derived", derived).withColumn(
        "allowed", ~F.col("benchmark_derived") | F.lit(acknowledged)
    ).drop("_task", "_own", "_prompt")


def counter_delta_join(scrapes: DataFrame, windows: DataFrame, source: str, counters: Sequence[str]) -> DataFrame:
    """Counter growth over each run window: last scrape up to its end minus last scrape up to its start.

    Windows and scrapes are put on one time line per source, and the last scrape seen is carried to
    each window border, so a window is not paired with every scrape of its source.
    """
    from benchloom.operators.measure import last_seen

    points = scrapes.select(
        source, F.col("ts").alias("_ts"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_window"),
        F.col("scrape_id").alias("_tie"), F.struct(*counters).alias("_values"),
    )
    none = F.lit(None).cast(points.schema["_values"].dataType)
    for kind, time in ((1, "start_ts"), (2, "end_ts")):
        points = points.unionByName(
            windows.select(
                source, F.col(time).alias("_ts"), F.lit(kind).alias("_kind"), F.col("window_id").alias("_window"),
                F.col("window_id").alias("_tie"), none.alias("_values"),
            )
        )
    seen = last_seen(points, [source], ["_ts", "_kind", "_tie"], "_values", "_seen")
    borders = seen.where(F.col("_kind") > 0)
    pairs = borders.groupBy(source, F.col("_window").alias("window_id")).agg(
        F.max(F.when(F.col("_kind") == 1, F.col("_seen"))).alias("b"),
        F.max(F.when(F.col("_kind") == 2, F.col("_seen"))).alias("a"),
    )
    growth = {c: F.col(f"a.{c}") - F.col(f"b.{c}") for c in counters}
    reset = F.lit(False)
    for g in growth.values():
        reset = reset | F.coalesce(g < 0, F.lit(False))
    return pairs.select(
        source,
        "window_id",
        reset.alias("reset"),
        *[F.when(~reset, g).alias(c) for c, g in growth.items()],
    )
