"""Recurring lines by a tree of line templates, with DataFrame operations only.

A line is split at white space; a token with a digit is a variable field.  The tree has fixed depth: the number of
tokens, then the leading tokens.  Only leaves that hold enough lines of more than one document are looked at.
Inside a leaf, a token that few lines have at its place is a variable field too, so lines that differ there share
a template; if too few constant tokens would be left, the line is a template by itself: with its fields if at
least half of its tokens and letters are outside of them, else word for word, so rows of numbers and lines of texts
without spaces recur only if they are equal.  A template that stands in enough documents recurs: it stays where it stands first - the smallest id, then the first line - and is
dropped everywhere else.  If asked for, long lines that are equal word for word recur from two documents on.

Texts are shuffled twice (to find the leaves' lines, and to cut the documents); in between only hashes, counts
and places move.  Hot lines and templates are summed before each shuffle.

Defined results: a null text stays null and has no lines; blank lines are never dropped; rows with equal id and
text are one document and get the same result each; a null id comes after all others; other columns pass through;
no rows give no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import stored, table

#: Leading tokens in the tree, documents that make a template recur, share of constant tokens.
DEPTH, MIN_DOCS, SIMILARITY = 3, 10, 0.8
#: Where long equal lines are asked for: their least number of words, and the documents that make one recur.
LONG_WORDS, LONG_DOCS = 10, 2
SPACE = r"[ \t\r\f]+"
FIELD = "<*>"


def numbered_lines(docs: DataFrame) -> DataFrame:
    """The lines that are not blank, tidied, with ``doc_id``, ``mark`` (a hash of the whole text) and ``place``."""
    # Texts are hashed before they are cut: beside the cut, a text would be hashed once for each of its lines.
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.split("text", "\n").alias("lines"))
    lines = marked.select("doc_id", "mark", F.posexplode("lines").alias("place", "line"))
    return lines.where(F.btrim("line", F.lit(" \t\r\f")) != "").withColumn("line", tidied(F.col("line")))


def tidied(line: Column) -> Column:
    """The line with single spaces; the pattern runs only where it matches."""
    ragged = reduce(or_, [F.contains(line, F.lit(s)) for s in ("  ", "\t", "\r", "\f")])
    return F.trim(F.when(ragged, F.regexp_replace(line, SPACE, " ")).otherwise(line))


def masked(single: Column) -> Column:
    """A tidied line with its tokens with digits as fields."""
    token = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
    return F.when(single.rlike("[0-9]"), F.regexp_replace(single, token, FIELD)).otherwise(single)


def by_itself() -> Column:
    """The template of a line by itself: its fields count as such if they are at most half of its tokens and
    letters, else it is the whole line."""
    fields = (F.length("masked") - F.length(F.replace("masked", F.lit(FIELD), F.lit("")))) / len(FIELD)
    outside = F.length("masked") - fields * len(FIELD) - (F.col("n") - 1)
    letters = F.col("width") - (F.col("n") - 1)
    few = (fields * 2 <= F.col("n")) & (outside * 2 >= letters)
    return F.when(few, F.xxhash64("line_id", F.lit(2))).otherwise(F.xxhash64("raw", F.lit(3)))


def dropped_lines(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY
) -> DataFrame:
    """Places (from 0) of the lines to drop of every document that has some: ``doc_id``, ``mark``, ``drop``."""
    lines = (
        numbered_lines(docs)
        .withColumn("masked", masked(F.col("line")))
        .select(
            "doc_id",
            "mark",
            "place",
            "masked",
            F.xxhash64("line").alias("raw"),
            F.length("line").alias("width"),
            (F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1).alias("n"),
            F.substring_index("masked", " ", depth).alias("lead"),
        )
    )
    leaf = ["n", "lead"]
    # The rows of a document share its mark, so two marks or two ids are two documents.
    document = F.xxhash64("doc_id", "mark")
    leaves = (
        lines.groupBy(*leaf)
        .agg(F.count(F.lit(1)).alias("lines"), F.min(document).alias("a"), F.max(document).alias("b"))
        .where((F.col("lines") >= min_docs) & (F.col("a") < F.col("b")))
        .select(*leaf)
    )
    held = stored(lines.join(leaves, leaf, "left_semi").withColumn("line_id", F.xxhash64("masked", "n")), "lines")

    kinds = held.groupBy("masked", "n", "lead", "line_id").agg(F.count(F.lit(1)).alias("weight"))
    tokens = kinds.select(*leaf, "line_id", "weight", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    tokens = stored(tokens.where(F.col("at") >= depth), "tokens")
    known = (
        tokens.groupBy(*leaf, "at", "token")
        .agg(F.sum("weight").alias("support"))
        .where((F.col("support") >= min_docs) & (F.col("token") != FIELD))
        .drop("support")
    )
    one = F.xxhash64("at", "token")
    constant = F.col("known").isNotNull()
    # A template: a hash over its places and constant tokens, with the leaf.
    generalised = (
        tokens.join(known.withColumn("known", F.lit(True)), [*leaf, "at", "token"], "left")
        .groupBy("line_id")
        .agg(
            F.sum(constant.cast("int")).alias("constants"),
            F.bit_xor(F.when(constant, one).otherwise(F.lit(0).cast("long"))).alias("general"),
        )
    )
    leading = F.size(F.filter(F.split("lead", " "), lambda t: t != FIELD))
    templates = kinds.join(generalised, "line_id", "left").select(
        "line_id",
        F.when(
            (leading + F.coalesce("constants", F.lit(0))) >= F.col("n") * similarity,
            F.xxhash64(*leaf, F.coalesce("general", F.lit(0).cast("long")), F.lit(1)),
        )
        .alias("template"),
    )
    placed = stored(
        held.select("doc_id", "mark", "place", "line_id", by_itself().alias("own"))
        .join(templates, "line_id")
        .select("doc_id", "mark", "place", F.coalesce("template", "own").alias("template")),
        "templates",
    )
    return _beyond_first(placed, min_docs).groupBy("doc_id", "mark").agg(F.collect_set("place").alias("drop"))


def _beyond_first(placed: DataFrame, min_docs: int) -> DataFrame:
    """The places of recurring templates (``doc_id``, ``mark``, ``place``, ``template``) but the first of each."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "place")
    recurring = (
        placed.groupBy("template", "doc_id", "mark")
        .agg(F.min(place).alias("first"))
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("documents"), F.min("first").alias("first"))
        .where(F.col("documents") >= min_docs)
        .select("template", "first")
    )
    return placed.join(recurring, "template").where(place != F.col("first")).select("doc_id", "mark", "place")


def long_equal_lines(docs: DataFrame, words: int = LONG_WORDS, min_docs: int = LONG_DOCS) -> DataFrame:
    """Places of the lines of at least ``words`` words that stand in ``min_docs`` documents, but the first of each."""
    lines = numbered_lines(docs)
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    # Two hashes: a line goes only if both agree with another's.
    template = F.struct(F.xxhash64("line"), F.xxhash64("line", F.lit(4)))
    placed = stored(lines.where(n >= words).select("doc_id", "mark", "place", template.alias("template")), "long-lines")
    return _beyond_first(placed, min_docs)


def without_recurring_lines(
    docs: DataFrame,
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    similarity: float = SIMILARITY,
    long_words: int | None = None,
) -> DataFrame:
    """``docs`` with the recurring lines cut out of ``text``, and ``__lines`` and ``__dropped`` (counts).  With
    ``long_words``, equal lines of so many words go from LONG_DOCS documents on."""
    drop = dropped_lines(docs, depth, min_docs, similarity)
    if long_words is not None:
        places = drop.select("doc_id", "mark", F.explode("drop").alias("place"))
        places = places.unionByName(long_equal_lines(docs, long_words))
        drop = places.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("drop"))
    drop = drop.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    own = F.xxhash64("text") == F.col("__mark")
    joined = docs.join(drop, docs["doc_id"].eqNullSafe(F.col("__id")) & own, "left")
    # The text is cut in a step of its own: inside the transform it would be cut once for each kept line.
    kept = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("drop"))
    cut = F.concat_ws("\n", F.transform(kept, lambda i: F.element_at("__parts", i + 1)))
    return (
        joined.withColumn("__parts", F.split("text", "\n"))
        .withColumn("__lines", F.coalesce(F.size("__parts"), F.lit(0)))
        .withColumn("__dropped", F.coalesce(F.size("drop"), F.lit(0)))
        .withColumn("text", F.when(F.col("drop").isNull(), F.col("text")).otherwise(cut))
        .drop("__id", "__mark", "__parts", "drop")
    )


def op1_line_dedup(spark, folder: str) -> DataFrame:
    cut = without_recurring_lines(table(spark, folder, "documents"))
    return cut.select(
        "doc_id",
        F.greatest("__lines", F.lit(0)).cast("long").alias("n_lines"),
        F.greatest("__dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.md5(F.encode("text", "UTF-8")).alias("kept_md5"),
    )


SQL = """
WITH numbered AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), split AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS place FROM numbered
), lines AS (
  SELECT *, string_split(masked, ' ') AS tokens FROM (
    SELECT doc_id, place,
           regexp_replace(regexp_replace(regexp_replace(line, '[ \\t\\r\\f]+', ' ', 'g'), '^ | $', '', 'g'),
                          '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked
    FROM split)
  WHERE masked <> ''
), keyed AS (
  SELECT *, len(tokens) AS n, array_to_string(tokens[1:3], ' ') AS head FROM lines
), leaves AS (
  SELECT n, head FROM keyed GROUP BY n, head HAVING count(*) >= 10 AND count(DISTINCT doc_id) > 1
), held AS (
  SELECT keyed.* FROM keyed SEMI JOIN leaves USING (n, head)
), kinds AS (
  SELECT masked, n, head, any_value(tokens) AS tokens, count(*) AS weight FROM held GROUP BY masked, n, head
), tokens AS (
  SELECT masked, n, head, weight, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM kinds
), known AS (
  SELECT n, head, pos, token FROM tokens WHERE token <> '<*>' GROUP BY n, head, pos, token HAVING sum(weight) >= 10
), templates AS (
  SELECT masked, n,
         count(*) FILTER (WHERE (t.pos <= 3 AND t.token <> '<*>') OR (t.pos > 3 AND k.token IS NOT NULL)) AS constants,
         string_agg(CASE WHEN t.pos <= 3 OR k.token IS NOT NULL THEN t.token ELSE '<*>' END, ' ' ORDER BY t.pos) AS general
  FROM tokens t LEFT JOIN known k USING (n, head, pos, token) GROUP BY masked, n
), placed AS (
  SELECT doc_id, place, CASE WHEN constants >= n * 0.8 THEN 'g ' || general ELSE 'l ' || masked END AS template
  FROM held JOIN templates USING (masked, n)
), recurring AS (
  SELECT template, min(struct_pack(d := doc_id, p := place)) AS first
  FROM placed GROUP BY template HAVING count(DISTINCT doc_id) >= 10
), cut AS (
  SELECT doc_id, list(DISTINCT place) AS places FROM placed JOIN recurring USING (template)
  WHERE struct_pack(d := doc_id, p := place) <> first GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text
  FROM split LEFT JOIN cut USING (doc_id) WHERE places IS NULL OR NOT list_contains(places, place) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(len(cut.places), 0)::BIGINT AS n_dropped,
       md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END) AS kept_md5
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": SQL}
