"""A mix of sources in given proportions, by weighted fair queueing.

Every source is a queue: its documents in a shuffled order, then the same order again for as many passes as a
document may be taken.  A document's virtual finish time is the words of its source up to its end divided by the
source's weight, so at any virtual time the sources have been served in proportion to their weights, and a source
that has run empty leaves its share to the others.  The virtual time at which the budget is spent follows from
the sizes of the sources.  Documents that finish by then are taken whole; the one that a source is being served
from is taken up to its share.  Taken rows are sorted by finish time over the whole cluster, and the running
total of words is cut at the budget.

The shuffled order comes from hashes of id and text alone, so it is the same in every run and for every file
layout.  Queues are summed along a range-sorted sequence that crosses task borders, so a source with a third of
all documents is spread over a third of the tasks.

Defined results: a null text has no words and is never taken; null sources are one source, the last; rows with
equal id and text differ only in place in the queue; a source without words has target 0; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom.llm.common import salted, stored, table
from benchloom.operators.ordered import as_sequence, with_position, with_running_sum

#: Weights of the sources by code point, repeating; share of all words that the mix has; passes over a document.
WEIGHTS, SHARE, PASSES = (5, 2, 1), Fraction(3, 2), 2
#: So many sources are sent to every task (a few bytes each); more are joined in a salted shuffle.
FEW_SOURCES, SALTS = 10_000, 64


@F.pandas_udf(T.LongType())
def _words(texts: pd.Series) -> pd.Series:
    # Without an argument, split of bytes knows just the six characters U+0020 and U+0009 to U+000D.
    return texts.map(lambda t: len(t.encode("utf-8", "surrogatepass").split()) if t is not None else 0).astype("int64")


def weighed_sources(rows: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``absent``, ``name``, ``source_size``, ``weight`` of every source; null ones have ``absent``."""
    sizes = rows.groupBy("absent", "name").agg(F.sum("size").alias("source_size"))
    placed = with_position(as_sequence(sizes, ["absent", "name"], []))
    listed = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    weight = F.element_at(listed, (F.col("position") % len(weights) + 1).cast("int"))
    return stored(placed.select("absent", "name", "source_size", weight.alias("weight")), "sources")


def finish_of_budget(sources: DataFrame, share: Fraction, passes: int) -> tuple[int, Fraction]:
    """The number of sources and the virtual time at which the budget is spent.

    Sources whose passes end before the time of now are given whole and the rest of the budget is shared by the
    others, until no source ends early.  Each step is one row of sums, and each but the last ends further sources.
    """
    sums = lambda df: df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("source_size").cast("decimal(38,0)")), F.lit(0)).alias("size"),
        F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"),
    ).first()
    every = sums(sources)
    total, budget = int(every["size"]), int(every["size"]) * share
    at, ended = Fraction(0), -1
    while True:
        # passes * size <= at * weight, in whole numbers.
        left = F.col("source_size").cast("decimal(38,0)") * (passes * at.denominator) > F.col("weight").cast("decimal(38,0)") * F.lit(
            at.numerator
        )
        open_ones = sums(sources.where(left))
        if int(every["n"]) - int(open_ones["n"]) == ended or not open_ones["weight"]:
            return int(every["n"]), at
        ended = int(every["n"]) - int(open_ones["n"])
        at = (budget - passes * (total - int(open_ones["size"]))) / int(open_ones["weight"])


def beside_source(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    key = ["absent", "name"]
    if n <= FEW_SOURCES:
        return rows.join(F.broadcast(sources), key)
    copies = sources.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", salted(F.col("mark"), SALTS)).join(copies, [*key, "salt"]).drop("salt")


def queued(docs: DataFrame, weights: Sequence[int], share: Fraction, passes: int, seed: int) -> tuple[DataFrame, Fraction]:
    """Documents with ``upto``, the words of their source's queue up to their end in one pass, ``source_size``,
    ``weight``, ``target``; and the virtual time at which the budget is spent."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    name, absent = F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("absent")
    rows = stored(docs.select("doc_id", name, absent, _words("text").alias("size"), mark.alias("mark")), "sizes")
    sources = weighed_sources(rows, weights)
    n, at = finish_of_budget(sources, share, passes)
    sequence = with_running_sum(as_sequence(rows, ["absent", "name"], ["mark", "doc_id", "size"]), ["absent", "name"], "size", "upto")
    target = F.lit(float(passes)) * F.col("source_size")
    if at:
        shared = F.col("weight") * F.lit(float(at.numerator)) / F.lit(float(at.denominator))
        target = F.least(target, shared)
    return beside_source(sequence, sources, n).withColumn("target", target), at


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, passes: int = PASSES, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents.

    The mix has a row for each taken piece, in the order of virtual finish times: ``place`` and ``row`` (``doc_id``,
    ``pass_number`` from 0, ``words``, ``finish``, ``begin``: words of the mix before it).  The documents have
    ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.
    """
    documents, at = queued(docs, weights, share, passes, seed)
    documents = stored(documents.withColumn("row", F.monotonically_increasing_id()).drop("_bucket", "_row"), "queue")
    total = documents.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    budget = int(total * share)
    # A source's words up to the end of the mix: its share of the virtual time, at most its passes.
    served = F.least(F.col("source_size") * passes, F.floor(F.col("target")).cast("long"))
    upto = F.col("upto") + F.col("pass_number") * F.col("source_size")
    words = F.least("size", F.greatest(F.lit(0), served - (upto - F.col("size"))))
    pieces = (
        documents.withColumn("pass_number", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
        .withColumn("words", words.cast("long"))
        .where("words > 0")
        .select("row", "doc_id", "pass_number", "words", (F.least(upto, served) / F.col("weight")).alias("finish"), "mark")
    )
    line = with_running_sum(as_sequence(pieces, [], ["finish", "mark", "row", "pass_number"]), [], "words", "end")
    line = line.withColumn("begin", F.col("end") - F.col("words")).where(F.col("begin") < F.lit(budget))
    cut = F.least("words", F.lit(budget) - F.col("begin"))
    line = line.withColumn("words", cut.cast("long")).select("row", "doc_id", "pass_number", "words", "finish", "begin")
    taken = line.groupBy("row").agg(F.sum("words").alias("taken"))
    result = documents.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return line, result


def op13_source_mix(spark, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents"))[1]


def _oracle() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    share, passes = f"{SHARE.numerator}::double / {SHARE.denominator}", PASSES
    return f"""WITH d AS (SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS name,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size,
        md5('13:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) AS mark FROM documents),
      s AS (SELECT absent, name, sum(size)::bigint AS source_size, CASE (row_number() OVER (ORDER BY absent, name) - 1) % {len(WEIGHTS)}
        {weights} END AS weight FROM d GROUP BY absent, name),
      o AS (SELECT *, {passes} * source_size / weight AS ends FROM s),
      -- If all sources up to this one in the order of their ends are given whole, the rest is shared by the others.
      c AS (SELECT *, (SELECT {share} * sum(source_size) FROM s) - coalesce(sum({passes} * source_size) OVER w, 0) AS room,
        (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS open_weight FROM o
        WINDOW w AS (ORDER BY ends, absent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      v AS (SELECT room, open_weight FROM c WHERE room <= ends * open_weight ORDER BY ends, absent, name LIMIT 1),
      t AS (SELECT absent, name, source_size, weight, least({passes}.0::double * source_size, weight * room / open_weight) AS target FROM s, v),
      q AS (SELECT d.*, source_size, target, least({passes} * source_size, floor(target)::bigint) AS served,
        sum(size) OVER (PARTITION BY absent, name ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begin_at
        FROM d JOIN t USING (absent, name))
      SELECT doc_id, size, source_size, target, (SELECT sum(least(size, greatest(0, served - (begin_at + p * source_size))))
        FROM range({passes}) r(p))::bigint AS taken FROM q"""


QUERIES = {"op13_source_mix": op13_source_mix}
ORACLES = {"op13_source_mix": _oracle()}
