"""How the vocabulary of each source departs from its language and from the language's other sources.

Terms are counted per language and source; a language keeps the terms of enough of its documents.  Each group
gives each kept term a smoothed share in billionths, in whole numbers throughout.

Terms that a source overuses: a term whose count in the group is not lower, whose count in the language is not
higher and whose text is earlier stands before another in the ranking, whatever the totals are.  So each task
keeps only the skyband of its rows - terms with fewer than k such dominators - without knowing any total; the
skybands of a group are merged in bounded parts, and the survivors are ranked exactly.

Distances between sources: terms are dealt into parts and sources into blocks; a task holds one part of terms
for two blocks and gives one partial sum for each pair of their sources.  A term that neither source has adds the same
amount for all terms, so only counted terms are ever sent.

Defined results: null text, language and source are empty strings; a group without terms, or a language that
keeps none, has distance rows and no term rows; repeated rows are documents of their own; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.llm.common import stored, table

DOCS, TOP, SMOOTHING, UNIT = 30, 50, 5, 1_000_000_000
#: Terms that a task counts before it hands them on.
HELD = 600_000
#: Rows of one part of a skyband to be merged; terms and sources of one part for distances.
BAND_ROWS, PART_TERMS, BLOCK = 100_000, 1_000, 256
#: Letters become small, other bytes below 128 become spaces, all others stay.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
TERM_COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; an empty term marks that the group occurs."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in groups.items():
            terms = [b"", *times]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(lang, len(terms)),
                    pa.repeat(source, len(terms)),
                    pa.array(terms, pa.binary()).cast(pa.string(), safe=False),
                    pa.array([0, *times.values()], pa.int64()),
                    pa.array([0, *map(docs.__getitem__, times)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        columns = [batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())]
        for lang, source, text in zip(*columns):
            times, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            terms = terms_of(text.as_py())
            held -= len(times)
            times.update(terms)
            docs.update(set(terms))
            held += len(times)
            if held > HELD:
                yield from rows()
                groups, held = {}, 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    found = docs.select(*text).mapInArrow(_counted, TERM_COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * kept)) by long division, so that no product leaves 64 bits."""
    rest, by = count + SMOOTHING, total + SMOOTHING * kept
    found = F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + F.call_function("div", rest, by)
        rest = rest % by
    return found + 1


# ---------------------------------------------------------------- skybands


def skyband(group: np.ndarray, lang: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Places of the terms with fewer than ``k`` dominators among these of one group.

    In the order of group count, language count and term every dominator comes first, so a term is compared with the
    terms kept before it and those of its own chunk; a term with k dominators has k of them in the skyband.
    """
    order = np.lexsort((term, lang, -group))
    kept = order[:0]
    for start in range(0, len(order), 512):
        chunk = order[start : start + 512]
        before = (lang[kept][None, :] <= lang[chunk][:, None]) & (term[kept][None, :] < term[chunk][:, None])
        own = (lang[chunk][None, :] <= lang[chunk][:, None]) & (term[chunk][None, :] < term[chunk][:, None])
        own &= np.arange(len(chunk))[None, :] < np.arange(len(chunk))[:, None]
        kept = np.concatenate([kept, chunk[before.sum(axis=1) + own.sum(axis=1) < k]])
    return kept


def _band(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    if len(rows) <= k:
        return rows
    rank = np.argsort(np.argsort(rows["term"].to_numpy(object), kind="stable"), kind="stable")
    return rows.iloc[skyband(rows["n"].to_numpy(), rows["in_lang"].to_numpy(), rank, k)]


BAND = "lang string, source string, term string, n long, in_lang long"


def local_bands(rows: DataFrame, k: int) -> DataFrame:
    """The skyband of each group in each task; a task holds its skybands and one batch."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands: dict[tuple, pd.DataFrame] = {}
        for frame in frames:
            for key, part in frame.groupby(["lang", "source"], sort=False):
                bands[key] = _band(pd.concat([bands[key], part]) if key in bands else part, k)
        yield from bands.values()

    return rows.select("lang", "source", "term", "n", "in_lang").mapInPandas(work, BAND)


def merged_bands(rows: DataFrame, k: int, part_rows: int = BAND_ROWS) -> DataFrame:
    """Local skybands merged; a group whose skybands are large is merged in parts, each a skyband that still holds the group's."""
    bands = stored(local_bands(rows, k), "bands")
    sizes = bands.groupBy("lang", "source").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    dealt = bands.join(sizes, ["lang", "source"]).withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
    merge = lambda frame: _band(frame[["lang", "source", "term", "n", "in_lang"]], k)
    return dealt.groupBy("lang", "source", "part").applyInPandas(merge, BAND)


# ---------------------------------------------------------------- distances


def _pair_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """For two blocks of sources and one part of terms: by pair, the distance over the part's terms less what they
    would add if neither source had them."""
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    sources, at = np.unique(frame["source"].to_numpy(object), return_inverse=True)
    marks, rows = frame["term"].isna().to_numpy(), frame["term"].notna().to_numpy()
    floor_of, block = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    floor_of[at[marks]], block[at[marks]] = frame["p"].to_numpy()[marks], frame["block"].to_numpy()[marks]
    left, right = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
    sums = np.zeros((len(left), len(right)), np.int64)
    term, at, p = pd.factorize(frame["term"].to_numpy(object)[rows])[0], at[rows], frame["p"].to_numpy(np.int64)[rows]
    order = np.argsort(term, kind="stable")
    term, at, p = term[order], at[order], p[order]
    base = np.abs(floor_of[left][:, None] - floor_of[right][None, :])
    for start in range(0, (term[-1] + 1 if len(term) else 0), 1024):
        a, b = np.searchsorted(term, [start, start + 1024])
        n = int(term[b - 1]) + 1 - start
        dense = np.repeat(floor_of[:, None], n, axis=1)
        dense[at[a:b], term[a:b] - start] = p[a:b]
        for row, source in enumerate(left):
            sums[row] += np.abs(dense[right] - dense[source][None, :]).sum(axis=1)
        sums -= n * base
    x, y = np.nonzero((sources[left][:, None] < sources[right][None, :]) if i == j else np.ones(sums.shape, bool))
    return pd.DataFrame({"lang": frame["lang"].iloc[0], "source": sources[left[x]], "item": sources[right[y]], "value": sums[x, y]})


def pair_distances(rows: DataFrame, groups: DataFrame, part_terms: int, block: int) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` for every ordered pair of sources of a language."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    none = share(F.lit(0), F.col("total"), F.col("kept"))
    known = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    parts = F.ceil(F.col("kept") / part_terms).cast("int")
    known = stored(known.withColumn("none", F.when(F.col("kept") > 0, none).otherwise(0)).withColumn("parts", parts), "groups")
    part = F.pmod(F.xxhash64("term", F.lit(11)), F.col("parts")).cast("int")
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    counted = rows.join(known, ["lang", "source"]).select("lang", "source", "block", "blocks", "term", p.alias("p"), part.alias("part"))
    marks = known.where("kept > 0").select(
        "lang", "source", "block", "blocks", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = counted.unionByName(marks).withColumn("with", other)
    dealt = dealt.select("lang", "source", "block", "term", "p", "part", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    found = dealt.groupBy("lang", "part", "i", "j").applyInPandas(_pair_sums, "lang string, source string, item string, value long")
    sums = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # Every pair of sources is a row of the result; sources without any term are among them.
    left = known.select("lang", "source", "none", "kept")
    right = known.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    every = left.join(right, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    value = F.coalesce("value", F.lit(0)) + F.col("kept") * F.abs(F.col("none") - F.col("item_none"))
    return every.select("lang", "source", "item", value.alias("value"))


# ---------------------------------------------------------------- the audit


def divergence(
    docs: DataFrame, least_docs: int = DOCS, top: int = TOP, part_terms: int = PART_TERMS, block: int = BLOCK, band_rows: int = BAND_ROWS
) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value``, ``rank`` for every group of ``docs``."""
    counts = stored(term_counts(docs), "counts")
    in_lang = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    in_lang = in_lang.where(F.col("docs") >= least_docs).drop("docs")
    rows = stored(counts.drop("docs").join(in_lang, ["lang", "term"]), "kept")
    langs = in_lang.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.na.fill(0, ["total", "lang_total", "kept"]), "totals")

    pairs = pair_distances(rows, groups, part_terms, block).withColumn("part", F.lit("pair"))
    own = share(F.col("n"), F.col("total"), F.col("kept"))
    of_lang = share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    terms = merged_bands(rows, top, band_rows).join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (own - of_lang).alias("value")
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranks = lambda df: df.withColumn("rank", F.row_number().over(ranked))
    best = ranks(terms.where("value > 0")).where(F.col("rank") <= top)
    return ranks(pairs).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence_audit(spark, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))


def _oracle() -> str:
    p = lambda n, total: f"1 + ({UNIT}::hugeint * ({n} + {SMOOTHING})) // ({total} + {SMOOTHING} * v)"
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
        FROM documents),
      w AS (SELECT lang, source, r, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{capital}', '{small}')
        AS term FROM d),
      k AS MATERIALIZED (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {DOCS}),
      g AS (SELECT DISTINCT lang, source FROM d),
      c AS MATERIALIZED (SELECT g.lang, g.source, k.term, k.in_lang, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang,
        source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
      t AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v,
        sum(in_lang) OVER (PARTITION BY lang, source) AS lang_total FROM c),
      p AS MATERIALIZED (SELECT lang, source, term, n, {p("n", "total")} AS p, {p("in_lang", "lang_total")} AS q FROM t),
      pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND
        a.source <> b.source LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang =
        y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
      term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
      SELECT lang, source, part, item, value::bigint AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC,
        item))::int AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= {TOP}"""


QUERIES = {"op11_divergence_audit": op11_divergence_audit}
ORACLES = {"op11_divergence_audit": _oracle()}
