"""Joins over documents, orders, line items, parts and events."""

from pyspark.sql import functions as F

from benchloom.operators import joins as ops
from benchloom.plans.registry import query, r4

_SHARDS = "cast(CASE WHEN lang = 'en' THEN 30 WHEN lang = 'fr' THEN 12 ELSE 5 END AS int)"


def _datasets(t):
    count = F.when(F.col("lang") == "en", 30).when(F.col("lang") == "fr", 12).otherwise(5)
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("items")).select(
        F.col("lang").alias("task"), "items", count.cast("int").alias("shard_count")
    )


@query(
    "missing_shards",
    f"""SELECT task, cast(s AS int) AS shard FROM (SELECT DISTINCT lang AS task, {_SHARDS} AS n FROM documents), range(1, 31) r(s)
        WHERE s <= n AND NOT EXISTS (SELECT 1 FROM results x WHERE x.task = task AND x.shard = s AND x.pass AND x.model < 'src13')""".replace(
        "x.task = task", "x.task = d.task"
    ).replace("AS n FROM documents)", "AS n FROM documents) d"),
)
def _(t):
    covered = t.results.where(F.col("pass") & (F.col("model") < "src13")).select("task", "shard")
    return ops.missing_shards(_datasets(t), covered, "task")


_MISSING = f"""SELECT d.task, cast(s AS int) AS shard FROM (SELECT DISTINCT lang AS task, {_SHARDS} AS n FROM documents) d,
  range(1, 31) r(s) WHERE s <= n AND NOT EXISTS (SELECT 1 FROM results x WHERE x.task = d.task AND x.shard = s)"""


@query("next_missing", f"SELECT task, min(shard) AS next_shard FROM ({_MISSING}) GROUP BY task")
def _(t):
    return ops.next_missing(_datasets(t), t.results.select("task", "shard"), "task")


@query(
    "coverage_catalog",
    f"""WITH c AS (SELECT task, count(DISTINCT shard) AS covered, {r4('(count(CASE WHEN pass THEN 1 END) / count(*))')} AS score FROM results
          WHERE task <> 'de' GROUP BY task),
        m AS (SELECT d.task, cast(s AS int) AS shard FROM (SELECT DISTINCT lang AS task, {_SHARDS} AS n FROM documents) d,
          range(1, 31) r(s) WHERE s <= n AND NOT EXISTS
          (SELECT 1 FROM results x WHERE x.task = d.task AND x.shard = s AND x.task <> 'de')),
        g AS (SELECT task, count(*) AS missing, min(shard) AS next_shard FROM m GROUP BY task)
        SELECT d.task, d.items, d.n AS shard_count, coalesce(covered, 0) AS covered, coalesce(missing, 0) AS missing,
          next_shard, score FROM (SELECT lang AS task, {_SHARDS} AS n, count(*) AS items FROM documents GROUP BY ALL) d
        LEFT JOIN c USING (task) LEFT JOIN g USING (task)""",
)
def _(t):
    covered = t.results.where(F.col("task") != "de")
    from benchloom.functions.numbers import round4

    scores = covered.groupBy("task").agg(round4(F.count_if("pass") / F.count(F.lit(1))).alias("score"))
    return ops.coverage_catalog(_datasets(t), covered.select("task", "shard"), scores, "task")


@query(
    "join_results_to_checkpoint",
    """SELECT question, l_orderkey, passed FROM (SELECT l_partkey % 3000 AS question, o.o_orderkey AS l_orderkey,
         l_returnflag = 'R' AS passed, row_number() OVER (PARTITION BY l_partkey % 3000 ORDER BY o_orderdate, o_orderkey,
         l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS n
       FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o_orderstatus <> 'P') WHERE n = 1""",
)
def _(t):
    entries = t.orders.where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("l_orderkey"), F.struct("o_orderdate", "o_orderkey").alias("entry_index")
    )
    results = t.lineitem.select(
        "l_orderkey",
        (F.col("l_partkey") % 3000).alias("question"),
        (F.col("l_returnflag") == "R").alias("passed"),
        F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").alias("result_index"),
    )
    return ops.join_results_to_checkpoint(entries, results, "l_orderkey", "question").select(
        "question", "l_orderkey", "passed"
    )


def _task_sets(t):
    actual = t.lineitem.where(F.col("l_quantity") > 25).select(F.col("l_orderkey").alias("task"))
    expected = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("task"))
    return actual, expected


_ACTUAL = "(SELECT DISTINCT l_orderkey AS task FROM lineitem WHERE l_quantity > 25)"
_EXPECTED = "(SELECT o_orderkey AS task FROM orders WHERE o_orderstatus <> 'P')"


@query(
    "task_set_diff",
    f"""SELECT task, 'missing' AS side FROM {_EXPECTED} e WHERE task NOT IN (SELECT task FROM {_ACTUAL} a)
        UNION ALL SELECT task, 'extra' FROM {_ACTUAL} a WHERE task NOT IN (SELECT task FROM {_EXPECTED} e)""",
)
def _(t):
    return ops.task_set_diff(*_task_sets(t), "task")


@query(
    "task_set_summary",
    f"""SELECT (SELECT count(*) FROM {_EXPECTED}) AS expected, (SELECT count(*) FROM lineitem WHERE l_quantity > 25) AS actual,
        (SELECT count(*) FROM {_EXPECTED} WHERE task NOT IN (SELECT task FROM {_ACTUAL})) AS missing,
        (SELECT count(*) FROM {_ACTUAL} WHERE task NOT IN (SELECT task FROM {_EXPECTED})) AS extra, false AS matches""",
)
def _(t):
    return ops.task_set_summary(*_task_sets(t), "task")


@query(
    "mark_loaded",
    """SELECT p_partkey, path, instance, coalesce(n, 0) AS loaded FROM (SELECT p_partkey, concat('/m/', p_partkey) AS path FROM part)
       LEFT JOIN (SELECT concat('/m/', l_partkey) AS path, concat('inst-', l_suppkey) AS instance, count(*) OVER (PARTITION BY l_partkey)
       AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45)) USING (path)""",
)
def _(t):
    path = lambda c: F.concat(F.lit("/m/"), F.col(c).cast("string")).alias("path")
    instances = t.lineitem.where(F.col("l_quantity") > 45).select(
        path("l_partkey"), F.concat(F.lit("inst-"), F.col("l_suppkey").cast("string")).alias("instance")
    )
    return ops.mark_loaded(t.part.select("p_partkey", path("p_partkey")), instances)


def _offers(t):
    offers = t.orders.select(
        F.col("o_custkey").alias("listing"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 3000).cast("string")).alias("model"),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("W"), (F.col("o_orderkey") % 9).cast("string"))).alias(
            "weights_id"
        ),
    )
    live = t.part.where(F.col("p_size") > 5).select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model"),
        F.concat(F.lit("w"), (F.col("p_size") % 9).cast("string")).alias("weights_id"),
    )
    return offers, live


_SERVED = """SELECT listing, o.model, o.weights_id, NOT (coalesce(o.weights_id, '') <> '' AND
    lower(o.weights_id) <> coalesce(lower(l.weights_id), '')) AS served FROM
  (SELECT o_custkey AS listing, concat('m', o_orderkey % 3000) AS model, CASE WHEN o_orderkey % 5 > 0 THEN
    concat('W', o_orderkey % 9) END AS weights_id FROM orders) o LEFT JOIN
  (SELECT concat('m', p_partkey) AS model, concat('w', p_size % 9) AS weights_id FROM part WHERE p_size > 5)
  l ON l.model = o.model"""


@query("offers_vs_live", _SERVED)
def _(t):
    return ops.offers_vs_live(*_offers(t))


@query(
    "offer_summary",
    f"""SELECT listing, count(CASE WHEN served THEN 1 END) AS served, count(CASE WHEN NOT served THEN 1 END) AS changed FROM (SELECT listing, model, bool_and(served) AS
        served FROM ({_SERVED}) GROUP BY ALL) GROUP BY listing""",
)
def _(t):
    return ops.offer_summary(*_offers(t))


@query(
    "allowlist_check",
    """SELECT p_partkey, p_brand AS name FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice > 999.5)
       AND EXISTS (SELECT 1 FROM part WHERE p_retailprice > 999.5)""",
)
def _(t):
    rows = t.part.select("p_partkey", F.col("p_brand").alias("name"))
    return ops.allowlist_check(rows, "name", t.part.where(F.col("p_retailprice") > 999.5).select(F.col("p_brand").alias("name")))


_NORMAL = r"""array_to_string(list_filter(string_split_regex(lower(regexp_replace({f}, '\.[^.]*$', '')), '[-_.]+'),
  lambda p: p <> '' AND p <> 'qat'), '-')"""


@query(
    "source_candidates",
    f"""WITH w AS (SELECT DISTINCT upper(file) AS file FROM files),
        h AS (SELECT CASE WHEN file_id % 2 = 0 THEN owner ELSE concat('unsloth/', regexp_extract(file, '(?i)^(.+?)-ud-', 1),
          '-GGUF') END AS repository, file_id AS place, replace(file, '-', '_') AS held FROM files WHERE brand <> 'Brand#1'),
        j AS (SELECT w.file, h.repository, min(h.place) AS place, min(CASE WHEN h.repository = concat('unsloth/',
          nullif(regexp_extract(w.file, '(?i)^(.+?)-ud-', 1), ''), '-GGUF') THEN 0 ELSE 1 END) AS first FROM w JOIN h ON
          {_NORMAL.format(f='w.file')} = {_NORMAL.format(f='h.held')} GROUP BY ALL)
        SELECT file, arg_min(repository, struct_pack(a := first, b := place, c := repository)) AS repository FROM j GROUP BY file""",
)
def _(t):
    held = t.files.where(F.col("brand") != "Brand#1").select(
        F.when(F.col("file_id") % 2 == 0, F.col("owner"))
        .otherwise(F.concat(F.lit("unsloth/"), F.regexp_extract("file", "(?i)^(.+?)-ud-", 1), F.lit("-GGUF")))
        .alias("repository"),
        F.col("file_id").alias("place"),
        F.translate("file", "-", "_").alias("file"),
    )
    return ops.source_candidates(t.files.select(F.upper("file").alias("file")), held)


_LABELS = """SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'e', '') WHEN 1 THEN concat('x', p_name) WHEN 2 THEN
  concat(p_name, p_size % 10) ELSE concat(p_brand, p_name) END AS label FROM part"""


@query(
    "nearest_vocab",
    f"""SELECT label, arg_min(w, struct_pack(a := d, b := w)) AS nearest, cast(min(d) AS int) AS distance FROM (
          SELECT label, w, levenshtein(label, w) AS d FROM ({_LABELS}), (SELECT DISTINCT p_name AS w FROM part)) WHERE d < 4
        GROUP BY label""",
)
def _(t):
    k = F.col("p_partkey") % 4
    label = (
        F.when(k == 0, F.replace("p_name", F.lit("e"), F.lit("")))
        .when(k == 1, F.concat(F.lit("x"), F.col("p_name")))
        .when(k == 2, F.concat(F.col("p_name"), (F.col("p_size") % 10).cast("string")))
        .otherwise(F.concat("p_brand", "p_name"))
    )
    return ops.nearest_vocab(t.part.select(label.alias("label")), t.part, "label", "p_name")


@query(
    "gold_leak_join",
    r"""SELECT item_id, gold FROM (SELECT d.doc_id AS item_id, d.text AS input, CASE WHEN d.doc_id % 3 = 0 THEN
         lower(substr(d.text, 20, 12)) WHEN d.doc_id % 3 = 1 THEN b.text ELSE 'the' END AS gold FROM documents d
         JOIN benchmark b ON b.item_id = d.doc_id % 40)
       WHERE strlen(regexp_replace(gold, '^\s+|\s+$', '', 'g')) >= 4 AND
         contains(lower(input), lower(regexp_replace(gold, '^\s+|\s+$', '', 'g')))""",
)
def _(t):
    items = t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("input"))
    marks = t.documents.select("doc_id", F.lower(F.substring("text", 20, 12)).alias("part"), (F.col("doc_id") % 40).alias("b"))
    golds = marks.join(t.benchmark.select(F.col("item_id").alias("b"), F.col("text").alias("btext")), "b").select(
        F.col("doc_id").alias("item_id"),
        F.when(F.col("doc_id") % 3 == 0, F.col("part")).when(F.col("doc_id") % 3 == 1, F.col("btext")).otherwise("the").alias("gold"),
    )
    return ops.gold_in_input(items, golds, "item_id").select("item_id", "gold")


@query(
    "holdout_check",
    """SELECT d.doc_id, l.doc_id IS NOT NULL AS benchmark_derived, l.doc_id IS NULL AS allowed FROM documents d
       LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(t):
    return ops.holdout_check(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id", acknowledged=False)


@query(
    "benchmark_text_search",
    r"""WITH p AS (SELECT item_id, 'whole' AS part, text FROM benchmark UNION ALL SELECT item_id, 'start', left(text, 24) FROM benchmark UNION ALL
         SELECT item_id, 'word', split_part(text, ' ', 2) FROM benchmark),
       q AS (SELECT item_id, part, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS pattern FROM p)
       SELECT doc_id, item_id, part, instr(lower(text), pattern)::int AS at FROM documents, q WHERE strlen(pattern) >= 4 AND
         contains(lower(text), pattern)""",
)
def _(t):
    parts = [("whole", F.col("text")), ("start", F.left("text", F.lit(24))), ("word", F.split_part("text", F.lit(" "), F.lit(2)))]
    patterns = t.benchmark.select("item_id", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), c.alias("text")) for n, c in parts])).alias("p"))
    patterns = patterns.select(F.struct("item_id", "p.part").alias("key"), "p.text")
    found = ops.texts_within(t.documents, patterns, "doc_id", "text", "key", "text")
    return found.select("doc_id", "key.item_id", "key.part", "at")


@query(
    "holdout_prompts",
    r"""WITH e AS (SELECT DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
       SELECT doc_id, d.doc_id IN (SELECT doc_id FROM labels) OR e.p IS NOT NULL AS benchmark_derived,
         NOT (d.doc_id IN (SELECT doc_id FROM labels) OR e.p IS NOT NULL) AS allowed FROM documents d LEFT JOIN e ON e.p <> '' AND
         e.p = trim(regexp_replace(lower(d.text), '\s+', ' ', 'g'))""",
)
def _(t):
    evaluation = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id").select("doc_id", "text")
    got = ops.holdout_check(t.documents.select("doc_id", "text"), evaluation, "doc_id", acknowledged=False, prompt="text")
    return got.select("doc_id", "benchmark_derived", "allowed")


@query(
    "counter_delta_join",
    """WITH s AS (SELECT user_id, epoch_us(ts) AS ts, event_id, floor(value)::bigint AS draft, event_id AS accepted FROM events
         WHERE event_type <> 'signup'),
       w AS (SELECT user_id, event_id AS window_id, epoch_us(ts) AS a, epoch_us(ts) + 36000000000 AS b FROM events WHERE
         event_type = 'signup'),
       j AS (SELECT w.user_id, w.window_id, arg_max(draft, struct_pack(x := s.ts, y := s.event_id)) FILTER (WHERE s.ts <= a) AS d0,
         arg_max(accepted, struct_pack(x := s.ts, y := s.event_id)) FILTER (WHERE s.ts <= a) AS a0,
         arg_max(draft, struct_pack(x := s.ts, y := s.event_id)) FILTER (WHERE s.ts <= b) AS d1,
         arg_max(accepted, struct_pack(x := s.ts, y := s.event_id)) FILTER (WHERE s.ts <= b) AS a1
         FROM w LEFT JOIN s ON s.user_id = w.user_id GROUP BY ALL)
       SELECT user_id, window_id, coalesce(d1 < d0, false) OR coalesce(a1 < a0, false) AS reset,
         CASE WHEN NOT (coalesce(d1 < d0, false) OR coalesce(a1 < a0, false)) THEN d1 - d0 END AS draft,
         CASE WHEN NOT (coalesce(d1 < d0, false) OR coalesce(a1 < a0, false)) THEN a1 - a0 END AS accepted FROM j""",
)
def _(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t.events.select("user_id", "event_id", "event_type", micros.alias("ts"), F.floor("value").cast("bigint").alias("draft"))
    scrapes = rows.where(F.col("event_type") != "signup").select(
        "user_id", "ts", F.col("event_id").alias("scrape_id"), "draft", F.col("event_id").alias("accepted")
    )
    windows = rows.where(F.col("event_type") == "signup").select(
        "user_id",
        F.col("event_id").alias("window_id"),
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.lit(36000000000)).alias("end_ts"),
    )
    return ops.counter_delta_join(scrapes, windows, "user_id", ["draft", "accepted"])
