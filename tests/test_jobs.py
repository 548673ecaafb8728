"""Jobs against brute force and small fixtures."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from benchloom.operators import extraction, joins, market, quality, scoring, training
from benchloom.operators import runs as run_ops
from benchloom.operators.measure import cache_evidence
from benchloom.sources import readers, writers


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_nearest_vocab_finds_what_brute_force_finds(spark):
    vocabulary = ["a", "ab", "model", "models", "mode", "hardware", "quantization", "runs-dir", "max-tokens", "max-token", "é-x", "xyz"]
    labels = ["", "b", "mdel", "modle", "quantisation", "max-tokns", "hardwrae", "runsdir", "zzzzzzzz", "tokens-max", "e-x", "xyzabc", "abcd"]
    got = {
        r.label: (r.nearest, r.distance)
        for r in joins.nearest_vocab(
            spark.createDataFrame([(x,) for x in labels], "label string"),
            spark.createDataFrame([(x,) for x in vocabulary], "word string"),
            "label",
            "word",
        ).collect()
    }
    want = {}
    for label in labels:
        best = min((distance(label, w), w) for w in vocabulary)
        if best[0] < 4:
            want[label] = (best[1], best[0])
    assert got == want


def test_nearest_short_and_long_words_of_few_letters(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abé") for _ in range(r.choice([0, 1, 2, 3, 3, 5, 9, 11, 12, 13, 14, 16])))
    vocabulary, labels = sorted({word() for _ in range(90)}), sorted({word() for _ in range(120)})
    frames = [spark.createDataFrame([(x,) for x in xs] + [(None,)], "x string") for xs in (labels, vocabulary)]
    got = {r.x: (r.distance, r.nearest) for r in joins.nearest_vocab(*frames, "x", "x").collect()}
    best = {label: min((distance(label, w), w) for w in vocabulary) for label in labels}
    assert got == {label: b for label, b in best.items() if b[0] < 4}


def test_no_key_of_short_words_is_large(spark):
    """All words of up to three letters share the empty text, yet its key holds one row for each way to get there."""
    letters = [chr(97 + i) for i in range(26)]
    words = [(a + b + c,) for a in letters for b in letters for c in letters]
    index = joins._deletions(spark.createDataFrame(words, "_word string"), "_word", 3).groupBy("_kept", "_marks").agg(F.min("_word"))
    assert index.groupBy("_kept").count().agg(F.max("count")).first()[0] <= 10


@pytest.mark.parametrize("scan_bytes", [1 << 20, 60])
def test_texts_within_documents(spark, scan_bytes):
    r = random.Random(2)
    base = " ".join(r.choice(["alpha", "Beta", "ÉTÉ", "the", "日本"]) for _ in range(4000))
    texts = [(i, base[i * 7 : i * 7 + r.choice([0, 3, 40, 400])]) for i in range(60)] + [(100, None), (101, ""), (102, base), (103, "the THE thE the")]
    patterns = [(i, base[p : p + n]) for i, (p, n) in enumerate((r.randrange(3000), r.choice([2, 5, 9, 30, 200])) for _ in range(60))]
    patterns += [(200, "the"), (201, " The t "), (202, None), (203, ""), (204, "  "), (205, patterns[3][1]), (206, "absent text")]
    got = joins.texts_within(
        spark.createDataFrame(texts, "doc long, body string"), spark.createDataFrame(patterns, "id long, part string"),
        "doc", "body", "id", "part", scan_bytes=scan_bytes,
    )
    want = []
    for d, t in texts:
        for i, p in patterns:
            p = (p or "").strip().lower()
            if t and len(p.encode()) >= 4 and p in t.lower():
                want.append((d, i, t.lower().index(p) + 1))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_holdout_by_prompt(spark):
    records = spark.createDataFrame([(1, "Ask  me"), (2, "other"), (3, " ask ME\n"), (4, None), (5, ""), (None, "ask me!")], "task long, prompt string")
    evaluation = spark.createDataFrame([(2, "x"), (9, "ask me"), (8, ""), (None, None)], "task long, prompt string")
    got = joins.holdout_check(records, evaluation, "task", False, "prompt").collect()
    assert {r.task: r.allowed for r in got} == {1: False, 2: False, 3: False, 4: True, 5: True, None: True}


def test_compare_against_median_baseline(spark):
    runs = spark.createDataFrame(
        [("a", "fp16", 100.0), ("b", "Q4_K_M", 200.0), ("c", "Q4_K_M", 50.0), ("d", "Q4_K_M", 0.0)],
        "path string, quantization string, tok_s_out double",
    )
    for c in ("hf_id", "engine", "mode", "hardware", "props"):
        runs = runs.withColumn(c, F.lit(""))
    rows = {r.name: r for r in run_ops.compare_groups(runs, baseline="FP16").collect()}
    assert rows["Q4_K_M"].value == 125.0 and rows["Q4_K_M"].ratio == 1.25 and rows["Q4_K_M"].better
    assert rows["fp16"].delta == 0.0 and not rows["fp16"].better
    stats = {r.key: r for r in run_ops.run_group_stats(runs, by="quant").collect()}
    assert (stats["Q4_K_M"].runs, stats["Q4_K_M"].metric_runs, stats["Q4_K_M"].best_run) == (3, 2, "b")
    assert stats["fp16"].stddev is None


def test_compare_pair(spark):
    pair = spark.createDataFrame([(1, 100.0, 125.0, 200.0, 100.0)], "id int, left_tok_s_out double, right_tok_s_out double, left_ttft_ms double, right_ttft_ms double")
    rows = {r.metric: r for r in run_ops.compare_pairs(pair, ["tok_s_out", "ttft_ms"]).collect()}
    assert (rows["tok_s_out"].percent, rows["tok_s_out"].better) == (25.0, True)
    assert (rows["ttft_ms"].percent, rows["ttft_ms"].better) == (50.0, True)


def test_patches_clear_fields_and_never_double_runs(spark):
    runs = spark.createDataFrame(
        [(1, "a", (1, 2)), (2, "b", (3, 4)), (3, "c", None)], "id int, name string, at struct<x:int,y:int>"
    )
    patches = spark.createDataFrame(
        [
            (1, "new", (9, None), ["name", "at.x"], 1),
            (1, None, None, ["name"], 2),
            (2, None, (None, None), ["at"], 1),
            (None, "lost", None, ["name"], 1),
        ],
        "id int, name string, at struct<x:int,y:int>, named array<string>, n int",
    )
    got = run_ops.patch_runs(runs, patches, "id", ["name", "at"], named="named", order="n")
    assert sorted((r.id, r.name, r.at and tuple(r.at)) for r in got.collect()) == [
        (1, None, (9, 2)),
        (2, "b", (None, None)),
        (3, "c", None),
    ]
    plain = run_ops.patch_runs(runs, patches, "id", ["name"], unset=["at"])
    assert sorted((r.id, r.name, r.at is None) for r in plain.collect()) == [(1, "new", True), (2, "b", True), (3, "c", True)]


def test_bench_rows(spark):
    texts = spark.createDataFrame(
        [
            (1, '[{"n_prompt": 512, "n_gen": 0, "n_depth": 10000, "avg_ts": 6425.91}, {"n_prompt": 0, "n_gen": 128, "n_depth": 10000, "avg_ts": 116.71}]'),
            (2, '{"input_len": 10000, "output_len": 64, "batch_size": 1, "avg_latency": 2.0}'),
            (3, "| m | pp512 @ d4096 | 6425.91 ± 10.2 |\n| m | tg128 | 116.71 ± 0.1 |"),
            (4, "no numbers"),
        ],
        "run_id int, text string",
    )
    rows = {r.run_id: r for r in extraction.bench_json_metrics(texts, "run_id").collect()}
    assert (rows[1].tok_s_prefill, rows[1].tok_s_out, rows[1].prefill_tokens) == (6425.91, 116.71, 10000.0)
    assert (rows[2].latency_ms, rows[2].tok_s_total, rows[2].tok_s_out) == (2000.0, 5032.0, 32.0)
    assert rows[4].tok_s_out is None
    table = {r.run_id: r for r in extraction.bench_table_metrics(texts, "run_id").collect()}
    assert (table[3].tok_s_prefill, table[3].tok_s_out, table[3].prompt_tokens, table[3].prefill_tokens) == (6425.91, 116.71, 512.0, 4096.0)


def test_metric_by_alias_prefers_the_shallowest(spark):
    docs = spark.createDataFrame(
        [(1, '{"a": {"tok_s_out": 5}, "b": [{"x": {"tokSOut": 9}}], "decode-throughput": 0}'), (2, '{"z": {"tokSOut": "7"}, "y": {"genThroughput": 3}}'), (3, "broken")],
        "id int, doc string",
    )
    rows = {r.id: r.tok_s_out for r in extraction.metric_by_alias(docs, "id", "doc").collect()}
    assert rows == {1: 5.0, 2: 3.0, 3: None}


def test_cache_evidence(spark):
    rows = spark.createDataFrame(
        [
            (1, 100.0, 0.0, None, None),
            (2, 100.0, 100.0, None, 0.0),
            (3, 100.0, 40.0, 40.0, 60.0),
            (4, 100.0, 40.0, 50.0, None),
            (5, 100.0, None, None, None),
            (6, 0.0, 0.0, None, None),
            (7, 100.0, 0.5, None, None),
            (8, 100.0, 101.0, None, None),
        ],
        "id int, prompt_tokens double, cached_tokens double, cache_n double, prompt_n double",
    )
    got = {r.id: r.status for r in cache_evidence(rows).collect()}
    assert got == {1: "not_retained", 2: "retained", 3: "partial", 4: "unknown", 5: "unknown", 6: "unknown", 7: "unknown", 8: "unknown"}


def test_harness_score(spark):
    rows = spark.createDataFrame(
        [
            (1, '{"acc,none": 0.75, "acc_stderr,none": 0.01}'),
            (2, '{"rougeL": 42}'),
            (3, '{"acc": "0.5"}'),
            (4, '{"zzz_stderr": 0.2}'),
            (5, '{"b": 0.2, "a": 0.1}'),
            (6, '{"acc": -1}'),
        ],
        "id int, metrics string",
    )
    got = {r.id: (r.metric, r.score) for r in scoring.harness_score(rows).collect()}
    assert got == {1: ("acc,none", 0.75), 2: ("rougeL", 0.42), 3: (None, None), 4: (None, None), 5: ("a", 0.1), 6: (None, None)}


def test_loglikelihood_counts_the_continuation_only(spark):
    schema = "id int, context_bytes int, choices array<string>, gold string, scored array<struct<logprobs:array<double>,offsets:array<int>>>"
    rows = [
        (1, 3, ["aa", "bb"], "2", [([None, -9.0, -2.0], [0, 1, 3]), ([None, -9.0, -1.0], [0, 1, 3])]),
        (2, 3, ["aa", "bb"], "a", [([None, -1.0], [0, 3]), ([None, -1.0], [0, 3])]),
    ]
    got = {r.id: r for r in scoring.score_loglikelihood(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].sums == [-2.0, -1.0] and got[1].predicted == "B" and got[1]["pass"]
    assert got[2].predicted == "A" and got[2]["pass"]


def test_token_f1(spark):
    rows = spark.createDataFrame([("the cat the", "the cat sat"), ("", "x"), ("a", "b"), ("Same!", "same")], "response string, gold string")
    got = [r.f1 for r in scoring.token_f1(rows).collect()]
    assert got == pytest.approx([2 / 3, 0.0, 0.0, 1.0])


def test_audit(spark):
    items = spark.createDataFrame(
        [
            ("items[0]", 0, "What is red?", "A", ["x", "y"]),
            ("items[1]", 1, " what  is RED? ", "C", ["x", "X"]),
            ("items[2]", 2, "Paris is the gold", "paris", None),
        ],
        "path string, place int, input string, gold string, choices array<string>",
    )
    got = {(r.code, r.path) for r in quality.audit_items(items, "text").collect()}
    assert got == {
        ("duplicate_input", "items[1].input"),
        ("duplicate_choice", "items[1].choices"),
        ("invalid_choice_gold", "items[1].gold"),
        ("possible_gold_leak", "items[2]"),
        ("dataset_small", "tasks"),
        ("source_missing", "sourceUrl"),
    }


def test_column_mapping(spark):
    df = spark.createDataFrame([("q", "a", "r")], ["Question ", "ANSWER", "criteria"])
    got = quality.map_columns(df)
    assert got.columns == ["input", "gold", "rubric", "kind"] and got.first().kind == "judge"
    assert quality.map_columns(df, {"input": "ANSWER"}, "judge").columns == ["Question ", "input", "gold", "rubric", "kind"]
    with pytest.raises(ValueError):
        quality.map_columns(df, {"input": "nope"})


def test_messages(spark):
    part = "struct<type:string,text:string,thinking:string,id:string,name:string,arguments:string>"
    schema = f"id int, seq int, type string, message struct<role:string,content:array<{part}>,toolCallId:string,toolName:string>"
    text = lambda t: ("text", t, None, None, None, None)
    rows = [
        (1, 0, "message_end", ("user", [text("hi"), text("there")], None, None)),
        (1, 1, "message_update", ("assistant", [text("par")], None, None)),
        (1, 2, "message_end", ("assistant", [("thinking", None, "hm", None, None, None), text("ok"), ("toolCall", None, None, "c", "bash", '{"a":1}')], None, None)),
        (1, 3, "message_end", ("toolResult", [], "c", "bash")),
        (1, 4, "message_end", ("assistant", [text("  ")], None, None)),
        (1, 5, "message_end", ("system", [text("x")], None, None)),
    ]
    got = {r.seq: r for r in training.normalize_messages(spark.createDataFrame(rows, schema), ["id", "seq"]).collect()}
    assert sorted(got) == [0, 2, 3]
    assert got[0].content == "hi\nthere"
    assert got[2].tool_calls[0].function.name == "bash" and got[2].content == "ok"
    assert (got[3].role, got[3].content, got[3].tool_call_id) == ("tool", "(no output)", "c")


def test_settlement_bounds(spark):
    usage = spark.createDataFrame(
        [(1, 1000, 2000, 900, 1500, 400, 0, 0, 1000), (1, None, None, None, 1500, 400, 10, 5, 1000)],
        "listing int, prompt_tokens int, cached_tokens int, output_tokens int, request_tokens int, delivered_tokens int,"
        "prompt_floor int, output_floor int, max_output_tokens int",
    )
    prices = spark.createDataFrame([(1, 2.0, 5.0, 10.0)], "listing int, input_price double, cached_price double, output_price double")
    full, floor = sorted(market.settle_usage(usage, prices).collect(), key=lambda r: -r.cost)
    assert (full.billed_prompt, full.billed_cached, full.billed_output) == (1000, 1000, 400)
    assert float(full.cost) == pytest.approx((1000 * 2 + 400 * 10) / 1e6)
    assert (floor.billed_prompt, floor.billed_cached, floor.billed_output) == (10, 0, 5)
    assert float(full.reserved) == pytest.approx((1500 * 2 + 1000 * 10) / 1e6)


def test_label_mask(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a b c"), (1, 1, "assistant", "d e f"), (2, 0, "user", "a b c d e f"), (2, 1, "assistant", "g")], "id int, turn int, role string, content string")
    masked = training.label_mask(rows, "id", ["turn"], 5)
    got = {(r.id, r.turn): (len(r.input_ids), r.labels) for r in masked.collect()}
    assert got[(1, 0)] == (3, [-100] * 3) and got[(1, 1)][0] == 2 and -100 not in got[(1, 1)][1]
    assert (2, 1) not in got
    assert [r.id for r in training.label_counts(masked, "id").collect()] == [1]


def test_run_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"payload": {"hfId": "m"}}')
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.JSON").write_text('{"hfId": "n"}')
    (tmp_path / "bad.json").write_text("[1")
    (tmp_path / "note.txt").write_text('{"hfId": "x"}')
    runs = readers.scan_runs(spark, str(tmp_path))
    assert sorted(r.payload for r in runs.collect()) == ['{"hfId": "n"}', '{"hfId":"m"}']
    with pytest.raises(PySparkException):
        readers.scan_runs(spark, str(tmp_path / "bad.json"), strict=True).collect()
    assert readers.scan_runs(spark, default=str(tmp_path / "none")).count() == 0


def test_hashes_of_ranges(spark, tmp_path):
    """A large file is read by many tasks; its digest does not depend on how it is cut, and any changed byte shows."""
    rng = random.Random(5)
    data = b"\xef\xbb\xbf" + rng.randbytes(300_000) + b"\r\n\n" + bytes(3_000) + rng.randbytes(50_000)
    (tmp_path / "a").mkdir()
    (tmp_path / "b c").mkdir()
    (tmp_path / "a" / "large.bin").write_bytes(data)
    (tmp_path / "a" / "small.bin").write_bytes(b"x\n")
    (tmp_path / "a" / "packed.gz").write_bytes(data)
    scan = lambda folder, n=1_000: readers.scan_range_hashes(spark, str(tmp_path / folder), whole=n)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    digests = set()
    try:
        for size in ("1g", "64k", "999b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in scan("a").collect()}
            digests.add(got["large.bin"])
            text = readers._below(spark, "text", str(tmp_path / "a" / "large.bin"), "*")
            assert text.rdd.getNumPartitions() >= {"1g": 1, "64k": 6, "999b": 300}[size]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(digests) == 1 and got["large.bin"][0] == len(data) and got["large.bin"][1].startswith("lines:")
    whole = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in readers.scan_hashes(spark, str(tmp_path / "a")).collect()}
    assert got["small.bin"] == whole["small.bin"] and got["packed.gz"] == whole["packed.gz"]
    assert len(got) == 3 and {r.path for r in scan("a").collect()} == {r.path for r in readers.scan_hashes(spark, str(tmp_path / "a")).collect()}
    lines = data.split(b"\n")
    swapped = b"\n".join([lines[0], lines[2], lines[1], *lines[3:]])
    for i, other in enumerate([data[:-1] + bytes([data[-1] ^ 1]), data.replace(b"\r\n", b"\n\n"), swapped, data[:3] + b"\n" + data[4:]]):
        (tmp_path / "b c" / f"{i}.bin").write_bytes(other)
    (tmp_path / "b c" / "same.bin").write_bytes(data)
    after = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in scan("b c").collect()}
    assert after.pop("same.bin") == got["large.bin"]
    assert len(after) == 4 and len({*after.values(), got["large.bin"]}) == 5


def test_documents_as_files(spark, tables, tmp_path):
    """One file per row whatever the rows hold, in a fixed number of folders, so no folder per run has to be made and listed."""
    texts = [f'{{"id": {i}}}' for i in range(300)] + ['{"id": 7}', "[1, 2", None, '{"id": "a\\nb"}\n']
    path = tmp_path / "runs of a day"
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    assert tables.supplier.count() > 0 and writers.write_documents(rows, str(path)) == len(texts)
    files = [f for f in path.rglob("*") if f.is_file()]
    assert sorted(f.read_text() for f in files) == sorted(t or "" for t in texts)
    assert len(list(path.iterdir())) <= writers.FOLDERS and {f.suffix for f in files} == {".json"}
    assert readers.scan_runs(spark, str(path)).count() == 302
    assert writers.write_documents(rows.limit(0), str(tmp_path / "none")) == 0
    assert readers.scan_runs(spark, str(tmp_path / "none")).count() == 0


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("p", None, 1.0, 0.25, [1, 2])], "path string, hf_id string, a double, b double, c array<int>").withColumn("props", F.lit("{}"))
    writers.write_csv(df, ["path", "model", "a", "b", "c"], str(tmp_path / "out"))
    lines = {line for part in (tmp_path / "out").glob("*.csv") for line in part.read_text().splitlines()}
    assert lines == {"path,model,a,b,c", 'p,,1,0.25,"[1,2]"'}
