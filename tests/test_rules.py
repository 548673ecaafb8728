"""Rule columns against small vectors."""

import pytest
from pyspark.sql import functions as F

from benchloom.functions import answers, naming, numbers, text
from benchloom.operators.capacity import decode_upper_bound, speculative_tokens
from benchloom.operators.inventory import glob_pattern, redact_arguments, redact_command
from benchloom.operators.measure import decode_rate
from benchloom.operators.scoring import pass_at_k_value


def values(spark, rows, column, *names):
    df = spark.createDataFrame(rows, names)
    return [r[0] for r in df.select(column).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "value, digits, want", [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.05, 1, 0.1), (1234.5678, 2, 1234.57)]
)
def test_rounding(spark, value, digits, want):
    assert one(spark, numbers.round_to(F.lit(value), digits)) == want


@pytest.mark.parametrize(
    "response, want",
    [
        ("so we get 5.\nFinal answer: $1,234.50 dollars, not 7", "$1,234.50"),
        ("#### 42", "42"),
        ("The answer is: 3\nno wait, the answer is 4", "4"),
        ("a = 5\nTotal cost = 107\nsee 12", "107"),
        ("Therefore **Sum: 3** then **9** of 11", "9"),
        ("3 + 4 = 7 and 12", "7"),
        ("**Step 2: go** then **about -17%** 99", "-17%"),
        ("first 1 then 2", "2"),
        ("nothing to see", "nothing to see"),
        ("the question asks for the answer, 5 or 6", "6"),
        ("éso 5 6 7", "7"),
    ],
)
def test_final_answer(spark, response, want):
    assert one(spark, answers.final_answer(F.lit(response))) == want


def test_other_answer_modes(spark):
    assert one(spark, answers.last_number(F.lit("pay $1,000.50 or 20%"))) == "20%"
    assert one(spark, answers.regex_answer(F.lit("x=1 x=2"), r"x=(\d)")) == "2"
    assert one(spark, answers.regex_answer(F.lit("x=1 x=2"), r"x=\d")) == "x=2"
    assert one(spark, answers.regex_answer(F.lit("x=1"), r"(")) == "x=1"
    assert one(spark, answers.regex_answer(F.lit("x=1"), "")) == "x=1"


@pytest.mark.parametrize(
    "answer, gold, same",
    [
        ("18", "18.0", True),
        ("$1,234.0", "1234", True),
        ("50%", "50", True),
        ("42.", "42", True),
        ("Paris!", "paris", True),
        ("1e3", "1000", True),
        ("17", "18", False),
        ("cat", "dog", False),
    ],
)
def test_answers_match(spark, answer, gold, same):
    assert one(spark, answers.answers_match(F.lit(answer), F.lit(gold))) is same


@pytest.mark.parametrize(
    "value, want",
    [("b", "B"), ("(C)", "C"), ("2", "B"), ("0", "A"), ("Blue!", "B"), ("I pick c because", "I"), ("none such", "none such")],
)
def test_choice_letter(spark, value, want):
    choices = F.array(F.lit("red"), F.lit("blue"), F.lit("green"))
    assert one(spark, answers.choice_letter(F.lit(value), choices)) == want


@pytest.mark.parametrize("gold, valid", [("A", True), ("d", False), ("0", True), ("3", False), ("BLUE ", True), ("", False), ("1x", False)])
def test_valid_choice_gold(spark, gold, valid):
    choices = F.array(F.lit("red"), F.lit("blue"), F.lit("green"))
    assert one(spark, answers.valid_choice_gold(F.lit(gold), choices)) is valid


def test_choice_list(spark):
    assert one(spark, answers.choice_list(F.lit('["a", "b"]'))) == ["a", "b"]
    assert one(spark, answers.choice_list(F.lit(" x | y || z "))) == ["x", "y", "z"]


@pytest.mark.parametrize(
    "reply, want",
    [('ok {"score": 0.75, "rationale": "r"}', 0.75), ('{"score": 7} so 0.5', 0.5), ("Score: 1", 1.0), ("no idea", None), ("9 of 9", None)],
)
def test_judge_score(spark, reply, want):
    assert one(spark, answers.judge_score(F.lit(reply))) == want


def test_rendered_prompt(spark):
    template = F.lit(" {{input}}|{{gold}}|{{choices}} ")
    assert one(spark, answers.rendered_prompt(template, F.lit("q"), F.array(F.lit("x"), F.lit("y")))) == "q||A. x\nB. y"
    assert one(spark, answers.rendered_prompt(template, F.lit("q"), F.lit(None).cast("array<string>"))) == "q||{{choices}}"


@pytest.mark.parametrize("limit", range(8, 20))
def test_cut_bytes_keeps_whole_characters(spark, limit):
    value, mark = "aé漢😀bé漢😀", "~"
    got = one(spark, text.cut_bytes(F.lit(value), limit, mark))
    raw = value.encode()
    if len(raw) <= limit:
        assert got == value
        return
    keep = limit - 1
    while keep and (raw[keep] & 0xC0) == 0x80:
        keep -= 1
    assert got == raw[:keep].decode() + mark


def test_head_tail(spark):
    short, long = "x" * 4000, "a" * 3000 + "b" * 500 + "c" * 1000
    assert one(spark, text.head_tail(F.lit(short))) == short
    assert one(spark, text.head_tail(F.lit(long))) == "a" * 3000 + "\n…\n" + "c" * 1000


@pytest.mark.parametrize(
    "n, c, k, want", [(5, 0, 1, 0.0), (5, 5, 1, 1.0), (5, 1, 1, 0.2), (5, 2, 2, 0.7), (2, 1, 5, 1.0), (1, 0, 3, 0.0), (10, 3, 8, 1.0)]
)
def test_pass_at_k(spark, n, c, k, want):
    assert one(spark, pass_at_k_value(F.lit(n), F.lit(c), k)) == pytest.approx(want)


def test_speculative_tokens(spark):
    assert one(spark, speculative_tokens(F.lit(4), F.lit(0.8))) == pytest.approx(3.3616)
    assert one(spark, speculative_tokens(F.lit(4), F.lit(1.0))) == 5.0


def test_dense_capacity(spark):
    grid = spark.createDataFrame(
        [(24.0, 1000.0, 2.0, 7.0, 8.0, 120.0)],
        "capacity_gb double, bandwidth_gbps double, overhead_gb double, total_params_b double, weight_bits double, min_tok_s double",
    ).withColumns(
        {"global_layers": F.lit(1), "kv_heads": F.lit(1), "head_dim": F.lit(1), "allocated_context": F.lit(100), "read_context": F.lit(100)}
    ).withColumn("fixed_store_gb", F.lit(1.0)).withColumn("fixed_read_gb", F.lit(0.1))
    row = decode_upper_bound(grid).first()
    assert row.state == "usable"
    assert row.fit_batch == 14
    assert row.single_tok_s == pytest.approx(1000 / 7.1000004)
    best = row.batch
    rate = lambda b: 1000 / (7.0 / b + 0.1000004) / b
    assert rate(best) >= 120 and (best == 14 or rate(best + 1) < 120)


def test_decode_rate(spark):
    rate = lambda *v: one(spark, decode_rate(*[F.lit(x) if x is not None else F.lit(None).cast("double") for x in v]))
    assert rate(11, 0.0, 1000.0, 2000.0, 2500.0) == 10.0
    assert rate(1, 0.0, 1000.0, 1000.0, 2250.0) == 0.8
    assert rate(5, 0.0, None, None, 1000.0) == 5.0
    assert rate(0, 0.0, None, None, 1000.0) is None


@pytest.mark.parametrize(
    "path, model, quant",
    [
        ("/m/Foo-7B-Q4_K_M.gguf", "Foo-7B", "Q4_K_M"),
        ("Foo-7B-UD-IQ4_NL-00001-of-00002.gguf", "Foo-7B", "IQ4_NL"),
        ("foo.bf16.safetensors", "foo.bf16", "BF16"),
        ("Q8_0.gguf", "Q8_0", "Q8_0"),
        ("plain-model.bin", "plain-model", None),
        ("x-mxfp4-gguf.gguf", "x", "MXFP4"),
    ],
)
def test_file_names(spark, path, model, quant):
    assert one(spark, naming.model_name_from_file(F.lit(path))) == model
    assert one(spark, naming.quantization_from_file(F.lit(path))) == quant


@pytest.mark.parametrize(
    "name, repo", [("org/model", True), ("model-x", True), ("default", False), ("a/b/c", False), ("/m/x", False), ("x.gguf", False), ("a\\b", False)]
)
def test_repository_names(spark, name, repo):
    assert one(spark, naming.is_repository_name(F.lit(name))) is repo


def test_spec_methods(spark):
    method = lambda m, d=None: one(spark, naming.canonical_spec_method(F.lit(m), F.lit(d) if d else None))
    assert method("draft_mtp") == "MTP"
    assert method("dflash", "org/DFlash-2-x") == "DFlash2"
    assert method("draft-dflash") == "DFlash"
    assert method(" eagle ") == "eagle"


@pytest.mark.parametrize(
    "pattern, name, hit",
    [
        ("*.gguf", "a.gguf", True),
        ("*.gguf", "d/a.gguf", False),
        ("**/*.gguf", "a.gguf", True),
        ("**/*.gguf", "d/e/a.gguf", True),
        ("d/**", "d/e/f", True),
        ("d/**", "d", True),
        ("d/**/f", "d/f", True),
        ("d/**/f", "d/x/y/f", True),
        ("d/?.bin", "d/a.bin", True),
        ("d/[ab].bin", "d/c.bin", False),
        ("**", "a/b", True),
    ],
)
def test_globs(pattern, name, hit):
    import re

    assert bool(re.match(glob_pattern(pattern), name)) is hit


def test_redaction(spark):
    assert one(spark, redact_command(F.lit("x --api-key abc --hf-token='q r' --port 1"))) == (
        "x --api-key <redacted> --hf-token=<redacted> --port 1"
    )
    argv = F.array(*[F.lit(a) for a in ["--api-key", "v", "--token=q", "--secret", "--x", "--tokens", "5"]])
    assert one(spark, redact_arguments(argv)) == ["--api-key", "<redacted>", "--token=<redacted>", "--secret", "--x", "--tokens", "5"]
