"""The divergence audit, centroid clusters and the source mix against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from benchloom.llm import centroid_clusters, divergence_audit, source_mix

# Columns whose names the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n long, part string, size string, mark int, cluster string"
VECTORS = "vec_id long, embedding array<double>, cluster string, n long, data string"


def docs_of(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], DOCS).repartition(parts)


# ---------------------------------------------------------------- divergence audit


def audit_by_hand(rows, least_docs, top):
    docs = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang, s, [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]) for t, lang, s in docs]
    out = []
    for lang in {d[0] for d in found}:
        in_docs, counts, groups = Counter(), Counter(), defaultdict(Counter)
        for own, s, words in found:
            if own == lang:
                in_docs.update(set(words))
                counts.update(words)
                groups[s].update(words)
        kept = sorted(t for t, n in in_docs.items() if n >= least_docs)

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        of_lang, of = share(counts), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, of[s][t] - of_lang[t]) for t in kept if groups[s][t] and of[s][t] > of_lang[t]]
            order = lambda x: (-x[1], x[0].encode())
            out += [(lang, s, "pair", i, v, k + 1) for k, (i, v) in enumerate(sorted(pairs, key=order))]
            out += [(lang, s, "term", i, v, k + 1) for k, (i, v) in enumerate(sorted(terms, key=order)[:top])]
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "éa", "日本", "Straße", "a", "\x85b"]
    rows = []
    for i in range(240):
        text = " ".join(r.choice(words[: 20 + i % 47]) + r.choice(["", ",", "'s", "9", "\x00", "-X"]) for _ in range(r.randrange(40)))
        rows.append((i, text.upper() if i % 5 == 0 else text, ["en", "de", None][i % 3], ["hot", "hot", f"s{i % 7}", None, ""][i % 5]))
    rows += [(1000 + i, rows[7][1], "en", "hot") for i in range(60)]
    rows += [(2000, None, "en", "silent"), (2001, "", "xx", "only"), (2002, "123", "xx", "other"), (2003, "q " * 20_000, "en", "long"), (None, "wa", None, "s1")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"part_terms": 3, "block": 2, "band_rows": 7}])
def test_audit_equals_brute_force(spark, corpus, sizes):
    got = divergence_audit.divergence(docs_of(spark, corpus), least_docs=8, top=9, **sizes)
    assert audit_rows(got) == audit_by_hand(corpus, 8, 9)


def test_audit_of_few_and_no_rows(spark):
    assert audit_rows(divergence_audit.divergence(docs_of(spark, []))) == []
    # No term in 30 documents: distances are 0 and there are no terms.
    rows = [(1, "a b", "en", "x"), (2, "a c", "en", "y"), (3, None, None, None)]
    assert audit_rows(divergence_audit.divergence(docs_of(spark, rows))) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_audit_flushes_counts(spark, corpus, monkeypatch):
    want = audit_by_hand(corpus, 8, 9)
    batches = iter(docs_of(spark, corpus).select("lang", "source", "text").na.fill("").toArrow().to_batches())
    monkeypatch.setattr(divergence_audit, "HELD", 10)
    parts = list(divergence_audit._counted(batches))
    assert len(parts) > 100
    total = Counter()
    for p in parts:
        for term, n in zip(p.column("term").to_pylist(), p.column("n").to_pylist()):
            total[term] += n
    assert total["wa" + "a"] == sum(len(re.findall(r"(?i)(?<![a-z\u0080-￿])waa(?![a-z\u0080-￿])", t or "")) for _, t, _, _ in corpus)
    assert want


def test_skyband_keeps_every_term_with_few_dominators():
    r = np.random.default_rng(3)
    for n, k in [(5, 2), (300, 3), (1500, 20)]:
        group, lang, term = r.integers(0, 30, n), r.integers(0, 40, n), r.permutation(n)
        better = (group[None, :] >= group[:, None]) & (lang[None, :] <= lang[:, None]) & (term[None, :] < term[:, None])
        assert sorted(divergence_audit.skyband(group, lang, term, k)) == np.nonzero(better.sum(axis=1) < k)[0].tolist()


def test_share_is_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (7, 10, 3), (999_999_999_999, 3_000_000_000_001, 17), (4 * 10**14 + 7, 8 * 10**15 + 1, 10**9)]
    df = spark.createDataFrame(cases, "n long, total long, kept long")
    F = divergence_audit.F
    got = df.select(divergence_audit.share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "n", "total", "kept").collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 5) // (r["total"] + 5 * r["kept"]) for r in got)


# ---------------------------------------------------------------- centroid clusters


def clusters_by_hand(rows, clusters, rounds, dim=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 2**54 for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), centroid_clusters.packed(np.array(r[1])))
    centroids = [v for _, v in sorted(kept, key=name)[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((square(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        for k, vs in own.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    per, fits = Counter(), lambda n: n if n < 2**63 else None
    for _, k, d in out:
        per[k] += d
    sha = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    big = {k for _, k, d in out if d >= 2**63}
    return sorted(
        ((i, k, fits(d), None if k in big else fits(per[k]), None if big else fits(sum(per.values())), sha(k)) for i, k, d in out), key=str
    )


def vectors(n, r, near=4):
    middles = [[r.gauss(0, 0.1) for _ in range(64)] for _ in range(near)]
    return [(i, [x + r.gauss(0, 0.03) for x in middles[i % near]]) for i in range(n)]


def clustered(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "c", 1, "d") for r in rows], VECTORS).repartition(3)
    got, _ = centroid_clusters.cluster_vectors(df, **settings)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_clusters_equal_brute_force(spark):
    r = random.Random(9)
    rows = vectors(150, r) + [(500 + i, [0.25] * 64) for i in range(60)] + [(3, [0.25] * 64), (None, [-0.1] * 64)]
    unusable = [(600, None), (601, []), (602, [0.1] * 63), (603, [0.1] * 63 + [None]), (604, [math.nan] * 64), (605, [math.inf] + [0.0] * 63)]
    assert clustered(spark, rows + unusable, clusters=12, rounds=5) == clusters_by_hand(rows, 12, 5)


def test_clusters_of_very_large_components(spark):
    r = random.Random(2)
    rows = vectors(20, r) + [(100 + i, [r.choice([1e7, -3e9, 1e15, 2.0**53]) * r.random() for _ in range(64)]) for i in range(12)]
    assert clustered(spark, rows + [(900, [2.0**54] * 64), (901, [1e308] * 64)], clusters=5, rounds=3) == clusters_by_hand(rows, 5, 3)


def test_clusters_of_few_and_no_vectors(spark):
    assert clustered(spark, []) == []
    assert clustered(spark, [(1, None), (2, [0.0])]) == []
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (2, [0.0] * 64)]
    assert clustered(spark, rows) == clusters_by_hand(rows, 40, 5)


def test_bounds_save_evaluations_and_stay_exact():
    """Bounds loosened by the total displacement let most pairs unevaluated, and none that mattered."""
    r = np.random.default_rng(1)
    middles = r.normal(0, 40, (20, 16))
    x = np.floor(middles[r.integers(0, 20, 4000)] + r.normal(0, 6, (4000, 16))).astype(np.int64)
    history = x[None, :20].copy()
    bounds = centroid_clusters.Bounds.new(x, 20)
    for at in range(6):
        before = bounds.evaluated
        bounds.settle(history)
        full = ((x[:, None, :] - history[-1][None, :, :]) ** 2).sum(axis=2)
        assert (bounds.cluster == full.argmin(axis=1)).all()
        saved = 1 - (bounds.evaluated - before) / (len(x) * 20)
        means = [x[bounds.cluster == k].sum(axis=0) // max(1, (bounds.cluster == k).sum()) for k in range(20)]
        after = [m if (bounds.cluster == k).any() else history[-1][k] for k, m in enumerate(means)]
        history = np.concatenate([history, np.array(after)[None]])
    assert saved > 0.8


def test_displacement_is_of_the_way_and_not_of_the_rounds():
    there_and_back = np.array([[[0, 0]], [[30, 40]], [[0, 0]]])
    assert centroid_clusters.displacements(there_and_back)[:, 0] == pytest.approx([0, 50, 0], abs=1e-3)


# ---------------------------------------------------------------- source mix


def targets_by_hand(sizes, weights=(5, 2, 1), share=Fraction(3, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, given, open_ones = sum(sizes.values()) * share, {}, set(names)
    while True:
        at = left / sum(weight[s] for s in open_ones) if open_ones else 0
        over = {s for s in open_ones if weight[s] * at > 2 * sizes[s]}
        if not over:
            return given | {s: weight[s] * at for s in open_ones}
        given |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ones -= over


def mix_cases():
    r = random.Random(4)
    text = lambda n: r.choice([" ", "\t", "\x1c ", "  "]).join("word" for _ in range(n))
    rows = [(i, text(r.randrange(40)), "en", ["big", "big", "big", "tiny", "b", "Z", None, "ü"][i % 8]) for i in range(400)]
    rows += [(900, text(3), "en", "rare"), (901, None, "en", "empty"), (902, text(9000), "en", "b"), (905, "a b", "en", "b"), (905, "a b", "en", "b")]
    return rows + [(None, "x y z", "en", None), (903, "", "en", "rare")]


@pytest.mark.parametrize("few", [source_mix.FEW_SOURCES, 0])
def test_mix_meets_the_targets(spark, monkeypatch, few):
    monkeypatch.setattr(source_mix, "FEW_SOURCES", few)
    rows = mix_cases()
    line, docs = source_mix.mixed(docs_of(spark, rows))
    got = docs.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(g["doc_id"]), g["size"]) for g in got) == sorted((str(i), words(t)) for i, t, _, _ in rows)
    assert all(0 <= g["taken"] <= 2 * g["size"] for g in got)
    sizes, source_of = Counter(), {}
    for i, t, _, s in rows:
        sizes[s] += words(t)
        source_of[i] = s
    want = targets_by_hand(sizes)
    taken = Counter()
    for g in got:
        s = source_of[g["doc_id"]]
        taken[s] += g["taken"]
        assert g["source_size"] == sizes[s] and g["target"] == pytest.approx(float(want[s]))
    assert all(want[s] - 1 < taken[s] <= want[s] for s in sizes)
    # The mix itself: gapless, in the order of finish times, the same words.
    pieces = sorted(line.collect(), key=lambda p: p["begin"])
    at = 0
    for p, after in zip(pieces, pieces[1:] + pieces[-1:]):
        assert p["begin"] == at and p["finish"] <= after["finish"]
        at += p["words"]
    assert at == sum(taken.values())


def test_mix_serves_by_weight_all_along(spark):
    rows = [(i, "w " * 10, "en", f"s{i % 3}") for i in range(600)]
    pieces = sorted(source_mix.mixed(docs_of(spark, rows))[0].collect(), key=lambda p: p["begin"])
    half = Counter(p["doc_id"] % 3 for p in pieces if p["begin"] < 1000)
    assert half[0] == pytest.approx(62, abs=2) and half[1] == pytest.approx(25, abs=2) and half[2] == pytest.approx(12, abs=2)


def test_mix_is_the_same_in_every_run_and_layout(spark):
    rows = mix_cases()
    runs = [sorted(map(str, source_mix.mixed(docs_of(spark, order, parts))[1].collect())) for order, parts in ((rows, 2), (rows[::-1], 7))]
    assert runs[0] == runs[1]


def test_mix_of_nothing(spark):
    assert source_mix.mixed(docs_of(spark, []))[1].collect() == []
    got = source_mix.mixed(docs_of(spark, [(1, None, "en", "a"), (2, " ", "en", None)]))[1].collect()
    assert [(g["size"], g["source_size"], g["target"], g["taken"]) for g in got] == [(0, 0, 0.0, 0)] * 2
