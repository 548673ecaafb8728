"""The training-data operators against brute force on small tables with nulls, ties, repeats and odd texts."""

import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from benchloom.llm import (
    decontamination,
    embedding_dedup,
    line_dedup,
    packing,
    pseudonyms,
    sharding,
    simhash_dedup,
    suffix_dedup,
    token_files,
    toxicity,
)
from benchloom.llm.common import components
from benchloom.llm.token_ids import TokenIds

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, shard string, bucket int, place int, item string, source string"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, "x", 1, 2, "y", "hot") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "Éa", "x1"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(50)) * r.randrange(2) for _ in range(n))
    base = [prose(60) for _ in range(12)]
    shared = prose(20)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 3]) for i in range(9)]
    rows += [(200 + i, base[i] + " tail " + prose(2)) for i in range(6)]
    rows += [(300 + i, prose(5) + " " + shared + " " + prose(5)) for i in range(8)]
    rows += [(400, None), (401, ""), (402, " "), (403, "a"), (None, base[0]), (5, base[5]), (5, base[6]), (404, "z" * 700)]
    rows += [(405, "ab" * 300), (406, "日本 語 \x1c x<|endoftext|>."), (407, prose(4000))]
    return rows


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(500, 500 + i) for i in range(1, 300)] + [(7, 7)]
    up = {}

    def root(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x["node"]: x["component"] for x in got} == {a: root(a) for a in list(up)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_token_ids_equal_the_library():
    own, library = TokenIds(PATH), Tokenizer.from_file(PATH)
    odd = ["Hello, WORLD!! it's 3.14..., b,,", "naïve Ünïcode’s ¿qué? İstanbul", "a\x1cb\x85c\xa0d", "<|endoftext|>x", "... ., ,"]
    for text in odd:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def expected_ids(text, end):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files(spark, texts, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = token_files.write_token_files(docs_of(spark, texts), folder, PATH)
    got = token_files.read_token_files(spark, folder, manifest).orderBy("start").collect()
    assert len(got) == len(texts)
    assert [(g["doc_id"] is not None, g["doc_id"] or 0) for g in got] == sorted((i is not None, i or 0) for i, _ in texts)
    at = 0
    for g in got:
        assert g["start"] == at and zlib.crc32(bytes(g["ids"])) == g["ids_crc32"] and len(g["ids"]) == 4 * g["n_tokens"]
        at += g["n_tokens"]
    want = sorted(expected_ids(t, 2).tobytes() for _, t in texts)
    assert sorted(bytes(g["ids"]) for g in got) == want
    empty = token_files.write_token_files(docs_of(spark, []), folder + "/none", PATH)
    assert token_files.read_token_files(spark, folder + "/none", empty).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 40_000])
def test_coder_blocks_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = rng.geometric(0.01, n) % 700
    symbols, counts = np.unique(ids, return_counts=True)
    kept, freq = token_files.scaled_frequencies(dict(zip(symbols.tolist(), counts.tolist())))
    coder = token_files.Coder(kept, freq)
    data = token_files.file_bytes(coder, [1], [n], ids)
    file = token_files.TokenFile(data)
    assert (file.ids(coder) == ids).all()
    last = len(file.blocks) - 1
    assert (file.ids(coder, last) == ids[file.blocks[last][0] :]).all()
    if len(kept) == 1:
        return  # a lone symbol takes no bits
    broken = bytearray(data)
    for i in range(3):
        broken[len(token_files.MAGIC) + i] ^= 255
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(broken)).ids(coder)


def test_packing(spark, texts):
    got = packing.pack(docs_of(spark, texts), PATH, size=64, group_tokens=2000).collect()
    want = []
    for i, t in texts:
        ids = expected_ids(t, 0)
        for p, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((str(i), p, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(g["doc_id"]), *g[1:5]) for g in got) == sorted(want)
    sequences = {}
    for g in got:
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.1 * sum(w[3] for w in want) / 64 + 2
    assert packing.pack(docs_of(spark, []), PATH).count() == 0


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]
    assert bins.put(4) == (0, 6)
    assert bins.put(2) == (2, 8)


def test_sharding(spark, texts):
    got = sharding.shuffle_into_shards(docs_of(spark, texts), shards=7, part_rows=6).collect()
    assert sorted((str(g["doc_id"]), g["size"], g["text_crc32"]) for g in got) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts
    )
    counts = {}
    for g in got:
        counts.setdefault(g["shard"], []).append(g["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    sizes = [len(counts.get(s, [])) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffle_into_shards(docs_of(spark, [])).count() == 0


def test_communication_matrix_is_uniform():
    total = np.zeros((2, 2))
    for seed in range(400):
        m = np.array(sharding.communication_matrix([30, 10], [20, 20], seed))
        assert m.sum(axis=1).tolist() == [30, 10] and m.sum(axis=0).tolist() == [20, 20]
        total += m
    assert abs(total[0, 0] / 400 - 15) < 0.3
    big = sharding.hypergeometric(np.random.default_rng(1), 3_000_000_000, 6_000_000_000, 900_000)
    assert abs(big - 300_000) < 5 * 450


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    prints = [(i, brute_fingerprint(t)) for i, t in texts]
    up = list(range(len(prints)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                up[max(root(i), root(j))] = min(root(i), root(j))
    group = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            group[root(i)] = min(group.get(root(i), d), d)
    want = sorted((str(d), f"{f:016x}", group[root(i)]) for i, (d, f) in enumerate(prints))
    got = simhash_dedup.near_duplicates(docs_of(spark, texts)).collect()
    assert sorted((str(g["doc_id"]), g["fingerprint"], g["component_id"]) for g in got) == want
    kept = simhash_dedup.keep_one(docs_of(spark, texts)).collect()
    assert len(kept) == len({root(i) for i in range(len(prints))})
    assert simhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_pipeline_keeps_one_of_near_fingerprints(spark, texts):
    """The stage keeps the first of each group of fingerprints linked within two bits."""
    import corpus_pipeline

    r = random.Random(12)
    rows = list(texts)
    for i in range(30):
        w = [f"s{i}w{r.randrange(300)}" for _ in range(400)]
        rows += [(2000 + 10 * i + k, " ".join([*w[: 399 - k], f"edit{i}x{k}"])) for k in range(4)]
    prints = [brute_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                x, y = up[i], up[j]
                up = [y if k == x else k for k in up]
    want = [min((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if up[k] == g) for g in set(up)]
    kept = corpus_pipeline.simhash_dedup(spark, docs_of(spark, rows), "").collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in kept) == sorted(want)
    assert len(rows) - 40 > len(want)


def test_labels_of_other_documents_do_not_use_up_the_sample(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(r.choice(["vile", "nasty"] if bad and k % 3 == 0 else ["tree", "river", "stone"]) for k in range(20))))
        labels.append((i, 1, int(bad), "x"))
    labels += [(10_000 + i, 1, i % 2, "x") for i in range(5_000)] + [(i, None, None, "x") for i in range(20_000, 20_500)] + [(None, 1, 1, "x")]
    # Labels beyond 0 and 1 are none.
    labels += [(i, 5, 7, "x") for i in range(400)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    chain = toxicity.fit_chain(docs_of(spark, rows), marks, train_rows=400)
    got = chain.score(docs_of(spark, rows)).select("doc_id", "p_toxic").collect()
    assert all((g["p_toxic"] >= toxicity.THRESHOLD) == (g["doc_id"] % 4 == 0) for g in got)


def test_vectors_of_any_magnitude_link(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((6, 8))
    rows = [(10 * i + k, (v * scale).tolist()) for i, v in enumerate(base) for k, scale in enumerate((1.0, 1e200, 1e-200, 3e-310))]
    rows += [(100, [1e308] * 8), (101, [5e-324] * 8), (102, [0.0] * 8)]
    got = {g["vec_id"]: g for g in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    for i, v in rows:
        near = [j for j, w in rows if j != i and any(v) and any(w) and unit(v) @ unit(w) >= 0.95]
        assert got[i]["n_links"] == len(near)


def test_vantage_points_find_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    points = np.unique(np.concatenate([centres ^ np.uint64(1 << int(a) | 1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))]))
    want = {
        (int(i), int(j)) for i in range(len(points)) for j in np.nonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 2)[0] + i + 1
    }
    found = {tuple(sorted(p)) for a, b in simhash_dedup.close_pairs(points, 2) for p in zip(a.tolist(), b.tolist())}
    assert found == want
    nodes = simhash_dedup.build_tree(points[::3], 9, 2)
    place, shard = simhash_dedup.route(nodes, points, 2)
    at = {}
    for p, s in zip(place.tolist(), shard.tolist()):
        at.setdefault(p, set()).add(s)
    assert all(at[i] & at[j] for i, j in want)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 16))
    near = base[:40] + rng.standard_normal((40, 16)) * 0.15
    hot = base[0] + rng.standard_normal((60, 16)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, hot]))]
    rows += [(900 + i, rows[3][1]) for i in range(4)]
    rows += [(950, None), (951, [0.0] * 16), (952, [float("nan")] * 16), (953, [1.0, None]), (954, []), (955, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cell int, tab int")
    got = {g["vec_id"]: g for g in embedding_dedup.link_vectors(df, cell_size=32, block=40).collect()}
    good = [(i, np.array(v)) for i, v in rows if i < 950]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    ids = [i for i, _ in good]
    label = list(ids)
    for _ in ids:
        label = [min([label[i], *(label[j] for j in np.nonzero(linked[i])[0])]) for i in range(len(ids))]
    for i, d in enumerate(ids):
        assert (got[d]["n_links"], got[d]["component_id"], got[d]["kept"]) == (linked[i].sum(), label[i], label[i] == d)
    for d in range(950, 956):
        assert (got[d]["n_links"], got[d]["component_id"]) == (0, d)
    assert len(got) == len(rows)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def test_suffixes(spark, texts):
    big = suffix_dedup.NO_ID
    ordered = sorted(((big if i is None else i), (t or "").encode()) for i, t in texts)
    first = {}
    for d, b in ordered:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], d)
    want = []
    for d, b in ordered:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((None if d == big else d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    for blocks, anchors, at_once in ((1 << 20, 100_000, 100_000), (3_000, 150, 20)):
        got = suffix_dedup.repeated_spans(docs_of(spark, texts), 50, blocks, anchors, at_once).collect()
        rows = [(g["doc_id"], g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for g in got]
        assert sorted(rows, key=str) == sorted(want, key=str)
    assert suffix_dedup.repeated_spans(docs_of(spark, [])).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, (500, 20)).astype(np.uint8)
    order = suffix_dedup.multikey_order(suffix_dedup._words(data))
    rows = [data[i].tobytes() for i in order]
    assert rows == sorted(rows)


def test_slices_keep_equal_words_together():
    words = np.random.default_rng(5).integers(0, 40, 500).astype(np.uint64)
    parts = suffix_dedup.slices(words, 30)
    assert sorted(np.concatenate(parts).tolist()) == list(range(500)) and len(parts) > 5
    assert all(words[a].max() < words[b].min() for a, b in zip(parts, parts[1:]))
    assert suffix_dedup.slices(words[:0], 30) == []


def smith_waterman(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, now[j] - 1))
        best, before = max(best, *now), now
    return best


def test_decontamination(spark, texts):
    r = random.Random(3)
    items = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(25))) for i in range(12)] + [(90, None), (91, ""), (92, "zzz")]
    rows = list(texts)
    rows += [(1000 + i, f"lead in {t} and out") for i, t in items[:12]]
    edited = []
    for i, t in items[:6]:
        w = t.split()
        w[4], w[15] = "other", "words"
        del w[20]
        edited.append((1100 + i, "before, " + " ".join(w).upper() + "! after"))
    rows += edited
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontamination.contaminated(docs_of(spark, rows), bench).collect()
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    want = {}
    for d, t in rows:
        for i, q in items:
            if words(q) and len(words(t)) < 200:
                score = smith_waterman(words(q), words(t)) / (2 * len(words(q)))
                if score >= 0.5:
                    want[d, i] = round(score, 6)
    assert {(g["doc_id"], g["item_id"]): g["score"] for g in got} == want
    assert {(1000 + i, i) for i in range(12)} | {(1100 + i, i) for i in range(6)} <= set(want)
    in_chunks = decontamination.contaminated(docs_of(spark, rows), bench, chunk_bytes=400).collect()
    assert {(g["doc_id"], g["item_id"]): g["score"] for g in in_chunks} == want
    left = decontamination.without_benchmark(docs_of(spark, rows), bench)
    assert left.columns == docs_of(spark, []).columns and left.count() == len([d for d, _ in rows if d not in {k[0] for k in want}])
    assert decontamination.contaminated(docs_of(spark, []), bench).count() == 0
    assert decontamination.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_heavily_edited_copies(spark):
    r = random.Random(8)
    items = [(i, " ".join(f"v{i}x{r.randrange(900)}" for _ in range(30))) for i in range(3)]
    every_fifth = lambda t, k: " ".join(f"new{k}y{j}" if j % 5 == 4 else w for j, w in enumerate(t.split()))
    # One copy; many copies with equal edits; copies of half an item, behind other words.
    rows = [(0, "lead " + every_fifth(items[0][1], 0) + " end")]
    rows += [(100 + k, every_fifth(items[1][1], 1) + f" tail{k}") for k in range(300)]
    rows += [(500 + k, f"other{k} " * 20 + " ".join(items[2][1].split()[15:])) for k in range(40)]
    rows += [(900, "nothing " + " ".join(items[0][1].split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(docs_of(spark, rows), bench).collect()
    want = {}
    for d, t in rows:
        for i, q in items:
            score = smith_waterman(q.split(), t.split()) / 60
            if score >= 0.5:
                want[d, i] = round(score, 6)
    assert len(want) == 341
    assert {(g["doc_id"], g["item_id"]): g["score"] for g in got} == want


def test_a_very_long_text_hashes_like_its_words():
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    whole = decontamination.word_hashes([text])[0]
    short = decontamination.word_hashes([" ".join(text.split()[:977])])[0]
    assert len(whole) == 300_000 and (whole[:977] == short).all() and (whole[977 * 5 : 977 * 6] == short).all()


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        image = [pseudonyms.permute(v, size, b"k", "t") for v in range(size)]
        assert sorted(image) == list(range(size))
        assert [pseudonyms.permute(v, size, b"k", "t", back=True) for v in image] == list(range(size))


def test_pseudonyms(spark):
    text = (
        "card 4539 1488 0343 6467, call +1 (269) 555-3296 or 212-555-0199, at 10.200.3.4 born 1984-02-29, 12/31/1999; "
        "mail Jo.Doe42@mail.example.com ssn 123-45-6789 bad 4539148803436468 300.1.1.1 2023-02-30 4.0.1"
    )
    new, found = pseudonyms.replace_values(text, b"key")
    assert [f[0] for f in found] == ["card", "phone", "phone", "ip", "date", "date", "email", "ssn"]
    for bad in ("4539148803436468", "300.1.1.1", "2023-02-30", "4.0.1"):
        assert bad in new
    card = re.sub(r"\D", "", found[0][3])
    assert pseudonyms.luhn_digit(card[:-1]) == int(card[-1]) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", found[0][3])
    datetime.date.fromisoformat(found[4][3])
    assert re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d\d@mail\.example\.com", found[6][3])
    assert pseudonyms.replace_values("4539148803436467 again", b"key")[1][0][3] == card
    rows = [(1, text), (1, text), (None, None), (2, ""), (3, "no values")]
    got = pseudonyms.pseudonymize(docs_of(spark, rows), b"key").collect()
    assert sorted(len(g["found"]) for g in got) == [0, 0, 0, 8, 8]
    assert pseudonyms.pseudonymize(docs_of(spark, []), b"key").count() == 0


@pytest.mark.parametrize(
    "text, cards",
    [
        ("4539 1488 0343 6467 12/25", ["4539 1488 0343 6467"]),
        ("qty 3 4539 1488 0343 6467", ["4539 1488 0343 6467"]),
        ("qty 3 4539-1488-0343-6467-12", ["4539-1488-0343-6467"]),
        ("77-4539-1488-0343-6467-12", ["4539-1488-0343-6467"]),
        ("9 4539148803436467 4111 1111 1111 1111 12", ["4539148803436467", "4111 1111 1111 1111"]),
        ("no 1234 1234 1234 1234 5", []),
    ],
)
def test_cards_beside_numbers(text, cards):
    new, found = pseudonyms.replace_values(text, b"key")
    assert [(k, text[a : a + n]) for k, a, n, _ in found] == [("card", c) for c in cards]
    assert not any(c in new for c in cards)
    assert pseudonyms.replace_values(new, b"key", back=True)[0] == text


def test_values_beside_failed_runs():
    text = "5 1234 1234 1234 1000 2001-02-03, 123 456 7890 4539 1488 0343 6467 10.0.0.1"
    found = pseudonyms.replace_values(text, b"key")[1]
    want = [("date", "2001-02-03"), ("card", "4539 1488 0343 6467"), ("ip", "10.0.0.1")]
    assert [(k, text[a : a + n]) for k, a, n, _ in found] == want


def test_lines(spark):
    prose = lambda k: f"the story number one of writer {'abcdefghij'[k % 10]} goes on {k}x"
    rows = [(i, f"unique words {'xyz'[i % 3] * (i + 1)} here\nPage {i} of 99\n\nAll rights reserved") for i in range(12)]
    rows += [(50, None), (51, ""), (None, "All rights reserved"), (3, rows[3][1]), (60, "All rights reserved\nAll rights reserved")]
    rows += [(70 + i, prose(i)) for i in range(3)]
    got = line_dedup.without_recurring_lines(docs_of(spark, rows)).collect()
    by = {}
    for g in got:
        by.setdefault(g["doc_id"], []).append(g["text"])
    assert by[0] == [rows[0][1]]
    assert by[1] == ["unique words yy here\n"] and by[3] == ["unique words xxxx here\n"] * 2
    assert by[50] == [None] and by[51] == [""] and by[None] == [""] and by[60] == [""]
    assert by[70] == [prose(0)]
    assert line_dedup.without_recurring_lines(docs_of(spark, [])).count() == 0


def test_lines_of_fields_recur_only_if_equal(spark):
    rows = [(i, f"{i}.5 13.{i} 99.{i}\nTotal {i} {i + 1} {i + 2}\n今天天气很好温度是{i}度我们去公园\n価格は {i}円でした本日のみ限定です") for i in range(12)]
    rows += [(20 + i, f"1.5 2.5 3.5\n第3章おわり\nPage {i} of 99") for i in range(12)]
    got = {g["doc_id"]: g["text"] for g in line_dedup.without_recurring_lines(docs_of(spark, rows)).collect()}
    assert all(got[i] == t for i, t in rows[:12])
    assert got[20] == rows[12][1] and {got[20 + i] for i in range(1, 12)} == {""}


def test_long_equal_lines_recur_from_two_documents(spark):
    import corpus_pipeline

    long = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}" for i in range(60))
    rows = [(i, f"{'own' * (i + 1)}\n{long}\nshort equal line") for i in range(9)] + [(40, long + "\n" + long), (41, None), (42, "")]
    rows += [(50, "once twice\n" + long.upper() + "\n" + long.upper())]
    cut = corpus_pipeline.line_dedup(spark, docs_of(spark, rows), "")
    got = {g["doc_id"]: g["text"] for g in cut.collect()}
    assert got == {0: rows[0][1], 41: None, 42: "", 50: rows[-1][1]} | {
        i: f"{'own' * (i + 1)}\nshort equal line" for i in range(1, 9)
    }
    # op1 keeps the ten documents of its SQL.
    left = line_dedup.without_recurring_lines(docs_of(spark, rows[:9])).select("text").collect()
    assert all(long in g["text"] for g in left)


def test_toxicity(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        bad, low = i % 5 == 0, i % 3 == 0
        w = [r.choice(words) for _ in range(30)] + ["scum"] * bad + ["junk"] * low
        rows.append((i, " ".join(w)))
        if i < 250:
            labels.append((i, int(not low), int(bad), "x"))
    rows += [(900, None), (901, ""), (None, "scum"), (902, "w1 " * 5000 + "scum")]
    labels += [(None, 1, 1, "x"), (3, None, None, "x"), (5000, 1, 1, "x")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(docs_of(spark, rows), marks).collect()
    assert len(got) == len(rows)
    held_out = [g for g in got if g["doc_id"] is not None and 250 <= g["doc_id"] < 400]
    right = sum(g["is_toxic"] == (g["doc_id"] % 5 == 0) for g in held_out)
    assert right / len(held_out) > 0.95
    assert toxicity.toxicity(docs_of(spark, rows), marks.limit(0)).where("is_toxic").count() == 0
    one_class = marks.where("toxic = 0")
    assert toxicity.toxicity(docs_of(spark, rows), one_class).where("is_toxic").count() == 0
    assert toxicity.without_toxic(docs_of(spark, []), marks).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = out


def test_a_text_is_hashed_and_cut_once(spark):
    """Not once for each of its lines; and lines are tidied as the patterns of the SQL say."""
    from pyspark.sql import functions as F

    texts = [" a\t b9c  d\r", "9", "x1 22y é", "plain words", "  ", "", "\f", "a  b", " 7 ", "ab12cd 3.4 <*>", "  1"]
    lines = line_dedup.numbered_lines(docs_of(spark, [(1, "\n".join(texts)), (2, None)]))
    got = {r.place: (r.line, r.masked) for r in lines.withColumn("masked", line_dedup.masked(F.col("line"))).collect()}
    tidy = [re.sub("^ | $", "", re.sub("[ \t\r\f]+", " ", t)) for t in texts]
    assert got == {i: (t, re.sub("[^ ]*[0-9][^ ]*", "<*>", t)) for i, t in enumerate(tidy) if t}
    plan = lines._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = next(i for i, row in enumerate(plan) if "Generate posexplode" in row)
    assert any("xxhash64(text" in row for row in plan[cut:]) and not any("xxhash64(text" in row for row in plan[:cut])
    done = line_dedup.without_recurring_lines(docs_of(spark, [(i, "same line here\nown") for i in range(12)]))
    plan = done._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("split(text" in row for row in plan if "transform(" in row)
    assert {r.doc_id: r.text for r in done.collect()} == {0: "same line here\nown"} | dict.fromkeys(range(1, 12), "")
