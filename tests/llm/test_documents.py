"""Operators over texts: plain versions on small inputs, and the defined edge cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from vulnlake.llm import licenses, packing, personal, quality, segmentation, simhash, suffix, toxicity
from vulnlake.llm.common import connected, least_labels

SCHEMA = "doc_id long, text string, row string, rest long, id long, fp string, base string, label string"


def documents(spark, rows):
    """Rows (doc_id, text) beside extra columns with names that operators use inside."""
    return spark.createDataFrame([(i, t, "r", 1, 2, "f", "b", "l") for i, t in rows], SCHEMA)


WORDS = "alpha beta gamma delta the of and stone river light ñandú über été".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "x" * 60_000),
    (5, prose(5, 400)),
    (5, prose(5, 400)),
    (6, prose(5, 400)),
    (None, prose(9, 30)),
    (7, "é" * 150),
    (8, "one"),
    (9, prose(10, 20_000)),
]


# --- SimHash ---------------------------------------------------------------------------


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [simhash.xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(marks):
    ids = sorted(marks)
    fps = np.array([marks[i] for i in ids], dtype=np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    label = least_labels(len(ids), i, j)
    return {ids[k]: ids[label[k]] for k in range(len(ids))}


def near_texts():
    rows = []
    for k in range(12):
        words = prose(k, 300).split()
        for copy in range(4):
            changed = list(words)
            changed[copy * 7] = f"changed{copy}"
            rows.append((100 * k + copy, " ".join(changed)))
    return rows


def test_simhash_matches_a_plain_version(spark):
    rows = near_texts() + [(9000, ""), (9001, None), (9002, "A b"), (9003, "a B")]
    out = simhash.simhash_components(documents(spark, rows)).collect()
    marks = {i: plain_simhash(t) for i, t in rows}
    assert {r["id"]: r["fp"] & (1 << 64) - 1 for r in out} == marks
    groups = plain_groups(marks)
    assert {r["id"]: r["component"] for r in out} == groups
    assert len(set(groups.values())) < len(rows)


@pytest.mark.parametrize("tile", [4, 2048])
def test_large_key_groups_are_tiled_without_loss(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (20, 15)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel()]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["id"]: r["component"] for r in connected(simhash.near_links(frame, tile=tile)).collect()}
    expected = plain_groups({int(s): int(u) for s, u in zip(fps.view(np.int64), fps)})
    assert len({found.get(int(x), int(x)) for x in fps.view(np.int64)}) == len(set(expected.values()))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_counters(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(3), base ^ np.uint64(1 << 40)])
    run = np.sort(rng.integers(0, 4, len(fps)))
    left, right = simhash.linked_in_runs(fps, run, radius)
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius) & (run[:, None] == run[None, :])
    i, j = np.nonzero(np.triu(near, 1))
    assert (least_labels(len(fps), i, j) == least_labels(len(fps), left, right)).all()


def test_simhash_edges(spark):
    docs = documents(spark, EDGES)
    kept = simhash.simhash_dedup(docs)
    assert kept.schema == docs.schema
    ids = Counter(r["doc_id"] for r in kept.collect())
    # Null, empty and blank texts share fingerprint 0; 6 copies 5; 5 is in twice; null ids stay.
    assert ids[1] == 1 and 2 not in ids and 3 not in ids and ids[5] == 2 and 6 not in ids and ids[None] == 1
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    found = {r["id"]: r["component"] for r in connected(links).collect()}
    assert found == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


# --- Suffixes --------------------------------------------------------------------------


def plain_removed(texts):
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        yield gone


def test_the_cover_meets_every_shift():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


def test_suffix_dedup_matches_a_plain_version(spark, monkeypatch):
    passage, other = prose(77, 60), prose(78, 40)
    rows = [(k, f"{prose(k, 20)} {passage[k:]} {prose(k + 50, 10)}") for k in range(15)]
    rows += [(20, other + "|" + other), (21, "ab" * 300), (22, passage[: 199]), (23, "é" * 100), (24, "é" * 100)]
    rows += EDGES[:3] + EDGES[4:7]
    out = suffix.remove_repeats(documents(spark, rows).repartition(3)).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    texts = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), t, gone in zip(rows, texts, plain_removed(texts)):
        spans = len(re.findall(b"\1+", bytes(gone)))
        expected.append((i, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in out.collect()]
    assert Counter(got) == Counter(expected)
    assert sum(r[2] for r in got) > 5000


def crafted(swapped):
    """200 bytes whose sum of byte values times powers of a fixed base once equalled the other's."""
    signs = [bin(k).count("1") % 2 for k in range(64)]
    text = bytearray(b"z" * 200)
    for start, pair in ((0, (111, 118)), (64, (102, 100)), (129, (51, 56))):
        text[start : start + 64] = bytes(pair[s ^ swapped] for s in signs)
    return text.decode()


def test_crafted_texts_do_not_collide(spark):
    one, two = crafted(0), crafted(1)
    out = suffix.remove_repeats(documents(spark, [(1, one), (2, two), (3, "q" + one)]))
    assert sorted((r["rest"]["doc_id"], r["n_removed"]) for r in out.collect()) == [(1, 200), (2, 0), (3, 200)]
    # Neither do sums of other shapes under any secret: blocks of letters that swap in this order.
    for secret in (0, 1, 2**125 - 1):
        heads = suffix.Heads(200, secret)
        for size in (1, 2, 4, 7, 8, 9, 12, 16, 25):
            order = [bin(k).count("1") % 2 for k in range(200 // size)]
            both = []
            for swapped in (0, 1):
                text = "".join(("a" if s ^ swapped else "b") * size for s in order).ljust(200, "c").encode()
                both.append(int(heads.at(np.frombuffer(text, dtype=np.uint8), np.array([0]))[0]))
            assert both[0] != both[1]


def test_suffix_dedup_edges(spark):
    docs = documents(spark, EDGES)
    kept = suffix.dedup_texts(docs)
    assert [f.name for f in kept.schema] == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.where("doc_id <> 5").collect()}
    assert texts[1] == "" and texts[4] == "" and texts[8] == "one" and texts[7] == ""
    assert kept.where("doc_id = 5").count() == 2
    assert suffix.dedup_texts(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(docs, width=20)


# --- Packing ---------------------------------------------------------------------------


def checked_sequences(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, long in sorted(places):
            assert offset == at
            at += long
        assert at <= length
    return by


def test_packing_matches_the_tokenizer(spark):
    rows = EDGES + [(k, prose(k, k % 37 * 20)) for k in range(20, 80)] + [(99, "a<|endoftext|>b it's` x. É. 5.")]
    out = packing.pack(documents(spark, rows).repartition(4)).collect()
    tokenizer = packing.Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    expected = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            expected[i, start // 2048, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    plain = packing.best_fit(Counter(r["length"] for r in out), 2048)
    assert len(checked_sequences(out, 2048)) <= sum(n for _, n in plain)
    assert packing.pack(documents(spark, []).limit(0)).count() == 0


def test_genetic_packing_keeps_every_piece():
    rng = np.random.default_rng(0)
    counts = Counter(int(x) for x in rng.integers(1, 100, 2000))
    first = packing.best_fit(counts, 100)
    for seed in range(4):
        best = packing.evolve(dict(counts), [first], 100, seed, 4, 4)
        used = Counter()
        for pattern, times in best:
            assert packing.fill(pattern) <= 100
            for size, count in pattern:
                used[size] += times * count
        assert used == counts
        assert packing.cost(best, 100) <= packing.cost(first, 100)


def test_islands_find_the_bound(spark):
    counts = {60: 30, 40: 30, 55: 20, 45: 20, 33: 12, 34: 6}
    best = packing.pack_lengths(spark, counts, 100, islands=2, epochs=2)
    assert packing.cost(best, 100)[0] == -(-sum(k * n for k, n in counts.items()) // 100)


# --- Toxicity and quality --------------------------------------------------------------


def labelled(spark, bad):
    rows, labels = [], []
    for k in range(300):
        is_bad = k % 5 == 0
        words = prose(k, 60).split()
        if is_bad:
            words[k % 50] = f"grimp{'abcde'[k % 4]}{k % 3}"
            words[k % 40 + 5] = "vile"
        text = " ".join(words)
        rows.append((k, bad(text) if is_bad else text))
        labels.append((k, int(not is_bad), int(is_bad)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_separates_and_generalises(spark):
    docs, labels = labelled(spark, lambda t: t)
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 2 = 0"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = toxicity.score(docs, model).select("row.doc_id", "severity", "p_toxic", "grade").collect()
    assert all(r["p_toxic"] >= 0.5 for r in out if r["doc_id"] % 5 == 0)
    assert sum(r["p_toxic"] >= 0.5 for r in out if r["doc_id"] % 5) <= 2
    unseen = documents(spark, [(1, prose(1, 50) + " grimpz9 vile"), *EDGES])
    kept = toxicity.drop_toxic(unseen, labels.limit(0)).count()
    assert kept == len(EDGES) + 1  # without labels nothing is rejected
    scored = {r["doc_id"]: r for r in toxicity.score(unseen, model).select("row.doc_id", "severity", "p_toxic").collect()}
    assert scored[2]["p_toxic"] < 0.5 and scored[3]["severity"] == scored[2]["severity"]
    dropped = toxicity.drop_toxic(unseen, labels.withColumn("doc_id", F.col("doc_id") * 0 + F.lit(None)))
    assert dropped.schema == unseen.schema


def test_ordinal_fit_orders_severity():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 4, 800)
    rows = [np.unique(np.concatenate([[10 + f for f in range(g)], rng.integers(100, 140, 5)])).astype(np.int32) for g in grades]
    model = toxicity.fit(rows, grades)
    eta = np.array([sum(model.weights[np.searchsorted(model.ids, f)] for f in r if f in set(model.ids.tolist())) for r in rows])
    severity = model.above(eta).sum(axis=1)
    means = [severity[grades == g].mean() for g in range(4)]
    assert means == sorted(means) and (np.diff(model.thresholds) > 0).all()


def test_ordinal_gradient():
    rng = np.random.default_rng(3)
    row, at, grades = rng.integers(0, 20, 60), rng.integers(0, 7, 60), rng.integers(0, 3, 20)
    params = rng.normal(size=9)

    def value(p):
        cuts = np.concatenate([[-np.inf], toxicity._cuts(p[7:]), [np.inf]])
        eta = np.bincount(row, p[at], 20)
        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        return np.log(sigmoid(cuts[grades + 1] - eta) - sigmoid(cuts[grades] - eta)).mean()

    steps = [(value(params + e) - value(params - e)) / 2e-6 for e in np.eye(9) * 1e-6]
    assert np.allclose(steps, toxicity._gradient(params, row, at, grades, 2), atol=1e-5)


def test_quality_ranks_held_out_rows(spark):
    docs, labels = labelled(spark, lambda t: t.replace(" ", "%%% ").upper())
    model = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    out = quality.score(docs, model).select("row.doc_id", "score").where("doc_id % 2 = 1").collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 5 != 0) for r in out)
    edges = quality.score(documents(spark, EDGES), model).select("row.doc_id", "score").collect()
    assert len(edges) == len(EDGES) and all(0 <= r["score"] <= 1 for r in edges)
    for label, score in ((1, 0.75), (0, 0.25)):
        one = quality.fit_quality(docs, labels.where(f"quality = {label}"))
        assert quality.score(docs, one).select(F.round("score", 6)).distinct().collect() == [(score,)]
    none = quality.fit_quality(docs, labels.limit(0))
    assert quality.score(docs, none).select("score").distinct().collect() == [(0.5,)]
    assert quality.score(docs.limit(0), model).count() == 0


# --- Personal data ---------------------------------------------------------------------

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def test_quality_uses_every_label(spark):
    """Cuts, threshold and pairs come from all labelled rows, so the very last one counts."""
    rows = spark.range(30_000).select(
        F.col("id"), (F.col("id") % 3 > 0).cast("long").alias("label"),
        F.array(*(F.when(F.lit(i > 0), 0.0).otherwise(F.col("id").cast("double")) for i in range(15))).alias("x"),
    )
    width = quality.text_features(pa.array([""])).shape[1]
    rows = rows.withColumn("x", F.slice("x", 1, width))
    pairs = quality._pairs(rows, 20_000, 10_000, 40_000)
    told = pairs.agg(
        F.count("*").alias("n"), F.countDistinct(F.col("left")[0]).alias("left"), F.countDistinct(F.col("right")[0]).alias("right")
    ).first()
    assert (told.n, told.left, told.right) == (40_000, 20_000, 10_000)
    model = quality.fit(rows)
    x = np.arange(30_000.0)
    at = np.arange(1, quality.CUTS) / quality.CUTS
    for k, side in enumerate((x[x % 3 > 0], x[x % 3 == 0])):
        got = model.cuts[0, k * len(at) : (k + 1) * len(at)]
        assert np.abs(got - np.quantile(side, at, method="midpoint")).max() < 0.01
    assert abs(model.mean[0] - x.mean()) < 1e-6
    raw = model.raw(np.concatenate([x[:, None], np.zeros((30_000, width - 1))], axis=1))
    assert abs(model.threshold - np.quantile(raw, 1 / 3, method="midpoint")) < 1e-4


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and personal.luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("letters", ["a@b.1-+ (2)3.0.@@%é\n5", "0123456789 -4.", "12.5.+"])
def test_base_spans_match_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert personal.base_spans(text) == plain_spans(text)


def test_personal_data(spark):
    card = "4111 1111 1111 1111"
    rows = [(k, f"call me, phone (0{k}) 555-{1000 + k} or mail a{k}@x.example.com") for k in range(20, 90)]
    rows += [(k, f"see version 3.{k}.{k} of order {k}0000{k}") for k in range(20, 90)]
    rows += [(200, f"card {card}, host 10.0.0.{k}") for k in range(5)] + EDGES
    docs = documents(spark, rows)
    model = personal.fit_spans(docs)
    out = personal.find_spans(docs, model).select("row.doc_id", "row.text", "base", "spans").collect()
    assert len(out) == len(rows)
    for r in out:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(r["text"] or ""))
        assert r["base"] == base and set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        if (r["text"] or "").startswith("call me"):
            assert r["spans"] != r["base"]  # the number without a plus was added
        if (r["text"] or "").startswith("see version"):
            assert r["spans"] == ""
    clean = personal.redact(docs)
    assert [f.name for f in clean.schema] == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.where("doc_id in (1, 2, 200)").collect()}
    assert texts[1] is None and texts[2] == "" and texts[200].startswith("card [CARD], host [IP]")
    assert personal.redact(docs.limit(0)).count() == 0


def test_reliabilities_are_learned():
    patterns = [("phone", (1, 0, 1, 1), 80), ("phone", (-1, 0, -1, -1), 90), ("phone", (1, 0, 0, 1), 20), ("phone", (-1, 0, 1, -1), 10)]
    likely = personal.estimate(patterns)
    assert likely["phone", (1, 0, 0, 1)] > 0.9 and likely["phone", (-1, 0, 1, -1)] < 0.1


# --- Licences --------------------------------------------------------------------------


def test_licenses(spark):
    rows = [(k, f"{prose(k, 30)}\n{prose(k + 1, 12)}") for k in range(60)]
    rows += [(100, "Intro\nReleased under the MIT License.\nend"), (101, "This work is licensed under the Apache License, Version 2.0."), (102, "All rights reserved."), (103, "the driver had to renew the licence of the bus"), (104, "licensed under cc by-nc 4.0!\nReleased under the MIT License.")]
    out = licenses.scan_licenses(documents(spark, rows + EDGES)).collect()
    found = {(r["id"], r["paragraph"], r["family"]) for r in out if r["confirmed"]}
    assert found == {(100, 1, "MIT"), (101, 0, "Apache-2.0"), (102, 0, "proprietary"), (104, 0, "CC-BY-NC-4.0"), (104, 1, "MIT")}
    assert all(r["probability"] >= 0.5 for r in out if r["confirmed"])
    assert all(r["family"] == "unknown" and r["probability"] < 0.5 for r in out if r["id"] == 103)
    assert licenses.scan_licenses(documents(spark, []).limit(0)).count() == 0


def test_dropped_paragraphs_are_unknown(spark):
    """The scan leaves out paragraphs without a feature; the model calls them unknown."""
    lines = licenses.paragraphs(documents(spark, [(k, prose(k, 20)) for k in range(50)]), "doc_id", "text")
    model = licenses.LicenseModel(licenses.training(spark, lines, 50))
    blank = spark.createDataFrame([(1, 0, "x", [])], T._parse_datatype_string("id long, paragraph int, text string, grams array<string>"))
    row = model.score(blank).first()
    assert row["family"] == "unknown" and row["probability"] < 0.5


# --- Segmentation ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return segmentation.Vocabulary(public_tokenizers.path(segmentation.MODEL))


def all_paths(unit, vocabulary):
    known = {vocabulary.text[i].decode(): (i, w) for i, w in zip(vocabulary.ids.tolist(), vocabulary.weights.tolist())}

    def walk(at):
        if at == len(unit):
            yield (), 1.0
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in known:
                for rest, weight in walk(end):
                    yield (known[unit[at:end]][0], *rest), weight * known[unit[at:end]][1]

    paths = dict(walk(0))
    total = sum(paths.values())
    return {ids: w / total for ids, w in paths.items()}


def test_samples_are_drawn_without_replacement(vocabulary):
    one, two = all_paths(" the", vocabulary), all_paths(" cat", vocabulary)
    chance = {a + b: x * y for a, x in one.items() for b, y in two.items()}
    n = 20_000
    search = segmentation.Search(pa.array(["the cat"] * n), np.arange(n), vocabulary)
    found, left = search.samples(3)
    drawn = []
    for live, merged, _, counts, log_p, gumbel in found:
        ids, offsets = search.ids(merged, counts)
        drawn.append([tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])])
        assert live.all() and np.allclose(log_p, [np.log(chance[x]) for x in drawn[-1]])
    assert all(len(set(x)) == 3 for x in zip(*drawn))
    assert (found[0][5] >= found[1][5]).all() and (found[1][5] >= found[2][5]).all() and (found[2][5] >= left).all()
    second = Counter()
    for a, p in chance.items():
        for b, q in chance.items():
            if a != b:
                second[b] += p * q / (1 - p)
    first, then = Counter(drawn[0]), Counter(drawn[1])
    assert max(abs(first[x] / n - p) for x, p in chance.items()) < 0.015
    assert max(abs(then[x] / n - p) for x, p in second.items()) < 0.015
    # Inclusion scores make weighted sums over the samples unbiased.
    weighted = sum(np.exp(f[4]) / -np.expm1(-np.exp(f[4] - left)) for f in found)
    assert abs(weighted.mean() - 1) < 0.02


def mass(unit, vocabulary):
    """Weight of all paths of a unit."""
    known = {vocabulary.text[i].decode(): w for i, w in zip(vocabulary.ids.tolist(), vocabulary.weights.tolist())}
    total = [0.0] * len(unit) + [1.0]
    for at in range(len(unit) - 1, -1, -1):
        total[at] = sum(known.get(unit[at:end], 0) * total[end] for end in range(at + 1, min(len(unit), at + 16) + 1))
    return total[0]


def drawn_ids(search, sample):
    ids, offsets = search.ids(sample[1], sample[3])
    return [tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]


def test_long_units_keep_their_whole_lattice(spark, vocabulary, monkeypatch):
    # Pieces may cross any place of a unit, also behind its 24th character.
    unit = " internationalizationinternational"
    weight = dict(zip(vocabulary.ids.tolist(), vocabulary.weights.tolist()))
    whole, n = mass(unit, vocabulary), 4_000
    share = 1 - mass(unit[:24], vocabulary) * mass(unit[24:], vocabulary) / whole
    search = segmentation.Search(pa.array([unit[1:]] * n), np.arange(n), vocabulary)
    found, _ = search.samples(2)
    for sample in found:
        wanted = [np.log([weight[i] for i in x]).sum() - np.log(whole) for x in drawn_ids(search, sample)]
        assert np.allclose(sample[4], wanted)
    ends = [np.cumsum([len(vocabulary.text[i]) for i in x]).tolist() for x in drawn_ids(search, found[0])]
    assert share > 0.1 and abs(sum(24 not in x for x in ends) / n - share) < 0.03
    # Paths that took more than one number are left out as well.
    monkeypatch.setattr(segmentation, "SPENT", 0.9)
    short = all_paths(" the", vocabulary)
    search = segmentation.Search(pa.array(["the"] * n), np.arange(n), vocabulary)
    found, _ = search.samples(2)
    first, second = drawn_ids(search, found[0]), drawn_ids(search, found[1])
    assert all(a != b for a, b in zip(first, second))
    for b in short:
        after = sum(p * short[b] / (1 - p) for a, p in short.items() if a != b)
        assert abs(first.count(b) / n - short[b]) < 0.03 and abs(second.count(b) / n - after) < 0.03
    monkeypatch.undo()
    # Weights of long units leave the range of doubles.
    long = ["日本語の文章" * 500, "international" * 500, " " * 2_000 + "x"]
    rows = segmentation.encode_samples(documents(spark, list(enumerate(long))), samples=2)
    assert rows.where("isnan(log_p) or log_p > 0").count() == 0
    # No piece joins two characters of the first text, so it has one segmentation.
    assert not any(ord(c) << 32 | ord(d) in set(vocabulary.pairs.tolist()) for c, d in zip(long[0][:7], long[0][1:7]))
    assert {(r["id"], r["sample"]) for r in rows.collect()} == {(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)}
    back = segmentation.decode(rows.select("id", "ids")).collect()
    assert all(r["text"] == long[r["id"]] for r in back)


def test_encoding_and_decoding(spark):
    hard = [(20, "  two  spaces "), (21, "▁ literal"), (22, "日本語 \x00 \r\n\t"), (23, "a" * 500), (24, " ")]
    docs = documents(spark, EDGES[:5] + EDGES[6:] + hard)
    out = segmentation.encode_samples(docs, samples=3)
    rows = {}
    for r in out.collect():
        rows.setdefault(r["id"], []).append(r)
    for i, given in rows.items():
        assert [r["sample"] for r in given] == list(range(len(given)))
        assert len({tuple(r["ids"]) for r in given}) == len(given)
        assert all(r["log_inclusion"] <= 0 and r["n_pieces"] == len(r["ids"]) for r in given)
    assert [r["log_inclusion"] for r in rows[2]] == [0.0] and len(rows[9]) == 3
    texts = {i: t or "" for i, t in EDGES[:5] + EDGES[6:] + hard}
    back = segmentation.decode(out.select(F.col("id").alias("id"), "ids"))
    assert all(r["text"] == texts[r["id"]] for r in back.collect())
    moved = segmentation.encode_samples(docs.repartition(3, "text"), samples=3)
    assert sorted(map(repr, moved.drop("log_p", "log_inclusion").collect())) == sorted(map(repr, out.drop("log_p", "log_inclusion").collect()))
    assert segmentation.encode_samples(docs.limit(0)).count() == 0
    digest = segmentation.encode_samples(docs, digest=True)
    assert digest.where("not exact").count() == 0 and digest.count() > len(rows)
    assert segmentation.decode(spark.createDataFrame([(1, None)], "id long, ids array<int>")).first()["text"] is None


def test_pipeline_stages_keep_the_contract(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, prose(k, 80), "en", "s", 0) for k in range(60)]
    rows += [(100 + k, prose(k, 80), "en", "s", 0) for k in range(10)]  # copies
    rows += [(200 + k, prose(300 + k, 40) + " vile grimp", "en", "s", 0) for k in range(20)]
    rows += [(300, None, None, None, None), (301, "mail me at a@b.example.com", "en", "s", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(200 + k, 1, 1) for k in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    expected = [set(range(60)) | set(range(100, 110)) | {300, 301}, set(range(60)) | {300, 301}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path))
        assert [(f.name, f.dataType) for f in kept.schema] == [(f.name, f.dataType) for f in docs.schema], name
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} == expected[min(k, 1)], name
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert texts[301] == ("mail me at [EMAIL]", 18) and texts[5] == (rows[5][1], len(rows[5][1]))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == expected[1]
    checked_sequences(packed, 2048)


def test_registered_queries_read_their_tables(spark):
    import __spark_entry__ as contract

    names = [n for n in contract.queries() if re.match(r"op\d+_|pipeline", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    out = contract.queries()["op2_suffix_array_dedup"](spark, "/root/testdata/sf0.001")
    first = out.orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == first["doc_id"]).first()["text"]
    assert first["n_bytes"] == len(text.encode())
    if not first["n_removed"]:
        assert first["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# --- Token ids -------------------------------------------------------------------------


def test_word_ids_are_the_tokenizers_own():
    """Hard words, and a table so small that it forgets again and again."""
    words = packing.WordIds(public_tokenizers.path(packing.TOKENIZER), remembered=3000)
    rng = random.Random(4)
    pool = list("abcxyzéÉßÿŸñÑçöÖ09²½ªº.,!?'#$*%_-~^`|<>\"()«»¿¡§€αΩжЖ你好́İıſK\x00\x07\xad\xa0µ×÷")
    pool += ["'s", "'re", "<|", "|>", "<|endoftext|>", "..."]
    texts = [" ".join("".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", "é" * 40, "a" * 33, "b" * 32, prose(1, 5000)]
    for at in range(0, len(texts), 250):
        some = texts[at : at + 250]
        ids, starts = words.batch(pa.array(some))
        for k, text in enumerate(some):
            expected = words.tokenizer.encode(text, add_special_tokens=False).ids + [packing.SEPARATOR]
            assert ids[starts[k] : starts[k + 1]].tolist() == expected


def test_merges_are_the_tokenizers_own():
    words = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(6)
    parts = "th ti on ou er he re an in ed ing st wh ea sh en nd tion é ü ß ñ a e i o u z q aa".split()
    some = list({"".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))[:16] for _ in range(3000)} | {"a", "aaaaaaa", "abababab"})
    ids, lengths = words.merges.encode(some)
    assert ids.tolist() == [i for w in some for i in words.alone(w)]
    assert lengths.tolist() == [len(words.alone(w)) for w in some]


def test_unscaled_totals_near_a_units_end_give_the_same_lattices(monkeypatch):
    import public_tokenizers

    vocabulary = segmentation.Vocabulary(public_tokenizers.path(segmentation.MODEL))
    places = np.arange(len(vocabulary.hashes))
    at, place = vocabulary.find(np.concatenate([vocabulary.hashes, vocabulary.hashes ^ np.uint64(1)]))
    found = at < len(places)
    assert (at[found] == places).all() and (vocabulary.hashes[place[found]] == vocabulary.hashes).all()
    units = [" word", " " + "x" * 3_000, " " + "\U0001f600" * 90, " naïve" + "ab" * 40, "   "]
    made = []
    for near in (segmentation.NEAR, 0):
        monkeypatch.setattr(segmentation, "NEAR", near)
        lattice = segmentation.lattices(units, vocabulary)
        made.append([getattr(lattice, c) for c in ("edges", "target", "piece", "chance", "below")])
    assert all(np.array_equal(a, b) for a, b in zip(*made))
    assert np.isfinite(made[0][3]).all()



def test_a_block_of_copies_fits_beside_an_executor():
    import tracemalloc

    data = np.random.default_rng(1).integers(0, 256, suffix.BLOCK_BYTES // 2, dtype=np.uint8).tobytes() * 2
    tracemalloc.start()
    try:
        gone = suffix.Texts(data, [len(data) // 8] * 8, suffix.WIDTH, 8, (1 << 100) + 12345).removed(None, None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert gone.all() and peak < 300 << 20


def test_segmentation_holds_little_of_a_batch(spark, monkeypatch):
    """A worker's memory follows the slices that it encodes, not the batches that arrive."""
    monkeypatch.setattr(segmentation, "map_batches", lambda rows, run, schema: run)
    run = segmentation.encode_samples(spark.createDataFrame([], "doc_id long, text string"), digest=True)
    # 4 MiB of words that are all different.
    texts = [" ".join(f"{mixed:x}" for mixed in range(n << 32, (n << 32) + 4096 * 104729, 104729)) for n in range(1, 100)]
    texts = texts[: (4 << 20) // len(texts[0])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    try:
        exact = [x for part in run(iter([batch])) for x in part.column("exact").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert exact == [True] * 2 * len(texts)
    assert peak < 500 << 20


def test_a_batch_without_second_samples_keeps_its_types(spark):
    docs = documents(spark, [(1, ""), (2, None)]).coalesce(1)
    found = segmentation.encode_samples(docs, digest=True).collect()
    assert sorted((r["id"], r["sample"], r.n_pieces, r.ids_crc32, r.exact) for r in found) == [(1, 0, 0, 0, True), (2, 0, 0, 0, True)]
