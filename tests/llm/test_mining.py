"""Phrase mining, toxicity and hard negatives against plain versions, held-out labels and awkward rows."""

import collections
import decimal
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import collocations, hard_negatives, queries, toxicity
from stockloom.llm.batches import slabs

EXTRA = "source string, id bigint, w string, n bigint, rank int, owned int, tile int, score double"
MORE = ("s", 1, "w", 2, 3, 4, 5, 0.5)


# --- phrases -------------------------------------------------------------------------------------------------------


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counted(rows, longest):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, longest + 1):
                counts[lang].update(" ".join(w[i:i + size]) for i in range(len(w) - size + 1))
    return counts, total


def phrases(rows, plan):
    counts, total = counted(rows, plan.longest)
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if " " in p and a >= plan.least}
        found = []
        for p, a in candidates.items():
            if any(q.count(" ") > p.count(" ") and f" {p} " in f" {q} " and 100 * b >= plan.covered * a for q, b in candidates.items()):
                continue
            w = p.split(" ")
            ways = [(c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, (left, right) = min((1_000_000 * a * a // (x * y), k, (x, y)) for k, (x, y) in enumerate(ways))
            found.append((-score, -a, p.encode(), (p, a, left, right, total[lang], score)))
        out += [(lang, rank, *row) for rank, (*_, row) in enumerate(sorted(found)[:plan.top], 1)]
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame([(*r, *MORE) for r in rows], f"text string, lang string, {EXTRA}").repartition(3)


def toy_texts(seed):
    draw = random.Random(seed)
    words = ["a", "B", "c.", "d,e", "É", "a\tb", "\x85", "x!y", " "]
    rows = [(" ".join(draw.choice(words) for _ in range(draw.randrange(40))), draw.choice([None, "en", "und"])) for _ in range(80)]
    return rows + [(None, "en"), ("", "xx"), (" \n.", None), ("a a " * 500, "en")] + [("q r s t u v", "en")] * 12


@pytest.mark.parametrize("plan", [
    collocations.PhrasePlan(),
    collocations.PhrasePlan(period=2, least=2, stretch=5, tokens=50, chunk_bytes=100, hot_parts=4, block_bytes=300),
    collocations.PhrasePlan(period=1, longest=4, least=2, hot_parts=1 << 40),
    collocations.PhrasePlan(period=10**6, stretch=3, least=2, longest=2, top=5, salts=2),
])
def test_phrases_against_plain_counts(spark, plan):
    rows = toy_texts(plan.period)
    got = sorted(tuple(r) for r in collocations.mine_phrases(documents(spark, rows), plan).collect())
    assert got == phrases(rows, plan) and got


def test_phrases_of_nothing(spark):
    assert collocations.mine_phrases(documents(spark, []).where("false")).collect() == []
    assert collocations.mine_phrases(documents(spark, [(None, None), ("one", "en")])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_chunks_own_every_word_once(seed, monkeypatch):
    draw = random.Random(seed)
    monkeypatch.setattr("stockloom.llm.batches.SLAB_BYTES", 50)
    plan = collocations.PhrasePlan(period=draw.choice([1, 3, 9]), stretch=draw.choice([2, 7, 4096]))
    text = " ".join(draw.choice(["a", "b", "cc.", "dd"]) for _ in range(draw.randrange(400))).encode()
    assert b"".join(slabs(text)) == text
    line = collocations.tokens(text)
    at = 0
    for owned, chunk in collocations.parse(text, plan):
        held = chunk.split(b" ")
        assert held == line[at:at + len(held)] and owned <= len(held)
        # All phrases that begin in the chunk lie in it.
        assert len(held) >= min(owned + plan.longest - 1, len(line) - at)
        at += owned
    assert at == len(line)


def test_shared_passages_fall_into_the_same_chunks():
    draw = random.Random(5)
    text = lambda n: " ".join("w%d" % draw.randrange(3000) for _ in range(n))
    shared = text(600)
    plan = collocations.PhrasePlan()
    one, two = (dict.fromkeys(collocations.parse(f"{text(50)} {shared} {text(70)}".encode(), plan)) for _ in range(2))
    common = sum(owned for owned, _ in one.keys() & two.keys())
    assert common > 500


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_007, 3_000_000_000_011, 9_999_999_999_973
    row = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    got = row.select(collocations.cut_score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1_000_000 * a * a // (left * right)
    assert decimal.Decimal(a) * a > 2**63


# --- toxicity ------------------------------------------------------------------------------------------------------

SMALL = toxicity.NetPlan(window=6, stride=3, width=4, hidden=3, gram_rows=256, epochs=8, rows=200, batch=16)


def toy_labels(n=160, seed=1):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        line = [draw.choice(words) for _ in range(draw.choice([1, 5, 30]))]
        bad = i % 4 == 0
        for _ in range(2 if bad else 0):
            line.insert(draw.randrange(len(line) + 1), draw.choice(["Vile,", "rotten", "VILE"]))
        rows.append((i, " ".join(line), int(bad)))
    return rows


def plain_score(net, text):
    """One window after the other, one step after the other."""
    p, plan, size = {k: v.astype(float) for k, v in net.p.items()}, net.plan, net.plan.hidden
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    words = [toxicity.plain(t) for t in text.encode().split()]
    if not words:
        return 0.0

    def vector(word):
        own = p["words"][net.words[word]] if word in net.words else np.zeros(plan.width)
        three, four, _ = toxicity.gram_ids([word], plan.gram_rows)
        return np.concatenate([own, np.mean([p["grams"][i] for i in [*three, *four]], 0)])

    def read(side, xs):
        h, out = np.zeros(size), []
        for x in xs:
            a = x @ p[f"{side}_in"] + p[f"{side}_bias"]
            z, r = np.split(sigmoid(a[:2 * size] + h @ p[f"{side}_gates"]), 2)
            n = np.tanh(a[2 * size:] + (r * h) @ p[f"{side}_new"])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    best = -np.inf
    last = max(len(words) - plan.window, 0)
    for start in sorted({*range(0, last + 1, plan.stride), last}):
        xs = [vector(w) for w in words[start:start + plan.window]]
        states = [np.concatenate(s) for s in zip(read("f", xs), read("b", xs[::-1])[::-1])]
        energy = np.array([np.tanh(s @ p["attend"]) @ p["focus"] for s in states])
        weight = np.exp(energy - energy.max())
        best = max(best, (weight / weight.sum()) @ np.array(states) @ p["out"] + p["bias"][0])
    return float(sigmoid(best))


def windows_of(text, plan):
    tokens = [toxicity.plain(t) for t in text.encode().split()]
    return [tokens[s:s + plan.window] for s in toxicity.window_starts(len(tokens), plan)]


def test_gradients_are_slopes():
    draw = np.random.default_rng(0)
    net = toxicity.Network.fresh(SMALL, {b"a": 0})
    net.p = {k: v.astype(float) + draw.normal(size=v.shape) * 0.2 for k, v in net.p.items()}
    x, ids, mask = draw.normal(size=(6, 8)), draw.integers(0, 6, (6, 7)), np.ones((6, 7), bool)
    mask[3:, 2] = mask[1:, 4] = False
    y = draw.integers(0, 2, 7).astype(float)
    _, slopes, d_x = toxicity.gradients(net, x, ids, mask, y)

    def slope(values, at):
        old, step = values[at], 1e-5
        values[at] = old + step
        above = toxicity.gradients(net, x, ids, mask, y)[0]
        values[at] = old - step
        below = toxicity.gradients(net, x, ids, mask, y)[0]
        values[at] = old
        return (above - below) / (2 * step)

    for name, got in [*slopes.items(), ("x", d_x)]:
        values = x if name == "x" else net.p[name]
        for _ in range(5):
            at = tuple(draw.integers(0, s) for s in values.shape)
            assert math.isclose(slope(values, at), np.asarray(got)[at], abs_tol=1e-8)


def test_scores_of_batches_are_those_of_single_steps():
    rows = toy_labels()
    net = toxicity.fit([(y, windows_of(t, SMALL)) for _, t, y in rows], SMALL)
    texts = [t for _, t, _ in rows] + ["", " \n", "...", "é" * 300, "vile " * 40, "w1 " * 100 + "vile"]
    got = toxicity.Scorer(net, most=10, rows=5)([t.encode() for t in texts])
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)


def test_windows_cover_every_word():
    for n in range(1, 60):
        starts = toxicity.window_starts(n, SMALL)
        assert {i for s in starts for i in range(s, min(s + SMALL.window, n))} == set(range(n))
        assert len(starts) == len(set(starts)) and starts[-1] == max(n - SMALL.window, 0)
    assert len(toxicity.window_starts(0, SMALL)) == 0


def test_toxicity_on_awkward_rows(spark):
    rows = toy_labels()
    texts = [(i, t) for i, t, _ in rows] + [(None, None), (None, "vile"), (3, ""), (5, rows[5][1]), (1000, "w1 w2 " * 60_000 + "vile rotten")]
    docs = spark.createDataFrame([(*r, *MORE) for r in texts], f"doc_id bigint, text string, {EXTRA}").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (8, 1), (8, 0)], "doc_id bigint, label int")
    got = toxicity.toxicity_by_fold(docs, labels, plan=SMALL).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == rows[r.doc_id][2] for r in got if r.doc_id is not None and r.doc_id not in (3, 1000)) > 150
    assert next(r.score for r in got if r.doc_id == 1000) > 0.5
    # Labels of the held-out fold change nothing.
    flipped = labels.withColumn("label", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    again = toxicity.toxicity_by_fold(docs, flipped, plan=SMALL).collect()
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in again) == sorted((str(r.doc_id), round(r.score, 5)) for r in got)
    assert toxicity.toxicity_by_fold(docs.where("false"), labels, plan=SMALL).collect() == []


@pytest.mark.parametrize("value", [None, 0, 1])
def test_toxicity_of_one_class(spark, value):
    docs = spark.createDataFrame([(i, f"w{i} x") for i in range(9)], "doc_id bigint, text string")
    labels = docs.select("doc_id", F.lit(value).cast("int").alias("label"))
    got = toxicity.toxicity_by_fold(docs, labels, plan=SMALL).collect()
    assert {r.predicted for r in got} == {1 if value else 0}


def test_sample_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"a b {i}") for i in range(300)] + [(2, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, label int")
    assert len(toxicity.sample(docs, labels, SMALL)) == 2


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in queries.op12_toxicity(spark, d).where("held_out").collect() if r.doc_id in labels]
    found = collections.Counter(got)
    assert found[1, 1] / (found[1, 1] + found[0, 1]) > 0.85
    assert found[0, 0] / (found[0, 0] + found[1, 0]) > 0.93


# --- hard negatives ------------------------------------------------------------------------------------------------


def hard(rows, anchor, floor=80, k=5):
    hold = lambda v: max(-2**63, min(2**63 - 1, v))
    seen = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(c is None or not math.isfinite(c) for c in v):
            continue
        row = (label, [hold(math.floor(c * 256)) for c in v])
        seen[i] = min(row, seen.get(i, row))
    out = []
    for a, (label, xa) in seen.items():
        if not anchor(a):
            continue
        scores = sorted((-hold(sum(p * q for p, q in zip(xa, x))), i, other) for i, (other, x) in seen.items() if i != a)
        for i, s in [(i, -s) for s, i, other in scores if other == label][:k]:
            near = [(j, -t) for t, j, other in scores if other != label and floor * s <= -100 * t <= 100 * s][:k]
            out += [(a, i, rank, j, s, t) for rank, (j, t) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 1e6, 1e17])
def test_hard_negatives_against_all_rows(spark, size):
    draw = random.Random(3)
    vectors = lambda i: draw.choice([
        [draw.gauss(0, size) for _ in range(draw.choice([3, 3, 2]))], [0.5 * size] * 3, [0.5 * size] * 3,
        None if i % 20 == 0 else [1.0, float("nan"), 2.0] if i % 21 == 0 else [1.0, None] if i % 22 == 0 else [0.25] * 3, []])
    rows = [(draw.choice([i, i, 7, None]), draw.choice([0, 1, 1, 2, None, -1]), vectors(i)) for i in range(400)]
    df = spark.createDataFrame([(*r, *MORE) for r in rows], f"vec_id bigint, label int, embedding array<double>, {EXTRA}").repartition(5)
    plan = hard_negatives.MinePlan(tile_rows=40, block_rows=9, leaf=4, fan=3)
    got = hard_negatives.hard_negatives(hard_negatives.points(df), F.col("vec_id") % 5 == 0, plan)
    assert sorted(tuple(r) for r in got.collect()) == hard(rows, lambda i: i % 5 == 0)
    none = hard_negatives.hard_negatives(hard_negatives.points(df.where("false")), F.col("vec_id") % 5 == 0, plan)
    assert none.collect() == []
    assert hard_negatives.hard_negatives(hard_negatives.points(df), F.lit(None).cast("boolean"), plan).collect() == []


def test_boxes_bound_their_rows_and_are_passed_over():
    draw = np.random.default_rng(2)
    n = 3000
    x = np.concatenate([draw.integers(-9, 9, (n, 3)) + 100 * c for c in np.eye(3, dtype=int)])
    ids, labels = draw.permutation(len(x)), np.repeat([0, 1, 2], n)
    plan = hard_negatives.MinePlan(leaf=32)
    tree = hard_negatives.build_tree(ids, labels, x, plan)
    assert sorted(tree.ids.tolist()) == list(range(len(x)))
    leaves = [k for k in range(len(tree.lo)) if not tree.kids[k]]
    assert sum(b - a for a, b in (tree.rows[k] for k in leaves)) == len(x)
    for k in leaves:
        rows = tree.x[slice(*tree.rows[k])]
        assert (tree.lo[k] <= rows).all() and (rows <= tree.hi[k]).all()

    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counting.read += 1
            return super().__getitem__(at)

    tree.labels = tree.labels.view(Counting)
    q = np.array([[100, 0, 0]])
    hard_negatives.search(tree, q, np.array([-1]), np.array([0]), 5, same=True)
    assert 0 < Counting.read < len(leaves) / 3
