"""Operators that compare rows with each other, against brute force on small tables with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import fingerprints, lm_scoring, mixing, ngram_join, shingles
from stockloom.llm.components import component_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, lang string, id bigint, row string, size bigint, target double, word string, c int"


def frame(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names the operators use, too."""
    return spark.createDataFrame([(*r, "en", 1, "r", 2, 0.5, "w", 3) for r in rows], SCHEMA).repartition(3)


def shared_targets(sizes, weights=(3, 1, 2)):
    """Shares by weight, cut off at twice the size, the excess shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target = {s: 1.5 * sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    free = set(names)
    while over := [s for s in free if target[s] > 2 * sizes[s] + 1e-9]:
        excess = sum(target[s] - 2 * sizes[s] for s in over)
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += excess * weight[s] / total
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice([None, 1, 2, i]), draw.choice([None, "", "w " * draw.randint(1, 90)]), draw.choice([None, "", "a", "b", "é"]))
            for i in range(60)] + [(7, "x y z", "hot")] * 40
    docs = frame(spark, rows)
    mixed = mixing.mix_sources(docs).collect()
    assert sorted(str((r.doc_id, r.source, r.size)) for r in mixed) == sorted(
        str((i, s, len(WORD.findall(t or "")))) for i, t, s in rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in mixed:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    target = shared_targets(sizes)
    for r in mixed:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-12)
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in sizes)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    largest = max(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert all(abs(words[s] - target[s]) <= largest for s in sizes)


def test_mixing_ranges_agree_with_one(spark, monkeypatch):
    docs = frame(spark, [(i, "w " * (i % 13 + 1), "s" if i % 3 else "t") for i in range(200)])
    one = sorted(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == one


def test_mixing_tells_rows_of_one_id_and_size_apart(spark, monkeypatch):
    """Rows without id and of equal size fill many ranges, and a rerun over other partitions takes the same ones."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    docs = frame(spark, [(None, f"w{i}", "s") for i in range(300)] + [(5, "a b", "t")] * 3)
    placed = mixing._placed(docs, (3, 1, 2), 1.5, 2.0)
    assert placed.select("__mix_range").distinct().count() > 20
    one, two = (sorted(r.text for r in mixing.mixed_documents(d).collect()) for d in (docs, docs.repartition(5)))
    assert one == two and len(set(one)) > 200


def test_mixing_of_nothing(spark):
    assert mixing.mix_sources(frame(spark, []).limit(0)).count() == 0
    blank = mixing.mix_sources(frame(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def shingle_sets(texts):
    found = []
    for t in texts:
        w = WORD.findall(t or "")
        found.append(frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    return found


def brute_classes(rows):
    sets = shingle_sets([t for _, t, _ in rows])
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= 0.8 * len(a | b):
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return [(d, smallest.get(find(i)), links[i], len(sets[i])) for i, (d, _, _) in enumerate(rows)]


def near_rows(seed, n=90):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n", "a"), (3, "one two", "a"), (4, "one\ttwo", "a"), (None, "one two three four", "a")]
    base = [word() for _ in range(150)]
    for i in range(5, n):
        kind = i % 4
        if kind == 0:
            w = [word() for _ in range(draw.randint(3, 200))]
        elif kind == 1:
            w = list(base)
            for _ in range(draw.randint(0, 5)):
                w[draw.randrange(len(w))] = word()
        elif kind == 2:
            w = passage.split() + [word() for _ in range(draw.randint(0, 60))]
        else:
            w = base[:draw.randint(100, 150)]
        rows.append((i if draw.random() < 0.95 else None, " ".join(w), "a"))
    return rows + rows[20:30] * 2


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("plan", [ngram_join.JoinPlan(), ngram_join.JoinPlan(bucket=3, block=4)], ids=["default", "splits"])
def test_join_against_all_pairs(spark, seed, plan):
    rows = near_rows(seed)
    got = ngram_join.ngram_jaccard_join(frame(spark, rows), plan).collect()
    assert sorted(map(str, brute_classes(rows))) == sorted(str((r.doc_id, r.class_id, r.n_links, r.n_shingles)) for r in got)


def test_one_of_each_class(spark):
    rows = near_rows(5)
    docs = frame(spark, rows)
    kept = ngram_join.one_of_each_class(docs)
    assert kept.columns == docs.columns
    sets = shingle_sets([t for _, t, _ in rows])
    parts = {}
    classes = ngram_join.ngram_jaccard_join(docs).collect()
    for r in classes:
        parts.setdefault(r.class_id, 0)
    got = kept.collect()
    left = shingle_sets([r.text for r in got])
    # No two of the kept are near, and every document is near a kept one or linked to it by others.
    for a, b in itertools.combinations(left, 2):
        assert a != b and len(a & b) < 0.8 * len(a | b)
    named = [r for r in got if r.doc_id is not None]
    assert len(named) == len({r.class_id for r in classes if r.class_id is not None})
    assert {r.doc_id for r in named} == {r.class_id for r in classes if r.class_id is not None} and sets


def test_join_of_nothing(spark):
    nothing = frame(spark, []).limit(0)
    assert ngram_join.ngram_jaccard_join(nothing).count() == 0 and ngram_join.one_of_each_class(nothing).count() == 0


def test_large_groups_are_not_paired(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(40)), "a") for i in range(400)]
    got = ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 399)}


@pytest.mark.parametrize("common, own", [(4, 1), (8, 1), (16, 2), (24, 3)])
def test_paths_of_small_sets_reach_their_recall(common, own):
    """Near copies of 5 to 27 shingles: similarity at the threshold or next to it, one split at a time."""
    plan, draw = ngram_join.JoinPlan(), np.random.default_rng(common)
    for width in plan.widths:
        keys, missed = plan.paths(width), 0
        for _ in range(1500):
            drawn = draw.integers(0, 2**64, common + 2 * own, dtype=np.uint64)
            a, b = np.sort(drawn[:common + own]), np.sort(np.append(drawn[:common], drawn[common + own:] if common > 4 else drawn[:0]))
            x, y = (set(shingles.coordinate_paths(s, width, keys, plan.seed).tolist()) for s in (a, b))
            missed += x.isdisjoint(y)
        assert missed <= 8


def test_components(spark):
    draw = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + draw.randrange(30), 200 + draw.randrange(30)) for _ in range(25)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.label for r in component_labels(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_shingle_hashes_follow_the_words():
    text = "a b c d e f g \x0b h\x1ci j"
    assert len(shingles.shingle_set(text.encode())) == len(shingle_sets([text])[0])
    assert len(shingles.shingle_set(b"  ")) == 0 and len(shingles.shingle_set(b"a b")) == 1
    assert set(shingles.shingle_set(b"a b")) != set(shingles.shingle_set(b"b a"))


def expected_edits(rows):
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        third = len(t) // 3
        edited = t[:len(t) - third] + order[(k + 1) % len(order)][1][:third]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("case", ["none", "one", "nulls", "ties", "many"])
def test_fingerprint_edits(spark, case):
    draw = random.Random(2)
    rows = {
        "none": [], "one": [(1, "abc def", None)],
        "nulls": [(None, "aaa bbb", "a"), (None, None, "a"), (None, "zz é z", "a"), (5, "hello 中文 world", "a"), (7, "", "a"), (7, None, "a")],
        "ties": [(3, "x y z", "a")] * 4 + [(3, "other words here", "a")],
        "many": [(draw.choice([None, 1, 9, 10**12, -4, i]), " ".join(draw.choice(["q", "r", "s", "tt"]) for _ in range(draw.randint(0, 30))), "a")
                 for i in range(80)],
    }[case]
    docs = frame(spark, rows)
    got = fingerprints.fingerprint_edits(docs, fingerprints.build_lexicon(docs, commonest=1.0)).collect()
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == expected_edits(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all(r.near_edited == 1 for r in got if r.fingerprint == r.edited_fingerprint)


def test_lexicon_holds_the_band_and_little_else(spark):
    """Every word of the band is a term; of 60,000 others fewer than 1 in 1,000 are."""
    words_in, words_out = [f"in{i}" for i in range(20_000)], [f"out{i}" for i in range(60_000)]
    hashed = lambda ws: spark.createDataFrame([(w,) for w in ws], "w string").select(F.xxhash64("w").alias("h"))
    lexicon = fingerprints.Lexicon(fingerprints.tag_table(r.h for r in hashed(words_in).collect()), 1)
    texts = spark.createDataFrame([(" ".join(words_in),), (" ".join(words_out),), (None,)], "text string")
    found = [r[0] for r in texts.select(F.size(fingerprints.terms(F.col("text"), lexicon))).collect()]
    assert found[0] == len(words_in) and found[1] < len(words_out) / 1000 and found[2] == 0
    assert sum(map(bool, fingerprints.tag_table([5, 5, 5 - (1 << 64)], 8))) == 1


def test_fingerprints_tell_edits_from_others(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = fingerprints.fingerprint_edits(docs, fingerprints.build_lexicon(docs)).collect()
    edited, other = sorted(r.near_edited for r in rows), sorted(r.near_next for r in rows)
    assert edited[len(rows) // 2] > 0.25 and other[len(rows) * 9 // 10] < 0.15
    same = collections.defaultdict(set)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        same[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize("common", [0.95, 0.67])
def test_likeness_of_edits_at_every_size(spark, common):
    """Texts just above a rate, too, have enough sampled terms: no edit looks like an unrelated text."""
    draw = random.Random(5)
    rows = []
    for m in [2, 17, 65, 260, 1030, 5000]:
        for _ in range(60 if m < 5000 else 10):
            terms = [draw.getrandbits(63) for _ in range(m)]
            changed = draw.sample(range(m), m - round(m * common))
            rows.append((m, sorted(terms), sorted([draw.getrandbits(63) if k in set(changed) else t for k, t in enumerate(terms)]
                                                  if m < 1000 else terms[len(changed):] + [draw.getrandbits(63) for _ in changed]),
                         sorted(draw.getrandbits(63) for _ in range(m))))
    pairs = spark.createDataFrame(rows, "m int, a array<bigint>, b array<bigint>, c array<bigint>").select(
        "m", *[fingerprints.subset_hashes(F.col(x)).alias(x) for x in "abc"])
    got = pairs.select(
        "m", fingerprints.likeness(F.col("a"), F.col("b")).alias("edit"), fingerprints.likeness(F.col("a"), F.col("c")).alias("other")).collect()
    assert len(got) == len(rows) and all(r.other == 0 for r in got)
    assert min(r.edit for r in got if r.m > 2) > (0.5 if common > 0.9 else 0.1)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_lm_base_score(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, i, i]), draw.choice([None, "", "The é Ä cat  THE\tdog " * draw.randint(1, 9), f"rare{i} the cat"]), "a")
            for i in range(80)] + [(3, "the the the", "a")] * 3
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[*WORD.findall(lower(t or "")), None] for _, t, _ in rows]
    counts = collections.Counter(x for (i, _, _), t in zip(rows, tokens) if not out(i) for x in t)
    total, kinds = sum(counts.values()), len(counts)
    from stockloom.llm.text import fold

    for plan in (lm_scoring.ModelPlan(), lm_scoring.ModelPlan(hot_parts=4, batch_bytes=100)):
        got = lm_scoring.score_by_fold(frame(spark, rows), fold(F.col("doc_id"), 7) == 2, plan).collect()
        expected = [(i, out(i), len(t), sum(counts[x] > 0 for x in t), total,
                     round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in t), 6)) for (i, _, _), t in zip(rows, tokens)]
        assert sorted(map(str, expected)) == sorted(
            str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got)
        assert all(r.score < 0 for r in got)


def test_lm_without_training_rows(spark):
    docs = frame(spark, [(1, "a b", "a"), (2, None, "a")])
    got = lm_scoring.score_by_fold(docs, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 2
    assert lm_scoring.score_by_fold(docs.limit(0), F.lit(False)).count() == 0


def plain_model(learned, discount=0.75, least=2):
    """Probability of a word after a history, straight from counts of n-grams up to three words."""
    grams = collections.Counter()
    for t in learned:
        line = ["<s>", *t, "</s>"]
        grams.update(tuple(line[k:k + n]) for n in (1, 2, 3) for k in range(len(line) - n + 1))
    del grams[("<s>",)]
    words = {g[0]: c for g, c in grams.items() if len(g) == 1}
    total, kinds = sum(words.values()), len(words)
    follow = collections.defaultdict(dict)
    for g, c in grams.items():
        if len(g) > 1:
            follow[g[:-1]][g[-1]] = c

    def chance(history, w):
        if not history:
            return (words.get(w, 0) + 1) / (total + kinds + 1)
        counts = follow.get(history, {})
        kept = {x: c for x, c in counts.items() if c >= least}
        if not kept:
            return chance(history[1:], w)
        seen = sum(counts.values())
        left = 1 - (sum(kept.values()) - discount * len(kept)) / seen
        return (kept[w] - discount if w in kept else 0) / seen + left * chance(history[1:], w)

    return chance, words


def plain_score(chance, text):
    line = ["<s>", *text, "</s>"]
    return sum(math.log10(chance(tuple(line[max(0, k - 2):k]), line[k])) for k in range(1, len(line)))


def test_plain_model_sums_to_one():
    draw = random.Random(1)
    chance, words = plain_model([[draw.choice("aabbbcd") for _ in range(draw.randint(0, 12))] for _ in range(60)])
    for history in [(), ("a",), ("<s>",), ("<s>", "a"), ("b", "b"), ("d", "d"), ("never",)]:
        assert math.isclose(sum(chance(history, w) for w in [*words, "unseen"]), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("plan", [
    {}, {"hot_parts": 3}, {"hot_parts": 3, "batch_bytes": 200, "fewest_ranges": 3}, {"least": 4, "hot_parts": 2, "batch_bytes": 1},
    {"hot_parts": 1 << 20},
])
def test_lm_scores_are_those_of_the_plain_model(spark, plan):
    """Whatever the batches, ranges and hot contexts; every n-gram from the least count on takes part."""
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice("aaaaaabbbcdefg") for _ in range(draw.randint(0, 30))), "a") for i in range(150)]
    rows += [(1000 + i, t, "a") for i, t in enumerate(["x y z", "x y z a", "", None, "x y q", "new words x y z"])]
    rows += [(2000, "a b c " * 3000, "a")] + [(3000, "hot b c d", "a")] * 30
    plan = lm_scoring.ModelPlan(**plan)
    out = F.col("doc_id").isin(1005, 7)
    got = lm_scoring.score_by_fold(frame(spark, rows), out, plan).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    chance, _ = plain_model([(t or "").split() for i, t, _ in rows if i not in (1005, 7)], least=plan.least)
    texts = {i: (t or "").split() for i, t, _ in rows}
    expected = {i: plain_score(chance, t) for i, t in texts.items()}
    for r in got:
        assert math.isclose(r.score, expected[r.doc_id], rel_tol=1e-9), r


def test_lm_hashes_follow_the_words():
    """Equal words have equal hashes wherever they stand, also over the ends of slabs, and no two words share one here."""
    draw = random.Random(3)
    texts = ["", " ", "a", *["".join(draw.choice("abAé \t\n\x0b\x0c\r\x00\x1c\x85\xa0") for _ in range(draw.randint(0, 300))) for _ in range(200)],
             "long word " * 150_000 + "x" * 3_000_000, "end"]
    line, starts = lm_scoring._line([t.encode() for t in texts])
    seen = {}
    for t, begin, end in zip(texts, starts, starts[1:]):
        words = WORD.findall(lower(t))
        codes = line[begin + 1:end - 1].tolist()
        assert len(codes) == len(words)
        for w, c in zip(words, codes):
            assert seen.setdefault(w, c) == c
    assert len(set(seen.values())) == len(seen)


def test_lm_hot_contexts_are_found(spark):
    """A context above its share is dealt by n-gram; rare ones are not."""
    rows = [(i, f"the w{i} the x{i} y{i}", "a") for i in range(400)]
    source = lm_scoring._batched(frame(spark, rows).selectExpr("true __train", "cast(text AS binary) __text"), 2000)
    found = lm_scoring._hot_contexts(
        source.select("batch", "at", "data"), lm_scoring.ModelPlan(hot_parts=20))
    named = {shingles.word_hash(b" start"), shingles.word_hash(b" end"), int(lm_scoring._line([b"THE"])[0][1])}
    # One more is the start followed by "the".
    assert named < set(found.tolist()) and len(found) == 4


def test_pipeline_decodes_what_it_encodes(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.encode(spark, frame(spark, [(1, "some plain words é", "a"), (2, None, "a")]), "").collect()
    assert len(got) == 2
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_against_its_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from stockloom.llm import quality_rules, secret_scan

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    clean = {r.doc_id: r.cleaned_text for r in quality_rules.clean_documents(docs).where("kept").collect()}
    classes = brute_classes([(i, t, None) for i, t in sorted(clean.items())])
    left = {c for _, c, _, _ in classes}
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {}
    for i in left:
        t, done, out = clean[i], 0, ""
        for _, _, end, start in sorted(secret_scan.scan(t), key=lambda x: x[3]):
            if start >= done:
                out += t[done:start] + "[SECRET]"
            done = max(done, end)
        texts[i] = out + t[done:]
    got = corpus_pipeline.run(spark, d).collect()
    copies = collections.Counter(r.doc_id for r in got)
    assert set(copies) <= left and max(copies.values()) <= 2
    for r in got:
        assert r.ids == plain.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        sizes[source[i]] += len(WORD.findall(t))
        taken[source[i]] += copies[i] * len(WORD.findall(t))
    target = shared_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= max(len(WORD.findall(t)) for t in texts.values()) for s in sizes)


def test_automaton_is_small():
    """A batch of 8 MB has over a million arcs and states; they are held as numbers, not as Python objects."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 2000) % 5000).encode() for _ in range(20)]
    plan = lm_scoring.ModelPlan()
    levels, starts = lm_scoring._levels(texts, [True] * len(texts), plan.order)
    counts = [level.counts.astype(np.int64) + 1 for level in levels]
    sums = [tuple(np.bincount(up.prefix, x, len(level.codes)).astype(np.int64) for x in (c, c, np.ones(len(c))))
            for level, up, c in zip(levels, levels[1:], counts[1:])]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    automaton = lm_scoring.build_automaton(levels, counts, sums, 40000, 5000, plan)
    taken = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert taken < 32 * sum(len(level.codes) for level in levels)
    assert automaton.traverse(automaton.ahead(levels, starts[0], starts[1])) < 0
