"""Phrase collocations by prefix-free parsing.

Texts are parsed into overlapping chunks that begin and end at trigger windows, which follow from the words alone. So a
passage that many documents share falls into the same chunks wherever it stands: the distinct chunks are the dictionary,
and how often each occurs is its parse frequency. Phrases are counted inside distinct chunks only, weighted by the parse
frequency. Neighbouring chunks overlap by one word less than the longest phrase, and a chunk owns the phrases that begin
before its overlap, so every occurrence is counted exactly once.

Counts travel between tasks as sorted, compressed blocks of phrases, dealt by a hash of the phrase: no word, phrase, chunk
or language can fill one task. Phrases go by their text, not by a hash, so counts are exact.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import pieces, slabs
from .shingles import mix
from .text import held, ship

#: Any of the characters that part pieces; no word holds a full stop, so it stands for all of them in a parsed text.
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_STOP = b"."
_STOPS = bytes.maketrans(_SEPARATORS, _STOP * len(_SEPARATORS))
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_U = np.uint64


@dataclass(frozen=True)
class PhrasePlan:
    longest: int = 3  # words of a phrase
    least: int = 10  # occurrences of a candidate
    covered: int = 50  # percent of a candidate's occurrences that lie inside a longer one that replaces it
    top: int = 2000  # rows of the report, per language
    period: int = 16  # a window is a trigger once in so many
    stretch: int = 4096  # a chunk without a trigger is cut after so many tokens
    chunk_bytes: int = 8 << 20  # of chunks held in a task
    tokens: int = 1_000_000  # of chunks counted at a time in a task
    block_bytes: int = 8 << 20  # of text per block of phrases
    hot_parts: int = 4096  # words and phrases this common are looked up without a shuffle
    salts: int = 64


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case and stops; ``bytes.split`` parts at the two characters left that part words."""
    return text.lower().translate(_STOPS).replace(_STOP, b" . ").split()


def parse(text: bytes, plan: PhrasePlan) -> Iterator[tuple[int, bytes]]:
    """(tokens owned, chunk) of a text in order. A chunk has its own tokens and then the overlap with the next one."""
    overlap = plan.longest - 1
    line: list[bytes] = []
    for slab in slabs(text, _GAP):
        line += tokens(slab)
        n = len(line) - overlap + 1
        if n <= 1:
            continue
        codes = np.fromiter(map(zlib.crc32, line), _U, len(line))
        window = np.zeros(n, _U)
        with np.errstate(over="ignore"):
            for k in range(overlap):
                window = mix(window * _U(0x9E3779B97F4A7C15) + codes[k:k + n])
        cuts = np.flatnonzero(window % _U(plan.period) == 0).tolist()
        start = 0
        for cut in [*cuts, n - 1]:
            while cut - start > plan.stretch:
                yield plan.stretch, b" ".join(line[start:start + plan.stretch + overlap])
                start += plan.stretch
            if start < cut < n - 1 or (cut in cuts[-1:] and cut > start):
                yield cut - start, b" ".join(line[start:cut + overlap])
                start = cut
        line = line[start:]
    if line:
        yield len(line), b" ".join(line)


def _chunks(docs: DataFrame, plan: PhrasePlan) -> DataFrame:
    """The dictionary: distinct chunks (lang, owned, chunk) with their parse frequency n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[str, int, bytes], int] = defaultdict(int)
        size = 0

        def out() -> pa.RecordBatch:
            keys = list(waiting)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.binary()), pa.array(list(waiting.values()), pa.int64())],
                ["lang", "owned", "chunk", "n"])

        for batch in batches:
            for piece in pieces(batch):
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1)):
                    for owned, chunk in parse(text.as_py(), plan):
                        waiting[lang, owned, chunk] += 1
                        size += len(chunk)
                        if size > plan.chunk_bytes:
                            yield out()
                            waiting.clear()
                            size = 0
        if waiting:
            yield out()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    found = docs.select(lang, text).mapInArrow(run, "lang string, owned int, chunk binary, n bigint")
    return found.groupBy("lang", "owned", "chunk").agg(F.sum("n").alias("n"))


def tally(chunks: list[tuple[list[bytes], int, int]], longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(phrases, hashes, counts) of the phrases that begin among the owned tokens of chunks (tokens, owned, times).

    No phrase goes over a stop. The empty phrase counts words. Words get numbers in their order, and a phrase is the number of
    the phrase without its last word next to the number of that word, so sorting numbers sorts phrases.
    """
    line = [t for tokens_, _, _ in chunks for t in tokens_]
    lengths = np.array([len(tokens_) for tokens_, _, _ in chunks])
    listed = sorted(set(line))
    number = dict(zip(listed, range(len(listed))))
    ids = np.fromiter(map(number.__getitem__, line), np.int64, len(line))
    chunk = np.repeat(np.arange(len(chunks)), lengths)
    within = np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    times = np.array([n for _, _, n in chunks], np.int64)[chunk]
    plain = ids != number.get(_STOP, -1)
    at = np.flatnonzero(plain & (within < np.array([owned for _, owned, _ in chunks])[chunk]))
    rank, hashed = ids.copy(), np.fromiter(map(zlib.crc32, listed), _U, len(listed))
    words = pa.array(listed, pa.binary())
    phrases, hashes, counts = [pa.array([b""])], [np.zeros(1, _U)], [np.array([times[at].sum()])]
    for size in range(1, longest + 1):
        key = ids[at]
        if size > 1:
            last = at + size - 1
            fits = last < len(line)
            at, last = at[fits], last[fits]
            fits = (chunk[last] == chunk[at]) & plain[last]
            at, last = at[fits], last[fits]
            key = rank[at] << 32 | ids[last]
        if not len(at):
            break
        order = np.argsort(key, kind="stable")
        new = np.append(True, np.diff(key[order]) > 0)
        rank[at[order]] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        counts.append(np.add.reduceat(times[at[order]], first))
        begin, code = at[order[first]], np.zeros(len(first), _U)
        with np.errstate(over="ignore"):
            for k in range(size):
                code = mix(code * _U(0x9E3779B97F4A7C15) + hashed[ids[begin + k]])
        hashes.append(code)
        parts = [words.take(pa.array(ids[begin + k])) for k in range(size)]
        phrases.append(pc.binary_join_element_wise(*parts, pa.scalar(b" ")) if size > 1 else parts[0])
    return pa.concat_arrays(phrases), np.concatenate(hashes), np.concatenate(counts)


def _counted(chunks: DataFrame, plan: PhrasePlan, blocks: int) -> DataFrame:
    """Phrase counts of tasks as blocks: (block, lang, phrases, counts), phrases in order and parted by line feeds."""
    longest, most = plan.longest, plan.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        waiting: dict[str, list[tuple[list[bytes], int, int]]] = defaultdict(list)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, some in waiting.items():
                phrases, hashes, counts = tally(some, longest)
                block = (hashes % _U(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                ended = pc.binary_join_element_wise(phrases.take(pa.array(order)), pa.scalar(b""), pa.scalar(b"\n"))
                ends = np.frombuffer(ended.buffers()[1], np.int32)[ended.offset:ended.offset + len(ended) + 1]
                text = memoryview(ended.buffers()[2])
                edges = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
                for a, b in zip(edges, edges[1:]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block[order[a]]], pa.int64()), pa.array([lang]),
                         pa.array([pack(text[ends[a]:ends[b] - 1])], pa.binary()),
                         pa.array([pack(counts[order[a:b]].tobytes())], pa.binary())], ["block", "lang", "phrases", "counts"])

        for batch in batches:
            for lang, owned, chunk, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held_tokens = chunk.split(b" ")
                waiting[lang].append((held_tokens, owned, n))
                size += len(held_tokens)
                if size > most:
                    yield from out()
                    waiting.clear()
                    size = 0
        yield from out()

    return chunks.mapInArrow(run, "block bigint, lang string, phrases binary, counts binary")


def _merged(blocks: DataFrame, least: int) -> DataFrame:
    """Sums of the blocks of each hash range, phrases below ``least`` left out: lang, phrase, words, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held_key, counts = None, defaultdict(int)

        def out() -> pa.RecordBatch:
            kept = [(p, c) for p, c in counts.items() if c >= least or not p]
            return pa.RecordBatch.from_arrays(
                [pa.array([held_key[1]] * len(kept), pa.string()), pa.array([p.decode() for p, _ in kept], pa.string()),
                 pa.array([p.count(b" ") + 1 if p else 0 for p, _ in kept], pa.int32()),
                 pa.array([c for _, c in kept], pa.int64())], ["lang", "phrase", "words", "f"])

        for batch in batches:
            for block, lang, phrases, values in zip(*(batch.column(k) for k in range(4))):
                key = (block.as_py(), lang.as_py())
                if key != held_key and counts:
                    yield out()
                    counts.clear()
                held_key = key
                numbers = np.frombuffer(unpack(values.as_py()), np.int64).tolist()
                for phrase, c in zip(unpack(phrases.as_py()).split(b"\n"), numbers):
                    counts[phrase] += c
        if counts:
            yield out()

    ordered = blocks.sortWithinPartitions("block", "lang")
    return ordered.mapInArrow(run, "lang string, phrase string, words int, f bigint")


def phrase_counts(docs: DataFrame, plan: PhrasePlan = PhrasePlan()) -> DataFrame:
    """lang, phrase, words, f of every phrase of up to ``longest`` words that occurs ``least`` times in its language.

    The empty phrase (0 words) of a language counts all its words.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = 1 + size // plan.block_bytes
    parts = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = _counted(_chunks(docs, plan), plan, blocks)
    dealt = counted.repartitionById(parts, (F.col("block") % parts).cast("int"))
    return held(_merged(dealt, plan.least), "phrases")


def _looked_up(asked: DataFrame, counts: DataFrame, hot: Column) -> DataFrame:
    """``asked`` (lang, part, ...) with the count ``f`` of each part.

    Parts that make up one in ``hot_parts`` of all words are at most that many of each length, so they are broadcast; a
    colder one is asked for by few phrases. Rows that are answered already get a key of their own in the join.
    """
    known = counts.select("lang", F.col("phrase").alias("part"), "f")
    common = F.broadcast(known.where(hot).withColumnRenamed("f", "_hot"))
    first = asked.join(common, ["lang", "part"], "left")
    # No phrase holds a line feed.
    own = F.concat(F.lit("\n"), F.xxhash64("phrase", "cut", "side").cast("string"))
    keyed = first.withColumn("part", F.when(F.col("_hot").isNull(), F.col("part")).otherwise(own))
    return keyed.join(known.where(~hot), ["lang", "part"], "left").withColumn("f", F.coalesce("_hot", "f")).drop("_hot")


def cut_score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits: exact for counts up to 10^16."""
    wide = lambda x: x.cast("decimal(19,0)")
    above, below = wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r)
    return F.call_function("div", above, below)


def mine_phrases(docs: DataFrame, plan: PhrasePlan = PhrasePlan()) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang; a null language reads as ``und``, a null or blank text has no words. A candidate has 2 to
    ``longest`` words and occurs ``least`` times or more. Repeated rows count as often as they stand, ties go by
    occurrences and then by the bytes of the phrase, further columns are ignored, and an empty table gives no rows. A very
    long text is parsed by the megabyte.
    """
    counts = phrase_counts(docs, plan)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    everything = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = counts.where("words > 0")
    candidates = parts.where("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))

    longest = plan.longest
    piece = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    words = F.size("w")
    cuts = [
        F.when(words > cut, F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), text.alias("part")))
        for cut in range(1, longest)
        for side, text in (("l", piece(1, cut)), ("r", piece(cut + 1, words - cut)))]
    asked = candidates.select("lang", "phrase", "a", F.explode(F.array_compact(F.array(*cuts))).alias("c"))
    hot = F.col("f") * F.lit(plan.hot_parts) >= F.lit(everything)
    answers = _looked_up(asked.select("lang", "phrase", "a", "c.*"), parts, hot)
    # The phrases inside each longer candidate.
    inner = [F.when(words > size, F.when(words >= start + size - 1, piece(start, size)))
             for size in range(2, longest) for start in range(1, longest - size + 2)]
    inside = candidates.where(words > 2).select(
        "lang", F.explode(F.array_compact(F.array(*inner, F.lit(None).cast("string")))).alias("phrase"), F.col("a").alias("longer"))
    side = lambda cut, name: F.max(F.when((F.col("cut") == cut) & (F.col("side") == name), F.col("f")))
    gathered = answers.unionByName(inside, allowMissingColumns=True).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.max("longer").alias("longer"),
        *[side(cut, name).alias(f"{name}{cut}") for cut in range(1, longest) for name in "lr"])
    kept = gathered.where(F.col("longer").isNull() | (100 * F.col("longer") < plan.covered * F.col("a")))
    ways = [
        F.when(F.col(f"r{cut}").isNotNull(), F.struct(
            cut_score(F.col("a"), F.col(f"l{cut}"), F.col(f"r{cut}")).alias("score"), F.lit(cut).alias("cut"),
            F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
        for cut in range(1, longest)]
    scored = kept.withColumn("best", F.array_min(F.array_compact(F.array(*ways)))).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score")
    best_first = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # Each language is cut to its best within salts first, so that none meets in one task as a whole.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(plan.salts))
    some = scored.withColumn("_salt", salt).withColumn(
        "_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best_first))).where(F.col("_place") <= plan.top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)).cast("bigint"))
    return ranked.where(F.col("rank") <= plan.top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
