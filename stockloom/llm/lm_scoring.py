"""Language-model scoring with a weighted backoff automaton.

Every n-gram that occurs ``least`` times or more is kept, whatever the size of the corpus, with discounted counts that are
interpolated with the next lower order. Texts are dealt into batches of about ``batch_bytes``. A batch sends its distinct
n-grams, packed and sorted, to ranges of the hash of their contexts; a range adds up the counts of all batches and answers
each batch with the counts of just its n-grams and the sums of its contexts. From the answers a batch builds the part of the
automaton that its texts can reach: contexts become states, kept n-grams arcs, and a state without an arc for the next word
passes on to the state of its shorter context by a failure arc that has a weight. One traversal from left to right then scores
each text. The model is never in one place: a range holds its contexts, a batch what its own texts contain.

Contexts that begin one n-gram in ``hot_parts`` are at most that many of each order. Their n-grams are dealt by their own
hash instead of the context's, and the sums of these contexts go through the driver; so does the empty context.
Words and n-grams go by 64-bit hashes, the n-grams of one context by 32 bits, so two of them could be taken for one.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .batches import pieces, slabs
from .text import held, ship, whole

_U = np.uint64
_ROOT = 0  # stands for the empty context among the sums of contexts
_TAIL = 4  # bytes kept of the code of an n-gram within its context


@dataclass(frozen=True)
class ModelPlan:
    order: int = 3
    least: int = 2  # n-grams are kept from this count on
    discount: float = 0.75
    batch_bytes: int = 8 << 20
    range_bytes: int = 8 << 20  # text per range of contexts
    fewest_ranges: int = 32
    hot_parts: int = 1 << 12


@dataclass
class Level:
    """The distinct n-grams of one order in some texts, sorted by code. ``index`` gives the n-gram that begins at a place of
    the line (-1: none); ``prefix`` and ``suffix`` are numbers in the level below."""

    codes: np.ndarray
    counts: np.ndarray  # in training texts
    index: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray


#: Base of the polynomial hash of words, any large odd number, and a number for each byte; A-Z count as a-z.
_BASE = 0x9E3779B97F4A7C15
_BYTES = sh.mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_BYTES[65:91] = _BYTES[97:123]
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, _U), np.ones(1, _U))


def _powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64; those of usual lengths are kept."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, factor, _U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 4 << 20:
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word, from running sums of byte numbers times powers of the base."""
    raw = np.frombuffer(text, np.uint8)
    gap = np.concatenate([[True], _IS_GAP[raw], [True]])
    first = np.flatnonzero(gap[:-1] & ~gap[1:])
    last = np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = _powers_of_base(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTES[raw] * up[:-1], out=sums[1:])
    return first, sh.mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U))


def _line(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in one line, each text between its start and its end, and where texts begin (the end, too)."""
    joined = b"\n".join(texts)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    firsts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, _U)], 0
    for slab in slabs(joined):
        first, codes = _words(slab)
        firsts.append(first + at)
        hashes.append(codes)
        at += len(slab)
    n = np.diff(np.searchsorted(np.concatenate(firsts), begins))
    starts = np.concatenate([[0], np.cumsum(n + 2)])
    # No word has a space in it.
    line = np.full(int(starts[-1]), sh.word_hash(b" end"), _U)
    line[starts[:-1]] = sh.word_hash(b" start")
    codes = np.concatenate(hashes)
    line[np.arange(len(codes)) + 2 * np.repeat(np.arange(len(texts)), n) + 1] = codes
    return line, starts


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct codes, a place of each, and the number of each place's code; places of equal codes are alike here."""
    order = np.argsort(codes)
    ordered = codes[order]
    runs = _runs(ordered)
    new = np.zeros(len(codes), np.int32)
    new[runs[1:]] = 1
    inverse = np.empty(len(codes), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32)
    return ordered[runs], order[runs], inverse


def _levels(texts: list[bytes], training: np.ndarray, most: int) -> tuple[list[Level], np.ndarray]:
    """Levels of orders 1 to ``most`` of the texts, and where each text begins in the line."""
    line, starts = _line(texts)
    taught = np.repeat(np.asarray(training, bool), np.diff(starts))
    ends = np.zeros(len(line), bool)
    ends[starts[1:] - 1] = True
    inside, codes, levels = np.ones(len(line), bool), line, []
    for order in range(1, most + 1):
        if order > 1:
            inside = inside[:-1] & ~ends[order - 2:-1]
            with np.errstate(over="ignore"):
                codes = sh.mix(codes[:-1] * _U(_BASE) + codes[1:] + _U(order))
        places = np.flatnonzero(inside)
        distinct, first, inverse = _distinct(codes[places])
        counts = np.bincount(inverse[taught[places]], minlength=len(distinct)).astype(np.int32)
        index = np.full(len(line) + 1, -1, np.int32)
        index[places] = inverse
        at = places[first]
        if order == 1:
            own = np.arange(len(distinct), dtype=np.int32)
            # The start of a text is no event.
            counts[distinct == _U(sh.word_hash(b" start"))] = 0
            levels.append(Level(distinct, counts, index, own, own))
        else:
            below = levels[-1].index
            levels.append(Level(distinct, counts, index, below[at], below[at + 1]))
    return levels, starts


def _among(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(codes), bool)
    return sorted_codes[np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)] == codes


@dataclass
class Section:
    """Some n-grams of order ``n`` in the order in which they travel; range r gets ``order[bounds[r]:bounds[r + 1]]``.

    ``implied``: the context of each is an n-gram of order 2 in the same range, and they come in the order of these."""

    n: int
    implied: bool
    order: np.ndarray
    bounds: np.ndarray


def _dealt(levels: list[Level], ranges: int, hot: np.ndarray) -> list[Section]:
    """All n-grams by range: words by their own hash, pairs by that of their first word, triples with the pair they begin
    with, longer ones by the hash of their context; what follows a hot context by its own hash."""
    sections: list[Section] = []
    within = np.arange(ranges + 1)
    for n, level in enumerate(levels, 1):
        m = len(level.codes)
        part = lambda by: (sh.mix(by + _U(n)) % _U(ranges)).astype(np.int64)  # noqa: B023, E731
        spread = np.ones(m, bool)
        if n == 1:
            to = part(level.codes)
        else:
            context = levels[n - 2].codes[level.prefix]
            common = _among(hot, context)
            to = part(np.where(common, level.codes, context))
            if n == 3:
                pairs = sections[-1]
                rank = np.empty(len(pairs.order), np.int64)
                rank[pairs.order] = np.arange(len(pairs.order))
                spread = common
                own = np.flatnonzero(~common)
                place = rank[level.prefix[own]]
                by = np.argsort(place, kind="stable")
                sections.append(Section(3, True, own[by], np.searchsorted(place[by], pairs.bounds)))
        # Levels are sorted by code, so equal keys stay in that order.
        some = np.flatnonzero(spread)
        by = np.argsort(to[some] * (m + len(levels[max(n - 2, 0)].codes)) + level.prefix[some], kind="stable")
        sections.append(Section(n, False, some[by], np.searchsorted(to[some[by]], within)))
    return sections


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _pack(x: np.ndarray, kept: int = 8) -> bytes:
    """The low ``kept`` bytes of 64-bit numbers, byte by byte of their places, compressed."""
    planes = np.ascontiguousarray(x.astype(_U).view(np.uint8).reshape(len(x), 8)[:, :kept].T)
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes, n: int, kept: int = 8) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data, decompressed_size=n * kept, asbytes=True) if n else b""
    result = np.zeros((n, 8), np.uint8)
    result[:, :kept] = np.frombuffer(raw, np.uint8).reshape(kept, n).T
    return result.reshape(-1).view(_U)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=_U(0)))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n), dtype=_U)


_BLOCK = ("range int, domain int, section int, level int, batch bigint, first int, last int, n_contexts int, n_grams int, contexts binary, "
          "followers binary, grams binary, counts binary")
_ANSWER = ("batch bigint, first int, last int, range int, section int, n_contexts int, n_grams int, counts binary, seen binary, "
           "kept_count binary, kept binary, context bigint, sum_seen bigint, sum_kept_count bigint, sum_kept bigint, kinds bigint")


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [tuple(f.split()) for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(values, kinds[kind]) for (name, kind), values in zip(fields, columns)})


def _batched(docs: DataFrame, size: int) -> DataFrame:
    """The rows of ``docs`` (with __text as binary) in batches of about ``size`` bytes: batch, at (number of the first row in
    its batch), size (of the texts), data (the rows as a compressed Arrow stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        batch, at, filled = TaskContext.get().partitionId() << 32, 0, 0
        for whole_batch in batches:
            for piece in pieces(whole_batch, "__text", max(1, size // 4)):
                # A slice is copied, or it would be written with all of its batch.
                piece = pa.Table.from_batches([piece]).take(pa.array(np.arange(piece.num_rows))).combine_chunks()
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, piece.schema, options=options) as stream:
                    stream.write_table(piece)
                length = int(pc.sum(pc.binary_length(piece.column("__text"))).as_py() or 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch], pa.int64()), pa.array([at], pa.int32()), pa.array([length], pa.int64()),
                     pa.array([out.getvalue().to_pybytes()], pa.binary())], ["batch", "at", "size", "data"])
                at, filled = at + piece.num_rows, filled + length
                if filled >= size:
                    batch, at, filled = batch + 1, 0, 0

    return docs.mapInArrow(run, "batch bigint, at int, size bigint, data binary")


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes], list[bool]]]:
    """(batch, first row, texts, training flags): runs of rows of one batch; a reader may see a batch in several runs."""
    batch, texts, flags, start = None, [], [], 0
    for rows in batches:
        for b, at, data in zip(*(rows.column(name).to_pylist() for name in ("batch", "at", "data"))):
            if texts and (b != batch or at != start + len(texts)):
                yield batch, start, texts, flags
                texts, flags = [], []
            if not texts:
                batch, start = b, at
            opened = _opened(data)
            texts.extend(opened.column("__text").to_pylist())
            flags.extend(opened.column("__train").to_pylist())
    if texts:
        yield batch, start, texts, flags


def _hot_contexts(rows: DataFrame, plan: ModelPlan) -> np.ndarray:
    """Sorted codes of the contexts that begin one n-gram in ``hot_parts``; at most twice that many of each order.

    Batches name the contexts above a quarter of that share of their own text, so that at least half of the occurrences of
    each context sought are added up.
    """
    parts, most = plan.hot_parts, plan.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts, flags in _gathered(batches):
            levels, starts = _levels(texts, flags, most - 1)
            codes, counts = [np.array([_ROOT], _U)], [np.array([starts[-1]])]
            for level in levels:
                used = np.bincount(level.index[level.index >= 0], minlength=len(level.codes))
                often = used * 4 * parts >= starts[-1]
                codes.append(level.codes[often])
                counts.append(used[often])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(codes).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], ["code", "c"])

    sums = held(rows.mapInArrow(run, "code bigint, c bigint").groupBy("code").agg(F.sum("c").alias("c")), "contexts")
    total = sums.where(F.col("code") == _ROOT).agg(F.sum("c")).first()[0] or 0
    found = sums.where((F.col("code") != _ROOT) & (F.col("c") * 2 * parts >= total)).select("code").toArrow()
    return np.sort(found.column(0).to_numpy().view(_U))


def _blocks(rows: DataFrame, plan: ModelPlan, ranges: int, hot) -> DataFrame:
    """The distinct n-grams of each batch in packed blocks, one for each range and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, texts, flags in _gathered(batches):
            levels, _ = _levels(texts, flags, plan.order)
            sections = _dealt(levels, ranges, hot.value)
            for k, section in enumerate(sections):
                n, level, bounds = section.n, levels[section.n - 1], section.bounds
                # Words are counted on their own, pairs together with the triples they begin.
                domain = 2 if section.implied else n if n < 3 else n + 1
                out = []
                begun = np.bincount(level.prefix[section.order], minlength=len(levels[1].codes)) if section.implied else None
                for r in np.flatnonzero(np.diff(bounds)):
                    of = section.order[bounds[r]:bounds[r + 1]]
                    codes, counts = level.codes[of], _pack(level.counts[of])
                    head = (int(r), domain, k, n, batch, first, first + len(texts) - 1)
                    if n == 1:
                        out.append((*head, 0, len(of), b"", b"", _pack_sorted(codes), counts))
                        continue
                    if section.implied:
                        pairs = sections[k - 1].order[sections[k - 1].bounds[r]:sections[k - 1].bounds[r + 1]]
                        followers, contexts = begun[pairs], b""
                    else:
                        runs = _runs(level.prefix[of])
                        followers = np.diff(runs, append=len(of))
                        contexts = _pack_sorted(levels[n - 2].codes[level.prefix[of[runs]]])
                    out.append((*head, len(followers), len(of), contexts, _pack(followers), _pack(codes, _TAIL), counts))
                yield from _table(_BLOCK, out).to_batches()

    return rows.mapInArrow(run, _BLOCK)


def _answers(blocks: DataFrame, plan: ModelPlan, hot) -> DataFrame:
    """Counts over all batches for the n-grams of each block, sums of its contexts, and the parts of sums of hot contexts."""
    least = plan.least

    def run(group: pa.Table) -> pa.Table:
        by_section: dict[int, list[dict]] = {}
        for row in group.to_pylist():
            by_section.setdefault(row["section"], []).append(row)
        out, numbers = [], {}
        for section, rows in sorted(by_section.items()):
            ends = np.cumsum([r["n_grams"] for r in rows])
            counts = np.concatenate([_unpack(r["counts"], r["n_grams"]) for r in rows]).astype(np.int64)
            words, implied = rows[0]["level"] == 1, rows[0]["level"] > 1 and not rows[0]["contexts"]
            own = []  # the contexts of each block; those of triples go by the number of the pair among all of the range
            if words:
                keys = np.concatenate([_unpack_sorted(r["grams"], r["n_grams"]) for r in rows])
            else:
                followers = [_unpack(r["followers"], r["n_contexts"]).astype(np.int64) for r in rows]
                own = [numbers[r["batch"], r["first"]] if implied else _unpack_sorted(r["contexts"], r["n_contexts"]) for r in rows]
                contexts = np.concatenate([np.repeat(x, n) for x, n in zip(own, followers)])
                tails = np.concatenate([_unpack(r["grams"], r["n_grams"], _TAIL) for r in rows])
                with np.errstate(over="ignore"):
                    keys = sh.mix(contexts * _U(_BASE) + tails)
                del tails
            _, at, inverse = _distinct(keys)
            del keys
            # Sums of floats are exact up to 2^53.
            c = np.bincount(inverse, counts, len(at)).astype(np.int64)
            del counts
            if words:
                out.append((*[None] * 11, _ROOT, int(c.sum()), 0, 0, int((c > 0).sum())))
            else:
                distinct, _, of = _distinct(contexts[at])
                keep = c >= least
                seen = np.bincount(of, c, len(distinct)).astype(np.int64)
                kept_count = np.bincount(of[keep], c[keep], len(distinct)).astype(np.int64)
                kept = np.bincount(of[keep], minlength=len(distinct))
                del of, keep, contexts
                for k in np.flatnonzero(_among(hot.value, distinct)) if not implied else ():
                    out.append((*[None] * 11, int(distinct[k:k + 1].view(np.int64)[0]), int(seen[k]), int(kept_count[k]), int(kept[k]), 0))
            for k, (row, end) in enumerate(zip(rows, ends)):
                mine = inverse[end - row["n_grams"]:end]
                head = tuple(row[name] for name in ("batch", "first", "last", "range", "section", "n_contexts", "n_grams"))
                sums = (b"", b"", b"")
                if not words:
                    place = np.minimum(np.searchsorted(distinct, own[k]), len(distinct) - 1)
                    there = (followers[k] > 0) & (kept[place] > 0)
                    sums = tuple(_pack(np.where(there, x[place], 0)) for x in (seen, kept_count, kept))
                if section == 1:
                    numbers[row["batch"], row["first"]] = mine.astype(_U)
                out.append((*head, _pack(c[mine]), *sums, *[None] * 5))
        return _table(_ANSWER, out)

    return blocks.groupBy("range", "domain").applyInArrow(run, _ANSWER)


@dataclass
class Automaton:
    """State 0 is the empty context and has an arc for every word of the texts it was built for. A state of ``depth`` m
    stands for the last m words, so its arc for the next word is that of the n-gram of order m + 1 ending there: ``arcs``
    gives for each order the arc of each n-gram (-1: none). An arc has a log10 probability ``gain`` and a next state
    ``goes``; a state without an arc passes on to ``fail`` at the cost ``weight``."""

    arcs: list[np.ndarray]
    gain: array
    goes: array
    weight: array
    fail: array
    depth: array
    start: int

    def ahead(self, levels: list[Level], begin: int, end: int) -> Iterator[tuple[int, ...]]:
        """For each place of a text but its start: the arcs that states of depth 0, 1, ... have there."""
        found = []
        for m, arcs in enumerate(self.arcs):
            index = levels[m].index[max(begin + 1 - m, begin):max(end - m, begin)]
            some = np.where(index >= 0, arcs[index], -1) if len(arcs) else np.full(len(index), -1)
            found.append([-1] * (end - begin - 1 - len(index)) + some.tolist())
        return zip(*found)

    def traverse(self, ahead: Iterator[tuple[int, ...]]) -> float:
        """log10 probability of the words of one text, its end included."""
        gain, goes, weight, fail, depth = self.gain, self.goes, self.weight, self.fail, self.depth
        state, total = self.start, 0.0
        for arcs in ahead:
            arc = arcs[depth[state]]
            while arc < 0:
                total += weight[state]
                state = fail[state]
                arc = arcs[depth[state]]
            total += gain[arc]
            state = goes[arc]
        return total


def build_automaton(
    levels: list[Level], counts: list[np.ndarray], sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]], total: int,
    distinct: int, plan: ModelPlan,
) -> Automaton:
    """The states and arcs that texts with these n-grams can reach.

    ``counts`` holds the corpus counts of the n-grams of each order, ``sums`` for each order but the last what they begin:
    occurrences, occurrences of kept n-grams, and how many those are (0, 0, 0 where none is kept). A kept n-gram has
    probability (c - discount) / occurrences of its context plus the context's weight times that of the lower order; the
    weight is what the discounts leave.
    """
    p = (counts[0] + 1) / (total + distinct + 1)
    words = len(p)
    weights, fails, depths = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    arcs, gains, goes = [], [], []
    states, known = 1, 0
    reached = first = None  # of the order below: the state after an n-gram
    for n, level in enumerate(levels, 1):
        kept = np.ones(words, bool)
        if n > 1:
            kept = counts[n - 1] >= plan.least
            own = np.where(kept, counts[n - 1] - plan.discount, 0.0) / np.maximum(sums[n - 2][0], 1)[level.prefix]
            p = own + gamma[level.prefix] * p[level.suffix]  # noqa: F821
        shorter = np.zeros(words, np.int64) if n == 1 else reached[level.suffix]
        after = shorter
        if n < len(levels):
            seen, kept_count, kinds = sums[n - 1]
            is_state = kinds > 0
            gamma = np.where(is_state, 1 - (kept_count - plan.discount * kinds) / np.maximum(seen, 1), 1.0)
            here = np.where(is_state, states + np.cumsum(is_state) - 1, -1)
            states += int(is_state.sum())
            weights.append(np.log10(gamma[is_state]))
            fails.append(shorter[is_state])
            depths.append(np.full(int(is_state.sum()), n))
            after = np.where(is_state, here, shorter)
            first = here if n == 1 else first
        arcs.append(np.where(kept, known + np.cumsum(kept) - 1, -1).astype(np.int32))
        known += int(kept.sum())
        gains.append(np.log10(p[kept]))
        goes.append(after[kept])
        reached = after
    begin = np.flatnonzero(levels[0].codes == _U(sh.word_hash(b" start")))
    start = int(max(first[begin[0]], 0)) if len(begin) and first is not None else 0
    return Automaton(
        arcs, _packed("d", gains), _packed("i", goes), _packed("d", weights), _packed("i", fails), _packed("b", depths), start)


def _packed(kind: str, parts: list[np.ndarray]) -> array:
    """The numbers in one typed array: a list of as many Python numbers takes four to eight times the memory. ``parts`` is emptied."""
    result = array(kind)
    while parts:
        result.frombytes(parts.pop(0).astype(np.dtype(kind)).tobytes())
    return result


def _read_answers(levels: list[Level], answers: list[dict], ranges: int, hot: np.ndarray, hot_sums: np.ndarray):
    """Corpus counts of the n-grams of ``levels`` and sums of their contexts, as build_automaton takes them."""
    counts = [np.zeros(len(level.codes), np.int64) for level in levels]
    sums = [tuple(np.zeros(len(level.codes), np.int64) for _ in range(3)) for level in levels[:-1]]
    sections = _dealt(levels, ranges, hot)
    for row in answers:
        section, r = sections[row["section"]], row["range"]
        of = section.order[section.bounds[r]:section.bounds[r + 1]]
        counts[section.n - 1][of] = _unpack(row["counts"], row["n_grams"])
        if section.n > 1:
            if section.implied:
                pairs = sections[row["section"] - 1]
                context = pairs.order[pairs.bounds[r]:pairs.bounds[r + 1]]
            else:
                context = levels[section.n - 1].prefix[of]
                context = context[_runs(context)]
            for target, name in zip(sums[section.n - 2], ("seen", "kept_count", "kept")):
                target[context] = _unpack(row[name], row["n_contexts"])
    for n, level in enumerate(levels[:-1]):
        common = np.flatnonzero(_among(hot, level.codes))
        for k, target in enumerate(sums[n]):
            target[common] = hot_sums[np.searchsorted(hot, level.codes[common]), k]
    return counts, sums


def score_corpus(docs: DataFrame, training: Column, carry: list[str], plan: ModelPlan = ModelPlan()) -> DataFrame:
    """Learn from the rows of ``docs`` where ``training`` is true and score every whole text: the columns ``carry``,
    n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty and consist of the end token. Repeated rows count and are scored once each. A very long text is a
    batch of its own; its tokens are held as numbers, about 100 bytes each, while it is worked on. Without training rows
    every token has probability 1. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    # Written once, so that batches and places of rows do not change when a lost task runs again.
    asked = docs.select(
        *carry, F.coalesce(training, F.lit(False)).alias("__train"), whole(F.col("text")).cast("binary").alias("__text"))
    source = held(_batched(asked, plan.batch_bytes), "batches")
    rows = source.select("batch", "at", "data")
    size = source.agg(F.sum("size")).first()[0] or 0
    ranges = max(plan.fewest_ranges, -(-size // plan.range_bytes))
    # At most 2 x hot_parts x (order - 1) codes.
    hot = _hot_contexts(rows, plan)
    shared = spark.sparkContext.broadcast(hot)
    answers = held(_answers(_blocks(rows, plan, ranges, shared), plan, shared), "answers")
    found = answers.where("context IS NOT NULL").groupBy("context").agg(
        *[F.sum(c).alias(c) for c in ("sum_seen", "sum_kept_count", "sum_kept", "kinds")]).collect()
    root = [r for r in found if r.context == _ROOT]
    total, distinct = (root[0].sum_seen, root[0].kinds) if root else (0, 0)
    hot_sums = np.zeros((len(hot), 3), np.int64)
    for r in found:
        if r.context != _ROOT:
            hot_sums[np.searchsorted(hot, np.array([r.context]).view(_U))[0]] = r.sum_seen, r.sum_kept_count, r.sum_kept
    known = spark.sparkContext.broadcast((hot, hot_sums))

    def run(texts: pa.Table, sent: pa.Table) -> pa.Table:
        texts = texts.sort_by("at")
        texts = pa.concat_tables([_opened(data) for data in texts.column("data").to_pylist()])
        parts: dict[tuple[int, int], list[dict]] = {}
        for row in sent.to_pylist():
            parts.setdefault((row["first"], row["last"]), []).append(row)
        lengths, hits, bases, scores = [], [], [], []
        del sent
        for first, last in sorted(parts):
            some = texts.slice(first, last - first + 1)
            levels, starts = _levels(some.column("__text").to_pylist(), some.column("__train").to_pylist(), plan.order)
            counts, sums = _read_answers(levels, parts.pop((first, last)), ranges, *known.value)
            automaton = build_automaton(levels, counts, sums, total, distinct, plan)
            del sums
            base = np.log10((counts[0] + 1) / (total + distinct + 1))
            for begin, end in zip(starts, starts[1:]):
                words = levels[0].index[begin + 1:end]
                lengths.append(len(words))
                hits.append(int((counts[0][words] > 0).sum()))
                bases.append(math.fsum(base[words]))
                scores.append(automaton.traverse(automaton.ahead(levels, begin, end)))
        return pa.table([
            *(texts.column(c) for c in carry), pa.array(lengths, pa.int64()), pa.array(hits, pa.int64()),
            pa.array(bases, pa.float64()), pa.array(scores, pa.float64())], [*carry, "n_tokens", "n_known", "base_score", "score"])

    fields = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in carry)
    sent_back = answers.where("batch IS NOT NULL").drop("context", "sum_seen", "sum_kept_count", "sum_kept", "kinds")
    scored = rows.groupBy("batch").cogroup(sent_back.groupBy("batch")).applyInArrow(
        run, f"{fields}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        *carry, "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def score_by_fold(docs: DataFrame, held_out: Column, plan: ModelPlan = ModelPlan()) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text) where ``held_out`` is false and score all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; further columns are ignored. See
    score_corpus for nulls, repeats, long texts and empty tables.
    """
    marked = docs.select("doc_id", held_out.alias("held_out"), F.col("text"))
    scored = score_corpus(marked, ~F.col("held_out"), ["doc_id", "held_out"], plan)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
