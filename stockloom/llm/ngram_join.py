"""N-gram Jaccard self-join by chosen paths.

Every distinct shingle set draws a few of its shingles by a shared hash. Sets that drew the same shingle meet in a bucket.
Sets of a bucket that is too large are split again by paths through several MinHash coordinates of the full sets at once (each
stands for a sampled shared shingle, so sets must share several of them to stay together), and a second time by longer
paths. Each level repeats its draws in as many independent runs as a pair at the threshold needs to be found with the
target recall. Small buckets are compared in full, and pairs are verified on the exact sets. Buckets that are still large
after the last split hold sets much alike. Those that hang together form a crowd, whose members are compared all with all
on the exact sets, block by block inside tasks; what leaves a task are each member's number of links and its connection,
never the pairs.

Only distinct sets take part: copies are counted, not paired, so a group of copies of any size is one set. Rows of
buckets with one member are dropped before anything is joined to them, and a pair is reported by the smallest path that
its sets share, not by every bucket in which they meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .batches import pieces
from .components import component_labels
from .text import held, ship, whole


@dataclass(frozen=True)
class JoinPlan:
    """Parameters of the join."""

    threshold: float = 0.8
    recall: float = 0.999
    per_run: float = 2.0  # shingles that a set draws in one run, on average
    widths: tuple[int, ...] = (4, 8)  # coordinates of a path in the first and second split of large buckets
    bucket: int = 32  # buckets up to this size are compared in full
    block: int = 256  # crowds are compared in blocks of this size
    seed: int = 20240501

    @property
    def runs(self) -> int:
        """Runs for the target recall. Sets x, y with Jaccard t share at least t * max(|x|, |y|) shingles, so no common one is
        drawn in a run with probability exp(-per_run * t) at most."""
        return max(1, math.ceil(-math.log(1 - self.recall) / (self.per_run * self.threshold)))

    def paths(self, width: int) -> int:
        """Paths through ``width`` coordinates for the target recall; sets with Jaccard t share each with probability
        t**width, independently, since every coordinate has a salt of its own."""
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**width)))

    def salts(self) -> list[int]:
        draw = np.random.default_rng(self.seed)
        return [int(x) for x in draw.integers(1, 2**63 - 1, self.runs)]


def _signatures(docs: DataFrame, plan: JoinPlan) -> DataFrame:
    """One written row per document: row, doc_id, text_key, key, n, sketch, drawn (salted shingles of all runs)."""
    ship(docs.sparkSession)
    salts, per_run = plan.salts(), plan.per_run
    text = whole(F.col("text")).cast("binary")
    source = docs.select("doc_id", F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                keys, sizes, sketches, lists = [], [], [], []
                for text in piece.column(2).to_pylist():
                    found = sh.shingle_set(text)
                    keys.append(sh.set_key(found))
                    sizes.append(len(found))
                    sketches.append(sh.sketch(found))
                    lists.append(np.concatenate(sh.chosen(found, per_run, salts)))
                inner = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64))
                drawn = pa.ListArray.from_arrays(pa.array(inner), values)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()),
                     pa.array(sketches, pa.binary()), drawn], ["doc_id", "text_key", "key", "n", "sketch", "drawn"])

    signed = source.mapInArrow(
        run, f"doc_id {kind}, text_key binary, key binary, n int, sketch binary, drawn array<bigint>")
    return held(signed.select(F.monotonically_increasing_id().alias("row"), "*"), "signatures")


def _buckets(rows: DataFrame) -> DataFrame:
    """Rows (path, id) with the size of their bucket, without buckets of one member; written."""
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return held(rows.join(counts, "path"), "buckets")


def _coordinate_paths(width: int, keys: int, seed: int):
    @F.arrow_udf("array<bigint>")
    def paths(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lists:
            offsets, every = batch.offsets.to_numpy(), batch.values.to_numpy().view(np.uint64)
            found = [sh.coordinate_paths(every[s:e], width, keys, seed) for s, e in zip(offsets[:-1], offsets[1:])]
            ends = pa.array(np.arange(0, keys * len(found) + 1, keys, dtype=np.int32))
            yield pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))

    return paths


def _candidates(docs: DataFrame, sets: DataFrame, plan: JoinPlan) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of ids whose sketches leave the threshold possible, and the crowds (id, crowd), whose
    members are not paired here."""
    found = _buckets(sets.select("id", F.explode("drawn").alias("path")))
    large = F.col("members") > plan.bucket
    small = found.where(~large)
    full = None
    for width in plan.widths:
        crowded = found.where(large).select("id").distinct()
        if crowded.isEmpty():
            break
        paths = _coordinate_paths(width, plan.paths(width), plan.seed)
        full = _shingles(docs, sets, crowded, "crowded") if full is None else full
        again = full.join(crowded, "id", "left_semi")
        found = _buckets(again.select("id", F.explode(paths("shingles")).alias("path")))
        small = small.unionByName(found.where(~large))
    crowds = _crowds(found.where(large))

    met = small.groupBy("id").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    known = held(sets.select("id", "n", "sketch").join(met, "id").join(crowds, "id", "left"), "met")
    grouped = small.select("path", "id").join(known, "id").groupBy("path").agg(
        F.collect_list(F.struct("id", "n", "crowd", "sketch", "paths")).alias("members"))
    near = _near_pairs(plan.threshold)
    pairs = grouped.select(F.explode(near(F.col("path"), F.col("members"))).alias("p")).select("p.a", "p.b").distinct()
    return held(pairs, "pairs"), crowds


def _crowds(buckets: DataFrame) -> DataFrame:
    """(id, crowd) of the members of large buckets (path, id); buckets with a common member are one crowd."""
    heads = buckets.groupBy("path").agg(F.min("id").alias("b"))
    links = buckets.join(heads, "path").select(F.col("id").alias("a"), "b").distinct()
    return component_labels(links).withColumnRenamed("label", "crowd")


def _near_pairs(threshold: float):
    """Pairs within each small bucket whose sizes and sketches allow the threshold and whose smallest common path is the
    bucket's. Pairs within a crowd are left to it."""
    result = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def near(groups: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for path, lists in groups:
            offsets, flat = lists.offsets.to_numpy(), lists.values
            ids, n = flat.field("id").to_numpy(), flat.field("n").to_numpy()
            crowd = pc.fill_null(flat.field("crowd"), -1).to_numpy(zero_copy_only=False)
            marks = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, sh.BINS // 2)
            own = flat.field("paths")
            starts, every = own.offsets.to_numpy(), own.values.to_numpy()
            here = path.to_numpy()
            lefts, rights, counts = [], [], [0]
            for g in range(len(lists)):
                s, e = offsets[g], offsets[g + 1]
                i, j = np.triu_indices(e - s, 1)
                i, j = i + s, j + s
                good = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
                good &= (crowd[i] != crowd[j]) | (crowd[i] < 0)
                i, j = i[good], j[good]
                good = sh.sketches_allow(marks[i], marks[j], threshold)
                i, j = i[good], j[good]
                if len(i):
                    earlier = {}
                    for x in set(i.tolist()) | set(j.tolist()):
                        mined = every[starts[x]:starts[x + 1]]
                        earlier[x] = set(mined[:np.searchsorted(mined, here[g])].tolist())
                    good = np.array([earlier[x].isdisjoint(earlier[y]) for x, y in zip(i.tolist(), j.tolist())])
                    i, j = i[good], j[good]
                lefts.append(np.minimum(ids[i], ids[j]))
                rights.append(np.maximum(ids[i], ids[j]))
                counts.append(counts[-1] + len(i))
            none = np.empty(0, np.int64)
            pairs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(lefts or [none])), pa.array(np.concatenate(rights or [none]))], ["a", "b"])
            yield pa.ListArray.from_arrays(pa.array(np.array(counts, np.int32)), pairs).cast(result)

    return near


def _crowd_links(crowds: DataFrame, sets: DataFrame, exact: DataFrame, plan: JoinPlan) -> DataFrame:
    """(id, others, root) for members of crowds: linked documents counted with copies, and a set the links lead to."""
    sizes = crowds.groupBy("crowd").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / plan.block).cast("int")
    placed = crowds.join(sizes, "crowd").withColumn("blocks", blocks).withColumn(
        "mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "crowd", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    grouped = dealt.join(sets.select("id", "copies"), "id").join(exact, "id").groupBy("crowd", "low", "high").agg(
        F.collect_list(F.struct("id", "mine", "copies", "shingles")).alias("members"))
    threshold = plan.threshold

    @F.arrow_udf("array<struct<id:bigint,others:bigint,root:bigint>>")
    def linked(groups: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, cross in groups:
            offsets, flat = lists.offsets.to_numpy(), lists.values
            ids, mine, copies = (flat.field(name).to_numpy() for name in ("id", "mine", "copies"))
            own = flat.field("shingles")
            starts, every = own.offsets.to_numpy(), own.values.to_numpy()
            out = []
            for g in range(len(lists)):
                s, e = offsets[g], offsets[g + 1]
                near = sh.all_similar(every[starts[s]:starts[e]], np.diff(starts[s:e + 1]), threshold)
                if cross[g].as_py():
                    near &= mine[s:e, None] != mine[None, s:e]
                root = sh.spread(near, ids[s:e])
                others = near @ copies[s:e]
                out.append([{"id": i, "others": o, "root": r} for i, o, r in zip(ids[s:e].tolist(), others.tolist(), root.tolist()) if o])
            yield pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("others", pa.int64()), ("root", pa.int64())])))

    return held(
        grouped.select(F.explode(linked(F.col("members"), F.col("low") != F.col("high"))).alias("l")).select("l.*"), "crowd-links")


def _exact_sets(docs: DataFrame, sets: DataFrame, pairs: DataFrame, crowds: DataFrame) -> DataFrame:
    """(id, shingles) of all sets that are to be compared exactly, read from the texts again. Written."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowds.select("id")).distinct()
    return _shingles(docs, sets, ids, "shingles")


def _shingles(docs: DataFrame, sets: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """(id, shingles) of the sets ``ids``, read from the texts again. Written."""
    wanted = sets.join(ids, "id", "left_semi").select(F.col("doc_id").alias("w_doc"), F.col("text_key").alias("w_key"), "id")
    text = whole(F.col("text")).cast("binary")
    texts = docs.select("doc_id", text.alias("text"))
    found = texts.join(
        wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.unhex(F.md5("text")) == F.col("w_key"))
    ).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = [np.sort(sh.shingle_set(x).view(np.int64)) for x in piece.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "shingles"])

    # Rows that repeat an id and its text would come back more than once.
    return held(found.mapInArrow(run, "id bigint, shingles array<bigint>").dropDuplicates(["id"]), label)


def _verified(exact: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches the threshold: a, b. Written."""
    both = (
        pairs.join(exact.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(exact.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("common"))
    )
    jaccard = F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))
    return held(both.where(jaccard >= threshold).select("a", "b"), "links")


def _joined(docs: DataFrame, plan: JoinPlan) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, distinct sets with their copies, linked documents per set (id, others) and links (a, b)
    that connect what is linked."""
    signed = _signatures(docs, plan)
    groups = held(signed.groupBy("key").agg(
        F.min("row").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")), "groups")
    sets = held(
        signed.where("n > 0").join(groups.select("id", "copies"), F.col("row") == F.col("id"))
        .select("id", "doc_id", "text_key", "n", "sketch", "drawn", "copies"), "sets")
    pairs, crowds = _candidates(docs, sets, plan)
    exact = _exact_sets(docs, sets, pairs, crowds)
    links = _verified(exact, pairs, plan.threshold)
    crowd = _crowd_links(crowds, sets, exact, plan)
    ends = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    others = ends.join(sets.select(F.col("id").alias("b"), "copies"), "b").select(F.col("a").alias("id"), F.col("copies").alias("others"))
    counted = others.unionByName(crowd.select("id", "others")).groupBy("id").agg(F.sum("others").alias("others"))
    joining = links.unionByName(crowd.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    return signed, groups, counted, joining


def ngram_jaccard_join(docs: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copy_id, n_shingles.

    ``docs`` has doc_id and text; further columns are ignored. Two documents are linked if the Jaccard similarity of
    their sets of five-word shingles is at least the threshold. ``n_links`` counts the other documents linked to this
    one, copies included; ``class_id`` is the smallest doc_id that links lead to, ``copy_id`` the smallest with the same
    set. Links are found with the plan's recall and never made up. A text of one to four words has one shingle, its
    words; texts without words (null, empty, blank) are copies of each other. Repeated rows are copies. Null ids are
    smaller than none: a class whose ids are all null has a null class_id. An empty table gives no rows.
    """
    signed, groups, counted, links = _joined(docs, plan)
    per_id = _per_set(groups, counted, links)
    return signed.select("doc_id", "key", F.col("n").cast("bigint").alias("n_shingles")).join(per_id, "key").select(
        "doc_id", "class_id", "n_links", "copy_id", "n_shingles")


def _per_set(groups: DataFrame, counted: DataFrame, links: DataFrame) -> DataFrame:
    """key, id, label, class_id, n_links, copy_id of every distinct set."""
    labels = component_labels(links)
    known = groups.join(labels, "id", "left").join(counted, "id", "left").withColumn("label", F.coalesce("label", "id"))
    classes = known.groupBy("label").agg(F.min("first_doc").alias("class_id"))
    return known.join(classes, "label").select(
        "key", "id", "label", "class_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.col("first_doc").alias("copy_id"))


def one_of_each_class(docs: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """The documents without near duplicates: of each class the one with the smallest id stays, whole rows as given.

    Where the smallest id stands on several rows of the class, one row of the smallest text hash stays.
    """
    signed, groups, counted, links = _joined(docs, plan)
    per_id = _per_set(groups, counted, links).select("key", F.col("label").alias("class"))
    # The first row of each class by (doc_id, text): a minimum, so the copies of a class are combined before they move.
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
    first = (
        signed.groupBy("key").agg(F.min(place).alias("p")).join(per_id, "key").groupBy("class").agg(F.min("p").alias("p"))
        .select(F.col("p.d").alias("__llm_d"), F.col("p.t").alias("__llm_t"))
    )
    marked = docs.withColumn("__llm_k", F.unhex(F.md5(whole(F.col("text")).cast("binary"))))
    kept = marked.join(
        first, F.col("doc_id").eqNullSafe(F.col("__llm_d")) & (F.col("__llm_k") == F.col("__llm_t")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__llm_k"]).drop("__llm_k")
