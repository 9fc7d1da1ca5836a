"""I-Match fingerprints: hashes of a document's mid-frequency terms under several randomised lexicons.

The lexicon keeps the words whose document frequency lies in a band relative to the number of documents. A word above the
lower end stands in at least 1/rarest of all documents, so there are at most ``rarest`` times the mean number of distinct
words of a document, however large the corpus is; that makes the lexicon small enough to travel with the plan, as a
table of one-byte tags over hashed words. Everything else is built-in column functions on single rows.

Every randomised lexicon is a hash sample of the lexicon at one of many rates in steps of 2, so that texts of any size have
samples of about one term, and enough of them: all terms of a text up to 64 terms, about 32 or more of a longer one. A
sample's distinct terms are sorted and hashed together; the likeness of two fingerprints is the share of equal hashes among
samples fine enough for the two texts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import bind, sha256_hex, whole, words

#: Rates of the randomised lexicons: one in so many terms. Each rate has up to ``SUBSETS`` disjoint samples.
RATES = tuple(1 << k for k in range(2, 19))
SUBSETS = 64
#: Slots of the table that holds the lexicon: at least so many, and at least ``SPARE`` for each word.
SLOTS = 1 << 18
SPARE = 8
_SECOND, _TAG = 20, 40  # a word's first slot, second slot and tag come from its hash from these bits on
_TAGS = bytes(range(256))


@dataclass(frozen=True)
class Lexicon:
    """A word of the band has its tag (1 to 255) in one of its two slots; 0 is empty. A word outside the band counts as a term
    too, always and everywhere, if one of its slots holds its tag: fewer than 1 in 1,000, as an eighth of the slots are taken
    at most."""

    slots: bytes
    documents: int


def tag_table(hashes: Iterable[int], least: int = SLOTS) -> bytes:
    """The tags of the hashed words, each in one of its two slots; a word that finds both taken moves another one on."""
    known = {h & (1 << 64) - 1 for h in hashes}
    size = least
    while size < SPARE * len(known):
        size *= 2
    while True:
        held: dict[int, int] = {}
        if all(_settled(held, h, size) for h in known):
            break
        size *= 2
    table = bytearray(size)
    for slot, h in held.items():
        table[slot] = (h >> _TAG) % 255 + 1
    return bytes(table)


def _settled(held: dict[int, int], h: int, size: int) -> bool:
    at = h % size
    for _ in range(200):
        places = (h % size, (h >> _SECOND) % size)
        free = next((p for p in places if p not in held), None)
        if free is not None:
            held[free] = h
            return True
        at = places[1] if at == places[0] else places[0]
        h, held[at] = held[at], h
    return False


def _hashes(text: Column) -> Column:
    """Distinct hashes of a text's words."""
    return F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w)))


def build_lexicon(docs: DataFrame, commonest: float = 8.0, rarest: float = 400.0) -> Lexicon:
    """Words that stand in more than one of ``rarest`` documents and in fewer than one of ``commonest``.

    Document frequencies are exact counts over all rows of ``docs`` (text); null texts count as empty documents.
    """
    n = docs.count()
    counted = (
        docs.select(F.explode(_hashes(F.col("text"))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
        .where((F.col("df") * rarest >= n) & (F.col("df") * commonest <= n))
    )
    # At most rarest x mean distinct words rows, see above.
    return Lexicon(tag_table(row.h for row in counted.select("h").collect()), n)


def terms(text: Column, lexicon: Lexicon) -> Column:
    """Sorted distinct hashes of the words in the lexicon."""
    table, tags, size = F.lit(lexicon.slots), F.lit(_TAGS), F.lit(len(lexicon.slots))

    def listed(h: Column) -> Column:
        tag = F.substring(tags, F.pmod(F.shiftrightunsigned(h, _TAG), F.lit(255)).cast("int") + 2, 1)
        at = lambda bits: F.pmod(F.shiftrightunsigned(h, bits) if bits else h, size).cast("int") + 1
        return (F.substring(table, at(0), 1) == tag) | (F.substring(table, at(_SECOND), 1) == tag)

    return F.sort_array(F.filter(_hashes(text), listed))


def subset_hashes(found: Column) -> Column:
    """struct(m, entries): the number of terms, and (k, h) for each randomised lexicon that has terms of the text: its
    number, rate * SUBSETS + subset, and the hash of these terms.

    Rates below the number of terms are left out, since ``likeness`` passes them over, but for the first, whose samples hold
    all terms.
    """

    def at_rate(t: Column, rate: int) -> Column:
        own = F.filter(t, lambda x: F.pmod(x["u"], F.lit(rate)) < SUBSETS)
        own = F.transform(own, lambda x: F.struct((F.pmod(x["u"], F.lit(rate)) + rate * SUBSETS).alias("k"), x["h"].alias("h")))
        hashed = lambda d, k: F.pmod(
            F.xxhash64(F.transform(F.filter(d, lambda x: x["k"] == k), lambda x: x["h"])), F.lit(1 << 32))
        samples = bind(own, lambda d: F.transform(
            F.array_distinct(F.transform(d, lambda x: x["k"])), lambda k: F.struct(k.alias("k"), hashed(d, k).alias("h"))))
        if rate in (RATES[0], RATES[-1]):
            return samples
        return F.when(F.size(t) <= rate, samples).otherwise(F.array().cast("array<struct<k:bigint,h:bigint>>"))

    def entries(t: Column) -> Column:
        return F.struct(F.size(t).alias("m"), F.concat(*[at_rate(t, rate) for rate in RATES]).alias("entries"))

    numbered = F.transform(found, lambda h: F.struct(
        h.alias("h"), F.pmod(F.xxhash64(h, F.lit(0)), F.lit(RATES[-1])).alias("u")))
    return bind(numbered, entries)


def fingerprint_text(parts: Column) -> Column:
    shown = F.transform(parts["entries"], lambda e: F.lower(F.concat_ws(":", F.hex(e["k"]), F.hex(e["h"]))))
    return F.concat_ws(".", parts["m"].cast("string"), F.array_join(shown, "."))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes (0 to 1) among the samples in which either text has terms.

    Rates that leave more than one term of the larger text in a sample, on average, are passed over, since one change among many
    terms already alters their hash. Equal fingerprints have likeness 1, without any term in common it is 0.
    """
    most = F.greatest(a["m"], b["m"])
    fine = lambda p: F.filter(p["entries"], lambda e: (
        F.floor(e["k"] / SUBSETS) >= most) | (e["k"] >= RATES[-1] * SUBSETS))
    keys = lambda x: F.transform(x, lambda e: e["k"])
    share = bind(F.struct(fine(a).alias("x"), fine(b).alias("y")), lambda z: bind(
        F.size(F.array_union(keys(z["x"]), keys(z["y"]))), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(
            F.size(F.array_intersect(z["x"], z["y"])) / n)))
    return F.when((a["m"] == b["m"]) & (a["entries"] == b["entries"]), F.lit(1.0)).otherwise(share)


def fingerprints(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, n_chars, n_terms, fingerprint of every whole text of ``docs``.

    Null texts are empty. A text without lexicon terms has the fingerprint of the empty one. Each row stands for itself,
    so repeated rows and null ids are kept; an empty table gives no rows.
    """
    parts = subset_hashes(terms(F.col("text"), lexicon))
    return docs.select("doc_id", F.length(whole(F.col("text"))).cast("bigint").alias("n_chars"), parts.alias("p")).select(
        "doc_id", "n_chars", F.col("p.m").cast("bigint").alias("n_terms"), fingerprint_text(F.col("p")).alias("fingerprint"))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the value, by halving; -1 for null."""
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda pos, s: F.when(
        F.get(listed, pos + s - 1) < value, pos + s).otherwise(pos))
    return F.when(value.isNull(), -1).otherwise(at)


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """``docs`` (doc_id, text) with the columns ``derived`` from each row and ``next``, a struct of text and those columns of
    the next document in descending doc_id (null last); after the last comes the first. Ties are ordered by text.

    Documents are dealt into ranges of doc_id by measured quantiles and moved once. Inside a range the next row is a window
    function; the first document of each range is also dealt, as a guest, to the range before it, whose last document
    needs it. There are two ranges for each shuffle partition, so the list of guests is as small.
    """
    spark = docs.sparkSession
    n = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = [k / n for k in range(1, n)]
    row = docs.agg(F.percentile_approx("doc_id", quantiles, max(10_000, 20 * n)).alias("q")).first() if n > 1 else None
    bounds = sorted(set(row.q or [])) if row else []
    ranged = docs.withColumn("__range", _bucket(F.col("doc_id"), bounds))
    # One row per range: its first document, and the range whose last document it follows.
    across = Window.orderBy(F.col("__range").desc())
    nameless = docs.where(F.col("doc_id").isNull()).agg(F.max("text").alias("__text")).withColumn("__range", F.lit(-1))
    firsts = ranged.groupBy("__range").agg(F.max("doc_id").alias("__first")).join(nameless, "__range", "left")
    firsts = firsts.select("__first", "__text", F.coalesce(
        F.lag("__range").over(across), F.min("__range").over(Window.partitionBy(F.lit(0)))).alias("__range"))
    guests = docs.join(
        F.broadcast(firsts),
        F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("doc_id").isNotNull() | F.col("text").eqNullSafe(F.col("__text"))))
    guests = guests.select(*docs.columns, "__range").dropDuplicates(["doc_id", "text", "__range"])
    dealt = ranged.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__guest", F.lit(1)))
    order = Window.partitionBy("__range").orderBy(
        "__guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    placed = dealt.repartition("__range").withColumns(derived)
    return (
        placed.withColumn("next", F.lead(F.struct("text", *derived)).over(order))
        .where("__guest = 0").drop("__range", "__guest")
    )


def fingerprint_edits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, as the query of this operator states them.

    The edited text has its last third replaced by the beginning of the next document in descending doc_id.
    """
    whole_text = whole(F.col("text"))
    base = docs.select("doc_id", whole_text.alias("text"))
    paired = with_next(base, {"parts": subset_hashes(terms(F.col("text"), lexicon))})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    changed = paired.select(
        "doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "parts", F.col("next.parts").alias("after"))
    changed = changed.withColumn("edited_parts", subset_hashes(terms(F.col("edited"), lexicon)))
    return changed.select(
        "doc_id", "n_chars", sha256_hex(F.col("edited")).alias("edited_sha256"),
        fingerprint_text(F.col("parts")).alias("fingerprint"),
        fingerprint_text(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("after")).alias("near_next"))
