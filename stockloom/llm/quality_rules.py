"""Line-first cleaning: rules judge single lines, then documents that lose too much text are rejected.

Everything is one projection over built-in functions. A document is never moved, so neither hot sources nor groups of
copies matter, and a long text costs time in proportion to its length (n log n where repeated windows are sorted).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import GAP, WORD_CHAR, bind, whole

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Separators of navigation bars.
SEPARATORS = "|»›•·"
#: What a complete line may end with (closing quotes and brackets after it are allowed).
LINE_END = r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: Phrases of banners, footers and forms.
BOILERPLATE = (
    r"(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|enable javascript|lorem ipsum|click here"
    r"|subscribe (now|to)|sign in|log in|sign up|share (this|on)|copyright (\(c\)|©)|©)"
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds. Shares are per hundred and compared as whole numbers."""

    min_words: int = 20  # a document below is rejected
    max_repeat: int = 30  # share of words in repeated windows above which a document is rejected
    window: int = 8  # words of a window
    max_symbols: int = 8  # share of symbols among a line's word characters
    separators_per: int = 4  # a navigation line has a separator for so many words, or more
    shout_words: int = 3  # lines of fewer words are never shouting
    short_line: int = 4  # a line of fewer words must end like a sentence
    boiler_words: int = 25  # longer lines are not boilerplate, whatever they mention
    max_loss: int = 50  # share of a document's word characters that its failed lines may hold


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """Whether a line that has a word breaks a rule. Blank lines are not for this function."""
    chars = _length_without(line, GAP)
    symbols = F.length(line) - _length_without(line, f"[{SYMBOLS}]+")
    separators = F.length(line) - _length_without(line, f"[{SEPARATORS}]+")
    n_words = F.size(F.array_remove(F.split(line, GAP), ""))
    upper = F.length(line) - _length_without(line, r"\p{Lu}+")
    lower = F.length(line) - _length_without(line, r"\p{Ll}+")
    navigation = (separators > 0) & (separators * rules.separators_per >= n_words)
    noisy = symbols * 100 > chars * rules.max_symbols
    shouting = (n_words >= rules.shout_words) & (upper > lower * 2)
    boilerplate = (n_words <= rules.boiler_words) & line.rlike(BOILERPLATE)
    unfinished = (n_words < rules.short_line) & ~line.rlike(LINE_END)
    return navigation | noisy | shouting | boilerplate | unfinished


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words lie in a window of ``window`` words that occurs twice or more in the text, first included.

    Windows are compared by a 64-bit hash: two of the n windows of one text are confused with probability n*n / 2**65.
    """

    def covered(starts: Column) -> Column:
        return bind(F.size(starts), lambda n: F.aggregate(
            F.sequence(F.lit(0), n - 1), F.lit(0),
            lambda total, k: total + F.when(k == n - 1, F.lit(window)).otherwise(
                F.least(F.lit(window), F.get(starts, k + 1) - F.get(starts, k)))))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twin = F.filter(p, lambda x, k: (
                (F.get(p, k - 1)["h"] == x["h"]) & (k > 0)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bind(bind(pairs, starts), covered))

    hashed = lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, window)))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(bind(hashed(words), count)).cast("bigint")


def _figures(text: Column, rules: LineRules) -> Column:
    """All figures of one text, and the text without its failed lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))

    def with_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w, rules.window).alias("n_repeat_words"))

    def with_lines(x: Column) -> Column:
        return F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            F.size(x).cast("bigint").alias("n_lines"))

    cleaned = F.array_join(F.filter(
        F.split(text, "\n"), lambda x: ~x.rlike(WORD_CHAR) | ~line_fails(x, rules)), "\n")
    return F.struct(
        bind(F.array_remove(F.split(text, GAP), ""), with_words).alias("w"),
        bind(lines, with_lines).alias("l"),
        (F.length(text) - _length_without(text, f"[{SYMBOLS}]+")).cast("bigint").alias("n_symbols"),
        cleaned.alias("cleaned"))


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Figures, verdict and cleaned text for every row of ``docs`` (doc_id, text; further columns are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars (word
    characters of the lines that passed), cleaned_text. A null or empty text has no words, so it fails and its cleaned
    text is empty. Repeated rows give repeated results; an empty table gives no rows; a null id stays null.
    """
    judged = docs.select(F.col("doc_id"), _figures(whole(F.col("text")), rules).alias("f"))
    judged = judged.select(
        "doc_id", F.col("f.w.n_words"), F.col("f.w.word_chars"), F.col("f.n_symbols"), F.col("f.l.n_dup_lines"),
        F.col("f.w.n_repeat_words"), F.col("f.cleaned").alias("cleaned_text"))
    base = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat)
    kept_chars = _length_without(F.col("cleaned_text"), GAP).cast("bigint")
    lost = (F.col("word_chars") - kept_chars) * 100 > F.col("word_chars") * rules.max_loss
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~lost).alias("kept"), kept_chars.alias("kept_chars"), "cleaned_text")


def keep_clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents with their cleaned text, under the columns of ``docs``; n_chars follows the text if present."""
    names = docs.columns
    # A generator of one row: unlike a projection, nothing above it is merged into it, so the figures are computed once
    # although the filter and the result both use them.
    figures = F.inline(F.array(F.struct(_figures(whole(F.col("text")), rules).alias("__llm_f"))))
    judged = docs.select("*", figures)
    f = F.col("__llm_f")
    n, chars, repeat = f["w"]["n_words"], f["w"]["word_chars"], f["w"]["n_repeat_words"]
    left = _length_without(f["cleaned"], GAP)
    good = (n >= rules.min_words) & (repeat * 100 <= n * rules.max_repeat) & (
        (chars - left) * 100 <= chars * rules.max_loss)
    new = {"text": f["cleaned"], "n_chars": F.length(f["cleaned"]).cast("bigint")}
    return judged.where(good).select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])
