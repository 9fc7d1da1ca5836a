"""Secret scans: fixed patterns, and literals that reach a sensitive name through assignments.

The second part lexes source and configuration syntax into (name, literal) pairs: assignments and comparisons, values on the
next line, brackets and triple quotes over lines, tuples, YAML block scalars and XML tags. Constants are carried from name to
name, forwards and backwards, through concatenations and ``{...}`` references until nothing changes, and each literal is scored
by the names it reaches. Base spans stay as they are; a longer literal that begins inside one is listed next to it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ship, whole

#: The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones are just the failing matches
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How much a part of a name says that its value is secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8, "auth": 0.7, "bearer": 0.9, "private": 0.6, "key": 0.6,
    "privatekey": 1.0, "secretkey": 1.0, "accesskey": 0.9, "signingkey": 0.9,
    "signature": 0.6, "salt": 0.6,
}
_STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "private", "signature", "salt")
#: Literals that stand for a value instead of being one.
PLACEHOLDER = re.compile(
    r"(?i)(x+|\*+|\.+|-+|_+|<.*>|\{.*\}|change_?me|example.*|none|null|true|false|test|dummy|sample|redacted|todo|your[_-].*)")
THRESHOLD = 0.5

#: Last parts of names that say something about a secret instead of holding it.
ABOUT = frozenset(
    "size length len count id name path file url uri type public format policy field label hint expiry expires ttl prefix".split())
#: From this weight of a name on, a quoted value may have spaces in it: pass phrases and keys.
STRONG = 0.9

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
# A name is tried once, where its run of characters begins.
_PAIR = re.compile(rf"""(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["']?\]?[ \t]*(?P<op>===?|!==?|:=|=>|=(?![=>])|:(?![:/=]))[ \t]*
    |<(?P<tag>{_NAME})(?:[ \t][^<>\n]*)?>(?P<body>[^<]+)</(?P=tag)>""", re.VERBOSE)
_COMPARISONS = ("==", "===", "!=", "!==")
_STRING = r"""(?:(?P<prefix>[rRbBuUfF]{1,2})(?=["']))?(?:
      \"\"\"(?P<double3>(?:[^"\\]|\\[\s\S]|"(?!""))*)\"\"\" | \'\'\'(?P<single3>(?:[^'\\]|\\[\s\S]|'(?!''))*)\'\'\'
    | "(?P<double>(?:[^"\\\n]|\\[\s\S])*)" | '(?P<single>(?:[^'\\\n]|\\[\s\S])*)' | `(?P<tick>[^`]*)`)"""
_QUOTED = ("double3", "single3", "double", "single", "tick")
_LITERAL = re.compile(_STRING, re.VERBOSE)
_PART = re.compile(rf"""{_STRING}
    | \$\{{(?P<braced>{_NAME})\}} | \$(?P<shell>[A-Za-z_]\w*) | (?P<bare>[A-Za-z0-9+/_.=-]+)""", re.VERBOSE)
_PLUS = re.compile(r"(?:[ \t]*\\?\r?\n)?[ \t]*[+.][ \t]*(?:\\?\r?\n[ \t]*)?(?=[\"'`$A-Za-z_])")
_NEXT_LINE = re.compile(r"\\?\r?\n[ \t]*")
_BETWEEN = re.compile(r"(?:[\s,+.]|\\\n)*")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*\r?\n")
_INNER = re.compile(rf"\$?\{{({_NAME})\}}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_COMMA = re.compile(r"[ \t]*,[ \t]*")
_LINE_END = re.compile(r"[ \t]*(?:[#;\r\n]|//|\Z)")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def name_weight(name: str) -> float:
    """The largest weight among the parts of a name; parts end at case changes, digits and punctuation.

    Names that end in a word like ``size`` or ``path`` or begin with ``public`` speak about a secret and weigh nothing.
    """
    parts = [p.lower() for p in _WORDS.findall(name)]
    if parts and (parts[-1] in ABOUT or parts[0] == "public"):
        return 0.0
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((NAME_WEIGHTS.get(p, 0.0) for p in parts + pairs), default=0.0)


def literal_weight(text: str, spaces: bool = False) -> float:
    """How much a literal looks like a secret: 0 for short ones and placeholders, more for longer and more varied ones.

    A text with white space inside is no secret unless ``spaces`` allows it.
    """
    text = text.strip()
    if len(text) < 6 or PLACEHOLDER.fullmatch(text) or (not spaces and any(c.isspace() for c in text)):
        return 0.0
    counts = Counter(text)
    bits = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    kinds = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 * kinds + bits / 8 + min(len(text), 32) / 64)


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret part) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(stem in low for stem in _ASSIGN_STEMS):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return found


@dataclass
class Pair:
    """What a name is given: literal spans, the names referred to, whether a literal is quoted, whether it is an assignment."""

    name: str
    spans: list[tuple[int, int]]
    refers: list[str]
    quoted: bool
    assigns: bool = True


def _expression(text: str, at: int, pair: Pair) -> int:
    """Read literals and names joined by ``+`` or ``.`` from ``at`` on into the pair; returns where they end."""
    plus = None
    while part := _PART.match(text, at):
        kind = next(k for k in (*_QUOTED, "braced", "shell", "bare") if part[k] is not None)
        s, e = part.span(kind)
        if kind in _QUOTED:
            pair.quoted = True
            pair.spans.append((s, e))
            pair.refers += _INNER.findall(part[kind])
        elif kind in ("braced", "shell") or re.fullmatch(_NAME, part[kind]):
            pair.refers.append(part[kind])
        at = part.end()
        joined = plus is not None
        plus = _PLUS.match(text, at)
        if kind == "bare" and not joined and not plus:
            pair.spans.append((s, e))  # operands of a concatenation are names, not values
        if not plus:
            break
        at = plus.end()
    return at


def _block_scalar(text: str, start: int, at: int, pair: Pair) -> int:
    """Read the lines below ``at`` that are indented more than the line of ``start`` as one literal."""
    line = text.rfind("\n", 0, start) + 1
    indent = len(text[line:start]) - len(text[line:start].lstrip(" \t-"))
    first, last = None, at
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        body = text[at:end]
        inner = len(body) - len(body.lstrip(" \t"))
        if body.strip():
            if inner <= indent:
                break
            first = at + inner if first is None else first
            last = at + len(body.rstrip())
        at = end + 1
    if first is not None:
        pair.spans.append((first, last))
        pair.quoted = True
    return max(last, min(at, len(text)))


def _bracketed(text: str, at: int, pair: Pair) -> int:
    """Read the string literals of a bracket that opens at ``at``, over lines; it ends at the first thing that is none."""
    at += 1
    while True:
        at = _BETWEEN.match(text, at).end()
        part = _LITERAL.match(text, at)
        if not part:
            return at
        kind = next(k for k in _QUOTED if part[k] is not None)
        pair.spans.append(part.span(kind))
        pair.refers += _INNER.findall(part[kind])
        pair.quoted = True
        at = part.end()


def _names_before(text: str, at: int) -> list[str]:
    """The names in front of ``at`` that are set apart by commas and begin their line, or none."""
    names: list[str] = []
    while True:
        while at and text[at - 1] in " \t":
            at -= 1
        if not at or text[at - 1] == "\n":
            return names[::-1]
        if text[at - 1] != ",":
            return []
        at -= 1
        while at and text[at - 1] in " \t":
            at -= 1
        end = at
        while at and text[at - 1] in _NAME_CHARS:
            at -= 1
        if not re.fullmatch(_NAME, text[at:end]):
            return []
        names.append(text[at:end])


def _tuple(text: str, start: int, at: int, name: str) -> tuple[list[Pair], int]:
    """``a, b = "x", "y"``: a pair for each name, if as many values follow as names stand on the left and end the line."""
    pairs = [Pair(n, [], [], False) for n in (*_names_before(text, start), name)]
    for k, pair in enumerate(pairs if len(pairs) > 1 else ()):
        if k:
            comma = _COMMA.match(text, at)
            if not comma:
                return [], at
            at = comma.end()
        at = _expression(text, at, pair)
    return (pairs, at) if len(pairs) > 1 and _LINE_END.match(text, at) else ([], at)


def name_literal_pairs(text: str) -> list[Pair]:
    """The assignments of a text in order: name and value on a line or two, brackets, block scalars, tags, tuples."""
    pairs: list[Pair] = []
    at = 0
    while m := _PAIR.search(text, at):
        if m["tag"]:
            s, e = m.span("body")
            body = m["body"]
            s, e = s + len(body) - len(body.lstrip()), e - len(body) + len(body.rstrip())
            pairs.append(Pair(m["tag"], [(s, e)] if e > s else [], [], True))
            at = m.end()
            continue
        pair = Pair(m["name"], [], [], False, m["op"] not in _COMPARISONS)
        at = m.end()
        if m["op"] in ("=", ":="):
            listed, end = _tuple(text, m.start(), at, m["name"])
            if listed:
                pairs += listed
                at = end
                continue
        if m["op"] == ":" and (block := _BLOCK.match(text, at)):
            at = _block_scalar(text, m.start(), block.end(), pair)
        elif text[at:at + 1] in ("(", "["):
            at = _bracketed(text, at, pair)
        else:
            below = _NEXT_LINE.match(text, at)
            if below and (_LITERAL.match(text, below.end()) and not _PAIR.match(text, below.end())):
                at = below.end()
            elif below and text[below.end():below.end() + 1] in ("(", "["):
                at = _bracketed(text, below.end(), pair)
                below = None
            at = _expression(text, at, pair) if not (below is None and pair.spans) else at
        pairs.append(pair)
    return pairs


def literal_spans(text: str) -> list[tuple[str, int, int, int]]:
    """Spans of literals whose value reaches a sensitive name directly or through constants.

    All assignments are read first. A name stands for its last assignment before the reference or, if there is none, for the
    first one after it. Weights pass from names to what they refer to until nothing changes; each assignment takes the largest
    weight that reaches it. Its literals are scored together with those of the constants that it names itself.
    """
    low = text.lower()
    if not any(stem in low for stem in _STEMS):
        return []
    pairs = name_literal_pairs(text)
    weights = [name_weight(p.name) for p in pairs]
    if not any(weights):
        return []
    places: dict[str, list[int]] = {}
    for k, pair in enumerate(pairs):
        if pair.assigns:
            places.setdefault(pair.name, []).append(k)

    def meant(name: str, k: int) -> int | None:
        known = places.get(name)
        if not known:
            return None
        j = bisect_left(known, k)
        found = known[j - 1] if j else known[0]
        return found if found != k else (known[1] if len(known) > 1 else None)

    refers = []
    for k, pair in enumerate(pairs):
        targets = {n: t for n in dict.fromkeys(pair.refers) if (t := meant(n, k)) is not None}
        # A bare word that names a constant stands for the constant's literals; a quoted one is a literal itself.
        if not pair.quoted:
            pair.spans = [s for s in pair.spans if text[s[0]:s[1]] not in targets]
        refers.append(list(dict.fromkeys(targets.values())))

    # The heaviest names first, so that every assignment is visited once.
    reached = [0.0] * len(pairs)
    seen = [False] * len(pairs)
    for start in sorted((k for k, w in enumerate(weights) if w), key=lambda k: -weights[k]):
        todo = [start]
        while todo:
            k = todo.pop()
            if not seen[k]:
                seen[k], reached[k] = True, weights[start]
                todo += refers[k]

    best: dict[tuple[int, int], float] = {}
    for k, pair in enumerate(pairs):
        if not reached[k]:
            continue
        spans = [s for s in dict.fromkeys([*pair.spans, *(s for j in refers[k] for s in pairs[j].spans)]) if s[1] > s[0]]
        quoted = pair.quoted or any(pairs[j].quoted for j in refers[k])
        value = "".join(text[s:e] for s, e in spans)
        score = reached[k] * literal_weight(value, quoted and reached[k] >= STRONG)
        for span in spans:
            best[span] = max(best.get(span, 0.0), score)
    return [("literal", s, e, s) for (s, e), score in best.items() if score >= THRESHOLD]


def scan(text: str) -> list[tuple[str, int, int, int]]:
    """All spans of a text by start, then kind. Literals inside a base span are not listed twice."""
    base = base_spans(text)
    spans = sorted(base, key=lambda x: x[1])
    ends, most = [], -1
    for x in spans:
        most = max(most, x[2])
        ends.append(most)
    starts = [x[1] for x in spans]
    extra = []
    for x in literal_spans(text):
        i = bisect_right(starts, x[1]) - 1
        if i < 0 or ends[i] < x[2]:
            extra.append(x)
    return sorted(base + extra, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = "array<struct<kind:string,start:int,end:int,secret:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.int32())]))


def secret_spans(text: Column) -> Column:
    """The spans of a text column as an array of (kind, start, end, secret): code points, end exclusive; ``secret`` is
    where the secret part begins."""

    @F.arrow_udf(_SPANS)
    def spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(
                [[dict(zip(("kind", "start", "end", "secret"), x)) for x in scan(t)] for t in batch.to_pylist()], _ARROW)

    return spans(whole(text))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Spans of every whole text: doc_id, found (array of kind, start, end, secret).

    Null texts are empty and have no spans. Each row is scanned on its own: repeated rows give repeated results, further
    columns are ignored, an empty table gives no rows.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", secret_spans(F.col("text")).alias("found"))


def span_text(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with the secret part of every span replaced by ``mark``; all columns stay, n_chars follows."""

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = []
            for t in batch.to_pylist():
                done, parts = 0, []
                for _, _, end, secret in sorted(scan(t), key=lambda x: x[3]):
                    if secret >= done:
                        parts += [t[done:secret], mark]
                    done = max(done, end)
                out.append("".join(parts) + t[done:] if parts else t)
            yield pa.array(out, pa.string())

    ship(docs.sparkSession)
    redacted = docs.withColumn("__llm_text", clean(whole(F.col("text"))))
    new = {"text": F.col("__llm_text"), "n_chars": F.length("__llm_text").cast("bigint")}
    return redacted.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
