"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last 16 bytes hits a pattern, so equal passages are cut alike wherever they
stand. A chunk met before (in another document or place) is not encoded again. A cut may fall inside a word; the ids of
a chunk therefore leave out its first and last partial word, and at every joint the two halves are put together and
encoded anew. The tokenizer ends words at white space and looks at nothing across it, so the joined ids are exactly
those of the whole text.

Chunks are shared within a Spark task and between the tasks of one Python worker. Sharing them over the cluster would
send every text and all its ids through a shuffle for the few chunks that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces
from .text import ship, whole

_SPACE = frozenset(b" \t\n\r\x0b\x0c")
_WINDOW = 16
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(_BLOCK + _WINDOW - 1, base, np.uint64))), dtype=np.uint64)


def cut_points(data: np.ndarray, mean: int) -> np.ndarray:
    """Places in a byte array where the hash of the 16 bytes before them hits; one in ``mean`` on average."""
    found = []
    up, down = cut_points.powers
    with np.errstate(over="ignore"):
        for start in range(0, max(0, len(data) - _WINDOW + 1), _BLOCK):
            block = data[start:start + _BLOCK + _WINDOW - 1].astype(np.uint64) + np.uint64(1)
            total = np.concatenate(([np.uint64(0)], np.cumsum(block * up[:len(block)], dtype=np.uint64)))
            n = len(block) - _WINDOW + 1
            window = (total[_WINDOW:] - total[:n]) * down[:n]
            window = (window ^ (window >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append(np.flatnonzero((window >> np.uint64(40)) % np.uint64(mean) == 0) + start + _WINDOW)
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


cut_points.powers = (_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64)))


class _Recent:
    """A map of bounded size: two generations, the older one is dropped when the younger is full."""

    def __init__(self, most: int, weigh=lambda key, value: 1):
        self.young, self.old, self.most, self.weight, self.weigh = {}, {}, most, 0, weigh

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value):
        if self.weight >= self.most:
            self.old, self.young, self.weight = self.young, {}, 0
        self.young[key] = value
        self.weight += self.weigh(key, value)


class ChunkEncoder:
    """Encodes texts with a word-ending BPE vocabulary, reusing words and chunks.

    ``mean_chunk``: average chunk length in bytes. ``word_entries`` and ``chunk_bytes`` bound the reuse tables, which
    decide how often something is encoded again and never what comes out.
    """

    def __init__(self, path: str, mean_chunk: int = 1024, word_entries: int = 250_000, chunk_bytes: int = 24 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mean = mean_chunk
        self.words = _Recent(word_entries)
        self.chunks = _Recent(chunk_bytes, lambda key, value: 2 * len(key) + 4 * len(value[1]) + 200)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        self.mark_id, self.mark = max((i, t.content) for i, t in added.items())
        self.tokens = pa.array([self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())], pa.string())

    def _encode_words(self, missing: list[bytes], known: dict[bytes, bytes]) -> None:
        """Fill in the ids (int32 bytes) of words. Many are encoded in one call, parted by a special token."""
        plain = [w for w in missing if b"<|" not in w]
        for start in range(0, len(plain), 512):
            group = plain[start:start + 512]
            text = self.mark.join([w.decode("utf-8", "replace") for w in group])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark_id)
            for word, part in zip(group, np.split(ids, cuts)):
                known[word] = (part[1:] if len(part) and part[0] == self.mark_id else part).tobytes()
        for word in missing:
            if b"<|" in word:
                text = word.decode("utf-8", "replace")
                known[word] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32).tobytes()
        for word in missing:
            self.words.put(word, known[word])

    def encode(self, data: bytes, ends: np.ndarray) -> list[bytes]:
        """Ids as int32 bytes of each text; the texts stand one after the other in ``data`` up to their ``ends``."""
        cuts = cut_points(np.frombuffer(data, np.uint8), self.mean)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        plan, parsed, wanted = [], {}, set()
        for start, end in zip(starts.tolist(), ends.tolist()):
            inner = cuts[np.searchsorted(cuts, start + _WINDOW):np.searchsorted(cuts, end)].tolist()
            chunks, at = [], start
            for cut in inner:
                if cut - at >= 64:
                    chunks.append(data[at:cut])
                    at = cut
            if end > at:
                chunks.append(data[at:end])
            # Joints: the words that the cuts may have torn apart, in full.
            steps, torn = [], []
            for chunk in chunks:
                entry = parsed.get(chunk) or self.chunks.get(chunk)
                if entry is None:
                    entry = self._parse(chunk, wanted)
                parsed[chunk] = entry
                head, body, tail = entry
                torn.append(head)
                if tail is not None:
                    if joint := b"".join(torn):
                        steps.append((joint, None))
                        wanted.add(joint)
                    steps.append((None, chunk))
                    torn = [tail]
            if joint := b"".join(torn):
                steps.append((joint, None))
                wanted.add(joint)
            plan.append(steps)
        known, missing = {}, []
        for word in wanted:
            ids = self.words.get(word)
            if ids is None:
                missing.append(word)
            else:
                known[word] = ids
        self._encode_words(missing, known)
        ready = {}
        for chunk, (head, body, tail) in parsed.items():
            if isinstance(body, list):
                body = b"".join(map(known.__getitem__, body))
                self.chunks.put(chunk, (head, body, tail))
            ready[chunk] = body
        return [b"".join([known[w] if c is None else ready[c] for w, c in steps]) for steps in plan]

    @staticmethod
    def _parse(chunk: bytes, wanted: set) -> tuple:
        """(head, inner words, tail): partial words at the edges. Without white space all is head and tail is None."""
        inner = chunk.split()
        opens, closes = chunk[0] not in _SPACE, chunk[-1] not in _SPACE
        if len(inner) == 1 and opens and closes:
            return chunk, b"", None
        head = inner.pop(0) if opens else b""
        tail = inner.pop() if closes else b""
        wanted.update(inner)
        return head, inner, tail

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of id lists as the tokenizer decodes them: all tokens, special ones too, joined by a space."""
        flat = ids.flatten()
        tokens = self.tokens.take(flat)
        lists = pa.ListArray.from_arrays(_offsets(ids), tokens)
        return pc.binary_join(lists, " ")


def _offsets(lists: pa.ListArray) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def _encoder(path: str, mean_chunk: int) -> ChunkEncoder:
    """One encoder per Python worker, so that words and chunks are reused from task to task."""
    key = (path, mean_chunk)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, mean_chunk)
    return _ENCODERS[key]


def _encoded(encoder: ChunkEncoder, piece: pa.RecordBatch) -> pa.ListArray:
    texts = piece.column(piece.schema.get_field_index("text"))
    raw = texts.to_pylist()
    ends = np.cumsum([len(x) for x in raw]).astype(np.int64)
    parts = encoder.encode(b"".join(raw), ends)
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode_documents(docs: DataFrame, path: str, *, decode: bool = False, mean_chunk: int = 1024) -> DataFrame:
    """Token ids of every whole text: doc_id, ids (array of int); with ``decode`` also decoded, read back from the ids.

    ``path`` names the tokenizer file, readable on all executors. Null texts are empty and have no ids. Ids, repeated rows
    and further columns are left alone: each row is encoded on its own, in its place. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    source = docs.select("doc_id", whole(F.col("text")).cast("binary").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, mean_chunk)
        for batch in batches:
            for piece in pieces(batch):
                ids = _encoded(encoder, piece)
                columns = {"doc_id": piece.column(0), "ids": ids} | ({"decoded": encoder.decode(ids)} if decode else {})
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return source.mapInArrow(run, f"doc_id {id_type}, ids array<int>" + (", decoded string" if decode else ""))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of ``encoded`` (doc_id, ids): doc_id, decoded. Null ids give an empty text."""
    ship(encoded.sparkSession)
    source = encoded.select("doc_id", F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, 1024)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([piece.column(0), encoder.decode(piece.column(1))], ["doc_id", "decoded"])

    return source.mapInArrow(run, f"doc_id {id_type}, decoded string")
