"""BPE encoding and decoding by content-defined chunk reuse.

Texts are cut where a rolling hash over their bytes says so, so that equal passages
give equal chunks wherever they stand. A worker encodes each chunk once, the unseen ones
of many texts together, and keeps its ids in a bounded store under a 128-bit digest; a
text of one chunk is kept whole. A chunk's first and last word may be
torn, so each join is repaired: a window from the last whole word before the join to
the first whole word after it is encoded by the library, must agree with the ids that
both chunks hold for these words, and replaces what lies between. Where the two do not
agree, or a chunk holds no two whole words, the window grows by a chunk; a text whose
joins never agree is encoded in one piece.

Edge cases: a null text counts as empty and gives no ids; repeated rows and null ids
of documents give a row each; other columns are ignored; very long texts cost memory
in proportion to one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from marquetry.llm.tokenizer import WordCodec, codec, default_path, slices
from marquetry.runtime import read_table

_WINDOW_STEPS = 5  # a window of 2 ** 5 bytes
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
_SPACE = (b" ", b"\n")


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the 32 bytes that end there (fewer at the start)."""
    h = _GEAR[data]
    for step in range(_WINDOW_STEPS):
        width = 1 << step
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
    return h


def cut_points(data: bytes, mean: int = 2048, least: int = 256, most: int = 32_768) -> list[int]:
    """Ends of the chunks of ``data``; always between characters, the last is its length."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= least:
        return [len(raw)] if len(raw) else []
    bits = max(1, int(mean).bit_length() - 1)
    marked = (rolling_hash(raw) >> np.uint32(32 - bits)) == 0
    marked[:-1] &= (raw[1:] & 0xC0) != 0x80
    cuts, last = [], 0
    for at in (np.flatnonzero(marked) + 1).tolist():
        while at - last > most:
            last = _between(raw, last + most)
            cuts.append(last)
        if at - last >= least and at < len(raw):
            cuts.append(at)
            last = at
    while len(raw) - last > most:
        last = _between(raw, last + most)
        cuts.append(last)
    return [*cuts, len(raw)]


def _between(raw: np.ndarray, at: int) -> int:
    while raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


@dataclass(slots=True)
class Chunk:
    """Ids of the whole words of a chunk, and where these words begin and end (bytes)."""

    inner: bytes  # ids of the words between the first and the last whole one
    first: bytes  # ids of the first whole word
    last: bytes
    first_at: int  # it begins here,
    first_end: int  # and ends here
    last_at: int
    last_end: int


def _whole_words(data: bytes) -> tuple[int, int, int, int] | None:
    """Where the first and the last whole word of a chunk begin and end; None when it has
    no two of them."""
    flat = data.replace(b"\n", b" ")
    a = flat.find(b" ") + 1
    z = flat.rfind(b" ")
    while a and a < z and flat[a : a + 1] == b" ":
        a += 1
    while z > a and flat[z - 1 : z] == b" ":
        z -= 1
    if not a or z <= a:
        return None
    a_end = flat.find(b" ", a, z)
    z_at = flat.rfind(b" ", a, z) + 1
    return None if a_end < 0 or z_at <= a_end else (a, a_end, z_at, z)


def _encode_all(words: WordCodec, texts: list[str]) -> list[bytes]:
    flat, sizes = words.encode_many(texts)
    ends = np.cumsum(sizes).tolist()
    return [flat[e - n : e].tobytes() for e, n in zip(ends, sizes.tolist(), strict=True)]


class ChunkStore:
    """Digest of a chunk -> what it encodes to; two generations of bounded size."""

    def __init__(self, words: WordCodec, most_bytes: int = 8_000_000):
        self.words, self.most, self.size = words, most_bytes, 0
        self.now: dict[bytes, Chunk | bytes | None] = {}
        self.old: dict[bytes, Chunk | bytes | None] = {}
        self.encoded = self.reused = 0

    def chunks(self, datas: list[bytes]) -> list[Chunk | None]:
        """Inner chunks of texts; those not held are encoded together."""
        return self._get(datas, b"c", self._make_chunks)

    def wholes(self, datas: list[bytes]) -> list[bytes]:
        """Ids of texts of one chunk."""
        return self._get(datas, b"w", lambda new: _encode_all(self.words, [x.decode() for x in new]))

    def _make_chunks(self, datas: list[bytes]) -> list[Chunk | None]:
        spans = [_whole_words(x) for x in datas]
        texts = [
            x[i:j].decode() for x, at in zip(datas, spans, strict=True) if at for i, j in ((at[1], at[2]), at[:2], at[2:])
        ]
        ids = iter(_encode_all(self.words, texts))
        return [Chunk(next(ids), next(ids), next(ids), *at) if at else None for at in spans]

    def _get(self, datas: list[bytes], kind: bytes, make: Callable) -> list:
        keys = [kind + xxhash.xxh3_128_digest(x) for x in datas]
        found: dict[bytes, object] = {}
        fresh: dict[bytes, bytes] = {}
        for key, data in zip(keys, datas, strict=True):
            if key in self.now:
                found[key] = self.now[key]
            elif key in self.old:
                found[key] = self.old[key]
            else:
                fresh[key] = data
        self.encoded += len(fresh)
        self.reused += len(keys) - len(fresh)
        found.update(zip(fresh, make(list(fresh.values())) if fresh else [], strict=True))
        for key, value in found.items():
            if key not in self.now:
                if self.size > self.most:
                    self.old, self.now, self.size = self.now, {}, 0
                self.now[key] = value
                self.size += 250 + len(value.inner if isinstance(value, Chunk) else value or b"")
        return [found[key] for key in keys]


def encode_texts(texts: list[str], store: ChunkStore, mean: int = 2048) -> list[bytes]:
    """Ids of each of ``texts`` from its chunks, joins repaired."""
    words = store.words
    if not words.by_words:
        return [words.encode(t) for t in texts]
    datas = [t.encode("utf-8", "surrogatepass") for t in texts]
    cuts = [cut_points(x, mean) for x in datas]
    single = [i for i, c in enumerate(cuts) if len(c) < 2]
    out: list[bytes] = [b""] * len(texts)
    for i, ids in zip(single, store.wholes([datas[i] for i in single]), strict=True):
        out[i] = ids
    many = [i for i, c in enumerate(cuts) if len(c) > 1]
    held = iter(store.chunks([datas[i][a:b] for i in many for a, b in zip([0, *cuts[i]], cuts[i], strict=False)]))
    for i in many:
        out[i] = _repaired(datas[i], cuts[i], held, words)
    return out


def encode_text(text: str, store: ChunkStore, mean: int = 2048) -> bytes:
    return encode_texts([text], store, mean)[0]


def _repaired(data: bytes, cuts: list[int], chunks: Iterator[Chunk | None], words: WordCodec) -> bytes:
    """Ids of a text out of those of its chunks, one of ``chunks`` for each of ``cuts``."""
    out: list[bytes] = []
    held: Chunk | None = None  # the last chunk taken, and where its last whole word begins
    held_at = begin = 0
    for end in cuts:
        chunk = next(chunks)
        if chunk is not None:
            window = data[held_at : begin + chunk.first_end].decode()
            ids = words.by_library(window)
            before = held.last if held else b""
            if ids.startswith(before) and ids.endswith(chunk.first) and len(ids) >= len(before) + len(chunk.first):
                out.append(ids)
                out.append(chunk.inner)
                held, held_at = chunk, begin + chunk.last_at
            # else no agreement: this chunk's ids are not used, and the window grows over it
        begin = end
    tail = words.by_library(data[held_at:].decode())
    if held and not tail.startswith(held.last):
        return words.by_library(data.decode())
    out.append(tail)
    return b"".join(out)


_STORES: dict[tuple[str, int], ChunkStore] = {}


def _store(path: str) -> ChunkStore:
    key = (path, 0)
    if key not in _STORES:
        _STORES[key] = ChunkStore(codec(path))
    return _STORES[key]


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", mean: int = 2048) -> DataFrame:
    """``(doc_id, ids array<int>)``: each whole text encoded. No shuffle, one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(path)
        for batch in batches:
            for part in slices(batch):
                parts = encode_texts([t or "" for t in part.column(1).to_pylist()], store, mean)
                flat = np.frombuffer(b"".join(parts), "<i4")
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` -> ``(doc_id, text)``, as the library decodes; null ids: empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = words.decode_many(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), texts.cast(pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest each text in one pass: ids never leave the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(path)
        for batch in batches:
            for part in slices(batch):
                parts = encode_texts([t or "" for t in part.column(1).to_pylist()], store)
                counts = np.array([len(x) // 4 for x in parts], np.int64)
                texts = store.words.decode_many(np.frombuffer(b"".join(parts), "<u4"), counts)
                heads = [hashlib.sha256(x).hexdigest() for x in parts]
                tails = [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.array(heads, pa.string()), pa.array(tails, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read_table(spark, sf_dir, "documents"), default_path())
