"""A word codec over a tokenizer file: exactly the library's ids, most words from a memo."""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marquetry.llm.merges import PairTable, gather, merge_all

#: Words whose handling below is the library's letter by letter: Latin, all in NFC, and
#: each letter with one lower-case letter (so without the dotted capital I).
_PLAIN = "^[!-~¡-įı-ɏ]*$"
_SPLIT = (
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level models use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


#: Pieces of more bytes are merged by the library, so that few rounds settle all others.
LONGEST = 48


@dataclass
class Runs:
    """Runs of ids in one flat array."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, sizes: np.ndarray) -> Runs:
        return cls(flat, np.cumsum(sizes) - sizes, sizes)

    def take(self, at: np.ndarray) -> Runs:
        """The runs of these numbers, laid one after the other."""
        return Runs.of(gather(self.flat, self.starts[at], self.sizes[at]), self.sizes[at])

    def joined(self, ends: np.ndarray) -> Runs:
        """Of adjacent runs: those from each of ``ends`` to the next as one run."""
        bounds = np.concatenate([[0], np.cumsum(self.sizes)])[ends]
        return Runs(self.flat, bounds[:-1], np.diff(bounds))

    def spread(self, at: np.ndarray, n: int) -> Runs:
        """``n`` runs: these at the numbers of ``at``, empty ones elsewhere."""
        starts, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        starts[at], sizes[at] = self.starts, self.sizes
        return Runs(self.flat, starts, sizes)

    def put(self, at: np.ndarray, runs: list[np.ndarray]) -> Runs:
        """With other runs at some numbers."""
        if len(at):
            self.sizes[at] = [len(x) for x in runs]
            self.starts[at] = len(self.flat) + np.cumsum(self.sizes[at]) - self.sizes[at]
            self.flat = np.concatenate([self.flat, *runs])
        return self


class WordCodec:
    """Encodes and decodes with one tokenizer file.

    When the file drops white space and never joins pieces across it (the layout of
    ``word_bpe_49k.json``), a text's ids are those of its words in a row; ``by_words``
    says so. Then the words of many texts are told apart first and the pieces of all of
    them are merged at once; nothing is kept between calls. Any other file goes through
    the library text by text.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self._special = [x["content"] for x in spec["added_tokens"]]
        self.by_words = (
            norm == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"].get("Regex") == _SPLIT
            and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
            and (pre[1]["use_regex"], pre[1]["add_prefix_space"]) == (False, False)
            and not any(x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
            and not any(x.split() != [x] for x in self._special)
        )
        self._pieces = regex.compile(_SPLIT).findall
        self._letters = _byte_letters()
        self._tokenize = self.library.model.tokenize
        if self.by_words:
            self._load_merges(spec["model"])
        self.joined_by_space = spec.get("decoder") is None
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.library.id_to_token(i) for i in range(size)]
        self._names = pa.array(self.tokens, pa.large_string())

    def _load_merges(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right, joined = (
            np.array(x, np.int64) for x in ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs])
        )
        self.table = PairTable(left, right, joined)
        letters = [self._letters[b] for b in range(256)]
        # Symbols of the 256 bytes inside a piece and at its end; -1 where the file has none.
        self._inner = np.array([vocab.get(x, -1) for x in letters], np.int32)
        self._final = np.array([vocab.get(x + suffix, -1) for x in letters], np.int32)

    def _part(self, piece: str) -> np.ndarray:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
        return np.array([x.id for x in self._tokenize(mapped)], np.int32)

    def _pieces_ids(self, pieces: pa.Array) -> Runs:
        """Ids of distinct pieces; the library merges those too long to be done at once."""
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        first = pieces.offset and pieces.buffers()[1] and int(np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset])
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[first : first + int(sizes.sum())]
        symbols = self._inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self._final[data[last]]
        odd = (sizes > LONGEST) | (np.minimum.reduceat(symbols, last - sizes + 1) < 0) if len(sizes) else np.zeros(0, bool)
        keep = np.repeat(~odd, sizes)
        flat, counts = merge_all(symbols[keep], sizes[~odd], self.table)
        runs = Runs.of(flat, counts).spread(np.flatnonzero(~odd), len(odd))
        at = np.flatnonzero(odd)
        return runs.put(at, [self._part(x) for x in pieces.take(pa.array(at)).to_pylist()])

    def _word_ids(self, words: pa.Array) -> Runs:
        """Ids of distinct words."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for mark in self._special:
            plain = pc.and_not(plain, pc.match_substring(words, mark))
        lows = pc.utf8_lower(words)
        one = pc.and_(plain, pc.match_substring_regex(lows, r"^\pL+$"))  # a run of letters is one piece
        two = pc.and_(plain, pc.match_substring_regex(lows, r"^\pL+[.,!?]$"))
        known = plain.to_numpy(zero_copy_only=False)
        ones, twos = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (one, two))
        rest = known.copy()
        rest[ones] = rest[twos] = False
        others = np.flatnonzero(rest)
        found = [self._pieces(x) for x in lows.filter(pa.array(rest)).to_pylist()]
        ended = lows.filter(two)
        coded = pa.concat_arrays(
            [lows.filter(one), pc.utf8_slice_codeunits(ended, 0, -1), pc.utf8_slice_codeunits(ended, -1),
             pa.array([x for part in found for x in part], pa.string())]
        ).dictionary_encode()
        # Pieces in the order of words: those of one piece, those of two, the others.
        at = coded.indices.to_numpy()
        a, b = len(ones), len(ones) + len(twos)
        at = np.concatenate([at[:a], np.stack([at[a:b], at[b : 2 * b - a]], 1).ravel(), at[2 * b - a :]])
        counts = np.concatenate([np.full(a, 1), np.full(b - a, 2), np.array([len(x) for x in found], np.int64)])
        ids = self._pieces_ids(coded.dictionary).take(at).joined(np.concatenate([[0], np.cumsum(counts)]))
        runs = ids.spread(np.concatenate([ones, twos, others]), len(words))
        at = np.flatnonzero(~known)
        return runs.put(at, [np.frombuffer(self.by_library(x), np.int32) for x in words.take(pa.array(at)).to_pylist()])

    def by_library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0].tobytes()

    def encode_many(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; null texts count as empty."""
        if not self.by_words:
            parts = [self.by_library(t or "") for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        found = self._word_ids(coded.dictionary).take(coded.indices.to_numpy()).joined(lists.offsets.to_numpy())
        return found.flat.view("<u4"), found.sizes

    def decode(self, ids: bytes) -> str:
        """What the library's ``decode(ids, skip_special_tokens=False)`` returns."""
        values = np.frombuffer(ids, "<u4").tolist()
        if self.joined_by_space:
            return " ".join(map(self.tokens.__getitem__, values))
        return self.library.decode(values, skip_special_tokens=False)

    def decode_many(self, flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The decoded texts of runs of ids."""
        if not self.joined_by_space:
            ends = np.cumsum(sizes)
            parts = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            return pa.array([self.decode(x) for x in parts], pa.large_string())
        names = self._names.take(pa.array(flat.view(np.int32)))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), names), pa.scalar(" ", pa.large_string()))


def give_back() -> None:
    """Return freed memory to the machine: a worker that waits for its next task, or runs
    another kind of task, should not hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _bounds(texts: pa.Array, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = min(int(np.searchsorted(ends, before + most_bytes)) + 1, at + most_rows, len(texts))
        yield at, end - at
        at = end


def text_slices(texts: pa.Array, most_bytes: int = 2 << 20, most_rows: int = 4096) -> Iterator[pa.Array]:
    """Parts of some ``most_bytes`` of text, or one text; freed memory is given back after."""
    yield from (texts.slice(at, n) for at, n in _bounds(texts, most_bytes, most_rows))
    give_back()


def slices(batch: pa.RecordBatch, column: int = 1, most_bytes: int = 2 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same of a batch, by the texts in ``column``."""
    yield from (batch.slice(at, n) for at, n in _bounds(batch.column(column), most_bytes, most_rows))
    give_back()


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """The worker's codec of a file; workers are reused, and so is its memo."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def default_path() -> str:
    """Vocabulary of the registered queries; operators take any path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
