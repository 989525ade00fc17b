"""Subword ids of whole Arrow string columns, equal to the tokenizer's own, by way of a cache of white-space chunks.

White space never lies inside a pre-token of the vocabulary used, so a text's ids are its chunks' ids in order. Letters with
punctuation after them are two parts, found for a whole slice at once; other chunks are one. Each distinct part is encoded
once in a worker.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netquarry.llm import _text

VOCABULARY = "word_bpe_49k.json"
#: Parts of chunks held by a worker before those go that were met in one slice only; bounds memory only.
CACHED = 400_000

# The vocabulary's own pre-token rule for lower-case ASCII without white space.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_TAIL = re.compile(r"[!-/:-@\[-`{-~]+$")
# Pieces the tokenizer's normaliser only lower-cases: printable ASCII, and Latin letters that stand composed.
_LETTERS = re.compile(r"[a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0132-\u0148\u014A-\u017F]+")
_PLAIN = re.compile(rf"[!-~]+|{_LETTERS.pattern}")
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _byte_letters()


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Subwords:
    _by_path: dict[str, Subwords] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> Subwords:
        """One for each worker process."""
        path = vocabulary_path(path)
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def finals(self) -> np.ndarray:
        """Which ids end a pre-token."""
        table = np.zeros(1 << 16, dtype=bool)
        table[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>") or t.startswith("<|")]] = True
        return table

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self._flat, self._starts, self._lengths = array("H"), array("q"), array("i")
        self.met = np.zeros(0, dtype=np.int32)
        self._view()

    def _shrink(self) -> None:
        """Keep the parts met most often, half of the bound at most, and those only that were met again."""
        least = max(2, int(np.partition(self.met, -(CACHED // 2))[-(CACHED // 2)]) + 1)
        kept = np.flatnonzero(self.met >= least)
        names, ids = list(self.index), self.flat[_text.ragged(self.starts[kept], self.lengths[kept].astype(np.int64))]
        lengths, met = self.lengths[kept], self.met[kept] // 2
        names = [names[k] for k in kept.tolist()]
        self._reset()
        self.index = {name: k for k, name in enumerate(names)}
        self._flat.frombytes(ids.tobytes())
        self._lengths.frombytes(lengths.astype(np.int32).tobytes())
        self._starts.frombytes((np.cumsum(lengths, dtype=np.int64) - lengths).tobytes())
        self.met = met
        self._view()

    def _view(self) -> None:
        self.flat, self.starts, self.lengths = (np.frombuffer(a.tobytes(), dtype=k) for a, k in ((self._flat, np.uint16), (self._starts, np.int64), (self._lengths, np.int32)))

    @staticmethod
    def _split(chunk: str) -> list[str]:
        if "<|" in chunk:
            return [chunk]
        if chunk.isascii():
            low = chunk.lower()
            return [low] if low.isalpha() else _ASCII_PIECES.findall(low)
        if m := _TAIL.search(chunk):
            if chunk[: m.start()].lower().isalpha():  # a mark that lower-casing sets apart goes with the punctuation
                return [chunk[: m.start()], m[0]]
        return [chunk]

    def _place(self, name: str, ids) -> None:
        self.index[name] = len(self._starts)
        self._starts.append(len(self._flat))
        self._lengths.append(len(ids))
        self._flat.extend(ids)

    def _encoded(self, pieces: list[str]) -> None:
        """Place new pieces. Plain ones go to the tokenizer's model as they are, others through all its steps."""
        tokenize, place, full = self.tokenizer.model.tokenize, self._place, []
        for p in pieces:
            if "<|" in p or p and not _PLAIN.fullmatch(p):
                full.append(p)
                continue
            body = p if p.isascii() else p.lower().encode().decode("latin-1").translate(_BYTES)
            place(p, [t.id for t in tokenize(body)])
        for p, e in zip(full, self.tokenizer.encode_batch(full, add_special_tokens=False) if full else (), strict=True):
            place(p, e.ids)

    def _whole(self, chunks: list[str]) -> None:
        """Place new chunks that are not letters with punctuation after them."""
        split = list(map(self._split, chunks))
        self._encoded(list({p for s in split for p in s if p not in self.index}))
        flat, starts, lengths = self._flat, self._starts, self._lengths
        for c, s in zip(chunks, split, strict=True):
            if c not in self.index:
                at = [self.index[p] for p in s]
                self._place(c, [i for k in at for i in flat[starts[k] : starts[k] + lengths[k]]])

    def _places(self, names: list[str], add) -> np.ndarray:
        """Cache places of distinct names; ``add`` places those that are new (it may leave some out: -1)."""
        get = self.index.get
        place = list(map(get, names))
        missing = [k for k, p in enumerate(place) if p is None]
        if missing:
            add([names[k] for k in missing])
            for k in missing:
                place[k] = get(names[k], -1)
        return np.array(place, dtype=np.int64)

    def _letters(self, cores: list[str]) -> None:
        self._encoded([c for c in cores if not c or (c.isalpha() if c.isascii() else _LETTERS.fullmatch(c))])

    def _parts(self, names: pa.Array) -> np.ndarray:
        """Cache places of the two parts of each distinct chunk: its letters and the punctuation after them; or the chunk as it is
        and nothing."""
        low = pc.ascii_lower(names)
        core = pc.ascii_rtrim(low, _MARKS)
        raw, offsets = _text.flat(low)
        ends, sizes = offsets[1:], np.diff(offsets) - np.asarray(pc.binary_length(core)).astype(np.int64)
        coded = core.dictionary_encode()
        out = np.full((len(names), 2), -1, dtype=np.int64)
        out[:, 0] = self._places(coded.dictionary.to_pylist(), self._letters)[np.asarray(coded.indices)]
        marked = np.flatnonzero((sizes > 0) & (out[:, 0] >= 0))
        bounds = np.concatenate([[0], np.cumsum(sizes[marked])]).astype(np.int64)
        tails = pa.Array.from_buffers(pa.large_string(), len(marked), [None, pa.py_buffer(bounds), pa.py_buffer(raw[_text.ragged(ends[marked] - sizes[marked], sizes[marked])])]).dictionary_encode()
        empty = self._places([""], self._letters)[0]
        out[out[:, 0] >= 0, 1] = empty
        if len(marked):
            out[marked, 1] = self._places(tails.dictionary.to_pylist(), self._encoded)[np.asarray(tails.indices)]
        rest = np.flatnonzero(out[:, 0] < 0)
        if len(rest):
            out[rest, 0] = self._places(names.take(pa.array(rest)).to_pylist(), self._whole)
            out[rest, 1] = empty
        return out

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, how many of them each white-space chunk has, and the bounds of the rows among the
        chunks."""
        if len(self.index) > CACHED:
            self._shrink()
        column = column.fill_null("") if column.null_count else column
        parts = pc.ascii_split_whitespace(column)
        bounds = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        place = self._parts(coded.dictionary)
        self._view()
        self.met = np.concatenate([self.met, np.zeros(len(self.index) - len(self.met), dtype=np.int32)])
        self.met[place.reshape(-1)] += 1  # once a slice
        sizes = self.lengths[place].astype(np.int64)
        own = self.flat[_text.ragged(self.starts[place].reshape(-1), sizes.reshape(-1))]  # the ids of each distinct chunk
        sizes = sizes.sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        codes = np.asarray(coded.indices)
        blank = coded.dictionary.index("").as_py()
        if blank >= 0:
            real = codes != blank
            codes, bounds = codes[real], np.concatenate([[0], np.cumsum(real)])[bounds]
        sizes = sizes[codes]
        return own[_text.ragged(starts[codes], sizes)], sizes, bounds

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text."""
        ids, sizes, bounds = self.words(column)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[bounds]


def discharge() -> None:
    """Let go of the caches of a worker whose task encodes nothing, and give its free memory back to the system."""
    Subwords._by_path.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass
