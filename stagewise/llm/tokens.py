"""Tokenizing whole texts with a public vocabulary file.

The word tokenizer drops white space, so a text's ids are the ids of its
space-separated chunks one after another. Its splitting pattern is read from the
file; a file whose steps are others is refused, as chunks could not stand alone. Each chunk is encoded once per worker
and looked up by its hash afterwards; ids of a slice of texts are gathered with numpy.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .text import Words

TOKENIZER = "word_bpe_49k.json"
#: Chunks that a Python worker remembers from task to task; beyond it the cache starts anew.
CACHE_CHUNKS = 600_000
#: Parts of chunks that it remembers besides, which only new chunks need.
CACHE_PARTS = 150_000
#: Parts encoded in one call, which bounds the library's objects.
ENCODE_AT_ONCE = 4096

#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Stands between chunks that are split together.
_BREAK = "\n"


def default_path(name: str = TOKENIZER) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splitting_pattern(path: str) -> regex.Pattern:
    """The pattern of a file that keeps matches of one regex in lower-cased text, as bytes; line ends match as well."""
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)
    normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
    split, *rest = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    drops_space = split.get("behavior") == "Removed" and split.get("invert") and "\\s" in split.get("pattern", {}).get("Regex", "")
    if normal != ["NFC", "Replace", "Lowercase"] or not drops_space or [x.get("type") for x in rest] != ["ByteLevel"] or rest[0].get("add_prefix_space") or steps["post_processor"]:
        raise ValueError(f"{path}: not a lower-casing word tokenizer that drops white space")
    return regex.compile(split["pattern"]["Regex"] + "|" + _BREAK)


class _Runs:
    """Numbered runs of ids in one growing flat array."""

    def __init__(self):
        self.start, self.length, self.flat = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64), np.zeros(4096, dtype=np.int32)
        self.count = self.used = 0

    def add(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        n, used = self.count + len(lengths), self.used + len(ids)
        if n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * n), np.resize(self.length, 2 * n)
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        self.length[self.count : n] = lengths
        self.start[self.count : n] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : used] = ids
        self.count, self.used = n, used

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs one after another, and their n+1 offsets."""
        lengths = self.length[which]
        ends = np.append(0, np.cumsum(lengths))
        return self.flat[np.repeat(self.start[which] - ends[:-1], lengths) + np.arange(ends[-1])], ends


class ChunkTokenizer:
    """Ids of texts by a ``tokenizers`` file whose pre-tokenizer drops white space."""

    def __init__(self, path: str, encode_special: bool = False):
        # executors run one task a core; threads of the library only add work
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special
        self.merge = self.tokenizer.model.tokenize
        self.split = splitting_pattern(path)
        self._forget()

    def _forget(self) -> None:
        #: Sorted hashes of known chunks, and the numbers of their runs.
        self.known, self.number = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.chunk_ids = _Runs()
        self._forget_parts()

    def _forget_parts(self) -> None:
        self.parts: dict[str, int] = {_BREAK: 0}
        self.part_ids = _Runs()
        self.part_ids.add(np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32))

    def _part_numbers(self, texts: list[str], split: bool) -> np.ndarray:
        """Numbers of parts; those not met before are encoded, split ones by the model alone."""
        parts = self.parts
        new = list({p for p in texts if p not in parts})
        for i in range(0, len(new), ENCODE_AT_ONCE):
            some = new[i : i + ENCODE_AT_ONCE]
            if split:
                found = [[t.id for t in self.merge(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTE_CHARS))] for p in some]
            else:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.part_ids.add(lengths, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(lengths.sum())))
            parts.update(zip(some, range(len(parts), len(parts) + len(some))))
        return np.fromiter(map(parts.__getitem__, texts), dtype=np.int64, count=len(texts))

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers of new chunks, looked up by parts, so that ``word`` and ``Word,`` share work.

        Below U+0100 lower-casing goes letter by letter and text is in NFC; a
        chunk with other characters, or one that may hold a special token, is one part.
        """
        out = np.empty(len(chunks), dtype=np.int64)
        whole = np.fromiter((b"<|" in c or max(c) >= 0xC4 for c in chunks), dtype=bool, count=len(chunks))
        for which, split in ((np.flatnonzero(~whole), True), (np.flatnonzero(whole), False)):
            if not len(which):
                continue
            some = [chunks[i] for i in which.tolist()]
            if split:
                # no chunk holds a line end, so that it can stand between chunks
                parts = self.split.findall(_BREAK.join([c.decode("utf-8", "replace") for c in some]).lower())
                number = self._part_numbers(parts, True)
                breaks = np.flatnonzero(number == 0)
                counts = np.diff(np.concatenate([[-1], breaks, [len(number)]])) - 1
                number = number[number > 0]
            else:
                number, counts = self._part_numbers([c.decode("utf-8", "replace") for c in some], False), np.ones(len(some), dtype=np.int64)
            ids, ends = self.part_ids.take(number)
            out[which] = self.chunk_ids.count + np.arange(len(which))
            self.chunk_ids.add(np.diff(ends[np.append(0, np.cumsum(counts))]), ids)
        return out

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice with ``end_id`` after each, and n+1 offsets."""
        if len(self.known) > CACHE_CHUNKS:
            self._forget()
        if len(self.parts) > CACHE_PARTS:
            self._forget_parts()
        # equal chunks of the slice are looked up once, and read as bytes only if they are new
        words = Words(data, off, lower=False)
        hashes, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != hashes
        if new.any():
            raw, ones = data.tobytes(), first[new]
            learned = self._learn([raw[a:b] for a, b in zip(words.start[ones].tolist(), words.end[ones].tolist())])
            self.known, self.number = np.insert(self.known, at[new], hashes[new]), np.insert(self.number, at[new], learned)
            at = np.searchsorted(self.known, hashes)
        ids, ends = self.chunk_ids.take(self.number[at][place])
        before = ends[words.bounds]
        out = np.empty(len(ids) + len(off) - 1, dtype=np.int32)
        offsets = before + np.arange(len(before))
        last = offsets[1:] - 1
        mask = np.ones(len(out), dtype=bool)
        mask[last] = False
        out[mask], out[last] = ids, end_id
        return out, offsets


_encoders: dict[tuple[str, bool], ChunkTokenizer] = {}


def shared_tokenizer(path: str, encode_special: bool = False) -> ChunkTokenizer:
    """The worker's tokenizer for a file, with what earlier tasks have looked up."""
    key = (path, encode_special)
    if key not in _encoders:
        _encoders[key] = ChunkTokenizer(path, encode_special)
    return _encoders[key]


def int_array(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))
