"""Token ids of whole texts by a public tokenizer file, with the ids of pieces met before kept for the next texts.

Texts are cut at single spaces where the tokenizer cuts too, equal pieces of a batch are found by Arrow, and only
pieces not met before go through the tokenizer. A text in which such a cut could matter goes through it whole.
The ids equal those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .texts import U64, bytes_of, held, mix, ragged, string_hashes

#: bytes of pieces and their ids that an encoder keeps; beyond that it starts anew
KEPT = 64 << 20
MARKS = frozenset(".,;:!?")
#: white space, a space, then white space, the end or a special token: a cut at that space may differ
UNSAFE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}] ([\s\p{Z}\x{85}\x{1c}-\x{1f}<]|$)"
SPACED = U64(0xA0761D6478BD642F)


def encoder(path: str, spaceless: bool, kept: int = KEPT) -> Encoder:
    """The process's encoder for a file. ``spaceless``: the tokenizer drops white space and lower-cases.

    The process keeps one, with its pieces, for the next task that encodes; a task of another kind lets it go.
    """
    key = ("encoder", path, spaceless, kept)
    if key not in held:
        held.clear()
        held[key] = Encoder(path, spaceless, kept)
    return held[key]


class _Known:
    """Ids by the hash of a piece: sorted keys, and where each one's ids lie in one pool."""

    def __init__(self):
        self.key = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def size_in_bytes(self) -> int:
        return self.key.nbytes + self.start.nbytes + self.size.nbytes + self.pool.nbytes

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entry of every key, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def add(self, key: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Distinct keys that are not here yet, in any order."""
        start = np.cumsum(size) - size + len(self.pool)
        order = np.argsort(key)
        at = np.searchsorted(self.key, key[order])
        self.key = np.insert(self.key, at, key[order])
        self.start = np.insert(self.start, at, start[order])
        self.size = np.insert(self.size, at, size[order].astype(np.int32))
        self.pool = np.concatenate([self.pool, ids])


def _keys(pieces: pa.Array, spaced: np.ndarray | bool) -> np.ndarray:
    h = string_hashes(*bytes_of(pieces))
    with np.errstate(over="ignore"):
        return mix(np.where(spaced, h ^ SPACED, h))


class Encoder:
    def __init__(self, path: str, spaceless: bool, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaceless, self.kept = Tokenizer.from_file(path), spaceless, kept
        self.known = _Known()

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        size = []
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = found.ids
            size.append(len(ids))
            flat += ids
        return np.array(flat, np.uint32), np.array(size, np.int64)

    def _letters(self, piece: str) -> bool:
        return (piece.lower() if self.spaceless else piece).isalpha()

    def _parts(self, piece: str, spaced: bool) -> tuple[tuple[str, bool], ...]:
        """A piece as parts that the tokenizer keeps apart: words of letters, a mark, a line end; else the piece."""
        head, line, tail = piece.partition("\n")
        if line and tail:
            a, b = self._parts(head, spaced), self._parts(tail, False)
            if self._letters(a[0][0]) and self._letters(b[0][0]) and a[-1][0] and "\n" not in tail:
                return (*a, ("\n", False), *b)
            return ((piece, spaced),)
        if piece[-1:] in MARKS and self._letters(piece[:-1]):
            return ((piece[:-1], spaced), (piece[-1], False))
        return ((piece, spaced),)

    def _learn(self, pieces: list[str], spaced: np.ndarray, keys: np.ndarray) -> None:
        """Encode pieces that are not known: their parts first, then each piece from its parts."""
        parts = [self._parts(p, s) for p, s in zip(pieces, spaced.tolist(), strict=True)]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = [x for p in parts for x in p]
        text = [x[0] for x in flat]
        wide = np.fromiter((x[1] for x in flat), bool, len(flat))
        part_keys = _keys(pa.array(text, pa.large_string()), wide)
        fresh, first = np.unique(part_keys, return_index=True)
        first = first[self.known.find(fresh) < 0]
        if len(first):
            ids, size = self._raw([" " + text[i] if wide[i] else text[i] for i in first.tolist()])
            self.known.add(part_keys[first], size, ids)
        several = count > 1
        if several.any():
            at = self.known.find(part_keys[np.repeat(several, count)])
            size, start = self.known.size[at].astype(np.int64), self.known.start[at]
            whole = np.add.reduceat(size, np.cumsum(count[several]) - count[several])
            self.known.add(keys[several], whole, self.known.pool[ragged(size, start)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each. Null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = np.zeros(n, bool)
        cut = texts
        if self.spaceless:
            cut = pc.replace_substring(texts, "\n", " ")
        else:
            whole = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
            if whole.any():
                cut = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts)
        lists = pc.split_pattern(cut, " ")
        off = lists.offsets.to_numpy().astype(np.int64)
        off, flat = off - off[0], lists.flatten()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        pieces, spaced = coded.dictionary, np.zeros(len(coded.dictionary), bool)
        if not self.spaceless:  # a text's first piece has no space before it
            first = flat.take(pa.array(off[:-1])).dictionary_encode()
            codes[off[:-1]] = first.indices.to_numpy() + len(pieces)
            spaced = np.arange(len(pieces) + len(first.dictionary)) < len(pieces)
            pieces = pa.concat_arrays([pieces, first.dictionary])
        if self.known.size_in_bytes() > self.kept:
            self.known = _Known()
        keys = _keys(pieces, spaced)
        new = self.known.find(keys) < 0
        if new.any():
            self._learn(pieces.filter(pa.array(new)).to_pylist(), spaced[new], keys[new])
        at = self.known.find(keys)[codes]
        lengths = self.known.size[at].astype(np.int64)
        out = self.known.pool[ragged(lengths, self.known.start[at])]
        per = np.add.reduceat(lengths, off[:-1])
        if whole.any():
            raw, per[whole] = self._raw(texts.filter(pa.array(whole)).to_pylist())
            marks = np.repeat(whole, per)
            both = np.empty(len(marks), np.uint32)
            both[~marks], both[marks] = out, raw
            out = both
        return out, per

    def encode_ended(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the id ``end`` after each text."""
        ids, per = self.encode(texts)
        out = np.full(len(ids) + len(per), end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(per + 1) - 1] = False
        out[keep] = ids
        return out, per + 1
