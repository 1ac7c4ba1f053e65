"""Token ids of whole texts, with a word cache in front of the tokenizers library.

A byte-level BPE cuts a text before every single space that stands between two other characters, whatever follows, and
between an ASCII letter and an ASCII sign other than an apostrophe.  So the ids of a text are the ids of its pieces
between such places, and equal pieces are encoded once.  Spaces beside any white space, ASCII or not, are no cuts.  This
holds only for tokenizers without normaliser and with the usual byte-level splitting; for others, whole texts are
encoded.  So are texts that spell a special token, which the library takes out before it cuts.

Null texts are empty texts, and those have no ids.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textscan import _binary

#: Letters of a few scripts, perhaps after a space: one unit for the tokenizer's model.
_PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f]+")
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SIGN = np.array([32 < b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 ones are themselves, the others follow from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the tokenizer file at ``path``; at most ``cache`` pieces are remembered."""

    def __init__(self, path: str, cache: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        pre = form.get("pre_tokenizer") or {}
        self.cuts = not form.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.plain = bool(self.cuts) and (form.get("model") or {}).get("type") == "BPE"
        self.special = "|".join(re.escape(t["content"]) for t in form.get("added_tokens") or ())
        self.limit = cache
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.end = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _spelled(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces in one row, and how many each has."""
        out: list[list[int]] = []
        rest: list[int] = []
        tokenize = self.tokenizer.model.tokenize if self.plain else None
        for i, piece in enumerate(pieces):
            if tokenize and (piece[1:] if piece[0] == 32 else piece).isalpha():  # ASCII letters
                text = piece.decode()
                out.append([t.id for t in tokenize("\u0120" + text[1:] if piece[0] == 32 else text)])
            elif tokenize and _PLAIN.fullmatch(piece.decode("utf-8", "replace")):
                out.append([t.id for t in tokenize(piece.decode("latin-1").translate(_BYTE_LETTERS))])
            else:
                rest.append(i)
                out.append([])
        done = self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)
        for i, e in zip(rest, done, strict=True):
            out[i] = e.ids
        return np.fromiter(chain.from_iterable(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def _learn(self, pieces: list[bytes]) -> None:
        flat, sizes = self._spelled(pieces)
        while self.end + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        n = len(self.known)
        while n + len(pieces) > len(self.first):
            self.first, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.size))
        self.size[n : n + len(pieces)] = sizes
        self.first[n : n + len(pieces)] = self.end + np.cumsum(sizes) - sizes
        self.ids[self.end : self.end + len(flat)] = flat
        self.end += len(flat)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of all texts begin, with the end of the last."""
        if not self.cuts or len(data) < 5:
            return np.unique(offsets)
        at = np.flatnonzero(data == 32)
        at = at[(at > 2) & (at < len(data) - 1)]
        before, after = data[at - 1], data[at + 1]
        odd = (before >= 128) & ((data[at - 2] == 0xC2) | ((data[at - 2] >= 128) & (data[at - 3] >= 0xE1) & (data[at - 3] <= 0xE3)))
        odd |= (before <= 32) | (after <= 32) | (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
        signs = np.flatnonzero(_SIGN[data[1:]] & _LETTER[data[:-1]]) + 1
        starts = np.sort(np.concatenate((at[~odd], signs, offsets)), kind="stable")
        return starts[np.append(True, starts[1:] != starts[:-1])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in row order, and the offset of each row in them; null is empty."""
        if self.special:
            odd = np.flatnonzero(pc.match_substring_regex(texts, self.special).fill_null(False).to_numpy(zero_copy_only=False))
            if len(odd):
                return self._with_special(texts, odd)
        return self._cut_and_encode(texts)

    def _with_special(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``; the texts at ``odd`` are encoded whole."""
        mask = np.zeros(len(texts), bool)
        mask[odd] = True
        ids, offsets = self._cut_and_encode(pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts))
        whole = [self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in odd]
        sizes = np.diff(offsets)
        sizes[odd] = [len(w) for w in whole]
        at = np.repeat(offsets[odd], sizes[odd])
        return np.insert(ids, at, np.fromiter(chain.from_iterable(whole), np.uint32)), np.append(0, np.cumsum(sizes))

    def _cut_and_encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = _binary(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(data) > 1 << 30:
            half = len(texts) // 2
            if half:
                a, b = self._cut_and_encode(texts.slice(0, half)), self._cut_and_encode(texts.slice(half))
                return np.concatenate((a[0], b[0])), np.concatenate((a[1], a[1][-1] + b[1][1:]))
        starts = self._pieces(data, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.limit:
            self._forget()
        new = [p for p in distinct if p not in self.known]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        sizes = self.size[which]
        # pieces are learnt one after the other, so their ids are the values of one list array
        n = len(self.known)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(self.first[:n], self.end)), pa.array(self.ids[: self.end]))
        indices = coded.indices.to_numpy()
        ids = lists.take(pa.array(which[indices])).flatten().to_numpy()
        ends = np.cumsum(sizes[indices])
        # a text begins with a piece; empty texts begin where the next one does
        return ids, np.append(0, ends)[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
