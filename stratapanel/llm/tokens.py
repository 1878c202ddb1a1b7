"""Token ids of whole texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from stratapanel.llm.arrays import PrefixHash, pieces, words_of

#: The vocabulary's own end-of-text string; texts that hold it go to the tokenizer as they are.
SPECIAL = b"<|endoftext|>"
_SPACES, _ODD = np.zeros(256, bool), np.zeros(256, bool)
_SPACES[list(b" \t\n\r\f\v")] = True
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = True
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[32] = True


def _whole(data: np.ndarray, raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """Which texts are encoded whole: a blank meets other white space, or there are odd bytes or the end-of-text string."""
    space = _SPACES[data]
    blank = data == 32
    found = [(np.flatnonzero(_ODD[data]), 1), (np.flatnonzero(blank[:-1] & blank[1:]), 2), (np.flatnonzero(space[:-2] & blank[1:-1] & space[2:]), 3)]
    if SPECIAL in raw:
        found.append((np.array([m.start() for m in re.finditer(re.escape(SPECIAL), raw)]), len(SPECIAL)))
    out = np.zeros(len(offsets) - 1, bool)
    for at, width in found:
        owner = np.searchsorted(offsets, at, side="right") - 1
        out[owner[at + width <= offsets[owner + 1]]] = True
    return out


class Encoder:
    """Encodes Arrow text columns; a word with its leading blank is encoded once and then looked up.

    The vocabulary's splitting rule always cuts in front of a single blank that follows a
    non-blank, so the ids of a text are the ids of its blank-led words, one after the other.
    Texts in which blanks meet other white space are encoded whole.  The word table holds at most
    ``capacity`` entries and starts again when full.
    """

    def __init__(self, path: str, capacity: int = 600_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = _ranks_encoder(path)
        self.capacity = capacity
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def encode(self, text: str) -> list[int]:
        if self.fast is None or SPECIAL.decode() in text:
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def _add(self, keys: list[int], units: list[bytes]) -> None:
        """Enters new words, all in one go."""
        plain, flat, lengths = self.fast if not any(SPECIAL in u for u in units) else None, [], []
        for unit in units:
            got = plain.encode_ordinary(unit.decode("utf-8", "replace")) if plain else self.encode(unit.decode("utf-8", "replace"))
            flat += got
            lengths.append(len(got))
        n, new = len(self.index), len(units)
        while n + new > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[n : n + new] = lengths
        self.start[n : n + new] = self.used + np.cumsum([0, *lengths[:-1]])
        self.used += len(flat)
        self.index.update(zip(keys, range(n, n + new), strict=True))

    def column(self, texts: pa.Array):
        """Yields the ids (uint32 array) of each text, in order; null counts as empty."""
        for _, _, data, offsets in pieces(texts):
            raw = data.tobytes()
            whole = _whole(data, raw, offsets)
            # Texts in a row that are looked up word by word go together.
            edges = [0, *(np.flatnonzero(whole[1:] | whole[:-1]) + 1).tolist(), len(whole)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                a, b = int(offsets[i]), int(offsets[j])
                if j > i and whole[i]:
                    yield np.asarray(self.encode(raw[a:b].decode("utf-8", "replace")), np.uint32)
                elif j > i:
                    yield from self._piece(data[a:b], raw[a:b], offsets[i : j + 1] - a)

    def _piece(self, data: np.ndarray, raw: bytes, offsets: np.ndarray):
        if not raw:
            yield from [np.zeros(0, np.uint32)] * (len(offsets) - 1)
            return
        starts, ends, owner = words_of(data, offsets, _ONLY_SPACE)
        starts = starts - ((starts > offsets[owner]) & (data[np.maximum(starts - 1, 0)] == 32))
        # A blank that ends a text is a word of its own.
        tail = np.flatnonzero((offsets[1:] > offsets[:-1]) & (data[np.maximum(offsets[1:] - 1, 0)] == 32))
        if len(tail):
            starts, ends, owner = np.concatenate([starts, offsets[tail + 1] - 1]), np.concatenate([ends, offsets[tail + 1]]), np.concatenate([owner, tail])
            order = np.argsort(starts, kind="stable")
            starts, ends, owner = starts[order], ends[order], owner[order]
        keys, first, inverse = np.unique(PrefixHash(data).spans(starts, ends), return_index=True, return_inverse=True)
        if len(self.index) + len(keys) > self.capacity:
            self._clear()
        known = keys.tolist()
        rows = np.fromiter(map(self.index.get, known, repeat(-1)), np.int64, len(known))
        if len(missing := np.flatnonzero(rows < 0)):
            places, n = first[missing], len(self.index)
            self._add(keys[missing].tolist(), [raw[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)])
            rows[missing] = np.arange(n, n + len(missing))
        rows = rows[inverse]
        lengths = self.length[rows]
        total = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.ids[np.repeat(self.start[rows] - total[:-1], lengths) + np.arange(total[-1])]
        bounds = total[np.searchsorted(owner, np.arange(len(offsets)))]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield flat[a:b]


def _ranks_encoder(path: str):
    """The same vocabulary as ranks, if such a file lies beside ``path``; it gives the same ids faster."""
    import base64
    import os

    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_path):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its word table lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
