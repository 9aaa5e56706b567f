"""Token ids of texts by remembered chunks, for byte-level vocabularies.

Their pre-tokenizer pattern looks only ahead, and no piece of it runs from a
visible character into white space, from a letter into punctuation, or from a
lone line break into a letter. A text may be cut there, and the chunks coded one
by one give the ids of the whole text. Chunks are found and hashed on the bytes
of many texts at once; only chunks that a worker has not met are coded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import _BYTE, _MULTIPLIER, _SPACE, mix, powers

#: Chunks that a worker remembers; beyond it the memory starts afresh. It bounds
#: memory (some 50 bytes a chunk) and changes no result.
REMEMBERED = 300_000
_CHECK = mix(_BYTE ^ np.uint64(0xA5A5A5A5A5A5A5A5))


_CODES = np.arange(256)
_LETTER = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122))
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_VISIBLE = (_CODES > 0x20) & (_CODES < 0x7F)
_PUNCT = _VISIBLE & ~_LETTER & ~_DIGIT
_BREAK = _SPACE & (_CODES != 0x20)
_LATIN_LEAD = 0xC3  # first byte of U+00C0 to U+00FF, all of them visible


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of texts that hold a byte, and the safe cuts inside texts.

    Next to other bytes above 0x7F, which may be white space, a text is not cut.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        visible = _VISIBLE[data]
        ends = visible.copy()  # a visible character ends here
        ends[1:] |= data[:-1] == _LATIN_LEAD
        cut[1:] = (_SPACE[data[1:]] & ends[:-1]) | (_PUNCT[data[1:]] & _LETTER[data[:-1]])
        cut[2:] |= _BREAK[data[1:-1]] & ends[:-2] & (visible[2:] | (data[2:] == _LATIN_LEAD))
        inner = offsets[1:-1]
        inner = inner[inner < n]
        cut[inner[inner + 1 < n] + 1] &= ~_BREAK[data[inner[inner + 1 < n]]]  # its left side is another text
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class ChunkCoder:
    """``code`` turns a list of texts into (ids of all, number of ids of each);
    ``cuts`` finds the starts of chunks that it may code one by one."""

    def __init__(self, code: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cuts: Callable[[np.ndarray, np.ndarray], np.ndarray] = chunk_starts, remembered: int = REMEMBERED):
        self.code, self.cuts, self.remembered = code, cuts, remembered
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # by ascending key
        self.check, self.sizes, self.starts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids up to the end of each text)."""
        starts = self.cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        n = len(data)
        total, other = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(n, _MULTIPLIER), out=total[1:])
        np.cumsum(_CHECK[data], out=other[1:])
        key = mix((total[ends] - total[starts]) * powers(n, pow(_MULTIPLIER, -1, 1 << 64))[starts])
        check = (other[ends] - other[starts]) ^ (ends - starts).astype(np.uint64)
        own, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.place) > self.remembered:
            self.clear()
        spot = np.searchsorted(self.keys, own)
        met = np.append(self.keys, own[-1:] + np.uint64(1))[spot] == own
        at, new = np.append(self.place, -1)[spot], np.flatnonzero(~met)
        if len(new):
            raw = data.tobytes()
            pick = first[new]
            ids, sizes = self.code([raw[a:b].decode() for a, b in zip(starts[pick].tolist(), ends[pick].tolist())])
            at[new] = len(self.sizes) + np.arange(len(new))
            self.keys, self.place = np.insert(self.keys, spot[new], own[new]), np.insert(self.place, spot[new], at[new])
            self.check = np.append(self.check, check[pick])
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.flat = np.append(self.flat, ids.astype(np.int32))
        place = at[back]
        if (self.check[place] != check).any():
            raise ArithmeticError("two chunks share a hash")
        sizes = self.sizes[place]
        upto = np.cumsum(sizes)
        out = self.flat[np.repeat(self.starts[place] - upto + sizes, sizes) + np.arange(upto[-1])]
        chunk = np.searchsorted(starts, offsets[1:])
        return out, np.append(0, upto)[chunk]
