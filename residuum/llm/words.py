"""Word-wise encoding with a ``tokenizers`` vocabulary file, remembered by word.

The vocabulary splits texts at white space before anything else, so the values
(ids, counts) of a text are those of its blank-separated pieces in order.  A
full stop or comma after an ASCII letter at a piece's end always stands alone,
so it is a piece of its own here.  Each distinct piece is worked out once per
worker; everything else is array work on the pieces' hashes.
"""

from __future__ import annotations

import os
import re

import numpy as np

from residuum.llm.bytewords import BLANKS, LOWERED, byte_class, prefix_sums, stretch_hash, words_before, words_of

#: Pieces of letters whose lower-casing and splitting are the same everywhere.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Bound of one worker's memory of pieces; at the bound it is emptied.
MAX_PIECES = 700_000
#: Longer pieces are worked out each time.
MAX_PIECE = 64

_MARKS = byte_class(b".,")
_LETTERS = byte_class(bytes(range(65, 91)) + bytes(range(97, 123)))


class Pieces:
    """The pieces of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begins, ends = words_of(data, offsets, BLANKS)
        if len(begins):
            cut = (ends - begins > 1) & _MARKS[data[ends - 1]] & _LETTERS[data[np.maximum(ends - 2, 0)]]
            marks = ends[cut] - 1
            flag = np.zeros(len(data) + 1, bool)
            flag[begins] = flag[marks] = True
            begins = np.flatnonzero(flag)
            flag[:] = False
            flag[ends] = flag[marks] = True
            ends = np.flatnonzero(flag)
            # ASCII pieces are lower-cased at once, unless they may hold a special string
            odd = np.concatenate([[0], np.cumsum((data >= 128) | (data == 60))])
            keep = (odd[ends] - odd[begins]) > 0
            low = LOWERED[data]
            if keep.any():
                step = np.zeros(len(data) + 1, np.int8)
                step[begins[keep]] += 1
                step[ends[keep]] -= 1
                raw = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
                low[raw] = data[raw]
            data = low
        self.data, self.begins, self.ends = data, begins, ends
        self.rows = words_before(offsets, begins)
        self.keys = stretch_hash(prefix_sums(data), begins, ends) if len(begins) else np.zeros(0, np.uint64)

    def texts(self, at: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode() for a, b in zip(self.begins[at].tolist(), self.ends[at].tolist())]


class PieceMemory:
    """Integer sequences of pieces by hash; ``work_out`` gives unknown ones.

    ``look_up`` returns, for every piece of a slice, where its sequence begins
    in ``pool`` and how long it is.
    """

    def __init__(self, work_out, dtype):
        self.work_out, self.dtype = work_out, np.dtype(dtype)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def look_up(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        keys, first, back = np.unique(pieces.keys, return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > MAX_PIECES:
            self._clear()
        place = np.searchsorted(self.known, keys)
        found = np.zeros(len(keys), bool)
        inside = place < len(self.known)
        found[inside] = self.known[place[inside]] == keys[inside]
        new = np.flatnonzero(~found)
        if len(new):
            sequences = self.work_out(pieces.texts(first[new]))
            lengths = np.fromiter(map(len, sequences), np.int64, len(new)) // self.dtype.itemsize
            starts = len(self.pool) + np.concatenate([[0], np.cumsum(lengths)[:-1]])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(sequences), self.dtype)])
            self.known = np.insert(self.known, place[new], keys[new])
            self.at = np.insert(self.at, place[new], starts)
            self.length = np.insert(self.length, place[new], lengths)
            place = np.searchsorted(self.known, keys)
        return self.at[place][back], self.length[place][back]


class WordEncoder:
    """Encodes slices of texts; equal to the library's
    ``encode(text, add_special_tokens=False).ids`` for each text."""

    def __init__(self, vocabulary: str, width: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.dtype = np.dtype(f"<u{width}")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if size > 1 << (8 * width):
            raise ValueError(f"ids of {vocabulary} do not fit {width} bytes")
        self.word_end = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.memory = PieceMemory(self.work_out, self.dtype)

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def work_out(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as bytes, in a few calls of the library."""
        out: list[bytes] = [b""] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if PLAIN.fullmatch(p)] if self.word_end.any() else []
        chosen = set(plain)
        odd = [i for i in range(len(pieces)) if i not in chosen]
        for at in range(0, len(plain), 2000):
            part = plain[at:at + 2000]
            ids = np.array(self._encode(" ".join(pieces[i] for i in part)).ids, self.dtype)
            cuts = np.flatnonzero(self.word_end[ids]) + 1
            if len(cuts) == len(part):
                self._cut(ids, cuts, part, out)
            else:
                odd += part
        for at in range(0, len(odd), 500):
            part = odd[at:at + 500]
            enc = self._encode(" ".join(pieces[i] for i in part))
            ids = np.array(enc.ids, self.dtype)
            lengths = np.array([len(pieces[i]) + 1 for i in part])
            begins = np.array([a for a, _ in enc.offsets], np.int64)
            self._cut(ids, np.searchsorted(begins, np.cumsum(lengths)), part, out)
        return out

    def _cut(self, ids: np.ndarray, cuts: np.ndarray, part: list[int], out: list[bytes]) -> None:
        raw, last = ids.tobytes(), 0
        for i, cut in zip(part, (cuts * self.dtype.itemsize).tolist()):
            out[i] = raw[last:cut]
            last = cut

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the border of each."""
        pieces = Pieces(data, offsets)
        if not len(pieces.begins):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        at, length = self.memory.look_up(pieces)
        total = np.concatenate([[0], np.cumsum(length)])
        gather = np.repeat(at - total[:-1], length) + np.arange(total[-1])
        return self.memory.pool[gather], total[pieces.rows]
