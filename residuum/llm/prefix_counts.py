"""Token counts by dynamic programming over prefixes.

For a merge-based vocabulary the encoding of a prefix fixes everything but its
last token: ``t1..tn`` is the encoding of a word exactly when ``t1..t(n-1)`` is
the encoding of the shorter prefix and the last two tokens stand together, that
is, merging their joined symbols gives the same two tokens again.  So one table
over the prefixes of a word, filled from left to right, holds the exact token
count of each prefix, and the sums over the words of a text together with the
table of the word it ends in hold it for each prefix of the text, at every
character.  Truncation and budget questions are lookups in these tables; nothing
is encoded again.

* ``token_counts``: per document the total and the longest prefix within a limit.
* ``prefix_table``: per document the table itself, as two arrays.
* ``tokens_before`` / ``bytes_within``: column expressions over that table.

Defined cases: a NULL or empty text has 0 bytes and 0 tokens; a NULL id is
carried through; repeated rows each give a row; special strings inside a text
count as the library counts them by default (one token).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.bytewords import text_bytes
from residuum.llm.shared import held, slices
from residuum.llm.words import MAX_PIECE, PLAIN, PieceMemory, Pieces

#: Bound of one worker's memory of words; at the bound it is emptied.
MAX_WORDS = 500_000
#: Bound of one worker's memory of prefix tables, in numbers; beyond it is emptied.
MAX_ENTRIES = 1 << 24


class PrefixCounter:
    """Prefix tables of words for one vocabulary file.

    ``count_word(w)`` is the token count of a pre-token (in the vocabulary's
    byte alphabet), ``word_table(w)`` the counts of all its prefixes, each
    taken as a text of its own.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = sorted((a["content"] for a in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.together: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.tokens = frozenset(model["vocab"])
        self.longest = max((len(t.removesuffix(self.suffix)) for t in self.tokens), default=1)
        self.inner: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.words: dict[str, int] = {}
        self.lowers = "Lowercase" in json.dumps(spec.get("normalizer"))

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1:] + self.suffix]
        return list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        """The merges of a few symbols, lowest rank first, leftmost first."""
        while len(symbols) > 1:
            best, at = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))))
            if best == 1 << 60:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stands(self, left: str, token: str) -> bool:
        """Whether ``token`` may follow ``left`` as the last token of a prefix."""
        if not left:
            ok = self.alone.get(token)
            if ok is None:
                ok = self.alone[token] = self._merged(self._symbols(token)) == [token]
            return ok
        ok = self.together.get((left, token))
        if ok is None:
            if len(self.together) > 4 * MAX_WORDS:
                self.together.clear()
            ok = self._merged(self._symbols(left) + self._symbols(token)) == [left, token]
            self.together[(left, token)] = ok
        return ok

    def _step(self, word: str, end: int, mark: str, table) -> tuple[str, int]:
        """The entry of ``word[:end]``: its last token and its token count."""
        for begin in range(max(0, end - self.longest), end):
            token = word[begin:end] + mark
            if token in self.tokens:
                left, n = table(begin)
                if self._stands(left, token):
                    return token, n + 1
        raise ValueError("the vocabulary lacks a byte")

    def _inner(self, word: str) -> Callable[[int], tuple[str, int]]:
        """The table of the prefixes of ``word`` without a word end."""
        if len(word) > MAX_PIECE:
            rows: list[tuple[str, int]] = [("", 0)]
            for end in range(1, len(word)):
                rows.append(self._step(word, end, "", rows.__getitem__))
            return rows.__getitem__
        known = self.inner
        table = lambda at: known[word[:at]]
        done = len(word) - 1
        while word[:done] not in known:
            done -= 1
        for end in range(done + 1, len(word)):
            known[word[:end]] = self._step(word, end, "", table)
        return table

    def count_word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            if len(self.words) > MAX_WORDS:
                self.words.clear()
                self.inner = {"": ("", 0)}
            elif len(self.inner) > 2 * MAX_WORDS:
                self.inner = {"": ("", 0)}
            n = self._step(word, len(word), self.suffix, self._inner(word))[1]
            if len(word) <= MAX_PIECE:
                self.words[word] = n
        return n

    def word_table(self, word: str) -> list[int]:
        """Token counts of ``word[:1]``, ``word[:2]``, ... each as a whole word."""
        if len(self.inner) > 2 * MAX_WORDS:
            self.inner = {"": ("", 0)}
        table = self._inner(word)
        return [self._step(word, end, self.suffix, table)[1] for end in range(1, len(word) + 1)]

    def _count_odd(self, piece: str) -> int:
        """A piece in which the library's own rules find words and specials."""
        n, parts = 0, [piece]
        if self.special_re is not None:
            parts = self.special_re.split(piece)
            n = len(parts) - 1
        t = self.tokenizer
        for part in parts:
            if part:
                text = t.normalizer.normalize_str(part) if t.normalizer else part
                n += sum(self.count_word(w) for w, _ in t.pre_tokenizer.pre_tokenize_str(text) if w)
        return n

    def count_piece(self, piece: str) -> int:
        """The token count of a piece between blanks.  Only runs of letters
        whose lower-casing is the same everywhere skip the library's rules."""
        if self.lowers and PLAIN.fullmatch(piece):
            word = piece.lower()
            return self.count_word(word if word.isascii() else _byte_letters(word))
        return self._count_odd(piece)

    def _normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _apart(self, text: str, at: int) -> bool:
        """Whether the normal form of ``text`` is that of its two sides of ``at``."""
        c = text[at]
        return c.isascii() or (not unicodedata.combining(c) and not 0x1160 <= ord(c) <= 0x11FF
                               and self._normal(text[at - 1:at + 1]) == self._normal(text[at - 1]) + self._normal(c))

    def _groups(self, part: str) -> list[tuple[int, int, str | None]]:
        """Begin and end of the words that the library finds in a part, and the
        word; stretches that cannot be told apart are one, without a word."""
        from tokenizers import PreTokenizedString

        t, found = self.tokenizer, PreTokenizedString(part)
        if t.normalizer:
            found.normalize(t.normalizer.normalize)
        t.pre_tokenizer.pre_tokenize(found)
        out: list[tuple[int, int, str | None]] = []
        for word, (a, b), _ in found.get_splits("original", "char"):
            whole = b
            while b < len(part) and not self._apart(part, b):   # what the normal form joins to it
                b += 1
            # without a mark that joins a letter after it, an apostrophe may begin a word with it
            joined = part[a - 1:a] == "'" and not all(self._apart(part, i) for i in range(a + 1, min(a + 4, len(part))))
            if out and (a < out[-1][1] or joined or not self._apart(part, a)):
                out[-1] = (out[-1][0], max(b, out[-1][1]), None)
            else:
                out.append((a, b, word if b == whole else None))
        return out

    def _group_table(self, text: str, word: str | None, most: int) -> list[int]:
        """Token counts of the prefixes of one stretch of ``_groups``."""
        if word is not None and (len(text) > 3 or text.isalpha()) and (text.isalpha() or not any(map(str.isalnum, text))):
            # a run of letters or of signs: each prefix is one word as well
            forms = [c.lower() if self.lowers and c.isascii() else self._normal(c) for c in text]
            whole = "".join(forms)
            if whole == self._normal(text) and _byte_letters(whole) == word:
                table = [0, *self.word_table(word[:(most + 1) * self.longest])]
                ends = np.cumsum([len(f.encode()) for f in forms]).tolist()
                return [table[e] if e < len(table) else most + 1 for e in ends]
        # the last words of the prefixes share the table of what they begin with alike
        out: list[int] = []
        rows, base = [("", 0)], ""
        for k in range(1, len(text) + 1):
            *before, word = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self._normal(text[:k])) if w] or [""]
            if sum(map(len, before)) + len(word) > (most + 1) * self.longest:
                break
            del rows[len(os.path.commonprefix([base, word])) + 1:]
            for end in range(len(rows), len(word)):
                rows.append(self._step(word, end, "", rows.__getitem__))
            base = word
            out.append(sum(map(self.count_word, before)) + (self._step(word, len(word), self.suffix, rows.__getitem__)[1] if word else 0))
        return out + [most + 1] * (len(text) - len(out))

    def piece_table(self, piece: str, most: int = 1 << 30) -> list[int]:
        """Token counts of ``piece[:1]``, ``piece[:2]``, ... each as a text of
        its own; counts above ``most`` may be given as ``most + 1``."""
        if self.lowers and piece.isascii() and PLAIN.fullmatch(piece):
            return self._group_table(piece, piece.lower(), most)
        out: list[int] = []
        total, at = 0, 0
        specials = [m.span() for m in self.special_re.finditer(piece)] if self.special_re is not None else []
        for begin, end in [*specials, (len(piece), len(piece))]:
            part, last = piece[at:begin], (begin, total)
            for a, b, word in self._groups(part) if part else []:
                if total > most:
                    break
                out += [total] * (at + a - len(out))
                last = (at + a, total)
                out += [total + n for n in self._group_table(part[a:b], word, most)]
                total = out[-1]
            else:
                out += [total] * (begin - len(out))
                # a cut special string is text that goes on from the stretch before it
                out += [last[1] + self._count_odd(piece[last[0]:k]) for k in range(begin + 1, end)]
                total += end > begin
                out += [total] * (end - len(out))
                at = end
            if total > most:
                break
        return out + [most + 1] * (len(piece) - len(out))

    def tables(self, pieces: list[str]) -> list[bytes]:
        """The byte ends and counts of all prefixes of pieces, in the form of
        ``PieceMemory``."""
        return [np.stack([_byte_ends(p), self.piece_table(p)], 1).astype("<i4").tobytes() for p in pieces]

    def counts(self, pieces: list[str]) -> list[bytes]:
        """The counts of pieces, in the form of ``PieceMemory``."""
        return [n.to_bytes(4, "little") for n in map(self.count_piece, pieces)]


def _alphabet() -> dict[int, str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies:
    printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _alphabet()


def _byte_letters(word: str) -> str:
    return word.encode().decode("latin-1").translate(_LETTERS)


def _byte_ends(text: str) -> np.ndarray:
    """The byte length of each prefix of a text."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))


class PrefixTables:
    """Prefix counts of slices of texts: a running sum over their pieces, and
    the tables of the pieces themselves."""

    def __init__(self, vocabulary: str):
        self.counter = PrefixCounter(vocabulary)
        self.memory = PieceMemory(self.counter.counts, "<i4")
        self.prefixes = PieceMemory(self.counter.tables, "<i4")

    def running(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Pieces, np.ndarray]:
        """The pieces, and the tokens before each of them and after the last."""
        pieces = Pieces(data, offsets)
        counts = np.zeros(0, np.int64)
        if len(pieces.begins):
            at, _ = self.memory.look_up(pieces)
            counts = self.memory.pool[at].astype(np.int64)
        return pieces, np.concatenate([[0], np.cumsum(counts)])

    def within(self, piece: str, room: int) -> tuple[int, int]:
        """Bytes and tokens of the longest prefix of a piece within ``room`` tokens."""
        table = self.counter.piece_table(piece, room)
        k = max((i for i, n in enumerate(table, 1) if n <= room), default=0)
        return (len(piece[:k].encode()), table[k - 1]) if k else (0, 0)

    def every(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte end and tokens of every prefix of the texts that ends with a
        character of a piece, and the border of each text."""
        pieces = Pieces(data, offsets)
        if not len(pieces.begins):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        if len(self.prefixes.pool) > MAX_ENTRIES:
            self.prefixes._clear()
        at, length = self.prefixes.look_up(pieces)
        sums = np.concatenate([[0], np.cumsum(self.prefixes.pool[at + length - 1].astype(np.int64))])
        total = np.concatenate([[0], np.cumsum(length)])
        found = self.prefixes.pool[np.repeat(at - total[:-1], length) + np.arange(total[-1])].reshape(-1, 2)
        own = np.repeat(np.arange(len(at)), length // 2)
        n = np.diff(pieces.rows)
        before, start = sums[:-1] - np.repeat(sums[pieces.rows[:-1]], n), pieces.begins - np.repeat(offsets[:-1], n)
        return start[own] + found[:, 0], before[own] + found[:, 1], total[pieces.rows] // 2


def tables(vocabulary: str) -> PrefixTables:
    """The worker's tables of a vocabulary; tasks of one worker share them."""
    return held(f"tables {vocabulary}", lambda: PrefixTables(vocabulary))


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return src, src.schema["_id"].dataType.simpleString()


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, within_bytes, within_tokens``.

    ``within_bytes`` is the byte length of the longest prefix of whole
    characters that has at most ``limit`` tokens (without blanks that may
    follow), ``within_tokens`` its token count: where to truncate, read off the
    prefix sums and the table of the piece in which the limit falls.
    """
    src, id_type = _source(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables(vocabulary)
        for whole in batches:
            for batch in slices(whole, "_text"):
                data, offsets = text_bytes(batch.column("_text"))
                pieces, sums = own.running(data, offsets)
                first, last = sums[pieces.rows[:-1]], sums[pieces.rows[1:]]
                total, size = last - first, np.diff(offsets)
                over = total > limit
                # the last piece whose running sum stays within the limit
                at = np.minimum(np.searchsorted(sums, first + limit, "right") - 1, pieces.rows[1:])
                some = over & (at > pieces.rows[:-1])
                cut = np.where(over, 0, size)
                cut[some] = pieces.ends[at[some] - 1] - offsets[:-1][some]
                kept = np.where(over, sums[at] - first, total)
                # as much of the piece that goes beyond it as has room
                rows = np.flatnonzero(over)
                for i, piece in zip(rows.tolist(), pieces.texts(at[rows])):
                    more, tokens = own.within(piece, int(limit - kept[i]))
                    if more:
                        cut[i] = pieces.begins[at[i]] - offsets[i] + more
                        kept[i] += tokens
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(size), pa.array(total), pa.array(cut), pa.array(kept)],
                    names=["_id", "n_bytes", "n_tokens", "within_bytes", "within_tokens"])

    out = src.mapInArrow(run, f"_id {id_type}, n_bytes long, n_tokens long, within_bytes long, within_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"), "within_bytes", "within_tokens")


def prefix_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ends, tokens``: ``tokens[i]`` is the token count of the prefix of
    ``ends[i]`` bytes, for every prefix that ends with a character other than a
    blank (blanks at the end of a prefix have no tokens).  A NULL or empty text
    has empty arrays."""
    src, id_type = _source(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables(vocabulary)
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                data, offsets = text_bytes(batch.column("_text"))
                ends, tokens, borders = own.every(data, offsets)
                borders = pa.array(borders, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.ListArray.from_arrays(borders, pa.array(ends, pa.int32())),
                     pa.ListArray.from_arrays(borders, pa.array(tokens, pa.int32()))],
                    names=["_id", "ends", "tokens"])

    out = src.mapInArrow(run, f"_id {id_type}, ends array<int>, tokens array<int>")
    return out.select(F.col("_id").alias(id_col), "ends", "tokens")


def tokens_before(n_bytes: Column | int, ends: str = "ends", tokens: str = "tokens") -> Column:
    """Tokens of the longest tabled prefix of at most ``n_bytes`` bytes."""
    k = F.size(F.filter(F.col(ends), lambda e: e <= n_bytes))
    return F.when(k > 0, F.get(F.col(tokens), k - 1)).otherwise(F.lit(0))


def bytes_within(budget: Column | int, ends: str = "ends", tokens: str = "tokens") -> Column:
    """Bytes of the longest tabled prefix of at most ``budget`` tokens."""
    return F.coalesce(F.array_max(F.zip_with(ends, tokens, lambda e, t: F.when(t <= budget, e))), F.lit(0))
