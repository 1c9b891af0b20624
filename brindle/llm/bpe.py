"""Exact lengths and ids of byte-level BPE, looked up by pre-token.

A text is cut at spaces into units, units into pre-tokens, and a pre-token goes
to the tokenizer's model once and then comes from a bounded cache. A space that
follows something other than white space always starts a new pre-token, so units
can be tokenized apart. Units of characters below U+0250 are cut here; any other
unit is cut by the tokenizer's own pre-tokenizer, whose Unicode classes decide.
Only texts that hold an added token's string go whole to the library.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

from brindle.llm.worker import stage_cache

#: White space below U+0250, and all of Unicode's, as the pre-tokenizer sees it.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_SPACES = _SPACE + "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space in some versions of Unicode and not in others.
_DISPUTED = "\u180e"
_LIMIT = 0x250
#: Marks that are a pre-token of their own at the end of a word.
_MARKS = ",.;:!?"


def _ranges(kind: str) -> str:
    """A character class of all characters below the limit whose category starts with ``kind``."""
    codes = [c for c in range(_LIMIT) if unicodedata.category(chr(c)).startswith(kind)]
    out, start = [], None
    for i, c in enumerate(codes):
        start = c if start is None else start
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\u{start:04x}-\\u{c:04x}")
            start = None
    return "".join(out)


_L, _N = _ranges("L"), _ranges("N")
PRE_TOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_SPACE}{_L}{_N}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_SPACE_RUN = re.compile(f"[{_SPACES}] ")
_BEYOND = re.compile(f"[^\\x00-\\u{_LIMIT - 1:04x}]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shifted = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class RecentValues(dict):
    """Values of short keys, computed when missing. Of two generations the younger is filled up to ``limit``, then it
    becomes the older one and what that held and was not asked for again is let go; so frequent keys stay."""

    def __init__(self, compute: Callable[[str], bytes], limit: int):
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceTokenizer:
    """Exact token counts and ids for one vocabulary file, with bounded caches."""

    def __init__(self, path: str, known: dict[str, int] | None = None, cache: int = 200_000):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.added = [t["content"] for t in spec["added_tokens"]]
        #: The short cut is for plain byte-level files; others take the library alone.
        self.plain = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec["normalizer"] and not spec["post_processor"] and spec["model"]["type"] == "BPE"
        )
        self.alphabet = byte_alphabet()
        self.model = self.whole.model
        self.known = known or {}
        self.cache_limit = cache
        self.lengths: dict[str, int] = {}
        self.unit_lengths: dict[str, int] = {}
        self.piece_ids = RecentValues(self._model_ids, cache // 8)
        self.word_ids = RecentValues(self._word_ids, cache)

    def _tokens(self, piece: str) -> list:
        if piece.isascii() and piece[1:].isalpha():  # printable ASCII stands for itself
            return self.model.tokenize(self.alphabet[32] + piece[1:] if piece[0] == " " else piece.translate(self.alphabet))
        return self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.alphabet))

    def easy(self, text: str) -> bool:
        return self.plain and _DISPUTED not in text and not any(a in text for a in self.added)

    def pieces(self, unit: str) -> list[str]:
        """The pre-tokens of a unit."""
        if not _BEYOND.search(unit):
            return PRE_TOKEN.findall(unit)
        return [unit[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(unit)]

    @staticmethod
    def units(text: str) -> list[str]:
        """Parts of a text that can be tokenized apart; all but the first start with a space."""
        if not text:
            return []
        if _SPACE_RUN.search(text):
            cuts = [0, *(m.start() for m in re.finditer(f"(?<=[^{_SPACES}]) ", text)), len(text)]
            return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def piece_length(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.lengths.get(piece)
        if n is None:
            n = len(self._tokens(piece))
            if len(self.lengths) < self.cache_limit and len(piece) <= 64:
                self.lengths[piece] = n
        return n

    def count(self, text: str) -> int:
        if not self.easy(text):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        total, get = 0, self.unit_lengths.get
        for unit in self.units(text):
            n = get(unit)
            if n is None:
                n = sum(map(self.piece_length, self.pieces(unit)))
                if len(self.unit_lengths) < self.cache_limit and len(unit) <= 64:
                    self.unit_lengths[unit] = n
            total += n
        return total

    def _model_ids(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self._tokens(piece)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word_ids(self, word: str) -> bytes:
        """The ids of a unit without its leading space. Letters are one pre-token, a mark behind them another."""
        if word.isalpha() and not _BEYOND.search(word):
            return self._model_ids(" " + word)
        if word[-1:] in _MARKS and word[:-1].isalpha() and not _BEYOND.search(word):
            return self.word_ids[word[:-1]] + self.piece_ids[word[-1]]
        pieces = self.pieces(" " + word)
        if len(pieces) == 1:
            return self._model_ids(pieces[0])
        return b"".join([self.word_ids[p[1:]] if p[0] == " " and p.isascii() and p[1:].isalpha() else self.piece_ids[p] for p in pieces])

    def packed_ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not self.easy(text):
            return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])
        if _SPACE_RUN.search(text):
            first, *rest = self.units(text)
            rest = [unit[1:] for unit in rest]
        else:
            first, *rest = text.split(" ")
        return b"".join(map(self.piece_ids.__getitem__, self.pieces(first))) + b"".join(map(self.word_ids.__getitem__, rest))


def opened(path: str) -> PieceTokenizer:
    """This worker's tokenizer for a file; it and its caches live as long as the worker's stage."""
    held = stage_cache()
    if path not in held:
        held[path] = PieceTokenizer(path)
    return held[path]
