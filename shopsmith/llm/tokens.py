"""Token ids of whole texts, one cached call of the tokenizer per distinct word.

A pre-tokenizer never joins text across a lone space or line end with visible characters
on both sides, so a text can be cut there and its ids are the ids of the parts, one after
the other.  The parts repeat (Zipf), hence a bounded cache of part -> id bytes.  A part
that is Latin letters and then ASCII punctuation is one or two pre-tokens whatever the
tokenizer's regular expression library, and goes straight to the tokenizer's BPE model;
every other part (digits, apostrophes, odd white space, other scripts, special tokens)
goes through the tokenizer whole.  Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import os
import re
from array import array

#: Entries kept per worker (about 200 bytes each), in two generations.
CACHE_PARTS = 400_000
CACHE_CHARS = 48
#: A single space between two visible characters; Python's \s covers every white space
#: that the tokenizers know, so a doubtful character only means a longer part.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line end, and pairs of these two.
ODD_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
DOUBLE = ("  ", " \n", "\n ", "\n\n")
_LETTERS, _PUNCT = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(rf"(\n)?([{_LETTERS}]+)([{_PUNCT}]*)|(\n)?([{_PUNCT}]+)")
WORD, MARKS = re.compile(f"[{_LETTERS}]+"), "".join(c for c in map(chr, range(128)) if re.match(f"[{_PUNCT}]", c))


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies use for each byte: printable
    Latin-1 bytes stand for themselves, the rest take the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [], 0
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


_SYMBOLS = byte_symbols()
_SPACE = _SYMBOLS[32]


def to_symbols(piece: str) -> str:
    if piece.isascii() and piece.isprintable():
        return _SPACE + piece[1:] if piece[0] == " " else piece
    return "".join([_SYMBOLS[b] for b in piece.encode("utf-8")])


class PartCache(dict):
    """part -> encoded value, filled on demand.  When full, the older half goes: what is
    looked up meanwhile comes back from it.  Long parts are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, part):
        value = self.older.get(part)
        if value is None:
            value = self.encode(part)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = value
        return value


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def parts_of(text: str) -> tuple[str, list[str]]:
    """The first part and the others, each of which follows a space unless it begins with
    a line end.  A text with odd white space is cut at lone spaces only."""
    if any(d in text for d in DOUBLE) or any(c in text for c in ODD_SPACE) or text[0] in " \n" or text[-1] in " \n":
        parts = [p if k == 0 or p[0] != "\n" else " " + p for k, p in enumerate(CUT.split(text))]
    else:
        parts = text.replace("\n", " \n").split(" ")
    return parts[0], parts[1:]


def bare_parts(text: str) -> list[str]:
    """For tokenizers that drop white space: cut at every space and line end."""
    return text.replace("\n", " ").split(" ")


def plain_pieces(part: str) -> list[str] | None:
    """The pre-tokens of a part of letters and punctuation (after a line end), else None."""
    m = PLAIN.fullmatch(part)
    return [p for p in m.groups() if p] if m else None


class PartEncoder:
    """``encode(text)`` -> id bytes of the whole text (null or empty: none).

    ``keeps_spaces``: the vocabulary has tokens that start with a space (byte-level BPE),
    so a part after a cut keeps that space; otherwise the tokenizer lower-cases and drops
    white space, and parts go in bare.
    """

    def __init__(self, path: str, keeps_spaces: bool):
        self.tok, self.keeps_spaces = load_tokenizer(path), keeps_spaces
        self.cache = PartCache(self._after_space if keeps_spaces else self._part)
        self.marks = PartCache(lambda marks: self._ids([marks]))
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.tok.get_vocab(True).values(), default=-1) + 1)]

    def _after_space(self, part: str) -> bytes:
        word = part.rstrip(MARKS)
        # most parts are a word, or a word that may be known already and the marks after it
        if word.isalpha() and (word.isascii() or WORD.fullmatch(word)):
            return self._ids([" " + word]) if len(word) == len(part) else self.cache[word] + self.marks[part[len(word):]]
        return self._part(part if part[0] == "\n" else " " + part)

    def _ids(self, pieces: list[str]) -> bytes:
        tokenize = self.tok.model.tokenize
        known = self.id_bytes
        return b"".join([known[t.id] for p in pieces for t in tokenize(to_symbols(p if self.keeps_spaces else p.lower()))])

    def _part(self, part: str) -> bytes:
        pieces = plain_pieces(part.removeprefix(" "))
        if pieces is None:
            return array("I", self.tok.encode(part, add_special_tokens=False).ids).tobytes()
        if part[0] == " ":
            pieces[0] = " " + pieces[0]
        return self._ids(pieces)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.keeps_spaces:
            return b"".join(map(self.cache.__getitem__, bare_parts(text)))
        first, others = parts_of(text)
        return self._part(first) + b"".join(map(self.cache.__getitem__, others))


_ENCODERS: dict[tuple[str, bool], PartEncoder] = {}


def encoder(path: str, keeps_spaces: bool) -> PartEncoder:
    """One per Python worker, reused by its tasks."""
    key = (path, keeps_spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = PartEncoder(path, keeps_spaces)
    return _ENCODERS[key]
