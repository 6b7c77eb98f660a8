"""Counts of one text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

#: Character classes, by UTF-8 byte: a byte over 127 counts as (part of) a letter beyond ASCII.
CLASSES = ("lower", "upper", "beyond", "digit", "space", "line_end", "stop", "symbol", "other")
SYMBOLS = b"#*$%&|<>"
_STOPS = b".,;:'\"!?-()"


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"))
    for b in range(256):
        c = chr(b)
        if b > 127:
            k = "beyond"
        elif c.islower():
            k = "lower"
        elif c.isupper():
            k = "upper"
        elif c.isdigit():
            k = "digit"
        elif b in SYMBOLS:
            k = "symbol"
        elif b in _STOPS:
            k = "stop"
        elif c == "\n":
            k = "line_end"
        elif c in " \t\x0b\x0c\r":
            k = "space"
        else:
            continue
        table[b] = CLASSES.index(k)
    return table


_TABLE = _class_table()
_WHITE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_SYMBOL = np.frombuffer(SYMBOLS, np.uint8)


def class_bytes(by_byte: np.ndarray) -> np.ndarray:
    return np.bincount(_TABLE, weights=by_byte, minlength=len(CLASSES))


class Counts:
    """``n_words, n_chars, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_distinct_words, top_word`` and ``classes`` (bytes by class) of a text (null: empty).

    Words are runs without ASCII white space; a dup line has a word and equals an earlier
    line; repeat words lie in three-word windows that the text has twice or more.
    """

    def __init__(self, text: str | None):
        text = text or ""
        raw = text.encode("utf-8")
        by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        self.classes = class_bytes(by_byte)
        self.words = raw.split()
        self.n_chars = len(text)
        self.n_words = len(self.words)
        self.word_chars = self.n_chars - int(by_byte[_WHITE].sum())
        self.n_symbols = int(by_byte[_SYMBOL].sum())
        lines = raw.split(b"\n")
        self.n_lines = len(lines)
        real = [x for x in lines if x and not x.isspace()]
        self.n_dup_lines = len(real) - len(set(real))
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, self.n_words)
        self.n_distinct_words = len(number)
        self.top_word = int(np.bincount(ids).max()) if self.n_words else 0
        self.n_repeat_words = _covered(ids) if self.n_words >= 3 else 0


def _covered(ids: np.ndarray) -> int:
    v = int(ids.max()) + 1
    pairs = ids[:-1] * v + ids[1:]
    if v > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(keys) + k] |= twice
    return int(covered.sum())
