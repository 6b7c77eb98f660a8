"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can end its encoding.  The
tokens that are suffixes of a prefix come from an Aho-Corasick automaton over the
vocabulary; the last token of a prefix is the one that is compatible with the last token
of the prefix before it (BPE on the two tokens' text gives these two tokens back).
Following the stored last tokens backwards from the whole word gives its ids.
"""

from __future__ import annotations

import json
import re
from array import array

from .tokens import PartCache, bare_parts, load_tokenizer, plain_pieces, to_symbols

#: Compatibility answers kept per worker.
CACHE_PAIRS = 2_000_000
#: The last symbol of a word is another symbol than the same byte inside it.
_END_SHIFT = 0x1000
_NEVER = 1 << 60


class PrefixBpe:
    """Encoder for a vocabulary with a word-end suffix and ranked merges."""

    def __init__(self, path: str):
        import ahocorasick
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab = {self._word(s): i for s, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = self._word(a), self._word(b)
            pair, whole = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            self.rank[pair] = k
            self.halves.setdefault(whole, (k, *pair))
        self.automaton = ahocorasick.Automaton()
        for s, i in self.vocab.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def _word(self, token: str) -> str:
        """A token of the file in symbols, one character each."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + _END_SHIFT)
        return token

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one end of a token while BPE builds it: (token, rank of the
        merge that takes it up), from the single symbol to the token itself.  side 2:
        right end, 1: left end."""
        key = (token, side)
        if key not in self.spines:
            out, death = [(token, _NEVER)], _NEVER
            while token in self.halves:
                death = self.halves[token][0]
                token = self.halves[token][side]
                out.append((token, death))
            self.spines[key] = out[::-1]
        return self.spines[key]

    def compatible(self, left: int, right: int) -> bool:
        """Does BPE leave the border between the two tokens alone?  A merge across it
        happens if its rank is below that of the merge taking up the left symbol, and
        not above the right one's (equal ranks go from left to right)."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b, i, j, ok = self._spine(left, 2), self._spine(right, 1), 0, 0, True
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            k = self.rank.get((x, y), _NEVER)
            if k < x_end and k <= y_end and k != _NEVER:
                ok = False
                break
            if x_end == _NEVER and y_end == _NEVER:
                break
            if x_end <= y_end:
                i += 1
            if y_end <= x_end:
                j += 1
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_word(self, symbols: str) -> list[int]:
        """Ids of one pre-token given in byte symbols."""
        if not symbols:
            return []
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + _END_SHIFT)
        n = len(symbols)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for end, (token, length) in self.automaton.iter(symbols):
            i = end + 1
            if last[i] is not None:
                continue
            if length == i:
                if self._is_whole(token):
                    last[i] = (token, length)
            else:
                before = last[i - length]
                if before is not None and self._is_whole(token) and self.compatible(before[0], token):
                    last[i] = (token, length)
        ids, i = [], n
        while i:
            token, length = last[i]
            ids.append(token)
            i -= length
        return ids[::-1]

    def _is_whole(self, token: int) -> bool:
        """Does BPE of the token's own text give the token?"""
        known = self.whole.get(token)
        if known is None:
            if token not in self.halves:
                known = True
            else:
                _, a, b = self.halves[token]
                known = self._is_whole(a) and self._is_whole(b) and self._joins(a, b)
            self.whole[token] = known
        return known

    def _joins(self, a: int, b: int) -> bool:
        """The first merge across the border of ``a`` and ``b`` is that of both whole."""
        left, right, i, j = self._spine(a, 2), self._spine(b, 1), 0, 0
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            k = self.rank.get((x, y), _NEVER)
            if k != _NEVER and k < x_end and k <= y_end:
                return x == a and y == b
            if x_end == _NEVER and y_end == _NEVER:
                return False
            if x_end <= y_end:
                i += 1
            if y_end <= x_end:
                j += 1


class PrefixCodec:
    """``encode(text)`` -> (id bytes, decoded text) of a whole text.

    Normalising and splitting a part that is more than letters and punctuation is left to
    the tokenizer's own rules; special tokens in a text are found as the tokenizer does.
    """

    def __init__(self, path: str):
        self.bpe, self.tok = PrefixBpe(path), load_tokenizer(path)
        self.names = {i: s for s, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        # the first in the text; of those at one place, the first in the file
        self.split = re.compile(f"({'|'.join(map(re.escape, self.special))})").split if self.special else lambda part: [part]
        self.cache = PartCache(self._part)

    def _pieces(self, text: str) -> list[str]:
        norm = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return [s for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]

    def _ids(self, part: str) -> list[int]:
        ids = []
        for k, piece in enumerate(self.split(part)):
            if k % 2:
                ids.append(self.special[piece])
            elif (pieces := plain_pieces(piece)) is not None:
                ids += [i for p in pieces for i in self.bpe.encode_word(to_symbols(p.lower()))]
            elif piece:
                ids += [i for s in self._pieces(piece) for i in self.bpe.encode_word(s)]
        return ids

    def _part(self, part: str) -> tuple[bytes, str]:
        ids = self._ids(part) if part else []
        return array("I", ids).tobytes(), self.decode(ids)

    def decode(self, ids) -> str:
        """The tokens' names joined by spaces (this vocabulary file names no decoder)."""
        return " ".join([self.names[i] for i in ids])

    def encode(self, text: str | None) -> tuple[bytes, str]:
        if not text:
            return b"", ""
        got = [self.cache[p] for p in bare_parts(text)]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])


_CODECS: dict[str, PrefixCodec] = {}


def codec(path: str) -> PrefixCodec:
    """One per Python worker, reused by its tasks."""
    if path not in _CODECS:
        _CODECS[path] = PrefixCodec(path)
    return _CODECS[path]


def encode_documents(docs, path: str):
    """``docs`` (doc_id, text, ...) -> doc_id, n_tokens, ids (binary, little-endian
    unsigned 32-bit), decoded; one row per input row, in place (no shuffle).

    Null or empty text: no ids, empty decoded text.  Repeated rows are encoded each;
    a null doc_id stays null; other columns are ignored; an empty table gives none.
    """
    from .common import map_lists

    def run(rows):
        c = codec(path)
        got = [c.encode(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_tokens": [len(g[0]) // 4 for g in got],
                "ids": [g[0] for g in got], "decoded": [g[1] for g in got]}

    return map_lists(docs.select("doc_id", "text"), run,
                     "doc_id long, n_tokens long, ids binary, decoded string")
