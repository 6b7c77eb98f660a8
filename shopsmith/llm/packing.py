"""Packing token ids into sequences of a fixed window, best fit decreasing.

Documents are tokenised where they are read; a document longer than the window is first
cut into full windows, its rest is packed with the other rests of the same batch of
documents: longest first, each into the fullest open window with room for it, found in a
segment tree over remaining capacities.  What is left open at the end of a batch is closed
by cutting: rests from the emptiest windows fill the larger gaps, and the last window falls
into pieces of powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import map_lists
from .tokens import encoder

WINDOW = 2048
#: Ids and rests packed together by one task: they bound its memory whatever the partition's size.
BATCH_IDS, BATCH_RESTS = 8_000_000, 500_000
#: Gaps up to this many ids are left as padding rather than filled with a cut.
SMALL_GAP = 16


class RoomTree:
    """Counts of open windows by remaining capacity; finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least ``length`` with an open window, or -1."""
        i = self.size + length
        if self.count[i]:
            return length
        while i > 1:  # up until a right sibling has windows, then down its left side
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of indexes into ``lengths`` (each between 1 and ``window``); equal
    lengths in the given order."""
    tree, open_by_room, bins = RoomTree(window), [[] for _ in range(window + 1)], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room = tree.tightest(lengths[k])
        if room < 0:
            b, room = len(bins), window
            bins.append([])
        else:
            b = open_by_room[room].pop()
            tree.add(room, -1)
        bins[b].append(k)
        if room > lengths[k]:
            open_by_room[room - lengths[k]].append(b)
            tree.add(room - lengths[k], 1)
    return bins


def close_windows(bins: list[list[tuple[int, int, int]]], window: int, small_gap: int = SMALL_GAP):
    """``bins``: pieces (key, start, length).  Fill gaps over ``small_gap`` with pieces cut
    from the emptiest windows, then cut the last open window into powers of two."""
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    lo, hi = 0, len(order) - 1
    spare: list[tuple[int, int, int]] = []
    while lo < hi or spare:
        if lo > hi:
            break
        target = order[lo]
        gap = window - fill[target]
        if gap <= small_gap:
            lo += 1
            continue
        if not spare:
            if lo == hi:
                break
            spare, bins[order[hi]], fill[order[hi]] = bins[order[hi]], [], 0
            hi -= 1
        key, start, length = spare.pop()
        k = min(gap, length)
        bins[target].append((key, start, k))
        fill[target] += k
        if k < length:
            spare.append((key, start + k, length - k))
    out = [b for b, f in zip(bins, fill) if b and (f >= window - small_gap or f & (f - 1) == 0)]
    spare += [p for b, f in zip(bins, fill) if b and f < window - small_gap and f & (f - 1) for p in b]
    left = sum(p[2] for p in spare)
    while left:
        room = min(window, 1 << (left.bit_length() - 1))
        left -= room
        out.append([])
        while room:
            key, start, length = spare.pop()
            k = min(room, length)
            out[-1].append((key, start, k))
            room -= k
            if k < length:
                spare.append((key, start + k, length - k))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, keeps_spaces: bool, end_id: int = 1,
                   window: int = WINDOW, batch_ids: int = BATCH_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit).

    No shuffle: each scan task packs its own documents in batches of ``batch_ids`` ids, and
    sequence_id is (task, number in the task), so it is unique and the same after a retry.
    Null or empty text: just ``end_id``.  Repeated rows are packed each; a null doc_id stays
    null; other columns are ignored; an empty table gives none.
    """
    class Packer:
        def __init__(self):
            from pyspark import TaskContext
            self.enc, self.end = encoder(tokenizer, keeps_spaces), np.array([end_id], "<u4").tobytes()
            self.next = TaskContext.get().partitionId() << 36
            self.rests, self.size = [], 0
            self.reset()

        def reset(self):
            self.out = {c: [] for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}

        def emit(self, pieces):
            offset = 0
            for doc_id, total, start, ids in pieces:
                n = len(ids) // 4
                for c, v in (("doc_id", doc_id), ("start", start), ("length", n), ("doc_tokens", total),
                             ("sequence_id", self.next), ("offset", offset), ("ids", ids)):
                    self.out[c].append(v)
                offset += n
            self.next += 1

        def pack(self):
            lengths = [len(r[3]) // 4 for r in self.rests]
            bins = [[(k, 0, lengths[k]) for k in b] for b in best_fit_decreasing(lengths, window)]
            for b in close_windows(bins, window):
                pieces = []
                for k, start, n in b:
                    doc_id, total, base, ids = self.rests[k]
                    pieces.append((doc_id, total, base + start, ids[4 * start: 4 * (start + n)]))
                self.emit(pieces)
            self.rests, self.size = [], 0

        def __call__(self, rows):
            self.reset()
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                ids = self.enc.encode(text) + self.end
                total = len(ids) // 4
                full = total // window * window
                for start in range(0, full, window):
                    self.emit([(doc_id, total, start, ids[4 * start: 4 * (start + window)])])
                if total > full:
                    self.rests.append((doc_id, total, full, ids[4 * full:]))
                    self.size += total - full
                if self.size >= batch_ids or len(self.rests) >= BATCH_RESTS:
                    self.pack()
            return self.out

        def finish(self):
            self.reset()
            self.pack()
            return self.out

    return map_lists(docs.select("doc_id", "text"), Packer,
                     "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
