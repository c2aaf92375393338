"""Suffix arrays and common prefixes of byte strings in numpy."""

from __future__ import annotations

import numpy as np


def _heads(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros follow the text."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(16, np.uint8)]).astype(np.uint64)
    out = np.zeros(n + 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + n + 8]
    return out


def suffix_array(text: np.ndarray, heads: np.ndarray | None = None) -> np.ndarray:
    """Larsson-Sadakane refinement: suffixes sorted by h symbols are sorted by 2h through the ranks h places on; groups of one are left alone."""
    n = len(text)
    heads = _heads(text)[:n] if heads is None else heads[:n]
    order = np.argsort(heads)
    sorted_ = heads[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]][:n]
    rank = np.zeros(n + 1, np.uint64)
    place = np.arange(n)
    rank[order] = (np.maximum.accumulate(np.where(new, place, 0)) + 1).astype(np.uint64)
    h = 8
    while h < 2 * n:
        alone = new & np.r_[new[1:], True]
        place = place[~alone]
        if not len(place):
            break
        own = order[place]
        key = (rank[own] << np.uint64(32)) | rank[np.minimum(own + h, n)]
        turn = np.argsort(key)
        own, key = own[turn], key[turn]
        order[place] = own
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        # a group's rank is the place of its first suffix; places of unsorted groups may have gaps between them
        rank[own] = (np.maximum.accumulate(np.where(new, place, 0)) + 1).astype(np.uint64)
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, heads: np.ndarray | None = None) -> np.ndarray:
    """For each place of the text, the prefix that its suffix shares with the suffix before it in the order.

    By Kasai's rule the value falls by one from place to place as long as both suffixes are preceded by one symbol, so
    only the other places are compared, all at once and eight bytes at a time.
    """
    n = len(text)
    heads = _heads(text) if heads is None else heads
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:] - 1, 0)])
    start = np.flatnonzero(~follows)
    length = np.zeros(n, np.int64)
    live = start[before[start] >= 0]
    other = before[live]
    at = np.zeros(len(live), np.int64)
    while len(live):
        a, b = live + at, other + at
        x = heads[np.minimum(a, n)] ^ heads[np.minimum(b, n)]
        ended = (a >= n) | (b >= n)
        stop = (x != 0) | ended
        if stop.any():
            x, more = x[stop], np.zeros(int(stop.sum()), np.int64)
            same = np.ones(len(x), bool)
            for k in range(8):
                same &= ((x >> np.uint64(56 - 8 * k)) & np.uint64(255)) == 0
                more += same
            room = n - np.maximum(live, other)[stop]
            length[live[stop]] = np.minimum(at[stop] + np.where(ended[stop], 0, more), room)
        live, other, at = live[~stop], other[~stop], at[~stop] + 8
    last = np.maximum.accumulate(np.where(follows, 0, place))
    return np.maximum(length[last] - (place - last), 0)


class Shard:
    """The sorted suffixes of pieces of text, of which only the first `starts` of each piece count. Byte 0xFF, which UTF-8 never has, ends each piece."""

    def __init__(self, pieces: list[bytes], starts: list[int]):
        self.sizes, self.starts = np.array([len(p) + 1 for p in pieces]), np.array(starts)
        self.text = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8)
        self.heads = _heads(self.text)
        order = suffix_array(self.text, self.heads)
        self.begin = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.text)) - np.repeat(self.begin, self.sizes)
        kept = np.flatnonzero((place < np.repeat(self.starts, self.sizes))[order])
        self.order = order[kept]
        # what a suffix shares with the one kept before it is the least of what lies between
        self.shared = np.zeros(len(kept), np.int64)
        if len(kept) > 1:
            shared = common_prefixes(self.text, order, self.heads)[order]
            self.shared[1:] = np.minimum.reduceat(shared[: kept[-1] + 1], kept[:-1] + 1)

    def _by_piece(self, best: np.ndarray, spans: tuple[int, ...]) -> list[np.ndarray]:
        """best: by place, bytes shared with another suffix. Rows: spans; columns: the starts of a piece."""
        return [np.stack([best[a : a + n] >= span for span in spans]) for a, n in zip(self.begin.tolist(), self.starts.tolist())]

    def repeated(self, spans: tuple[int, ...]) -> list[np.ndarray]:
        """For each piece, by span, which of its strings also start elsewhere in the shard."""
        best = np.zeros(len(self.text), np.int64)
        best[self.order] = np.maximum(self.shared, np.r_[self.shared[1:], 0][: len(self.shared)])
        return self._by_piece(best, spans)

    def found_in(self, other: Shard, spans: tuple[int, ...]) -> list[np.ndarray]:
        """For each piece, by span, which of its strings start in another shard, by binary search among its suffixes."""
        most, own = max(spans), self.order
        low, high = np.zeros(len(own), np.int64), np.full(len(own), len(other.order))
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) // 2
            same, less = self._compared(own[live], other, other.order[middle], most)
            after = less & (same < most)
            low[live[after]] = middle[after] + 1
            high[live[~after]] = middle[~after]
        best = np.zeros(len(self.text), np.int64)
        for at in (low - 1, low):  # the longest common prefix is with a neighbour of the place found
            some = np.flatnonzero((at >= 0) & (at < len(other.order)))
            best[own[some]] = np.maximum(best[own[some]], self._compared(own[some], other, other.order[at[some]], most)[0])
        return self._by_piece(best, spans)

    def _compared(self, own: np.ndarray, other: Shard, theirs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the suffixes share, up to `most`, and whether the other's comes before our own."""
        same, less = np.full(len(own), most), np.zeros(len(own), bool)
        live, at = np.arange(len(own)), 0
        while len(live) and at < most:
            x, y = self.heads[np.minimum(own[live] + at, len(self.text))], other.heads[np.minimum(theirs[live] + at, len(other.text))]
            stop = x != y
            if stop.any():
                d = x[stop] ^ y[stop]
                more, equal = np.zeros(len(d), np.int64), np.ones(len(d), bool)
                for k in range(8):
                    equal &= ((d >> np.uint64(56 - 8 * k)) & np.uint64(255)) == 0
                    more += equal
                same[live[stop]] = np.minimum(at + more, most)
                less[live[stop]] = y[stop] < x[stop]
            live, at = live[~stop], at + 8
        return same, less
