"""A run-length index of short texts, and matching statistics streamed over it.

The Burrows-Wheeler transform of all texts is kept as its runs, with the text
position sampled at both ends of each run.  A pattern is read from its last byte
to its first; the index keeps one occurrence of the longest match that starts at
each byte.  Where the transform's character is not the pattern's, the nearest run
end on either side offers the occurrence that shares most with what was matched;
its sample says where it stands in the texts.  Many patterns are streamed together.
"""

from __future__ import annotations

import numpy as np


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (byte + 1, 0 after each text), starts of texts, and bytes left in its text at each position."""
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int16) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols[starts + sizes] = 0
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(symbols))
    return symbols, starts, left


def suffix_order(symbols: np.ndarray, left: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, each ending at its text's end, equal ones by position;
    and ids of the first ``keep`` symbols of each position that has as many (else unique ids)."""
    n, h = len(symbols), 7
    key = np.zeros(n, np.uint64)
    ended = np.zeros(n, bool)
    for i in range(h):
        s = np.zeros(n, np.uint64)
        s[: n - i] = symbols[i:]
        ended |= left < i
        s[ended] = 0
        key = key * np.uint64(257) + s
    done = left < h
    place = np.arange(n)
    ids = None
    while True:
        order = np.argsort(key)
        k = key[order]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if ids is None and 2 * h >= keep:
            ids = rank * np.int64(n) + rank[np.minimum(place + (keep - h), n - 1)]
        tied = ~new
        tied[:-1] |= ~new[1:]
        if done[order[tied]].all():
            break
        key = rank.astype(np.uint64) * np.uint64(n) + np.where(done, 0, rank[np.minimum(place + h, n - 1)]).astype(np.uint64)
        h *= 2
        done = left < h
    if ids is None:
        ids = rank.copy()
    lone = left < keep
    ids[lone] = -1 - place[lone]
    return np.argsort(rank * np.int64(n) + place), ids


class RunLengthIndex:
    """Built over texts with an owner each; owners of equal windows are known by their least."""

    def __init__(self, texts: list[bytes], owners: np.ndarray, window: int):
        if window < 7:
            raise ValueError("windows have 7 bytes at least")
        self.window = window
        symbols, starts, left = joined(texts)
        order, ids = suffix_order(symbols, left, window)
        bwt = symbols[order - 1]  # before position 0 stands the end of the last text
        change = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.run_start = change
        self.run_end = np.append(change[1:], len(bwt)) - 1
        self.run_of = np.repeat(np.arange(len(change), dtype=np.int32), np.diff(np.append(change, len(bwt))))
        self.head = bwt[change].astype(np.int64)
        self.first_at, self.last_at = order[self.run_start], order[self.run_end]
        length = self.run_end - self.run_start + 1
        by_head = np.lexsort((np.arange(len(change)), self.head))
        before = np.cumsum(length[by_head]) - length[by_head]
        self.before = np.empty(len(change), np.int64)
        self.before[by_head] = before  # characters of this kind, and of smaller kinds, ahead of the run
        self.by_head, self.head_key = by_head, self.head[by_head] * np.int64(len(change)) + by_head
        self.bytes = np.zeros(len(symbols) + 256, np.uint8)
        self.bytes[: len(symbols)] = np.where(symbols > 0, symbols - 1, 0)
        self.left, self.starts = left, starts
        sorted_ids = ids[order]
        first = np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1]))
        self.group_of = np.cumsum(first, dtype=np.int32) - 1
        owner = np.repeat(owners, np.diff(np.append(starts, len(symbols))))
        self.group_least = np.minimum.reduceat(owner[order], np.flatnonzero(first))

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal bytes from positions a and b on, most of them at most."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        most = np.minimum(most, self.left[a])
        words = np.lib.stride_tricks.as_strided(self.bytes[:8].view("<u8"), (len(self.bytes) - 7,), (1,))
        while len(live):
            x = words[a[live] + out[live]] ^ words[b[live] + out[live]]
            same = np.full(len(live), 8)
            odd = x != 0
            low = x[odd] & (~x[odd] + np.uint64(1))
            same[odd] = np.log2(low.astype(np.float64)).astype(np.int64) >> 3
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def stream(self, start: np.ndarray, size: np.ndarray):
        """Matching statistics of stretches of the indexed bytes, from their ends to their starts.

        Yields (stretches, places, lengths of the longest match there, ranks of its suffix)."""
        live = np.flatnonzero(size > 0)
        j, length = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        step = 0
        runs = np.int64(len(self.head))
        while len(live):
            p = start[live] + size[live] - 1 - step
            c = self.bytes[p].astype(np.int64) + 1
            at = j[live]
            run = self.run_of[at].astype(np.int64)
            off = self.head[run] != c
            if off.any():
                m = np.flatnonzero(off)
                nxt = np.searchsorted(self.head_key, c[m] * runs + run[m])
                prv = nxt - 1
                ok_n = nxt < runs
                ok_n[ok_n] = self.head[self.by_head[nxt[ok_n]]] == c[m][ok_n]
                ok_p = prv >= 0
                ok_p[ok_p] = self.head[self.by_head[prv[ok_p]]] == c[m][ok_p]
                up, down = self.by_head[np.where(ok_n, nxt, 0)], self.by_head[np.where(ok_p, prv, 0)]
                after, had = p[m] + 1, length[live[m]]
                len_n = np.where(ok_n, self._common(self.first_at[up], after, had), -1)
                len_p = np.where(ok_p, self._common(self.last_at[down], after, had), -1)
                use_n = len_n >= len_p
                run[m] = np.where(use_n, up, down)
                at[m] = np.where(use_n, self.run_start[up], self.run_end[down])
                length[live[m]] = np.maximum(len_n, len_p)
            j[live] = self.before[run] + at - self.run_start[run]
            length[live] += 1
            yield live, p - start[live], length[live], j[live]
            step += 1
            live = live[size[live] > step]

    def least_owner(self, rank: np.ndarray) -> np.ndarray:
        """The least owner of the window that the suffix of a rank begins with."""
        return self.group_least[self.group_of[rank]]


def smaller_owner_windows(texts: list[bytes], owners: np.ndarray, window: int, together: int = 1 << 16) -> np.ndarray:
    """For each text, bit i: the window at byte i also stands in a text of a smaller owner (the first 32 windows)."""
    index = RunLengthIndex(texts, owners, window)
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.uint32)
    for lo in range(0, len(texts), together):
        part = np.arange(lo, min(lo + together, len(texts)))
        for live, place, length, rank in index.stream(index.starts[part], size[part]):
            long = (length >= window) & (place < 32)
            which = part[live[long]]
            hit = index.least_owner(rank[long]) < owners[which]
            out[which[hit]] |= np.uint32(1) << place[long][hit].astype(np.uint32)
    return out
