"""The Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round r adds, for every string that is that long, the suffix of length r: the symbols of all
strings at one distance from their ends are inserted together. A symbol may be several bytes
wide; a string then stands for one sequence of symbols from each of its first bytes. A suffix
cS comes where S's symbol c ranks among the c's of the transform so far; its common prefix with
its neighbour is one more than the least common prefix between the places of the two c's.

The transform, the prefix lengths and the suffixes' owners are three files. Each round reads
them from start to end, BLOCK entries at a time, and writes them anew with the insertions; what
stays in memory is a block, a number for each symbol and the sequences' places.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16
STRIDE = 40
_FAR = np.uint16(0xFFFF)


def _range_min(lcp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(lcp[start:end]) of non-empty ranges, which are taken from the last to the first so
    that reduceat passes over nothing between them."""
    if not len(start):
        return np.empty(0, lcp.dtype)
    by = np.argsort(-start, kind="stable")
    at = np.empty(2 * len(start), np.int64)
    at[::2], at[1::2] = start[by], end[by]
    out = np.empty(len(start), lcp.dtype)
    out[by] = np.minimum.reduceat(np.append(lcp, lcp.dtype.type(0)), at)[::2]
    return out


class Column:
    """An external file of numbers, written and read from its start to its end.

    It is the scratch of one task, as a spill is: unnamed, and gone with the task.
    """

    def __init__(self, dtype):
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.file = tempfile.TemporaryFile(buffering=0, dir=local if os.path.isdir(local) else None)
        self.dtype, self.n = np.dtype(dtype), 0

    def append(self, values: np.ndarray) -> None:
        left = memoryview(np.ascontiguousarray(values, self.dtype)).cast("B")
        while left:
            left = left[self.file.write(left) :]
        self.n += len(values)

    def rewrite(self) -> None:
        self.file.seek(0)
        self.n = 0

    def blocks(self, size: int) -> Iterator[np.ndarray]:
        self.file.seek(0)
        for at in range(0, self.n, size):
            out = np.empty(min(size, self.n - at), self.dtype)
            left = memoryview(out).cast("B")
            while left:
                left = left[self.file.readinto(left) :]
            yield out


class CollectionBWT:
    """Suffixes in order, with an end before all symbols and the ends in the order of the strings.

    rows() gives bwt, lcp (of suffixes i - 1 and i) and each suffix's string and length.
    """

    def __init__(self, columns: np.ndarray, block: int = BLOCK):
        """columns[r, i]: the symbol (from 1 on) of string i before its suffix of length r; 0 where there is none."""
        self.columns, self.m, self.block = columns, columns.shape[1], block
        self.symbols = int(columns.max(initial=0)) + 1
        kinds = (columns.dtype, np.uint16, np.uint32, np.uint16)
        self.files, self.spare = [[Column(k) for k in kinds] for _ in range(2)]
        m = self.m
        for file, values in zip(self.files, (columns[0], np.zeros(m), np.arange(m), np.zeros(m))):
            file.append(values)
        counts = np.bincount(columns[0], minlength=self.symbols)
        at = np.flatnonzero(columns[0])  # the places of the symbols to be inserted next
        who = at.copy()  # their strings
        for r in range(1, len(columns)):
            if not len(at):
                break
            at, who = self._round(r, at, who, counts)

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        yield from zip(*(f.blocks(self.block) for f in self.files))

    def close(self) -> None:
        for f in (*self.files, *self.spare):
            f.file.close()

    def _round(self, r: int, at: np.ndarray, who: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Insert the suffixes of length r; returns the next symbols' places and strings."""
        place, own, then = self._find(at, counts)
        by = np.argsort(place, kind="stable")
        place, own, then, who = place[by], own[by], then[by], who[by]
        symbol = self.columns[r, who]
        before = place - np.arange(len(place))  # the old entry that each comes before
        last = np.append(before[1:] != before[:-1], True)  # the next one in order is an old entry
        added = (symbol, own, who, np.full(len(who), r))
        base = 0
        for file in self.spare:
            file.rewrite()
        for blocks in self.rows():
            n = len(blocks[0])
            final = base + n == self.files[0].n
            lo, hi = np.searchsorted(before, base), len(before) if final else np.searchsorted(before, base + n)
            where = before[lo:hi] - base
            mend = last[lo:hi] & (then[lo:hi] > 0) & (where < n)
            blocks[1][where[mend]] = then[lo:hi][mend]
            for file, old, new in zip(self.spare, blocks, added):
                file.append(np.insert(old, where, new[lo:hi]) if hi > lo else old)
            base += n
        self.files, self.spare = self.spare, self.files
        counts += np.bincount(symbol, minlength=self.symbols)
        more = symbol != 0
        return place[more], who[more]

    def _find(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the symbols at sorted places: where their suffixes go, and these' common prefixes
        with the one before and the one after (0: another symbol)."""
        place, own, then = np.empty(len(at), np.int64), np.zeros(len(at), np.uint16), np.zeros(len(at), np.uint16)
        smaller = self.m + np.concatenate([[0, 0], np.cumsum(counts[1:-1])])
        seen = np.zeros(self.symbols, np.int64)
        low = np.full(self.symbols, _FAR)  # least lcp since the symbol was last seen
        waiting = np.full(self.symbols, -1)  # the insertion that waits for the symbol's next place
        base = 0
        for bwt, lcp in zip(self.files[0].blocks(self.block), self.files[1].blocks(self.block)):
            n = len(bwt)
            here = np.bincount(bwt, minlength=self.symbols)
            order = np.argsort(bwt, kind="stable")[here[0] :]
            s = bwt[order]
            new = np.append(True, s[1:] != s[:-1])[: len(s)]
            first = np.flatnonzero(new)
            if base:  # the symbols' first places in this block meet what an earlier one left
                c = s[first]
                reach = np.minimum(low[c], np.minimum.accumulate(lcp)[order[first]])
                wait = waiting[c]
                then[wait[wait >= 0]] = 1 + reach[wait >= 0]
                waiting[c] = -1
            lo, hi = np.searchsorted(at, (base, base + n))
            if hi > lo:
                is_new = np.zeros(n, bool)
                is_new[at[lo:hi] - base] = True
                t = np.flatnonzero(is_new[order])  # in the order of symbols
                i = lo + np.searchsorted(at[lo:hi], order[t] + base)
                c = s[t]
                start = np.zeros(self.symbols, np.int64)
                start[s[first]] = first
                place[i] = smaller[c] + seen[c] + t - start[c]
                inner = ~new[t]
                own[i[inner]] = 1 + _range_min(lcp, order[t[inner] - 1] + 1, order[t[inner]] + 1)
                if base:
                    outer = new[t] & (seen[c] > 0)
                    reach_of = np.zeros(self.symbols, np.uint16)
                    reach_of[s[first]] = reach
                    own[i[outer]] = 1 + reach_of[c[outer]]
                follows = t + 1 < len(s)
                follows[follows] = ~new[t[follows] + 1]
                then[i[follows]] = 1 + _range_min(lcp, order[t[follows]] + 1, order[t[follows] + 1] + 1)
                waiting[c[~follows]] = i[~follows]
            base += n
            if base < self.files[0].n:
                seen += here
                least = np.append(np.minimum.accumulate(lcp[::-1])[::-1], _FAR)
                np.minimum(low, least[0], out=low)
                if len(s):
                    ends = np.append(first[1:], len(s)) - 1
                    low[s[first]] = least[order[ends] + 1]
        return place, own, then


def _pair(a: np.ndarray, step: int, b: np.ndarray) -> np.ndarray:
    """Numbers, from 0 on, for the pairs (a[i], b[i + step])."""
    n = max(0, min(len(a), len(b) - step))
    key = a[:n].astype(np.uint64) * np.uint64(int(b.max(initial=0)) + 1) + b[step : step + n].astype(np.uint64)
    return np.unique(key, return_inverse=True)[1]


def symbols_of(buf: np.ndarray, stride: int) -> np.ndarray:
    """A number for the `stride` bytes from each place on; equal bytes have equal numbers."""
    code, wide, out, have = buf.astype(np.int64), 1, None, 0
    if stride % 8 == 0:
        packed = np.zeros(max(0, len(buf) - 7), np.uint64)
        for i in range(8):
            packed = (packed << np.uint64(8)) | buf[i : i + len(packed)]
        code, wide = np.unique(packed, return_inverse=True)[1], 8
    while True:
        if stride & wide:
            out, have = (code, wide) if out is None else (_pair(out, have, code), have + wide)
        if have == stride:
            return out
        code, wide = _pair(code, wide, code), 2 * wide


def columns_of(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of byte strings over symbols of `stride` bytes, which are numbered.

    A string gives `stride` sequences, one for each byte to start from, so that every byte of
    it starts a suffix. Returns the columns and each sequence's string and end in bytes.
    """
    symbol = symbols_of(buf, stride)
    string = np.repeat(np.arange(len(starts)), stride)
    first = np.tile(np.arange(stride), len(starts))
    n = np.maximum(0, lengths[string] - first) // stride
    end = first + stride * n
    back = np.arange(int(n.max(initial=0)) + 1)[:, None]
    at = starts[string] + end - stride * (back + 1)
    used = back < n
    columns = np.zeros(at.shape, np.min_scalar_type(int(symbol.max(initial=0)) + 1))
    columns[used] = symbol[at[used]] + 1
    return columns, string, end


def repeated_windows(strings: list[bytes], weights: np.ndarray, width: int, stride: int = STRIDE, block: int = BLOCK) -> list[np.ndarray]:
    """For each string, the starts of its windows of `width` bytes (a multiple of the stride)
    that occur at least twice in the collection, where a string counts `weights` times."""
    lengths = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    columns, owner, end = columns_of(np.frombuffer(b"".join(strings), np.uint8), starts, lengths, stride)
    built, least, found = CollectionBWT(columns, block), width // stride, []
    held: list[tuple[np.ndarray, ...]] = []  # the suffixes of a run that may go on in the next block

    def decide(part: tuple[np.ndarray, ...]) -> None:
        lcp, who, length = part
        run = np.cumsum(lcp < least)
        long = length >= least
        total = np.bincount(run, weights=weights[owner[who]] * long)
        again = long & (total[run] >= 2)
        found.append((owner[who[again]], end[who[again]] - stride * length[again].astype(np.int64)))

    for _, *part in built.rows():
        cut = np.flatnonzero(part[0] < least)
        if len(cut):
            decide(tuple(map(np.concatenate, zip(*held, [x[: cut[-1]] for x in part]))))
            held, part = [], [x[cut[-1] :] for x in part]
        held.append(tuple(part))
    if held:
        decide(tuple(map(np.concatenate, zip(*held))))
    built.close()
    if not found:
        return [np.empty(0, np.int64) for _ in strings]
    string, start = map(np.concatenate, zip(*found))
    by = np.lexsort((start, string))
    string, start = string[by], start[by]
    return np.split(start, np.searchsorted(string, np.arange(1, len(strings))))
