"""The gear hash and content-defined cuts of one byte string."""

from __future__ import annotations

import math
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np

_M64, _M32 = (1 << 64) - 1, (1 << 32) - 1
# Fixed values of the table's generator; the mixed value is the next state.
_STEP, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _generate() -> tuple[int, ...]:
    out, x = [], _STEP
    while len(out) < 256:
        x = x + _STEP & _M64
        for shift, factor in ((30, _MIX1), (27, _MIX2)):
            x = (x ^ x >> shift) * factor & _M64
        out.append((x ^ x >> 31) & _M32)
    return tuple(out)


GEAR = _generate()
_LANES = np.array(GEAR, np.uint32)
#: Lanes that are worth a step in common, lanes at most, and steps whose table values are looked up at a time.
FEW, MOST, AHEAD = 16, 4096, 512


@dataclass(frozen=True)
class Cuts:
    """Where chunks end: average, least and largest size, hash ('rotate', or 'shift', which forgets bytes after 32),
    and read_grid: 0, or the block length of a reader that hashes an unfinished chunk again with every block."""

    avg: int = 64 << 10
    least: int = 8 << 10
    most: int = 1 << 20
    hash: str = "rotate"
    read_grid: int = 0

    def __post_init__(self) -> None:
        if self.hash not in ("rotate", "shift") or not 0 < self.least <= self.most or self.avg < 1:
            raise ValueError(f"not a chunking: {self}")

    @property
    def mask(self) -> int:
        return (1 << min(23, max(1, math.floor(math.log2(self.avg) + 0.5)))) - 1

    def ends(self, data: bytes) -> list[int]:
        """Ends of the chunks, the last being the data's; none for no data."""
        if not self.read_grid or len(data) <= self.read_grid:
            done, ends, _ = self._scan(data, 0)
            return ends + [len(data)] if done < len(data) else ends
        ends, start, h = [], 0, 0
        for at in range(0, len(data), self.read_grid):
            stop = min(len(data), at + self.read_grid)
            done, found, h = self._scan(data[start:stop], h)
            ends += [start + x for x in found]
            start += done
        return ends + [len(data)] if start < len(data) else ends

    def ends_of_all(self, datas: list[bytes]) -> list[list[int]]:
        """ends() of many strings. Strings are dealt into lanes of like length, one after the other in a lane, and all
        lanes advance by one byte in each step. A string too long for that, beside the others, goes alone: where a
        chunk ends depends on all bytes since the last end, so one string has no steps that could be taken apart."""
        out: list[list[int]] = [[] for _ in datas]
        sizes = [len(d) for d in datas]
        left = sum(sizes)
        order = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: -sizes[i])
        some = []
        for i in order:
            if sizes[i] * FEW > left or (self.read_grid and sizes[i] > self.read_grid):
                out[i] = self.ends(datas[i])
                left -= sizes[i]
            else:
                some.append(i)
        if some:
            for i, ends in zip(some, self._lanes([datas[i] for i in some], min(MOST, left // sizes[some[0]])), strict=True):
                out[i] = ends
        return out

    def _lanes(self, datas: list[bytes], lanes: int) -> list[list[int]]:
        """ends() of strings that are not empty, the longest first, in so many lanes."""
        loads = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        place = np.zeros(len(datas), np.int64)
        for i, d in enumerate(datas):
            load, k = heappop(loads)
            held[k].append(i)
            place[i] = load
            heappush(loads, (load + len(d), k))
        steps = max(load for load, _ in loads)
        flat = np.frombuffer(b"".join(b"".join([datas[i] for i in own]).ljust(steps, b"\0") for own in held), np.uint8).reshape(lanes, steps)
        lane = np.zeros(len(datas), np.int64)
        for k, own in enumerate(held):
            lane[own] = k
        last = place + np.array([len(d) for d in datas])
        by = np.argsort(last, kind="stable")
        stops, owners = last[by], lane[by]
        edge = np.flatnonzero(np.diff(stops, prepend=-1)).tolist() + [len(stops)]
        h, start, turned, high = np.zeros(lanes, np.uint32), np.zeros(lanes, np.int64), np.empty(lanes, np.uint32), np.empty(lanes, np.uint32)
        mask, one, top, wrap = np.uint32(self.mask), np.uint32(1), np.uint32(31), self.hash == "rotate"
        found, at, turn, due, stop = [], [], 0, self.most, int(stops[0])
        for t0 in range(0, steps, AHEAD):
            for t, g in enumerate(_LANES[np.ascontiguousarray(flat[:, t0 : t0 + AHEAD].T)], t0 + 1):
                np.left_shift(h, one, out=turned)
                if wrap:
                    np.right_shift(h, top, out=high)
                    np.bitwise_or(turned, high, out=turned)
                np.add(turned, g, out=h)
                np.bitwise_and(h, mask, out=high)
                cut = None
                if not high.all():
                    cut = np.flatnonzero(high == 0)
                    cut = cut[t - start[cut] >= self.least]
                if t >= due:
                    full = np.flatnonzero(t - start >= self.most)
                    cut = full if cut is None else np.union1d(cut, full)
                if t == stop:
                    ended = owners[edge[turn] : edge[turn + 1]]
                    cut = ended if cut is None else np.union1d(cut, ended)
                    turn += 1
                    stop = int(stops[edge[turn]]) if turn + 1 < len(edge) else -1
                if cut is not None and len(cut):
                    found.append(cut)
                    at.append(t)
                    h[cut] = 0
                    start[cut] = t
                if t >= due:
                    due = int(start.min()) + self.most
        ends = np.sort(np.concatenate(found) * (steps + 1) + np.repeat(at, [len(x) for x in found]))
        first = lane * (steps + 1) + place
        a, z = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, lane * (steps + 1) + last, side="right")
        return [(ends[i:j] - f).tolist() for i, j, f in zip(a.tolist(), z.tolist(), first.tolist(), strict=True)]

    def _scan(self, data: bytes, h: int, held: int = 0) -> tuple[int, list[int], int]:
        """End of the last chunk closed, all ends, and the hash of what is open; held bytes came before the data."""
        gear, mask, least, most, start, out = GEAR, self.mask, self.least, self.most, -held, []
        wrap = self.hash == "rotate"
        for i, byte in enumerate(data, 1):
            h = ((h << 1) + (h >> 31 if wrap else 0) & _M32) + gear[byte] & _M32
            size = i - start
            if size >= most or (size >= least and not h & mask):
                out.append(i)
                start, h = i, 0
        return max(0, start), out, h
