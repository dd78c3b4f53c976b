"""Content-defined chunking by a gear hash, in the steps of the FastCDC paper.

The hash of a place is a sum of the last bytes' gear values, each doubled once for every byte since, so
its k low bits depend on the last k bytes alone. All places' low bits are computed at once; cut places
are then those whose bits under a mask are zero."""

from __future__ import annotations

import numpy as np

#: Fixed value: the seed of java.util.Random from which the gear values come.
GEAR_SEED = 0x9E3779B97F4A7C15


def java_longs(seed: int, n: int) -> list[int]:
    """java.util.Random(seed).nextLong(), n times, as unsigned."""
    state, out = (seed ^ 0x5DEECE66D) & (1 << 48) - 1, []
    for _ in range(n):
        halves = []
        for _ in range(2):
            state = (state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
            x = state >> 16
            halves.append(x - (1 << 32) if x >= 1 << 31 else x)
        out.append(((halves[0] << 32) + halves[1]) & (1 << 64) - 1)
    return out


GEAR = np.array(java_longs(GEAR_SEED, 256), dtype=np.uint64)


def cuts(data: bytes, least: int = 4096, average: int = 16384, most: int = 65536) -> list[int]:
    """Where the chunks of data end. average: a power of two, between least and most."""
    if not 0 < least <= average <= most or average & average - 1:
        raise ValueError("sizes: 0 < least <= average <= most, average a power of two")
    n = len(data)
    if not n:
        return []
    bits = average.bit_length() - 1
    strict_bits, loose_bits = bits + 2, max(bits - 2, 0)
    kind = np.uint16 if strict_bits <= 16 else np.uint32 if strict_bits <= 32 else np.uint64  # low bits need no more
    gear = GEAR.astype(kind)[np.frombuffer(data, np.uint8)]
    low = gear.copy()
    for k in range(1, min(strict_bits, n)):
        low[k:] += gear[:-k] << kind(k)
    strict = np.flatnonzero(low & kind((1 << strict_bits) - 1) == 0)
    loose = np.flatnonzero(low & kind((1 << loose_bits) - 1) == 0)
    out, start = [], 0
    while start < n:
        if n - start <= least:
            out.append(n)
            break
        stop = min(n, start + most)
        middle = min(start + average, stop)
        first = start + least
        end = _first(gear, strict, first, middle, strict_bits, first) or _first(gear, loose, middle, stop, loose_bits, first) or stop
        out.append(end)
        start = end
    return out


def _first(gear: np.ndarray, places: np.ndarray, lo: int, hi: int, bits: int, origin: int) -> int:
    """The end after the first place in [lo, hi) whose hash, begun at origin, has its low bits zero; 0 if none.

    Places less than `bits` after the origin lack some terms of the precomputed sum and are summed anew."""
    near = min(hi, origin + bits - 1)
    h = 0
    for i in range(origin, near):
        h = (h << 1) + int(gear[i])
        if i >= lo and h & (1 << bits) - 1 == 0:
            return i + 1
    k = int(np.searchsorted(places, max(lo, near)))
    return int(places[k]) + 1 if k < len(places) and places[k] < hi else 0


class Cutter:
    """Ends of chunks for any starts within data at once. data: of a stream from some place on, to its end or to
    `most` bytes behind the last start that is asked about."""

    def __init__(self, data: bytes, least: int, average: int, most: int):
        self.n, self.least, self.average, self.most = len(data), least, average, most
        bits = average.bit_length() - 1
        self.strict_bits, self.loose_bits = bits + 2, max(bits - 2, 0)
        self.kind = kind = np.uint16 if self.strict_bits <= 16 else np.uint32 if self.strict_bits <= 32 else np.uint64
        gear = GEAR.astype(kind)[np.frombuffer(data, np.uint8)]
        self.low = gear.copy()
        for k in range(1, min(self.strict_bits, self.n)):
            self.low[k:] += gear[:-k] << kind(k)
        self.places = {b: np.flatnonzero(self.low & kind((1 << b) - 1) == 0) for b in (self.strict_bits, self.loose_bits)}

    def _found(self, first: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
        """The end after the first place in [lo, hi) whose hash, begun at first, has its low bits zero; 0 if none."""
        out = np.zeros(len(first), np.int64)
        mask = self.kind((1 << bits) - 1)
        before = np.where(first > 0, self.low[np.minimum(np.maximum(first - 1, 0), self.n - 1)], self.kind(0))
        for d in range(bits - 1):  # what the bytes before first add is taken away
            at = first + d
            asked = np.flatnonzero((out == 0) & (at >= lo) & (at < hi))
            if len(asked):
                h = self.low[at[asked]] - (before[asked] << self.kind(d + 1))
                hit = asked[h & mask == 0]
                out[hit] = at[hit] + 1
        places = self.places[bits]
        if len(places):
            k = np.searchsorted(places, np.maximum(lo, np.minimum(hi, first + bits - 1)))
            far = places[np.minimum(k, len(places) - 1)]
            ok = (out == 0) & (k < len(places)) & (far < hi)
            out[ok] = far[ok] + 1
        return out

    def ends(self, starts: np.ndarray) -> np.ndarray:
        stop = np.minimum(self.n, starts + self.most)
        middle, first = np.minimum(starts + self.average, stop), starts + self.least
        end = self._found(first, first, middle, self.strict_bits)
        later = np.flatnonzero(end == 0)
        end[later] = self._found(first[later], middle[later], stop[later], self.loose_bits)
        end = np.where(end == 0, stop, end)
        return np.where(self.n - starts <= self.least, self.n, end)

    def leads(self, upto: int) -> np.ndarray:
        """Where the chunks that begin at 0, 1, ... most - 1 lead to: the first start at or behind `upto`, less
        upto. Chains that meet are followed once."""
        at, of = np.unique(np.minimum(np.arange(self.most), self.n), return_inverse=True)
        while (open_ := np.flatnonzero(at < min(upto, self.n))).size:
            at[open_] = self.ends(at[open_])
            at, back = np.unique(at, return_inverse=True)
            of = back[of]
        return np.maximum(at[of] - upto, 0)

    def chain(self, start: int, upto: int) -> list[int]:
        """The starts from `start` on that are before upto, and the end of the last chunk."""
        out = [start]
        while out[-1] < min(upto, self.n):
            out.append(int(self.ends(np.array(out[-1:]))[0]))
        return out
