"""External induced sorting of suffixes, with common prefixes.

The suffixes of a string are of type S (less than the next suffix) or L. The leftmost S suffixes of each
run are ordered first: one induction orders the substrings between them, these get names, and where names
repeat the string of names is sorted by recursion. A second induction then orders all suffixes. An
induction sweeps twice over a priority queue of suffix tuples (position, common prefix with the tuple
before): a tuple that is taken out induces the one for the suffix a place before it, which is put in
under its first symbol, behind all others of that symbol. What two neighbours under one symbol have in
common is one more than the least common prefix met between the two tuples that induced them, so prefix
lengths are carried along and never compared anew; only where S follows L under a symbol does the run of
that symbol decide.

The queue keeps the `room` tuples due next in memory. Others wait on disk, a file for each later range of
priorities, until their range is due; so its memory doesn't grow with the string. Tuples are taken out in
bulk, up to the first whose place is still open. Arrays as long as the string are mapped from disk where
they exceed `room`."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BATCH = 1 << 13
LOG = np.maximum(np.frexp(np.arange(BATCH + 1))[1].astype(np.int64) - 1, 0)
ZERO, PLACES = np.zeros(1, np.int64), np.arange(BATCH, dtype=np.int64)
POWER = 1 << np.arange(BATCH.bit_length(), dtype=np.int64)


def scratch_folder() -> str:
    """Where the cluster lets tasks spill."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()


def places(n: int) -> type:
    """Of numbers up to n."""
    return np.int32 if n < 1 << 31 else np.int64


class Scratch:
    """A folder for the time of one sort, and arrays that lie in it where they are long."""

    def __init__(self, room: int, folder: str | None = None):
        self.room, self.count, self.mapped = room, 0, 0
        self.path = tempfile.mkdtemp(dir=folder or scratch_folder(), prefix="induced-")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        shutil.rmtree(self.path, ignore_errors=True)

    def file(self) -> str:
        self.count += 1
        return os.path.join(self.path, str(self.count))

    def array(self, n: int, kind: type) -> np.ndarray:
        if n <= self.room:
            return np.zeros(n, kind)
        self.mapped += 1
        return np.memmap(self.file(), kind, "w+", shape=(n,))

    def parts(self, n: int) -> Iterator[slice]:
        for at in range(0, n, self.room):
            yield slice(at, min(n, at + self.room))


TUPLE = np.dtype([("slot", np.int64), ("position", np.int64), ("common", np.uint16)])


class Queue:
    """A priority queue of suffix tuples. A priority is a slot: the slots of a symbol follow each other,
    and are given out in the order of arrival, so that every slot gets one tuple in the end."""

    def __init__(self, scratch: Scratch, slots: int, kind: type):
        self.scratch, self.slots, self.room, self.kind = scratch, slots, scratch.room, kind
        self.from_, self.to = 0, 0
        self.waiting: dict[int, tuple[str, list[np.ndarray], int]] = {}

    def advance(self) -> bool:
        """Makes the next range of priorities the current one."""
        self.from_, self.to = self.to, min(self.slots, self.to + self.room)
        if self.from_ == self.to:
            return False
        self.position = np.full(self.to - self.from_, -1, self.kind)
        self.common = np.zeros(self.to - self.from_, np.uint16)
        path, held, spilled = self.waiting.pop(self.from_ // self.room, ("", [], 0))
        if spilled:
            with open(path, "rb") as f:
                while len(part := np.fromfile(f, TUPLE, self.room // 4 + 1)):
                    self._place(part["slot"], part["position"], part["common"])
            os.remove(path)
        for part in held:
            self._place(part["slot"], part["position"], part["common"])
        return True

    def _place(self, slot: np.ndarray, position: np.ndarray, common: np.ndarray) -> None:
        self.position[slot - self.from_] = position
        self.common[slot - self.from_] = common

    def put(self, slot: np.ndarray, position: np.ndarray, common: np.ndarray) -> None:
        """Tuples in ascending order of their slots."""
        n = int(np.searchsorted(slot, self.to)) if len(slot) and slot[-1] >= self.to else len(slot)
        if n == len(slot):
            self._place(slot, position, common)
            return
        self._place(slot[:n], position[:n], common[:n])
        slot, position, common = slot[n:], position[n:], common[n:]
        bounds = np.flatnonzero(np.diff(slot // self.room)) + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(slot)], strict=True):
            key = int(slot[a]) // self.room
            path, held, spilled = self.waiting.get(key) or (self.scratch.file(), [], 0)
            part = np.empty(b - a, TUPLE)
            part["slot"], part["position"], part["common"] = slot[a:b], position[a:b], common[a:b]
            held.append(part)
            if sum(map(len, held)) > self.room // 16:
                with open(path, "ab") as f:
                    for p in held:
                        p.tofile(f)
                held, spilled = [], 1
            self.waiting[key] = (path, held, spilled)


class Least:
    """The least common prefix since the last tuple that a symbol got: within batches by a table of
    ranges, over batches by the last batch that fell to each value."""

    def __init__(self, symbols: int, most: int):
        self.most, self.batch = most, 0
        self.table = np.zeros((BATCH.bit_length(), BATCH), np.uint16)
        self.flat, self.suffix = self.table.reshape(-1), np.zeros(BATCH + 1, np.uint16)
        self.last = np.full(symbols, -1, np.int64)  # the last batch from which the symbol got a tuple
        self.since = np.zeros(symbols, np.uint16)  # the least after that tuple within that batch
        self.fell = np.full(most + 1, -1, np.int64)  # the last batch whose least was at most this

    def between(self, d: np.ndarray, c: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For tuples induced from places `at` of the batch d, in groups [starts, ends) of the symbols c: the
        common prefix with the tuple before them under their symbol. Ends the batch."""
        n, table = len(d), self.table
        table[0, :n] = d
        for k in range(1, int(LOG[n]) + 1):
            w = 1 << (k - 1)
            np.minimum(table[k - 1, : n - 2 * w + 1], table[k - 1, w : n - w + 1], out=table[k, : n - 2 * w + 1])
        out = np.empty(len(at), np.uint16)
        low, high = at[:-1], at[1:]
        level = LOG.take(high - low, mode="clip")  # places of another symbol may come before, and get no use of it
        row = level * BATCH + 1
        np.minimum(self.flat.take(row + low, mode="clip"), self.flat.take(row + high - POWER.take(level), mode="clip"), out=out[1:])
        np.minimum(out, self.most - 1, out=out)
        out += 1
        self.suffix[:n] = np.minimum.accumulate(d[::-1])[::-1]
        self.suffix[n] = self.most
        seen = self.last[c]
        over = self.fell.searchsorted(seen + 1)  # the least of the batches after the last; most + 1 if there is none
        first = np.minimum(np.minimum(np.minimum.accumulate(d)[at[starts]], self.since[c]), np.minimum(over, self.most - 1)) + 1
        out[starts] = np.where(seen < 0, 0, np.minimum(first, self.most))
        self.since[c] = self.suffix[at[ends - 1] + 1]
        self.last[c] = self.batch
        self.end(int(self.suffix[0]))
        return out

    def end(self, least: int) -> None:
        self.fell[least:] = self.batch
        self.batch += 1


@dataclass
class Buckets:
    """How many suffixes of each type begin with each symbol."""

    large: np.ndarray
    small: np.ndarray
    leftmost: np.ndarray


def run_lengths(code: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """How often the symbol at each place is repeated from there on."""
    out = np.ones(len(at), np.int64)
    live = np.arange(len(at))
    first = code[at] >> 1
    for k in range(1, most):
        live = live[at[live] + k < len(code)]
        live = live[(code[at[live] + k] >> 1) == first[live]]
        if not len(live):
            break
        out[live] += 1
    return out


def sweep(code: np.ndarray, scratch: Scratch, slots: int, free: np.ndarray, placed: tuple[np.ndarray, np.ndarray, np.ndarray], small: int, seams: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One sweep: (position, common prefix with the one before) of all tuples in order, range by range.

    code: symbol * 2 + type. free: the first slot of each symbol for induced tuples. placed: slots, positions
    and common prefixes of the tuples known before. small: whether S or L suffixes are induced. seams: slots
    whose common prefix with the slot before is that of a run. most: 0 if common prefixes aren't wanted."""
    queue, least = Queue(scratch, slots, places(len(code))), Least(len(free), most) if most else None
    before, slot_of, position_of, common_of = -1, *placed
    last = code.dtype.type(len(free) - 1)
    while queue.advance():
        lo, hi = np.searchsorted(slot_of, (queue.from_, queue.to))
        queue._place(slot_of[lo:hi], position_of[lo:hi], common_of[lo:hi] if most else 0)
        at, n, size, from_ = 0, queue.to - queue.from_, 1024, queue.from_
        position, shared = queue.position, queue.common
        while at < n:
            p = position[at : at + size]
            open_ = p < 0
            k = int(open_.argmax())
            if open_[k]:
                p = p[:k]
            k = len(p)
            if not k:
                raise RuntimeError("nothing induces the suffix that is due")
            size = min(BATCH, 2 * size if k == size else max(256, 2 * k))
            if most:
                lo, hi = seams.searchsorted((from_ + at, from_ + at + k))
                if hi > lo:
                    own = seams[lo:hi] - from_
                    left = np.where(own > 0, position[own - 1], before)
                    shared[own] = np.minimum(run_lengths(code, left, most), run_lengths(code, position[own], most))
            d = shared[at : at + k]
            at += k
            prior = code[p - 1]  # before the first place stands one that is never induced
            go = (prior & 1 == small).nonzero()[0]
            if not len(go):
                if most:
                    least.end(int(d.min()))
                continue
            symbol = prior[go] >> 1
            order = (last - symbol if small else symbol).argsort(kind="stable")  # slots are given in ascending order
            symbol, go = symbol[order], go[order]
            ends = (symbol[1:] != symbol[:-1]).nonzero()[0] + 1
            starts, ends = np.concatenate([ZERO, ends]), np.concatenate([ends, [len(go)]])
            c = symbol[starts]
            f = free[c]
            free[c] = f + ends - starts
            slot = np.repeat(f - starts, ends - starts) + PLACES[: len(go)]
            common = least.between(d, c, starts, ends, go) if most else None
            if slot[-1] < queue.to:
                if from_:
                    slot -= from_
                position[slot] = p[go] - 1
                if most:
                    shared[slot] = common
            else:
                queue.put(slot, p[go] - 1, common if most else np.zeros(len(go), np.uint16))
        before = int(queue.position[-1])
        yield queue.position, queue.common


def starts_of(*counts: np.ndarray) -> np.ndarray:
    """The first slot of each symbol, if each symbol takes as many slots as all counts say."""
    return np.concatenate([[0], np.cumsum(sum(counts))[:-1]]).astype(np.int64)


def induce(code: np.ndarray, buckets: Buckets, leftmost: np.ndarray, common: np.ndarray | None, scratch: Scratch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes, the greatest first, each with what it has in common with the one before, from the
    leftmost S suffixes in order with their common prefixes."""
    n = len(code) - 1
    # the first sweep takes L and leftmost S suffixes in ascending order
    free = starts_of(buckets.large, buckets.leftmost)
    own = free + buckets.large
    slot = scratch.array(len(leftmost), places(n))
    slot[:] = np.repeat(own - starts_of(buckets.leftmost), buckets.leftmost) + np.arange(len(leftmost))
    seams = own[(buckets.large > 0) & (buckets.leftmost > 0)]
    total = int(buckets.large.sum())
    large, shared = scratch.array(total, places(n)), scratch.array(total + 1, np.uint16)
    at = 0
    for position, d in sweep(code[:n], scratch, total + len(leftmost), free, (slot, leftmost, common), 0, seams, most):
        keep = np.flatnonzero(code[position] & 1 == 0)
        large[at : at + len(keep)], shared[at : at + len(keep)] = position[keep], d[keep]
        at += len(keep)
    # the second takes L and S suffixes in descending order: symbols, and the tuples of each, turned round
    large_down, small_down = buckets.large[::-1], buckets.small[::-1]
    base = starts_of(large_down, small_down)
    own = base + small_down
    slot, placed, together = scratch.array(total + 1, places(n)), scratch.array(total + 1, places(n)), scratch.array(total + 1, np.uint16)
    slot[:total] = np.repeat(own - starts_of(large_down), large_down) + np.arange(total)
    for part in scratch.parts(total):
        placed[part] = large[total - part.stop : total - part.start][::-1]
        together[part] = shared[total - part.stop + 1 : total - part.start + 1][::-1]
    slot[total] = placed[total] = n - 1  # the least suffix of all, which follows none that could induce it
    seams = own[(small_down > 0) & (large_down > 0)]
    yield from sweep(code, scratch, n, base[::-1].copy(), (slot, placed, together), 1, seams, most)


def typed(t: np.ndarray, symbols: int, scratch: Scratch) -> np.ndarray:
    """symbol * 2 + 1 for S, symbol * 2 for L suffixes; and one 0 more."""
    n = len(t)
    code = scratch.array(n + 1, np.uint16 if symbols < 1 << 15 else np.int32 if symbols < 1 << 30 else np.int64)
    after, small = -1, True  # of the suffix behind the part
    for part in reversed(list(scratch.parts(n))):
        x = t[part].astype(places(symbols))
        step = np.sign(np.append(x[1:], after) - x)
        if part.stop == n:
            step[-1] = 1
        decided = np.where(step != 0, np.arange(len(x), dtype=places(n)), places(n)(len(x)))
        nearest = np.minimum.accumulate(decided[::-1])[::-1]
        s = np.append(step > 0, small)[nearest]
        code[part] = 2 * x + s
        after, small = int(x[0]), bool(s[0])
    return code


def extended(t: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of the suffixes x and y that agree in `known` symbols at least, up to `most`."""
    out = np.minimum(known, most).astype(np.int64)
    live = np.flatnonzero(out < most)
    while len(live):
        live = live[t[x[live] + out[live]] == t[y[live] + out[live]]]
        out[live] += 1
        live = live[out[live] < most]
    return out.astype(np.uint16)


def equal(t: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` symbols from each x on are those from y on."""
    out = np.zeros(len(x), bool)
    live, k = np.arange(len(x)), 0
    while len(live):
        live = live[t[x[live] + k] == t[y[live] + k]]
        k += 1
        ended = size[live] <= k
        out[live[ended]] = True
        live = live[~ended]
    return out


def sorted_suffixes(t: np.ndarray, symbols: int, scratch: Scratch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of t, the greatest first, each with the length, up to `most`, of what it has in common with
    the one before. t holds numbers under `symbols`, and 0 at its end alone."""
    n = len(t)
    code = typed(t, symbols, scratch)
    kinds = np.zeros((2, symbols), np.int64)
    first = np.zeros(symbols, np.int64)
    found = []
    for part in scratch.parts(n):
        x = code[part]
        own, s = x >> 1, x & 1 == 1
        kinds[0] += np.bincount(own[~s], minlength=symbols)
        kinds[1] += np.bincount(own[s], minlength=symbols)
        lag = np.append(code[part.start - 1 : part.start] & 1 == 0, ~s[:-1]) if part.start else np.append(False, ~s[:-1])
        left = np.flatnonzero(s & lag)
        first += np.bincount(own[left], minlength=symbols)
        found.append(left + part.start)
    leftmost = scratch.array(sum(map(len, found)), places(n))
    at = 0
    for f in found:
        leftmost[at : at + len(f)] = f
        at += len(f)
    del found
    buckets = Buckets(kinds[0], kinds[1], first)
    m = len(leftmost)
    if m < 2:
        ranked, common = leftmost, np.zeros(m, np.uint16)
    else:
        order = np.argsort(code[leftmost], kind="stable")
        ranked = scratch.array(m, places(n))
        at = m
        for position, _ in induce(code, buckets, leftmost[order], None, scratch, 0):
            p = position[position > 0]
            p = p[(code[p] & 1 == 1) & (code[p - 1] & 1 == 0)]
            ranked[at - len(p) : at] = p[::-1]
            at -= len(p)
        place = np.searchsorted(leftmost, ranked)
        size = np.append(np.diff(leftmost) + 1, 1)[place]
        fresh = np.ones(m, bool)
        fresh[1:] = size[1:] != size[:-1]
        alike = np.flatnonzero(~fresh)
        fresh[alike] = ~equal(t, ranked[alike], ranked[alike - 1], size[alike])
        if fresh.all():
            known = np.zeros(m, np.int64)
        else:
            names = scratch.array(m, places(m))
            names[place] = np.cumsum(fresh) - 1
            at, rank, known = m, scratch.array(m, places(m)), scratch.array(m, places(n))
            for position, d in sorted_suffixes(names, int(fresh.sum()), scratch, most):
                k = len(position)
                rank[at - k : at] = position[::-1]
                if at < m:
                    known[at] = d[0]
                known[at - k + 1 : at] = d[1:][::-1]
                at -= k
            ranked = leftmost[rank]
            known[1:] = leftmost[rank[1:] + known[1:]] - ranked[1:]
        common = np.zeros(m, np.uint16)
        common[1:] = extended(t, ranked[1:], ranked[:-1], known[1:], most)
    yield from induce(code, buckets, ranked, common, scratch, most)
