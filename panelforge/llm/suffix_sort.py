"""External induced sorting: suffixes of a text larger than memory, in order, with their common prefixes.

The text and all arrays as long as it are mapped from files once they pass the bound. Queues of (symbol, place, common
prefix) hold a bound in memory and write sorted runs beyond it. The suffixes that begin a falling-to-rising turn (LMS)
are ranked by recursion over the names of the substrings between them, until the names fit the bound.
"""

from __future__ import annotations

import heapq
import os
import tempfile

import numpy as np

MEMORY = 96 << 20
"""Bytes that a queue holds, and from which on an array is mapped from a file; places a block, and bytes an entry and a list of entries take."""
_BLOCK, _ENTRY, _PART = 1 << 16, 14, 200


def room(n: int, dtype, memory: int) -> np.ndarray:
    """An array of ``n`` items, mapped from an unlinked file if it is larger than the bound."""
    size = n * np.dtype(dtype).itemsize
    if size <= memory:
        return np.empty(n, dtype=dtype)
    with tempfile.TemporaryFile() as file:
        file.truncate(size)
        return np.memmap(file, dtype=dtype, mode="r+", shape=(n,))


def _whole(n: int) -> type:
    """Type of places in a text of ``n`` symbols."""
    return np.int32 if n < 1 << 31 else np.int64


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of integers from 0 on, by 16 bits at a time, for which numpy counts instead of comparing."""
    by, most, shift = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable"), int(keys.max()), 16
    while most >> shift:
        by = by[np.argsort((keys[by] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return by


class _Run:
    """A sorted run in the file of a queue, read once from front to back."""

    def __init__(self, file, fields: tuple[np.ndarray, ...], block: int):
        self.file, self.block = file, block
        self.n, self.at, self.begin, self.held = len(fields[0]), 0, 0, None
        self.kinds, self.starts = [f.dtype for f in fields], []
        for f in fields:
            self.starts.append(file.seek(0, os.SEEK_END))
            file.write(f.tobytes())

    def _field(self, k: int) -> np.ndarray:
        size = self.kinds[k].itemsize
        self.file.seek(self.starts[k] + self.at * size)
        return np.frombuffer(self.file.read(min(self.block, self.n - self.at) * size), dtype=self.kinds[k])

    def head(self) -> int | None:
        if self.at == self.n:
            self.held = None
            return None
        if self.held is None or self.at >= self.begin + len(self.held[0]):
            self.held, self.begin = [self._field(k) for k in range(len(self.kinds))], self.at
        return int(self.held[0][self.at - self.begin])

    def take(self, key: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        a = self.at - self.begin
        b = min(a + int(np.searchsorted(self.held[0][a:], key, "right")), a + most)
        self.at = self.begin + b
        return self.held[1][a:b], self.held[2][a:b]


class DiskQueue:
    """Priority queue of (key, place, common prefix): smallest key first, first in first out within a key.

    Keys pushed are never smaller than one that was popped, so runs on disk are only read forwards.
    """

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.near: dict[int, list] = {}
        self.keys: list[int] = []
        self.file, self.runs, self.heads = None, [], []

    def push(self, keys: np.ndarray, places: np.ndarray, prefixes: np.ndarray) -> None:
        """Entries sorted by key."""
        if not len(keys):
            return
        cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b, key in zip(cut, cut[1:], keys[cut[:-1]].tolist()):
            if key not in self.near:
                self.near[key] = []
                heapq.heappush(self.keys, key)
            self.near[key].append((places[a:b], prefixes[a:b]))
        self.held += _ENTRY * len(keys) + _PART * (len(cut) - 1)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """All that is held becomes a sorted run in the file."""
        self.file = self.file or tempfile.TemporaryFile()
        keys = sorted(self.near)
        sizes = [sum(len(p[0]) for p in self.near[k]) for k in keys]
        parts = zip(*(p for k in keys for p in self.near[k]))
        fields = np.repeat(np.array(keys, dtype=np.int64), sizes), *(np.concatenate(c) for c in parts)
        self.runs.append(_Run(self.file, fields, max(self.memory // (64 * _ENTRY), 64)))
        heapq.heappush(self.heads, (self.runs[-1].head(), len(self.runs) - 1))
        self.near, self.keys, self.held = {}, [], 0

    def next_key(self) -> int | None:
        heads = [k for k, _ in self.heads[:1]] + self.keys[:1]
        return min(heads) if heads else None

    def pop(self, key: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next entries of the smallest key, or None if it has no more."""
        if self.heads and self.heads[0][0] == key:
            number = self.heads[0][1]
            taken = self.runs[number].take(key, most)
            head = self.runs[number].head()
            if head is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (head, number))
            return taken
        if not self.keys or self.keys[0] != key:
            return None
        parts = self.near[key]
        used, n = 1, len(parts[0][0])
        while used < len(parts) and n + len(parts[used][0]) <= most:
            n, used = n + len(parts[used][0]), used + 1
        taken = parts[:used]
        del parts[:used]
        self.held -= _ENTRY * n + _PART * used
        if not parts:
            del self.near[key]
            heapq.heappop(self.keys)
        return taken[0] if used == 1 else tuple(np.concatenate(c) for c in zip(*taken))


class _Minima:
    """Smallest common prefix since the last push of each symbol, over the suffixes in the order they are taken."""

    def __init__(self, symbols: int, depth: int, memory: int):
        self.depth, self.taken = depth, 0
        self.batch = room(symbols, np.int64, memory)
        self.batch[:] = -1
        self.rest = room(symbols, np.int16, memory)
        self.ids, self.values = [], []  # minima of batches, rising from the first to the last

    def pushed(self, prefixes: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Common prefixes of what the entries ``at`` of a batch push, sorted by symbol, with the push before."""
        n, out = len(prefixes), np.zeros(0, dtype=np.int16)
        if len(at):
            first = np.concatenate(([True], symbols[1:] != symbols[:-1]))
            begin = np.where(first, 0, np.concatenate(([0], at[:-1] + 1)))
            last = np.concatenate((first[1:], [True]))
            low = _range_minima(prefixes, np.concatenate((begin, at[last] + 1)), np.concatenate((at + 1, np.full(last.sum(), n))))
            out, rest = low[:len(at)], low[len(at):]
            key = symbols[first]
            before = self.batch[key]
            between = np.append(np.array(self.values, dtype=np.int16), self.depth)[np.searchsorted(self.ids, before, "right")]
            out[first] = np.where(before < 0, -1, np.minimum(np.minimum(out[first], self.rest[key]), between))
            out = np.minimum(out + 1, self.depth).astype(np.int16)
            self.batch[key], self.rest[key] = self.taken, rest
        least = int(prefixes.min())
        while self.values and self.values[-1] >= least:
            self.ids.pop(), self.values.pop()
        self.ids.append(self.taken), self.values.append(least)
        self.taken += 1
        return out


def _range_minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest of values[a:b] for each pair; the largest number there is for empty ranges."""
    out = np.full(len(a), np.iinfo(np.int16).max, dtype=np.int16)
    size, level, table = b - a, 0, values
    while True:
        now = np.flatnonzero((size >> level) == 1)
        if len(now):
            out[now] = np.minimum(table[a[now]], table[b[now] - (1 << level)])
        if len(table) <= 1 << level or not (size >> (level + 1)).any():
            return out
        table = np.minimum(table[:len(table) - (1 << level)], table[1 << level:])
        level += 1


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most) -> np.ndarray:
    """Symbols that the suffixes ``a`` and ``b`` share, up to ``most`` of them."""
    most = np.minimum(np.broadcast_to(most, a.shape), len(text) - np.maximum(a, b))
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(most > 0)
    x, y, end, n = a[live], b[live], most[live], 0
    while len(live):
        same = text[x] == text[y]
        n += 1
        out[live[~same]] = n - 1
        same &= end > n
        if not same.all():
            ended = ~same & (text[x] == text[y])
            out[live[ended]] = n
            live, x, y, end = live[same], x[same], y[same], end[same]
        x, y = x + 1, y + 1
    return out


def _turns(text: np.ndarray, memory: int) -> np.ndarray:
    """The LMS places: larger symbol before, and the suffix is smaller than the next one. By blocks from the right."""
    n, rising = len(text), False
    out = room(n // 2 + 1, _whole(n), memory)
    filled = len(out)
    for end in range(n - 1, 0, -_BLOCK):
        begin = max(end - _BLOCK, 0)
        part = text[begin:end + 1].astype(np.int64)
        step = np.diff(part)
        places = np.flatnonzero(step)
        after = np.searchsorted(places, np.arange(len(step)))
        small = np.append(np.concatenate((step[places] > 0, [rising]))[after], rising)
        found = np.flatnonzero(small[1:] & ~small[:-1]) + begin + 1
        rising = bool(small[0])
        out[filled - len(found):filled] = found
        filled -= len(found)
    return out[filled:]


def _by_symbol(text: np.ndarray, places: np.ndarray, memory: int) -> np.ndarray:
    """Places in the order of their symbols."""
    queue, out, at = DiskQueue(memory), room(len(places), places.dtype, memory), 0
    for a in range(0, len(places), _BLOCK):
        part = places[a:a + _BLOCK]
        part = part[np.argsort(text[part], kind="stable")]
        queue.push(text[part], part, np.zeros(len(part), dtype=np.int16))
    while (key := queue.next_key()) is not None:
        part = queue.pop(key, _BLOCK)[0]
        out[at:at + len(part)] = part
        at += len(part)
    return out


def _sweep(text, sign: int, seeds, prefixes, depth: int, memory: int, out, shared_out) -> int:
    """One direction of the induction: what stands before a suffix taken is pushed, if it belongs to the other type.

    Rising (``sign`` 1) the LMS ``seeds`` give the larger suffixes, falling (-1) those give the smaller ones. Suffixes
    are taken by symbol, queued ones before seeds. Several symbols go at once, up to the first one that a push of the
    batch itself falls on. Writes what it takes, rising without the seeds, and returns how many; each common
    prefix is that with the suffix taken before.
    """
    queue, most = DiskQueue(memory), max(memory // (8 * _ENTRY), 256)
    minima = None if prefixes is None else _Minima(int(text.max()) + 1, depth, memory)
    wide, whole = np.int16 if text.dtype == np.uint8 else np.int64, _whole(len(text))
    near = np.zeros(0, dtype=wide), np.zeros(0, dtype=whole), np.zeros(0, dtype=np.int16)
    if sign > 0:
        last = int(text[-1])
        queue.push(np.array([last], dtype=wide), np.array([len(text) - 1], dtype=whole), np.zeros(1, dtype=np.int16))
        if minima:
            minima.batch[last], minima.rest[last] = 0, np.iinfo(np.int16).max
    s, filled, limit, target, before = 0, 0, 0, 256, (None, 0)
    block, block_key = 0, np.zeros(0, dtype=wide)
    while True:
        if s - block >= len(block_key) and s < len(seeds):
            block, block_key = s, sign * text[seeds[s:s + most]].astype(wide)
        seed_key = block_key[s - block:s - block + target]
        more = s + len(seed_key) < len(seeds)
        if not len(near[0]):
            parts, n = [], 0
            while n < target and (key := queue.next_key()) is not None and not (len(seed_key) and key > seed_key[-1]):
                parts.append(queue.pop(key, most))
                parts[-1] = np.full(len(parts[-1][0]), key, dtype=wide), *parts[-1]
                n += len(parts[-1][0])
            if not n and not len(seed_key):
                return filled
            if parts:
                near = tuple(np.concatenate(c) for c in zip(*parts))
            ahead = queue.next_key()
            high = max([int(k[-1]) for k in (near[0], seed_key) if len(k)])
            limit = high if ahead is None else min(high, ahead - 1)
        n = int(np.searchsorted(near[0], seed_key[-1], "right")) if more and len(seed_key) else len(near[0])
        n_seeds = int(np.searchsorted(seed_key, limit, "right"))
        key = np.concatenate((near[0][:n], seed_key[:n_seeds]))
        place = np.concatenate((near[1][:n], seeds[s:s + n_seeds]))
        rank = 2 * key
        rank[n:] += 1
        by = np.argsort(rank, kind="stable") if 0 < n < len(rank) else np.arange(len(rank))
        if 0 < n < len(rank):
            key, place, rank = key[by], place[by], rank[by]
        symbol = sign * text[place - 1].astype(wide)  # place 0 wraps round and is left out below
        fits = (place > 0) & (symbol >= key + (rank & 1 if sign < 0 else 0))
        inside = symbol[fits & (symbol <= limit)]
        taken = int(np.searchsorted(rank, 2 * int(inside.min()), "right")) if len(inside) else len(rank)
        key, place, rank, by, queued = key[:taken], place[:taken], rank[:taken], by[:taken], (rank[:taken] & 1) == 0
        at = np.flatnonzero(fits[:taken])
        at = at[np.argsort(symbol[at], kind="stable")]
        symbol = symbol[at]
        if minima:
            shared = np.concatenate((near[2][:n], prefixes[s:s + n_seeds]))[by]
            follows = np.concatenate(([before[0] == int(rank[0]) - 1], rank[:-1] == rank[1:] - 1))
            touch = np.flatnonzero(~queued & follows)
            if len(touch):
                other = np.where(touch > 0, place[touch - 1], before[1])
                shared[touch] = common_prefix(text, other, place[touch], depth)
            pushed = minima.pushed(shared, at, sign * symbol)
        else:
            shared, pushed = np.zeros(taken, dtype=np.int16), np.zeros(len(at), dtype=np.int16)
        kept = queued if sign > 0 else slice(None)
        written = place[kept]
        out[filled:filled + len(written)], shared_out[filled:filled + len(written)] = written, shared[kept]
        filled, before = filled + len(written), (int(rank[-1]), int(place[-1]))
        used = int(queued.sum())
        s += taken - used
        stay = int(np.searchsorted(symbol, limit, "right"))
        fresh = symbol, place[at] - 1, pushed
        queue.push(*(f[stay:] for f in fresh))
        near = tuple(f[used:] for f in near)
        if stay:
            near = tuple(np.concatenate((f, g[:stay])) for f, g in zip(near, fresh))
            by = np.argsort(near[0], kind="stable")
            near = tuple(f[by] for f in near)
        target = min(max(2 * taken, 64), most)


def _induce(text: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray | None, depth: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and the symbols each shares with the one before, from the LMS ``seeds`` in order.

    Without ``prefixes`` of the seeds, only the order means something.
    """
    n = len(text)
    larger, shared = room(n, _whole(n), memory), room(n + 1, np.int16, memory)
    filled = _sweep(text, 1, seeds, prefixes, depth, memory, larger, shared)
    shared[filled] = 0
    order, prefix = room(n, _whole(n), memory), room(n + 1, np.int16, memory)
    _sweep(text, -1, larger[:filled][::-1], None if prefixes is None else shared[1:filled + 1][::-1], depth, memory, order, prefix)
    prefix[n] = 0
    return order[::-1], prefix[1:][::-1]


def _doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of a string of names that fits the bound, by prefix doubling."""
    n = len(names)
    whole = _whole(n)
    reach, ranks, order = 1, names.astype(whole), stable_order(names).astype(whole)
    levels = [(reach, ranks)]
    while int(ranks[order[-1]]) + 1 < n and reach < depth:
        # By what comes ``reach`` names later; what has nothing there comes first.
        order = np.concatenate((np.arange(max(n - reach, 0), n, dtype=whole), order[order >= reach] - whole(reach)))
        order = order[stable_order(ranks[order])]
        ahead = np.full(n, -1, dtype=whole)
        ahead[:-reach] = ranks[reach:]
        sorted_ranks, ahead = ranks[order], ahead[order]
        new = (sorted_ranks[1:] != sorted_ranks[:-1]) | (ahead[1:] != ahead[:-1])
        ranks = np.empty_like(ranks)
        ranks[order] = np.cumsum(np.concatenate(([0], new)))
        reach *= 2
        levels.append((reach, ranks))
    # Common prefixes by halves: two places agree on ``reach`` names if their ranks at that reach do.
    a, b = order[:-1].copy(), order[1:].copy()
    for reach, ranks in reversed(levels):
        same = np.flatnonzero(np.maximum(a, b) + reach <= n)
        same = same[ranks[a[same]] == ranks[b[same]]]
        a[same] += whole(reach)
        b[same] += whole(reach)
    shared = np.minimum(b - order[1:], depth)
    return order, np.concatenate(([0], shared))


def suffix_order(text: np.ndarray, depth: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, by the first ``depth`` symbols at least, and common prefixes up to ``depth``."""
    lms = _turns(text, memory)
    count = len(lms)
    if not count:
        return _induce(text, lms, np.zeros(0, dtype=np.int16), depth, memory)
    rough = _induce(text, _by_symbol(text, lms, memory), None, depth, memory)[0]
    ranked, at = room(count, _whole(count), memory), 0  # which LMS place comes when, by its substring
    number = room(len(text), _whole(count), memory)
    number[:] = -1
    for a in range(0, count, _BLOCK):
        number[lms[a:a + _BLOCK]] = np.arange(a, min(a + _BLOCK, count))
    for a in range(0, len(rough), _BLOCK):
        part = rough[a:a + _BLOCK]
        which = number[part]
        which = which[which >= 0]
        ranked[at:at + len(which)] = which
        at += len(which)
    rough = number = part = None  # a slice keeps its array
    names, name = room(count, np.int64, memory), 0
    names[ranked[0]] = 0
    for a in range(1, count, _BLOCK):
        left, right = ranked[a - 1:min(a + _BLOCK, count) - 1], ranked[a:a + _BLOCK]
        size = [np.minimum(np.where(w + 1 < count, lms[np.minimum(w + 1, count - 1)] + 1, len(text)) - lms[w], depth) for w in (left, right)]
        new = size[0] != size[1]
        alike = np.flatnonzero(~new)
        new[alike] = common_prefix(text, lms[left[alike]], lms[right[alike]], size[0][alike]) < size[0][alike]
        numbered = name + np.cumsum(new)
        names[right], name = numbered, int(numbered[-1])
    if name + 1 == count:
        order, shared = ranked, np.zeros(count, dtype=np.int16)
    elif 24 * count <= memory:
        order, shared = _doubled(np.asarray(names), depth // 2 + 1)
    else:
        order, shared = suffix_order(names, depth // 2 + 1, memory)
    ranked = names = left = right = None
    seeds, prefixes = room(count, lms.dtype, memory), room(count, np.int16, memory)
    prefixes[0] = 0
    seeds[0] = lms[order[0]]
    for a in range(1, count, _BLOCK):
        left, right, same = order[a - 1:min(a + _BLOCK, count) - 1], order[a:a + _BLOCK], shared[a:a + _BLOCK]
        seeds[a:a + _BLOCK] = lms[right]
        ahead = [np.where(w + same < count, lms[np.minimum(w + same, count - 1)], len(text)) - lms[w] for w in (left, right)]
        sure = np.minimum(np.minimum(*ahead), depth)
        prefixes[a:a + _BLOCK] = sure + common_prefix(text, lms[left] + sure, lms[right] + sure, depth - sure)
    lms = order = shared = left = right = same = None
    return _induce(text, seeds, prefixes, depth, memory)
