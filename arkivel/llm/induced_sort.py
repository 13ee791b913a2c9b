"""Suffixes of a shard by external induced sorting, with common-prefix values.

Suffixes that begin a rising stretch (S*) are named by their substrings and ordered through the reduced string of names.
From them two passes induce all others: a disk-backed queue gives suffix tuples (position, common prefix with the one
before) in ascending order of first character and time of insertion; each tuple taken out sends its preceding suffix
into the queue. The common prefix of two neighbours so sent is one more than the smallest value between their senders.

Whatever grows with the shard (text, types, S* suffixes, names, tuples) is in memory up to a limit for each and in files
beyond: arrays as mapped scratch files, queues as runs sorted by character that are merged as they are read. The result
is a stream. Work is done in chunks of numpy arrays. A reduced string that fits into memory is ordered by prefix doubling
over the names, as a queue step for each of very many names costs more; any other is induced in its turn.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

CHUNK = 1 << 16
#: Reduced strings of so few names are induced in any case.
FEW_NAMES = 2048
#: Bytes that one array or queue takes in memory.
LIMIT = 64 << 20
_TUPLE = np.dtype([("pos", np.int64), ("lcp", np.uint16)])
_FAR = np.uint16(65535)


class Scratch:
    """Arrays of a sort: in memory up to limit bytes each, beyond that mapped to files that vanish with them."""

    def __init__(self, folder: str | Path | None = None, limit: int = LIMIT):
        self.folder, self.limit = folder, limit

    def file(self):
        return tempfile.TemporaryFile(dir=self.folder)

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.limit:
            return np.zeros(n, kind)
        with self.file() as f:
            return np.memmap(f, kind, "w+", shape=(n,))


def _steps(n: int, step: int = CHUNK * 16) -> Iterator[tuple[int, int]]:
    return ((a, min(a + step, n)) for a in range(0, n, step))


class Queue:
    """Priority queue of suffix tuples whose insertions are already in order within each first character.

    What memory does not hold is written as a run, sorted by character; a character's tuples are those of the runs in
    the order of writing, then those in memory.
    """

    def __init__(self, scratch: Scratch):
        self.scratch, self.size = scratch, 0
        self.held: dict[int, list[np.ndarray]] = {}
        self.runs: list[tuple] = []

    def push(self, c: int, tuples: np.ndarray) -> None:
        self.held.setdefault(c, []).append(tuples)
        self.size += tuples.nbytes
        if self.size > self.scratch.limit:
            file, chars, ends = self.scratch.file(), sorted(self.held), [0]
            for k in chars:
                for part in self.held[k]:
                    part.tofile(file)
                ends.append(ends[-1] + sum(map(len, self.held[k])))
            self.runs.append((file, np.array(chars, np.int64), ends))
            self.held, self.size = {}, 0

    def pop(self, c: int) -> Iterator[np.ndarray]:
        """Chunks of the tuples of character c, those that come in meanwhile included."""
        done = 0
        while True:
            while done < len(self.runs):
                file, chars, ends = self.runs[done]
                done += 1
                at = int(np.searchsorted(chars, c))
                if at < len(chars) and chars[at] == c:
                    for a in range(ends[at], ends[at + 1], CHUNK):
                        file.seek(a * _TUPLE.itemsize)
                        yield np.fromfile(file, _TUPLE, min(CHUNK, ends[at + 1] - a))
            if c not in self.held:
                return
            parts = self.held.pop(c)
            self.size -= sum(p.nbytes for p in parts)
            whole = np.concatenate(parts)
            for a in range(0, len(whole), CHUNK):
                yield whole[a : a + CHUNK]


class _Prefixes:
    """Smallest common-prefix value since the last tuple sent to each character."""

    def __init__(self, sigma: int, most: int):
        self.part = np.full(sigma, _FAR, np.uint16)  # within the chunk of the last tuple sent
        self.at = np.full(sigma, -1, np.int64)  # that chunk
        self.times: list[int] = []  # chunks whose smallest value is below that of all later ones
        self.mins: list[int] = []
        self.now, self.most = 0, most

    def sent(self, lcp: np.ndarray, target: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The values of what tuples index (ascending within each target, targets ascending) send to target."""
        value = np.zeros(0, np.uint16)
        if len(index):
            levels = [lcp]
            while 2 << (len(levels) - 1) <= len(lcp):
                step = 1 << (len(levels) - 1)
                levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))

            def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # over a..b, both included; nothing if a > b
                out = np.full(len(a), _FAR, np.uint16)
                some = b >= a
                a, b = a[some], b[some]
                k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
                got = np.empty(len(a), np.uint16)
                for level in np.unique(k):
                    own = k == level
                    got[own] = np.minimum(levels[level][a[own]], levels[level][b[own] - (1 << int(level)) + 1])
                out[some] = got
                return out

            head = np.r_[True, target[1:] != target[:-1]]
            value = least(np.where(head, 0, np.r_[0, index[:-1] + 1]), index)
            own = target[head]
            later = np.append(np.array(self.mins, np.uint16), _FAR)[np.searchsorted(np.array(self.times, np.int64), self.at[own], "right")]
            value[head] = np.minimum(np.minimum(value[head], self.part[own]), later)
            value = np.minimum(value, self.most - 1).astype(np.uint16) + np.uint16(1)
            value[np.flatnonzero(head)[self.at[own] < 0]] = 0
            last = index[np.r_[np.flatnonzero(head)[1:] - 1, len(index) - 1]]
            self.part[own] = least(last + 1, np.full(len(last), len(lcp) - 1))
            self.at[own] = self.now
        whole = int(lcp.min())
        while self.mins and self.mins[-1] >= whole:
            self.mins.pop()
            self.times.pop()
        self.mins.append(whole)
        self.times.append(self.now)
        self.now += 1
        return value


def _rising(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is smaller than the next (type S); the last one is, by convention."""
    up = scratch.array(len(t), bool)
    up[-1] = True
    for a, b in reversed(list(_steps(len(t) - 1))):
        x = np.asarray(t[a : b + 1])
        differs = np.flatnonzero(x[1:] != x[:-1])
        up[a:b] = np.append(x[differs] < x[differs + 1], up[b])[np.searchsorted(differs, np.arange(b - a))]
    return up


def _stars(up: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Places where an S suffix follows one that is not."""
    found = lambda a, b: np.flatnonzero(up[a + 1 : b + 1] & ~up[a:b]) + a + 1
    out = scratch.array(sum(len(found(a, b)) for a, b in _steps(len(up) - 1)), np.int64)
    done = 0
    for a, b in _steps(len(up) - 1):
        own = found(a, b)
        out[done : done + len(own)] = own
        done += len(own)
    return out if done else np.array([len(up) - 1])


def _names(t: np.ndarray, up: np.ndarray, stars: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Dense ranks of the substrings from each S* suffix to the next one, by characters and types; how many there are."""
    m = len(stars)
    bits = max(int(t[a:b].max()) for a, b in _steps(len(t))).bit_length() + 2
    per = 63 // bits
    lengths = lambda own: stars[np.minimum(own + 1, m - 1)] - stars[own] + 1

    def code(own: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
        at = np.minimum(stars[own] + k, len(t) - 1)
        return np.where(length > k, (t[at].astype(np.uint64) << np.uint64(1)) + up[at] + np.uint64(1), np.uint64(0))

    def buckets(own: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, int]]:
        """Sets of places that fit into memory, in the order of their first characters, of which the first depth are alike."""
        if own.nbytes * 8 <= scratch.limit or len(own) < 64:
            yield own, depth
            return
        values = np.zeros(0, np.uint64)
        for a, b in _steps(len(own)):
            values = np.union1d(values, code(own[a:b], lengths(own[a:b]), depth))
        counts = np.zeros(len(values), np.int64)
        for a, b in _steps(len(own)):
            counts += np.bincount(np.searchsorted(values, code(own[a:b], lengths(own[a:b]), depth)), minlength=len(values))
        dealt, next_ = scratch.array(len(own), np.int64), np.r_[0, np.cumsum(counts)]
        ends = next_.copy()
        for a, b in _steps(len(own)):
            which = np.searchsorted(values, code(own[a:b], lengths(own[a:b]), depth))
            by = np.argsort(which, kind="stable")
            w = which[by]
            place = np.arange(len(w)) - np.searchsorted(w, w)
            dealt[next_[w] + place] = own[a:b][by]
            next_[:-1] += np.bincount(which, minlength=len(values))
        for k, v in enumerate(values.tolist()):
            part = dealt[ends[k] : ends[k + 1]]
            if v:
                yield from buckets(part, depth + 1)
            else:
                yield part, -1  # all have ended: they are the same

    def ranked(own: np.ndarray, done: int) -> np.ndarray:
        rank, length = np.zeros(len(own), np.int64), lengths(own)
        open_ = np.flatnonzero(length > done)
        while len(open_):
            word = np.zeros(len(open_), np.uint64)
            for k in range(done, done + per):
                word = (word << np.uint64(bits)) | code(own[open_], length[open_], k)
            done += per
            # Refine within each group of equal rank; a rank is the number of smaller substrings.
            order = np.lexsort((word, rank[open_])) if len(open_) < len(own) else np.argsort(word)
            r, w = rank[open_][order], word[order]
            new_group = np.r_[True, r[1:] != r[:-1]]
            new = new_group | np.r_[True, w[1:] != w[:-1]]
            start, begin = np.flatnonzero(new_group), np.flatnonzero(new)
            base = np.repeat(start, np.diff(np.r_[start, len(r)]))
            sizes = np.diff(np.r_[begin, len(r)])
            rank[open_[order]] = r + (np.repeat(begin, sizes) - base)
            tied = open_[order][np.repeat(sizes, sizes) > 1]
            open_ = np.sort(tied[length[tied] > done])
        used = np.zeros(len(own), np.int64)
        used[rank] = 1
        return (np.cumsum(used) - 1)[rank]

    out, base = scratch.array(m, np.int64), 0
    whole = scratch.array(m, np.int64)
    for a, b in _steps(m):
        whole[a:b] = np.arange(a, b)
    for own, depth in buckets(whole, 0):
        own = np.asarray(own)
        got = ranked(own, depth) if depth >= 0 else np.zeros(len(own), np.int64)
        out[own] = base + got
        base += int(got.max()) + 1 if len(got) else 0
    return out, base


def _doubled(names: np.ndarray, stars: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of names by prefix doubling, and of each how many names it shares with the one before.

    Suffixes that are alike for `most` characters are in any order.
    """
    m, h, levels = len(names), 1, []
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]  # the number of smaller ones
    tied = np.flatnonzero(counts[names] > 1)
    while True:
        levels.append((h, rank.astype(np.int32)))
        if not len(tied) or (stars[np.minimum(tied + h, m - 1)] - stars[tied]).min() >= most:
            break
        after = np.where(tied + h < m, rank[np.minimum(tied + h, m - 1)] + 1, 0)
        key = rank[tied] * (m + 1) + after
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        r = rank[tied]
        group, new = (np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) for x in (r, key))
        sizes = np.diff(np.r_[new, len(r)])
        rank[tied] = r + np.repeat(new, sizes) - np.repeat(group, np.diff(np.r_[group, len(r)]))
        tied = np.sort(tied[np.repeat(sizes, sizes) > 1])
        h *= 2
    order = np.argsort(rank)
    same = np.zeros(m, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for h, level in reversed(levels):
        x, y = np.minimum(a, m - 1), np.minimum(b, m - 1)
        step = np.where((level[x] == level[y]) & (a < m) & (b < m), h, 0)
        same[1:] += step
        a += step
        b += step
    return order, same


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b (never the same), up to room for each."""
    out, live, k = np.zeros(len(a), np.int64), np.flatnonzero(room > 0), 0
    while len(live):
        live = live[t[a[live] + k] == t[b[live] + k]]
        k += 1
        out[live] = k
        live = live[room[live] > k]
    return out


def _ordered_stars(t: np.ndarray, up: np.ndarray, stars: np.ndarray, most: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The S* suffixes in ascending order, and the common prefix of each with the one before, up to most."""
    m = len(stars)
    names, sigma = _names(t, up, stars, scratch)
    if sigma > FEW_NAMES and sigma < m and m * 64 <= scratch.limit * 16:
        order, same = _doubled(np.asarray(names), stars, most)
    else:
        order, same = scratch.array(m, np.int64), scratch.array(m, np.int64)
        if sigma == m:
            for a, b in _steps(m):
                order[names[a:b]] = np.arange(a, b)
        else:
            end = m
            for pos, lcp in induced(names, most // 2 + 1, scratch):  # a name moves on by two characters at least
                k = len(pos)
                order[end - k : end] = pos[::-1]
                first = int(end == m)
                same[end - np.arange(first, k)] = lcp[first:]
                end -= k
    out, between = scratch.array(m, np.int64), scratch.array(m, np.uint16)
    for a, b in _steps(m):
        out[a:b] = stars[order[a:b]]
    for a, b in _steps(m - 1):
        x, y, k = order[a:b], order[a + 1 : b + 1], same[a + 1 : b + 1]
        p, q = stars[np.minimum(x + k, m - 1)], stars[np.minimum(y + k, m - 1)]
        far = p - stars[x]
        between[a + 1 : b + 1] = np.minimum(far + _common(t, p, q, np.where(p == q, 0, most - far)), most)
    return out, between


def induced(t: np.ndarray, most: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of t in descending order, in parts: positions, and common prefixes with the next greater one.

    Both order and common prefixes hold for the first `most` characters. The last number of t must be its smallest and
    occur nowhere else.
    """
    n = len(t)
    sigma = max(int(t[a:b].max()) for a, b in _steps(n)) + 1
    up = _rising(t, scratch)
    stars = _stars(up, scratch)
    order, between = _ordered_stars(t, up, stars, most, scratch)
    counts, falling = np.zeros(sigma, np.int64), n
    for a, b in _steps(len(stars)):
        counts += np.bincount(t[stars[a:b]], minlength=sigma)
    for a, b in _steps(n):
        falling -= int(up[a:b].sum())
    heads = np.r_[0, np.cumsum(counts)]

    def take(tuples: np.ndarray, queue: Queue, prefixes: _Prefixes, want_up: bool) -> None:
        """Send the preceding suffixes of these, if of the wanted type."""
        before = tuples["pos"] - 1
        index = np.flatnonzero((before >= 0) & (up[before] == want_up))
        target = t[before[index]]
        by = np.argsort(target, kind="stable")  # of 16-bit numbers by digits
        index, target = index[by], target[by].astype(np.int64)
        values = prefixes.sent(tuples["lcp"], target, index)
        if not len(index):
            return
        new = np.empty(len(index), _TUPLE)
        new["pos"], new["lcp"] = before[index], values
        edges = np.r_[np.flatnonzero(np.r_[True, target[1:] != target[:-1]]), len(target)].tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            queue.push(int(target[a]), new[a:b])

    def meeting(a: int, b: int) -> int:
        x, y = t[a : a + most], t[b : b + most]
        k = min(len(x), len(y))
        differs = np.flatnonzero(x[:k] != y[:k])
        return int(differs[0]) if len(differs) else k

    queue, prefixes = Queue(scratch), _Prefixes(sigma, most)
    low, ends, done = scratch.array(falling, _TUPLE), np.zeros(sigma + 1, np.int64), 0
    for c in range(sigma):
        for tuples in queue.pop(c):
            low[done : done + len(tuples)] = tuples
            done += len(tuples)
            take(tuples, queue, prefixes, False)
        ends[c + 1] = done
        for a in range(heads[c], heads[c + 1], CHUNK):
            some = np.empty(min(CHUNK, heads[c + 1] - a), _TUPLE)
            some["pos"], some["lcp"] = order[a : a + len(some)], between[a : a + len(some)]
            if a == heads[c]:
                some["lcp"][0] = meeting(int(low["pos"][done - 1]), int(some["pos"][0])) if done > ends[c] else 0
            take(some, queue, prefixes, False)

    queue, prefixes = Queue(scratch), _Prefixes(sigma, most)
    for c in range(sigma - 1, -1, -1):
        smallest = -1
        for tuples in queue.pop(c):
            take(tuples, queue, prefixes, True)
            yield tuples["pos"], tuples["lcp"]
            smallest = int(tuples["pos"][-1])
        if c == t[-1]:  # the end itself is sent by none
            end = np.array([(n - 1, 0)], _TUPLE)
            take(end, queue, prefixes, True)
            yield end["pos"], end["lcp"]
        a, b = int(ends[c]), int(ends[c + 1])
        shared = meeting(int(low["pos"][b - 1]), smallest) if b > a and smallest >= 0 else 0
        for y in range(b, a, -CHUNK):
            part = low[max(a, y - CHUNK) : y]
            down = np.empty(len(part), _TUPLE)
            down["pos"], down["lcp"][0], down["lcp"][1:] = part["pos"][::-1], shared, part["lcp"][:0:-1]
            shared = int(part["lcp"][0])
            take(down, queue, prefixes, True)
            yield down["pos"], down["lcp"]


def repeated(t: np.ndarray, lengths: tuple[int, ...], scratch: Scratch, starts: np.ndarray | None = None) -> list[np.ndarray]:
    """For each length, whether so many characters from each position also begin anywhere else in t.

    starts: the positions that count, as repeats and as what is repeated; all by default. A repeat may run over any
    character but the last, which must be the smallest of t and unique.
    """
    out, before, between = [scratch.array(len(t), bool) for _ in lengths], -1, 65535
    for pos, lcp in induced(t, max(lengths), scratch):
        own = np.arange(len(pos)) if starts is None else np.flatnonzero(starts[pos])
        if not len(own):
            between = min(between, int(lcp.min()))
            continue
        shared = np.minimum.reduceat(lcp[: own[-1] + 1], np.r_[0, own[:-1] + 1])  # with the next greater one that counts
        shared[0] = min(shared[0], between)
        pos, between = pos[own], int(lcp[own[-1] + 1 :].min(initial=65535))
        greater = np.r_[before, pos[:-1]]
        for flags, length in zip(out, lengths, strict=True):
            same = shared >= length
            flags[pos[same]] = True
            flags[greater[same]] = True
        before = int(pos[-1])
    return out
