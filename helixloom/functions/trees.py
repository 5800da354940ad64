"""Routing trees of one design's staples in arrays: a level of many staples at once, with the matches of the rests that occur in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .longest import LETTERS, _packed, _shared

#: Staples whose levels grow together, and children that are made at once.
STAPLES, BLOCK = 64, 1 << 20


class Strand:
    """What staples pair along, and where other staples claim it; letters other than ACGT match with nothing."""

    def __init__(self, strand: str, circular: bool, claims: list[tuple[int, int]] = (), beta: float = 0.3) -> None:
        self.strand, self.n, self.circular, self.beta = strand, len(strand), circular, beta
        self.plain = not re.search("[^ACGT]", strand)
        if self.plain and self.n:
            more = (strand * (LETTERS // self.n + 1))[: LETTERS - 1] if circular else "A" * (LETTERS - 1)
            self.windows = _packed(strand + more)
            self.whole = self.n if circular else max(0, self.n - LETTERS + 1)
            self.order = np.argsort(self.windows[: self.whole])
            self.sorted = self.windows[: self.whole][self.order]
        # layers of owners: base b is claimed by each of owners[:, b] that is not -1
        places: dict[int, set[int]] = {}
        for b, o in claims:
            places.setdefault(b, set()).add(o)
        self.owners = np.full((max(map(len, places.values()), default=0), self.n), -1, np.int64)
        for b, own in places.items():
            if 0 <= b < self.n:
                self.owners[: len(own), b] = sorted(own)

    def matches(self, rests: list[str], sigma: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """starts (one more than rests), places and lengths of each rest's matches, and its floor.

        Matches are at most sigma shorter than the longest of their rest, and least letters or more.
        """
        if not self.plain or any(len(f) > LETTERS for f in rests) or re.search("[^ACGT]", "".join(rests)):
            return self._by_place(rests, sigma, least)
        k = len(rests)
        size = np.array([len(f) for f in rests], np.int64)
        value = _packed("".join(f.ljust(LETTERS, "A") for f in rests))[::LETTERS]
        longest = np.zeros(k, np.int64)
        if self.whole:
            at = np.searchsorted(self.sorted, value)
            longest = np.minimum(np.maximum(_shared(self.sorted[np.maximum(at - 1, 0)], value), _shared(self.sorted[np.minimum(at, self.whole - 1)], value)), size)
        tail = np.arange(self.whole, self.n)
        cut = np.minimum(_shared(self.windows[self.whole : self.n, None], value[None]), np.minimum((self.n - tail)[:, None], size[None]))
        if tail.size:
            longest = np.maximum(longest, cut.max(0))
        floor = np.maximum(longest - sigma, least)
        shift = (2 * np.minimum(floor, LETTERS - 1)).astype(np.uint64)
        rest = np.where(floor >= LETTERS, np.uint64(0), np.uint64(2**64 - 1) >> shift)
        lo, hi = np.searchsorted(self.sorted, value & ~rest), np.searchsorted(self.sorted, value | rest, "right")
        count = np.where(longest >= least, hi - lo, 0)
        rows = np.repeat(np.arange(k), count)
        spot = np.arange(rows.size) - np.repeat(np.cumsum(count) - count, count) + lo[rows]
        place, run = self.order[spot], np.minimum(_shared(self.sorted[spot], value[rows]), size[rows])
        if tail.size:
            t, f = np.nonzero(cut >= floor[None])
            rows, place, run = np.append(rows, f), np.append(place, tail[t]), np.append(run, cut[t, f])
            by = np.argsort(rows, kind="stable")
            rows, place, run = rows[by], place[by], run[by]
        return np.searchsorted(rows, np.arange(k + 1)), place, run, floor

    def _by_place(self, rests: list[str], sigma: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        most = max(map(len, rests), default=0)
        loop = self.strand + (self.strand * (most // max(1, self.n) + 1))[:most] if self.circular else self.strand
        seeds: dict[str, list[int]] = {}
        for p in range(self.n):
            seeds.setdefault(loop[p : p + least], []).append(p)
        starts, out, floors = [0], [], []
        for f in (re.split("[^ACGT]", r)[0] for r in rests):
            found = []
            for p in seeds.get(f[:least], ()) if len(f) >= least else ():
                run = least
                while run < min(len(f), len(loop) - p) and f[run] == loop[p + run]:
                    run += 1
                found.append((p, run))
            floors.append(max(max((run for _, run in found), default=0) - sigma, least))
            out += [x for x in found if x[1] >= floors[-1]]
            starts.append(len(out))
        both = np.array(out, np.int64).reshape(-1, 2)
        return np.array(starts), both[:, 0], both[:, 1], np.array(floors, np.int64)

    def blocked(self, staple: np.ndarray, i53: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Whether other staples claim a share of beta of a section, or one has all that it claims of it within it."""
        count, out = np.zeros(i53.size, np.int64), np.zeros(i53.size, bool)
        wrap = lambda i: i % self.n if self.circular else i

        def owner(layer: np.ndarray, i: np.ndarray) -> np.ndarray:
            i = wrap(i)
            return np.where((i >= 0) & (i < self.n), layer[np.clip(i, 0, self.n - 1)], -1)

        ends = [owner(layer, e) for layer in self.owners for e in (i53 + 1, i53 - run)]
        for r in range(int(run.max(initial=0))):
            other = np.zeros(i53.size, bool)
            for layer in self.owners:
                o = owner(layer, i53 - r)
                own = (o >= 0) & (o != staple) & (r < run)
                other |= own
                for e in ends:
                    own &= o != e
                out |= own
            count += other
        return out | (count / run >= self.beta)


def grow(strand: Strand, ids: list[int], staples: list[str], sigma: int, least: int, max_nodes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """staple, nodes, and staple, route number, depth and sections (i53, run, a column a section) of routes, for some staples at a time.

    A staple with more nodes than max_nodes has no routes; what it has beyond them is not made.
    """
    for a in range(0, len(staples), STAPLES):
        yield _grow(strand, np.array(ids[a : a + STAPLES], np.int64), staples[a : a + STAPLES], sigma, least, max_nodes)


def _grow(strand: Strand, ids: np.ndarray, staples: list[str], sigma: int, least: int, max_nodes: int) -> tuple[np.ndarray, ...]:
    n, length = strand.n, np.array([len(s) for s in staples], np.int64)
    nodes, depth = np.ones(len(staples), np.int64), max(1, int(length.max(initial=0)) // least)
    who, at = np.flatnonzero(length >= least), np.zeros(int((length >= least).sum()), np.int64)
    hist = np.zeros((who.size, 0, 2), np.int32)
    routes = []
    while who.size:
        key, rest_of = np.unique(who * (1 << 32) + at, return_inverse=True)
        starts, place, run, floor = strand.matches([staples[k >> 32][k & 0xFFFFFFFF :] for k in key.tolist()], sigma, least)
        many = np.diff(starts)[rest_of]
        total = np.cumsum(many)
        made, lo = [], 0
        while lo < who.size:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK, "right")))
            # staples that have grown too large get no more
            some = np.flatnonzero(nodes[who[lo:hi]] <= max_nodes) + lo
            lo = hi
            parent = np.repeat(some, many[some])
            spot = np.arange(parent.size) - np.repeat(np.cumsum(many[some]) - many[some], many[some]) + starts[rest_of[parent]]
            i53, size, least_run = n - 1 - place[spot], run[spot], floor[rest_of[parent]]
            if strand.circular:
                size = np.minimum(size, n)
            for k in range(hist.shape[1]):
                j, held = hist[parent, k, 0].astype(np.int64), hist[parent, k, 1]
                if strand.circular:
                    free = np.where((j - i53) % n < held, 0, (i53 - j) % n)
                else:
                    free = np.where((j >= i53) & (j - i53 < held), 0, np.where(i53 > j, i53 - j, size))
                size = np.minimum(size, free)
            good = size >= least_run
            parent, i53, size = parent[good], i53[good], size[good]
            if strand.owners.size and parent.size:
                tries, back = np.unique((who[parent] * n + i53) * (1 << 16) + size, return_inverse=True)
                bad = strand.blocked(ids[(tries >> 16) // n], (tries >> 16) % n, tries & 0xFFFF)
                good = ~bad[back]
                parent, i53, size = parent[good], i53[good], size[good]
            nodes += np.bincount(who[parent], minlength=nodes.size)
            made.append((parent, i53, size))
        parent, i53, size = (np.concatenate(x) for x in zip(*made))
        good = nodes[who[parent]] <= max_nodes
        parent, i53, size = parent[good], i53[good], size[good]
        hist = np.concatenate([hist[parent], np.stack([i53, size], 1)[:, None].astype(np.int32)], 1)
        who, at = who[parent], at[parent] + size
        end = at == length[who]
        routes.append((who[end], hist[end]))
        more = length[who] - at >= least
        who, at, hist = who[more], at[more], hist[more]
    owner = np.concatenate([w for w, _ in routes]) if routes else np.zeros(0, np.int64)
    deep = np.concatenate([np.full(w.size, h.shape[1]) for w, h in routes]) if routes else owner
    sections = np.full((owner.size, depth, 2), -1, np.int32)
    a = 0
    for w, h in routes:
        sections[a : a + w.size, : h.shape[1]] = h
        a += w.size
    good = nodes[owner] <= max_nodes
    owner, deep, sections = owner[good], deep[good], sections[good]
    # depth first from the 3' end on: by falling i53, section by section
    by = np.lexsort([*(-sections[:, k, 0] for k in range(depth - 1, -1, -1)), owner])
    owner, deep, sections = owner[by], deep[by], sections[by]
    number = np.arange(owner.size) - np.searchsorted(owner, owner)
    return ids, nodes, ids[owner], number, deep, sections
