"""The state of a crawl as arrays over numbers of nodes, for rules that compare all open nodes in every step.

Nodes are numbered in the order of their ids, so ties by id fall to the least number. Whole answers only: an open node then
links to closed nodes alone. The traces are those of the rules written out in plain Python.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_BLOCK, _FEW = 1 << 14, 512
_FAR = 1 << 30


def md5_heads(m: list, n: int) -> np.ndarray:
    """The first 8 hex digits of the MD5 of n one-block messages; m: their 16 words, each a number or an array of n.

    They are the state's first word, which the last three rounds only move.
    """
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        if isinstance(m[g], int):
            f += np.uint32((_SINES[i] + m[g]) & 0xFFFFFFFF)
        else:
            f += np.uint32(_SINES[i])
            f += m[g]
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
        f <<= np.uint32(_SHIFTS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(0x67452301)
    return b.byteswap()


class Hashes:
    """The draws of ``choice`` times 2^32, of many nodes at once."""

    def __init__(self, ids: list[str]):
        self.raw = [v.encode() for v in ids]
        self.size = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.width = max(1, int(self.size.max(initial=0)))
        self.words: dict[int, tuple] = {}  # by the length of what comes before the id

    def __call__(self, seed: int, step: int, at: np.ndarray) -> np.ndarray:
        head = f"{seed}:{step}:".encode()
        if len(at) < _FEW or len(head) + self.width > 55:
            own = hashlib.md5(head)

            def one(i):
                h = own.copy()
                h.update(self.raw[i])
                return int.from_bytes(h.digest()[:4], "big")

            return np.fromiter((one(i) for i in at.tolist()), np.uint32, len(at))
        low, words, bits = self._placed(len(head))
        first = [int.from_bytes(head[4 * j : 4 * j + 4], "little") for j in range(low + 1)]
        out = np.empty(len(at), np.uint32)
        for begin in range(0, len(at), _BLOCK):
            part = at[begin : begin + _BLOCK]
            m: list = first[:low] + [0] * (16 - low)
            for j, w in enumerate(words):
                m[low + j] = w[part]
            m[low] |= np.uint32(first[low])
            m[14] = bits[part]
            out[begin : begin + _BLOCK] = md5_heads(m, len(part))
        return out

    def _placed(self, before: int) -> tuple:
        """The first word that holds a part of the ids, these words, and the lengths of the messages in bits."""
        if before not in self.words:
            n, low = len(self.raw), before // 4
            off = before - 4 * low
            block = np.zeros((n, 4 * ((before + self.width) // 4 + 1 - low)), np.uint8)
            block[:, off : off + self.width] = np.array(self.raw, dtype=f"S{self.width}").view(np.uint8).reshape(n, self.width)
            block[np.arange(n), off + self.size] = 0x80
            self.words[before] = low, np.ascontiguousarray(block.view("<u4").T), (8 * (before + self.size)).astype(np.uint32)
        return self.words[before]


class Grown:
    """A column that grows at its end."""

    def __init__(self):
        self.own, self.n = np.empty(1024, np.int64), 0

    def add(self, values) -> None:
        need = self.n + len(values)
        if need > len(self.own):
            self.own = np.concatenate([self.own[: self.n], np.empty(need, np.int64)])
        self.own[self.n : need] = values
        self.n = need

    def now(self) -> np.ndarray:
        return self.own[: self.n]


class Arrays:
    """What a ``Crawl`` knows, as arrays; its ``query`` calls ``told``."""

    def __init__(self, crawl, eccentric: bool = False):
        adj = crawl.access.adj
        if crawl.access.limit:
            raise ValueError("the arrays of a crawl hold whole answers only")
        self.c, self.ids, self.up = crawl, sorted(adj), None
        self.at = {v: i for i, v in enumerate(self.ids)}
        n = len(self.ids)
        self.deg = np.array([len(adj[v]) for v in self.ids], dtype=np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(self.deg)])
        self.nbr = np.fromiter((self.at[w] for v in self.ids for w in adj[v]), np.int64, int(self.ptr[-1]))
        self.hash = Hashes(self.ids)
        self.open, self.closed, self.seen = (np.zeros(n, dtype=bool) for _ in range(3))
        self.obs, self.pairs, self.around = (np.zeros(n, dtype=np.int64) for _ in range(3))  # links; twice the linked pairs, and the degrees, of its neighbours
        self.fresh = self.deg.copy()  # neighbours that nobody has seen
        self.parent = np.full(n, -1, dtype=np.int64)
        self.place = np.full(n, -1, dtype=np.int64)  # in the order of finding
        self.found, self.asked, self.entries, self.owners, self.starts = (Grown() for _ in range(5))
        # The queries so far, again; the pairs of open nodes are counted once, from what is known now.
        for v in crawl.closed:
            self._answer(self.at[v])
        for i in np.flatnonzero(self.open & (self.obs > 1)).tolist():
            own = crawl.near[self.ids[i]]
            self.pairs[i] = sum(len(own & crawl.near[w]) for w in own)
        if eccentric:
            self.up = np.full(n, _FAR, dtype=np.int64)
            for i in self.asked.now().tolist():
                self._bound(i, *self._eccentricity(i))

    def links(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of nodes one after another, and where those of each begin."""
        n = self.deg[at]
        ends = np.cumsum(n)
        return self.nbr[np.arange(ends[-1]) + np.repeat(self.ptr[at] - ends + n, n)], ends - n

    def _answer(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Close a node: the open nodes of its answer that are new, and those that are not."""
        near = self.nbr[self.ptr[i] : self.ptr[i + 1]]
        new = near[~self.seen[near]]
        old = near[self.open[near]]
        first = new if self.seen[i] else np.append(new, i)
        self.seen[first] = True
        self.place[first] = self.found.n + np.arange(len(first))
        self.found.add(first)
        self.open[i], self.closed[i] = False, True
        self.open[new], self.parent[new] = True, i
        self.obs[new] = 1
        self.obs[old] += 1
        self.obs[i] = len(near)
        self.around[new] += len(near)
        self.around[old] += len(near)
        if len(first):
            np.subtract.at(self.fresh, self.links(first)[0], 1)
        self.starts.add([self.entries.n])
        self.asked.add([i])
        self.entries.add(self.place[near])
        self.owners.add(np.full(len(near), self.place[i]))
        return new, old

    def told(self, v: str) -> None:
        i = self.at[v]
        if self.closed[i]:
            return
        new, old = self._answer(i)
        near, mine = self.c.near, self.c.near[v]
        for x in old.tolist():
            self.pairs[x] += 2 * len(near[self.ids[x]] & mine)
        if self.up is not None:
            away, far = self._eccentricity(i)
            if len(new):
                # A new node is one step beyond this one; no distance between others has grown.
                np.maximum(self.up, away + 1, out=self.up)
                self.up[new] = far + 1
            self._bound(i, away, far)

    # --- choices -----------------------------------------------------------------------------------------------------

    def least(self, at: np.ndarray) -> str:
        """The node of least hash, then id; the numbers ascend."""
        return self.ids[at[np.argmin(self.hash(self.c.seed, self.c.step, at))]] if len(at) > 1 else self.ids[at[0]]

    @staticmethod
    def greatest(at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Those whose value, rounded to nine places, is greatest."""
        near = value >= value.max() - 2e-9
        at, value = at[near], value[near]
        kinds, which = np.unique(value, return_inverse=True)
        rounded = np.array([round(float(x), 9) for x in kinds])
        return at[(rounded == rounded.max())[which]]

    def clustering(self, at: np.ndarray) -> np.ndarray:
        n = self.obs[at]
        return np.where(n > 1, self.pairs[at] / np.maximum(n * (n - 1), 1), 0.0)

    def ranked(self, share: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
        """The open nodes, and which of them are the share of greatest observed degree, then least id."""
        at = np.flatnonzero(self.open)
        obs = self.obs[at]
        k = int(share * len(at))
        if not k:
            return at, np.zeros(len(at), dtype=bool)
        count = np.bincount(obs)
        down = np.cumsum(count[::-1])
        p = int(np.searchsorted(down, k))
        least = len(count) - 1 - p
        first = obs > least
        first[np.flatnonzero(obs == least)[: k - int(down[p] - count[least])]] = True
        return at, first

    def candidates(self) -> np.ndarray:
        at, first = self.ranked()
        return at[first] if first.any() else at

    def expand(self) -> str:
        at, first = self.ranked()
        return self.least(at[~first])

    def densify(self) -> str:
        cand = self.candidates()
        obs = self.obs[cand]
        if len(cand) <= 10:
            return self.ids[cand[np.argmax(obs)]]
        lo, hi = int(obs.min()), int(obs.max())
        return self.least(self.greatest(cand, ((obs - lo) / (hi - lo) if hi > lo else obs) * (1 - self.clustering(cand))))

    def quarter(self, arm: int) -> str:
        """Of the given quarter of the open nodes by observed degree times lack of clustering, then hash, that of least hash."""
        at = np.flatnonzero(self.open)
        low, high = len(at) * arm // 4, len(at) * (arm + 1) // 4
        score = self.obs[at] * (1 - self.clustering(at))
        least, most = np.partition(score, (low, high - 1))[[low, high - 1]]
        inside = at[(score > least) & (score <= most)]
        # Nodes of the least score are dealt by their hashes: the first of them belong to the quarter before.
        tied = at[score == least]
        skip = low - int((score < least).sum())
        draw = self.hash(self.c.seed, self.c.step, tied)
        k = int(np.argsort(draw, kind="stable")[skip]) if skip else int(np.argmin(draw))
        picks = [(int(draw[k]), int(tied[k]))]
        if len(inside):
            draw = self.hash(self.c.seed, self.c.step, inside)
            picks.append((int(draw.min()), int(inside[np.argmin(draw)])))
        return self.ids[min(picks)[1]]

    def pagerank(self, rounds: int = 20) -> str | None:
        """The open node of greatest PageRank in the sample; None where rounding to nine places hangs on the order of sums."""
        n, asked = self.found.n, self.place[self.asked.now()]
        entries, owners, starts = self.entries.now(), self.owners.now(), self.starts.now()
        links = self.obs[self.found.now()].astype(np.float64)
        rank = np.full(n, 1 / n)
        for _ in range(rounds):
            own = rank / links
            # Open nodes link to closed ones alone; the answers of closed nodes hold all their links.
            sums = np.bincount(entries, weights=own[owners], minlength=n)
            sums[asked] = np.add.reduceat(own[entries], starts)
            rank = 0.15 / n + 0.85 * sums
        at = np.flatnonzero(self.open)
        value = rank[self.place[at]]
        top = float(value.max())
        high = value[value >= top - 2e-9] * 1e9
        if (np.abs(high - np.floor(high) - 0.5) < 1e-3 * top).any():
            return None
        return self.least(self.greatest(at, value))

    def unseen(self) -> str:
        """Of the candidates of densification, one with most neighbours that nobody has seen."""
        cand = self.candidates()
        fresh = self.fresh[cand]
        return self.least(cand[fresh == fresh.max()])

    def towards(self, members, beside: dict, name) -> str:
        """The open node with most unseen neighbours in a community, of those next to it, if there are any, else of all;
        ``beside`` keeps the nodes next to a community under its name."""
        if name not in beside:
            own = np.zeros(len(self.ids), dtype=bool)
            own[[self.at[n] for n in members if n in self.at]] = True
            beside[name] = own, (np.unique(self.links(np.flatnonzero(own))[0]) if own.any() else np.flatnonzero(own))
        own, near = beside[name]
        near = near[self.open[near]]
        at = near if len(near) else np.flatnonzero(self.open)
        left = own & ~self.seen
        if self.deg[left].sum() < self.deg[at].sum():
            count = np.bincount(self.links(np.flatnonzero(left))[0], minlength=len(left))[at] if left.any() else np.zeros(len(at), dtype=np.int64)
        else:
            links, starts = self.links(at)
            count = np.add.reduceat(left[links].astype(np.int64), starts)
        return self.least(at[count == count.max()])

    def likeliest(self, w: np.ndarray, exact) -> str:
        """The open node of greatest sum of features (1, degree, clustering, neighbours' mean degree) by weights w; ``exact``
        gives the sum of a node as the rule defines it, where others come close."""
        at = np.flatnonzero(self.open)
        obs, around = self.obs[at], self.around[at]
        value = w[0] + w[1] * np.log1p(obs) + w[2] * self.clustering(at) + w[3] * np.log1p(around / np.maximum(obs, 1))
        near = value >= value.max() - 2e-9 - 1e-12 * np.abs(w).sum() * 50
        at = at[near]
        kinds, first, which = np.unique(np.stack([self.obs[at], self.pairs[at], self.around[at]]), axis=1, return_index=True, return_inverse=True)
        own = np.array([round(exact(self.ids[at[i]]), 9) for i in first])
        return self.least(at[(own == own.max())[which.reshape(-1)]])

    # --- eccentricity ------------------------------------------------------------------------------------------------

    def distances(self, i: int) -> np.ndarray:
        """Hops in the sample from a node to all it reaches; -1 elsewhere."""
        away = np.full(len(self.ids), -1, dtype=np.int64)
        away[i] = 0
        waiting = self.asked.now()
        edge, level = np.array([i]), 0
        while len(edge):
            shut = edge[self.closed[edge]]
            # A leaf leads back only to where it was reached from.
            loose = edge[~self.closed[edge] & ((self.obs[edge] > 1) | (edge == i))]
            found = []
            if len(loose):
                waiting = waiting[away[waiting] < 0]
                if len(waiting) and self.deg[waiting].sum() < self.deg[loose].sum():
                    beside, starts = self.links(waiting)
                    found.append(waiting[np.logical_or.reduceat(away[beside] == level, starts)])
                else:
                    beside, _ = self.links(loose)
                    found.append(beside[self.closed[beside] & (away[beside] < 0)])
                away[found[0]] = level + 1
            if len(shut):
                beside, _ = self.links(shut)
                found.append(beside[away[beside] < 0])
                away[found[-1]] = level + 1
            level += 1
            edge = np.concatenate(found) if found else edge[:0]
            if len(edge) > 1:
                mark = np.zeros(len(away), dtype=bool)
                mark[edge] = True
                edge = np.flatnonzero(mark)
        return away

    def _eccentricity(self, i: int) -> tuple[np.ndarray, int]:
        away = self.distances(i)
        return away, int(away.max())

    def _bound(self, i: int, away: np.ndarray, far: int) -> None:
        """A search from a node bounds the eccentricity of all others, and gives its own and its twins'."""
        np.minimum(self.up, np.where(away >= 0, far + away, self.up), out=self.up)
        self._exact(i, far)

    def _exact(self, i: int, far: int) -> None:
        self.up[i] = far
        if self.open[i] and self.obs[i] == 1:
            own = self.nbr[self.ptr[self.parent[i]] : self.ptr[self.parent[i] + 1]]
            self.up[own[self.open[own] & (self.obs[own] == 1)]] = far

    def _many(self, at: np.ndarray) -> np.ndarray:
        """The eccentricities of many nodes: their reach as bits, one for each of them, level by level."""
        n, wide = self.found.n, -(-len(at) // 64)
        reach = np.zeros((n, wide), dtype=np.uint64)
        k = np.arange(len(at))
        reach[self.place[at], k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        entries, owners, starts = self.entries.now(), self.owners.now(), self.starts.now()
        shut = self.place[self.asked.now()]
        loose = self.open[self.found.now()[entries]]
        into, own = entries[loose], owners[loose]
        order = np.argsort(into, kind="stable")
        into, own = into[order], own[order]
        begin = np.flatnonzero(np.append(True, into[1:] != into[:-1])) if len(into) else into
        far, level, edge = np.zeros(len(at), dtype=np.int64), 0, reach.copy()
        while True:
            level += 1
            then = np.zeros_like(reach)
            then[shut] = np.bitwise_or.reduceat(edge[entries], starts, axis=0)
            if len(into):
                then[into[begin]] = np.bitwise_or.reduceat(edge[own], begin, axis=0)
            then &= ~reach
            alive = np.bitwise_or.reduce(then, axis=0)
            grows = (alive[k // 64] >> (k % 64).astype(np.uint64)) & np.uint64(1) > 0
            if not grows.any():
                return far
            far[grows] = level
            reach |= then
            edge = then

    def outermost(self) -> str:
        """Of the open nodes of greatest eccentricity (G12), that of least hash. Upper bounds outlive a step: only nodes
        whose bound is the greatest are searched from, in the order of their hashes, until one attains it."""
        at = np.flatnonzero(self.open)
        while True:
            most = self.up[at].max()
            group = at[self.up[at] == most]
            group = group[np.argsort(self.hash(self.c.seed, self.c.step, group), kind="stable")]
            away, far = self._eccentricity(int(group[0]))
            self._bound(int(group[0]), away, far)
            if far == most:
                return self.ids[group[0]]
            wide = 64
            while len(group := group[self.up[group] == most]):
                twin = np.where(self.obs[group] == 1, self.parent[group], len(self.ids) + group)
                some = group[np.sort(np.unique(twin, return_index=True)[1])[:wide]]
                each = self._many(some)
                for i, far in zip(some.tolist(), each.tolist(), strict=True):
                    self._exact(i, far)
                if (each == most).any():
                    return self.ids[some[np.argmax(each == most)]]
                wide = 256
