"""Crawlers as grouped executors: one group is one run, advanced in plain Python over a shared adjacency.

For long budgets a Spark job per query would dominate; here all runs of a batch go at once, one task a run. The adjacency
is broadcast, so its size is checked first: larger graphs take ``crawl`` instead. Both give the same traces.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.choice import u_py
from netquarry.operators.arrays import Arrays

#: Most edges of a broadcast adjacency.
MAX_EDGES = 5_000_000
TRACE = "algo string, trial int, step int, cost double, node string, obs int, score double, nodes long, edges long"


class Access:
    """What a crawler may ask: whole, partial or paginated answers, with their cost."""

    def __init__(self, adj: dict[str, list[str]], limit: int = 0, paged: bool = False, seed: int = 0):
        self.adj, self.limit, self.paged, self.seed = adj, limit, paged, seed
        self.asked: dict[str, int] = defaultdict(int)

    def ask(self, v: str) -> tuple[list[str], bool]:
        """The answer and whether nothing more can come from this node."""
        every, k = self.adj[v], self.asked[v]
        self.asked[v] += 1
        if not self.limit or len(every) <= self.limit and not self.paged:
            return every, True
        if self.paged:
            return every[k * self.limit : (k + 1) * self.limit], (k + 1) * self.limit >= len(every)
        return sorted(every, key=lambda n: (u_py(self.seed, k, f"{v}-{n}"), n))[: self.limit], False


class Ranked:
    """Open nodes by a key that changes at few nodes a step: the greatest are found without a look at the others.

    The nodes of one key are a set; a heap holds the keys, stale ones included until they reach its top.
    """

    def __init__(self):
        self.key: dict[str, float] = {}
        self.same: dict[float, set[str]] = {}
        self.heap: list[float] = []

    def put(self, v: str, key: float) -> None:
        old = self.key.get(v)
        if old == key and v in self.key:
            return
        self.drop(v)
        self.key[v] = key
        own = self.same.get(key)
        if own is None:
            self.same[key] = own = set()
            heapq.heappush(self.heap, -key)
        own.add(v)

    def drop(self, v: str) -> None:
        key = self.key.pop(v, None)
        if key is not None:
            own = self.same[key]
            own.discard(v)
            if not own:
                del self.same[key]

    def greatest(self) -> set[str]:
        while -self.heap[0] not in self.same:
            heapq.heappop(self.heap)
        return self.same[-self.heap[0]]


class Crawl:
    """The state of one run: closed and open nodes, the sample's links, the cost and the trace."""

    def __init__(self, access: Access, algo: str, trial: int, seed: int, com: dict[str, int] | None = None, cheap: dict[str, int] | None = None):
        self.com, self.cheap = com or {}, cheap or {}  # a partition, and degrees in a cheap layer
        self.found: dict[int, list[str]] = defaultdict(list)  # step -> nodes that it found
        self.access, self.algo, self.trial, self.seed = access, algo, trial, seed
        self.closed: dict[str, int] = {}
        self.open: dict[str, int] = {}  # id -> step that found it
        self.near: dict[str, set[str]] = defaultdict(set)
        self.cost, self.step, self.edges = 0.0, 0, 0
        self.rows: list[tuple] = []
        self.cash: dict[str, float] = defaultdict(lambda: 1.0)
        self.opic: dict[str, float] = defaultdict(lambda: 1.0)
        self.ranked: dict[str, Ranked] = {}  # by the name of a key
        self.arrays: Arrays | None = None  # for rules that compare all open nodes in every step

    def table(self, **kw) -> Arrays:
        """The state as arrays; ``query`` keeps them up to date from their first use."""
        if self.arrays is None:
            self.arrays = Arrays(self, **kw)
        return self.arrays

    def best(self, name: str, step: int | None = None) -> str:
        """``top`` of the open nodes by a key of ``KEYS``; ``query`` keeps the order up to date from its first use."""
        own = self.ranked.get(name)
        if own is None:
            own = self.ranked[name] = Ranked()
            for n in self.open:
                own.put(n, round(KEYS[name](self, n), 9))
        return self.least(own.greatest(), step)

    def shut(self, v: str) -> None:
        """Close a node that was not asked last."""
        self.open.pop(v, None)
        self.closed.setdefault(v, self.step)
        for own in self.ranked.values():
            own.drop(v)

    def least(self, nodes, step: int | None = None) -> str:
        """The node of least hash, then id."""
        step = self.step if step is None else step
        if len(nodes) < 64:
            return min(nodes, key=lambda v: (u_py(self.seed, step, v), v))
        head = hashlib.md5(f"{self.seed}:{step}:".encode())
        return min(_hashed(head, nodes))[1]

    def deg(self, v: str) -> int:
        return len(self.access.adj[v])

    def obs(self, v: str) -> int:
        return len(self.near[v])

    def cc(self, v: str) -> float:
        n = self.near[v]
        return sum(len(n & self.near[w]) for w in n) / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0

    def u(self, v: str) -> float:
        return u_py(self.seed, self.step, v)

    def top(self, nodes, key=lambda v: 0) -> str:
        return min(nodes, key=lambda v: (-round(key(v), 9), self.u(v), v))

    def query(self, v: str, score: float = 0.0) -> int:
        """Ask for v's neighbours (G0); the number of nodes that are new."""
        before, obs = len(self.closed) + len(self.open), self.obs(v) if v in self.open else 0
        self.step += 1
        self.cost += 1
        answer, done = self.access.ask(v)
        self.open.pop(v, None) if done else self.open.setdefault(v, self.step)
        if done:
            self.closed.setdefault(v, self.step)
        mine = self.opic[v]
        for n in answer:
            if n not in self.near[v]:
                self.near[v].add(n)
                self.near[n].add(v)
                self.edges += 1
            self.cash[n] += 1 / self.deg(v)
            self.opic[n] += mine / self.deg(v)
            if n not in self.closed and n not in self.open:
                self.open[n] = self.step
                self.found[self.step].append(n)
        self.opic[v] = 0.0
        for name, own in self.ranked.items():
            for n in (v, *answer):
                own.put(n, round(KEYS[name](self, n), 9)) if n in self.open else own.drop(n)
        if self.arrays is not None:
            self.arrays.told(v)
        total = len(self.closed) + len(self.open)
        self.rows.append((self.algo, self.trial, self.step, self.cost, v, obs, float(score), total, self.edges))
        return total - before


def _hashed(head, nodes):
    """(first 8 hex digits of a hash, node) of nodes; ``head`` has taken what the keys begin with."""
    for v in nodes:
        h = head.copy()
        h.update(v.encode())
        yield h.digest()[:4], v


#: Keys of an open node that change only when it is asked or is part of an answer.
KEYS = {"same": lambda c, n: 0, "obs": Crawl.obs, "excess": lambda c, n: c.deg(n) - c.obs(n), "deg": Crawl.deg, "opic": lambda c, n: c.opic[n], "cash": lambda c, n: c.cash[n], "ratio": lambda c, n: c.obs(n) / c.deg(n)}


def sample_pagerank(c: Crawl, rounds: int = 20) -> dict[str, float]:
    nodes = [v for v in c.near if c.near[v]]
    rank = dict.fromkeys(nodes, 1 / max(1, len(nodes)))
    for _ in range(rounds):
        rank = {v: 0.15 / len(nodes) + 0.85 * sum(rank[w] / len(c.near[w]) for w in sorted(c.near[v])) for v in nodes}
    return rank


def distances(c: Crawl, v: str) -> dict[str, int]:
    """Hops in the sample from v to all it reaches."""
    away, edge = {v: 0}, [v]
    while edge:
        level = away[edge[0]] + 1
        edge = list({n for x in edge for n in c.near[x]} - away.keys())
        away.update(dict.fromkeys(edge, level))
    return away


def eccentricity(c: Crawl, v: str) -> int:
    return max(distances(c, v).values())


def farthest(c: Crawl) -> list[str]:
    """The open nodes of greatest eccentricity (G12), of all open nodes.

    Nodes with the same neighbours share theirs; a search from w bounds that of v by ecc(w) - d and ecc(w) + d, so only nodes
    that can still be among the greatest are searched from.
    """
    twins: dict[frozenset, list[str]] = defaultdict(list)
    for n in sorted(c.open):
        twins[frozenset(c.near[n])].append(n)
    most = {own[0]: math.inf for own in twins.values()}
    exact: dict[str, int] = {}
    while most:
        v = max(most, key=most.get)
        if exact and most[v] < max(exact.values()):
            break
        del most[v]
        away = distances(c, v)
        exact[v] = max(away.values())
        for n in most:
            if n in away:
                most[n] = min(most[n], exact[v] + away[n])
    best = max(exact.values())
    return [n for own in twins.values() if exact.get(own[0]) == best for n in own]


def _simple(rule):
    def run(c: Crawl, v: str, budget: float, p: dict) -> None:
        while v is not None and c.cost < budget:
            c.query(v)
            v = rule(c, v, p) if c.open else None

    return run


def _queue(half: bool):
    def run(c: Crawl, v: str, budget: float, p: dict) -> None:
        queue: list[tuple] = []
        round_ = math.floor if p.get("round") == "floor" else math.ceil
        while v is not None and c.cost < budget:
            c.query(v)
            new = sorted((n for n in c.found[c.step] if n != v), key=lambda n: (c.u(n), n))
            for n in new[: round_(len(new) / 2)] if half else new:
                heapq.heappush(queue, (c.step, c.u(n), n))
            while queue and queue[0][2] not in c.open:
                heapq.heappop(queue)
            v = queue[0][2] if queue else None

    return run


def _walk(c: Crawl, v: str, budget: float, p: dict) -> None:
    hop, most = 0, 50 * budget + 100
    c.query(v)
    while c.cost < budget and hop < most and (c.open or p.get("mode") == "any"):
        hop += 1
        if p.get("teleport") and u_py(c.seed, hop, "jump") < p["teleport"] and c.open:
            v = min(c.open, key=lambda n: (u_py(c.seed, hop, n), n))
        elif p.get("greedy") and u_py(c.seed, hop, "turn") < (p["greedy"] if p["greedy"] < 1 else sum(map(c.cc, c.near[v])) / max(1, c.obs(v))) and (own := [n for n in c.near[v] if n in c.open]):
            v = max(own, key=lambda n: (c.obs(n), n))
        elif c.near[v]:
            v = min(c.near[v], key=lambda n: (u_py(c.seed, hop, n), n))
        if v not in c.closed:
            c.query(v)


def _k_rank(c: Crawl, v: str, p: dict) -> str:
    ranked = sorted(c.open, key=lambda n: (-(c.deg(n) - c.obs(n)), c.u(n), n))
    cut = int(0.1 * len(ranked))
    return c.top(ranked[:cut]) if cut > 2 else ranked[0]


def _max_score(c: Crawl, v: str, p: dict) -> str:
    best = sorted(c.closed, key=lambda n: (-c.obs(n), n))[:10]
    own = {n for b in best for n in c.near[b] if n in c.open}
    return c.top(own) if len(c.closed) > 10 and own else c.top(c.open)


def _gap(c: Crawl, v: str, p: dict) -> str:
    mean = sum(map(c.obs, c.closed)) / len(c.closed)
    return min(c.open, key=lambda n: (c.obs(n) < mean, -(c.obs(n) - mean), c.u(n), n))


def _quartile_arm(c: Crawl, v: str, p: dict) -> str:
    """Four arms by score quarter; an unpulled arm first, then that of best mean reward."""
    arms = p.setdefault("arms", {i: [] for i in range(4)})
    if "last" in p:
        arms[p["last"][0]].append(len(c.closed) + len(c.open) - p["last"][1])
    n = len(c.open)
    live = [i for i in range(4) if n * i // 4 < n * (i + 1) // 4]
    arm = min(live, key=lambda i: (bool(arms[i]), -(sum(arms[i]) / len(arms[i]) if arms[i] else 0), i))
    p["last"] = (arm, len(c.closed) + n)
    return c.table().quarter(arm)


def _pagerank(c: Crawl, v: str, p: dict) -> str:
    pick = c.table().pagerank()
    if pick is None:
        rank = sample_pagerank(c)
        pick = c.top(c.open, lambda n: rank.get(n, 0.0))
    return pick


def _likely(c: Crawl, v: str, p: dict) -> str:
    """The open node with most neighbours nobody has seen."""
    seen = set(c.closed) | set(c.open)
    return c.top(c.open, lambda n: sum(w not in seen for w in c.access.adj[n]))


def _vmab(c: Crawl, v: str, budget: float, p: dict) -> None:
    """A bandit over arms that come and go; an arm holds the open nodes with the same closed neighbours."""
    _walk(c, v, min(10.0, budget), {})
    rewards: dict[tuple, list[float]] = defaultdict(list)
    born: dict[tuple, int] = {}
    arms: dict[tuple, set[str]] = {}
    arm_of: dict[str, tuple] = {}
    sizes: dict[int, dict[tuple, None]] = {}  # arms without a reward by their number of neighbours
    pulled: set[tuple] = set()  # live arms with rewards

    def leave(n: str) -> None:
        a = arm_of.pop(n, None)
        if a is not None:
            arms[a].discard(n)
            if not arms[a]:
                del arms[a]
                pulled.discard(a)
                own = sizes.get(len(a), {})
                own.pop(a, None)
                if not own:
                    sizes.pop(len(a), None)

    def enter(n: str) -> None:
        a = tuple(sorted(c.near[n] & c.closed.keys()))
        if arm_of.get(n) == a:
            return
        leave(n)
        arm_of[n] = a
        if a not in arms:
            arms[a] = set()
            pulled.add(a) if rewards.get(a) else sizes.setdefault(len(a), {}).setdefault(a)
            born.setdefault(a, c.step)
        arms[a].add(n)

    for n in c.open:
        enter(n)
    while c.open and c.cost < budget:
        decay = 150 * math.exp(-0.05 * c.step)
        worth = lambda a: sum(rewards[a]) / len(rewards[a]) + decay * math.sqrt(2 * math.log(max(2, c.step - born[a] + 1)) / len(rewards[a]))
        live = [(-round(worth(a), 9), a) for a in pulled]
        if sizes:
            most = max(sizes)  # the longest of the arms without a reward
            live.append((-round(float(most) + decay, 9), min(sizes[most])))
        arm = min(live)[1]
        score = worth(arm) if arm in pulled else float(len(arm)) + decay
        pick = c.top(arms[arm], lambda n: c.cash[n])
        reward = float(c.query(pick, score))
        if arm not in pulled:
            own = sizes[len(arm)]
            del own[arm]
            if not own:
                del sizes[len(arm)]
            pulled.add(arm)
        rewards[arm].append(reward)
        leave(pick)
        for n in c.near[pick]:
            if n in c.open:
                enter(n)


def _seed_walk(c: Crawl, v: str, budget: float, p: dict) -> list[str]:
    """A walk that accepts a neighbour with probability min(1, its observed degree / the degree here); the nodes it took."""
    took: list[str] = []
    for hop in range(int(50 * budget) + 100):
        if c.cost >= budget or (not c.open and c.closed):
            break
        if v not in c.closed:
            c.query(v)
        n = min(c.near[v], key=lambda x: (u_py(c.seed, hop, x), x))
        if u_py(c.seed, hop, "accept") < c.obs(n) / len(c.near[v]):
            v = n
            took.append(v)
    return took


def calibrated_weight(c: Crawl, took: list[str]) -> tuple[float, float]:
    """The greatest closed degree over the mean degree that the harmonic estimate (E12) of the nodes taken gives; and it."""
    own = [c.obs(n) for n in set(took)] or [c.obs(n) for n in c.closed]
    mean = math.ceil(len(own) / sum(1 / max(1, d) for d in own))
    return max(map(c.obs, c.closed)) / mean, float(mean)


def _random_exp(c: Crawl, v: str, budget: float, p: dict) -> None:
    """A seed walk, then random expansion alone."""
    _walk(c, v, min(budget, max(5.0, 0.15 * budget)), {})
    while c.open and c.cost < budget:
        c.query(c.table().expand())


def _oracle(c: Crawl, v: str, budget: float, p: dict) -> None:
    """With a partition at hand: expand towards the community with most unseen members for its size, densify on the
    candidate with most unseen neighbours while the densification score stays at 0.1 or more."""
    members: dict[int, set[str]] = defaultdict(set)
    for n, k in c.com.items():
        members[k].add(n)
    unseen = {k: len(own) for k, own in members.items()}
    beside: dict = {}  # communities, and the nodes with a neighbour in them
    pick: str | None = v

    def ask(v: str, score: float) -> int:
        start = v not in c.open
        new = c.query(v, score)
        for n in (*c.found[c.step], *([v] if start else [])):
            if n in c.com:
                unseen[c.com[n]] -= 1
        return new

    while pick is not None and c.cost < budget:
        den = 1.0
        while pick is not None and c.cost < budget and den >= 0.1:
            obs = c.obs(pick)
            new, room = ask(pick, den), max(0, c.deg(pick) - obs)
            den = (0.5 * den if c.step > 1 else 0.0) + (new / room if room else 0.0)
            pick = c.table().unseen() if c.open else None
        if not c.open:
            break
        target = max(members, key=lambda k: (unseen[k] / len(c.com), -k), default=None)
        pick = c.table().towards(members.get(target, ()), beside, target)


def _man(c: Crawl, v: str, p: dict) -> str:
    """Of the top fifth by observed degree, one of the top tenth by true degree that the cheap layer lacks, else of the
    best by degree, clustering and cheap degree."""
    ranked = sorted(c.open, key=lambda n: (-c.obs(n), n))
    cand = ranked[: int(0.2 * len(ranked))] or ranked
    absent = [n for n in sorted(cand, key=lambda n: (-c.deg(n), n))[: int(0.1 * len(cand))] if n not in c.cheap]
    if absent:
        return c.top(absent)
    lo, hi = min(map(c.obs, ranked)), max(map(c.obs, ranked))
    there = [c.cheap[n] for n in cand if n in c.cheap]
    low, high = min(there, default=0), max(there, default=0)

    def score(n: str) -> float:
        own = 0.5 * ((c.obs(n) - lo) / (hi - lo) if hi > lo else c.obs(n)) * (1 - c.cc(n))
        return own + (0.5 * ((c.cheap[n] - low) / (high - low)) ** 0.3 if n in c.cheap and high > low else 0.0)

    return c.top(cand, score)


def _learned(c: Crawl, v: str, budget: float, p: dict) -> None:
    """The greatest observed degree up to a cost of 50 (half the budget, if that is less); then the open node that a
    logistic regression over the queries so far (degree, clustering and neighbours' mean degree; new nodes over the median) likes
    best."""
    rows: list[list[float]] = []
    gains: list[int] = []
    features = lambda n: [1.0, math.log1p(c.obs(n)), c.cc(n), math.log1p(sum(map(c.obs, c.near[n])) / max(1, c.obs(n)))]
    while v is not None and c.cost < budget:
        rows.append(features(v))
        gains.append(c.query(v))
        if not c.open:
            break
        y = np.array(gains) > np.median(gains)
        if c.cost <= min(50.0, budget / 2) or y.all() or not y.any():
            v = c.top(c.open, c.obs)
            continue
        x, w = np.array(rows), np.zeros(4)
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(4), x.T @ (q - y) + w)
        v = c.table().likeliest(w, lambda n: float(np.dot(features(n), w)))


def _exp_den(c: Crawl, v: str, budget: float, p: dict) -> None:
    """A seed walk (or G16: a queue; G15: an accepting walk), then expansion and densification in turns (``den`` falls under ``exp`` or a threshold)."""
    first = {"bfs": _queue(False), "smooth": _seed_walk}.get(p.get("seed"), _walk)
    took = first(c, v, min(budget, p.get("seed_budget", max(5.0, 0.15 * budget))), {})
    wanted = sum(1 for n in c.closed) / max(1e-9, sum(1 / max(1, c.obs(n)) for n in c.closed))
    weight = max(map(c.obs, c.closed)) / max(1.0, wanted)
    if p.get("seed") == "smooth":
        weight, wanted = calibrated_weight(c, took)
    den, exp = math.inf, 0.0
    table = c.table(eccentric=bool(p.get("eccentric")))
    while c.open and c.cost < budget:
        pick = table.outermost() if p.get("eccentric") else table.expand()
        obs = c.obs(pick)
        new = c.query(pick, exp)
        room = max(0, c.deg(pick) - obs)
        exp = 0.5 * exp + (room - new) / room if room else 0.5 * exp
        den = math.inf
        while c.open and c.cost < budget:
            pick = table.densify()
            obs = c.obs(pick)
            new = c.query(pick, 0.0 if math.isinf(den) else den)
            room = c.deg(pick) - obs
            x = weight * new / room if room > 0 else 0.0
            den = x if math.isinf(den) else 0.5 * den + x
            if p.get("escalate") and obs >= wanted:
                weight += 10
            if den <= p["threshold"] if "threshold" in p else den < exp:
                break


def _hybrid(c: Crawl, v: str, budget: float, p: dict) -> None:
    """Greedy and walking in turns; every ten steps the mode flips if the window's yield fell under the decayed last."""
    mode, last, now, t = "mod", 0.0, 0, 0
    while v is not None and c.cost < budget:
        now += c.query(v, float(mode == "mod")) if v not in c.closed else 0
        t += 1
        if t % 10 == 0:
            if now < int(last * math.exp(-(t / 10) / 200)):
                mode = "rw" if mode == "mod" else "mod"
            last, now = float(now), 0
        if not c.open:
            break
        own = [n for n in c.near[v] if n in c.open]
        v = c.top(c.open, c.obs) if mode == "mod" or not own else c.top(own)


def _percentile(c: Crawl, v: str, budget: float, p: dict) -> None:
    """Random open nodes until one's degree percentile among the closed reaches a moving threshold; then densify."""
    bar = p.get("percentile", 80.0)
    c.query(v)
    while c.open and c.cost < budget:
        pick = c.top(c.open)
        c.query(pick, bar)
        degs = sorted(map(c.obs, c.closed))
        rank = 100.0 * sum(d <= c.obs(pick) for d in degs) / len(degs)
        bar = min(100.0, bar * 1.01) if rank >= bar else bar * 0.995
        while rank >= bar and c.open and c.cost < budget:
            own = [n for n in c.near[pick] if n in c.open]
            if not own:
                break
            pick = c.top(own, c.obs)
            if c.query(pick, bar) == 0:
                break


def _skipping(c: Crawl, v: str, budget: float, p: dict) -> None:
    """H2-H5, H7: under incomplete access a node may be asked again; asks with low chance of news are skipped, five in a row at most."""
    last: dict[str, float] = {}
    skips, rules = 0, p.get("next", lambda c: c.obs)
    for turn in range(int(20 * budget) + 20):
        if v is None or c.cost >= budget:
            break
        d, o = c.deg(v), c.obs(v)
        chance = 1.0 if not o else min(1.0, abs(d - o) / max(1, c.access.limit))
        if v in last and c.cost:
            chance *= (c.cost - last[v]) / c.cost
        if u_py(c.seed, turn, v) > chance and skips < 5:
            skips += 1
        else:
            skips = 0
            last[v] = c.cost
            c.query(v, chance)
            if c.obs(v) == d:
                c.shut(v)
        if p.get("key") and c.open:
            v = c.best(p["key"] if skips == 0 else "same", turn + 1)
            continue
        near = [n for n in c.near[v] if n in c.open] if p.get("walk") else []
        rule = rules(c) if skips == 0 else lambda n: 0
        v = min(near or c.open, key=lambda n: (-rule(n), u_py(c.seed, turn + 1, n), n)) if c.open else None


def _half_queue(c: Crawl):
    """First found first, the drawn half of each answer before the rest."""
    drawn = {n for step, own in c.found.items() for n in sorted(own, key=lambda n: (u_py(c.seed, step, n), n))[: math.ceil(len(own) / 2)]}
    return lambda n: (1 << 40 if n in drawn else 0) - c.open[n]


def _ranks(c: Crawl):
    rank = sample_pagerank(c)
    return lambda n: round(rank.get(n, 0.0), 9)


#: H7: what a crawler prefers among the open nodes under incomplete access; ``rw`` moves to a neighbour.
INCOMPLETE = {
    "mod": lambda c: c.obs, "bfs": lambda c: lambda n: -c.open[n], "sb": _half_queue, "random": lambda c: lambda n: 0, "rw": lambda c: lambda n: 0,
    "med": lambda c: lambda n: c.deg(n) - c.obs(n), "opic": lambda c: lambda n: c.opic[n], "pagerank": _ranks,
}

#: Those of them that are a key of ``KEYS``.
INDEXED = {"mod": "obs", "random": "same", "med": "excess"}

ALGORITHMS = {
    "bfs": (_queue(False), {}), "sb": (_queue(True), {}), "random": (_simple(lambda c, v, p: c.least(c.open)), {}), "rw": (_walk, {"mode": "any"}),
    "mod": (_simple(lambda c, v, p: c.best("obs")), {}), "med": (_simple(lambda c, v, p: c.best("excess")), {}),
    "cheat": (_simple(lambda c, v, p: c.best("deg")), {}), "pagerank": (_simple(_pagerank), {}),
    "opic": (_simple(lambda c, v, p: c.best("opic")), {}), "cash": (_simple(lambda c, v, p: c.best("cash")), {}),
    "vmab": (_vmab, {}), "exp_den": (_exp_den, {}), "dense_ex": (_exp_den, {"eccentric": True}), "exp_den_0.2": (_exp_den, {"threshold": 0.2}), "exp_den_0.5": (_exp_den, {"threshold": 0.5}), "exp_den_0.7": (_exp_den, {"threshold": 0.7}),
    "escalating": (_exp_den, {"escalate": True}), "hybrid": (_hybrid, {}), "k_rank": (_simple(_k_rank), {}), "max_score": (_simple(_max_score), {}), "degree_gap": (_simple(_gap), {}), "quartile": (_simple(_quartile_arm), {}),
    "unobserved": (_simple(_likely), {}), "percentile": (_percentile, {}), "rw_teleport": (_walk, {"teleport": 0.1}), "rw_mixed": (_walk, {"greedy": 0.5}), "rw_clustered": (_walk, {"greedy": 1}),
    "ratio": (_simple(lambda c, v, p: c.best("ratio")), {}),
    "seed_walk": (_seed_walk, {}), "random_exp": (_random_exp, {}), "oracle": (_oracle, {}), "man": (_simple(_man), {}), "learned": (_learned, {}),
    "dense_ex_bfs": (_exp_den, {"eccentric": True, "seed": "bfs"}), "dense_ex_smooth": (_exp_den, {"eccentric": True, "seed": "smooth"}),
}


def run_one(adj: dict[str, list[str]], algo: str, trial: int, budget: float, seed: int, limit: int = 0, paged: bool = False, incomplete: bool = False, com: dict[str, int] | None = None, cheap: dict[str, int] | None = None) -> list[tuple]:
    """One run; the runs of a trial share their start node."""
    c = Crawl(Access(adj, limit, paged, seed), algo, trial, seed, com, cheap)
    start = min(adj, key=lambda n: (u_py(seed, 0, n), n))
    body, params = ALGORITHMS[algo]
    if incomplete:
        if algo not in INCOMPLETE:
            raise ValueError(f"{algo} has no rule for incomplete access: one of {', '.join(INCOMPLETE)}")
        _skipping(c, start, budget, {"next": INCOMPLETE[algo], "walk": algo == "rw", "key": INDEXED.get(algo)})
    else:
        body(c, start, budget, dict(params))
    return c.rows


def adjacency_of(edges: DataFrame, max_edges: int = MAX_EDGES) -> dict[str, list[str]]:
    """The checked adjacency that is broadcast."""
    if edges.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"over {max_edges} edges: use operators.crawl, which never holds the graph in one process")
    adj: dict[str, list[str]] = defaultdict(list)
    got = edges.select("src", "dst").toArrow()
    for a, b in zip(got.column("src").to_pylist(), got.column("dst").to_pylist(), strict=True):
        adj[a].append(b)
        adj[b].append(a)
    return {k: sorted(v) for k, v in sorted(adj.items())}


def mapping_of(table: DataFrame | None, adj: dict[str, list[str]]) -> dict:
    """A table of a node's value as a mapping, for the nodes of the checked adjacency only."""
    if table is None:
        return {}
    got = table.toArrow()
    return {k: v for k, v in zip(*(got.column(i).to_pylist() for i in range(2)), strict=True) if k in adj}


def crawl_all(edges: DataFrame, algos: list[str], trials: int, budget: float, seed: int = 1, limit: int = 0, paged: bool = False, incomplete: bool = False, max_edges: int = MAX_EDGES, com: DataFrame | None = None, cheap: DataFrame | None = None) -> DataFrame:
    """The traces of algorithms by trials, one task a run. A trial's seed is shared by its algorithms. ``com(id, com)`` serves the
    oracle, ``cheap(id, deg)`` the crawl that looks at a cheap layer."""
    spark = edges.sparkSession
    adj = adjacency_of(edges, max_edges)
    shared = spark.sparkContext.broadcast((adj, mapping_of(com, adj), mapping_of(cheap, adj)))
    runs = [(a, t) for a in algos for t in range(trials)]

    def body(batches):
        graph, partition, degree = shared.value
        for algo, trial in (runs[i] for pdf in batches for i in pdf["id"]):
            rows = run_one(graph, algo, trial, budget, seed + trial, limit, paged, incomplete, partition, degree) if graph else []
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRACE.split(", ")])

    # Rows of a range are dealt evenly; by a hash of their names, runs would share tasks while others stay empty.
    return spark.range(0, len(runs), 1, max(1, min(len(runs), 200))).mapInPandas(body, TRACE)


def budget_curve(trace: DataFrame, interval: int = 10) -> DataFrame:
    """G1: nodes and edges at every multiple of the interval."""
    mark = F.floor("cost")
    return trace.where(mark % interval == 0).groupBy("algo", "trial", mark.cast("int").alias("budget")).agg(F.max("nodes").alias("nodes"), F.max("edges").alias("edges"))
