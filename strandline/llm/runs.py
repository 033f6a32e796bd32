"""Periodic runs of words: suffix trees of a text and its reversal, and Lyndon roots extended both ways.

A run is a stretch of words whose smallest period is ``q``, at least
``least_words`` long and ``repeats`` periods long, that neither neighbour
extends. Every run has a Lyndon root: a Lyndon word, longest from its first
word on, by one of two orders of words. So the longest Lyndon words from all
places, in both orders, are the candidates; each is extended to the right by
the longest common prefix of two suffixes and to the left by that of the
reversal. Suffix trees are Ukkonen's; a common prefix is the depth of a lowest
common ancestor, a range minimum over the tour of the tree in constant time.

Words in no repeated stretch of a few words can be in no run; a text's trees
are built of its other parts, which are joined by marks that occur once.

Defined results: a null text and one without words have no runs and collapse to
an empty text. Whole texts count, however long: a task holds the trees of one
text, some 400 bytes a word that is in a repeated stretch. Words are what lies
between ASCII white space, compared by their bytes. Equal texts have equal
results; repeated rows stay separate, and an empty table gives an empty result.
Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunsConfig:
    least_words: int = 24
    repeats: int = 3

    def stretch(self) -> int:
        """The most words such that each stretch of so many within a run is there a second time in it.

        A stretch of k words of a run of n words and period q has no second
        place only if n <= 2q + k - 2.
        """
        k = 1
        while all(max(self.least_words, self.repeats * q) > 2 * q + k - 1 for q in range(1, self.least_words + k + 2)):
            k += 1
        return k

    def __post_init__(self) -> None:
        if self.repeats < 3 or self.least_words < 1:
            raise ValueError("runs have three periods or more")


#: Of a run: first word, words, period.
Run = tuple[int, int, int]
_RUN = "struct<start: long, length: long, period: long>"
RESULT = f"struct<runs: array<{_RUN}>, strongest: {_RUN}, collapsed: string>"


def suffix_tree(symbols: list[int], alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's tree of ``symbols``, the last of which occurs once: for each node but the root its number, parent, first symbol and the length of its edge."""
    n = len(symbols)
    start, end, link, go = [0], [0], [0], {}
    node = edge = length = left = 0
    for i, c in enumerate(symbols):
        left += 1
        fresh = 0
        while left:
            if not length:
                edge = i
            key = node * alphabet + symbols[edge]
            to = go.get(key)
            if to is None:
                go[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                a = start[to]
                long = min(end[to], i + 1) - a
                if length >= long:
                    edge += long
                    length -= long
                    node = to
                    continue
                if symbols[a + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                split = len(start)
                go[key] = split
                start += (a, i)
                end += (a + length, n)
                link += (0, 0)
                go[split * alphabet + c] = split + 1
                start[to] = a + length
                go[split * alphabet + symbols[a + length]] = to
                if fresh:
                    link[fresh] = split
                fresh = split
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    keys = np.fromiter(go.keys(), np.int64, len(go))
    nodes = np.fromiter(go.values(), np.int64, len(go))
    lengths = np.array(end) - np.array(start)
    return nodes, keys // alphabet, keys % alphabet, lengths[nodes]


class CommonPrefixes:
    """Longest common prefixes of suffixes, and the suffixes' ranks, from a suffix tree."""

    def __init__(self, symbols: list[int], alphabet: int, marks: int):
        """Symbols under ``marks`` occur once each."""
        n = len(symbols)
        nodes, parents, firsts, lengths = suffix_tree(symbols, alphabet)
        count = len(nodes) + 1
        parent, length = np.zeros(count, np.int64), np.zeros(count, np.int64)
        parent[nodes], length[nodes] = parents, lengths
        inner = np.zeros(count, bool)
        inner[parents] = True
        inner[0] = True
        self._family = nodes, parents, firsts, inner.tolist()
        tour = self._tour(firsts)
        depth = [0] * count
        for v, p, long in zip(tour, parent[tour].tolist(), length[tour].tolist(), strict=True):
            depth[v] = depth[p] + long
        depth = np.array(depth)
        tour = np.array(tour)
        suffix = np.where(inner, -1, n - depth)
        self._suffix = suffix
        at = suffix[tour]
        self._place = np.zeros(n, np.int64)
        self._place[at[at >= 0]] = np.flatnonzero(at >= 0)
        # A lowest common ancestor is the parent of the highest node between, so its depth is a minimum.
        level = depth[parent[tour]].astype(np.int32)
        self._least, step = [level], 1
        while 2 * step <= count:
            level = np.minimum(level[:-step], level[step:])
            self._least.append(level)
            step *= 2
        self._marks, self._alphabet, self._n = marks, alphabet, n

    def _tour(self, order: np.ndarray) -> list[int]:
        """All nodes, a parent before its children and those by ``order``."""
        nodes, parents, _, inner = self._family
        by = np.lexsort((-order, parents))
        children = nodes[by].tolist()
        bounds = np.searchsorted(parents[by], np.arange(len(inner) + 1)).tolist()
        tour, open_ = [], [0]
        while open_:
            v = open_.pop()
            tour.append(v)
            if inner[v]:
                open_ += children[bounds[v] : bounds[v + 1]]
        return tour

    def ranks(self, turned: bool) -> np.ndarray:
        """Each suffix's place among all; ``turned`` has words the other way round. Marks come first in both orders."""
        firsts = self._family[2]
        order = np.where(firsts < self._marks, firsts, self._alphabet - firsts + self._marks) if turned else firsts
        at = self._suffix[np.array(self._tour(order))]
        at = at[at >= 0]
        rank = np.empty(self._n, np.int64)
        rank[at] = np.arange(self._n)
        return rank

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different suffixes ``a`` and ``b``."""
        x, y = self._place[a], self._place[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            some = level == k
            table = self._least[k]
            out[some] = np.minimum(table[low[some]], table[high[some] - (1 << k) + 1])
        return out


def _next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank; the last place has the least rank."""
    values, after = ranks.tolist(), [0] * len(ranks)
    open_: list[int] = []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            after[open_.pop()] = i
        open_.append(i)
    return np.array(after)


def _repeated(ids: np.ndarray, stretch: int) -> np.ndarray:
    """Which words are in a stretch of that length that occurs twice; a few others may be named too."""
    n = len(ids) - stretch + 1
    kept = np.zeros(len(ids) + 1, np.int64)
    if n < 2:
        return kept[:-1] > 0
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = spread[:n].copy()
    for i in range(1, stretch):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += spread[i : n + i]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    np.add.at(kept, at, 1)
    np.add.at(kept, at + stretch, -1)
    return np.cumsum(kept)[:-1] > 0


def runs_of(ids: np.ndarray, config: RunsConfig = RunsConfig()) -> list[Run]:
    """All runs of a sequence of numbers, by start and then period."""
    if len(ids) < config.least_words:
        return []
    kept = _repeated(ids, config.stretch())
    edges = np.diff(np.r_[0, kept.astype(np.int8), 0])
    parts = [(a, b) for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True) if b - a >= config.least_words]
    if not parts:
        return []
    # Parts are joined by marks, the least symbols; another mark ends all.
    marks = len(parts) + 1
    place = np.concatenate([np.r_[np.arange(a, b), -1 - k] for k, (a, b) in enumerate(parts)])
    word = place >= 0
    symbols = np.where(word, 0, -place)
    numbers = np.unique(ids[place[word]], return_inverse=True)[1]
    symbols[word] = numbers + marks
    alphabet = int(symbols.max()) + 1
    n = len(symbols)
    ahead = CommonPrefixes([*symbols.tolist(), 0], alphabet, marks)
    roots = []
    for turned in (False, True):
        after = _next_smaller(ahead.ranks(turned))[:n]
        roots.append(np.stack([np.flatnonzero(word), after[word]]))
    i, j = np.unique(np.concatenate(roots, axis=1), axis=1)
    right = ahead.of(i, j)
    del ahead
    back = CommonPrefixes([*symbols[::-1].tolist(), 0], alphabet, marks)
    left = back.of(n - i, n - j)
    period, length = j - i, right + left + j - i
    good = length >= np.maximum(config.least_words, config.repeats * period)
    start = place[(i - left)[good]]
    return [tuple(r) for r in np.unique(np.stack([start, period[good], length[good]], axis=1), axis=0)[:, [0, 2, 1]].tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run with most periods, counted exactly; of equal ones the first, then the one of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words but those that follow a run's first period within it, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()])


def find_runs(text: Column, config: RunsConfig = RunsConfig()) -> Column:
    """For each text its ``runs``, the ``strongest`` of them, and the text ``collapsed``."""
    kind = pa.struct([pa.field(c, pa.int64()) for c in ("start", "length", "period")])

    def named(run: Run | None) -> dict | None:
        return None if run is None else dict(zip(("start", "length", "period"), run, strict=True))

    def udf(texts: pa.Array) -> pa.Array:
        found, best, kept = [], [], []
        for text in texts:
            words = (text.as_py() or b"").split()
            number: dict[bytes, int] = {}
            ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
            runs = runs_of(ids, config)
            found.append([named(r) for r in runs])
            best.append(named(strongest(runs)))
            kept.append(collapsed(words, runs).decode("utf-8", "replace"))
        arrays = [pa.array(found, pa.list_(kind)), pa.array(best, kind), pa.array(kept, pa.string())]
        return pa.StructArray.from_arrays(arrays, ["runs", "strongest", "collapsed"])

    return F.arrow_udf(udf, RESULT)(text.cast("binary"))
