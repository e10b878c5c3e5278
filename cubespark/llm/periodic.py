"""Periodic runs of words: maximal stretches that repeat with a fixed period.

A run is a stretch of consecutive words with smallest period q, at least ``max(12, 2q)`` long,
that no neighbouring word extends. Each document is searched by itself:

1. A run of such length holds words that match those q further on, six of them in a row at
   least, and each of its words is covered by a six-word sequence that is there again within
   the run. So stretches covered by repeated sequences are cut out, and cut again by
   themselves until nothing changes; no run is lost, and prose without runs ends here.
2. What is left gets a suffix tree by Ukkonen's algorithm, and another one of its reversal.
   An Euler tour notes the depth to which it climbs between two leaves, so the lowest common
   ancestor, and with it the longest common extension of two positions, is a range minimum
   that a sparse table gives in constant time.
3. Each run has a Lyndon root: the longest Lyndon word that starts at one of its positions,
   under one of the two orders of the alphabet. It ends at the next smaller suffix; suffixes
   are ranked by walking the tree in both orders. Each of these candidates is extended to both
   sides, to the right on the tree of the text, to the left on that of the reversal.

Words are runs without ASCII white space, as they are written. Null and empty texts have no
words and no runs. Ids are not read, so null ids and rows that repeat are rows like others;
ties of the longest run go to the smallest start, then to the smallest period. Memory grows
with the periodic part of a single long text (some 300 bytes a word), not with prose. An
empty table gives an empty one. All other columns are kept; where they clash with a result
the result takes their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.llm.words import SPACES

LEAST = 12
SEQUENCE = LEAST // 2
ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
RESULTS = ("n_words", "runs", "collapsed")


class Tree(NamedTuple):
    """Suffix tree of n symbols, the last one a sentinel 0 that is there once; node 0 is the root."""

    n: int
    width: int
    start: list[int]
    end: list[int]
    edges: dict[int, int]  # node * width + first symbol: child


def suffix_tree(symbols: list[int]) -> Tree:
    """Ukkonen's algorithm: one symbol at a time, from the active point along suffix links."""
    n, width = len(symbols), max(symbols) + 1
    start, end, link = [0], [0], [0]
    edges: dict[int, int] = {}
    node = at = depth = waiting = 0
    for i, symbol in enumerate(symbols):
        waiting += 1
        unlinked = 0
        while waiting:
            if not depth:
                at = i
            key = node * width + symbols[at]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                low = start[child]
                span = end[child] - low
                if depth >= span and end[child] <= i:
                    node, at, depth = child, at + span, depth - span
                    continue
                if symbols[low + depth] == symbol:
                    if unlinked:
                        link[unlinked] = node
                    depth += 1
                    break
                split = len(start)
                edges[key] = split
                start += (low, i)
                end += (low + depth, n)
                link += (0, 0)
                edges[split * width + symbol] = split + 1
                start[child] = low + depth
                edges[split * width + symbols[low + depth]] = child
                if unlinked:
                    link[unlinked] = split
                unlinked = split
            waiting -= 1
            if node:
                node = link[node]
            elif depth:
                depth -= 1
                at = i - waiting + 1
    return Tree(n, width, start, end, edges)


def euler_tour(tree: Tree, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of the tree's leaves, and the least depth on the tour to each leaf from the
    one before it. The sentinel comes first, the other symbols ascending or descending."""
    keys = np.fromiter(tree.edges.keys(), np.int64, len(tree.edges))
    children = np.fromiter(tree.edges.values(), np.int64, len(tree.edges))
    parents, symbols = np.divmod(keys, tree.width)
    # the last of a node's children is visited first
    rank = np.where(symbols == 0, tree.width, -symbols if not descending else symbols)
    order = np.lexsort((rank, parents))
    first = np.searchsorted(parents[order], np.arange(len(tree.start) + 1)).tolist()
    kids = children[order].tolist()
    start, end, n = tree.start, tree.end, tree.n
    suffixes, climbs = [], []
    stack, depths, least = kids[first[0] : first[1]], [0] * (first[1] - first[0]), 0
    while stack:
        node, above = stack.pop(), depths.pop()
        if above < least:
            least = above
        below = above + end[node] - start[node]
        low, high = first[node], first[node + 1]
        if low == high:
            suffixes.append(n - below)
            climbs.append(least)
            least = below
        else:
            stack += kids[low:high]
            depths += [below] * (high - low)
    return np.array(suffixes, np.int64), np.array(climbs, np.int64)


class Extensions:
    """Longest common extensions of pairs of positions, each in constant time."""

    def __init__(self, suffixes: np.ndarray, climbs: np.ndarray) -> None:
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.table = [climbs.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(climbs):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths for positions that differ pairwise."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self.table[k][low[some]], self.table[k][high[some] - (1 << int(k)) + 1])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next position of smaller rank, for all but the last one, which has the smallest."""
    ranks, n = rank.tolist(), len(rank) - 1
    found = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, ranks[i]
        while ranks[j] > own:
            j = found[j]
        found[i] = j
    return np.array(found[:n], np.int64)


def maximal_runs(codes: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of at least ``LEAST`` symbols, by start, then period."""
    n = len(codes)
    symbols = (np.unique(codes, return_inverse=True)[1] + 1).tolist()
    tree = suffix_tree([*symbols, 0])
    tours = [euler_tour(tree, descending) for descending in (False, True)]
    del tree
    begins, ends = [], []
    for suffixes, _ in tours:
        rank = np.empty(n + 1, np.int64)
        rank[suffixes] = np.arange(n + 1)
        begins.append(np.arange(n))
        ends.append(next_smaller(rank))
    b, e = np.concatenate(begins), np.concatenate(ends)
    right = Extensions(*tours[0]).of(b, e)
    del tours
    # what ends before position x of the text starts at n - x of its reversal
    left = Extensions(*euler_tour(suffix_tree([*symbols[::-1], 0]))).of(n - b, n - e)
    period = e - b
    start, length = b - left, left + period + right
    keep = (length >= LEAST) & (length >= 2 * period)
    found = np.unique(np.stack([start[keep], period[keep], length[keep]], 1), axis=0)
    return found[:, [0, 2, 1]]


def repeating_stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges that hold all runs: covered by sequences of ``SEQUENCE`` codes that are there twice
    within the range. Codes of different words may be equal; that only widens a range."""
    done, open_ranges = [], [(0, len(codes))]
    while open_ranges:
        low, high = open_ranges.pop()
        n = high - low - SEQUENCE + 1
        if high - low < LEAST:
            continue
        part = codes[low:high]
        names = np.zeros(n, np.uint64)
        for k in range(SEQUENCE):
            names = names * ODD + part[k : n + k]
            names ^= names >> np.uint64(29)
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        if not same.any():
            continue
        again = np.zeros(n, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        gaps = np.flatnonzero(np.diff(at) > SEQUENCE)
        begins = at[np.concatenate([[0], gaps + 1])] + low
        ends = at[np.append(gaps, len(at) - 1)] + SEQUENCE + low
        if len(begins) == 1 and begins[0] == low and ends[0] == high:
            done.append((low, high))
        else:
            open_ranges += zip(begins.tolist(), ends.tolist())
    return sorted(done)


def runs_of(words: list[bytes]) -> np.ndarray:
    """(start, length, period) of all runs of a document's words, by start, then period."""
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    found = []
    for low, high in repeating_stretches(codes):
        names: dict[bytes, int] = {}
        exact = np.array([names.setdefault(w, len(names)) for w in words[low:high]], np.int64)
        runs = maximal_runs(exact)
        runs[:, 0] += low
        found.append(runs)
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def without_repeats(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``n_words``, their ``runs`` (start, length, period; by start, then period) and
    ``collapsed``: the words that no run holds after its first period, joined by one space."""
    others = [c for c in df.columns if c not in RESULTS]
    source = df.select(*[F.col(f"`{c}`") for c in others], F.struct(F.col(f"`{text}`").alias("text")).alias("collapsed"))
    schema = T.StructType(
        [f for f in df.schema if f.name in others]
        + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, left, bounds, every = [], [], [0], []
            for value in batch.column(len(others)).field(0):
                words = (value.as_py() or "").encode().split()
                runs = runs_of(words)
                counts.append(len(words))
                bounds.append(bounds[-1] + len(runs))
                every.append(runs)
                left.append(b" ".join(without_repeats(words, runs)).decode())
            flat = np.concatenate(every) if every else np.zeros((0, 3), np.int64)
            fields = [pa.array(flat[:, k]) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(counts, pa.int64()), lists, pa.array(left, pa.string())],
                names=[*others, *RESULTS],
            )

    return source.mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length, of equal ones that of smallest start, then smallest period."""
    keyed = F.transform(runs, lambda r: F.struct(-r["length"], r["start"], r["period"], r.alias("run")))
    return F.get(F.transform(F.array(F.array_min(keyed)), lambda k: k["run"]), F.lit(0))


def word_list(text: Column) -> Column:
    """Runs without ASCII white space; null and empty give none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))


def periodic_tail(text: Column, start: Column, parts: Column) -> Column:
    """The text's words from number ``start`` % n on overwritten by the first ones of that tail again
    and again, with a period of 1 + floor(length of the tail / ``parts``); joined by one space."""

    def of(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = start % n
        p = F.lit(1) + F.floor((n - a) / parts)
        spun = F.transform(
            F.sequence(F.lit(0).cast("bigint"), n - 1),
            lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
        )
        return F.when(n > 0, F.array_join(spun, " ")).otherwise("")

    # the list is bound to a lambda's variable, else the text would be split again for each word
    return F.get(F.transform(F.array(word_list(text)), of), F.lit(0))
