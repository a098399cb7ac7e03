"""LM scoring: a window network predicts every token from both sides; its log-probabilities are summed."""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Saved, lean, pieces, table, tidied

#: Words with an output of their own at most: the most frequent ones. Others are spelt.
MAX_WORDS = 1 << 15
#: As neighbours, other words share so many embeddings by their last letters.
SUFFIXES = 64
#: Neighbours that a token is predicted from.
WINDOW = (-2, -1, 1, 2)
#: The network: width of embeddings, hidden units; step of training, tokens in a step.
EMBED, HIDDEN, RATE, STEP = 16, 16, 0.1, 4096
#: Each round predicts every so-manieth token of every document: all of them, unless a caller asks for fewer.
ROUNDS, EVERY = 1, 1
#: Characters with an own symbol in the spelling of other words, and the weight of the shorter context.
SYMBOLS, BACK = 62, 4.0
_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_").findall
_WORDS_AND_ENDS = re.compile(_WORDS.__self__.pattern + r"|\n").findall
#: What a word without a number of its own, and the end of a chunk, are until they get theirs.
_OTHER, _END = -1, -2
_MOST, _MOST_BYTES = 200_000, 16 << 20
_PIECE, _IDS, _BLOCK, _PARTS = 4 << 20, 2 << 20, 1 << 13, 16
#: Rows that a step moves more often have their values added up by themselves, the others together.
_OFTEN = 16
#: Nodes of the tree below which outputs are grouped, and nodes of a group whose turns are taken together.
_TOP, _COLUMNS = 31, 40


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all documents; each task adds up its own counts first.

    Words are runs of letters, runs of digits and single marks, lower-cased; none goes across white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            row: defaultdict[str, int] = defaultdict(itertools.count(1).__next__, {"\n": 0})  # words are numbered as they are met
            found = _WORDS_AND_ENDS("\n".join([*seen, ""]))
            rows = np.fromiter(map(row.__getitem__, found), np.int64, len(found))
            times = np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), np.diff(np.flatnonzero(rows == 0), prepend=-1))
            n = np.bincount(rows, times, len(row)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([*row][1:], pa.string()), pa.array(n[1:])], ["word", "n"])

        for batch in batches:
            for b in pieces(batch, _PIECE):
                for text in b.column(0).to_pylist():
                    seen.update((text or "").lower().split())
                if len(seen) > _MOST:
                    yield out()
                    seen.clear()
        yield out()

    return lean(documents).selectExpr("cast(text as string) text").mapInArrow(tidied(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = MAX_WORDS) -> list[tuple[str, int]]:
    """The words above the lowest level of frequency at which there are at most so many, most frequent first.

    Levels are sixteenths of a doubling, so the driver gets a number for each level and then the words.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).count().collect()
    least, room = None, most
    for r in sorted(levels, key=lambda r: -r.level):
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    rows = counts.where(level >= least).collect() if least is not None else []  # at most `most`
    return sorted(((r.word, r.n) for r in rows), key=lambda r: (-r[1], r[0]))


class Spelling(NamedTuple):
    """Probabilities of words without an own output, by their characters: each from the two before it, and an end."""

    symbol: dict[str, int]
    logs: np.ndarray  # [symbol two before, symbol before, symbol]

    def log_probability(self, word: str) -> float:
        """Characters without an own symbol share one, each with the same share of it."""
        other, edge = len(self.symbol), len(self.symbol) + 1
        s = [edge, edge, *(self.symbol.get(c, other) for c in word), edge]
        total = sum(float(self.logs[s[k - 2], s[k - 1], s[k]]) for k in range(2, len(s)))
        return total - s.count(other) * math.log(0x110000 - len(self.symbol))

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """log_probability of each of many words."""
        if not words:
            return np.zeros(0)
        other, edge, size = len(self.symbol), len(self.symbol) + 1, len(self.symbol) + 2
        symbol = np.full(0x110000, other, np.int32)
        for c, k in self.symbol.items():
            symbol[ord(c)] = k
        length = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(length + 3) - length - 3  # two edges, the characters, an edge
        s = np.full(int((length + 3).sum()), edge, np.int32)
        s[np.arange(int(length.sum())) + np.repeat(3 * np.arange(len(words)) + 2, length)] = symbol.take(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32))
        logs = np.zeros(len(s))
        logs[2:] = self.logs.ravel().take((s[:-2] * size + s[1:-1]) * size + s[2:])
        logs[starts] = logs[starts + 1] = 0.0
        return np.add.reduceat(logs, starts) - np.add.reduceat((s == other).astype(np.int64), starts) * math.log(0x110000 - len(self.symbol))


def spelling(counts: DataFrame, words: set[str], symbols: int = SYMBOLS) -> Spelling:
    """The spelling of all words of counts that aren't among words, as often as they occur; what the driver gets is bounded by the symbols cubed."""
    spark = counts.sparkSession
    sent = spark.sparkContext.broadcast(words)

    def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in sent.value:
                    for c in w:
                        seen[c] += n
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["c", "n"])

    found = counts.mapInArrow(tidied(characters), "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(symbols)
    symbol = {r.c: k for k, r in enumerate(found.collect())}
    other, edge = len(symbol), len(symbol) + 1
    size = len(symbol) + 2

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size**3, np.int64)
        for b in batches:
            cells: list[int] = []
            times: list[int] = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in sent.value:
                    s = [edge, edge, *(symbol.get(c, other) for c in w), edge]
                    cells += [(s[k - 2] * size + s[k - 1]) * size + s[k] for k in range(2, len(s))]
                    times += [n] * (len(s) - 2)
            np.add.at(seen, np.array(cells, np.int64), np.array(times, np.int64))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["cell", "n"])

    n3 = np.zeros(size**3)
    for r in counts.mapInArrow(tidied(triples), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        n3[r.cell] = r.n
    n3 = n3.reshape(size, size, size)
    n2 = n3.sum(0)
    p1 = (n2.sum(0) + 1) / (n2.sum() + size)
    p2 = (n2 + BACK * p1) / (n2.sum(1, keepdims=True) + BACK)
    p3 = (n3 + BACK * p2) / (n3.sum(2, keepdims=True) + BACK)
    return Spelling(symbol, np.log(p3).astype(np.float32))


class Tree(NamedTuple):
    """A Huffman tree over the outputs: the words, and a last one for all others. An output's probability is that of the turns to it."""

    nodes: np.ndarray  # of all outputs' ways, one after the other
    turns: np.ndarray  # 1: right, -1: left
    first: np.ndarray
    length: np.ndarray
    bias: np.ndarray  # of each node, by which the turns have their share of the counts

    @classmethod
    def of(cls, counts: Iterable[int]) -> Tree:
        weight = [max(int(n), 1) for n in counts]
        n = len(weight)
        heap = [(w, k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        up, side, bias = [0] * (2 * n - 1), [0] * (2 * n - 1), np.zeros(max(n - 1, 0), np.float32)
        for k in range(n - 1):
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            up[left] = up[right] = n + k
            side[left], side[right], bias[k] = -1, 1, math.log(b / a)
            heapq.heappush(heap, (a + b, n + k))
        nodes, turns, length = array("i"), array("b"), array("i")
        for leaf in range(n):
            at, before = leaf, len(nodes)
            while at != 2 * n - 2:
                nodes.append(up[at] - n)
                turns.append(side[at])
                at = up[at]
            length.append(len(nodes) - before)
        long = np.array(length, np.int64)
        return cls(np.array(nodes, np.int32), np.array(turns, np.float32), np.cumsum(long) - long, long, bias)

    def ways(self, outputs: np.ndarray, length: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
        """(steps, nodes and turns at all of them) of the first so many turns, from the output on, of each output's way.

        Outputs come in the order of longest_first. A step (n, a, b): the first n outputs' next turns stand from a to b.
        """
        first = self.first.take(outputs)
        n = np.searchsorted(-length, -np.arange(int(length.max(initial=0)))).tolist()
        at = np.concatenate([np.zeros(0, np.int64), *(first[:k] + step for step, k in enumerate(n))])
        ends = list(itertools.accumulate(n))
        return [(k, end - k, end) for k, end in zip(n, ends, strict=True)], self.nodes.take(at), self.turns.take(at)


def longest_first(length: np.ndarray) -> np.ndarray:
    """An order in which those with a k-th turn come before those without, for every k."""
    return np.argsort((-length).astype(np.int16), kind="stable")  # 16 bits are sorted by digits


class Blocks(NamedTuple):
    """A tree's heavy nodes as blocks of columns, so that the turns at them are products of matrices.

    The outputs below each exit of the _TOP heaviest nodes are a group. A group's columns are the nodes on the way
    to it and the heaviest ones below. The rest of an output's way, next to the output, isn't in its group's columns.
    """

    group: np.ndarray  # of each output
    columns: np.ndarray  # [group, column]: a node, or 0 where no output turns
    signs: np.ndarray  # [output, column]: its turn there, or 0 where it doesn't come by
    rest: np.ndarray  # of each output: how many turns of its way are in no column

    @classmethod
    def of(cls, tree: Tree) -> Blocks:
        cut = max(0, len(tree.bias) - _TOP)  # nodes were made in the order of their counts: the last ones are the heaviest
        of, ends = np.repeat(np.arange(len(tree.first)), tree.length), tree.first + tree.length
        tops = np.add.reduceat((tree.nodes >= cut).astype(np.int64), tree.first)
        exits = ends - tops
        _, some, group = np.unique(tree.nodes.take(exits) * 2 + (tree.turns.take(exits) > 0), return_index=True, return_inverse=True)
        columns, least = np.zeros((len(some), _COLUMNS), np.int64), np.full(len(some), cut)
        depth, column = ends.take(of) - 1 - np.arange(len(of)), np.zeros(len(tree.bias), np.int64)
        low = np.unique((group.take(of) * cut + cut - 1 - tree.nodes)[tree.nodes < cut])  # by group, the heaviest first
        starts = np.searchsorted(low, np.arange(len(some) + 1) * cut)
        for g, one in enumerate(some):
            columns[g, : tops[one]] = tree.nodes[exits[one] : ends[one]][::-1]
            below = cut - 1 - low[starts[g] : starts[g + 1]][: _COLUMNS - tops[one]] % max(cut, 1)
            if len(below):
                columns[g, tops[one] : tops[one] + len(below)], least[g] = below, below[-1]
                column[below] = tops[one] + np.arange(len(below))
        inside = tree.nodes >= least.take(group).take(of)
        signs = np.zeros((len(tree.first), _COLUMNS), np.int8)
        signs[of[inside], np.where(tree.nodes >= cut, depth, column.take(tree.nodes))[inside]] = tree.turns[inside]
        return cls(group, columns, signs, np.add.reduceat((~inside).astype(np.int64), tree.first))


class Network(NamedTuple):
    """Embeddings of the neighbours -> tanh -> a turn at each node on the way to the token."""

    embed: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray

    @classmethod
    def start(cls, n_in: int, tree: Tree, seed: int = 7) -> Network:
        """One that gives each token its share of the counts, whatever stands beside it."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[-2]), shape).astype(np.float32)
        return cls(rng.normal(0, 0.3, (n_in, EMBED)).astype(np.float32), normal(len(WINDOW) * EMBED, HIDDEN), np.zeros((1, HIDDEN), np.float32), np.zeros((len(tree.bias), HIDDEN), np.float32), tree.bias[:, None].copy())

    def tables(self) -> list[np.ndarray]:
        """What each neighbour adds to the hidden units, for each place beside the token."""
        return [self.embed @ part for part in np.split(self.hidden, len(WINDOW))]

    def log_probabilities(self, tree: Tree, beside: np.ndarray, outputs: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Of each row: log P(output | neighbours)."""
        if not len(self.out) or not len(outputs):
            return np.zeros(len(outputs))
        order = longest_first(tree.length.take(outputs))
        h, columns = np.repeat(self.bias, len(order), 0), beside.take(order, 0).T
        for column, t in zip(columns, tables or self.tables(), strict=True):
            h += t.take(column, 0)
        np.tanh(h, out=h)
        outputs = outputs.take(order)
        steps, node, turn = tree.ways(outputs, tree.length.take(outputs))
        z = self.base[:, 0].take(node)
        for n, a, b in steps:
            z[a:b] += np.einsum("ij,ij->i", h[:n], self.out.take(node[a:b], 0))
        z *= turn
        right = 1 / (1 + np.exp(np.clip(-z, -30, 30)))
        product, logs = np.ones(len(order)), np.empty(len(order))
        for n, a, b in steps:
            product[:n] *= right[a:b]
        logs[order] = np.log(product)
        return logs


def _rows_added(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, how often each, sums of their values), the most frequent rows first."""
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")  # 16 bits are sorted by digits
    found, values = rows.take(order), values.take(order, 0)
    starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    times = np.diff(np.concatenate((starts, [len(found)])))
    order = np.argsort((-np.minimum(times, _OFTEN + 1)).astype(np.int16), kind="stable")
    starts, times = starts.take(order), times.take(order)
    sums, ones = values.take(starts, 0), np.ones(len(rows), values.dtype)
    often = int((times > _OFTEN).sum())
    for k, (a, n) in enumerate(zip(starts[:often].tolist(), times[:often].tolist(), strict=True)):
        sums[k] = ones[:n] @ values[a : a + n]
    for k in range(1, _OFTEN):  # the k-th value of each of the others
        if (n := int((times > k).sum())) <= often:
            break
        sums[often:n] += values.take(starts[often:n] + k, 0)
    return found.take(starts), times, sums


class Trainer:
    """Steps of gradient descent from a network on; each weight's step shrinks with what it has moved (Adagrad)."""

    def __init__(self, start: Network, tree: Tree, rate: float = RATE):
        self.start, self.tree, self.rate = start, tree, rate
        self.net = self._side_by_side(Network(*(x.copy() for x in start)))
        self.seen = self._side_by_side(Network(*(np.full(x.shape, 1e-2, np.float32) for x in start)))
        self.blocks = Blocks.of(tree)
        #: How many tokens have moved each row of the parts before the tree, and how often each output was met.
        self.moved, self.met = Network(*(np.zeros(len(x), np.float32) for x in start)), np.zeros(len(tree.first), np.int64)

    @staticmethod
    def _side_by_side(net: Network) -> Network:
        """The same, where a node's weights and its bias are parts of one row."""
        both = np.concatenate((net.out, net.base), 1)
        return net._replace(out=both[:, :-1], base=both[:, -1:])

    def _move(self, part: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        whole = lambda x: x.view(f"V{x.itemsize * x.shape[1]}")[:, 0]  # noqa: E731  # a row is written at once
        squares = seen.take(rows, 0)
        squares += grad * grad
        whole(seen)[rows] = whole(squares)
        grad *= self.rate
        grad /= np.sqrt(squares, out=squares)
        new = part.take(rows, 0)
        new -= grad
        whole(part)[rows] = whole(new)

    def step(self, beside: np.ndarray, outputs: np.ndarray) -> None:
        net, seen, moved, blocks, n = self.net, self.seen, self.moved, self.blocks, len(outputs)
        nodes, seen_nodes = net.out.base, seen.out.base
        group = blocks.group.take(outputs)
        order = np.argsort(group.astype(np.int16), kind="stable")
        outputs, beside = outputs.take(order).astype(np.int64), beside.take(order, 0).ravel()
        x = net.embed.take(beside, 0).reshape(n, -1)
        own = np.ones((n, HIDDEN + 1), np.float32)  # the hidden units, and a one for the bias of each node
        h = np.tanh(x @ net.hidden + net.bias)
        own[:, :-1] = h

        # Turns at the nodes of blocks, by groups.
        last = np.cumsum(np.bincount(group, minlength=len(blocks.columns))).tolist()
        slices = [(k, a, b) for k, (a, b) in enumerate(zip([0, *last], last, strict=False)) if a < b]
        weights = nodes.take(blocks.columns, 0)
        signs = blocks.signs.take(outputs, 0).astype(np.float32)
        z = np.empty((n, _COLUMNS), np.float32)
        for k, a, b in slices:
            np.matmul(own[a:b], weights[k].T, out=z[a:b])
        z *= signs
        np.exp(np.minimum(z, 30, out=z), out=z)
        z += 1
        g = np.divide(signs, z, out=z)
        back = np.empty_like(own)  # with the sign of a step down, as g
        for k, a, b in slices:
            np.matmul(g[a:b], weights[k], out=back[a:b])
            np.matmul(g[a:b].T, own[a:b], out=weights[k])
        told = [k for k, _, _ in slices]
        rows, values = blocks.columns[told].ravel(), weights[told].reshape(-1, HIDDEN + 1)

        # The rest of the ways, turn by turn.
        length = blocks.rest.take(outputs)
        order = longest_first(length)[: np.count_nonzero(length)]
        steps, node, turn = self.tree.ways(outputs.take(order), length.take(order))
        if len(node):
            some, ways = own.take(order, 0), nodes.take(node, 0)
            z = np.empty(len(node), np.float32)
            for k, a, b in steps:
                np.einsum("ij,ij->i", some[:k], ways[a:b], out=z[a:b])
            g = (turn / (1 + np.exp(np.minimum(z * turn, 30))))[:, None]
            ways *= g
            more = back.take(order, 0)
            for k, a, b in steps:
                more[:k] += ways[a:b]
                np.multiply(some[:k], g[a:b], out=ways[a:b])  # from here on what each turn adds to its node's row
            back[order] = more
            rows, values = np.concatenate((rows, node)), np.concatenate((values, ways))

        dh = back[:, :-1] * (h * h - 1)
        dx = (dh @ net.hidden.T).reshape(-1, EMBED)
        self._move(net.hidden, seen.hidden, np.arange(len(net.hidden)), x.T @ dh)
        self._move(net.bias, seen.bias, np.arange(1), np.ones((1, n), np.float32) @ dh)
        moved.hidden[:] += n
        moved.bias[:] += n
        found, times, grad = _rows_added(beside, dx)
        self._move(net.embed, seen.embed, found, grad)
        moved.embed[found] += times
        found, _, grad = _rows_added(rows, values)
        self._move(nodes, seen_nodes, found, np.negative(grad, out=grad))
        self.met += np.bincount(outputs, minlength=len(self.met))

    def moves(self) -> Network:
        """How many tokens have moved each row: the weight of what has been learnt about it."""
        tree = self.tree
        passed = np.bincount(tree.nodes, np.repeat(self.met, tree.length), len(tree.bias)).astype(np.float32)
        return self.moved._replace(out=passed, base=passed)


class Model(NamedTuple):
    """What scores documents: the words, the spelling of others, the tree over outputs, and the network."""

    words: list[str]
    spelling: Spelling
    tree: Tree
    network: Network

    @property
    def edge(self) -> int:
        return len(self.words) + SUFFIXES

    @property
    def kind(self) -> type:
        """Of tokens' numbers."""
        return np.uint16 if self.edge < 1 << 16 else np.int32


class Reader:
    """Texts as numbers: a word's own, or of those that others share by their last letters; with their spellings' logs."""

    def __init__(self, words: list[str], spelling: Spelling | None = None):
        self.id, self.spelling, self.n = {w: k for k, w in enumerate(words)} | {"\n": _END}, spelling, len(words)
        self._clear()

    def _clear(self) -> None:
        self.row: defaultdict[str, int] = defaultdict(itertools.count().__next__)  # chunks are numbered as they are met
        self.shared: dict[str, int] = {}
        self.held = 0
        self.count, self.first, self.ids, self.spelt = array("i"), array("i"), array("i"), array("d")

    def _share(self, end: str) -> int:
        k = self.shared[end] = self.n + zlib.crc32(end.encode("utf-8", "surrogatepass")) % SUFFIXES
        return k

    def _add(self, chunks: list[str]) -> None:
        """The next chunks; no chunk has white space, so line ends stand between them."""
        words = _WORDS_AND_ENDS("\n".join([*chunks, ""]))
        ids = np.fromiter(map(self.id.get, words, itertools.repeat(_OTHER)), np.int32, len(words))
        others, ends = np.flatnonzero(ids == _OTHER), np.flatnonzero(ids == _END)
        strange = [words[k] for k in others.tolist()]
        ids[others] = [k if (k := self.shared.get(w[-2:])) is not None else self._share(w[-2:]) for w in strange]
        count = np.diff(ends, prepend=-1) - 1
        spelt = np.bincount(np.searchsorted(ends, others), self.spelling.log_probabilities(strange), len(chunks)) if self.spelling else np.zeros(len(chunks))
        self.first.frombytes((len(self.ids) + np.cumsum(count) - count).astype(np.int32).tobytes())
        self.count.frombytes(count.astype(np.int32).tobytes())
        self.ids.frombytes(ids[ids != _END].tobytes())
        self.spelt.frombytes(spelt.tobytes())
        self.held += sum(map(len, chunks))

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of all tokens, tokens of each text, sum of the spellings' logs of each text)"""
        if len(self.row) > _MOST or self.held > _MOST_BYTES:
            self._clear()
        split = [(t or "").lower().split() for t in texts]
        n, known = np.fromiter(map(len, split), np.int64, len(split)), len(self.row)
        rows = np.fromiter(map(self.row.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n.sum()))
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        new = itertools.islice(self.row, known, None)
        while some := list(itertools.islice(new, _BLOCK)):
            self._add(some)
        count, first, ids, spelt = np.frombuffer(self.count, np.int32)[rows].astype(np.int64), np.frombuffer(self.first, np.int32)[rows], np.frombuffer(self.ids, np.int32), np.frombuffer(self.spelt, np.float64)[rows]
        before = lambda x: np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))
        starts, last = before(count), np.cumsum(n)
        flat = ids[np.repeat(first - starts[:-1], count) + np.arange(starts[-1])].astype(np.int64)
        logs = before(spelt)
        return flat, starts[last] - starts[last - n], logs[last] - logs[last - n]


_NUMBERS = "doc_id bigint, ids binary, spelt double"


def _numbered(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _NUMBERS from (doc_id, text): the numbers of a text's tokens, and the sum of its spellings' logs."""
    reader = Reader(model.words, model.spelling)
    for batch in batches:
        for b in pieces(batch, _PIECE):
            flat, lengths, spelt = reader.of(b.column(1).to_pylist())
            flat, last = flat.astype(model.kind), np.cumsum(lengths)
            ids = [flat[at : at + n].tobytes() for at, n in zip((last - lengths).tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(spelt)], ["doc_id", "ids", "spelt"])


def numbered(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, ids, spelt) of each document, so that texts are split and spelt once for training and scoring."""
    sent = documents.sparkSession.sparkContext.broadcast(model._replace(tree=None, network=None))
    return _texts(documents).mapInArrow(tidied(lambda batches: _numbered(sent.value, batches)), _NUMBERS)


def _texts(documents: DataFrame) -> DataFrame:
    return lean(documents).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def _beside(ids: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens with edges around each text, where the tokens are in it, and how many each text has."""
    texts = ids.to_pylist()
    flat, reach = np.frombuffer(b"".join(texts), model.kind), max(map(abs, WINDOW))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) // flat.itemsize
    place = np.arange(len(flat)) + reach * (1 + np.repeat(np.arange(len(lengths)), lengths))
    wide = np.full(len(flat) + reach * (len(lengths) + 1), model.edge, model.kind)
    wide[place] = flat
    return wide, place, lengths


def _summed(batches: Iterator[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    total: dict[str, np.ndarray] = {}
    weight: dict[str, np.ndarray] = {}
    for b in batches:
        for name, first, width, n, change in zip(*(b.column(c).to_pylist() for c in ("name", "first", "width", "n", "change")), strict=True):
            w = np.frombuffer(n, np.float32).astype(np.float64)
            d = np.frombuffer(change, np.float32).reshape(len(w), width)
            key = f"{name} {first}"
            total[key] = total.get(key, 0) + d
            weight[key] = weight.get(key, 0) + w
    return total, weight


_DELTA = "salt int, part int, name string, first int, width int, n binary, change binary"


def _delta(salt: int, parts: list[tuple[int, str, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of _DELTA: blocks of rows with how many tokens moved each (n), and n times its change."""
    cols = [[salt] * len(parts), [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], [p[4].shape[1] for p in parts], [p[3].astype(np.float32).tobytes() for p in parts], [p[4].astype(np.float32).tobytes() for p in parts]]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["salt", "part", "name", "first", "width", "n", "change"])


def _add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = _summed(batches)
    part = key[-1].as_py()
    yield _delta(0, [(part, k.split()[0], int(k.split()[1]), weight[k], total[k]) for k in sorted(total)])


_add_up.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def train_round(numbers: DataFrame, model: Model, number: int, *, every: int = EVERY, rate: float = RATE) -> Network:
    """The network after a round over numbered documents: each task learns from its own, and what they learnt is averaged.

    Every so-manieth token of every document is predicted, by default all. A row's new weights are the mean of the tasks', each
    counting as often as its tokens moved the row; so what one task alone has seen isn't thinned out. Each task
    tells the rows it moved; sums are made in two steps, by groups of about the root of the number of tasks.
    """
    sent = numbers.sparkSession.sparkContext.broadcast(model)
    groups = max(1, math.isqrt(numbers._jdf.rdd().getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = sent.value
        start, trainer, at = model.network, Trainer(model.network, model.tree, rate), TaskContext.get().partitionId()
        rng, offsets = np.random.default_rng((number, at)), np.array(WINDOW)
        for batch in batches:
            for b in pieces(batch, _IDS):
                wide, place, _ = _beside(b.column(0), model)
                chosen = rng.permutation(place[(number + int(rng.integers(every))) % every :: every])
                for k in range(0, len(chosen), STEP):
                    some = chosen[k : k + STEP]
                    trainer.step(wide.take(some[:, None] + offsets), np.minimum(wide.take(some), len(model.words)))
        parts = []
        for name, old, new, moved in zip(Network._fields, start, trainer.net, trainer.moves(), strict=True):
            size = max(1, -(-len(old) // _PARTS))
            for part, first in enumerate(range(0, len(old), size)):
                n = moved[first : first + size]
                if n.any():
                    parts.append((part, name, first, n, (new[first : first + size] - old[first : first + size]) * n[:, None]))
        if parts:
            yield _delta(at % groups, parts)

    if not len(model.network.out):
        return model.network
    told = lean(numbers).select("ids").mapInArrow(tidied(run), _DELTA)
    out = Network(*(x.copy() for x in model.network))
    for r in told.groupBy("salt", "part").applyInArrow(_add_up, _DELTA).groupBy("part").applyInArrow(_add_up, _DELTA).collect():  # the size of the network
        n = np.frombuffer(r.n, np.float32)
        change = np.frombuffer(r.change, np.float32).reshape(len(n), r.width)
        getattr(out, r.name)[r.first : r.first + len(n)] += change / np.maximum(n, 1)[:, None]
    return out


def by_counts(documents: DataFrame, most: int = MAX_WORDS) -> Model:
    """The model before its first round.

    Counts of all words of all documents give the words with an own output, the spelling of the others, and the
    tree over the outputs; the network starts as these counts.
    """
    counts = Saved(word_counts(documents), "lm-words")
    top = frequent(counts.df, most)
    spelt = spelling(counts.df, {w for w, _ in top})
    total = counts.df.agg(F.sum("n")).first()[0] or 0
    counts.drop()
    words = [w for w, _ in top]
    tree = Tree.of([*(n for _, n in top), total - sum(n for _, n in top)])
    return Model(words, spelt, tree, Network.start(len(words) + SUFFIXES + 1, tree))


def trained(numbers: DataFrame, model: Model, *, rounds: int = ROUNDS, every: int = EVERY, rate: float = RATE) -> Model:
    """The model after its rounds over all numbered documents."""
    for number in range(rounds):
        model = model._replace(network=train_round(numbers, model, number, every=every, rate=rate))
    return model


def fit(documents: DataFrame, *, most: int = MAX_WORDS, rounds: int = ROUNDS, every: int = EVERY, rate: float = RATE) -> Model:
    """The model of all documents: by_counts, and trained on all of them."""
    model = by_counts(documents, most)
    if not rounds:
        return model
    numbers = Saved(numbered(documents, model), "lm-numbers")
    model = trained(numbers.df, model, rounds=rounds, every=every, rate=rate)
    numbers.drop()
    return model


_SCORES = "doc_id bigint, n_tokens bigint, log_likelihood double, per_token double"


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _SCORES from rows of _NUMBERS."""
    offsets, tables = np.array(WINDOW), model.network.tables()
    for batch in batches:
        for b in pieces(batch, _IDS):
            wide, place, lengths = _beside(b.column(1), model)
            logs = np.zeros(len(place) + 1)
            for k in range(0, len(place), _BLOCK):
                some = place[k : k + _BLOCK]
                logs[k + 1 : k + 1 + len(some)] = model.network.log_probabilities(model.tree, wide.take(some[:, None] + offsets), np.minimum(wide.take(some), len(model.words)), tables)
            sums, last = np.cumsum(logs), np.cumsum(lengths)
            total = sums[last] - sums[last - lengths] + b.column(2).to_numpy()
            total[lengths == 0] = 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(total), pa.array(total / np.maximum(lengths, 1))], ["doc_id", "n_tokens", "log_likelihood", "per_token"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) of each document.

    log_likelihood is the sum over all tokens of the whole text of log P(token | the two tokens on either side);
    per_token divides it by the tokens. A word without an own output has the probability of the output for others
    times that of its spelling. Null and empty texts: 0 tokens, 0.0 and 0.0. Very long texts count whole, null ids
    stay null, repeated rows are scored each, empty tables give no rows, other columns are not read. The model,
    at most MAX_WORDS rows of a fixed width, is broadcast.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return _texts(documents).mapInArrow(tidied(lambda batches: _scored(sent.value, _numbered(sent.value, batches))), _SCORES)


def fit_and_score(documents: DataFrame) -> DataFrame:
    """score(documents, fit(documents)), for which texts are numbered once: their numbers stay in the shared folder."""
    model = by_counts(documents)
    numbers = Saved(numbered(documents, model), "lm-numbers").df
    sent = documents.sparkSession.sparkContext.broadcast(trained(numbers, model))
    return lean(numbers).mapInArrow(tidied(lambda batches: _scored(sent.value, batches)), _SCORES)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_score(table(spark, sf_dir, "documents"))
