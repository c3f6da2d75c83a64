"""Language-model scoring by logistic context mixing.

A text is its words, lower-cased (A-Z), and one end. A token is coded in binary decisions:

  again    Has the present pair of words (or else the present word) been followed by a word before, in this text?
           If so, one decision tells whether the same word follows. Its probability is that of the state: the order
           of the guess, whether the last two guesses in this context held, and whether the last two tokens' did.
  class    Otherwise up to DEPTH decisions lead down a tree of classes, whose leaves are the `head` most frequent
           words, the end and an escape, in an order that puts words of like documents together and splits them by
           weight. Each bit is predicted in four hashed contexts: the last word; the last two; the one before the
           last (a skip); the last very frequent word with the last word's class.
  word     Decisions lead on within the class, which is parted likewise until a word is alone. Each bit is predicted in the
           same four contexts and by the words' weights.
  rare     After an escape one decision tells whether the word is known to the training documents, however rare.
           A known word is its share of all such words, by its exact count, which it meets in a join.
  letters  An unknown word is the Huffman code of its bytes and of a closing byte; each bit is predicted in hashed
           contexts: the last one, two and three bytes, and the whole prefix.

Predictions are counts of zeros and ones in tables hashed by context. They are mixed in the logistic domain by
weights that a gate selects from the depth and from how often the longer contexts were seen; an adaptive probability
map by the same gate refines the outcome. Along a document the outcome is refined again: at each depth it is shifted,
in the logistic domain, by what the document's earlier bits have differed from their predictions.

Training. Spark counts the words of all training documents. A second pass over all of them learns online: each task
predicts a block of tokens by its own tables, weights and maps so far, moves the weights and maps by the error, then
adds the block's bits to the tables. What tasks have learned adds up: tables and maps as counts, weights in proportion
to the bits seen at a gate; they send it in stripes, which Spark sums in two steps. Letters are learned likewise from
all distinct rare words. The tables' slots grow with the distinct words, up to MOST_SLOTS; the counts of words
without bound.

Scoring. The model is frozen to one byte a slot and broadcast; its size is bounded by head and MOST_SLOTS. Words beyond
the head leave the texts and are joined to their counts.
"""

from __future__ import annotations

import functools
import heapq
import math
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fold, released, stored, text_rows

END = b"\n"
#: Numbers in one stripe of a table.
STRIPE = 1 << 16
MOST_SLOTS = 1 << 20
LETTER_SLOTS = 1 << 20
FREQUENT = 64
AGAIN = 2 * 4 * 4
DEPTH = 6
CLASSES = 1 << DEPTH
GROUPS = 16
LIMIT = 12.0
MAP_STEPS = 33
#: How often a context was seen: never, once, up to 3, 7, 15, more.
LEVELS = 6
#: Tokens of a block; bits of what a document has shown count against so many of no difference.
BLOCK = 16_384
CALM = 12.0
#: The contexts of decisions within a class: all four.
INNER = (0, 1, 2, 3)
INNER_POSITIONS = 8
#: Predictions are whole tenths of the logistic domain.
TENTH = np.float32(0.1)
GOLDEN = np.uint32(0x9E3779B1)
#: Slots that are made anew at once; what FEW zeros and ones give is made once.
STEP = 1 << 14
FEW_BITS = 6
FEW = 1 << FEW_BITS


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of each word in order, and how many words each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py() if len(texts) else np.zeros(1, np.int64)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), np.diff(np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][offsets])


def parts_of(batch: pa.RecordBatch, most: int = 1_500_000) -> Iterator[pa.Array]:
    """The texts of a batch (null: empty) in slices of about `most` bytes; a longer text is a slice by itself."""
    texts = pc.fill_null(column(batch, "text"), "")
    total = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right"))
        yield texts.slice(begin, max(end, begin + 1) - begin)
        begin = max(end, begin + 1)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 31-bit hash of each of these words (none is empty): its bytes times numbers by their places, added up."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint32)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begins = offsets[:-1] - offsets[0]
    at = np.arange(len(data)) - np.repeat(begins, np.diff(offsets))
    total = np.add.reduceat((data.astype(np.uint32) + np.uint32(1)) * (spread(at, 29) | np.uint32(1)), begins, dtype=np.uint32)
    return spread(total, 31) >> np.uint32(1)


def spread(x: np.ndarray, salt: int) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers."""
    x = (x.astype(np.uint32) ^ np.uint32(salt)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return x * np.uint32(0x85EBCA6B)


class Code:
    """A Huffman code over leaves 0..n-1: for each leaf the inner nodes on its path and the bits taken there."""

    def __init__(self, weights: list[int]):
        n = len(weights)
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        up, bit = [0] * (2 * n - 1), np.zeros(2 * n - 1, np.uint8)
        for made in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x] = up[y] = made
            bit[y] = 1
            heapq.heappush(heap, (a + b, made))
        nodes: list[int] = []
        bits: list[int] = []
        self.sizes = np.zeros(n, np.int64)
        for leaf in range(n):
            at, path = leaf, []
            while at != 2 * n - 2:
                path.append((up[at] - n, bit[at]))
                at = up[at]
            self.sizes[leaf] = len(path)
            for node, b in reversed(path):
                nodes.append(node)
                bits.append(b)
        self.nodes, self.bits = np.array(nodes, np.int64), np.array(bits, np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def paths(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, bits, place in leaves) of all decisions."""
        sizes = self.sizes[leaves]
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(leaves)), sizes)
        at = np.arange(len(of)) + (self.starts[leaves] - ends + sizes).take(of)
        return self.nodes.take(at), self.bits.take(at), of


def squash(x):
    return 1 / (1 + np.exp(-x))


def of_bits(p: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The probability of each of these bits, where p is that of a one. Without a branch, which bits would make slow."""
    return np.abs(1 - bits - p)


class Mixer:
    """Predictors of one kind of bit: counts of zeros and ones [contexts, slots, 2], their stretched
    quotients in tenths and levels by slot; weights and map by gate. A gate is a position (the depth of a bit) and the levels
    of the two contexts in `watched`. `known` predictions more, stretched, come with the bits."""

    def __init__(self, contexts: int, slots: int, positions: int, watched: tuple[int, int], known: int = 0):
        self.contexts, self.slots, self.positions, self.watched = contexts, slots, positions, watched
        self.shift = np.uint32(32 - (slots.bit_length() - 1))
        self.gates = positions * LEVELS * LEVELS
        self.weights = np.full((self.contexts + known + 1, self.gates), 0.3, np.float32)
        self.weights[self.contexts :], self.weights[-1] = 1, 0
        self.map_ = np.tile(squash(np.linspace(-LIMIT, LIMIT, MAP_STEPS)), (self.gates, 1)).astype(np.float32)
        self.seen = np.zeros(self.gates)
        self.met, self.ones = (np.zeros((self.gates, MAP_STEPS)) for _ in range(2))
        self.table: np.ndarray | None = None
        # by context: of a slot the stretched quotient; in watched ones its level before it, in one number, read at once
        self.read: list[np.ndarray] = []
        self.new: list[list[np.ndarray]] = []
        self.counted, self.refreshed = 0, 0

    def opened(self) -> Mixer:
        """With empty tables, to learn."""
        self.table = np.zeros((self.contexts, self.slots * 2), np.uint32)
        self.read = self.unread()
        self.new = [[] for _ in range(self.contexts)]
        low, high = np.arange(FEW * FEW, dtype=np.float32) % FEW, np.arange(FEW * FEW) // FEW
        zeros, ones = (low, high.astype(np.float32)) if sys.byteorder == "little" else (high.astype(np.float32), low)
        self.few = self.tenths(zeros, ones), self.level(zeros + ones)
        return self

    def unread(self) -> list[np.ndarray]:
        return [np.zeros(self.slots, np.uint16 if k in self.watched else np.int8) for k in range(self.contexts)]

    @property
    def frozen(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Stretched quotients in tenths by context, levels by watched context: what `read` has."""
        return [x.view(np.int8)[x.itemsize - 1 :: x.itemsize] for x in self.read], [self.read[k].view(np.uint8)[::2] for k in self.watched]

    @staticmethod
    def tenths(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        stretched = np.clip(np.log((ones + np.float32(0.1)) / (zeros + np.float32(0.1))), -LIMIT, LIMIT)
        return np.rint(stretched / TENTH).astype(np.int8)

    @staticmethod
    def level(seen: np.ndarray) -> np.ndarray:
        return reduce(np.add, ((seen >= np.float32(1 << k)).view(np.uint8) for k in range(LEVELS - 1)))

    def inputs(self, hashes: Iterable[np.ndarray], gate: np.ndarray, ones: np.ndarray | None = None) -> list[np.ndarray]:
        """Stretched predictions by context, of bits with these hashes by context, which are spent. To gate, where
        the position is, the levels are added. With ones (0 or 1 a bit) given, the bits wait for count()."""
        found = []
        for k, slot in enumerate(hashes):
            slot >>= self.shift
            at = slot.astype(np.intp)
            read = self.read[k].take(at)
            found.append(read.view(np.int8)[read.itemsize - 1 :: read.itemsize] * TENTH)
            for j, scale in enumerate((1, LEVELS)):
                if self.watched[j] == k:
                    gate += read.view(np.uint8)[::2] * np.uint8(scale)
            if ones is not None:
                slot <<= np.uint32(1)
                slot += ones
                self.new[k].append(slot.view(np.int32))
        return found

    def mixed(self, found: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        dot = self.weights[-1].take(gate)
        for k, x in enumerate(found):
            own = self.weights[k].take(gate)
            own *= x
            dot += own
        return np.clip(dot, -LIMIT, LIMIT, out=dot)

    def probability(self, dot: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one: half the mixer's, half the map's, between its nearest two entries."""
        place = (dot + np.float32(LIMIT)) * np.float32((MAP_STEPS - 1) / (2 * LIMIT))
        low = np.minimum(place.astype(np.int64), MAP_STEPS - 2)
        share = place - low.astype(np.float32)
        flat, at = self.map_.ravel(), gate * MAP_STEPS + low
        mapped = flat.take(at) * (1 - share) + flat.take(at + 1) * share
        return np.clip(np.float32(0.5) * (mapped + squash(dot)), np.float32(1e-5), np.float32(1 - 1e-5))

    def learn(self, hashes: np.ndarray, positions: np.ndarray, bits: np.ndarray) -> None:
        """Online: the block is predicted by what was learned before and moves weights and map by its error; its bits
        wait for count()."""
        if len(bits):
            gate = positions * (LEVELS * LEVELS)
            self.moved(self.inputs((h.copy() for h in hashes), gate, bits.astype(np.uint32)), gate, bits)

    def moved(self, found: list[np.ndarray], gate: np.ndarray, bits: np.ndarray, rate: float = 0.02) -> None:
        """Weights and map, by the error of a block's bits with these stretched predictions and gates."""
        if not len(bits):
            return
        dot = self.mixed(found, gate)
        wrong = bits - squash(dot)
        dot += np.float32(LIMIT)
        dot *= np.float32((MAP_STEPS - 1) / (2 * LIMIT))
        spot = np.rint(dot, out=dot).astype(np.intp)
        spot += gate * MAP_STEPS
        spot += spot
        spot += bits.astype(np.uint8)
        both = np.bincount(spot, minlength=2 * self.met.size).reshape(*self.met.shape, 2)
        seen = both.sum(axis=(1, 2))
        # a gate's steps do not grow without end with what many bits say alike
        by = rate / np.maximum(np.sqrt(np.maximum(seen, 1)), seen / 50)
        slope = np.empty(len(bits))
        for k, x in enumerate([*found, np.float32(1)]):
            np.multiply(wrong, x, out=slope)
            self.weights[k] += (by * np.bincount(gate, slope, self.gates)).astype(np.float32)
        self.seen += seen
        self.met += both.sum(axis=2)
        self.ones += both[:, :, 1]
        self.counted += len(bits)

    def count(self) -> None:
        """Adds the bits that wait to the tables, one table after the other. Predictions are made anew from these when they
        have grown by a fifth."""
        for table, new in zip(self.table, self.new):
            for at in new:
                np.add.at(table, at, np.uint32(1))
            new.clear()
        if self.counted > 1.2 * self.refreshed:
            self.refreshed, (all_tenths, all_levels) = self.counted, self.frozen
            for k, table in enumerate(self.table):
                both = table.view(np.uint64)
                for begin in range(0, self.slots, STEP):
                    own = slice(begin, begin + STEP)
                    # zeros in the lower half of a number and ones in the upper, or the other way round
                    pair = both[own]
                    at = ((pair | pair >> np.uint64(32 - FEW_BITS)) & np.uint64(FEW * FEW - 1)).view(np.int64)
                    many = np.flatnonzero((pair & np.uint64((1 << 32 | 1) * (2**32 - FEW))) != 0)
                    zeros, ones = table[2 * begin : 2 * (begin + STEP)].reshape(-1, 2).take(many, axis=0).T.astype(np.float32)
                    tenths = self.few[0].take(at)
                    tenths[many] = self.tenths(zeros, ones)
                    all_tenths[k][own] = tenths
                    if k in self.watched:
                        levels = self.few[1].take(at)
                        levels[many] = LEVELS - 1
                        all_levels[self.watched.index(k)][own] = levels

    def told(self) -> np.ndarray:
        """What a task has learned beside its tables, as numbers that add up over tasks."""
        return np.concatenate([self.seen, self.met.ravel(), self.ones.ravel(), (self.weights * self.seen).ravel()])

    @property
    def size(self) -> int:
        return self.gates * (1 + 2 * MAP_STEPS + len(self.weights))

    def take(self, total: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> None:
        """Of the added numbers of all tasks: the mean of the weights by the bits seen at each gate; the map's entries are
        shares of ones, where the first ones weigh 100 bits. tables: stretched quotients in tenths and levels by slot."""
        cuts = np.cumsum([self.gates, self.gates * MAP_STEPS, self.gates * MAP_STEPS])
        self.seen, met, ones, weights = np.split(total[: self.size].astype(np.float64), cuts)
        mean = weights.reshape(-1, self.gates) / np.maximum(self.seen, 1)
        self.weights = np.where(self.seen > 0, mean, self.weights).astype(np.float32)
        self.map_ = ((100 * self.map_ + ones.reshape(self.map_.shape)) / (100 + met.reshape(self.map_.shape))).astype(np.float32)
        self.met = self.ones = None
        self.read = self.unread()
        for k, own in enumerate(self.frozen[0]):
            own[:] = tables[0].reshape(self.contexts, -1)[k]
        for k, own in zip(self.watched, self.frozen[1]):
            own[:] = tables[1].reshape(self.contexts, -1)[k]


@dataclass
class Ways:
    """Decisions of ways laid end to end: how many there are on each way, where it starts; of each decision the mark that it
    adds to a hash, its bit as a float and its prior, side by side in 16 bytes."""

    sizes: np.ndarray
    starts: np.ndarray
    decisions: np.ndarray

    @staticmethod
    def of(sizes: np.ndarray, marks: np.ndarray, bits: np.ndarray, prior: np.ndarray) -> Ways:
        decisions = np.zeros((len(marks), 4), np.uint32)
        decisions[:, 0], decisions[:, 1], decisions[:, 2] = marks, bits.astype(np.float32).view(np.uint32), prior.astype(np.float32).view(np.uint32)
        return Ways(sizes.astype(np.uint8), np.cumsum(sizes) - sizes, decisions)

    def along(self, ways: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]:
        """(order, counts, marks, bits, priors): the order of ways from the longest on; all first decisions, all second ones
        and so on, in this order, so that `counts` many ways, the first ones, have a first decision, a second and so on."""
        sizes = self.sizes.take(ways)
        order = np.argsort(~sizes, kind="stable")
        starts = self.starts.take(ways.take(order))
        least = np.cumsum(np.bincount(sizes)[::-1])[::-1]
        counts = least[1:].tolist()
        found = self.decisions.take(firsts(starts, counts) + np.repeat(np.arange(len(counts)), counts), axis=0)
        return order, counts, found[:, 0].copy(), found[:, 1].copy().view(np.float32), found[:, 2].copy().view(np.float32)


def firsts(x: np.ndarray, counts: list[int]) -> np.ndarray:
    """The first so many of x, one after the other."""
    return np.concatenate([x[:n] for n in counts]) if counts else x[:0]


class Tree:
    """Classes of leaves 0..n-1, which stand in order: by halves of their weight, DEPTH times or until one is left; where
    few are left, so that each has a class of its own. Nodes are numbered as in a heap, from 1; nodes[class] is its path,
    0 where it has ended, bits[class] its turns.

    The leaves of a class are parted likewise until each is alone. The nodes of all classes are numbered on; of each,
    place is its number in its class, the upper ones first, and prior the log of the odds of a one by the weights."""

    def __init__(self, weights: np.ndarray, order: np.ndarray):
        total = np.r_[0, np.cumsum(weights[order].astype(np.float64))]
        self.of = np.zeros(len(order), np.int64)
        paths: list[list[tuple[int, int]]] = []
        spans: list[tuple[int, int]] = []

        def half(low: int, high: int) -> int:
            cut = int(np.searchsorted(total, (total[low] + total[high]) / 2))
            if cut > low + 1 and total[cut] + total[cut - 1] > total[low] + total[high]:
                cut -= 1
            return min(max(cut, low + 1), high - 1)

        waiting = [(0, len(order), 1, [])]
        while waiting:
            low, high, node, path = waiting.pop()
            if high - low == 1 or len(path) == DEPTH:
                self.of[order[low:high]] = len(paths)
                paths.append(path)
                spans.append((low, high))
                continue
            cut, room = half(low, high), 1 << DEPTH - len(path) - 1
            if high - low <= 2 * room:
                cut = min(max(cut, high - room), low + room)
            waiting += [(cut, high, 2 * node + 1, [*path, (node, 1)]), (low, cut, 2 * node, [*path, (node, 0)])]
        self.nodes, self.bits = np.zeros((len(paths), DEPTH), np.uint32), np.zeros((len(paths), DEPTH), np.float32)
        for k, path in enumerate(paths):
            for d, (node, bit) in enumerate(path):
                self.nodes[k, d], self.bits[k, d] = node, bit
        place, prior, turns = [], [], [()] * len(order)
        for span in spans:
            first, queue = len(place), [(*span, ())]
            for low, high, path in queue:
                if high - low == 1:
                    turns[order[low]] = path
                    continue
                cut, own = half(low, high), 2 * len(place)
                place.append(len(place) - first)
                prior.append(math.log((total[high] - total[cut]) / (total[cut] - total[low])))
                queue += [(low, cut, (*path, own)), (cut, high, (*path, own + 1))]
        self.place, self.prior = np.array(place, np.uint32), np.array(prior, np.float32)
        self.sizes = np.fromiter(map(len, turns), np.int64, len(turns))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.turns = np.fromiter((x for path in turns for x in path), np.int32, self.sizes.sum())
        # of a leaf in its class by weight alone: what the priors on its way give together
        self.share = np.log10(weights / np.bincount(self.of, weights)[self.of])

    @functools.cached_property
    def ways(self) -> Ways:
        """To the classes."""
        real = self.nodes > 0
        return Ways.of(real.sum(axis=1), spread(self.nodes[real], 23) * GOLDEN, self.bits[real], np.zeros(real.sum()))

    @functools.cached_property
    def inner_ways(self) -> Ways:
        """From the classes to the leaves; marks are the places."""
        nodes = self.turns >> 1
        return Ways.of(self.sizes, self.place.take(nodes), self.turns & 1, self.prior.take(nodes))

    def inside(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, bits, depths, place in leaves) of all decisions within the classes of these leaves."""
        sizes = self.sizes[leaves]
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(leaves)), sizes)
        depth = np.arange(len(of)) - (ends - sizes).take(of)
        turns = self.turns.take(self.starts[leaves].take(of) + depth)
        return turns >> 1, (turns & 1).astype(np.float32), depth, of


@dataclass
class Lexicon:
    """The most frequent words with their counts (leaf 0: the escape, leaf 1: the end, leaf 2: the first word), their
    classes, and the code of letters. rare, once: tokens of all other words in training, and how many of these words came once."""

    words: pa.Array
    counts: np.ndarray
    tree: Tree
    letters: Code
    total: int
    distinct: int
    rare: int = 0
    once: int = 0

    def leaves(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), -2).to_numpy().astype(np.int64) + 2

    def unknown(self) -> float:
        """The share of unknown words among rare ones: that of the words met once, as each was unknown when it came."""
        return (self.once + 0.5) / (self.rare + 1)

    def letter_bits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes [4, n], positions, bits, word) of the bits of the bytes and the closing byte of these words."""
        flat, of, contexts = self._letters(words)
        nodes, bits, at = self.letters.paths(flat.astype(np.int64))
        nodes = spread(np.arange(256), 77).take(nodes)
        return np.stack([spread(c, 101 + k).take(at) + nodes for k, c in enumerate(contexts)]) * np.uint32(0x9E3779B1), np.zeros(len(bits), np.int64), bits.astype(np.float32), of[at]

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """All bytes with a closing one a word, the word of each, and their four contexts: 32-bit numbers."""
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)[: sizes.sum()].astype(np.uint32)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        past = []
        for back in range(3):
            own = np.zeros(len(flat), np.uint32)
            own[back + 1 :] = flat[: -back - 1] + np.uint32(1)
            own[at <= back] = 0
            past.append(own)
        prefix, places = np.zeros(len(flat), np.uint32), np.argsort(at, kind="stable")
        for rows in np.split(places, np.cumsum(np.bincount(at))[:-1])[1:] if len(flat) else []:
            prefix[rows] = (prefix[rows - 1] ^ (flat[rows - 1] + np.uint32(1))) * np.uint32(0x9E3779B1)
            prefix[rows] ^= prefix[rows] >> np.uint32(15)
        shift = np.uint32(9)
        return flat, np.repeat(np.arange(len(words)), sizes), [past[0], past[0] << shift | past[1], (past[0] << shift | past[1]) << shift | past[2], prefix]


@dataclass
class Tokens:
    """The tokens of some texts laid end to end: distinct words (the last: the end), each token's number, text, leaf and
    hashes of the four contexts of its class."""

    words: pa.Array
    number: np.ndarray
    text: np.ndarray
    leaf: np.ndarray
    contexts: list[np.ndarray]


def tokens_of(texts: pa.Array, lexicon: Lexicon) -> Tokens:
    words, plain, sizes = coded_words(texts)
    sizes = sizes + 1
    number = np.full(sizes.sum(), len(words))
    ends = np.zeros(len(number), bool)
    ends[np.cumsum(sizes) - 1] = True
    number[~ends] = plain
    text = np.repeat(np.arange(len(texts)), sizes)
    leaves = np.append(lexicon.leaves(words), 1)
    leaf = leaves[number]
    own = leaves.astype(np.uint32)
    rare = leaves[:-1] == 0
    own[:-1][rare] = word_hashes(words.filter(pa.array(rare))) | np.uint32(1 << 31)
    words = pa.concat_arrays([words, pa.array([END], pa.binary())])
    # the last token's word and class and the word before it, 0 where there is none in the text
    begins = np.cumsum(sizes) - sizes
    one, two, last = np.zeros(len(number), np.uint32), np.zeros(len(number), np.uint32), np.zeros(len(number), np.uint32)
    hashed = (own + np.uint32(1))[number]
    one[1:], two[2:], last[1:] = hashed[:-1], hashed[:-2], (lexicon.tree.of[leaf[:-1]] + 1).astype(np.uint32)
    one[begins], two[begins], last[begins] = 0, 0, 0
    two[begins[sizes > 1] + 1] = 0
    # the last token before this one, in its text, that is one of the most frequent words
    at = np.arange(len(number))
    before = np.maximum.accumulate(np.where((leaf > 1) & (leaf < FREQUENT), at, -1))
    before = np.r_[-1, before][:-1]
    kind = np.where(before >= np.repeat(begins, sizes), leaf[before], 0).astype(np.uint32)
    x, y = spread(one, 11), spread(two, 13)
    return Tokens(words, number, text, leaf, [x, spread(x ^ y >> np.uint32(1), 17), y, spread(kind * np.uint32(2 * CLASSES) + last, 19)])


def alike(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the places by two numbers each and then by place, and where in it a place has its forerunner's
    numbers. Both numbers and the place are sorted as one 64-bit number if they fit."""
    n = len(first)
    low, mid, high = n.bit_length(), int(second.max(initial=0)).bit_length(), int(first.max(initial=0)).bit_length()
    if low + mid + high < 64:
        key = np.sort((first << mid | second) << low | np.arange(n))
        order = key & (1 << low) - 1
        key >>= low
        return order, np.r_[False, key[1:] == key[:-1]][:n]
    order = np.lexsort((second, first))
    return order, np.r_[False, (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])][:n]


def again(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """For each token the state of its guess, -1 for none, and whether the guess held."""
    n = len(tokens.number)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    number, text = tokens.number, tokens.text
    first = np.r_[True, text[1:] != text[:-1]]
    one = np.where(first, len(tokens.words), np.r_[0, number[:-1]])
    second = first | np.r_[True, first[:-1]]
    two = np.where(second, len(tokens.words), np.r_[0, 0, number[:-2]][:n])
    guessed, group, key = [], text, one
    for order in (0, 1):
        place, same = alike(group, key)
        before, again_ = np.full(n, -1), np.flatnonzero(same)
        before[place.take(again_)] = place.take(again_ - 1)
        # where there is none before, the last place is read and not used
        has, older = before >= 0, before.take(before)
        held = (number == number.take(before)) & has
        sure = (held.take(before) & has).view(np.uint8)
        sure += (held.take(older) & has & (older >= 0)).view(np.uint8) * np.uint8(2)
        guessed.append((has, held, sure))
        if not order:
            group, key = np.empty(n, np.int64), two
            group[place] = np.cumsum(~same)
    use = guessed[1][0]
    has, held, sure = (np.where(use, second, first) for first, second in zip(*guessed))
    state = use * np.uint8(16) + sure * np.uint8(4)
    state[1:] += (held[:-1] & ~first[1:]).view(np.uint8)
    state[2:] += (held[:-2] & ~second[2:]).view(np.uint8) * np.uint8(2)
    return np.where(has, state.astype(np.int64), -1), held


@dataclass
class Block:
    """Decisions of tokens that follow each other, as Ways.along has them: the tokens' rows; the order and counts; of each
    decision its bit, stretched predictions and gate."""

    rows: np.ndarray
    order: np.ndarray
    counts: list[int]
    bits: np.ndarray
    found: list[np.ndarray]
    gate: np.ndarray


def class_blocks(mixer: Mixer, tokens: Tokens, rows: np.ndarray, tree: Tree, counted: bool = False) -> Iterator[Block]:
    """The class decisions of these tokens, block by block. counted: the bits wait for the mixer's count()."""
    for begin in range(0, len(rows), BLOCK):
        part = rows[begin : begin + BLOCK]
        order, counts, marks, bits, _ = tree.ways.along(tree.of.take(tokens.leaf.take(part)))
        gate = np.repeat(np.arange(len(counts)) * (LEVELS * LEVELS), counts)
        own = part.take(order)
        hashes = (firsts(c.take(own) * GOLDEN, counts) + marks for c in tokens.contexts)
        yield Block(part, order, counts, bits, mixer.inputs(hashes, gate, bits.astype(np.uint32) if counted else None), gate)


def inner_blocks(mixer: Mixer, tokens: Tokens, rows: np.ndarray, tree: Tree, counted: bool = False) -> Iterator[Block]:
    """The decisions within these tokens' classes, likewise. In a context a class has slots side by side, so that its upper
    nodes are near in memory."""
    aside, classes = np.uint32(33 - mixer.slots.bit_length()), spread(np.arange(CLASSES), 31)
    for begin in range(0, len(rows), BLOCK):
        part = rows[begin : begin + BLOCK]
        order, counts, marks, bits, prior = tree.inner_ways.along(tokens.leaf.take(part))
        gate = np.repeat(np.minimum(np.arange(len(counts)), INNER_POSITIONS - 1) * (LEVELS * LEVELS), counts)
        marks <<= aside
        own = part.take(order)
        of = classes.take(tree.of.take(tokens.leaf.take(own)))
        hashes = (firsts((tokens.contexts[k].take(own) ^ of) * GOLDEN, counts) + marks for k in INNER)
        yield Block(part, order, counts, bits, [*mixer.inputs(hashes, gate, bits.astype(np.uint32) if counted else None), prior], gate)


@dataclass
class Model:
    lexicon: Lexicon
    words: Mixer
    letters: Mixer
    again: np.ndarray
    inner: Mixer

    def letter_costs(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each of these words' letters."""
        found = [np.zeros(0)]
        for k in range(0, len(words), 5000):
            part = words[k : k + 5000]
            hashes, positions, bits, of = self.lexicon.letter_bits(part)
            gate = positions * (LEVELS * LEVELS)
            p = self.letters.probability(self.letters.mixed(self.letters.inputs(hashes, gate), gate), gate)
            found.append(np.bincount(of, np.log10(of_bits(p, bits)), len(part)))
        return np.concatenate(found)

    def class_costs(self, tokens: Tokens, rows: np.ndarray) -> np.ndarray:
        """log10 of the probability of the classes of these tokens, which follow each other. In each text the bits so far
        shift those that come; between blocks the text that goes on keeps its sums."""
        found = [np.zeros(0)]
        kept, text_kept = np.zeros((2, DEPTH), np.float32), -1
        for block in class_blocks(self.words, tokens, rows, self.lexicon.tree):
            p = self.words.probability(self.words.mixed(block.found, block.gate), block.gate)
            n, counts, ends = len(block.rows), block.counts, np.cumsum(block.counts)
            # a row a depth, in the tokens' order; where a path has ended nothing is added and nothing paid
            each, bits, real = np.zeros((DEPTH, n), np.float32), np.zeros((DEPTH, n), np.float32), np.zeros((DEPTH, n), np.float32)
            for d, end in enumerate(ends.tolist()):
                at, own = block.order[: counts[d]], slice(end - counts[d], end)
                each[d][at], bits[d][at], real[d][at] = p[own], block.bits[own], 1
            p = each
            sums = np.stack([(bits - p) * real, p * (1 - p)])
            upto = np.cumsum(sums, axis=2, dtype=np.float32) - sums
            text = tokens.text.take(block.rows)
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            start = upto[:, :, first]
            if text[0] == text_kept:
                start[:, :, 0] -= kept
            past = upto - np.repeat(start, np.diff(np.r_[first, n]), axis=2)
            shift = np.clip(past[0] / (past[1] + np.float32(CALM)), -2, 2)
            kept, text_kept = past[:, :, -1] + sums[:, :, -1], text[-1]
            # of the odds, times e to the shift
            odds = p / (1 - p) * np.exp(shift)
            p = (bits * odds + (1 - bits)) / (1 + odds)
            p = p * real + (1 - real)
            found.append(np.log10(reduce(np.multiply, p.astype(np.float64))))
        return np.concatenate(found)

    def inner_costs(self, tokens: Tokens, rows: np.ndarray) -> np.ndarray:
        """log10 of the probability of these tokens within their classes."""
        found = [np.zeros(0)]
        for block in inner_blocks(self.inner, tokens, rows, self.lexicon.tree):
            p = self.inner.probability(self.inner.mixed(block.found, block.gate), block.gate)
            each, costs, begin = np.log10(of_bits(p, block.bits)), np.zeros(len(block.rows)), 0
            for n in block.counts:
                costs[:n] += each[begin : begin + n]
                begin += n
            found.append(np.empty(len(costs)))
            found[-1][block.order] = costs
        return np.concatenate(found)

    def token_costs(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability but for what a rare word costs, and whether it does."""
        states, held = again(tokens)
        told = np.where(states >= 0, np.log10(np.where(held, self.again[states], 1 - self.again[states])), 0)
        rows = np.flatnonzero(~held)
        told[rows] += self.class_costs(tokens, rows) + self.inner_costs(tokens, rows)
        return told, ~held & (tokens.leaf == 0)

    def rare_costs(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each rare word: by its count, or if that is 0 letter by letter."""
        unknown = self.lexicon.unknown()
        costs = np.log10((1 - unknown) * np.maximum(counts, 1) / max(self.lexicon.rare, 1))
        new = counts == 0
        if new.any():
            costs[new] = np.log10(unknown) + self.letter_costs(words.filter(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
        return costs


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, best): counts, and the most that one group of documents has, times GROUPS, with the group's number; a group
    is of documents that are alike in their most frequent word. Counts are added up in Arrow tables; those of too many
    words are sent on."""
    held: list[pa.Table] = []

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by(["word", "likes"]).aggregate([("n", "sum")]).rename_columns(["word", "likes", "n"]).select(["word", "n", "likes"])

    def sent(table: pa.Table) -> list[pa.RecordBatch]:
        best = pc.add(pc.multiply(table["n"], GROUPS), table["likes"].cast(pa.int64()))
        whole = table.append_column("best", best).group_by("word").aggregate([("n", "sum"), ("best", "max")])
        return whole.rename_columns(["word", "n", "best"]).combine_chunks().to_batches(100_000)

    def rows(words: pa.Array, times: np.ndarray, likes: np.ndarray) -> pa.Table:
        return pa.table({"word": words, "n": pa.array(times.astype(np.int64)), "likes": pa.array(likes.astype(np.int32))})

    for batch in batches:
        for part in parts_of(batch):
            words, number, sizes = coded_words(part)
            pairs, times = np.unique(np.repeat(np.arange(len(part)), sizes) << 32 | number, return_counts=True)
            texts, own = pairs >> 32, pairs & 0xFFFFFFFF
            groups = np.zeros(len(part), np.int64)
            if len(pairs):
                # of a text's words the most frequent, the first of equal ones
                first = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]])
                best = 0xFFFFFFFF - (np.maximum.reduceat(times << 32 | 0xFFFFFFFF - own, first) & 0xFFFFFFFF)
                groups[texts[first]] = word_hashes(words)[best] % GROUPS
            keys, of = np.unique(groups[texts] << 32 | own, return_inverse=True)
            held.append(rows(words.take(pa.array(keys & 0xFFFFFFFF)), np.bincount(of, times, len(keys)), keys >> 32))
            held.append(rows(pa.array([END], pa.binary()), np.array([len(part)]), np.zeros(1)))
            if sum(map(len, held)) > 900_000:
                held = [added()]
                if len(held[0]) > 300_000:
                    yield from sent(held.pop())
    if held:
        yield from sent(added())


def _stripe_rows(table: np.ndarray, first: int) -> pa.RecordBatch:
    """The stripes of a table that have anything, numbered from first."""
    flat, task = table.reshape(-1, STRIPE), TaskContext.get().partitionId()
    used = [k for k in range(len(flat)) if flat[k].any()]
    data = [pa.compress(flat[k].astype(np.float32).tobytes(), codec="zstd", asbytes=True) for k in used]
    return pa.RecordBatch.from_arrays([pa.array([first + k for k in used], pa.int32()), pa.array([task] * len(used), pa.int32()), pa.array(data, pa.binary())], ["stripe", "task", "data"])


def _filled(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros(-len(x) % STRIPE)])


def _learned_words(shared, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        mixer, inner, states = word_mixer(slots).opened(), inner_mixer(slots).opened(), np.zeros(2 * AGAIN)
        for batch in batches:
            for part in parts_of(batch):
                tokens = tokens_of(part, lexicon)
                at, held = again(tokens)
                states += np.bincount((2 * at + held)[at >= 0], minlength=2 * AGAIN)
                rows = np.flatnonzero(~held)
                for of, blocks in ((mixer, class_blocks), (inner, inner_blocks)):
                    for k, block in enumerate(blocks(of, tokens, rows, lexicon.tree, counted=True)):
                        of.moved(block.found, block.gate, block.bits)
                        if k % 32 == 31:
                            of.count()
                    of.count()
        stripes = mixer.table.size // STRIPE
        yield _stripe_rows(mixer.table, 0)
        yield _stripe_rows(inner.table, stripes)
        yield _stripe_rows(_filled(np.concatenate([states, mixer.told(), inner.told()])), stripes + inner.table.size // STRIPE)

    return run


def _learned_letters(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        mixer = letter_mixer().opened()
        for batch in batches:
            words = column(batch, "word").to_numpy(zero_copy_only=False).tolist()
            for begin in range(0, len(words), 3000):
                hashes, positions, bits, _ = lexicon.letter_bits(words[begin : begin + 3000])
                mixer.learn(hashes, positions, bits)
                if begin // 3000 % 16 == 15:
                    mixer.count()
            mixer.count()
        yield _stripe_rows(mixer.table, 0)
        yield _stripe_rows(_filled(mixer.told()), mixer.table.size // STRIPE)

    return run


def word_mixer(slots: int) -> Mixer:
    return Mixer(4, slots, DEPTH, (0, 1))


def inner_mixer(slots: int) -> Mixer:
    return Mixer(len(INNER), slots, INNER_POSITIONS, (0, 1), 1)


def letter_mixer() -> Mixer:
    return Mixer(4, LETTER_SLOTS, 1, (2, 3))


def _summed_data(table: pa.Table) -> np.ndarray:
    total = np.zeros(STRIPE)
    for x in table["data"]:
        total += np.frombuffer(pa.decompress(x.as_py(), 4 * STRIPE, codec="zstd", asbytes=True), np.float32)
    return total


def _sum_stripes(table: pa.Table) -> pa.Table:
    data = pa.compress(_summed_data(table).astype(np.float32).tobytes(), codec="zstd", asbytes=True)
    return pa.table({"stripe": table["stripe"][:1], "task": pa.array([0], pa.int32()), "data": pa.array([data], pa.binary())})


def _freeze_stripes(tables: int):
    """Sums; stripes of the tables, which come first, become a byte of stretched quotient and one of level a slot."""

    def run(table: pa.Table) -> pa.Table:
        total, stripe = _summed_data(table).astype(np.float32), table["stripe"][0].as_py()
        if stripe < tables:
            zeros, ones = total.reshape(-1, 2).T
            total = np.stack([Mixer.tenths(zeros, ones), Mixer.level(zeros + ones).astype(np.int8)])
        return pa.table({"stripe": table["stripe"][:1], "data": pa.array([pa.compress(total.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    return run


def _gathered(stripes: DataFrame, slots: int, contexts: int, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tenths, levels, numbers): the sum of all tasks' stripes, first within groups of about the root of the tasks, then
    over the groups, so that no task holds more than some hundred stripes; the driver gets two bytes a slot."""
    tables, groups, size = contexts * slots * 2 // STRIPE, max(1, math.isqrt(tasks)), STRIPE // 2
    some = stripes.withColumn("task", F.pmod("task", F.lit(groups)).cast("int")).groupBy("stripe", "task").applyInArrow(_sum_stripes, "stripe int, task int, data binary")
    tenths, levels, rest = np.zeros(contexts * slots, np.int8), np.zeros(contexts * slots, np.int8), {}
    for r in some.groupBy("stripe").applyInArrow(_freeze_stripes(tables), "stripe int, data binary").toLocalIterator():
        if r["stripe"] < tables:
            both = np.frombuffer(pa.decompress(bytes(r["data"]), 2 * size, codec="zstd", asbytes=True), np.int8).reshape(2, -1)
            at = slice(r["stripe"] * size, (r["stripe"] + 1) * size)
            tenths[at], levels[at] = both
        else:
            rest[r["stripe"] - tables] = np.frombuffer(pa.decompress(bytes(r["data"]), 4 * STRIPE, codec="zstd", asbytes=True), np.float32)
    numbers = np.zeros((1 + max(rest, default=0), STRIPE))
    for k, x in rest.items():
        numbers[k] = x
    return tenths, levels, numbers.ravel()


def train(documents: DataFrame, training: Column, head: int = 60_000) -> tuple[DataFrame, Model]:
    """The counts (word, n) of all training tokens, in the shared folder, and the model; from the texts (null: empty)
    of the rows for which `training` is true."""
    spark = documents.sparkSession
    texts = text_rows(documents).where(training).select("text")
    # tasks have added up their own counts: their rows are dealt as they are and added once
    counted = texts.mapInArrow(released(_word_counts), "word binary, n long, best long").repartition("word").groupBy("word")
    counts = stored(counted.agg(F.sum("n").alias("n"), F.pmod(F.max("best"), F.lit(GROUPS)).cast("int").alias("likes")), "word-counts")
    end = F.col("word") == END
    total, distinct, rows, once = (int(x) for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(end, F.col("n"))), F.lit(0)), F.count_if((F.col("n") == 1) & ~end)).first())
    # the most frequent words, by eighths of octaves of their counts, as long as there are `head` at most: what comes to
    # the driver does not grow with the words or the tasks
    octave, most, kept = F.floor(8 * F.log2("n")), None, 0
    for r in sorted(counts.where(~end).groupBy(octave.alias("octave")).count().collect(), key=lambda r: -r["octave"]):
        kept += r["count"]
        if kept > head:
            most = r["octave"]
            break
    found = counts.where(~end if most is None else ~end & (octave > most)).collect()
    top = sorted(((bytes(r["word"]), int(r["n"]), r["likes"]) for r in found), key=lambda x: (-x[1], x[0]))
    rare = total - rows - sum(n for _, n, _ in top)
    weights = np.array([max(rare, 1), max(rows, 1), *(n for _, n, _ in top)])
    likes = np.array([-2, -1, *(g for _, _, g in top)])
    letters = np.ones(256)
    for w, n, _ in top:
        np.add.at(letters, np.frombuffer(w, np.uint8), n**0.5)
    letters[32] += sum(n**0.5 for _, n, _ in top)
    once -= sum(n == 1 for _, n, _ in top)
    held = np.array([rare, rows, *(n for _, n, _ in top)])
    lexicon = Lexicon(pa.array([w for w, _, _ in top], pa.binary()), held, Tree(weights, np.lexsort((-weights, likes))), Code(letters.astype(int).tolist()), total, distinct, rare, once)
    slots = min(MOST_SLOTS, max(STRIPE, 1 << (4 * distinct).bit_length()))
    shared = spark.sparkContext.broadcast(lexicon)
    stripes = "stripe int, task int, data binary"
    words, inner, spelled = word_mixer(slots), inner_mixer(slots), letter_mixer()
    tenths, levels, numbers = _gathered(texts.mapInArrow(released(_learned_words(shared, slots)), stripes), slots, words.contexts + inner.contexts, texts.rdd.getNumPartitions())
    own = words.contexts * slots
    words.take(numbers[2 * AGAIN :], (tenths[:own], levels[:own]))
    inner.take(numbers[2 * AGAIN + words.size :], (tenths[own:], levels[own:]))
    states = numbers[: 2 * AGAIN].reshape(AGAIN, 2) + 0.4
    tenths, levels, numbers = _gathered(counts.where(F.lit(False) if most is None else ~end & (octave <= most)).select("word").mapInArrow(released(_learned_letters(shared)), stripes), LETTER_SLOTS, spelled.contexts, counts.rdd.getNumPartitions())
    spelled.take(numbers, (tenths, levels))
    return counts.select("word", "n"), Model(lexicon, words, spelled, states[:, 1] / states.sum(axis=1), inner)


def _new_letters(model: Model, words: list[pa.Array], held: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """What the letters of each of these words cost, if the word may be unknown, or 0: only texts held out can have unknown
    words, and what a text beside them has that is learned from is known."""
    found, all_ = np.zeros(len(held)), pa.concat_arrays(words)
    wanted = np.flatnonzero(held & (spelled > 0))
    own = all_.take(pa.array(wanted)).dictionary_encode()
    new = np.flatnonzero(~pc.is_in(own.dictionary, value_set=all_.filter(pa.array(~held))).to_numpy(zero_copy_only=False))
    costs = np.zeros(len(own.dictionary))
    costs[new] = model.letter_costs(own.dictionary.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
    found[wanted] = costs.take(own.indices.to_numpy())
    return found


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        lexicon = model.lexicon
        size = np.log10(lexicon.total + 0.5 * (lexicon.distinct + 1))
        value, known = np.log10(lexicon.counts + 0.5) - size, lexicon.counts > 0
        value[0], known[0] = 0, False
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("spelled", pa.int64()), ("letters", pa.float64())]))
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            rare, held, begin = [], [], 0
            held_out = column(batch, "held_out").to_numpy(zero_copy_only=False)
            for part in parts_of(batch):
                tokens = tokens_of(part, lexicon)
                n, common = len(part), tokens.leaf > 0
                costs, spelled = model.token_costs(tokens)
                # each text has a token at least, its end
                first = np.flatnonzero(np.r_[True, tokens.text[1:] != tokens.text[:-1]])
                out[0].append(np.diff(np.r_[first, len(costs)]))
                out[1].append(np.add.reduceat(known.take(tokens.leaf), first, dtype=np.int64))
                lengths = pc.binary_length(tokens.words).to_numpy().astype(np.int64)
                out[2].append(np.add.reduceat(lengths.take(tokens.number) + (tokens.leaf != 1), first))
                out[3].append(np.add.reduceat(value.take(tokens.leaf), first))
                out[4].append(np.add.reduceat(costs, first))
                pairs, of, times = np.unique(tokens.text[~common] << 32 | tokens.number[~common], return_inverse=True, return_counts=True)
                told = np.bincount(of, spelled[~common], len(pairs)).astype(np.int64)
                cuts = np.searchsorted(pairs >> 32, np.arange(n + 1))
                rare.append((tokens.words.take(pa.array(pairs & 0xFFFFFFFF)), times, told, cuts))
                held.append(held_out[begin : begin + n].take(pairs >> 32))
                begin += n
            if rare:
                letters = iter(np.split(_new_letters(model, [x[0] for x in rare], np.concatenate(held), np.concatenate([x[2] for x in rare])), np.cumsum([len(x[0]) for x in rare])[:-1]))
                for words, times, told, cuts in rare:
                    rows = pa.StructArray.from_arrays([words, pa.array(times), pa.array(told), pa.array(next(letters))], ["word", "n", "spelled", "letters"])
                    out[5].append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows))
            whole = [np.concatenate(x) if x else np.zeros(0) for x in out[:5]]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), *(pa.array(x.astype(np.int64)) for x in whole[:3]), *(pa.array(x.astype(np.float64)) for x in whole[3:]), pa.concat_arrays(x.cast(kind) for x in out[5]) if out[5] else pa.array([], kind)], ["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base", "score", "rare"])

    return run


def score_documents(documents: DataFrame, head: int = 60_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row; learned from the
    rows not held out. score: log10 of the probability of the words and the end; bits_per_byte: its bits by the bytes
    of the words, each with one more (a blank or the end).

    Null text is empty: the end alone; null keys and repeated rows stay; without training rows all counts are 0; an
    empty table gives no rows; further columns are ignored; a text of any length counts whole."""
    spark = documents.sparkSession
    counts, model = train(documents, fold("doc_id", 5) != 1, head)
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, score double, rare array<struct<word:binary,n:long,spelled:long,letters:double>>"
    rows = documents.select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held_out")).mapInArrow(released(_score(shared)), schema)
    scored = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    words = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", F.col("x.n").alias("times"), "x.spelled", "x.letters")
    # neither side is sorted: of the counts, each once, a task holds its part
    met = words.join(counts.hint("shuffle_hash"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # as Model.rare_costs has it
    lexicon, unknown = model.lexicon, model.lexicon.unknown()
    size = math.log10(lexicon.total + 0.5 * (lexicon.distinct + 1))
    cost = F.when(F.col("n") > 0, F.log10(F.lit(1 - unknown) * F.col("n") / F.lit(max(lexicon.rare, 1)))).otherwise(F.lit(math.log10(unknown)) + F.col("letters"))
    told = met.select("row", (F.col("times") * (F.log10(F.col("n") + 0.5) - size)).alias("more"), (F.col("spelled") * cost).alias("more_score"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("more_known"))
    # words of a row are in many tasks: they are added once, where they meet
    rest = told.repartition("row").groupBy("row").agg(F.sum("more").alias("more"), F.sum("more_score").alias("more_score"), F.sum("more_known").alias("more_known"))
    whole = scored.drop("rare").join(rest, "row", "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
