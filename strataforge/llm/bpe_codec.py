"""Byte-level BPE encoding and decoding by speculation and verification.

Words (the pieces of the splitting pattern) are first proposed as greedy longest matches from the vocabulary,
left to right. A sequence of tokens is the BPE encoding of its text exactly if every adjacent pair is one: that
is, if no merge of lower rank would have joined across their border. So all adjacent pairs of all proposed words
are tested at once, in numpy, each distinct pair once in a process's life; words with a failing pair, and only
they, are merged step by step by rank.

The pair test undoes merges backwards. Of the two bytes at the border and the tokens grown from them, the token
that was made last is taken apart first; at each stage the two present neighbours are looked up as a merge. If
that merge has a lower rank than the one that consumes either of them, it would have come first: the pair fails.
At equal ranks the place further left goes first.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import ChunkEncoder, vocabulary
from .common import column, released, steps, text_rows

#: Fixed value: how the vocabulary's tokenizer splits a text before merging.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@functools.cache
def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Codec:
    """encode_words() and decode() for a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters, model = byte_letters(), told["model"]
        as_bytes = lambda token: bytes(map(letters.__getitem__, token))
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.ids = {as_bytes(t): n for t, n in model["vocab"].items() if t not in self.special}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.pieces: list[bytes] = [b""] * size
        for token, n in [*self.ids.items(), *((t.encode(), n) for t, n in self.special.items())]:
            self.pieces[n] = token
        self.longest = max(map(len, self.ids))
        # rank of the merge that makes a token (-1: a byte), and the tokens it joins
        self.size = size
        self.made, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        keys = np.zeros(len(model["merges"]), np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (self.ids[as_bytes(x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = self.ids[self.pieces[a] + self.pieces[b]]
            self.made[whole], self.left[whole], self.right[whole] = rank, a, b
            self.merges[a, b] = rank, whole
            keys[rank] = a * size + b
        self.merge_ranks = np.argsort(keys)
        self.merge_keys = keys[self.merge_ranks]
        self.tested_keys, self.tested = np.zeros(0, np.int64), np.zeros(0, bool)
        self.failed = self.seen = 0

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest matches."""
        ids, out, at, n = self.ids, [], 0, len(word)
        while at < n:
            to = min(n, at + self.longest)
            while (found := ids.get(word[at:to])) is None:
                to -= 1
            out.append(found)
            at = to
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether the encoding of their joined text is the pair."""
        a, b = a.copy(), b.copy()
        never = np.int64(len(self.merge_keys))
        used_a, used_b = np.full(len(a), never), np.full(len(a), never)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.merge_keys, key), never - 1)
            rank = np.where(self.merge_keys[at] == key, self.merge_ranks[at], never)
            clash = (rank < used_a[live]) & (rank <= used_b[live]) & (rank < never)
            good[live[clash]] = False
            made_x, made_y = self.made[x], self.made[y]
            go = ~clash & ((made_x >= 0) | (made_y >= 0))
            live, made_x, made_y = live[go], made_x[go], made_y[go]
            later = made_x > made_y
            rows = live[later]
            used_a[rows] = made_x[later]
            a[rows] = self.right[a[rows]]
            rows = live[~later]
            used_b[rows] = made_y[~later]
            b[rows] = self.left[b[rows]]
        return good

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """compatible() of distinct pairs as numbers, each tested once."""
        at = np.minimum(np.searchsorted(self.tested_keys, keys), max(len(self.tested_keys) - 1, 0))
        old = self.tested_keys[at] == keys if len(self.tested_keys) else np.zeros(len(keys), bool)
        good = np.zeros(len(keys), bool)
        good[old] = self.tested[at[old]]
        new = keys[~old]
        good[~old] = self.compatible(new // self.size, new % self.size)
        if len(self.tested_keys) > 4_000_000:
            self.tested_keys, self.tested = np.zeros(0, np.int64), np.zeros(0, bool)
        both = np.concatenate([self.tested_keys, new])
        order = np.argsort(both, kind="stable")
        self.tested_keys, self.tested = both[order], np.concatenate([self.tested, good[~old]])[order]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: again and again the leftmost adjacent pair of the least rank."""
        parts = [self.ids[word[k : k + 1]] for k in range(len(word))]
        if len(parts) > 200:
            return self._merge_long(parts)
        get, none = self.merges.get, (len(self.merges), 0)
        while len(parts) > 1:
            rank, whole, at = min((*get(pair, none), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == none[0]:
                break
            parts[at : at + 2] = [whole]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """merge() with a heap over a linked list, for words of very many bytes."""
        import heapq

        n, get = len(parts), self.merges.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(*got, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (got := get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, whole, k, a, b = heapq.heappop(heap)
            j = after[k]
            if j >= n or parts[k] != a or parts[j] != b:
                continue
            parts[k], parts[j], after[k] = whole, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                if got := get((whole, parts[after[k]])):
                    heapq.heappush(heap, (*got, k, whole, parts[after[k]]))
            if before[k] >= 0 and (got := get((parts[before[k]], whole))):
                heapq.heappush(heap, (*got, before[k], parts[before[k]], whole))
        return [x for x in parts if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The exact ids of each word."""
        proposed = [*map(self.propose, words)]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((x for ids in proposed for x in ids), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(words)), sizes)
        inside = word_of[1:] == word_of[:-1]
        keys, of = np.unique((flat[:-1] * self.size + flat[1:])[inside], return_inverse=True)
        bad = np.unique(word_of[:-1][inside][~self._known(keys)[of]]) if len(keys) else []
        self.seen += len(words)
        self.failed += len(bad)
        for k in bad:
            proposed[k] = self.merge(words[k])
        return proposed

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """ids of short texts as little-endian 32-bit numbers; special tokens' strings become their ids."""
        cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split: list[list] = []
        for text in texts:
            spans = cut.split(text) if cut and any(s in text for s in self.special) else [text]
            split.append([w for span in spans for w in ([self.special[span]] if span in self.special else [x.encode() for x in SPLIT.findall(span)])])
        distinct = [*{w for words in split for w in words if not isinstance(w, int)}]
        ids = {w: array.array("I", x).tobytes() for w, x in zip(distinct, self.encode_words(distinct))}
        return [b"".join(w.to_bytes(4, "little") if isinstance(w, int) else ids[w] for w in words) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of the ids; special tokens give their strings, bytes that are no UTF-8 the replacement sign."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, tuple[Codec, ChunkEncoder]] = {}


def codec(path: str) -> tuple[Codec, ChunkEncoder]:
    if path not in _codecs:
        made = Codec(path)
        _codecs[path] = made, ChunkEncoder(made.encode_texts)
    return _codecs[path]


def _run(name: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, encoder = codec(vocabulary(name))
        for batch in batches:
            doc_ids, at = column(batch, "doc_id"), 0
            for part in steps(x.as_py() for x in column(batch, "text")):
                ids = encoder.encode(part)
                decoded = [tables.decode(x) for x in ids]
                own = [doc_ids.slice(at, len(part)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                if full:
                    own += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(own, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(own)])

    return run


def encode_and_decode(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", full: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every row: the ids of the whole text, and
    the text they decode to. One narrow pass, no shuffle.

    Null text is empty (no ids); null keys and repeated rows stay; an empty table gives no rows; a word of any
    length is merged exactly; further columns are ignored."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * full
    return text_rows(documents).select("doc_id", "text").mapInArrow(released(_run(tokenizer, full)), schema)
