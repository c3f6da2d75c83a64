"""Encoding of whole texts with a vocabulary of the tokenizers library, one library call a distinct chunk.

A text is cut where no token can reach across: after a run of Latin letters that an ASCII mark or blank
follows, and before a blank that follows a non-blank. For the two vocabularies' splitting rules (byte-level
with a leading blank; word-level with blanks dropped, NFC and lower-casing) the ids of a text are then the
ids of its chunks, joined. (The dotted capital I, U+0130, is no such letter: in lower case it ends in a mark,
which the next mark joins.) Chunks repeat much, so their ids are kept, as little-endian 32-bit numbers, and
joining them is one bytes.join a text. tests/llm holds the law against the library on whole texts.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+(?=[ .,\n;:!?])|[ \n]*[^ \n]+(?:(?<=\s)[ \n]+[^ \n]*)*|[ \n]+")
_CUT = re.compile(r"(?<=\S)[ \n]")
#: A text longer than this is handled in several parts, cut at a chunk's end.
PART = 1_000_000


def parts(text: str, most: int = PART) -> Iterable[str]:
    """text in pieces of about `most` characters, each ending where a chunk ends."""
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


#: A blank that a blank or line end follows (the class: what either engine calls a blank): such texts are cut by
#: CHUNK, all others at each blank and line end.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]"


class ChunkEncoder:
    """encode(texts) gives each text's ids as bytes.

    Texts are split, and their distinct words numbered and looked up among the known ones, by Arrow; Python sees
    the unknown words alone. The ids of all words are gathered by numpy. At most `kept` words are held; when they
    are too many, the older half goes."""

    def __init__(self, encode_distinct: Callable[[list[str]], list[bytes]], kept: int = 800_000):
        self.encode_distinct = encode_distinct
        self.kept = kept
        self.loose: dict[str, bytes] = {}
        self.words = pa.array([], pa.string())
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, one by one."""
        missing = [*{x for x in chunks if x not in self.loose}]
        if missing:
            if len(self.loose) + len(missing) > self.kept // 2:
                self.loose, missing = {}, [*set(chunks)]
            self.loose.update(zip(missing, self.encode_distinct(missing)))
        return [*map(self.loose.__getitem__, chunks)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text; the caller keeps the texts of one call to some MB."""
        if not any(len(x) > 2 * PART for x in texts):
            return self._encode(texts)
        cut = [[*parts(x, PART)] for x in texts]
        found = iter([ids for own in cut for part in own for ids in self._encode([part])])
        return [b"".join(next(found) for _ in own) for own in cut]

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        unsafe = pc.match_substring_regex(pa.array(texts, pa.string()), _UNSAFE).to_pylist()
        for k in (k for k, x in enumerate(unsafe) if x):
            out[k] = b"".join(self.lookup(CHUNK.findall(texts[k])))
        plain = [k for k, x in enumerate(unsafe) if not x]
        if plain:
            for k, ids in zip(plain, self._plain([texts[k].replace("\n", " \n") for k in plain])):
                out[k] = ids
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        offsets, index = split.offsets.to_numpy() - split.offsets[0].as_py(), coded.indices.to_numpy().astype(np.int64)
        # a text's first word has no blank before it
        first = self.lookup(coded.dictionary.take(coded.indices.take(pa.array(offsets[:-1]))).to_pylist())
        at = self._places(coded.dictionary)
        index = at[index]
        index[offsets[:-1]] = np.arange(len(self.sizes), len(self.sizes) + len(first))
        sizes = np.r_[self.sizes, np.fromiter(map(len, first), np.int64, len(first)) // 4]
        flat, starts = np.r_[self.flat, np.frombuffer(b"".join(first), "<u4")], np.cumsum(sizes) - sizes
        own = sizes[index]
        ends = np.cumsum(own)
        joined, cuts = flat[np.arange(ends[-1]) + np.repeat(starts[index] - ends + own, own)], ends[offsets[1:] - 1]
        return [joined[a:b].tobytes() for a, b in zip(np.r_[0, cuts[:-1]].tolist(), cuts.tolist())]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each distinct word stands among the known ones, to which the unknown are added."""
        if len(self.words) + len(words) > self.kept:
            half = len(self.words) // 2
            self.words, self.flat = self.words.slice(half), self.flat[self.sizes[:half].sum() :]
            self.sizes = self.sizes[half:]
        at = pc.index_in(words, value_set=self.words)
        unknown = words.filter(at.is_null())
        if len(unknown):
            ids = self.encode_distinct([x if x[:1] == "\n" else " " + x for x in unknown.to_pylist()])
            at = pc.fill_null(at, -1).to_numpy().copy()
            at[at < 0] = np.arange(len(self.words), len(self.words) + len(unknown))
            self.words = pa.concat_arrays([self.words, unknown])
            self.sizes = np.r_[self.sizes, np.fromiter(map(len, ids), np.int64, len(ids)) // 4]
            self.flat = np.r_[self.flat, np.frombuffer(b"".join(ids), "<u4")]
        return np.asarray(at).astype(np.int64)


def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes with the library itself: no added special tokens, truncation or padding. Chunks that begin with a blank
    and have no other are encoded many at a time, as one text, and told apart by the library's offsets."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def alone(chunks: list[str]) -> list[bytes]:
        return [array.array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(chunks: list[str]) -> list[bytes]:
        joint = [k for k, x in enumerate(chunks) if _SIMPLE.fullmatch(x)]
        groups = [joint[k : k + 200] for k in range(0, len(joint), 200)]
        found: list[bytes | None] = [None] * len(chunks)
        for group, x in zip(groups, tokenizer.encode_batch(["".join(chunks[k] for k in group) for group in groups], add_special_tokens=False)):
            begins = np.fromiter((a for a, _ in x.offsets), np.int64, len(x))
            cuts = np.searchsorted(begins, np.cumsum([len(chunks[k]) for k in group])).tolist()
            ids, at = array.array("I", x.ids).tobytes(), 0
            for k, cut in zip(group, cuts):
                found[k], at = ids[4 * at : 4 * cut], cut
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, alone([chunks[k] for k in rest])):
            found[k] = ids
        return found

    return encode


#: What can stand in a joint text: a blank and Latin words and marks, nothing that normalising may move.
_SIMPLE = re.compile(r"[ \n][A-Za-zÀ-ÖØ-öø-įı-ɏ0-9]+[-.,;:!?')]*")


_encoders: dict[str, ChunkEncoder] = {}


def library_chunks(path: str) -> ChunkEncoder:
    """This process's encoder for the vocabulary file; Spark keeps its Python workers from task to task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(library_encoder(path))
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Where an installed public vocabulary file lies; looked up on the machine that reads it."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
