"""Token ids of whole texts by a public tokenizer of the tokenizers library."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomstrand.llm.common import KEPT, release


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file that ships with the environment."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Two white-space characters in a row, or the beginning of a special token: such texts are encoded in one go.
UNSAFE = re.compile(r"\s\s|<\|")


MARK = "<|endoftext|>"


#: By byte: 1 for ASCII white space, 2 for the first of the bytes of other white space.
KINDS = np.zeros(256, np.uint8)
KINDS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
#: That byte and the next of white space that is not ASCII.
WIDE = np.array([0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380])


def unsafe_rows(column: pa.Array) -> np.ndarray:
    """The rows of a column of strings without nulls that UNSAFE is found in. Only rows whose bytes may hold it are searched."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if at[0] == at[-1]:
        return np.empty(0, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    kinds = KINDS[raw]
    space = kinds == 1
    places = [np.flatnonzero(space[:-1] & space[1:]), np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))]
    wide = np.flatnonzero(kinds[:-1] == 2)
    places.append(wide[np.isin(raw[wide].astype(np.int64) << 8 | raw[wide + 1], WIDE)])
    rows = np.unique(np.searchsorted(at, np.concatenate(places) + at[0], "right") - 1)
    return rows[[UNSAFE.search(column[k].as_py()) is not None for k in rows.tolist()]] if len(rows) else rows


class Memory:
    """Ids by word for the words met last, `most` at the most: once half of them are new or met again since, the others
    are forgotten, so that frequent words stay."""

    def __init__(self, most: int):
        self.half, self.young, self.old = max(1, most // 2), {}, {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def find(self, words: list[str], encode) -> list[bytes]:
        """The ids of different words; encode(words) makes those that are not known."""
        get, before = self.young.get, self.old.pop
        out = [get(w) or before(w, None) for w in words]
        new = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(new, encode([words[k] for k in new]), strict=True):
            out[k] = ids
        for at in range(0, len(words), self.half):
            if len(self.young) + len(words[at : at + self.half]) > self.half:
                self.old, self.young = self.young, {}
            self.young.update(zip(words[at : at + self.half], out[at : at + self.half], strict=True))
        return out


class Encoder:
    """Encodes texts by the library, each different word once for as long as it is remembered.

    Both kinds of vocabulary files used here cut a text, whatever stands around, before a single space or line end, and
    after a line end. So the ids of a text without adjoining white space are those of its parts in order. The different
    parts of a batch are found by Arrow, so that Python meets each of them once.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memory(most - most // 8)  # ids of ' word', by word
        self.parts = Memory(most // 8)  # ids of line ends and of words that begin a line
        self.mark = self.tokenizer.token_to_id(MARK)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. Many go through the library as one text, told apart by a special token, which cuts a
        text before anything else is done to it (no part here holds one)."""
        if self.mark is None:
            return self._encode(parts)
        out: list[bytes] = []
        for first in range(0, len(parts), 1 << 14):
            rows = [parts[k : k + 64] for k in range(first, min(first + (1 << 14), len(parts)), 64)]
            for row, e in zip(rows, self.tokenizer.encode_batch_fast([MARK.join(row) for row in rows], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                at = (4 * np.flatnonzero(ids == self.mark)).tolist()
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(data)], strict=True)] if len(at) == len(row) - 1 else self._encode(row)
        return out

    def _spaced(self, words: list[str]) -> list[bytes]:
        return self._encode_parts([f" {w}" for w in words])

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(column):
            return []
        whole = unsafe_rows(column)
        found = self._encode([column[k].as_py() for k in whole.tolist()])
        if len(whole):
            unsafe = np.zeros(len(column), bool)
            unsafe[whole] = True
            column = pc.if_else(pa.array(unsafe), "", column)
        split = pc.split_pattern(pc.replace_substring(column, "\n", " \n "), " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        codes = 2 * coded.indices.to_numpy()  # one more where no space stands before
        codes[bounds[:-1]] |= 1
        if (end := pc.index(coded.dictionary, "\n").as_py()) >= 0:
            at = np.flatnonzero(codes >> 1 == end)
            codes[at] |= 1
            codes[at + 1] |= 1
        texts_of = coded.dictionary.to_pylist()
        met = np.zeros(2 * len(texts_of), bool)
        met[codes] = True
        spaced, bare = np.flatnonzero(met[0::2]), np.flatnonzero(met[1::2])
        ids = self.words.find([texts_of[k] for k in spaced.tolist()], self._spaced) + self.parts.find([texts_of[k] for k in bare.tolist()], self._encode_parts)
        place = np.zeros(2 * len(texts_of), np.int32)
        place[np.concatenate((2 * spaced, 2 * bare + 1))] = np.arange(len(ids))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(sizes) - sizes
        order = place[codes]
        n = sizes[order]
        ends = np.concatenate(([0], np.cumsum(n)))
        tokens = np.repeat(first[order] - ends[:-1], n)
        tokens += np.arange(ends[-1])
        tokens = np.frombuffer(b"".join(ids), "<u4")[tokens].tobytes()
        at = (4 * ends[bounds]).tolist()
        out = [tokens[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for k, x in zip(whole.tolist(), found, strict=True):
            out[k] = x
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    release()
    return Encoder(path)


KEPT.append(encoder.cache_clear)
