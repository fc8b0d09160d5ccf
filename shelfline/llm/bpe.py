"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Method. The encoding of a byte string ends in one token only, and dropping that token leaves the encoding of a
shorter prefix. So one number per prefix, its last token, holds the encodings of all prefixes. A token ending at a
byte is the last one if it is what merging its own bytes gives, and if merging the bytes of the token before it
and its own gives just these two tokens again. The work is linear in the length (a token has a bounded
length), also for a word of a million letters. Tables allow exact appends, which extend them, and edits, which keep
the part before the edit.

Texts are cut by the tokenizer's pattern first; a piece that is itself a token is that token, as in the reference
tokenizer. Because a match depends on what follows its start only, `Encoded` re-cuts an edited text from the last
boundary whose pieces can't have looked at the edit to the first boundary after it where old and new cuts meet.

Defined results: null and empty texts have no tokens; ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_lists

#: Distinct pieces and token pairs a worker remembers; beyond that it starts afresh.
MEMORY = 300_000
CHUNK = 1_000_000


class Prefixes:
    """Byte strings to token ids, by the last token of every prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.never = max(ranks.values()) + 2
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token's own bytes joins; None for tokens that merging its bytes
        doesn't give. A single byte is (-1, -1)."""
        if token not in self.halves:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                found = [self.ranks.get(a + b, self.never) for a, b in zip(parts, parts[1:], strict=False)]
                i = found.index(min(found))
                if found[i] == self.never:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (-1, -1) if len(data) == 1 else tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self.halves[token]

    def follows(self, left: int, right: int) -> bool:
        """True if merging the bytes of two tokens gives these two. Time runs backwards: the later made of the two is
        taken apart, and at no time may the parts that then meet at the border make a token of a rank below that of
        the token just taken apart (of equal ranks the leftmost pair merges first)."""
        ok = self.fits.get((left, right))
        if ok is not None:
            return ok
        a, b, limit, ok = left, right, self.never, True
        while True:
            rank = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], self.never)
            if rank < limit:
                ok = False
                break
            a_made = a if self.split(a)[0] >= 0 else -1
            b_made = b if self.split(b)[0] >= 0 else -1
            if a_made < 0 and b_made < 0:
                break
            if a_made > b_made:
                limit, a = a_made, self.split(a)[1]
            else:
                limit, b = b_made + 1, self.split(b)[0]
        if len(self.fits) > MEMORY:
            self.fits.clear()
        self.fits[left, right] = ok
        return ok

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Append to `last` the last token of each further prefix of data; last[0] stands for the empty prefix."""
        get, size, halves, split, fits, follows = self.ranks.get, self.sizes.__getitem__, self.halves, self.split, self.fits, self.follows
        for end in range(len(last), len(data) + 1):
            # The last token is unique, so any order of trial is right: first the token before it made longer.
            first = end - 1 - size(last[end - 1]) if end > 1 else 0
            for start in chain((first,), range(first + 1, end), range(first - 1, max(0, end - self.longest) - 1, -1)):
                token = get(data[start:end])
                if token is None or not (halves.get(token) or split(token)):
                    continue
                if start:
                    ok = fits.get((last[start], token))
                    if not (follows(last[start], token) if ok is None else ok):
                        continue
                last.append(token)
                break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return last

    def walked(self, last: list[int]) -> list[int]:
        """The encoding of the longest prefix of a table."""
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= self.sizes[last[end]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        return [token] if token is not None else self.walked(self.extend([-1], piece))

    def encode_sorted(self, pieces: list[bytes]) -> list[list[int]]:
        """Encodings of pieces in ascending order: each goes on from the prefix it shares with the one before."""
        out, last, before = [], [-1], b""
        for piece in pieces:
            token = self.ranks.get(piece)
            if token is not None:
                out.append([token])
                continue
            shared = len(commonprefix((before, piece)))
            del last[shared + 1 :]
            out.append(self.walked(self.extend(last, piece)))
            before = piece
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def compiled(pattern: str) -> regex.Pattern:
    """White space is the Unicode property, whatever the library takes \\s for."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.prefixes = Prefixes(ranks)
        self.pattern = compiled(pattern)
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers, one after the other

    def piece(self, piece: str) -> list[int]:
        return self.prefixes.encode(piece.encode())

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.packed([text])), np.int32).tolist()

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as 32-bit numbers. Pieces not yet known are encoded together, in order, for about
        CHUNK code points."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and size < CHUNK:
                size += len(texts[stop])
                stop += 1
            cut = [self.pattern.findall(t) for t in texts[start:stop]]
            if len(self.known) > MEMORY:
                self.known.clear()
            # Strings and their bytes are in the same order.
            new = sorted(set().union(*cut).difference(self.known))
            for p, ids in zip(new, self.prefixes.encode_sorted([p.encode() for p in new]), strict=True):
                self.known[p] = array("i", ids).tobytes()
            for pieces in cut:
                yield b"".join(map(self.known.__getitem__, pieces))
            start = stop


class Encoded:
    """A text with its pieces' tokens, for appends and edits without encoding all of it again."""

    def __init__(self, tokenizer: Tokenizer, text: str = ""):
        self.tokenizer, self.text = tokenizer, ""
        self.ends: list[int] = []  # of the pieces, in code points
        self.tokens: list[list[int]] = []
        self.edit(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for t in self.tokens for i in t]

    def append(self, text: str) -> int:
        return self.edit(len(self.text), len(self.text), text)

    def _settled(self, end: int, start: int) -> bool:
        """True if the cut of a piece can't change by an edit at `start`. A match looks two code points beyond its end
        at most (an apostrophe at "re", "ve" and "ll"), or, from white space, at the whole run and one beyond it."""
        if end + 2 > start:
            return False
        while self.text[end - 1].isspace() and self.text[end].isspace():
            end += 1
            if end >= start:
                return False
        return True

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace text[start:stop]; returns how many pieces were encoded for it."""
        grown = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        keep = bisect_right(self.ends, start - 2)
        while keep and not self._settled(self.ends[keep - 1], start):
            keep -= 1
        at = self.ends[keep - 1] if keep else 0
        old = {e + grown: i for i, e in enumerate(self.ends) if e >= stop}
        ends, tokens, join = [], [], len(self.ends)
        for m in self.tokenizer.pattern.finditer(text, at):
            ends.append(m.end())
            tokens.append(self.tokenizer.piece(m.group()))
            if m.end() > start + len(new) and m.end() in old:
                join = old[m.end()] + 1
                break
        done = len(tokens)
        self.ends = self.ends[:keep] + ends + [e + grown for e in self.ends[join:]]
        self.tokens = self.tokens[:keep] + tokens + self.tokens[join:]
        self.text = text
        return done


def ranks(path: str) -> dict[bytes, int]:
    """From a rank file: a line for each token, its bytes in base 64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """Read once per worker."""
    return Tokenizer(ranks(path), pattern)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> pa.Array:
    """The bytes of each id, null for numbers that are none; read once per worker."""
    bytes_of = {i: b for b, i in ranks(path).items()}
    return pa.array([bytes_of.get(i) for i in range(max(bytes_of) + 1)], pa.binary())


def joined(lists: pa.ListArray, words: pa.Array) -> pa.Array:
    """For each list of ids the bytes that they stand for, one after the other (null: none)."""
    ids = lists.flatten()
    parts = pc.take(words, ids)
    if parts.null_count:
        raise ValueError("an id is outside the vocabulary")
    first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    data = parts.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends[first].astype(np.int32)), data])


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns but the text (and a column named as the result), and the token ids of each whole text."""
    keep = [c for c in docs.columns if c not in (text, ids)]

    def run(texts):
        found = list(tokenizer(path, pattern).packed([t or "" for t in texts]))
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
        values = np.frombuffer(b"".join(found), np.int32)
        return {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))}

    return map_lists(docs.select(*keep, text), run, f"`{ids}` array<int>", keep=keep)


def decoded(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for (null ids: none)."""
    keep = [c for c in tokens.columns if c != out]

    def run(lists):
        return {out: joined(lists, vocabulary(path))}

    return map_lists(tokens.select(*keep).withColumn("_ids", tokens[ids]), run, f"`{out}` binary", keep=keep, as_lists=False)
