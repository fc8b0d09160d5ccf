"""Benchmark decontamination by a generalised suffix automaton of the test items.

Method. Items and documents are normalised to words (A-Z in lower case; runs of digits, letters and all that is not
ASCII). The automaton recognises every stretch of words of every item. A document's words are streamed through it:
its state and the length of the longest match that ends at a word are kept from word to word. A match of WINDOW words or more
ends an occurrence of a window, the suffix of that length, whose state names the items that hold it; an item shorter than
a window is a window of its own and is recognised by the states of whole items on the chain of suffix links.
Words outside the items' vocabulary reset the match, and stretches too short for any window aren't streamed.

Items are taken in blocks of about BLOCK_WORDS words, cut from long items with an overlap of one word less than a
window, so that each automaton has a bounded size; documents pass through the blocks' automata one after the other.

Hit words form spans. `cleaned` removes the spans of `least` words or more, and whole documents that are covered by
more than a share.

Defined results: null and empty texts have no words, such items no window; rows of one item_id are one item with all
their windows; a null item_id is an item named by the empty text; without items nothing is hit. Repeated documents have equal
results; columns named like the results are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut
from .common import pieces

WINDOW = 10
#: Words of the items that one automaton holds, on average, and of a part of a long item.
BLOCK_WORDS, PART_WORDS = 200_000, 20_000
#: Automata that a task holds at a time.
AT_ONCE = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed by the definition of a word: digits, a-z after lower-casing A-Z, and every byte of a character that is not ASCII.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = "array<struct<start:bigint,length:bigint>>"


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(WORD_BYTES).split() if raw else []


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty match."""

    def __init__(self, parts: list[tuple[str, list[bytes], bool]], window: int = WINDOW):
        """parts: item, words, and whether these are the whole item."""
        self.window = window
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words, _ in parts]
        for sequence in coded:
            last = 0
            for c in sequence:
                last = self._append(last, c)
        self.shortest = min([min(len(words), window) for _, words, _ in parts if words], default=window)
        # The state of each state's suffix of `window` words, from short states to long ones.
        self.suffix = [-1] * len(self.go)
        order = sorted(range(1, len(self.go)), key=self.size.__getitem__)
        for v in order:
            if self.size[v] >= window:
                self.suffix[v] = v if self.size[self.link[v]] < window else self.suffix[self.link[v]]
        self.items: dict[int, set[str]] = {}
        wholes = set()
        for (item, words, whole), sequence in zip(parts, coded, strict=True):
            v = 0
            for i, c in enumerate(sequence):
                v = self.go[v][c]
                if i + 1 >= window:
                    self.items.setdefault(self.suffix[v], set()).add(item)
            if whole and 0 < len(words) < window:
                self.items.setdefault(v, set()).add(item)
                wholes.add(v)
        # The longest whole item that a state's longest match ends with, itself included.
        self.whole = [-1] * len(self.go)
        for v in order:
            self.whole[v] = v if v in wholes else self.whole[self.link[v]]

    def _state(self, go: dict[int, int], link: int, size: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        return len(self.go) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the matches of q that are one word longer than p's longest."""
        twin = self._state(dict(self.go[q]), self.link[q], self.size[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = twin
            p = self.link[p]
        return twin

    def _append(self, last: int, c: int) -> int:
        q = self.go[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new = self._state({}, 0, self.size[last] + 1)
        p = last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new

    def search(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Spans [start, end) of the words inside windows, and the items of these windows."""
        spans: list[list[int]] = []
        if len(words) < self.shortest or not self.vocabulary:
            return spans, set()
        coded = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        turns = np.flatnonzero(np.diff(coded >= 0, prepend=False, append=False))
        go, link, size, suffix, whole, window = self.go, self.link, self.size, self.suffix, self.whole, self.window
        states: set[int] = set()
        for a, b in turns.reshape(-1, 2).tolist():
            if b - a < self.shortest:
                continue
            v = long = 0
            for i, c in enumerate(coded[a:b].tolist(), a + 1):
                to = go[v].get(c)
                while to is None and v:
                    v = link[v]
                    long = size[v]
                    to = go[v].get(c)
                if to is None:
                    continue
                v = to
                long += 1
                covered = 0
                if long >= window:
                    covered = window
                    states.add(suffix[v])
                u = whole[v]
                while u > 0:
                    if size[u] <= long:
                        covered = max(covered, size[u])
                        states.add(u)
                    u = whole[link[u]]
                if covered:
                    start = i - covered
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i])
        return spans, set().union(*map(self.items.__getitem__, states))


_built: dict[str, Automaton] = {}


def built(name: str, parts: list, window: int) -> Automaton:
    """The automaton of a block, kept by a worker until it meets other blocks."""
    if name not in _built:
        while len(_built) >= AT_ONCE:
            _built.pop(next(iter(_built)))
        _built[name] = Automaton(parts, window)
    return _built[name]


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))


def parted(items: DataFrame, window: int) -> DataFrame:
    """item, words and whole of every part of an item with words, each once."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(F.col("text")).alias("words")).filter("size(words) > 0")
    step = PART_WORDS - window + 1
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step)))
    parts = words.withColumn("at", at).select("item", F.slice("words", F.col("at") + 1, PART_WORDS).alias("words"), (F.size("words") < window).alias("whole"))
    return parts.distinct()


def blocks(items: DataFrame, window: int) -> Iterator[list[tuple[str, list[bytes], bool]]]:
    """The parts of the items, in blocks of about BLOCK_WORDS words: no more is on the driver at a time."""
    parts = cut(parted(items, window), "items")
    n = -(-(parts.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK_WORDS)
    for i in range(n):
        block = parts.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i)
        yield [(r.item, [w.encode() for w in r.words], r.whole) for r in sorted(block.collect())]


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


MADE = {"n_words": "bigint", "spans": SPANS, "items": "array<string>"}


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns but the text (that too with keep_text), n_words, spans of hit words (start, length, in words) and
    items (sorted ids, as text) whose windows occur."""
    keep = [c for c in docs.columns if c not in (text, *MADE)]
    rows = docs.select(*keep, F.col(text)).withColumns({c: F.lit(None).cast(t) for c, t in MADE.items()})
    schema = StructType(rows.schema.fields)
    arrow = to_arrow_schema(schema)

    def passing(name: str, parts: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = built(name, parts, window)
            for batch in (p for whole in batches for p in pieces(whole)):
                sizes, spans, hits = [], [], []
                for raw, old, known in zip(
                    batch.column(text).cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True
                ):
                    words = words_of(raw)
                    found, names = automaton.search(words)
                    if old:
                        found = merged(found + [[s["start"], s["start"] + s["length"]] for s in old])
                    sizes.append(len(words))
                    spans.append([{"start": a, "length": b - a} for a, b in found])
                    hits.append(sorted(names.union(known or ())))
                made = [pa.array(x, arrow.field(c).type) for c, x in zip(MADE, (sizes, spans, hits), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [batch.column(text), *made], schema=arrow)

        return run

    i = -1
    for i, parts in enumerate(blocks(items, window)):
        if i and i % AT_ONCE == 0:
            rows = cut(rows, "matched")
        rows = rows.mapInArrow(passing(uuid.uuid4().hex, parts), schema)
    if i < 0:
        rows = rows.mapInArrow(passing("none", []), schema)
    return rows if keep_text else rows.drop(text)


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = WINDOW, share: float = 0.5) -> DataFrame:
    """The documents without the spans of `least` words or more (from a span's first word to its last); documents of
    whose words more than `share` are hit go. All columns stay."""
    own = [f"_{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index("text")]
    found = matched(docs.toDF(*own), items, window, text, keep_text=True).filter(n_hit() <= F.col("n_words") * share)

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, marked in zip(texts, spans, strict=True):
            long = [s for s in (marked if marked is not None else ()) if s["length"] >= least]
            if t is None or not long:
                out.append(t)
                continue
            raw, at, left = t.encode(), 0, []
            words = [m.span() for m in WORD.finditer(raw)]
            for s in long:
                left.append(raw[at : words[s["start"]][0]])
                at = words[s["start"] + s["length"] - 1][1]
            out.append(b"".join([*left, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    return found.withColumn(text, without(text, "spans")).select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])


def sql(window: int = WINDOW) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}')"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {words} AS words FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(words), {window}) AS m, array_to_string(words[i : i + least(len(words), {window}) - 1], ' ') AS gram
  FROM (SELECT item, words, unnest(generate_series(1, greatest(len(words) - {window - 1}, 1))) AS i FROM items WHERE len(words) > 0)
), places AS (
  SELECT k, i, m, array_to_string(words[i : i + m - 1], ' ') AS gram
  FROM (SELECT k, words, m, unnest(generate_series(1, len(words) - m + 1)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(words) >= m)
), found AS (SELECT k, i, places.m, item FROM places JOIN windows ON places.m = windows.m AND places.gram = windows.gram),
hit AS (SELECT k, count(DISTINCT w) AS n FROM (SELECT k, unnest(generate_series(i, i + m - 1)) AS w FROM (SELECT DISTINCT k, i, m FROM found)) GROUP BY k),
named AS (SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit ON hit.k = docs.k LEFT JOIN named ON named.k = docs.k"""
