"""Document fingerprints from Lempel-Ziv phrases.

Method. A text is parsed from left to right into phrases: the longest phrase already in its dictionary plus one
code point becomes a new phrase (LZ78). The set of phrases is hashed, 128 permutations give 128 minimum hashes,
and the low 16 bits of each make the fingerprint, written as hexadecimal digits. The share of equal places
estimates the similarity of two phrase sets: like a compression distance, it is high for texts that compress
each other well.

Each document is also compared with an edited text (its last third replaced by the beginning of the next document
in descending order of doc_id, the last one's next being the first) and with that next document. Documents are
dealt to slices of doc_id between bounds that are ids of the table, and are streamed through in order; the
document at each bound is sent to the slice above it as well. So a text is shuffled once and a task holds
two texts at a time.

Defined results: a null text is the empty text, whose fingerprint is empty (likeness 1 to another empty one, 0 to
all others). Rows of one doc_id follow each other by their text; a null doc_id comes after all others. Where no row
has an id, the first one's next text is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import U64, map_lists, minima, spread

PERMUTATIONS = 128
MOST_SLICES = 4096
NONE = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)


def parse(text: str, phrases: set[str], open_phrase: str, new: list[str]) -> str:
    """Go on parsing: add each new phrase to the dictionary and to `new`; returns the phrase still open."""
    w = open_phrase
    for c in text:
        w += c
        if w not in phrases:
            phrases.add(w)
            new.append(w)
            w = ""
    return w


class Fingerprints:
    """Fingerprints of texts, by a fixed family of permutations."""

    def __init__(self, seed: int = 2, permutations: int = PERMUTATIONS):
        self.a, self.b = spread(permutations, seed)

    def low(self, phrases: list[str]) -> np.ndarray:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), U64, len(phrases))
        return minima((h >> U64(32)).astype(np.uint32), self.a, self.b)

    def of(self, text: str) -> np.ndarray:
        new: list[str] = []
        rest = parse(text, set(), "", new)
        return self.low(new + [rest] if rest else new)

    def of_both(self, head: str, tail: str, other_tail: str) -> tuple[np.ndarray, np.ndarray]:
        """Of head + tail and of head + other_tail; the common head is parsed once."""
        known: set[str] = set()
        shared: list[str] = []
        rest = parse(head, known, "", shared)
        low = self.low(shared)
        out = []
        for end, phrases in ((tail, known.copy()), (other_tail, known)):
            new: list[str] = []
            last = parse(end, phrases, rest, new)
            out.append(np.minimum(low, self.low(new + [last] if last else new)))
        return out[0], out[1]


def written(low: np.ndarray, text: str) -> str:
    return (low & np.uint32(0xFFFF)).astype(">u2").tobytes().hex() if text else ""


def likeness(one: str, two: str) -> float:
    """Share of equal places of two fingerprints."""
    if not one or not two:
        return float(one == two)
    a, b = (np.frombuffer(bytes.fromhex(x), ">u2") for x in (one, two))
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs but the text, and `fingerprint`."""
    maker = Fingerprints()

    def make(texts):
        return {"fingerprint": [written(maker.of(t or ""), t or "") for t in texts]}

    return map_lists(docs.drop("fingerprint"), make, "fingerprint string", keep=[c for c in docs.columns if c not in (text, "fingerprint")])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slices = min(MOST_SLICES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / slices for i in range(1, slices)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, 100 * slices).alias("cuts"), F.max("doc_id").alias("top")).first()
    # Bounds are ids of the table; the list has MOST_SLICES entries at most.
    bounds = sorted({*(found.cuts or []), found.top} - {None})
    edges = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    own = F.size(F.filter(edges, lambda b: b < F.col("doc_id")))
    above = F.when(own + 1 < len(bounds), own + 1).otherwise(0)
    place = F.array(
        F.struct(own.alias("slice"), F.lit(1).alias("real")),
        F.when(F.array_contains(edges, F.col("doc_id")), F.struct(above.alias("slice"), F.lit(0).alias("real"))),
    )
    dealt = (
        docs.withColumn("place", F.explode(F.filter(place, lambda p: p.isNotNull())))
        .select("place.slice", "place.real", "doc_id", "text")
        .repartition(max(1, len(bounds)), "slice")
        .sortWithinPartitions("slice", "real", F.col("doc_id").asc_nulls_first(), "text")
    )
    out = StructType.fromDDL(
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    arrow = to_arrow_schema(out)
    maker = Fingerprints()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = None, ("", "")
        for batch in batches:
            rows = []
            for part, real, doc, text in zip(*(batch.column(c).to_pylist() for c in ("slice", "real", "doc_id", "text")), strict=True):
                if part != at:
                    at, before = part, ("", "")
                if not real:
                    before = (text, written(maker.of(text), text))
                    continue
                n = len(text)
                k = n // 3
                head, new_tail = text[: n - k], before[0][:k]
                one, two = maker.of_both(head, text[n - k :], new_tail)
                edited = head + new_tail
                mine, other = written(one, text), written(two, edited)
                digest = hashlib.sha256(edited.encode()).hexdigest()
                rows.append((doc, n, digest, mine, other, likeness(mine, other), likeness(mine, before[1])))
                before = (text, mine)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, out)
