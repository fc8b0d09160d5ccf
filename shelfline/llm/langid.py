"""Language identification by the nearest of several centroids per language.

Method. A text is a vector of its byte n-grams (one to three bytes of the lower-cased text with all but letters taken
for a space), hashed into DIMENSIONS places, weighted by 1 + log(count) times IDF and scaled to length one. Document
frequencies are counted over all documents to learn from. The centroids come from spherical k-means within each
language, on a bounded sample: ROWS texts of a language (those of the smallest hashes), MOST_ROWS in all; a cluster of
less than a twentieth of its language's sample is noise and gives no centroid. A text gets the language of the
centroid of greatest cosine. It is rejected where that cosine is below FAR times the tenth percentile among sample
documents of about its number of n-grams.

Defined results: null texts and texts without a letter are `und` with score 0 and are rejected; with nothing to learn
from, every text is; rows with a null lang are not learned from; equal cosines go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, give_back, map_lists, numbered, renamed

DIMENSIONS = 4096
ROWS, MOST_ROWS = 400, 8000
CENTROIDS = 4
FAR = 0.6
BINS = 24
UNKNOWN = "und"
#: Sparse counts on their way to the driver: most significant byte first.
COUNTS = np.dtype(">u4")
SCHEMA = "lang_pred string, score double, rejected boolean"
LETTER = regex.compile(r"\p{L}")
KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str | None) -> np.ndarray | None:
    """Count of each place's n-grams; None for a text without letters."""
    if not text or not LETTER.search(text):
        return None
    raw = b" " + b" ".join(text.lower().encode().translate(KEEP).split()) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:] + np.uint32(1 << 10)
    three = two[:-1] * np.uint32(263) + x[2:] + np.uint32(1 << 20)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    hashed = np.concatenate([x, two, three]) * np.uint32(2654435761) >> shift
    return np.bincount(hashed, minlength=DIMENSIONS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of counts."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def size_bin(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=-1) + 1).astype(int), BINS - 1)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # cosine below which a text of a size is rejected

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        out = {"lang_pred": [], "score": [], "rejected": []}
        for text in texts:
            counts = grams(text) if self.langs else None
            if counts is None:
                best, score, rejected = UNKNOWN, 0.0, True
            else:
                cosines = self.centroids @ weighted(counts, self.idf)
                i = int(cosines.argmax())
                best, score = self.langs[self.owner[i]], float(np.clip(cosines[i], 0, 1))
                rejected = score < self.least[size_bin(counts)]
            out["lang_pred"].append(best)
            out["score"].append(score)
            out["rejected"].append(bool(rejected))
        return out


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each place over all documents, and their number. Tasks send one row per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = grams(text)
                if counts is not None:
                    seen += counts > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[n], seen]))], names=["place", "n"])

    found = np.zeros(DIMENSIONS + 1)
    for r in docs.select("text").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        found[r.place + 1] = r.n
    return found[1:], int(found[0])


def sample(docs: DataFrame) -> list:
    """Up to ROWS different texts of each language as sparse counts: lang, place, n (arrays of COUNTS as bytes, which
    the driver holds as they are)."""
    # The texts of the smallest hashes of each language, equal texts once.
    hashed = docs.select("lang", "text", F.xxhash64("text", F.lit("sample")).alias("hash"))
    hashes = hashed.select("lang", "hash").distinct()
    langs = hashes.select("lang").distinct().count()
    if not langs:
        return []
    rows = min(ROWS, MOST_ROWS // langs + 1)
    order = Window.partitionBy("lang").orderBy("hash")
    few = hashes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows)
    upto = few.groupBy("lang").agg(F.max("hash").alias("upto")).withColumnRenamed("lang", "of")
    upto = F.broadcast(upto) if langs <= BROADCAST_ROWS else upto
    drawn = hashed.join(upto, (F.col("lang") == F.col("of")) & (F.col("hash") <= F.col("upto"))).dropDuplicates(["lang", "hash"])

    def run(texts):
        found = [grams(t) for t in texts]
        places = [np.flatnonzero(c) if c is not None else None for c in found]
        counts = [c[p] if c is not None else None for c, p in zip(found, places, strict=True)]
        return {"place": [_raw(p) for p in places], "n": [_raw(c) for c in counts]}

    return map_lists(drawn.select("lang", "text"), run, "place binary, n binary", keep=["lang"]).filter("place is not null").collect()


def _raw(x: np.ndarray | None) -> bytes | None:
    return None if x is None else x.astype(COUNTS).tobytes()


def _dense(rows: list) -> np.ndarray:
    """The counts of sampled texts, a row each."""
    counts = np.zeros((len(rows), DIMENSIONS))
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r.place, COUNTS)] = np.frombuffer(r.n, COUNTS)
    return counts


def clustered(v: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; starts are chosen farthest first."""
    centers = [v.mean(axis=0)]
    centers[0] /= np.linalg.norm(centers[0])
    nearest = v @ centers[0]
    while len(centers) < min(k, len(v)):
        centers.append(v[nearest.argmin()])
        nearest = np.maximum(nearest, v @ centers[-1])
    c = np.array(centers)
    for _ in range(steps):
        owner = (v @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (owner == i).any():
                m = v[owner == i].sum(axis=0)
                c[i] = m / np.linalg.norm(m)
    # A cluster of less than a twentieth of the language is noise.
    sizes = np.bincount((v @ c.T).argmax(axis=1), minlength=len(c))
    return c[sizes * 20 >= len(v)] if (sizes * 20 >= len(v)).any() else c


def fitted(docs: DataFrame) -> Model:
    """A model from the texts and languages of docs (columns doc_id, text, lang)."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen, n = frequencies(docs)
    idf = np.log((1 + n) / (1 + seen)) + 1
    # Bytes of COUNTS are in the order of their numbers. One language's vectors are held at a time.
    rows = sorted(sample(docs), key=lambda r: (r.lang, r.place, r.n))
    by_lang = {lang: list(of) for lang, of in groupby(rows, key=lambda r: r.lang)}
    langs = list(by_lang)
    parts = [clustered(weighted(_dense(of), idf), CENTROIDS) for of in by_lang.values()]
    centroids = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS))
    owner = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
    least = np.zeros(BINS)
    if len(rows):
        best = np.concatenate([(weighted(_dense(of), idf) @ centroids.T).max(axis=1) for of in by_lang.values()])
        bins = np.concatenate([size_bin(_dense(of)) for of in by_lang.values()])
        known = [(b, FAR * float(np.quantile(best[bins == b], 0.1))) for b in range(BINS) if (bins == b).sum() >= 20]
        for b in range(BINS):  # sizes not seen often enough take the next smaller one's value
            least[b] = min((x for k, x in known if k >= b), default=least[b - 1] if b else 0.0) if any(k <= b for k, _ in known) else 0.0
    del rows, by_lang
    give_back()
    return Model(langs, idf, centroids, owner, least)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, with lang_pred, score and rejected (columns of these names are replaced)."""
    made = ("lang_pred", "score", "rejected")
    keep = [c for c in docs.columns if c not in (text, *made)]
    return map_lists(docs, model.predict, SCHEMA, keep=keep, read=[text])


def accepted(docs: DataFrame, learn: Column) -> DataFrame:
    """The documents whose language is known for sure enough; a missing lang is filled in. learn: rows to learn from."""
    model = fitted(docs.filter(learn).select("doc_id", "text", "lang"))
    columns = docs.columns
    rows = numbered(docs)
    lang = f"_{columns.index('lang')}"
    named = map_lists(rows, model.predict, SCHEMA, keep=rows.columns, read=[f"_{columns.index('text')}"]).filter("not rejected")
    return renamed(named.withColumn(lang, F.coalesce(lang, "lang_pred")), columns)
