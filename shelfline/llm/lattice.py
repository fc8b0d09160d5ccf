"""Language-model scores by the subword lattice.

Method. An existing subword vocabulary is given (its path is a parameter). A word is begun by the mark that the
vocabulary uses for a word's begin, and its lattice holds every way to write it in pieces; a character without a piece
is written in byte pieces. The unigram weights of the pieces come from the documents to learn from: pieces of their
words in the vocabulary's own segmentation, counted over all of them. A forward recursion in log space sums
over all segmentations of a word; a text's probability is the product over its words and one end.

Beside it stands a plain word model: the sum of log10((c + 1) / (N + 1 * (V + 1))) over words and the end. Words are
counted over all documents to learn from, by a 64-bit hash. The COMMON most frequent words (a fixed number) are
sent to all tasks; the others' occurrences are joined with the counts, so no list of all words is ever in one place.

Defined results: a null or empty text is the end alone; with nothing to learn from, N, V and all counts are 0; every
row of a repeated doc_id is scored by itself; a null doc_id belongs to the part with remainder 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import byte_words, map_lists

COMMON = 200_000
MEMORY = 300_000
FLUSH = 500_000
#: Different words of so many texts are scored together.
CHUNK = 400_000
WORD, PIECE, DOCS, LENGTH = 0, 1, 2, 3
MARK = "▁"


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def as_text(word: bytes) -> str:
    return word.decode(errors="replace")


def counted(docs: DataFrame, path: str) -> DataFrame:
    """kind, key, n: occurrences of words (by hash) and of pieces (by number), number of documents and of words."""

    def rows(words: Counter) -> tuple[list, list, list]:
        pieces: Counter = Counter()
        found = list(words.items())
        for i in range(0, len(found), 10_000):
            part = found[i : i + 10_000]
            for (_, n), ids in zip(part, vocabulary(path).encode([as_text(w) for w, _ in part], num_threads=1), strict=True):
                for p in ids:
                    pieces[p] += n
        keys = [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w, _ in found]
        kinds = [WORD] * len(found) + [PIECE] * len(pieces)
        return kinds, keys + list(pieces), [n for _, n in found] + list(pieces.values())

    def batch(kinds, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        docs = length = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                found = byte_words(text)
                words.update(found)
                docs += 1
                length += len(found)
                if len(words) > FLUSH:
                    yield batch(*rows(words))
                    words.clear()
        yield batch(*rows(words))
        yield batch([DOCS, LENGTH], [0, 0], [docs, length])

    return docs.select("text").mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Lattice:
    """Log probability of words, summed over all their segmentations."""

    def __init__(self, path: str, counts: dict[int, int], ends: int):
        sp = vocabulary(path)
        size = sp.vocab_size()
        total = sum(counts.values()) + ends + size + 1
        log = [math.log((counts.get(i, 0) + 1) / total) for i in range(size)]
        self.end = math.log((ends + 1) / total)
        self.bytes = [log[sp.piece_to_id(f"<0x{b:02X}>")] for b in range(256)]
        #: Log probability of each piece; None for strings that only end pieces.
        self.pieces: dict[str, float | None] = {}
        for i in range(size):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            p = sp.id_to_piece(i)
            for k in range(1, len(p)):
                self.pieces.setdefault(p[k:], None)
            self.pieces[p] = log[i]

    def extend(self, forward: list[float], s: str) -> list[float]:
        """Append the log probability of each further prefix of s; forward[0] = 0 stands for the empty prefix."""
        get = self.pieces.get
        for end in range(len(forward), len(s) + 1):
            terms = []
            start = end - 1
            p = get(s[start:end], 0.0)
            if not p:  # a character that is no piece is written in bytes
                terms.append(forward[start] + sum(self.bytes[b] for b in s[start].encode(errors="replace")))
            while p != 0.0:
                if p is not None:
                    terms.append(forward[start] + p)
                start -= 1
                if start < 0:
                    break
                p = get(s[start:end], 0.0)
            if len(terms) == 1:
                forward.append(terms[0])
            else:
                high = max(terms)
                forward.append(high + math.log(sum([math.exp(t - high) for t in terms])))
        return forward

    def score(self, word: str) -> float:
        return self.extend([0.0], MARK + word)[-1]

    def score_sorted(self, words: list[str]) -> list[float]:
        """Scores of words in ascending order: each goes on from the prefix it shares with the one before."""
        out, forward, before = [], [0.0], ""
        for word in words:
            s = MARK + word
            del forward[len(commonprefix((before, s))) + 1 :]
            out.append(self.extend(forward, s)[-1])
            before = s
        return out


def frequent_from(words: DataFrame, most: int) -> int:
    """The least count for which no more than `most` words have it or more, from a histogram of a few hundred rows."""
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.max("n").alias("top")).orderBy(F.desc("step")).collect()
    least, left = (steps[0].top + 1 if steps else 1), most
    for i, r in enumerate(steps):
        left -= r.words
        if left < 0:
            break
        least = steps[i + 1].top + 1 if i + 1 < len(steps) else 1
    return least


def scored(docs: DataFrame, learn: Column, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    counts = cut(counted(docs.filter(learn), path), "counts")
    sums = {r.kind: r.n for r in counts.filter(F.col("kind") >= DOCS).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    ends = sums.get(DOCS, 0)
    # Pieces are bounded by the vocabulary, common words by their number.
    pieces = {r.key: r.n for r in counts.filter(F.col("kind") == PIECE).collect()}
    words = counts.filter(F.col("kind") == WORD)
    different = words.count() + (ends > 0)
    n_train = sums.get(LENGTH, 0) + ends
    common = words.filter(F.col("n") >= frequent_from(words, COMMON)).select("key", "n").collect()
    shared = spark.sparkContext.broadcast(({r.key: math.log10(r.n + 1) for r in common}, pieces))
    state: dict = {}

    def run(texts):
        if "lattice" not in state:
            state["lattice"], state["known"] = Lattice(path, shared.value[1], ends), {}
        out = {"n_tokens": [], "n_common": [], "common_sum": [], "score": [], "rare": []}
        start = 0
        while start < len(texts):
            stop, found, size = start, [], 0
            while stop < len(texts) and size < CHUNK:
                found.append(Counter(byte_words(texts[stop])))
                size += len(found[-1])
                stop += 1
            add(found, out)
            start = stop
        return out

    def add(found, out):
        lattice, known, frequent = state["lattice"], state["known"], shared.value[0]
        if len(known) > MEMORY:
            known.clear()
        new = sorted({w for c in found for w in c if w not in known})
        texts = [as_text(w) for w in new]
        for w, log in zip(new, lattice.score_sorted(texts), strict=True):
            key = xxhash.xxh3_64_intdigest(w) - (1 << 63)
            known[w] = (log, frequent.get(key), key)
        for words in found:
            total, n_common, log = 0.0, 0, lattice.end
            rare = []
            for w, times in words.items():
                score, common, key = known[w]
                log += times * score
                if common is not None:
                    total += times * common
                    n_common += times
                else:
                    rare += [key] * times
            out["n_tokens"].append(words.total() + 1)
            out["n_common"].append(n_common)
            out["common_sum"].append(total)
            out["score"].append(log / math.log(10))
            out["rare"].append(rare)

    schema = "n_tokens bigint, n_common bigint, common_sum double, score double, rare array<bigint>"
    first = map_lists(docs.select("doc_id", (~learn).alias("held_out"), "text"), run, schema, keep=["doc_id", "held_out"])
    first = cut(first.withColumn("row", F.monotonically_increasing_id()), "first")
    rare = (
        first.select("row", F.explode("rare").alias("key")).join(words.select("key", "n"), "key")
        .groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_sum"))
    )
    end = math.log10(ends + 1)
    norm = math.log10(n_train + different + 1)
    base = F.col("common_sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(norm)
    return first.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), "score",
    )
