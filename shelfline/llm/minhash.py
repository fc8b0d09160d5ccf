"""Near-duplicate documents by b-bit MinHash.

Method. A document is its set of distinct five-word shingles. 256 permutations give 256 minima. Bands of five
full minima name candidate buckets; of every minimum only the low four bits are kept, packed into 16 longs.
Matching bits, corrected for chance collisions of four-bit values, estimate the similarity of a candidate pair;
pairs far below the threshold go, the rest are confirmed on their full sets.

Equal sets are one class from the start. In a bucket every class is tried against one leader, three times with
different leaders; the confirmed links join classes to components. Only classes which then are outside the
component of most members of the bucket (outliers) are compared, by bit counts, with the other components in
that bucket, and then on full sets; of all these comparisons only true links become rows. So no link between
different texts is lost, while a bucket of near copies costs a few rows per member.

Two sets of similarity 0.75 miss each other in all 51 bands with probability 1e-6.

Defined results: null and empty texts have an empty set, are linked with nothing and are kept; repeated rows are
one class; rows with a null doc_id take part, and component_id is null only where no row of a component has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import BATCH, U64, byte_words, map_lists, minima, mixed, numbered, renamed, signed, small_side, spread, word_hashes

SHINGLE = 5
SIMILARITY = 75  # percent
PERMUTATIONS = 256
BAND = 5
BITS = 4
#: Estimates below the threshold by this many standard deviations are not confirmed on full sets.
MARGIN = 5
#: Bands in which a pair is compared once, whatever further bands it shares.
PILOTS = 16
#: Rounds in which a bucket's members are tried against one of them, before outliers are tried against all.
STAR_ROUNDS = 3
#: Rows of two numbers each (links, labels) that one task works off without a shuffle.
ROWS_PER_TASK = 200_000
FIXED = U64(0x100000001B3)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text of fewer words is one shingle, one without words none."""
    words = word_hashes(byte_words(text))
    n = len(words)
    if n == 0:
        return words
    k = min(n, size)
    out = np.full(n - k + 1, U64(k))
    for i in range(k):
        out = mixed(out * FIXED + words[i : n - k + 1 + i])
    return np.unique(out)


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into 64-bit words."""
    per = 64 // BITS
    parts = (low & np.uint32(2**BITS - 1)).astype(U64).reshape(-1, per)
    return (parts << (np.arange(per, dtype=U64) * U64(BITS))).sum(axis=1, dtype=U64)


def bands(low: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name per band of BAND full minima; the band's number is part of the name."""
    rows = low[: len(low) // BAND * BAND].reshape(-1, BAND).astype(U64)
    key = mixed(np.arange(1, len(rows) + 1, dtype=U64))
    for i in range(BAND):
        key = mixed(key * FIXED + rows[:, i])
    return key


def sketches(docs: DataFrame, size: int = SHINGLE, permutations: int = PERMUTATIONS, seed: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, n_shingles, set_key (128-bit hash of the whole set, null if empty), bands, sig."""
    a, b = spread(permutations, seed)

    def sketch(texts):
        out = {"n_shingles": [], "set_key": [], "bands": [], "sig": []}
        for text in texts:
            s = shingles(text, size)
            low = minima((s >> U64(32)).astype(np.uint32), a, b)
            out["n_shingles"].append(len(s))
            out["set_key"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["bands"].append(signed(bands(low)) if len(s) else None)
            out["sig"].append(signed(packed(low)) if len(s) else None)
        return out

    schema = "n_shingles bigint, set_key binary, bands array<bigint>, sig array<bigint>"
    return map_lists(docs.select(*keep, "text"), sketch, schema, keep=list(keep))


def full_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """set_key and the whole set of shingle hashes, one row per different set."""

    def sets(texts):
        found = [shingles(t, size) for t in texts]
        return {"set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in found], "shingles": [signed(s) for s in found]}

    return map_lists(docs.select("text"), sets, "set_key binary, shingles array<bigint>").dropDuplicates(["set_key"])


def estimated(sig_a: str, sig_b: str, permutations: int = PERMUTATIONS) -> Column:
    """Similarity from packed signatures: differing bits are folded to one per minimum and counted; the share
    2**-BITS of unequal minima whose low bits agree by chance is taken out."""
    fold = int("0x" + "1" * 16, 16)
    differ = F.lit(0)
    for i in range(permutations * BITS // 64):
        x = F.col(sig_a)[i].bitwiseXOR(F.col(sig_b)[i])
        any_bit = x
        for s in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(fold)))
    chance = 2.0**-BITS
    return (F.lit(1.0) - differ / F.lit(float(permutations)) - chance) / (1 - chance)


def _comparable(n_a: Column, n_b: Column, similarity: int) -> Column:
    """Sets whose sizes alone rule out the similarity need no look."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * similarity


def near_estimate(similarity: int, permutations: int) -> float:
    """Least estimate that is still tried on full sets."""
    p = similarity / 100
    match = p + (1 - p) * 2.0**-BITS
    return p - MARGIN * (match * (1 - match) / permutations) ** 0.5 / (1 - 2.0**-BITS)


def promising(pairs: DataFrame, classes: DataFrame, similarity: int, permutations: int) -> DataFrame:
    """Pairs (a, b) whose estimate is near enough."""
    sig = classes.select("cid", "sig")
    return (
        pairs.join(sig.toDF("a", "sig_a"), "a")
        .join(sig.toDF("b", "sig_b"), "b")
        .filter(estimated("sig_a", "sig_b", permutations) >= near_estimate(similarity, permutations))
        .select("a", "b")
    )


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """Pairs (a, b) of classes that pass the test on their full sets. The sets are made anew, for the classes in
    question only, from the text of one document each."""
    near = cut(pairs, "near")
    sets = sets_of(near.select(F.col("a").alias("cid")).union(near.select("b")), classes, docs, size)
    return (
        near.join(sets.toDF("b", "s_b"), "b")
        .join(sets.toDF("a", "s_a"), "a")
        .filter(_similar("s_a", "s_b", similarity))
        .select("a", "b")
    )


def sets_of(cids: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """cid and its whole set of shingles."""
    wanted = cut(cids.distinct().join(classes.select("cid", "set_key", "place"), "cid"), "wanted")
    # Each class has its set made from one text, found by the hash of its row; texts move only if the list is too long to broadcast.
    texts = docs.select(row_place().alias("place"), "text")
    found = full_sets(texts.join(small_side(wanted.select("place")), "place", "left_semi").dropDuplicates(["place"]), size)
    return cut(wanted.select("cid", "set_key").join(found, "set_key").select("cid", "shingles"), "sets")


def row_place() -> Column:
    """Hash of a row's id and text: where a class finds its text again. Rows that share it by chance are told apart by
    the hash of their whole set."""
    return F.xxhash64("doc_id", "text")


def _similar(a: str, b: str, similarity: int) -> Column:
    return F.size(F.array_intersect(a, b)) * (100 + similarity) >= (F.size(a) + F.size(b)) * similarity


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, label: the smallest node reachable over the edges (a, b) and, if given, those that led to the labels
    `known`. Every node takes its smallest neighbour; the trees so made are followed to their roots by doubling, and the
    graph shrinks to its roots until no edge is left. Roots are never neighbours, so each round leaves at most half of
    the nodes. Up to ROWS_PER_TASK edges and labels take all their rounds in one task; others are dealt out, and each
    round is a few queries, whose plans the driver holds."""
    edges = cut(edges.filter("a <> b").distinct(), "edges")
    few, few_known = _few(edges), known if known is None else _few(known)
    if few is not edges and (known is None or few_known is not known):
        # A label is an edge to the smallest node of its component.
        ends = few.select("a", "b") if known is None else few.select("a", "b").union(few_known.select("node", "label"))
        return cut(ends.coalesce(1).mapInArrow(_rooted, "node bigint, label bigint"), "labels")
    edges, known = few, few_known
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if known is None:
        labels = labels.withColumn("label", F.col("node"))
    else:
        labels = labels.join(known, "node", "full").select("node", F.coalesce("label", "node").alias("label"))
        edges = _few(cut(_contracted(edges, known), "edges"))
    labels = _few(cut(labels, "labels"))
    while not edges.isEmpty():
        ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = edges.select(F.explode(ends).alias("end")).select(F.col("end.a").alias("v"), "end.b")
        up = _few(cut(both.groupBy("v").agg(F.least(F.min("b"), F.col("v")).alias("up")), "up"))
        while True:
            above = up.select(F.col("v").alias("up"), F.col("up").alias("top"))
            jumped = cut(up.join(above, "up").select("v", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            up = _few(jumped.select("v", "up"))
            if jumped.filter("moved").isEmpty():
                break
        edges = _few(cut(_contracted(edges, up.toDF("node", "label")), "edges"))
        labels = labels.join(up.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        labels = _few(cut(labels, "labels"))
    return labels


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label from the edges of one task: roots take their smallest neighbouring root until none is left."""
    ends = [np.stack([np.asarray(batch.column(i), np.int64) for i in (0, 1)]) for batch in batches if batch.num_rows]
    nodes, place = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), return_inverse=True)
    a, b = place.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):
        up = root.copy()
        np.minimum.at(up, a, b)
        np.minimum.at(up, b, a)
        while (above := up[up]).tobytes() != up.tobytes():
            up = above
        root = up[root]
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    for i in range(0, len(nodes), BATCH):
        columns = [pa.array(nodes[i : i + BATCH]), pa.array(nodes[root[i : i + BATCH]])]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "label"])


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the labels of their ends; an end without a label stays."""
    to_a, to_b = labels.toDF("a", "to_a"), labels.toDF("b", "to_b")
    a, b = F.coalesce("to_a", "a"), F.coalesce("to_b", "b")
    ends = edges.join(to_a, "a", "left").join(to_b, "b", "left")
    return ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()


def _few(written: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """A written table of two numbers a row, in one partition if it has few rows."""
    return written.coalesce(1) if written.count() <= rows else written


def links(classes: DataFrame, docs: DataFrame, size: int, similarity: int, permutations: int) -> DataFrame:
    """node, label: the component of every class that has a link."""
    spots = classes.select("cid", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = spots.groupBy("bucket").count().filter("count > 1").select("bucket")
    sig = classes.select("cid", "sig", F.slice("bands", 1, PILOTS).alias("pilots"))
    members = cut(spots.join(shared, "bucket"), "members")
    labels = None
    for turn in range(STAR_ROUNDS):
        placed = _placed(members, labels)
        by = F.col("cid") if turn == 0 else F.xxhash64("cid", "bucket", F.lit(turn))
        lead = placed.groupBy("bucket").agg(F.min_by(F.struct("cid", "n", "label"), by).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high"))
        lead = lead.filter("low <> high").select("bucket", F.col("lead.cid").alias("a"), F.col("lead.n").alias("n_a"), F.col("lead.label").alias("label_a"))
        star = (
            placed.select("bucket", F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"))
            .join(lead, "bucket")
            .filter((F.col("label_a") != F.col("label_b")) & _comparable(F.col("n_a"), F.col("n_b"), similarity))
            .select("a", "b")
            .distinct()
        )
        labels = components(confirmed(promising(star, classes, similarity, permutations), classes, docs, size, similarity), labels)
    placed = _placed(members, labels)
    # The label most members of a bucket have; the others are outliers, each against all other labels there.
    most = placed.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
    placed = placed.join(most.filter("labels > 1").select("bucket", "most"), "bucket")
    # Signatures are fetched for the buckets that are left only.
    placed = cut(placed.withColumn("out", F.col("label") != F.col("most")).drop("most").join(sig, "cid"), "placed")
    left = placed.filter("out").select("bucket", F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"), F.col("sig").alias("sig_a"), "band", F.col("pilots").alias("p_a"))
    right = placed.select(F.col("bucket").alias("place"), F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("sig").alias("sig_b"), "out", F.col("pilots").alias("p_b"))
    near = (
        (F.col("bucket") == F.col("place"))
        & (F.col("label_a") != F.col("label_b"))
        & (~F.col("out") | (F.col("a") < F.col("b")))
        & _comparable(F.col("n_a"), F.col("n_b"), similarity)
    )
    # A pair that shares one of the first PILOTS bands is compared in the first such band only.
    for i in range(PILOTS):
        near = near & ((F.col("band") <= i) | (F.col("p_a")[i] != F.col("p_b")[i]))
    near = near & (estimated("sig_a", "sig_b", permutations) >= near_estimate(similarity, permutations))
    # Only members with a promising partner go on, with their full sets; only true links become rows.
    left = cut(left.join(right, near, "left_semi"), "left")
    right = cut(right.join(left, near, "left_semi"), "right")
    sets = sets_of(left.select(F.col("a").alias("cid")).union(right.select("b")), classes, docs, size)
    left, right = left.join(sets.toDF("a", "s_a"), "a"), right.join(sets.toDF("b", "s_b"), "b")
    linked = left.join(right, near & _similar("s_a", "s_b", similarity)).select("a", "b")
    return components(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), labels)


def _placed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of shared buckets with the component they are known to be in."""
    if labels is None:
        return members.withColumn("label", F.col("cid"))
    return cut(members.join(labels.toDF("cid", "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid")), "placed")


def _named(sketched: DataFrame, docs: DataFrame, size: int, similarity: int, permutations: int) -> DataFrame:
    """set_key, rep and component (label) of every class of equal sets."""
    classes = cut(
        sketched.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.min("place").alias("place"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    joined = links(classes, docs, size, similarity, permutations)
    named = classes.select("cid", "set_key", "rep").join(joined.toDF("cid", "label"), "cid", "left")
    return named.select("set_key", "rep", F.coalesce("label", "cid").alias("label"))


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, permutations: int = PERMUTATIONS, seed: int = 1
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least
    `similarity` percent), kept (doc_id = component_id)."""
    docs = docs.select("doc_id", "text")
    sketched = cut(sketches(docs.withColumn("place", row_place()), size, permutations, seed, keep=("doc_id", "place")), "sketches")
    named = _named(sketched, docs, size, similarity, permutations)
    roots = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    homes = named.join(roots, "label").select("set_key", "component_id")
    return (
        sketched.select("doc_id", "n_shingles", "set_key")
        .join(homes, "set_key", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(
    docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, permutations: int = PERMUTATIONS, seed: int = 1
) -> DataFrame:
    """The documents with one row of each group of near copies, also among rows that share a doc_id or have none: the
    one of the smallest doc_id (null last), then of the smallest hash of its text. Texts without words stay, equal rows
    of them once."""
    columns = docs.columns
    doc_id, text = (f"_{columns.index(c)}" for c in ("doc_id", "text"))
    rows = numbered(docs).withColumn("text_key", F.unhex(F.md5(F.col(text).cast("binary"))))
    keyed = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "text_key")
    sketched = cut(sketches(keyed.withColumn("place", row_place()), size, permutations, seed, keep=("doc_id", "place", "text_key")), "sketches")
    named = _named(sketched, keyed.select("doc_id", "text"), size, similarity, permutations)
    # Rows of one id and text are one key, so that a key of any size is folded before the shuffle.
    keys = cut(sketched.groupBy("doc_id", "text_key").agg(F.first("set_key").alias("set_key"), F.count("*").alias("rows")), "keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "rows")).alias("first")
    chosen = keys.join(named.select("set_key", "label"), "set_key").groupBy("label").agg(first).select("first.doc_id", "first.text_key", "first.rows")
    chosen = chosen.union(keys.filter("set_key is null").select("doc_id", "text_key", "rows"))
    chosen = cut(chosen, "chosen").toDF("chosen_id", "chosen_text", "chosen_rows")
    kept = rows.join(small_side(chosen), F.col(doc_id).eqNullSafe(F.col("chosen_id")) & F.col("text_key").eqNullSafe(F.col("chosen_text")))
    single = kept.filter("chosen_rows = 1")
    several = kept.filter("chosen_rows > 1").dropDuplicates([doc_id, text])
    return renamed(single.unionByName(several), columns)
