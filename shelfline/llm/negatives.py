"""Hard negatives by cover trees over norm-augmented vectors.

Method. Vectors are whole numbers; a score is their inner product. A vector x becomes (x, sqrt(M^2 - |x|^2)), M being the
greatest norm of its block, so that all lie on one sphere and a higher inner product with an anchor (a, 0) is a smaller distance.
A block's cover tree has levels: the children of a node are chosen farthest first from its own centre on, until all its
points are within half its covering radius of a child. The covering radius r bounds the scores in a node: they differ from the
centre's by at most |a| r. The anchors of a pack descend together: the node of the highest bound comes first, with the windows
of scores that it may touch and that hold less already; its children's bounds, and exactly the points of a leaf, are scored
for these in one matrix product. Where points are spread so evenly that a node would need a centre for every few of them, it
is a leaf: bounds would skip nothing and cost a pass over all points each.

Rows with the same label and vector are one class with its first ids, which are all that can be returned. Classes are
dealt to blocks of about BLOCK, anchors (one per class) to packs of about PACK. Every pack meets every block that can
hold partners: for positives the blocks of its label, for negatives blocks of all labels. A unit of work is a block and
a team of TEAM packs: the block's tree is built once, the packs stream by. Each meeting returns the first few of an
anchor; these are merged by a ranking per anchor, which prunes inside each task. The work grows with anchors times blocks less what the
radii skip (little for vectors spread evenly over many dimensions).

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part; repeated rows count
once; rows of one id with other labels or vectors are rows of their own; shorter vectors are as if filled up with zeros; an anchor
without positives or a positive without negatives has no rows; windows of negative scores are empty. Components of more than 64 bits
are cut to 64, scores beyond 53 bits are computed exactly but slowly.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import pieces, small_batches

#: Classes in a block, anchors in a pack and packs in a team, on average.
BLOCK, PACK, TEAM = 4096, 128, 64
#: Nodes of so many points are leaves; so are those whose points are spread so evenly that half their radius would need
#: a centre for every LEAF points, whose parts would stay in this leaf.
LEAF = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class CoverTree:
    """Points of one block. points: rows of whole numbers; ids: each point's ids, ascending."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, ids: list[list[int]]):
        self.points, self.labels, self.ids = points, labels, ids
        self.first = np.array([i[0] for i in ids], np.int64)
        rough = points.astype(np.float64)
        square = (rough * rough).sum(axis=1)
        self.top = float(np.sqrt(square.max(initial=0.0)))
        self.lifted = np.column_stack([rough, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))])
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []
        self._grow()

    def _far(self, among: np.ndarray, centre: int) -> np.ndarray:
        """Distances of the vectors `among` from a point."""
        away = among - self.lifted[centre]
        return np.sqrt(np.einsum("ij,ij->i", away, away))

    def _node(self, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append(np.zeros(0, np.int64))
        self.leaf.append(np.zeros(0, np.int64))
        return len(self.centre) - 1

    def _grow(self) -> None:
        if not len(self.points):
            return
        every = np.arange(len(self.points))
        far = self._far(self.lifted, 0)
        todo = [(self._node(0, float(far.max())), every, far)]
        while todo:
            node, points, near = todo.pop()
            radius = self.radius[node]
            if len(points) <= LEAF or radius == 0.0:
                self.leaf[node] = points
                continue
            # Farthest first: near is the distance to the closest centre so far, owner that centre.
            owner, centres, vectors = np.zeros(len(points), np.int64), [self.centre[node]], self.lifted[points]
            while near.max() > radius / 2 and len(centres) * LEAF <= len(points):
                centres.append(int(points[near.argmax()]))
                far = self._far(vectors, centres[-1])
                closer = far < near
                owner[closer], near[closer] = len(centres) - 1, far[closer]
            if near.max() > radius / 2:
                self.leaf[node] = points
                continue
            order = np.argsort(owner, kind="stable")
            parts = np.split(order, np.searchsorted(owner[order], np.arange(1, len(centres))))
            small = [part for part in parts if len(part) <= LEAF]
            self.leaf[node] = points[np.concatenate(small)] if small else self.leaf[node]
            found = []
            for centre, part in zip(centres, parts, strict=True):
                if len(part) > LEAF:
                    found.append(self._node(centre, float(near[part].max())))
                    todo.append((found[-1], points[part], near[part]))
            self.children[node] = np.array(found, np.int64)
        self.radii = np.array(self.radius)
        self.centres = self.lifted[self.centre, :-1]

    def first_in(self, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, other_than: int | None = None) -> list[list[tuple[int, int]]]:
        """`first_of` for one anchor."""
        return self.first_of(anchor[None, :], [windows], k, None if other_than is None else [other_than])[0]

    def first_of(
        self, anchors: np.ndarray, windows: list[list[tuple[int, int]]], k: int, other_than: list[int] | None = None
    ) -> list[list[list[tuple[int, int]]]]:
        """For each anchor and each of its windows [low, high] of scores the first k (score, id), by higher score, then
        smaller id, among points of other labels than the anchor's `other_than`. All descend together, so that a node
        costs one matrix product for the windows that still ask it."""
        flat = [w for some in windows for w in some]
        of = np.repeat(np.arange(len(windows)), [len(some) for some in windows])
        best: list[list[tuple[int, int]]] = [[] for _ in flat]
        if len(self.points) and flat:
            self._descend(anchors, of, flat, k, None if other_than is None else np.array(other_than, np.int64)[of], best)
        ends = np.cumsum([len(some) for some in windows]).tolist()
        return [best[end - len(some) : end] for some, end in zip(windows, ends, strict=True)]

    def _descend(self, anchors: np.ndarray, of: np.ndarray, windows: list, k: int, other_than: np.ndarray | None, best: list) -> None:
        """of: each window's anchor; other_than: each window's label."""
        rough = anchors.astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", rough, rough))[of]
        slack = 1.0 + 1e-9 * norm * self.top
        low, high = (np.array([w[i] for w in windows], anchors.dtype) for i in (0, 1))
        rough_low, rough_high = low.astype(np.float64), high.astype(np.float64)
        heap = [(-np.inf, 0, np.arange(len(of)), norm * self.top + slack)]
        while heap:
            _, node, asking, upper = heappop(heap)
            asking = asking[upper >= rough_low[asking]]
            if not len(asking):
                continue
            if len(self.leaf[node]):
                self._verify(self.leaf[node], asking, anchors, of, low, high, k, other_than, best)
                rough_low[asking] = low[asking].astype(np.float64)
            inner = self.children[node]
            if len(inner):
                who, place = np.unique(of[asking], return_inverse=True)
                score = (self.centres[inner] @ rough[who].T)[:, place]
                reach = self.radii[inner][:, None] * norm[asking] + slack[asking]
                upper = score + reach
                open_ = (upper >= rough_low[asking]) & (score - reach <= rough_high[asking])
                for i in np.flatnonzero(open_.any(axis=1)).tolist():
                    reached = upper[i, open_[i]]
                    heappush(heap, (-float(reached.max()), int(inner[i]), asking[open_[i]], reached))

    def _verify(
        self, part: np.ndarray, asking: np.ndarray, anchors: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, other_than: np.ndarray | None, best: list
    ) -> None:
        """Scores the points of a leaf with the anchors of the windows `asking`; raises `low` to the last of a full list."""
        who, place = np.unique(of[asking], return_inverse=True)
        score = (anchors[who] @ self.points[part].T)[place]
        fits = (score >= low[asking][:, None]) & (score <= high[asking][:, None])
        if other_than is not None:
            fits &= self.labels[part] != other_than[asking][:, None]
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            # The first k points by score and first id hold the first k of all.
            j, at = asking[i], np.flatnonzero(fits[i])
            found, ids = score[i, at], self.first[part[at]]
            if score.dtype == object:
                order = sorted(range(len(at)), key=lambda i, found=found, ids=ids: (-found[i], ids[i]))[:k]
            else:
                order = np.lexsort((ids, -found))[:k].tolist()
            more = [(int(found[x]), one) for x in order for one in self.ids[part[at[x]]]]
            best[j] = sorted(best[j] + more, key=lambda x: (-x[0], x[1]))[:k]
            if len(best[j]) == k:
                low[j] = max(low[j], best[j][-1][0])


def matrix(lists: list[list[int]], width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(lists), width), kind)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def quantised(rows: DataFrame, scale: int, vec_id: str = "vec_id", label: Column | None = None, vector: str = "embedding") -> DataFrame:
    """id, label and v (components floor(scale * x)) of the rows that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    label = F.col("label") if label is None else label
    found = rows.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("x"), sound.alias("sound"))
    found = found.filter("id is not null and label is not null and x is not null and sound")
    return found.select("id", "label", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v")).distinct()


def _meetings(candidates: DataFrame, packs: DataFrame, units: int, width: int, kind: type, k: int, other: bool) -> DataFrame:
    """Lets every pack meet the candidates of its unit. candidates: block, team, label, v, ids. packs: block, team and
    asked (cid, label, v, windows). Returns cid, of, score, id: the first k of every window and block."""
    spark = candidates.sparkSession
    left = candidates.select("block", "team", F.lit(0).alias("kind"), "label", "v", "ids", F.lit(None).cast(packs.schema["asked"].dataType).alias("asked"))
    right = packs.select("block", "team", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("label"), F.lit(None).cast("array<bigint>").alias("v"), F.lit(None).cast("array<bigint>").alias("ids"), "asked")
    parts = max(1, min(units, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = left.unionByName(right).repartition(parts, "block", "team").sortWithinPartitions("block", "team", "kind")
    out = pa.schema([("cid", pa.int64()), ("of", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, tree, waiting = None, None, ([], [], [])
        for batch in (part for whole in batches for part in pieces(whole)):
            found = []
            for row in batch.to_pylist():
                if (row["block"], row["team"]) != unit:
                    unit, tree, waiting = (row["block"], row["team"]), None, ([], [], [])
                if not row["kind"]:
                    for kept, c in zip(waiting, ("v", "label", "ids"), strict=True):
                        kept.append(row[c])
                    continue
                if tree is None:
                    tree = CoverTree(matrix(waiting[0], width, kind), np.array(waiting[1], np.int64), waiting[2])
                    waiting = ([], [], [])
                asked = row["asked"]
                windows = [[(w["low"], w["high"]) for w in a["windows"]] for a in asked]
                first = tree.first_of(matrix([a["v"] for a in asked], width, kind), windows, k, [a["label"] for a in asked] if other else None)
                for a, per_window in zip(asked, first, strict=True):
                    found += [(a["cid"], w["of"], min(max(score, LEAST), MOST), one) for w, best in zip(a["windows"], per_window, strict=True) for score, one in best]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4, schema=out)

    return small_batches(dealt).mapInArrow(run, "cid bigint, of bigint, score bigint, id bigint")


def _packed(asked: DataFrame, by: list[str], packs: Column) -> DataFrame:
    """Anchors (cid, label, v, windows) dealt to packs: `by` columns, pack, asked."""
    dealt = asked.withColumn("pack", F.pmod(F.xxhash64("cid", F.lit("pack")), packs))
    return dealt.groupBy(*by, "pack").agg(F.collect_list(F.struct("cid", "label", "v", "windows")).alias("asked"))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: id, label, v (see `quantised`);
    anchors: which rows, as a condition on id. A negative's score is `low` to `high` percent of its positive's."""
    rows = cut(rows.select("id", "label", "v"), "rows")
    few = max(positives + 1, negatives)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))).filter(F.col("rank") <= few)
    classes = ranked.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id())
    classes = cut(classes, "classes")
    asked = cut(rows.filter(anchors).join(classes.select("label", "v", "cid"), ["label", "v"]).select("id", "cid"), "asked")
    wanted = classes.drop("ids").join(asked.select("cid").distinct(), "cid", "left_semi")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max("v")).alias("most"), F.min(F.array_min("v")).alias("least")).first()
    width, top = size.width or 0, max(size.most or 0, -(size.least or 0))
    # Doubles hold scores below 2^53 exactly.
    kind = np.float64 if top * top * max(width, 1) < 1 << 53 else object

    # Positives: the blocks of a label against the packs of that label.
    per_label = classes.groupBy("label").agg(F.count("*").alias("n")).join(wanted.groupBy("label").agg(F.count("*").alias("m")), "label")
    plan = cut(per_label.select("label", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("m") / PACK).alias("packs")).withColumn("teams", F.ceil(F.col("packs") / TEAM)), "plan")
    name = lambda number: F.struct("label", number.alias("number"))
    candidates = classes.join(plan, "label").withColumn("team", F.explode(F.sequence(F.lit(0), F.col("teams") - 1)))
    candidates = candidates.withColumn("block", name(F.pmod(F.xxhash64("cid"), F.col("blocks"))))
    open_window = F.array(F.struct(F.lit(0).cast("bigint").alias("of"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    packs = _packed(wanted.withColumn("windows", open_window).join(plan, "label"), ["label", "blocks"], F.col("packs"))
    packs = packs.withColumn("team", F.expr(f"pack div {TEAM}")).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    packs = packs.withColumn("block", name(F.col("number").cast("bigint")))
    units = plan.agg(F.sum(F.col("blocks") * F.col("teams"))).first()[0] or 0
    near = cut(_first(_meetings(candidates, packs, units, width, kind, positives + 1, False), ["cid"], positives + 1).select("cid", "score", "id"), "positives")

    # Negatives: blocks of all labels against all packs, with a window per positive score.
    score = F.col("score").cast("decimal(20,0)")
    window = F.struct(F.col("score").alias("of"), F.ceil(score * low / 100).cast("bigint").alias("low"), F.floor(score * high / 100).cast("bigint").alias("high"))
    windows = near.select("cid", window.alias("w")).filter("w.low <= w.high")
    windows = windows.groupBy("cid").agg(F.collect_set("w").alias("windows"))
    seeking = cut(wanted.join(windows, "cid"), "seeking")
    blocks, n_packs = -(-size.n // BLOCK), -(-seeking.count() // PACK)
    teams = -(-n_packs // TEAM)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(n, 1) - 1).cast("bigint")))
    candidates = classes.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(max(blocks, 1)))).withColumn("team", every(teams))
    packs = _packed(seeking, [], F.lit(max(n_packs, 1))).withColumn("team", F.expr(f"pack div {TEAM}")).withColumn("block", every(blocks))
    found = _meetings(candidates, packs, blocks * teams, width, kind, negatives, True)
    far = cut(_first(found, ["cid", "of"], negatives), "negatives")

    # Classes to their anchors: an anchor's positives are the first of its class but itself.
    own = asked.withColumnRenamed("id", "anchor_id").join(near.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), "cid").filter("anchor_id <> positive_id")
    order = Window.partitionBy("cid", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    own = own.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    far = far.withColumnsRenamed({"of": "positive_score", "id": "negative_id", "score": "negative_score"})
    return own.join(far, ["cid", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
