"""Mixing sources to target weights by hierarchical budgets.

Method. Leaves are (domain, language, source). A budget of tokens goes down the tree by weight. A node can take no
more than its leaves hold in `epochs` passes; what it cannot take goes to its siblings by their weights, and only
what all siblings together cannot take reaches the level above. With siblings in ascending order of room per
weight, the full ones are those whose room is no more than an equal share (by weight) of what is left, so one
window per parent settles a level.

A leaf's budget is whole epochs and a prefix of one more. Equal rows of a leaf (id, text and tokens) are one group with a number of
copies. The order of an epoch is given by the md5 of seed, epoch number and the group; the prefix takes copy after
copy as long as the running sum of tokens stays within the rest. Running sums are taken in slices of that order (the
leading hexadecimal digits), each of which carries only its sum to the next, so a leaf of any size is spread over many
tasks; copies are counted before the shuffle, so a text repeated by a third of all rows is one row.

Only DataFrame functions are used. Defined results: null domain, lang or source are names of their own; rows without id, or of
one id, are told apart by their texts; leaves and nodes without a weight have weight 0 and get nothing; documents without tokens are in
every whole epoch of their leaf and in a prefix where their turn comes before the rest is used up; a budget beyond
all rooms takes every epoch of all leaves of positive weight. So a leaf's tokens are its budget or less by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import renamed, small_side

LEVELS = ("domain", "lang", "source")
#: Groups in a slice of a leaf's order, on average.
SLICE_ROWS = 2_000
#: Copies written out by a task at a time.
COPIES = 1_000
DIGITS = 8


def token_count(text: str = "text") -> Column:
    """Words of [^\\x20\\x09-\\x0D]+; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _down(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes: parent columns, weight, room and `given` (the parent's budget); adds each node's `budget`."""
    order = Window.partitionBy(*parent).orderBy("level", *[c for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    share = (F.col("given") - F.coalesce(F.sum("room").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = nodes.filter("weight > 0").withColumn("level", F.col("room") / F.col("weight")).withColumn("share", share)
    # Shares rise while nodes are full and fall after that: the highest one holds for the nodes with room left.
    common = F.max("share").over(Window.partitionBy(*parent))
    return ranked.withColumn("budget", F.least("room", F.col("weight") * common)).drop("level", "share")


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int) -> DataFrame:
    """leaves: domain, lang, source, the three weights and tokens. Adds `budget` (whole tokens) of each leaf."""
    room = (F.col("tokens") * epochs).cast("double")
    nodes = leaves.withColumn("room", room)
    positive = F.when((F.col("domain_weight") > 0) & (F.col("lang_weight") > 0) & (F.col("source_weight") > 0), F.col("room")).otherwise(0.0)
    nodes = nodes.withColumn("room", positive)
    domains = nodes.groupBy("domain").agg(F.max("domain_weight").alias("weight"), F.sum("room").alias("room")).withColumn("given", budget)
    domains = _down(domains, []).select("domain", F.col("budget").alias("given"))
    langs = nodes.groupBy("domain", "lang").agg(F.max("lang_weight").alias("weight"), F.sum("room").alias("room"))
    langs = _down(langs.join(domains, "domain"), ["domain"]).select("domain", "lang", F.col("budget").alias("given"))
    found = _down(nodes.withColumn("weight", F.col("source_weight")).join(langs, ["domain", "lang"]), ["domain", "lang"])
    return leaves.join(found.select(*LEVELS, F.floor(F.col("budget") + 1e-6).cast("bigint").alias("budget")), list(LEVELS), "left").fillna(0, ["budget"])


KEY = (*LEVELS, "doc_id", "text_key", "tokens")


def keyed(tokens: Column | None, domain: Column | None) -> list[Column]:
    """The columns of KEY, from those of documents."""
    name = lambda c: F.coalesce(c, F.lit("(none)"))
    return [
        name(domain if domain is not None else F.col("source")).alias("domain"),
        name(F.col("lang")).alias("lang"),
        name(F.col("source")).alias("source"),
        F.col("doc_id"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"),
        (tokens if tokens is not None else token_count()).cast("bigint").alias("tokens"),
    ]


def chosen(
    docs: DataFrame, weights: dict[str, Column], share: float, epochs: int, seed: int, tokens: Column | None = None, domain: Column | None = None
) -> DataFrame:
    """One row per group of equal rows: KEY, copies, whole (epochs of all copies) and more (copies that are in the
    prefix of one more epoch).

    weights: a positive number per level (domain, lang, source) as an expression on that level's column.
    share: the budget as a share of all tokens. epochs: most passes over a leaf."""
    groups = cut(docs.select(*keyed(tokens, domain)).groupBy(*KEY).agg(F.count("*").alias("copies")), "groups")
    size = F.col("tokens") * F.col("copies")
    leaves = groups.groupBy(*LEVELS).agg(F.sum(size).alias("tokens"), F.count("*").alias("rows"))
    for level in LEVELS:
        leaves = leaves.withColumn(f"{level}_weight", F.coalesce(weights[level].cast("double"), F.lit(0.0)))
    total = leaves.agg(F.floor(F.sum("tokens") * share).cast("double").alias("given"))
    leaves = leaf_budgets(leaves, total.scalar(), epochs)
    # Written once: the plans below, which use it four times, would each bring all levels along.
    plan = leaves.select(
        *LEVELS,
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("bigint").alias("rest"),
        F.ceil(F.col("rows") / SLICE_ROWS).alias("slices"),
    )
    plan = cut(plan, "plan")
    text = [F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key"), F.col("tokens").cast("string")]
    part = F.floor(F.conv(F.substring("place", 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS) * F.col("slices")).cast("int")
    placed = groups.join(plan, list(LEVELS)).withColumn("place", F.md5(F.concat_ws(":", *text).cast("binary"))).withColumn("slice", part)
    sums = placed.filter("rest > 0").groupBy(*LEVELS, "slice").agg(F.sum(size).alias("here"))
    earlier = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*LEVELS, "slice", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("carried"), "here")
    # Only the slices in which the rest runs out are put in order.
    joined = placed.join(carried, [*LEVELS, "slice"], "left")
    torn = F.coalesce((F.col("rest") >= F.col("carried")) & (F.col("rest") < F.col("carried") + F.col("here")), F.lit(False))
    within = Window.partitionBy(*LEVELS, "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("rest") - F.col("carried") - F.col("before")
    fit = F.when(F.col("tokens") > 0, F.greatest(F.lit(0), F.least("copies", F.expr("(rest - carried - before) div nullif(tokens, 0)")))).otherwise(F.when(left >= 0, F.col("copies")).otherwise(0))
    tail = joined.filter(torn).withColumn("before", F.sum(size).over(within) - size).withColumn("more", fit)
    whole = joined.filter(~torn).withColumn("more", F.when(F.col("rest") >= F.col("carried") + F.col("here"), F.col("copies")).otherwise(0))
    return whole.select(*KEY, "copies", "whole", "more").unionByName(tail.select(*KEY, "copies", "whole", "more"))


def mixed(
    docs: DataFrame, weights: dict[str, Column], share: float, epochs: int, seed: int, tokens: Column | None = None, domain: Column | None = None
) -> DataFrame:
    """One row per document row: doc_id, domain, lang, source, tokens, epochs (how often the mix takes it). See `chosen`."""
    groups = chosen(docs, weights, share, epochs, seed, tokens, domain)
    both = F.array(F.struct((F.col("whole") + 1).alias("epochs"), F.col("more").alias("rows")), F.struct(F.col("whole").alias("epochs"), (F.col("copies") - F.col("more")).alias("rows")))
    parts = groups.select("doc_id", *LEVELS, "tokens", F.inline(F.filter(both, lambda x: x["rows"] > 0)))
    # Many copies are written out in chunks by several tasks.
    chunks = parts.filter(F.col("rows") > COPIES).withColumn("chunk", F.explode(F.expr(f"sequence(0, (rows - 1) div {COPIES})"))).repartition("chunk")
    chunks = chunks.withColumn("rows", F.least(F.lit(COPIES), F.col("rows") - F.col("chunk") * COPIES)).drop("chunk")
    parts = parts.filter(F.col("rows") <= COPIES).unionByName(chunks)
    return parts.withColumn("row", F.explode(F.expr("sequence(1, rows)"))).drop("row", "rows")


def drawn(docs: DataFrame, choice: DataFrame, tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    """The documents the mix takes, each as often as its epochs say. choice: of `chosen` with the same tokens and domain.
    Which copies of a text are in the prefix is of no matter to the text; they are told apart by their place in the table."""
    columns = docs.columns
    two = lambda names: [F.xxhash64(*names).alias("_one"), F.xxhash64(*names, F.lit("two")).alias("_two")]  # noqa: E731  128 bits tell groups apart
    taken = choice.filter("whole + more > 0").select(*two(KEY), F.col("copies").alias("_copies"), F.col("whole").alias("_whole"), F.col("more").alias("_more"))
    rows = docs.select(*keyed(tokens, domain), F.struct(*columns).alias("_row")).select("_row", *two(KEY))
    rows = rows.join(small_side(cut(taken, "taken")), ["_one", "_two"]).select("_row.*", "_one", "_two", "_copies", "_whole", "_more")
    rows = rows.toDF(*[f"_{i}" for i in range(len(columns))], "_one", "_two", "_copies", "_whole", "_more")
    # In a leaf one group at most is in the prefix in part: its copies are numbered, task by task.
    some = (F.col("_more") > 0) & (F.col("_more") < F.col("_copies"))
    partly = cut(rows.filter(some).withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "partly")
    ahead = Window.partitionBy("_one", "_two").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = partly.groupBy("_one", "_two", "_task").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).drop("_rows")
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_one", "_two", "_task").orderBy("_at"))
    partly = partly.join(before, ["_one", "_two", "_task"]).withColumn("_epochs", F.col("_whole") + (at <= F.col("_more")).cast("int"))
    own = [f"_{i}" for i in range(len(columns))]
    fully = rows.filter(~some).withColumn("_epochs", F.col("_whole") + (F.col("_more") > 0).cast("int"))
    found = fully.select(*own, "_epochs").unionByName(partly.select(*own, "_epochs")).filter("_epochs > 0")
    return renamed(found.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_epochs")))), columns)
