"""Quality rules: robust multivariate outliers of text statistics.

Method. Every text becomes a vector of six transformed statistics (see VECTOR). For each language and source the
minimum-covariance-determinant estimate of centre and spread is found by concentration steps: the distances of
all rows, the nearest ALPHA share of them, and their mean and covariance give the next estimate; a step never
raises the determinant. Two starts are run (medians with median deviations, and plain moments), and the one of the
smaller determinant counts. A text whose squared Mahalanobis distance exceeds the chi-square quantile CUT is
rejected.

Estimates are sums and quantile sketches per group over all rows, so a group of any size is folded before the
shuffle. Groups with fewer than LEAST rows are pooled by language, and these, if still small, with one another.
REGULAR is added to the spreads while the estimate is sought, since statistics that are zero for most texts have none.

In the verdict the group's covariance decides on every axis that has spread. An axis whose spread is below SHARE of
what counting alone gives a text of the group's mean length (three quarters of the texts have nothing to count) is
judged by itself instead: its variance is the group's, plus the counting error of a text of mean length (the centre is
not known better than that) and of the text's own length. A transformed count over n has the counting error
1 / (2 sqrt(n)); a repeat covers three words and counts as one of n / 3, and of lines, which are few and hardly equal
by chance, half the error is taken.

Defined results: null lang or source are groups of their own; a text without words fails the base rules; repeated
rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import map_lists, numbered, renamed, small_side

ALPHA = 0.75
CUT = 0.999999
LEAST = 200
STEPS = 6
#: Standard deviation that keeps covariances invertible.
REGULAR = 0.003
#: Spreads below this share of the counting error count as none.
SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
UPPER = bytes(range(65, 91))


def statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_punct, n_upper of a text. Words are
    runs of [^\\x20\\x09-\\x0D], lines are cut at \\n and have a word."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        end = 0  # words before it are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    punctuation = len(raw) - len(raw.translate(None, PUNCTUATION))
    upper = len(raw) - len(raw.translate(None, UPPER))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), punctuation, upper


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punct", "n_upper")


SCHEMA = ", ".join(f"{s} bigint" for s in STATISTICS)


def _columns(texts: list[str | None]) -> dict[str, list]:
    return dict(zip(STATISTICS, zip(*map(statistics, texts), strict=True) if texts else [[]] * len(STATISTICS), strict=True))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics."""
    keep = ["doc_id", "lang", "source"]
    return map_lists(docs.select(*keep, "text"), _columns, SCHEMA, keep=keep)


def _share(part: str, whole: str) -> Column:
    return F.asin(F.sqrt(F.least(F.col(part) / F.greatest(F.col(whole), F.lit(1)), F.lit(1.0))))


#: Transformed statistics: logarithm of the mean word length, roots of symbols and punctuation per word, and
#: arcsines of the shares of repeated lines, repeated words and capitals.
VECTOR = (
    lambda: F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))),
    lambda: F.sqrt(F.col("n_symbols") / F.greatest("n_words", F.lit(1))),
    lambda: _share("n_dup_lines", "n_lines"),
    lambda: _share("n_repeat_words", "n_words"),
    lambda: F.sqrt(F.col("n_punct") / F.greatest("n_words", F.lit(1))),
    lambda: _share("n_upper", "word_chars"),
)
#: What each statistic of VECTOR is counted over, and how many of these one event covers.
COUNTED = (("n_words", 1), ("n_words", 1), ("n_lines", 0.25), ("n_words", 3), ("n_words", 1), ("word_chars", 1))
P = len(VECTOR)
#: Groups (a few hundred bytes each) up to which their table is broadcast; rows then stay where they are, also those of a hot group.
GROUPS = 50_000
#: Groups whose sums one task adds up.
GROUPS_PER_TASK = 100
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi2(x: float, p: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2(mid, p) < share else (low, mid)
    return high


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _counting(count: Column, covers: int) -> Column:
    """Variance that counting gives a transformed statistic."""
    return F.lit(covers / 4) / F.greatest(count, F.lit(1))


def _distance() -> Column:
    """Squared Mahalanobis distance of x to `center` under the packed `inverse`."""
    d = [F.col("x")[i] - F.col("center")[i] for i in range(P)]
    return _total([d[i] * d[j] * F.col("inverse")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)])


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(F.col("x")[i]) for i in range(P)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS]
    return rows.groupBy("key", "start").agg(F.count("*").alias("n"), F.array(*sums).alias("sums"), F.array(*products).alias("products"))


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """key, start, center, inverse (packed) and log_det from the sums of each group."""

    def run(counts, sums, products):
        out = {"center": [], "inverse": [], "log_det": []}
        for n, s, q in zip(counts, sums, products, strict=True):
            center = np.array(s) / n
            cov = np.empty((P, P))
            for (i, j), v in zip(PAIRS, q, strict=True):
                cov[i, j] = cov[j, i] = v / n - center[i] * center[j]
            cov = cov * factor + REGULAR**2 * np.eye(P)
            inverse = np.linalg.inv(cov)
            out["center"].append(center)
            out["inverse"].append([inverse[i, j] for i, j in PAIRS])
            out["log_det"].append(float(np.linalg.slogdet(cov)[1]))
        return out

    schema = "center array<double>, inverse array<double>, log_det double"
    return map_lists(moments, run, schema, keep=["key", "start"])


def keys(stats: DataFrame) -> DataFrame:
    """The group that judges each language and source: _lang, _source, key."""
    small = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = small.groupBy("lang").agg(F.sum(F.when(F.col("n") < LEAST, F.col("n"))).alias("n_pool"))
    none = F.lit(None).cast("string")
    key = F.when(F.col("n") >= LEAST, F.struct("lang", "source", F.lit(0).alias("pool")))
    key = key.when(F.col("n_pool") >= LEAST, F.struct("lang", none.alias("source"), F.lit(1).alias("pool")))
    key = key.otherwise(F.struct(none.alias("lang"), none.alias("source"), F.lit(2).alias("pool")))
    pools = by_lang.withColumnRenamed("lang", "_lang")
    return (
        small.join(pools, F.col("lang").eqNullSafe(F.col("_lang")))
        .select("_lang", F.col("source").alias("_source"), F.to_json(key).alias("key"))
    )


def vectors(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """stats with the vector x and the key of the group that judges the row."""
    rows = stats.withColumn("x", F.array(*[v() for v in VECTOR]))
    return rows.join(small_side(groups, GROUPS), F.expr("lang <=> _lang and source <=> _source")).drop("_lang", "_source")


def estimates(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of every key: key, center, inverse, log_det."""
    inside = 1 / (chi2(chi2_quantile(ALPHA, P), P + 2) / ALPHA)
    x = [F.col("x")[i] for i in range(P)]
    middle = cut(rows.groupBy("key").agg(F.array(*[F.percentile_approx(c, 0.5, 1000) for c in x]).alias("center")), "middle")
    # All tables below have two rows a key at most, so they are counted once, and a step is one query.
    n = middle.count()
    side = F.broadcast if 2 * n <= GROUPS else lambda table: table
    tasks = 1 + 2 * n // GROUPS_PER_TASK
    off = rows.join(side(middle), "key").groupBy("key").agg(
        F.first("center").alias("center"),
        F.array(*[F.percentile_approx(F.abs(c - F.col("center")[i]), 0.5, 1000) for i, c in enumerate(x)]).alias("off"),
    )
    spread = [F.pow(F.col("off")[i] * 1.4826, 2) + REGULAR**2 for i in range(P)]
    packed = F.array(*[1 / spread[i] if i == j else F.lit(0.0) for i, j in PAIRS])
    robust = off.select("key", F.lit(0).alias("start"), "center", packed.alias("inverse"), F.lit(0.0).alias("log_det"))
    plain = _estimates(_moments(rows.withColumn("start", F.lit(1))).coalesce(tasks), 1.0)
    now = cut(robust.unionByName(plain), "estimates")
    for _ in range(STEPS):
        at = rows.select("key", "x").join(side(now), "key").select("key", "start", "x", _distance().alias("d"))
        near = at.groupBy("key", "start").agg(F.percentile_approx("d", ALPHA, 1000).alias("limit"))
        half = at.join(side(near), ["key", "start"]).filter("d <= limit")
        now = cut(_estimates(_moments(half).coalesce(tasks), inside), "estimates")
    return now.groupBy("key").agg(F.min_by(F.struct("center", "inverse"), "log_det").alias("best")).select("key", "best.*")


def judges(rows: DataFrame) -> DataFrame:
    """key, center, the inverse covariance of the axes that have spread (packed; 0 for the others) and, for the others,
    the variance `flat` that does not depend on the text (null for those that have spread)."""
    error = [_counting(F.avg(c), covers) for c, covers in COUNTED]
    found = estimates(rows).join(rows.groupBy("key").agg(F.array(*error).alias("error")), "key")

    def run(inverses, errors):
        out = {"inverse": [], "flat": []}
        for packed, error in zip(inverses, errors, strict=True):
            inverse = np.empty((P, P))
            for (i, j), v in zip(PAIRS, packed, strict=True):
                inverse[i, j] = inverse[j, i] = v
            cov = np.linalg.inv(inverse)
            spread = np.diag(cov) >= SHARE**2 * np.array(error)
            inverse = np.zeros((P, P))
            inverse[np.ix_(spread, spread)] = np.linalg.inv(cov[np.ix_(spread, spread)])
            out["inverse"].append([inverse[i, j] for i, j in PAIRS])
            out["flat"].append([None if spread[i] else float(cov[i, i] + error[i]) for i in range(P)])
        return out

    found = found.select("key", "center", F.col("inverse").alias("_inverse"), "error")
    return map_lists(found, run, "inverse array<double>, flat array<double>", keep=["key", "center"], read=["_inverse", "error"])


def base_rule() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _verdict(rows: DataFrame, found: DataFrame) -> DataFrame:
    off = [F.pow(F.col("x")[i] - F.col("center")[i], 2) for i in range(P)]
    flat = [F.coalesce(off[i] / (F.col("flat")[i] + _counting(F.col(c), covers)), F.lit(0.0)) for i, (c, covers) in enumerate(COUNTED)]
    return (
        rows.join(small_side(found, GROUPS), "key", "left")
        .withColumn("base_failed", base_rule())
        .withColumn("distance", F.coalesce(_distance() + _total(flat), F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(CUT, P)))
    )


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (squared) and kept."""
    stats = cut(measured(docs), "statistics")
    rows = cut(vectors(stats, cut(keys(stats), "keys")), "vectors")
    found = cut(judges(rows.filter(~base_rule())), "judges")
    return _verdict(rows, found).select("doc_id", *STATISTICS, "base_failed", "distance", "kept")


def passed(docs: DataFrame) -> DataFrame:
    """The documents that are kept, judged row by row."""
    columns = docs.columns
    at = {c: f"_{columns.index(c)}" for c in ("text", "lang", "source")}
    stats = cut(measured(docs), "statistics")
    groups = cut(keys(stats), "keys")
    found = cut(judges(cut(vectors(stats, groups).filter(~base_rule()), "vectors")), "judges")
    rows = numbered(docs)
    rows = map_lists(rows, _columns, SCHEMA, keep=rows.columns, read=[at["text"]])
    rows = vectors(rows.withColumns({c: F.col(at[c]) for c in ("lang", "source")}), groups)
    return renamed(_verdict(rows, found).filter("kept"), columns)
