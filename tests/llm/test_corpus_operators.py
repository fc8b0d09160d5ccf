"""Mixing, quality, language: brute force, held-out accuracy and edge rows; the pipeline as a whole."""

import os
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfline.llm import langid, minhash, mixing, quality, queries
from shelfline.llm.common import crc_part, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def fill(budget, nodes):
    """nodes: name -> (weight, room). Shares what full nodes leave among the others, again and again."""
    given = {n: 0.0 for n in nodes}
    open_ = {n for n, (w, r) in nodes.items() if w > 0}
    left = min(budget, sum(nodes[n][1] for n in open_))
    while open_ and left > 1e-9:
        unit = left / sum(nodes[n][0] for n in open_)
        for n in sorted(open_):
            given[n] += min(unit * nodes[n][0], nodes[n][1] - given[n])
        left = min(budget, sum(r for w, r in nodes.values() if w > 0)) - sum(given.values())
        open_ = {n for n in open_ if nodes[n][1] - given[n] > 1e-9}
    return given


def test_budgets_by_repeated_sharing(spark):
    rng = random.Random(3)
    leaves = [(f"d{d}", f"l{i}", f"s{s}", float(1 + d), float(1 + i % 2), float(rng.randrange(3)), rng.randrange(1, 200), 1) for d in range(3) for i in range(3) for s in range(4)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, domain_weight double, lang_weight double, source_weight double, tokens bigint, rows bigint")
    for budget in (100.0, 1500.0, 1e6):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, F.lit(budget), 2).collect()}
        room = {(x[0], x[1], x[2]): x[6] * 2.0 if x[5] > 0 else 0.0 for x in leaves}
        total = lambda *p: sum(r for k, r in room.items() if k[: len(p)] == p)
        want = {}
        for d, gd in fill(budget, {f"d{d}": (1.0 + d, total(f"d{d}")) for d in range(3)}).items():
            for i, gl in fill(gd, {f"l{i}": (1.0 + i % 2, total(d, f"l{i}")) for i in range(3)}).items():
                want |= {(d, i, s): v for s, v in fill(gl, {x[2]: (x[5], room[d, i, x[2]]) for x in leaves if x[:2] == (d, i)}).items()}
        assert all(abs(got[k] - want[k]) <= 1 for k in want)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "x y", "en", "a"), (3, "a b c", "en", "a"), (3, "a b c", "en", "a")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", tokens int")
    weights = {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}
    choice = mixing.mixed(docs, weights, 1.0, 1, 5)
    assert choice.count() == 5 and choice.agg(F.sum(F.col("tokens") * F.col("epochs"))).first()[0] == 8
    groups = mixing.chosen(docs, weights, 1.0, 1, 5)
    # Rows without tokens are taken where their turn comes before the rest is used up; a whole epoch takes all.
    assert mixing.drawn(docs, groups).columns == docs.columns and mixing.drawn(docs, groups).count() == 4
    assert mixing.mixed(docs.limit(0), weights, 1.0, 1, 5).count() == 0
    assert mixing.drawn(docs.limit(0), mixing.chosen(docs.limit(0), weights, 1.0, 1, 5)).count() == 0


def many_rows(spark):
    """A third without id, a third of ids that repeat in other leaves, a long text, a text repeated by a sixth of all."""
    rng = random.Random(8)
    text = lambda i: "same text here" if i % 6 == 0 else " ".join(["w"] * (20_000 if i == 7 else rng.randrange(1, 180)) + [str(i)])
    rows = [(None if i % 3 == 0 else i % 400 if i % 3 == 1 else i, text(i), "en", f"s{i % 2}", i) for i in range(1800)]
    return spark.createDataFrame(rows, DOCS + ", tokens int").drop("tokens")


@pytest.mark.parametrize(("share", "epochs"), [(0.9, 1), (0.5, 1), (0.8, 3), (1.0, 2)])
def test_budgets_are_met_within_a_document_of_each_leaf(spark, monkeypatch, share, epochs):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 50)
    monkeypatch.setattr(mixing, "COPIES", 20)
    docs = many_rows(spark)
    weights = {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}
    total = docs.agg(F.sum(mixing.token_count())).first()[0]
    choice = mixing.mixed(docs, weights, share, epochs, 3).collect()
    assert len(choice) == 1800
    assert sorted((str(r.doc_id), r.source) for r in choice) == sorted((str(r.doc_id), r.source) for r in docs.collect())
    groups = mixing.chosen(docs, weights, share, epochs, 3)
    taken = mixing.drawn(docs, groups)
    got = {r.source: r.n for r in taken.groupBy("source").agg(F.sum(mixing.token_count()).alias("n")).collect()}
    picked = {}
    for r in choice:
        picked[r.source] = picked.get(r.source, 0) + r.epochs * r.tokens
    assert got == picked
    room = {r.source: r.n * epochs for r in docs.groupBy("source").agg(F.sum(mixing.token_count()).alias("n")).collect()}
    want = fill(total * share, {s: (1.0, float(n)) for s, n in room.items()})
    assert all(want[s] - 20_001 <= n <= want[s] + 1 for s, n in got.items())
    assert taken.filter("doc_id is null").count() > 0
    # no document is taken more than one time above another of its leaf
    spread = {}
    for r in choice:
        spread.setdefault(r.source, set()).add(r.epochs)
    assert all(max(x) - min(x) <= 1 for x in spread.values())


def test_op3_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES["op3_mixing"](spark, SF)
    want = con.sql(queries.SQL["op3_mixing"]).select(", ".join(df.columns)).fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_language_sample_of_rows_without_ids(spark):
    rows = [(None, f"text {chr(97 + i % 26) * 3} {i:06d}", "en") for i in range(3000)] + [(1, "the same text", "de")] * 1000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    drawn = langid.sample(docs)
    assert {x: sum(r.lang == x for r in drawn) for x in ("en", "de")} == {"en": langid.ROWS, "de": 1}
    assert langid.fitted(docs).langs == ["de", "en"]


def test_statistics_by_plain_counts():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choices(["a ", "b ", "cé ", "\n", "#", "| ", "A\t", " ", "x\x0b"], k=rng.randrange(60)))
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        hit = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = quality.statistics(text)
        assert got[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))
    assert quality.statistics(None) == (0,) * 8


def test_planted_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(500):
        text = " ".join(rng.choices(words, k=rng.randrange(60, 200)))
        rows.append((i, text.replace(" ", "### ") if i % 25 == 0 else text, ["en", "de", None][i % 3], ["s", "t"][i % 2]))
    rows += [(900, None, "en", "s"), (901, "few words", None, None), (902, rows[1][1], "xx", "alone")]
    docs = spark.createDataFrame([(*r, 1.0, "k") for r in rows], DOCS + ", n_words double, key string")
    got = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert {d for d, k in got.items() if not k} == {i for i in range(500) if i % 25 == 0} | {900, 901}
    kept = quality.passed(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, k in got.items() if k}
    assert quality.judged(docs.limit(0)).count() == 0


def test_planted_outliers_on_each_axis(spark):
    """A text that is far out on one statistic goes, also where the group has no spread on it."""
    rng = random.Random(4)

    def prose(n=300, lines=8, letters=(2, 9), commas=0.15, capitals=0.1, symbols=0.0):
        words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(*letters))) for _ in range(n)]
        words = [w.title() if rng.random() < capitals else w for w in words]
        words = [w + "," * (rng.random() < commas) + "#" * (rng.random() < symbols) for w in words]
        size = -(-n // lines)
        return [words[i : i + size] for i in range(0, n, size)]

    def text(lines):
        return "\n".join(map(" ".join, lines))

    repeated = [line for part in prose(lines=20) for line in (part, ["menu"])]
    said = prose()
    said[0][:24] = said[1][:24] = said[2][:24] = said[3][:24]
    planted = [prose(letters=(6, 13)), prose(symbols=0.2), repeated, said, prose(commas=0.7), prose(capitals=0.9)]
    rows = [(i, text(prose(n=rng.randrange(150, 500))), "en", "s") for i in range(400)] + [(1000 + i, text(p), "en", "s") for i, p in enumerate(planted)]
    got = quality.judged(spark.createDataFrame(rows, DOCS)).collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == set(range(1000, 1006))


def test_concentration_finds_the_clean_majority(spark):
    """The estimate of a group with a fifth of far rows is near the moments of the others."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, quality.P)) * np.array([1, 2, 1, 1, 3, 1])
    x[:800] += 30
    df = spark.createDataFrame([("k", [float(v) for v in r]) for r in x], "key string, x array<double>")
    r = quality.estimates(df).collect()[0]
    assert np.allclose(r.center, x[800:].mean(axis=0), atol=0.3)


@needs_tables
def test_language_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = queries.op9_langid(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98


def test_language_of_odd_rows(spark):
    rng = random.Random(2)
    said = {"aa": ["kala", "mina", "tuli"], "zz": ["xorp", "qwyx", "vrz"]}
    rows = [(i, " ".join(rng.choices(said[g], k=30)), g, "s") for i, g in enumerate(["aa", "zz"] * 40)]
    odd = [(200, None, "aa", "s"), (201, "123 ... !", None, "s"), (202, "kala mina", None, "s"), (202, "kala mina", None, "s"), (203, "xorp " * 50_000, "aa", "s")]
    docs = spark.createDataFrame([(*r, "old") for r in rows + odd], DOCS + ", score string")
    model = langid.fitted(docs.filter("doc_id < 200"))
    got = {r.doc_id: r.lang_pred for r in langid.identified(docs, model).collect()}
    assert [got[i] for i in (200, 201, 202, 203)] == ["und", "und", "aa", "zz"] and all(got[r[0]] == r[2] for r in rows)
    kept = langid.accepted(docs, F.col("doc_id") < 200)
    assert kept.columns == docs.columns and {r.lang for r in kept.filter("doc_id = 202").collect()} == {"aa"}
    assert not {200, 201} & {r.doc_id for r in kept.collect()}
    assert langid.identified(docs, langid.fitted(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


@needs_tables
def test_stages_one_by_one(spark):
    """Each stage's result is what its operator decides on the stage's own input."""
    docs = table(spark, SF, "documents").cache()
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = corpus_pipeline.language(spark, docs, SF).cache()
    model = langid.fitted(docs)
    assert one.columns == docs.columns and ids(one) == ids(langid.identified(docs, model).filter("not rejected"))
    two = corpus_pipeline.quality_rules(spark, one, SF).cache()
    assert two.columns == docs.columns and ids(two) == ids(quality.judged(one).filter("kept"))
    three = corpus_pipeline.near_duplicates(spark, two, SF).cache()
    assert three.columns == docs.columns and ids(three) == ids(minhash.near_duplicates(two).filter("kept"))
    four = corpus_pipeline.mix(spark, three, SF).cache()
    total = three.agg(F.sum(mixing.token_count())).first()[0]
    assert four.columns == docs.columns and set(ids(four)) <= set(ids(three))
    assert four.agg(F.sum(mixing.token_count())).first()[0] <= corpus_pipeline.SHARE * total
    five = corpus_pipeline.tokens(spark, four, SF)
    assert ids(five) == ids(four) == ids(corpus_pipeline.run(spark, SF))


def test_part_by_crc(spark):
    import zlib

    got = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint").select("doc_id", crc_part("doc_id", 7).alias("p")).collect()
    assert all(r.p == zlib.crc32(str(r.doc_id).encode()) % 7 for r in got)
