"""Windows of test items against a search of every window, several automata, odd rows, cleaned texts."""

import glob
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from shelfline.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_all_windows(text, items, window):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        m = min(len(w), window)
        for grams in ({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set(),):
            for i in range(len(own) - m + 1):
                if tuple(own[i : i + m]) in grams:
                    hit.update(range(i, i + m))
                    names.add("" if name is None else str(name))
    return len(own), hit, sorted(names)


def drawn(rng, n, k):
    return " ".join(rng.choice(["a", "B", "c", "d'e", "ß", "7"][:k]) for _ in range(n))


@pytest.mark.parametrize("block", [200_000, 40], ids=["one automaton", "several"])
def test_windows_equal_a_search_of_all(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 15)
    rng = random.Random(12)
    items = [(i % 17, drawn(rng, rng.choice([0, 1, 2, 3, 4, 5, 9, 40]) if i else 3, 6)) for i in range(24)] + [(None, "a a a a a a"), (99, None)]
    items = [(n, t) for n, t in items if len(words(t)) != 1]
    docs = [(i, drawn(rng, rng.choice([0, 3, 30, 200]), 6) + ("; " + items[i % len(items)][1] if i % 3 and items[i % len(items)][1] else "")) for i in range(60)] + [(None, None), (3, "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, items string")
    got = decontaminate.matched(df, spark.createDataFrame(items, "item_id bigint, text string"), 5, keep_text=True).collect()
    assert len(got) == len(docs)
    some = 0
    for r in got:
        n, hit, names = by_all_windows(r.text, items, 5)
        mine = [k for s in r.spans for k in range(s.start, s.start + s.length)]
        assert (r.n_words, sorted(hit), names) == (n, mine, r["items"])
        some += bool(hit)
    assert some > 20


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "One two, three four five"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in decontaminate.matched(docs, none).orderBy("doc_id").collect()] == [(5, [], []), (0, [], [])]
    item = spark.createDataFrame([(7, "TWO three-four")], "item_id bigint, text string")
    assert decontaminate.matched(docs.limit(0), item).count() == 0
    assert [r.text for r in decontaminate.cleaned(docs, item, least=3, share=0.7).orderBy("doc_id").collect()] == ["One  five", None]
    assert [r.doc_id for r in decontaminate.cleaned(docs, item, least=3, share=0.5).collect()] == [2]
    assert [r.text for r in decontaminate.cleaned(docs, item, least=4, share=0.7).orderBy("doc_id").collect()] == ["One two, three four five", None]


def test_long_text_and_a_hot_item(spark):
    many = [(i, "to be or not to be that is the question") for i in range(3000)]
    items = spark.createDataFrame(many, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "to be or not " * 100_000 + "to be that is the question")], "doc_id bigint, text string")
    r = decontaminate.matched(docs, items).first()
    assert (r.n_words, len(r["items"])) == (400_006, 3000) and [tuple(s) for s in r.spans] == [(399_996, 10)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES["op12_decontaminate"](spark, SF)
    want = con.sql(queries.SQL["op12_decontaminate"]).select(", ".join(df.columns)).fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(want) and df.filter(F.col("contaminated")).count() > 0
