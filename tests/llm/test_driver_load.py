"""What the driver holds and plans for the stages of the pipeline."""

import random
import tracemalloc

from pyspark.sql import functions as F
from shelfline.llm import langid, minhash, mixing, quality

DOCS = "doc_id bigint, text string, lang string, source string"


def recorded(monkeypatch, module):
    """Labels of the tables that the module writes from now on."""
    written, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, label: written.append(label) or cut(df, label))
    return written


def test_fit_holds_one_language_at_a_time(spark):
    letters = [chr(0x4E00 + 97 * i) for i in range(40)]
    rows = [(i, f"{letters[i % 20]}{letters[20 + i % 20]} {i:05d} {letters[i % 20] * (i % 50 + 1)}", f"l{i % 20:02d}", "s") for i in range(8000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    tracemalloc.start()
    try:
        model = langid.fitted(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.langs) == 20 and most < 150e6


def test_a_concentration_step_is_one_query(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"k{i % 3}", [rng.gauss(0, 1) for _ in range(quality.P)]) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, x array<double>")
    plain = {r.key: r for r in quality.estimates(df).collect()}
    written = recorded(monkeypatch, quality)
    monkeypatch.setattr(quality, "GROUPS", 1)  # too many groups to broadcast
    apart = {r.key: r for r in quality.estimates(df).collect()}
    assert len(written) == quality.STEPS + 2
    assert plain.keys() == apart.keys() and all(abs(a - b) < 1e-9 for k in plain for a, b in zip(plain[k].center, apart[k].center, strict=True))


def test_mix_plans_its_budgets_once(spark):
    rows = [(i, "word " * (i % 7 + 1), ["en", "de"][i % 2], f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = dict.fromkeys(mixing.LEVELS, F.lit(1))
    choice = mixing.chosen(docs, weights, 0.5, 1, 5)
    plan = choice._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") <= 4 and choice.count() == 60


def test_links_are_written_once(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = [rng.choices(words, k=80) for _ in range(5)]
    rows = [(i, " ".join(texts[i % 5] + [f"end{i % 10}"])) for i in range(40)]
    written = recorded(monkeypatch, minhash)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == set(range(5))
    assert written.count("edges") == minhash.STAR_ROUNDS + 1 and "links" not in written
