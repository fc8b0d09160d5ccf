"""Verdicts of the quality rules and of the language model against plain copies of their definitions."""

import random

import numpy as np
from shelfline.llm import langid, quality


def middle(values, share=0.5):
    """The value of rank ceil(share * n)."""
    return sorted(values)[max(0, int(np.ceil(share * len(values))) - 1)]


def plain_vector(s):
    n_words, chars, symbols, dup, repeat, lines, punct, upper = s
    share = lambda a, b: np.arcsin(np.sqrt(min(a / max(b, 1), 1.0)))
    return [np.log1p(chars / max(n_words, 1)), np.sqrt(symbols / max(n_words, 1)), share(dup, lines), share(repeat, n_words), np.sqrt(punct / max(n_words, 1)), share(upper, chars)]


def plain_judge(x, counts):
    """Centre, and the two parts of the distance, of one group: minimum covariance determinant from two starts."""
    p = x.shape[1]
    regular = quality.REGULAR**2 * np.eye(p)
    inside = 1 / (quality.chi2(quality.chi2_quantile(quality.ALPHA, p), p + 2) / quality.ALPHA)
    centre = np.array([middle(c) for c in x.T])
    off = np.array([middle(np.abs(c - m)) for c, m in zip(x.T, centre, strict=True)])
    starts = [(centre, np.diag((off * 1.4826) ** 2 + quality.REGULAR**2)), (x.mean(axis=0), np.cov(x.T, bias=True) + regular)]
    found = []
    for centre, cov in starts:
        for _ in range(quality.STEPS):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            half = x[d <= middle(d, quality.ALPHA)]
            centre, cov = half.mean(axis=0), np.cov(half.T, bias=True) * inside + regular
        found.append((np.linalg.slogdet(cov)[1], centre, cov))
    _, centre, cov = min(found, key=lambda f: f[0])
    error = np.array([covers / 4 / max(1, np.mean(of)) for of, (_, covers) in zip(counts, quality.COUNTED, strict=True)])
    return centre, cov, np.diag(cov) >= quality.SHARE**2 * error, error


def test_quality_verdict_equals_a_plain_copy(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    rows = []
    for i in range(700):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        words = [w.upper() if rng.random() < 0.02 else w + rng.choice(["", "", "", ",", "."]) for w in words]
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        if i % 23 == 0:  # outliers, each on one axis
            text = [text.upper(), text.replace(" ", " # "), text.replace(" ", ", "), "\n".join([text.split("\n")[0]] * 9) + "\n" + text, text.replace(" ", "ab cdefghijklmnop")][i // 23 % 5]
        rows.append((i, text, "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: (r.distance, r.kept) for r in quality.judged(docs).collect()}
    stats = [quality.statistics(t) for _, t, _, _ in rows]
    of = dict(zip(quality.STATISTICS, range(len(quality.STATISTICS)), strict=True))
    good = [s for s in stats if not (s[0] < 50 or 100 * s[of["n_repeat_words"]] > 50 * s[0])]
    x = np.array([plain_vector(s) for s in good])
    centre, cov, spread, error = plain_judge(x, [[s[of[c]] for s in good] for c, _ in quality.COUNTED])
    limit = quality.chi2_quantile(quality.CUT, x.shape[1])
    rejected = 0
    for (i, *_), s in zip(rows, stats, strict=True):
        away = np.array(plain_vector(s)) - centre
        own = np.array([covers / 4 / max(1, s[of[c]]) for c, covers in quality.COUNTED])
        d = away[spread] @ np.linalg.inv(cov[np.ix_(spread, spread)]) @ away[spread]
        d += sum(away[~spread] ** 2 / (np.diag(cov) + error + own)[~spread])
        failed = s[0] < 50 or 100 * s[of["n_repeat_words"]] > 50 * s[0]
        # percentiles over several tasks may be off by one rank
        assert abs(got[i][0] - d) <= 0.03 * max(1, d) and (got[i][1] == (not failed and d <= limit) or abs(d - limit) < 0.03 * limit)
        rejected += not got[i][1]
    assert 10 < rejected < 60


def plain_grams(text):
    if not text or not any(c.isalpha() for c in text):
        return None
    raw = b" " + b" ".join(bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()).split()) + b" "
    counts = [0] * langid.DIMENSIONS
    place = lambda v: (v * 2654435761 % 2**32) >> (32 - langid.DIMENSIONS.bit_length() + 1)
    two = [(a * 257 + b + (1 << 10)) % 2**32 for a, b in zip(raw, raw[1:], strict=False)]
    for v in [*raw, *two, *[(t * 263 + c + (1 << 20)) % 2**32 for t, c in zip(two, raw[2:], strict=False)]]:
        counts[place(v)] += 1
    return counts


def test_language_is_that_of_the_nearest_centroid(spark):
    rng = random.Random(9)
    words = {"aa": ["kala", "maja", "jala", "taev"], "bb": ["huis", "boom", "straat", "lucht"], "cc": ["дом", "река", "небо"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(3, 40))), x) for i, x in enumerate(rng.choices(list(words), k=240))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fitted(docs)
    texts = [None, "", "12 34", "kala huis", "qqqq zzzz xxxx", "дом дом huis", *[t for _, t, _ in rows[:60]]]
    got = model.predict(texts)
    for text, lang, score, rejected in zip(texts, got["lang_pred"], got["score"], got["rejected"], strict=True):
        counts = plain_grams(text)
        if counts is None:
            assert (lang, score, rejected) == (langid.UNKNOWN, 0.0, True)
            continue
        v = np.array([np.log1p(c) * w for c, w in zip(counts, model.idf, strict=True)])
        cosines = [sum(a * b for a, b in zip(c, v / np.linalg.norm(v), strict=True)) for c in model.centroids]
        best = int(np.argmax(cosines))
        least = model.least[min(int(np.log2(sum(counts) + 1)), langid.BINS - 1)]
        assert lang == model.langs[model.owner[best]] and abs(score - min(max(cosines[best], 0), 1)) < 1e-9 and rejected == (cosines[best] < least)
