import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from shelfline.llm import lattice
from shelfline.llm.common import crc_part

PATH = P.path("piece_bpe_32k.model")
ROWS = [(i, t) for i, t in enumerate(["The cat sat", "the CAT ran éé", "", None, "日本 the", "cat cat\tdog\n" * 5, "zzz", "of the of"] * 4)]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def brute(rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    learn = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in learn for w in words(t))
    n, v = sum(c.values()) + len(learn), len(c) + 1
    pieces = Counter(p for w, k in c.items() for p in sp.encode(w) for _ in range(k))
    total = sum(pieces.values()) + len(learn) + sp.vocab_size() + 1
    usable = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}

    @lru_cache(None)
    def marginal(s):
        """Sum over all segmentations, by the first piece."""
        if not s:
            return 1.0
        out = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in usable:
                out += (pieces[usable[s[:k]]] + 1) / total * marginal(s[k:])
            elif k == 1:
                p = math.prod((pieces[sp.piece_to_id(f"<0x{b:02X}>")] + 1) / total for b in s[0].encode())
                out += p * marginal(s[1:])
        return out

    for d, t in rows:
        ws = words(t)
        base = sum(math.log10((k + 1) / (n + v + 1)) for k in [*(c[w] for w in ws), len(learn)])
        score = sum(math.log10(marginal("▁" + w)) for w in ws) + math.log10((len(learn) + 1) / total)
        yield d, zlib.crc32(str(d).encode()) % 7 == 2, len(ws) + 1, sum(w in c for w in ws) + 1, n, base, score


@pytest.mark.parametrize("common", [2, 1000])
def test_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(lattice, "COMMON", common)
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in lattice.scored(docs, crc_part("doc_id", 7) != 2, PATH).collect())
    for a, b in zip(got, brute(ROWS), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert lattice.scored(none, F.lit(True), PATH).collect() == []
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    got = lattice.scored(rows, F.col("doc_id").isNull(), PATH).collect()
    assert len(got) == 3 and {r.train_tokens for r in got} == {2}
