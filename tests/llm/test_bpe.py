import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from shelfline.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "ß", "12", "!", "...", "\x1c", "\x85", " ", "日本", "😀", "́", "the", "ing", "\r", "²"]


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_the_library():
    ours, theirs, rng = bpe.tokenizer(PATH, P.PATTERN), library(), random.Random(3)
    texts = ["", "ab" * 20_000] + ["".join(rng.choices(BITS, k=rng.randrange(1, 30))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü", k=rng.randrange(1, 60))) for _ in range(1000)]
    want = [theirs.encode_ordinary(t) for t in texts]
    assert [np.frombuffer(p, np.int32).tolist() for p in ours.packed(texts)] == want
    assert [ours.encode(t) for t in texts] == want
    assert all(ours.prefixes.decode(i).decode() == t for i, t in zip(want, texts, strict=True))


def test_edits_and_appends():
    t, rng = bpe.tokenizer(PATH, P.PATTERN), random.Random(5)
    state = bpe.Encoded(t, "x")
    for _ in range(800):
        i = rng.randrange(len(state.text) + 1)
        state.edit(i, min(len(state.text), i + rng.randrange(4)), "".join(rng.choices(BITS, k=rng.randrange(5))))
        assert state.ids == t.encode(state.text)
    long = bpe.Encoded(t, "one two three " * 2000)
    assert long.append("and four") <= 4
    assert long.ids == t.encode(long.text)


def test_typing_and_edits_beside_long_matches():
    """Contractions and runs of white space, whose matches look further than one code point ahead."""
    t, rng = bpe.tokenizer(PATH, P.PATTERN), random.Random(6)
    state, said = bpe.Encoded(t), "we're sure they've said  it'll   rain, 'tis I'd \n\n  say; we'r 'v ''ll   \t x"
    for i, c in enumerate(said):
        state.append(c)
        assert state.ids == t.encode(said[: i + 1])
    state = bpe.Encoded(t, "a  b")
    state.edit(3, 4, " ")
    assert state.ids == t.encode("a   ")
    state = bpe.Encoded(t, "x")
    for _ in range(6000):
        i = rng.randrange(len(state.text) + 1)
        state.edit(i, min(len(state.text), i + rng.randrange(4)), "".join(rng.choices("'rvlesdt  \na1.\x1c\u3000", k=rng.randrange(4))))
        if len(state.text) > 60:
            state = bpe.Encoded(t, state.text[:9])
        assert state.ids == t.encode(state.text)


def test_frame(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "Ab c", 7)], "doc_id bigint, text string, ids int")
    rows = bpe.decoded(bpe.encoded(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, len(r.ids), bytes(r.decoded)) for r in rows) == [(0, 2, b"Ab c"), (1, 0, b""), (2, 0, b""), (2, 0, b"")]
    assert bpe.encoded(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_joined_bytes_of_lists():
    words = pa.array([b"a", None, b"", b"cd"], pa.binary())
    lists = pa.array([[0], [], [3, 2, 0], None, [3]], pa.list_(pa.int32()))
    assert bpe.joined(lists, words).to_pylist() == [b"a", b"", b"cda", b"", b"cd"]
    assert bpe.joined(lists[1:], words).to_pylist() == [b"", b"cda", b"", b"cd"]
    assert bpe.joined(lists[:0], words).to_pylist() == []
    assert bpe.joined(pa.array([[], None], pa.list_(pa.int32())), words).to_pylist() == [b"", b""]
    for wrong in (1, 4):
        with pytest.raises((ValueError, pa.ArrowInvalid, IndexError)):
            bpe.joined(pa.array([[wrong]], pa.list_(pa.int32())), words)
