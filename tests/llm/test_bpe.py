import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from twigspark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "  x", "a b  c\n\n d", "don't  stop\n", "é" * 500, "ab" * 3000, "\x1c x \x85y", "<|endoftext|> a", "日本 語　x", "1234 5 $$$", "tail "]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_direct(ranks):
    r, m = random.Random(1), bpe.Merger(ranks, 1)
    for _ in range(1500):
        b = bytes(r.choices(b"theaionsr \xc3\xa9", k=r.randint(1, 70)))
        assert m.tree(b) == m.direct(b) == m._heap(b)


def test_equals_library(ranks, library):
    e, r = bpe.TextEncoder(ranks, P.PATTERN), random.Random(2)
    chars = [chr(c) for c in range(0x3001)] + [" "] * 3000 + ["\n"] * 1000 + ["'"] * 200 + ["a", "b"] * 500
    for t in [*TEXTS[1:], *("".join(r.choices(chars, k=r.randint(0, 14))) for _ in range(4000))]:
        assert e.ids(t).tolist() == library.encode_ordinary(t)
        assert e.decode(e.ids(t)) == t.encode()


def test_frames(spark, library):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids2 int")
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and list(r.ids) == library.encode_ordinary(r.text or "") for r in back)
    for r in bpe.report(df, PATH, P.PATTERN).collect():
        ids = library.encode_ordinary(TEXTS[r.doc_id] or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((TEXTS[r.doc_id] or "").encode()))
    assert bpe.report(df.limit(0), PATH, P.PATTERN).collect() == []


def test_vocabularies_of_one_size_are_told_apart(spark, ranks, tmp_path):
    """Two that differ in the ranks of two late tokens alone, one after the other in the same worker."""
    import base64

    a, b = [k for k, v in ranks.items() if v >= 40_000 and k.isalpha()][:2]
    other = ranks | {a: ranks[b], b: ranks[a]}
    path = tmp_path / "other.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in other.items()))
    df = spark.createDataFrame([(1, a.decode(), 0)], "doc_id long, text string, x int").coalesce(1)
    assert [bpe.encode(df, p, P.PATTERN).first().ids for p in (PATH, str(path), PATH)] == [[ranks[a]], [ranks[b]], [ranks[a]]]


def test_decoding_joins_halves(ranks):
    e = bpe.TextEncoder(ranks, P.PATTERN)
    for text in ("", "a", "é日本 " * 3000, "x y " * bpe.LEAF_IDS):
        assert e.decode(e.ids(text)) == text.encode()


def test_leaves_and_seams_are_encoded_once(ranks, monkeypatch):
    """A piece of 4096 bytes that repeats 8 has few different leaves and seams; tables that are full start anew and change nothing."""
    calls = []

    class Counted(bpe.Merger):
        def direct(self, piece):
            calls.append(piece)
            return super().direct(piece)

    piece = b"qzxvkjwy" * 512
    want = bpe.Merger(ranks)._heap(piece)
    assert Counted(ranks).tree(piece) == want and len(calls) < 100
    monkeypatch.setattr(bpe, "SHORTS", 3)
    assert Counted(ranks).tree(piece) == want
