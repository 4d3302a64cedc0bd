import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from twigspark.llm import packing

PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start int"


def test_hilbert_steps_to_neighbours():
    for dim, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim), -1).reshape(-1, dim)
        key = packing.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    e, r = packing.Splitter(packing.encoder(packing.read_vocabulary(PATH), P.PATTERN), packing.read_added(PATH)), random.Random(4)
    chars = [chr(c) for c in range(0x500)] + [" "] * 900 + ["\n"] * 300 + ["a", "b", "'s"] * 100
    for x in ["<|endoftext|> a", "  a", "", *("".join(r.choices(chars, k=r.randint(0, 20))) for _ in range(2000))]:
        assert e.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_texts_are_cut_without_a_search():
    """White space of any kind after a space, at both ends, in the middle and behind cuts that are known; no regular expression reads a text of plain spaces."""
    t = Tokenizer.from_file(PATH)
    e = packing.encoder(packing.read_vocabulary(PATH), P.PATTERN, "searched")
    for space in [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000"]:
        for x in [f"a b {space}c d", f"a b{space}", f"a b {space}", f"{space} a b", f"{space}a b", f" {space}", f"a{space} b", space, f"a b {space} c"]:
            assert e.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids, ascii(x)
    assert not hasattr(e, "odd")
    e.cut = None
    assert e.ids("plain words, cut at spaces\nand lines").tolist() == t.encode("plain words, cut at spaces\nand lines", add_special_tokens=False).ids


@pytest.mark.parametrize("parts", ["1", "5"])
def test_pieces(spark, parts):
    t = Tokenizer.from_file(PATH)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    rows = [*df.itertuples(index=False, name=None), (900, None), (901, ""), (902, "word " * 5000), (3, df.text[3]), (None, "x")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3), PATH, P.PATTERN).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for d, x in rows:
        want.setdefault(d, []).append([*t.encode(x or "", add_special_tokens=False).ids, 0])
    seen, sequences = {}, {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        ids = next(x for x in want[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for d, texts in want.items():
        assert sum(r.length for r in seen[d]) == sum(map(len, texts))
        at = 0
        for r in sorted(seen[d], key=lambda r: r.start) if len(texts) == 1 else []:
            assert r.start == at
            at += r.length
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    full = sum(1 for s in sequences.values() if sum(r.length for r in s) == 1024)
    assert full >= sum(r.length for r in got) // 1024 - int(parts)


def test_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 1)], SCHEMA)
    got = packing.pack(df, PATH, P.PATTERN, with_ids=True).collect()
    assert [x for r in sorted(got, key=lambda r: r.start) for x in r.ids] == [64, 275, 0]
    assert packing.pack(df.limit(0), PATH, P.PATTERN).collect() == []


def test_added_tokens_are_the_librarys(spark):
    t = Tokenizer.from_file(PATH)  # with its default settings
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext |> <|endoftext", " <|endoftext|>  z <|endoftext|>"]
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(texts)], SCHEMA)
    of = {}
    for r in sorted(packing.pack(df, PATH, P.PATTERN, with_ids=True).collect(), key=lambda r: r.start):
        of.setdefault(r.doc_id, []).extend(r.ids)
    assert of == {k: [*t.encode(x, add_special_tokens=False).ids, 0] for k, x in enumerate(texts)}
    assert of[0] == [64, 220, 50256, 275, 0]
