"""Each stage on its predecessor's rows against a plain version of it; what it returns; and that hard inputs pass."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from twigspark.llm import quality_model, quality_rules
from twigspark.llm.queries import QUERIES

from .test_line_dedup import key
from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        out = stage(spark, docs, SF)
        if name == "packing":
            got = out.collect()
            assert {r.doc_id for r in got} == {d for d, _ in before}
            break
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        after = rows(kept)
        if name == "quality classifier":
            model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            s = quality_model.scores(model, pa.array([t for _, t in before]))
            assert after == [x for x, v in zip(before, s, strict=True) if v >= 0.3]
        elif name == "quality rules":
            good = {r.doc_id for r in quality_rules.report(docs).where("kept").collect()}
            assert after == [x for x in before if x[0] in good]
        elif name == "line dedup":
            held, first, want = {}, {}, []
            for d, t in sorted(before):
                for x in t.split("\n"):
                    held.setdefault(key(x), set()).add(d)
            for d, t in sorted(before):
                left = []
                for x in t.split("\n"):
                    if not key(x) or len(held[key(x)]) < 10 or first.setdefault(key(x), d) == d and (key(x), 0) not in first:
                        left.append(x)
                        if key(x) and len(held[key(x)]) >= 10:
                            first[key(x), 0] = d
                if any(map(key, left)):
                    want.append((d, "\n".join(left)))
            assert after == sorted(want, key=str)
        else:
            class_of = {d: c for d, _, c in brute(before, 5, 80, 100)}
            assert [d for d, _ in after] == sorted((d for d, c in class_of.items() if d == c), key=lambda d: str((d, dict(before)[d])))
        docs = kept


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, digest int"
    long = " ".join(f"word{k}" for k in range(30_000))
    made = [(1, None), (2, ""), (3, long), (3, long), (4, long + " x"), (5, "\n\n \t"), (None, "a b c"), (6, "x" * 200_000)]
    docs = spark.createDataFrame([(d, t, "en", None, 0, 0.5, "k", 1) for d, t in made], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(made)


def test_registered(spark):
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert np.isfinite(len(corpus_pipeline.STAGES))


def test_long_lines_of_few_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, digest int"
    passage, short = " ".join(f"p{k}" for k in range(60)), "a line of a few words"
    own = lambda d: " ".join(f"own{d}x{k}" for k in range(200))
    docs = spark.createDataFrame([(d, f"{own(d)}\n{passage}\n{short}", "en", None, 0, 0.5, "k", 1) for d in (1, 2, 3)], schema)
    for name, stage in corpus_pipeline.STAGES:
        if name in ("line dedup", "n-gram Jaccard join"):
            docs = stage(spark, docs, SF)
    want = [(1, f"{own(1)}\n{passage}\n{short}"), *((d, f"{own(d)}\n{short}") for d in (2, 3))]
    assert rows(docs) == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_clashing_column_names(spark):
    """Columns named as the stages name their own for a while come through, values and order."""
    names = ["__d", "__G", "__keep", "__digest", "digest", "keep", "score", "label", "root", "copies", "n"]
    line = "one line that all of them hold"
    docs = [(k, f"{line}\n" + " ".join(f"w{k}x{j}" for j in range(60)), *[k] * len(names)) for k in range(12)] + [(50, docs_text := "a b c d e f g", *[50] * len(names)), (51, docs_text, *[51] * len(names))]
    df = spark.createDataFrame(docs, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        if name in ("line dedup", "n-gram Jaccard join"):
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            got = {r[0]: tuple(r) for r in out.collect()}
            assert all(set(r[2:]) == {d} for d, r in got.items()) and set(got) == ({*range(12), 50} | ({51} if name == "line dedup" else set()))
            if name == "line dedup":
                assert [d for d, r in got.items() if line in r[1]] == [0]
