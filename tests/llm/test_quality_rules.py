import random
import re
from collections import Counter

from pyspark.sql import functions as F

from twigspark.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, kept string, n_words int"


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def texts():
    r = random.Random(1)
    words = [f"word{k}" for k in range(40)] + ["é x", "#tag", "日本"]
    made = [None, "", " \n\t", "a\x0bb\x0cc", "one two\none two\n\n", "x " * 5000, " ".join(f"w{k}" for k in range(20_000)) + " " + " ".join(f"w{k}" for k in range(9_000)), "\x1c a"]
    for _ in range(120):
        part = r.choices(words, k=r.randint(1, 60))
        made.append(r.choice([" ", "\n", " \t"]).join(part + part[: r.choice([0, 5, 8, 9, 20])] + r.choices(words, k=r.randint(0, 30))))
    return made


def test_base_columns(spark):
    rows = [(k, t, "k", 3) for k, t in enumerate(texts())] + [(0, None, "k", 3), (None, "a b", None, None)]
    got = Q.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = Counter((d, *base(t)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_cascade_equals_all_rules_in_any_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = [*Q.base_rules(Q.whole("text")), *Q.further_rules(Q.whole("text"))]
    marks = df.select("doc_id", *[r.rejects.alias(r.name) for r in rules]).collect()
    want = sorted(r.doc_id for r in marks if not any(r[x.name] for x in rules))
    for order in (rules, rules[::-1]):
        assert sorted(r.doc_id for r in df.where(Q.cascade(order)).collect()) == want
    assert sorted(r.doc_id for r in Q.keep(df).collect()) == want == sorted(r.doc_id for r in Q.report(df).where("kept").collect())


def test_order_is_by_rejections_per_second(spark):
    df = spark.createDataFrame([(k, "a b c") for k in range(400)], "doc_id long, text string")
    never, always = Q.Rule("never", F.length("text") < 0), Q.Rule("always", F.length("text") > 0)
    assert [r.name for r in Q.ordered(df, [never, always])] == ["always", "never"]


def test_clean_prose_stays(spark):
    prose = " ".join(f"Satz{k % 17} und Wort{k}, klein." for k in range(60))
    assert Q.keep(spark.createDataFrame([(1, prose)], "doc_id long, text string")).count() == 1


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Q.report(df).collect() == [] and Q.keep(df).columns == df.columns and Q.keep(df).count() == 0


def test_two_calls_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [[r.name for r in Q.ordered(df, Q.all_rules)] for _ in range(2)]
    assert names[0] == names[1] and sorted(names[0]) == sorted(r.name for r in Q.all_rules(Q.parts_of(Q.whole("text"))))


def test_kept_is_the_same_in_both_uses(spark):
    """The pipeline's filter and the report, over odd texts, with clashing column names."""
    df = spark.createDataFrame([(k, t, "k", 3) for k, t in enumerate(texts())], SCHEMA)
    assert sorted(r.doc_id for r in Q.keep(df).collect()) == sorted(r.doc_id for r in Q.report(df).where("kept").collect())
