import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from twigspark.llm import pii as P
from twigspark.llm.oracles import PII

#: The patterns as they are asked for; those of the module are written otherwise.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "secret": r"[A-Za-z0-9_-]{20,}"}
LETTERS = r"[^\W\d_]{3,}"


def luhn(x):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(x))) % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "secret":
        return len(re.findall("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", m)) >= 5
    return True


def value(kind, m):
    return re.sub("[^0-9]", "", m) if kind in ("card", "phone") else m


def base(text):
    """(start, kind, end, value, terms near) by start, then kind as listed."""
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        found = list(re.finditer(pattern, text))
        for k, m in enumerate(found):
            if good(kind, m.group()):
                before = text[found[k - 1].end() if k else 0 : m.start()]
                behind = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
                left, right = re.findall(LETTERS, before[-P.CONTEXT :]), re.findall(LETTERS, behind[: P.CONTEXT])
                left, right = left[len(before) > P.CONTEXT :], right[: len(right) - 1] if len(behind) > P.CONTEXT else right
                out.append((m.start(), rank, m.end(), kind, value(kind, m.group()), {x.lower() for x in left + right}))
    return sorted(out, key=lambda x: x[:3])


def plain(texts):
    """Spans (start, end, kind, removed) of every text, with the counts over all of them."""
    texts = [t or "" for t in texts]
    spans = [base(t) for t in texts]
    n_e, n_et, n_t = Counter(), Counter(), Counter(x for t in texts for x in {y.lower() for y in re.findall(LETTERS, t)})
    for s in spans:
        n_e.update({x[3:5] for x in s})
        n_et.update({(*x[3:5], y) for x in s for y in x[5]})
    level = defaultdict(dict)
    for (kind, v, term), n in n_et.items():
        if n >= P.MIN_DOCS:
            gives = math.log2(len(texts) * n / (n_e[kind, v] * (n_t[term] + 1)))
            content = math.log2(len(texts) / n_e[kind, v])
            if gives >= content / P.GENERALISE:
                level[kind, v][term] = gives >= content / P.REMOVE
    out = []
    for t, s in zip(texts, spans, strict=True):
        told = defaultdict(bool)
        for x in s:
            for term, removed in level[x[3:5]].items():
                told[term] |= removed
        terms = [(m.start(), 5, m.end(), "term", told[m.group().lower()]) for m in re.finditer(LETTERS, t) if m.group().lower() in told]
        terms = [x for x in terms if not any(y[0] < x[2] and x[0] < y[2] for y in s)]
        out.append([(a, b, k, r) for a, _, b, k, r in sorted([(*x[:4], True) for x in s] + terms, key=lambda x: x[:3])])
    return out


def texts():
    r = random.Random(7)
    bits = ["a@b.c", "x.y@d-e.fr..g@h.i", "@", "a@b.c.d@e.f.g", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.03.255", "4111 1111-1111 1111", "4111  1111", "49927398716000", "+1 (017) 555-7713", "+49", "+1+2 345 678 901 2",
            'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "state-of-the-art-2019-2020", "\x01", "5\x015", "日本", "é", "ZEILE"]
    made = [None, "", "4111 1111 1111 1111", "a@b.c", "1 " * 40_000 + "4111111111111111", "a." * 30_000 + "@" + "b." * 30_000 + "c", "+1" + " " * 50_000, "9" * 50_000 + ".1.1.1", "a@b.c " * 3000]
    for _ in range(150):
        made.append("".join(r.choice(bits) + r.choice(["", " ", ".", "-", "\n", ", "]) for _ in range(r.randint(1, 12))))
    # Entities with words around that only they have, in copies and apart.
    for k in range(6):
        made += [f"Herr Ünal{'abcdef'[k]}son wohnt bei p{k}@mail.example.org im Haus.", f"Von {'abcdef'[k]}vogel und Ünal{'abcdef'[k]}son: p{k}@mail.example.org, im Haus", "im Haus wohnt Herr und von bei"] * 12
    made += ["Ünalason im Garten"] * 2
    return made


def test_spans_equal_the_plain_version(spark):
    t = texts()
    rows = [(k if k % 7 else None, x, "k", 1) for k, x in enumerate(t)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int").withColumn("at", F.monotonically_increasing_id()).repartition(4)
    out = P.find(df, spans="found")
    assert out.columns == [*df.columns, "found"]
    got = {r.text: [tuple(x) for x in r.found] for r in out.collect()}
    for x, w in zip(t, plain(t), strict=True):
        assert got[x] == w, x and x[:200]
    assert any(s[2] == "term" and s[3] for v in got.values() for s in v)
    assert got["Ünalason im Garten"] == [] and got["im Haus wohnt Herr und von bei"] == []


def test_sql_equals_the_report_where_terms_disclose(spark):
    rows = [(k, x) for k, x in enumerate(texts()) if len(x or "") < 10_000]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql("select doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans from (" + PII + ")").fetchall()}
    assert {r.doc_id: tuple(r)[1:] for r in P.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert any("term:" in r[5] for r in want.values())


def test_report(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    want = {}
    for r, s in zip(rows, plain([r.text for r in rows]), strict=True):
        line = lambda x: ",".join(f"{k}:{a}:{b}" for a, b, k, _ in x)
        n = Counter(x[2] for x in s)
        want[r.doc_id] = (*(n[k] for k in P.KINDS[:4]), hashlib.sha256(line([x for x in s if x[2] in P.KINDS[:4]]).encode()).hexdigest(), line(s))
    assert {r.doc_id: tuple(r)[1:] for r in P.report(df).collect()} == want
    assert P.report(df.limit(0)).collect() == []


def test_sanitised_text(spark):
    rows = [(1, "mail a.b@c.de, +1 (017) 555-7713 or 4111 1111 1111 1111!"), (2, None), (3, "nothing here 123")] + [(k, f"Frau Quirrlen nahe quirr@len.org nr {k}") for k in range(4, 9)] + [(k, f"Herr Allgemein Nummer {k}") for k in range(9, 300)]
    got = {r.doc_id: r.text for r in P.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "mail [EMAIL], [PHONE] or [CARD]!" and got[2] is None and got[3] == "nothing here 123"
    for k in range(4, 9):
        assert "quirr" not in got[k].lower() and got[k].endswith(f"nr {k}")


def test_no_python_in_the_plan(spark, sf):
    plan = P.report(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
