"""Personal data in texts: fixed patterns, opaque secrets, and the terms that reveal either, by DataFrame functions alone.

Protected entities are the values that the patterns find and secrets: unbroken strings of at least SECRET_CHARS letters, digits, - and _ that change between letters and digits at least SECRET_TURNS times, as
keys and tokens do and words don't. Terms are runs of at least three letters, lower-cased. Over all documents it is counted how many hold an entity e (n_e), a term t (n_t), and t within CONTEXT characters of e
(n_et). With N documents, the information that t gives of e is log2(N * n_et / (n_e * (n_t + 1))), which the one document more keeps below e's own information content log2(N / n_e). A term near an entity in at
least MIN_DOCS documents discloses it if it gives more than the content's GENERALISE-th part; it is removed beyond its REMOVE-th part, else generalised to a label. Disclosing terms are found
everywhere in the documents that hold the entity; documents without an entity are left alone.

The patterns are written so that each reads a text once, without recursion in the regular expression engine, and yields the leftmost matches of the plain patterns: separators inside a number or a domain
are first replaced by a mark of one character, which leaves positions as they are.

Shuffles carry pairs of entities and nearby terms, counted before they are sent; a table of terms or flagged texts is broadcast only if it measures at most BROADCAST_BYTES, else both sides are shuffled. Copies of a
text share one row of flagged terms.

Defined cases: a null or empty text has no span (`sanitise` leaves null); texts are read whole; repeated rows and null or equal ids are judged row by row, and each counts as a document; an empty table gives an empty one; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, free, let
from .quality_rules import whole

KINDS = ["email", "ip", "card", "phone", "secret", "term"]
CONTEXT, MIN_DOCS, GENERALISE, REMOVE = 60, 3, 1.1, 1.03
SECRET_CHARS, SECRET_TURNS = 20, 5
#: A separator between two digits or two labels of a domain; what the text itself has of it becomes OTHER.
MARK, OTHER = "\x01", "\x02"
TERM = "[\\p{L}\\p{M}]{3,}+"
#: Fixed patterns, on marked texts. An address begins where the characters before it end, or right behind another address.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+\\x01-]))[A-Za-z0-9._%+\\x01-]++@[A-Za-z0-9-]++\\x01[A-Za-z0-9\\x01-]++"
IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9][0-9\\x01]++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SECRET = "[A-Za-z0-9_-]{20,}+"
#: Numbers summed together before their sums are: an array that grows by one number at a time is copied each time.
CHUNK = 256
SPAN = "array<struct<start: int, end: int, kind: string, value: string, near: array<string>>>"


def running(values: Column) -> Column:
    """Sums of the values up to and with each."""

    def short(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(x, start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"] + v)).alias("a")), lambda acc: acc["a"])

    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    joined = lambda cs: F.flatten(F.zip_with(cs, short(F.transform(cs, total)), lambda c, s: F.transform(short(c), lambda x: x + s - total(c))))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(chunks, joined))


def placed(text: Column, pattern: str, build) -> Column:
    """build(start, match, gap before, gap behind) of every match, in order; starts are in code points."""

    def of(gaps: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(running(steps), lambda ends: F.transform(found, lambda m, i: build(F.get(ends, i) - F.length(m), m, F.get(gaps, i), F.get(gaps, i + 1))))

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: of(gaps, found)))


def terms_near(before: Column, behind: Column) -> Column:
    """The terms of the CONTEXT characters before and behind, but for those that the limit may have cut."""
    runs = lambda x: F.regexp_extract_all(x, F.lit(TERM), F.lit(0))
    left = let(runs(F.substring(before, -CONTEXT, CONTEXT)), lambda r: F.when(F.length(before) > CONTEXT, F.slice(r, 2, F.greatest(F.size(r), F.lit(1)))).otherwise(r))
    right = let(runs(F.substring(behind, 1, CONTEXT)), lambda r: F.when(F.length(behind) > CONTEXT, F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r))
    return F.array_distinct(F.transform(F.concat(left, right), lambda x: F.lower(x)))


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int")
        doubled = 2 * d - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def found_spans(text: Column) -> Column:
    """Spans (start, end, kind, value, near) of the patterns and of secrets, by start, then kind as listed; near are the terms around."""
    t, unmarked = text, F.translate(text, MARK, OTHER)
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")

    def spans(kind: str, marked: Column, pattern: str, value, good) -> Column:
        made = placed(marked, pattern, lambda s, m, a, b: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), F.lit(kind).alias("kind"), value(m).alias("value"), terms_near(a, b).alias("near")))
        return F.filter(made, lambda x: good(x["value"]))

    dots = F.regexp_replace(unmarked, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", MARK)
    numbers = F.regexp_replace(unmarked, "(?<=[0-9])[ -](?=[0-9])", MARK)
    turns = lambda v: F.regexp_count(v, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
    none = F.array().cast(SPAN)
    # Each pattern is preceded by a cheap test that only texts with a match, or nearly, pass.
    kinds = [
        F.when(t.contains("@"), spans("email", dots, EMAIL, lambda m: F.translate(m, MARK, "."), lambda v: F.lit(True))),
        F.when(t.rlike("[0-9]\\.[0-9]"), spans("ip", t, IP, lambda m: m, lambda v: v.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$"))),
        F.when(t.rlike("[0-9](?:[ -]?[0-9]){13}"), spans("card", numbers, CARD, digits, lambda v: F.length(v).between(14, 19) & luhn(v))),
        F.when(t.contains("+"), spans("phone", t, PHONE, digits, lambda v: F.length(v).between(10, 15))),
        F.when(t.rlike(SECRET), spans("secret", t, SECRET, lambda m: m, lambda v: turns(v) >= SECRET_TURNS)),
    ]
    every = F.concat(*[F.coalesce(k.cast(SPAN), none) for k in kinds])
    return let(every, lambda s: F.when(F.size(s) < 2, s).otherwise(F.array_sort(s, in_order)))


def in_order(a: Column, b: Column) -> Column:
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int")
    by = F.when(a["start"] != b["start"], a["start"] - b["start"]).when(rank(a) != rank(b), rank(a) - rank(b))
    return by.otherwise(a["end"] - b["end"])


def entity(span: Column) -> Column:
    return F.md5(F.concat_ws(":", span["kind"], span["value"]))


def fits(df: DataFrame, *columns: str) -> bool:
    size = df.agg(F.coalesce(F.sum(sum((F.octet_length(F.col(c)) for c in columns), F.lit(32))), F.lit(0))).first()[0]
    return size <= BROADCAST_BYTES


def disclosing(docs: DataFrame, text: str, spans: str) -> DataFrame:
    """(entity, term, removed) of all disclosing terms, from docs with the column spans."""
    pair = lambda s: F.concat(F.array(F.struct(entity(s).alias("entity"), F.lit(None).cast("string").alias("term"))), F.transform(s["near"], lambda x: F.struct(entity(s).alias("entity"), x.alias("term"))))
    held = docs.where(F.size(spans) > 0).select(F.explode(F.array_distinct(F.flatten(F.transform(spans, pair)))).alias("p"))
    n = cut(held.groupBy("p.entity", "p.term").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS))
    near = n.where("term is not null").withColumnRenamed("n", "n_et")
    names = cut(near.select("term").distinct())
    if names.isEmpty():
        return near.select("entity", "term", F.lit(True).alias("removed"))
    terms = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), lambda x: F.lower(x)))
    # All terms are counted, in each task first, and joined then: a common one leaves a task as one row.
    counted = docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).join(names, "term")
    every, content = F.lit(float(docs.count())), F.log2(F.col("every") / F.col("n_e"))
    gives = F.log2(F.col("every") * F.col("n_et") / (F.col("n_e") * (F.col("n_t") + 1)))
    found = near.join(n.where("term is null").select("entity", F.col("n").alias("n_e")), "entity").join(counted, "term").withColumn("every", every).withColumns({"gives": gives, "content": content})
    return cut(found.where(F.col("gives") >= F.col("content") / GENERALISE).select("entity", "term", (F.col("gives") >= F.col("content") / REMOVE).alias("removed")))


def term_spans(text: Column, terms: Column, spans: Column) -> Column:
    """Where the terms (term, removed) occur in text, outside of spans."""
    names = F.transform(terms, lambda x: x["term"])
    made = placed(text, TERM, lambda s, m, a, b: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), F.lit("term").alias("kind"), F.lower(m).alias("value")))
    free_of = lambda x: ~F.exists(spans, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    hit = F.filter(made, lambda x: F.array_contains(names, x["value"]) & free_of(x))
    removed = lambda v: F.exists(terms, lambda x: (x["term"] == v) & x["removed"])
    return F.transform(hit, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), removed(x["value"]).alias("removed")))


def find(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with the column spans: (start, end, kind, removed) in code points, end exclusive, by start, then kind. removed is false where a term is only generalised."""
    s, e, g, w, t, k = free(docs, "__spans", "__entities", "__digest", "__whole", "__terms", "__key")
    d = docs.withColumn(w, whole(text)).withColumn(s, found_spans(F.col(w)))
    flagged = disclosing(d, w, s)
    few = fits(flagged, "entity", "term")
    # By text, not by row: copies share their terms. Texts without an entity have a key of their own that spreads them and finds nothing.
    key = F.when(F.size(s) > 0, F.md5(w)).otherwise(F.concat(F.lit("-"), F.xxhash64(w).cast("string")))
    texts = d.where(F.size(s) > 0).select(F.md5(w).alias(g), F.explode(F.array_distinct(F.transform(s, entity))).alias(e)).distinct()
    told = texts.join(F.broadcast(flagged) if few else flagged, F.col(e) == F.col("entity")).groupBy(g, "term").agg(F.max("removed").alias("removed")).groupBy(g).agg(F.sort_array(F.collect_list(F.struct("term", "removed"))).alias(t))
    told = cut(told)
    size = told.agg(F.coalesce(F.sum(F.aggregate(t, F.lit(0), lambda acc, x: acc + F.octet_length(x["term"]) + 8) + 32), F.lit(0))).first()[0]
    both = d.withColumn(k, key).join(F.broadcast(told) if size <= BROADCAST_BYTES else told, F.col(k) == F.col(g), "left")
    plain = F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(True).alias("removed")))
    every = F.when(F.col(t).isNull(), plain).otherwise(F.array_sort(F.concat(plain, term_spans(F.col(w), F.col(t), F.col(s))), in_order))
    return both.withColumn(spans, every).drop(*{s, e, g, w, t, k} - {spans})


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans of text replaced by labels such as [EMAIL]; terms that have to go are removed, those that are generalised become [TERM]. Of spans that overlap the first counts, as far as both reach."""
    (s,) = free(docs, "__spans")
    t = F.col(f"`{text}`")
    label = lambda x: F.when((x["kind"] == "term") & x["removed"], "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        added = F.when(fresh, F.array(F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), label(x))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], added).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.col(s), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return find(docs, text, s).withColumn(text, F.when(F.size(s) == 0, t).otherwise(done)).drop(s)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 of the spans of these kinds, and spans, all of them as kind:start:end."""
    d = find(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(KINDS[:4]))
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *map(count, KINDS[:4]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
