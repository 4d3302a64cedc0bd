"""Quality rules as a short-circuit cascade of native column expressions.

Each rule is one boolean expression, true where the document is rejected, over the text, its words and its lines. On a bounded sample from all partitions
the cascade measures what each rule costs and how many documents it rejects, and orders the rules by rejections per second among the documents that earlier
rules leave. A cost is the least of several warm runs over the cached sample beyond that of a run without a rule; words and lines are cached with the sample, and all else that a rule needs of a text (counts of
characters, hashes of windows) is measured with it. The order changes the speed only: a document is kept if no rule rejects it, so any order has the same result.

Defined cases: a null or empty text has no words, so `too_few_words` rejects it; very long texts are
read whole (sorting windows is n log n in their length); repeated rows and equal doc_ids are judged row by
row; an empty table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Rows, about, of the sample from which costs and selectivities are estimated; it never affects which documents are kept.
SAMPLE_ROWS = 400
#: Evaluations of a rule in a timed run, and timed runs of each rule, after one that isn't timed.
EVALUATIONS, RUNS = 1000, 3
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))


def repeats(values: Column) -> Column:
    return (F.size(values) - F.size(F.array_distinct(values))).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of `window` words whose text occurs at least twice in the document, the first occurrence included.

    Windows are 64-bit hashes. Most texts repeat none, which one distinct count shows; otherwise
    (hash, start) pairs are sorted, starts whose hash has an equal neighbour are sorted again, and the union of their
    windows is measured from the gaps between starts.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            like = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            kept = F.filter(s, lambda x, j: like(x, j - 1) | like(x, j + 1))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        def measured(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        return let(let(pairs, starts), measured)

    def windows(hw: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(hw) - window)
        return F.transform(first, lambda i: F.xxhash64(*[F.get(hw, i + k) for k in range(window)]))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), counted))


@dataclass(frozen=True)
class Parts:
    """What rules ask of a text, each measured once."""

    text: Column
    words: Column
    lines: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_repeat_words: Column


def parts_of(text: Column, words: Column | None = None, lines: Column | None = None) -> Parts:
    w, x = words_of(text) if words is None else words, worded_lines(text) if lines is None else lines
    return Parts(text, w, x, F.size(w).cast("long"), F.length(F.array_join(w, "")).cast("long"), count_of(text, SYMBOLS), repeated_words(w))


def base_rules(text: Column | Parts) -> list[Rule]:
    """The rules that decide base_failed."""
    p = text if isinstance(text, Parts) else parts_of(text)
    return [Rule("too_few_words", p.n_words < 20), Rule("repeated_windows", 100 * p.n_repeat_words > 30 * p.n_words)]


def further_rules(text: Column | Parts) -> list[Rule]:
    """Rules of published web-corpus filters, with thresholds that plain prose doesn't reach."""
    p = text if isinstance(text, Parts) else parts_of(text)
    capitals, letters = count_of(p.text, "\\p{Lu}"), F.length(p.text) - F.length(F.regexp_replace(p.text, "\\p{L}+", ""))
    chars = lambda x: F.length(F.array_join(x, ""))
    return [
        Rule("symbols", 10 * p.n_symbols > p.n_words),
        Rule("shouting", 2 * capitals > letters),
        Rule("exclaims", 5 * count_of(p.text, "!") > p.n_words),
        # By characters: a short line that opens and closes a text of three lines is a third of its lines, but little of it.
        Rule("duplicate_lines", let(chars(p.lines), lambda c: 5 * (c - chars(F.array_distinct(p.lines))) > c)),
        Rule("word_length", (p.word_chars < 2 * p.n_words) | (p.word_chars > 20 * p.n_words)),
        Rule("few_letters", 10 * F.size(F.filter(p.words, lambda x: x.rlike("\\p{L}"))) < 6 * p.n_words),
        Rule("ellipses", 10 * F.size(F.filter(p.lines, lambda y: y.rlike("(\\.\\.\\.|…)\\s*$"))) > 3 * F.size(p.lines)),
        Rule("bullets", 10 * F.size(F.filter(p.lines, lambda y: y.rlike("^\\s*[-*•●]\\s"))) > 9 * F.size(p.lines)),
    ]


def whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def sampled(df: DataFrame, text: str, rows: int) -> DataFrame:
    """About so many rows of text, from all partitions and whatever their length; they stay on the executors. A table of no more rows is taken whole."""
    every = max(1, round(df.count() / rows))
    t = F.col(f"`{text}`")
    return df.select(t).where(F.pmod(F.xxhash64(t, F.monotonically_increasing_id()), F.lit(every)) == 0).repartition(1)


def ordered(df: DataFrame, rules: list[Rule] | Callable[[Parts], list[Rule]], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by rejections per second on a sample of about sample_rows rows, each measured among the rows that the rules before it leave.

    A function from Parts to rules gives rules that share words and lines, which are cached with the sample; what else a rule asks of a text is part of its own cost.
    """
    sample = sampled(df, text, sample_rows)
    if callable(rules):
        sample = sample.withColumns({"__w": words_of(whole(text)), "__l": worded_lines(whole(text))})
        rules = rules(parts_of(whole(text), F.col("__w"), F.col("__l")))
    sample.persist()
    try:
        marks = [F.coalesce(r.rejects, F.lit(False)).alias(r.name) for r in rules]
        rows = [(x.asDict(), x["count"]) for x in sample.select(*marks).groupBy(*[r.name for r in rules]).count().collect()]
        if not rows:
            return rules
        repeats = max(1, EVALUATIONS // sum(n for _, n in rows))
        often = sample.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        tests = {None: often.agg(F.count_if(F.col("__k") < 0))} | {r.name: often.agg(F.count_if(r.rejects)) for r in rules}
        took = dict.fromkeys(tests, float("inf"))
        for k in range(1 + RUNS):
            for name, test in tests.items():
                began = time.perf_counter()
                test.collect()
                took[name] = min(took[name], time.perf_counter() - began) if k else took[name]
    finally:
        sample.unpersist()
    # What a run costs without any rule isn't a rule's own; less than a part of it can't be told apart.
    cost = {r.name: max(took[r.name] - took[None], took[None] / 16) for r in rules}
    left, out = list(rules), []
    while left:
        best = max(left, key=lambda r: sum(n for x, n in rows if x[r.name]) / cost[r.name])
        rows = [(x, n) for x, n in rows if not x[best.name]]
        out.append(best)
        left.remove(best)
    return out


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects; a rule is evaluated only where all before it let the document pass."""
    passed = F.lit(True)
    for r in reversed(rules):
        passed = F.when(r.rejects, F.lit(False)).otherwise(passed)
    return passed


def all_rules(p: Parts) -> list[Rule]:
    return [*base_rules(p), *further_rules(p)]


def named(rules: list[Rule], order: list[Rule]) -> list[Rule]:
    """rules in the order of others of the same names."""
    by = {r.name: r for r in rules}
    return [by[r.name] for r in order]


def keep(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    if rules:
        return docs.where(cascade(ordered(docs, rules, text, sample_rows)))
    order = ordered(docs, all_rules, text, sample_rows)
    t = whole(text)
    return docs.where(let(words_of(t), lambda w: let(worded_lines(t), lambda x: cascade(named(all_rules(parts_of(t, w, x)), order)))))


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    order = ordered(docs, further_rules, text, sample_rows)
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole(text).alias("__t"))
    d = d.select("doc_id", "__t", words_of(F.col("__t")).alias("__w"), worded_lines(F.col("__t")).alias("__l"))
    p = parts_of(F.col("__t"), F.col("__w"), F.col("__l"))
    d = d.select("*", p.n_words.alias("n_words"), p.word_chars.alias("word_chars"), p.n_symbols.alias("n_symbols"), repeats(p.lines).alias("n_dup_lines"), p.n_repeat_words.alias("n_repeat_words"))
    p = Parts(p.text, p.words, p.lines, *map(F.col, ("n_words", "word_chars", "n_symbols", "n_repeat_words")))
    failed = base_rules(p)[0].rejects | base_rules(p)[1].rejects
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(named(further_rules(p), order)))).drop("__t", "__w", "__l")
