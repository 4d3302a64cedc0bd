"""Runs of words that repeat periodically, by bit-parallel comparison of a text with itself at every lag.

A text's words get dense ids, and each bit of the ids becomes one big integer with a bit per word (a plane). For a lag p the planes are XORed with
themselves shifted by p and ORed: a zero says that the words p apart are identical. Zeros that go on long enough are isolated by ANDing their mask with itself
shifted by 1, 2, 4, ... A few planes are compared first; most lags have no long stretch left by then, and the others aren't looked at.

Work is n * n / 8 word pairs, 30 a machine operation, and memory a few integers of n bits: 20,000 words take hundredths of a second, a million about a minute.
Texts are independent, so there is no shuffle.

Defined cases: a null or empty text has no words and no run (`collapse` leaves null as it is); texts are read whole; repeated rows and null or equal ids are judged row by row;
an empty table gives an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, let, small_batches
from .quality_rules import words_of

#: Words of a run at least, and how often its period fits into it at least.
MIN_WORDS, MIN_REPEATS = 6, 4
#: Planes that are compared before the others.
FIRST_PLANES = 3
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def planes_of(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the ids: its bit i is that of word i."""
    return [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(max(1, int(ids.max()).bit_length()))]


def long_stretches(zeros: int, need: int) -> int:
    """Where a stretch of at least need set bits begins or goes on for as many."""
    have = 1
    while have < need and zeros:
        step = min(have, need - have)
        zeros &= zeros >> step
        have += step
    return zeros


def set_bits(x: int) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(-(-x.bit_length() // 8), "little"), "u1"), bitorder="little")).tolist()


def runs_of(words: list, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every stretch of words that keeps its period, can't be extended, and has at least min_words words and min_repeats periods, by start."""
    n = len(words)
    if n < max(min_words, min_repeats):
        return []
    given: dict = {}
    planes = planes_of(np.fromiter((given.setdefault(w, len(given)) for w in words), "i8", n))
    found: dict[tuple[int, int], int] = {}
    for p in range(1, n // min_repeats + 1):
        every = (1 << (n - p)) - 1
        need = max(min_words - p, (min_repeats - 1) * p, 1)
        differ = 0
        for k in range(0, len(planes), FIRST_PLANES):
            for plane in planes[k : k + FIRST_PLANES]:
                differ |= plane ^ (plane >> p)
            left = long_stretches(every & ~differ, need)
            if not left:
                break
        if left:
            for a, b in zip(set_bits(left & ~(left << 1)), set_bits(left & ~(left >> 1)), strict=True):
                # A multiple of a period has the same stretch: the smallest came first.
                found.setdefault((a, b + need + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without what follows the first period of a run."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def found(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """docs with, in place of text, n_words, runs (start, length, period; by start), and collapsed: the kept words joined by one space. Columns of docs that have these names are left out."""
    new = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())])
    kept = [f for f in docs.schema if f.name != text and f.name.lower() not in new.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, runs, left = [], [], []
            for t in b[text]:
                words = (t.as_py() or "").encode().split()
                r = runs_of(words, min_words, min_repeats)
                counts.append(len(words))
                runs.append([{"start": x, "length": y, "period": z} for x, y, z in r])
                left.append(b" ".join(collapsed(words, r)).decode())
            added = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in kept), *added], [*(f.name for f in kept), *new.fieldNames()])

    return small_batches(docs).select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`")).mapInArrow(run, T.StructType([*kept, *new]))


def collapse(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """docs with every run of text cut to its first period and words joined by one space; a text without a run stays as it is."""
    names = {c: n for c, n in zip(docs.columns, free(docs, *(f"__{k}" for k in range(len(docs.columns)))), strict=True)}
    (whole,) = free(docs, "__whole")
    x = found(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text}`").alias(whole)), whole, min_words, min_repeats)
    changed = F.when(F.size("runs") == 0, F.col(names[text])).otherwise(F.col("collapsed"))
    return x.select(*[(changed if c == text else F.col(n)).alias(c) for c, n in names.items()])


def repeated(text: Column, doc_id: Column) -> Column:
    """text, or for every tenth doc_id by crc32 its words with the tail replaced by repetitions of a period that the same number chooses."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        # Where there is no word, n is 1: expressions may be evaluated before the test that guards them.
        n = F.greatest(F.size(w), F.lit(1)).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.when(F.size(w) > 0, F.array_join(F.transform(at, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words_of(F.coalesce(text, F.lit(""))), tail)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """Per document, after `repeated`: doc_id, n_runs, start, length, period and exponent_milli of the longest run (the first, of equals), and digests of all runs and of the collapsed words."""
    d = found(docs.select("doc_id", repeated(F.col("text"), F.col("doc_id")).alias("text"))).withColumn("collapsed_sha256", F.sha2("collapsed", 256))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(line, 256).alias("runs_sha256"), "collapsed_sha256")
    return d.select("doc_id", "n_runs", F.col("m.s").alias("start"), (-F.col("m.l")).alias("length"), F.col("m.p").alias("period"), F.floor(-1000 * F.col("m.l") / F.col("m.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
