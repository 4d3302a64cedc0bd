"""URL filters: written rules first, then a tree of path templates per host.

A rule (verdict, "host/path") fits its host and all subdomains where the path starts with the rule's; the longest fitting rule decides.
All other URLs are judged by their template. Per host, a path segment that enough of the host's URLs share at its depth, or that a rule for
the host names, stays literal, all others become a wildcard of their shape; the resulting tree of templates is small whatever the number of URLs. Sibling
literal branches whose next levels are distributed alike are merged: labelled ones if their shares of bad don't differ, unlabelled ones with each other, and an
unlabelled branch with a labelled one if it is alike to that one alone; where labelled branches of different purity look the same, it stays apart. A template
is rejected if its share of bad, smoothed towards one half, is high; each of its URLs without a label smooths as well, by a part of a URL (`spread`), so that what few
labels say reaches few URLs. URLs are labelled by the rules that fit them and by an optional table of labels.

Only counts are grouped by host: rows of a host with a third of all URLs are counted by partial aggregation, and the
templates of a host come to at most (1 / share) literals and a fixed number of shapes a level, whatever the number of its URLs.

Defined cases: a URL that is null or has no "://" has an empty host and path; no rule fits an empty host; a template without labels
is allowed; rows that repeat a page_id are judged row by row; paths deeper than `depth` are cut into that many segments, the last
keeping what remains as one wildcard; an empty table gives an empty table; other columns aren't touched. A literal segment that looks like a wildcard is none (its braces are doubled in a template's name).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut

#: What a literal segment starts with inside a tree, so that none is taken for a wildcard.
LITERAL = "="
#: File endings that a wildcard keeps.
ENDING = r"(?i)(\.(?:html?|xhtml|php|aspx?|jsp|cgi|pdf|jpe?g|png|gif|css|js|xml|txt|json|rss))$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def first_fit(rules: list[tuple[str, str]], host: Column, path: Column, value) -> Column:
    """value(verdict, rule) of the longest fitting rule, else null. Rules are configuration: a list of the size that a plan can hold."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        out = F.when(fits(rule, host, path), F.lit(value(verdict, rule))).otherwise(out)
    return out


def segments(path: Column, depth: int) -> Column:
    return F.split(F.regexp_replace(path, "^/", ""), "/", depth)


def shape(segment: Column) -> Column:
    """A wildcard: runs of digits, words, or anything, with one of a few file endings kept, so that a level has a bounded number of shapes."""
    ending = F.lower(F.regexp_extract(segment, ENDING, 1))
    stem = F.regexp_replace(segment, ENDING, "")
    kind = F.when(segment == "", "").when(stem.rlike("^[0-9]+$"), "{n}").when(stem.rlike("^[\\p{L}_-]+$"), "{w}").otherwise("{*}")
    return F.concat(kind, ending)


@dataclass
class Node:
    """A branch: labelled counts of its URLs, how many end here, and its children; names of literal children start with LITERAL."""

    n: int = 0
    bad: int = 0
    good: int = 0
    ends: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    leaves: list[tuple] = field(default_factory=list)

    def add(self, parts: list[str], key: tuple, n: int, bad: int, good: int) -> None:
        self.n, self.bad, self.good = self.n + n, self.bad + bad, self.good + good
        if parts:
            self.children.setdefault(parts[0], Node()).add(parts[1:], key, n, bad, good)
        else:
            self.ends += n
            self.leaves.append(key)

    def absorb(self, other: Node) -> None:
        self.n, self.bad, self.good, self.ends = self.n + other.n, self.bad + other.bad, self.good + other.good, self.ends + other.ends
        self.leaves += other.leaves
        for k, c in other.children.items():
            if k in self.children:
                self.children[k].absorb(c)
            else:
                self.children[k] = c


def divergence(a: Counter, b: Counter) -> float:
    """Jensen-Shannon divergence in bits."""
    na, nb, out = sum(a.values()), sum(b.values()), 0.0
    for k in {*a, *b}:
        p, q = a[k] / na, b[k] / nb
        m = (p + q) / 2
        out += (p * math.log2(p / m) if p else 0) / 2 + (q * math.log2(q / m) if q else 0) / 2
    return out


def alike(a: Node, b: Node, most: float = 0.05, z: float = 1.96) -> bool:
    """Whether two branches are statistically similar: their next levels are distributed alike and, where both have labels, their shares of bad don't differ."""
    below = lambda x: Counter({k: c.n for k, c in x.children.items()} | ({None: x.ends} if x.ends else {}))
    if not a.n or not b.n or divergence(below(a), below(b)) > most:
        return False
    na, nb = a.bad + a.good, b.bad + b.good
    if not na or not nb:
        return True
    p = (a.bad + b.bad) / (na + nb)
    return abs(a.bad / na - b.bad / nb) <= z * math.sqrt(max(p * (1 - p), 1e-9) * (1 / na + 1 / nb)) + 1e-9


def grouped(node: Node, names: list[str]) -> list[list[str]]:
    """Takes alike children together: the first of a group absorbs the others."""
    out = []
    while names:
        first, rest = names[0], []
        group, whole = [first], node.children[first]
        for other in names[1:]:
            if alike(whole, node.children[other]):
                whole.absorb(node.children.pop(other))
                group.append(other)
            else:
                rest.append(other)
        out.append(group)
        names = rest
    return out


def merged(node: Node) -> None:
    """Merges similar literal branches, from the top down, in order of their names: those with labels, those without, then each of the latter with the only one of the former that it is like."""
    names = sorted(k for k in node.children if k.startswith(LITERAL))
    has = {k: node.children[k].bad + node.children[k].good > 0 for k in names}
    known, others = (grouped(node, [k for k in names if has[k] == flag]) for flag in (True, False))
    near = [[k for k in known if alike(node.children[k[0]], node.children[u[0]])] for u in others]
    for u, found in zip(others, near, strict=True):
        if len(found) == 1:
            node.children[found[0][0]].absorb(node.children.pop(u[0]))
            found[0].extend(u)
    for group in known + [u for u, found in zip(others, near, strict=True) if len(found) != 1]:
        if len(group) > 1:
            node.children["{" + "|".join(sorted(map(shown, group))) + "}"] = node.children.pop(group[0])
    for c in node.children.values():
        merged(c)


def shown(name: str) -> str:
    """A child's name in a template."""
    return name[len(LITERAL) :].replace("{", "{{").replace("}", "}}") if name.startswith(LITERAL) else name


def judged(node: Node, weight: float, spread: float, prefix: str = "") -> list[tuple]:
    """(key, template, purity) of every leaf."""
    labels = node.bad + node.good
    half = weight + spread * (node.n - labels)
    out = [(k, prefix or "/", (node.bad + half / 2) / (labels + half)) for k in node.leaves]
    for k, c in node.children.items():
        out += judged(c, weight, spread, f"{prefix}/{shown(k)}")
    return out


def _host_tree(weight: float, spread: float, key, table):
    import pandas as pd

    root = Node()
    for parts, n, bad, good in sorted(zip(table["parts"].map(list), table["n"], table["bad"], table["good"], strict=True), key=lambda r: r[0]):
        root.add(parts, tuple(parts), int(n), int(bad), int(good))
    merged(root)
    rows = judged(root, weight, spread)
    return pd.DataFrame({"host": [key[0]] * len(rows), "parts": [list(r[0]) for r in rows], "template": [r[1] for r in rows], "purity": [r[2] for r in rows]})


def sized(df: DataFrame, size: Column) -> DataFrame:
    """df (checkpointed) as a side to broadcast if its rows' sizes sum up to at most BROADCAST_BYTES, else as the built side of a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df.hint("shuffle_hash")


def list_bytes(c: str) -> Column:
    return F.octet_length(F.concat_ws("/", c)) + 16 * F.size(c) + 64


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, share: float = 0.05, support: int = 20, weight: float = 4.0, reject: float = 0.8, depth: int = 8, url: str = "url", page_id: str = "page_id", spread: float = 0.1) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template, purity. labels: (url, bad 0/1), further labelled URLs."""
    u = F.col(f"`{url}`")
    p = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    p = p.withColumn("rule", first_fit(rules, F.col("host"), F.col("path"), lambda v, r: r)).withColumn("by_rule", first_fit(rules, F.col("host"), F.col("path"), lambda v, r: v))
    p = p.withColumn("parts", segments(F.col("path"), depth))
    known = p.select("host", "parts", (F.col("by_rule") == "block").cast("int").alias("bad"))
    if labels is not None:
        more = labels.select(host_of(F.col("url")).alias("host"), segments(path_of(F.col("url")), depth).alias("parts"), F.col("bad").cast("int").alias("bad"))
        known = known.unionByName(more)
    at = known.select("host", F.posexplode("parts").alias("level", "segment")).groupBy("host", "level", "segment").count()
    total = at.groupBy("host", "level").agg(F.sum("count").alias("total"))
    literal = at.join(total, ["host", "level"]).where((F.col("count") >= support) & (F.col("count") >= share * F.col("total")) & (F.col("segment") != ""))
    literal = sized(cut(literal.groupBy("host").agg(F.collect_set(F.concat_ws("/", "level", "segment")).alias("literal"))), list_bytes("literal"))

    named = [(rule.partition("/")[0], level, s) for _, rule in rules for level, s in enumerate(rule.partition("/")[2].split("/")[:-1]) if s and level < depth - 1]

    def by_rule(s: Column, i: Column) -> Column:
        """Whether a rule that may fit the host names the segment."""
        host, out = F.col("host"), F.lit(False)
        for name, level, segment in dict.fromkeys(named):
            out = out | ((i == level) & (s == segment) & ((host == name) | host.endswith("." + name)))
        return out

    def generalised(df: DataFrame) -> DataFrame:
        kept = lambda s, i: F.array_contains(F.coalesce("literal", F.array().cast("array<string>")), F.concat_ws("/", i, s))
        last = lambda s, i: F.when(s.contains("/"), F.lit("{*}")).otherwise(shape(s))
        return df.join(literal, "host", "left").withColumn("parts", F.transform("parts", lambda s, i: F.when(kept(s, i) | by_rule(s, i), F.concat(F.lit(LITERAL), s)).otherwise(last(s, i)))).drop("literal")

    counted = generalised(known).groupBy("host", "parts").agg(F.count("*").alias("n"), F.count_if(F.col("bad") == 1).alias("bad"), F.count_if(F.col("bad") == 0).alias("good"))
    trees = counted.groupBy("host").applyInPandas(partial(_host_tree, weight, spread), "host string, parts array<string>, template string, purity double")
    out = generalised(p).join(sized(cut(trees), list_bytes("parts") + F.octet_length("template") + F.octet_length("host")), ["host", "parts"], "left")
    verdict = F.coalesce("by_rule", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
