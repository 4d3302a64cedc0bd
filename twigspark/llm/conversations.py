"""Repair of conversations so that roles follow the grammar (s?(ua)+)?: an optional system turn, then pairs of user and assistant.

Turns are shuffled by conversation and sorted by turn inside the partitions; a task streams them in batches of whole conversations as far as they fit. In each batch a recursive
DuckDB query advances all conversations by one turn a recursion and keeps, for each state of the grammar, the cheapest edits (least cost, then least audit). Long conversations are
cut into segments of SEGMENT turns, walked at once from every state they may be entered in, and a second recursion joins a conversation's segments, so the number of recursions
doesn't follow the longest conversation. Where a conversation goes on in the next batch, the frontier (a cost, an audit and a digest for each of four states) is carried there: a task
holds a batch and, of one conversation, a byte a turn for each state and 16 bytes a turn to know repeated turns again. A digest of a conversation's text can only be made in its order, so one
conversation stays one stream; it is never held whole unless its texts are asked for.

Edits: Keep costs nothing, Rerole (to user or assistant) 3, Delete 4, Insert (of an empty turn of user or assistant) 3; a blank or repeated turn has to be deleted, and a truncated one that
stays costs 3 more. Each edit is a letter of the audit. No two audits of equal cost for the same turns are prefixes of each other, so the least of a whole is made of the least of its parts.

Defined cases: a null conv_id is one conversation; null turns come first; equal turns are ordered by role, then text; nulls of role and text are taken as given by the caller (`report` makes them
one space; otherwise they count as empty); a conversation without rows has no faults and an empty audit; repeated rows are faults; other columns aren't read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, parts_for, small_batches

#: Turns and bytes of a batch, and turns of a segment.
ROWS, BYTES, SEGMENT = 8192, 4 << 20, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "repaired array<struct<role: string, text: string>>"

#: States are the last role given: nothing yet, system, user, assistant. The first column of GOES is the state, then what may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
GOES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {"u": "user", "a": "assistant"}
#: Inserts that make a state one to end in.
ENDS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def given(state: int) -> str:
    """The letter of the only role that an inserted or renamed turn can have there."""
    return "a" if state == USER else "u"


def edits() -> list[tuple[str, int, int, str, int]]:
    """(code, state, next state, letters, cost) of every way to take a turn: up to two inserts, then one edit. Two inserts reach every state that more do.

    A code is the initial of the role (o: another), in capitals if truncated, or x for a turn that has to go."""
    out = []
    for state in GOES:
        at = state
        for k in range(3):
            before, cost = "I" * k, INSERT * k
            for code in "xsuaoSUAO":
                out.append((code, state, at, before + "D", cost + DELETE))
                if code != "x":
                    stays = cost + TRUNCATED * code.isupper()
                    if code.lower() in GOES[at]:
                        out.append((code, state, GOES[at][code.lower()], before + "K", stays + KEEP))
                    out.append((code, state, GOES[at][given(at)], before + "R", stays + REROLE))
            at = GOES[at][given(at)]
    return out


WALK = """with recursive walk(c, seg, s0, s, pos, cost, audit) as (
 select c, seg, s0, s0, 0, 0, '' from starts
 union all
 select c, seg, s0, t, pos + 1, m.cost, m.audit from (
  select w.c, w.seg, w.s0, e.t, w.pos, min({'cost': w.cost + e.cost, 'audit': w.audit || e.letters}) m
  from walk w join turns r on r.c = w.c and r.seg = w.seg and r.pos = w.pos join edits e on e.code = r.code and e.s = w.s group by all)),
part as (select c, seg, s0, s, cost, audit from walk join segments using (c, seg) where pos = n),
fold(c, seg, s, least) as (
 select c, 0, s, {'cost': cost, 'rank': rank, 'audit': '', 's0': s} from carried
 union all
 select c, seg, s, m from (
  select f.c, f.seg + 1 seg, p.s, min({'cost': f.least.cost + p.cost, 'rank': f.least.rank, 'audit': f.least.audit || p.audit, 's0': f.least.s0}) m
  from fold f join part p on p.c = f.c and p.seg = f.seg and p.s0 = f.s group by all))
select c, s, least.cost, least.rank, least.audit, least.s0 from fold join (select c, max(seg) + 1 last from segments group by c) l using (c) where seg = last order by c, least.cost, least.rank, least.audit"""


class Open:
    """A conversation as far as it was read."""

    def __init__(self, key: int | None, texts: bool):
        self.key, self.texts = key, texts
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last = None
        self.seen: set[bytes] = set()
        #: state: (cost, audit, digest, turns)
        self.ends: dict[int, tuple] = {START: (0, "", hashlib.sha256(), [])}
        self.rows: list[tuple[str, str]] = []
        self.codes: list[str] = []

    def take(self, turn: int | None, role: str, text: str) -> None:
        trimmed = text.rstrip(SPACES)
        digest = hashlib.md5(b"%d:%b%b" % (len(role), role.encode(), text.encode())).digest()
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not trimmed:
            self.blank += 1
            code = "x"
        elif digest in self.seen:
            self.duplicate += 1
            code = "x"
        elif trimmed[-1] not in ".!?":
            self.truncated += 1
            code = code.upper()
        self.seen.add(digest)
        if self.last is not None and (self.last, role[:1]) not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        self.rows.append((role, text))
        self.codes.append(code)

    def moved(self, found: list[tuple]) -> None:
        """Follows each state's cheapest edits over the turns of the batch."""
        ends = {}
        for state, cost, audit, origin in found:
            _, before, digest, turns = self.ends[origin]
            digest, turns = digest.copy(), list(turns)
            self.replay(origin, audit, digest, turns)
            ends[state] = (cost, before + audit, digest, turns)
        self.ends, self.rows, self.codes = ends, [], []

    def replay(self, state: int, audit: str, digest, turns: list) -> None:
        rows = iter(self.rows)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            step = role[:1] if letter == "K" else given(state)
            role = role if letter == "K" else NAMES[step]
            digest.update((b"" if state == START else b"\n") + role.encode() + b":" + text.encode())
            if self.texts:
                turns.append({"role": role, "text": text})
            state = GOES[state][step]

    def closed(self) -> tuple:
        state, (cost, audit, digest, turns) = min(self.ends.items(), key=lambda x: (x[1][0] + INSERT * ENDS[x[0]], x[1][1]))
        digest, turns = digest.copy(), list(turns)
        last = "I" * ENDS[state]
        self.replay(state, last, digest, turns)
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost + INSERT * len(last), audit + last, digest.hexdigest(), turns)


def walked(db: duckdb.DuckDBPyConnection, batch: list[Open]) -> None:
    """Advances the conversations of a batch to the end of what was read of each."""
    batch = [x for x in batch if x.rows]
    if not batch:
        return
    turns, segments, starts, carried = [], [], [], []
    for c, x in enumerate(batch):
        for a in range(0, len(x.codes), SEGMENT):
            part = x.codes[a : a + SEGMENT]
            turns += [(c, a // SEGMENT, k, code) for k, code in enumerate(part)]
            segments.append((c, a // SEGMENT, len(part)))
            starts += [(c, a // SEGMENT, s) for s in (GOES if a else x.ends)]
        order = sorted(x.ends, key=lambda s: x.ends[s][1])
        carried += [(c, s, x.ends[s][0], rank) for rank, s in enumerate(order)]
    made = {"turns": (turns, "c seg pos code"), "segments": (segments, "c seg n"), "starts": (starts, "c seg s0"), "carried": (carried, "c s cost rank")}
    for name, (rows, names) in made.items():
        db.register(name, pa.table(list(map(pa.array, zip(*rows, strict=True))), names.split()))
    found: list[list[tuple]] = [[] for _ in batch]
    for c, s, cost, _, audit, s0 in db.execute(WALK).fetchall():
        found[c].append((s, cost, audit, s0))
    for name in made:
        db.unregister(name)
    for x, f in zip(batch, found, strict=True):
        x.moved(f)


def repaired(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        db.execute("create table edits(code varchar, s bigint, t bigint, letters varchar, cost bigint)")
        db.executemany("insert into edits values (?, ?, ?, ?, ?)", edits())
        here: list[Open] = []
        rows = size = 0

        def flush(end: bool) -> pa.RecordBatch:
            walked(db, here)
            done = here if end else here[:-1]
            out = list(zip(*(x.closed() for x in done), strict=True)) or [()] * 10
            del here[: len(done)]
            types = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))] * texts
            names = [x.split()[0] for x in DDL.split(", ")] + ["repaired"] * texts
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=False)], names)

        for b in batches:
            for key, turn, role, text, gone in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if not here or here[-1].key != key:
                    here.append(Open(key, texts))
                if not gone:
                    here[-1].take(turn, role or "", text or "")
                    size += len(text or "")
                rows += 1
                if rows >= ROWS or size >= BYTES:
                    yield flush(False)
                    rows = size = 0
        if here:
            yield flush(True)
        db.close()

    return run


def repair(turns: DataFrame, texts: bool = True) -> DataFrame:
    """Per conversation of turns (conv_id, turn, role, text, gone): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, with texts, the repaired turns.

    Rows that are gone only say that there is such a conversation. The digest is that of the repaired `role:text`, joined by line feeds."""
    parts = parts_for(small_batches(turns), "role", "text")
    sorted_turns = turns.select("conv_id", "turn", "role", "text", "gone").repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return sorted_turns.mapInArrow(repaired(texts), DDL + f", {TURNS}" * texts)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with nulls made one space and every twentieth row dropped, emptied, stripped of its ends of sentences, repeated or given to the user, by the crc32 of conv_id:turn."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(s("conv_id"), F.lit(":"), s("turn"))) % 20
    d = conversations.select("conv_id", "turn", s("role").alias("role"), s("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    gone = F.col("k") == 0
    d = d.select("conv_id", "turn", F.when(gone, F.lit(None)).when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"), "k")
    return d.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "copy")


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation, after `damaged`: its faults, the cost and audit of the cheapest repair, and the digest of the repaired turns."""
    return repair(damaged(conversations), texts=False)
