"""Conversation structure repair by composition of weighted finite-state machines.

A conversation's rows are an input acceptor, one arc a row. The edit transducer keeps, renames, deletes or
inserts turns at a cost; the grammar acceptor takes role initials `(s?(ua)+)?`. Their composition is built
state by state as it is reached and is free of cycles, as the transducer counts the inserts since the last row
it read: two reach every grammar state, and a third would come back to one at a cost. Weights are pairs
(cost, label string), compared in that order. A state has one arc a label, so strings of equal first label go on
from the same state, and the first label alone decides between them: strings are kept as links, not copied.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, materialize

#: Grammar acceptor: states 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a); 0 and 3 accept.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTS = (0, 3)
KEEP, RENAME, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
MOST_INSERTS = 2
#: A row as a symbol: its role's initial (others count as '-'), whether it must go, and whether its text is cut short.
INITIALS = "sua-"
NO_REPAIR = hashlib.sha256(b"").hexdigest()


def symbol(initial: str, must_go: bool, cut_short: bool) -> int:
    return INITIALS.index(initial if initial in ("s", "u", "a") else "-") * 4 + 2 * must_go + cut_short


def edit_arcs(inserts: int, sym: int | None):
    """Arcs of the edit transducer: (label, output initial, inserts after, cost, reads a row). Output '' writes nothing."""
    if inserts < MOST_INSERTS:
        for initial in ROLES:
            yield "I", initial, inserts + 1, INSERT, False
    if sym is None:
        return
    initial, must_go, extra = INITIALS[sym // 4], sym & 2, CUT_SHORT * (sym & 1)
    yield "D", "", 0, DELETE, True
    if not must_go:
        if initial != "-":
            yield "K", initial, 0, KEEP + extra, True
        for other in ROLES:
            if other != initial:
                yield "R", other, 0, RENAME + extra, True


class Composition:
    """Input, edits and grammar composed as far as they are reached; what a set of states does on a symbol is kept for reuse."""

    def __init__(self):
        self.known: dict = {}

    def step(self, grammar_states: frozenset, sym: int | None):
        """From the grammar states before a row: (key, arcs) in topological order, the same as a dict, and the states after it.

        A key is 4 * inserts + grammar state. An arc is (label, cost, next key); the key of a state after the row is ~state.
        """
        if (grammar_states, sym) not in self.known:
            levels, order, after = [set(grammar_states)] + [set() for _ in range(MOST_INSERTS)], [], set()
            for inserts in range(MOST_INSERTS + 1):
                for g in sorted(levels[inserts]):
                    arcs = []
                    for label, out, then, cost, reads in edit_arcs(inserts, sym):
                        to = g if not out else GRAMMAR.get((g, out))
                        if to is not None:
                            (after if reads else levels[then]).add(to)
                            arcs.append((label, cost, ~to if reads else then * 4 + to))
                    order.append((inserts * 4 + g, arcs))
            self.known[grammar_states, sym] = order, dict(order), frozenset(after)
        return self.known[grammar_states, sym]

    def cheapest(self, symbols: bytes) -> tuple[int, str]:
        """(cost, labels) of the least path over lexicographic weights; links are 12 bytes a row, costs are kept for two rows."""
        layers, states = [], frozenset([0])
        for s in [*symbols, None]:
            order, arcs_of, states = self.step(states, s)
            layers.append((order, arcs_of))
        best, links = {}, []
        for at in range(len(layers) - 1, -1, -1):
            here, link = {}, bytearray(12)
            for key, arcs in reversed(layers[at][0]):
                weight = (0, "", 0) if at == len(layers) - 1 and key % 4 in ACCEPTS else None
                for n, (label, cost, to) in enumerate(arcs):
                    rest = best.get(~to) if to < 0 else here.get(to)
                    if rest is not None and (weight is None or (rest + cost, label) < weight[:2]):
                        weight = (rest + cost, label, n)
                if weight is not None:
                    here[key], link[key] = weight[0], weight[2]
            links.append(bytes(link))
            best = {g: here[g] for g in range(4) if g in here}
        links.reverse()
        labels, key, at = [], 0, 0
        while True:
            if at == len(layers) - 1 and key % 4 in ACCEPTS:
                return best[0], "".join(labels)
            label, _, to = layers[at][1][key][links[at][key]]
            labels.append(label)
            at, key = (at + 1, ~to) if to < 0 else (at, to)


def damage(rows: DataFrame) -> DataFrame:
    """Known faults for rows (conv_id, turn, role, text), by crc32 of 'conv_id:turn' modulo 20.

    0 drops the row, 1 empties its text, 2 takes [.!?] out of it, 3 repeats the row, 4 makes it a user's. Nulls of
    role and text, and in the key, are one space. Extra columns are left out.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def _clean(rows: DataFrame) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"))
    return rows.withColumn("_digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _of(spark_column: str) -> Column:
    return F.col(spark_column).asc_nulls_first()


AUDIT = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audit(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' initials).

    rows: conv_id, turn, role, text, read by turn (null first), ties by role, then by the text's MD5. Null role and
    text are one space, a null conv_id is a conversation of its own, extra columns are ignored, repeated rows are
    duplicates, an empty table gives no rows. Only role, digest and flags are shuffled and held, not the texts. A
    row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated. A role
    whose initial is not s, u or a, or that is empty, cannot be kept. A task holds a few bytes a row of one conversation.
    """
    last = F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    flags = _clean(rows).select("conv_id", "turn", "role", "_digest", blank.alias("_blank"), (~blank & ~last.rlike("[.!?]")).alias("_short"))
    near = flags.repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "_digest").orderBy(_of("turn"))
    near = near.withColumn("_again", F.row_number().over(seen) > 1).select("conv_id", "turn", "role", "_digest", "_again", "_blank", "_short")
    schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in ("conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])

    def run(batches):
        machine, now, state = Composition(), None, None
        for b in batches:
            out = []
            for conv, turn, role, _, again, blank, short in zip(*[c.to_pylist() for c in b.columns]):
                if state is None or conv != now:
                    if state is not None:
                        out.append(state.row(now, machine))
                    now, state = conv, _Conversation()
                state.add(turn, role[:1], blank, again, short)
            if out:
                yield batch(schema, **dict(zip(schema.names, zip(*out))))
        if state is not None:
            yield batch(schema, **dict(zip(schema.names, zip(state.row(now, machine)))))

    return near.sortWithinPartitions(_of("conv_id"), _of("turn"), "role", "_digest", "_again").mapInArrow(run, AUDIT)


class _Conversation:
    """Counts and symbols of the conversation that is being read."""

    def __init__(self):
        self.symbols, self.counts, self.illegal, self.before = bytearray(), [0, 0, 0], 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn, initial, blank, again, short):
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        fault = 0 if blank else 1 if again else 2 if short else None
        if fault is not None:
            self.counts[fault] += 1
        self.symbols.append(symbol(initial, fault in (0, 1), fault == 2))

    def row(self, conv, machine):
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (conv, len(self.symbols), gaps, *self.counts, self.illegal, *machine.cheapest(bytes(self.symbols)))


def repair(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit, role, text; a conversation's rows come in order and together.

    rows as for audit, audits as it returned. The edits of a conversation travel ahead of its rows, which stream
    past in the same order, so a task holds the edits of one conversation and no texts. Inserted turns have an empty text.
    """
    texts = _clean(rows).select("conv_id", "turn", "role", "_digest", "text", F.lit(None).cast("string").alias("audit"))
    none = lambda kind: F.lit(None).cast(kind)
    heads = audits.select("conv_id", none("long").alias("turn"), none("string").alias("role"), none("binary").alias("_digest"), none("string").alias("text"), "audit")
    both = heads.union(texts).repartition("conv_id").sortWithinPartitions(_of("conv_id"), F.col("audit").isNull(), _of("turn"), "role", "_digest")
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        edits, at, state, place = "", 0, 0, 0
        for b in batches:
            out = []

            def write(conv, label, role=None, text=""):
                nonlocal state, place
                initial = role[:1] if label == "K" else "a" if state == 2 else "u"
                out.append((conv, place, label, role if label == "K" else ROLES[initial], text))
                state, place = GRAMMAR[state, initial], place + 1

            for conv, role, text, labels in zip(*[b.column(i).to_pylist() for i in (0, 2, 4, 5)]):
                if labels is not None:
                    edits, at, state, place = labels, 0, 0, 0
                else:
                    if edits[at] != "D":
                        write(conv, edits[at], role, text)
                    at += 1
                while at < len(edits) and edits[at] == "I":
                    write(conv, "I")
                    at += 1
            if out:
                yield batch(schema, **dict(zip(schema.names, zip(*out))))

    return both.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def repaired_hashes(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its `role:text` lines. repaired: straight from repair, so that a conversation's rows come in order and together."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        now, digest = None, None
        for b in batches:
            done = []
            for conv, place, role, text in zip(*[b.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                if place == 0:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if done:
                yield batch(schema, conv_id=[c for c, _ in done], repaired_sha256=[h for _, h in done])
        if digest is not None:
            yield batch(schema, conv_id=[now], repaired_sha256=[digest.hexdigest()])

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Every conv_id of conversations with its audit and the hash of its repaired rows after damage; zeros, an empty audit and the empty string's hash where nothing is left."""
    rows = damage(conversations)
    audits = materialize(audit(rows), "audits")
    hashes = repaired_hashes(repair(rows, audits.select("conv_id", "audit")))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("_kind", F.lit(0))
    blank = {c: F.lit(None).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    parts = ids.select("conv_id", *[v.alias(c) for c, v in blank.items()], F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    parts = parts.unionByName(audits.select("conv_id", *blank, "audit"), allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)
    counts = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in blank]
    return parts.groupBy("conv_id").agg(*counts, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(NO_REPAIR)).alias("repaired_sha256"))
