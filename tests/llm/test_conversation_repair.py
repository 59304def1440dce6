import hashlib
import itertools
import random
import re
import zlib

import pytest

from strandwise.llm.convrepair import Composition, audit, damage, repair, repair_digest, repaired_hashes, symbol

SPACE = " \t\n\v\f\r"
CONV = "conv_id long, turn long, role string, text string, audit string, place string"


def by_trial(symbols):
    """Least (cost, labels) by trying every edit of every row with up to two inserts anywhere; the output is held against the pattern itself."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]

    def tries(i):
        if i == len(symbols):
            for g in gaps:
                yield 3 * len(g), "I" * len(g), g
            return
        initial, go, short = symbols[i]
        own = [(4, "D", "")]
        if not go:
            own += [(3 * short, "K", initial)] + [(3 + 3 * short, "R", r) for r in "ua"]
        for g, (cost, label, out) in itertools.product(gaps, own):
            for more_cost, more, rest in tries(i + 1):
                yield 3 * len(g) + cost + more_cost, "I" * len(g) + label + more, g + out + rest

    for cost, labels, out in tries(0):
        if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, labels) < best):
            best = cost, labels
    return best


def test_least_path_against_every_edit():
    rng, machine = random.Random(5), Composition()
    for n in (0, 1, 2, 3):
        for _ in range(60 if n < 3 else 25):
            symbols = [(rng.choice("suaux"), rng.random() < 0.25, rng.random() < 0.3) for _ in range(n)]
            symbols = [(i, go, short and not go) for i, go, short in symbols]
            assert machine.cheapest(bytes(symbol(*s) for s in symbols)) == by_trial(symbols), symbols


def test_ties_go_to_the_least_string():
    # A lone assistant: delete it (4) costs more than to insert a user before it (3).
    assert Composition().cheapest(bytes([symbol("a", False, False)])) == (3, "IK")
    # Two rows of an unknown role: both renamed, both deleted (8) is dearer.
    assert Composition().cheapest(bytes([symbol("t", False, False)] * 2)) == (6, "RR")
    # One row of an unknown role: deleting it is cheapest.
    assert Composition().cheapest(bytes([symbol("t", False, False)])) == (4, "D")


def test_a_very_long_conversation_is_repaired():
    rng = random.Random(8)
    symbols = bytes(symbol(rng.choice("uuas"), rng.random() < 0.1, False) for _ in range(50_000))
    cost, labels = Composition().cheapest(symbols)
    assert len(labels.replace("I", "")) == 50_000 and cost > 0


def plain_repair(conversations):
    """The contract row by row, with the edits found by least weights that carry whole strings forward."""
    damaged = {}
    for conv, turn, role, text in conversations:
        damaged.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        damaged[conv] += [row, row] if kind == 3 else [row]
    out = {}
    for conv, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
        best = {"": (0, "", ())}

        def relax(into, state, weight):
            if state not in into or weight < into[state]:
                into[state] = weight

        def with_inserts(states):
            for _ in range(2):
                for state, (cost, labels, made) in list(states.items()):
                    for new in set(allowed[state]) - {"s"}:
                        relax(states, new, (cost + 3, labels + "I", (*made, ("user" if new == "u" else "assistant", ""))))
            return states

        for (_, role, text), fault in zip(rows, faults):
            after = {}
            for state, (cost, labels, made) in with_inserts(best).items():
                relax(after, state, (cost + 4, labels + "D", made))
                if fault in ("blank", "duplicate"):
                    continue
                more = 3 * (fault == "truncated")
                for label, extra, name in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if name[:1] and name[:1] in allowed[state]:
                        relax(after, name[:1], (cost + extra + more, labels + label, (*made, (name, text))))
            best = after
        cost, labels, made = min(w for s, w in with_inserts(best).items() if s in ("", "a"))
        count = faults.count
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, labels, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def awkward_rows():
    rng = random.Random(11)
    rows = []
    for conv in [*range(60), None]:
        for turn in [None, *range(rng.randint(1, 9))]:
            if rng.random() < 0.85:
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
                text = rng.choice(["Yes.", "No!", "what", "", " \n\t", None, "so. \n", "Same text.", "a: b\nc?"])
                rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 2])
                if rng.random() < 0.1:
                    rows.append((conv, turn, role, "another text of the turn."))
    rows.append((99, 1, "user", "word " * 200_000 + "end."))
    rows += [(98, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3_000)]
    dropped = next(i for i in range(1_000, 2_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")], dropped


def test_query_against_the_contract(spark):
    rows, dropped = awkward_rows()
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], CONV).repartition(5)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    ours = {r["conv_id"]: tuple(r[n] for n in names) for r in repair_digest(table).collect()}
    assert ours == plain_repair(rows)
    assert ours[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_rows_come_out_repaired(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "cut"), (1, 2, "tool", "A result."), (2, 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    audits = {r["conv_id"]: (r["cost"], r["audit"]) for r in audit(table).collect()}
    assert audits == {1: (9, "IKKR"), 2: (4, "D")}
    out = sorted(map(tuple, repair(table, audit(table).select("conv_id", "audit")).collect()))
    assert out == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hello."), (1, 2, "K", "user", "cut"), (1, 3, "R", "assistant", "A result.")]
    assert repaired_hashes(repair(table, audit(table).select("conv_id", "audit"))).count() == 1


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], CONV)
    assert repair_digest(none).count() == 0 and audit(damage(none)).count() == 0


@pytest.mark.parametrize("kind, want", [(1, ""), (2, "a b c"), (4, "a. b! c?")])
def test_damage(spark, kind, want):
    turn = next(t for t in range(500) if zlib.crc32(f"7:{t}".encode()) % 20 == kind)
    got = damage(spark.createDataFrame([(7, turn, "assistant", "a. b! c?")], "conv_id long, turn long, role string, text string")).collect()
    assert [(r["role"], r["text"]) for r in got] == [("user" if kind == 4 else "assistant", want)]
