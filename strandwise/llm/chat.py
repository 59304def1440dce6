"""Chat formatting by incremental black-box rendering.

The template is only called, never inspected. Successive prefixes of a conversation are rendered; where
one output starts with the one before, what was added is the new turn's span. A second rendering of the
same prefix with a probe in place of the new text shows how many characters of the span stand before
and after the text. A template whose longer output does not start with the shorter one rewrites
history, and the conversation is flagged instead of being given wrong spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

Template = Callable[[list[tuple[str, str]]], str]
#: Private-use characters, of which the first that a role does not hold is the probe.
PROBES = [chr(c) for c in range(0xE000, 0xE100)]


def escape(text: str) -> str:
    """No control string is left: '<', k backslashes, '|' becomes '<', k+1 backslashes, '|'."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def chatml(turns: list[tuple[str, str]]) -> str:
    """The default template: turns between markers, control strings inside roles and texts escaped reversibly."""
    return "".join(f"<|im_start|>{escape_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


def render(turns: list[tuple[str, str]], template: Template = chatml) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The whole output, each turn's (start, text start, text end, end), and whether history was rewritten.

    Prefixes are rendered one turn at a time. If an output does not extend the one before, or the
    probe can't be found once in its turn, spans end there and the flag is set.
    """
    before, spans = template([]) if not turns else "", []
    for k in range(len(turns)):
        role, text = turns[k]
        after = template(turns[: k + 1])
        mark = next(c for c in PROBES if c not in role)
        probe = template([*turns[:k], (role, mark)])
        if not after.startswith(before) or not probe.startswith(before) or probe.count(mark, len(before)) != 1:
            return template(turns), spans, True
        head = probe.index(mark, len(before))
        tail = len(probe) - head - len(mark)
        if after[:head] != probe[:head] or len(after) - tail < head or (tail and after[-tail:] != probe[-tail:]):
            return template(turns), spans, True
        spans.append((len(before), head, len(after) - tail, len(after)))
        before = after
    return before, spans, False


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns read back from chatml output."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("<|im_start|>", at):
            raise ValueError(f"no turn starts at character {at}")
        line, end = formatted.index("\n", at), formatted.index("<|im_end|>\n", at)
        turns.append((unescape_role(formatted[at + 12 : line]), unescape(formatted[line + 1 : end])))
        at = end + 11
    return turns


def grouped(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array of turn, role, text): one row a conversation, turns in order; ties by role, then text."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def format_chats(conversations: DataFrame, template: Template = chatml, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, spans (turn spans and text spans), loss (flag per span), rewrites_history.

    conversations: conv_id, turn, role, text. One shuffle brings a conversation's turns together; a
    conversation is one training example and is rendered in one task. Rows are ordered by turn (null
    first), then role, then text; repeated rows stay. Null role and text are empty; null conv_id is a
    conversation of its own. Extra columns are ignored; an empty table gives no rows. Rendering every
    prefix costs the square of a conversation's length, as the template is a black box.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "text_start", "text_end", "end")]))), ("loss", pa.list_(pa.bool_())), ("rewrites_history", pa.bool_())]
    )

    def run(batches):
        for b in batches:
            out = {n: [] for n in schema.names}
            for conv_id, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                turns = [(t["role"], t["text"]) for t in turns]
                formatted, spans, rewrites = render(turns, template)
                out["conv_id"].append(conv_id)
                out["formatted"].append(formatted)
                out["spans"].append([dict(zip(("start", "text_start", "text_end", "end"), s)) for s in spans])
                out["loss"].append([role in loss_roles for role, _ in turns[: len(spans)]])
                out["rewrites_history"].append(rewrites)
            yield batch(schema, **out)

    ddl = "conv_id long, formatted string, spans array<struct<start: long, text_start: long, text_end: long, end: long>>, loss array<boolean>, rewrites_history boolean"
    return grouped(conversations).mapInArrow(run, ddl)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: read back from format_chats' output alone."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history")
    kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string(), "rewrites_history": pa.bool_()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def run(batches):
        for b in batches:
            out = {n: [] for n in names}
            for r in b.to_pylist():
                turns = parse(r["formatted"])
                loss = "".join(unescape(r["formatted"][s["text_start"] : s["text_end"]]) for s, on in zip(r["spans"], r["loss"]) if on)
                row = (r["conv_id"], len(turns), hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"]), r["rewrites_history"])
                for n, v in zip(names, row):
                    out[n].append(v)
            yield batch(schema, **out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
