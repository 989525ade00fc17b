"""Chat formatting: a finite-state machine over roles, a declarative template, and text segments with loss flags.

The template marks turns; every control string (any ``<`` backslashes ``|``) inside a text gains a backslash, so no text
can look like a mark, and losing one backslash each restores the text. Only assistant texts lie under the loss mask.

Rows are taken in the order of (turn, role, text). Edge cases: a null text is empty; a null role is the empty role, which
the machine rejects; roles out of order are formatted all the same and flagged from the first bad turn on; repeated rows
are turns of their own; a null conv_id is one conversation; an empty table gives no rows; extra columns are ignored.
Conversations are streamed row by row, so a long one is never held in memory; its digest is sequential by definition.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; "start" is the first state.
    machine: dict = field(default_factory=lambda: {
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
        "rejected": {},
    })
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("answered", "asked")


CHAT = Template()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segments(role: str, text: str, template: Template = CHAT) -> list[tuple[str, bool]]:
    """The (text, loss) segments of one turn."""
    return [(template.begin + _role_out(role) + template.after_role, False), (escape(text), role in template.loss_roles), (template.end, False)]


def _formatting(template: Template):
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches):
        conv, state, position = (), "start", 0
        for batch in batches:
            out = {"conv_id": [], "position": [], "turn": [], "segments": [], "valid": [], "state": []}
            for c, t, r, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv != (c,):
                    conv, state, position = (c,), "start", 0
                role, text = r or "", x or ""
                state = template.machine[state].get(role, "rejected")
                for k, v in zip(out, (c, position, t, [{"text": a, "loss": b} for a, b in segments(role, text, template)], state != "rejected", state), strict=True):
                    out[k].append(v)
                position += 1
            yield pa.record_batch([pa.array(out["conv_id"], pa.int64()), pa.array(out["position"], pa.int64()), pa.array(out["turn"], pa.int64()), pa.array(out["segments"], kind), pa.array(out["valid"], pa.bool_()), pa.array(out["state"], pa.string())], names=list(out))

    return run


def format_turns(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per turn, in order within a conversation: conv_id, position, turn, segments(text, loss), valid, state."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_formatting(template), "conv_id long, position long, turn long, segments array<struct<text:string,loss:boolean>>, valid boolean, state string")


def _reading(template: Template):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        own = None

        def done():
            return (own["c"], own["n"], own["turns"].hexdigest(), own["chars"], own["loss"].hexdigest(), own["all"], own["ok"] and own["state"] in template.final)

        for batch in batches:
            out = []
            for c, parts, ok, state in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if own is None or own["c"] != c:
                    if own is not None:
                        out.append(done())
                    own = {"c": c, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "ok": True}
                # Read back from the formatted text alone: marks delimit, escapes protect.
                whole = "".join(p["text"] for p in parts)
                head, _, rest = whole[len(template.begin) :].partition(template.after_role)
                role, text = _role_in(head), unescape(rest[: -len(template.end)])
                own["turns"].update(f"{role}\n{text}\n".encode())
                learnt = unescape("".join(p["text"] for p in parts if p["loss"]))
                own["loss"].update(learnt.encode())
                own["n"] += 1
                own["chars"] += len(learnt)
                own["all"] += len(whole)
                own["ok"] &= ok
                own["state"] = state
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if own is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(done(), types, strict=True)], names=names)

    return run


def digest(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation, read back from the output of ``format_turns`` (which keeps a conversation's turns together)."""
    return formatted.mapInArrow(_reading(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
