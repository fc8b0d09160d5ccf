"""Chat formatting by incremental rendering of a black box.

Method. A template is any function from a list of (role, text) turns to one string. Successive prefixes of a
conversation are rendered; where an output begins with the one before it, the rest is the new turn's span, and where
it doesn't the template rewrites history, which is reported with the first such turn. The turns of such a conversation
have no spans; their texts are located in the whole rendering, by rendering all of it with a mark in place of each text
in turn, and a text that the whole rendering leaves out has none. Within a turn's span the text
is located by rendering the same turn with a mark in its place: what stands before and after the mark stands before
and after the text.

A long conversation is rendered in blocks: the whole prefix once per block of BLOCK turns, and the prefixes within a
block with the block's first turns and the turn before them only. If the pieces don't add up to the difference of
the two whole renderings, the block is done by whole prefixes after all. So results never depend on the blocks.

Conversations are dealt by conv_id and put in order within tasks; a task holds one conversation at a time, which
is also one cell of the result. Defined results: null texts are empty, null roles are "user"; turns of equal number
are ordered by role and text (a null turn first); equal rows are turns of their own; the null conv_id is one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_lists

Turns = list[tuple[str, str]]
BLOCK = 64
MARK = "\x00\x01mark\x01\x00"


class Instruct:
    """The library's own template. User turns stand between [INST] and [/INST], system turns between [SYS] and
    [/SYS], other roles between [ROLE=name] and [/ROLE]; an assistant's turn ends with </s>. Within texts a
    backslash is doubled, and control strings get one after their first character."""

    CONTROL = re.compile(r"([<\[])(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE=|/ROLE\])")
    TURN = re.compile(
        r"\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]"
        r"|\[ROLE=(?P<name>[0-9a-f]*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?)</s>",
        re.S,
    )

    def escape(self, text: str) -> str:
        return self.CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def __call__(self, turns: Turns) -> str:
        out = ["<s>"] if turns else []
        for role, text in turns:
            body = self.escape(text)
            if role == "user":
                out.append(f"[INST] {body} [/INST]")
            elif role == "system":
                out.append(f"[SYS] {body} [/SYS]")
            elif role == "assistant":
                out.append(f" {body}</s>")
            else:
                out.append(f"[ROLE={role.encode().hex()}] {body} [/ROLE]")
        return "".join(out)

    def parse(self, formatted: str) -> Turns:
        """The turns of a formatted conversation."""
        out, at = [], len("<s>") if formatted else 0
        while at < len(formatted):
            m = self.TURN.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at {at}")
            kind = m.lastgroup
            role = bytes.fromhex(m["name"]).decode() if kind == "other" else kind
            out.append((role, self.unescape(m[kind])))
            at = m.end()
        return out


Render = Callable[[Turns], str]


def spans(
    render: Render, turns: Turns, block: int = BLOCK
) -> tuple[str, list[tuple[int | None, int | None, int | None, int | None]], int]:
    """The formatted conversation; for each turn its span and its text's span (begin, end, text begin, text end, in
    code points); the number of the first turn whose addition rewrites what was rendered before, or -1. Where there is one,
    begin and end are None, and so are text begin and text end of texts that are not in the formatted conversation."""
    found: list[tuple[int | None, int | None, int | None, int | None]] = []
    whole = render([])
    for start in range(0, len(turns), block):
        part = turns[start : start + block]
        after = render(turns[: start + len(part)])
        pieces = None
        if start:
            context = turns[start - 1 : start]
            pieces = _pieces(render, context, part)
            if pieces is None or whole + "".join(p for p, _, _ in pieces) != after:
                pieces = None
        pieces = pieces or _pieces(render, turns[:start], part)
        if pieces is None or whole + "".join(p for p, _, _ in pieces) != after:
            first = next(i for i in range(start, len(turns)) if not render(turns[: i + 1]).startswith(render(turns[:i])))
            whole = render(turns)
            return whole, [(None, None, *_located(render, turns, i, whole)) for i in range(len(turns))], first
        for piece, before, behind in pieces:
            at = len(whole)
            whole += piece
            found.append((at, len(whole), at + before, len(whole) - behind))
    return whole, found, -1


def _located(render: Render, turns: Turns, i: int, whole: str) -> tuple[int, int] | tuple[None, None]:
    """Where the text of turn i stands in the rendering of all turns."""
    before, found, behind = render([*turns[:i], (turns[i][0], MARK), *turns[i + 1 :]]).partition(MARK)
    if not found or not whole.startswith(before) or not whole.endswith(behind) or len(before) + len(behind) > len(whole):
        return None, None
    return len(before), len(whole) - len(behind)


def _pieces(render: Render, context: Turns, part: Turns) -> list[tuple[str, int, int]] | None:
    """What each turn of a part adds, and how much of it stands before and behind the text; None if a rendering
    isn't the beginning of the next."""
    out = []
    done = list(context)
    last = render(done)
    for role, text in part:
        now = render([*done, (role, text)])
        marked = render([*done, (role, MARK)])
        if not now.startswith(last) or not marked.startswith(last):
            return None
        piece, probe = now[len(last) :], marked[len(last) :]
        before, found, behind = probe.partition(MARK)
        if not found or not piece.startswith(before) or not piece.endswith(behind) or len(before) + len(behind) > len(piece):
            before, behind = piece, ""  # the template drops or changes this text
        out.append((piece, len(before), len(behind)))
        done.append((role, text))
        last = now
    return out


def formatted(conversations: DataFrame, render: Render, learn: tuple[str, ...] = ("assistant",), block: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (array of begin, end; null if history is rewritten), loss (array of begin, end: texts of
    the roles to learn from) and rewritten (number of the first turn that rewrites history, else -1)."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    pair = "array<struct<begin: bigint, end: bigint>>"
    out = StructType.fromDDL(f"conv_id bigint, formatted string, spans {pair}, loss {pair}, rewritten bigint")
    arrow = to_arrow_schema(out)

    def row(conv, said: Turns) -> dict:
        text, found, first = spans(render, said, block)
        return {
            "conv_id": conv,
            "formatted": text,
            "spans": [{"begin": b, "end": e} for b, e, _, _ in found] if first < 0 else None,
            "loss": [{"begin": b, "end": e} for (_, _, b, e), (role, _) in zip(found, said, strict=True) if role in learn and b is not None],
            "rewritten": first,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, said = None, []
        for batch in batches:
            rows = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if said and c != conv:
                    rows.append(row(conv, said))
                    said = []
                conv = c
                said.append((role, text))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if said:
            yield pa.RecordBatch.from_pylist([row(conv, said)], schema=arrow)

    return turns.mapInArrow(run, out)


def read_back(rendered: DataFrame, template: Instruct) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten, from formatted text and
    loss spans alone."""

    def run(texts, losses):
        out = {"n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
        for text, loss in zip(texts, losses, strict=True):
            turns = template.parse(text)
            learned = "".join(template.unescape(text[s["begin"] : s["end"]]) for s in loss)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(_digest("".join(f"{r}\n{t}\n" for r, t in turns)))
            out["loss_chars"].append(len(learned))
            out["loss_sha256"].append(_digest(learned))
            out["formatted_chars"].append(len(text))
        return out

    schema = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_lists(rendered.select("conv_id", "formatted", "loss", "rewritten"), run, schema, keep=["conv_id", "rewritten"])


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
