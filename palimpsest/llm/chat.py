"""Chat formatting with typed content parts and a loss mask that can be read back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, unused

#: Marks of the template. A turn is `<|turn:role|>` text `<|end|>` and a newline.
OPEN, MID, CLOSE = "<|turn:", "|>", "<|end|>\n"
#: An attachment is `<|kind:number|>`. Inside texts `<|` is written `<\|`, and a backslash after `<` doubled with it: `<\` -> `<\\`.
_OPEN = re.compile(r"<(?=[|\\])")
_SHUT = re.compile(r"<\\([|\\])")

#: Tokens that a part stands for, by kind: (fixed, per unit, the unit's field).
EXPANDED = {"image": (1, 1, "tiles"), "audio": (1, 25, "seconds"), "document": (1, 256, "pages")}


def escape(text: str) -> str:
    """No `<|` is left in the result, so no control string is; unescape() undoes it for any text."""
    return _OPEN.sub(r"<\\", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1", text)


_HELD = re.compile(r"<\|(" + "|".join(EXPANDED) + r"):(\d+)\|>")


@dataclass
class Flattened:
    """Pieces in order, a text or the number of an attachment; what is attached; the tokens that attachments expand to."""

    pieces: list[str | int] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded_tokens: int = 0

    def placeholder(self, at: int) -> str:
        return f"<|{self.attachments[at]['kind']}:{at}|>"

    @property
    def text(self) -> str:
        """Texts and placeholders; only written() can be read back whatever the texts hold."""
        return "".join(p if isinstance(p, str) else self.placeholder(p) for p in self.pieces)

    def written(self) -> str:
        """As in a formatted turn: texts escaped, so that none can pass for a placeholder."""
        return "".join(escape(p) if isinstance(p, str) else self.placeholder(p) for p in self.pieces)


class PartVisitor:
    """Visits typed content parts in order; each kind has its own method.

    Text parts are kept as they are; image, audio and document parts leave a placeholder,
    numbered over the turn, and record their reference and the tokens they expand to.
    An unknown kind is an error, so that nothing is dropped unseen.
    """

    def __init__(self) -> None:
        self.out = Flattened()

    def visit(self, part) -> None:
        kind = "text" if isinstance(part, str) else part.get("type", "text")
        getattr(self, f"visit_{kind}", self.unknown)(part)

    def unknown(self, part) -> None:
        raise ValueError(f"unknown content part {part!r:.80}")

    def visit_text(self, part) -> None:
        text = part if isinstance(part, str) else part.get("text") or ""
        if self.out.pieces and isinstance(self.out.pieces[-1], str):
            self.out.pieces[-1] += text  # a control string over two parts is escaped like any other
        elif text:
            self.out.pieces.append(text)

    def attach(self, part) -> None:
        kind = part["type"]
        fixed, each, unit = EXPANDED[kind]
        tokens = fixed + each * int(part.get(unit) or 1)
        at = len(self.out.attachments)
        offset = sum(len(p) if isinstance(p, str) else len(self.out.placeholder(p)) for p in self.out.pieces)
        self.out.attachments.append({"index": at, "kind": kind, "ref": part.get("ref"), "tokens": tokens, "offset": offset})
        self.out.expanded_tokens += tokens
        self.out.pieces.append(at)

    visit_image = visit_audio = visit_document = attach


def flatten(content) -> Flattened:
    """content: null, a text, or a list of parts (also as JSON in a column of content parts)."""
    visitor = PartVisitor()
    for part in [] if content is None else [content] if isinstance(content, (str, dict)) else content:
        visitor.visit(part)
    return visitor.out


def format_turn(role: str | None, content) -> tuple[str, int, int]:
    """The formatted turn and its loss span (code points within it; empty unless assistant's); content: as flatten() takes it, or flattened."""
    head = OPEN + (role or "").replace("\\", "\\\\").replace("|", "\\p") + MID
    body = (content if isinstance(content, Flattened) else flatten(content)).written()
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return head + body + CLOSE, *span


def read_parts(body: str) -> list[str | tuple[str, int]]:
    """What a formatted body says: texts as they were, and (kind, number) for each attachment."""
    out, at = [], 0
    for m in _HELD.finditer(body):
        out += [unescape(body[at : m.start()])] * (m.start() > at) + [(m[1], int(m[2]))]
        at = m.end()
    return out + [unescape(body[at:])] * (at < len(body))


def _said(body: str) -> str:
    return "".join(p if isinstance(p, str) else f"<|{p[0]}:{p[1]}|>" for p in read_parts(body))


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text with placeholders) of each turn; an error if anything is left over."""
    out, at = [], 0
    while at < len(formatted):
        # find() instead of a scan by character: texts may be very long
        mid = formatted.find(MID, at)
        end = formatted.find(CLOSE, mid)
        if not formatted.startswith(OPEN, at) or mid < 0 or end < 0:
            raise ValueError(f"no turn at {at}")
        role = re.sub(r"\\(.)", lambda m: "|" if m[1] == "p" else "\\", formatted[at + len(OPEN) : mid])
        out.append((role, _said(formatted[mid + len(MID) : end])))
        at = end + len(CLOSE)
    return out


TURNS = "formatted string, loss_from int, loss_to int, attachments string, expanded_tokens long"


def format_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """turns with formatted, loss_from, loss_to, attachments (JSON) and expanded_tokens.

    Each turn is formatted by itself, so a conversation is the concatenation of its turns
    in order and no conversation has to fit in memory. parts_col, where not null,
    holds a JSON list of typed parts instead of the text. Null text and role are empty;
    repeated rows are turns of their own; an empty table gives an empty result.
    Other columns stay; columns of turns with the results' names are replaced.
    """
    prepare(turns.sparkSession)
    kept = turns.drop(*[c.split()[0] for c in TURNS.split(", ")])
    role, text, parts = (unused(kept, n) for n in ("_role", "_text", "_parts"))
    given = kept.withColumns({role: F.col(role_col), text: F.col(text_col), parts: F.col(parts_col) if parts_col else F.lit(None).cast("string")})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r, t, p in zip(batch.pop(role), batch.pop(text), batch.pop(parts)):
                flat = flatten(json.loads(p)) if isinstance(p, str) else flatten(t if isinstance(t, str) else None)
                formatted, a, b = format_turn(r if isinstance(r, str) else None, flat)
                rows.append((formatted, a, b, json.dumps(flat.attachments) if flat.attachments else None, flat.expanded_tokens))
            names = [c.split()[0] for c in TURNS.split(", ")]
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), TURNS])
    return given.mapInPandas(run, schema)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"


def read_back(formatted: DataFrame, conv_col: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """One row per conversation, from the formatted turns alone: counts and digests of what they say.

    Rows of a conversation meet in one partition and are read there in order as a stream, as a digest over its
    turns asks for: a conversation of any length takes the memory of a batch, and the time of its turns in one task. Ties of `turn` go by
    role, then text, nulls first. Conversations without an id are one conversation.
    """
    names = [f"o{i}" for i in range(len(order))]
    rows = formatted.select(F.col(conv_col).cast("long").alias("conv_id"), *(F.col(c).alias(n) for c, n in zip(order, names)), "formatted", "loss_from", "loss_to", "expanded_tokens")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *names).select("conv_id", "formatted", "loss_from", "loss_to", "expanded_tokens")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, done = None, None, []

        def close():
            if state:
                done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            for key, text, a, b, tokens in zip(batch["conv_id"].tolist(), batch["formatted"].tolist(), batch["loss_from"].tolist(), batch["loss_to"].tolist(), batch["expanded_tokens"].tolist()):
                key = None if key is None or key != key else int(key)
                if state is None or key != conv:
                    close()
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if b > a:
                    learned = "".join(p for p in read_parts(text[a:b]) if isinstance(p, str))
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += int(tokens)
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in READ_BACK.split(", ")])
                done.clear()
        close()
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in READ_BACK.split(", ")])

    return rows.mapInPandas(run, READ_BACK)
