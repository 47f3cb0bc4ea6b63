"""Memory slots: short texts under a label, each with a limit of size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import fold_in_order

#: Characters of a slot unless it says otherwise, and at most.
LIMIT, MOST = 2000, 20_000
LABEL = r"^[a-z][a-z0-9_]*$"


def valid_label(label: Column) -> Column:
    return label.rlike(LABEL)


def appended(lines: DataFrame, slot: str, order: list[str], text: str, limit: int = LIMIT) -> DataFrame:
    """(slot, content, rejected): lines added in order, each on a line of its own; one that would exceed the limit is rejected.

    Empty lines add nothing. Only the slot's content, which the limit bounds, is held while its lines stream by.
    """
    if not 1 <= limit <= MOST:
        raise ValueError(f"a slot's limit lies between 1 and {MOST}")

    def step(state, row):
        content, rejected = state or ("", 0)
        grown = content + ("\n" if content and not content.endswith("\n") else "") + row[0]
        return ((grown, rejected) if len(grown) <= limit else (content, rejected + 1)), None

    return fold_in_order(lines.where(F.col(text) != ""), [slot], order, [text], step, "content string, rejected int", lambda state: state)
