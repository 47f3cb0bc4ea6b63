"""Cost-balanced packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

LENGTH = 1024
#: Documents whose leftovers are balanced together; bounds memory and the search for a sequence.
BLOCK = 4096
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention within the piece).
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long, cost double"
)


#: How the ByteLevel pre-tokenizer cuts a text if its use_regex is on: fixed by the `tokenizers` library, not in its files.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids with the byte-level BPE of a `tokenizers` JSON file, run by tiktoken.

    Vocabulary, byte alphabet and added tokens come from the file; its merges have the order of its ids,
    so that ranks give the same ids as `tokenizers` (a test holds them against each other)
    at a fifth of the time. As there, the strings of added tokens in a text are those tokens. Files
    that ask for anything else (normalisers, other cuts, flags of added tokens) are an error.
    """
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    cut = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens", [])
    flags = [t for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or flags or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path}: only plain byte-level BPE is supported")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    made = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return made.encode(text, allowed_special="all")
        return made.encode_ordinary(text)

    return encode


def _cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def balance(rests: list[tuple[int, int]], length: int = LENGTH) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, from, to) for leftovers (document, tokens), each under `length` tokens.

    Leftovers go in descending order to the sequence of lowest cost that has room for them, of all there are.
    Those that fit nowhere whole wait until all others have a place and are then cut over the
    cheapest sequences with room. All sequences are full but one, which is split at powers
    of two, where no padding is needed.
    """
    total = sum(n for _, n in rests)
    whole, left = divmod(total, length)
    room = np.array([length] * whole + [left] * (left > 0), dtype=np.int64)
    cost = np.zeros(len(room))
    held: list[list[tuple[int, int, int]]] = [[] for _ in room]

    def cheapest(n: int) -> int:
        return int(np.where(room >= n, cost, np.inf).argmin())

    def put(s: int, doc: int, a: int, b: int) -> None:
        held[s].append((doc, a, b))
        room[s] -= b - a
        cost[s] += _cost(b - a)

    waiting = []
    for doc, n in sorted(rests, key=lambda x: (-x[1], x[0])):
        if room[s := cheapest(n)] >= n:
            put(s, doc, 0, n)
        else:
            waiting.append((doc, n))
    for doc, n in waiting:
        at = 0
        while at < n:
            s = cheapest(1)
            take = min(int(room[s]), n - at)
            put(s, doc, at, at + take)
            at += take
    yield from held[:whole]
    if left:
        pieces, goal, used, out = held[whole], 1 << (left.bit_length() - 1), 0, []
        for doc, a, b in pieces:
            while a < b:
                take = min(b - a, goal - used)
                out.append((doc, a, a + take))
                a, used = a + take, used + take
                if used == goal:
                    yield out
                    left -= goal
                    goal, used, out = 1 << (max(left, 1).bit_length() - 1), 0, []


def pack_block(docs: list[tuple[object, np.ndarray]], length: int, first: int) -> Iterator[tuple]:
    """Rows of SCHEMA for documents (id, ids): full sequences first, then the balanced leftovers."""
    sequence = first

    def row(doc: int, a: int, b: int, offset: int, size: int) -> tuple:
        key, ids = docs[doc]
        pad = 0 if size & (size - 1) == 0 else length - size
        return (key, a, b - a, zlib.crc32(ids[a:b]), len(ids), sequence, offset, size, pad, _cost(b - a))

    rests = []
    for doc, (_, ids) in enumerate(docs):
        full = len(ids) // length * length
        for a in range(0, full, length):
            yield row(doc, a, a + length, 0, length)
            sequence += 1
        if full < len(ids):
            rests.append((doc, len(ids) - full))
    for pieces in balance(rests, length):
        size, offset = sum(b - a for _, a, b in pieces), 0
        for doc, a, b in pieces:
            base = len(docs[doc][1]) // length * length
            yield row(doc, base + a, base + b, offset, size)
            offset += b - a
        sequence += 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and more.

    Each document's ids get `end` appended; every id lies in exactly one piece. Documents
    are packed where they are read, `block` at a time (or 16 M tokens), without a shuffle; costs are balanced
    within such a block, a bound of memory and not of what is packed. sequence_id is
    unique over the table. A sequence whose size is a power of two isn't padded, others are
    padded to `length`; as leftovers are cut freely, no sequence needs padding. A null
    or empty text is the one id `end`; repeated rows are packed each; a null id stays null;
    further columns are not read; an empty table gives none. `length` is a power of two.
    Very long texts are tokenised whole, alone in their block.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    prepare(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        held, tokens = [], 0

        def flush():
            nonlocal first
            rows = list(pack_block(held, length, first))
            first = rows[-1][5] + 1
            held.clear()
            return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for key, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = encode(text) if text else []
                ids.append(end)
                held.append((None if key is None or key != key else int(key), np.array(ids, dtype="<u4")))
                tokens += len(ids)
                if len(held) >= block or tokens > 16_000_000:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)
