"""SentencePiece segmentation sampled by forward filtering and backward sampling."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, unused

#: Units whose lattices a worker keeps; the memory they take is bounded by it.
KEPT_UNITS = 400_000
#: Texts are sampled in groups of at most so many characters, a longer text alone.
GROUP_CHARS = 2_000_000
SPACE = "▁"
#: Weights are raised by this for each character of a piece.
RAISE = 8.0


class Lattice:
    """The piece lattice of a SentencePiece model with byte fallback, and its sampler.

    A piece's weight is 1 / (rank + 1) ** alpha, ranks by the model's scores: scores of a BPE
    model are ranks, not log probabilities. Large alpha comes near one segmentation, 0 weighs
    all alike. Spaces are the model's space mark; no space is put before a text and
    nothing is normalised, so that decoding gives back the very text. A character that is no piece,
    the space mark itself included, is its UTF-8 bytes.
    """

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        byte_ids, usual = {}, []
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usual.append(i)
        usual.sort(key=lambda i: (-sp.get_score(i), i))
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.weight: dict[str, tuple[float, int]] = {}
        for rank, i in enumerate(usual):
            piece = sp.id_to_piece(i).replace(SPACE, " ")
            self.bytes_of[i] = piece.encode()
            self.weight.setdefault(piece, ((rank + 1.0) ** -alpha, i))
        self.byte_weight = (len(usual) + 1.0) ** -alpha
        self._trie()
        # by id: length and weight; each character raises the weight, which changes no chance but keeps sums near 1
        self.length = np.ones(n, np.int64)
        self.chance = np.zeros(n)
        for piece, (w, i) in self.weight.items():
            self.length[i], self.chance[i] = len(piece), w * RAISE ** len(piece)
        self.longest = int(self.length.max())
        self.unit = self._units()
        self._forget()

    def _trie(self) -> None:
        """All pieces as a tree: sorted (state, character) keys with the state they lead to, and each state's piece or -1."""
        number, edges = {"": 0}, {}
        for piece in self.weight:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in number:
                    number[piece[:n]] = len(number)
                    edges[number[piece[: n - 1]] << 21 | ord(piece[n - 1])] = number[piece[:n]]
        self.step = np.array(sorted(edges), dtype=np.int64)
        self.leads = np.array([edges[k] for k in self.step.tolist()], dtype=np.int64)
        self.ends_piece = np.full(len(number), -1, np.int64)
        for piece, (_, i) in self.weight.items():
            self.ends_piece[number[piece]] = i

    def _matches(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, piece) of every piece that begins at `starts`, walking the tree from all of them at once."""
        ends, pieces, state, back = [], [], np.zeros(len(starts), np.int64), 0
        while len(starts):
            keys = state << 21 | codes[starts + back]
            at = np.minimum(np.searchsorted(self.step, keys), len(self.step) - 1)
            on = self.step[at] == keys
            starts, state = starts[on], self.leads[at[on]]
            hit = self.ends_piece[state]
            ends.append((starts + back)[hit >= 0])
            pieces.append(hit[hit >= 0])
            back += 1
        return np.concatenate([np.zeros(0, np.int64), *ends]), np.concatenate([np.zeros(0, np.int64), *pieces])

    def _units(self) -> re.Pattern:
        """Units between which no piece reaches, so that they are independent: a character of no longer piece, or spaces with what follows."""
        longer = [p for p in self.weight if len(p) > 1]
        if any(re.search("[^ ] ", p) for p in longer):
            return re.compile(r"[\s\S]+")
        inside = set("".join(longer)) | {" "}
        alone = "".join(chr(i) for i in range(1, 128) if chr(i) not in inside)
        letter = r"[^\W\d_]"
        after = {m[1] for p in longer for m in re.finditer(f"(?<={letter})(\\W|[\\d_])", p)} | {" "}
        # a word ends before a sign that no piece has after a letter
        safe = "".join(chr(i) for i in range(1, 128) if not chr(i).isalpha() and chr(i) not in after)
        parts = [f" *{letter}+(?=[{re.escape(safe)}])"] if safe else []
        parts += [f"[{re.escape(alone)}]"] if alone else []
        return re.compile("|".join([*parts, f" *[^ {re.escape(alone)}]+", " +"]))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.done = self.states = self.edges = 0
        self.last = np.zeros(0, np.int64)  # by unit: its last state
        self.local = np.zeros(0, np.int32)  # by state: its place in its unit, from 1
        self.cum = np.zeros(0)  # by edge: its state's number plus the chance of the state's edges up to it
        self.piece = np.zeros(0, np.int32)  # by edge: the piece's id, or -1 - code point

    def _grow(self, name: str, size: int) -> np.ndarray:
        held = getattr(self, name)
        if len(held) < size:
            held = np.concatenate([held, np.zeros(max(size, 2 * len(held)) - len(held), held.dtype)])
            setattr(self, name, held)
        return held

    def _compile(self, units: list[str]) -> None:
        """Forward filtering of many units at once: the chances of the pieces that end at each place.

        Sums go place by place, over all units at once.
        """
        line = "\0".join(units) + "\0"
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        inside = np.ones(len(codes), bool)
        inside[starts + sizes] = False
        # no piece reaches over a join, which is no character of any
        ends, piece = self._matches(codes, np.flatnonzero(inside))
        single = np.zeros(len(codes), bool)
        single[ends[self.length[piece] == 1]] = True
        bare = np.flatnonzero(inside & ~single)
        ends, piece = np.concatenate([ends, bare]), np.concatenate([piece, -1 - codes[bare]])
        order = np.argsort(ends, kind="stable")
        ends, piece = ends[order], piece[order]
        length = np.where(piece < 0, 1, self.length[np.maximum(piece, 0)])
        weight = np.where(piece < 0, self.byte_weight * RAISE, self.chance[np.maximum(piece, 0)])
        # alpha by character of the line; the one before a unit's first is its start
        alpha = np.zeros(len(codes) + 1)
        alpha[starts] = 1.0
        place = np.arange(len(codes)) - np.repeat(starts, sizes + 1) + 1
        local = place[ends]
        share = np.zeros(len(ends))
        steps = np.argsort(local, kind="stable")
        cuts = np.searchsorted(local[steps], np.arange(1, sizes.max() + 2))
        for j in range(len(cuts) - 1):
            e = steps[cuts[j] : cuts[j + 1]]
            if not len(e):
                break
            end = ends[e]
            p = alpha[end + 1 - length[e]] * weight[e]
            first = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
            total = np.add.reduceat(p, first)
            q = p / np.repeat(total, np.diff(np.concatenate((first, [len(e)]))))
            share[e] = np.cumsum(q) - np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(e)]))))
            at = end[first] + 1
            alpha[at] = total
            far = (total < 1e-100) | (total > 1e100)
            if far.any():
                for back in range(min(self.longest, j + 2)):
                    alpha[at[far] - back] /= total[far]
        state = self.states + np.cumsum(inside)[ends] - 1
        cum = state + np.clip(share, 0.0, 1.0)
        final = np.concatenate((ends[1:] != ends[:-1], [True]))
        cum[final] = state[final] + 1.0
        n, m, k = self.edges, self.states, len(units)
        self._grow("cum", n + len(cum))[n : n + len(cum)] = cum
        self._grow("piece", n + len(cum))[n : n + len(cum)] = piece
        self._grow("local", m + int(inside.sum()))[m : m + int(inside.sum())] = place[inside]
        self._grow("last", self.done + k)[self.done : self.done + k] = m + np.cumsum(sizes) - 1
        self.edges, self.states, self.done = n + len(cum), m + int(inside.sum()), self.done + k

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of one sampled segmentation per text; the same for the same text, key and model, however texts are grouped."""
        split = [self.unit.findall(t) for t in texts]
        if len(self.known) > KEPT_UNITS:
            self._forget()
        number = self.known.setdefault
        units = np.array([number(u, len(self.known)) for us in split for u in us], dtype=np.int64)
        if not len(units):
            return [np.zeros(0, np.int64) for _ in texts]
        if len(self.known) > self.done:
            new = list(itertools.islice(self.known, self.done, None))
            self._compile(new)
        cum, last = self.cum[: self.edges], self.last
        counts = np.fromiter(map(len, split), np.int64, len(split))
        owner = np.repeat(np.arange(len(texts)), counts)
        state = last[units]
        size = self.local[state].astype(np.int64)
        ends = np.cumsum(size)
        text_start = np.concatenate(([0], ends))[np.cumsum(counts) - counts]
        base = ends - size - text_start[owner]  # the unit's place in its own text
        key = keys[owner].astype(np.uint64)
        live, at = np.arange(len(units)), size.copy()
        taken_unit, taken_piece = [], []
        while len(live):
            u = _uniform(key[live], (base[live] + at).astype(np.uint64))
            piece = self.piece[np.searchsorted(cum, state + u, side="right")]
            taken_unit.append(live)
            taken_piece.append(piece)
            back = np.where(piece < 0, 1, self.length[np.maximum(piece, 0)])
            at, state = at - back, state - back
            on = at > 0
            live, state, at = live[on], state[on], at[on]
        unit, piece = np.concatenate(taken_unit), np.concatenate(taken_piece)
        # steps run backwards: the later a step the earlier its piece
        pieces_of = np.bincount(unit, minlength=len(units))
        ends_at = np.cumsum(pieces_of)
        step = np.repeat(np.arange(len(taken_unit)), [len(x) for x in taken_unit])
        ids = np.empty(len(piece), np.int64)
        ids[ends_at[unit] - 1 - step] = piece
        cuts = np.concatenate(([0], ends_at))[np.cumsum(counts)][:-1]
        return [self._spell(x) for x in np.split(ids, cuts)]

    def _spell(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece become their bytes' pieces."""
        if not (ids < 0).any():
            return ids
        out: list[int] = []
        for i in ids.tolist():
            out += [i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
        return np.array(out, dtype=np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")


def _uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for a row's key and a place in its text (splitmix64)."""
    z = key + at * np.uint64(0x9E3779B97F4A7C15)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(times)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(12)).astype(np.float64) * 2.0**-52


_loaded: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, alpha: float = 1.0) -> Lattice:
    """The model of this worker process, loaded once."""
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattice(path, alpha)
    return _loaded[path, alpha]


def encode(docs: DataFrame, model: str, key_col: str, text_col: str = "text", alpha: float = 1.0, seed: int = 0, digest: bool = False) -> DataFrame:
    """docs with pieces (ids), one segmentation sampled per row, seeded by the row's key and `seed`.

    With digest, pieces gives way to n_chars, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and lossless: whether
    decoding gave the very text. Null and empty texts have no pieces. Rows of equal key and
    text are segmented alike; a null key is a key like others. Columns of docs with the results' names are
    replaced, others kept; an empty table stays empty. Whole texts are segmented.
    """
    prepare(docs.sparkSession)
    names = {"n_chars": "long", "n_pieces": "long", "ids_crc32": "long", "lossless": "boolean"} if digest else {"pieces": "array<int>"}
    kept = docs.drop(*[c for c in names if c not in (key_col, text_col)])

    @F.pandas_udf(", ".join(f"{n} {t}" for n, t in names.items()))
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        lat = lattice(model, alpha)

        def rows(texts: list[str], keys: np.ndarray):
            for text, ids in zip(texts, lat.sample(texts, keys)):
                if digest:
                    yield len(text), len(ids), zlib.crc32(ids.astype("<u4")), lat.decode(ids.tolist()) == text
                else:
                    yield (ids.astype(np.int32),)

        for key, text in parts:
            texts, keys = [t if isinstance(t, str) else "" for t in text], key.to_numpy().view(np.uint64)
            out, at = [], 0
            while at < len(texts):
                to, held = at + 1, len(texts[at])
                while to < len(texts) and held + len(texts[to]) <= GROUP_CHARS:
                    held += len(texts[to])
                    to += 1
                out += rows(texts[at:to], keys[at:to])
                at = to
            yield pd.DataFrame(out, columns=list(names))

    at = unused(kept, "_of")
    row_key = F.xxhash64(F.col(key_col), F.lit(seed))
    cols = [F.col(f"`{c}`") for c in kept.columns if c not in names]
    return kept.withColumn(at, of(row_key, F.col(text_col))).select(*cols, f"{at}.*")


def decode(rows: DataFrame, model: str, pieces_col: str = "pieces", text_col: str = "text") -> DataFrame:
    """rows with text_col, the text that pieces_col spells; null pieces are the empty text."""
    prepare(rows.sparkSession)

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lat = lattice(model)
        for s in parts:
            yield pd.Series([lat.decode(p) if p is not None else "" for p in s], dtype=object)

    return rows.withColumn(text_col, of(F.col(pieces_col)))
