"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import math
import warnings
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpointed, prepare, unused

#: Labelled rows to learn from, those of the smallest hashes; only their features are gathered.
LABELLED = 6000
#: Rounds of co-training, each over all unlabelled rows; in each a view hands over at most so many pseudo-labels
#: per class, of rows of which it is so confident, those of the smallest hashes.
ROUNDS, HANDED, CONFIDENT = 3, 200, 0.98
#: The threshold rejects at most this share of held-out good documents.
LOST_GOOD = 0.002
#: Labels of either kind below which nothing is learned.
LEAST_LABELS = 10

#: The text view: shares of kinds of characters and words, then words by hash.
SHARES, HASHED = 16, 512
TEXT_VIEW = SHARES + HASHED
SOURCES, LANGS = 32, 8
META_VIEW = 4 + SOURCES + LANGS
#: Words whose places a worker keeps.
KEPT_WORDS = 300_000
_place: dict[str, int] = {}


def _share(x: float, n: float) -> float:
    return x / n if n else 0.0


def _places(found: Iterable[str]) -> list[int]:
    if len(_place) > KEPT_WORDS:
        _place.clear()
    out = []
    for w in found:
        at = _place.get(w)
        if at is None:
            at = _place[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % HASHED
        out.append(at)
    return out


def text_view(text: str) -> np.ndarray:
    """What the words and characters of the whole text are: shares, and the square root of each hashed word's share."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h = np.bincount(raw, minlength=256)
    n = len(raw)
    upper, lower, digits, beyond = h[65:91].sum(), h[97:123].sum(), h[48:58].sum(), h[128:].sum()
    words = text.split()
    counts = Counter(words)
    lines = [x for x in text.splitlines() if x.strip()]
    c = lambda s: sum(int(h[ord(x)]) for x in s)
    k = len(words)
    shares = [
        _share(upper, upper + lower), _share(digits, n), _share(c("!"), k), _share(c("|"), k), _share(c("#$%&*"), k), _share(c(".,;:"), k), _share(c("?"), k),
        _share(c("()[]{}<>"), k), _share(c("=/\\_~^@+"), k), _share(beyond, n), _share(len(counts), k), _share(sum(map(len, words)), k) / 10,
        _share(sum(v for w, v in counts.items() if len(w) <= 3), k), _share(len(lines) - len(set(lines)), len(lines)),
        _share(max(counts.values(), default=0), k), math.log1p(max(map(len, counts), default=0)),
    ]
    hashed = np.bincount(_places(counts), np.fromiter(counts.values(), float, len(counts)), HASHED) if k else np.zeros(HASHED)
    return np.concatenate((shares, np.sqrt(hashed / max(1, k))))


def meta_view(n_chars: float | None, source: str | None, lang: str | None) -> list[float]:
    """What the table says of a page beside its text: length, source and language; nothing is read from the text."""
    told = n_chars is not None and n_chars == n_chars
    n = math.log1p(max(0, n_chars)) if told else 0.0
    out = [n, n * n / 10, float(told and n_chars <= 0), float(not told)]
    for value, size in ((source, SOURCES), (lang, LANGS)):
        hot = [0.0] * size
        if value is not None:
            hot[zlib.crc32(value.encode("utf-8", "surrogatepass")) % size] = 1.0
        out += hot
    return out


class Logistic:
    """Logistic regression on standardised features, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._z(x)
        w = np.zeros(z.shape[1])
        # many features beside few rows ask for more
        ridge = np.full(len(w), l2 * max(1.0, x.shape[1] / 16))
        ridge[-1] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            w -= step
            if abs(step).max() < 1e-6:
                break
        self.w = w

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


@dataclass
class CoTrained:
    """The two views' classifiers, their joint calibration and the threshold; without views nothing was learned."""

    views: tuple[Logistic, Logistic] | None
    joint: Logistic | None
    threshold: float
    #: Pseudo-labels that each view got from the other.
    received: tuple[int, int] = (0, 0)

    @classmethod
    def train(cls, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, ask: Callable[[tuple[Logistic, Logistic], int], list[tuple[int, int, np.ndarray, np.ndarray]]], rounds: int = ROUNDS) -> CoTrained:
        """labelled: features of the two views. A quarter of the labelled rows only calibrates.

        ask(models, round) gives (giver, label, text features, metadata features) of the rows, of all that have no
        label, that a view is sure of and hands over: they train the other view from then on.
        """
        held = np.arange(len(y)) % 4 == 3
        if min((y[~held] == v).sum() for v in (0, 1)) < LEAST_LABELS or len(set(y[held])) < 2:
            return cls(None, None, 0.0)
        xs = [v[~held] for v in labelled]
        ys = [y[~held].astype(float)] * 2
        received = [0, 0]
        for r in range(rounds):
            handed = ask(tuple(Logistic(xs[i], ys[i]) for i in (0, 1)), r)
            for giver, label, *views in handed:
                taker = 1 - giver
                xs[taker] = np.vstack([xs[taker], views[taker][None]])
                ys[taker] = np.append(ys[taker], float(label))
                received[taker] += 1
            if not handed:
                break
        models = tuple(Logistic(xs[i], ys[i]) for i in (0, 1))
        # the weight of each view, and the calibration, come from rows that neither has seen
        joint = Logistic(np.stack([models[i].logit(labelled[i][held]) for i in (0, 1)], axis=1), y[held].astype(float), 0.1)
        model = cls(models, joint, 0.5, tuple(received))
        good = np.sort(model.score(tuple(v[held] for v in labelled))[y[held] == 1])
        model.threshold = float(min(0.5, good[int(LOST_GOOD * len(good))]))
        return model

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Calibrated probability that a document is good; NaN where nothing could be learned."""
        if self.views is None:
            return np.full(len(views[0]), np.nan)
        return _sigmoid(self.joint.logit(np.stack([m.logit(v) for m, v in zip(self.views, views)], axis=1)))


def _views(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    said = lambda x: x if isinstance(x, str) else None
    return (
        np.array([text_view(said(t) or "") for t in frame["text"]], dtype=float).reshape(-1, TEXT_VIEW),
        np.array([meta_view(n, said(s), said(g)) for n, s, g in zip(frame["n_chars"].astype(float), frame["source"], frame["lang"])], dtype=float).reshape(-1, META_VIEW),
    )


_FEATURES = "t binary, m binary"


def _packed(views: tuple[np.ndarray, np.ndarray]) -> dict[str, list[bytes]]:
    """Features as bytes: a tenth of what lists of numbers take."""
    return {n: [row.astype("<f4").tobytes() for row in v] for n, v in zip("tm", views)}


def _unpacked(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([np.frombuffer(r[n], "<f4") for r in rows], dtype=float).reshape(-1, size) for n, size in (("t", TEXT_VIEW), ("m", META_VIEW)))


def _own(docs: DataFrame) -> DataFrame:
    """The columns that are read; a table without one of the metadata columns has nulls there."""
    there = lambda n, kind: F.col(n).cast(kind) if n in docs.columns else F.lit(None).cast(kind)
    return docs.select("doc_id", "text", there("source", "string").alias("source"), there("lang", "string").alias("lang"), there("n_chars", "long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Learn from docs(doc_id, text, source, lang, n_chars) and labels(doc_id, quality).

    The labelled rows are `labelled` at most, those of the smallest hashes of the id. In each round both views look
    at all rows without a label, where they are, and hand over some that they are sure of. Of contradicting labels
    of a document the lower holds, repeated labels and documents count once; null ids, labels and texts are not learned
    from. With under LEAST_LABELS labels of either kind a warning is given and nothing is learned.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = _own(docs).where("doc_id is not null and text is not null")
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    # ids and labels only, a bounded number of rows: fit for every executor
    sample = bounded_sample(told, labelled, "doc_id").withColumn("k", F.xxhash64("doc_id", F.lit("quality")))

    def features(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"k": b["k"], "y": b["y"], **_packed(_views(b))})

    got = own.join(F.broadcast(sample), "doc_id").mapInPandas(features, f"k long, y int, {_FEATURES}").collect()
    got = list({r.k: r for r in sorted(got, key=lambda r: (r.k, r.t), reverse=True)}.values())[::-1]
    known = told.select("doc_id")
    # a row is known by its hash: what travels of the whole table is ids and hashes, never texts
    rest = own.withColumn("k", F.xxhash64("doc_id", F.lit("pool")))
    seen: set[int] = set()

    def ask(models: tuple[Logistic, Logistic], r: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        def sure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                p = [_sigmoid(m.logit(v)) for m, v in zip(models, _views(b))]
                for giver in (0, 1):
                    for label, at in ((1, p[giver] >= CONFIDENT), (0, p[giver] <= 1 - CONFIDENT)):
                        if at.any():
                            yield b.loc[at, ["doc_id", "k"]].assign(giver=giver, label=label)

        said = rest.mapInPandas(sure, f"doc_id {dict(own.dtypes)['doc_id']}, k long, giver int, label int")
        found = checkpointed(said.join(known, "doc_id", "left_anti").select("giver", "label", "k").distinct())
        wanted, picked = HANDED * rounds, []  # some are handed over already
        for c in found.groupBy("giver", "label").count().orderBy("giver", "label").collect():
            mine = found.where((F.col("giver") == c.giver) & (F.col("label") == c.label)).select("k")
            if c["count"] > 2 * wanted:
                mine = mine.where(F.shiftrightunsigned(F.xxhash64("k"), 1) < int((1 << 63) * (1.5 * wanted / c["count"])))
            fresh = sorted(x.k for x in mine.collect() if x.k not in seen)[:HANDED]
            seen.update(fresh)
            picked += [(k, c.giver, c.label) for k in fresh]
        if not picked:
            return []
        ids = F.broadcast(spark.createDataFrame(sorted({(k,) for k, *_ in picked}), "k long"))  # 4 * HANDED at most
        rows = rest.join(ids, "k").withColumn("y", F.lit(0)).mapInPandas(features, f"k long, y int, {_FEATURES}").collect()
        by_k = {x.k: x for x in sorted(rows, key=lambda x: (x.k, x.t), reverse=True)}
        return [(giver, label, *(v[0] for v in _unpacked([by_k[k]]))) for k, giver, label in picked]

    y = np.array([r.y for r in got], dtype=int)
    model = CoTrained.train(_unpacked(got), y, ask, rounds)
    if model.views is None:
        warnings.warn(f"{len(y)} labelled documents, {int((y == 1).sum())} of them good, are too few: no quality is learned", stacklevel=2)
    return model


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """docs with quality_text, quality_meta, quality_score (0 to 1) and quality_keep; columns of these names are replaced.

    Whole texts are read. A null text counts as empty, null source, lang or n_chars as unknown, as does a column that
    docs doesn't have; repeated rows score alike. Where nothing was learned scores are null and
    all is kept. An empty table stays empty.
    """
    prepare(docs.sparkSession)
    names = ["quality_text", "quality_meta", "quality_score", "quality_keep"]
    kept = docs.drop(*names)

    @F.pandas_udf("quality_text double, quality_meta double, quality_score double, quality_keep boolean")
    def of(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, source, lang, n_chars in parts:
            views = _views(pd.DataFrame({"text": text, "source": source, "lang": lang, "n_chars": n_chars}))
            total = model.score(views)
            each = [_sigmoid(m.logit(v)) for m, v in zip(model.views, views)] if model.views else [total, total]
            yield pd.DataFrame(dict(zip(names, [*each, total, np.isnan(total) | (total >= model.threshold)])))

    at = unused(kept, "_of")
    read = [F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind) for c, kind in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "double"))]
    out = docs.withColumn(at, of(*read))
    numbers = [F.when(~F.isnan(f"{at}.{c}"), F.col(f"{at}.{c}")).alias(c) for c in names[:3]]
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], *numbers, F.col(f"{at}.quality_keep"))
