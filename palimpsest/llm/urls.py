"""URL filter: longest-match rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, prepare

#: At most so many labelled URLs, those of the smallest hashes, train the model.
TRAIN_ROWS = 10_000


@dataclass(frozen=True)
class Rule:
    """`host/path` with a verdict; it fits the host and its subdomains, and paths that start with `/path`."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host with A-Z lower-cased; both empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = re.search(r"[/?#]", rest)
    host, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    stop = re.search(r"[?#]", rest)
    return _lower(host), rest[: stop.start()] if stop else rest


_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lower(s: str) -> str:
    return s.translate(_AZ)


def compile_rules(rules: Iterable[Rule]) -> dict[str, list[Rule]]:
    """Rules by host, so that a URL is held against those of its own suffixes only."""
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    return by_host


def match(by_host: dict[str, list[Rule]], host: str, path: str) -> Rule | None:
    """The longest fitting rule; of equally long ones a block, then the smaller text."""
    if not host:
        return None
    labels, found = host.split("."), []
    for i in range(len(labels)):
        for r in by_host.get(".".join(labels[i:]), ()):
            if path.startswith(r.path):
                found.append(r)
    return min(found, key=lambda r: (-len(r.text), r.verdict != "block", r.text), default=None)


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "odd_ratio", "https", "longest_label", "suffix_rate", "suffix_seen", "word_rate")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def _words(url: str) -> list[str]:
    return re.findall(r"[a-z]{3,}", _lower(url))


def lexical(url: str, suffix: dict[str, tuple[float, float]], word: dict[str, float]) -> list[float]:
    host, path = split_url(url)
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".") if host else []
    seen = next((suffix[s] for s in _suffixes(host) if s in suffix), (0.5, 0.0))
    rates = [word[w] for w in _words(url) if w in word]
    n = max(1, len(url))
    return [
        len(url), len(host), len(path), path.count("/"), len(labels), sum(c.isdigit() for c in url) / n, url.count("-"), _entropy(url), _entropy(host),
        query.count("&") + 1 if query else 0, len(query), sum(not (c.isalnum() or c in "/.:-?=&#_") for c in url) / n, url.startswith("https"), max(map(len, labels), default=0),
        seen[0], math.log1p(seen[1]), max(rates, key=lambda r: abs(r - 0.5), default=0.5),
    ]


@dataclass
class Boosted:
    """Gradient-boosted regression trees on the logistic loss, over quantile bins."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    base: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        p = (y.sum() + 1) / (len(y) + 2)
        model = cls(edges, [], float(np.log(p / (1 - p))))
        raw = np.full(len(y), model.base)
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-raw))
            tree = cls._grow(binned, prob - y, prob * (1 - prob), depth, rate, bins, l2)
            model.trees.append(tree)
            raw += cls._walk(tree, binned)
        return model

    @staticmethod
    def _grow(b, g, h, depth, rate, bins, l2):
        """Complete levels: feature, bin and value arrays indexed as a heap."""
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(g), int)
        for at in range(size):
            own = np.flatnonzero(node == at)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[at] = -rate * gs / (hs + l2)
            if at >= size // 2 or len(own) < 8:
                continue
            best = 1e-6
            for j in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[own, j], g[own], bins))[:-1]
                hl = np.cumsum(np.bincount(b[own, j], h[own], bins))[:-1]
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                if gain.max() > best:
                    best, feature[at], cut[at] = gain.max(), j, int(gain.argmax())
            if feature[at] >= 0:
                node[own] = 2 * at + 1 + (b[own, feature[at]] > cut[at])
        return feature, cut, value

    @staticmethod
    def _walk(tree, b):
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        for _ in range(int(np.log2(len(feature) + 1))):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (b[np.arange(len(b)), f] > cut[node]), node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        return 1 / (1 + np.exp(-(self.base + sum(self._walk(t, b) for t in self.trees))))


@dataclass
class UrlModel:
    trees: Boosted | None
    suffix: dict[str, tuple[float, float]]
    word: dict[str, float]
    cut: float

    def block_probability(self, urls: list[str]) -> np.ndarray:
        if not urls or self.trees is None:
            return np.zeros(len(urls))
        return self.trees.predict(np.array([lexical(u, self.suffix, self.word) for u in urls], dtype=float))


def _rates(keys: list[list[str]], y: np.ndarray, least: int) -> dict[str, tuple[float, float]]:
    n, bad = Counter(), Counter()
    for ks, label in zip(keys, y):
        for k in set(ks):
            n[k] += 1
            bad[k] += label
    return {k: ((bad[k] + 1) / (n[k] + 2), float(n[k])) for k in n if n[k] >= least}


def train(urls: list[str], blocked: list[bool], cut: float = 0.5) -> UrlModel:
    """Fit on labelled URLs. Suffix and word rates of a row come from the other half, not from its own label."""
    y = np.array(blocked, dtype=float)
    if len(set(blocked)) < 2:
        return UrlModel(None, {}, {}, cut)
    half = np.array([hash_half(u) for u in urls])
    hosts, words = [_suffixes(split_url(u)[0]) for u in urls], [_words(u) for u in urls]
    x = np.zeros((len(urls), len(FEATURES)))
    for side in (0, 1):
        rest, own = np.flatnonzero(half != side), np.flatnonzero(half == side)
        suffix = _rates([hosts[i] for i in rest], y[rest], 2)
        word = {k: v[0] for k, v in _rates([words[i] for i in rest], y[rest], 5).items()}
        for i in own:
            x[i] = lexical(urls[i], suffix, word)
    return UrlModel(Boosted.fit(x, y), _rates(hosts, y, 2), {k: v[0] for k, v in _rates(words, y, 5).items()}, cut)


def hash_half(url: str) -> int:
    import zlib

    return zlib.crc32(split_url(url)[0].encode("utf-8", "surrogatepass")) & 1


def host_column(url_col: str) -> Column:
    """The host as split_url gives it, empty where there is none; JVM expressions only."""
    rest = F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.col(url_col).contains("://"), host).otherwise("")


def path_column(url_col: str) -> Column:
    """The path as split_url gives it; JVM expressions only."""
    rest = F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")
    return F.when(F.col(url_col).contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_labels(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """(url, blocked) of the distinct URLs that a rule decides; JVM expressions only."""
    url, host, path = F.col(url_col), host_column(url_col), path_column(url_col)
    out = F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.verdict == "block")).otherwise(out)
    return pages.select(url.alias("url"), out.alias("blocked")).where("blocked is not null").distinct()


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and block_score.

    labelled(url, blocked) trains the trees, on the TRAIN_ROWS rows of the smallest hashes at most, however
    long. A rule decides where one fits, else the trees: block from `cut` on. Null urls and
    those without `://` have empty host and path and are judged by the trees as the empty
    URL. Repeated rows are judged each. Other columns are not returned. With no labelled row of
    either kind the trees say allow. An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    rows = bounded_sample(labelled.where(F.col("blocked").isNotNull() & F.col("url").isNotNull()), TRAIN_ROWS, "url", "blocked").collect()
    model = train([r.url for r in rows], [bool(r.blocked) for r in rows], cut)
    by_host = compile_rules(rules)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            urls = [u if isinstance(u, str) else None for u in batch["url"]]
            split = [split_url(u) for u in urls]
            found = [match(by_host, *s) for s in split]
            score = np.full(len(urls), np.nan)
            open_ = [i for i, r in enumerate(found) if r is None]
            score[open_] = model.block_probability([urls[i] or "" for i in open_])
            batch["host"], batch["path"] = [h for h, _ in split], [p for _, p in split]
            batch["rule"] = [r and r.text for r in found]
            batch["verdict"] = [r.verdict if r else "block" if s >= cut else "allow" for r, s in zip(found, score)]
            batch["block_score"] = [float(r.verdict == "block") if r else float(s) for r, s in zip(found, score)]
            yield batch.drop(columns="url")

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).mapInPandas(
        run, f"page_id {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string, block_score double"
    )
