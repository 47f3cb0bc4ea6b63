"""SimHash near-duplicate groups found with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import checkpointed, prepare, unused
from .components import components

BITS = 64


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a whole text, unsigned.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of `shingle`
    words count as often as they occur; a shorter text is one shingle, no word gives 0.
    A bit is set if more than half the XXH64 hashes set it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: str, shingle: int = 3):
    """Column of fingerprints as signed longs; null text counts as empty."""

    @F.pandas_udf(LongType())
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.array([simhash(t, shingle) for t in s], dtype=np.uint64).view(np.int64))

    return of(F.col(text))


def covering_masks(radius: int = 2, bits: int = BITS) -> list[int]:
    """2^(radius+1)-1 masks; any two words within `radius` agree on all bits of some mask.

    Bit i carries the nonzero vector m(i) of radius+1 bits, dealt in turn. The mask of v
    keeps bit i if <m(i), v> is odd. At most `radius` differing bits are `radius` linear
    conditions on v, so a nonzero v meets them all and its mask keeps none of those bits.
    """
    top = 1 << (radius + 1)
    return [sum(1 << i for i in range(bits) if ((i % (top - 1) + 1) & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) among the distinct longs in prints(fp), with the components of all pairs within radius.

    Every table of the covering is grouped on its masked value. A bucket of two is compared
    directly. In a larger bucket the values are not paired: each is sent to the centres
    that differ from it in at most radius/2 of the bits outside the mask, and those who
    share a centre are linked to the smallest there. Two values share one exactly if they
    are within the radius, and a centre has at most 1 + 64 values, so that no
    bucket, however large, costs more than its size. Even radii only.
    """
    if radius != 2:
        raise ValueError("the centre step is written for radius 2")
    masks = covering_masks(radius)
    table = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(masks)))
    dealt = prints.select("fp", F.explode(table).alias("k")).select("fp", F.col("k.t").alias("t"), F.col("fp").bitwiseAND(F.col("k.m")).alias("key"))
    buckets = dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    pairs = buckets.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    flips = F.array(
        *(
            F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1))
            for m in masks
        )
    )
    large = dealt.join(buckets.where("n > 2").select("t", "key"), ["t", "key"])
    centres = (
        large.select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
        .groupBy("z")
        .agg(F.collect_set("fp").alias("all"))
        .where("size(all) > 1")
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
        .where("a <> b")
    )
    return pairs.unionByName(centres).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs with fingerprint (16 hex digits) and component_id, the smallest id reachable by links within radius.

    Equal fingerprints are gathered first, so copies cost one row. Null and empty texts have
    fingerprint 0 and are linked like any other; repeated rows stay, each with its group; a
    null id takes the group but never names one. An empty table gives an empty result. Clashing column names of docs are kept: only id_col
    and the two results are returned.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = checkpointed(own.select("doc_id", fingerprint_column("text", shingle).alias("fp")))
    groups = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(groups.select("fp"), radius))
    joined = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = joined.join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- groups at a similarity of word shingles, for which radius 2 alone is too narrow

#: MinHash samples, in bands: a pair of similarity 0.8 shares a band with a chance of 0.9998.
BANDS, BAND_ROWS = 16, 4


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles; a shorter text is one, no word gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 7) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64))


_MULTIPLY = np.random.default_rng(11).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """One signed long per band; equal in a band means equal least values of all its samples."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * _MULTIPLY
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


#: Bits of the parity sketch, and members of a bucket that all others are tried on first.
PARITY_BITS, REPRESENTATIVES = 512, 4
#: Members of a block: larger buckets are paired block by block, so that no task gets a whole one.
BLOCK = 128


def parities(hashes: np.ndarray) -> list[int]:
    """PARITY_BITS parities as signed longs: two sketches differ in no more bits than their sets differ in elements."""
    counts = np.bincount((hashes >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8").tolist()


def may_reach(a: str, b: str, at_least: float) -> Column:
    """False only if sizes or parities rule out a similarity of at_least between the shingle sets of rows a and b.

    Of sets with n elements together that differ in d, the similarity is (n - d) / (n + d).
    """
    n, most = F.col(f"{a}.n") + F.col(f"{b}.n"), (1 - at_least) / (1 + at_least)
    differ = sum((F.bit_count(F.get(f"{a}.parity", i).bitwiseXOR(F.get(f"{b}.parity", i))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return F.greatest(differ, F.abs(F.col(f"{a}.n") - F.col(f"{b}.n"))) <= n * F.lit(most) + 1e-6


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def unresolved(members: DataFrame, nodes: DataFrame, roots: DataFrame, at_least: float) -> DataFrame:
    """Pairs (x, y) of members of one bucket that are not in one group yet and whose similarity isn't ruled out.

    Every pair of a bucket that holds more than one group is looked at. A bucket is cut into
    blocks by hash, and each two blocks meet under a key of their own.
    """
    # the group of a text that no link has reached is itself
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("t", "key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size")).where("a <> b")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    kept = placed.join(open_.select("t", "key", blocks.alias("blocks")), ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    kept = checkpointed(kept.join(nodes.select("node", "n", "parity"), "node"))
    left = kept.withColumn("low", F.col("block")).withColumn("high", F.explode(F.sequence("block", F.col("blocks") - 1))).alias("l")
    right = kept.withColumn("high", F.col("block")).withColumn("low", F.explode(F.sequence(F.lit(0), "block"))).alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("t", "key", "low", "high")]
    on += [F.col("l.root") != F.col("r.root"), (F.col("l.low") < F.col("l.high")) | (F.col("l.node") < F.col("r.node")), may_reach("l", "r", at_least)]
    ends = F.col("l.node"), F.col("r.node")
    return left.join(right, on).select(F.greatest(*ends).alias("x"), F.least(*ends).alias("y")).distinct()


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, at_least: float = 0.8) -> DataFrame:
    """docs without near copies: of each group the row with the smallest id stays (nulls last).

    Copies go first, by digest. Candidates are pairs that agree on a covering mask of SimHash (3-word
    shingles; all pairs within two bits do) and, as a similarity of 0.8 is some ten bits away, pairs that
    share a MinHash band. A candidate is a link if the exact Jaccard similarity of its
    `shingle`-word shingles is at_least or more. First all members of a bucket are held against
    a few of them; in buckets that still hold more than one group then all pairs of different groups.
    Null and empty texts are copies of each other. All columns stay, whatever their names; an
    empty table stays empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = unused(docs, "_key")
    # one column says both text and id: what is dealt out by it need not be dealt out again
    row_key = lambda n, i: F.concat(n, F.lit(":"), F.coalesce(i.cast("string"), F.lit("-")))
    marked = docs.withColumn(key, row_key(F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col)))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id")).withColumn("node", F.md5("text"))

    @F.pandas_udf("fp long, bands array<long>, n int, parity array<long>")
    def sketch(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            sets = [shingles(t, shingle) for t in s]
            yield pd.DataFrame(
                {"fp": np.array([simhash(t) for t in s], dtype=np.uint64).view(np.int64), "bands": list(map(bands, sets)), "n": list(map(len, sets)), "parity": list(map(parities, sets))}
            )

    sketched = texts.withColumn("s", sketch("text")).groupBy("node").agg(F.min("id").alias("id"), F.first("s").alias("s"))
    nodes = checkpointed(sketched.select("node", "id", "s.*"))
    # buckets: the bands of MinHash, then the covering tables of SimHash
    masked = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in covering_masks()))
    dealt = nodes.select("node", F.posexplode(F.concat("bands", masked)).alias("t", "key"))
    shared = dealt.groupBy("t", "key").count().where("count > 1").drop("count")
    members = checkpointed(dealt.join(shared, ["t", "key"]))
    tried = members.groupBy("t", "key").agg(F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(r))) for r in range(REPRESENTATIVES)))).alias("some"))
    star = members.join(tried, ["t", "key"]).select("node", F.explode("some").alias("one")).where("node <> one")
    star = star.select(F.greatest("node", "one").alias("x"), F.least("node", "one").alias("y")).distinct()
    sized = nodes.select("node", "n", "parity")
    star = star.join(sized.alias("l"), F.col("x") == F.col("l.node")).join(sized.alias("r"), F.col("y") == F.col("r.node")).where(may_reach("l", "r", at_least)).select("x", "y")

    @F.pandas_udf("boolean")
    def alike(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            # a hub's text comes again and again: its shingles are made once a batch
            made = {t: shingles(t, shingle) for t in {*left, *right}}
            yield pd.Series([similarity(made[a], made[b]) >= at_least for a, b in zip(left, right)])

    def linked(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        asked = nodes.join(wanted, "node", "left_semi").select(row_key(F.col("node"), F.col("id")).alias("k"))
        named = texts.select("node", "text", row_key(F.col("node"), F.col("id")).alias("k")).join(asked, "k", "left_semi").groupBy("k").agg(F.first("node").alias("node"), F.first("text").alias("text")).drop("k")
        both = pairs.join(named.withColumnsRenamed({"node": "x", "text": "tx"}), "x").join(named.withColumnsRenamed({"node": "y", "text": "ty"}), "y")
        return both.where(alike("tx", "ty")).select(F.col("x").alias("a"), F.col("y").alias("b"))

    roots = components(linked(checkpointed(star)))
    rest = checkpointed(unresolved(members, nodes, roots, at_least))
    if not rest.isEmpty():
        # links between groups: their components join the groups
        of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        ends = linked(rest).join(of("a"), "a", "left").join(of("b"), "b", "left")
        joined = components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("over"))
        named_roots = nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = named_roots.join(joined, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    grouped = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("w")).select(row_key(F.col("w.node"), F.col("w.id")).alias(key))
    kept = marked.join(first, key, "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
