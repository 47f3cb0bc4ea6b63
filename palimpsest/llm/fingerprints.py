"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, prepare

#: Samples of a signature, each drawn over all terms of a text.
SAMPLES = 64
#: Rows that are neighbours in order share a window of about so many.
SPAN = 128
#: Pieces of the range of ids, of as many rows each, within which ids are taken to be spread evenly.
PIECES = 256
EMPTY = "0000"


def _uniforms(h: Column, k: int) -> tuple[Column, Column]:
    """Two uniform numbers in (0, 1), of 32 bits each, for a term's hash."""
    bits = F.xxhash64(h, F.lit(k))
    halves = F.shiftrightunsigned(bits, 32), bits.bitwiseAND(0xFFFFFFFF)
    return tuple(x.cast("double") * 2.0**-32 + 2.0**-33 for x in halves)


def _sample(h: Column, n: Column, k: int) -> Column:
    """a of a term's k-th sample: the term with the least a represents the text.

    With r, c ~ Gamma(2, 1) and b ~ U(0, 1), all drawn from the term's hash: t = floor(ln n / r + b),
    a = c exp(-r (t - b + 1)). a hangs on the term and t alone, so equal least values
    mean equal (term, t), whose chance is the generalised Jaccard similarity.
    r b and r (1 - b) are independent exponential variates -ln u and -ln v, so r = -ln(u v) and
    a = c v exp(-r t); for a count of 1, t is 0.
    """
    (u, v), (x, y) = _uniforms(h, 2 * k), _uniforms(h, 2 * k + 1)
    r = -F.ln(u * v)
    t = F.floor((F.ln(n) - F.ln(u)) / r).cast("double")
    first = -F.ln(x * y) * v
    return F.when(n == 1.0, first).otherwise(first * F.exp(-r * t))


def tokens(text: Column) -> Column:
    """Words of a text: A-Z lower-cased runs without ASCII white space."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def runs(hashes: Column) -> Column:
    """Where the runs of equal values of a sorted array start."""
    return F.filter(F.transform(hashes, lambda x, i: F.when((i == 0) | (F.get(hashes, i - 1) != x), i)), lambda i: i.isNotNull())


def signatures(texts: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """keys and fingerprint, one row per row of texts, which `keys` must tell apart.

    A term is a word, its weight its count. The fingerprint has four hex digits per sample;
    texts without a word have zeros throughout. Terms are counted inside the row, so what is
    aggregated is the samples only; if texts is already dealt out by one of `keys`, nothing is shuffled.
    """
    hashed = texts.select(*keys, F.sort_array(F.transform(tokens(F.col(text_col)), lambda w: F.xxhash64(w))).alias("hs"))
    started = hashed.select(*keys, "hs", runs(F.col("hs")).alias("starts"))
    terms = started.select(
        *keys,
        F.explode_outer(
            F.transform("starts", lambda s, j: F.struct(F.get("hs", s).alias("h"), (F.coalesce(F.get("starts", j + 1), F.size("hs")) - s).alias("n")))
        ).alias("term"),
    ).select(*keys, F.col("term.h").alias("h"), F.col("term.n").cast("double").alias("n"))
    # in the aggregate, whose code is split by function; a projection of all samples is too large a method to be compiled
    sampled = terms.groupBy(*keys).agg(*(F.min(_sample(F.col("h"), F.col("n"), k)).alias(f"a{k}") for k in range(samples)))
    # a sample that happens to read as the empty mark gets another value
    digit = lambda x: F.regexp_replace(F.lower(F.lpad(F.hex(F.xxhash64(x).bitwiseAND(0xFFFF)), 4, "0")), f"^{EMPTY}$", "0001")
    whole = F.array_join(F.transform(F.array(*(f"a{k}" for k in range(samples))), digit), "")
    return sampled.select(*keys, F.when(F.col("a0").isNull(), EMPTY * samples).otherwise(whole).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Estimate of the generalised Jaccard similarity: the share of samples that agree.

    Two texts without words are alike.
    """
    cut = lambda x, k: F.substring(x, 4 * k + F.lit(1), F.lit(4))
    at = F.sequence(F.lit(0), F.lit(samples - 1))
    same = F.size(F.filter(at, lambda k: (cut(a, k) == cut(b, k)) & (cut(a, k) != EMPTY)))
    told = F.size(F.filter(at, lambda k: (cut(a, k) != EMPTY) | (cut(b, k) != EMPTY)))
    return F.when(told == 0, 1.0).otherwise(same.cast("double") / told)


def following(buckets: DataFrame, span: int = 4096) -> DataFrame:
    """(bucket, next_bucket) for distinct longs, in a ring: windows over `span` neighbours, then over their firsts.

    Buckets are numbered without large gaps, so the last window has one short row for some SPAN * span rows of the table.
    """
    w = Window.partitionBy("coarse").orderBy("bucket")
    inner = buckets.withColumn("coarse", F.expr(f"floor(bucket / {span})")).withColumn("inner", F.lead("bucket").over(w))
    ring = Window.partitionBy(F.lit(0)).orderBy("coarse")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outer = inner.groupBy("coarse").agg(F.min("bucket").alias("least"))
    outer = outer.select("coarse", F.coalesce(F.lead("least").over(ring), F.first("least").over(whole)).alias("outer"))
    return inner.join(outer, "coarse").select("bucket", F.coalesce("inner", "outer").alias("next_bucket"))


def bucketed(rows: DataFrame, key: str, tie: str, span: int = SPAN, pieces: int = PIECES) -> DataFrame:
    """rows with `bucket`, a number that rises with the long `key`, then a hash of `tie`, and that about `span` rows share.

    Approximate quantiles cut the keys into pieces of equal numbers of rows, and each piece is cut evenly, so it doesn't matter
    how keys are spread. A key that holds several quantiles is a piece of its own, cut by `tie_hash`, the
    hash of `tie`, as are null keys, which come first.
    """
    at = [i / pieces for i in range(pieces)]
    told = rows.agg(F.count(key).alias("n"), F.count("*").alias("all"), F.max(key).alias("top"), F.percentile_approx(key, at, 10_000).alias("low")).first()
    h = F.shiftrightunsigned(F.xxhash64(tie), 1)
    hashed = rows.withColumn("tie_hash", h)
    share = F.col("tie_hash").cast("double") * 2.0**-63
    free = max(1, -(-(told["all"] - told["n"]) // span))
    nulls = F.floor(share * free) - free
    if not told["n"]:
        return hashed.withColumn("bucket", F.coalesce(nulls, F.lit(0).cast("long")))
    times = Counter(told["low"])
    each = max(1, -(-told["n"] // (span * pieces)))  # buckets of a quantile
    starts, top = [], told["top"] + 1
    for low, n in sorted(times.items()):
        hot = n > 1
        starts.append((low, hot, each * n))
        if hot and low + 1 < top and low + 1 not in times:
            starts.append((low + 1, False, each))
    lows, hots, parts = zip(*starts)
    # in doubles: the range may exceed longs, and rounding keeps the order
    widths = [max(1.0, (high - low) / n) for low, high, n in zip(lows, [*lows[1:], top], parts)]
    offsets = [sum(parts[:i]) for i in range(len(parts))]
    table = {n: F.array(*[F.lit(x).cast(kind) for x in xs]) for n, xs, kind in (("_low", lows, "long"), ("_hot", hots, "boolean"), ("_parts", parts, "long"), ("_width", widths, "double"), ("_offset", offsets, "long"))}
    # the quantiles are approximate: what lies below the first is in its piece
    placed = hashed.withColumn("_piece", F.greatest(F.size(F.filter(table["_low"], lambda b: b <= F.col(key))), F.lit(1)))
    placed = placed.withColumns({n: F.element_at(t, F.col("_piece")) for n, t in table.items()})
    inner = F.floor(F.when(F.col("_hot"), share * F.col("_parts")).otherwise((F.col(key).cast("double") - F.col("_low").cast("double")) / F.col("_width")))
    number = F.col("_offset") + F.least(F.greatest(inner, F.lit(0)), F.col("_parts") - 1)
    # never null, and known not to be: else joins on it filter one side before it's dealt out, and texts are dealt out twice
    bucket = F.coalesce(F.when(F.col(key).isNull(), nulls).otherwise(number), F.lit(0).cast("long"))
    return placed.withColumn("bucket", bucket).drop("_piece", *table)


def with_next(rows: DataFrame, order: list[str], payload: list[str], place: str = "place") -> DataFrame:
    """rows(bucket, ...) with `place` and next_<payload>: the values of the next row by (bucket, order), after the last the first.

    Rows are dealt out by bucket, so a task sorts few rows however many there are.
    The last row of a bucket gets the first one of the next bucket by a join.
    """
    w = Window.partitionBy("bucket").orderBy(*[F.col(c) for c in order])
    # dealt out first, so that neither the windows nor what follows shuffles the rows again
    named = rows.repartition("bucket").withColumns(
        {place: F.row_number().over(w), "last": F.lead(F.lit(1)).over(w).isNull()} | {f"next_{p}": F.lead(p).over(w) for p in payload}
    )
    firsts = named.where(f"{place} = 1").select(F.col("bucket").alias("next_bucket"), *[F.col(p).alias(f"over_{p}") for p in payload])
    over = following(rows.select("bucket").distinct()).join(firsts, "next_bucket").drop("next_bucket")
    joined = named.join(over, "bucket", "left")
    return joined.withColumns({f"next_{p}": F.when(F.col("last"), F.col(f"over_{p}")).otherwise(F.col(f"next_{p}")) for p in payload}).drop("last", *[f"over_{p}" for p in payload])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, with likenesses.

    Edited: the last floor(n/4) code points give way to the first as many (or all) of the next
    document's, ascending by id; after the last comes the first. Null texts are empty; of
    repeated ids, and of null ids, which come before all others, that of the smaller hash comes first; a lone
    document is its own next. Equal texts have equal fingerprints, empty ones zeros. An
    empty table gives an empty result; other columns are not returned.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = F.expr("substring(text, 1, cast(char_length(text) - floor(char_length(text) / 4) as int))")
    edited = F.concat(kept, F.expr("substring(next_text, 1, cast(floor(char_length(text) / 4) as int))"))
    keys = ["bucket", "place", "doc_id", "n_chars", "edited_sha256", "which"]
    pair = (
        with_next(bucketed(own, "doc_id", "text"), ["doc_id", "tie_hash", "text"], ["text"])
        .select("bucket", "place", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .select(*keys[:-1], F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v"))
        .select(*keys[:-1], F.col("v.which").alias("which"), F.col("v.text").alias("text"))
    )
    both = (
        signatures(pair, keys, "text", samples)
        .groupBy(*keys[:-1])
        .agg(F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    )
    chained = with_next(checkpointed(both), ["place"], ["fingerprint"], place="at")
    return chained.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
