"""Score formulas as column expressions; `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a fraction, to the microsecond."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(later) - micros(earlier)) / (DAY * 1e6)


# What a memory's type is worth.
TYPE_WEIGHT = {"architecture": 0.9, "preference": 0.85, "pattern": 0.8, "bug": 0.7, "workflow": 0.6, "fact": 0.5}


def salience(kind: Column, accesses: Column, confidence: Column | None = None) -> Column:
    """Weight of the type, or of a semantic fact its confidence of 0.5 at least, and up to 0.2 for accesses."""
    if confidence is not None:
        base = F.greatest(F.lit(0.5), confidence)
    else:
        base = F.lit(0.5)
        for k, w in reversed(TYPE_WEIGHT.items()):
            base = F.when(kind == k, w).otherwise(base)
    return F.least(F.lit(1.0), base + F.least(F.lit(0.2), 0.02 * accesses))


def boost(days: Column) -> Column:
    """What one access gives, to be summed: 1/days if it was a positive number of days ago."""
    return F.when(days > 0, 1.0 / days).otherwise(0.0)


def retention(salient: Column, age_days: Column, boosts: Column, decay: float = 0.01, share: float = 0.3) -> Column:
    """min(1, salience e^(-decay age) + share * boosts), boosts being the sum of boost() over all accesses."""
    return F.least(F.lit(1.0), salient * F.exp(-decay * age_days) + share * boosts)


def tier(score: Column) -> Column:
    return F.when(score >= 0.7, "hot").when(score >= 0.4, "warm").when(score >= 0.15, "cold").otherwise("evictable")


def strength_decay(strength: Column, days: Column, period: float = 30.0) -> Column:
    """A tenth is lost for every whole period beyond the first moment past it, down to 0.1."""
    return F.when(days > period, F.greatest(F.lit(0.1), strength * F.pow(F.lit(0.9), F.floor(days / period)))).otherwise(strength)


def confidence_decay(confidence: Column, rate: Column, days: Column) -> Column:
    """After a week `rate` a week is lost, down to 0.05; rounded to three places."""
    return F.when(days >= 7, F.round(F.greatest(F.lit(0.05), confidence - rate * (days / 7.0)), 3)).otherwise(confidence)


def reinforced(confidence: Column, times: Column) -> Column:
    """c + 0.1 (1 - c), `times` over, in closed form."""
    return F.least(F.lit(1.0), 1.0 - (1.0 - confidence) * F.pow(F.lit(0.9), times))


def relevance(query: str, text: Column, confidence: Column, days: Column, longer_than: int = 1) -> Column:
    """confidence * share of the query's terms that the text contains anywhere / (1 + 0.01 days)."""
    terms = [t for t in query.lower().split() if len(t) > longer_than]
    if not terms:
        return F.lit(0.0)
    hits = sum(F.lower(text).contains(t).cast("int") for t in terms)
    return F.round(confidence * (hits / float(len(terms))) / (1 + 0.01 * days), 3)


def frontier_score(priority: Column, age_hours: Column, unlocks: Column, spawned: Column, active: Column) -> Column:
    flag = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    return F.round(10 * priority + F.least(0.5 * age_hours, F.lit(20.0)) + 5 * unlocks + flag(spawned, 3) + flag(active, 15), 2)


def core_score(importance: Column, days: Column, accesses: Column) -> Column:
    return 0.5 * importance / 10 + 0.3 / (1 + 0.1 * days) + 0.2 * F.log2(accesses + 1.0) / 10


def compression_quality(facts: Column, narrative: Column, title: Column, concepts: Column, importance: Column) -> Column:
    """0 to 100 for a compressed observation."""
    points = [
        (F.size(facts) > 0, 25), (F.size(facts) >= 3, 10), (F.length(narrative) >= 20, 20), (F.length(narrative) >= 50, 5),
        (F.length(title).between(5, 120), 15), (F.size(concepts) > 0, 15), (importance.between(1, 10), 10),
    ]
    return F.least(F.lit(100), sum(F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in points))


def summary_quality(title: Column, narrative: Column, decisions: Column, files: Column, concepts: Column) -> Column:
    points = [(F.length(title) >= 5, 20), (F.length(narrative) >= 20, 25), (F.length(narrative) >= 100, 5), (F.size(decisions) > 0, 20), (F.size(files) > 0, 15), (F.size(concepts) > 0, 15)]
    return F.least(F.lit(100), sum(F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in points))


def health(lag_ms: Column, cpu: Column, memory: Column, rss: Column, floor: int = 512 * 1024 * 1024) -> Column:
    """critical, degraded or healthy; memory counts only from a resident size on."""
    big = rss >= floor
    return (
        F.when((lag_ms > 500) | (cpu > 90) | ((memory > 95) & big), "critical")
        .when((lag_ms > 100) | (cpu > 80) | ((memory > 80) & big), "degraded")
        .otherwise("healthy")
    )


def relation_confidence(shared: Column, days_a: Column, days_b: Column, kind: Column) -> Column:
    """0.5, more for shared sessions and recent ends, less for old ends and contradiction; within 0 and 1."""
    recency = F.when((days_a < 7) & (days_b < 7), 0.1).when((days_a > 90) & (days_b > 90), -0.1).otherwise(0.0)
    by_kind = F.when(kind == "supersedes", 0.1).when(kind == "contradicts", -0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.least(0.1 * shared, F.lit(0.3)) + recency + by_kind))


def replay_duration(text: Column) -> Column:
    """Milliseconds to read a text at 40 characters a second, from 300 to 20000."""
    return F.least(F.lit(20000), F.greatest(F.lit(300), F.floor(F.length(text) / 40 * 1000 + 0.5).cast("int")))


def _points(*rules: tuple[Column, int]) -> Column:
    """The points of all rules that hold, 100 at most; a null holds nothing."""
    total = F.lit(0)
    for holds, points in rules:
        total = total + F.when(holds, points).otherwise(0)
    return F.least(F.lit(100), total)


def summary_quality(title: Column, narrative: Column, decisions: Column, files: Column, concepts: Column) -> Column:
    """What a session's summary holds, of 100."""
    return _points((F.length(title) >= 5, 20), (F.length(narrative) >= 20, 25), (F.length(narrative) >= 100, 5), (F.size(decisions) > 0, 20), (F.size(files) > 0, 15), (F.size(concepts) > 0, 15))


def context_quality(context: Column, project: Column) -> Column:
    """What a context holds, of 100: length, the project's name, sections in tags."""
    sections = F.size(F.regexp_extract_all(context, F.lit("<[A-Za-z0-9_]+>"), F.lit(0)))
    named = (project != "") & F.lower(context).contains(F.lower(project))
    return _points((F.length(context) > 0, 20), (named, 20), (context.contains("<"), 15), (sections >= 2, 15), (sections >= 4, 10), (F.length(context) >= 100, 10), (F.length(context) >= 500, 10))
