"""Text functions: tokens, stems, synonyms, redaction, entities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a token may not hold. The class keeps letters, digits, white space, `/`, `.` and U+005C to U+005F; a hyphen divides.
NOT_TOKEN = r"[^\p{L}\p{N}\s/.\\-_]"
NOT_TOKEN_RE2 = r"[^\pL\pN\s/.\\\]^_]"


#: Scripts that are written without spaces between words.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
HANGUL_BLOCK = r"[\uAC00-\uD7AF]+"


def segment_cjk(token: Column) -> Column:
    """A token cut where Han, kana or Hangul begin or end; of Hangul runs their syllable blocks, other runs whole.

    Runs stay whole because no dictionary is at hand; cut_runs() takes one.
    """
    runs = F.regexp_extract_all(token, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"\p{IsHangul}"), F.regexp_extract_all(r, F.lit(HANGUL_BLOCK), F.lit(0))).otherwise(F.array(r))))


def cut_runs(tokens: Column, cut: Callable[[str], list[str]]) -> Column:
    """Tokens with those that hold Han or kana cut by a segmenter, such as one with a dictionary."""

    @F.pandas_udf("array<string>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        some = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
        for s in parts:
            yield s.map(lambda ts: None if ts is None else [p for t in ts for p in ([x.strip() for x in cut(t) if x.strip()] if some.search(t) else [t])])

    return of(tokens)


def tokenize(text: Column) -> Column:
    """Lower-cased tokens of two characters or more; those in scripts without spaces are cut up, into single characters if need be."""
    clean = F.regexp_replace(F.lower(text), NOT_TOKEN, " ")
    tokens = F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) >= 2)
    cut = F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(f"[{CJK}]"), segment_cjk(t)).otherwise(F.array(t))))
    # asked of the text as it is, so that most texts are cleaned once, and ASCII ones aren't searched at all
    return F.when((F.octet_length(text) != F.length(text)) & text.rlike(f"[{CJK}]"), cut).otherwise(tokens)


def document_text(*fields: Column) -> Column:
    """The text that is indexed: all fields, arrays spread out, joined by spaces."""
    return F.concat_ws(" ", *fields)


# ---- stems

_VOWEL, _VOWEL_Y = "aeiou", "aeiouy"


def _measure(s: str) -> int:
    """How often a vowel run (y counts) is followed by a consonant run."""
    return len(re.findall(f"[{_VOWEL_Y}]+(?=[^{_VOWEL_Y}])", s))


def _has_vowel(s: str) -> bool:
    return any(c in _VOWEL for c in s)


def _doubled(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and s[-1] not in _VOWEL


def _short_end(s: str) -> bool:
    return bool(re.search(f"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxy]$", s))


# Suffixes and what takes their place, tried in this order.
_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", iser="ise", abli="able", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", isation="ise", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP3 = dict(icate="ic", ative="", alize="al", alise="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = ("ement", "ment", "tion", "sion", "ance", "ence", "able", "ible", "ism", "ate", "iti", "ous", "ive", "ize", "ise", "ant", "ent", "al", "er", "ic", "ou")
_PAST = re.compile(f"^(.*[{_VOWEL}].*)(?:ed|ing)$")


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    found = _PAST.match(w)
    if not found:
        return w
    base = found[1]
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _doubled(base) and base[-1] not in "lsz":
        return base[:-1]
    return base + "e" if _measure(base) == 1 and _short_end(base) else base


def _mapped(w: str, suffixes: dict[str, str]) -> str:
    """Only the first suffix that fits is tried."""
    hit = next((s for s in suffixes if w.endswith(s)), None)
    if hit is None or not _measure(w[: -len(hit)]):
        return w
    return w[: -len(hit)] + suffixes[hit]


def _bare(w: str) -> str:
    # the longest suffix is the leftmost match
    hit = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if hit and _measure(w[: -len(hit)]) > 1:
        w = w[: -len(hit)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("l") and _doubled(w) and _measure(w[:-1]) > 1 else w


def stem(word: str) -> str:
    """A Porter stem whose measure takes y for a vowel; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    return _bare(_mapped(_mapped(w, _STEP2), _STEP3))


#: So many stems a Python worker remembers from one batch to the next.
STEMS_KEPT = 200_000


def stemmed_text(tokens: Column) -> Column:
    """The stems of an array of tokens, joined by spaces; null for no tokens. A batch's distinct terms are stemmed once each."""

    @F.arrow_udf(T.StringType())
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for listed in parts:
            sizes = pc.fill_null(pc.list_value_length(listed), 0).cast(pa.int32())
            terms = listed.flatten().cast(pa.string()).dictionary_encode()
            if len(known) > STEMS_KEPT:
                known.clear()
            stems = [known[t] if t in known else known.setdefault(t, stem(t)) for t in terms.dictionary.to_pylist()]
            ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes)])
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(stems, pa.string()).take(terms.indices)), " ")
            yield pc.if_else(pc.equal(sizes, 0), pa.scalar(None, pa.string()), joined)

    return of(tokens)


# Groups of synonyms, in order.
SYNONYMS = [
    "auth authentication authn authenticating",
    "authz authorization authorizing",
    "db database datastore",
    "perf performance latency throughput slow bottleneck",
    "optim optimization optimizing optimise query-optimization",
    "k8s kubernetes kube",
    "config configuration configuring setup",
    "deps dependencies dependency",
    "env environment",
    "fn function",
    "impl implementation implementing",
    "msg message messaging",
    "repo repository",
    "req request",
    "res response",
    "ts typescript",
    "js javascript",
    "pg postgres postgresql",
    "err error errors",
    "api endpoint endpoints",
    "ci continuous-integration",
    "cd continuous-deployment",
    "test testing tests",
    "doc documentation docs",
    "infra infrastructure",
    "deploy deployment deploying",
    "cache caching cached",
    "log logging logs",
    "monitor monitoring",
    "observe observability",
    "sec security secure",
    "validate validation validating",
    "migrate migration migrations",
    "debug debugging",
    "container containerization docker",
    "crash crashloop crashloopbackoff",
    "webhook webhooks callback",
    "middleware mw",
    "paginate pagination",
    "serialize serialization",
    "encrypt encryption",
    "hash hashing",
]


def synonym_rows() -> list[tuple[str, str, int]]:
    """(term, synonym, position), stemmed, each synonym once per term in order."""
    out: dict[str, dict[str, None]] = {}
    for group in SYNONYMS:
        stems = [stem(w) for w in group.split()]
        for s in stems:
            out.setdefault(s, {}).update({o: None for o in stems if o != s})
    return [(term, s, i) for term, others in out.items() for i, s in enumerate(others)]


# ---- likeness

def jaccard_tokens(text: Column) -> Column:
    """Distinct white-space tokens of more than two characters."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: F.length(t) > 2))


def long_terms(text: Column) -> Column:
    """Distinct lower-cased white-space tokens of more than three characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) > 3))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


# ---- a model's answers


def xml_rows(rows: DataFrame, column: str, tag: str, attributes: list[str]) -> DataFrame:
    """A row for each empty element of a name in a text, with some of its attributes; one that isn't there is empty."""
    found = rows.withColumn("_x", F.explode(F.regexp_extract_all(column, F.lit(f"<{tag} [^>]*/>"), F.lit(0))))
    return found.select(*[c for c in rows.columns if c != column], *(F.regexp_extract("_x", f'{a}="([^"]*)"', 1).alias(a) for a in attributes))


def xml_texts(rows: DataFrame, column: str, tag: str) -> DataFrame:
    """A row for each element of a name in a text, with its trimmed content as text."""
    found = rows.withColumn("_x", F.explode(F.regexp_extract_all(column, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))))
    return found.select(*[c for c in rows.columns if c != column], F.trim("_x").alias("text"))


# ---- private data

# What is taken for a secret, in the order of replacement; the first two regardless of case.
SECRETS = [
    r"""(?i)(?:api[_-]?key|secret|token|password|credential|auth)[\s]*[=:]\s*["']?[A-Za-z0-9_\-/.+]{20,}["']?""",
    r"(?i)Bearer\s+[A-Za-z0-9._\-+/=]{20,}",
    r"sk-proj-[A-Za-z0-9\-_]{20,}",
    r"(?:sk|pk|rk|ak)-[A-Za-z0-9][A-Za-z0-9\-_]{19,}",
    r"sk-ant-[A-Za-z0-9\-_]{20,}",
    r"gh[pus]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"xoxb-[A-Za-z0-9\-]+",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[A-Za-z0-9\-_]{35}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"npm_[A-Za-z0-9]{36}",
    r"glpat-[A-Za-z0-9\-_]{20,}",
    r"dop_v1_[A-Za-z0-9]{64}",
]
PRIVATE = r"(?is)<private>.*?</private>"


def redact(text: Column) -> Column:
    """Private passages, then secrets, give way to marks."""
    out = F.regexp_replace(text, PRIVATE, "[REDACTED]")
    for s in SECRETS:
        out = F.regexp_replace(out, s, "[REDACTED_SECRET]")
    return out


# ---- entities

# Capitalised words that are no entities.
NO_ENTITIES = (
    "The This That What When Where How Why Who Which Did Does Do Is Are Was Were Has Have Had Can Could Would Should Will May Might If And But Or Not For From With About After Before Between"
).split()
QUOTED, CAPITALISED = r'"([^"]+)"', r"\b([A-Z][a-zA-Z0-9_.-]+)\b"
#: A word's edge by ASCII letters alone, which Java's own mark is not.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def entities(text: Column) -> Column:
    """Quoted spans, then capitalised words that are none of NO_ENTITIES; each once."""
    no = F.array(*map(F.lit, NO_ENTITIES))
    words = F.filter(F.regexp_extract_all(text, F.lit(CAPITALISED.replace(r"\b", _EDGE)), F.lit(1)), lambda w: ~F.array_contains(no, w))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), words))


# ---- observations

# Words of a tool's name and the type they stand for, tried in this order.
TOOL_WORDS = [
    ("web_fetch", "fetch http web"),
    ("search", "grep search glob find"),
    ("command_run", "bash shell exec run"),
    ("file_edit", "edit update patch replace"),
    ("file_write", "write create"),
    ("file_read", "read view"),
    ("subagent", "task agent"),
]
HOOK_TYPES = {"post_tool_failure": "error", "prompt_submit": "conversation", "subagent_stop": "subagent", "task_completed": "subagent", "notification": "notification"}


def infer_type(tool: Column, hook: Column) -> Column:
    """The type of an observation, from its hook or else from the words of its tool's name."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(tool, "([a-z])([A-Z])", "$1_$2"), r"[-\s]+", "_"))
    out = F.when(hook == "post_tool_failure", HOOK_TYPES["post_tool_failure"])
    for h, t in list(HOOK_TYPES.items())[1:]:
        out = out.when(hook == h, t)
    out = out.when(tool.isNull() | (tool == ""), "other")
    for t, ws in TOOL_WORDS:
        w = ws.replace(" ", "|")
        # a word at either end needs no underscore, one in the middle does
        out = out.when(snake.rlike(f"^({w})|({w})$|_({w})_"), t)
    return out.otherwise("other")


def truncated(text: Column, n: int) -> Column:
    """At most n characters; a longer text ends in an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def fingerprint_id(prefix: str, content: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(content, 256), 1, 16))


def token_estimate(text: Column, per: int = 3) -> Column:
    return F.ceil(F.length(text) / per)
