"""Operators and queries on DataFrames: nulls, empty tables, ties, repeated rows, clashing columns, brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ann, chat, fingerprints, language, packing, quality, sentencepieces, simhash, urls
from palimpsest.llm import queries as qs
from palimpsest.llm.common import read
from palimpsest.llm.components import components

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "null id here", None, "s", 5), (3, "word " * 30_000, "en", None, 1), (4, "same text twice", "en", "s", 1), (5, "same text twice", "de", "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, DIR, "documents")


# ---- components


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (7, 3)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    want = collections.defaultdict(set)
    for x in list(parent):
        want[find(x)].add(x)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: min(g) for g in want.values() for x in g}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- fingerprints


def words(t):
    return collections.Counter((t or "").encode().lower().split())


def generalised(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_fingerprints_against_brute_force(spark, docs):
    rows = {r.doc_id: r for r in qs.op3_weighted_fingerprints(spark, DIR).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    errors = []
    for i, d in enumerate(ids):
        t, nxt = texts[d], texts[ids[(i + 1) % len(ids)]]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        assert rows[d].n_chars == len(t) and rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [rows[d].near_edited - generalised(words(t), words(edited)), rows[d].near_next - generalised(words(t), words(nxt))]
    # 64 samples: a standard error of 0.06 at most
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08 and np.abs(errors).max() < 0.4
    same = collections.defaultdict(set)
    for d in ids:
        same[texts[d]].add(rows[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_of_few_and_dominating_words(spark):
    """40 pairs of texts in which one shared word outweighs all others: no text's estimate may lean to one side."""
    rows = []
    for i in range(40):
        rows += [(2 * i, f"heavy{i} " * 60 + " ".join(f"a{i}x{j}" for j in range(8))), (2 * i + 1, f"heavy{i} " * 60 + " ".join(f"b{i}x{j}" for j in range(8)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprints(df).collect()}
    errors = [got[d] - generalised(words(dict(rows)[d]), words(dict(rows)[d + 1])) for d in range(0, 80, 2)]
    assert abs(np.mean(errors)) < 0.05 and np.abs(errors).max() < 0.25


def test_fingerprints_of_odd_rows(spark, odd, none):
    out = fingerprints.fingerprints(odd).collect()
    assert len(out) == len(ODD) and sum(r.doc_id is None for r in out) == 1
    assert all(set(r.fingerprint) == {"0"} for r in out if r.n_chars == 0)
    assert fingerprints.fingerprints(none).count() == 0
    lone = fingerprints.fingerprints(odd.where("doc_id = 4")).first()
    assert lone.near_next == 1.0


@pytest.mark.parametrize("ids", [[0, 1, 127, 128, 5000, 10**12, -5], [7], [-(1 << 63), (1 << 63) - 1, 0], [*range(3000), *random.Random(1).sample(range(1 << 62), 3000)], []])
def test_the_chain_of_documents_crosses_buckets(spark, ids):
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    dealt = fingerprints.bucketed(df, "doc_id", "text")
    got = fingerprints.with_next(dealt, ["doc_id", "tie_hash", "text"], ["text"]).collect()
    order = sorted(ids)
    assert {r.doc_id: r.next_text for r in got} == {d: str(order[(i + 1) % len(order)]) for i, d in enumerate(order)}
    sizes = collections.Counter(r.bucket for r in got)
    assert max(sizes.values(), default=0) <= 4 * fingerprints.SPAN  # sparse, dense and mixed ids alike


@pytest.mark.parametrize("hot", [None, 0, 5, 9])
def test_null_and_repeated_ids_are_dealt_to_many_buckets(spark, hot):
    df = spark.createDataFrame([(hot, f"t{i}") for i in range(2000)] + [(i, f"x{i}") for i in range(10)], "doc_id long, text string")
    got = fingerprints.with_next(fingerprints.bucketed(df, "doc_id", "text"), ["doc_id", "tie_hash", "text"], ["text"]).collect()
    assert max(collections.Counter(r.bucket for r in got).values()) < 512
    nexts, ids = {r.text: r.next_text for r in got}, {r.text: -1 if r.doc_id is None else r.doc_id for r in got}
    seen, at = [], "x9" if hot != 9 else max((r for r in got if r.doc_id == 9), key=lambda r: (r.tie_hash, r.text)).text
    for _ in got:
        at = nexts[at]
        seen.append(at)
    assert sorted(seen) == sorted(nexts) and [ids[t] for t in seen] == sorted(ids.values())  # one ring, by id


# ---- SimHash


def test_simhash_groups_against_brute_force(spark, docs):
    got = qs.op8_simhash_groups(spark, DIR).collect()
    prints = {r.doc_id: simhash.simhash(r.text) for r in docs.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_groups(prints)


def test_simhash_groups_of_odd_rows(spark, odd, none):
    """Null ids and texts, repeated rows, a long text, columns that clash with the results', no rows."""
    rows = odd.collect()
    got = simhash.near_duplicates(odd.withColumnsRenamed({"lang": "fp", "source": "component_id"})).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 1
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert all(len(v) == 1 for v in by.values())
    prints = {r.doc_id: simhash.simhash(r.text) for r in rows if r.doc_id is not None}
    assert {d: int(next(iter(by[d]))[0], 16) for d in prints} == prints
    assert {d: next(iter(by[d]))[1] for d in prints} == brute_groups(prints)
    assert by[1] == by[2] == {("0" * 16, 1)} and by[4] == by[5]
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(odd.where("doc_id is null")).first().component_id is None


def test_clashing_columns_do_not_matter(spark, odd):
    """Every operator reads its own columns only, whatever else a table has under the names that it uses inside."""
    clash = odd.select("*", *[F.lit("z").alias(n) for n in ("bucket", "place", "fingerprint", "which", "_piece", "tie_hash", "node", "root", "sequence_id", "start", "offset")])
    path = qs.tokenizer_path("byte_bpe_50k.json")
    for f in (fingerprints.fingerprints, lambda d: packing.pack(d, path), simhash.near_duplicates):
        plain, other = (sorted(map(repr, f(d).drop("sequence_id").collect())) for d in (odd, clash))
        assert plain == other


def brute_groups(prints):
    ids = sorted(prints)
    least = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_links_within_the_radius_are_all_found(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base[:6]:
        x = b
        for _ in range(14):  # large buckets and chains
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(x)
            values.add(b ^ 1 << rng.randrange(64))
    values |= {b ^ 1 << i for b in base[:1] for i in range(64)} | {0, (1 << 64) - 1, 1 << 63}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"))
    assert edges.where("bit_count(a ^ b) > 2").count() == 0
    found = {r.node: r.root for r in components(edges).collect()}
    prints = {signed(v): v for v in values}
    want = brute_groups(prints)
    group = lambda m: sorted(map(sorted, _classes({k: m.get(k, k) for k in prints})))
    assert group(found) == group(want)


def _classes(m):
    out = collections.defaultdict(list)
    for k, v in m.items():
        out[v].append(k)
    return out.values()


def test_near_copies_leave_one_each(spark):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b = text(300), text(300)
    near = a.split()
    for i in (20, 150, 280):
        near[i] = "changed"
    far = a.split()
    for i in range(0, 300, 9):
        far[i] = "changed"
    rows = [(9, a, 1), (3, " ".join(near), 2), (4, a, 3), (4, a, 3), (5, " ".join(far), 4), (6, b, 5), (None, b, 6), (7, None, 7), (8, "", 8), (10, "short text", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node long")
    out = simhash.one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 5, 6, 7, 10]
    assert simhash.one_of_each_group(df.limit(0)).count() == 0


def test_near_copies_in_a_large_templated_group(spark):
    """150 texts round one template: two of a pair are near copies, any others are not, yet all share buckets."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    common = [word() for _ in range(400)]
    rows = []
    for pair in range(75):
        own = [word() for _ in range(12)]
        for which in range(2):
            rows.append((2 * pair + which, " ".join(common + own + [word() for _ in range(48)])))
    sets = [simhash.shingles(t) for _, t in rows]
    near, far = [], []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            (near if i // 2 == j // 2 else far).append(simhash.similarity(a, b))
    at_least = 0.8
    assert min(near) >= at_least > max(far) > 0.7
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.one_of_each_group(df, at_least=at_least).collect())
    assert kept == list(range(0, 150, 2))


def test_no_similar_pair_is_ruled_out(spark):
    rng = np.random.default_rng(4)
    rows, sets = [], []
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    for i in range(60):
        sets.append(np.unique(np.concatenate([base[: 300 - 3 * (i % 20)], rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)])))
        rows.append((i, len(sets[-1]), simhash.parities(sets[-1])))
    df = spark.createDataFrame(rows, "node long, n int, parity array<long>")
    got = {(r.x, r.y) for r in df.alias("l").crossJoin(df.alias("r")).where(simhash.may_reach("l", "r", 0.8)).selectExpr("l.node x", "r.node y").collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if simhash.similarity(a, b) >= 0.8}
    assert want <= got and len(want) < 3600


# ---- packing, chat, pieces, language, URLs, quality, HTML, vectors: odd rows and contracts


def test_packing_of_the_whole_table(spark, docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(qs.tokenizer_path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in qs.op9_cost_balanced_packing(spark, DIR).collect():
        got[r.doc_id].append(r)
    for d in docs.collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(got[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    path = qs.tokenizer_path("byte_bpe_50k.json")
    assert sum(r.length for r in packing.pack(odd, path).collect() if r.doc_id == 2) == 2
    assert packing.pack(none, path).count() == 0


def test_conversations_are_read_back(spark):
    want = collections.defaultdict(list)
    for r in sorted(read(spark, DIR, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id].append((r.role, r.text or ""))
    want[-7] = [("user", qs.ADDED[1]), ("assistant", qs.ADDED[1])]
    got = {r.conv_id: r for r in qs.op5_chat_formatting(spark, DIR).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(learned) and got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_chat_of_odd_rows(spark):
    kind = "conv_id long, turn long, role string, text string, formatted string, parts string"
    rows = [(1, 0, None, None, "x", None), (1, 0, None, None, "x", None), (None, None, "assistant", "a<|b", None, None), (2, 0, "user", "no", None, '[{"type":"image","ref":"r"}, " y"]')]
    out = chat.format_turns(spark.createDataFrame(rows, kind), parts_col="parts")
    assert {r.text: r.expanded_tokens for r in out.collect()}["no"] == 2
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert back[1].n_turns == 2 and back[None].loss_chars == 4 and back[2].turns_sha256 == hashlib.sha256(b"user\n<|image:0|> y\n").hexdigest()
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], kind))).count() == 0


def test_pieces_round_trip(spark, odd, none):
    path = qs.tokenizer_path("piece_bpe_32k.model")
    out = sentencepieces.encode(odd.withColumnRenamed("lang", "pieces"), path, "doc_id")
    back = sentencepieces.decode(out, path, text_col="again").collect()
    assert all(r.again == (r.text or "") for r in back) and len(back) == len(ODD)
    assert sentencepieces.encode(none, path, "doc_id", digest=True).count() == 0
    assert all(r.lossless for r in qs.op4_sentencepiece_sampling(spark, DIR).collect())


def test_languages_on_held_out_documents(spark, docs, odd, none):
    rows = {r.doc_id: r for r in qs.op6_language_id(spark, DIR).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in rows if rows[d].held_out]
    assert held and all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in rows)
    assert np.mean([rows[d].lang_pred == lang[d] for d in held]) > 0.95
    model = language.learn(none)
    out = language.identify(odd.withColumnRenamed("lang", "lang_pred"), model)
    assert out.count() == len(ODD) and {r.lang_pred for r in out.collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_languages_never_learned_are_rejected(spark):
    """Each of the four languages is left out in turn; of the known ones next to nothing is rejected."""
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("length(text) >= 200")
    for left in ("en", "de"):
        rows = language.identify(docs, language.learn(docs.where(F.col("lang") != left))).select("lang", "lang_rejected").collect()
        assert np.mean([r.lang_rejected for r in rows if r.lang == left]) > 0.9
        assert np.mean([r.lang_rejected for r in rows if r.lang != left]) < 0.01


def test_languages_learn_from_long_texts_alike_in_spark_and_plain(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [("xx", text("abcdef", 60)) for _ in range(30)] + [("yy", text("uvwxyz", 12_000)) for _ in range(10)] + [("xx", None), (None, "abc"), ("zz", "123")]
    df = spark.createDataFrame(rows + rows[:5], "lang string, text string")
    model = language.learn(df)
    assert model.names == ["xx", "yy", "zz"]
    sample = sorted(((r.lang, r.n, r.text) for r in language.training_sample(df).collect()))
    assert len(sample) == 41  # copies count once
    plain = language.Languages.train([(lang, t) for lang, _, t in sample])
    probe = [text("abcdef", 20), text("uvwxyz", 20), "q"]
    assert np.allclose(model.entropies(probe)[0], plain.entropies(probe)[0], atol=1e-4) and [p[0] for p in model.predict(probe[:2])] == ["xx", "yy"]
    few = language.learn(df, texts=4, langs=2)
    assert few.names == ["xx", "yy"] and language.training_sample(df, texts=4, langs=2).count() == 8


def test_urls_are_judged(spark):
    rows = qs.op7_url_filters(spark, DIR).collect()
    by = urls.compile_rules(qs.RULES)
    url = {r.page_id: r.url for r in read(spark, DIR, "pages").collect()}
    for r in rows:
        host, path = urls.split_url(url[r.page_id])
        rule = urls.match(by, host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text) and r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")
    odd = spark.createDataFrame([(1, None, 2), (1, None, 2), (2, "", 2), (None, "http://A.org/", 2)], "page_id long, url string, host long")
    got = urls.judge(odd, qs.RULES, urls.rule_labels(odd, qs.RULES)).collect()
    assert len(got) == 4 and {r.rule for r in got} == {None, "org/"}
    assert urls.judge(odd.limit(0), qs.RULES, urls.rule_labels(odd, qs.RULES)).count() == 0


def test_long_urls_train_and_are_judged(spark):
    rows = [(i, f"http://a{i}.net/" + ("x" * 6000 if i % 2 else "y")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([(u, i % 2 == 1) for i, u in rows] + [(None, True), ("http://q.net/", None)], "url string, blocked boolean")
    got = {r.page_id: r.verdict for r in urls.judge(df, [], labelled).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i, _ in rows}


def test_rule_labels_agree_with_the_rules(spark):
    cases = ["http://a.org/x", "https://m.example.org/es/1", "http://Example.ORG/en/12?x", "q://b.com/fr/", "q://b.com/de", "q://b.com/de/é", "none", "http://c.net/", "http://d.org"]
    got = {r.url: r.blocked for r in urls.rule_labels(spark.createDataFrame([(c,) for c in cases], "url string"), qs.RULES).collect()}
    by = urls.compile_rules(qs.RULES)
    assert got == {c: m.verdict == "block" for c in cases if (m := urls.match(by, *urls.split_url(c)))}


def test_quality_of_held_out_documents(spark):
    """Trained on the labels of two thirds of the ids, held against those of the rest."""
    docs, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.train(docs, labels.where(~held))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    told = {r.doc_id: r.quality for r in labels.where(held).collect()}
    assert len(told) > 80 and np.mean([(got[d].quality_score >= 0.5) == bool(q) for d, q in told.items()]) > 0.97
    assert np.mean([got[d].quality_keep for d, q in told.items() if q]) > 0.98
    assert sum(model.received) > 0 and len(got) == docs.count()
    # what is handed over doesn't hang on how rows are dealt out
    again = quality.train(docs.repartition(7), labels.where(~held))
    assert again.received == model.received and np.allclose(again.joint.w, model.joint.w)


def test_quality_of_odd_rows(spark, odd, none, docs):
    rows = {r.doc_id: r for r in qs.op10_quality_cotraining(spark, DIR).collect()}
    assert len(rows) == docs.count() and all(0 <= r.quality_score <= 1 for r in rows.values())
    with pytest.warns(UserWarning, match="too few"):
        model = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    out = quality.score(odd.withColumn("quality_score", odd.doc_id), model).collect()
    assert len(out) == len(ODD) and all(r.quality_keep and r.quality_score is None for r in out)
    assert quality.score(none, model).count() == 0
    # repeated and contradicting labels, repeated documents, a table without metadata columns
    rng = random.Random(4)
    texts = [(i, ("BUY!! NOW!! " if i % 2 else "the calm sea and the hills ") * rng.randint(3, 9)) for i in range(80)]
    few = spark.createDataFrame(texts + texts[:9] + [(None, "x"), (200, None)], "doc_id long, text string")
    told = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)] * 2 + [(0, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(few, told)
    good = {r.doc_id: r.quality_score for r in quality.score(few, model).collect()}
    assert np.mean([(good[i] >= 0.5) == (i % 2 == 0) for i in range(1, 80)]) > 0.97 and good[200] is not None


def brute_nearest(rows, k, every):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in usable if i % every == 0):
        d = sorted((math.sqrt(((usable[q] - v) ** 2).sum()), i) for i, v in usable.items() if i != q)
        out[q] = d[:k]
    return out


def test_nearest_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, DIR, "embeddings").collect()]
    want = brute_nearest(rows, 10, 100)
    got = collections.defaultdict(list)
    for r in sorted(qs.op2_nearest_neighbours(spark, DIR).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.score, r.vec_id))
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in got)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    assert all(a <= b for g in got.values() for (a, _), (b, _) in zip(g, g[1:]))


def test_nearest_over_many_cells_and_blocks(spark):
    """Cells are probed, split and merged into blocks, queries cut into parts; recall as against all vectors."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 3
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    x[4000:4500] = x[0]  # a large group of copies
    df = spark.createDataFrame([(i, v.tolist(), "clash", 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, v string, cell int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, 10, 50, cell=200, block=150, query_block=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = x.astype(np.float32).astype(float)
    hits = []
    for q in range(0, 6000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(6000), d))[:10]
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-9 for i, s in got[q])
        hits.append(len({i for i, _ in got[q]} & set(true.tolist())) / 10)
    assert len(got) == 120 and np.mean(hits) >= 0.93


def test_nearest_of_copies_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 300)] + [(400, [0.0, 1.0]), (401, [0.0, 2.0]), (402, [0.0, 0.0]), (403, [nan, 1.0]), (404, [inf, 1.0]), (405, None), (406, [None, 1.0]), (None, [1.0, 1.0]), (500, [3.0, 3.0]), (500, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(df, 5).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.score, r.vec_id))
    want = brute_nearest(dict(rows[:-1]).items(), 5, 100)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.where("vec_id in (400, 401)"), 5).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(400, 401, 1.0)]
