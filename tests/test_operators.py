"""Edge cases of the operators."""

import random
import re

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import graph as g
from palimpsest.operators import lifecycle as lc
from palimpsest.operators import paths, slots
from palimpsest.operators import search as s
from palimpsest.operators import sequences as q
from palimpsest.operators import similarity as sim
from palimpsest.operators import work as wk
from palimpsest.session import ship
from palimpsest.sources import tables as src


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_bm25_of_empty_and_single_corpora(spark):
    schema = "doc long, text string"
    asked = s.weighted_terms(s.terms_of(spark.createDataFrame([(1, "auth flow")], schema), "doc", F.col("text")))
    empty = s.postings(s.terms_of(spark.createDataFrame([], schema), "doc", F.col("text")))
    assert s.bm25(empty, asked).count() == 0
    one = s.postings(s.terms_of(spark.createDataFrame([(7, "authentication here")], schema), "doc", F.col("text")))
    assert [r.id for r in s.bm25(one, asked).collect()] == [7]  # by prefix only
    assert s.bm25(one, asked, prefixes=False).count() == 0


def test_exact_beats_prefix(spark):
    docs = spark.createDataFrame([(1, "author writes"), (2, "auth writes")], "doc long, text string")
    index = s.postings(s.terms_of(docs, "doc", F.col("text")))
    asked = s.weighted_terms(s.terms_of(spark.createDataFrame([(1, "auth")], "doc long, text string"), "doc", F.col("text")))
    assert [r.id for r in s.bm25(index, asked).orderBy("rank").collect()] == [2, 1]


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(s.cosine(v(0.0, 0.0), v(1.0, 0.0)).alias("zero"), s.cosine(v(1.0), v(1.0, 0.0)).alias("dims"), s.cosine(v(2.0, 0.0), v(1.0, 0.0)).alias("same")).first()
    assert tuple(row) == (0.0, 0.0, 1.0)


def test_fusion_keeps_the_keyword_weight_when_that_stream_is_empty(spark):
    kind = "query_id long, id long, rank long, score double"
    out = s.rrf({"bm25": spark.createDataFrame([], kind), "vector": spark.createDataFrame([(1, 5, 1, 0.9)], kind)})
    assert abs(out.first().score - 0.6 / 61) < 1e-9


def test_diversification_backfills(spark):
    rows = [(1, i, 1.0 - i / 100, "a" if i < 5 else "b") for i in range(6)]
    ranked = spark.createDataFrame(rows, "query_id long, id long, score double, session string")
    assert [r.id for r in s.diversified(ranked, "session", 5).orderBy("rank").collect()] == [0, 1, 2, 5, 3]


def test_budgets_stop_or_skip(spark):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate([5, 9, 4])], "s string, id long, t long")
    assert got(s.prefix_budget(rows, ["s"], [F.asc("id")], "t", 10), "id") == [(0,)]
    assert got(s.skip_budget(rows, ["s"], "id", "id", "t", 10), "id") == [(0,), (2,)]


def test_dedup_at_the_very_end_is_a_repeat(spark):
    rows = spark.createDataFrame([(1, "h", "2024-01-01 00:00:00"), (2, "h", "2024-01-01 00:05:00"), (3, "h", "2024-01-01 00:05:01")], "id long, h string, t string").withColumn("t", F.to_timestamp("t"))
    assert got(q.dedup_with_expiry(rows, ["h"], "t", "id"), "id") == [(1,), (3,)]


def test_as_of_bounds_belong_to_it(spark):
    e = spark.createDataFrame([(1, "2024-01-01", None, "2024-02-01"), (2, "2024-02-02", None, None)], "id long, tcommit string, tvalid string, tvalid_end string")
    assert got(g.as_of(e, F.lit("2024-02-01")), "id") == [(1,)]


def test_compatible_paths_follow_the_bounded_search(spark):
    # b is cheapest through c, at the limit, and may not go on to d
    edges = [("a", "b", 0.1), ("a", "c", 1.0), ("c", "b", 1.0), ("b", "d", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    starts = spark.createDataFrame([("a",)], "start string")
    assert got(g.compatible_paths(df, starts), "id", "hops") == [("b", 2), ("c", 1)]
    assert {r.id for r in g.two_hop_paths(df, starts).collect()} == {"b", "c", "d"}
    random.seed(3)
    for _ in range(3):
        more = [(random.randrange(8), random.randrange(8), random.random()) for _ in range(14)]
        more = [(a, b, w) for a, b, w in more if a != b]
        out = g.compatible_paths(spark.createDataFrame(more, "src long, dst long, weight double"), spark.createDataFrame([(more[0][0],)], "start long"))
        want = g.bounded_dijkstra(more, more[0][0], 2)
        assert got(out, "id", "hops") == sorted((k, h) for k, (c, h) in want.items() if k != more[0][0])


def test_a_tied_vote_is_ambiguous(spark):
    votes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, None), (3, None)], "item long, v string")
    assert got(lc.majority(votes, "item", "v"), "item", "winner", "ambiguous") == [(1, None, True), (2, "a", False)]


def test_last_write_needs_to_be_newer(spark):
    a, b = spark.createDataFrame([(1, "old", 5), (2, "old", 5)], "k long, v string, t long"), spark.createDataFrame([(1, "new", 5), (2, "new", 6), (3, "new", 1)], "k long, v string, t long")
    assert got(lc.last_write_wins(a, b, "k", "t"), "k", "v") == [(1, "old"), (2, "new"), (3, "new")]


def test_contradictions_leave_out_a_memory_itself(spark):
    rows = [(1, ["Auth", "auth"], ["aaa", "bbb"], 5), (2, ["auth"], ["bbb", "aaa"], 5), (3, [], ["aaa", "bbb"], 9), (4, ["auth"], ["ccc"], 9), (5, ["auth"], [], 9)]
    df = spark.createDataFrame(rows, "id long, c array<string>, w array<string>, t long")
    # 3 shares no concept, 4 no word, 5 has none
    assert got(lc.contradictions(df, "id", "c", "w", "t"), "older", "newer") == [(2, 1)]


def test_siblings_share_two_concepts(spark):
    rows = [(1, ["A", "b", "c"], False), (2, ["a", "B"], True), (3, ["a"], True), (4, ["x"], False), (5, ["a", "b"], False)]
    df = spark.createDataFrame(rows, "id long, c array<string>, is_latest boolean")
    assert got(lc.shared_concepts(df, df.where("not is_latest"), "id", "c"), "id", "siblings") == [(1, 1), (5, 1)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, rng.sample(words, rng.randint(0, 14))) for i in range(120)]
    rows += [(200 + i, rows[i][1][:-1] + ["x"]) for i in range(60)] + [(300 + i, rows[i][1]) for i in range(40)] + [(400, []), (401, [])]
    df = spark.createDataFrame(rows, "id long, w array<string>").repartition(5)
    key = {}
    for i, w in rows:
        key.setdefault(frozenset(w), i)
    for over in (0.3, 0.5, 0.7, 0.9):
        want = {(key[a], key[b]) for a in key for b in key if key[a] < key[b] and a and b and jaccard(a, b) > over}
        want |= {(key[frozenset(w)], i) for i, w in rows if key[frozenset(w)] != i}
        assert set(got(sim.near_copies(df, "id", "w", over), "a", "b")) == want
    assert sim.near_copies(df.limit(0), "id", "w", 0.7).count() == 0


def test_the_first_similar_memory_of_the_project_is_superseded(spark):
    old = spark.createDataFrame([(1, ["a", "b", "c"], "q"), (2, ["a", "b", "c"], "p"), (3, ["a", "b", "c", "d"], None), (4, ["z"], "p")], "id long, w array<string>, p string")
    new = spark.createDataFrame([(10, ["c", "b", "a"], "p"), (11, ["a", "b", "c", "d"], "x"), (12, ["a", "b", "c"], None), (13, ["y"], "p")], "id long, w array<string>, p string")
    assert got(sim.first_similar(new, old, "id", "w", "p", 0.7), "id", "supersedes") == [(10, 2), (11, 3), (12, 1)]


def test_folds_stream_group_by_group(spark):
    rows = [(g_, i, i % 3) for g_ in (None, 1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(6)
    run = lambda state, row: ((state or 0) + row[1], (row[0],) if (state or 0) + row[1] > (state or 0) and row[0] > 490 else None)
    out = q.fold_in_order(df, ["g"], ["i"], ["i", "v"], run, "i long")
    assert sorted(str((r.g, r.i)) for r in out.collect()) == sorted(str((g_, i)) for g_ in (None, 1, 2) for i in range(491, 500) if i % 3)
    ends = q.fold_in_order(df, ["g"], ["i"], ["v"], lambda state, row: ((state or 0) + row[0], None), "total long", lambda state: (state,))
    assert {r.total for r in ends.collect()} == {sum(i % 3 for i in range(500))} and ends.count() == 3


def test_slots_reject_what_would_exceed_their_limit(spark):
    df = spark.createDataFrame([("s", 1, "abc"), ("s", 2, "x" * 10), ("s", 3, "de\n"), ("s", 4, "f"), ("s", 5, ""), ("t", 1, "y" * 11)], "s string, n long, t string")
    assert got(slots.appended(df, "s", ["n"], "t", 10), "s", "content", "rejected") == [("s", "abc\nde\nf", 1), ("t", "", 1)]


def test_paths_end_in_each_other(spark):
    a = spark.createDataFrame([(1, "src/auth.ts"), (2, "auth.ts"), (3, "xauth.ts"), (4, "/w/src/auth.ts")], "id long, p string")
    b = spark.createDataFrame([("src/auth.ts",)], "w string")
    assert got(paths.by_suffix(a, "p", b, "w"), "id") == [(1,), (2,), (4,)]


def test_an_index_is_read_back_by_ranges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "author writes auth auth"), (2, "auth"), (3, None), (4, "zebra")], "doc long, text string")
    index = s.postings(s.terms_of(docs, "doc", F.col("text")))
    s.write_index(index, str(tmp_path / "i"), 3)
    assert got(s.read_index(spark, str(tmp_path / "i")), "id", "term") == got(index, "id", "term")
    assert got(s.read_index(spark, str(tmp_path / "i"), ["auth"]), "id", "term") == [(1, "auth"), (1, "author"), (2, "auth")]


def test_runs_of_a_routine(spark):
    steps = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a", "b"])], "step string, depends_on array<string>")
    actions, edges = wk.instantiate(steps, F.lit("r1"))
    assert got(actions, "id", "status") == [("r1:a", "pending"), ("r1:b", "blocked"), ("r1:c", "blocked")]
    assert got(edges, "src", "dst", "type") == [("r1:b", "r1:a", "requires"), ("r1:c", "r1:a", "requires"), ("r1:c", "r1:b", "requires")]


def test_missing_requirements_block_nothing_but_are_not_done(spark):
    actions = spark.createDataFrame([(1, "pending", 5, "2024-01-01"), (2, "blocked", 5, "2024-01-01")], "id long, status string, priority int, created string")
    edges = spark.createDataFrame([(1, 99, "requires"), (2, 99, "requires")], "src long, dst long, type string")
    none = spark.createDataFrame([], "id long, status string")
    assert got(wk.frontier(actions, edges, none, F.lit("2024-01-02")), "id") == [(1,)]
    assert wk.unblocked(actions, edges).count() == 0


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"type":"user","sessionId":"s","timestamp":"1","cwd":"/w/proj","message":{"role":"user","content":"hello"}}\n'
        "no json\n"
        '{"type":"assistant","sessionId":"s","timestamp":"2","message":{"role":"assistant","content":[{"type":"text","text":"hi"},{"type":"tool_use","name":"Bash","input":"ls"}]}}\n'
        '{"type":"user","timestamp":"3","message":{"role":"user","content":[{"type":"tool_result","is_error":true,"content":"bad"}]}}\n'
    )
    e = src.read_transcripts(spark, str(tmp_path))
    assert got(e, "timestamp", "hook") == [("1", "prompt_submit"), ("2", "pre_tool_use"), ("2", "stop"), ("3", "post_tool_failure")]
    assert {(r.session_id, r.project) for r in e.collect()} == {("s", "proj")}
    assert src.sessions_of(e).first().first_prompt == "hello"


def test_import_strategies(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "a")], "k long, v string"), spark.createDataFrame([(2, "b"), (3, "b")], "k long, v string")
    assert got(src.merge_import(a, b, "k", "merge"), "k", "v") == [(1, "a"), (2, "b"), (3, "b")]
    assert got(src.merge_import(a, b, "k", "skip"), "k", "v") == [(1, "a"), (2, "a"), (3, "b")]
    assert got(src.merge_import(a, b, "k", "replace"), "k", "v") == [(2, "b"), (3, "b")]


def test_snapshots_are_listed_and_restored(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string")
    for version, df in ((3, a), (7, b)):
        src.snapshot(df, str(tmp_path), version)
    assert src.snapshots(spark, str(tmp_path)) == [3, 7] and got(src.restored(spark, str(tmp_path), 3), "k", "v") == [(1, "a")]
    assert got(src.snapshot_diff(src.restored(spark, str(tmp_path), 3), b), "v", "change") == [("a", "removed"), ("b", "added"), ("c", "added")]


def test_exports_and_notes(spark, tmp_path):
    sessions, rows = spark.createDataFrame([(i,) for i in range(5)], "session long"), spark.createDataFrame([(i % 5, i) for i in range(12)], "session long, i long")
    page, more = src.export_page(sessions, {"rows": rows}, offset=1, most=2)
    assert got(page["sessions"], "session") == [(1,), (2,)] and got(page["rows"], "i") == [(1,), (2,), (6,), (7,), (11,)] and more
    assert not src.export_page(sessions, {}, offset=3, most=2)[1]
    src.export_json(page, str(tmp_path / "out"))
    assert got(spark.read.json(str(tmp_path / "out" / "rows")), "i") == [(1,), (2,), (6,), (7,), (11,)]
    src.write_markdown(spark.createDataFrame([("Auth", "text")], "title string, content string"), str(tmp_path / "notes"))
    assert [r.value for r in spark.read.text(str(tmp_path / "notes")).collect() if r.value] == ["# Auth", "text"]


def test_sessions_of_two_imports_are_one(spark):
    kind = "session_id string, project string, observation_count long, started_at string, ended_at string, first_prompt string, status string"
    a, b = spark.createDataFrame([("s", "p", 2, "2", "3", None, "active")], kind), spark.createDataFrame([("s", "q", 3, "1", "2", "hi", "completed"), ("t", "q", 1, "1", "1", None, "completed")], kind)
    out = {r.session_id: r for r in src.merged_sessions(a, b).collect()}
    assert (out["s"].observation_count, out["s"].started_at, out["s"].ended_at, out["s"].project, out["s"].first_prompt, out["s"].status) == (5, "1", "3", "p", "hi", "active") and out["t"].observation_count == 1


def test_a_log_of_upserts(spark):
    log = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 1, False), (2, None, 5, True), (3, "d", 1, None)], "k long, v string, at long, gone boolean")
    assert got(src.latest(log, "k", F.col("at"), "gone"), "k", "v") == [(1, "b"), (3, "d")]


def test_sketches_rule_out_no_pair(spark):
    rng = random.Random(4)
    rows = []
    for i, n in enumerate((3, 20, 90, 260, 400, 1100)):
        base = [f"w{rng.randrange(1500)}" for _ in range(n)]
        rows += [(10 * i + k, base[k * n // 40 :] + [f"x{i}{k}{j}" for j in range(k * n // 60)]) for k in range(8)]
    rows += [rows[0], rows[40], (900, None), (901, None), (902, [])]
    df = spark.createDataFrame(rows, "id long, w array<string>").repartition(5)
    sets = {i: set(w) for i, w in rows if w}
    key = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(a, b) for a in set(key.values()) for b in set(key.values()) if a < b and jaccard(sets[a], sets[b]) > 0.7} | {(k, i) for i, k in key.items() if k != i}
    assert set(got(sim.near_copies(df, "id", "w", 0.7), "a", "b")) == want


def test_stems_are_found_by_text_and_postings_stay_where_they_are(spark):
    """Python gets texts, no row for each token with all of its text's tokens (F2)."""
    ship(spark)
    texts = {1: "Connections connected, connecting the ponies", 2: None, 3: "! a", 4: "relational " * 3000, 5: "the the configuration"}
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    terms = s.terms_of(docs, "doc", F.col("text"), stems=True)
    said = {i: [w for w in re.split(r"[^a-z]+", (t or "").lower()) if len(w) > 1] for i, t in texts.items()}
    assert sorted((r.id, r.pos, r.term, r.dl) for r in terms.collect()) == sorted((i, n, tx.stem(w), len(ws)) for i, ws in said.items() for n, w in enumerate(ws))
    plan = s.postings(terms)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and not re.search(r"Generate posexplode\(tokens#\d+\), \[[^\]]*tokens", plan)
    asked = s.weighted_terms(s.terms_of(spark.createDataFrame([(1, "connect poni")], "doc long, text string"), "doc", F.col("text"), stems=True))
    index = s.held(s.postings(terms))
    index.count()  # how kept rows lie is known once they are there
    found = s.bm25(index, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((part#\w+, )?(query_id#\w+, )?id#", plan)
    assert [r.id for r in found.collect()] == [1]
    s.release()


def test_pairs_are_found_once_for_both_ways(spark):
    """A union of both ways finds all pairs twice (F3)."""
    schema = "id long, w array<string>, p string"
    words = [f"w{i}" for i in range(9)]
    new = spark.createDataFrame([(4, words, "x"), (9, words[:8], None), (14, [], "x"), (19, None, "x"), (24, ["alone"], "x")], schema)
    old = spark.createDataFrame([(1, words, "y"), (2, words[1:], "x"), (3, [], "x"), (5, words[:8], "y")], schema)
    first = sim.first_similar(new, old, "id", "w", "p", 0.7)
    assert first._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") <= 2  # in the join's condition and in what it returns
    assert got(first, "id", "supersedes") == [(4, 2), (9, 1), (14, 3)]
