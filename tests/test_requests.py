"""Search requests, the graph's stream, clusters, integrity and context: small cases and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import context as cx
from palimpsest.operators import graph as g
from palimpsest.operators import integrity as it
from palimpsest.operators import recall as r
from palimpsest.operators import similarity as sim


def got(df, *cols):
    return sorted(tuple(x) for x in df.select(*cols).collect())


def test_limits_are_clamped():
    assert [r.clamp("vision", n) for n in (None, 0, 80)] == [10, 1, 50] and r.clamp("graph", 9999) == 5000 and r.clamp("search", 500) == 100
    with pytest.raises(ValueError):
        r.clamp("search", 0)


def test_agents_fail_closed():
    assert r.agent_scope("*", True, None) is None and r.agent_scope(None, False, None) is None and r.agent_scope(None, True, "me") == "me" and r.agent_scope(" you ", True, "me") == "you"
    with pytest.raises(ValueError):
        r.agent_scope(None, True, " ")


def test_rows_of_an_agent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, None)], "id long, agent string")
    assert got(r.of_agent(df, "a"), "id") == [(1,)] and got(r.of_agent(df, "a", orphans=True), "id") == [(1,), (3,)] and r.of_agent(df, None).count() == 3


def test_project_by_session_then_by_memory(spark):
    hits = spark.createDataFrame([(1, "s"), (2, "t"), (3, "gone"), (4, None), (5, None)], "id long, session string")
    sessions = spark.createDataFrame([("s", "p", "/w"), ("t", "q", "/w"), ("u", None, None)], "session string, project string, cwd string")
    memories = spark.createDataFrame([(4, "q"), (5, None)], "id long, project string")
    assert got(r.in_project(hits, sessions, memories, "p"), "id") == [(1,), (3,), (5,)]
    assert got(r.in_project(hits, sessions, memories, None, "/w"), "id") == [(1,), (2,), (3,), (4,), (5,)]
    assert got(r.in_project(hits, sessions, memories, "p", "/x"), "id") == [(3,), (5,)]


def test_reranking_moves_the_first_only(spark):
    hits = spark.createDataFrame([(1, i, 1.0 / i, i, f"t{i}", "n") for i in range(1, 6)], "query_id long, id long, score double, rank long, title string, narrative string")
    asked = spark.createDataFrame([(1, "q")], "query_id long, text string")
    model = lambda pairs: [float(t[1]) for q, t in pairs]
    assert [x.id for x in r.rerank(hits, asked, model, 3).orderBy("rank").collect()] == [3, 2, 1, 4, 5]
    assert r.rerank(hits, asked).collect() == hits.collect()


def test_vectors_of_another_length_are_made_again(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0]), (3, [1.0])], "id long, v array<double>")
    t = spark.createDataFrame([(2, "some words here")], "id long, text string")
    out = {x.id: x.v for x in r.migrate_vectors(v, t, 4).collect()}
    assert set(out) == {1, 2} and out[2] == pytest.approx(r.hash_embedding("some words here", 4)) and sum(x * x for x in out[2]) == pytest.approx(1)
    assert r.hash_embedding("", 3) == [0.0] * 3


def test_scripts_without_spaces_are_cut(spark):
    df = spark.createDataFrame([("修复auth漏洞 now",), ("한국어tokenize 개발ㅋ",), ("plain words",), (None,)], "t string")
    out = [x.ts for x in df.select(tx.tokenize(F.col("t")).alias("ts")).collect()]
    assert out == [["修复", "auth", "漏洞", "now"], ["한국어", "tokenize", "개발"], ["plain", "words"], None]
    cut = df.select(tx.cut_runs(tx.tokenize(F.col("t")), list).alias("ts")).collect()
    assert cut[0].ts == ["修", "复", "auth", "漏", "洞", "now"] and cut[2].ts == ["plain", "words"]


def test_two_hops_follow_the_bounded_search(spark):
    rng = random.Random(11)
    for _ in range(4):
        edges = [(rng.randrange(9), rng.randrange(9), round(rng.random(), 3)) for _ in range(22)]
        edges = [(a, b, w) for a, b, w in edges if a != b]
        starts = sorted({a for a, _, _ in edges})[:4]
        out = g.bounded_two_hops(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(x,) for x in starts], "start long"))
        want = sorted((x, k, round(c, 6), h) for x in starts for k, (c, h) in g.bounded_dijkstra(edges, x, 2).items() if k != x)
        assert sorted((x.start, x.id, round(x.cost, 6), x.hops) for x in out.collect()) == want


def test_names_and_entities_contain_each_other(spark):
    names = ["Auth Service", "auth", "", "DB", "cache layer", "x"]
    entities = [(1, "AUTH"), (2, "the db and cache layer"), (3, "zzz"), (4, "")]
    out = g.named_like(spark.createDataFrame(list(enumerate(names)), "id long, name string"), spark.createDataFrame(entities, "query_id long, entity string"))
    want = sorted({(q, i) for i, n in enumerate(names) for q, e in entities if n and e and (e.lower() in n.lower() or n.lower() in e.lower())})
    assert got(out, "query_id", "id") == want


def test_hits_by_entities_and_by_expansion(spark):
    nodes = spark.createDataFrame([(1, "auth"), (2, "db"), (3, "cache"), (4, "lone")], "id long, name string")
    edges = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.4)], "src long, dst long, weight double")
    prov = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40), (2, 10)], "id long, obs long")
    asked = spark.createDataFrame([(1, "auth"), (2, "lone"), (3, "none")], "query_id long, entity string")
    out = [(x.query_id, x.id, x.score, x["rank"]) for x in g.entity_hits(nodes, edges, prov, asked).orderBy("query_id", "rank").collect()]
    # observation 10 was reached over db before auth's own turn came
    assert out == [(1, 10, 0.4, 1), (1, 20, 0.4, 2), (1, 30, 0.2, 3), (2, 40, 1.0, 1)]
    seeds = spark.createDataFrame([(1, 20)], "query_id long, obs long")
    expanded = g.expansion_hits(edges, prov, seeds)
    assert got(expanded, "id", "rank") == [(10, 1), (30, 2)]
    both = g.appended([g.entity_hits(nodes, edges, prov, asked).where("query_id = 1"), expanded])
    assert [x.id for x in both.orderBy("rank").collect()] == [10, 20, 30, 10, 30]


def test_a_page_of_the_graph(spark):
    nodes = spark.createDataFrame([(i, "file" if i % 2 else "concept", f"n{i}", {"lang": "Go" if i == 4 else "py"}) for i in range(6)], "id long, type string, name string, properties map<string, string>")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "src long, dst long, weight double")
    shown, between = g.query_page(nodes, edges, spark.createDataFrame([(0,)], "start long"), 3)
    assert got(shown, "id", "hops") == [(0, 0), (1, 1), (2, 2), (3, 3)] and got(between, "src", "dst") == [(0, 1), (1, 2), (2, 3)]
    shown, between = g.query_page(nodes, edges, spark.createDataFrame([(0,)], "start long"), 9, "concept", 2, 1)
    assert got(shown, "id") == [(2,), (4,)] and between.count() == 0
    assert got(g.text_matches(nodes, "go"), "id") == [(4,)] and got(g.text_matches(nodes, "N3"), "id") == [(3,)]


def plain_clusters(kinds, edges, most):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order, seen, out = sorted((i for i, t in kinds.items() if t == "concept"), key=lambda i: (-len(near.get(i, ())), i)), set(), []
    for seed in order:
        if len(out) >= most:
            break
        if seed in seen:
            continue
        reach = {seed} | near.get(seed, set()) | {y for x in near.get(seed, ()) for y in near.get(x, ())}
        own = {x for x in reach if kinds[x] == "concept"}
        seen |= own
        if len(own) >= 2:
            out.append((seed, own))
    return sorted((s, x) for s, own in out for x in own)


def test_clusters_of_concepts_against_a_plain_version(spark):
    rng = random.Random(12)
    kinds = {i: rng.choice(["concept", "concept", "file"]) for i in range(40)}
    edges = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(30)) if a != b})
    nodes = spark.createDataFrame(list(kinds.items()), "id long, type string")
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    for most in (2, 10):
        assert got(g.concept_clusters(nodes, df, most), "seed", "id") == plain_clusters(kinds, edges, most)


def test_clusters_by_rows_against_a_plain_version(spark):
    rng = random.Random(13)
    terms = [f"t{i:02d}" for i in range(30)]
    rows = [(i, rng.sample(terms[: 10 + i % 20], rng.randint(0, 5))) for i in range(40)]
    sets = {t: {i for i, ts in rows if t in ts} for t in terms}
    names = [t for t in terms if len(sets[t]) >= 2]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.3
    pairs = sim.concept_pairs(spark.createDataFrame(rows, "id long, terms array<string>"), 0.3)
    assert got(pairs, "a", "b") == sorted((a, b) for a in names for b in names if a < b and alike(a, b))
    seen, want = set(), []
    for a in names:
        if a in seen:
            continue
        seen.add(a)
        own = [b for b in names if b not in seen and alike(a, b)]
        seen |= set(own)
        want += [(a, x) for x in [a, *own]] if own else []
    assert got(sim.greedy_clusters(pairs), "seed", "id") == sorted(want)


def small_world(spark):
    t = lambda rows, kind: spark.createDataFrame(rows, kind)
    return {
        "actions": t([(1, "active", "a"), (2, "blocked", None), (3, "pending", None), (4, "done", None), (5, "active", "b")], "id long, status string, assigned_to string"),
        "edges": t([(2, 4, "requires"), (3, 99, "requires")], "src long, dst long, type string"),
        "leases": t([(1, 1, "a", "active", 5), (2, 5, "b", "active", 50), (3, 77, "c", "active", 50)], "id long, action long, agent string, status string, expires_at long"),
        "memories": t([(1, [], True, "p"), (2, [1, 9], True, None)], "id long, supersedes array<long>, is_latest boolean, project string"),
        "lessons": t([(1, float("nan"), None), (2, 0.5, None), (3, None, True)], "id long, confidence double, deleted boolean"),
        "sketches": t([(1, "active", 10), (2, "done", 1)], "id long, status string, expires_at long"),
    }


def test_diagnosis_and_repair(spark):
    world = small_world(spark)
    found = {(x.name, x.status, x.fixable) for x in it.diagnose(world, F.lit(10)).collect()}
    assert found == {
        ("active-no-lease:1", "warn", False), ("blocked-deps-done:2", "fail", True), ("pending-unsatisfied-deps:3", "fail", True), ("expired-lease:1", "fail", True), ("orphaned-lease:3", "fail", True),
        ("memory-missing-supersedes:2:9", "warn", False), ("memory-stale-latest:1", "fail", True), ("memory-project-coverage", "warn", True), ("lesson-bad-confidence:1", "warn", False), ("expired-sketch:1", "fail", True),
    }
    assert {x.name for x in it.diagnose({"lessons": world["lessons"].where("id = 2")}, F.lit(10), ["lessons", "nonsense"]).collect()} == {"lessons-ok"}
    with pytest.raises(ValueError):
        it.diagnose({}, F.lit(10))
    healed, done = it.heal(world, F.lit(10))
    assert got(healed["actions"], "id", "status") == [(1, "pending"), (2, "pending"), (3, "blocked"), (4, "done"), (5, "active")]
    assert got(healed["leases"], "id", "status") == [(1, "expired"), (2, "active")]
    assert got(healed["memories"], "id", "is_latest") == [(1, False), (2, True)] and got(healed["sketches"], "id", "status") == [(1, "expired"), (2, "done")]
    assert done.count() == 7


def test_forgetting(spark):
    t = lambda rows, kind: spark.createDataFrame(rows, kind)
    obs = t([(1, "s"), (2, "s"), (3, "t"), (4, "t")], "id long, session string")
    sessions = t([("s",), ("t",)], "session string")
    asked = t([(1, None, "s", None), (2, None, "t", 3), (2, 7, None, None), (3, None, "none", None)], "request long, memory long, session string, observation long")
    left, counts = it.forget(obs, sessions, sessions, t([(7,), (8,)], "id long"), asked)
    assert got(left["observations"], "id") == [(4,)] and got(left["sessions"], "session") == [("t",)] and got(left["memories"], "id") == [(8,)]
    assert got(counts, "request", "deleted") == [(1, 4), (2, 2), (3, 2)]


def test_bulk_deletions_need_a_condition(spark):
    m = spark.createDataFrame([(1,), (2,)], "id long")
    assert got(it.govern(m, F.col("id") == 1)[0], "id") == [(2,)] and it.govern(m, None, dry_run=True)[0].count() == 2
    with pytest.raises(ValueError):
        it.govern(m, None)


def test_enriched_contexts_are_escaped_and_cut(spark):
    t = lambda rows, kind: spark.createDataFrame(rows, kind)
    hits = t([(1, 1, "a < b & c"), (1, 2, "x" * 50)], "request long, rank long, narrative string")
    files = t([(1, "src/a.ts"), (2, "b.ts")], "request long, file string")
    bugs = t([(i, f"bug{i}", "c", f, i) for i, f in enumerate(["a.ts", "src/a.ts", "src/a.ts/x", "other"])], "id long, title string, content string, file string, updated_at long")
    out = {x.request: x for x in cx.enriched(t([(1,), (2,)], "request long"), hits, cx.bugs_in(files, bugs), 100).collect()}
    assert out[1].context.startswith("<relevant-context>\na &lt; b &amp; c\nxxx") and out[1].truncated and len(out[1].context) == 100
    assert out[2].context == "" and not out[2].truncated
    assert got(cx.bugs_in(files, bugs), "request", "title") == [(1, "bug0"), (1, "bug1"), (1, "bug2")]
