"""Ordered folds, streams, paths, clusters and row patterns against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import clusters, folds, paths, symbols, trajectories

FEEDBACK = "src string, dst string, kind string, at long, seq long, positive boolean, score double"


def test_edge_weights_equal_a_loop_also_for_a_hot_edge(spark):
    r = random.Random(1)
    log = [(f"m{0 if r.random() < 0.6 else r.randrange(9)}", "t", r.choice(["Supports", "SharedTag"]), r.randrange(50), i, r.random() < 0.4, r.choice([None, -1.0, 0.0, 0.3, 1.0, 7.0])) for i in range(6000)]
    frame = spark.createDataFrame(log, FEEDBACK).repartition(7)
    start = F.when(F.col("kind") == "Supports", 0.95).otherwise(0.5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    got = {(g.src, g.kind): g for g in folds.edge_weights(frame, start).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for src, _, kind, at, seq, good, score in sorted(log, key=lambda x: (x[3], x[4])):
        w, up, down, _ = want.get((src, kind), (0.95 if kind == "Supports" else 0.5, 0, 0, 0))
        s = 1.0 if score is None or score <= 0 else min(score, 1.0)
        w = w + 0.15 * s * (1 - w) if good else w - 0.2 * s * w
        want[src, kind] = (min(1.0, max(0.05, w)), up + good, down + (not good), at)
    assert got.keys() == want.keys()
    for k, (w, up, down, last) in want.items():
        assert abs(got[k].weight - w) < 1e-9 and (got[k].reinforcements, got[k].depressions, got[k].last) == (up, down, last)
    assert folds.edge_weights(frame.limit(0), start).count() == 0


def test_moving_average_equals_a_loop(spark):
    r = random.Random(2)
    log = [(r.randrange(3), i, float(r.randrange(2))) for i in range(900)] + [(None, 1000, 1.0)]
    got = {g.k: g.average for g in folds.moving_average(spark.createDataFrame(log, "k int, i int, x double"), "k", ["i"], F.col("x"), 0.5).collect()}
    want = {}
    for k, _, x in log:
        want[k] = want.get(k, 0.5) * 0.8 + x * 0.2
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def claims_of(n):
    r = random.Random(3)
    return sorted({(0 if r.random() < 0.5 else r.randrange(5), r.randrange(4), 1_700_000_000 + r.randrange(4000) * 60, r.choice([60, 600, 7200]), r.random() < 0.15) for _ in range(n)})


def folded(rows):
    state, out = {}, []
    for row in sorted(rows, key=lambda c: (c[2], c[1], c[4], c[3])):
        state[row[0]], values = folds.claim(state.get(row[0]), row)
        out.append(values)
    return sorted(map(repr, out))


CLAIM = "resource long, holder long, at long, ttl long, release boolean"


def test_denied_claims_hold_nothing(spark):
    rows = [(1, 1, 0, 10, False), (1, 2, 5, 100, False), (1, 3, 12, 10, False), (1, 3, 15, 50, False), (1, 2, 20, 5, True), (1, 3, 21, 5, True), (1, 2, 22, 5, False)]
    got = folds.leases(spark.createDataFrame(rows, CLAIM)).orderBy("at").collect()
    assert [g.outcome for g in got] == ["granted", "denied", "granted", "granted", "not held", "released", "granted"]
    many = claims_of(2000)
    assert sorted(repr(tuple(g)) for g in folds.leases(spark.createDataFrame(many, CLAIM)).collect()) == folded(many)


def test_lease_stream_equals_the_table(spark, tmp_path):
    from tidepool.streaming.leases import lease_stream

    rows = claims_of(600)
    rows.sort(key=lambda c: c[2])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "claims")
    third = rows[len(rows) // 3][2]
    for part in ([c for c in rows if c[2] < third], [c for c in rows if c[2] >= third]):
        spark.createDataFrame(part, CLAIM).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(f"{CLAIM}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    query = lease_stream(stream).writeStream.format("memory").queryName("leased").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(repr(tuple(g)) for g in spark.table("leased").collect())
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == folded(rows)


def test_best_paths_equal_a_search_of_all_walks(spark):
    r = random.Random(5)
    edges = [(f"n{r.randrange(14)}", f"n{r.randrange(14)}", r.choice("ab"), r.randrange(1, 10) / 10) for _ in range(45)] + [("n0", "n1", "b", 0.5), ("n0", "n1", "a", 0.5), ("n1", "dead", "a", 0.0)]
    edges = sorted(set(edges))
    steps = paths.best_paths(spark.createDataFrame(edges, "src string, dst string, kind string, weight double"), "n0", 4)
    got = {g.target: (g.energy, [(s.node, s.kind) for s in g.path]) for g in paths.read_back(steps, steps.select("node"), 4).collect()}
    best = {"n0": 1.0}
    walks = [(1.0, ["n0"], [])]
    for _ in range(4):
        walks = [(e * w, [*nodes, d], [*kinds, k]) for e, nodes, kinds in walks for s, d, k, w in edges if s == nodes[-1] and e * w > 0]
        for e, nodes, _ in walks:
            best[nodes[-1]] = max(best.get(nodes[-1], 0), e)
    assert {t: round(e, 9) for t, (e, _) in got.items()} == {t: round(e, 9) for t, e in best.items()}
    weight = {(s, d, k): w for s, d, k, w in edges}
    for target, (energy, path) in got.items():
        at, product = "n0", 1.0
        for node, kind in path:
            product *= weight[at, node, kind]
            at = node
        assert at == target and product == pytest.approx(energy)


def test_leaders_are_apart_and_near_their_members(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    points = [(i, "hot" if i % 3 else f"b{i % 4}", (centers[rng.integers(12)] + rng.normal(scale=0.25, size=8)).tolist()) for i in range(900)] + [(900, "hot", [0.0] * 8), (901, "hot", [0.0] * 8), (902, "hot", None)]
    frame = spark.createDataFrame(points, "id int, block string, vector array<double>").repartition(5)
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in points if v is not None}
    away = lambda a, b: max(0.0, 1 - float(unit[a] @ unit[b]))
    loop, leaders = {}, {}
    for i, block, v in points:
        if v is None:
            continue
        d, j = min(((away(i, j), n) for n, j in enumerate(leaders.setdefault(block, []))), default=(9, 0))
        if d < 0.2:
            loop[i] = leaders[block][j]
        else:
            leaders[block].append(i)
            loop[i] = i
    assert {r.id: r.leader for r in clusters.leader_clusters(frame).collect()} == loop
    for splits in (4, 16):
        got = {r.id: r for r in clusters.leader_clusters(frame, splits=splits).collect()}
        assert got.keys() == loop.keys()
        heads = {r.leader for r in got.values()}
        assert all(got[i].block == got[got[i].leader].block and (away(i, got[i].leader) < 0.2 or i == got[i].leader) for i in got)
        assert all(away(a, b) >= 0.2 for a in heads for b in heads if a != b and got[a].block == got[b].block)
    found = clusters.medoids(clusters.leader_clusters(frame), frame).collect()
    for m in found:
        members = [i for i, j in loop.items() if j == m.leader]
        assert m.n == len(members) and min(members, key=lambda i: (round(sum(1 - float(unit[i] @ unit[j]) for j in members), 9), i)) == m.medoid


def test_recoveries_equal_a_scan(spark):
    r = random.Random(9)
    log = [(s, q * 3, r.choice(["failure", "attempt", "attempt", "success", "other", "other"]), f"s{r.randrange(5)}") for s in range(6) for q in range(200 if s else 3000)]
    got = sorted((g.session_id, g.failed_at, g.recovered_at, tuple(g.steps)) for g in trajectories.recoveries(spark.createDataFrame(log, "session_id int, seq int, kind string, step string").repartition(4)).collect())
    want = []
    for s in range(6):
        events = [e for e in log if e[0] == s]
        i = 0
        while i < len(events):
            if events[i][2] == "failure":
                steps, j = [], i + 1
                while j < len(events) and j - i <= 10 and not (events[j][2] == "success" and steps):
                    steps += [events[j][3]] if events[j][2] == "attempt" else []
                    j += 1
                if j < len(events) and j - i <= 10:
                    want.append((s, events[i][1], events[j][1], tuple(steps)))
                    i = j
                    continue
            i += 1
    assert got == sorted(want) and len(want) > 100


def test_calls_are_resolved_by_the_first_rule(spark):
    edges = spark.createDataFrame([("src\\a\\x.rs", "imported"), ("src/a/x.rs", "Type::new"), ("src/a/x.rs", "obj.go"), ("src/a/x.rs", "own"), ("src/a/x.rs", "only"), ("src/a/x.rs", "many"), ("src/c/z.rs", "many"), ("src/a/x.rs", "nowhere"), ("./src/a//x.rs", "own"), ("top.rs", "many"), (None, "own"), ("src/a/x.rs", None)], "caller_file string, callee string")
    imports = spark.createDataFrame([("src/a/x.rs", "imported", "lib/i.rs"), ("src\\a\\x.rs", "imported", "lib/j.rs"), ("src/a/x.rs", "Type", "lib/t.rs"), ("src/a/x.rs", "obj", "lib/o.rs")], "file string, symbol string, target string")
    defs = spark.createDataFrame([("src/a/x.rs", "own"), ("src/b/y.rs", "own"), ("src/b/y.rs", "only"), ("src/b/y.rs", "many"), ("src/a/w.rs", "many"), ("src/a/w.rs", "many")], "file string, symbol string")
    got = sorted(((r.caller_file or "", r.callee or "", r.target, r.rule) for r in symbols.resolve_edges(edges, imports, defs).collect()), key=repr)
    want = [("src\\a\\x.rs", "imported", "lib/i.rs", "import"), ("src/a/x.rs", "Type::new", "lib/t.rs", "scope"), ("src/a/x.rs", "obj.go", "lib/o.rs", "scope"), ("src/a/x.rs", "own", "src/a/x.rs", "local"), ("src/a/x.rs", "only", "src/b/y.rs", "only"), ("src/a/x.rs", "many", "src/a/w.rs", "near"), ("src/c/z.rs", "many", "src/a/w.rs", "first"), ("src/a/x.rs", "nowhere", None, None), ("./src/a//x.rs", "own", "src/a/x.rs", "local"), ("top.rs", "many", "src/a/w.rs", "first"), ("src/a/x.rs", "", None, None)]
    assert [g for g in got if g[0]] == sorted(want, key=repr)
    assert [g[1:] for g in got if not g[0]] in ([("own", "src/a/x.rs", "first")], [("own", None, None)])


def test_index_counts_the_last_segment_only(spark, tmp_path):
    from tidepool.operators.search import Index

    docs = [(1, "red apple pie", "a"), (2, "red red wine", "b"), (3, None, "a"), (4, "apples and pears", "a")]
    index = Index(spark, str(tmp_path / "one"))
    frame = lambda rows: spark.createDataFrame(rows, "id int, text string, scope string")
    index.add(frame(docs), 1, attributes=["scope"])
    ids = lambda i, words, **more: [r.id for r in i.search(words, **more).orderBy(F.desc("score"), "id").collect()]
    assert ids(index, ["Red"]) == [2, 1] and ids(index, ["appl"]) == [] and ids(index, ["appl"], prefix=True) == [1, 4]
    assert ids(index, ["red"], keep=F.col("scope") == "a") == [1] and ids(index, []) == [] and ids(index, ["none"]) == []
    index.add(frame([(2, "green tea", "b"), (3, "red", "a")]), 2, attributes=["scope"])
    index.add(frame([(1, None, "a")]), 3, attributes=["scope"], deleted=True)
    assert ids(index, ["red"]) == [3] and ids(index, ["tea", "red"]) == [3, 2]
    small = index.compact(str(tmp_path / "two"))
    assert ids(small, ["red"]) == [3] and small.documents().count() == 3
    assert sorted(r.score for r in small.search(["red", "pears"]).collect()) == pytest.approx(sorted(r.score for r in index.search(["red", "pears"]).collect()))
    plan = index.postings(["red"], False)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,red)" in plan


def test_three_way_merge_and_density(spark):
    from tidepool.operators import branches

    rows = [("same", "b", 0, "x"), ("took", "b", 0, "x"), ("took", "f", 1, "y"), ("took", "f", 2, "z"), ("kept", "b", 0, "x"), ("kept", "r", 1, "y"), ("agree", "f", 1, "y"), ("agree", "r", 9, "y"), ("fight", "b", 0, "x"), ("fight", "f", 1, None), ("fight", "r", 1, "y"), ("gone", "b", 0, "x"), ("gone", "f", 1, None), ("back", "b", 0, "x"), ("back", "f", 1, "y"), ("back", "f", 2, "x"), ("other", "q", 1, "x")]
    frame = spark.createDataFrame(rows, "k string, branch string, at int, c string")
    got = {r.k: r.outcome for r in branches.merge(frame, "k", F.col("c"), "b", "f", "r").collect()}
    assert got == {"same": "unchanged", "took": "taken", "kept": "kept", "agree": "agreed", "fight": "conflict", "gone": "taken", "back": "unchanged"}
    events = [("a", 0, 1.0, 0.1), ("a", 86_400, 0.9, 0.1), ("a", 86_400, 1.0, 0.95), ("b", 0, 1.0, None), ("b", 90_000, None, 0.2), ("c", 0, -1.0, 0.99)]
    out = {r.k: r for r in branches.gated(spark.createDataFrame(events, "k string, at long, likeness double, importance double"), "k", F.lit(86_400), 0.9).collect()}
    assert out["a"].recurrences == 2 and out["a"].bypassed == 1 and out["a"].density == pytest.approx(np.exp(-1) + 0.9) and out["a"].decision == "hold"
    assert out["b"].density == pytest.approx(np.exp(-1)) and (out["c"].recurrences, out["c"].density, out["c"].bypassed) == (0, 0.0, 1)
