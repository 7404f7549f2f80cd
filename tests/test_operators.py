"""Small cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidepool.functions import decay, errors, temporal
from tidepool.operators import evidence, graphs, retrieval, sessions, upserts
from tidepool.sources import files
from tidepool.streaming import futility


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_decay_by_hand(spark):
    s = decay.stability(F.lit(0), F.lit(0.5))
    assert one(spark, s) == pytest.approx(26.4)
    assert one(spark, decay.retention(F.lit(24.0), s)) == pytest.approx(0.402890, abs=1e-6)
    assert one(spark, decay.activation(decay.trace(F.lit(24.0)), F.lit(0.5), F.lit(1.0))) == pytest.approx(-0.839027, abs=1e-6)


def test_fusion_by_hand(spark):
    ranked = lambda r: spark.createDataFrame([("a", r)], "id string, rank int")
    got = retrieval.fuse({"w": (ranked(1), 0.4), "v": (ranked(2), 0.4), "g": (ranked(1), 0.35)}).first()["score"]
    assert got == pytest.approx(0.01874669, abs=1e-8)
    assert got * one(spark, retrieval.quality(F.lit(0.9), F.lit(1.0))) == pytest.approx(0.02174617, abs=1e-8)


def test_hop_factor(spark):
    assert [one(spark, retrieval.hop_factor(F.lit(h))) for h in range(4)] == [1.5, 1.0, 0.5, 0.0]


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, retrieval.cosine(v(1, 0), v(1, 0, 0))) == 0.0
    assert one(spark, retrieval.cosine(v(0, 0), v(1, 1))) == 0.0
    assert one(spark, retrieval.cosine(v(1, 1), v(2, 2))) == pytest.approx(1.0)


def test_diffusion_by_hand(spark):
    edges = spark.createDataFrame([("A", "B", 0.95), ("B", "C", 0.95)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("A", 1.0)], "node string, energy double")
    want = {1: {"A": 1.0, "B": 0.6175}, 2: {"A": 1.0, "B": 0.741, "C": 0.381306}, 3: {"A": 1.0, "B": 0.7657, "C": 0.533829}}
    for hops, energies in want.items():
        got = {r["node"]: r["energy"] for r in graphs.diffuse(edges, seeds, hops=hops).collect()}
        assert got == pytest.approx(energies, abs=1e-5)


def test_blast_risk_by_hand(spark):
    assert one(spark, graphs.blast_risk(F.lit(0.9), F.lit(0.9 * 0.75), F.lit(True), F.lit(True))) == pytest.approx(0.698875)


def test_waves_leave_cycles_out(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("y",)], "node string")
    deps = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "node string, needs string")
    assert {r["node"]: r["level"] for r in graphs.waves(tasks, deps).collect()} == {"a": 0, "b": 1, "c": 2}


def test_communities_of_two_cliques(spark):
    pairs = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.1)]
    got = {r["node"]: r["label"] for r in graphs.label_propagation(spark.createDataFrame(pairs, "src string, dst string, weight double")).collect()}
    assert len({got[n] for n in "abcd"}) == 1 and len({got[n] for n in "wxyz"}) == 1 and got["a"] != got["z"]


def test_poisoned_memory(spark):
    log = spark.createDataFrame([("m", "failure")] * 4 + [("m", "success"), ("n", "failure"), ("n", "failure")], "memory_id string, outcome string")
    got = {r["memory_id"]: (r["efficacy"], r["rejection"], r["poisoned"]) for r in evidence.efficacy(log).collect()}
    assert got == {"m": (0.2, 0.8, True), "n": (0.0, 1.0, False)}


def test_contradiction_cues(spark):
    cues = lambda a, b: one(spark, evidence.contradiction_cues(F.lit(a), F.lit(b)))
    assert cues("Enable the cache", "Disable the cache") == ["enable/disable"]
    assert cues("Use tabs", "Do not use tabs") == ["use/do not use", "not"]
    assert cues("Keep tabs", "Never notify, keep spaces") == ["not", "never"]
    assert cues("Keep " + "x" * 1000 + " mutable", "Keep immutable") == ["mutable/immutable"]


def test_replay_reward_and_backoff(spark):
    assert one(spark, sessions.replay_reward(F.lit(3), F.lit(4), F.lit(0.6))) == pytest.approx(0.705)
    assert [one(spark, errors.backoff_seconds(F.lit(n))) for n in (1, 2, 10)] == [1.0, 2.0, 300.0]


def test_signature_and_globs(spark):
    assert one(spark, errors.signature(F.lit('Error at /a/b.rs:12 in "main"  0xFF'))) == "error at <path>:<n> in <str> <hex>"
    hit = lambda glob, path: one(spark, F.lit(path).rlike(errors.glob_to_regex(glob)))
    assert hit("src/**/*.rs", "src/a/b/c.rs") and hit("src/**/*.rs", "src/c.rs") and not hit("src/*.rs", "src/a/c.rs")
    assert hit("*.py, *.rs", "x/y.rs") and hit("{a,b}.ts", "b.ts") and not hit("?.ts", "ab.ts")


def test_validity_and_branches(spark):
    rows = spark.sql("select * from values (1, date'2024-01-01', null, 'main'), (2, date'2024-01-01', date'2024-01-05', 'x'), (3, date'2024-02-01', null, null) t(id, valid_from, valid_until, branch)")
    at = F.lit("2024-01-05").cast("date")
    assert [r["id"] for r in rows.filter(temporal.active_at(at)).collect()] == [1]
    assert sorted(r["id"] for r in rows.filter(temporal.branch_visible("y")).collect()) == [1, 3]
    assert rows.filter(temporal.branch_visible("*")).count() == 3


def test_latest_row_wins(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, v int, s string")
    assert sorted(map(tuple, upserts.latest(log, "k", "v").collect())) == [("a", 3, "z"), ("b", 1, None)]


def test_futility_fold_by_hand():
    evidence_, recent, futile, seen = 0, [], False, []
    for signature in "AABCD":
        evidence_, recent, futile, verdict = futility.fold(evidence_, recent, futile, True, signature)
        seen.append((evidence_, verdict))
    assert seen == [(7, "Continue"), (17, "Continue"), (24, "Continue"), (31, "Futile"), (38, "StillFutile")]
    assert futility.fold(evidence_, recent, futile, False, "")[0] == 9


def test_stream_equals_batch(spark, tmp_path):
    rows = [(t, i, float(i), i % 4 != 3, "ABCD"[(i * 7) % 4]) for i in range(40) for t in ("p", "q")]
    schema = "task string, seq long, ts double, failed boolean, signature string"
    table = spark.createDataFrame(rows, schema)
    for part in range(2):
        table.filter((F.col("seq") >= 20) == bool(part)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = futility.futility_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    want = sorted(map(tuple, futility.futility_batch(table).collect()))
    assert sorted(map(tuple, spark.table("verdicts").collect())) == want


def test_changes_apply(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq long, v string")
    batch = spark.createDataFrame([("a", 2, "new", "upsert"), ("b", 3, "", "delete"), ("c", 1, "z", "upsert"), ("a", 0, "old", "upsert")], "k string, seq long, v string, op string")
    assert sorted(map(tuple, futility.apply_changes(batch, table, "k", "seq").collect())) == [("a", 2, "new"), ("c", 1, "z")]


def test_samples_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p", "c", "r", True), ("q", "d", "s", False)], files.SAMPLES["dpo"])
    files.export_samples(rows, str(tmp_path / "s"), require_verified=True)
    assert [tuple(r) for r in files.read_samples(spark, str(tmp_path / "s"), "dpo").collect()] == [("p", "c", "r", True)]
    (tmp_path / "log.txt").write_text("ok\nerror[E0308]: mismatched types --> src/a.rs:12\n")
    got = files.read_failures(spark, str(tmp_path / "log.txt")).first()
    assert (got["error_class"], got["file"], got["line"]) == ("error[E0308]", "src/a.rs", 12)


def test_budget_and_quotas(spark):
    rows = spark.createDataFrame([("g", i, "x" * 40) for i in range(5)], "g string, id int, t string")
    assert sorted(r["id"] for r in sessions.within_budget(rows, "g", [F.col("id")], "t", 25).collect()) == [0, 1]
    assert math.isclose(sessions.stratified(rows, "g", {"g": 2}, "id", "id").agg(F.sum("id")).first()[0], 7)


def test_statements_by_hand(spark):
    from tidepool.functions import statements as st

    say = lambda a, b: one(spark, st.decision(F.lit(a), F.lit(b)))
    assert say("The cache is warm", "A cache is warm!") == "noop"
    assert say("Timeout set to 30 seconds", "Timeout set to 45 seconds") == "update"
    assert say("Main database is postgres cluster", "Main database is sqlite file") == "update"
    assert say("Main database is postgres", "Retract: main database postgres") == "delete"
    assert say("Main database is postgres", "Deploy on Fridays only") == "add"
    assert one(spark, st.without_retraction(F.lit("Delete: tabs rule is obsolete"))) == "tabs rule"
    assert one(spark, st.same_path_end(F.lit("src/a.rs"), F.lit("a.rs"))) and not one(spark, st.same_path_end(F.lit("src/aa.rs"), F.lit("a.rs")))
    assert one(spark, st.normal_path(F.lit("./a\\\\b//c"))) == "a/b/c"
