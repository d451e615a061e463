"""Contexts, eligibility, attribution, tool results, roles, corrections, links and chunks in small known cases."""

from datetime import datetime

from pyspark.sql import functions as F

from evimem.operators import context as C
from evimem.operators import links as K

T0 = datetime(2024, 1, 1)
RECORD = "id string, context_mode string, scope map<string,string>, entities array<string>, preconditions map<string,string>, systems array<string>, versions array<string>"


def asked(spark, rows):
    none = F.array().cast("array<string>")
    return spark.createDataFrame(rows, RECORD).withColumns(
        {
            "query": F.lit("restart the gateway on v1"),
            "asked_scope": F.expr("map('project', 'Keen-Tracer', 'environment', 'production')"),
            "asked_state": F.expr("map('mode', 'not enabled')"),
            "asked_entities": F.array(F.lit("Mira")),
            "asked_systems": F.array(F.lit("router d")),
            "asked_versions": none,
        }
    )


def test_the_gate_is_strict(spark):
    dep = "context_dependent"
    rows = [
        ("case and signs", dep, {"project": "keen tracer"}, [], {}, [], []),
        ("part of a word", dep, {"environment": "nonproduction"}, [], {}, [], []),
        ("other order", dep, {"project": "tracer keen"}, [], {}, [], []),
        ("precondition", dep, {}, [], {"mode": "enabled"}, [], []),
        ("system", dep, {}, [], {}, ["Router-D"], []),
        ("other system", dep, {}, [], {}, ["router"], []),
        ("version in the query", dep, {}, [], {}, [], ["V1"]),
        ("longer version", dep, {}, [], {}, [], ["v10"]),
        ("entity", dep, {}, ["mira"], {}, [], []),
        ("other entity", dep, {}, ["tuva"], {}, [], []),
        ("nothing required", dep, None, None, None, None, None),
        ("standalone", "standalone", {"environment": "staging"}, [], {}, [], []),
        ("no mode", None, {"environment": "staging"}, [], {}, [], []),
        ("goal", dep, {"goal": "restart"}, [], {}, [], []),
    ]
    got = {r["id"]: r["gate"] for r in C.context_match(asked(spark, rows)).collect()}
    assert {k for k, v in got.items() if v == 1} == {"case and signs", "other order", "system", "version in the query", "entity", "standalone", "no mode"}
    likely = C.context_match(asked(spark, rows[-1:]).withColumn("goal_likeness", F.lit(0.6)))
    assert [r["gate"] for r in likely.collect()] == [1]
    one = C.context_match(asked(spark, [("a", dep, {"project": "keen tracer", "environment": "staging"}, ["mira", "tuva"], {}, [], [])])).collect()[0]
    assert (one["scope_match"], one["entity_match"], one["completeness"]) == (0.5, 0.5, 0.5)
    assert one["boost"] == round(0.08 + 0.05 * 0.5 + 0.07 * 0.5 + 0.05 * 0.5, 6)
    assert C.context_match(asked(spark, rows).where("false")).collect() == []


def test_eligibility(spark):
    m = spark.createDataFrame([(k, s) for k, s in (("a", "active"), ("b", "cold"), ("c", "archived"), ("d", "quarantine"), ("e", "active"), ("f", "active"), ("g", "active"))], "id string, state string")
    members = [(k, "live", "primary", None) for k in "abcd"] + [("a", "live", "primary", None), ("e", "live", "evidence_only", None), ("f", "live", "primary", T0), ("unknown", "live", "primary", None), ("g", "other", "primary", None)]
    ms = spark.createDataFrame(members, "memory_id string, recall_set_id string, eligibility string, revoked_at timestamp_ntz")
    ids = lambda **k: sorted(r["id"] for r in C.eligible(m, ms, "live", **k).collect())
    assert ids() == ["a", "b"] and ids(evidence_lookup=True) == ["a", "b", "e"] and ids(include_archived=True) == ["a", "b", "c"]


def test_trust(spark):
    row = {"confidence": 0.9, "trust": 0.9, "currentness": 0.9, "utility": 0.8, "relevance": 0.9, "stale_risk": 0.0, "wrong_rate": 0.0, "source_prior": 0.9, "positive": 4, "negative": 0, "dirty": False, "superseded": False, "state": "active"}
    rows = [row, row | {"dirty": True, "state": "cold"}, row | {"confidence": 0.2, "relevance": 0.0, "wrong_rate": 1.0, "superseded": True, "dirty": None}]
    got = [(r["probability"], r["decision"]) for r in C.assessed(spark.createDataFrame(rows)).collect()]
    p = 0.2 * 0.9 + 0.16 * 0.9 + 0.14 * 0.9 + 0.13 * 0.8 + 0.13 * 0.9 + 0.1 + 0.08 * 0.9 + 0.06 * 0.75
    assert got[0] == (round(p, 6), "use") and got[1] == (round(p - 0.19, 6), "verify") and got[2][1] == "abstain"


def test_attribution(spark):
    rows = [
        ("The port is 8443.", "It listens on the port 8443 now.", None, 0.0),
        ("The owner of it is docs.", "ask Mira Stone", "mira stone", 0.0),
        ("Paint the old fence green.", "Nothing of the kind was said.", None, 0.9),
        ("", "an answer", None, 1.0),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "content string, response string, object_value string, similarity double")
    got = [r["attribution"] for r in C.attributed(df).collect()]
    assert got[0] >= 0.88 and got[1] == 1.0 and got[2] == 0.17 and got[3:] == [0.0, 0.0]


def test_tool_results(spark):
    cases = [
        ('{"exit_code": 1, "success": true}', True),
        ('{"success": true, "note": "error: none"}', False),
        ('{"ok": false}', True),
        ('{"status": "Failed"}', True),
        ('{"error": ""}', False),
        ('{"error": "no"}', True),
        ('{"success": true}\n{"ok": false}', False),
        ("Traceback: x", True),
        ("all error free", False),
        ("permission denied", True),
        ("", False),
        (None, False),
    ]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", C.result_failed(F.col("t"))).collect())
    calls = [("s1", 1, "read", '{"path": "a", "mode": 1}', "ok"), ("s1", 0, "find", "{}", "ok"), ("s2", 0, "find", "{}", "ok"), ("s2", 1, "read", '{"mode": 2, "path": "b"}', "ok"), ("s3", 0, "find", "no json", "fatal: timed out")]
    got = {r["session_id"]: r for r in C.workflows(spark.createDataFrame(calls, "session_id string, step int, tool string, arguments string, result string")).collect()}
    assert got["s1"]["workflow_key"] == got["s2"]["workflow_key"] != got["s3"]["workflow_key"]
    assert (got["s3"]["success"], got["s3"]["error_type"], got["s1"]["steps"]) == (False, "timeout", 2)


def test_roles(spark):
    rows = [
        ("```x = 1```", "semantic", "conversation", "USER_EXPLICIT", None, "reference"),
        ("a | b |\n|---|---|\n| 1 | 2 |", "semantic", "conversation", "USER_EXPLICIT", None, "reference"),
        ("plain words", "semantic", "vault_markdown", "USER_EXPLICIT", None, "reference"),
        ("plain words", "preference", "conversation", "USER_EXPLICIT", None, "canonical"),
        ("plain words", "episode", "conversation", "AGENT_INFERENCE", None, "event"),
        ("plain words", "semantic", "conversation", "AGENT_INFERENCE", None, "claim"),
        ("plain words", "semantic", "conversation", "AGENT_INFERENCE", True, "canonical"),
        ('{"a": [1, 2]}', "semantic", "conversation", "TOOL_VERIFIED", None, "reference"),
        ("host: a port: 1 user: b", "semantic", "conversation", None, None, "reference"),
        (None, None, None, None, None, "canonical"),
    ]
    df = spark.createDataFrame(rows, "content string, kind string, source_type string, source_category string, supported boolean, want string")
    assert [(r["content"], r["role"]) for r in C.record_role(df).collect()] == [(r[0], r[5]) for r in rows]


def test_corrections_append(spark):
    day = lambda n: datetime(2024, 1, 1 + n)
    v = spark.createDataFrame([("m", 1, "a", "active", 0.4, day(0), None, day(0)), ("m", 2, "b", "active", 0.3, day(3), None, day(4))], "memory_id string, version_id bigint, content string, state string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, system_from timestamp_ntz")
    c = spark.createDataFrame([("m", 8, "c", day(6)), ("m", 9, "d", day(9)), ("new", 5, "x", day(2)), (None, 6, "y", day(2))], "memory_id string, version_id bigint, content string, at timestamp_ntz")
    got = {(r["memory_id"], r["version_id"]): (r["content"], r["confidence"], r["valid_from"], r["valid_to"], r["reason"]) for r in C.corrected(v, c).collect()}
    assert got == {
        ("m", 2): ("b", 0.3, day(3), day(6), "closed"),
        ("m", 8): ("c", 0.55, day(6), day(9), "correction"),
        ("m", 9): ("d", 0.55, day(9), None, "correction"),
        ("new", 5): ("x", 0.55, day(2), None, "correction"),
    }
    wanted = spark.createDataFrame([("m", "cold", day(7)), ("m", "active", day(7)), ("none", "cold", day(7))], "memory_id string, state string, at timestamp_ntz")
    assert [(r["version_id"], r["before"], r["state"]) for r in C.state_changes(v, wanted).collect()] == [(2, "active", "cold")]


def test_arms_are_balanced(spark):
    rows = spark.createDataFrame([(f"{k:04d}", "ab"[k % 7 == 0], k) for k in range(500)], "id string, kind string, n int").repartition(4)
    got = C.balanced(rows, ["kind"], ["x", "y", "z"], [F.col("n")], "id", "e").orderBy("n").collect()
    seen: dict = {}
    for r in got:
        counts = seen.setdefault(r["kind"], {"x": 0, "y": 0, "z": 0})
        counts[r["arm"]] += 1
        assert max(counts.values()) - min(counts.values()) <= 1
    assert len(got) == 500


def test_groups_are_numbered_over_partitions(spark):
    rows = spark.createDataFrame([("hot" if k % 3 else None, k) for k in range(300)], "g string, k int").repartition(5)
    got = {(r["g"], r["k"]): r["n"] for r in K.numbered(rows, ["g"], [F.desc("k")], "n").collect()}
    for g, keep in (("hot", lambda k: k % 3), (None, lambda k: not k % 3)):
        ordered = [k for k in range(299, -1, -1) if keep(k)]
        assert [got[g, k] for k in ordered] == list(range(1, len(ordered) + 1))


def test_links_and_chunks(spark):
    notes = spark.createDataFrame([("1", "x/Plan.md", "The plan"), ("2", "y/plan.md", "Other"), ("3", "z/home.md", None), ("4", "home.md", "plan")], "id string, path string, title string")
    links = spark.createDataFrame([("3", "plan"), ("3", "Plan#part|label"), ("1", "z/home"), ("2", "nowhere"), ("4", "home"), ("2", "the PLAN")], "id string, target string")
    # of the two files named plan the one with the least path; a name that is a path comes before file names
    assert sorted(tuple(r) for r in C.resolved_links(links, notes).collect()) == [("1", "2"), ("1", "3")]
    old = spark.createDataFrame([("n", 0, "a", "k0"), ("n", 1, "b", "k1"), ("n", 2, "c", "k2"), ("n", 3, "d", "k3")], "path string, place int, hash string, key string")
    new = spark.createDataFrame([("n", 0, "a"), ("n", 1, "c"), ("n", 2, "x"), ("m", 0, "a")], "path string, place int, hash string")
    got = {(r["path"], r["place"], r["action"]): r["key"] for r in C.reconciled_chunks(old, new).collect()}
    fresh = got.pop(("m", 0, "add"))
    assert fresh not in {"k0", "k1", "k2", "k3"}
    assert got == {("n", 0, "keep"): "k0", ("n", 1, "move"): "k2", ("n", 2, "add"): got[("n", 2, "add")], ("n", 1, "remove"): "k1", ("n", 3, "remove"): "k3"}


def test_labels_taken_back(spark):
    rows = [("1", "t", "helpful", 1, None), ("2", "t", "harmful", 2, 5), ("3", "u", "helpful", 1, 2), ("4", "v", "ignored", 1, None), ("5", "v", "validated", 1, None)]
    df = spark.createDataFrame(rows, "label_id string, task_id string, outcome string, created_at int, reversed_at int")
    assert {tuple(r) for r in C.standing_labels(df, ["task_id"]).collect()} == {("t", "helpful", 1), ("v", "validated", 2)}
