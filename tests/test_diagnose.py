import json
import os
import sys

import pytest
from pyspark import cloudpickle

from conftest import SF001, at, make_logs
from telemill.operators import diagnose, sessions
from telemill.plans.analyze import fleet_summary
from telemill.sources.events_adapter import load_machine_logs

# Model stand-ins below travel to Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FENCE = "```"
OK = '{"root_cause":"x","confidence":0.5}'

# (response, failed, root_cause prefix, confidence)
CASES = [
    (OK, False, "x", 0.5),
    (f"{FENCE}json\n{OK}\n{FENCE}", False, "x", 0.5),
    (f"  {FENCE}\n{OK}\n", False, "x", 0.5),
    (f"{FENCE}{OK}{FENCE}", True, "Analysis failed:", 0.0),
    ("not json", True, "Analysis failed:", 0.0),
    ("", True, "Analysis failed:", 0.0),
    (None, True, "Analysis failed:", 0.0),
    ("[1]", True, "Analysis failed:", 0.0),
    ('{"a":1,', True, "Analysis failed:", 0.0),
    ("{'a':1}", True, "Analysis failed:", 0.0),
    ('{"a":1} trailing', True, "Analysis failed:", 0.0),
    ('{"error":"boom"}', True, "Analysis failed: boom", 0.0),
    ('{"error":null}', True, "Analysis failed: None", 0.0),
    ('{"confidence":"high","root_cause":"k"}', False, "k", 0.0),
    ('{"evidence":"one","root_cause":"r"}', False, "r", 0.0),
    ('{"recommended_actions":["x"],"root_cause":"r","confidence":0.75}', False, "r", 0.75),
    ('{"root_cause":"a"}{"x":1}', True, "Analysis failed:", 0.0),
    ('{"root_cause":"a"},{"root_cause":"b"}', True, "Analysis failed:", 0.0),
    ('{"root_cause":"a"}}', True, "Analysis failed:", 0.0),
    ('{"root_cause":"a"} junk}', True, "Analysis failed:", 0.0),
    ('{}', False, "Unknown", 0.0),
]


def _diag(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, response string")
    return {r["id"]: r for r in diagnose.to_diagnoses(diagnose.parse_responses(df), ["id"]).collect()}


def test_f7_parse_table(spark):
    out = _diag(spark, [c[0] for c in CASES])
    for i, (text, failed, root, conf) in enumerate(CASES):
        d = out[i]
        assert (d["status"] != "ok") is failed, text
        assert d["root_cause"].startswith(root), (text, d["root_cause"])
        assert d["confidence"] == conf, text
        if failed:
            assert d["failure_mode"] == "UNKNOWN" and d["evidence"] == [] and d["recommended_actions"] == []
    ok = out[0]
    assert (ok["failure_mode"], ok["severity_assessment"], ok["pattern_notes"]) == ("UNKNOWN", "UNKNOWN", "")


def test_f7_actions(spark):
    out = _diag(spark, ['{"recommended_actions":[{"action":"a"}]}',
                        '{"recommended_actions":[{"action":"a","estimated_downtime_hours":"2-4"}]}',
                        '{"recommended_actions":[{"action":"a","priority":"IMMEDIATE","estimated_downtime_hours":2.5}]}'])
    a0 = out[0]["recommended_actions"][0]
    assert (a0["action"], a0["priority"], a0["estimated_downtime_hours"]) == ("a", None, None)
    a1 = out[1]["recommended_actions"][0]
    assert a1["estimated_downtime_hours"] is None and a1["estimated_downtime_text"] == "2-4"
    a2 = out[2]["recommended_actions"][0]
    assert a2["estimated_downtime_hours"] == 2.5 and a2["priority"] == "IMMEDIATE"


class FakeModel:
    """Stands in for a provider client: answers each prompt with a fenced JSON diagnosis."""

    calls = 0

    def __call__(self, system, prompt, max_tokens):
        assert "Analyze the following failure window" in prompt and max_tokens in (2000, 3000)
        body = {"root_cause": "coolant", "failure_mode": "THERMAL", "confidence": 0.9,
                "severity_assessment": "HIGH", "evidence": ["temp high"],
                "recommended_actions": [{"action": "replace pump", "priority": "IMMEDIATE",
                                         "estimated_downtime_hours": 4}],
                "parts_at_risk": ["pump"], "pattern_notes": "n"}
        return "```json\n" + json.dumps(body) + "\n```"


def test_infer_with_model_callable(spark):
    logs = load_machine_logs(spark, SF001)
    d = diagnose.diagnose(logs, call=FakeModel(), max_windows=3).collect()
    assert len(d) == 3
    assert all(r["status"] == "ok" and r["failure_mode"] == "THERMAL" and r["confidence"] == 0.9 for r in d)
    assert d[0]["recommended_actions"][0]["estimated_downtime_text"] == "4"
    prompts = diagnose.window_prompts(sessions.prepared_windows(logs, 3)).collect()
    p = prompts[0]["prompt"]
    assert f"from machine {prompts[0]['machine_id']}." in p and '"severity":' in p and "{{" not in p
    assert "(chronological):**" in p


def _storm(spark):
    """One window of 5,000 entries and three short ones."""
    rows = [dict(timestamp=at(seconds=i), machine_id="A", severity="ERROR", error_code="E-201") for i in range(5000)]
    rows += [dict(timestamp=at(hours=5 + k), machine_id=m, severity="CRITICAL", error_code="E-301")
             for k, m in enumerate("BCD")]
    return make_logs(spark, rows)


class CountingModel(FakeModel):
    """Leaves a file for each call."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, system, prompt, max_tokens):
        import os
        import uuid
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w", encoding="utf-8") as f:
            f.write(prompt)
        return super().__call__(system, prompt, max_tokens)


def test_one_diagnosis_for_each_window_of_any_size(spark, tmpdir_path):
    logs = _storm(spark)
    d = diagnose.diagnose(logs, call=CountingModel(tmpdir_path), max_windows=4)
    assert sorted(r["machine_id"] for r in d.collect()) == ["A", "B", "C", "D"]
    texts = [open(os.path.join(tmpdir_path, f), encoding="utf-8").read() for f in os.listdir(tmpdir_path)]
    assert len(texts) == 3 + 3  # the storm in three parts
    assert sum("part 2 of 3" in t for t in texts) == 1
    p = diagnose.fleet_prompt(d).collect()
    assert len(p) == 1 and p[0]["num_windows"] == 4 and all(f'"machine_id":"{m}"' in p[0]["prompt"] for m in "ABCD")
    assert diagnose.diagnose(logs, call=FakeModel(), max_windows=None).count() == 4
    assert diagnose.diagnose(logs, max_windows=None).count() == 4 and diagnose.diagnose(logs, max_windows=2).count() == 2


def test_model_calls_run_in_parallel_and_once(spark, tmpdir_path):
    prompts = spark.createDataFrame([(i, "Analyze the following failure window") for i in range(200)], "id int, prompt string")
    out = diagnose.infer(prompts, CountingModel(tmpdir_path), ["id"], partitions=8)
    assert out.count() == 200 and len(os.listdir(tmpdir_path)) == 200
    used = out.rdd.glom().map(len).filter(lambda n: n > 0).count()
    assert used > 1


def test_merge_parts_prefers_the_confident_part(spark):
    rows = [("w", 0, "ok", '{"root_cause":"a","confidence":0.4,"evidence":["e1"],"pattern_notes":"n1"}'),
            ("w", 1, "ok", '{"root_cause":"b","confidence":0.9,"evidence":["e1","e2"],"pattern_notes":"n2"}'),
            ("w", 2, "bad", "no json"), ("v", 0, "bad", "no json")]
    df = spark.createDataFrame([(w, p, t) for w, p, _, t in rows], "k string, part int, response string")
    m = {r["k"]: r for r in diagnose.merge_parts(
        diagnose.to_diagnoses(diagnose.parse_responses(df), ["k", "part"]), ["k"]).collect()}
    assert (m["w"]["root_cause"], m["w"]["evidence"], m["w"]["pattern_notes"]) == ("b", ["e1", "e2"], "n1 n2")
    assert m["v"]["status"] == "parse_error" and m["v"]["root_cause"].startswith("Analysis failed")


def test_fleet_summary_paths(spark):
    logs = load_machine_logs(spark, SF001)
    diags = diagnose.diagnose(logs)
    n = diags.count()
    offline = fleet_summary(diags).first()
    assert offline["status"] == "ok" and "failure windows analysed" in offline["executive_summary"]
    one = diagnose.fleet_prompt(diags).collect()
    assert len(one) == 1 and one[0]["num_windows"] == n and one[0]["prompt"].startswith(f"You have analyzed {n} ")
    several = diagnose.fleet_prompt(diags, per_prompt=20).collect()
    assert len(several) > 1 and sum(r["num_windows"] for r in several) == n
    assert all(r["prompt"].startswith(f"Part {r['part'] + 1} of {r['parts']} ") for r in several)

    def fleet_call(system, prompt, max_tokens):
        return json.dumps({"executive_summary": "ok", "top_issues": [{"issue": "i", "affected_machines": ["M-1"]}],
                           "estimated_downtime_savings_hours": "7.5"})

    f = fleet_summary(diags, fleet_call).collect()
    assert len(f) == 1 and f[0]["executive_summary"] == "ok" and f[0]["estimated_downtime_savings_hours"] == 7.5
    assert f[0]["top_issues"][0]["affected_machines"] == ["M-1"] and f[0]["trend_alerts"] == []


def _listed(prompt):
    return json.loads(prompt[prompt.index("individual diagnoses:") + 21:prompt.index("Provide a fleet-level")])


def test_fleet_tree_is_one_summary_of_many_windows(spark, tmpdir_path):
    """10**5 diagnoses: no prompt over its number of records, one issue a name, nothing counted twice."""
    from telemill.operators import fleet
    from telemill.plans.registry import _rule_fleet_model
    d = spark.range(100_000, numPartitions=8).selectExpr(
        "concat('M-', id % 30) AS machine_id", "concat('2025-01-01 ', id) AS start", "'x' AS end", "'c' AS root_cause",
        "concat('MODE', id % 7) AS failure_mode", "'HIGH' AS severity_assessment",
        "array(named_struct('action', 'a', 'priority', 'p', 'estimated_downtime_hours', 0.5D)) AS recommended_actions")
    rule = _rule_fleet_model()

    def call(system, prompt, max_tokens):
        items = _listed(prompt)
        limit = 20 if "executive_summary" in items[0] else diagnose.FLEET_ITEMS
        assert len(items) <= limit
        return rule(system, prompt, max_tokens)

    r = fleet.fleet_tree(d, call, partitions=8).collect()
    assert len(r) == 1 and r[0]["levels"] == 3 and r[0]["num_windows"] == 100_000 and r[0]["failed_parts"] == 0
    assert [(i["issue"], int(i["frequency"])) for i in r[0]["top_issues"]] == [(f"MODE{k}", 14_286 if k < 5 else 14_285) for k in range(7)]
    assert r[0]["estimated_downtime_savings_hours"] == 50_000.0


def test_fleet_tree_leaves_unreadable_parts_out(spark):
    from telemill.operators import fleet
    d = spark.range(40).selectExpr("concat('M-', id) AS machine_id", "cast(id AS string) AS start", "'x' AS end", "'c' AS root_cause",
                                   "'T' AS failure_mode", "'HIGH' AS severity_assessment",
                                   "cast(array() AS array<struct<action:string,priority:string,estimated_downtime_hours:double>>) AS recommended_actions")

    def call(system, prompt, max_tokens):
        items = _listed(prompt)
        if any(i.get("machine_id") == "M-3" for i in items):
            return "nothing to read"
        return json.dumps({"executive_summary": f"{len(items)} items"})

    r = fleet.fleet_tree(d, call, per_prompt=10, fan_in=30, partitions=2).first()
    assert r["failed_parts"] == 1 and r["status"] == "ok" and r["levels"] == 2 and r["num_windows"] < 40
    bad = fleet.fleet_tree(d, lambda *a: "?", per_prompt=50, partitions=2).collect()
    assert len(bad) == 1 and bad[0]["status"] == "parse_error"
    assert fleet.fleet_tree(d.limit(0), call, partitions=2).count() == 0


def test_a_stopped_model_run_is_taken_up(spark, tmpdir_path):
    """A model that fails in the third batch: the next run asks for nothing that was committed."""
    from telemill.operators.replies import resumable_replies
    calls, table = os.path.join(tmpdir_path, "calls"), os.path.join(tmpdir_path, "replies")
    os.makedirs(calls)
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(40)] + [(40, None)], "id int, prompt string")

    def model(limit):
        def call(system, prompt, max_tokens):
            if len(os.listdir(calls)) >= limit:
                raise RuntimeError("stopped")
            with open(os.path.join(calls, prompt.split()[-1] + "-" + os.urandom(4).hex()), "w"):
                return prompt.upper()
        return call

    with pytest.raises(Exception, match="stopped"):
        resumable_replies(prompts, model(25), ["id"], table, batch_prompts=8, partitions=2)
    done = {r["id"] for r in spark.read.parquet(table).collect()}
    before = len(os.listdir(calls))
    assert 8 <= len(done) < 40 and before >= len(done - {40})
    out = resumable_replies(prompts, model(10 ** 6), ["id"], table, batch_prompts=8, partitions=2)
    assert {r["id"]: r["response"] for r in out.collect()} == {**{i: f"PROMPT {i}" for i in range(40)}, 40: None}
    asked = [f.split("-")[0] for f in os.listdir(calls)]
    assert all(asked.count(str(i)) == 1 for i in done - {40})
    n = len(asked)
    assert resumable_replies(prompts, model(0), ["id"], table, partitions=2).count() == 41 and len(os.listdir(calls)) == n
    changed = prompts.replace("prompt 7", "prompt 7 and more 7")
    again = resumable_replies(changed, model(10 ** 6), ["id"], table, partitions=2)
    assert again.where("id = 7").first()["response"] == "PROMPT 7 AND MORE 7" and len(os.listdir(calls)) == n + 1


def test_signature_responder_round_trip(spark):
    logs = make_logs(spark, [dict(timestamp=at(0), machine_id="A", severity="CRITICAL", error_code="E-201",
                                  temperature_c=60.0, laser_power_w=2400.0, coolant_flow_lpm=4.0,
                                  feed_rate_mm_min=2000.0)])
    d = diagnose.diagnose(logs).first()
    assert (d["failure_mode"], d["confidence"], d["severity_assessment"]) == ("THERMAL", 1.0, "CRITICAL")
    assert d["recommended_actions"][0]["priority"] == "IMMEDIATE"
    assert d["evidence"] == ["error code E-201"]


@pytest.mark.parametrize("tmpl", [diagnose.SINGLE_WINDOW_PROMPT, diagnose.BATCH_SUMMARY_PROMPT])
def test_template_conversion_keeps_text(tmpl):
    names = diagnose._WINDOW_FIELDS if "machine_id" in tmpl else diagnose._FLEET_FIELDS
    conv = diagnose._template(tmpl, names)
    assert "{{" not in conv and all("{" + n + "}" not in conv for n in names)
