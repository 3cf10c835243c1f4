"""Diagnosis stage: prompts, batch inference, response parsing, diagnosis records.

One row per failure window of any length. The model is a caller-supplied
callable ``call(system_prompt, user_prompt, max_tokens) -> str`` run inside
``mapInPandas`` (created once per partition, Arrow batches in and out); its
output is checkpointed to the shared checkpoint folder so a lost executor
never makes Spark call the model again for finished windows. A window too long
for one prompt is prompted in parts whose records are merged into one. Without
a callable, records come straight from the signature scores, JVM-side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.exprs import fence_body, fixed, round1, strip_ws, ts_text
from telemill.schema import DIAGNOSIS_JSON_SCHEMA
from telemill.session import checkpoint_dir

# ---------------------------------------------------------------------------
# Prompt texts and token budgets of the reference.
SYSTEM_PROMPT = """You are an expert manufacturing engineer specializing in laser cutting \
and welding equipment diagnostics. You analyze machine logs, sensor telemetry, and \
operator notes to identify failure modes, root causes, and recommend corrective actions.

You have deep knowledge of:
- Laser resonator and optical path systems
- CNC motion control and mechanical drive trains
- Assist gas delivery and pressure regulation
- Thermal management and coolant systems
- Material science and cutting parameter optimization

Always respond with structured JSON matching the requested schema. \
Be specific and actionable in your recommendations. Reference actual sensor \
values and operator observations in your reasoning."""

SINGLE_WINDOW_PROMPT = """Analyze the following failure window from machine {machine_id}.

**Failure Window:**
- Time range: {start} → {end} ({duration_minutes} min)
- Events: {event_count}
- Error codes: {error_codes}

**Log entries (chronological):**
{entries_json}

Respond with ONLY valid JSON in this exact schema:
{{
  "root_cause": "Brief description of the most likely root cause",
  "failure_mode": "One of: THERMAL | OPTICAL | PNEUMATIC | MECHANICAL | MATERIAL | ELECTRICAL | UNKNOWN",
  "confidence": 0.0 to 1.0,
  "severity_assessment": "One of: LOW | MEDIUM | HIGH | CRITICAL",
  "evidence": [
    "Specific observation from the logs supporting this diagnosis"
  ],
  "recommended_actions": [
    {{
      "action": "What to do",
      "priority": "IMMEDIATE | NEXT_SHIFT | SCHEDULED",
      "estimated_downtime_hours": 0.0
    }}
  ],
  "parts_at_risk": ["Component names that may need replacement"],
  "pattern_notes": "Any notable patterns in the sensor data or timing"
}}"""

BATCH_SUMMARY_PROMPT = """You have analyzed {num_windows} failure windows across the fleet. \
Here are the individual diagnoses:

{diagnoses_json}

Provide a fleet-level summary. Respond with ONLY valid JSON:
{{
  "executive_summary": "2-3 sentence overview of fleet health",
  "top_issues": [
    {{
      "issue": "Description",
      "affected_machines": ["machine IDs"],
      "frequency": "How often this occurs",
      "business_impact": "Production impact"
    }}
  ],
  "maintenance_priorities": [
    {{
      "action": "What to do",
      "machines": ["machine IDs"],
      "priority": "IMMEDIATE | THIS_WEEK | THIS_MONTH",
      "rationale": "Why this matters"
    }}
  ],
  "trend_alerts": [
    "Any emerging patterns that could become problems"
  ],
  "estimated_downtime_savings_hours": 0.0
}}"""

WINDOW_MAX_TOKENS = 2000
FLEET_MAX_TOKENS = 3000
# ---------------------------------------------------------------------------

ModelCall = Callable[[str, str, int], str]


def _template(text: str, names: list[str]) -> str:
    """Turn a ``str.format`` template into a ``format_string`` one (positional %n$s)."""
    out = text.replace("%", "%%")
    for i, n in enumerate(names, 1):
        out = out.replace("{" + n + "}", f"%{i}$s")
    return out.replace("{{", "{").replace("}}", "}")


_WINDOW_FIELDS = ["machine_id", "start", "end", "duration_minutes", "event_count", "error_codes", "entries_json"]
_FLEET_FIELDS = ["num_windows", "diagnoses_json"]


_ENTRIES_TITLE = "**Log entries (chronological):**"
#: Tasks that call the model at once, unless the caller says otherwise.
MODEL_PARTITIONS = 64
#: Diagnoses in one fleet prompt.
FLEET_ITEMS = 500


def window_prompts(prepared: DataFrame) -> DataFrame:
    """Fill the window template from ``prepared_windows(nested=True)`` rows.

    The entries are serialised with ``to_json`` (compact, NULLs kept) instead
    of an indented dump; the content is the same. A part of a longer window
    says which part it is.
    """
    entries_json = F.to_json("entries", {"ignoreNullFields": "false"})
    prompt = F.format_string(
        _template(SINGLE_WINDOW_PROMPT, _WINDOW_FIELDS),
        F.col("machine_id"), F.col("start"), F.col("end"), F.col("duration_minutes").cast("string"),
        F.col("event_count").cast("string"), F.array_join("error_codes", ", "), entries_json)
    titled = F.replace(prompt, F.lit(_ENTRIES_TITLE), F.format_string(
        "**Log entries (chronological, part %d of %d):**", F.col("part") + 1, F.col("parts")))
    return prepared.select("machine_id", "start", "end", "duration_minutes", "event_count",
                           "max_severity", "error_codes", "part", "parts",
                           F.when(F.col("parts") > 1, titled).otherwise(prompt).alias("prompt"))


def infer(prompts: DataFrame, call: ModelCall | Callable[[], ModelCall], key_cols: list[str],
          prompt_col: str = "prompt", max_tokens: int = WINDOW_MAX_TOKENS,
          system_prompt: str = SYSTEM_PROMPT, partitions: int = MODEL_PARTITIONS,
          factory: bool = False, persist: bool = True) -> DataFrame:
    """Batch inference: ``(keys, prompt) -> (keys, response)`` via ``mapInPandas``.

    Prompts are dealt by key to ``partitions`` tasks, which bounds parallel
    model calls and is the same on retry. ``factory=True`` means ``call``
    builds the client once per partition. The result is checkpointed
    (reliable, shared folder) when ``persist`` is set, so recomputation never
    calls the model again.
    """
    src = prompts.select(*key_cols, prompt_col).repartition(partitions, *key_cols)
    out_schema = T.StructType([f for f in src.schema.fields if f.name in key_cols]
                              + [T.StructField("response", T.StringType())])

    def run(batches):
        fn = call() if factory else call
        for pdf in batches:
            texts = [fn(system_prompt, p, max_tokens) if p is not None else None for p in pdf[prompt_col]]
            res = pdf[key_cols].copy()
            res["response"] = texts
            yield res

    out = src.mapInPandas(run, out_schema)
    if persist:
        checkpoint_dir(out.sparkSession)
        out = out.checkpoint(eager=True)
    return out


def parse_responses(df: DataFrame, schema: T.StructType = DIAGNOSIS_JSON_SCHEMA,
                    text_col: str = "response") -> DataFrame:
    """Fence removal, JSON parse, status: ``ok`` | ``model_error`` | ``parse_error``.

    The text must be exactly one JSON object: it is parsed as the only element
    of an array, so text after the object fails as it should. A parsed object
    with an ``error`` key is a model error. Lists are read as raw text and
    parsed each on its own later, so an ill-typed one doesn't cost the record.
    """
    # Stripped text, fence-free text and the parsed struct are named columns,
    # so each regex pass and the JSON parse run once per response.
    parsed = F.from_json(F.concat(F.lit("["), F.col("_clean"), F.lit("]")), T.ArrayType(schema),
                         {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    x = (df.withColumn("_stripped", strip_ws(F.col(text_col)))
           .withColumn("_clean", fence_body(F.col("_stripped"))).drop("_stripped")
           .withColumn("_list", parsed))
    bad = (F.col("_clean").isNull() | ~F.coalesce(F.col("_clean").startswith("{"), F.lit(False))
           | F.col("_list").isNull() | (F.size("_list") != 1) | F.json_object_keys("_clean").isNull())
    x = x.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    has_error = F.coalesce(F.array_contains(F.json_object_keys("_clean"), "error"), F.lit(False))
    status = F.when(F.col("_bad"), "parse_error").when(has_error, "model_error").otherwise("ok")
    return (x.withColumn("status", status).withColumn("_j", F.when(~F.col("_bad"), F.col("_list")[0]))
            .drop("_list", "_bad").withColumnRenamed("_clean", "clean_text"))


_TEXTS = "array<string>"
_RAW_ACTION = "array<struct<action:string,priority:string,estimated_downtime_hours:string>>"
_ACTION = "array<struct<action:string,priority:string,estimated_downtime_hours:double,estimated_downtime_text:string>>"


def _listed(raw: Column, failed: Column, kind: str) -> Column:
    """A list field from its raw JSON text; NULL, missing or ill-typed gives the empty list."""
    empty = F.array().cast(kind)
    return F.when(failed, empty).otherwise(F.coalesce(
        F.when(raw.startswith("["), F.from_json(raw, kind, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})), empty))


def to_diagnoses(parsed: DataFrame, key_cols: list[str]) -> DataFrame:
    """Diagnosis records with the reference's defaults; failures become UNKNOWN / 0.0."""
    failed = F.col("status") != "ok"
    j = F.col("_j")
    reason = (F.when(F.col("status") == "parse_error", F.lit("Failed to parse LLM response"))
              .otherwise(F.coalesce(j["error"], F.lit("None"))))
    actions = F.transform(
        _listed(j["recommended_actions"], failed, _RAW_ACTION),
        lambda a: F.struct(a["action"].alias("action"), a["priority"].alias("priority"),
                           a["estimated_downtime_hours"].try_cast("double").alias("estimated_downtime_hours"),
                           a["estimated_downtime_hours"].alias("estimated_downtime_text")))
    return parsed.select(
        *key_cols,
        F.when(failed, F.concat(F.lit("Analysis failed: "), reason))
         .otherwise(F.coalesce(j["root_cause"], F.lit("Unknown"))).alias("root_cause"),
        F.when(failed, "UNKNOWN").otherwise(F.coalesce(j["failure_mode"], F.lit("UNKNOWN"))).alias("failure_mode"),
        F.when(failed, 0.0).otherwise(F.coalesce(j["confidence"].try_cast("double"), F.lit(0.0))).alias("confidence"),
        F.when(failed, "UNKNOWN").otherwise(F.coalesce(j["severity_assessment"], F.lit("UNKNOWN")))
         .alias("severity_assessment"),
        _listed(j["evidence"], failed, _TEXTS).alias("evidence"),
        F.filter(actions, lambda a: a.isNotNull()).alias("recommended_actions"),
        _listed(j["parts_at_risk"], failed, _TEXTS).alias("parts_at_risk"),
        F.when(failed, "").otherwise(F.coalesce(j["pattern_notes"], F.lit(""))).alias("pattern_notes"),
        "status",
        F.coalesce(F.col("clean_text"), F.col("response")).alias("raw_response"),
    )


_SCALARS = ["root_cause", "failure_mode", "confidence", "severity_assessment", "status", "raw_response"]


def merge_parts(diagnoses: DataFrame, key_cols: list[str]) -> DataFrame:
    """One diagnosis per window from the diagnoses of its parts (column ``part``).

    The scalar fields come from the part that was read and is most confident
    (the earliest of equals); lists of all parts are joined in order, repeats
    once; notes are joined.
    """
    best = F.struct((F.col("status") == "ok").alias("ok"), F.col("confidence").alias("sure"),
                    (-F.col("part")).alias("early"), *_SCALARS)
    order = F.struct("part", "evidence", "recommended_actions", "parts_at_risk", "pattern_notes")
    g = diagnoses.groupBy(*key_cols).agg(F.max(best).alias("_best"), F.array_sort(F.collect_list(order)).alias("_parts"))

    def joined(name: str) -> Column:
        return F.array_distinct(F.flatten(F.transform("_parts", lambda p: p[name])))

    notes = F.array_join(F.filter(F.transform("_parts", lambda p: p["pattern_notes"]), lambda n: n != ""), " ")
    fields = {c: F.col(f"_best.{c}") for c in _SCALARS}
    fields |= {c: joined(c) for c in ("evidence", "recommended_actions", "parts_at_risk")} | {"pattern_notes": notes}
    return g.select(*key_cols, *[fields[c].alias(c) for c in (
        "root_cause", "failure_mode", "confidence", "severity_assessment", "evidence", "recommended_actions",
        "parts_at_risk", "pattern_notes", "status", "raw_response")])


def _signature_fields() -> list[Column]:
    """The fields of a record, from a window summary with its ``best_signature`` columns."""
    mode = F.col("failure_mode")
    known = mode != "UNKNOWN"
    critical = F.col("max_severity") == "CRITICAL"
    action = F.struct(
        F.concat(F.lit("Inspect the "), F.lower(mode), F.lit(" subsystem")).alias("action"),
        F.when(critical, "IMMEDIATE").otherwise("NEXT_SHIFT").alias("priority"),
        round1("(duration_minutes / 60D)").alias("estimated_downtime_hours"))
    return [
        F.when(known, F.concat(mode, F.lit(" signature: "), F.col("n_matched").cast("string"), F.lit(" of "),
                               F.col("n_considered").cast("string"), F.lit(" readings in range")))
         .otherwise(F.lit("No failure signature matched")).alias("root_cause"),
        mode.alias("failure_mode"),
        F.col("confidence").alias("confidence"),
        F.when(critical, "CRITICAL").otherwise("HIGH").alias("severity_assessment"),
        F.transform("error_codes", lambda c: F.concat(F.lit("error code "), c)).alias("evidence"),
        F.when(known, F.array(action)).otherwise(F.array().cast(
            "array<struct<action:string,priority:string,estimated_downtime_hours:double>>"))
         .alias("recommended_actions"),
        F.array().cast("array<string>").alias("parts_at_risk"),
        F.concat(F.col("event_count").cast("string"), F.lit(" events in "),
                 fixed("duration_minutes", 1), F.lit(" min")).alias("pattern_notes"),
    ]


def signature_responses(scored: DataFrame) -> DataFrame:
    """The signature record as a model would write it: JSON text in ``response``."""
    return scored.withColumn("response", F.to_json(F.struct(*_signature_fields())))


def signature_diagnoses(scored: DataFrame) -> DataFrame:
    """Diagnosis records straight from the signature scores, without a JSON round trip."""
    fields = _signature_fields()
    text = F.to_json(F.struct(*fields))
    out = scored.select("machine_id", ts_text("start").alias("start"), ts_text("end").alias("end"), *fields,
                        F.lit("ok").alias("status"), text.alias("raw_response"))
    actions = F.transform("recommended_actions", lambda a: F.struct(
        a["action"].alias("action"), a["priority"].alias("priority"),
        a["estimated_downtime_hours"].alias("estimated_downtime_hours"),
        a["estimated_downtime_hours"].cast("string").alias("estimated_downtime_text")))
    return out.withColumn("recommended_actions", actions)


def fleet_prompt_rows(diagnoses: DataFrame) -> DataFrame:
    """The six fields of each diagnosis that go into the fleet prompt."""
    return diagnoses.select(
        "machine_id", "start",
        F.concat(F.col("start"), F.lit(" → "), F.col("end")).alias("time_range"),
        "root_cause", "failure_mode", F.col("severity_assessment").alias("severity"),
        "recommended_actions")


def fleet_prompt(diagnoses: DataFrame, per_prompt: int = FLEET_ITEMS) -> DataFrame:
    """Fleet prompts over all diagnoses: (key, part, parts, num_windows, prompt).

    Up to ``per_prompt`` diagnoses make one prompt, the reference's. More are
    dealt by key into prompts of about that many, which say what part of the
    fleet they are (``fleet.fleet_tree`` prompts on with the replies until one
    is left). The diagnoses are counted first, so hand over a written table.
    """
    parts = max(1, -(-diagnoses.count() // per_prompt))
    item = F.struct("machine_id", "time_range", "root_cause", "failure_mode", "severity",
                    F.transform("recommended_actions", lambda a: F.struct(
                        a["action"].alias("action"), a["priority"].alias("priority"),
                        a["estimated_downtime_hours"].alias("estimated_downtime_hours"))).alias("recommended_actions"))
    part = F.pmod(F.xxhash64("machine_id", "start"), F.lit(parts)).cast("int")
    agg = (fleet_prompt_rows(diagnoses).groupBy(part.alias("part"))
           .agg(F.count(F.lit(1)).alias("num_windows"),
                F.array_sort(F.collect_list(F.struct("start", "machine_id", item.alias("d")))).alias("_l")))
    text = F.format_string(_template(BATCH_SUMMARY_PROMPT, _FLEET_FIELDS),
                           F.col("num_windows").cast("string"),
                           F.to_json(F.transform("_l", lambda e: e["d"]), {"ignoreNullFields": "false"}))
    if parts > 1:
        text = F.concat(F.format_string("Part %d of %d of the fleet's failure windows. ", F.col("part") + 1, F.lit(parts)), text)
    return agg.select(F.lit("fleet").alias("key"), "part", F.lit(parts).alias("parts"), "num_windows", text.alias("prompt"))


_ISSUES = "array<struct<issue:string,affected_machines:array<string>,frequency:string,business_impact:string>>"
_PRIORITIES = "array<struct<action:string,machines:array<string>,priority:string,rationale:string>>"


def to_fleet_summary(parsed: DataFrame, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """Fleet record with defaults; failures give 'Summary generation failed: ...'."""
    failed = F.col("status") != "ok"
    j = F.col("_j")
    reason = (F.when(F.col("status") == "parse_error", F.lit("Failed to parse LLM response"))
              .otherwise(F.coalesce(j["error"], F.lit("None"))))
    return parsed.select(
        *key_cols,
        F.when(failed, F.concat(F.lit("Summary generation failed: "), reason))
         .otherwise(F.coalesce(j["executive_summary"], F.lit(""))).alias("executive_summary"),
        _listed(j["top_issues"], failed, _ISSUES).alias("top_issues"),
        _listed(j["maintenance_priorities"], failed, _PRIORITIES).alias("maintenance_priorities"),
        _listed(j["trend_alerts"], failed, _TEXTS).alias("trend_alerts"),
        F.when(failed, 0.0).otherwise(F.coalesce(j["estimated_downtime_savings_hours"].try_cast("double"),
                                                 F.lit(0.0))).alias("estimated_downtime_savings_hours"),
        "status",
        F.coalesce(F.col("clean_text"), F.col("response")).alias("raw_response"),
    )


def fleet_issues(diagnoses: DataFrame) -> DataFrame:
    """Issue table over all diagnoses, one row per failure mode: windows, machines, mean confidence, critical
    windows, hours of the recommended actions. The machines are rows of ``fleet_issue_machines``."""
    hours = F.aggregate("recommended_actions", F.lit(0.0),
                        lambda acc, a: acc + F.coalesce(a["estimated_downtime_hours"], F.lit(0.0)))
    per_machine = (diagnoses.withColumn("_hours", hours).groupBy("failure_mode", "machine_id")
                   .agg(F.count(F.lit(1)).alias("_n"), F.sum("confidence").alias("_c"), F.sum("_hours").alias("_h"),
                        F.count(F.when(F.col("severity_assessment") == "CRITICAL", F.lit(1))).alias("_k")))
    return (per_machine.groupBy("failure_mode")
            .agg(F.sum("_n").alias("n_windows"), F.count("machine_id").alias("n_machines"),
                 (F.sum("_c") / F.sum("_n")).alias("mean_confidence"), F.sum("_k").alias("n_critical"),
                 F.sum("_h").alias("hours")))


def fleet_issue_machines(diagnoses: DataFrame) -> DataFrame:
    """(failure_mode, machine_id, n_windows): the machines behind each issue, a row each."""
    return diagnoses.groupBy("failure_mode", "machine_id").agg(F.count(F.lit(1)).alias("n_windows"))


def scored_windows(entries: DataFrame) -> DataFrame:
    """Window summaries and signature scores from ONE aggregation of the entries."""
    from telemill.operators.catalog import best_signature, signature_aggs
    from telemill.operators.sessions import summarize_windows

    w = summarize_windows(entries, signature_aggs())
    keep = [c for c in w.columns if "__" not in c]
    return w.select(*keep, *best_signature())


def diagnose(logs: DataFrame, call: ModelCall | None = None, max_windows: int | None = None,
             factory: bool = False, partitions: int = MODEL_PARTITIONS, part_entries: int | None = None,
             replies_path: str | None = None) -> DataFrame:
    """One diagnosis per failure window; ``max_windows`` keeps the earliest ones, None all.

    Without ``call`` records come from the signature scores. With a model
    ``call`` windows are prompted (in parts where they have over
    ``part_entries`` entries), the responses checkpointed, parsed and merged.
    """
    from telemill.operators.sessions import DEFAULT_PROMPT_ENTRIES, first_windows, prepared_windows, window_entries

    keys = ["machine_id", "start", "end"]
    if call is None:
        return signature_diagnoses(first_windows(scored_windows(window_entries(logs)), max_windows))
    prompts = window_prompts(prepared_windows(logs, max_windows, part_entries=part_entries or DEFAULT_PROMPT_ENTRIES))
    if replies_path:
        from telemill.operators.replies import resumable_replies
        responses = resumable_replies(prompts, call, [*keys, "part"], replies_path, factory=factory, partitions=partitions)
    else:
        responses = infer(prompts, call, [*keys, "part"], factory=factory, partitions=partitions)
    return merge_parts(to_diagnoses(parse_responses(responses), [*keys, "part"]), keys)
