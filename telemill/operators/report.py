"""Report tables and Markdown text as Spark rows.

Each diagnosis becomes one text row built with ``concat_ws`` (which skips
NULL parts, so empty blocks vanish). The assembled report is a set of
``(section_ord, ord, tie, text)`` rows; only the final text sink orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.exprs import epoch_us_sql, fixed

# ---------------------------------------------------------------------------
# Report badges by severity and by priority.
SEVERITY_BADGES = {
    "CRITICAL": "🔴 CRITICAL",
    "HIGH": "🟠 HIGH",
    "MEDIUM": "🟡 MEDIUM",
    "LOW": "🟢 LOW",
}
PRIORITY_BADGES = {
    "IMMEDIATE": "⚡ IMMEDIATE",
    "NEXT_SHIFT": "📋 NEXT SHIFT",
    "SCHEDULED": "📅 SCHEDULED",
    "THIS_WEEK": "📋 THIS WEEK",
    "THIS_MONTH": "📅 THIS MONTH",
}
REPORT_TITLE = "# Manufacturing Log Diagnostic Report"
STATS_HEAD = ["## Dataset Overview", "", "| Metric | Value |", "|--------|-------|"]
DETAILS_HEAD = ["## Detailed Failure Analysis", ""]
FIELDS_HEAD = ["| Field | Value |", "|-------|-------|"]
EVIDENCE_HEAD = ["**Evidence:**"]
ACTIONS_HEAD = ["**Recommended Actions:**", "", "| Priority | Action | Est. Downtime |",
                "|----------|--------|---------------|"]
FLEET_HEAD = ["## Fleet Summary", ""]
ISSUES_HEAD = ["### Top Issues", ""]
PRIORITIES_HEAD = ["### Maintenance Priorities", "", "| Priority | Action | Machines | Rationale |",
                   "|----------|--------|----------|-----------|"]
ALERTS_HEAD = ["### Trend Alerts", ""]
SAVINGS = ("**Estimated Downtime Savings:** ", " hours (if all recommended actions are completed)")
# ---------------------------------------------------------------------------


def _lookup(table: dict[str, str], key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.element_at(m, key)


def severity_badge(c: Column) -> Column:
    return F.coalesce(_lookup(SEVERITY_BADGES, c), F.concat(F.lit("⚪ "), F.coalesce(c, F.lit("None"))))


def priority_badge(c: Column) -> Column:
    return F.coalesce(_lookup(PRIORITY_BADGES, c), c, F.lit(""))


def percent0(c: Column) -> Column:
    """Python's ``{x:.0%}``: 100 x, rounded half to even."""
    return F.concat(F.format_string("%.0f", F.rint(c * 100)), F.lit("%"))


def recommended_actions(diagnoses: DataFrame) -> DataFrame:
    """One row per recommended action (1-based ``ord``); diagnoses without actions keep one NULL row."""
    x = diagnoses.select("machine_id", "start",
                         F.posexplode_outer("recommended_actions").alias("pos", "a"))
    return x.select("machine_id", "start",
                    (F.col("pos") + 1).alias("ord"),
                    F.col("a.priority").alias("priority"),
                    F.col("a.action").alias("action"),
                    F.col("a.estimated_downtime_hours").alias("estimated_downtime_hours"),
                    F.col("a.estimated_downtime_text").alias("estimated_downtime_text"))


def _block(cond: Column, *lines: Column) -> Column:
    return F.when(cond, F.concat_ws("\n", *lines))


def _fixed_lines(lines: list[str]) -> list[Column]:
    return [F.lit(x) for x in lines]


def diagnosis_section(d: Column | None = None) -> Column:
    """Markdown section of one diagnosis row (column names of ``to_diagnoses``)."""
    ev = F.col("evidence")
    acts = F.col("recommended_actions")
    parts = F.col("parts_at_risk")
    notes = F.col("pattern_notes")
    act_rows = F.transform(acts, lambda a: F.concat(
        F.lit("| "), priority_badge(a["priority"]), F.lit(" | "), F.coalesce(a["action"], F.lit("")),
        F.lit(" | "), F.coalesce(a["estimated_downtime_text"], F.lit("—")), F.lit("h |")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### Machine `"), F.col("machine_id"), F.lit("` — "), F.col("start"), F.lit(" → "),
                 F.col("end")),
        F.lit(""),
        *_fixed_lines(FIELDS_HEAD),
        F.concat(F.lit("| **Root Cause** | "), F.col("root_cause"), F.lit(" |")),
        F.concat(F.lit("| **Failure Mode** | `"), F.col("failure_mode"), F.lit("` |")),
        F.concat(F.lit("| **Confidence** | "), percent0(F.col("confidence")), F.lit(" |")),
        F.concat(F.lit("| **Severity** | "), severity_badge(F.col("severity_assessment")), F.lit(" |")),
        F.lit(""),
        _block(F.size(ev) > 0, *_fixed_lines(EVIDENCE_HEAD),
               F.array_join(F.transform(ev, lambda e: F.concat(F.lit("- "), e)), "\n"), F.lit("")),
        _block(F.size(acts) > 0, *_fixed_lines(ACTIONS_HEAD),
               F.array_join(act_rows, "\n"), F.lit("")),
        _block(F.size(parts) > 0, F.concat(F.lit("**Parts at Risk:** "), F.array_join(parts, ", ")), F.lit("")),
        _block(notes != "", F.concat(F.lit("**Pattern Notes:** "), notes), F.lit("")),
        F.lit("---"),
        F.lit(""),
    )


def diagnosis_titles(diagnoses: DataFrame) -> DataFrame:
    """The dashboard's title line of each diagnosis: badge, machine, mode, whole-percent confidence."""
    badge = F.when(F.col("severity_assessment") == "CRITICAL", "🔴").otherwise("🟠")
    title = F.concat(badge, F.lit(" "), F.col("machine_id"), F.lit(" — "), F.col("failure_mode"), F.lit(" ("),
                     percent0(F.col("confidence")), F.lit(" confidence)"))
    return diagnoses.select("machine_id", "start", title.alias("title"))


def action_lines(diagnoses: DataFrame) -> DataFrame:
    """The dashboard's line of each recommended action; an unknown downtime is shown as ?."""
    x = diagnoses.select("machine_id", "start", F.posexplode("recommended_actions").alias("pos", "a"))
    line = F.concat(F.lit("- ["), F.coalesce("a.priority", F.lit("")), F.lit("] "), F.coalesce("a.action", F.lit("")),
                    F.lit(" (~"), F.coalesce("a.estimated_downtime_text", F.lit("?")), F.lit("h downtime)"))
    return x.select("machine_id", "start", (F.col("pos") + 1).alias("ord"), line.alias("line"))


def report_sections(diagnoses: DataFrame) -> DataFrame:
    """One Markdown section per diagnosis."""
    return diagnoses.select("machine_id", "start", diagnosis_section().alias("text"))


def fleet_section(fleet: DataFrame) -> DataFrame:
    """Markdown of the fleet summary record (one row)."""
    issues = F.transform(F.col("top_issues"), lambda it, i: F.concat_ws(
        "\n",
        F.concat(F.lit("**"), (i + 1).cast("string"), F.lit(". "), F.coalesce(it["issue"], F.lit("")), F.lit("**")),
        F.concat(F.lit("- Affected: `"), F.coalesce(F.array_join(it["affected_machines"], ", "), F.lit("")), F.lit("`")),
        F.concat(F.lit("- Frequency: "), F.coalesce(it["frequency"], F.lit("N/A"))),
        F.concat(F.lit("- Impact: "), F.coalesce(it["business_impact"], F.lit("N/A"))),
        F.lit("")))
    prios = F.transform(F.col("maintenance_priorities"), lambda mp: F.concat(
        F.lit("| "), priority_badge(mp["priority"]), F.lit(" | "), F.coalesce(mp["action"], F.lit("")),
        F.lit(" | `"), F.coalesce(F.array_join(mp["machines"], ", "), F.lit("")), F.lit("` | "),
        F.coalesce(mp["rationale"], F.lit("")), F.lit(" |")))
    alerts = F.transform(F.col("trend_alerts"), lambda a: F.concat(F.lit("- ⚠️ "), a))
    savings = F.col("estimated_downtime_savings_hours")
    text = F.concat_ws(
        "\n",
        *_fixed_lines(FLEET_HEAD),
        F.concat(F.lit("> "), F.col("executive_summary")), F.lit(""),
        _block(F.size("top_issues") > 0, *_fixed_lines(ISSUES_HEAD), F.array_join(issues, "\n")),
        _block(F.size("maintenance_priorities") > 0, *_fixed_lines(PRIORITIES_HEAD),
               F.array_join(prios, "\n"), F.lit("")),
        _block(F.size("trend_alerts") > 0, *_fixed_lines(ALERTS_HEAD),
               F.array_join(alerts, "\n"), F.lit("")),
        _block(savings != 0, F.concat(F.lit(SAVINGS[0]),
                                      fixed("estimated_downtime_savings_hours", 1),
                                      F.lit(SAVINGS[1])), F.lit("")),
    )
    return fleet.select(text.alias("text"))


# The fleet tables use ``posexplode_outer`` + a NULL filter: a plain
# ``posexplode`` makes Spark infer a ``size(array) > 0`` filter on its input,
# which copies the whole record-building expression into the plan.
def fleet_issue_rows(fleet: DataFrame) -> DataFrame:
    """Dashboard table of the fleet record's top issues, numbered from 1."""
    return (fleet.select(F.posexplode_outer("top_issues").alias("pos", "i")).where(F.col("pos").isNotNull())
            .select((F.col("pos") + 1).alias("rank"), F.col("i.issue").alias("issue"),
                    F.coalesce(F.array_join("i.affected_machines", ", "), F.lit("")).alias("affected_machines"),
                    F.col("i.frequency").alias("frequency"), F.col("i.business_impact").alias("business_impact")))


def fleet_priority_rows(fleet: DataFrame) -> DataFrame:
    """Dashboard table of maintenance priorities, in the record's order."""
    return (fleet.select(F.posexplode_outer("maintenance_priorities").alias("pos", "m"))
            .where(F.col("pos").isNotNull())
            .select((F.col("pos") + 1).alias("rank"), F.col("m.priority").alias("priority"),
                    F.col("m.action").alias("action"),
                    F.coalesce(F.array_join("m.machines", ", "), F.lit("")).alias("machines"),
                    F.col("m.rationale").alias("rationale")))


def fleet_alert_rows(fleet: DataFrame) -> DataFrame:
    """Dashboard list of trend alerts."""
    return (fleet.select(F.posexplode_outer("trend_alerts").alias("pos", "alert")).where(F.col("pos").isNotNull())
            .select((F.col("pos") + 1).alias("rank"), "alert"))


def assemble_report(diagnoses: DataFrame, generated_at: str, fleet: DataFrame | None = None,
                    stats: DataFrame | None = None) -> DataFrame:
    """Report rows ``(section_ord, ord, tie, text)``: header, stats, fleet, diagnoses in time order.

    Diagnoses are ordered by ``ord`` = start (epoch microseconds) and ``tie`` =
    machine, a global sort key, so no single task has to number them.
    ``generated_at`` is a parameter (not the wall clock) so runs are reproducible.
    """
    spark = diagnoses.sparkSession
    schema = "section_ord int, ord bigint, tie string, text string"

    def fixed_rows(section: int, lines: list[tuple[int, str]]) -> DataFrame:
        return spark.createDataFrame([(section, o, "", t) for o, t in lines], schema)

    parts = [fixed_rows(0, [(0, REPORT_TITLE), (1, ""), (2, f"*Generated: {generated_at}*"), (3, "")])]
    if stats is not None:
        parts.append(fixed_rows(1, list(enumerate(STATS_HEAD))))
        parts.append(stats.select(F.lit(1).alias("section_ord"), (F.col("ord") + 10).cast("bigint").alias("ord"),
                                  "tie",
                                  F.concat(F.lit("| "), F.col("metric"), F.lit(" | "), F.col("value"),
                                           F.lit(" |")).alias("text")))
        parts.append(fixed_rows(1, [(1000, "")]))
    if fleet is not None:
        parts.append(fleet_section(fleet).select(F.lit(2).alias("section_ord"), F.lit(0).cast("bigint").alias("ord"),
                                                 F.lit("").alias("tie"), "text"))
    parts.append(fixed_rows(3, list(enumerate(DETAILS_HEAD))))
    start = F.expr(epoch_us_sql("CAST(start AS TIMESTAMP_NTZ)"))
    parts.append(diagnoses.select(
        F.lit(4).alias("section_ord"), start.alias("ord"),
        F.col("machine_id").alias("tie"), diagnosis_section().alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
