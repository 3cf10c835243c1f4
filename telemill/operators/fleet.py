"""Fleet summary of any number of diagnoses, as a tree of prompts.

The leaves are prompts of up to ``per_prompt`` diagnoses, the reference's form.
Where there are several, their replies are summaries, and up to ``fan_in`` of
them make a prompt of the next round, until one is left. So no prompt and no
row holds more than ``per_prompt`` records, and the last reply covers the fleet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators import diagnose
from telemill.operators.replies import resumable_replies
from telemill.schema import FLEET_JSON_SCHEMA

#: Summaries in one prompt of the rounds after the first.
FAN_IN = 20
_FIELDS = ["executive_summary", "top_issues", "maintenance_priorities", "trend_alerts", "estimated_downtime_savings_hours"]


def _dealt(items: DataFrame, most: int, n: int) -> DataFrame:
    """items (key, windows, json) with ``part``: no part has more than ``most`` of them."""
    if n <= most:
        return items.withColumn("part", F.lit(0).cast("long"))
    buckets = -(-n // (50 * most))  # each is cut into some 50 parts, full but for the last one
    by = Window.partitionBy("bucket").orderBy("key", "json")
    return (items.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
            .withColumn("part", F.col("bucket") + F.lit(buckets) * F.floor((F.row_number().over(by) - 1) / most)).drop("bucket"))


def _prompts(dealt: DataFrame, level: int) -> DataFrame:
    """(level, part, num_windows, prompt), one row a part."""
    g = dealt.groupBy("part").agg(F.sum("windows").alias("num_windows"),
                                  F.array_sort(F.collect_list(F.struct("key", "json"))).alias("_l"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("_l", lambda e: e["json"]), ","), F.lit("]"))
    text = F.format_string(diagnose._template(diagnose.BATCH_SUMMARY_PROMPT, ["num_windows", "diagnoses_json"]),
                           F.col("num_windows").cast("string"), listed)
    if level:
        text = F.concat(F.lit("The list below has summaries of parts of the fleet in place of single diagnoses. "
                              "Join what they have in common. "), text)
    return g.select(F.lit(level).alias("level"), "part", "num_windows", F.size("_l").alias("records"), text.alias("prompt"))


def _json(*fields: str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def fleet_tree(diagnoses: DataFrame, call, per_prompt: int = diagnose.FLEET_ITEMS, fan_in: int = FAN_IN,
               factory: bool = False, partitions: int = diagnose.MODEL_PARTITIONS, replies_path: str | None = None) -> DataFrame:
    """The fleet record (one row, none without diagnoses), with ``num_windows`` and ``levels``.

    Parts whose reply can't be read are left out of the next round and counted in
    ``failed_parts``; if no part can be read the first failed record is given. With
    ``replies_path`` the replies are kept there, and a run can be taken up
    again. Hand over a written table: it is counted.
    """
    if fan_in < 2 or per_prompt < 1:
        raise ValueError("fan_in must be at least 2 and per_prompt at least 1")
    rows = diagnose.fleet_prompt_rows(diagnoses).withColumn("recommended_actions", F.transform("recommended_actions", lambda a: F.struct(
        a["action"].alias("action"), a["priority"].alias("priority"), a["estimated_downtime_hours"].alias("estimated_downtime_hours"))))
    items = rows.select(F.concat_ws(" ", "start", "machine_id").alias("key"), F.lit(1).cast("long").alias("windows"),
                        _json("machine_id", "time_range", "root_cause", "failure_mode", "severity", "recommended_actions").alias("json"))
    n, level, failed = items.count(), 0, 0
    keys = ["level", "part", "num_windows"]
    while True:
        prompts = _prompts(_dealt(items, per_prompt if level == 0 else fan_in, n), level)
        if replies_path:
            replies = resumable_replies(prompts, call, keys, replies_path, max_tokens=diagnose.FLEET_MAX_TOKENS,
                                        partitions=partitions, factory=factory)
        else:
            replies = diagnose.infer(prompts, call, keys, max_tokens=diagnose.FLEET_MAX_TOKENS, partitions=partitions, factory=factory)
        records = diagnose.to_fleet_summary(diagnose.parse_responses(replies, FLEET_JSON_SCHEMA), tuple(keys))
        counts = {r["status"]: r["count"] for r in records.groupBy("status").count().collect()}
        read, unread = counts.get("ok", 0), sum(v for k, v in counts.items() if k != "ok")
        failed += unread
        if read + unread <= 1 or not read:
            break
        items = records.where("status = 'ok'").select(
            F.format_string("%012d", "part").alias("key"), F.col("num_windows").alias("windows"), _json(*_FIELDS).alias("json"))
        n, level = read, level + 1
    return (records.orderBy("part").limit(1).drop("level", "part")
            .withColumn("levels", F.lit(level + 1)).withColumn("failed_parts", F.lit(failed).cast("long")))


def issue_rows(fleet: DataFrame) -> DataFrame:
    """(issue, affected_machines, frequency, business_impact): one row for each issue name of the record."""
    issue = fleet.select(F.posexplode("top_issues").alias("pos", "i")).select("pos", "i.*")
    first = F.min_by(F.struct("frequency", "business_impact"), "pos").alias("f")
    named = issue.groupBy("issue").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("affected_machines")))).alias("affected_machines"), first)
    return named.select("issue", "affected_machines", "f.frequency", "f.business_impact")
