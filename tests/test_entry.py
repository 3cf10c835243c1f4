import __spark_entry__ as E

# planned keys of the operator inventory
SURVEY_KEYS = """time_features failure_events sensor_zscores anomaly_flags category_counts sensor_trend
sensor_anomalies_top20 prepared_windows fleet_prompt failure_window_listing severity_counts rolling_stats
code_category signature_match out_of_range severity_summary overview anomalies_by_sensor failure_windows
window_prompts diagnoses parsed_responses fleet_issues fleet_summary fleet_top_issues fleet_priorities
report_stats report_sections
recommended_actions load_logs machine_list machine_trend window_notes reply_records window_prompt_entries
fleet_issue_machines fleet_alerts fleet_section diagnosis_titles action_lines report_rows""".split()


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(SURVEY_KEYS) <= set(q)
    assert set(SURVEY_KEYS) <= set(o)
