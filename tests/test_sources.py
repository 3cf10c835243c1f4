import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from telemill.operators import sessions
from telemill.schema import RAW_COLUMNS, SENSORS
from telemill.sources.csv_logs import read_logs_csv, write_logs_csv
from telemill.sources.events_adapter import load_machine_logs

HEADER = ",".join(RAW_COLUMNS)


def _write(path, lines):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(lines) + "\n")


def test_f8_csv_cells(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "logs.csv")
    _write(p, [
        HEADER,
        '2025-01-01 00:00:00,LC-01,A. Petrov,DAY,SS304,ERROR,E-201,THERMAL,2400.5,60.1,150.0,0.03,2000.0,4.5,'
        '"He said ""hot"", then left"',
        '2025-01-01 00:10:00,LC-01,M. Chen,DAY,SS304,INFO,,,NA,25.0,,0.02,2100.0,9.5,"line one\nline two — ünï"',
        'not a time,LC-02,J. Rodriguez,NIGHT,AL6061,WARNING,,,2000.0,30.0,150.0,0.01,2000.0,9.0,x',
    ])
    df = read_logs_csv(spark, p, multi_line=True).orderBy(F.col("timestamp").asc_nulls_last()).collect()
    assert len(df) == 3
    assert df[0]["operator_notes"] == 'He said "hot", then left'
    assert df[1]["operator_notes"] == "line one\nline two — ünï"
    assert df[1]["laser_power_w"] is None and df[1]["gas_pressure_psi"] is None
    assert df[1]["error_code"] is None and df[0]["_corrupt_record"] is None
    bad = df[2]
    assert bad["timestamp"] is None and "not a time" in bad["_corrupt_record"]


def test_contract_minimal_columns(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "min.csv")
    cols = [c for c in RAW_COLUMNS if c not in ("operator", "shift", "material", "failure_category")]
    _write(p, [",".join(cols), "2025-01-01 00:00:00,LC-01,ERROR,E-201,1,2,3,4,5,6,note"])
    df = read_logs_csv(spark, p)
    r = df.first()
    assert r["failure_category"] is None and r["operator"] is None and r["laser_power_w"] == 1.0
    assert sessions.failure_windows(df).count() == 1


def test_csv_round_trip_keeps_results(spark, tmpdir_path):
    logs = load_machine_logs(spark, SF001)
    out = os.path.join(tmpdir_path, "roundtrip")
    write_logs_csv(logs.drop("event_id"), out)
    back = read_logs_csv(spark, out)
    assert back.count() == logs.count()
    assert back.where("_corrupt_record IS NOT NULL").count() == 0
    a = sessions.failure_windows(logs).select("machine_id", "start", "event_count").collect()
    b = sessions.failure_windows(back).select("machine_id", "start", "event_count").collect()
    assert a == b


def test_csv_by_lines_shows_open_quotes(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "logs.csv")
    row = "2025-01-01 00:00:00,LC-01,,,,INFO,,,1,2,3,4,5,6,"
    _write(p, [HEADER + ",site", *[row + "fine,x"] * 20_000, row + '"line one', 'line two",x'])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = read_logs_csv(spark, p, line_breaks="none")
        assert df.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert df.where("_corrupt_record IS NULL").count() == 20_000
    assert df.where("_corrupt_record IS NOT NULL").count() == 2
    assert df.select("site").distinct().where("site = 'x'").count() == 1
    whole = read_logs_csv(spark, p, multi_line=True)
    assert whole.where("_corrupt_record IS NOT NULL").count() == 0 and whole.count() == 20_001


def test_missing_value_tokens(spark, tmpdir_path):
    from telemill.schema import NULL_TOKENS
    p = os.path.join(tmpdir_path, "logs.csv")
    _write(p, [HEADER, *[f"2025-01-01 00:00:00,{t},,,,INFO,,,{t},2,3,4,5,6,{t}" for t in NULL_TOKENS]])
    rows = read_logs_csv(spark, p).collect()
    assert len(rows) == len(NULL_TOKENS)
    assert all(r["machine_id"] is None and r["laser_power_w"] is None and r["operator_notes"] is None
               and r["_corrupt_record"] is None for r in rows)


def test_processed_table_has_files_by_the_rows_of_a_date(spark, tmpdir_path):
    from telemill.operators import features
    from telemill.sources.csv_logs import write_enriched
    logs = load_machine_logs(spark, SF001)
    for k, (rows, most) in enumerate(((10 ** 6, 1), (10, 8))):
        out = os.path.join(tmpdir_path, f"processed{k}")
        counts = logs.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("n"))
        write_enriched(features.enrich(logs), out, counts=counts, rows_per_file=rows)
        files = [len([f for f in os.listdir(os.path.join(out, d)) if f.startswith("part-")]) for d in os.listdir(out) if d.startswith("date=")]
        assert max(files) <= most and (most == 1 or max(files) > 2)
        assert spark.read.parquet(out).count() == logs.count()


def _quoted_rows(rnd, n):
    """CSV cells as a writer makes them: quotes doubled, line breaks and commas inside quotes."""
    out = []
    for k in range(n):
        note = rnd.choice(["", "fine", 'said ""hot""', "two\nlines", 'a ""b""\n\n,c', "x" * rnd.randrange(200), '\n""\n', "ünï, ✓"])
        cells = ["2025-01-01 00:%02d:%02d" % (k // 60 % 60, k % 60), f"LC-{k % 7}", rnd.choice(["INFO", "ERROR"]), f"E-{k}",
                 *[str(rnd.randrange(100)) for _ in SENSORS]]
        out.append([*cells, note])
    return out


def _csv_file(path, header, rows, end="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        for r in [header, *rows]:
            f.write(",".join(f'"{c}"' if any(x in c for x in '",\n') else c for c in r) + end)


_MINIMAL = ["timestamp", "machine_id", "severity", "error_code", *SENSORS, "operator_notes"]


@pytest.mark.parametrize("seed,split", [(1, "300"), (2, "1k"), (3, "90"), (4, "64k")])
def test_line_breaks_in_quotes_at_any_split(spark, tmpdir_path, seed, split):
    rnd = random.Random(seed)
    for k in range(3):
        _csv_file(os.path.join(tmpdir_path, f"{k}.csv"), _MINIMAL, _quoted_rows(rnd, [400, 1, 0][k]))
    whole = sorted(map(tuple, read_logs_csv(spark, tmpdir_path, multi_line=True).collect()), key=str)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = read_logs_csv(spark, tmpdir_path)
        assert sorted(map(tuple, df.collect()), key=str) == whole and len(whole) == 401
        assert split == "64k" or df.rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_file_with_line_breaks_has_several_tasks(spark, tmpdir_path):
    rnd = random.Random(9)
    block = _quoted_rows(rnd, 4000)
    p = os.path.join(tmpdir_path, "large.csv")
    _csv_file(p, _MINIMAL, block * 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        df = read_logs_csv(spark, p)
        assert os.path.getsize(p) > 15_000_000 and df.rdd.getNumPartitions() > 6
        assert df.count() == 200_000 and df.where("_corrupt_record IS NOT NULL").count() == 0
        whole = read_logs_csv(spark, p, multi_line=True)
        marks = [F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))]
        assert df.agg(*marks).first() == whole.agg(*marks).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_columns_go_by_each_files_header(spark, tmpdir_path):
    row = ["2025-01-01 00:00:00", "LC-01", "ERROR", "E-201", "1", "2", "3", "4", "5", "6", "one\ntwo"]
    _csv_file(os.path.join(tmpdir_path, "a.csv"), _MINIMAL, [row])
    _csv_file(os.path.join(tmpdir_path, "b.csv"), ["\ufeff" + "operator_notes", *_MINIMAL[-2::-1]], [row[::-1]], "\r\n")
    _csv_file(os.path.join(tmpdir_path, "c.csv"), [*_MINIMAL, "site", "", "site"], [[*row, "north", "7", "9"], row[:5]])
    got = read_logs_csv(spark, tmpdir_path)
    assert [c for c in got.columns if c not in RAW_COLUMNS] == ["event_id", "site", "_c12", "site13", "_corrupt_record"]
    rows = got.collect()
    assert len(rows) == 4 and sum(r["_corrupt_record"] is not None for r in rows) == 1
    good = [r for r in rows if r["_corrupt_record"] is None]
    for r in good:
        assert (r["machine_id"], r["severity"], r["laser_power_w"], r["coolant_flow_lpm"]) == ("LC-01", "ERROR", 1.0, 6.0)
        assert r["operator_notes"].replace("\r", "") == "one\ntwo"
    assert sorted((r["site"], r["_c12"], r["site13"]) for r in good if r["site"]) == [("north", "7", "9")]


def test_open_quote_at_the_end_of_a_file_costs_one_record(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "x.csv")
    row = "2025-01-01 00:00:00,LC-01,INFO,,1,2,3,4,5,6,"
    _write(p, [",".join(_MINIMAL), row, row + "fine", row + '"never closed'])
    got = read_logs_csv(spark, p).collect()
    assert len(got) == 3
    _write(os.path.join(tmpdir_path, "empty.csv"), [])
    assert read_logs_csv(spark, tmpdir_path).count() == 3


def test_no_rows(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "x.csv")
    _write(p, [HEADER])
    got = read_logs_csv(spark, p)
    assert got.count() == 0 and set(RAW_COLUMNS) <= set(got.columns)
