"""Sources: CSV NA handling and typing, call-log usage, problem type, predictions sink."""

import json
import tempfile

from tabprobe.sources import ingest as A


def test_read_table_na_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="tabprobe-test-", dir="/tmp")
    with open(f"{d}/t.csv", "w") as f:
        f.write("id,x,when,label,flag\n1,1.5,2024-01-02,a,True\n2,NA,2024-01-03 10:00:00,NA,False\n3,,N/A,b,true\n")
    df, err = A.read_table(spark, f"{d}/t.csv")
    assert err is None
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["x"] == "double" and types["when"].startswith("timestamp")
    assert types["flag"] == "boolean" and types["label"] == "string"
    rows = df.orderBy("id").collect()
    assert rows[1]["x"] is None and rows[1]["label"] is None and rows[2]["when"] is None
    bad, err = A.read_table(spark, f"{d}/missing.csv")
    assert bad is None and err.startswith("Failed to load")


def test_call_log_usage(spark):
    d = tempfile.mkdtemp(prefix="tabprobe-test-", dir="/tmp")
    recs = [{"agent": "stats", "model": "m1", "timestamp": "2024-05-01T10:00:00",
             "usage": {"prompt_tokens": 10, "completion_tokens": 5, "total_tokens": 15}},
            {"agent": "stats", "model": "m1", "timestamp": "2024-05-01T11:00:00",
             "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}},
            {"agent": "eda", "model": "m2", "timestamp": "2024-05-02T09:00:00",
             "usage": {"prompt_tokens": 7, "completion_tokens": 0, "total_tokens": 7}}]
    with open(f"{d}/log.jsonl", "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs))
    got = {(r["agent"], str(r["day"])): (r["calls"], r["total_tokens"]) for r in A.call_log_usage(spark, f"{d}/log.jsonl").collect()}
    assert got == {("stats", "2024-05-01"): (2, 18), ("eda", "2024-05-02"): (1, 7)}


def test_detect_problem_type(spark):
    df = spark.createDataFrame([(i % 3, float(i), "x") for i in range(50)], "a int, b double, c string")
    assert A.detect_problem_type(df, "a") == "classification"
    assert A.detect_problem_type(df, "b") == "regression"
    assert A.detect_problem_type(df, "c") == "classification"
