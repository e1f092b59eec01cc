"""Gold questions (JSON lines) and evaluation cases (YAML) as DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "qid string, type string, query string, filters map<string,string>, acceptable array<string>, notes string"
CASE = (
    "id string, type string, question string, questions array<string>, expected_facts array<string>, category string,"
    " expected_reason string, query string, expected_ticker string, expected_form string, expected_section string, k int,"
    " expected_refused boolean, notes string"
)
# The four types, with what each must and may state.
REQUIRED = {
    "correctness": {"question", "expected_facts"},
    "refusal": {"question", "category"},
    "filter": {"query"},
    "robustness": {"questions"},
}


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(gold questions, decoys). Blank lines are skipped; a malformed one raises."""
    rows = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)
    return rows.where("type <> 'off_corpus'"), rows.where("type = 'off_corpus'")


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """All cases of a folder; an unknown type, a wrong field or an id used twice raises."""
    import yaml

    fields = [f.split()[0] for f in CASE.split(", ")]
    rows, seen = [], {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        case = yaml.safe_load(path.read_text("utf-8"))
        kind = case.get("type")
        if kind not in REQUIRED:
            raise ValueError(f"{path.name}: unknown type {kind!r}")
        if bad := (set(case) - set(fields)) | (({"id"} | REQUIRED[kind]) - set(case)):
            raise ValueError(f"{path.name}: wrong or missing fields {sorted(bad)}")
        if case["id"] in seen:
            raise ValueError(f"{path.name}: id {case['id']!r} is that of {seen[case['id']]}")
        seen[case["id"]] = path.name
        rows.append(tuple(case.get(f) for f in fields))
    return spark.createDataFrame(rows, CASE)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
