import pytest
from pyspark.sql import functions as F

from quillgrid.operators.profile import describe_columns, profile_table
from quillgrid.plans.adhoc import ask_sql, check_sql
from quillgrid.plans.ask import ask, read_question
from quillgrid.plans.autoreport import auto_report, choose_reports, default_filters


@pytest.fixture(scope="module")
def projects(spark):
    rows = [(f"P-{i}", f"Project {i}", ["Design", "Build", "Done"][i % 3], f"R{i % 9}", 1000.0 + i, 10.0 * i, f"{i}%", f"2024-{i % 12 + 1:02d}-01") for i in range(30)]
    return spark.createDataFrame(rows, "project_code string, project_name string, stage string, region string, budget double, spend double, growth string, start_date string")


@pytest.fixture(scope="module")
def profile(projects):
    return profile_table(projects, F.substring("project_code", 3, 9).cast("int"), parts=["top_values"]).collect()


def test_choice(profile):
    reports = {r["id"]: r for r in choose_reports(profile)}
    assert list(reports) == ["kpi_budget", "kpi_spend", "kpi_growth", "line_trend_budget", "donut_breakdown_stage", "bar_breakdown_project_name", "pivot_matrix", "table_records"]
    assert reports["kpi_growth"]["aggregation"] == "avg" and reports["donut_breakdown_stage"]["measure"] == "spend"
    assert reports["table_records"]["columns"] == ["project_code", "project_name", "stage", "region", "budget", "spend", "growth", "start_date"]
    filters = default_filters(profile)
    assert [f["id"] for f in filters] == ["filter_start_date", "filter_project_name", "filter_stage", "filter_region"]
    assert filters[2]["options"] == ["Design", "Build", "Done"]


def test_choice_without_time_or_measure(profile):
    def keep(keys):
        return [p for p in profile if p["column_key"] in keys]

    no_time = {r["id"]: r for r in choose_reports(keep(["stage", "region", "budget"]))}
    assert no_time["bar_breakdown_region"]["limit"] == 15 and no_time["donut_breakdown_stage"]["measure"] == "budget"
    bare = {r["id"]: r for r in choose_reports(keep(["project_code", "stage"]))}
    assert list(bare) == ["kpi_total_records", "donut_breakdown_stage", "table_records"]
    assert bare["donut_breakdown_stage"]["aggregation"] == "count" and bare["kpi_total_records"]["measure"] == "project_code"


def test_auto_report_runs(projects, profile):
    out = auto_report(projects, profile=profile, active={"filter_stage": "Done"}, granularity="year")
    assert not [k for k, v in out.items() if isinstance(v, Exception)]
    assert out["kpi_budget"].first()[0] == sum(1000.0 + i for i in range(30) if i % 3 == 2)
    assert out["line_trend_budget"].count() == 1 and out["table_records"].count() == 10


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame([(10, "North"), (30, "North"), (50, "South")], "revenue int, region string")


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("What is the average revenue?", [(30.0,)]),
        ("average revenue by region", [("South", 50.0), ("North", 20.0)]),
        ("top 1 region by revenue", [("South", 50)]),
        ("total revenue", [(90,)]),
        ("sum of revenue per region", [("South", 50), ("North", 40)]),
        ("how many rows per region", [("North", 2), ("South", 1)]),
        ("show everything", [(10, "North"), (30, "North"), (50, "South")]),
    ],
)
def test_questions(regions, question, expected):
    assert [tuple(r) for r in ask(regions, question).collect()] == expected


def test_question_limits(projects):
    profile = describe_columns(projects).orderBy("ordinal").collect()
    assert read_question("top 500 stage by spend", profile) == {"type": "bar", "dimension": "stage", "measures": ["spend"], "aggregation": "sum", "limit": 100}
    assert read_question("best stage", profile)["limit"] == 5
    assert len(read_question("list them", profile)["columns"]) == 6


REFUSED = """
DELETE FROM t
SELECT 1; SELECT 2
SELECT * FROM t; DROP TABLE t
WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x
SELECT read_csv('x')
SELECT * FROM csv.`/etc/passwd`
SELECT *, 1 AS "/etc/passwd" FROM text."/etc/passwd"
SELECT * FROM `text`.`/etc/passwd`
SELECT /* ' */ * FROM text.`/etc/passwd` -- '
SELECT '\\' FROM text.`/etc/passwd` WHERE '' = '\\'
SELECT * FROM own_view
SELECT * FROM default.t
SELECT (SELECT max(x) FROM own_view) FROM t
SELECT * FROM t WHERE EXISTS (SELECT 1 FROM own_view)
SELECT * FROM t WHERE x IN (SELECT x FROM own_view)
SELECT * FROM (SELECT * FROM (SELECT * FROM own_view))
SELECT * FROM own_view WHERE EXISTS (WITH own_view AS (SELECT 1) SELECT * FROM own_view)
WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a
SELECT * FROM range(10)
SELECT reflect('java.lang.System', 'exit', 0)
SELECT `java_method`('a', 'b')
SELECT session_user()
SELECT * FROM IDENTIFIER('own_view')
SELECT TRANSFORM(x) USING 'cat' FROM t
VALUES (1)
""".strip().splitlines()


@pytest.mark.parametrize("sql", ["", "SELECT " + "1" * 4000, *REFUSED])
def test_refused_sql(spark, sql):
    spark.range(3).createOrReplaceTempView("own_view")
    with pytest.raises(ValueError):
        check_sql(spark, sql, ["t"])


def test_session_views_stay(spark, regions):
    spark.range(3).createOrReplaceTempView("sales")
    assert ask_sql(spark, "WITH s AS (SELECT count(*) AS n FROM sales) SELECT n FROM s", {"sales": regions}).first()[0] == regions.count()
    assert spark.table("sales").count() == 3


def test_allowed_sql(spark, regions):
    sql = """SELECT "region", sum("revenue") AS "total" FROM "sales" WHERE "region" <> 'drop; "x"' GROUP BY "region" ORDER BY "total";"""
    assert [tuple(r) for r in ask_sql(spark, sql, {"sales": regions}).collect()] == [("North", 40), ("South", 50)]
    with pytest.raises(ValueError):
        ask_sql(spark, 'SELECT "secret" FROM "sales"', {"sales": regions})
