import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import joinkeys
from quillgrid.operators import profile as P
from quillgrid.operators.joinkeys import find_join_candidates, name_stem, names_compatible, profile_workbook, types_compatible
from quillgrid.operators.median import lower_medians


def facts_of(spark, columns, kinds_by_look=True, names=None):
    """Profile facts of text columns given as lists."""
    keys = list(columns)
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"`{k}` string" for k in keys))
    return {r["column_key"]: r for r in P.describe_columns(df, original_names=names, kinds_by_look=kinds_by_look).collect()}


def test_types(spark):
    n = 10
    columns = {
        "employee_id": [f"E-{i}" for i in range(n)],
        "full_name": [f"Person {chr(65 + i)}" for i in range(n)],
        "department": ["Sales", "Ops"] * 5,
        "hire_date": [f"2024-01-{i + 1:02d}" for i in range(n)],
        "salary": [str(50000 + i) for i in range(n)],
        "is_active": ["true", "false"] * 5,
        "in_stock_flag": ["1", "0"] * 5,
        "growth": [f"{i}.5%" for i in range(n)],
        "discount_rate": ["0.1"] * n,
        "fee": [f"€{i},000.00" for i in range(n)],
        "loss": [f"({i}00.00)" for i in range(n)],
        "start_serial": [str(45000 + i) for i in range(n)],
        "units_sold": [str(i) for i in range(n)],
        "store_id": [str(i) for i in range(n)],
        "unit_cost_gbp": [str(i) for i in range(n)],
        "expense_category": ["a", "b"] * 5,
        "col_2": [f"some words {chr(97 + i)}" for i in range(n)],
        "mood": ["good", "bad"] * 5,
        "nothing": [None] * n,
        "revenue_plan": [None] * n,
        "mixed_dates": ["2024-01-05", "5/6/2024", "Jan 2024", "March 3, 2024", "5-Feb-24", "2024.02.03", "2024-01-05T10:00:00Z", "1/2/24", "x", "2024-01-01"],
    }
    found = {k: r["inferred_type"] for k, r in facts_of(spark, columns).items()}
    assert found == {
        "employee_id": "id", "full_name": "text", "department": "category", "hire_date": "date", "salary": "currency", "is_active": "boolean",
        "in_stock_flag": "boolean", "growth": "percent", "discount_rate": "percent", "fee": "currency", "loss": "currency", "start_serial": "date",
        "units_sold": "number", "store_id": "id", "unit_cost_gbp": "currency", "expense_category": "text", "col_2": "text", "mood": "category",
        "nothing": "text", "revenue_plan": "currency", "mixed_dates": "date",
    }


def test_confidence_currency_and_roles(spark):
    f = facts_of(spark, {
        "price": ["£5", "€6", "$7", "8", "£9"], "amount": ["1", "2", "3", "4", "5"], "budget eur": ["1", "2", "3", "4", "5"],
        "created_at": ["a", "b", "c", "d", "e"], "lead_days": ["1", "2", "3", "4", "5"], "order_key": ["1", "2", "3", "4", "5"], "year": ["1", "1", "2", "2", "3"],
    })
    assert (f["price"]["inferred_type"], f["price"]["currency_code"], f["price"]["confidence"]) == ("currency", "GBP", pytest.approx(0.97))
    assert f["amount"]["currency_code"] == "USD" and f["budget eur"]["currency_code"] == "EUR"
    roles = {k: r["semantic_role"] for k, r in f.items()}
    assert roles == {"price": "measure", "amount": "measure", "budget eur": "measure", "created_at": "time", "lead_days": "dimension", "order_key": "identifier", "year": "time"}


def brute_median(values):
    return statistics.median(values)


@pytest.mark.parametrize("seed", range(4))
def test_stats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    makers = [lambda: rng.uniform(-1e6, 1e6), lambda: rng.choice([1.0, 2.0, 2.0, 3.0]), lambda: rng.lognormvariate(0, 20), lambda: 1e9 + rng.random()]
    values = [makers[seed]() for _ in range(rng.randint(400, 401) + seed)]
    df = spark.createDataFrame([(i, v, None if i % 7 else v) for i, v in enumerate(values)], "i bigint, v double, w double").repartition(5)
    found = {r["column_key"]: r["stats"] for r in P.profile_table(df, F.col("i"), parts=["stats"]).collect()}
    for key, kept in (("v", values), ("w", values[::7])):
        s = found[key]
        assert s["median"] == brute_median(kept)
        assert (s["min"], s["max"]) == (min(kept), max(kept))
        assert s["mean"] == pytest.approx(statistics.fmean(kept))
        assert s["variance"] == pytest.approx(statistics.pvariance(kept), rel=1e-9)


def test_median_narrows_a_crowded_range(spark):
    """More distinct values in one bucket than are looked at one by one."""
    values = spark.range(200_001).select(F.lit(0).alias("ordinal"), (F.lit(1.0) + F.col("id") / 1e8).alias("v"), F.lit(1).cast("bigint").alias("n"))
    assert lower_medians(values)[0] == (1.0 + 100_000 / 1e8, 200_001)


def test_lists_do_not_depend_on_layout(spark):
    rows = [(i, ["x", "y", "z", "=f", " "][i % 5], "w" * 45 + str(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "i bigint, a string, b string")
    one = P.profile_table(df.coalesce(1), F.col("i")).collect()
    other = P.profile_table(df.orderBy(F.desc("i")).repartition(7), F.col("i")).collect()
    assert one == other
    a = one[1]
    assert [tuple(v) for v in a["top_values"]] == [("x", 10, 20.0), ("y", 10, 20.0), ("z", 10, 20.0), ("'=f", 10, 20.0)]
    assert a["null_count"] == 10 and a["distinct_count"] == 4 and a["nullable"]
    # Samples are cut to 40 characters before they are told apart.
    assert one[2]["sample_values"] == ["w" * 40] and one[0]["sample_values"] == ["0", "1", "2", "3", "4"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "order_id string, price string, when_date date")
    found = P.profile_table(df).collect()
    assert [(r["column_key"], r["inferred_type"], r["total_count"], r["uniqueness_ratio"]) for r in found] == [
        ("order_id", "id", 0, 0.0), ("price", "currency", 0, 0.0), ("when_date", "date", 0, 0.0),
    ]


def test_recommendations(spark):
    df = spark.createDataFrame([(f"C{i}", f"2024-01-0{i + 1}", i * 1.0, "a", i) for i in range(5)], "code string, day string, price double, kind string, month int")
    row = P.recommendations(P.describe_columns(df)).first()
    assert row.asDict() == {"primary_key_candidate": "code", "recommended_time_column": "day", "recommended_measures": ["price"], "recommended_dimensions": ["kind"]}


def test_name_rules():
    assert name_stem("customer_id") == "customer" and name_stem("id_order") == "order" and name_stem("po_number") == "po"
    assert names_compatible("customer_id", "customer_code") and names_compatible("id", "order_id") and names_compatible("Customer", "customer_ref")
    assert not names_compatible("id", "name") and not names_compatible("ab_id", "cd_id")
    assert types_compatible("id", "text") and types_compatible("number", "number") and not types_compatible("number", "id")


def test_join_candidates(spark):
    customers = spark.createDataFrame([(f"C{i}", f"name {i}") for i in range(5)], "customer_id string, company_name string")
    orders = spark.createDataFrame([(f"O{i}", f"C{i % 4}") for i in range(6)], "order_id string, customer_id string")
    items = spark.createDataFrame([(f"I{i}", f" O{i % 6} ") for i in range(7)], "item_id string, order_id string")
    found = {(r["source_table"], r["source_column"], r["target_table"]): r for r in find_join_candidates({"customers": customers, "orders": orders, "items": items}).collect()}
    assert set(found) == {("orders", "customer_id", "customers"), ("orders", "order_id", "items")}
    first = found["orders", "customer_id", "customers"]
    assert (first["confidence"], first["overlap_ratio"], first["sample_matches"]) == (1.0, 1.0, ["C0", "C1", "C2", "C3"])


def test_join_candidates_need_half_of_the_smaller_side(spark):
    a = spark.createDataFrame([(str(i),) for i in range(10)], "code_id string")
    b = spark.createDataFrame([(str(i),) for i in range(5, 15)], "code_id string")
    types = {"a": {"code_id": "id"}, "b": {"code_id": "id"}}
    assert find_join_candidates({"a": a, "b": b}, types).count() == 0
    assert find_join_candidates({"a": a, "b": b.limit(9)}, types).count() == 1


def plain_joins(tables, types):
    """Every pair of columns compared by itself."""
    sets = {(t, c): {str(r[c]).strip() for r in df.collect() if r[c] is not None and str(r[c]).strip()} for t, df in tables.items() for c in df.columns}
    names, out = list(tables), set()
    for i, ta in enumerate(names):
        for tb in names[i + 1 :]:
            for ca in tables[ta].columns:
                for cb in tables[tb].columns:
                    a, b = sets[ta, ca], sets[tb, cb]
                    if not names_compatible(ca, cb) or not types_compatible(types[ta][ca], types[tb][cb]) or not a or not b:
                        continue
                    common = len(a & b)
                    ratio = float(f"{common / min(len(a), len(b)):.4f}")
                    if ratio > 0.5:
                        ends = (ta, ca, tb, cb) if common / len(a) >= common / len(b) else (tb, cb, ta, ca)
                        out.add((*ends, ratio, min(1.0, round(0.5 + 0.3 * ratio + (0.2 if ca == cb else 0.1), 2))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_catalogue_against_every_pair(spark, seed):
    """Many tables with names that go together in part, values common and rare, empty columns and tables."""
    rng = random.Random(seed)
    names = ["id", "order_id", "Order_ID", "id_order", "customer_code", "customer", "cust", "po_number", "ref", "x_id", "idx"]
    tables, types = {}, {}
    for n in range(9):
        keys = list({k.lower(): k for k in rng.sample(names, rng.randint(1, 5))}.values())
        low = rng.choice([0, 0, 20, 500])
        pool = [str(v) for v in range(low, low + rng.choice([5, 30, 60]))] + ["", " 7 "]
        rows = [tuple(None if rng.random() < 0.1 else rng.choice(pool) for _ in keys) for _ in range(rng.choice([0, 40, 80]))]
        tables[f"t{n}"] = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in keys))
        types[f"t{n}"] = {k: rng.choice(["id", "text", "number"]) for k in keys}
    found = find_join_candidates(tables, types).collect()
    got = {(r["source_table"], r["source_column"], r["target_table"], r["target_column"], r["overlap_ratio"], r["confidence"]) for r in found}
    assert got == plain_joins(tables, types) and len(got) == len(found) and got


def test_catalogue_plan_does_not_grow_with_pairs(spark):
    """Twice the columns are four times the pairs; the plan of the result stays the same."""

    def plan(columns):
        tables = {t: spark.range(20).selectExpr(*[f"cast(id as string) as customer_{n}_id" for n in range(columns)]) for t in "ab"}
        types = {t: dict.fromkeys(df.columns, "id") for t, df in tables.items()}
        return find_join_candidates(tables, types)._jdf.queryExecution().optimizedPlan().numberedTreeString().count("\n")

    assert plan(3) == plan(6)


def test_profiles_of_a_workbook(spark):
    tables = {"customers": spark.createDataFrame([(f"C{i}", i) for i in range(6)], "customer_id string, n int"), "orders": spark.createDataFrame([(f"O{i}", f"C{i % 4}") for i in range(9)], "order_id string, customer_id string")}
    profiles, joins = profile_workbook(tables)
    assert {(r["table_name"], r["column_key"], r["distinct_count"]) for r in profiles.collect()} == {("customers", "customer_id", 6), ("customers", "n", 6), ("orders", "order_id", 9), ("orders", "customer_id", 4)}
    assert [(r["source_table"], r["source_column"], r["target_table"]) for r in joins.collect()] == [("orders", "customer_id", "customers")]


def test_no_join_by_column_alone(spark, monkeypatch):
    """Values are dealt by value too, never all of a column to one task."""
    plans = []

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored_as_before(df)

    stored_as_before = joinkeys.stored
    monkeypatch.setattr(joinkeys, "stored", stored)
    monkeypatch.setattr(joinkeys, "TASK_VALUES", 200, raising=False)
    monkeypatch.setattr(joinkeys, "_sharing_rare_values", lambda *given, rare=joinkeys._sharing_rare_values: stored(rare(*given)))
    a = spark.range(2000).selectExpr("cast(id as string) as code")
    b = spark.range(500, 2500).selectExpr("cast(id as string) as code")
    types = {"a": {"code": "id"}, "b": {"code": "id"}}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joinkeys.find_join_candidates({"a": a, "b": b}, types).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [(r["overlap_ratio"], r["confidence"]) for r in found] == [(0.75, 0.93)] and len(found[0]["sample_matches"]) == 10
    rare = [plan for plan in plans if "rarity#" in plan]
    by_column = [line for plan in rare for line in plan.split("\n") if "SortMergeJoin [col#" in line or "SortMergeJoin [small#" in line]
    # Only the counts by rarity, a few rows a column, meet the sizes by column.
    assert len(rare) == 1 and len(by_column) <= 1
