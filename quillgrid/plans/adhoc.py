"""Ad-hoc SQL over given tables: one reading statement, checked on the plan that Spark's parser makes of it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

MAX_LENGTH = 4000

#: Parts of a reading statement, by the names of Spark's parsed nodes. Everything else is refused.
PLANS = frozenset(
    "Project Filter Aggregate Sort Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases Distinct GlobalLimit LocalLimit Offset Union Except Intersect "
    "UnresolvedHaving WithWindowDefinition UnresolvedWith UnresolvedRelation OneRowRelation UnresolvedInlineTable LocalRelation Pivot Unpivot Window".split()
)
#: Functions that compute from their arguments alone.
FUNCTIONS = frozenset(
    "abs add_months any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_size array_sort ascii avg "
    "bit_and bit_length bit_or bool_and bool_or bround btrim cardinality cbrt ceil ceiling char_length character_length chr coalesce collect_list collect_set concat concat_ws contains "
    "corr cos count count_if covar_pop covar_samp crc32 cume_dist date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc datediff day dayofmonth dayofweek "
    "dayofyear decode degrees dense_rank div double element_at elt encode endswith every exists exp explode filter find_in_set first first_value float floor format_number format_string "
    "greatest grouping grouping_id hash hex hour if ifnull initcap instr int isnan isnotnull isnull kurtosis lag last last_day last_value lcase lead least left length levenshtein ln locate "
    "log log10 log2 lower lpad ltrim make_date map map_keys map_values max max_by md5 mean median min min_by minute mod mode month months_between named_struct next_day now nth_value ntile "
    "nullif nvl nvl2 octet_length percent_rank percentile percentile_approx percentile_cont percentile_disc pi pmod position posexplode pow power quarter radians rank regexp_count "
    "regexp_extract regexp_like regexp_replace regexp_substr regr_count regr_r2 regr_slope repeat replace reverse right round row_number rpad rtrim second sequence sha1 sha2 sign signum sin "
    "size skewness slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string struct substr substring sum tan timestamp to_char to_date to_number "
    "to_timestamp translate trim trunc try_add try_avg try_cast try_divide try_subtract try_sum typeof ucase unhex unix_date upper var_pop var_samp variance weekday weekofyear when "
    "width_bucket window xxhash64 year".split()
)


def _seq(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_plan(plan, known: frozenset[str]) -> None:
    """Refuse a parsed plan that holds anything but known relations, and expressions of allowed functions."""
    kind = _kind(plan)
    if kind not in PLANS:
        raise ValueError(f"{kind} is no part of a reading statement")
    if kind == "UnresolvedWith":
        # A name is known to the queries after it, not before and not outside.
        for pair in _seq(plan.cteRelations()):
            _check_plan(pair._2(), known)
            known = known | {pair._1().lower()}
        _check_plan(plan.child(), known)
        return
    if kind == "UnresolvedRelation":
        parts = _seq(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in known:
            raise ValueError(f"unknown table {'.'.join(parts)!r}")
    for expression in _seq(plan.expressions()):
        _check_expression(expression, known)
    for child in _seq(plan.children()):
        _check_plan(child, known)


def _check_expression(expression, known: frozenset[str]) -> None:
    kind = _kind(expression)
    if kind == "UnresolvedFunction":
        name = _seq(expression.nameParts())
        if len(name) != 1 or name[0].lower() not in FUNCTIONS:
            raise ValueError(f"function {'.'.join(name)!r} is not allowed")
    if kind in ("UnresolvedTableValuedFunction", "NamedParameter", "PosParameter", "NameParameterizedQuery") or "Identifier" in kind:
        raise ValueError(f"{kind} is no part of a reading statement")
    if hasattr(expression, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _check_plan(expression.plan(), known)
    for child in _seq(expression.children()):
        _check_expression(child, known)


def _quoted(sql: str) -> str:
    """Names in double quotes, which Spark reads as text, in backticks. What comes of it is parsed and checked."""
    return re.sub(r"""('(?:''|[^'])*')|"([^"]*)\"""", lambda m: m[1] or f"`{m[2]}`", sql.strip().rstrip(";"))


def check_sql(spark: SparkSession, sql: str, tables: Iterable[str]) -> str:
    """The statement as Spark is to run it; ValueError unless it is one query of the given tables and nothing else."""
    if not 1 <= len(sql) <= MAX_LENGTH:
        raise ValueError(f"a statement has 1 to {MAX_LENGTH} characters")
    text = _quoted(sql)
    if not re.match(r"(select|with)\b", text, re.IGNORECASE):
        raise ValueError("a statement begins with SELECT or WITH")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, Py4JJavaError) as problem:
        raise ValueError(f"not a statement: {problem}") from problem
    _check_plan(plan, frozenset(t.lower() for t in tables))
    return text


def ask_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run one checked statement over the given tables. Names may be quoted with double quotes.

    The tables are bound inside the statement, to views of random names that are gone when it has been analysed: the
    session's own views are neither replaced nor in reach.
    """
    text = check_sql(spark, sql, tables)
    views = {name: f"asked_{uuid.uuid4().hex}" for name in tables}
    bound = ", ".join(f"`{name.replace('`', '``')}` as (select * from {view})" for name, view in views.items())
    own = re.match(r"with\b(?!\s+recursive\b)", text, re.IGNORECASE)
    if bound:
        text = f"with {bound}, {text[own.end() :]}" if own else f"with {bound} {text}"
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(views[name])
        return spark.sql(text)
    except (AnalysisException, ParseException) as problem:
        raise ValueError(f"not a statement over these tables: {problem}") from problem
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
