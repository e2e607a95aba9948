"""The guarded read-only SQL surface."""

from __future__ import annotations

import re

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

LIMIT = 200
#: Logical plan nodes of a read; anything else (commands, inserts, DDL, SET) is refused.
READS = {
    "Aggregate", "CTE", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "OneRowRelation",
    "Pivot", "Project", "Sort", "SubqueryAlias", "Tail", "Union", "Unpivot", "UnresolvedCTERelationDef", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTableValuedFunction", "UnresolvedWith", "Window", "WithWindowDefinition", "View", "Sample", "UnresolvedOrderBy", "Deduplicate", "Offset", "NamedParametersQuery",
}


def clean(sql: str) -> str:
    return re.sub(r"```(?:sqlite|sql)?\s*", "", sql, flags=re.I).strip().rstrip(";").strip()


#: Functions that run other code or tell of the machine; table functions other than these are refused as well.
REFUSED = {"reflect", "try_reflect", "java_method", "input_file_name", "input_file_block_start", "input_file_block_length", "version", "current_user", "user", "session_user", "sql_keywords", "collations"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
_PLAN, _EXPRESSION = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", "org.apache.spark.sql.catalyst.expressions.SubqueryExpression"


def _faults(spark: SparkSession, plan) -> list[str]:
    """What a parsed statement may not hold: nodes that are no reads, relations that aren't registered, functions that aren't built in or are refused."""
    gateway = spark.sparkContext._gateway
    builtin = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    name_of = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    found, relations, own, todo = [], [], set(), [plan]
    while todo:
        x = todo.pop()
        if not isinstance(x, JavaObject):
            continue
        kind = x.getClass().getSimpleName()
        if is_instance_of(gateway, x, _PLAN):
            if x.nodeName() not in READS:
                found.append(x.nodeName())
            if kind == "UnresolvedRelation":
                relations.append([str(p) for p in listed(x.multipartIdentifier())])
            if kind == "UnresolvedTableValuedFunction" and [str(p).lower() for p in listed(x.name())][-1] not in TABLE_FUNCTIONS:
                found.append("a table function")
            if kind == "UnresolvedWith":
                own |= {str(t._1()).lower() for t in listed(x.cteRelations())}
            todo += listed(x.expressions())
        elif is_instance_of(gateway, x, _EXPRESSION):
            todo.append(x.plan())
        if kind == "UnresolvedFunction":
            parts = [str(p).lower() for p in listed(x.nameParts())]
            if len(parts) > 1 or parts[0] in REFUSED or not builtin.functionExists(name_of(parts[0])):
                found.append(".".join(parts))
        if kind == "UnresolvedGenerator":
            if str(x.name().funcName()).lower() not in TABLE_FUNCTIONS:
                found.append("a generator")
        todo += listed(x.children())
        todo += [y for y in listed(x.innerChildren()) if isinstance(y, JavaObject) and is_instance_of(gateway, y, _PLAN)]
    views = {t.name.lower() for t in spark.catalog.listTables()}
    return found + [".".join(r) for r in relations if len(r) > 1 or r[0].lower() not in own | views]


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The result of one read-only statement over registered views; PermissionError for any other."""
    text = clean(sql)
    # the parser is a private API of the classic session; it is used here alone
    bad = sorted(set(_faults(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(text))))
    if bad:
        raise PermissionError(f"only reads of registered views are allowed, not {', '.join(bad)}")
    return spark.sql(text)


def sql_tool(spark: SparkSession, sql: str) -> dict:
    """row_count, at most LIMIT rows and a note, or the error's text."""
    try:
        df = run_sql(spark, sql)
        rows = [r.asDict(recursive=True) for r in df.limit(LIMIT + 1).collect()]
    except Exception as error:  # the agent gets the message to repair its statement
        return {"error": str(error).split("\n")[0], "hint": "check table and column names"}
    if len(rows) <= LIMIT:
        return {"row_count": len(rows), "rows": rows, "note": ""}
    return {"row_count": df.count(), "rows": rows[:LIMIT], "note": f"first {LIMIT} rows"}


# Chart types that a tool call may name
CHARTS = {"bar": "bar", "column": "bar", "line": "line", "pie": "pie", "doughnut": "pie", "scatter": "scatter"}


def chart_spec(kind: str, labels: list, values: list, title: str = "", most: int = 40) -> dict:
    """A chart of at most `most` points; what isn't a number is 0."""

    def as_number(x) -> float:
        try:
            return float(x)
        except (TypeError, ValueError):
            return 0.0

    n = min(len(labels), len(values), most)
    return {"type": CHARTS.get(str(kind).lower(), "bar"), "title": title, "labels": [str(x) for x in labels[:n]], "values": [as_number(x) for x in values[:n]]}
