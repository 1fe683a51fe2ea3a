"""What an analyzed plan reads and calls, from its tree and never from its text.

The walk goes through every node, expression and subquery, and stops at the views of
the session: what they are made of is the owner's, not the user's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

# Plan nodes without children that hold no stored data.
_OWN_ROWS = frozenset({"OneRowRelation", "OneRowRelation$", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"})
# Expressions that run code outside the query, or tell of the system and not of the data.
_SYSTEM_CALLS = frozenset({
    "CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
    "CurrentUser", "CurrentDatabase", "CurrentCatalog", "CurrentPath", "SparkVersion", "Version", "SparkPartitionID",
    "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "PythonUDTFGenerator", "HiveSimpleUDF", "HiveGenericUDF", "HiveGenericUDTF",
    "HiveUDAFFunction", "StaticInvoke", "Invoke", "NewInstance",
})
# Functions whose only child is what they are rewritten to; what they were called with are their parameters.
_REWRITTEN = "org.apache.spark.sql.catalyst.expressions.InheritAnalysisRules"
_SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"


@dataclass
class Seen:
    """Views read, relations read beside them, and system functions called."""

    views: set[str] = field(default_factory=set)
    relations: set[str] = field(default_factory=set)
    calls: set[str] = field(default_factory=set)


def items(sequence) -> Iterator:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def subqueries(session: SparkSession) -> Callable[[JavaObject], list[JavaObject]]:
    """Gives the plan of an expression that is a subquery, in a list, else none."""
    kind = session._jvm.java.lang.Class.forName(_SUBQUERY)
    return lambda e: [e.plan()] if kind.isInstance(e) else []


def resolved(session: SparkSession, plan: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """The expressions of an analyzed plan, subqueries included, but not what views are made of."""
    plans, expressions, of = [plan], [], subqueries(session)
    rewritten = session._jvm.java.lang.Class.forName(_REWRITTEN)
    while plans or expressions:
        if expressions:
            e = expressions.pop()
            yield e.getClass().getSimpleName(), e
            plans.extend(of(e))
            expressions.extend(items(e.parameters() if rewritten.isInstance(e) else e.children()))
            continue
        plan = plans.pop()
        if plan.getClass().getSimpleName() != "View":
            plans.extend(items(plan.children()))
            plans.extend(x for x in items(plan.innerChildren()) if hasattr(x, "expressions"))
            expressions.extend(items(plan.expressions()))


def inspect(df: DataFrame, own_functions: frozenset[str] = frozenset()) -> Seen:
    """Everything the analyzed plan of `df` reads and calls. own_functions: names the session itself registered."""
    jvm = df.sparkSession._jvm
    rewritten, subquery = (jvm.java.lang.Class.forName(name) for name in (_REWRITTEN, _SUBQUERY))
    seen = Seen()
    plans, expressions = [df._jdf.queryExecution().analyzed()], []
    while plans or expressions:
        if expressions:
            e = expressions.pop()
            kind = e.getClass().getSimpleName()
            name = e.prettyName()
            if kind in _SYSTEM_CALLS and name not in own_functions:
                seen.calls.add(name)
            if subquery.isInstance(e):
                plans.append(e.plan())
            expressions.extend(items(e.parameters() if rewritten.isInstance(e) else e.children()))
            continue
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "View":
            seen.views.add(plan.desc().identifier().table())
            continue
        children = list(items(plan.children()))
        if not children and kind not in _OWN_ROWS:
            seen.relations.add(kind)
        plans.extend(children)
        expressions.extend(items(plan.expressions()))
    return seen


def limit_at(session: SparkSession, text: str) -> tuple[int, int, int] | None:
    """(value, first, last character) of the constant limit of a whole query, from its parsed form."""
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    while plan.getClass().getSimpleName() == "UnresolvedWith":
        plan = plan.child()
    if plan.getClass().getSimpleName() != "GlobalLimit" or not plan.limitExpr().foldable():
        return None
    value, origin = plan.limitExpr().eval(None), plan.limitExpr().origin()
    if value is None or origin.startIndex().isEmpty() or origin.stopIndex().isEmpty():
        return None
    return int(value), origin.startIndex().get(), origin.stopIndex().get()
