"""Read-only SQL over registered tables: the whole relational surface by pass-through."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from loomkb.session import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


#: Built-in functions that reach beyond the tables, and the table functions that do not.
FORBIDDEN = frozenset("java_method reflect try_reflect".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode".split())

# The parsed nodes of queries. A node of any other class is rejected, so what a new version adds is closed until it is listed.
PLANS = frozenset(
    "Project OneRowRelation Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect Join LateralJoin SubqueryAlias Generate Pivot Unpivot "
    "Sample WithWindowDefinition UnresolvedWith LocalRelation RepartitionByExpression UnresolvedHint".split()
)
NOT_RESOLVED = frozenset(
    "UnresolvedRelation UnresolvedTableValuedFunction UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedAttribute UnresolvedAlias "
    "UnresolvedFunction UnresolvedGenerator UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedRegex UnresolvedExtractValue UnresolvedOrdinal NamedParameter".split()
)
EXPRESSIONS = frozenset(
    "Literal Alias AttributeReference Cast CaseWhen LambdaFunction UnresolvedNamedLambdaVariable SortOrder Rollup Cube GroupingSets PipeExpression PipeOperator "
    "EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual And Or Not In IsNull IsNotNull IsUnknown Like ILike RLike LikeAny LikeAll NotLikeAny NotLikeAll "
    "Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive BitwiseAnd BitwiseOr BitwiseXor BitwiseNot ShiftLeft ShiftRight ShiftRightUnsigned "
    "Concat Lower Coalesce Substring StringTrim StringTrimLeft StringTrimRight StringLocate Overlay CreateNamedStruct SemiStructuredExtract Collate UnresolvedCollation "
    "TimestampAdd TimestampDiff AggregateExpression First Last AnyValue WindowExpression UnresolvedWindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame "
    "CurrentRow UnboundedPreceding UnboundedFollowing ScalarSubquery Exists ListQuery InSubquery LateralSubquery FunctionTableSubqueryArgumentExpression "
    "CurrentDate CurrentTimestamp".split()
)
ALLOWED = {
    "org.apache.spark.sql.catalyst.plans.logical": PLANS,
    "org.apache.spark.sql.catalyst.analysis": NOT_RESOLVED,
    "org.apache.spark.sql.catalyst.expressions": EXPRESSIONS,
    "org.apache.spark.sql.catalyst.expressions.aggregate": EXPRESSIONS,
}
#: What the resolved plan may read besides files of the views it names.
CONSTANT_LEAVES = frozenset("OneRowRelation LocalRelation Range CTERelationRef UnionLoopRef".split())


class ReadOnlyError(ValueError):
    """A statement that is no plain query over the registered tables."""


def _name(parts) -> str:
    return ".".join(parts.apply(i) for i in range(parts.size())).lower()


class _Nodes:
    """All nodes of a plan, with those inside lists, options and pairs of any node's arguments."""

    def __init__(self, spark: SparkSession):
        named = spark._jvm.java.lang.Class.forName
        self.tree, self.many, self.product = map(named, ("org.apache.spark.sql.catalyst.trees.TreeNode", "scala.collection.IterableOnce", "scala.Product"))

    def __call__(self, plan: JavaObject) -> Iterator[JavaObject]:
        todo = [plan]
        while todo:
            value = todo.pop()
            if not isinstance(value, JavaObject):
                continue
            node = self.tree.isInstance(value)
            if node:
                yield value
            if self.many.isInstance(value) or self.product.isInstance(value):
                parts = value.productIterator() if node or not self.many.isInstance(value) else value.iterator()
                while parts.hasNext():
                    todo.append(parts.next())


def _class(node: JavaObject) -> tuple[str, str]:
    """(package, class name) of a node; of an inner class, the outer one's name."""
    package, _, name = node.getClass().getName().rpartition(".")
    return package, name.split("$")[0]


def check_read_only(spark: SparkSession, query: str) -> frozenset[str]:
    """Reject everything but queries over known tables with known functions; gives the tables and views that the query reads.

    The parsed plan decides, not the text: each of its nodes must be of a
    listed class, so commands, paths, names made by expressions, scripts and
    reads of older states do not pass. Relations must be input tables,
    temporary views or names that the query itself defines; functions must be
    known and not in ``FORBIDDEN``.
    """
    if not query.strip():
        raise ReadOnlyError("an empty query")
    relations, functions, defined, tables = set(), set(), set(), set()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as error:
        raise ReadOnlyError(f"no query: {str(error).splitlines()[0]}") from error
    for node in _Nodes(spark)(plan):
        package, kind = _class(node)
        if kind not in ALLOWED.get(package, ()):
            raise ReadOnlyError(f"not allowed in a read-only query: {kind}")
        if kind == "UnresolvedRelation":
            if node.isStreaming() or not node.options().isEmpty():
                raise ReadOnlyError("tables are read as they are")
            relations.add(_name(node.multipartIdentifier()))
        elif kind == "UnresolvedFunction":
            functions.add(_name(node.nameParts()))
        elif kind == "UnresolvedGenerator":
            functions.add(node.name().unquotedString().lower())
        elif kind == "UnresolvedTableValuedFunction":
            tables.add(_name(node.name()))
        elif kind == "UnresolvedWith":
            named = node.cteRelations()
            defined.update(named.apply(i)._1().lower() for i in range(named.size()))
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    if unknown := relations - defined - views - set(TABLES):
        raise ReadOnlyError(f"unknown tables: {', '.join(sorted(unknown))}")
    if unknown := tables - TABLE_FUNCTIONS:
        raise ReadOnlyError(f"table functions that are not allowed: {', '.join(sorted(unknown))}")
    known = {r[0].lower() for r in spark.sql("SHOW ALL FUNCTIONS").collect()} - FORBIDDEN
    if unknown := functions - known:
        raise ReadOnlyError(f"functions that are not allowed: {', '.join(sorted(unknown))}")
    return frozenset(relations)


def _sources(spark: SparkSession, df: DataFrame) -> tuple[set[str], set[str]]:
    """(folders and files that the resolved plan reads, kinds of its other leaves)."""
    paths, others = set(), set()
    leaf = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LeafNode")
    for node in _Nodes(spark)(df._jdf.queryExecution().analyzed()):
        kind = _class(node)[1]
        if kind == "CallMethodViaReflection":
            raise ReadOnlyError("calls of methods are not allowed")
        if leaf.isInstance(node) and kind == "LogicalRelation" and hasattr(node.relation(), "location"):
            roots = node.relation().location().rootPaths()
            paths.update(roots.apply(i).toString() for i in range(roots.size()))
        elif leaf.isInstance(node):
            others.add(kind)
    return paths, others - CONSTANT_LEAVES


def register(spark: SparkSession, sf_dir: str, query: str = "") -> None:
    """Temp views of the input tables that the query's text names; all if it is empty."""
    for name in TABLES:
        if not query or name in query.lower():
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def run_query(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """The query's rows. What it resolves to must read nothing but what the views it names read."""
    named = check_read_only(spark, query)
    register(spark, sf_dir, query)
    result = spark.sql(query)
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    paths, others = _sources(spark, result)
    for name in named & views:
        held_paths, held_others = _sources(spark, spark.table(name))
        paths, others = paths - held_paths, others - held_others
    if paths or others:
        raise ReadOnlyError(f"reads more than its tables: {', '.join(sorted(paths | others))}")
    return result
