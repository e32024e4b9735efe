"""The driver's tables as change tables, for queries that can be checked by SQL on the same files.

Expressions are SQL that both engines read alike, so each stand-in has one definition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from driftrank.tables import spread, table

KINDS = (
    "OBJECT_REMOVED", "PARAMETER_REMOVED", "PARAMETER_ADDED_REQUIRED", "PARAMETER_CHANGED_REQUIRED", "PARAMETER_CHANGED_DEFAULT", "PARAMETER_CHANGED_KIND",
    "PARAMETER_MOVED", "RETURN_CHANGED_TYPE", "ATTRIBUTE_CHANGED_TYPE", "ATTRIBUTE_CHANGED_VALUE", "CLASS_REMOVED_BASE", "OBJECT_CHANGED_KIND",
)
_LEAF = "case l_linenumber % 4 when 0 then '_n' || (l_partkey % 300) when 2 then '__d' || (l_partkey % 300) || '__' else 'N' || (l_partkey % 300) end"
CHANGES = {
    "package": "cast(o_custkey as bigint)",
    "upgrade": "cast(l_orderkey as bigint)",
    "released_at": "o_orderdate",
    "symbol": f"'r' || (l_suppkey % 9) || '.m' || (l_partkey % 23) || '.' || {_LEAF}",
    "kind": "case (l_partkey + l_linenumber) % 12 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end",
    "sub_target": "case when l_linenumber % 3 = 0 then '' else 'p' || l_linenumber end",
    "is_private": "l_linenumber % 4 = 0",
    "label": "case when l_returnflag = 'R' then 1 else 0 end",
    "score": "case when l_tax > 0.03 then l_discount + l_quantity / 1000 end",
    "quantity": "l_quantity",
    "line": "cast(l_linenumber as bigint)",
    "inherited_by": "cast(l_linenumber % 3 as bigint)",
    "in_dunder_all": "l_partkey % 7 = 0",
    "was_deprecated_before": "l_suppkey % 11 = 0",
    "explanation": "'pkg.py:' || l_linenumber || ': ' || case l_linenumber % 4 when 1 then 'N' || (l_partkey % 300) else 'C.x' end || ': Attribute value was changed: 1 -> ' || case when l_partkey % 5 = 0 then 'unset' else '2' end",
    "export_paths": "case when l_partkey % 3 = 0 then 'r' || (l_suppkey % 9) || '.N' || (l_partkey % 300) || ';' || 'r' || (l_suppkey % 9) || '.m' || ((l_partkey + 1) % 23) || '.N' || (l_partkey % 300) else '' end",
}
#: Common table expressions of the stand-ins, for the checking SQL.
CTE = f"""ch as (select {', '.join(f'{e} as {n}' for n, e in CHANGES.items())} from lineitem join orders on l_orderkey = o_orderkey),
us as (select symbol, count(distinct package) as user_count from ch where label = 1 and not is_private group by symbol),
rel as (select cast(o_custkey as bigint) as package, cast(o_orderkey as bigint) as upgrade, o_orderdate as released_at, {{version}} as version, o_orderstatus as status, o_totalprice as price from orders)"""
VERSION = "(o_orderkey % 3) || '.' || (o_orderkey % 12) || '.' || (o_custkey % 5)"
CTE = CTE.replace("{version}", VERSION)
RELEASES = {"package": "cast(o_custkey as bigint)", "upgrade": "cast(o_orderkey as bigint)", "released_at": "o_orderdate", "version": VERSION, "status": "o_orderstatus", "price": "o_totalprice"}


class Standins:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def n_changes(self) -> int:
        """Rows of changes, as the table's footers tell it."""
        return self.table("lineitem").count()

    @cached_property
    def changes(self) -> DataFrame:
        items, orders = self.table("lineitem"), self.table("orders")
        items, orders = spread(self.n_changes, (items, "l_orderkey"), (orders, "o_orderkey"))
        return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).selectExpr(*[f"{e} as {n}" for n, e in CHANGES.items()])

    @cached_property
    def releases(self) -> DataFrame:
        return self.table("orders").selectExpr(*[f"{e} as {n}" for n, e in RELEASES.items()])

    @cached_property
    def usage(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.changes.where("label = 1 and not is_private").groupBy("symbol").agg(F.count_distinct("package").alias("user_count"))
