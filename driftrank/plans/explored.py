"""Registered queries of the exploration views and of the bundle of tie-averaged measures with its bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftrank.functions import names
from driftrank.operators import explore, metrics
from driftrank.plans.catalogue import PAIRS, RANKABLE, _pairs, big, query

VIEW = f"{PAIRS}, x as (select ch.*, version_from, version_to from ch join t using (upgrade))"


def _view(s):
    return s.changes.join(_pairs(s).select("upgrade", "version_from", "version_to"), "upgrade")


@query(f"{VIEW} select package, count(*) as rows, count(distinct coalesce(version_from, '') || ' ' || version_to) as pairs, round(count(*) / (select count(*) from x), 9) as share from x group by package")
def q_by_package(s):
    return explore.by_package(_view(s)).withColumn("share", F.round("share", 9)).select("package", *big("rows", "pairs"), "share")


SERIOUS_SQL = "kind in ('OBJECT_REMOVED', 'PARAMETER_REMOVED', 'PARAMETER_ADDED_REQUIRED')"


@query(f"""k as (select kind, 0 as level, count(*) as rows, {SERIOUS_SQL} as serious from ch group by kind
union all select case when {SERIOUS_SQL} then 'serious' else 'other' end, 1, count(*), {SERIOUS_SQL} from ch group by {SERIOUS_SQL})
select kind, cast(level as bigint) as level, rows, round(rows / (select count(*) from ch), 9) as share, serious from k""")
def q_by_kind(s):
    return explore.by_kind(s.changes).select("kind", *big("level", "rows"), F.round("share", 9).alias("share"), "serious")


@query(f"{VIEW} select package, case when is_private then 'private' else 'public' end as flag, symbol, version_from, version_to, cast(length(symbol) - length(replace(symbol, '.', '')) as bigint) as depth from x where kind = 'OBJECT_REMOVED'")
def q_removed_view(s):
    return explore.removed(_view(s).withColumn("depth", names.depth(F.col("symbol")))).select("package", "flag", "symbol", "version_from", "version_to", *big("depth"))


@query(f"{VIEW}, y as (select * from x where package = (select min(package) from ch)) select version_from, version_to, count(*) over (partition by version_from, version_to) as in_pair, case when kind = 'OBJECT_REMOVED' then '!' else ' ' end as mark, kind, symbol from y")
def q_package_view(s):
    rows = _view(s).withColumn("name", F.concat(F.lit("Pkg_"), F.col("package")))
    first = s.changes.agg(F.min("package")).first()[0]
    return explore.of_package(rows, f"pkg_{first}", "name").select("version_from", "version_to", *big("in_pair"), "mark", "kind", "symbol")


MEANINGS = {"symbol": "dotted name", "kind": "what changed", "sub_target": "part of it", "explanation": "in words", "export_paths": "other names"}
_CELLS = ", ".join(f"({i}, '{c}', {c}, '{m}')" for i, (c, m) in enumerate(MEANINGS.items()))


@query(f"select upgrade, line, cast(v.place as bigint) as place, v.name, case when length(v.value) > 60 then left(v.value, 57) || '...' else coalesce(v.value, '') end as value, v.meaning from ch, lateral (values {_CELLS}) v(place, name, value, meaning)")
def q_row_cards(s):
    return explore.cards(s.changes, ["upgrade", "line"], MEANINGS).select("upgrade", "line", *big("place"), "name", "value", "meaning")


_PATH = "-cast(length(symbol) as double) desc, symbol, sub_target, kind, upgrade, line"


@query(f"""{RANKABLE}, o as (select *, row_number() over (partition by package order by {_PATH}) as r from k), g as (select package, sum(label) / 10.0 as p10 from o where r <= 10 group by package),
k20 as (select * from t where p > 0 and n > 20), o20 as (select *, row_number() over (partition by package order by {_PATH}) as r, row_number() over (partition by package order by label desc) as best from k20),
n20 as (select package, sum(case when r <= 20 then label / log2(r + 1) else 0 end) / sum(case when best <= 20 then label / log2(best + 1) else 0 end) as v from o20 group by package)
select 'path_precision_at_10' as quantity, round(avg(p10), 8) as value from g union all select 'path_ndcg_at_20', round(avg(v), 8) from n20""")
def q_path_measures(s):
    """What the bundle tells of path length beside its average precision (`q_bundle`) and the bands of the lifts (`q_bundle_bands`)."""
    rows = s.changes.withColumn("path", -F.length("symbol").cast("double"))
    return metrics.first_places(rows, ["package"], "path", "label", ["symbol", "sub_target", "kind", "upgrade", "line"]).withColumn("value", F.round("value", 8))


@query()
def q_bundle_bands(s):
    rows = s.changes.withColumns({"score": F.coalesce("score", F.lit(-1.0)), "pop": -(F.col("package") % 97).cast("double"), "path": -F.length("symbol").cast("double")})
    return metrics.lift_bands(rows, ["package"], "score", {"popularity": "pop", "path": "path"}, "label")
