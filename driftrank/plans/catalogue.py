"""Registered queries of the change-impact operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.functions import names, versions
from driftrank.operators import audit, graph, labels, metrics, relational, requirements, rules, sealed, serve, store
from driftrank.operators import sweep as sweeps
from driftrank.plans.standins import CTE, Standins
from driftrank.streaming import events
from driftrank.tables import park

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, cte: bool = True):
    """Registers a function of stand-ins under its name. sql follows the stand-ins' common table expressions."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Standins(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"with {CTE}{' ' if sql.lstrip().startswith('select') else ', '}{sql}" if cte else sql
        return f

    return add


def big(*cols: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in cols]


HOT = "score desc nulls last, case when score is null then user_count end desc nulls last, symbol, sub_target"


def _signals(s: Standins) -> DataFrame:
    return s.changes.join(s.usage, "symbol", "left").withColumn("user_count", F.coalesce("user_count", F.lit(0)))


@query(f"""t as (select ch.*, coalesce(user_count, 0) as user_count from ch left join us using (symbol) where not is_private),
v as (select upgrade, symbol, sub_target, score, user_count, count(*) over w as total, count(case when user_count > 0 then 1 end) over w as n_imported, count(score) over w as n_scored, row_number() over (partition by upgrade order by {HOT}) as rn from t window w as (partition by upgrade))
select upgrade, rn, symbol, sub_target, score, user_count, total, n_imported, case when n_scored > 0 then 'model' else 'usage' end as ranking from v where rn <= 5""")
def q_hot_rank(s):
    out = serve.rank_releases(_signals(s), "upgrade", 5)
    return out.select("upgrade", *big("rn"), "symbol", "sub_target", "score", *big("user_count", "total", "n_imported"), "ranking")


@query("""select upgrade, count(*) as total, count(case when coalesce(user_count, 0) > 0 then 1 end) as n_imported, count(case when is_private then 1 end) as n_private from ch left join us using (symbol) group by upgrade""")
def q_counts(s):
    return _signals(s).groupBy("upgrade").agg(F.count("*").alias("total"), F.count_if(F.col("user_count") > 0).alias("n_imported"), F.count_if("is_private").alias("n_private"))


@query(f"""t as (select ch.*, coalesce(user_count, 0) as user_count, row_number() over (partition by package, symbol, kind, sub_target order by released_at desc, upgrade desc, score desc nulls last, label desc) as copy from ch left join us using (symbol) where not is_private),
v as (select upgrade, symbol, sub_target, score, user_count, count(*) over w as release_total, count(score) over w as release_scored, row_number() over (partition by upgrade order by {HOT}) as rn from t where copy = 1 window w as (partition by upgrade))
select * from v where rn <= 3""")
def q_analyze(s):
    rows = serve.newest_copies(_signals(s).where(~F.col("is_private")), ["package", "symbol", "kind", "sub_target"], F.col("released_at"), [F.desc("upgrade"), F.col("score").desc_nulls_last(), F.desc("label")])
    out = serve.rank_releases(rows, "upgrade", 3)
    return out.select("upgrade", "symbol", "sub_target", "score", *big("user_count"), F.col("total").cast("bigint").alias("release_total"), F.col("n_scored").cast("bigint").alias("release_scored"), *big("rn"))


@query("select symbol, user_count from us")
def q_usage_index(s):
    return s.usage


@query("select package, upgrade, symbol, sub_target, coalesce(user_count, 0) as user_count, case when user_count > 0 then 1 else 0 end as label from ch left join us using (symbol)")
def q_label_exact(s):
    return labels.exact_label(s.changes.drop("label"), s.usage).select("package", "upgrade", "symbol", "sub_target", *big("user_count"), "label")


@query("""t as (select distinct symbol, split_part(symbol, '.', 1) as r, split_part(symbol, '.', -1) as l from ch),
o as (select r, l, count(distinct symbol) as owners from t group by r, l),
n as (select split_part(symbol, '.', 1) as r, split_part(symbol, '.', -1) as l, sum(user_count) as by_name from us group by 1, 2)
select t.symbol, cast(owners as bigint) as leaf_owners, cast(case when owners = 1 then greatest(coalesce(by_name, 0), coalesce(user_count, 0)) else coalesce(user_count, 0) end as bigint) as scoped_user_count, case when coalesce(user_count, 0) > 0 or (owners = 1 and coalesce(by_name, 0) > 0) then 1 else 0 end as label_scoped
from t join o using (r, l) left join n using (r, l) left join us using (symbol)""")
def q_label_scoped(s):
    out = labels.scoped_label(labels.exact_label(s.changes.select("symbol").distinct(), s.usage), s.usage)
    return out.select("symbol", *big("leaf_owners", "scoped_user_count"), "label_scoped")


@query("""t as (select distinct symbol, export_paths from ch),
p as (select symbol, export_paths, unnest(list_concat([symbol], list_filter(string_split(export_paths, ';'), lambda x: x <> ''))) as path from t)
select p.symbol, p.export_paths, cast(max(coalesce(user_count, 0)) as bigint) as alias_user_count, cast(min(length(path) - length(replace(path, '.', ''))) as bigint) as public_depth, case when max(coalesce(user_count, 0)) > 0 then 1 else 0 end as label_alias, p.export_paths <> '' as has_export_path from p left join us on p.path = us.symbol group by p.symbol, p.export_paths""")
def q_label_alias(s):
    rows = s.changes.select("symbol", "export_paths").distinct()
    return labels.alias_label(rows, s.usage, ["symbol", "export_paths"]).select("symbol", "export_paths", *big("alias_user_count", "public_depth"), "label_alias", "has_export_path")


@query("select upgrade, symbol, sub_target, count(*) over (partition by upgrade) as release_size from ch")
def q_release_size(s):
    return relational.group_size(s.changes, ["upgrade"], "release_size").select("upgrade", "symbol", "sub_target", "release_size")


@query("""t as (select package, upgrade, symbol, case when status = 'P' then null else ch.released_at end as d from ch join rel using (package, upgrade))
select package, upgrade, symbol, case when d is null then 0 else (select count(*) from t u where u.package = t.package and u.d < t.d) end as package_churn from t""")
def q_package_churn(s):
    rows = s.changes.join(s.releases.select("upgrade", "status"), "upgrade").withColumn("d", F.when(F.col("status") != "P", F.col("released_at")))
    return relational.count_before(rows, ["package"], "d", "package_churn").select("package", "upgrade", "symbol", "package_churn")


@query("""t as (select split_part(symbol, '.', 1) as root, released_at, count(*) as c from ch group by 1, 2)
select root, released_at, cast(coalesce(sum(c) over (partition by root order by released_at rows between unbounded preceding and 1 preceding), 0) as bigint) as prior_breaks from t""")
def q_prior_breaks(s):
    return relational.running_before(s.changes.withColumn("root", names.root(F.col("symbol"))), ["root"], "released_at", "prior_breaks")


@query("""t as (select package, count(*) as rows, max(released_at) >= timestamp '2000-06-01' as holdout from ch group by package)
select package, rows, coalesce(holdout, false) as holdout from t""")
def q_pair_date_holdout(s):
    return labels.with_holdout(s.changes, ["package"], "released_at", F.lit("2000-06-01").cast("timestamp_ntz")).groupBy("package", "holdout").agg(F.count("*").alias("rows")).select("package", "rows", "holdout")


@query("""t as (select quantile_cont(cast(epoch_us(released_at) as double), 0.8) as cut from ch)
select upgrade, symbol, sub_target, case when epoch_us(released_at) > cut then 'test' else 'train' end as split from ch, t""")
def q_temporal_split(s):
    return labels.split_by_date(s.changes, "released_at", 0.2).select("upgrade", "symbol", "sub_target", "split")


@query("""t as (select quantile_cont(cast(epoch_us(released_at) as double), [0.4, 0.55, 0.7, 0.85, 1.0]) as q from ch),
f as (select i as fold, q[i] as lo, q[i + 1] as hi from t, (values (1), (2), (3), (4)) v(i))
select cast(fold as bigint) as fold, case when epoch_us(released_at) <= lo then 'fit' else 'validate' end as role, count(*) as rows, cast(sum(label) as bigint) as positives from ch join f on epoch_us(released_at) <= hi group by 1, 2""")
def q_cv_folds(s):
    return labels.folds(s.changes, "released_at").groupBy(F.col("fold").cast("bigint").alias("fold"), "role").agg(F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives"))


@query("""t(cut) as (values (timestamp '1996-01-01'), (timestamp '1998-01-01'), (timestamp '2000-01-01'))
select cut, case when released_at <= cut then 'train' else 'test' end as split, count(*) as rows, avg(label) as rate from ch, t group by 1, 2""")
def q_cut_sweep(s):
    cuts = s.spark.createDataFrame([("1996-01-01",), ("1998-01-01",), ("2000-01-01",)], "cut string").select(F.col("cut").cast("timestamp_ntz").alias("cut"))
    return labels.at_cuts(s.changes, "released_at", cuts).groupBy("cut", "split").agg(F.count("*").alias("rows"), F.avg("label").alias("rate"))


@query("""t as (select * from ch where released_at <= timestamp '1998-01-01' and kind <> 'OBJECT_REMOVED'), r as (select kind, avg(label) as rate from t group by kind)
select ch.kind, count(*) as rows, round(min(coalesce(rate, (select avg(label) from t))), 9) as kind_prior from ch left join r on ch.kind = r.kind where released_at > timestamp '1998-01-01' group by ch.kind""")
def q_kind_prior(s):
    late = F.col("released_at") > F.lit("1998-01-01").cast("timestamp_ntz")
    out = metrics.kind_prior(s.changes.where(~late & (F.col("kind") != "OBJECT_REMOVED")), s.changes.where(late), "kind", "label")
    return out.groupBy("kind").agg(F.count("*").alias("rows"), F.round(F.min("kind_prior"), 9).alias("kind_prior"))


def _pairs(s: Standins) -> DataFrame:
    return relational.predecessor(s.releases, ["package"], [F.asc("released_at"), F.asc("upgrade")], "version", "version_from").withColumnRenamed("version", "version_to")


PAIRS = "t as (select package, upgrade, released_at, status, price, version as version_to, lag(version) over (partition by package order by released_at, upgrade) as version_from from rel)"
BUMP = "case when version_from is null then 'other' when split_part(version_from, '.', 1) <> split_part(version_to, '.', 1) then 'major' when split_part(version_from, '.', 2) <> split_part(version_to, '.', 2) then 'minor' when split_part(version_from, '.', 3) <> split_part(version_to, '.', 3) then 'patch' else 'other' end"


@query(f"{PAIRS} select package, upgrade, version_from, version_to, {BUMP} as bump from t")
def q_bump_type(s):
    return _pairs(s).select("package", "upgrade", "version_from", "version_to", versions.bump(F.col("version_from"), F.col("version_to")).alias("bump"))


@query(f"{PAIRS} select upgrade, cast(case {BUMP} when 'major' then 3 when 'minor' then 2 when 'patch' then 1 else 0 end as double) as semver from t")
def q_semver_score(s):
    return _pairs(s).select("upgrade", metrics.step_score(versions.bump(F.col("version_from"), F.col("version_to"))).alias("semver"))


@query("""t as (select c_custkey, c_mktsegment, case when c_acctbal > 0 then rank() over (order by c_acctbal desc) end as r from customer)
select c_custkey, cast(-coalesce(r, max(r) over (partition by c_mktsegment)) as double) as popularity from t""")
def q_popularity(s):
    ranked = relational.ranked(s.table("customer"), "c_acctbal", "r")
    ranked = ranked.withColumn("r", F.when(F.col("c_acctbal") > 0, F.col("r")))
    return ranked.select("c_custkey", metrics.popularity(F.col("r"), ["c_mktsegment"]).alias("popularity"))


@query("""t as (select distinct symbol, case when is_private then null else length(symbol) - length(replace(symbol, '.', '')) + (length(symbol) % 3) end as d from ch)
select symbol, cast(-coalesce(d, max(d) over ()) as double) as path from t""")
def q_path_rank(s):
    d = F.when(~F.col("is_private"), names.depth(F.col("symbol")) + F.length("symbol") % 3)
    return metrics.with_path_score(s.changes.select("symbol", d.alias("d")).distinct(), "d").select("symbol", "path")


NUMBER = "cast(split_part(version, '.', 1) as int) * 10000 + cast(split_part(version, '.', 2) as int) * 100 + cast(split_part(version, '.', 3) as int)"
RANKABLE = "t as (select *, sum(label) over (partition by package) as p, count(*) over (partition by package) as n from ch), k as (select * from t where p > 0 and n > 10)"
TIE = "coalesce(score, -1) desc, symbol, sub_target, kind, upgrade, quantity, label"


@query(f"""{RANKABLE}, o as (select *, row_number() over (partition by package order by {TIE}) as r from k), g as (select package, sum(label) / 10.0 as p10 from o where r <= 10 group by package)
select round(coalesce(avg(p10), 0), 9) as precision_at_10, count(*) as groups from g""")
def q_prec_at_k(s):
    out = metrics.precision_at(s.changes, ["package"], "label", _tie(), 10)
    return out.select(F.round("precision_at_10", 9).alias("precision_at_10"), "groups")


def _tie():
    return [F.coalesce("score", F.lit(-1.0)).desc(), *[F.asc(c) for c in ("symbol", "sub_target", "kind", "upgrade", "quantity", "label")]]


@query(f"""{RANKABLE}, o as (select *, row_number() over (partition by package order by {TIE}) as i, row_number() over (partition by package order by label desc) as j from k),
g as (select package, sum(case when i <= 10 then label / log2(i + 1) else 0 end) / sum(case when j <= 10 then label / log2(j + 1) else 0 end) as v from o group by package)
select round(coalesce(avg(v), 0), 9) as ndcg_at_10, count(*) as groups from g""")
def q_ndcg_at_k(s):
    out = metrics.ndcg_at(s.changes, ["package"], "label", _tie(), 10)
    return out.select(F.round("ndcg_at_10", 9).alias("ndcg_at_10"), "groups")


RUNS = """t as (select coalesce(score, -1) as score, label, row_number() over (order by coalesce(score, -1) desc) as pos from ch),
u as (select score, count(*) as n, sum(label) as r, min(pos) - 1 as above, sum(1.0 / pos) as inv from t group by score),
v as (select *, coalesce(sum(r) over (order by score desc rows between unbounded preceding and 1 preceding), 0) as found, sum(r) over () as p from u)"""


@query(f"{RUNS} select round(sum(cast(r as double) * (found + r) / (above + n)) / max(p), 9) as pr_auc_step, round(cast(sum(r) as double) / sum(n), 9) as floor from v")
def q_pr_auc_step(s):
    out = metrics.average_precision(s.changes.withColumn("score", F.coalesce("score", F.lit(-1.0))), "score", "label")
    return out.select(F.round("pr_auc_step", 9).alias("pr_auc_step"), F.round("floor", 9).alias("floor"))


@query(f"{RUNS} select round(sum(cast(r as double) / n * ((found + 1) * inv + (case when n > 1 then (r - 1.0) / (n - 1) else 0 end) * (n - (above + 1) * inv))) / max(p), 8) as pr_auc_ties from v")
def q_pr_auc_ties(s):
    out = metrics.average_precision(s.changes.withColumn("score", F.coalesce("score", F.lit(-1.0))), "score", "label")
    return out.select(F.round("pr_auc_ties", 8).alias("pr_auc_ties"))


@query()
def q_bootstrap(s):
    rows = s.changes.withColumns({"score": F.coalesce("score", F.lit(-1.0)), "other": -names.name_length(F.col("symbol")).cast("double")})
    return metrics.intervals(rows, ["package"], "score", "other", "label", _tie(), draws=2000)


@query("select symbol, user_count, cast(least(greatest(ceil(ln(1 + user_count)), 1), 4) as int) as grade, power(2.0, least(greatest(ceil(ln(1 + user_count)), 1), 4)) - 1 as gain from us")
def q_grades(s):
    g = names.grade(F.col("user_count"), F.lit(True))
    return s.usage.select("symbol", "user_count", g.alias("grade"), names.gain(g).alias("gain"))


@query("t as (select *, row_number() over (partition by package, status order by upgrade desc) as n from rel) select package, status, upgrade, version from t where n = 1")
def q_keep_last(s):
    return relational.keep_last(s.releases, ["package", "status"], "upgrade").select("package", "status", "upgrade", "version")


@query("""t as (select * from rel where upgrade % 3 <> 0), n as (select package, upgrade, released_at, case when upgrade % 2 = 0 then version end as version, 'N' as status, price + 1 as price from rel where upgrade % 3 <> 1)
select coalesce(t.upgrade, n.upgrade) as upgrade, coalesce(n.version, t.version) as version, case when n.upgrade is not null then n.status else t.status end as status, case when t.upgrade is not null then t.price else n.price end as price from t full join n on t.upgrade = n.upgrade""")
def q_upsert(s):
    old = s.releases.where("upgrade % 3 <> 0").select("upgrade", "version", "status", "price")
    new = s.releases.where("upgrade % 3 <> 1").select("upgrade", F.when(F.expr("upgrade % 2 = 0"), F.col("version")).alias("version"), F.lit("N").alias("status"), (F.col("price") + 1).alias("price"))
    return store.upsert(old, new, ["upgrade"], coalesced=["version"], kept=["price"])


@query("select upgrade, status, price from rel where status <> 'P' union all select upgrade, status, price * 2 from rel where status = 'P' and upgrade % 2 = 0")
def q_replace_partition(s):
    rows = s.releases.select("upgrade", "status", "price")
    return store.replace_partition(rows, rows.where("status = 'P' and upgrade % 2 = 0").withColumn("price", F.col("price") * 2), "status")


@query("select upgrade, version from rel where upgrade not in (select upgrade from ch where label = 1)")
def q_delete(s):
    return store.delete(s.releases.select("upgrade", "version"), s.changes.where("label = 1"), ["upgrade"])


@query("select upgrade, version from rel where upgrade % 2 = 0 union all select upgrade, 'new' from rel where upgrade % 2 <> 0 and upgrade % 3 = 0")
def q_insert_missing(s):
    rows = s.releases.select("upgrade", "version")
    return store.insert_missing(rows.where("upgrade % 2 = 0"), rows.where("upgrade % 3 = 0").withColumn("version", F.lit("new")), ["upgrade"])


@query("""t as (select package, upgrade, count(*) as n_seen from ch group by 1, 2), r as (select package, upgrade, case when upgrade % 50 = 0 then 0 else (select count(*) from lineitem where l_orderkey = rel.upgrade) end as n_said from rel),
b as (select coalesce(t.package, r.package) as package, n_seen, n_said from t full join (select * from r where n_said > 0) r on t.package = r.package and t.upgrade = r.upgrade)
select package, bool_and(coalesce(n_seen = n_said, false)) as trusted, count(case when n_seen is distinct from n_said then 1 end) as n_differ from b group by package""")
def q_release_plan(s):
    lines = s.table("lineitem").groupBy(F.col("l_orderkey").alias("upgrade")).agg(F.count("*").alias("n"))
    said = s.releases.join(lines, "upgrade", "left").select("package", F.col("upgrade").alias("version"), F.when(F.expr("upgrade % 50 = 0"), 0).otherwise(F.coalesce("n", F.lit(0))).alias("n_changes"), F.lit(True).alias("analysed"))
    return audit.release_plan(s.changes.withColumnRenamed("upgrade", "version_to"), said)


@query("select distinct upgrade from ch where upgrade % 7 = 0 order by upgrade")
def q_orphans(s):
    return s.changes.join(s.releases.where("upgrade % 7 <> 0"), "upgrade", "left_anti").select("upgrade").distinct()


@query("""t as (select distinct upgrade from rel where upgrade % 2 = 0), n as (select distinct upgrade from rel where upgrade % 3 = 0)
select coalesce(t.upgrade, n.upgrade) as upgrade, case when n.upgrade is null then 'gone' when t.upgrade is null then 'added' else 'kept' end as side from t full join n on t.upgrade = n.upgrade""")
def q_extra_missing(s):
    return relational.symmetric_difference(s.releases.where("upgrade % 2 = 0"), s.releases.where("upgrade % 3 = 0"), ["upgrade"])


@query("select upgrade, count(*) as rows from ch group by upgrade having bool_and(is_private or label = 1)")
def q_emptied_groups(s):
    return rules.emptied_groups(s.changes, F.col("is_private") | (F.col("label") == 1), ("upgrade",))


@query("""t as (select package, upgrade, status, sum(case when status = 'P' then 1 else 0 end) over (partition by package order by released_at, upgrade rows between unbounded preceding and current row) as island from rel)
select package, upgrade, cast(island as bigint) as island, count(*) over (partition by package, island) as island_size from t where status <> 'P'""")
def q_gaps_islands(s):
    return relational.islands(s.releases, ["package"], [F.asc("released_at"), F.asc("upgrade")], F.col("status") == "P").select("package", "upgrade", "island", "island_size")


@query(f"{PAIRS}, u as (select *, lag(version_to) over (partition by package order by released_at, upgrade) as before from t where status <> 'P') select package, upgrade, before, version_from from u where before is not null and before <> version_from")
def q_chain_holes(s):
    return audit.chain_holes(_pairs(s).where("status <> 'P'"), ["package"], [F.asc("released_at"), F.asc("upgrade")]).select("package", "upgrade", "before", "version_from")


@query("""t as (select *, row_number() over (partition by package order by cast(split_part(version, '.', 1) as int) desc, cast(split_part(version, '.', 2) as int) desc, cast(split_part(version, '.', 3) as int) desc, upgrade desc) as rn from rel)
select package, upgrade, version, rn from t where rn <= 3""")
def q_last_n(s):
    keyed = s.releases.withColumn("key", versions.key(F.col("version")))
    return relational.top_in_group(keyed, ["package"], [F.desc("key"), F.desc("upgrade")], 3).select("package", "upgrade", "version", "rn")


@query("""t as (select package, min(version) as lo from rel where status = 'F' group by package), p as (select *, cast(split_part(version, '.', 1) as int) * 10000 + cast(split_part(version, '.', 2) as int) * 100 + cast(split_part(version, '.', 3) as int) as v from rel),
b as (select package, min(v) as lo, max(v) as hi from p where status = 'F' group by package) select p.package, upgrade, version from p join b on p.package = b.package and v between lo and hi""")
def q_range_window(s):
    keyed = s.releases.withColumn("key", versions.key(F.col("version")))
    window = keyed.where("status = 'F'").groupBy("package").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return keyed.join(window, "package").where("key between lo and hi").select("package", "upgrade", "version")


@query(f"""n as (select *, {NUMBER} as v from rel), t as (select package, upgrade, released_at, version as version_to, lag(version) over (partition by package order by v, upgrade) as version_from from n), d as (select package, version_to as v, min(released_at) as from_date from t group by 1, 2)
select t.package, t.upgrade, version_from, from_date, t.released_at < timestamp '1998-01-01' and from_date >= timestamp '1998-01-01' as straddles from t join d on t.package = d.package and t.version_from = d.v where t.released_at < from_date""")
def q_out_of_order(s):
    ordered = relational.predecessor(s.releases.withColumn("key", versions.key(F.col("version"))), ["package"], [F.asc("key"), F.asc("upgrade")], "version", "version_from").withColumnRenamed("version", "version_to")
    start = F.lit("1998-01-01").cast("timestamp_ntz")
    return audit.out_of_order(ordered, ["package"]).select("package", "upgrade", "version_from", "from_date", ((F.col("released_at") < start) & (F.col("from_date") >= start)).alias("straddles"))


@query("select kind, is_private, count(*) as rows, cast(sum(label) as bigint) as positives, round(avg(label), 9) as rate from ch group by kind, is_private")
def q_rates_by_kind(s):
    return audit.rates(s.changes, ["kind", "is_private"], "label").withColumn("rate", F.round("rate", 9))


@query("t as (select split_part(symbol, '.', 1) as root, count(*) as rows from ch group by 1) select root, rows, rows / sum(rows) over () as share from t")
def q_concentration(s):
    return audit.shares(s.changes.withColumn("root", names.root(F.col("symbol"))), ["root"])


@query("select symbol, count(*) as rows from ch group by symbol having count(*) >= 3 and sum(label) = 0")
def q_dead_roots(s):
    return audit.dead_groups(s.changes, ["symbol"], "label", 3)


@query("select package, upgrade, symbol, max(label) as label, count(*) as rows, count(distinct label) > 1 as mixed from ch group by 1, 2, 3")
def q_max_collapse(s):
    return rules.one_change_each(s.changes, "label", ("package", "upgrade"))


@query("t as (select cast(floor(user_count / 10) * 10 as bigint) as bucket, case when user_count = 0 then '0' when user_count <= 5 then '1-5' when user_count <= 20 then '6-20' else '21+' end as band from us) select bucket, band, count(*) as symbols from t group by 1, 2")
def q_buckets(s):
    n = F.col("user_count")
    band = F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 20, "6-20").otherwise("21+")
    return s.usage.groupBy((F.floor(n / 10) * 10).cast("bigint").alias("bucket"), band.alias("band")).agg(F.count("*").alias("symbols"))


@query("t as (select distinct package, upgrade || '|' || version as k from rel) select package, left(sha256(string_agg(k, '|' order by k)), 12) as fingerprint from t group by package")
def q_fingerprint(s):
    return relational.fingerprint(s.releases, ["upgrade", "version"], ["package"])


@query("select kind, count(*) as rows from (select distinct symbol, kind, sub_target, explanation from ch) group by kind")
def q_dedupe_fingerprint(s):
    return rules.exact_repeats_dropped(s.changes).groupBy("kind").agg(F.count("*").alias("rows"))


@query("""with recursive e as (select p_partkey as alias, p_partkey // 3 + p_partkey % 2 as target from part where p_partkey // 3 + p_partkey % 2 <> p_partkey),
w(alias, target, steps) as (select alias, target, 1 from e union all select w.alias, e.target, steps + 1 from w join e on w.target = e.alias where steps < 16)
select alias, target from w where steps <= 10 and not exists (select 1 from e where e.alias = w.target)""", cte=False)
def q_alias_closure(s):
    edges = s.table("part").selectExpr("p_partkey as alias", "p_partkey div 3 + p_partkey % 2 as target")
    return graph.alias_closure(edges)


@query("""t as (select distinct symbol from ch), a as (select distinct 'r' || (p_partkey % 9) || '.m' || (p_partkey % 23) as target, 'r' || (p_partkey % 9) as alias from part union select distinct 'r' || (p_partkey % 9), 's' || (p_partkey % 4) from part),
p as (select symbol, array_to_string(string_split(symbol, '.')[1:i], '.') as target from t, range(1, 4) r(i) where i <= len(string_split(symbol, '.'))),
h as (select distinct symbol, alias || substr(symbol, length(p.target) + 1) as path from p join a on p.target = a.target),
k as (select symbol, path, length(path) - length(replace(path, '.', '')) as d, length(symbol) - length(replace(symbol, '.', '')) as e from h)
select symbol, path from k where d < e or (d = e and split_part(path, '.', 1) <> split_part(symbol, '.', 1))""")
def q_prefix_rewrite(s):
    part = s.table("part")
    a = part.selectExpr("'r' || (p_partkey % 9) || '.m' || (p_partkey % 23) as target", "'r' || (p_partkey % 9) as alias").union(part.selectExpr("'r' || (p_partkey % 9)", "'s' || (p_partkey % 4)")).distinct()
    return graph.other_paths(s.changes, a).select("symbol", F.explode("paths").alias("path"))


@query("""t as (select distinct package, symbol, kind, sub_target, case when is_private then 'r0.m' || length(symbol) || '.base' end as defined_at from ch),
u as (select package, coalesce(defined_at, symbol) as target, kind, sub_target, symbol, defined_at is null as own, length(symbol) - length(replace(symbol, '.', '')) as d from t)
select package, target, kind, sub_target, arg_min(symbol, (case when own then '0' else '1' end) || lpad(cast(d as varchar), 4, '0') || symbol) as symbol, count(*) - 1 as inherited_by from u group by package, target, kind, sub_target""")
def q_fold_inherited(s):
    rows = s.changes.select("package", "symbol", "kind", "sub_target", F.when(F.col("is_private"), F.concat(F.lit("r0.m"), F.length("symbol"), F.lit(".base"))).alias("defined_at")).distinct()
    return graph.fold_inherited(rows).select("package", "target", "kind", "sub_target", "symbol", "inherited_by")


@query("""t as (select package, split_part(symbol, '.', 2) as symbol, kind from ch)
select package, symbol, count(*) as moved, count(case when c then 1 end) as echoes from (select *, bool_or(kind in ('PARAMETER_REMOVED', 'PARAMETER_ADDED_REQUIRED')) over (partition by package, symbol) as c from t) where kind = 'PARAMETER_MOVED' group by 1, 2""")
def q_echo_rule(s):
    rows = rules.with_echo(s.changes.withColumn("symbol", F.substring_index(F.substring_index("symbol", ".", 2), ".", -1)), ("package",))
    return rows.where("kind = 'PARAMETER_MOVED'").groupBy("package", "symbol").agg(F.count("*").alias("moved"), F.count_if("echo").alias("echoes"))


@query("""t as (select distinct symbol, string_split(symbol, '.') as parts from ch)
select symbol, len(list_filter(parts, lambda p: starts_with(p, '_') and not starts_with(p, '__'))) > 0 as is_private, len(list_filter(parts, lambda p: starts_with(p, '__') and ends_with(p, '__') and length(p) > 4)) > 0 as is_dunder from t""")
def q_private_symbol(s):
    c = F.col("symbol")
    return s.changes.select("symbol").distinct().select("symbol", names.is_private(c).alias("is_private"), names.is_dunder(c).alias("is_dunder"))


@query("""t as (select distinct symbol from ch)
select symbol, split_part(symbol, '.', -1) as leaf, split_part(symbol, '.', 1) as root, regexp_replace(symbol, '\\.[^.]*$', '') as module, cast(length(symbol) - length(replace(symbol, '.', '')) as bigint) as depth, lower(regexp_replace(symbol, '[-_.]+', '-', 'g')) as canonical, cast(length(split_part(symbol, '.', -1)) as bigint) as name_length, regexp_matches(split_part(symbol, '.', -2), '^[A-Z]') as method from t""")
def q_name_functions(s):
    c = F.col("symbol")
    return s.changes.select("symbol").distinct().select("symbol", names.leaf(c).alias("leaf"), names.root(c).alias("root"), names.module_of(c).alias("module"), names.depth(c).cast("bigint").alias("depth"), names.canonical(c).alias("canonical"), names.name_length(c).cast("bigint").alias("name_length"), names.looks_like_method(c).alias("method"))


def _sentence_sql() -> str:
    cases = " ".join("when '{}' then {}".format(k, "'" + v.replace("'", "''").replace("%1$s", "' || symbol || '").replace("%2$s", "' || sub_target || '") + "'") for k, v in serve.SENTENCES.items())
    return f"""t as (select distinct ch.symbol, kind, sub_target, coalesce(user_count, 0) as n, length(ch.symbol) % 3 as h from ch left join us using (symbol))
select symbol, kind, sub_target, case kind {cases} when 'PARAMETER_CHANGED_DEFAULT' then case when h = 0 then symbol || ' changed in this release.' else 'The default for ' || sub_target || ' in ' || symbol || ' changed from a to b.' end end
|| case when n > 0 then ' ' || format('{{:,}}', n) || ' of the ~1,500 scanned packages ' || case when n = 1 then 'imports' else 'import' end || ' it.' else '' end
|| case when h > 0 then ' It affects ' || h || ' inheriting ' || case when h = 1 then 'class' else 'classes' end || '.' else '' end
|| case when h = 2 then ' It appears to have moved to elsewhere.' else '' end as sentence from t"""


@query(_sentence_sql())
def q_explain_text(s):
    rows = _signals(s).select("symbol", "kind", "sub_target", "user_count", (F.length("symbol") % 3).alias("h")).distinct()
    none = F.lit(None).cast("string")
    detail = F.create_map(F.lit("old_value"), F.when(F.col("h") > 0, "a").otherwise(none), F.lit("new_value"), F.lit("b"), F.lit("moved_to"), F.when(F.col("h") == 2, "elsewhere").otherwise(none))
    c = F.col
    return rows.select("symbol", "kind", "sub_target", serve.sentence(c("kind"), c("symbol"), c("sub_target"), c("user_count"), c("h"), detail).alias("sentence"))


@query("""t as (select released_at as day, count(*) as rows, cast(sum(label) as bigint) as positives from ch group by 1),
u as (select day, sum(rows) over w as held, sum(positives) over w as found, sum(rows) over () as n from t window w as (order by day desc rows between unbounded preceding and current row))
select day, cast(held as bigint) as held, cast(found as bigint) as found, held / n as share from u where found >= 500 and held / n <= 0.5 order by day desc limit 1""")
def q_boundary_search(s):
    days = s.changes.groupBy(F.col("released_at").alias("day")).agg(F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives"))
    return audit.boundary(days, 500, 0.5).select("day", *big("held", "found"), "share")


@query("select package, string_agg(distinct kind, ', ' order by kind) as kinds from ch group by package")
def q_string_agg(s):
    return s.changes.groupBy("package").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))


@query("select released_at from ch where label = 1 intersect select released_at from ch where is_private intersect select released_at from ch where score is null")
def q_shared_cuts(s):
    d = lambda where: s.changes.where(where).select("released_at")
    return d("label = 1").intersect(d("is_private")).intersect(d("score is null"))


@query("""t as (select kind, round(avg(quantity) / avg(quantity * (1 + label)), 4) as x from ch group by kind)
select count(*) as n, count(case when x > 1 then 1 end) as wins, count(case when x < 1 then 1 end) as losses, median(x) as median, case when count(case when x > 1 then 1 end) >= 6 and median(x) >= 1.25 - 1e-9 then 'model' when count(case when x < 1 then 1 end) >= 6 and median(x) <= 0.8 + 1e-9 then 'path' else 'none' end as outcome from t""")
def q_verdict(s):
    pairs = s.changes.groupBy("kind").agg(F.avg("quantity").alias("model"), F.avg(F.col("quantity") * (1 + F.col("label"))).alias("path"))
    return metrics.verdict(pairs, "model", "path")


@query("select event_type, cast(user_id % 3 as bigint) as stage, count(*) as rows, count(distinct user_id) as users from events group by 1, 2", cte=False)
def q_failures_table(s):
    return s.table("events").groupBy("event_type", (F.col("user_id") % 3).cast("bigint").alias("stage")).agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, '{' || '\"kind\":\"' || event_type || '\"' || case when user_id % 2 = 0 then ',\"user\":' || user_id else '' end || '}' as detail from events", cte=False)
def q_json_detail(s):
    kept = F.to_json(F.struct(F.col("event_type").alias("kind"), F.when(F.expr("user_id % 2 = 0"), F.col("user_id")).alias("user")))
    return s.table("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), kept.alias("detail"))


@query("""select upgrade, symbol, sub_target, cast(length(symbol) - length(replace(symbol, '.', '')) as bigint) as module_depth, cast(length(split_part(symbol, '.', -1)) as bigint) as name_length, sub_target <> '' as has_sub_target, count(*) over (partition by upgrade) as release_size, rank() over (partition by package order by released_at) - 1 as package_churn from ch""")
def q_features(s):
    out = labels.add_features(s.changes.drop("is_private"), ["upgrade"])
    return out.select("upgrade", "symbol", "sub_target", *big("module_depth", "name_length"), "has_sub_target", *big("release_size", "package_churn"))


@query("""t as (select distinct kind, explanation, symbol, split_part(symbol, '.', -1) as leaf from ch)
select kind, explanation, symbol, (kind = 'ATTRIBUTE_CHANGED_VALUE' and not ends_with(explanation, ' -> unset')) as changed, list_extract(string_split(replace(split_part(explanation, ': Attribute value was changed', 1), ' ', ':'), ':'), -1) = leaf as in_module from t""")
def q_version_rules(s):
    c = F.col
    return s.changes.select("kind", "explanation", "symbol").distinct().select("kind", "explanation", "symbol", rules.value_changed(c("kind"), c("explanation")).alias("changed"), rules.sits_in_module(c("symbol"), c("explanation")).alias("in_module"))


@query("""t as (select kind, count(*) as before from ch where upgrade % 2 = 0 group by kind), u as (select kind, count(*) as after from ch where upgrade % 2 <> 0 and kind <> 'PARAMETER_MOVED' group by kind)
select kind, before, after, after - before as change from t join u using (kind)""")
def q_compare_runs(s):
    return audit.compare_runs(s.changes.where("upgrade % 2 = 0"), s.changes.where("upgrade % 2 <> 0 and kind <> 'PARAMETER_MOVED'"), ["kind"])


@query("select status as model_version, count(*) as scores, count(case when upgrade % 3 = 0 then 1 end) as stale from rel group by status")
def q_stale_scores(s):
    return audit.stale_scores(s.releases.withColumnRenamed("status", "model_version"), s.releases.where("upgrade % 3 <> 0"), ["upgrade"])


@query("select arg_max(version, price) as model_version from rel")
def q_served_model(s):
    return serve.served_model(s.releases.select("version", F.col("price").alias("trained_at")))


@query("""t as (select upgrade, price, version from rel where upgrade % 5 <> 0), n as (select upgrade, case when upgrade % 4 = 0 then price + 1 else price end as price, version from rel where upgrade % 3 <> 0)
select coalesce(t.upgrade, n.upgrade) as upgrade, case when n.upgrade is null then 'removed' when t.upgrade is null then 'added' else 'changed' end as change from t full join n on t.upgrade = n.upgrade where n.upgrade is null or t.upgrade is null or t.price <> n.price""")
def q_snapshot_diff(s):
    rows = s.releases.select("upgrade", "price", "version")
    new = rows.where("upgrade % 3 <> 0").withColumn("price", F.when(F.expr("upgrade % 4 = 0"), F.col("price") + 1).otherwise(F.col("price")))
    return graph.snapshot_diff(rows.where("upgrade % 5 <> 0"), new, ["upgrade"], ["price", "version"])


@query(f"{PAIRS} select package, version_from as value_from, version_to as value_to from t where version_from is not null")
def q_consecutive(s):
    return graph.consecutive(s.releases, ["package"], ["released_at", "upgrade"], "version")


@query("select kind, round(median(quantity), 6) as med, round(quantile_cont(quantity, 0.025), 6) as low, round(quantile_cont(quantity, 0.975), 6) as high, min(quantity) as least, max(quantity) as most from ch group by kind")
def q_quantiles(s):
    q = F.percentile("quantity", F.array(F.lit(0.025), F.lit(0.975)))
    return s.changes.groupBy("kind").agg(F.round(F.median("quantity"), 6).alias("med"), F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"), F.min("quantity").alias("least"), F.max("quantity").alias("most"))


@query("select kind, arg_max(symbol, symbol) as top, count(*) as n from ch group by kind")
def q_arg_max(s):
    return s.changes.groupBy("kind").agg(F.max_by("symbol", F.col("symbol")).alias("top"), F.count("*").alias("n"))


@query("""t as (select distinct version, cast(split_part(version, '.', 1) as int) as a, cast(split_part(version, '.', 2) as int) as b, cast(split_part(version, '.', 3) as int) as c from rel) select version, rank() over (order by a, b, c) as place from t""")
def q_version_order(s):
    from pyspark.sql import Window

    return s.releases.select("version").distinct().select("version", F.rank().over(Window.orderBy(versions.key(F.col("version")))).cast("bigint").alias("place"))


@query("select c_custkey, c_nationkey, c_acctbal from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F') and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')", cte=False)
def q_semi_anti(s):
    orders = s.table("orders").withColumnRenamed("o_custkey", "c_custkey")
    return s.table("customer").join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(orders.where("o_orderstatus = 'P'"), "c_custkey", "left_anti").select("c_custkey", "c_nationkey", "c_acctbal")


@query("select package, cast(null as varchar) as listed, true as missing from (select distinct package from ch where package % 4 = 0) union all select cast(c_custkey as bigint), c_name, false from customer where c_custkey % 4 <> 0")
def q_complete_dimension(s):
    listed = s.table("customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("package"), F.col("c_name").alias("listed"))
    return audit.complete_dimension(listed, s.changes, "package").select("package", "listed", F.col("listed").isNull().alias("missing"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2", cte=False)
def q_windowed_events(s):
    return events.windowed(s.table("events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with e as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval '2 hours' then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from e)
select user_id, min(ts) as start, max(ts) + interval '2 hours' as "end", count(*) as n from s group by user_id, k""", cte=False)
def q_sessions(s):
    return events.sessions(s.table("events"), "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def q_requirements(s):
    lines = F.concat(F.lit("pkg-"), F.col("package"), F.when(F.expr("upgrade % 5 = 0"), F.lit(">=")).otherwise(F.lit("==")), F.col("version"), F.when(F.expr("upgrade % 3 = 0"), F.lit("  # held")).otherwise(F.lit("")))
    files = s.releases.groupBy((F.col("upgrade") % 50).alias("file")).agg(F.array_join(F.array_sort(F.collect_list(lines)), "\n").alias("text"))
    return requirements.parse(files)


@query(f"""t as (select package, version, cast(split_part(version, '.', 1) as int) * 10000 + cast(split_part(version, '.', 2) as int) * 100 + cast(split_part(version, '.', 3) as int) as v from rel),
d as (select distinct package, version, v from t), p as (select package, min(v) as pin from d group by package), j as (select d.package, d.version, row_number() over (partition by d.package order by d.v desc) as place, count(*) over (partition by d.package) as held from d join p on d.package = p.package and d.v > p.pin)
select package, version, place, greatest(held - 4, 0) as hidden from j where place <= 4""")
def q_releases_after(s):
    held = s.releases.select("package", "version").distinct().select("package", "version", versions.key(F.col("version")).alias("key"), versions.is_pre(F.col("version")).alias("pre"))
    pins = held.groupBy("package").agg(F.min("key").alias("pin_key"), F.lit(False).alias("pin_pre"))
    return serve.releases_after(pins, held, 4).select("package", "version", *big("place", "hidden"))



def _learned(s: Standins) -> tuple[DataFrame, list[str], list[str]]:
    """(all rows with the 17 features, split by date; names of numbers; names of categories)"""
    from driftrank.plans import models

    numeric, categories = [*labels.NUMERIC, *labels.BOOLEAN], list(labels.CATEGORICAL)
    bumps = _pairs(s).select("upgrade", versions.bump(F.col("version_from"), F.col("version_to")).alias("bump"))
    ranks = s.releases.select("package").distinct().where("package % 10 <> 0").withColumn("package_rank", F.col("package") % 100)
    rows = models.prepared(labels.linear_columns(labels.feature_table(s.changes, bumps, ranks, rows=s.n_changes)), numeric)
    rows = park(rows.select("released_at", "label", *labels.FEATURES), "learned")  # written once: every pass of a fit reads them
    return labels.split_by_date(rows, "released_at", 0.2), numeric, categories


@query()
def q_linear_baseline(s):
    from driftrank.plans import models

    rows, numeric, categories = _learned(s)
    train = models.balanced(rows.where("split = 'train'"), "label")
    model = models.linear(numeric, categories, "label").fit(train)
    return metrics.average_precision(models.scored(model, rows.where("split = 'test'")), "score", "label")


@query("""d as (select upgrade, max(released_at) as d from ch group by upgrade), q as (select quantile_cont(cast(epoch_us(d) as double), [0.5, 0.7, 0.9]) as q from d)
select cast(s as double) as share, make_timestamp(cast(floor(q[i]) as bigint)) as cut from q, (values (1, 0.5), (2, 0.7), (3, 0.9)) v(i, s)""")
def q_cut_points(s):
    return sweeps.cut_points(s.changes, ["upgrade"], "released_at", [0.5, 0.7, 0.9]).select("share", F.col("cut").cast("timestamp_ntz").alias("cut"))


@query("""c(cut) as (values (timestamp '1997-01-01'), (timestamp '1999-01-01'), (timestamp '2030-01-01')), a as (select * from ch join c on released_at > cut),
g as (select cut, package, sum(label) as p, count(*) as n from a group by 1, 2)
select cut, cast(sum(n) as bigint) as rows, cast(sum(p) as bigint) as positives, count(case when p > 0 and n > 10 then 1 end) as rankable, sum(p) >= 30 and count(case when p > 0 and n > 10 then 1 end) >= 10 as measured, round(cast(sum(p) as double) / sum(n), 9) as floor from g group by cut""")
def q_stability_sweep(s):
    cuts = s.spark.createDataFrame([("1997-01-01",), ("1999-01-01",), ("2030-01-01",)], "cut string").select(F.col("cut").cast("timestamp_ntz").alias("cut"))
    out = sweeps.sweep(s.changes.withColumn("score", F.coalesce("score", F.lit(-1.0))), cuts, ["package"], "released_at", "score", "label")
    return out.select("cut", *big("rows", "positives"), "rankable", "measured", F.round("floor", 9).alias("floor"))


@query(f"""o as (select *, row_number() over (partition by package order by {TIE}) as r, count(*) over (partition by package) as n from ch)
select package, count(*) as rows, cast(sum(label) as bigint) as used, cast(sum(case when r <= 10 then label else 0 end) as bigint) as hits, round(least(10, count(*)) * avg(label), 9) as expected, round(max(case when label = 1 then (r - 1.0) / nullif(n - 1, 0) end), 9) as deepest from o group by package""")
def q_story_picks(s):
    out = sweeps.stories(s.changes, ["package"], _tie(), "label")
    return out.select("package", "rows", "used", "hits", F.round("expected", 9).alias("expected"), F.round("deepest", 9).alias("deepest"))


@query("""t as (select package, version, upgrade, case when upgrade % 11 = 0 then 'yanked' when upgrade % 4 = 0 then 'prerelease' end as why, cast(split_part(version, '.', 1) as int) * 10000 + cast(split_part(version, '.', 2) as int) * 100 + cast(split_part(version, '.', 3) as int) as v from rel),
d as (select package, version, v, max(why) as why from t group by 1, 2, 3),
c as (select *, count(case when why is null then 1 end) over (partition by package) as strict, count(case when why is null or why = 'prerelease' then 1 end) over (partition by package) as loose from d),
w as (select package, version, v, case when strict < 2 and loose > strict and why = 'prerelease' then null else why end as why from c),
p as (select *, case when why is null then row_number() over (partition by package, why is null order by v desc, version desc) end as place from w)
select package, version, case when place > 3 then 'outside_window' else why end as reason, case when place <= 3 then place end as place from p""")
def q_release_window(s):
    why = F.when(F.expr("upgrade % 11 = 0"), "yanked").when(F.expr("upgrade % 4 = 0"), "prerelease")
    rows = s.releases.withColumn("w", why).groupBy("package", "version").agg(F.max("w").alias("w"))
    out = sweeps.release_window(rows, versions.key(F.col("version")), F.col("w"), 3)
    return out.select("package", "version", "reason", *big("place"))


@query("""b as (select kind as cut, round(avg(quantity), 3) as x from ch where label = 1 group by kind), a as (select kind as cut, round(avg(quantity), 3) as x from ch where label = 0 group by kind)
select b.cut, b.x as before, a.x as after, abs(a.x - b.x) > 0.25 as moved from b join a using (cut)""")
def q_compare_sweeps(s):
    one = lambda y: s.changes.where(f"label = {y}").groupBy(F.col("kind").alias("cut")).agg(F.round(F.avg("quantity"), 3).alias("x"))
    return sweeps.compare_sweeps(one(1), one(0), "x")


@query()
def q_shape_lift(s):
    rows = s.changes.withColumns({"score": F.coalesce("score", F.lit(-1.0)), "other": -names.name_length(F.col("symbol")).cast("double")})
    out = sweeps.by_shape(rows, names.is_dunder(F.col("symbol")), "score", "other", "label")
    return out.select("shape", *[F.round(c, 8).alias(c) for c in ("ap", "floor", "other_ap", "lift")])


@query()
def q_rate_intervals(s):
    return sweeps.rate_intervals(s.changes, ["package"], "kind", "label", draws=2000, base="OBJECT_REMOVED")


@query("""t as (select package, version, upgrade, cast(split_part(version, '.', 1) as int) * 10000 + cast(split_part(version, '.', 2) as int) * 100 + cast(split_part(version, '.', 3) as int) as v from rel),
e as (select package, min(v) as lo, max(v) as hi from t where upgrade % 2 = 0 group by package),
i as (select t.*, lo, hi from t join e on t.package = e.package and v between lo and hi)
select case when upgrade % 2 = 0 and v > lo then 'used' when upgrade % 7 = 0 then 'failed' when upgrade % 5 = 0 then 'yanked' when v = lo then 'no_baseline' else 'unaccounted' end as bucket, count(*) as releases, count(distinct package) as packages from i group by 1""")
def q_window_accounting(s):
    rows = s.releases.withColumn("key", versions.key(F.col("version")))
    held = rows.where("upgrade % 2 = 0")
    low = held.groupBy("package").agg(F.min("key").alias("least"))
    registry = rows.join(low, "package", "left").select("package", "version", "key", F.when(F.expr("upgrade % 5 = 0"), "yanked").alias("reason"), F.expr("upgrade % 2 = 0 and key > least").alias("used"), F.expr("upgrade % 7 = 0").alias("failed"))
    return audit.window_accounting(held, registry)


@query("""s as (select distinct symbol, split_part(symbol, '.', 1) as r, split_part(symbol, '.', -1) as l from ch), x as (select *, count(*) over (partition by r, l) as n from s),
b as (select distinct split_part(symbol, '.', 1) as r, split_part(symbol, '.', -1) as l from us where length(symbol) % 2 = 0), e as (select symbol from us where length(symbol) % 2 = 0)
select case when e.symbol is not null then 'exact' when b.l is not null and n = 1 then 'unambiguous' when b.l is not null then 'ambiguous' else 'absent' end as population, count(*) as rows from x left join e using (symbol) left join b on x.r = b.r and x.l = b.l group by 1""")
def q_lookup_gap(s):
    return audit.lookup_gap(s.changes, s.usage.where("length(symbol) % 2 = 0"), names.leaf(F.col("symbol")), names.root(F.col("symbol")))


@query("""h as (select package, upgrade, released_at >= timestamp '2000-01-01' as held from rel) select count(case when not held then 1 end) as development, count(case when held then 1 end) as holdout, count(*) as rows from h""")
def q_sealed_parts(s):
    dev, held = sealed.parts(labels.with_holdout(s.releases, ["upgrade"], "released_at", F.lit("2000-01-01").cast("timestamp_ntz")))
    sides = dev.select(F.lit(0).alias("held")).unionAll(held.select(F.lit(1).alias("held")))
    return sides.agg(F.count_if(F.col("held") == 0).alias("development"), F.count_if(F.col("held") == 1).alias("holdout"), F.count("*").alias("rows"))


@query("""t as (select upgrade from rel where upgrade % 3 <> 0), n as (select upgrade from rel where upgrade % 2 = 0)
select count(case when t.upgrade is null then 1 end) as inserted, count(case when t.upgrade is not null and n.upgrade is not null then 1 end) as updated, count(case when n.upgrade is null then 1 end) as "left" from t full join n on t.upgrade = n.upgrade""")
def q_dry_run(s):
    return store.dry_run(s.releases.where("upgrade % 3 <> 0"), s.releases.where("upgrade % 2 = 0"), ["upgrade"])
