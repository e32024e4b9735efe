"""Registered queries of scalar functions, small set operations and sources, on texts made from the stand-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftrank.functions import names, versions
from driftrank.operators import api, graph, labels, relational, reports, rules, serve, store
from driftrank.plans.catalogue import NUMBER, big, query
from driftrank.sources import files
from driftrank.tables import shared_dir

_TESTS = "case when line % 3 = 0 then 'tests.' when line % 3 = 1 then 'a.test_' else 'contest.' end || symbol"


@query(f"""t as (select distinct symbol, explanation, line, {_TESTS} as p from ch)
select symbol, line, explanation as plain, regexp_replace(explanation, '^[^\\s:]+:\\d+:\\s*', '') as bare, 'a b ' || symbol as flat, left(explanation, 10) as short, lower(regexp_replace(symbol, '[-_.]', '', 'g')) as squeezed,
cast(line as varchar) as value, symbol || '|' || kind_word as words, regexp_matches(p, '(^|[./])(tests([./]|$)|test_)') as is_test, case when line % 2 <> 0 then line / cast(line % 2 as double) end as ratio from (select *, 'k' || line as kind_word from t)""")
def q_text_functions(s):
    rows = s.changes.select("symbol", "explanation", "line").distinct()
    c, esc = F.col, F.lit("\x1b[1;31m")
    head = F.when(F.expr("line % 3 = 0"), "tests.").when(F.expr("line % 3 = 1"), "a.test_").otherwise("contest.")
    return rows.select(
        "symbol", "line", names.without_colour(F.concat(esc, "explanation", F.lit("\x1b[0m"))).alias("plain"), names.without_location(c("explanation")).alias("bare"),
        names.one_line(F.concat(F.lit("  a\n\t b \n"), "symbol", F.lit(" "))).alias("flat"), names.one_line(c("explanation"), 10).alias("short"), names.squeezed(c("symbol")).alias("squeezed"),
        names.value_of(F.concat(F.lit("seen x=1 at n="), "line", F.lit(", then")), "n").alias("value"),
        F.array_join(names.quoted_words(F.concat(F.lit("check (a in ('"), "symbol", F.lit("', 'k"), "line", F.lit("'))"))), "|").alias("words"),
        names.is_test_code(F.concat(head, "symbol")).alias("is_test"), names.ratio(c("line").cast("double"), F.expr("line % 2")).alias("ratio"),
    )


@query("""select upgrade, case upgrade % 5 when 0 then 'own' || package || '/rep' || upgrade when 1 then 'Own/rep.x' end as repository from rel""")
def q_repository(s):
    url = (
        F.when(F.expr("upgrade % 5 = 0"), F.concat(F.lit("https://github.com/own"), "package", F.lit("/rep"), "upgrade", F.lit(".git")))
        .when(F.expr("upgrade % 5 = 1"), "http://www.GitHub.com/Own/rep.x/tree/main?tab=1").when(F.expr("upgrade % 5 = 2"), F.concat(F.lit("https://github.com/"), F.when(F.expr("package % 2 = 0"), "users").otherwise("Sponsors"), F.lit("/own")))
        .when(F.expr("upgrade % 5 = 3"), "https://example.org/own/rep").otherwise("git+https://github.com/own/rep")
    )
    return s.releases.select("upgrade", names.repository(url).alias("repository"))


@query("""select upgrade, upgrade % 7 in (0, 2, 3, 4) as flag, case upgrade % 7 when 0 then 1.0 when 1 then 0.0 when 2 then 1.0 when 6 then 2.5 end as number from rel""")
def q_flags(s):
    texts = F.array(*[F.lit(x) for x in ("True", "false", "1", " yes ", "T", "nan", "2.5")])
    text = texts[(F.col("upgrade") % 7).cast("int")]
    return s.releases.select("upgrade", names.flag(text).alias("flag"), names.number(text).alias("number"))


@query("""select upgrade, version || (case upgrade % 6 when 1 then 'rc1' when 2 then '.dev2' when 3 then '.x.y' when 4 then 'a1.dev3' else '' end) as version,
case when upgrade % 6 = 3 then 'unparseable' when upgrade % 6 in (2, 4) then 'dev' when upgrade % 6 = 1 then 'prerelease' when upgrade % 4 = 0 then 'yanked' when upgrade % 9 = 0 then 'no_source' end as reason, upgrade % 6 in (0, 5) as padded_equal from rel""")
def q_skip_reason(s):
    tail = F.array(*[F.lit(x) for x in ("", "rc1", ".dev2", ".x.y", "a1.dev3", "")])[(F.col("upgrade") % 6).cast("int")]
    rows = s.releases.withColumn("v", F.concat("version", tail))
    v = F.col("v")
    padded = F.coalesce(versions.key(v) == versions.key(F.concat(v, F.lit(".0.0"))), F.lit(False)) & F.expr("upgrade % 6 in (0, 5)")
    return rows.select("upgrade", v.alias("version"), versions.skip_reason(v, F.expr("upgrade % 4 = 0"), F.expr("upgrade % 9 <> 0")).alias("reason"), padded.alias("padded_equal"))


@query("""select upgrade, case upgrade % 4 when 0 then released_at when 1 then released_at + interval '10 hours 30 minutes' when 2 then released_at + interval '10 hours 30 minutes' - interval '2 hours' end as at from rel""")
def q_instants(s):
    day = F.date_format("released_at", "yyyy-MM-dd")
    text = F.when(F.expr("upgrade % 4 = 0"), day).when(F.expr("upgrade % 4 = 1"), F.concat(day, F.lit("T10:30:00"))).when(F.expr("upgrade % 4 = 2"), F.concat(day, F.lit("T10:30:00+02:00"))).otherwise("soon")
    return s.releases.select("upgrade", names.instant(text).cast("timestamp_ntz").alias("at"))


@query("select symbol, symbol = 'r1' or starts_with(symbol, 'r1.') or symbol = 'r2.m3' or starts_with(symbol, 'r2.m3.') as bad from (select distinct symbol from ch)")
def q_bad_roots(s):
    return s.changes.select("symbol").distinct().select("symbol", rules.under_any(F.col("symbol"), ["r1", "r2.m3"]).alias("bad"))


@query("select distinct package, 'cust-x-' || package as canon from rel where package % 3 = 0")
def q_canonical_join(s):
    name = lambda form: names.canonical(F.format_string(form, "package"))
    left = s.releases.select("package", name("Cust_x.%d").alias("canon")).distinct()
    return left.join(s.releases.where("package % 3 = 0").select(name("CUST--X_%d").alias("canon")).distinct(), "canon", "left_semi").select("package", "canon")


@query("""e as (select distinct 'r' || (p_partkey % 9) || '.a' || (p_partkey % 50) as target, 's' || (p_partkey % 4) || '.b' || (p_partkey % 40) as alias from part)
select target, string_agg(alias, ';' order by alias) as aliases from e where split_part(target, '.', 1) in ('r1', 'r4') group by target""")
def q_reversed_aliases(s):
    e = s.table("part").selectExpr("concat('r', p_partkey % 9, '.a', p_partkey % 50) as target", "concat('s', p_partkey % 4, '.b', p_partkey % 40) as alias")
    return graph.reversed_aliases(e, ["r1", "r4"]).select("target", F.array_join("aliases", ";").alias("aliases"))


@query("""e as (select upgrade from ch group by upgrade having bool_and(is_private or label = 1)), t as (select rel.*, row_number() over (partition by package order by released_at desc, upgrade desc) as n from rel join e using (upgrade))
select package, upgrade, version from t where n = 1 order by released_at desc, package limit 10""")
def q_all_clear(s):
    clear = rules.emptied_groups(s.changes, F.col("is_private") | (F.col("label") == 1), ("upgrade",)).select("upgrade")
    rows = s.releases.join(clear, "upgrade")
    return reports.newest_each(rows, "package", [F.desc("released_at"), F.desc("upgrade")], [F.desc("released_at"), F.asc("package")], 10).select("package", "upgrade", "version")


@query("""a as (select quantile_cont(cast(epoch_us(released_at) as double), 0.8) as cut from ch), t as (select ch.* from ch, a where epoch_us(released_at) <= cut), b as (select quantile_cont(cast(epoch_us(released_at) as double), 0.8) as cut from t)
select case when epoch_us(released_at) > cut then 'validate' else 'fit' end as role, count(*) as rows, cast(sum(label) as bigint) as positives from t, b group by 1""")
def q_validation_slice(s):
    train = labels.split_by_date(s.changes, "released_at", 0.2).where("split = 'train'").drop("split")
    role = F.when(F.col("split") == "test", "validate").otherwise("fit")
    return labels.split_by_date(train, "released_at", 0.2).groupBy(role.alias("role")).agg(F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives"))


@query("t as (select *, row_number() over (partition by package, status order by upgrade) as n from rel) select package, status, upgrade, version from t where n = 1")
def q_keep_first(s):
    return relational.keep_first(s.releases, ["package", "status"], "upgrade").select("package", "status", "upgrade", "version")


@query("select true as same, false as other, (select count(*) from (select distinct package, status from rel)) as groups, true as scored, false as unscored")
def q_key_sets(s):
    r, few = s.releases, s.releases.where("upgrade % 2 = 0")
    has = lambda where: not s.changes.where(where).limit(1).isEmpty()
    groups = r.select("package", "status").distinct().agg(F.count("*").alias("groups"))
    return groups.select(F.lit(relational.same_keys(r, r, ["upgrade"])).alias("same"), F.lit(relational.same_keys(r, few, ["upgrade"])).alias("other"), "groups", F.lit(has("score is not null")).alias("scored"), F.lit(has("score > 1000")).alias("unscored"))


@query("select symbol, kind, case when starts_with(kind, 'PARAMETER') then 'p' || line when kind = 'CLASS_REMOVED_BASE' then case when line % 2 = 0 then 'B' else 'A,B' end else '' end as sub_target, 'new' as added from (select distinct symbol, kind, line from ch)")
def q_sub_targets(s):
    rows = relational.default_column(s.changes.select("symbol", "kind", "line").distinct(), "added", "new")
    now = F.when(F.expr("line % 2 = 0"), F.array(F.lit("A"), F.lit("C"))).otherwise(F.array(F.lit("C")))
    return rows.select("symbol", "kind", rules.sub_target(F.col("kind"), F.concat(F.lit("p"), "line"), F.array(F.lit("A"), F.lit("B")), now).alias("sub_target"), "added")


def _fresh(s, label: str) -> str:
    """A path in the shared folder that no other call writes to, as results are read from it later."""
    return f"{shared_dir(s.spark)}/driftrank/{label}-{uuid.uuid4().hex}"


@query("select package, version, released_at, price from rel")
def q_csv_scan(s):
    where = _fresh(s, "csv-scan")
    s.releases.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(where)  # a second write replaces the first
    s.releases.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(where)
    schema = ", ".join(f"{f.name} {'string' if f.name == 'released_at' else f.dataType.simpleString()}" for f in s.releases.schema)
    out = files.csv(s.spark, where, schema)
    none = files.optional_csv(s.spark, f"{where}-none", schema)
    return out.unionAll(none).select("package", "version", F.col("released_at").cast("timestamp_ntz").alias("released_at"), "price")


@query("select row_number() over (order by c_custkey) as rank, c_name as package from customer order by c_custkey limit 50", cte=False)
def q_ranked_json(s):
    where = _fresh(s, "ranked-json")
    listed = s.table("customer").orderBy("c_custkey").limit(200)  # a list of 200, as the feature reads it
    doc = listed.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.struct(x["c_name"].alias("project"))).alias("rows"))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(where)
    return files.ranked_json(s.spark, where, limit=50).select(*big("rank"), "package")


@query("select distinct 'line ' || (upgrade % 40) as line from rel")
def q_line_set(s):
    where = _fresh(s, "line-set")
    s.releases.select(F.concat(F.lit("  line "), F.col("upgrade") % 40, F.when(F.expr("upgrade % 2 = 0"), " ").otherwise("\n"))).write.mode("overwrite").text(where)
    return files.lines(s.spark, where)


@query("""t as (select package, upgrade, 'r' || (upgrade % 9) as a, 'r' || (package % 9) as b from rel)
select symbol, count(distinct package) as user_count from (select package, a || '.core' as symbol, a as root, b from t where upgrade % 10 <> 0 union all select package, a || '.core.run' || (upgrade % 3), a, b from t where upgrade % 10 <> 0 union all select package, a || '.x.N' || (upgrade % 5), a, b from t where upgrade % 10 <> 0 union all select package, a || '.core.sub.deep' || (upgrade % 4), a, b from t where upgrade % 10 <> 0 union all select package, a || '.core.sub', a, b from t where upgrade % 10 <> 0) where root <> b group by symbol""")
def q_usage_from_source(s):
    root = F.format_string("r%d", F.expr("upgrade % 9"))
    text = F.format_string("import %s.core as c\nfrom %s.x import N%d\nimport os, untracked.y\nc.run%d(N%d, c.sub.deep%d)\n", root, root, F.expr("upgrade % 5"), F.expr("upgrade % 3"), F.expr("upgrade % 5"), F.expr("upgrade % 4"))
    code = s.releases.select(F.col("package").alias("scanner"), F.array(F.format_string("r%d", F.expr("package % 9"))).alias("own_roots"), F.when(F.expr("upgrade % 10 = 0"), "def (").otherwise(text).alias("text"))
    pairs = files.usage_pairs(code.withColumn("scanner", F.col("scanner").cast("string")), [f"r{i}" for i in range(9)])
    return files.usage_index(pairs).select("symbol", *big("user_count"))


@query("""p as (select p_partkey as k from part)
select 'm' || k || '.f' as symbol, 'function' as what, '' as parameter, k % 3 = 0 as deprecated from p union all select 'm' || k || '.f', 'parameter', 'a', k % 3 = 0 from p union all select 'm' || k || '.f', 'parameter', 'b' || (k % 4), k % 3 = 0 from p
union all select 'm' || k || '.g', 'alias', '', false from p union all select 'm' || k || '.h', 'function', '', k % 4 < 2 from p""", )
def q_parsed_symbols(s):
    mark = F.when(F.expr("p_partkey % 3 = 0"), "@deprecated('soon')\n").otherwise("")
    said = F.array(*[F.lit(x) for x in ("Deprecated: use f.", "This function has been deprecated.", "A mode is deprecated.", ":param x: deprecated")])[F.expr("p_partkey % 4")]
    text = F.concat(mark, F.format_string("def f(a, b%d=1): ...\nfrom n%d import h as g\n@deprecated_params('a')\ndef h():\n    '%s'\n", F.expr("p_partkey % 4"), F.col("p_partkey"), said))
    code = s.table("part").select(F.lit("p").alias("package"), F.lit("1").alias("version"), F.format_string("m%d", "p_partkey").alias("module"), text.alias("text"))
    return api.symbols(code).select("symbol", "what", "parameter", "deprecated")


@query("select 'm' || p_partkey || '.g' as alias, 'n' || p_partkey || '.h' as target from part", cte=False)
def q_alias_edges(s):
    code = s.table("part").select(F.lit("p").alias("package"), F.lit("1").alias("version"), F.format_string("m%d", "p_partkey").alias("module"), F.format_string("from n%d import h as g\n", "p_partkey").alias("text"))
    return api.alias_edges(api.symbols(code))


@query("""t as (select upgrade, price from rel where upgrade % 3 <> 0), n as (select upgrade, price * 2 as price from rel where upgrade % 2 = 0)
select coalesce(n.upgrade, t.upgrade) as upgrade, coalesce(n.price, t.price) as price, n.upgrade is not null as stamped from t full join n on t.upgrade = n.upgrade""")
def q_stamped_upsert(s):
    old = s.releases.where("upgrade % 3 <> 0").select("upgrade", "price", F.lit(None).cast("timestamp").alias("computed_at"))
    new = s.releases.where("upgrade % 2 = 0").select("upgrade", (F.col("price") * 2).alias("price"), F.current_timestamp().alias("computed_at"))
    return store.upsert(old, new, ["upgrade"]).select("upgrade", "price", F.col("computed_at").isNotNull().alias("stamped"))


@query("select upgrade, case when upgrade % 4 <> 0 then price end as price from rel")
def q_nan_to_null(s):
    spoiled = F.when(F.expr("upgrade % 4 = 0"), F.lit(float("nan"))).otherwise(F.col("price"))
    return s.releases.select("upgrade", F.nullif(spoiled, F.lit(float("nan"))).alias("price"))


@query(f"""k as (select distinct package, version, {NUMBER} as v, upgrade % 5 = 0 as pre from rel), h as (select package, version, v, bool_or(pre) as pre from k group by 1, 2, 3), p as (select package, min(v) as pin, bool_or(pre and v = m) as pin_pre from (select *, min(v) over (partition by package) as m from h) group by package),
j as (select h.package, h.version, row_number() over (partition by h.package order by h.v desc) as place from h join p on h.package = p.package and h.v > pin and (not pre or pin_pre))
select package, version, place from j where place <= 3""")
def q_prereleases_after(s):
    held = s.releases.groupBy("package", "version").agg(F.bool_or(F.expr("upgrade % 5 = 0")).alias("pre")).withColumn("key", versions.key(F.col("version")))
    pins = held.groupBy("package").agg(F.min("key").alias("pin_key"), F.min_by("pre", "key").alias("pin_pre"))
    return serve.releases_after(pins, held, 3).select("package", "version", *big("place"))
