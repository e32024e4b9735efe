"""Registered queries of learned rankers: model files and boosted trees on pairwise gradients over the 17 features."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftrank.functions import versions
from driftrank.operators import labels, ranker, trees
from driftrank.plans.catalogue import _pairs, query
from driftrank.plans.standins import CTE
from driftrank.tables import park

#: A model file of two trees: a numeric split with missing values to the left, a category split, and one where zero counts as missing.
TREE_FILE = """tree
version=v4
feature_names=quantity kind score
feature_infos=[1:50] 0:1:2 [0:1]
objective=lambdarank

Tree=0
num_leaves=3
num_cat=1
split_feature=0 1
threshold=24.5 0
decision_type=10 9
left_child=-1 -2
right_child=1 -3
leaf_value=0.25 -0.5 1
cat_boundaries=0 1
cat_threshold=5

Tree=1
num_leaves=3
num_cat=0
split_feature=2 0
threshold=0.06 10
decision_type=8 4
left_child=-1 -2
right_child=1 -3
leaf_value=0.125 2 -2

end of trees

pandas_categorical:[["OBJECT_REMOVED", "PARAMETER_MOVED", "RETURN_CHANGED_TYPE"]]
"""


@query("""t as (select upgrade, line, score, kind, case when line % 5 <> 0 then quantity end as q, case when line % 7 = 0 then 0 else quantity end as z from ch)
select upgrade, line, cast((case when q is null or q <= 24.5 then 0.25 when kind in ('OBJECT_REMOVED', 'RETURN_CHANGED_TYPE') then -0.5 else 1 end)
+ (case when score <= 0.06 then 0.125 when coalesce(q, 0) <> 0 and q <= 10 then 2 else -2 end) as double) as tree_score from t""")
def q_tree_file(s):
    forest = trees.parse(TREE_FILE)
    rows = s.changes.withColumn("quantity", F.when(F.expr("line % 5 <> 0"), F.col("quantity")))
    return rows.select("upgrade", "line", forest.score().alias("tree_score"))


@query(f"""select upgrade, line from (with {CTE} select upgrade, line, released_at, quantile_cont(cast(epoch_us(released_at) as double), 0.8) over () as cut from ch) where epoch_us(released_at) > cut""", cte=False)
def q_lambdarank(s):
    """The later fifth of the rows, ranked by trees that learned from those before: which rows are scored can be told by SQL."""
    bumps = _pairs(s).select("upgrade", versions.bump(F.col("version_from"), F.col("version_to")).alias("bump"))
    ranks = s.releases.select("package").distinct().withColumn("package_rank", F.col("package") % 100)
    rows = labels.feature_table(s.changes, bumps, ranks, rows=s.n_changes).select("upgrade", "line", "label", "released_at", *labels.FEATURES)
    rows = park(rows, "features")  # cut points, bins and scores each read them
    rows = labels.split_by_date(rows, "released_at", 0.2)
    train = labels.split_by_date(rows.where("split = 'train'").drop("split"), "released_at", 0.2)
    numeric = [*labels.NUMERIC, *labels.BOOLEAN]
    fitted = ranker.fit(train.where("split = 'train'"), train.where("split = 'test'"), ["upgrade"], "label", numeric, labels.CATEGORICAL, ["line"], rounds=4, depth=3, stop=2)
    return rows.where("split = 'test'").withColumn("s", fitted.forest.score()).where("s is not null").select("upgrade", "line")
