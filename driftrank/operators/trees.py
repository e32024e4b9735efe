"""Forests of decision trees: read from and written to the text format of boosted-tree model files, evaluated column-wise.

A file is text: a header with the features, then a block for each tree whose arrays name each inner node's feature, threshold, kind and
children. A child below 0 is the leaf -1 - child. Kinds are bits: 1 categorical, 2 missing goes left, 4 zero counts as missing,
8 NaN counts as missing. Scores are sums of leaf values.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The bits of a node's kind, and what counts as zero.
CATEGORICAL, LEFT_IF_MISSING, ZERO_IS_MISSING, NAN_IS_MISSING = 1, 2, 4, 8
NEAR_ZERO = 1e-35


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    kind: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    sets: list[frozenset[int]] = field(default_factory=list)  # of categorical nodes, the codes that go left, by threshold

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        kind, missing = int(self.kind[node]), np.isnan(x)
        if kind & CATEGORICAL:
            codes = np.fromiter(self.sets[int(self.threshold[node])], np.int64)
            return ~missing & (x >= 0) & np.isin(np.where(missing, -1, x).astype(np.int64), codes)
        if not kind & NAN_IS_MISSING:
            x, missing = np.where(missing, 0.0, x), np.zeros(len(x), bool)
            if kind & ZERO_IS_MISSING:
                missing = np.abs(x) <= NEAR_ZERO
        return np.where(missing, bool(kind & LEFT_IF_MISSING), x <= self.threshold[node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; rows are split node by node, so each node looks at its own rows once."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if len(self.feature) else []
        while todo:
            node, rows = todo.pop()
            go = self.goes_left(node, x[rows, self.feature[node]])
            for child, part in ((int(self.left[node]), rows[go]), (int(self.right[node]), rows[~go])):
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out


@dataclass
class Forest:
    features: list[str]
    trees: list[Tree]
    categories: dict[str, list]  # of categorical features: the value of each code
    objective: str = "lambdarank"

    def matrix(self, frame: pd.DataFrame) -> np.ndarray:
        cols = []
        for f in self.features:
            if f in self.categories:
                code = pd.Index(self.categories[f]).get_indexer(frame[f]).astype(float)
                code[code < 0] = np.nan
                cols.append(code)
            else:
                cols.append(pd.to_numeric(frame[f]).astype("float64").to_numpy(na_value=np.nan))
        return np.column_stack(cols) if cols else np.zeros((len(frame), 0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += t.value[t.leaves(x)]
        return out

    def score(self) -> Column:
        """The score of each row from the columns that bear the features' names; probabilities for a binary objective."""

        @F.pandas_udf("double")
        def evaluate(frame: pd.DataFrame) -> pd.Series:
            s = self.raw(self.matrix(frame))
            return pd.Series(1 / (1 + np.exp(-s)) if self.objective.startswith("binary") else s)

        # Numbers and booleans as double, so that nulls reach the tree as NaN; categories as they are.
        return evaluate(F.struct(*[F.col(f) if f in self.categories else F.col(f).cast("double").alias(f) for f in self.features]))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """tree, node, feature, threshold, kind, codes, left, right, leaf_value: inner nodes, and leaves as nodes -1 - leaf."""
        rows = []
        for i, t in enumerate(self.trees):
            for n in range(len(t.feature)):
                cat = bool(t.kind[n] & CATEGORICAL)
                rows.append((i, n, self.features[t.feature[n]], None if cat else float(t.threshold[n]), int(t.kind[n]), sorted(t.sets[int(t.threshold[n])]) if cat else None, int(t.left[n]), int(t.right[n]), None))
            rows += [(i, -1 - n, None, None, None, None, None, None, float(v)) for n, v in enumerate(t.value)]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, kind int, codes array<int>, left int, right int, leaf_value double")

    def importances(self) -> list[tuple[str, int]]:
        """(feature, number of splits), most used first."""
        used = np.bincount(np.concatenate([t.feature for t in self.trees] + [np.zeros(0, np.int64)]).astype(np.int64), minlength=len(self.features))
        return sorted(zip(self.features, used.tolist()), key=lambda x: -x[1])

    def to_text(self) -> str:
        """The forest as a file that `parse` reads to an equal one."""
        head = {"version": "v4", "num_class": 1, "num_tree_per_iteration": 1, "label_index": 0, "max_feature_idx": len(self.features) - 1, "objective": self.objective, "feature_names": " ".join(self.features)}
        out = ["tree", *[f"{k}={v}" for k, v in head.items()], ""]
        for i, t in enumerate(self.trees):
            words, bounds = [], [0]
            for s in t.sets:
                own = [0] * (max(s, default=0) // 32 + 1)
                for code in s:
                    own[code // 32] |= 1 << code % 32
                words += own
                bounds.append(len(words))
            arrays = {"split_feature": t.feature, "threshold": [repr(float(x)) for x in t.threshold], "decision_type": t.kind, "left_child": t.left, "right_child": t.right, "leaf_value": [repr(float(x)) for x in t.value]}
            if t.sets:
                arrays |= {"cat_boundaries": bounds, "cat_threshold": words}
            out += [f"Tree={i}", f"num_leaves={len(t.value)}", f"num_cat={len(t.sets)}", *[f"{k}={' '.join(map(str, v))}" for k, v in arrays.items()], ""]
        listed = [self.categories[f] for f in self.features if f in self.categories]
        return "\n".join([*out, "end of trees", "", f"pandas_categorical:{json.dumps(listed)}", ""])


def parse(text: str, categorical: Sequence[str] | None = None) -> Forest:
    """The forest of a model file's text. `categorical`: the features that the file's category lists belong to, in order; by
    default those that some node splits by category, or whose header range lists codes."""
    head: dict[str, str] = {}
    blocks: list[dict[str, str]] = []
    lists: list[list] = []
    now = head
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        if line.startswith("pandas_categorical:"):
            lists = json.loads(line.split(":", 1)[1]) or []
        elif key == "Tree" and eq:
            now = {}
            blocks.append(now)
        elif key == "end of trees":
            now = {}
        elif eq:
            now[key] = value
    features = head["feature_names"].split()
    numbers = lambda b, k, kind: np.array(b.get(k, "").split(), kind)
    trees = []
    for b in blocks:
        bounds, words = [int(x) for x in b.get("cat_boundaries", "0").split()], [int(x) for x in b.get("cat_threshold", "").split()]
        sets = [frozenset(32 * i + bit for i, w in enumerate(words[lo:hi]) for bit in range(32) if w >> bit & 1) for lo, hi in zip(bounds, bounds[1:])]
        t = Tree(*[numbers(b, k, kind) for k, kind in (("split_feature", np.int64), ("threshold", np.float64), ("decision_type", np.int64), ("left_child", np.int64), ("right_child", np.int64), ("leaf_value", np.float64))], sets)
        if len(t.value) != len(t.feature) + 1 or len(t.value) != int(b["num_leaves"]):
            raise ValueError("a tree has one leaf more than inner nodes")
        trees.append(t)
    if categorical is None:
        split = {features[f] for t in trees for f, k in zip(t.feature, t.kind) if k & CATEGORICAL}
        infos = dict(zip(features, head.get("feature_infos", "").split()))
        categorical = [f for f in features if f in split or (infos.get(f, "")[:1] not in ("", "[") and infos[f] != "none")]
    if len(categorical) != len(lists):
        raise ValueError(f"{len(lists)} lists of categories for {list(categorical)}")
    objective = head.get("objective", "").split()[0] if head.get("objective") else ""
    return Forest(features, trees, dict(zip(categorical, lists)), objective)


def load(spark: SparkSession, path: str, categorical: Sequence[str] | None = None) -> Forest:
    """A model file, read by Spark: the text of one small file."""
    return parse("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()), categorical)


def stump(value: float) -> Tree:
    """A tree without a split."""
    none = np.zeros(0, np.int64)
    return Tree(none, np.zeros(0), none, none, none, np.array([value if math.isfinite(value) else 0.0]))
