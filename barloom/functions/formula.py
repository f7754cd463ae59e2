"""Boolean rule trees: ``[feature, op, value]`` leaves joined by ``[tree, 'AND'|'OR', tree]``."""

from __future__ import annotations

import hashlib
import json
import operator
from collections.abc import Collection
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
    "==": operator.eq,
    "!=": operator.ne,
}
_LEAF = r'\["([^"]+)","(?:<=|>=|==|!=|<|>)"'
_LEAF_STRICT = r'\["([^"]+)","(?:<|>)"'


def to_json(tree) -> str:
    return json.dumps(tree, separators=(",", ":"))


def tree_id(tree) -> str:
    return hashlib.sha256(to_json(tree).encode()).hexdigest()


def _operand(value, columns: Collection[str]):
    """(is a column, Column or None); None marks an unknown feature."""
    if isinstance(value, str):
        return True, (F.col(value) if value in columns else None)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return False, F.lit(float(value))
    raise ValueError(f"unsupported operand {value!r}")


def compile_formula(tree, columns: Collection[str]) -> Column:
    """Predicate of a rule tree.  Missing values compare false (``!=``: true); unknown features are false."""
    if isinstance(tree, str):
        tree = json.loads(tree)
    if not isinstance(tree, list) or not tree:
        return F.lit(False)
    if len(tree) != 3:
        raise ValueError(f"unsupported rule {tree!r}")
    left, op, right = tree
    if op in ("AND", "OR"):
        parts = (compile_formula(left, columns), compile_formula(right, columns))
        return reduce(operator.and_ if op == "AND" else operator.or_, parts)
    if op not in COMPARE or isinstance(left, list) or isinstance(right, list):
        raise ValueError(f"unsupported rule {tree!r}")
    (lf, lc), (rf, rc) = _operand(left, columns), _operand(right, columns)
    if (not lf and not rf) or lc is None or rc is None:
        return F.lit(False)
    return F.coalesce(COMPARE[op](lc, rc), F.lit(op == "!="))


def leaves(tree) -> list:
    """Leaf lists of a tree, left to right."""
    if isinstance(tree[0], list):
        return leaves(tree[0]) + leaves(tree[2])
    return [tree]


def with_formula_id(df: DataFrame, formula: str = "formula_json", name: str = "formula_id") -> DataFrame:
    """G-03: content hash of the rule text."""
    return df.withColumn(name, F.sha2(F.col(formula), 256))


def alpha_id(formula: Column, universe: Column, timeframe: Column) -> Column:
    """G-03: content hash of rule text, sorted universe and timeframe."""
    joined = F.array_join(F.array_sort(universe), "")
    return F.sha2(F.concat_ws(":", F.coalesce(formula, F.lit("")), joined, F.coalesce(timeframe, F.lit(""))), 256)


def formula_features(df: DataFrame, formula: str = "formula_json", keep=(), strict: bool = False) -> DataFrame:
    """B-06: one row per leaf feature; ``strict`` keeps only < and > leaves, each feature once per rule."""
    found = F.regexp_extract_all(F.col(formula), F.lit(_LEAF_STRICT if strict else _LEAF), 1)
    return df.select(*keep, F.explode(F.array_distinct(found) if strict else found).alias("feature"))


def feature_set(formula: str | Column = "formula_json") -> Column:
    """Distinct leaf features as a sorted array."""
    c = F.col(formula) if isinstance(formula, str) else formula
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(_LEAF), 1)))


def formula_complexity(formula: str | Column = "formula_json") -> Column:
    """B-07: nodes of the tree; every node opens one bracket."""
    c = F.col(formula) if isinstance(formula, str) else formula
    return F.length(c) - F.length(F.replace(c, F.lit("["), F.lit("")))


def sanitize_formulas(
    df: DataFrame,
    features: Collection[str],
    suppressed: Collection[str] = (),
    low: float = -5.0,
    high: float = 5.0,
    max_nodes: int = 31,
    formula: str = "formula_json",
) -> DataFrame:
    """B-05: keep well-formed > / < rules over allowed features, clamp thresholds, drop repeats."""
    allowed = frozenset(features) - frozenset(suppressed)

    def tidy(node):
        """(clamped tree, node count) or None when the shape is not allowed."""
        if not isinstance(node, list) or len(node) < 3:
            return None
        left, op, right = node[:3]
        if isinstance(left, str) and op in (">", "<") and left in allowed:
            try:
                return [left, op, max(low, min(high, float(right)))], 1
            except (TypeError, ValueError):
                return None
        if op in ("AND", "OR"):
            a, b = tidy(left), tidy(right)
            if a and b:
                return [a[0], op, b[0]], 1 + a[1] + b[1]
        return None

    @F.pandas_udf("clean string, nodes int")
    def check(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                found = tidy(json.loads(text))
            except (TypeError, ValueError):
                found = None
            rows.append((to_json(found[0]), found[1]) if found else (None, None))
        return pd.DataFrame(rows, columns=["clean", "nodes"])

    return (
        df.select(formula).distinct()
        .withColumn("_c", check(F.col(formula)))
        .where(F.col("_c.clean").isNotNull() & (F.col("_c.nodes") <= max_nodes))
        .select(F.col("_c.clean").alias(formula), F.col("_c.nodes").alias("nodes"))
        .distinct()
        .withColumn("formula_id", F.sha2(F.col(formula), 256))
    )
