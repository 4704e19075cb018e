"""Scoring with tree ensembles held as node tables, attribution, model checks and model versions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import clamp01, is_finite
from fleetlens.schemas import MANIFEST, MODEL_NODE
from fleetlens.storage import new_path, scratch, staged, written

#: Nodes of an ensemble that is compiled to CASE expressions; larger ones are walked in numpy.
LARGEST_CASE = 100
#: Nodes that may be sent to the tasks; a model is user data, so its size is checked.
LARGEST_MODEL = 2_000_000


def column_name(feature: str) -> str:
    """The flat column of a manifest entry (dots are no good in column names)."""
    return feature.replace("bigrams.__", "").replace("trigrams.__", "").removesuffix("__")


def flatten_vector(features: DataFrame, manifest: tuple[str, ...] = MANIFEST) -> DataFrame:
    """features plus x: the manifest's values as array<float>; booleans 0 or 1, missing map keys and columns' nulls 0."""

    def value(name: str) -> Column:
        flat = column_name(name)
        if flat in features.columns:
            return F.coalesce(F.col(flat).cast("float"), F.lit(0.0).cast("float"))
        family, _, key = name.partition(".")
        if key and family in features.columns:
            return F.coalesce(F.try_element_at(F.col(family), F.lit(key)).cast("float"), F.lit(0.0).cast("float"))
        return F.lit(0.0).cast("float")

    return features.withColumn("x", F.array(*map(value, manifest)))


def finite_check(flat: DataFrame, manifest: tuple[str, ...] = MANIFEST) -> DataFrame:
    """Adds bad_feature: the first value that is no finite number, or null."""
    names = F.array(*[F.lit(n) for n in manifest])
    bad = F.filter(F.transform("x", lambda v, i: F.struct(v.alias("v"), F.get(names, i).alias("n"))), lambda p: ~is_finite(p["v"]))
    return flat.withColumn("bad_feature", F.get(bad, F.lit(0))["n"])


def collected_nodes(nodes: DataFrame) -> pd.DataFrame:
    """The node table on the driver, its size checked."""
    rows = nodes.select(*MODEL_NODE.fieldNames()).orderBy("tree_id", "node_id").limit(LARGEST_MODEL + 1).toPandas()
    if len(rows) > LARGEST_MODEL:
        raise ValueError(f"nodes: more than {LARGEST_MODEL} rows")
    return rows


def finished(raw: Column, transform: str) -> Column:
    if transform not in ("LOGISTIC", "NONE"):
        raise ValueError("transform must be LOGISTIC or NONE")
    return clamp01(1 / (1 + F.exp(-raw)) if transform == "LOGISTIC" else raw)


def score_case(flat: DataFrame, nodes: DataFrame, base: float = 0.0, transform: str = "LOGISTIC") -> DataFrame:
    """threat_score by nested CASE expressions: no Python in the tasks. For ensembles of up to LARGEST_CASE nodes."""
    table = collected_nodes(nodes)
    if len(table) > LARGEST_CASE:
        raise ValueError(f"nodes: more than {LARGEST_CASE} rows; use score_trees")
    by_id = {(r.tree_id, r.node_id): r for r in table.itertuples()}
    Ensemble(table)  # refuses what isn't a tree

    def tree(tree_id: int, node_id: int) -> Column:
        r = by_id[tree_id, node_id]
        if r.mode == "LEAF":
            return F.lit(float(r.weight))
        x = F.get("x", F.lit(int(r.feature_index)))
        limit = F.lit(float(r.threshold)).cast("float")
        goes = x < limit if r.mode == "LT" else x <= limit
        goes = F.when(F.isnan(x), F.lit(bool(r.missing_true))).otherwise(goes)
        return F.when(goes, tree(tree_id, int(r.true_node))).otherwise(tree(tree_id, int(r.false_node)))

    raw = F.lit(float(base))
    for tree_id in sorted(table["tree_id"].unique()):
        raw = raw + tree(tree_id, int(table.loc[table["tree_id"] == tree_id, "node_id"].min()))
    return flat.withColumn("threat_score", finished(raw, transform))


class Ensemble:
    """Node arrays; all rows and trees walk one level at a time."""

    def __init__(self, table: pd.DataFrame) -> None:
        self.table = table.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
        at = {k: i for i, k in enumerate(zip(self.table["tree_id"], self.table["node_id"], strict=True))}
        child = lambda c: np.array([at.get((t, int(n)), -1) if not pd.isna(n) else -1 for t, n in zip(self.table["tree_id"], self.table[c], strict=True)])
        self.true, self.false = child("true_node"), child("false_node")
        self.leaf = (self.table["mode"] == "LEAF").to_numpy()
        self.at_most = (self.table["mode"] == "LE").to_numpy()
        self.feature = self.table["feature_index"].fillna(0).to_numpy().astype(int)
        self.threshold = self.table["threshold"].fillna(0).to_numpy().astype(np.float32)
        self.missing = (self.table["missing_true"] == True).to_numpy()  # noqa: E712  null is no
        self.weight = self.table["weight"].fillna(0).to_numpy()
        self.roots = np.flatnonzero(~self.table["tree_id"].duplicated())
        self.depth = self._levels()

    def _levels(self) -> int:
        """Branches on the longest path. Tables in which a walk wouldn't end, or that aren't trees, are refused."""
        seen, front, levels = np.zeros(len(self.table), bool), self.roots, 0
        while True:
            if (front < 0).any():
                raise ValueError("nodes: a branch lacks a child")
            if seen[front].any() or len(np.unique(front)) < len(front):
                raise ValueError("nodes: a node is reached twice (a circle, or a node with several parents)")
            seen[front] = True
            inner = front[~self.leaf[front]]
            if not len(inner):
                break
            front, levels = np.concatenate([self.true[inner], self.false[inner]]), levels + 1
        if not seen.all():
            raise ValueError("nodes: a node isn't reached from its tree's first node")
        return levels

    def step(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        value = np.take_along_axis(x, self.feature[node], axis=1)
        below = np.where(self.at_most[node], value <= self.threshold[node], value < self.threshold[node])
        goes = np.where(np.isnan(value), self.missing[node], below)
        return np.where(self.leaf[node], node, np.where(goes, self.true[node], self.false[node]))

    def walk(self, x: np.ndarray, paths: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """The leaf of each row and tree, and the nodes passed level by level."""
        node, levels = np.tile(self.roots, (len(x), 1)), []
        while not self.leaf[node].all():
            if paths:
                levels.append(node)
            node = self.step(x, node)
        return node, levels


def score_trees(flat: DataFrame, nodes: DataFrame, base: float = 0.0, transform: str = "LOGISTIC") -> DataFrame:
    """threat_score by a vectorised walk; the node table goes to each worker once."""
    shared = flat.sparkSession.sparkContext.broadcast(Ensemble(collected_nodes(nodes)))

    @F.pandas_udf("double")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = shared.value
        for x in batches:
            leaf, _ = trees.walk(np.stack(x.to_numpy()).astype(np.float32)) if len(x) else (np.zeros((0, 1), int), [])
            yield pd.Series(trees.weight[leaf].sum(axis=1) + base)

    return flat.withColumn("threat_score", finished(raw("x"), transform))


def attribute_paths(flat: DataFrame, nodes: DataFrame, manifest: tuple[str, ...] = MANIFEST) -> DataFrame:
    """contributions: array of (feature_name, contribution_score), largest first, names break ties.

    Each tree's leaf weight is divided equally among the branches on its path.
    """
    shared = flat.sparkSession.sparkContext.broadcast(Ensemble(collected_nodes(nodes)))

    @F.pandas_udf("array<double>")
    def sums_by_feature(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = shared.value
        for x in batches:
            rows = np.stack(x.to_numpy()).astype(np.float32)
            leaf, levels = trees.walk(rows, paths=True)
            depth = sum((~trees.leaf[node]).astype(int) for node in levels) if levels else np.ones(leaf.shape, int)
            share = np.where(depth > 0, trees.weight[leaf] / np.maximum(depth, 1), 0.0)
            sums = np.zeros((len(rows), len(manifest)))
            for node in levels:
                row, tree = np.nonzero(~trees.leaf[node])
                np.add.at(sums, (row, trees.feature[node[row, tree]]), share[row, tree])
            yield pd.Series(list(sums))

    names = F.array(*[F.lit(n) for n in manifest])
    named = F.zip_with(names, sums_by_feature("x"), lambda n, c: F.struct((-F.abs(c)).alias("order"), n.alias("feature_name"), c.alias("contribution_score")))
    used = F.array_sort(F.filter(named, lambda c: -c["order"] > float(np.finfo(float).eps)))
    return flat.withColumn("contributions", F.transform(used, lambda c: F.struct(c["feature_name"].alias("feature_name"), c["contribution_score"].alias("contribution_score"))))


def attribution_table(flat: DataFrame, nodes: DataFrame, key: list[str], manifest: tuple[str, ...] = MANIFEST) -> DataFrame:
    """attribute_paths in relational form for audits: key, feature_name, contribution_score (nodes joined level by level,
    as many as the deepest tree has)."""
    depth = Ensemble(collected_nodes(nodes)).depth
    names = F.array(*[F.lit(n) for n in manifest])
    tree = nodes.withColumn("is_leaf", F.col("mode") == "LEAF")
    roots = tree.groupBy("tree_id").agg(F.min("node_id").alias("node_id"))
    if roots.limit(LARGEST_MODEL + 1).count() > LARGEST_MODEL:
        raise ValueError(f"nodes: more than {LARGEST_MODEL} trees")
    state = flat.select(*key, "x").join(F.broadcast(roots)).withColumn("used", F.array().cast("array<int>"))
    state = state.join(tree, ["tree_id", "node_id"])
    for _ in range(depth):
        x = F.get("x", F.col("feature_index"))
        limit = F.col("threshold").cast("float")
        goes = F.when(F.isnan(x), F.col("missing_true")).when(F.col("mode") == "LE", x <= limit).otherwise(x < limit)
        step = state.select(
            *key, "x", "tree_id", F.when(F.col("is_leaf"), F.col("node_id")).when(goes, F.col("true_node")).otherwise(F.col("false_node")).alias("node_id"),
            F.when(F.col("is_leaf"), F.col("used")).otherwise(F.array_append("used", F.col("feature_index"))).alias("used"),
        )
        state = step.join(tree, ["tree_id", "node_id"])
    spread = state.filter("is_leaf").select(*key, F.explode("used").alias("f"), (F.col("weight") / F.size("used")).alias("share"))
    sums = spread.groupBy(*key, "f").agg(F.sum("share").alias("contribution_score"))
    return sums.filter(F.abs("contribution_score") > 2.22e-16).select(*key, F.get(names, F.col("f")).alias("feature_name"), "contribution_score")


def node_places(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, root (the tree's first node), top (the last node on the way up), depth below it, circle: where
    each node hangs, by pointer doubling: after k rounds a node knows its ancestor 2^k levels up, so as many rounds as
    the number of a tree's nodes has bits. In a circle the way up never ends: top and depth are null there. Of several
    parents the smallest counts. The result is staged."""
    spark, path = nodes.sparkSession, new_path(nodes.sparkSession, "places")
    at = ["tree_id", "node_id"]
    with scratch(spark):
        ids = nodes.select(*at).distinct()
        down = nodes.filter(F.col("mode").isin("LT", "LE")).select("tree_id", F.col("node_id").alias("parent"), F.explode(F.array("true_node", "false_node")).alias("node_id"))
        up = down.groupBy(*at).agg(F.min("parent").alias("parent"))
        now = staged(ids.join(up, at, "left").select(*at, F.coalesce("parent", "node_id").alias("to"), F.col("parent").isNotNull().cast("bigint").alias("far"), F.col("parent").isNull().alias("ends")), "up")
        largest = ids.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
        for _ in range(largest.bit_length()):
            next_ = now.select("tree_id", F.col("node_id").alias("to"), F.col("to").alias("further"), F.col("far").alias("more"), F.col("ends").alias("over"))
            now = staged(now.join(next_, ["tree_id", "to"]).select(*at, F.col("further").alias("to"), (F.col("far") + F.col("more")).alias("far"), "over").withColumnRenamed("over", "ends"), "up")
        roots = ids.groupBy("tree_id").agg(F.min("node_id").alias("root"))
        ended = now.join(now.filter("node_id = to and ends").select("tree_id", F.col("node_id").alias("to"), F.lit(True).alias("whole")).distinct(), ["tree_id", "to"], "left")
        whole = F.coalesce("whole", F.lit(False))
        return written(ended.join(roots, "tree_id").select(*at, "root", F.when(whole, F.col("to")).alias("top"), F.when(whole, F.col("far")).alias("depth"), (~whole).alias("circle")), path)


def model_from_nodes(nodes: DataFrame, n_features: int = len(MANIFEST)) -> DataFrame:
    """Problems of a node table: tree_id, node_id, problem; no rows for a sound one.

    Of the shape: several parents, circle (the node lies on or under one), second root (a node without a parent that
    isn't the tree's first node), not reached (it lies under a second root)."""
    branch = F.col("mode").isin("LT", "LE")
    own = (
        F.when(~F.col("mode").isin("LT", "LE", "LEAF") | F.col("mode").isNull(), "unknown mode")
        .when((F.col("mode") == "LEAF") & F.col("weight").isNull(), "leaf without weight")
        .when(branch & (F.col("feature_index").isNull() | (F.col("feature_index") < 0) | (F.col("feature_index") >= n_features)), "feature index out of range")
        .when(branch & (F.col("threshold").isNull() | F.col("true_node").isNull() | F.col("false_node").isNull()), "branch without threshold or children")
    )
    local = nodes.select("tree_id", "node_id", own.alias("problem")).filter("problem is not null")
    ids = nodes.select("tree_id", "node_id")
    children = nodes.filter(branch).select("tree_id", F.col("node_id").alias("parent"), F.explode(F.array("true_node", "false_node")).alias("node_id")).filter("node_id is not null")
    lost = children.join(ids, ["tree_id", "node_id"], "left_anti").select("tree_id", F.col("parent").alias("node_id"), F.lit("missing child").alias("problem"))
    twice = ids.groupBy("tree_id", "node_id").count().filter("count > 1").select("tree_id", "node_id", F.lit("repeated node").alias("problem"))
    many = children.groupBy("tree_id", "node_id").count().filter("count > 1").join(ids.distinct(), ["tree_id", "node_id"]).select("tree_id", "node_id", F.lit("several parents").alias("problem"))
    placed = node_places(nodes)
    odd = F.when(F.col("circle"), "circle").when((F.col("top") == F.col("node_id")) & (F.col("node_id") != F.col("root")), "second root").when(F.col("top") != F.col("root"), "not reached")
    shape = placed.select("tree_id", "node_id", odd.alias("problem")).filter("problem is not null")
    return reduce(DataFrame.unionByName, [lost, twice, many, shape], local)


def model_schema_check(nodes: DataFrame, manifest: tuple[str, ...] = MANIFEST, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """One row: trees, nodes, width, manifest_ok, classes_ok, ok."""
    out = nodes.agg(F.count_distinct("tree_id").alias("trees"), F.count("*").alias("nodes"))
    out = out.withColumns({"width": F.lit(len(manifest)), "manifest_ok": F.lit(tuple(manifest) == MANIFEST), "classes_ok": F.lit(len(set(classes)) == 2)})
    return out.withColumn("ok", F.col("manifest_ok") & F.col("classes_ok") & (F.col("nodes") > 0))


def model_version_as_of(flat: DataFrame, registry: DataFrame, ts: str = "window_end_ns") -> DataFrame:
    """Adds model_hash: the latest valid model at each row's time; null before the first.

    registry: effective_ns, model_hash, valid. Versions are few by nature (one row per deployment) and collected; more
    than 10,000 are an error. So each row looks its version up, without a join.
    """
    known = registry.filter("valid").select("effective_ns", "model_hash").orderBy("effective_ns").limit(10_001).collect()
    if len(known) > 10_000:
        raise ValueError("registry must have 10,000 valid rows at most")
    if not known:
        return flat.withColumn("model_hash", F.lit(None).cast("string"))
    at, hashes = F.array(*[F.lit(r[0]).cast("bigint") for r in known]), F.array(*[F.lit(r[1]) for r in known])
    return flat.withColumn("model_hash", F.get(hashes, F.size(F.filter(at, lambda a: a <= F.col(ts))) - 1))


def cutover_audit(scored: DataFrame, grace_ms: int = 100) -> DataFrame:
    """One row about a swap between two models: old and new hash, first row of the new, rows per second, late old rows.

    scored: ts_ns, model_hash. The new model is the one whose first row is later.
    """
    by_hash = scored.groupBy("model_hash").agg(F.min("ts_ns").alias("first_ns"), F.count("*").alias("n"))
    swap = by_hash.agg(F.max_by("model_hash", "first_ns").alias("new_hash"), F.min_by("model_hash", "first_ns").alias("old_hash"), F.max("first_ns").alias("new_first_ns"), F.count("*").alias("hashes"))
    joined = scored.join(F.broadcast(swap))
    late = (F.col("model_hash") == F.col("old_hash")) & (F.col("hashes") > 1) & (F.col("ts_ns") > F.col("new_first_ns") + grace_ms * 1_000_000)
    seconds = F.greatest((F.max("ts_ns") - F.min("ts_ns")) / 1e9, F.lit(1e-9))
    return joined.groupBy("old_hash", "new_hash", "new_first_ns", "hashes").agg(F.count("*").alias("rows"), (F.count("*") / seconds).alias("rows_per_second"), F.sum(late.cast("bigint")).alias("late_old_rows"))


def degraded_scores(flat: DataFrame, reason: str) -> DataFrame:
    """Rows without a valid model: null score, hash `degraded`, the reason."""
    return flat.withColumns({"threat_score": F.lit(None).cast("double"), "model_hash": F.lit("degraded"), "degraded_reason": F.lit(reason)})


def would_alert(flat: DataFrame, nodes: DataFrame, threshold: float = 0.7, base: float = 0.0, transform: str = "LOGISTIC", model_hash: str = "") -> DataFrame:
    """Score, contributions, hash, threshold and verdict of any vectors."""
    scored = attribute_paths(score_trees(flat, nodes, base, transform), nodes)
    return scored.withColumns({"model_hash": F.lit(model_hash), "threshold": F.lit(threshold), "would_alert": F.col("threat_score") >= threshold})


def score(flat: DataFrame, model, base: float = 0.0, transform: str = "LOGISTIC") -> DataFrame:
    """Scores with a node table, a fitted Spark ML model, or a pandas UDF from array<float> to double."""
    if isinstance(model, DataFrame):
        return score_trees(flat, model, base, transform)
    if hasattr(model, "transform"):
        from pyspark.ml.functions import array_to_vector, vector_to_array

        ready = flat.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
        return model.transform(ready).withColumn("threat_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return flat.withColumn("threat_score", clamp01(model(F.col("x"))))


def cross_backend_check(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row: rows, largest difference, whether both scores are bounded and agree. a, b: key, threat_score."""
    both = a.select(*key, F.col("threat_score").alias("sa")).join(b.select(*key, F.col("threat_score").alias("sb")), key)
    out = both.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("sa") - F.col("sb"))).alias("largest"), F.bool_and(F.col("sa").between(0, 1) & F.col("sb").between(0, 1)).alias("bounded"))
    return out.withColumn("agree", F.coalesce(F.col("bounded") & (F.col("largest") <= tolerance), F.lit(True)))
