"""Training and evaluation on labelled corpora: weights, trees, grids, metrics, sweeps, reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordering import running_sums
from fleetlens.schemas import MODEL_NODE

# The grid and the gates.
GRID = {"estimators": (50, 100, 200), "depth": (3, 5, 7), "rate": (0.05, 0.1, 0.3)}
GATES = {"f1": 0.90, "tpr": 0.95, "fpr": 0.35}


def imbalance_weight(corpus: DataFrame) -> DataFrame:
    """One row, weight: negatives for each positive, 1 at least."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return corpus.agg(F.greatest(neg / F.greatest(pos, F.lit(1)), F.lit(1.0)).alias("weight"))


def train_trees(train: DataFrame, params: dict, seed: int = 1337):
    """A fitted boosted-tree pipeline model. train: x (array<float>), label; params: estimators, depth, rate."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    ready = train.join(F.broadcast(imbalance_weight(train))).select(array_to_vector(F.col("x").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, F.col("weight")).otherwise(1.0).alias("w"))
    gbt = GBTClassifier(labelCol="label", weightCol="w", maxIter=params["estimators"], maxDepth=params["depth"], stepSize=params["rate"], seed=seed)
    return gbt.fit(ready)


def nodes_from_trees(spark, model) -> DataFrame:
    """The node table of a fitted boosted-tree model (branches are `at most`; leaf weights doubled for LOGISTIC)."""
    rows = []
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        stack, count = [(tree._call_java("rootNode"), 0)], 1
        while stack:
            node, i = stack.pop()
            if node.numDescendants() == 0:
                rows.append((t, i, "LEAF", None, None, None, None, None, float(2 * weight * node.prediction())))
            else:
                rows.append((t, i, "LE", int(node.split().featureIndex()), float(node.split().threshold()), count, count + 1, False, None))
                stack += [(node.leftChild(), count), (node.rightChild(), count + 1)]
                count += 2
    return spark.createDataFrame(rows, MODEL_NODE)


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: tp, tn, fp, fn, f1, tpr, fpr at score >= threshold. scored: label, threat_score."""
    hit, real = F.col("threat_score") >= threshold, F.col("label") == 1
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = scored.agg(count(hit & real).alias("tp"), count(~hit & ~real).alias("tn"), count(hit & ~real).alias("fp"), count(~hit & real).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"f1": ratio(2 * tp, 2 * tp + fp + fn), "tpr": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn)})


def grid_search(train: DataFrame, valid: DataFrame, grid: dict | None = None, seed: int = 1337, parallelism: int = 4) -> DataFrame:
    """Validation metrics of every candidate: estimators, depth, rate and the columns of binary_metrics."""
    from fleetlens.operators.scoring import score

    grid = grid or GRID
    tries = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]

    def one(params: dict) -> tuple:
        got = binary_metrics(score(valid, train_trees(train, params, seed))).first()
        return (params["estimators"], params["depth"], params["rate"], *got)

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(one, tries))
    return train.sparkSession.createDataFrame(rows, "estimators int, depth int, rate double, tp bigint, tn bigint, fp bigint, fn bigint, f1 double, tpr double, fpr double")


def rank_candidates(metrics: DataFrame, tpr_floor: float = 0.95) -> DataFrame:
    """Candidates, best first: those at the TPR floor, then F1, then low FPR, then the smaller model."""
    return metrics.orderBy((F.col("tpr") < tpr_floor).cast("int"), F.desc("f1"), "fpr", "estimators", "depth", "rate")


def threshold_sweep(scored: DataFrame, tpr_floor: float = 0.95) -> DataFrame:
    """One row: the threshold of lowest FPR whose TPR reaches the floor. Scores are first grouped; the running sums over
    distinct scores go by range of scores, then within a range."""
    by_score = scored.filter("threat_score is not null").groupBy("threat_score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    whole = by_score.agg(F.greatest(F.sum("p"), F.lit(1)).alias("all_p"), F.greatest(F.sum("n"), F.lit(1)).alias("all_n"))
    totals = running_sums(by_score.withColumn("order", -F.col("threat_score")), ["order"], "sweep", tp=F.col("p"), fp=F.col("n"))
    sums = totals.select(F.col("threat_score").alias("threshold"), "tp", "fp").join(F.broadcast(whole))
    rates = sums.select("threshold", (F.col("tp") / F.col("all_p")).alias("tpr"), (F.col("fp") / F.col("all_n")).alias("fpr"))
    return rates.filter(F.col("tpr") >= tpr_floor).orderBy("fpr", F.desc("threshold")).limit(1)


def cut_gain(rows: DataFrame, feature: int, threshold: float) -> DataFrame:
    """One row, gain: how much a cut at x[feature] <= threshold lowers the weighted variance of the labels (as -1 and 1),
    positives weighted by `imbalance_weight`: what a boosted model's first tree maximises at its root. rows: x, label."""
    y, w = 2 * F.col("label").cast("double") - 1, F.when(F.col("label") == 1, F.col("weight")).otherwise(1.0)
    sides = rows.join(F.broadcast(imbalance_weight(rows))).groupBy((F.get("x", F.lit(feature)) <= threshold).alias("left")).agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"))
    return sides.agg((F.sum(F.col("wy") * F.col("wy") / F.col("w")) / F.sum("w") - F.pow(F.sum("wy") / F.sum("w"), 2)).alias("gain"))


def root_cut(model) -> tuple[int, float]:
    """(feature index, threshold) of the first tree's root."""
    root = model.trees[0]._call_java("rootNode")
    return int(root.split().featureIndex()), float(root.split().threshold())


def train_final(train: DataFrame, valid: DataFrame, test: DataFrame, grid: dict | None = None, seed: int = 1337):
    """(node table, test metrics, manifest) of a whole run over labelled corpora: priors from train alone, candidates
    compared on validation, the best one fitted anew on train and validation, the test split scored once.

    manifest: one row with the role of each split, the chosen parameters, the number of rows fitted and the provenance."""
    from fleetlens.operators.priors import corpus_features, prior_catalogue, provenance
    from fleetlens.operators.scoring import flatten_vector, score_trees

    spark, table = train.sparkSession, prior_catalogue(train)
    flat = lambda df: flatten_vector(corpus_features(df, table)).select("x", "label")
    best = rank_candidates(grid_search(flat(train), flat(valid), grid, seed)).first()
    both = flat(train.unionByName(valid))
    nodes = nodes_from_trees(spark, train_trees(both, {"estimators": best["estimators"], "depth": best["depth"], "rate": best["rate"]}, seed))
    metrics = binary_metrics(score_trees(flat(test), nodes))
    roles = {"priors": "train", "grid_search": "validation", "final_model": "train+validation", "evaluation": "test"}
    fitted = both.agg(F.count("*").alias("fitted_rows")).select(*[F.lit(v).alias(k) for k, v in roles.items()], *[F.lit(best[c]).alias(c) for c in ("estimators", "depth", "rate")], "fitted_rows")
    return nodes, metrics, fitted.join(F.broadcast(provenance(table, train, metrics)))


def metrics_gate(metrics: DataFrame, f1: float = GATES["f1"], tpr: float = GATES["tpr"], fpr: float = GATES["fpr"], checks: DataFrame | None = None) -> DataFrame:
    """metrics with passed: the figures reach the gates and, if the run's checks are given (one row, from
    `priors.provenance_check`), these all hold."""
    reached = (F.col("f1") >= f1) & (F.col("tpr") >= tpr) & (F.col("fpr") <= fpr)
    if checks is None:
        return metrics.withColumn("passed", reached)
    return metrics.join(F.broadcast(checks.select(F.col("passed").alias("sound")))).withColumn("passed", reached & F.col("sound")).drop("sound")


def detection_report(trials: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per fixture and in total (fixture null): trials, detections, rate, mean and lowest score, passed."""
    hit = F.count_if(F.col("threat_score") >= threshold)
    out = trials.rollup("fixture").agg(F.count("*").alias("trials"), hit.alias("detections"), F.avg("threat_score").alias("mean_score"), F.min("threat_score").alias("min_score"))
    return out.withColumns({"rate": F.col("detections") / F.col("trials"), "passed": F.col("detections") == F.col("trials")})


def false_positive_report(trials: DataFrame, hours: float, cap_per_hour: float = 1.0, threshold: float = 0.7) -> DataFrame:
    """Per benign workload: alerts, alerts an hour, share of trials with one, mean and highest score, passed."""
    if hours <= 0:
        raise ValueError("hours must be positive")
    hit = F.count_if(F.col("threat_score") >= threshold)
    out = trials.groupBy("workload").agg(F.count("*").alias("trials"), hit.alias("alerts"), F.avg("threat_score").alias("mean_score"), F.max("threat_score").alias("max_score"))
    return out.withColumns({"alerts_per_hour": F.col("alerts") / hours, "trial_fpr": F.col("alerts") / F.col("trials"), "passed": F.col("alerts") / hours <= cap_per_hour})
