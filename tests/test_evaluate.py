import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from retenta.operators import evaluate


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    score = np.round(rng.random(3000), 2)  # many ties
    score[:1000] = 0.31  # one score holds a third of the rows
    label = (rng.random(3000) < 0.2 + 0.5 * score).astype(int)
    rows = [(float(s), int(y), int(s > 0.5)) for s, y in zip(score, label)]
    return spark.createDataFrame(rows, "s double, y int, p int"), score, label


def curve(score, label):
    """Points by definition: rates at each distinct threshold, from the highest down."""
    thresholds = np.unique(score)[::-1]
    tp = np.array([(label[score >= t] == 1).sum() for t in thresholds])
    fp = np.array([(label[score >= t] == 0).sum() for t in thresholds])
    return thresholds, tp, fp


def test_auc_matches_definition_and_evaluator(scored):
    df, score, label = scored
    pos, neg = score[label == 1], score[label == 0]
    pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    got = evaluate.roc_auc(df, "s", "y").first()["roc_auc"]
    assert got == pytest.approx(pairs / (len(pos) * len(neg)), rel=1e-14)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert got == pytest.approx(evaluator.evaluate(df.withColumn("y", F.col("y").cast("double"))), rel=1e-10)


def test_average_precision(scored):
    df, score, label = scored
    _, tp, fp = curve(score, label)
    recall = np.concatenate([[0], tp / tp[-1]])
    want = np.sum(np.diff(recall) * tp / (tp + fp))
    assert evaluate.average_precision(df, "s", "y").first()[0] == pytest.approx(want, rel=1e-12)


def test_roc_curve_with_all_points(scored):
    df, score, label = scored
    thresholds, tp, fp = curve(score, label)
    rows = evaluate.roc_curve(df, "s", "y", drop_collinear=False).collect()
    assert rows[0] == (float("inf"), 0.0, 0.0) and rows[-1][1:] == (1.0, 1.0)
    assert [r["threshold"] for r in rows[1:]] == list(thresholds)
    assert np.allclose([r["tpr"] for r in rows[1:]], tp / tp[-1]) and np.allclose([r["fpr"] for r in rows[1:]], fp / fp[-1])


def test_roc_curve_drops_only_collinear_points(scored):
    df, score, label = scored
    thresholds, tp, fp = curve(score, label)
    bend = (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0)
    keep = np.concatenate([[True], bend, [True]])
    rows = evaluate.roc_curve(df, "s", "y").collect()
    assert [r["threshold"] for r in rows[1:]] == list(thresholds[keep])
    area = np.trapezoid([r["tpr"] for r in rows], [r["fpr"] for r in rows])
    assert area == pytest.approx(evaluate.roc_auc(df, "s", "y").first()[0])


def test_collinear_points_across_buckets(spark):
    rows = [(i / 500, 1) for i in range(300, 500)] + [(i / 500, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = [(r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df, "s", "y").collect()]
    assert got == [(0.0, 0.0), (0.0, 1 / 200), (0.0, 1.0), (1.0, 1.0)]


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert evaluate.roc_auc(df, "s", "y").first()[0] is None


def test_classification_report(scored):
    df, score, label = scored
    guess = (score > 0.5).astype(int)
    rows = {r["class"]: r for r in evaluate.classification_report(df, "p", "y").collect()}
    for c in (0, 1):
        hit = ((guess == c) & (label == c)).sum()
        precision, recall = hit / (guess == c).sum(), hit / (label == c).sum()
        r = rows[str(c)]
        assert (r["precision"], r["recall"]) == (pytest.approx(precision), pytest.approx(recall))
        assert r["f1_score"] == pytest.approx(2 * precision * recall / (precision + recall))
        assert r["support"] == (label == c).sum()
    assert rows["accuracy"]["f1_score"] == pytest.approx((guess == label).mean())
    assert rows["macro avg"]["recall"] == pytest.approx((rows["0"]["recall"] + rows["1"]["recall"]) / 2)


def test_report_with_an_empty_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "p int, y int")
    rows = {r["class"]: r for r in evaluate.classification_report(df, "p", "y").collect()}
    assert rows["1"]["precision"] == rows["1"]["recall"] == rows["1"]["f1_score"] == 0.0
    assert rows["accuracy"]["precision"] == 1.0
