import pytest
from pyspark.sql import functions as F

from strideframe.operators import metrics as met

LABELS = {"train": 2, "bus": 0, "car": 1}


def predictions(spark, matrix):
    order = list(LABELS.values())
    rows = [(order[i], order[j], f"s{i}{j}{n}", "p1") for i, row in enumerate(matrix) for j, c in enumerate(row) for n in range(c)]
    return spark.createDataFrame(rows, "label int, prediction int, session_id string, participant_id string")


def classes(spark, matrix):
    sums = met.confusion_sums(predictions(spark, matrix), LABELS)
    return {r.transport_mode: (r.support, r.precision, r.recall, r.f1, r.accuracy) for r in met.per_class_metrics(sums, LABELS).collect()}


def by_hand(matrix):
    """support, precision, recall, F1 and one-vs-rest accuracy of each class, counted pair by pair."""
    pairs = [(i, j) for i, row in enumerate(matrix) for j, n in enumerate(row) for _ in range(n)]
    out = []
    for c in range(len(matrix)):
        hit, said, was = (sum(f(i, j) for i, j in pairs) for f in (lambda i, j: i == j == c, lambda i, j: j == c, lambda i, j: i == c))
        right = sum((i == c) == (j == c) for i, j in pairs)
        out.append((was, hit / said if said else 0, hit / was if was else 0, 2 * hit / (said + was) if said + was else 0, right / len(pairs)))
    return out


@pytest.mark.parametrize("matrix", [[[5, 0, 2], [1, 6, 1], [3, 2, 4]], [[0, 3, 0], [0, 8, 1], [0, 0, 0]], [[1, 0, 0], [0, 0, 0], [0, 0, 9]]])
def test_classes_in_label_order(spark, matrix):
    found, wanted = classes(spark, matrix), by_hand(matrix)
    assert found == {n: pytest.approx(w) for n, w in zip(LABELS, wanted)}
    row = met.overall_metrics(met.confusion_sums(predictions(spark, matrix), LABELS), LABELS).first()
    assert row.balanced_accuracy == pytest.approx(sum(w[2] for w in wanted) / 3)
    assert row.minimum_class_recall == pytest.approx(min(w[2] for w in wanted))


def test_no_rows_leave_accuracy_empty(spark):
    assert all(v[4] is None for v in classes(spark, [[0] * 3] * 3).values())


def test_votes_take_the_lowest_class_on_ties_and_need_one_label(spark):
    rows = [("a", "p", 1, 0.5, 0.5, 0.0), ("a", "p", 1, 0.3, 0.3, 0.4), ("b", "p", 2, 0.0, 0.2, 0.8)]
    df = spark.createDataFrame(rows, "session_id string, participant_id string, label int, probability_0 double, probability_1 double, probability_2 double")
    assert {r.session_id: r.prediction for r in met.session_vote(df, [0, 1, 2]).collect()} == {"a": 0, "b": 2}
    with pytest.raises(Exception, match="more than one true label"):
        met.session_vote(df.withColumn("label", F.monotonically_increasing_id()), [0, 1, 2]).collect()


def test_alignment_sees_multiplicity(spark):
    one = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "id string, label int")
    assert met.paired_alignment(one, one, ["id", "label"]).count() == 0
    assert met.paired_alignment(one, one.distinct(), ["id", "label"]).collect()[0].asDict() == {
        "id": "x", "label": 1, "left_rows": 2, "right_rows": 1}


def test_stored_matrix_must_be_reproduced(spark):
    p = predictions(spark, [[5, 0, 2], [1, 6, 1], [3, 2, 4]])
    stored = met.confusion_matrix(met.confusion_sums(p, LABELS), LABELS).select("label", "prediction", "n")
    assert met.stored_matrix_differences(p, stored, LABELS).count() == 0
    off = stored.withColumn("n", F.col("n") + F.when(F.col("label") == F.col("prediction"), 0).otherwise(1))
    assert met.stored_matrix_differences(p, off, LABELS).count() == 12
