"""Training over rows with a weight."""

import pytest

from foliant.operators import ml


@pytest.mark.parametrize("kind", ml.WEIGHTED if hasattr(ml, "WEIGHTED") else ["svm"])
def test_rows_alike_reach_the_classifier_once(spark, monkeypatch, kind):
    few = spark.createDataFrame([(0.0, 1.0, "a"), (1.0, 3.0, "a"), (4.0, 2.0, "b"), (5.0, 0.0, "b"), (9.0, 9.0, "c")], "x double, y double, label string")
    many = few.crossJoin(spark.range(40)).drop("id")
    real, seen = ml.classifier, []

    def watched(*args, **options):
        found = real(*args, **options)
        fit = found.fit
        found.fit = lambda rows: seen.append(rows.count()) or fit(rows)
        return found

    monkeypatch.setattr(ml, "classifier", watched)
    options = {"trees": 3} if kind == "gradient_boost" else {}
    said = {(r["x"], r["label"]): r["document_type"] for r in ml.predict_class(ml.train_classifier(many, ["x", "y"], "label", kind, **options), few).collect()}
    assert seen == [5]
    assert said == {(x, label): label for x, label in said} and len(said) == 5


def test_weights_tell_rows_as_all_rows_do(spark):
    few = spark.createDataFrame([(float(i % 7), float(i * i % 11), "b" if i % 7 > 3 else "a") for i in range(60)], "x double, y double, label string")
    model = ml.train_classifier(few.unionByName(few).unionByName(few), ["x", "y"], "label", "svm")
    assert ml.predict_class(model, few).where("label <> document_type").count() == 0
