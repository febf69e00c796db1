"""Propensity of a nominal target given background knowledge, for measures that compare a subgroup with what was to be expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import model
from sieveline.model import Conditions, Target
from sieveline.operators.stats import PROPENSITY, positive
from sieveline.operators.tables import materialised


def with_propensity(df: DataFrame, target: Target, knowledge: list[Conditions]) -> DataFrame:
    """Adds each row's probability of the target by a logistic regression, without a penalty, on which of the known descriptions cover it. Without knowledge it is the share of positives."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    label = positive(target).cast("double")
    if not knowledge:
        share = df.agg(F.avg(label)).first()[0] or 0.0
        return df.withColumn(PROPENSITY, F.lit(float(share)))
    names = [f"__known{i}" for i in range(len(knowledge))]
    rows = df.withColumns({n: model.conjunction(c).cast("double") for n, c in zip(names, knowledge)}).withColumn("__label", label)
    rows = materialised(VectorAssembler(inputCols=names, outputCol="__features").transform(rows).drop(*names))
    fitted = LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__prediction", regParam=0.0, maxIter=100, tol=1e-9).fit(rows)
    return fitted.transform(rows).select(*df.columns, vector_to_array("__p")[1].alias(PROPENSITY))
