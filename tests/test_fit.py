"""The baseline's fit: few passes, and the minimum that Spark ML finds."""
import random

from pyspark.sql import functions as F

from tierflow.operators import logistic
from tierflow.operators.scoring import sparse_rows, train_lr


def _texts(spark, n=400):
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(30_000)]
    return spark.createDataFrame([(i, " ".join(rnd.choices(words, k=40)), rnd.randrange(2)) for i in range(n)], "id long, clean string, label int")


def _jobs(spark, name, work):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        return work(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_the_fit_takes_few_passes(spark):
    """Spark ML divides features by their deviation, and its search takes more passes on rare terms."""
    from pyspark.ml.classification import LogisticRegression
    df = _texts(spark)
    model = train_lr(df, tol=1e-13)
    x = sparse_rows(model.features(df), model.indexed, len(model.coefficients), df.select("id")).join(df.select("id", F.col("label").cast("double").alias("label")), "id").persist()
    x.count()
    ml = LogisticRegression(maxIter=1000, tol=1e-13, regParam=1.0 / 400, elasticNetParam=0.0, standardization=False)
    theirs, many = _jobs(spark, "ml-fit", lambda: ml.fit(x))
    rows = x.select("label", F.expr("features")).rdd.map(lambda r: (r.label, r.features.indices.tolist(), r.features.values.tolist())).toDF("label double, indices array<int>, values array<double>")
    (w, b), few = _jobs(spark, "own-fit", lambda: logistic.fit(rows, len(model.coefficients), 1.0, 1000, 1e-13))
    assert few < 50 < many
    assert max(abs(theirs.coefficients.toArray() - w)) < 1e-4 and abs(theirs.intercept - b) < 1e-4
    assert max(abs(model.coefficients - w)) < 1e-5


def test_blocks_hold_rows_without_cells(spark):
    rows = spark.createDataFrame([(1.0, [0, 2], [1.0, 2.0]), (0.0, [], []), (1.0, [2], [3.0])], "label double, indices array<int>, values array<double>").coalesce(1)
    block = [tuple(r) for r in rows.mapInArrow(logistic.to_blocks, logistic._BLOCKS).collect()]
    assert logistic.squares(block, 3).tolist() == [1.0, 0.0, 13.0, 3.0]
    got = logistic.loss_and_gradient(block, logistic.np.zeros(4))
    assert got[:4].tolist() == [-0.5, 0.0, -2.5, -0.5] and abs(got[4] - 3 * logistic.np.log(2)) < 1e-12
