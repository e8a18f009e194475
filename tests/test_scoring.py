from pyspark.sql import functions as F

from attesta.functions.scoring import status_label, trust_score

GOLDEN = [
    (0, 0, 0, 0.85, 0.00, "unclear"),
    (1, 0, 0, 0.80, 0.60, "unclear"),
    (1, 1, 0, 0.85, 0.73, "unclear"),
    (1, 2, 0, 0.85, 0.81, "verified"),
    (1, 2, 0, 0.80, 0.76, "verified"),
    (1, 2, 0, 0.75, 0.71, "unclear"),
    (1, 3, 0, 0.75, 0.79, "verified"),
    (1, 4, 0, 0.85, 0.95, "verified"),
    (1, 9, 0, 0.85, 0.95, "verified"),
    (1, 1, 1, 0.85, 0.43, "contradicted"),
    (1, 3, 1, 0.85, 0.59, "unclear"),
    (1, 0, 1, 0.85, 0.35, "contradicted"),
    (1, 0, 3, 0.85, 0.00, "contradicted"),
    (1, 0, 0, 0.10, 0.00, "unclear"),
]


def test_golden_scores(spark):
    df = spark.createDataFrame(GOLDEN, "n long, s long, c long, conf double, want double, label string")
    score = trust_score(F.col("n"), F.col("s"), F.col("c"), F.col("conf"))
    rows = df.withColumn("got", score).select(
        "*", status_label(F.col("got"), F.col("s"), F.col("c")).alias("status")
    ).collect()
    assert [(round(r.got, 2), r.status) for r in rows] == [(g[4], g[5]) for g in GOLDEN]


def test_score_stays_in_range_and_contradiction_bars_verified(spark):
    grid = (
        spark.range(12).select(F.col("id").alias("s"))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(5))))
        .withColumn("conf", F.explode(F.array(*[F.lit(x / 10) for x in range(11)])))
    )
    score = trust_score(F.lit(1), F.col("s"), F.col("c"), F.col("conf"))
    out = grid.withColumn("t", score).withColumn("st", status_label(F.col("t"), F.col("s"), F.col("c")))
    assert out.filter("t < 0 or t > 1 or (c > 0 and st = 'verified')").count() == 0
