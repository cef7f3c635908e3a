"""Every distinct value is a candidate, however many there are."""

from tiermark.operators import tailfit


def test_more_than_five_thousand_candidates(spark):
    n = 5101
    df = spark.range(1, n + 1).selectExpr("'g' AS label", "id AS v")
    got = tailfit.tail_candidates(df, ["label"], "v").select("xmin").collect()
    assert sorted(r["xmin"] for r in got) == list(range(1, n))
