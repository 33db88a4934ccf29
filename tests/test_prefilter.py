from __future__ import annotations

from trialspark.operators.prefilter import split_by_ids


def test_split_by_ids_loses_nothing(spark):
    df = spark.range(5000).selectExpr("case when id = 7 then null else id end as k", "id as v")
    ids = spark.range(0, 5000, 50).selectExpr("id as k")
    maybe, not_in = split_by_ids(df, "k", ids)
    hit, rest = {r["v"] for r in maybe.collect()}, {r["v"] for r in not_in.collect()}
    assert hit | rest == set(range(5000)) and not hit & rest and set(range(0, 5000, 50)) <= hit and 7 in rest and len(hit) < 200
    assert split_by_ids(df, "k", ids.limit(0))[0].count() == 0
