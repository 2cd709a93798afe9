"""The k-th rows of groups whose first key doesn't tell rows apart."""

import random

from civicspark.operators import paging


def test_later_keys_go_on_and_no_group_is_shuffled_whole(spark):
    rng = random.Random(3)
    rows = [("a", 7, i, rng.randint(0, 9)) for i in range(400)] + [("b", rng.randint(0, 3), i, 0) for i in range(50)] + [(None, i, None if i % 5 else i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, x int, y int, id int")
    keys = [("x", "asc"), ("y", "desc"), ("id", "asc")]
    for k in (1, 33, 250, 10_000):
        out = paging.kth_deep(df, "g", keys, k, most=5)
        want = {}
        for g in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], -(r[2] if r[2] is not None else 2**62), r[3]))
            want[g] = (*own[min(k, len(own)) - 1][1:], min(k, len(own)), len(own))
        assert {r["g"]: (r["x"], r["y"], r["id"], r["k"], r["total"]) for r in out.collect()} == want and out.columns == [*df.columns, "k", "total"]
    assert "_lo1" in out._jdf.queryExecution().analyzed().toString()  # the second key was counted, as 400 rows of "a" share the first
