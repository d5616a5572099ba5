"""Items with all components: by pairs, and no more candidates than results for short requests."""

import random

from kotonoha.operators import similarity


def test_requests_of_any_length_equal_a_plain_search(spark):
    rng = random.Random(5)
    letters = "亜唖娃阿哀愛挨"
    items = {a + b + c: set(rng.sample("口木日月火水", rng.randint(1, 5))) for a in letters for b in letters for c in "亜唖"}
    items["x" + letters] = set("口木日月火水")  # not of the population
    asked = {n: set(rng.sample("口木日月火水土", rng.randint(1, 5))) for n in range(60)}
    components = spark.createDataFrame([(i, c) for i, cs in items.items() for c in cs] * 2, "item string, component string")
    wanted = spark.createDataFrame([(r, c) for r, cs in asked.items() for c in cs] * 2, "request_id long, component string")
    want = sorted((r, i) for r, need in asked.items() for i, have in items.items() if need <= have and not i.startswith("x"))
    got = similarity.items_with_all(wanted, components)
    assert sorted(map(tuple, got.collect())) == want


def test_short_requests_meet_no_item_that_lacks_one(spark):
    # every item has 口, half have 木; no item has both
    rows = [("亜" * (1 + n % 9) + "哀" * (n // 9), "木" if n % 2 else "口") for n in range(90)]
    components = spark.createDataFrame([(i, c) for i, c in rows], "item string, component string")
    wanted = spark.createDataFrame([(1, "口"), (1, "木")], "request_id long, component string")
    out = similarity.items_with_all(wanted, components)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.collect() == [] and "array_except" not in plan
