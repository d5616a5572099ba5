"""Votes are counted where their group is."""

from kotonoha.functions.tables import small_table
from kotonoha.operators import similarity


def test_ties_and_unknown_members(spark):
    c = small_table(spark, [("ab", "b"), ("ab", "a"), ("cd", "c"), ("cd", "d"), ("ce", "c"), ("ce", "c")], "item string, component string")
    g = spark.createDataFrame([(1, "ab"), (1, "cd"), (1, "zz"), (1, "zz"), (2, "zz"), (3, "cd"), (3, "ce"), (3, "ab"), (4, "cd"), (4, "ce")], "group_id int, member string")
    got = {(r.group_id, r.component, r.votes) for r in similarity.majority_components(g, c, 0.5).collect()}
    # nothing of group 1 reaches two votes of four: the first of the strongest stands alone
    assert got == {(1, "a", 1), (3, "c", 2), (4, "c", 2), (4, "d", 1)}


def test_votes_are_not_shuffled_by_component(spark):
    c = small_table(spark, [("ab", "b")], "item string, component string")
    g = spark.range(9).selectExpr("id % 3 group_id", "'ab' member")
    plan = similarity.majority_components(g, c)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(group_id#" in plan
    assert not any("hashpartitioning(group_id" in line and "_c#" in line.split("hashpartitioning")[1].split(")")[0] for line in plan.splitlines())
    assert not any("hashpartitioning(group_id" in line and "component#" in line.split("hashpartitioning")[1].split(")")[0] for line in plan.splitlines())
