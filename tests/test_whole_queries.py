"""Registered queries read whole texts."""

from foliant.plans import folds


def test_alignment_tells_turns_apart_after_their_first_characters(spark, tmp_path):
    lead = "the same beginning of every turn in this talk " * 2
    rows = [(1, t, "user", lead + name) for t, name in ((1, "alpha"), (2, "beta"), (3, "gamma"), (4, "delta"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["old_place"], r["new_place"]) for r in folds.t22_list_alignment(spark, str(tmp_path)).collect()}
    assert got == {(1, 0), (2, 1), (3, 2)}
