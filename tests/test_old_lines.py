"""Lines of patches are read in the task that holds the patch."""

from weftline.operators.diffs import changed_old_lines


def test_lines_are_not_sorted(spark):
    patch = "@@ -9 +9 @@\n-x\ndiff --git a/f b/f\n--- a/f\n+++ b/f\n-no\n@@ -3,2 +3,2 @@\n a\n-b\n+c\n+d\n--- /dev/null\n-no\n@@ -7\n-e\n+f\n"
    found = changed_old_lines(spark.createDataFrame([("i", patch), ("j", None), ("k", "")], "instance_id string, patch string"))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("i", None, 9), ("i", "f", 4), ("i", "f", 5), ("i", "/dev/null", 7), ("i", "/dev/null", 8)}
