"""Unified diffs, test logs and resolution grading as window queries over lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def changed_old_lines(patches: DataFrame, key: str = "instance_id", text: str = "patch") -> DataFrame:
    """T20. key, file, line: the old lines that a patch removes, and where it adds (at the old line reached).

    Added lines do not advance the old line; any line that is not an addition does.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            name, at, file, line = batch.column(0), [], [], []
            for i, patch in enumerate(batch.column(1).to_pylist()):
                for own, old in _old_lines(patch or ""):
                    at.append(i)
                    file.append(own)
                    line.append(old)
            yield pa.RecordBatch.from_arrays([name.take(pa.array(at, pa.int64())), pa.array(file, pa.string()), pa.array(line, pa.int64())], names=[key, "file", "old_line"])

    return patches.select(key, F.col(text).alias("w_text")).mapInArrow(run, f"`{key}` {dict(patches.dtypes)[key]}, file string, old_line long").distinct()


def _old_lines(patch: str) -> set[tuple[str | None, int]]:
    file, at, found = None, None, set()
    for line in patch.split("\n"):
        if head := re.match(r"@@ -([0-9]+)", line):
            at = int(head[1])
        elif line.startswith("--- "):
            file, at = line[4:].removeprefix("a/"), None
        elif line.startswith("diff "):
            at = None
        elif at is not None:
            if line.startswith(("+", "-")):
                found.add((file, at))
            at += not line.startswith("+")
    return found


def modified_lines(patch: Column) -> Column:
    """T21. Added and removed lines, file headers aside."""
    return F.size(F.filter(F.split(patch, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)")))


def normalized_patch(patch: Column) -> Column:
    """T21. A patch's changed lines without blanks, for comparing patches."""
    kept = F.filter(F.split(patch, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))
    return F.concat_ws("\n", F.transform(kept, lambda x: F.regexp_replace(x, r"\s+", "")))


#: Line grammars of test logs: (pattern, group of the test, group of the status).
GRAMMARS = {
    "matplotlib": (r"^(PASSED|FAILED|ERROR|XFAIL|SKIPPED)\S*\s+(\S+)", 2, 1),
    "pytest": (r"^(PASSED|FAILED|ERROR|XFAIL|SKIPPED)\s+(\S+)", 2, 1),
    "suffix": (r"^(\S+)\s+(PASSED|FAILED|ERROR|XFAIL|SKIPPED)\b", 1, 2),
    "jest": (r"^(PASS|FAIL) \s*(\S+)", 2, 1),
    "dayjs": (r"^(PASS|FAIL) \s*(\S+)", 2, 1),
    "unittest": (r"^(?=(?:FAIL|ERROR): |.*\.\.\. (?:FAIL$|ERROR$|ok$|skipped ))(?:(?=FAIL|ERROR)(FAIL|ERROR): )?(.*?)(?: *\.\.\. (FAIL|ERROR|ok|skipped).*)?$", 2, 1),
    "sympy": (r"^(test_\w+)\s+(ok|F|E|f)\b", 1, 2),
    "maven": (r"^(?=.*Tests run:)(?=.*Time elapsed:)(?=.*Errors: ([0-9]+))?(?=.*Failures: ([0-9]+))?.*?- in (.*?)(?:- in .*)?$", 3, 1),
}
#: Statuses as graded.
STATUS = {"PASSED": "PASSED", "PASS": "PASSED", "ok": "PASSED", "XFAIL": "PASSED", "FAILED": "FAILED", "FAIL": "FAILED", "F": "FAILED", "f": "FAILED", "ERROR": "ERROR", "E": "ERROR", "SKIPPED": "SKIPPED", "skipped": "SKIPPED", "Tests run": "PASSED"}


def test_statuses(logs: DataFrame, key: str = "instance_id", text: str = "log", grammar: str = "pytest", after: str | None = None) -> DataFrame:
    """T22, T23. key, test, status: the last status of every test; after a marker line only, if one is named."""
    pattern, test, status = GRAMMARS[grammar]
    l = _lines(logs, key, text).withColumn("line", F.regexp_replace("line", r"\x1B\[[0-9;]*[A-Za-z]|[\x00-\x08\x0B-\x1F]", ""))
    if after:
        passed = F.max(F.contains(F.col("line"), F.lit(after))).over(Window.partitionBy(key).orderBy("pos"))
        l = l.withColumn("open", passed).where("open")
    if grammar == "matplotlib":  # names that hold a mouse button are known by its number
        plain = F.replace(F.replace("line", F.lit("MouseButton.LEFT"), F.lit("1")), F.lit("MouseButton.RIGHT"), F.lit("3"))
        l = l.withColumn("line", F.when(F.startswith("line", F.lit("FAILED")), F.replace(plain, F.lit(" - "), F.lit(" "))).otherwise(plain))
    part = lambda k: F.regexp_extract("line", pattern, k)
    name, raw = part(test), part(status)
    if grammar == "maven":  # failed if any error or failure is counted, passed if both are counted as none
        errors, failures = part(1).try_cast("int"), part(2).try_cast("int")
        name = F.concat(F.lit("org."), F.trim(part(3)))
        raw = F.when((errors > 0) | (failures > 0), "FAILED").when((errors == 0) & (failures == 0), "PASSED")
    elif grammar == "unittest":
        l = l.withColumn("line", F.trim("line"))
        name, raw = F.trim(name), F.when(raw != "", raw).otherwise(part(3))
    found = l.where(F.col("line").rlike(pattern)).select(key, "pos", name.alias("test"), raw.alias("raw")).where("raw is not null")
    if grammar == "dayjs":  # runs of the time zone tests are told apart by their number
        again = F.col("test") == "test/timezone.test.js"
        own = F.row_number().over(Window.partitionBy(key, "test").orderBy("pos"))
        found = found.withColumn("test", F.when(again, F.concat("test", F.lit("("), own, F.lit(")"))).otherwise(F.col("test")))
    if grammar == "unittest":  # an "ok" on a line of its own closes the test named last before " ... "
        named = F.last(F.when(F.contains("line", F.lit(" ... ")), F.trim(F.substring_index("line", " ... ", 1))), ignorenulls=True).over(Window.partitionBy(key).orderBy("pos"))
        late = l.select(key, "pos", named.alias("test"), F.lit("ok").alias("raw"), "line").where(F.col("line").startswith("ok") & F.col("test").isNotNull())
        found = found.unionByName(late.drop("line"))
        # A test that this line names has passed, and so has one that is cut by one of these messages before its "ok".
        version = "--version is equivalent to version"
        found = found.unionByName(l.where(F.contains("line", F.lit(version))).select(key, "pos", F.lit(version).alias("test"), F.lit("ok").alias("raw")))
        cut = r"^(.*?)\s\.\.\.\s(?:Testing against Django installed in .* silenced\)\.|Internal Server Error: /.*/|System check identified no issues \(0 silenced\))$"
        after = F.lead("line").over(Window.partitionBy(key).orderBy("pos"))
        ended = l.select(key, "line", after.alias("after")).where(F.col("line").rlike(cut) & (F.col("after") == "ok"))
        found = found.unionByName(ended.select(key, F.lit(2**31 - 1).alias("pos"), F.regexp_extract("line", cut, 1).alias("test"), F.lit("ok").alias("raw")))
    graded = F.coalesce(*(F.when(F.col("raw") == k, v) for k, v in STATUS.items()))
    return found.groupBy(key, "test").agg(F.max_by(graded, "pos").alias("status"))


def resolution(gold: DataFrame, statuses: DataFrame, key: str = "instance_id") -> DataFrame:
    """A26. f2p and p2p rates (an empty set counts 1, a missing test failed) and FULL, PARTIAL or NO.

    gold has a row (key, test, kind) for each expected test, kind being f2p or p2p.
    """
    joined = gold.join(statuses, [key, "test"], "left").withColumn("ok", F.coalesce(F.col("status") == "PASSED", F.lit(False)))
    rate = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("ok").cast("double"))), F.lit(1.0))
    rates = joined.groupBy(key).agg(rate("f2p").alias("f2p"), rate("p2p").alias("p2p"))
    return rates.withColumn("resolution", F.when((F.col("f2p") == 1) & (F.col("p2p") == 1), "FULL").when((F.col("f2p") > 0) & (F.col("f2p") < 1) & (F.col("p2p") == 1), "PARTIAL").otherwise("NO"))


def block_ends(lines: DataFrame, key: str, start: str = "start_line") -> DataFrame:
    """T12. key, start, end of a block opened in line start: where its braces balance, else the start itself."""
    opened = F.length("line") - F.length(F.replace(F.col("line"), F.lit("{"), F.lit("")))
    closed = F.length("line") - F.length(F.replace(F.col("line"), F.lit("}"), F.lit("")))
    w = Window.partitionBy(key, start).orderBy("line_no")
    run = lines.where(F.col("line_no") >= F.col(start)).select(key, start, "line_no", F.sum(opened - closed).over(w).alias("depth"), F.sum(opened).over(w).alias("seen"))
    return run.groupBy(key, start).agg(F.coalesce(F.min(F.when((F.col("depth") <= 0) & (F.col("seen") > 0), F.col("line_no"))), F.col(start)).alias("end_line"))
