"""Report lines by hand, and the sink's files, archives and two phases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from faultline.operators import report
from faultline.sources import report_sink

FIELDS = (
    "analysis_id long, title string, branch string, generated string, score int, level string, evidence_completeness double, completeness string, calibration string, score_description string, raw_score double, normalized double, "
    "direct int, indirect int, nodes int, edges int, cycles int, orphans int, unresolved int, raw_files int, relevant_files int, health_score int, metadata map<string,string>"
)
TEXT = """# Change Risk Assessment — o/r

> **Analysis ID:** `1` | **Branch:** `main` | **Generated:** today

---

## Executive Summary

**Risk Rating:** `61/100 — HIGH`  
**Evidence Completeness:** `85%` (most)  
**Calibration Status:** RULES

> *so so*

| Metric | Value | Direct Impact | Transitive Impact | Circular Dependencies |
|---|---|---|---|---|
| `61/100` | `HIGH` | `2 files` | `3 files` | `1` |

---

## 1. Risk Breakdown & Scoring Audit

| Rule | Category | Points | Evidence | Affected Files |
|------|----------|--------|----------|----------------|
| `auth` | security | **+9.5** | one hit | `a`, `b`, `c` |
| `none` | general | **+1.0** | x | — |

> **Score Calculation:** Raw Rule Points: `62.5` → Normalized: `61.25` → Final Capped Risk Score: **`61/100`**

---

## 2. Directly Observed Facts

- **`FACT`** `[F-1]` it is
  - *Source:* diff
  - *Files:* `a`

---

## 3. Deterministic Inferences

*No inferences recorded in persisted analysis.*

---

## 4. Recommendations

- **`RECOMMENDATION`** `[R-1]` *[POLICY_BASED]* test it

---

## 5. Blast Radius & Dependency Paths

- **Direct Impact:** `2` file(s)
- **Transitive Impact:** `3` dependent component(s)
- **Total Blast Radius:** `5` component(s)

| Depth | Component / Path | Relationship | Reason |
|-------|------------------|--------------|--------|
"""


def tables(spark):
    a = [(1, "o/r", "main", "today", 61, "HIGH", 0.85, "most", "RULES", "so so", 62.5, 61.25, 2, 3, 10, 20, 1, 1, 0, 2, 2, 80, {"owner": "o", "branch": "main"}), (2, "o/s", "dev", "now", 0, "LOW", 1.0, "all", "RULES", None, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 100, {})]
    d = lambda rows, fields: spark.createDataFrame(rows, "analysis_id long, ord int, " + fields)
    return spark.createDataFrame(a, FIELDS), {
        "factors": d([(1, 2, "none", "general", 1.0, "x", []), (1, 1, "auth", "security", 9.5, "one hit", ["a", "b", "c", "d"])], "rule string, category string, points double, evidence string, files array<string>"),
        "statements": d([(1, 1, "FACT", "F-1", "it is", "diff", None, None, ["a"]), (1, 2, "RECOMMENDATION", "R-1", "test it", None, None, "", [])], "kind string, id string, claim string, source string, ref string, recommendation_type string, files array<string>"),
        "paths": d([(1, k, k // 10, f"m{k:02}", "IMPORTS", "r") for k in range(40)], "depth int, name string, relationship string, reason string"),
        "files": d([(1, 0, "a", "SOURCE", "Python", "src", ["auth"], "ok"), (1, 5, "b", "TEST", "Python", "src", [], "ok")], "path string, category string, language string, module string, signals array<string>, status string"),
        "findings": d([(1, 0, "security", "HIGH", "key", "seen", "move it")], "kind string, classification string, title string, description string, recommendation string"),
        "orphan_files": d([(1, 0, "lost.py")], "path string"),
        "health": d([(1, 0, "tests", 70, 0.25, ["few", "old"]), (1, 1, "docs", 100, 0.1, [])], "category string, score int, weight double, evidence array<string>"),
        "reviewers": d([(1, 0, "a", "Ann", "e"), (1, 1, "b", None, None)], "area string, reviewer string, evidence string"),
    }


def test_markdown(spark):
    a, parts = tables(spark)
    rows = sorted((x.analysis_id, x.ord, x.line) for x in report.markdown_lines(a, **parts).collect())
    text = {k: "\n".join(line for i, _, line in rows if i == k) for k in "12"}
    assert text["1"].startswith(TEXT)
    tail = text["1"][len(TEXT) :].split("\n")
    assert tail[:2] == ["| `0` | `m00` | `IMPORTS` | r |", "| `0` | `m01` | `IMPORTS` | r |"] and sum(x.startswith("| `") and "IMPORTS" in x for x in tail) == 30
    for line in ["| 1 | `a` | `SOURCE` | Python | `src` | auth | ok |", "| 2 | `b` | `TEST` | Python | `src` | — | ok |", "**Potential Orphan Candidates (Showing 1 of 1):**", "- `lost.py`", "- 🔒 **[HIGH] key**: seen", "  - *Recommendation:* move it", report.NOTHING["architecture"], "| tests | `70/100` | `25%` | few; old |", "| docs | `100/100` | `10%` | Healthy |", report.NOTHING["rollback"], "| a | Ann | e |", f"| b | {report.NO_OWNER} |  |", "| `branch` | `main` |"]:
        assert line in tail, line
    # an analysis without rows says so in each section; headings come once and in order
    assert all(x in text["2"] for x in report.NOTHING.values())
    for k in "12":
        assert [x for x in text[k].split("\n") if x.startswith("## ")] == report.SECTIONS
    assert report.markdown_lines(a.limit(0), **{k: v.limit(0) for k, v in parts.items()}).count() == 0


def test_sink(spark, tmp_path):
    a, parts = tables(spark)
    csv = {"one": spark.createDataFrame([(1, 1, 'say "hi", you', ""), (1, 2, "é", " x "), (2, 1, "z", "w")], "analysis_id long, ord int, name string, value string"), "two": spark.createDataFrame([(1, 1, "q")], "analysis_id long, ord int, only string")}
    lines = report.markdown_lines(a, **parts).unionByName(report_sink.csv_lines(csv))
    folder = f"file://{tmp_path}/reports"
    for _ in range(2):  # a second run puts its files in place of the first's
        report_sink.write_reports(lines, folder)
        assert {str(p.relative_to(tmp_path / "reports")) for p in (tmp_path / "reports").rglob("*") if p.is_file()} == {"1/report.md", "1/data.zip", "2/report.md", "2/data.zip"}
    assert (tmp_path / "reports/1/report.md").read_text().startswith(TEXT)
    with zipfile.ZipFile(tmp_path / "reports/1/data.zip") as z:
        assert sorted(z.namelist()) == ["one.csv", "two.csv"] and z.read("one.csv").decode() == 'name,value\r\n"say ""hi"", you",\r\né, x \r\n' and z.read("two.csv") == b"only\r\nq\r\n"
    with zipfile.ZipFile(io.BytesIO((tmp_path / "reports/2/data.zip").read_bytes())) as z:
        assert z.namelist() == ["one.csv"]


def test_sink_leaves_nothing_of_a_job_that_fails(spark, tmp_path):
    folder = f"file://{tmp_path}/reports"
    rows = spark.range(50).select((F.col("id") % 5).cast("string").alias("analysis_id"), F.lit("report.md").alias("file"), F.lit("").alias("entry"), F.col("id").alias("ord"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="broken"):
        report_sink.write_reports(rows, folder)
    assert [p for p in (tmp_path / "reports").rglob("*")] == [] if (tmp_path / "reports").exists() else True


def test_sink_stages_before_it_commits(tmp_path):
    """Two attempts of a task write; only the one whose message is committed is put in place."""
    from pyspark.sql import Row

    w = report_sink.ReportWriter(f"file://{tmp_path}")
    rows = [Row(analysis_id="7", file="report.md", entry="", line=x) for x in "ab"]
    first, second = w.write(iter(rows)), w.write(iter(rows[:1]))
    assert not (tmp_path / "7").exists()
    w.commit([first, None])
    assert (tmp_path / "7/report.md").read_text() == "a\nb\n" and [p.name for p in tmp_path.iterdir()] == ["7"]
    third = w.write(iter(rows[:1]))
    w.abort([third])
    assert (tmp_path / "7/report.md").read_text() == "a\nb\n" and [p.name for p in tmp_path.iterdir()] == ["7"] and second.files
