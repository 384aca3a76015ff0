"""Nested reports of owners and files of any size."""

from pyspark.sql import functions as F

from trivet.operators import report


def decided(rows):
    """Decisions from ``owner, file_path, match_line_number``."""
    fixed = {"pattern_name": F.lit("P"), "is_credentials": F.lit(1), "status": F.lit("REAL"), "confidence": F.lit(0.875), "reasoning": F.lit("r"), "evidence": F.array(F.lit("e")), "json_valid": F.lit(True), "matched_value": F.lit("v")}
    return rows.withColumns(fixed)


def test_small_owners_have_one_part(spark):
    rows = spark.createDataFrame([("a", "f", 2), ("a", "f", 1), ("a", "g", 1), ("b", "f", 1), (None, "", 5), ("", None, 6)], "owner string, file_path string, match_line_number int")
    got = {r.owner: r for r in report.nested_report(decided(rows)).collect()}
    assert set(got) == {"a", "b", "unknown"} and all(r.part == 0 for r in got.values())
    assert [x.match_line_number for x in got["a"].files["f"]] == [1, 2] and got["a"].summary.total == 3
    assert [x.match_line_number for x in got["unknown"].files["unknown"]] == [5, 6] and got["unknown"].files["unknown"][0].confidence == 0.88
    assert report.nested_report(decided(rows.limit(0))).count() == 0


def test_parts_hold_every_detection_in_order(spark):
    """Equal detections, a file over several parts, and owners on both sides."""
    rows = spark.range(1000).select(F.concat(F.lit("o"), (F.col("id") % 3).cast("string")).alias("owner"), F.lit("f").alias("file_path"), (F.col("id") % 5).cast("int").alias("match_line_number"))
    parts = report.nested_report(decided(rows), most=30).collect()
    assert max(sum(map(len, r.files.values())) for r in parts) == 30
    for k in range(3):
        own = sorted((r for r in parts if r.owner == f"o{k}"), key=lambda r: r.part)
        assert [r.part for r in own] == list(range(len(own)))
        assert len({r.summary for r in own}) == 1
        lines = [x.match_line_number for r in own for x in r.files["f"]]
        assert lines == sorted(lines) and len(lines) == own[0].summary.total


def test_an_owner_of_a_million_files(spark):
    rows = spark.range(1_000_000).select(F.lit("big").alias("owner"), F.format_string("f%07d", F.col("id")).alias("file_path"), F.lit(1).alias("match_line_number"))
    parts = report.nested_report(decided(rows)).select("part", F.size("files").alias("n"), "summary.total").collect()
    assert sum(r.n for r in parts) == 1_000_000 and max(r.n for r in parts) <= 20_000
    assert sorted(r.part for r in parts) == list(range(len(parts))) and [r.total for r in parts if r.part == 0] == [1_000_000]
