"""Repeated lines at the lengths that the registered query uses."""

from fleetlens.llm import line_dedup


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.text for r in line_dedup.deduplicated(docs).orderBy("doc_id").collect()]


def test_equal_lines_go_at_any_length(spark):
    short, long = "All rights reserved.", "a line of more than thirty characters"
    texts = [f"{short}\n\n{long}\nx", f"{short}\n\n \t\u3000\n{long}", f"new\nx\n{short}\n \t\u3000\n{short}"]
    assert kept(spark, texts) == [f"{short}\n\n{long}\nx", "\n \t\u3000", "new\n \t\u3000"]


def test_edits_count_in_long_lines_only(spark):
    short, long = "All rights reserved.", "a line of more than thirty characters"
    assert kept(spark, [f"{short}\n{long}", f"{short}.\n{long}."]) == [f"{short}\n{long}", f"{short}."]
