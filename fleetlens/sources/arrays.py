"""Elements of JSON arrays that span whole files, found by byte ranges.

A file with one array over many lines need not be read by one task. Text is cut after every closing
brace, which Spark's text reader does within byte ranges; whether such a brace ends an element depends on
what stands before it, and that composes: each piece of text adds a number of quotes, whose parity says
whether a place is inside a string, and then a change of nesting outside strings. Both are running
sums, scanned per range first and over the ranges of a file then. Where a brace brings the nesting back to that of the array, an
element ends; pieces of one element are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.scan import Slices, chunked_scan, pack, so_far, unpack

BROKEN = "not a complete JSON object"


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.translate(text, what, ""))


def _running(df: DataFrame, slices: Slices | None, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows before this one in its file."""
    scanned = chunked_scan(
        df.withColumn("__v", value),
        [F.col("row")],
        slices,
        local={"__here": lambda w: F.sum("__v").over(so_far(w))},
        summary={"__sum": F.sum("__v")},
        carry={"__earlier": lambda w: F.sum("__sum").over(w)},
    )
    before = F.coalesce("__earlier", F.lit(0)) + F.col("__here") - F.col("__v")
    return scanned.withColumn(out, before).drop("__v", "__here", "__earlier")


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, position, element)``: the text of every element of the arrays, counted from 0 in each file.

    Elements are objects. What a file that breaks off holds of its last element is an element too, and so is the text of a
    file that is no array; reading it as an object fails. Empty arrays and files have none. Memory is that of a range or
    of one element, whatever the size of the file.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"),
    )
    # An escape never spans two pieces: a backslash does not stand before a brace.
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    quoted = _running(pack(pieces.withColumn("bare", bare), ["file"]), Slices(F.col("block"), 1), _count(F.col("bare"), '"'), "quotes")
    inside = F.col("quotes") % 2 == 1
    ends_inside = (F.col("quotes") + _count(F.col("bare"), '"')) % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), F.col("bare")), r'(?s)"[^"]*("|$)', "")
    quoted = quoted.withColumns({"outside": outside, "closes": F.when(ends_inside, 0).otherwise(1)})
    change = _count(F.col("outside"), "{[") - _count(F.col("outside"), "]") - F.col("closes")
    nested = _running(quoted.withColumn("change", change), None, F.col("change"), "depth")
    ends = ((F.col("closes") == 1) & (F.col("depth") + F.col("change") == 1)).cast("long")
    counted = unpack(_running(nested.withColumn("ends", ends), None, F.col("ends"), "position"))
    # The last piece ends with a brace only if the file does, which its size tells.
    files = counted.groupBy("file").agg(
        F.max(F.struct("block", "row")).alias("last"),
        (F.sum(F.octet_length("text")) + F.count(F.lit(1)) == F.max("size")).alias("whole"),
    )
    closed = F.col("whole") | (F.struct("block", "row") != F.col("last"))
    piece = F.concat("text", F.when(closed, "}").otherwise(""))
    marked = counted.join(files, "file").withColumn("piece", piece)
    inner = F.array_sort(F.collect_list(F.struct("block", "row", "piece")))
    whole = marked.groupBy("file", "position").agg(F.array_join(F.transform(inner, lambda p: p["piece"]), "").alias("text"))
    element = F.regexp_replace("text", r"^(?:[\s,\x{FEFF}]*\[)?[\s,]*|\s+$", "")
    return whole.select("file", "position", element.alias("element")).where(~F.col("element").isin("", "]"))
