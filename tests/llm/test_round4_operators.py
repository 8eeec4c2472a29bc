"""What a Python worker holds at once."""

from pyspark.sql import functions as F

from loreloom.llm import suffixes


def test_spans_are_sorted_in_small_groups(spark, monkeypatch):
    """2.4 MB of different spans in one task; none is sorted with more than 1 MB of others."""
    sorted_whole, bound = suffixes.repeated_starts, 1 << 20

    def counted(data, *rest):
        assert len(data) <= bound, f"{len(data)} bytes are sorted at once"
        return sorted_whole(data, *rest)

    monkeypatch.setattr(suffixes, "repeated_starts", counted)
    span = F.rpad(F.sha2(F.col("id").cast("string"), 512), 120, "x").cast("binary")
    laid = spark.range(20_000).select(
        F.col("id").alias("anchor"), F.lit(0).cast("long").alias("shard"),
        F.struct(F.lit(7).cast("long").alias("f"), F.col("id").alias("r")).alias("row_key"),
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"),
        F.unhex(F.lit("0000")).alias("marks"), span.alias("span"),
    )
    twice = laid.unionByName(laid.filter("anchor % 100 = 0").withColumn("doc_id", F.col("doc_id") + 20_000).withColumn(
        "row_key", F.struct(F.lit(8).cast("long").alias("f"), F.col("anchor").alias("r"))
    ))
    found = suffixes._sorted_repeats(twice, 100).collect()
    assert sorted((r["row_key"]["f"], r["row_key"]["r"], r["start"], r["end"]) for r in found) == [
        (8, i, 0, 100) for i in range(0, 20_000, 100)
    ]
