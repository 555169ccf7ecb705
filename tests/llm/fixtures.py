"""Rows with nulls, empties, repeats and clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=None):
    """A documents table of the texts; ``extra`` adds a string column of that name."""
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        frame = frame.withColumn(extra, F.lit("theirs"))
    return frame
