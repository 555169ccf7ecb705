"""Typed-in domains in their ASCII form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelumen.functions import urls as U


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts in the encoding of internationalised domain names; null where a label can't be encoded."""
    for batch in batches:
        out = []
        for host in batch.column(0).to_pylist():
            try:
                out.append(host.encode("idna").decode("ascii").lower())
            except UnicodeError:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "ascii"])


def ascii_domains(df: DataFrame, text: str, name: str = "domain") -> DataFrame:
    """Adds the normalised domain of a typed-in address, internationalised names as ``xn--`` labels.

    Only hosts with other characters go through Python, each once; a host that can't be encoded stays as typed, in lower case.
    Null if nothing is left of the text.
    """
    kept = [c for c in df.columns if c.lower() != name.lower()]
    # Columns go by place meanwhile: their names can clash with nothing.
    keyed = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), U.domain(F.col(f"`{text}`")).alias("typed"))
    odd = keyed.select(F.col("typed").alias("host")).where(F.col("host").rlike(r"[^\x00-\x7f]")).distinct()
    met = keyed.join(odd.mapInArrow(_encoded, "host string, ascii string"), F.col("typed") == F.col("host"), "left")
    plain = F.regexp_replace(F.coalesce("ascii", "typed"), r"^www\.", "")
    return met.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), plain.alias(name))
