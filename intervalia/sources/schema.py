"""Canonical schemas and the reference spellings that adapt() accepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _schema(**kinds) -> StructType:
    return StructType([StructField(n, t) for n, t in kinds.items()])


QBED = _schema(chr=StringType(), start=LongType(), end=LongType(), reads=LongType(), direction=StringType(), barcode=StringType())
BED3 = _schema(chr=StringType(), start=LongType(), end=LongType())
SITES = BED3
GENES = _schema(chr=StringType(), start=LongType(), end=LongType(), refseq=StringType(), gene=StringType(), strand=StringType())
GNASHY = _schema(number=LongType(), pos=LongType(), reads=LongType())

# Column spellings of the file format and of peak tables.
SPELLINGS = {
    "Chr": "chr", "Start": "start", "End": "end", "Reads": "reads", "Direction": "direction", "Barcodes": "barcode", "Center": "center",
    "Experiment Insertions": "experiment_insertions", "Background insertions": "background_insertions", "Reference Insertions": "reference_insertions",
    "Expected Insertions": "expected_insertions", "pvalue_adj": "pvalue_adj", "pvalue Reference": "pvalue_reference", "pvalue Background": "pvalue_background",
    "pvalue_adj Reference": "pvalue_adj_reference", "Fraction Experiment": "fraction_experiment", "TPH Experiment": "tph_experiment", "Fraction background": "fraction_background",
    "TPH background": "tph_background", "TPH background subtracted": "tph_background_subtracted", "Nearest Refseq1": "refseq1", "Gene Name1": "gene1", "Direction1": "direction1", "Distance1": "distance1",
    "Nearest Refseq2": "refseq2", "Gene Name2": "gene2", "Direction2": "direction2", "Distance2": "distance2",
}

# Genome sizes for the false-discovery rate, half-widths of an insertion, widths of a bedgraph row.
GENOME = {"mm10": 2730871774, "hg38": 3137300923, "sacCer3": 12157105}
HALF_WIDTH = {"hg38": 3, "mm10": 3, "sacCer3": 0}
EDIT_HALF_WIDTH = {"hg38": 4, "mm10": 4, "sacCer3": 1}
BEDGRAPH_WIDTH = {"hg38": 4, "mm10": 4, "sacCer3": 1}
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI"]
CHROMOSOMES = [f"chr{k}" for k in [*range(1, 23), "X", "Y", *ROMAN]]


def adapt(df: DataFrame) -> DataFrame:
    """Canonical lower-case names for known spellings; other columns pass through."""
    return df.select(*[F.col(f"`{c}`").alias(SPELLINGS.get(c, c)) for c in df.columns])


def to_reference_names(df: DataFrame) -> DataFrame:
    back = {v: k for k, v in SPELLINGS.items()}
    return df.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns])


def chromosome_key(c):
    """Sort key of a chromosome: its number, or the code of its letter."""
    rest = F.substring(c, 4, 100)
    return F.when(rest.rlike("^[0-9]+$"), rest.cast("int")).otherwise(F.ascii(rest))
