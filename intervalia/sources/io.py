"""Readers and writers. Schemas are explicit: nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S


def read_qbed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.QBED).option("sep", "\t").csv(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.BED3).option("sep", "\t").csv(path)


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.GENES).option("sep", "\t").csv(path)


def read_barcodes(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """The first column, distinct."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.select(F.col(f"`{df.columns[0]}`").alias("barcode")).distinct()


def read_rna(spark: SparkSession, path: str) -> DataFrame:
    """gene, sample, value from a wide CSV whose first column is the gene."""
    df = spark.read.option("header", True).csv(path)
    first, *samples = df.columns
    return df.select(F.col(f"`{first}`").alias("gene"), *[F.col(f"`{c}`").cast("double").alias(c) for c in samples]).unpivot("gene", samples, "sample", "value")


def read_gnashy(spark: SparkSession, path: str) -> DataFrame:
    """Legacy tables of chromosome number, position and reads."""
    df = spark.read.schema(S.GNASHY).option("sep", "\t").csv(path)
    names = F.array(*[F.lit(f"chr{r}") for r in S.ROMAN])
    return df.select(F.element_at(names, F.col("number").cast("int")).alias("chr"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "reads")


def read_gwas(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("CHR_ID").alias("chr_id"), F.col("CHR_POS").cast("long").alias("chr_pos"), F.col("`DISEASE/TRAIT`").alias("trait"))


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    return df.select(F.col("`Motif Name`").alias("motif"), F.col("`P-value`").cast("double").alias("pvalue"), F.col("`q-value (Benjamini)`").cast("double").alias("qvalue"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chr string, start long, end long, value double").option("sep", "\t").csv(path)


def fasta_slice(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Bases start..end (from 1, inclusive) of a one-sequence FASTA file, without joining it on the driver: each line knows its place."""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", "^>[^\n]*\n", ""), "\\s", "")
    return whole.select(F.substring(body, start, end - start + 1).alias("sequence"))


def save_table(df: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated, in parallel parts."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


save_qbed = save_bed = save_table


def motif_bed(peaks: DataFrame) -> DataFrame:
    return peaks.select("chr", "start", "end", F.concat_ws("_", "chr", "start", "end").alias("id"))


def bedgraph(qbed: DataFrame, width: int = 4) -> DataFrame:
    """chr, start, end, count of each position."""
    return qbed.groupBy("chr", "start").agg(F.count(F.lit(1)).alias("count")).select("chr", "start", (F.col("start") + width).alias("end"), "count")


def browser_tracks(qbed: DataFrame, peaks: DataFrame | None, path: str, width: int = 4) -> dict[str, str]:
    """Writes the files that a genome browser session shows; uploading them is left to the user."""
    parts = {"insertions": qbed.orderBy("chr", "start"), "density": bedgraph(qbed, width).orderBy("chr", "start")} | ({"peaks": peaks.select("chr", "start", "end").orderBy("chr", "start")} if peaks is not None else {})
    for name, df in parts.items():
        save_table(df, f"{path}/{name}")
    return {name: f"{path}/{name}" for name in parts}


class ReferenceCatalog:
    """Named reference tables (sites, genes, gwas, chain, lengths) by genome: paths to Parquet, or DataFrames given by the user."""

    def __init__(self, spark: SparkSession, tables: dict[tuple[str, str], str | DataFrame]):
        self.spark, self.tables = spark, tables

    def get(self, kind: str, genome: str) -> DataFrame:
        if (kind, genome) not in self.tables:
            raise ValueError(f"no {kind} for {genome}; known: {sorted(self.tables)}")
        t = self.tables[kind, genome]
        return self.spark.read.parquet(t) if isinstance(t, str) else t


# The example data sets and their parts.
DATASETS = {
    "mousecortex": ["qbed", "barcodes", "RNA", "CC", "Mudata"],
    "SP1_K562HCT116": ["HCT116_brd4_qbed", "K562_brd4_qbed", "HCT116_SP1_qbed", "K562_SP1_qbed", "barcodes"],
    "mouse_brd4": ["Female_Brd4", "Male_Brd4", "RNA", "CC", "Female_Brd4_rep1", "Female_Brd4_rep2", "Male_Brd4_rep1", "Male_Brd4_rep2"],
    "SP1_Cre": ["SP1_P10", "SP1_P28", "background"],
}


class DatasetRegistry(ReferenceCatalog):
    """Example data sets by (name, part) under one folder that holds name/part; nothing is downloaded. Barcodes and RNA are CSV files, matrices Parquet tables, all else qbed files."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[tuple[str, str], str | DataFrame] | None = None):
        super().__init__(spark, tables or {})
        self.folder = folder.rstrip("/")

    def get(self, kind: str, genome: str) -> DataFrame:
        if (kind, genome) in self.tables:
            return super().get(kind, genome)
        if genome not in DATASETS.get(kind, []):
            raise ValueError(f"no part {genome} of {kind}; known: {DATASETS}")
        path = f"{self.folder}/{kind}/{genome}"
        if genome == "barcodes":
            return read_barcodes(self.spark, path, ",")
        if genome == "RNA" and kind != "mousecortex":
            return read_rna(self.spark, path)
        return self.spark.read.parquet(path) if genome in ("RNA", "CC", "Mudata") else read_qbed(self.spark, path)
