"""The driver's tables seen as genomic ones, in text that Spark and DuckDB both run (FIXTURES.md, section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = {
    "ins": """SELECT concat('chr', CAST(l_suppkey % 19 + 1 AS STRING)) AS chr,
       ((l_partkey * l_suppkey) % 720) * 5000 + 1000 + l_linenumber * 50 + CAST(floor(l_quantity) AS BIGINT) AS start,
       ((l_partkey * l_suppkey) % 720) * 5000 + 1004 + l_linenumber * 50 + CAST(floor(l_quantity) AS BIGINT) AS end_,
       CAST(l_linenumber AS BIGINT) AS reads, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS direction,
       concat('c', CAST(l_orderkey % 40 AS STRING)) AS barcode, l_returnflag AS grp FROM lineitem""",
    "bg": """SELECT concat('chr', CAST(o_custkey % 19 + 1 AS STRING)) AS chr, ((o_custkey * 7 + o_orderkey) % 720) * 5000 + 1000 + (o_orderkey % 40) * 10 AS start FROM orders""",
    "sites": """SELECT c.chr, p.start FROM (SELECT DISTINCT concat('chr', CAST(l_suppkey % 19 + 1 AS STRING)) AS chr FROM lineitem) c CROSS JOIN
       (SELECT DISTINCT (p_partkey % 1000) * 3600 + k.k * 300 AS start FROM part CROSS JOIN (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS k FROM lineitem) k) p""",
    "genes": """SELECT concat('chr', CAST(p_partkey % 19 + 1 AS STRING)) AS chr, (p_partkey * 37 % 720) * 5000 + 2500 AS start, (p_partkey * 37 % 720) * 5000 + 2500 + p_size * 60 AS end_,
       concat('NM_', CAST(p_partkey AS STRING)) AS refseq, concat('GENE', CAST(p_partkey % 1500 AS STRING)) AS gene, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part""",
    "gwas": """SELECT CAST(c_custkey % 19 + 1 AS STRING) AS chr_id, (c_custkey * 53 % 720) * 5000 + 1100 + c_nationkey * 10 AS chr_pos, c_mktsegment AS trait FROM customer""",
    "obs": """SELECT DISTINCT concat('c', CAST(l_orderkey % 40 AS STRING)) AS barcode, concat('k', CAST(l_orderkey % 40 % 5 AS STRING)) AS cluster FROM lineitem""",
    "chain": """SELECT concat('chr', CAST(s AS STRING)) AS src_chr, b * 20000 AS src_start, b * 20000 + 15000 AS src_end, concat('chr', CAST((s + b) % 19 + 1 AS STRING)) AS dst_chr,
       b * 21000 + 7 AS dst_start, CASE WHEN b % 3 = 0 THEN '-' ELSE '+' END AS strand
       FROM (SELECT DISTINCT l_suppkey % 19 + 1 AS s FROM lineitem) x CROSS JOIN (SELECT DISTINCT p_partkey % 180 AS b FROM part) y""",
    "rna": """SELECT concat('k', CAST(p_partkey % 5 AS STRING)) AS grp, concat('GENE', CAST(p_partkey % 1500 AS STRING)) AS gene, CAST(min(p_size) AS DOUBLE) / 1000 AS pvalue, CAST(min(p_size) AS DOUBLE) / 500 AS pvalue_adj,
       CAST(max(p_size) - 25 AS DOUBLE) AS score, CAST(sum(p_size) AS DOUBLE) AS value FROM part GROUP BY p_partkey % 5, p_partkey % 1500""",
    "signal": """SELECT concat('chr', CAST(o_custkey % 19 + 1 AS STRING)) AS chr, b * 1000 AS start, b * 1000 + 1000 AS end_, CAST(count(*) AS DOUBLE) AS value
       FROM (SELECT o_custkey, (o_custkey * 7 + o_orderkey) % 3600 AS b FROM orders) x GROUP BY o_custkey % 19 + 1, b""",
}
TABLES = {"ins": ["lineitem"], "bg": ["orders"], "sites": ["lineitem", "part"], "genes": ["part"], "gwas": ["customer"], "obs": ["lineitem"], "chain": ["lineitem", "part"], "rna": ["part"], "signal": ["orders"]}

#: WITH clause of the oracle.
CTES = ",\n".join(f"{k} AS ({v})" for k, v in PARTS.items())


class Fixtures:
    """The views over one directory, with end_ named end."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in PARTS:
            raise AttributeError(name)
        text = PARTS[name]
        for t in TABLES[name]:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        df = self.spark.sql(text, **{t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in TABLES[name]})
        return df.withColumnRenamed("end_", "end").withColumnRenamed("grp", "group")
