"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import alignment, capfilters, crossparse, fitplan, hardneg, logtree, mixture, packing, partenum, quality, secretscan, templates, transducer

QUERIES = {}
CHECKS = {}


def query(sql: str | None = None):
    """Register a query, and the SQL that gives its rows where there is one."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            CHECKS[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(quality.check_sql())
def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("d2")


@query()
def op2_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(table(spark, sf_dir, "pages"))


@query()
def op3_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "shard", "doc_ids", "starts", "cu_seqlens", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )


@query(capfilters.check_sql())
def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.linked(table(spark, sf_dir, "embeddings"))


@query(partenum.check_sql())
def op5_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.classes(table(spark, sf_dir, "documents"))


@query()
def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.digests(table(spark, sf_dir, "documents"))


@query()
def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.languages(table(spark, sf_dir, "documents"))


@query(mixture.check_sql())
def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"))


@query(logtree.check_sql())
def op9_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logtree.report(table(spark, sf_dir, "documents"))


@query()
def op10_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(table(spark, sf_dir, "documents"))


@query(hardneg.check_sql())
def op11_zone_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, label = F.col("vec_id"), F.col("label")
    moved = F.when(number % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.mine(hardneg.whole_vectors(table(spark, sf_dir, "embeddings"), moved, number % 100 == 0))


@query()
def op12_spill_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        table(spark, sf_dir, "documents"), groups=lambda c: F.when(c == "", "").otherwise(F.sha2(c, 256)),
    ).withColumnRenamed("groups", "groups_sha256")


@query()
def op13_fit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = fitplan.pack(table(spark, sf_dir, "documents"), ids=F.crc32).withColumnRenamed("ids", "ids_crc32")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
