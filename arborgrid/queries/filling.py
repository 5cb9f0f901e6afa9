"""Problem 1: missing alleles, subpopulations and traits."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.operators import filling
from arborgrid.registry import query
from arborgrid.tables import read


def _fills(spark, folder):
    return filling.fill_project(*[read(spark, folder, t) for t in ("ift_snps", "ift_indiv", "ift_pheno", "subpops")])


@query("p1_fills")
def p1_fills(spark, folder):
    """Every filled cell with its value."""
    return _fills(spark, folder).withColumn("value_number", F.round("value_number", 6)).withColumn("share", F.round("share", 6))


@query(
    "p1_found",
    """
    WITH i AS (SELECT indiv_id, any_value(subpop) AS subpop, any_value(traitvalue) AS traitvalue FROM ift_indiv GROUP BY indiv_id)
    SELECT DISTINCT 'ift_snps' AS tbl, call_id AS row_id, 'allele' AS field, CAST(0 AS INT) AS item FROM ift_snps
    WHERE allele IS NULL OR NOT regexp_full_match(allele, '\\s*[0-3]\\s*')
    UNION ALL
    SELECT 'ift_indiv', indiv_id, 'subpop', 0 FROM i WHERE coalesce(upper(trim(subpop)), '') NOT IN (SELECT upper(subpop) FROM subpops)
    UNION ALL
    SELECT 'ift_indiv', indiv_id, 'traitvalue', trait_no FROM i, ift_pheno
    WHERE traitvalue[trait_no] IS NULL OR isnan(traitvalue[trait_no]) OR NOT (CAST(traitvalue[trait_no] AS DOUBLE) BETWEEN min_value AND max_value)
    """.replace("\\\\", "\\"),
)
def p1_found(spark, folder):
    """The cells that were missing and have come out filled by propagation."""
    return _fills(spark, folder).where("how = 'propagated'").select("tbl", "row_id", "field", "item")


@query("p1_snps")
def p1_snps(spark, folder):
    """ift_snps with every allele, and whether it was filled."""
    fills = _fills(spark, folder).where("field = 'allele'").select(F.col("row_id").alias("call_id"), F.col("value_text").alias("_fill"))
    rows = read(spark, folder, "ift_snps").join(fills, "call_id", "left")
    allele = F.coalesce(filling.allele_code(F.col("allele")).cast("string"), "_fill")
    return rows.withColumn("allele_filled", F.col("_fill").isNotNull()).withColumn("allele", allele).drop("_fill")


@query("p1_indiv")
def p1_indiv(spark, folder):
    """Individuals with every subpopulation and trait, and which of them were filled."""
    fills = _fills(spark, folder).where("tbl = 'ift_indiv'")
    traits = fills.where("field = 'traitvalue'").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("item", "value_number"))).alias("_t"))
    pops = fills.where("field = 'subpop'").select("row_id", F.col("value_text").alias("_s"))
    rows = filling.latest_individuals(read(spark, folder, "ift_indiv")).withColumnRenamed("indiv_id", "row_id")
    n = read(spark, folder, "ift_pheno").agg(F.max("trait_no")).first()[0]
    joined = rows.join(traits, "row_id", "left").join(pops, "row_id", "left")
    numbers = F.sequence(F.lit(1), F.lit(n))
    filled = F.transform(numbers, lambda k: F.coalesce(F.try_element_at("_t", k), F.get("traitvalue", k - 1).cast("double")))
    return joined.select(
        F.col("row_id").alias("indiv_id"), "lineid", F.coalesce("_s", F.upper(F.trim("subpop"))).alias("subpop"), filled.alias("traitvalue"), F.col("_s").isNotNull().alias("subpop_filled"),
        F.coalesce(F.array_sort(F.map_keys("_t")), F.array().cast("array<int>")).alias("traits_filled"), "label", "pos", "trial", "measured_at", "loaded_at",
    )
