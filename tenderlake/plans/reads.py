"""Queries that read the marts: filtered reads, top-N, reports and last aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import measures, predicates, rules

TOP_DEFAULT = 10


def _positive(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return limit


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    """The whole answer, unless the caller names a limit."""
    return df if limit is None else df.limit(_positive(limit))


def _ascending(*names: str):
    return [F.col(n).asc_nulls_last() for n in names]


def query_temporal(
    mart: DataFrame,
    agency: str | None = None,
    modality: str | None = None,
    first_year: int | None = None,
    last_year: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    wanted = predicates.equals_given(cod_unidade_gestora=agency, nm_modalidade=modality)
    if first_year is not None:
        wanted = wanted & (F.col("ano_assinatura") >= first_year)
    if last_year is not None:
        wanted = wanted & (F.col("ano_assinatura") <= last_year)
    order = _ascending(
        "tp_recorte", "ano_assinatura", "mes_assinatura", "cod_unidade_gestora", "nm_modalidade"
    )
    return _limited(mart.where(wanted).orderBy(*order), limit)


def query_diversity(
    mart: DataFrame, agency: str | None = None, limit: int | None = None
) -> DataFrame:
    wanted = mart.where(predicates.equals_given(cod_unidade_gestora=agency))
    return _limited(wanted.orderBy(*_ascending("cod_unidade_gestora", "nu_processo")), limit)


def query_escalation(
    mart: DataFrame,
    agency: str | None = None,
    modality: str | None = None,
    year: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    wanted = predicates.equals_given(
        cod_unidade_gestora=agency, nm_modalidade=modality, ano_assinatura=year
    )
    return _limited(mart.where(wanted).orderBy(*_ascending("cod_unidade_gestora", "nu_contrato")), limit)


def top_suppliers_agency(mart: DataFrame, agency: str, n: int = TOP_DEFAULT) -> DataFrame:
    return (
        mart.where(F.col("cod_unidade_gestora") == agency)
        .orderBy(*_ascending("rank_no_orgao", "id_contratado"))
        .limit(_positive(n))
    )


def top_suppliers_state(mart: DataFrame, n: int = TOP_DEFAULT) -> DataFrame:
    """The N best ranked suppliers overall, one row each: that of their first agency code.

    Ties share a rank, so the first N suppliers all have a rank of at most N and the rest can be
    left out before rows are compared.
    """
    one = Window.partitionBy("id_contratado").orderBy(
        *_ascending("rank_estado", "cod_unidade_gestora")
    )
    return (
        mart.where(F.col("rank_estado") <= _positive(n))
        .withColumn("_row", F.row_number().over(one))
        .where(F.col("_row") == 1)
        .drop("_row")
        .orderBy(*_ascending("rank_estado", "id_contratado"))
        .limit(n)
    )


def list_agencies(dim: DataFrame) -> DataFrame:
    return dim.orderBy(*_ascending("nm_unidade_gestora"))


def list_modalities(dim: DataFrame) -> DataFrame:
    return dim.orderBy(*_ascending("nm_modalidade"))


def report_data_quality_by_agency(mart: DataFrame) -> DataFrame:
    """How many contracts of each agency carry each flag; nothing is left out."""
    return (
        mart.groupBy("cod_unidade_gestora", "nm_unidade_gestora")
        .agg(
            F.count(F.lit(1)).alias("qt_contratos"),
            F.count_if("fl_aditivo_inconsistente").alias("qt_aditivo_inconsistente"),
            F.count_if("fl_valor_suspeito").alias("qt_valor_suspeito"),
        )
        .withColumns(
            {
                "perc_aditivo_inconsistente": measures.count_share(
                    "qt_aditivo_inconsistente", "qt_contratos"
                ),
                "perc_valor_suspeito": measures.count_share("qt_valor_suspeito", "qt_contratos"),
            }
        )
        .orderBy(F.col("qt_contratos").desc())
    )


def _sound(mart: DataFrame) -> DataFrame:
    return mart.where(
        predicates.not_suspicious("fl_valor_suspeito")
        & predicates.not_suspicious("fl_aditivo_inconsistente")
    )


def report_cost_change_by_modality(mart: DataFrame) -> DataFrame:
    """Mean percent change of contracts whose value changed, by common modality."""
    # Summed as decimals, so that the order in which partitions arrive does not matter.
    percent = F.col("perc_variacao").cast("decimal(28,10)")
    return (
        _sound(mart)
        .where(F.col("vl_variacao") != 0)
        .groupBy(F.col("nm_modalidade_norm").alias("nm_modalidade"))
        .agg(
            F.count(F.lit(1)).alias("qt_contratos_com_aditivo"),
            F.round(F.avg(percent), 2).alias("perc_variacao_media"),
        )
        .orderBy(F.col("qt_contratos_com_aditivo").desc())
    )


def report_term_change_by_modality(mart: DataFrame) -> DataFrame:
    """Mean change in days of contracts whose term changed, by common modality."""
    days = F.col("dias_variacao").cast("decimal(18,0)")
    return (
        _sound(mart)
        .where(F.col("dias_variacao") != 0)
        .groupBy(F.col("nm_modalidade_norm").alias("nm_modalidade"))
        .agg(
            F.count(F.lit(1)).alias("qt_contratos_com_aditivo_prazo"),
            F.round(
                F.sum(days).cast("decimal(20,0)") / F.count(days).cast("decimal(18,0)"), 1
            ).alias("dias_variacao_media"),
        )
        .orderBy(F.col("dias_variacao_media").desc())
    )


def sort_cost_report(report: DataFrame) -> DataFrame:
    return report.orderBy(F.col("perc_variacao_media").desc_nulls_last())


def sort_term_report(report: DataFrame) -> DataFrame:
    return report.orderBy(F.col("dias_variacao_media").desc_nulls_last())


def chart_cost_escalation_by_year(mart: DataFrame) -> DataFrame:
    """Total change of the sound contracts per signature year."""
    return (
        _sound(mart)
        .where(F.col("ano_assinatura").isNotNull())
        .groupBy("ano_assinatura")
        .agg(F.coalesce(F.sum("vl_variacao"), F.lit(0)).alias("vl_variacao_total"))
        .orderBy("ano_assinatura")
    )


def chart_cost_escalation_exclusions(mart: DataFrame) -> DataFrame:
    """How many contracts the chart above leaves out, and for which flag."""
    amended = predicates.is_true("fl_aditivo_inconsistente")
    suspicious = predicates.is_true("fl_valor_suspeito")
    return mart.agg(
        F.count(F.lit(1)).alias("qt_contratos"),
        F.count_if(amended | suspicious).alias("qt_excluidos"),
        F.count_if(amended).alias("qt_excluidos_aditivo"),
        F.count_if(suspicious).alias("qt_excluidos_valor"),
    )


def chart_diversity_counts(mart: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("ds_diversidade"), F.lit(rules.DIVERSITY_MISSING))
    return mart.groupBy(label.alias("ds_diversidade")).agg(F.count(F.lit(1)).alias("qt_processos"))


def chart_top10_share(mart: DataFrame, n: int = TOP_DEFAULT) -> DataFrame:
    """The largest supplier overall and the share that the top N hold together."""
    top = top_suppliers_state(mart, n)
    place = F.struct("rank_estado", "id_contratado")
    return top.agg(
        F.min_by("id_contratado", place).alias("id_contratado"),
        F.min_by("nm_contratado", place).alias("nm_contratado"),
        F.min_by("vl_total_fornecedor_estado", place).alias("vl_total_fornecedor_estado"),
        F.min_by("perc_sobre_total_estado", place).alias("perc_sobre_total_estado"),
        F.count(F.lit(1)).alias("qt_fornecedores"),
        F.sum(F.coalesce(F.col("perc_sobre_total_estado"), F.lit(0))).alias("perc_top"),
    )


def series_general(mart: DataFrame) -> DataFrame:
    """The overall monthly series with a year-month label."""
    return (
        mart.where(F.col("tp_recorte") == rules.SLICE_GENERAL)
        .select(
            "ano_assinatura",
            "mes_assinatura",
            F.concat_ws(
                "-", F.col("ano_assinatura").cast("string"),
                F.lpad(F.col("mes_assinatura").cast("string"), 2, "0"),
            ).alias("periodo"),
            "vl_total_atual",
        )
        .orderBy("ano_assinatura", "mes_assinatura")
    )
