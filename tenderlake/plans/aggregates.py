"""Aggregates of staged contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import labels, measures, predicates, rules
from tenderlake.operators import grouping as G
from tenderlake.operators import windows

_TOTALS = {
    "vl_total_original": G.total("vl_original"),
    "vl_total_atual": G.total("vl_atual"),
    "vl_total_aditado": G.total("vl_aditado"),
    "vl_total_variacao": G.total("vl_variacao"),
}
_SPREAD = {
    "vl_medio_contrato": G.mean("vl_original"),
    "vl_maior_contrato": G.largest("vl_atual"),
    "vl_menor_contrato": G.smallest("vl_atual"),
}
_DATES = {
    "dt_primeiro_contrato": G.smallest("dt_assinatura", zero_if_null=False),
    "dt_ultimo_contrato": G.largest("dt_assinatura", zero_if_null=False),
}


def _totals(*names: str) -> dict[str, G.Measure]:
    return {f"vl_total_{n}": _TOTALS[f"vl_total_{n}"] for n in names}


def agg_by_agency(stg: DataFrame) -> DataFrame:
    return G.summarize(
        stg,
        ["cod_unidade_gestora", "cod_gestao"],
        {"qt_contratos": G.rows(), **_TOTALS, **_SPREAD, **_DATES},
        distinct={"qt_fornecedores_distintos": "id_contratado"},
        modes={"nm_unidade_gestora": "nm_unidade_gestora", "nm_gestao": "nm_gestao"},
    )


def agg_by_supplier(stg: DataFrame) -> DataFrame:
    grouped = G.summarize(
        stg,
        ["id_contratado"],
        {
            "qt_contratos": G.rows(),
            **_TOTALS,
            **_SPREAD,
            **_DATES,
            "_vl_maior": G.largest("vl_atual", zero_if_null=False),
            "_vl_soma": G.total("vl_atual", zero_if_null=False),
        },
        distinct={
            "qt_orgaos_distintos": "cod_unidade_gestora",
            "qt_modalidades_distintas": "nm_modalidade",
        },
        modes={"nm_contratado": "nm_contratado"},
    )
    share = measures.ratio_percent("_vl_maior", "_vl_soma")
    return grouped.withColumn("perc_concentracao", F.coalesce(share, F.lit(0.0))).drop(
        "_vl_maior", "_vl_soma"
    )


def agg_by_modality(stg: DataFrame) -> DataFrame:
    grouped = G.summarize(
        stg.withColumn("nm_modalidade", labels.normalize_modality("nm_modalidade")),
        ["nm_modalidade"],
        {
            "qt_contratos": G.rows(),
            **_TOTALS,
            **_SPREAD,
            "_qt_com_aditivo": G.rows_where(predicates.is_true(F.col("vl_aditado") > 0)),
        },
        distinct={
            "qt_orgaos_distintos": "cod_unidade_gestora",
            "qt_fornecedores_distintos": "id_contratado",
        },
    )
    share = measures.ratio_percent("_qt_com_aditivo", "qt_contratos")
    return grouped.withColumn("perc_contratos_com_aditivo", F.coalesce(share, F.lit(0.0))).drop(
        "_qt_com_aditivo"
    )


def with_branch(stg: DataFrame, branch_rules: dict[str, list[str]]) -> DataFrame:
    """Add the branch of activity; the object text is lower-cased once per row."""
    return (
        stg.withColumn("_objeto", F.lower("ds_objeto"))
        .withColumn("ramo_atividade", labels.classify_branch("_objeto", branch_rules))
        .drop("_objeto")
    )


def agg_by_branch(stg: DataFrame) -> DataFrame:
    return G.summarize(
        with_branch(stg, rules.BRANCH_RULES),
        ["ramo_atividade"],
        {
            "qt_contratos": G.rows(),
            **_totals("original", "atual", "aditado"),
            "vl_medio_contrato": G.mean("vl_original"),
            "vl_maior_contrato": G.largest("vl_atual"),
        },
        distinct={"qt_fornecedores": "id_contratado", "qt_orgaos": "cod_unidade_gestora"},
    )


def agg_by_process(stg: DataFrame) -> DataFrame:
    return G.summarize(
        stg.where(predicates.real_process()),
        ["cod_unidade_gestora", "nu_processo"],
        {
            "qt_contratos": G.rows(),
            **_totals("original", "atual", "variacao"),
            **_DATES,
        },
        distinct={
            "qt_fornecedores_distintos": "id_contratado",
            "qt_modalidades_distintas": "nm_modalidade",
        },
        modes={"nm_unidade_gestora": "nm_unidade_gestora"},
    )


def _dated_and_plausible(stg: DataFrame) -> DataFrame:
    return stg.where(F.col("ano_assinatura").isNotNull() & predicates.not_suspicious())


def agg_monthly_general(stg: DataFrame) -> DataFrame:
    return G.summarize(
        _dated_and_plausible(stg),
        ["ano_assinatura", "mes_assinatura"],
        {
            "qt_contratos": G.rows(),
            **_TOTALS,
            "vl_medio_contrato": G.mean("vl_original"),
        },
        distinct={
            "qt_orgaos_distintos": "cod_unidade_gestora",
            "qt_fornecedores_distintos": "id_contratado",
            "qt_modalidades_distintas": "nm_modalidade",
        },
    )


def monthly_general_with_running_total(stg: DataFrame) -> DataFrame:
    return windows.running_total_year(
        agg_monthly_general(stg),
        {"qt_contratos_acumulado_ano": "qt_contratos", "vl_acumulado_ano": "vl_total_atual"},
    )


def agg_monthly_agency(stg: DataFrame) -> DataFrame:
    return G.summarize(
        _dated_and_plausible(stg),
        ["ano_assinatura", "mes_assinatura", "cod_unidade_gestora"],
        {"qt_contratos": G.rows(), **_totals("original", "atual", "variacao")},
        distinct={"qt_fornecedores_distintos": "id_contratado"},
        modes={"nm_unidade_gestora": "nm_unidade_gestora"},
    )


def agg_monthly_modality(stg: DataFrame) -> DataFrame:
    return G.summarize(
        _dated_and_plausible(stg),
        ["ano_assinatura", "mes_assinatura", "nm_modalidade"],
        {"qt_contratos": G.rows(), **_totals("original", "atual", "variacao")},
        distinct={"qt_orgaos_distintos": "cod_unidade_gestora"},
    )


def agg_supplier_state(stg: DataFrame) -> DataFrame:
    return (
        stg.where(predicates.not_suspicious())
        .groupBy("id_contratado")
        .agg(F.sum("vl_atual").alias("vl_total_fornecedor_estado"))
    )


def agg_supplier_agency(stg: DataFrame) -> DataFrame:
    return (
        stg.where(predicates.not_suspicious())
        .groupBy("cod_unidade_gestora", "id_contratado")
        .agg(F.sum("vl_atual").alias("vl_total_fornecedor_orgao"))
    )


def most_frequent(df: DataFrame, keys: list[str], column: str, weight: str | None = None) -> DataFrame:
    """Most frequent value of a column per group; the lowest on a tie, nulls ignored.

    ``weight`` counts a row that stands for several.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(n.alias("_n"))
    return counted.groupBy(*keys).agg(
        F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column)
    )
