"""The checks of the published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake import contract
from tenderlake.functions import predicates, rules
from tenderlake.operators import quality

# The columns of each table that may not be null.
NOT_NULL: dict[str, list[str]] = {
    "stg_contracts": [
        "nu_contrato", "id_contratado", "nm_contratado", "cod_unidade_gestora",
        "nm_unidade_gestora", "dt_assinatura", "vl_original", "vl_atual", "ds_situacao",
        "ano_assinatura", "mes_assinatura",
    ],
    "agg_by_agency": ["cod_unidade_gestora", "nm_unidade_gestora", "qt_contratos"],
    "agg_by_supplier": ["id_contratado", "nm_contratado", "qt_contratos"],
    "agg_by_modality": ["nm_modalidade", "qt_contratos"],
    "agg_by_branch": ["ramo_atividade", "qt_contratos"],
    "agg_by_process": [
        "cod_unidade_gestora", "nu_processo", "qt_contratos", "qt_fornecedores_distintos",
    ],
    "agg_monthly_general": ["ano_assinatura", "mes_assinatura", "qt_contratos"],
    "agg_monthly_agency": [
        "ano_assinatura", "mes_assinatura", "cod_unidade_gestora", "qt_contratos",
    ],
    "agg_monthly_modality": ["ano_assinatura", "mes_assinatura", "qt_contratos"],
    "supplier_concentration_state": ["id_contratado", "vl_total_fornecedor_estado"],
    "supplier_concentration_agency": [
        "cod_unidade_gestora", "id_contratado", "vl_total_fornecedor_orgao",
    ],
    "date_spine": ["dt_data"],
    "dim_dates": ["dt_data", "ano", "mes"],
    "dim_agencies": ["cod_unidade_gestora", "nm_unidade_gestora", "qt_contratos"],
    "dim_suppliers": ["id_contratado", "nm_contratado", "qt_contratos"],
    "dim_modalities": ["nm_modalidade", "qt_contratos"],
    "dim_branches": ["ramo_atividade", "qt_contratos"],
    "fct_contracts": [
        "nu_contrato", "id_contratado", "cod_unidade_gestora", "dt_assinatura", "ano_assinatura",
        "vl_original", "vl_atual",
    ],
    "fct_amendments": ["nu_contrato", "id_contratado", "vl_original", "vl_atual"],
    "fct_contracts_branch": [
        "nu_contrato", "id_contratado", "nm_contratado", "cod_unidade_gestora", "ramo_atividade",
    ],
    "mart_supplier_concentration": [
        "cod_unidade_gestora", "id_contratado", "vl_total_fornecedor_orgao",
    ],
    "mart_temporal": ["tp_recorte", "ano_assinatura", "mes_assinatura", "qt_contratos"],
    "mart_winner_diversity": [
        "cod_unidade_gestora", "nu_processo", "qt_contratos", "qt_fornecedores_distintos",
    ],
    "mart_cost_escalation": ["cod_unidade_gestora", "nu_contrato", "id_contratado"],
}
# Columns whose nulls are reported as a warning only.
NOT_NULL_WARN = {"agg_by_modality": ["nm_modalidade"]}

# The keys of each table.
UNIQUE: dict[str, list[str]] = {
    "date_spine": ["dt_data"],
    "dim_dates": ["dt_data"],
    "dim_suppliers": ["id_contratado"],
    "dim_modalities": ["nm_modalidade"],
    "dim_branches": ["ramo_atividade"],
    "supplier_concentration_state": ["id_contratado"],
}

_CHANGE = ["Acréscimo", "Decréscimo", "Sem variação"]
# The labels each column may hold.
ACCEPTED: dict[str, dict[str, list[str]]] = {
    "fct_amendments": {
        "tp_aditivo": ["Valor e Prazo", "Somente Valor", "Somente Prazo", "Sem alteração"],
        "tp_variacao_valor": ["Acréscimo", "Supressão", "Sem variação de valor"],
    },
    "dim_suppliers": {"porte_fornecedor": ["Micro", "Pequeno", "Médio", "Grande"]},
    "fct_contracts": {"tp_variacao": _CHANGE},
    "mart_cost_escalation": {"tp_variacao": _CHANGE},
    "mart_winner_diversity": {"ds_diversidade": ["Fornecedor único", "Múltiplos fornecedores"]},
    "mart_temporal": {"tp_recorte": ["Geral", "Órgão", "Modalidade"]},
}


def check_table(name: str, df: DataFrame) -> DataFrame:
    """All declared checks of one table."""
    reports = []
    if name in NOT_NULL:
        reports.append(
            quality.check_not_null(df, name, NOT_NULL[name], NOT_NULL_WARN.get(name, ()))
        )
    if name in ACCEPTED:
        reports.append(quality.check_accepted_values(df, name, ACCEPTED[name]))
    if name in UNIQUE:
        reports.append(quality.check_unique(df, name, UNIQUE[name]))
    merged = reports[0]
    for report in reports[1:]:
        merged = merged.unionByName(report)
    return merged


def check_composite_unique(stg: DataFrame, processes: DataFrame) -> DataFrame:
    """Contract and process keys are unique."""
    return quality.check_unique(stg, "contracts", contract.CONTRACT_KEY).unionByName(
        quality.check_unique(processes, "processes", contract.PROCESS_KEY)
    )


def check_process_grain(stg: DataFrame, processes: DataFrame) -> DataFrame:
    """The process aggregate counts every contract that has a real process number, once."""
    eligible = stg.where(predicates.real_process()).select(F.count(F.lit(1)).alias("n"))
    grouped = processes.agg(F.coalesce(F.sum("qt_contratos"), F.lit(0)).alias("qt_agrupado"))
    both = grouped.withColumn("qt_elegiveis", eligible.scalar())
    return quality.report_rows(
        both.where(F.col("qt_elegiveis") != F.col("qt_agrupado")), "process_grain"
    )


def lag_gap_rows(mart: DataFrame) -> DataFrame:
    """Rows of the monthly mart whose change differs from a real join to the year before."""
    keys = ["tp_recorte", "cod_unidade_gestora", "nm_modalidade", "mes_assinatura"]
    earlier = mart.select(
        *[F.col(k).alias(f"p_{k}") for k in keys],
        (F.col("ano_assinatura") + 1).alias("p_ano"),
        F.col("vl_total_atual").alias("vl_ano_anterior_real"),
    )
    same = F.col("ano_assinatura") == F.col("p_ano")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    expected = F.col("vl_total_atual") - F.col("vl_ano_anterior_real")
    return mart.join(earlier, same, "left").where(
        ~F.col("vl_variacao_ano_anterior").eqNullSafe(expected)
    )


def check_lag_gap(mart: DataFrame) -> DataFrame:
    return quality.report_rows(lag_gap_rows(mart), "lag_gap")


def check_slices_reconcile(mart: DataFrame) -> DataFrame:
    """Months in which the agency or modality slices do not add up to the overall one."""

    def count_of(label: str):
        return F.sum(F.when(F.col("tp_recorte") == label, F.col("qt_contratos")))

    months = mart.groupBy("ano_assinatura", "mes_assinatura").agg(
        count_of(rules.SLICE_GENERAL).alias("general"),
        count_of(rules.SLICE_AGENCY).alias("agency"),
        count_of(rules.SLICE_MODALITY).alias("modality"),
    )
    return quality.report_rows(
        months.where(
            (F.col("general") != F.col("agency")) | (F.col("general") != F.col("modality"))
        ),
        "slices_reconcile",
    )


def check_diversity_recompute(mart: DataFrame, stg: DataFrame) -> DataFrame:
    """Processes whose counts differ from counts taken anew from the contracts."""
    again = (
        stg.where(predicates.real_process())
        .groupBy(*contract.PROCESS_KEY)
        .agg(
            F.count_distinct("id_contratado").alias("suppliers_again"),
            F.count(F.lit(1)).alias("contracts_again"),
        )
    )
    return quality.report_rows(
        mart.join(again, contract.PROCESS_KEY).where(
            (F.col("qt_fornecedores_distintos") != F.col("suppliers_again"))
            | (F.col("qt_contratos") != F.col("contracts_again"))
        ),
        "diversity_recompute",
    )


def check_variation_formula(mart: DataFrame) -> DataFrame:
    """Contracts whose change is not the current less the original value, nulls taken as zero."""

    def amount(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    return quality.report_rows(
        mart.where(amount("vl_variacao") != amount("vl_atual") - amount("vl_original")),
        "variation_formula",
    )
