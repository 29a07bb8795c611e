"""Calendar, dimensions, facts and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake import contract
from tenderlake.functions import labels, measures, predicates, rules
from tenderlake.operators import ranking, windows
from tenderlake.plans import aggregates as A
from tenderlake.session import SMALL_ROWS, broadcast_if_small, materialize


def date_spine(
    spark: SparkSession,
    start: str = contract.CALENDAR_START,
    end: str = contract.CALENDAR_END,
) -> DataFrame:
    """One row per day from start to end, both included."""
    return spark.range(1).select(
        F.explode(
            F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))
        ).alias("dt_data")
    )


def date_spine_of(df: DataFrame, column: str) -> DataFrame:
    """One row per day of the calendar years that the dates of a column fall in."""
    ends = df.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    return ends.select(
        F.explode(
            F.sequence(
                F.trunc("first", "YEAR").cast("date"),
                F.date_sub(F.add_months(F.trunc("last", "YEAR"), 12), 1),
                F.expr("interval 1 day"),
            )
        ).alias("dt_data")
    )


def dim_dates(spine: DataFrame) -> DataFrame:
    """Calendar columns of each day; weekdays count from Sunday = 0, weeks are ISO weeks."""
    day = F.col("dt_data")
    weekday = F.dayofweek(day) - 1
    quarter = F.quarter(day)
    return spine.select(
        day,
        F.year(day).alias("ano"),
        F.month(day).alias("mes"),
        F.dayofmonth(day).alias("dia"),
        quarter.alias("trimestre"),
        F.weekofyear(day).alias("semana_ano"),
        weekday.alias("dia_semana_num"),
        F.date_format(day, "MMMM").alias("nm_mes"),
        F.date_format(day, "MMM").alias("nm_mes_abrev"),
        F.date_format(day, "EEEE").alias("nm_dia_semana"),
        F.date_format(day, "yyyy-MM").alias("ano_mes"),
        F.concat(quarter, F.lit("º Tri")).alias("nm_trimestre"),
        F.concat(F.lit("Q"), quarter).alias("sigla_trimestre"),
        weekday.isin(0, 6).alias("fl_fim_de_semana"),
        F.trunc(day, "MM").alias("primeiro_dia_mes"),
        F.last_day(day).alias("ultimo_dia_mes"),
    )


_BOTH_RANKS = {"rank_por_valor": "vl_total_atual", "rank_por_quantidade": "qt_contratos"}


def _suppliers(stg: DataFrame) -> tuple[DataFrame, int]:
    base, rows = materialize(A.agg_by_supplier(stg))
    ranked = ranking.with_ranks(base, _BOTH_RANKS, rows=rows)
    return (
        ranked.withColumns(
            {
                "porte_fornecedor": labels.supplier_size("vl_total_atual"),
                "ds_situacao_aditivo": labels.amendment_status("vl_total_aditado"),
                "ds_variacao_valor": labels.total_change("vl_total_variacao"),
            }
        ),
        rows,
    )


def dim_suppliers(stg: DataFrame) -> DataFrame:
    return _suppliers(stg)[0]


def _agencies(stg: DataFrame) -> tuple[DataFrame, int]:
    base, rows = materialize(A.agg_by_agency(stg))
    ranked = ranking.with_ranks(base, _BOTH_RANKS, rows=rows)
    return (
        ranked.withColumns(
            {
                "ds_situacao_aditivo": labels.amendment_status("vl_total_aditado"),
                "ds_perfil_contratacao": labels.agency_volume("qt_contratos"),
            }
        ),
        rows,
    )


def dim_agencies(stg: DataFrame) -> DataFrame:
    return _agencies(stg)[0]


def dim_modalities(stg: DataFrame) -> DataFrame:
    base, rows = materialize(A.agg_by_modality(stg))
    ranked = ranking.with_ranks(base, _BOTH_RANKS, rows=rows)
    for name, value in (
        ("perc_sobre_total_qt", "qt_contratos"),
        ("perc_sobre_total_valor", "vl_total_atual"),
    ):
        ranked = ranking.share_of_total_global(ranked, name, value, measures.ratio_percent)
    return ranked


def dim_branches(stg: DataFrame) -> DataFrame:
    base, rows = materialize(A.agg_by_branch(stg))
    ranked = ranking.with_ranks(base, _BOTH_RANKS, rows=rows)
    ranked = ranking.share_of_total_global(
        ranked, "perc_sobre_total_qt", "qt_contratos", measures.count_share
    )
    return ranking.share_of_total_global(ranked, "perc_sobre_total_valor", "vl_total_atual")


_FACT_COLUMNS = [
    "nu_contrato", "id_contratado", "cod_unidade_gestora", "cod_gestao", "nm_modalidade",
    "nm_contratado", "nm_unidade_gestora", "nm_gestao", "ds_situacao", "de_tipo_contrato",
    "nm_regime_execucao", "nm_local_execucao", "ds_objeto", "dt_assinatura", "dt_inicio", "dt_fim",
    "dt_fim_atual", "ano_assinatura", "mes_assinatura", "dias_originais", "dias_aditados",
    "dias_atuais", "vl_original", "vl_atual", "vl_aditado", "vl_garantia", "vl_variacao",
]


def fct_contracts(stg: DataFrame, dates: DataFrame) -> DataFrame:
    """Contract fact with its measures and labels, joined to calendar, supplier and agency.

    A side is sent whole only when its counted rows are few; otherwise both sides are shuffled and
    AQE splits the partitions of hot suppliers or agencies. A null key finds no partner.
    """
    suppliers, supplier_rows = _suppliers(stg)
    agencies, agency_rows = _agencies(stg)
    suppliers = suppliers.select(
        "id_contratado",
        F.col("rank_por_valor").alias("rank_fornecedor_por_valor"),
        F.col("rank_por_quantidade").alias("rank_fornecedor_por_quantidade"),
        "porte_fornecedor",
        F.col("ds_situacao_aditivo").alias("ds_situacao_aditivo_fornecedor"),
        F.col("qt_contratos").alias("qt_total_contratos_fornecedor"),
    )
    agencies = agencies.select(
        *contract.AGENCY_KEY,
        F.col("rank_por_valor").alias("rank_orgao_por_valor"),
        F.col("rank_por_quantidade").alias("rank_orgao_por_quantidade"),
        "ds_perfil_contratacao",
    )
    dates = dates.select(
        F.col("dt_data").alias("dt_assinatura"), "nm_mes", "nm_trimestre", "sigla_trimestre",
        "primeiro_dia_mes", "ultimo_dia_mes",
    )
    amended = F.coalesce(F.col("vl_aditado"), F.lit(0)).cast("decimal(18,2)")
    facts = (
        stg.select(*_FACT_COLUMNS)
        .withColumn("vl_aditado", amended)
        .withColumns(
            {
                "tp_variacao": labels.value_change("vl_variacao"),
                "ds_situacao_aditivo": labels.amendment_status("vl_aditado"),
                "fl_possui_aditivo": F.col("vl_aditado") > 0,
                "ds_situacao_prazo": labels.term_change("dias_aditados"),
                "perc_variacao": measures.ratio_percent(
                    F.coalesce(F.col("vl_variacao"), F.lit(0)), "vl_original"
                ),
            }
        )
    )
    return (
        # A calendar of four centuries has fewer rows than the limit of a small side.
        facts.join(F.broadcast(dates), "dt_assinatura", "left")
        .join(broadcast_if_small(suppliers, supplier_rows), "id_contratado", "left")
        .join(broadcast_if_small(agencies, agency_rows), contract.AGENCY_KEY, "left")
    )


def fct_amendments(stg: DataFrame) -> DataFrame:
    percent = measures.ratio_percent("vl_variacao", "vl_original")
    return stg.where(predicates.amended()).select(
        "nu_contrato", "id_contratado", "cod_unidade_gestora", "cod_gestao", "nm_modalidade",
        "nm_contratado", "nm_unidade_gestora", "ds_situacao", "de_tipo_contrato", "dt_assinatura",
        "dt_inicio", "dt_fim", "dt_fim_atual", "ano_assinatura", "mes_assinatura", "vl_original",
        "vl_aditado", "vl_atual", "vl_variacao", "dias_originais", "dias_aditados", "dias_atuais",
        percent.alias("perc_alteracao_valor"),
        measures.ratio_percent("dias_aditados", "dias_originais").alias("perc_alteracao_prazo"),
        labels.amendment_type("vl_aditado", "dias_aditados").alias("tp_aditivo"),
        labels.amendment_direction("vl_variacao").alias("tp_variacao_valor"),
        labels.variation_band(percent).alias("faixa_variacao"),
    )


def fct_contracts_branch(stg: DataFrame, max_test_value: float = rules.TEST_MAX_VALUE) -> DataFrame:
    kept = stg.where(predicates.not_test(max_test_value=max_test_value))
    return A.with_branch(kept, rules.FACT_BRANCH_RULES).select(
        "nu_contrato", "id_contratado", "nm_contratado", "cod_unidade_gestora",
        "nm_unidade_gestora", "nm_modalidade", "ds_objeto", "dt_assinatura", "ano_assinatura",
        "vl_original", "vl_atual",
        F.coalesce(F.col("vl_aditado"), F.lit(0)).cast("decimal(18,2)").alias("vl_aditado"),
        "ds_situacao", "ramo_atividade",
    )


def _ranked_with_share(df, rows, value, rank, total, share, partition=None, one_task_rows=SMALL_ROWS):
    df = ranking.with_ranks(df, {rank: value}, partition, rows=rows, one_task_rows=one_task_rows)
    df = (
        ranking.with_partition_total(df, total, value, partition)
        if partition
        else ranking.with_total(df, total, value)
    )
    return df.withColumn(share, measures.money_share(value, total))


def supplier_concentration_state(stg: DataFrame) -> DataFrame:
    """Suppliers by total over all agencies, with rank and share of the whole."""
    base, rows = materialize(A.agg_supplier_state(stg))
    return _ranked_with_share(
        base, rows, "vl_total_fornecedor_estado", "rank_estado", "vl_total_estado",
        "perc_sobre_total_estado",
    )


def supplier_concentration_agency(stg: DataFrame) -> DataFrame:
    """Suppliers by total inside each agency, with rank and share of the agency."""
    base, rows = materialize(A.agg_supplier_agency(stg))
    return _ranked_with_share(
        base, rows, "vl_total_fornecedor_orgao", "rank_no_orgao", "vl_total_orgao",
        "perc_sobre_total_orgao", ["cod_unidade_gestora"],
    )


def mart_supplier_concentration(stg: DataFrame, one_task_rows: int = SMALL_ROWS) -> DataFrame:
    """One row per agency and supplier: totals, ranks and shares in the agency and overall.

    Contracts are read once, counted per agency, supplier and pair of names; totals and the most
    frequent names follow from those counts. Names count all contracts, totals leave out
    suspicious ones. An agency has one name here whatever the number of its management units.
    """
    plausible = predicates.not_suspicious()
    pairs = stg.groupBy(
        "cod_unidade_gestora", "id_contratado", "nm_unidade_gestora", "nm_contratado"
    ).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(plausible).alias("_n_plausible"),
        F.sum(F.when(plausible, F.col("vl_atual"))).alias("_vl"),
    )
    pairs, _ = materialize(pairs)
    totals = (
        pairs.where(F.col("_n_plausible") > 0)
        .groupBy("cod_unidade_gestora", "id_contratado")
        .agg(F.sum("_vl").cast("decimal(28,2)").alias("vl_total_fornecedor_orgao"))
    )
    in_agency, pair_rows = materialize(totals)
    state, supplier_rows = materialize(
        in_agency.groupBy("id_contratado").agg(
            F.sum("vl_total_fornecedor_orgao").cast("decimal(28,2)").alias("vl_total_fornecedor_estado")
        )
    )
    in_agency = _ranked_with_share(
        in_agency, pair_rows, "vl_total_fornecedor_orgao", "rank_no_orgao", "vl_total_orgao",
        "perc_sobre_total_orgao", ["cod_unidade_gestora"], one_task_rows,
    )
    state = _ranked_with_share(
        state, supplier_rows, "vl_total_fornecedor_estado", "rank_estado", "vl_total_estado",
        "perc_sobre_total_estado", None, one_task_rows,
    )
    supplier_names = A.most_frequent(pairs, ["id_contratado"], "nm_contratado", "_n")
    agency_names = A.most_frequent(pairs, ["cod_unidade_gestora"], "nm_unidade_gestora", "_n")
    # The state side and the names have one row per supplier, so they meet before the larger side.
    suppliers = state.join(supplier_names, "id_contratado", "left")
    return in_agency.join(suppliers, "id_contratado", "left").join(
        agency_names, "cod_unidade_gestora", "left"
    ).select(
        "cod_unidade_gestora", "nm_unidade_gestora", "id_contratado", "nm_contratado",
        "vl_total_fornecedor_orgao", "vl_total_orgao", "rank_no_orgao", "perc_sobre_total_orgao",
        "vl_total_fornecedor_estado", "vl_total_estado", "rank_estado", "perc_sobre_total_estado",
    )


_SLICE_KEYS = ["tp_recorte", "cod_unidade_gestora", "nm_modalidade"]
_SLICE_TOTALS = ["vl_total_original", "vl_total_atual", "vl_total_variacao"]


def union_slices(stg: DataFrame) -> DataFrame:
    """Monthly totals overall, per agency and per modality, one under the other.

    Contracts are read and shuffled once, at the finest grain; the three slices are sums of it.
    A slice leaves the columns of the others null, and only the overall one has running totals.
    """
    text = "string"
    fine = (
        stg.where(F.col("ano_assinatura").isNotNull() & predicates.not_suspicious())
        .groupBy(
            "ano_assinatura", "mes_assinatura", "cod_unidade_gestora", "nm_unidade_gestora",
            "nm_modalidade",
        )
        .agg(
            F.count(F.lit(1)).alias("qt_contratos"),
            F.sum("vl_original").alias("vl_total_original"),
            F.sum("vl_atual").alias("vl_total_atual"),
            F.sum("vl_variacao").alias("vl_total_variacao"),
        )
    )

    def member(label: str, agency: bool = False, modality: bool = False):
        def only(name: str, wanted: bool):
            return (F.col(name) if wanted else F.lit(None).cast(text)).alias(f"slice_{name}")

        return F.struct(
            F.lit(label).alias("tp_recorte"),
            only("cod_unidade_gestora", agency),
            only("nm_unidade_gestora", agency),
            only("nm_modalidade", modality),
        )

    sliced = fine.withColumn(
        "slice",
        F.explode(
            F.array(
                member(rules.SLICE_GENERAL),
                member(rules.SLICE_AGENCY, agency=True),
                member(rules.SLICE_MODALITY, modality=True),
            )
        ),
    ).select(
        "slice.tp_recorte",
        "ano_assinatura",
        "mes_assinatura",
        F.col("slice.slice_cod_unidade_gestora").alias("cod_unidade_gestora"),
        F.col("slice.slice_nm_unidade_gestora").alias("nm_unidade_gestora"),
        F.col("slice.slice_nm_modalidade").alias("nm_modalidade"),
        "qt_contratos",
        *_SLICE_TOTALS,
    )
    keys = ["tp_recorte", "ano_assinatura", "mes_assinatura", "cod_unidade_gestora", "nm_modalidade"]
    sums = [F.sum(c).alias(c) for c in ("qt_contratos", *_SLICE_TOTALS)]
    name_order = F.when(
        F.col("nm_unidade_gestora").isNotNull(),
        F.struct(-F.col("qt_contratos"), F.col("nm_unidade_gestora")),
    )
    monthly = (
        sliced.groupBy(*keys, "nm_unidade_gestora")
        .agg(*sums)
        .groupBy(*keys)
        .agg(*sums, F.min_by("nm_unidade_gestora", name_order).alias("nm_unidade_gestora"))
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,2)") for c in _SLICE_TOTALS})
    )
    within_year = Window.partitionBy(*_SLICE_KEYS, "ano_assinatura").orderBy("mes_assinatura")
    overall = F.col("tp_recorte") == rules.SLICE_GENERAL
    return monthly.withColumns(
        {
            "qt_contratos_acumulado_ano": F.when(overall, F.sum("qt_contratos").over(within_year)),
            "vl_acumulado_ano": F.when(overall, F.sum("vl_total_atual").over(within_year)),
        }
    )


def mart_temporal(stg: DataFrame) -> DataFrame:
    """The monthly slices with guarded change to the year before and a three-year moving mean."""
    series = [*_SLICE_KEYS, "mes_assinatura"]
    with_change = windows.lag_year_guarded(
        union_slices(stg),
        "vl_total_atual",
        series,
        "vl_mesmo_mes_ano_anterior",
        "vl_variacao_ano_anterior",
        "perc_variacao_ano_anterior",
    )
    return windows.moving_avg_3y(with_change, "vl_total_atual", series, "vl_media_movel_3anos").select(
        "tp_recorte", "ano_assinatura", "mes_assinatura", "cod_unidade_gestora",
        "nm_unidade_gestora", "nm_modalidade", "qt_contratos", *_SLICE_TOTALS,
        "qt_contratos_acumulado_ano", "vl_acumulado_ano", "vl_mesmo_mes_ano_anterior",
        "vl_variacao_ano_anterior", "perc_variacao_ano_anterior", "vl_media_movel_3anos",
    )


def mart_winner_diversity(stg: DataFrame, one_task_rows: int = SMALL_ROWS) -> DataFrame:
    """Processes by the number of suppliers that won in them."""
    base, rows = materialize(A.agg_by_process(stg))
    return ranking.with_ranks(
        base.withColumn("ds_diversidade", labels.diversity("qt_fornecedores_distintos")),
        {"rank_por_diversidade": "qt_fornecedores_distintos"},
        rows=rows,
        one_task_rows=one_task_rows,
    )


def mart_cost_escalation(stg: DataFrame) -> DataFrame:
    """Contract grain: change of value and term; the flags are context, no row is left out."""
    return stg.select(
        "cod_unidade_gestora", "nu_contrato", "nm_unidade_gestora", "nm_modalidade",
        labels.normalize_modality("nm_modalidade").alias("nm_modalidade_norm"),
        "ano_assinatura", "mes_assinatura", "dt_assinatura", "id_contratado", "nm_contratado",
        "vl_original", "vl_atual", "vl_variacao",
        measures.ratio_percent(F.coalesce(F.col("vl_variacao"), F.lit(0)), "vl_original").alias(
            "perc_variacao"
        ),
        "dias_originais", "dias_atuais",
        (F.col("dias_atuais") - F.col("dias_originais")).alias("dias_variacao"),
        labels.value_change("vl_variacao").alias("tp_variacao"),
        "fl_aditivo_inconsistente", "fl_valor_suspeito",
    )
