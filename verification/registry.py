"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions import labels, measures, predicates, rules
from tenderlake.operators import merge, profile, ranking, windows
from tenderlake.plans import aggregates as A
from tenderlake.plans import checks as C
from tenderlake.plans import marts as M
from tenderlake.plans import reads as R
from tenderlake.plans.staging import stg_contracts
from tenderlake.session import compiled_methods, drop_folder, materialize, new_folder, shuffles_dropped
from tenderlake.sources import formats, lines
from tenderlake.sources import snapshots as S
from tenderlake.sources import tables as T
from tenderlake.sources.orders_view import as_text, contracts_from_orders
from tenderlake.streaming import incremental
from verification import derived as D

Query = Callable[[SparkSession, str], DataFrame]


_STAGED: dict[tuple[str, str], str] = {}


def fresh_staging(spark: SparkSession, folder: str) -> DataFrame:
    return stg_contracts(contracts_from_orders(spark, folder))


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """Staged contracts, derived from the tables once per session and kept as Parquet, so that each
    query scans the columns it needs and filters reach the files."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STAGED:
        path = new_folder(spark, "staging")
        with compiled_methods(spark), shuffles_dropped(spark):
            fresh_staging(spark, folder).write.option("compression", "zstd").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def once(spark: SparkSession, folder: str) -> DataFrame:
    """Staged contracts for a query that reads a few columns once or twice: from Parquet if this session
    has written it, else derived with no more than the columns the query takes."""
    stored = (spark.sparkContext.applicationId, folder) in _STAGED
    return staged(spark, folder) if stored else fresh_staging(spark, folder)


def kept_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """The contracts as derived, for a query that writes them more than once: joined once and kept."""
    path = new_folder(spark, "contracts")
    with compiled_methods(spark), shuffles_dropped(spark):
        contracts_from_orders(spark, folder).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _spine(spark: SparkSession, folder: str) -> DataFrame:
    return M.date_spine_of(spark.read.parquet(f"{folder}/orders.parquet"), "o_orderdate")


def _on_stg(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: build(staged(spark, folder))


def _once(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: build(once(spark, folder))


def _columns(**columns: Callable[[], Column]) -> Query:
    """Contract number with derived columns; a column can be made only once a session runs."""
    return _on_stg(
        lambda stg: stg.select("nu_contrato", *[make().alias(n) for n, make in columns.items()])
    )


TABLES: dict[str, Query] = {
    "stg_contracts": fresh_staging,
    "agg_by_agency": _on_stg(A.agg_by_agency),
    "agg_by_supplier": _on_stg(A.agg_by_supplier),
    "agg_by_modality": _on_stg(A.agg_by_modality),
    "agg_by_branch": _on_stg(A.agg_by_branch),
    "agg_by_process": _on_stg(A.agg_by_process),
    "agg_monthly_general": _on_stg(A.agg_monthly_general),
    "agg_monthly_agency": _on_stg(A.agg_monthly_agency),
    "agg_monthly_modality": _on_stg(A.agg_monthly_modality),
    "supplier_concentration_state": _on_stg(M.supplier_concentration_state),
    "supplier_concentration_agency": _on_stg(M.supplier_concentration_agency),
    "date_spine": _spine,
    "dim_dates": lambda spark, folder: M.dim_dates(_spine(spark, folder)),
    "dim_suppliers": _on_stg(M.dim_suppliers),
    "dim_agencies": _on_stg(M.dim_agencies),
    "dim_modalities": _on_stg(M.dim_modalities),
    "dim_branches": _on_stg(M.dim_branches),
    "fct_contracts": lambda spark, folder: M.fct_contracts(
        staged(spark, folder), M.dim_dates(_spine(spark, folder))
    ),
    "fct_amendments": _on_stg(M.fct_amendments),
    "fct_contracts_branch": _on_stg(M.fct_contracts_branch),
    "mart_supplier_concentration": _once(M.mart_supplier_concentration),
    "mart_temporal": _on_stg(M.mart_temporal),
    "mart_winner_diversity": _once(M.mart_winner_diversity),
    "mart_cost_escalation": _on_stg(M.mart_cost_escalation),
}


def _on(table: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: build(TABLES[table](spark, folder))


def _checks_of(tables: list[str], pick: Callable[[str, DataFrame], DataFrame]) -> Query:
    """The reports of all tables. Each is taken by itself, so that the shuffles of one table are gone
    when the next is built; a report has a row per rule."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        reports = [materialize(pick(name, TABLES[name](spark, folder)))[0] for name in tables]
        merged = reports[0]
        for report in reports[1:]:
            merged = merged.unionByName(report)
        return merged

    return run


def _not_null(name: str, df: DataFrame) -> DataFrame:
    return C.quality.check_not_null(df, name, C.NOT_NULL[name], C.NOT_NULL_WARN.get(name, ()))


NOT_NULL_TABLES = list(C.NOT_NULL)
ACCEPTED_TABLES = list(C.ACCEPTED)
UNIQUE_TABLES = list(C.UNIQUE)

FIRST_YEAR, SECOND_YEAR = 1997, 1999


def _sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Four publications of the same contracts: two archives by period, all of them, and the open
    ones; the highest precedence comes first."""
    stg = staged(spark, folder).select(
        "cod_unidade_gestora", "nu_contrato", "nm_unidade_gestora", "dt_assinatura", "ds_situacao",
        "vl_atual", "nm_fiscal",
    )
    year = F.year("dt_assinatura")
    return {
        "corrente": stg.where(F.col("ds_situacao") == "Em execução"),
        "arquivo_1": stg.where(year <= FIRST_YEAR).drop("nm_fiscal"),
        "arquivo_2": stg.where((year > FIRST_YEAR) & (year <= SECOND_YEAR)).drop("nm_fiscal"),
        "consolidado": stg,
    }


def _precedence(spark: SparkSession, folder: str) -> DataFrame:
    return merge.source_precedence_merge(_sources(spark, folder), ["cod_unidade_gestora", "nu_contrato"])


def _overlap(spark: SparkSession, folder: str) -> DataFrame:
    s = _sources(spark, folder)
    return merge.source_overlap(s["corrente"], s["arquivo_1"], ["cod_unidade_gestora", "nu_contrato"])


def _year_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_row_count_by_year(_sources(spark, folder), "dt_assinatura")


def _as_signed(stg: DataFrame) -> DataFrame:
    """The contracts as first published: no amendment yet and all of them running."""
    return stg.select(
        "cod_unidade_gestora", "nu_contrato",
        F.lit("Em execução").alias("ds_situacao"),
        F.col("vl_original").alias("vl_atual"),
        F.lit(None).cast("decimal(18,2)").alias("vl_aditado"),
        F.col("dt_fim").alias("dt_fim_atual"),
        F.col("dt_inicio").alias("dt_publicacao"),
    )


def _as_now(stg: DataFrame) -> DataFrame:
    return stg.select(
        "cod_unidade_gestora", "nu_contrato", "ds_situacao", "vl_atual", "vl_aditado", "dt_fim_atual",
        F.date_add("dt_inicio", 30).alias("dt_publicacao"),
    )


KEY = ["cod_unidade_gestora", "nu_contrato"]
TRACKED = ["ds_situacao", "vl_atual", "vl_aditado", "dt_fim_atual"]


def _merge_latest(stg: DataFrame) -> DataFrame:
    once = merge.merge_latest(_as_signed(stg), _as_now(stg), KEY, ["dt_publicacao"])
    return merge.merge_latest(once, _as_now(stg), KEY, ["dt_publicacao"])


def _history(stg: DataFrame) -> DataFrame:
    opened = merge.history_scd2(None, _as_signed(stg), KEY, TRACKED, "2002-01-01")
    return merge.history_scd2(opened, _as_now(stg), KEY, TRACKED, "2002-02-01")


def _shares_global(stg: DataFrame) -> DataFrame:
    base = A.agg_supplier_state(stg)
    return ranking.share_of_total_global(
        base, "perc_sobre_total_estado", "vl_total_fornecedor_estado"
    )


def _shares_partitioned(stg: DataFrame) -> DataFrame:
    base = A.agg_supplier_agency(stg)
    return ranking.share_of_total_partitioned(
        base, "perc_sobre_total_orgao", "vl_total_fornecedor_orgao", ["cod_unidade_gestora"]
    )


def _plain_slices(stg: DataFrame) -> DataFrame:
    return M.union_slices(stg)


def _lagged(stg: DataFrame) -> DataFrame:
    return windows.lag_year_guarded(
        A.agg_monthly_agency(stg), "vl_total_atual", ["cod_unidade_gestora", "mes_assinatura"],
        "vl_mesmo_mes_ano_anterior", "vl_variacao_ano_anterior", "perc_variacao_ano_anterior",
    ).select(
        "cod_unidade_gestora", "ano_assinatura", "mes_assinatura", "vl_mesmo_mes_ano_anterior",
        "vl_variacao_ano_anterior", "perc_variacao_ano_anterior",
    )


def _moving(stg: DataFrame) -> DataFrame:
    return windows.moving_avg_3y(
        A.agg_monthly_agency(stg), "vl_total_atual", ["cod_unidade_gestora", "mes_assinatura"],
        "vl_media_movel_3anos",
    ).select("cod_unidade_gestora", "ano_assinatura", "mes_assinatura", "vl_media_movel_3anos")


def _scanned(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    path = D.write_dirty_snapshot(spark, folder)
    header = S.read_header(spark, path)
    S.validate_header(header)
    return S.scan_contracts_csv(spark, path, header), header


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return S.classify_rows(*_scanned(spark, folder))


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    return _scan_result(_scanned(spark, folder)[0])


def _scan_in_pieces(spark: SparkSession, folder: str) -> DataFrame:
    path = D.write_dirty_snapshot(spark, folder)
    return _scan_result(lines.scan_by_line(spark, path, S.read_header(spark, path)))


def _scan_result(scanned: DataFrame) -> DataFrame:
    malformed = F.col("_bad").isNotNull()
    return scanned.select(
        F.when(~malformed, F.col("nucontrato")).alias("nu_contrato"),
        F.when(~malformed, F.col("objeto")).alias("ds_objeto"),
        malformed.alias("fl_malformada"),
    )


def _validate(spark: SparkSession, folder: str) -> DataFrame:
    """A superset header in upper case, and one that lacks the contract number.

    An archive goes once its rows are counted, so that one of them lies on disk at a time.
    """
    text = as_text(kept_contracts(spark, folder))
    outcomes = []
    for name, df in (("superset", text), ("sem_nucontrato", text.drop("nucontrato"))):
        path = new_folder(spark, "header")
        D.write_archive(df, path, ";", "UTF-8", D.EXTRA)
        header = S.read_header(spark, path)
        try:
            S.validate_header(header)
            missing = None
        except S.HeaderError as e:
            missing = str(e)
        rows = S.scan_contracts_csv(spark, path, header)
        outcome, _ = materialize(
            rows.agg(F.count(F.lit(1)).alias("qt_linhas")).select(
                F.lit(name).alias("cenario"), F.lit(missing).cast("string").alias("motivo"), "qt_linhas"
            )
        )
        drop_folder(spark, path)
        outcomes.append(outcome)
    return outcomes[0].unionByName(outcomes[1])


def _split(spark: SparkSession, folder: str) -> DataFrame:
    split = S.split_malformed(_scanned(spark, folder)[0])
    rows = split.select("source_file", F.col("_part").alias("parte"), F.length(F.coalesce("_bad", "nucontrato")))
    return rows.groupBy("parte").agg(F.count(F.lit(1)).alias("qt_linhas"))


CONTRACT_NUMBER = r"(\d+-\d+-\d+-\d+-[0-9.]+-\d{4}-\d{2}-\d{2})"


def _quarantined(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.quarantine_rows(_classified(spark, folder))
    return rows.select(
        "motivo", F.regexp_extract("linha_bruta", CONTRACT_NUMBER, 1).alias("nu_contrato")
    )


def _by_agency(contracts: DataFrame) -> DataFrame:
    stg = stg_contracts(contracts)
    return stg.groupBy("cod_unidade_gestora").agg(
        F.count(F.lit(1)).alias("qt_contratos"), F.sum("vl_atual").alias("vl_total_atual")
    )


def _promote(spark: SparkSession, folder: str) -> DataFrame:
    """A first snapshot of the open contracts, then one of all of them: the second is read."""
    base = new_folder(spark, "published")
    raw = kept_contracts(spark, folder)
    T.promote_snapshot(raw.where(F.col("situacao") == "Em execução"), base, "v1")
    T.promote_snapshot(raw, base, "v2")
    return _by_agency(T.read_current(spark, base))


def _ingest(spark: SparkSession, folder: str) -> DataFrame:
    base = new_folder(spark, "ingest")
    T.ingest_snapshot(spark, D.write_dirty_snapshot(spark, folder), base, "v1")
    return _by_agency(T.read_current(spark, f"{base}/contracts"))


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over one landed snapshot; the second finds nothing new."""
    base, landing = new_folder(spark, "incremental"), new_folder(spark, "landing")
    D.write_dirty_snapshot(spark, folder, f"{landing}/d1")

    def work(session: SparkSession, path: str, name: str) -> None:
        T.ingest_snapshot(session, path, base, name)

    runs = [
        incremental.incremental_file_trigger(spark, landing, f"{base}/checkpoint", work) for _ in range(2)
    ]
    return _by_agency(T.read_current(spark, f"{base}/contracts")).withColumns(
        {"qt_primeira": F.lit(runs[0]), "qt_segunda": F.lit(runs[1])}
    )


ARCHIVE_DROPPED = ["nmfiscal", "resumo"]


def _multi_format(spark: SparkSession, folder: str) -> DataFrame:
    """An older archive in another delimiter, encoding and column set, and a current file."""
    text = as_text(contracts_from_orders(spark, folder))
    old = F.col("dtinicio") < "1998"
    archive, current = new_folder(spark, "archive"), new_folder(spark, "current")
    D.write_archive(
        text.where(old).drop(*ARCHIVE_DROPPED), archive, ",", "ISO-8859-1", ["origem", "indice"]
    )
    D.write_archive(text.where(~old), current, ";", "UTF-8", D.EXTRA)
    known = [c for c in S.contract.RAW_COLUMNS if c not in ARCHIVE_DROPPED]
    merged = formats.multi_format_source(
        spark,
        {
            "corrente": (current, S.Format()),
            "arquivo": (archive, S.Format(sep=",", encoding="ISO-8859-1", known=known)),
        },
    )
    return merged.select(
        "fonte", F.col("nucontrato").alias("nu_contrato"), F.col("objeto").alias("ds_objeto"),
        F.col("nmmodalidade").alias("nm_modalidade"), F.col("nmfiscal").alias("nm_fiscal"),
        F.col("vloriginal").try_cast("decimal(18,2)").alias("vl_original"),
    )


def _write_marts(spark: SparkSession, folder: str) -> DataFrame:
    stg = staged(spark, folder)
    written = T.write_marts(
        {"mart_temporal": M.mart_temporal(stg), "mart_cost_escalation": M.mart_cost_escalation(stg)},
        new_folder(spark, "marts"),
        "v1",
    )
    return written["mart_temporal"]


def _merge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The first publication and the present state arrive one after the other as a stream."""
    stg = once(spark, folder)
    landing, base = new_folder(spark, "updates"), new_folder(spark, "merged")
    for df in (_as_signed(stg), _as_now(stg)):
        df.write.mode("append").option("compression", "zstd").parquet(landing)
        updates = spark.readStream.schema(df.schema).parquet(landing)
        incremental.merge_stream(updates, base, f"{base}/checkpoint", KEY, ["dt_publicacao"])
    return T.read_current(spark, base)


def _amended() -> Column:
    return F.coalesce(F.col("vl_aditado"), F.lit(0))

QUERIES: dict[str, Query] = {
    **TABLES,
    # Typing from the text form that a snapshot file has.
    "stg_contracts_from_text": lambda spark, folder: stg_contracts(
        as_text(contracts_from_orders(spark, folder))
    ),
    "flag_amendment_inconsistent": _columns(fl=lambda: predicates.amendment_inconsistent()),
    "flag_suspicious_value": _columns(fl=lambda: predicates.suspicious_value()),
    "filter_not_suspicious": _on_stg(
        lambda s: s.where(predicates.not_suspicious()).select("nu_contrato", "vl_original", "vl_atual")
    ),
    "filter_placeholder_process": _on_stg(
        lambda s: s.where(predicates.real_process()).select("nu_contrato", "nu_processo")
    ),
    "filter_amended": _on_stg(
        lambda s: s.where(predicates.amended()).select("nu_contrato", "vl_aditado", "dias_aditados")
    ),
    "filter_test_contracts": _on_stg(
        lambda s: s.where(predicates.not_test()).select("nu_contrato", "ds_objeto", "vl_original")
    ),
    "normalize_modality": _columns(nm_modalidade_norm=lambda: labels.normalize_modality("nm_modalidade")),
    "classify_branch_dim": _on_stg(
        lambda s: A.with_branch(s, rules.BRANCH_RULES).select("nu_contrato", "ramo_atividade")
    ),
    "classify_branch_fct": _on_stg(
        lambda s: A.with_branch(s, rules.FACT_BRANCH_RULES).select("nu_contrato", "ramo_atividade")
    ),
    "classify_supplier_size": _on_stg(
        lambda s: A.agg_by_supplier(s).select(
            "id_contratado", labels.supplier_size("vl_total_atual").alias("porte_fornecedor")
        )
    ),
    "classify_amendment_status": _columns(ds_situacao_aditivo=lambda: labels.amendment_status(_amended())),
    "classify_value_change": _columns(tp_variacao=lambda: labels.value_change("vl_variacao")),
    "classify_agency_volume": _on_stg(
        lambda s: A.agg_by_agency(s).select(
            "cod_unidade_gestora", "cod_gestao",
            labels.agency_volume("qt_contratos").alias("ds_perfil_contratacao"),
        )
    ),
    "classify_amendment_type": _columns(tp_aditivo=lambda: labels.amendment_type("vl_aditado", "dias_aditados")),
    "classify_amendment_direction": _columns(tp_variacao_valor=lambda: labels.amendment_direction("vl_variacao")),
    "classify_variation_band": _columns(
        faixa_variacao=lambda: labels.variation_band(measures.ratio_percent("vl_variacao", "vl_original"))
    ),
    "classify_term_change": _columns(
        ds_situacao_prazo=lambda: labels.term_change("dias_aditados"), fl_possui_aditivo=lambda: _amended() > 0
    ),
    "classify_diversity": _on_stg(
        lambda s: A.agg_by_process(s).select(
            "cod_unidade_gestora", "nu_processo",
            labels.diversity("qt_fornecedores_distintos").alias("ds_diversidade"),
        )
    ),
    "classify_supplier_id": _columns(tp_id=lambda: labels.classify_supplier_id("id_contratado")),
    "pct_change_measures": _columns(
        perc_alteracao_valor=lambda: measures.ratio_percent("vl_variacao", "vl_original"),
        perc_alteracao_prazo=lambda: measures.ratio_percent("dias_aditados", "dias_originais"),
        dias_variacao=lambda: F.col("dias_atuais") - F.col("dias_originais"),
    ),
    "agg_supplier_state": _on_stg(A.agg_supplier_state),
    "agg_supplier_agency": _on_stg(A.agg_supplier_agency),
    "mode_agg": _on_stg(lambda s: A.most_frequent(s, ["id_contratado"], "nm_contratado")),
    "running_total_year": _on_stg(A.monthly_general_with_running_total),
    "lag_year_guarded": _on_stg(_lagged),
    "moving_avg_3y": _on_stg(_moving),
    "rank_global": _on_stg(
        lambda s: ranking.rank_global(
            A.agg_supplier_state(s), "rank_estado", "vl_total_fornecedor_estado"
        )
    ),
    "rank_global_by_counting": _on_stg(
        lambda s: ranking.rank_global(
            A.agg_supplier_state(s), "rank_estado", "vl_total_fornecedor_estado", one_task_rows=0
        )
    ),
    "rank_partitioned": _on_stg(
        lambda s: ranking.rank_partitioned(
            A.agg_supplier_agency(s), "rank_no_orgao", "vl_total_fornecedor_orgao",
            ["cod_unidade_gestora"],
        )
    ),
    "rank_partitioned_by_counting": _once(
        lambda s: ranking.rank_partitioned(
            A.agg_supplier_agency(s), "rank_no_orgao", "vl_total_fornecedor_orgao",
            ["cod_unidade_gestora"], one_task_rows=0,
        )
    ),
    "share_of_total_global": _on_stg(_shares_global),
    "share_of_total_partitioned": _on_stg(_shares_partitioned),
    "union_slices": _on_stg(_plain_slices),
    "top_suppliers_state": _on("mart_supplier_concentration", R.top_suppliers_state),
    "top_suppliers_agency": _on(
        "mart_supplier_concentration", lambda m: R.top_suppliers_agency(m, "000003")
    ),
    "query_temporal": _on("mart_temporal", R.query_temporal),
    "query_temporal_filtered": _on(
        "mart_temporal", lambda m: R.query_temporal(m, agency="000003", first_year=1996, last_year=1999)
    ),
    "query_temporal_by_modality": _on(
        "mart_temporal", lambda m: R.query_temporal(m, modality="Pregão Eletrônico - Lei 10.520")
    ),
    "query_diversity": _on("mart_winner_diversity", R.query_diversity),
    "query_diversity_filtered": _on(
        "mart_winner_diversity", lambda m: R.query_diversity(m, agency="000003")
    ),
    "query_escalation": _on("mart_cost_escalation", R.query_escalation),
    "query_escalation_filtered": _on(
        "mart_cost_escalation",
        lambda m: R.query_escalation(m, "000003", "Pregão Eletrônico - Lei 10.520", 1998),
    ),
    "list_agencies": _on("dim_agencies", R.list_agencies),
    "list_modalities": _on("dim_modalities", R.list_modalities),
    "report_data_quality_by_agency": _on("mart_cost_escalation", R.report_data_quality_by_agency),
    "report_cost_change_by_modality": _on("mart_cost_escalation", R.report_cost_change_by_modality),
    "report_term_change_by_modality": _on("mart_cost_escalation", R.report_term_change_by_modality),
    "sort_cost_report": _on(
        "mart_cost_escalation", lambda m: R.sort_cost_report(R.report_cost_change_by_modality(m))
    ),
    "sort_term_report": _on(
        "mart_cost_escalation", lambda m: R.sort_term_report(R.report_term_change_by_modality(m))
    ),
    "chart_cost_escalation_by_year": _on("mart_cost_escalation", R.chart_cost_escalation_by_year),
    "chart_cost_escalation_exclusions": _on("mart_cost_escalation", R.chart_cost_escalation_exclusions),
    "chart_diversity_counts": _on("mart_winner_diversity", R.chart_diversity_counts),
    "chart_top10_share": _on("mart_supplier_concentration", R.chart_top10_share),
    "series_general": _on("mart_temporal", R.series_general),
    "check_not_null": _checks_of(NOT_NULL_TABLES, _not_null),
    "check_unique": _checks_of(
        UNIQUE_TABLES, lambda n, df: C.quality.check_unique(df, n, C.UNIQUE[n])
    ),
    "check_accepted_values": _checks_of(
        ACCEPTED_TABLES, lambda n, df: C.quality.check_accepted_values(df, n, C.ACCEPTED[n])
    ),
    "check_composite_unique": _on_stg(lambda s: C.check_composite_unique(s, A.agg_by_process(s))),
    "check_process_grain": _on_stg(lambda s: C.check_process_grain(s, A.agg_by_process(s))),
    "check_lag_gap": _on("mart_temporal", C.check_lag_gap),
    "check_slices_reconcile": _on("mart_temporal", C.check_slices_reconcile),
    "check_diversity_recompute": _on_stg(
        lambda s: C.check_diversity_recompute(M.mart_winner_diversity(s), s)
    ),
    "check_variation_formula": _on("mart_cost_escalation", C.check_variation_formula),
    "profile_percentiles": _on_stg(lambda s: profile.profile_percentiles(s, "vl_original")),
    "profile_outlier_counts": _once(
        lambda s: profile.profile_outlier_counts(s, value_limit=100_000)
    ),
    "profile_key_uniqueness": _on_stg(
        lambda s: profile.profile_key_uniqueness(
            s,
            {
                "nu_contrato": ["nu_contrato"],
                "nu_processo": ["nu_processo"],
                "id_contratado": ["id_contratado"],
                "cod_unidade_gestora+nu_contrato": ["cod_unidade_gestora", "nu_contrato"],
                "cod_unidade_gestora+nu_edital": ["cod_unidade_gestora", "nu_edital"],
            },
        )
    ),
    "profile_collisions": _on_stg(
        lambda s: profile.profile_collisions(s, "nu_edital", "cod_unidade_gestora")
    ),
    "profile_coverage": _on_stg(
        lambda s: profile.profile_coverage(
            s, ["dias_originais", "dias_aditados", "dias_atuais", "vl_aditado", "nm_modalidade"]
        )
    ),
    "profile_outlier_share": _on_stg(
        lambda s: profile.profile_outlier_share(s, "fl_valor_suspeito", "vl_original")
    ),
    "profile_row_count_by_year": _year_counts,
    "profile_name_drift": _on_stg(
        lambda s: profile.profile_name_drift(s, "cod_unidade_gestora", "nm_unidade_gestora")
    ),
    "distinct_pairs": _on_stg(
        lambda s: profile.distinct_pairs(s, "cod_unidade_gestora", "nm_unidade_gestora")
    ),
    "source_overlap": _overlap,
    "source_precedence_merge": _precedence,
    "merge_latest": _on_stg(_merge_latest),
    "history_scd2": _on_stg(_history),
    "scan_contracts_csv": _scan,
    "scan_contracts_csv_in_pieces": _scan_in_pieces,
    "validate_header": _validate,
    "project_known_columns": lambda spark, folder: stg_contracts(
        S.project_known_columns(
            S.split_malformed(_scanned(spark, folder)[0]).where(F.col("_part") == S.SOUND)
        )
    ),
    "split_malformed": _split,
    "repair_rows": lambda spark, folder: S.repair_rows(*_scanned(spark, folder)).select(
        F.col("nucontrato").alias("nu_contrato"), F.col("objeto").alias("ds_objeto"),
        F.col("diasatuais").try_cast("int").alias("dias_atuais"),
    ),
    "quarantine_rows": _quarantined,
    "ingest_summary": lambda spark, folder: S.ingest_summary(_classified(spark, folder)),
    "ingest_snapshot": _ingest,
    "promote_snapshot": _promote,
    "incremental_file_trigger": _incremental,
    "multi_format_source": _multi_format,
    "write_marts": _write_marts,
    "merge_latest_stream": _merge_stream,
}
