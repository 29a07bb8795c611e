"""The SQL of every registered query, by the query's name."""

from __future__ import annotations

from tenderlake.functions import rules
from tenderlake.plans import checks as declared
from verification import derived as D
from verification import oracle as O
from verification.oracle import lit, whole, _with
from verification.registry import (
    ACCEPTED_TABLES,
    FIRST_YEAR,
    NOT_NULL_TABLES,
    SECOND_YEAR,
    TABLES,
    UNIQUE_TABLES,
)

_STG = "stg"


def _rows(columns: str, source: str = _STG, where: str = "") -> str:
    return _with(f"select {columns} from {source}" + (f" where {where}" if where else ""))


def _label(name: str, expression: str) -> str:
    return _rows(f"nu_contrato, {expression} as {name}")


def _reports(tables: list[str], kind: str) -> str:
    parts = [p for t in tables for p in O.declared_checks(t) if p[0].startswith(kind)]
    return _with(O.rule_report(parts))


_report_cost = f"""select nm_modalidade_norm as nm_modalidade, count(*) as qt_contratos_com_aditivo,
    cast(round(avg(perc_variacao), 2) as decimal(18,2)) as perc_variacao_media
    from sound_marts where vl_variacao <> 0 group by 1"""
_report_term = f"""select nm_modalidade_norm as nm_modalidade, count(*) as qt_contratos_com_aditivo_prazo,
    {O._divide('(cast(sum(dias_variacao) as hugeint) * 10)', 'cast(count(*) as hugeint)', 1)} as dias_variacao_media
    from sound_marts where dias_variacao <> 0 group by 1"""

_sources = f"""
  (select 0 as p, 'corrente' as fonte, cod_unidade_gestora, nu_contrato, nm_unidade_gestora,
     dt_assinatura, ds_situacao, vl_atual, nm_fiscal from stg where ds_situacao = 'Em execução'
   union all select 1, 'arquivo_1', cod_unidade_gestora, nu_contrato, nm_unidade_gestora,
     dt_assinatura, ds_situacao, vl_atual, null from stg where year(dt_assinatura) <= {FIRST_YEAR}
   union all select 2, 'arquivo_2', cod_unidade_gestora, nu_contrato, nm_unidade_gestora,
     dt_assinatura, ds_situacao, vl_atual, null from stg
     where year(dt_assinatura) > {FIRST_YEAR} and year(dt_assinatura) <= {SECOND_YEAR}
   union all select 3, 'consolidado', cod_unidade_gestora, nu_contrato, nm_unidade_gestora,
     dt_assinatura, ds_situacao, vl_atual, nm_fiscal from stg)"""

_lag_keys = "partition by cod_unidade_gestora, mes_assinatura order by ano_assinatura"

_checks_rows = {
    "check_composite_unique": [
        O.unique("contracts", "stg", ["cod_unidade_gestora", "nu_contrato"]),
        O.unique("processes", "agg_by_process", ["cod_unidade_gestora", "nu_processo"]),
    ],
    "check_process_grain": [
        (
            "process_grain",
            """(select count(*) from (select (select count(*) from eligible) as a,
               (select coalesce(sum(qt_contratos), 0) from agg_by_process) as b) where a <> b)""",
            "erro",
        )
    ],
    "check_lag_gap": [
        (
            "lag_gap",
            """(select count(*) from mart_temporal b left join mart_temporal p
               on b.tp_recorte = p.tp_recorte
               and b.cod_unidade_gestora is not distinct from p.cod_unidade_gestora
               and b.nm_modalidade is not distinct from p.nm_modalidade
               and b.mes_assinatura = p.mes_assinatura and p.ano_assinatura = b.ano_assinatura - 1
               where b.vl_variacao_ano_anterior is distinct from b.vl_total_atual - p.vl_total_atual)""",
            "erro",
        )
    ],
    "check_slices_reconcile": [
        (
            "slices_reconcile",
            """(select count(*) from (select ano_assinatura, mes_assinatura,
                 sum(qt_contratos) filter (where tp_recorte = 'Geral') as g,
                 sum(qt_contratos) filter (where tp_recorte = 'Órgão') as o,
                 sum(qt_contratos) filter (where tp_recorte = 'Modalidade') as m
               from mart_temporal group by 1, 2) where g <> o or g <> m)""",
            "erro",
        )
    ],
    "check_diversity_recompute": [
        (
            "diversity_recompute",
            """(select count(*) from mart_winner_diversity m join (
                 select cod_unidade_gestora, nu_processo, count(distinct id_contratado) as f, count(*) as c
                 from eligible group by 1, 2) r using (cod_unidade_gestora, nu_processo)
               where m.qt_fornecedores_distintos <> r.f or m.qt_contratos <> r.c)""",
            "erro",
        )
    ],
    "check_variation_formula": [
        (
            "variation_formula",
            """(select count(*) from mart_cost_escalation where coalesce(vl_variacao, 0)
               <> coalesce(vl_atual, 0) - coalesce(vl_original, 0))""",
            "erro",
        )
    ],
}

_keys = {
    "nu_contrato": "nu_contrato",
    "nu_processo": "nu_processo",
    "id_contratado": "id_contratado",
    "cod_unidade_gestora+nu_contrato": "cod_unidade_gestora, nu_contrato",
    "cod_unidade_gestora+nu_edital": "cod_unidade_gestora, nu_edital",
}

ORACLE: dict[str, str] = {
    **{name: whole(name) for name in TABLES if name != "stg_contracts"},
    "stg_contracts": whole("stg"),
    "stg_contracts_from_text": whole("stg"),
    "flag_amendment_inconsistent": _label("fl", "fl_aditivo_inconsistente"),
    "flag_suspicious_value": _label("fl", "fl_valor_suspeito"),
    "filter_not_suspicious": _rows("nu_contrato, vl_original, vl_atual", "sound"),
    "filter_placeholder_process": _rows(
        "nu_contrato, nu_processo",
        where="""not (nu_processo is null or trim(nu_processo) = ''
          or regexp_replace(nu_processo, '[^0-9]', '', 'g') = ''
          or replace(regexp_replace(nu_processo, '[^0-9]', '', 'g'), '0', '') = '')""",
    ),
    "filter_amended": _rows(
        "nu_contrato, vl_aditado, dias_aditados", where="vl_aditado > 0 or dias_aditados > 0"
    ),
    "filter_test_contracts": _rows("nu_contrato, ds_objeto, vl_original", "fct_contracts_branch"),
    "normalize_modality": _label("nm_modalidade_norm", O.normalized()),
    "classify_branch_dim": _label("ramo_atividade", O.branch(rules.BRANCH_RULES)),
    "classify_branch_fct": _label("ramo_atividade", O.branch(rules.FACT_BRANCH_RULES)),
    "classify_supplier_size": _rows("id_contratado, porte_fornecedor", "dim_suppliers"),
    "classify_amendment_status": _label(
        "ds_situacao_aditivo", O.sign_label("coalesce(vl_aditado, 0)", rules.AMENDMENT_STATUS)
    ),
    "classify_value_change": _label(
        "tp_variacao", f"coalesce({O.sign_label('vl_variacao', rules.VALUE_CHANGE)}, 'Sem variação')"
    ),
    "classify_agency_volume": _rows(
        "cod_unidade_gestora, cod_gestao, ds_perfil_contratacao", "dim_agencies"
    ),
    "classify_amendment_type": _label(
        "tp_aditivo",
        """case when vl_aditado > 0 and dias_aditados > 0 then 'Valor e Prazo'
           when vl_aditado > 0 and dias_aditados = 0 then 'Somente Valor'
           when vl_aditado = 0 and dias_aditados > 0 then 'Somente Prazo' else 'Sem alteração' end""",
    ),
    "classify_amendment_direction": _label(
        "tp_variacao_valor",
        f"coalesce({O.sign_label('vl_variacao', rules.AMENDMENT_DIRECTION)}, 'Sem variação de valor')",
    ),
    "classify_variation_band": _label(
        "faixa_variacao",
        """case when vl_original > 0 and vl_variacao * 4 > vl_original then 'Acima de 25% — Atenção'
           when vl_original > 0 and vl_variacao > 0 then 'Até 25%' else 'Redução ou sem variação' end""",
    ),
    "classify_term_change": _rows(
        f"""nu_contrato, coalesce({O.sign_label('dias_aditados', rules.TERM_CHANGE)},
        'Prazo sem alteração') as ds_situacao_prazo, coalesce(vl_aditado, 0) > 0 as fl_possui_aditivo"""
    ),
    "classify_diversity": _rows("cod_unidade_gestora, nu_processo, ds_diversidade", "mart_winner_diversity"),
    "classify_supplier_id": _label(
        "tp_id",
        """case when id_contratado like '***.___.___-**' then 'cpf_mascarado_na_fonte'
           when id_contratado like '__.___.___/____-__' then 'cnpj' else 'nao_identificado' end""",
    ),
    "pct_change_measures": _rows(
        f"""nu_contrato, {O.ratio('vl_variacao', 'vl_original')} as perc_alteracao_valor,
        {O.ratio('dias_aditados', 'dias_originais')} as perc_alteracao_prazo,
        dias_atuais - dias_originais as dias_variacao"""
    ),
    "agg_supplier_state": whole("agg_supplier_state"),
    "agg_supplier_agency": whole("agg_supplier_agency"),
    "mode_agg": _rows("id_contratado, nm_contratado", "agg_by_supplier"),
    "running_total_year": whole("running_total_year"),
    "lag_year_guarded": _with(
        f"""select cod_unidade_gestora, ano_assinatura, mes_assinatura,
        case when a = ano_assinatura - 1 then v end as vl_mesmo_mes_ano_anterior,
        case when a = ano_assinatura - 1 then vl_total_atual - v end as vl_variacao_ano_anterior,
        case when a = ano_assinatura - 1 then {O.share('(vl_total_atual - v)', 'v')} end as perc_variacao_ano_anterior
        from (select *, lag(ano_assinatura) over ({_lag_keys}) as a,
          lag(vl_total_atual) over ({_lag_keys}) as v from agg_monthly_agency)"""
    ),
    "moving_avg_3y": _with(
        f"""select cod_unidade_gestora, ano_assinatura, mes_assinatura,
        {O._divide(O.cents('s'), 'cast(n as hugeint)', 2)} as vl_media_movel_3anos
        from (select *, sum(vl_total_atual) over ({_lag_keys} range between 2 preceding and current row) as s,
          count(*) over ({_lag_keys} range between 2 preceding and current row) as n
          from agg_monthly_agency)"""
    ),
    **{
        name: _rows("id_contratado, vl_total_fornecedor_estado, rank_estado", "supplier_concentration_state")
        for name in ("rank_global", "rank_global_by_counting")
    },
    **{
        name: _rows(
            "cod_unidade_gestora, id_contratado, vl_total_fornecedor_orgao, rank_no_orgao",
            "supplier_concentration_agency",
        )
        for name in ("rank_partitioned", "rank_partitioned_by_counting")
    },
    "share_of_total_global": _rows(
        "id_contratado, vl_total_fornecedor_estado, perc_sobre_total_estado",
        "supplier_concentration_state",
    ),
    "share_of_total_partitioned": _rows(
        "cod_unidade_gestora, id_contratado, vl_total_fornecedor_orgao, perc_sobre_total_orgao",
        "supplier_concentration_agency",
    ),
    "union_slices": whole("union_slices"),
    "top_suppliers_state": whole("top_suppliers_state"),
    "top_suppliers_agency": _with(
        """select * from mart_supplier_concentration where cod_unidade_gestora = '000003'
        order by rank_no_orgao, id_contratado limit 10"""
    ),
    "query_temporal": _with(
        """select * from mart_temporal order by tp_recorte, ano_assinatura, mes_assinatura,
        cod_unidade_gestora, nm_modalidade"""
    ),
    "query_temporal_filtered": _rows(
        "*", "mart_temporal",
        "cod_unidade_gestora = '000003' and ano_assinatura between 1996 and 1999",
    ),
    "query_temporal_by_modality": _rows(
        "*", "mart_temporal", "nm_modalidade = 'Pregão Eletrônico - Lei 10.520'"
    ),
    "query_diversity": _with(
        "select * from mart_winner_diversity order by cod_unidade_gestora, nu_processo"
    ),
    "query_diversity_filtered": _rows("*", "mart_winner_diversity", "cod_unidade_gestora = '000003'"),
    "query_escalation": _with(
        "select * from mart_cost_escalation order by cod_unidade_gestora, nu_contrato"
    ),
    "query_escalation_filtered": _rows(
        "*", "mart_cost_escalation",
        """cod_unidade_gestora = '000003' and ano_assinatura = 1998
        and nm_modalidade = 'Pregão Eletrônico - Lei 10.520'""",
    ),
    "list_agencies": whole("dim_agencies"),
    "list_modalities": whole("dim_modalities"),
    "report_data_quality_by_agency": _with(
        f"""select *, {O.count_share('qt_aditivo_inconsistente', 'qt_contratos')} as perc_aditivo_inconsistente,
        {O.count_share('qt_valor_suspeito', 'qt_contratos')} as perc_valor_suspeito
        from (select cod_unidade_gestora, nm_unidade_gestora, count(*) as qt_contratos,
          count(*) filter (where fl_aditivo_inconsistente) as qt_aditivo_inconsistente,
          count(*) filter (where fl_valor_suspeito) as qt_valor_suspeito
          from mart_cost_escalation group by 1, 2)"""
    ),
    "report_cost_change_by_modality": _with(_report_cost),
    "report_term_change_by_modality": _with(_report_term),
    "sort_cost_report": _with(_report_cost),
    "sort_term_report": _with(_report_term),
    "chart_cost_escalation_by_year": _with(
        """select ano_assinatura, coalesce(sum(vl_variacao), 0) as vl_variacao_total
        from sound_marts where ano_assinatura is not null group by 1"""
    ),
    "chart_cost_escalation_exclusions": _with(
        """select count(*) as qt_contratos,
        count(*) filter (where fl_aditivo_inconsistente or fl_valor_suspeito) as qt_excluidos,
        count(*) filter (where fl_aditivo_inconsistente) as qt_excluidos_aditivo,
        count(*) filter (where fl_valor_suspeito) as qt_excluidos_valor from mart_cost_escalation"""
    ),
    "chart_diversity_counts": _with(
        """select coalesce(ds_diversidade, 'Não classificado') as ds_diversidade, count(*) as qt_processos
        from mart_winner_diversity group by 1"""
    ),
    "chart_top10_share": _with(
        """select t.*, n.* from (select id_contratado, nm_contratado, vl_total_fornecedor_estado,
          perc_sobre_total_estado from top_suppliers_state order by rank_estado, id_contratado limit 1) t,
        (select count(*) as qt_fornecedores, sum(perc_sobre_total_estado) as perc_top
         from top_suppliers_state) n"""
    ),
    "series_general": _rows(
        """ano_assinatura, mes_assinatura,
        ano_assinatura || '-' || lpad(cast(mes_assinatura as varchar), 2, '0') as periodo, vl_total_atual""",
        "mart_temporal", "tp_recorte = 'Geral'",
    ),
    "check_not_null": _reports(NOT_NULL_TABLES, "not_null"),
    "check_unique": _reports(UNIQUE_TABLES, "unique"),
    "check_accepted_values": _reports(ACCEPTED_TABLES, "accepted_values"),
    **{name: _with(O.rule_report(parts)) for name, parts in _checks_rows.items()},
    "profile_percentiles": _with(
        f"""select cast(quantile_cont(cast(vl_original as double), 0.5) as decimal(22,4)) as mediana,
        cast(quantile_cont(cast(vl_original as double), 0.99) as decimal(22,4)) as p99,
        max(vl_original) as maximo, {O.mean('vl_original')} as media, count(vl_original) as total_linhas
        from stg where vl_original is not null"""
    ),
    "profile_outlier_counts": _with(
        """select count(*) filter (where vl_original > 100000) as acima_limite,
        count(*) filter (where vl_original > 100 * vl_atual and vl_atual > 0) as razao_acima,
        count(*) filter (where vl_original > 100000 or (vl_original > 100 * vl_atual and vl_atual > 0)) as uniao,
        count(*) filter (where vl_original > 100000 and vl_atual > 0
          and 100 * abs(vl_original - vl_atual) < vl_atual) as acima_com_atual_tambem_alto
        from stg where vl_original is not null"""
    ),
    "profile_key_uniqueness": _with(
        " union all ".join(
            f"""select {lit(name)} as chave, cast(sum(n) as bigint) as qt_linhas, count(*) as qt_valores,
            cast(sum(n) - count(*) as bigint) as qt_duplicadas
            from (select count(*) as n from stg group by {key})"""
            for name, key in _keys.items()
        )
    ),
    "profile_collisions": _with(
        """select nu_edital, count(distinct cod_unidade_gestora) as qt_donos, count(*) as qt_linhas
        from stg group by 1 having count(distinct cod_unidade_gestora) > 1"""
    ),
    "profile_coverage": _with(
        " union all ".join(
            f"select {lit(c)} as coluna, count(*) as qt_linhas, count({c}) as qt_preenchidas from stg"
            for c in ("dias_originais", "dias_aditados", "dias_atuais", "vl_aditado", "nm_modalidade")
        )
    ),
    "profile_outlier_share": _with(
        f"""select soma_total, soma_marcadas, {O.share('soma_marcadas', 'soma_total')} as perc_marcadas
        from (select sum(vl_original) as soma_total,
          sum(vl_original) filter (where fl_valor_suspeito) as soma_marcadas from stg)"""
    ),
    "profile_row_count_by_year": _with(
        f"select fonte, year(dt_assinatura) as ano, count(*) as qt_linhas from {_sources} group by 1, 2"
    ),
    "profile_name_drift": _with(
        """select cod_unidade_gestora, count(distinct nm_unidade_gestora) as qt_nomes from stg
        group by 1 having count(distinct nm_unidade_gestora) > 1"""
    ),
    "distinct_pairs": _with("select distinct cod_unidade_gestora, nm_unidade_gestora from stg"),
    "source_overlap": _with(
        f"""select count(*) filter (where a and not b) as so_esquerda,
        count(*) filter (where b and not a) as so_direita, count(*) filter (where a and b) as em_ambas
        from (select bool_or(ds_situacao = 'Em execução') as a,
          coalesce(bool_or(year(dt_assinatura) <= {FIRST_YEAR}), false) as b
          from stg group by cod_unidade_gestora, nu_contrato)"""
    ),
    "source_precedence_merge": _with(
        f"""select cod_unidade_gestora, nu_contrato, nm_unidade_gestora, dt_assinatura, ds_situacao,
        vl_atual, nm_fiscal, fonte, p = 3 as fl_nao_auditado
        from (select *, row_number() over (partition by cod_unidade_gestora, nu_contrato order by p) as rn
          from {_sources}) where rn = 1"""
    ),
    "merge_latest": _with(
        """select cod_unidade_gestora, nu_contrato, ds_situacao, vl_atual, vl_aditado, dt_fim_atual,
        cast(dt_inicio + 30 as date) as dt_publicacao from stg"""
    ),
    "history_scd2": _with(
        """select v.* from (
          select cod_unidade_gestora, nu_contrato, 'Em execução' as ds_situacao, vl_original as vl_atual,
            cast(null as decimal(18,2)) as vl_aditado, dt_fim as dt_fim_atual,
            date '2002-01-01' as valid_from,
            case when ds_situacao is distinct from 'Em execução' or vl_atual is distinct from vl_original
              or vl_aditado is not null or dt_fim_atual is distinct from dt_fim
              then date '2002-02-01' end as valid_to from stg
          union all
          select cod_unidade_gestora, nu_contrato, ds_situacao, vl_atual, vl_aditado, dt_fim_atual,
            date '2002-02-01', null from stg
          where ds_situacao is distinct from 'Em execução' or vl_atual is distinct from vl_original
              or vl_aditado is not null or dt_fim_atual is distinct from dt_fim) v"""
    ),
}

# Snapshot files: which rows are dirty, and what is found in the object of the others.
_escaped, _short = "nu_edital = '07'", "nu_edital = '013'"
_broken, _long = "nu_edital = '021'", "nu_edital = '029'"
_aside = f"({_short} or {_long})"
_object = f"""case when {_escaped} then coalesce(ds_objeto, '') || ' disse "oi; tchau" fim'
  when {_broken} then coalesce(ds_objeto, '') || chr(10) || 'segunda; linha' else ds_objeto end"""
_width = len(D.contract.RAW_COLUMNS) + len(D.EXTRA)
_agency = "cod_unidade_gestora, count(*) as qt_contratos, sum(vl_atual) as vl_total_atual"

ORACLE |= {
    "scan_contracts_csv": _rows(
        f"""case when not ({_aside} or {_escaped}) then nu_contrato end as nu_contrato,
        case when not ({_aside} or {_escaped}) then {_object} end as ds_objeto,
        {_aside} or {_escaped} as fl_malformada"""
    ),
    "validate_header": _with(
        """select 'superset' as cenario, cast(null as varchar) as motivo, count(*) as qt_linhas from stg
        union all select 'sem_nucontrato', 'missing columns: nucontrato', count(*) from stg"""
    ),
    "project_known_columns": _with(
        f"""select * replace ({_object} as ds_objeto, nullif(nu_processo, '') as nu_processo)
        from stg where not ({_aside} or {_escaped})"""
    ),
    "split_malformed": _with(
        f"""select case when {_aside} or {_escaped} then 'malformada' else 'ok' end as parte,
        count(*) as qt_linhas from stg group by 1"""
    ),
    "repair_rows": _rows(f"nu_contrato, {_object} as ds_objeto, dias_atuais", where=_escaped),
    "quarantine_rows": _rows(
        f"""'contagem de campos: esperado {_width}, obtido ' ||
        case when {_short} then {_width - len(D.EXTRA)} else {_width + 1} end as motivo, nu_contrato""",
        where=_aside,
    ),
    "ingest_summary": _with(
        f"""select count(*) as total, count(*) filter (where not ({_aside} or {_escaped})) as ok,
        count(*) filter (where {_escaped}) as reparadas, count(*) filter (where {_aside}) as quarentena
        from stg"""
    ),
    "ingest_snapshot": _with(f"select {_agency} from stg where not {_aside} group by 1"),
    "promote_snapshot": _with(f"select {_agency} from stg group by 1"),
    "incremental_file_trigger": _with(
        f"select {_agency}, 1 as qt_primeira, 0 as qt_segunda from stg where not {_aside} group by 1"
    ),
    "multi_format_source": _rows(
        """case when dt_inicio < date '1998-01-01' then 'arquivo' else 'corrente' end as fonte,
        nu_contrato, ds_objeto, nm_modalidade,
        case when dt_inicio >= date '1998-01-01' then nm_fiscal end as nm_fiscal, vl_original"""
    ),
    "write_marts": whole("mart_temporal"),
    "merge_latest_stream": ORACLE["merge_latest"],
}
ORACLE["scan_contracts_csv_in_pieces"] = ORACLE["scan_contracts_csv"]
