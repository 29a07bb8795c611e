"""Expected answers as DuckDB SQL over the same Parquet tables.

The SQL is written on its own terms (integer division for rounded shares, ``mode`` and ``rank``
over whole groups) and shares only the fixed values with the library.
"""

from __future__ import annotations

from tenderlake.functions import rules
from tenderlake.plans import checks as declared
from tenderlake.sources.orders_view import MODALITIES, OBJECTS, STATUS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cents(x: str) -> str:
    return f"cast(cast({x} as decimal(30,2)) * cast(100 as decimal(3,0)) as hugeint)"


def _divide(a: str, b: str, digits: int) -> str:
    """Half-up quotient of two whole numbers; ``a`` already carries the wanted decimals."""
    unit = "0." + "0" * (digits - 1) + "1"
    return (
        f"(case when ({b}) <> 0 then cast(sign({a}) * sign({b}) * "
        f"((2 * abs({a}) + abs({b})) // (2 * abs({b}))) as decimal(30,0)) "
        f"* cast({unit} as decimal({digits + 1},{digits})) end)"
    )


def share(a: str, b: str, digits: int = 2) -> str:
    return _divide(f"({cents(a)} * {10 ** (2 + digits)})", cents(b), digits)


def count_share(a: str, b: str, digits: int = 2) -> str:
    return _divide(
        f"(cast({a} as hugeint) * {10 ** (2 + digits)})", f"cast({b} as hugeint)", digits
    )


def mean(x: str) -> str:
    return f"coalesce({_divide(f'({cents(f'sum({x})')} * 10000)', f'cast(count({x}) as hugeint)', 6)}, 0)"


def ratio(a: str, b: str) -> str:
    return f"cast({a} as double) * 100.0 / nullif(cast({b} as double), 0)"


def mode(x: str) -> str:
    return f"mode() within group (order by {x})"


def branch(rule_set: dict[str, list[str]]) -> str:
    whens = []
    for label, words in rule_set.items():
        tests = [
            "(" + " and ".join(f"lower(ds_objeto) like '%{p.strip()}%'" for p in w.split("+")) + ")"
            for w in words
        ]
        whens.append(f"when {' or '.join(tests)} then {lit(label)}")
    return f"case {' '.join(whens)} else {lit(rules.BRANCH_OTHER)} end"


def normalized(column: str = "nm_modalidade") -> str:
    whens = " ".join(
        f"when {column} in ({', '.join(map(lit, names))}) then {lit(label)}"
        for label, names in rules.MODALITY_LABELS.items()
    )
    return f"case {whens} else coalesce({column}, {lit(rules.MODALITY_MISSING)}) end"


def sign_label(x: str, labels: tuple[str, str, str]) -> str:
    low, zero, high = map(lit, labels)
    return f"case when {x} < 0 then {low} when {x} > 0 then {high} when {x} = 0 then {zero} end"


_objects = "[" + ", ".join(map(lit, OBJECTS)) + "]"
_modality = " ".join(
    f"when o_orderpriority = {lit(k)} then (case when l_linenumber % 2 = 0 then {lit(a)} else {lit(b)} end)"
    for k, (a, b) in MODALITIES.items()
)
_status = " ".join(f"when o_orderstatus = {lit(k)} then {lit(v)}" for k, v in STATUS.items())

BASE = f"""
with raw0 as (
  select l.*, o.*, c.*, n.*, s_name, p_name, p_type, p_brand, p_size,
    lpad(cast(l_suppkey as varchar), 8, '0') as sup8,
    cast(o_orderdate as date) as signed, cast(l_shipdate as date) as shipped,
    cast(l_extendedprice as decimal(18,2)) as price,
    date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as gap
  from lineitem l join orders o on l_orderkey = o_orderkey
  join customer c on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey
  join supplier s on l_suppkey = s_suppkey join part p on l_partkey = p_partkey
), raw1 as (
  select *,
    case when l_partkey % 113 = 0 then cast(1000.00 as decimal(18,2))
         when l_partkey % 113 = 1 then cast(1000.01 as decimal(18,2))
         when l_partkey % 113 = 2 then null
         when l_orderkey % 211 = 5 then cast(price * 1000000 as decimal(18,2))
         else price end as original,
    case when l_partkey % 3 <> 0 then cast(cast(l_quantity as decimal(18,2)) *
      (case l_orderkey % 3 when 0 then 0 when 1 then 100 else -50 end) as decimal(18,2)) end as amended,
    case when l_partkey % 7 <> 0 then gap end as term,
    case l_linenumber % 4 when 1 then 0 when 2 then 30 when 3 then -10 end as extra
  from raw0
), raw2 as (
  select *, cast(original + coalesce(amended, 0) + (case when l_partkey % 11 = 0 then 1 else 0 end)
    as decimal(18,2)) as summed from raw1
), typed as (
  select
    lpad(cast(c_nationkey as varchar), 6, '0') as cod_unidade_gestora,
    case when l_linenumber % 3 = 0 then 'Secretaria ' || n_name else n_name end as nm_unidade_gestora,
    case when c_custkey % 50 <> 0 then c_mktsegment end as cod_gestao,
    case when c_custkey % 50 <> 0 then 'Gestão ' || c_mktsegment end as nm_gestao,
    concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, price, shipped) as nu_contrato,
    case l_suppkey % 3
      when 0 then sup8[1:2] || '.' || sup8[3:5] || '.' || sup8[6:8] || '/0001-91'
      when 1 then '***.' || sup8[3:5] || '.' || sup8[6:8] || '-**'
      else cast(l_suppkey as varchar) end as id_contratado,
    case when l_linenumber % 4 = 0 then s_name || ' LTDA' else s_name end as nm_contratado,
    p_brand || '; lote ' || p_size as ds_resumo,
    case l_partkey % 97 when 0 then 'teste' when 1 then 'TESTE ' when 2 then 'Teste.' when 3 then null
      else {_objects}[l_partkey % {len(OBJECTS)} + 1] || ' - ' || p_name || ' ' || p_type end as ds_objeto,
    signed as dt_inicio, shipped as dt_fim,
    cast(shipped + cast(coalesce(extra, 0) as integer) as date) as dt_fim_atual,
    case when l_orderkey % 101 <> 0 then signed end as dt_assinatura,
    case {_status} end as ds_situacao,
    case l_orderkey % 17 when 0 then null when 1 then '' when 2 then 'S/N' when 3 then '000/0000'
      when 4 then ' ' else 'PROC ' || l_orderkey end as nu_processo,
    original as vl_original,
    case when l_orderkey % 211 = 0 then cast(0 as decimal(18,2))
         when l_orderkey % 211 = 1 then cast(summed * cast(0.001 as decimal(4,3)) as decimal(18,2))
         when l_orderkey % 211 = 2 then cast(summed * 1000000 as decimal(18,2))
         when l_orderkey % 211 = 3 then cast(original * cast(0.01 as decimal(3,2)) as decimal(18,2))
         when l_orderkey % 211 = 4 then null
         else summed end as vl_atual,
    'Fiscal ' || p_size || '; Fiscal ' || l_linenumber as nm_fiscal,
    '0' || p_size as nu_edital, p_name as nm_bem_publico, l_returnflag as nm_regime_execucao,
    p_type as de_tipo_contrato, l_linestatus as de_tipo_documento_legal,
    '00' || l_linenumber as nu_documento_legal, 'multa ' || l_returnflag as de_multa,
    'A' || p_size as nu_autorizacao_orgao, cast(l_linenumber as varchar) as nu_prazo,
    cast(null as varchar) as nm_interveniente, n_name as nm_local_execucao,
    case {_modality} end as nm_modalidade,
    s_name as nm_rep_credor, cast(null as varchar) as nm_rep_interveniente, n_name as nm_rep_ug,
    cast(signed - 10 as date) as dt_autorizacao, signed as dt_inclusao,
    cast(signed - 20 as date) as dt_limite_proposta,
    cast(price * cast(l_tax as decimal(5,2)) as decimal(18,2)) as vl_garantia,
    cast(cast(l_tax as decimal(5,2)) * 100 as decimal(5,2)) as vl_perc_garantia,
    cast(cast(l_discount as decimal(5,2)) * 100 as decimal(5,2)) as vl_perc_multa,
    'T1' as nu_titulo, amended as vl_aditado,
    lpad(cast(c_nationkey as varchar), 6, '0') as cod_ug_fiscalizador, n_name as nm_ug_fiscalizador,
    case when c_custkey % 50 <> 0 then c_mktsegment end as cod_gestao_fiscalizador,
    case when c_custkey % 50 <> 0 then 'Gestão ' || c_mktsegment end as nm_gestao_fiscalizador,
    case when p_size % 2 = 0 then 'S' else 'N' end as fl_bem_publico, 'Contrato' as de_esp_titulo,
    cast(signed - 15 as date) as dt_proposta,
    cast(term as integer) as dias_originais, extra as dias_aditados,
    cast(term + coalesce(extra, 0) as integer) as dias_atuais
  from raw2
), stg as (
  select *, year(dt_assinatura) as ano_assinatura, month(dt_assinatura) as mes_assinatura,
    vl_atual - vl_original as vl_variacao,
    case when vl_aditado is null or vl_aditado = 0 then null
         else coalesce(abs(vl_atual - vl_original - vl_aditado) > 0.01, false) end as fl_aditivo_inconsistente,
    case when vl_original is null or vl_atual is null then null
         else (vl_atual > 0 and vl_original > 100 * vl_atual)
           or (vl_atual > 500000000 and 100 * abs(vl_original - vl_atual) >= vl_atual) end as fl_valor_suspeito
  from typed
), sound as (select * from stg where coalesce(fl_valor_suspeito, false) = false),
eligible as (select * from stg where regexp_matches(nu_processo, '[1-9]'))
"""

_totals = """
  coalesce(sum(vl_original), 0) as vl_total_original, coalesce(sum(vl_atual), 0) as vl_total_atual,
  coalesce(sum(vl_aditado), 0) as vl_total_aditado, coalesce(sum(vl_variacao), 0) as vl_total_variacao"""
_three = """
  coalesce(sum(vl_original), 0) as vl_total_original, coalesce(sum(vl_atual), 0) as vl_total_atual,
  coalesce(sum(vl_variacao), 0) as vl_total_variacao"""
_spread = f"""
  {mean('vl_original')} as vl_medio_contrato,
  coalesce(max(vl_atual), 0) as vl_maior_contrato, coalesce(min(vl_atual), 0) as vl_menor_contrato"""
_dates = "min(dt_assinatura) as dt_primeiro_contrato, max(dt_assinatura) as dt_ultimo_contrato"


def _rank(x: str, by: str = "") -> str:
    return f"rank() over ({by} order by {x} desc nulls first)"


_ranks = f"{_rank('vl_total_atual')} as rank_por_valor, {_rank('qt_contratos')} as rank_por_quantidade"

CTE = {
    "agg_by_agency": f"""select cod_unidade_gestora, cod_gestao,
        {mode('nm_unidade_gestora')} as nm_unidade_gestora, {mode('nm_gestao')} as nm_gestao,
        count(*) as qt_contratos, count(distinct id_contratado) as qt_fornecedores_distintos,
        {_totals}, {_spread}, {_dates} from stg group by all""",
    "agg_by_supplier": f"""select id_contratado, {mode('nm_contratado')} as nm_contratado,
        count(*) as qt_contratos, count(distinct cod_unidade_gestora) as qt_orgaos_distintos,
        count(distinct nm_modalidade) as qt_modalidades_distintas, {_totals}, {_spread}, {_dates},
        coalesce({ratio('max(vl_atual)', 'sum(vl_atual)')}, 0) as perc_concentracao
        from stg group by all""",
    "agg_by_modality": f"""select {normalized()} as nm_modalidade, count(*) as qt_contratos,
        count(distinct cod_unidade_gestora) as qt_orgaos_distintos,
        count(distinct id_contratado) as qt_fornecedores_distintos, {_totals}, {_spread},
        {ratio('count(*) filter (where vl_aditado > 0)', 'count(*)')} as perc_contratos_com_aditivo
        from stg group by 1""",
    "agg_by_branch": f"""select {branch(rules.BRANCH_RULES)} as ramo_atividade, count(*) as qt_contratos,
        count(distinct id_contratado) as qt_fornecedores, count(distinct cod_unidade_gestora) as qt_orgaos,
        coalesce(sum(vl_original), 0) as vl_total_original, coalesce(sum(vl_atual), 0) as vl_total_atual,
        coalesce(sum(vl_aditado), 0) as vl_total_aditado, {mean('vl_original')} as vl_medio_contrato,
        coalesce(max(vl_atual), 0) as vl_maior_contrato from stg group by 1""",
    "agg_by_process": f"""select cod_unidade_gestora, nu_processo,
        {mode('nm_unidade_gestora')} as nm_unidade_gestora, count(*) as qt_contratos,
        count(distinct id_contratado) as qt_fornecedores_distintos,
        count(distinct nm_modalidade) as qt_modalidades_distintas, {_three}, {_dates}
        from eligible group by 1, 2""",
    "agg_monthly_general": f"""select ano_assinatura, mes_assinatura, count(*) as qt_contratos,
        count(distinct cod_unidade_gestora) as qt_orgaos_distintos,
        count(distinct id_contratado) as qt_fornecedores_distintos,
        count(distinct nm_modalidade) as qt_modalidades_distintas, {_totals},
        {mean('vl_original')} as vl_medio_contrato
        from sound where ano_assinatura is not null group by 1, 2""",
    "agg_monthly_agency": f"""select ano_assinatura, mes_assinatura, cod_unidade_gestora,
        {mode('nm_unidade_gestora')} as nm_unidade_gestora, count(*) as qt_contratos,
        count(distinct id_contratado) as qt_fornecedores_distintos, {_three}
        from sound where ano_assinatura is not null group by 1, 2, 3""",
    "agg_monthly_modality": f"""select ano_assinatura, mes_assinatura, nm_modalidade,
        count(*) as qt_contratos, count(distinct cod_unidade_gestora) as qt_orgaos_distintos, {_three}
        from sound where ano_assinatura is not null group by 1, 2, 3""",
    "agg_supplier_state": """select id_contratado, sum(vl_atual) as vl_total_fornecedor_estado
        from sound group by 1""",
    "agg_supplier_agency": """select cod_unidade_gestora, id_contratado,
        sum(vl_atual) as vl_total_fornecedor_orgao from sound group by 1, 2""",
    "running_total_year": """select *,
        sum(qt_contratos) over (partition by ano_assinatura order by mes_assinatura) as qt_contratos_acumulado_ano,
        sum(vl_total_atual) over (partition by ano_assinatura order by mes_assinatura) as vl_acumulado_ano
        from agg_monthly_general""",
    "supplier_concentration_state": f"""select *,
        {share('vl_total_fornecedor_estado', 'vl_total_estado')} as perc_sobre_total_estado from (
          select *, sum(vl_total_fornecedor_estado) over () as vl_total_estado,
            {_rank('vl_total_fornecedor_estado')} as rank_estado from agg_supplier_state)""",
    "supplier_concentration_agency": f"""select *,
        {share('vl_total_fornecedor_orgao', 'vl_total_orgao')} as perc_sobre_total_orgao from (
          select *, sum(vl_total_fornecedor_orgao) over (partition by cod_unidade_gestora) as vl_total_orgao,
            {_rank('vl_total_fornecedor_orgao', 'partition by cod_unidade_gestora')} as rank_no_orgao
          from agg_supplier_agency)""",
    "date_spine": """select cast(unnest(generate_series(
          cast(date_trunc('year', (select min(o_orderdate) from orders)) as timestamp),
          cast(make_date(year((select max(o_orderdate) from orders)), 12, 31) as timestamp),
          interval 1 day)) as date) as dt_data""",
    "dim_dates": """select dt_data, year(dt_data) as ano, month(dt_data) as mes, day(dt_data) as dia,
        quarter(dt_data) as trimestre, week(dt_data) as semana_ano, dayofweek(dt_data) as dia_semana_num,
        strftime(dt_data, '%B') as nm_mes, strftime(dt_data, '%b') as nm_mes_abrev,
        strftime(dt_data, '%A') as nm_dia_semana, strftime(dt_data, '%Y-%m') as ano_mes,
        quarter(dt_data) || 'º Tri' as nm_trimestre, 'Q' || quarter(dt_data) as sigla_trimestre,
        dayofweek(dt_data) in (0, 6) as fl_fim_de_semana,
        cast(date_trunc('month', dt_data) as date) as primeiro_dia_mes,
        last_day(dt_data) as ultimo_dia_mes from date_spine""",
    "dim_suppliers": f"""select *, {_ranks},
        case when vl_total_atual >= 10000000 then 'Grande' when vl_total_atual >= 1000000 then 'Médio'
             when vl_total_atual >= 100000 then 'Pequeno' else 'Micro' end as porte_fornecedor,
        {sign_label('vl_total_aditado', rules.AMENDMENT_STATUS)} as ds_situacao_aditivo,
        {sign_label('vl_total_variacao', rules.TOTAL_CHANGE)} as ds_variacao_valor
        from agg_by_supplier""",
    "dim_agencies": f"""select *, {_ranks},
        {sign_label('vl_total_aditado', rules.AMENDMENT_STATUS)} as ds_situacao_aditivo,
        case when qt_contratos >= 1000 then 'Alto volume' when qt_contratos >= 100 then 'Médio volume'
             when qt_contratos >= 10 then 'Baixo volume' else 'Esporádico' end as ds_perfil_contratacao
        from agg_by_agency""",
    "dim_modalities": f"""select *, {_ranks},
        {ratio('qt_contratos', 'sum(qt_contratos) over ()')} as perc_sobre_total_qt,
        {ratio('vl_total_atual', 'sum(vl_total_atual) over ()')} as perc_sobre_total_valor
        from agg_by_modality""",
    "dim_branches": f"""select t.*, {count_share('qt_contratos', 'all_qt')} as perc_sobre_total_qt,
        {share('vl_total_atual', 'all_vl')} as perc_sobre_total_valor
        from (select *, {_ranks} from agg_by_branch) t,
          (select sum(qt_contratos) as all_qt, sum(vl_total_atual) as all_vl from agg_by_branch)
        """,
    "fct_contracts": f"""select c.nu_contrato, c.id_contratado, c.cod_unidade_gestora, c.cod_gestao,
        c.nm_modalidade, c.nm_contratado, c.nm_unidade_gestora, c.nm_gestao, c.ds_situacao,
        c.de_tipo_contrato, c.nm_regime_execucao, c.nm_local_execucao, c.ds_objeto, c.dt_assinatura,
        c.dt_inicio, c.dt_fim, c.dt_fim_atual, c.ano_assinatura, c.mes_assinatura, c.dias_originais,
        c.dias_aditados, c.dias_atuais, c.vl_original, c.vl_atual,
        coalesce(c.vl_aditado, 0) as vl_aditado, c.vl_garantia, c.vl_variacao,
        coalesce({sign_label('c.vl_variacao', rules.VALUE_CHANGE)}, 'Sem variação') as tp_variacao,
        {sign_label('coalesce(c.vl_aditado, 0)', rules.AMENDMENT_STATUS)} as ds_situacao_aditivo,
        coalesce(c.vl_aditado, 0) > 0 as fl_possui_aditivo,
        coalesce({sign_label('c.dias_aditados', rules.TERM_CHANGE)}, 'Prazo sem alteração') as ds_situacao_prazo,
        {ratio('coalesce(c.vl_variacao, 0)', 'c.vl_original')} as perc_variacao,
        f.rank_por_valor as rank_fornecedor_por_valor,
        f.rank_por_quantidade as rank_fornecedor_por_quantidade, f.porte_fornecedor,
        f.ds_situacao_aditivo as ds_situacao_aditivo_fornecedor,
        f.qt_contratos as qt_total_contratos_fornecedor,
        g.rank_por_valor as rank_orgao_por_valor, g.rank_por_quantidade as rank_orgao_por_quantidade,
        g.ds_perfil_contratacao, d.nm_mes, d.nm_trimestre, d.sigla_trimestre, d.primeiro_dia_mes,
        d.ultimo_dia_mes
        from stg c left join dim_dates d on c.dt_assinatura = d.dt_data
        left join dim_suppliers f on c.id_contratado = f.id_contratado
        left join dim_agencies g on c.cod_unidade_gestora = g.cod_unidade_gestora
          and c.cod_gestao = g.cod_gestao""",
    "fct_amendments": f"""select nu_contrato, id_contratado, cod_unidade_gestora, cod_gestao,
        nm_modalidade, nm_contratado, nm_unidade_gestora, ds_situacao, de_tipo_contrato, dt_assinatura,
        dt_inicio, dt_fim, dt_fim_atual, ano_assinatura, mes_assinatura, vl_original, vl_aditado,
        vl_atual, vl_variacao, dias_originais, dias_aditados, dias_atuais,
        {ratio('vl_variacao', 'vl_original')} as perc_alteracao_valor,
        {ratio('dias_aditados', 'dias_originais')} as perc_alteracao_prazo,
        case when vl_aditado > 0 and dias_aditados > 0 then 'Valor e Prazo'
             when vl_aditado > 0 and dias_aditados = 0 then 'Somente Valor'
             when vl_aditado = 0 and dias_aditados > 0 then 'Somente Prazo'
             else 'Sem alteração' end as tp_aditivo,
        coalesce({sign_label('vl_variacao', rules.AMENDMENT_DIRECTION)}, 'Sem variação de valor') as tp_variacao_valor,
        case when vl_original > 0 and vl_variacao * 4 > vl_original then 'Acima de 25% — Atenção'
             when vl_original > 0 and vl_variacao > 0 then 'Até 25%'
             else 'Redução ou sem variação' end as faixa_variacao
        from stg where vl_aditado > 0 or dias_aditados > 0""",
    "fct_contracts_branch": f"""select nu_contrato, id_contratado, nm_contratado, cod_unidade_gestora,
        nm_unidade_gestora, nm_modalidade, ds_objeto, dt_assinatura, ano_assinatura, vl_original,
        vl_atual, coalesce(vl_aditado, 0) as vl_aditado, ds_situacao,
        {branch(rules.FACT_BRANCH_RULES)} as ramo_atividade
        from stg where lower(ds_objeto) not in ('teste', 'teste.')
          and lower(trim(ds_objeto)) <> 'teste' and vl_original > 1000""",
    "mart_supplier_concentration": f"""select o.cod_unidade_gestora, a.nm_unidade_gestora,
        o.id_contratado, f.nm_contratado, o.vl_total_fornecedor_orgao, o.vl_total_orgao,
        o.rank_no_orgao, o.perc_sobre_total_orgao, e.vl_total_fornecedor_estado, e.vl_total_estado,
        e.rank_estado, e.perc_sobre_total_estado
        from supplier_concentration_agency o
        left join supplier_concentration_state e on o.id_contratado = e.id_contratado
        left join (select id_contratado, {mode('nm_contratado')} as nm_contratado from stg group by 1) f
          on o.id_contratado = f.id_contratado
        left join (select cod_unidade_gestora, {mode('nm_unidade_gestora')} as nm_unidade_gestora
                   from stg group by 1) a on o.cod_unidade_gestora = a.cod_unidade_gestora""",
    "union_slices": """
        select 'Geral' as tp_recorte, ano_assinatura, mes_assinatura,
          cast(null as varchar) as cod_unidade_gestora, cast(null as varchar) as nm_unidade_gestora,
          cast(null as varchar) as nm_modalidade, qt_contratos, vl_total_original, vl_total_atual,
          vl_total_variacao, qt_contratos_acumulado_ano, vl_acumulado_ano from running_total_year
        union all
        select 'Órgão', ano_assinatura, mes_assinatura, cod_unidade_gestora, nm_unidade_gestora, null,
          qt_contratos, vl_total_original, vl_total_atual, vl_total_variacao, null, null
          from agg_monthly_agency
        union all
        select 'Modalidade', ano_assinatura, mes_assinatura, null, null, nm_modalidade,
          qt_contratos, vl_total_original, vl_total_atual, vl_total_variacao, null, null
          from agg_monthly_modality""",
    "lagged": """select *, lag(ano_assinatura) over w as ano_lag, lag(vl_total_atual) over w as vl_lag,
          sum(vl_total_atual) over (w range between 2 preceding and current row) as soma3,
          count(*) over (w range between 2 preceding and current row) as n3
        from union_slices
        window w as (partition by tp_recorte, cod_unidade_gestora, nm_modalidade, mes_assinatura
                     order by ano_assinatura)""",
    "mart_temporal": f"""select tp_recorte, ano_assinatura, mes_assinatura, cod_unidade_gestora,
        nm_unidade_gestora, nm_modalidade, qt_contratos, vl_total_original, vl_total_atual,
        vl_total_variacao, qt_contratos_acumulado_ano, vl_acumulado_ano,
        case when ano_lag = ano_assinatura - 1 then vl_lag end as vl_mesmo_mes_ano_anterior,
        case when ano_lag = ano_assinatura - 1 then vl_total_atual - vl_lag end as vl_variacao_ano_anterior,
        case when ano_lag = ano_assinatura - 1 and vl_lag <> 0
             then {share('(vl_total_atual - vl_lag)', 'vl_lag')} end as perc_variacao_ano_anterior,
        {_divide(cents('soma3'), 'cast(n3 as hugeint)', 2)} as vl_media_movel_3anos from lagged""",
    "mart_winner_diversity": f"""select *,
        case when qt_fornecedores_distintos = 1 then 'Fornecedor único'
             when qt_fornecedores_distintos > 1 then 'Múltiplos fornecedores' end as ds_diversidade,
        {_rank('qt_fornecedores_distintos')} as rank_por_diversidade from agg_by_process""",
    "mart_cost_escalation": f"""select cod_unidade_gestora, nu_contrato, nm_unidade_gestora,
        nm_modalidade, {normalized()} as nm_modalidade_norm, ano_assinatura, mes_assinatura,
        dt_assinatura, id_contratado, nm_contratado, vl_original, vl_atual, vl_variacao,
        {ratio('coalesce(vl_variacao, 0)', 'vl_original')} as perc_variacao, dias_originais,
        dias_atuais, dias_atuais - dias_originais as dias_variacao,
        coalesce({sign_label('vl_variacao', rules.VALUE_CHANGE)}, 'Sem variação') as tp_variacao,
        fl_aditivo_inconsistente, fl_valor_suspeito from stg""",
    "sound_marts": """select * from mart_cost_escalation
        where fl_aditivo_inconsistente is not true and fl_valor_suspeito is not true""",
    "top_suppliers_state": """select * exclude (rn) from (
          select *, row_number() over (partition by id_contratado
            order by rank_estado, cod_unidade_gestora) as rn from mart_supplier_concentration)
        where rn = 1 order by rank_estado, id_contratado limit 10""",
}

# What each of the above reads, in the order they are defined.
_NAMES = list(CTE)


def _with(sql: str) -> str:
    """The base and every named part that the query needs, directly or not."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _NAMES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTE[name])

    visit(sql)
    parts = "".join(f",\n{name} as ({CTE[name]})" for name in _NAMES if name in needed)
    return f"{BASE}{parts}\n{sql}"


def whole(name: str) -> str:
    return _with(f"select * from {name}")


def rule_report(parts: list[tuple[str, str, str]]) -> str:
    """(rule, scalar SQL for the number of failures, status when it fails) as a report."""
    return " union all ".join(
        f"select {lit(rule)} as regra, n as qt_falhas, case when n = 0 then 'ok' else {lit(bad)} end as status "
        f"from (select {n} as n)"
        for rule, n, bad in parts
    )


def declared_checks(table: str) -> list[tuple[str, str, str]]:
    source = "stg" if table == "stg_contracts" else table
    parts = [
        (
            f"not_null:{table}.{c}",
            f"(select count(*) from {source} where {c} is null)",
            "aviso" if c in declared.NOT_NULL_WARN.get(table, ()) else "erro",
        )
        for c in declared.NOT_NULL.get(table, ())
    ]
    parts += [
        (
            f"accepted_values:{table}.{c}",
            f"(select count(*) from {source} where {c} not in ({', '.join(map(lit, values))}))",
            "erro",
        )
        for c, values in declared.ACCEPTED.get(table, {}).items()
    ]
    if table in declared.UNIQUE:
        parts.append(unique(table, source, declared.UNIQUE[table]))
    return parts


def unique(label: str, source: str, key: list[str]) -> tuple[str, str, str]:
    present = " and ".join(f"{k} is not null" for k in key)
    n = (
        f"(select count(*) from (select 1 from {source} where {present} "
        f"group by {', '.join(key)} having count(*) > 1))"
    )
    return f"unique:{label}.{'+'.join(key)}", n, "erro"
