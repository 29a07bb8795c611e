"""Invariants of the marts and their checks on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from tenderlake.plans import aggregates as A
from tenderlake.plans import checks as C
from tenderlake.plans import marts as M
from tenderlake.plans import reads as R
from verification.registry import staged

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stg(spark):
    return staged(spark, FOLDER)


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_calendar_of_the_published_marts(spark):
    days = M.dim_dates(M.date_spine(spark))
    assert days.count() == 5844
    row = days.where("dt_data = date '2024-02-29'").first()
    assert (row.nm_mes, row.nm_mes_abrev, row.nm_dia_semana) == ("February", "Feb", "Thursday")
    assert (row.dia_semana_num, row.nm_trimestre, row.sigla_trimestre) == (4, "1º Tri", "Q1")
    assert str(row.ultimo_dia_mes) == "2024-02-29" and row.semana_ano == 9


def test_slices_equal_the_three_aggregates(stg):
    slices = M.union_slices(stg)
    general = A.monthly_general_with_running_total(stg)
    columns = [
        "ano_assinatura", "mes_assinatura", "qt_contratos", "vl_total_atual",
        "qt_contratos_acumulado_ano", "vl_acumulado_ano",
    ]
    assert same(
        slices.where("tp_recorte = 'Geral'").select(*columns).orderBy(*columns[:2]), general.select(*columns)
    )
    columns = ["ano_assinatura", "mes_assinatura", "cod_unidade_gestora", "nm_unidade_gestora", "qt_contratos"]
    assert same(
        slices.where("tp_recorte = 'Órgão'").select(*columns), A.agg_monthly_agency(stg).select(*columns)
    )


def test_paths_for_large_aggregates_give_the_same_marts(stg):
    assert same(M.mart_supplier_concentration(stg), M.mart_supplier_concentration(stg, one_task_rows=0))
    assert same(M.mart_winner_diversity(stg), M.mart_winner_diversity(stg, one_task_rows=0))


def test_each_agency_has_a_first_supplier(stg):
    mart = M.mart_supplier_concentration(stg)
    first = mart.groupBy("cod_unidade_gestora").agg(F.min("rank_no_orgao").alias("r"))
    assert first.where("r <> 1").isEmpty()
    assert mart.count() == mart.select("cod_unidade_gestora", "id_contratado").distinct().count()


def test_checks_find_what_is_wrong(stg):
    mart = M.mart_temporal(stg)
    broken = mart.withColumn(
        "vl_variacao_ano_anterior",
        F.when(F.col("tp_recorte") == "Geral", F.lit(1).cast("decimal(29,2)")).otherwise(
            F.col("vl_variacao_ano_anterior")
        ),
    )
    assert C.check_lag_gap(mart).first().status == "ok"
    assert C.check_lag_gap(broken).first().status == "erro"
    short = mart.where("tp_recorte <> 'Modalidade' or qt_contratos > 1")
    assert C.check_slices_reconcile(mart).first().status == "ok"
    assert C.check_slices_reconcile(short).first().qt_falhas > 0
    escalation = M.mart_cost_escalation(stg)
    assert C.check_variation_formula(escalation.withColumn("vl_atual", F.col("vl_atual") + 1)).first().qt_falhas > 0
    twice = stg.unionByName(stg.limit(1))
    report = C.check_composite_unique(twice, A.agg_by_process(stg)).collect()
    assert {r.regra: r.qt_falhas for r in report}["unique:contracts.cod_unidade_gestora+nu_contrato"] >= 1


def test_reads_give_the_whole_answer_unless_limited(spark, stg):
    mart = M.mart_cost_escalation(stg)
    many = spark.range(250_000).select(
        F.col("id").cast("string").alias("nu_contrato"), F.lit("1").alias("cod_unidade_gestora"), F.col("id").cast("string").alias("nu_processo"),
        F.lit("m").alias("nm_modalidade"), F.lit("r").alias("tp_recorte"), F.lit(2000).alias("ano_assinatura"), F.lit(1).alias("mes_assinatura"),
    )
    for read in (R.query_escalation, R.query_diversity, R.query_temporal):
        assert read(many).count() == 250_000
    assert [r.nu_contrato for r in R.query_escalation(many, limit=3).collect()] == ["0", "1", "10"]
    with pytest.raises(ValueError):
        R.query_escalation(mart, limit=0)
    with pytest.raises(ValueError):
        R.top_suppliers_state(M.mart_supplier_concentration(stg), 0)
    assert R.query_escalation(mart, limit=5).count() == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(stg):
    plan = plan_of(R.query_escalation(M.mart_cost_escalation(stg), year=1998).select("vl_variacao"))
    assert "EqualTo(ano_assinatura,1998)" in plan
    assert "ds_objeto" not in plan


def test_counted_ranks_sort_no_rows_in_one_task(spark, stg):
    from tenderlake.operators import ranking

    plan = plan_of(ranking.rank_by_counting(A.agg_supplier_state(stg), "r", "vl_total_fornecedor_estado"))
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    # Only the sizes of the ranges meet in one task.
    assert len(single) == 1
    assert "Python" not in plan and "CartesianProduct" not in plan
