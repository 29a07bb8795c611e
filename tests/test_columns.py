"""Labels, flags and measures on rows that meet every edge."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import labels, measures, predicates, rules
from tenderlake.plans.aggregates import with_branch


def one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column()).collect()]


def test_supplier_id(spark):
    ids = ["***.006.069-**", "00.000.000/0001-91", "9876544", "505", "x***.006.069-**"]
    assert one(spark, "s string", [(i,) for i in ids], lambda: labels.classify_supplier_id("s")) == [
        "cpf_mascarado_na_fonte", "cnpj", "nao_identificado", "nao_identificado", "nao_identificado",
    ]


@pytest.mark.parametrize(
    "original, current, number, expected",
    [
        ("10000.00", "100.00", "a", False),  # ratio of exactly 100
        ("10000.01", "100.00", "a", True),
        ("500.00", "0.00", "a", False),  # no ratio
        ("1.00", "500000000.00", "a", False),  # not above the limit
        ("1.00", "500000000.01", "a", True),
        ("600000000.00", "600000000.00", "a", False),
        ("606000000.00", "600000000.00", "a", True),  # apart by exactly the tolerance
        ("605999999.00", "600000000.00", "a", False),
        ("6e9", "6e9", "2024CT010186", True),  # on the list
        (None, "1.00", "2024CT010186", None),
        ("1.00", None, "a", None),
        ("1.00", "1.00", None, False),
    ],
)
def test_suspicious_value(spark, original, current, number, expected):
    row = [(original and Decimal(original), current and Decimal(current), number)]
    schema = "vl_original decimal(18,2), vl_atual decimal(18,2), nu_contrato string"
    assert one(spark, schema, row, predicates.suspicious_value) == [expected]


@pytest.mark.parametrize(
    "amended, change, expected",
    [(None, 5, None), (0, 5, None), ("1.00", "1.01", False), ("1.00", "1.02", True), (2, None, False)],
)
def test_amendment_inconsistent(spark, amended, change, expected):
    row = [tuple(v if v is None else Decimal(v) for v in (amended, change))]
    schema = "vl_aditado decimal(18,2), vl_variacao decimal(19,2)"
    assert one(spark, schema, row, predicates.amendment_inconsistent) == [expected]


def test_real_process(spark):
    numbers = [None, "", " ", "-", ".", "SED", "S/N", "00", "0000/0000", "001/2016", "0 1"]
    kept = one(spark, "nu_processo string", [(n,) for n in numbers], predicates.real_process)
    assert kept == [False] * 9 + [True, True]


def test_test_contracts(spark):
    rows = [
        ("obra", Decimal("1000.00")), ("obra", Decimal("1000.01")), ("teste", Decimal(5000)),
        ("TESTE ", Decimal(5000)), ("Teste.", Decimal(5000)), ("teste de carga", Decimal(5000)),
        (None, Decimal(5000)), ("obra", None),
    ]
    df = spark.createDataFrame(rows, "ds_objeto string, vl_original decimal(18,2)")
    assert [r[0] for r in df.where(predicates.not_test()).collect()] == ["obra", "teste de carga"]


def test_branch_first_match_and_substrings(spark):
    texts = {
        "Desenvolvimento de SOFTWARE": "TI - Desenvolvimento de Software",
        "sustentação de software": "TI - Manutenção e Suporte",
        "sustentação predial": "Outros",
        "operação assistida": "Alimentação",  # holds 'ração'
        "serviço de cobrança": "Obras e Construção",  # holds 'obra'
        "seguro recepição": "Segurança Pública",  # holds 'epi'
        "água mineral": "Alimentação",
        "água potável": "Água e Saneamento",
        "manutenção predial": "Veículos e Manutenção",
        "nada": "Outros",
        None: "Outros",
    }
    df = spark.createDataFrame([(t,) for t in texts], "ds_objeto string")
    got = {r.ds_objeto: r.ramo_atividade for r in with_branch(df, rules.BRANCH_RULES).collect()}
    assert got == texts
    fact = {r.ds_objeto: r.ramo_atividade for r in with_branch(df, rules.FACT_BRANCH_RULES).collect()}
    assert fact["manutenção predial"] == "Outros"


def test_branch_rules_differ_as_stated():
    assert "sigrh" in rules.FACT_BRANCH_RULES["TI - Manutenção e Suporte"]
    assert "manutenção" not in rules.FACT_BRANCH_RULES["Veículos e Manutenção"]
    assert list(rules.FACT_BRANCH_RULES) == list(rules.BRANCH_RULES)


def test_amendment_labels(spark):
    rows = [(1, 1), (1, 0), (0, 1), (0, 0), (1, None), (None, 1), (1, -1)]
    got = one(spark, "a int, d int", rows, lambda: labels.amendment_type("a", "d"))
    assert got == ["Valor e Prazo", "Somente Valor", "Somente Prazo"] + ["Sem alteração"] * 4
    signs = [(-1,), (0,), (1,), (None,)]
    assert one(spark, "v int", signs, lambda: labels.amendment_status("v")) == [
        "Com supressão", "Sem aditivo", "Com acréscimo", None,
    ]
    assert one(spark, "v int", signs, lambda: labels.value_change("v")) == [
        "Decréscimo", "Sem variação", "Acréscimo", "Sem variação",
    ]
    assert one(spark, "v int", signs, lambda: labels.term_change("v")) == [
        "Prazo reduzido", "Prazo sem alteração", "Prazo prorrogado", "Prazo sem alteração",
    ]


def test_bands(spark):
    totals = [(10_000_000,), (9_999_999,), (1_000_000,), (100_000,), (99_999,), (-5,)]
    assert one(spark, "v int", totals, lambda: labels.supplier_size("v")) == [
        "Grande", "Médio", "Médio", "Pequeno", "Micro", "Micro",
    ]
    counts = [(1000,), (999,), (99,), (9,)]
    assert one(spark, "v int", counts, lambda: labels.agency_volume("v")) == [
        "Alto volume", "Médio volume", "Baixo volume", "Esporádico",
    ]
    percents = [(25.0,), (25.1,), (0.0,), (-1.0,), (None,)]
    assert one(spark, "v double", percents, lambda: labels.variation_band("v")) == [
        "Até 25%", "Acima de 25% — Atenção",
    ] + ["Redução ou sem variação"] * 3


def test_modality(spark):
    names = [
        "Pregão Eletrônico Lei 14.133", "Dispensa de Licitação por Valor - Lei 8.666",
        "Dispensa de Licitação por Valor - Lei 14.133", "Leilão", None,
    ]
    assert one(spark, "m string", [(n,) for n in names], lambda: labels.normalize_modality("m")) == [
        "Pregão Eletrônico - Leis 10.520/2002 e 14.133/2021", "Dispensa por Valor - Lei 8.666/1993",
        "Dispensa de Licitação por Valor - Lei 14.133", "Leilão", "Não informado",
    ]


def test_shares_round_half_up(spark):
    df = spark.createDataFrame(
        [(Decimal("1.45"), Decimal("1000.00")), (Decimal("-1.45"), Decimal("1000.00")),
         (Decimal("1.00"), Decimal("0.00"))],
        "a decimal(28,2), b decimal(28,2)",
    )
    got = [r[0] for r in df.select(measures.money_share("a", "b")).collect()]
    assert got == [Decimal("0.15"), Decimal("-0.15"), None]
    assert df.select(measures.count_share(F.lit(1), F.lit(2000))).first()[0] == Decimal("0.05")
