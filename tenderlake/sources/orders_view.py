"""A contracts snapshot derived from order tables, one contract per order line.

The order tables have no placeholders, dirty values or free text, so these are set by key.
Doubles become decimals before any arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake import contract
from tenderlake.session import spread

# One object text per kind of purchase; the part key picks one.
OBJECTS = [
    "desenvolvimento de software sob medida",
    "Sustentação do software de folha",
    "Renovação de licença anual",
    "computador e monitor",
    "óleo diesel S10",
    "gêneros alimentícios para merenda",
    "serviço de limpeza predial",
    "manutenção de viatura",
    "obra de pavimentação",
    "rede de esgoto",
    "capacitação de servidores",
    "material hospitalar",
    "vigilância armada",
    "aluguel de sala",
    "transporte escolar",
    "cadeira giratória",
    "insumo agrícola",
    "estudo ambiental",
    "serviço de operação assistida",
    "MANUTENÇÃO CORRETIVA do SIGEF",
    "imovel em comodato",
    "serviços gerais",
    "equipamento de proteção individual",
]

# Modalities by order priority, for even and for odd line numbers.
MODALITIES = {
    "1-URGENT": ("Dispensa de Licitação - Lei 8.666", "Dispensa de Licitação - Lei 14.133"),
    "2-HIGH": ("Pregão Eletrônico - Lei 10.520", "Pregão Eletrônico Lei 14.133"),
    "3-MEDIUM": ("Concorrência - Lei 8.666", "Pregão Presencial - Lei 10.520"),
    "5-LOW": ("Licitação Inexigível - Lei 8.666", "Dispensa de Licitação por Valor - Lei 8.666"),
}
STATUS = {"F": "Encerrado", "O": "Em execução", "P": "Suspenso"}


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def contracts_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The 51 raw columns, already typed; see ``as_text`` for the form they have in a file."""

    def read(name: str, *columns: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)

    lines = read(
        "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    # Orders meet their customers first, so that the many lines are shuffled once for all three. Names of
    # nations and suppliers, which are few, come last and cross no shuffle with the lines.
    orders = (
        read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        .join(
            read("customer", "c_custkey", "c_nationkey", "c_mktsegment"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .withColumn("segment", F.when(F.col("c_custkey") % 50 != 0, F.col("c_mktsegment")))
    )
    rows = (
        spread(lines, "l_orderkey", "l_partkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(
            read("part", "p_partkey", "p_name", "p_type", "p_brand", "p_size"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .join(read("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("supplier", "s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    order, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    supplier = F.lpad(_text("l_suppkey"), 8, "0")
    price = _money(F.col("l_extendedprice"))
    signed = F.col("o_orderdate").cast("date")
    shipped = F.col("l_shipdate").cast("date")
    term = F.datediff(shipped, signed)

    rows = rows.withColumns(
        {
            "signed": signed,
            "shipped": shipped,
            "price": price,
            "original": F.when(part % 113 == 0, _money(F.lit("1000.00")))
            .when(part % 113 == 1, _money(F.lit("1000.01")))
            .when(part % 113 != 2, F.when(order % 211 == 5, _money(price * 1000000)).otherwise(price)),
            "amended": F.when(
                part % 3 != 0,
                _money(
                    _money(F.col("l_quantity"))
                    * F.when(order % 3 == 0, 0).when(order % 3 == 1, 100).otherwise(-50)
                ),
            ),
            "term": F.when(part % 7 != 0, term),
            "extra": F.when(line % 4 == 1, 0).when(line % 4 == 2, 30).when(line % 4 == 3, -10),
        }
    ).withColumns(
        {
            "summed": _money(
                F.col("original")
                + F.coalesce(F.col("amended"), F.lit(0))
                + F.when(part % 11 == 0, 1).otherwise(0)
            ),
        }
    )
    current = (
        F.when(order % 211 == 0, _money(F.lit("0.00")))
        .when(order % 211 == 1, _money(F.col("summed") * F.lit("0.001").cast("decimal(4,3)")))
        .when(order % 211 == 2, _money(F.col("summed") * 1000000))
        .when(order % 211 == 3, _money(F.col("original") * F.lit("0.01").cast("decimal(3,2)")))
        .when(order % 211 != 4, F.col("summed"))
    )
    modality = F
    for priority, (even, odd) in MODALITIES.items():
        modality = modality.when(
            F.col("o_orderpriority") == priority, F.when(line % 2 == 0, even).otherwise(odd)
        )
    phrase = F.element_at(
        F.array(*[F.lit(t) for t in OBJECTS]), (part % len(OBJECTS) + 1).cast("int")
    )
    code = F.lpad(_text("c_nationkey"), 6, "0")
    segment = F.col("segment")
    guarantee = F.col("l_tax").cast("decimal(5,2)")
    status = F
    for key, label in STATUS.items():
        status = status.when(F.col("o_orderstatus") == key, label)

    values: dict[str, Column] = {
        "cdunidadegestora": code,
        "nmunidadegestora": F.when(line % 3 == 0, F.concat(F.lit("Secretaria "), F.col("n_name")))
        .otherwise(F.col("n_name")),
        "cdgestao": segment,
        "nmgestao": F.concat(F.lit("Gestão "), segment),
        "nucontrato": F.concat_ws(
            "-", _text("l_orderkey"), _text("l_partkey"), _text("l_suppkey"), _text("l_linenumber"),
            F.col("price").cast("string"), F.col("shipped").cast("string"),
        ),
        "idcontratado": F.when(
            F.col("l_suppkey") % 3 == 0,
            F.concat(
                F.substring(supplier, 1, 2), F.lit("."), F.substring(supplier, 3, 3), F.lit("."),
                F.substring(supplier, 6, 3), F.lit("/0001-91"),
            ),
        )
        .when(
            F.col("l_suppkey") % 3 == 1,
            F.concat(
                F.lit("***."), F.substring(supplier, 3, 3), F.lit("."), F.substring(supplier, 6, 3),
                F.lit("-**"),
            ),
        )
        .otherwise(_text("l_suppkey")),
        "contratado": F.when(line % 4 == 0, F.concat(F.col("s_name"), F.lit(" LTDA")))
        .otherwise(F.col("s_name")),
        "resumo": F.concat(F.col("p_brand"), F.lit("; lote "), _text("p_size")),
        "objeto": F.when(part % 97 == 0, F.lit("teste"))
        .when(part % 97 == 1, F.lit("TESTE "))
        .when(part % 97 == 2, F.lit("Teste."))
        .when(
            part % 97 != 3,
            F.concat(phrase, F.lit(" - "), F.col("p_name"), F.lit(" "), F.col("p_type")),
        ),
        "dtinicio": F.col("signed"),
        "dtfim": F.col("shipped"),
        "dtfimatual": F.date_add(F.col("shipped"), F.coalesce(F.col("extra"), F.lit(0))),
        "dtassinatura": F.when(order % 101 != 0, F.col("signed")),
        "situacao": status,
        "nuprocesso": F.when(order % 17 == 1, F.lit(""))
        .when(order % 17 == 2, F.lit("S/N"))
        .when(order % 17 == 3, F.lit("000/0000"))
        .when(order % 17 == 4, F.lit(" "))
        .when(order % 17 != 0, F.concat(F.lit("PROC "), _text("l_orderkey"))),
        "vloriginal": F.col("original"),
        "vlatual": current,
        "nmfiscal": F.concat(F.lit("Fiscal "), _text("p_size"), F.lit("; Fiscal "), _text("l_linenumber")),
        "nuedital": F.concat(F.lit("0"), _text("p_size")),
        "nmbempublico": F.col("p_name"),
        "nmregimeexecucao": F.col("l_returnflag"),
        "detipocontrato": F.col("p_type"),
        "detipodocumentolegal": F.col("l_linestatus"),
        "nudocumentolegal": F.concat(F.lit("00"), _text("l_linenumber")),
        "demulta": F.concat(F.lit("multa "), F.col("l_returnflag")),
        "nuautorizacaoorgao": F.concat(F.lit("A"), _text("p_size")),
        "nuprazo": _text("l_linenumber"),
        "nminterveniente": F.lit(None).cast("string"),
        "nmlocalexecucao": F.col("n_name"),
        "nmmodalidade": modality,
        "nmrepcredor": F.col("s_name"),
        "nmrepinterveniente": F.lit(None).cast("string"),
        "nmrepug": F.col("n_name"),
        "dtautorizacao": F.date_sub(F.col("signed"), 10),
        "dtinclusao": F.col("signed"),
        "dtlimiteproposta": F.date_sub(F.col("signed"), 20),
        "vlgarantia": _money(F.col("price") * guarantee),
        "vlpercgarantia": (guarantee * 100).cast("decimal(5,2)"),
        "vlpercmulta": (F.col("l_discount").cast("decimal(5,2)") * 100).cast("decimal(5,2)"),
        "nutitulo": F.lit("T1"),
        "vladitado": F.col("amended"),
        "cdugfiscalizador": code,
        "ugfiscalizador": F.col("n_name"),
        "cdgestaofiscalizador": segment,
        "gestaofiscalizador": F.concat(F.lit("Gestão "), segment),
        "bempublico": F.when(F.col("p_size") % 2 == 0, "S").otherwise("N"),
        "deesptitulo": F.lit("Contrato"),
        "dataproposta": F.date_sub(F.col("signed"), 15),
        "diasoriginais": F.col("term"),
        "diasaditados": F.col("extra"),
        "diasatuais": F.col("term") + F.coalesce(F.col("extra"), F.lit(0)),
    }
    return rows.select(*[values[name].alias(name) for name in contract.RAW_COLUMNS])


def as_text(raw: DataFrame) -> DataFrame:
    """Every column as the text a snapshot file holds; dates carry a time of day."""
    kinds = dict(raw.dtypes)
    return raw.select(
        *[
            (
                F.concat(F.col(name).cast("string"), F.lit(" 00:00:00.0"))
                if kinds[name] == "date"
                else F.col(name).cast("string")
            ).alias(name)
            for name in contract.RAW_COLUMNS
        ]
    )
