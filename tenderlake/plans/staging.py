"""Typed staging of a contracts snapshot."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake import contract
from tenderlake.functions import predicates


def stg_contracts(
    raw: DataFrame,
    confirmed_suspicious: Iterable[str] = contract.SUSPICIOUS_CONTRACTS,
    suspicious_value_limit=contract.SUSPICIOUS_VALUE,
) -> DataFrame:
    """Rename and type the 51 known columns, derive year, month and change, and set both flags.

    A value that does not fit its type becomes null instead of failing the job.
    """
    typed = raw.select(
        *[F.col(source).try_cast(kind).alias(name) for source, name, kind in contract.COLUMNS]
    )
    return (
        typed.withColumns(
            {
                "ano_assinatura": F.year("dt_assinatura"),
                "mes_assinatura": F.month("dt_assinatura"),
                "vl_variacao": F.col("vl_atual") - F.col("vl_original"),
            }
        )
        .withColumns(
            {
                "fl_aditivo_inconsistente": predicates.amendment_inconsistent(),
                "fl_valor_suspeito": predicates.suspicious_value(
                    confirmed=confirmed_suspicious, value_limit=suspicious_value_limit
                ),
            }
        )
    )
