"""The column contract of a contracts snapshot and the thresholds of its quality flags."""

from __future__ import annotations

from decimal import Decimal

# Source column, staged column, staged type, in the order of the snapshot header.
COLUMNS: list[tuple[str, str, str]] = [
    ("cdunidadegestora", "cod_unidade_gestora", "string"),
    ("nmunidadegestora", "nm_unidade_gestora", "string"),
    ("cdgestao", "cod_gestao", "string"),
    ("nmgestao", "nm_gestao", "string"),
    ("nucontrato", "nu_contrato", "string"),
    ("idcontratado", "id_contratado", "string"),
    ("contratado", "nm_contratado", "string"),
    ("resumo", "ds_resumo", "string"),
    ("objeto", "ds_objeto", "string"),
    ("dtinicio", "dt_inicio", "date"),
    ("dtfim", "dt_fim", "date"),
    ("dtfimatual", "dt_fim_atual", "date"),
    ("dtassinatura", "dt_assinatura", "date"),
    ("situacao", "ds_situacao", "string"),
    ("nuprocesso", "nu_processo", "string"),
    ("vloriginal", "vl_original", "decimal(18,2)"),
    ("vlatual", "vl_atual", "decimal(18,2)"),
    ("nmfiscal", "nm_fiscal", "string"),
    ("nuedital", "nu_edital", "string"),
    ("nmbempublico", "nm_bem_publico", "string"),
    ("nmregimeexecucao", "nm_regime_execucao", "string"),
    ("detipocontrato", "de_tipo_contrato", "string"),
    ("detipodocumentolegal", "de_tipo_documento_legal", "string"),
    ("nudocumentolegal", "nu_documento_legal", "string"),
    ("demulta", "de_multa", "string"),
    ("nuautorizacaoorgao", "nu_autorizacao_orgao", "string"),
    ("nuprazo", "nu_prazo", "string"),
    ("nminterveniente", "nm_interveniente", "string"),
    ("nmlocalexecucao", "nm_local_execucao", "string"),
    ("nmmodalidade", "nm_modalidade", "string"),
    ("nmrepcredor", "nm_rep_credor", "string"),
    ("nmrepinterveniente", "nm_rep_interveniente", "string"),
    ("nmrepug", "nm_rep_ug", "string"),
    ("dtautorizacao", "dt_autorizacao", "date"),
    ("dtinclusao", "dt_inclusao", "date"),
    ("dtlimiteproposta", "dt_limite_proposta", "date"),
    ("vlgarantia", "vl_garantia", "decimal(18,2)"),
    ("vlpercgarantia", "vl_perc_garantia", "decimal(5,2)"),
    ("vlpercmulta", "vl_perc_multa", "decimal(5,2)"),
    ("nutitulo", "nu_titulo", "string"),
    ("vladitado", "vl_aditado", "decimal(18,2)"),
    ("cdugfiscalizador", "cod_ug_fiscalizador", "string"),
    ("ugfiscalizador", "nm_ug_fiscalizador", "string"),
    ("cdgestaofiscalizador", "cod_gestao_fiscalizador", "string"),
    ("gestaofiscalizador", "nm_gestao_fiscalizador", "string"),
    ("bempublico", "fl_bem_publico", "string"),
    ("deesptitulo", "de_esp_titulo", "string"),
    ("dataproposta", "dt_proposta", "date"),
    ("diasoriginais", "dias_originais", "int"),
    ("diasaditados", "dias_aditados", "int"),
    ("diasatuais", "dias_atuais", "int"),
]

RAW_COLUMNS = [raw for raw, _, _ in COLUMNS]
STAGED_COLUMNS = [staged for _, staged, _ in COLUMNS]

CONTRACT_KEY = ["cod_unidade_gestora", "nu_contrato"]
PROCESS_KEY = ["cod_unidade_gestora", "nu_processo"]
AGENCY_KEY = ["cod_unidade_gestora", "cod_gestao"]

# Limits of the value flags, and the contract numbers confirmed by hand to be wrong.
SUSPICIOUS_RATIO = 100
SUSPICIOUS_VALUE = Decimal("500000000")
SUSPICIOUS_TOLERANCE = Decimal("0.01")
AMENDMENT_TOLERANCE = Decimal("0.01")
SUSPICIOUS_CONTRACTS = ("2024CT010186", "2022CT005403", "2020CT004866", "2025CT003501")

# The calendar of the published marts.
CALENDAR_START = "2015-01-01"
CALENDAR_END = "2030-12-31"
