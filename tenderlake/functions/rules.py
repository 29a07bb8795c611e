"""The label vocabularies and keyword lists of the classifiers."""

from __future__ import annotations

# Procurement modalities that two laws name differently, by common label.
MODALITY_LABELS: dict[str, list[str]] = {
    "Pregão Eletrônico - Leis 10.520/2002 e 14.133/2021": [
        "Pregão Eletrônico - Lei 10.520",
        "Pregão Eletrônico Lei 14.133",
    ],
    "Pregão Presencial - Leis 10.520/2002 e 14.133/2021": [
        "Pregão Presencial - Lei 10.520",
        "Pregão Presencial - Lei 14.133",
    ],
    "Dispensa de Licitação - Leis 8.666/1993 e 14.133/2021": [
        "Dispensa de Licitação - Lei 8.666",
        "Dispensa de Licitação - Lei 14.133",
    ],
    "Licitação Inexigível - Leis 8.666/1993 e 14.133/2021": [
        "Licitação Inexigível - Lei 8.666",
        "Licitação Inexigível - Lei 14.133",
    ],
    "Dispensa por Valor - Lei 8.666/1993": [
        "Dispensa de Licitação por Valor - Lei 8.666",
    ],
}
MODALITY_MISSING = "Não informado"

# Branch of activity by keywords found in the contract object; the first rule that
# holds wins. A keyword "a + b" asks for both parts.
BRANCH_RULES: dict[str, list[str]] = {
    "TI - Desenvolvimento de Software": [
        "desenvolvimento de software", "desenvolvimento de sistema",
    ],
    "TI - Manutenção e Suporte": [
        "manutenção de software", "manutencao de software", "sustentação + software",
        "suporte técnico", "suporte tecnico",
    ],
    "TI - Licenciamento de Software": ["licenciamento", "licença", "licenca"],
    "TI - Geral": [
        "software", "tecnologia", "informática", "informatica", "computador", "smartphone",
        "plataforma", "aplicativo",
    ],
    "Combustíveis e Energia": [
        "combustível", "combustivel", "combust", "gasolina", "lubrificante", "diesel",
        "gás glp", "gas glp", "glp", "energia elétrica", "energia eletrica",
    ],
    "Alimentação": [
        "alimenta", "refeição", "refeicao", "gênero alimentício", "genero alimenticio",
        "gêneros alimentícios", "generos alimenticios", "merenda", "pnae", "agua mineral",
        "água mineral", "ração", "racao",
    ],
    "Limpeza e Higiene": ["limpeza", "higiene", "saneante"],
    "Veículos e Manutenção": [
        "veículo", "veiculo", "viatura", "pneu", "peça", "revisão", "manutenção", "manutencao",
        "aferição", "afericao", "etilômetro", "etilometro",
    ],
    "Obras e Construção": [
        "obra", "construção", "construcao", "pavimentação", "pavimentacao", "reforma",
        "edificação", "hidráulico", "hidraulico",
    ],
    "Água e Saneamento": ["água", "agua", "esgoto", "saneamento"],
    "Educação e Capacitação": [
        "educação", "educacao", "ensino", "escola", "capacitação", "capacitacao", "treinamento",
        "acervo bibliográfico", "acervo bibliografico",
    ],
    "Saúde e Medicamentos": [
        "saúde", "saude", "medicamento", "hospitalar", "médico", "medico", "farmac",
        "laboratorial", "exame", "psicologia", "odontolog", "enfermagem",
    ],
    "Segurança Pública": [
        "segurança", "seguranca", "armamento", "vigilância", "vigilancia", "fardamento",
        "espingarda", "epi", "equipamento de proteção",
    ],
    "Locação de Imóveis": ["locação", "locacao", "aluguel", "imóvel", "imovel"],
    "Transporte e Logística": ["transporte", "frete", "logística", "logistica"],
    "Material de Escritório e Equipamentos": [
        "escritório", "escritorio", "expediente", "material gráfico", "lâmpada", "lampada",
        "papel a4", "mobiliário", "mobiliario", "cadeira", "ferramenta", "material elétrico",
        "material eletrico",
    ],
    "Agropecuária": [
        "agrícola", "agricola", "agropec", "insumo agrícola", "insumo agricola", "epagri",
        "agricultura familiar",
    ],
    "Meio Ambiente e Recursos Hídricos": [
        "meio ambiente", "hidrológico", "hidrologico", "hidrometeorológico",
        "hidrometeorologico", "ambiental",
    ],
}
BRANCH_OTHER = "Outros"

# How the keyword list of the contract-grain fact departs from the one above.
FACT_BRANCH_ADDED: dict[str, list[str]] = {
    "TI - Manutenção e Suporte": [
        "sigrh", "sigef", "sistema integrado", "manutenção corretiva", "manutencao corretiva",
        "manutenção evolutiva", "manutenção adaptativa",
    ],
}
FACT_BRANCH_DROPPED: dict[str, list[str]] = {
    "Alimentação": ["gênero alimentício", "genero alimenticio"],
    "Veículos e Manutenção": ["manutenção", "manutencao", "afericao", "etilometro"],
    "Obras e Construção": ["pavimentacao", "edificação", "hidraulico"],
    "Educação e Capacitação": ["capacitacao", "acervo bibliografico"],
    "Saúde e Medicamentos": ["medico"],
    "Segurança Pública": ["vigilancia", "equipamento de proteção"],
    "Locação de Imóveis": ["imovel"],
    "Transporte e Logística": ["logistica"],
    "Material de Escritório e Equipamentos": [
        "escritorio", "lampada", "mobiliario", "material eletrico",
    ],
    "Agropecuária": ["insumo agrícola", "insumo agricola"],
    "Meio Ambiente e Recursos Hídricos": ["hidrologico", "hidrometeorologico"],
}
FACT_BRANCH_RULES: dict[str, list[str]] = {
    label: [
        word
        for word in words + FACT_BRANCH_ADDED.get(label, [])
        if word not in FACT_BRANCH_DROPPED.get(label, [])
    ]
    for label, words in BRANCH_RULES.items()
}

# Objects that mark a test record, and the value at or below which one is a test.
TEST_OBJECTS = ("teste", "teste.")
TEST_MAX_VALUE = 1000

# Bands, highest first, as (lower limit, label); the last label takes the rest.
SUPPLIER_SIZE_BANDS = [(10_000_000, "Grande"), (1_000_000, "Médio"), (100_000, "Pequeno")]
SUPPLIER_SIZE_REST = "Micro"
AGENCY_VOLUME_BANDS = [(1000, "Alto volume"), (100, "Médio volume"), (10, "Baixo volume")]
AGENCY_VOLUME_REST = "Esporádico"

# Labels by sign, as (negative, zero, positive).
AMENDMENT_STATUS = ("Com supressão", "Sem aditivo", "Com acréscimo")
TOTAL_CHANGE = ("Valor reduziu", "Sem variação", "Valor aumentou")
VALUE_CHANGE = ("Decréscimo", "Sem variação", "Acréscimo")
AMENDMENT_DIRECTION = ("Supressão", "Sem variação de valor", "Acréscimo")
TERM_CHANGE = ("Prazo reduzido", "Prazo sem alteração", "Prazo prorrogado")

# Other labels.
AMENDMENT_BOTH = "Valor e Prazo"
AMENDMENT_VALUE = "Somente Valor"
AMENDMENT_TERM = "Somente Prazo"
AMENDMENT_NONE = "Sem alteração"
BAND_LIMIT = 25
BAND_ABOVE = "Acima de 25% — Atenção"
BAND_UP_TO = "Até 25%"
BAND_NONE = "Redução ou sem variação"
DIVERSITY_SINGLE = "Fornecedor único"
DIVERSITY_MULTIPLE = "Múltiplos fornecedores"
DIVERSITY_MISSING = "Não classificado"
SLICE_GENERAL = "Geral"
SLICE_AGENCY = "Órgão"
SLICE_MODALITY = "Modalidade"

# Shapes of supplier ids and their classes.
SUPPLIER_PERSON_PATTERN = r"^\*\*\*\.\d{3}\.\d{3}-\*\*$"
SUPPLIER_COMPANY_PATTERN = r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$"
SUPPLIER_PERSON = "cpf_mascarado_na_fonte"
SUPPLIER_COMPANY = "cnpj"
SUPPLIER_UNKNOWN = "nao_identificado"
