"""Schemas and the fixed values of the two time-card layouts."""

from __future__ import annotations

from pyspark.sql import types as T

PUNCH_COLUMNS = ("Dia", "Dia_Semana", "Entrada1", "Saida1", "Entrada2", "Saida2")
SLOTS = PUNCH_COLUMNS[2:]
MISSING = "0"

CARD_PAGES = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("page_no", T.IntegerType()), T.StructField("text", T.StringType())])
PUNCHES = T.StructType([T.StructField(c, T.StringType(), False) for c in PUNCH_COLUMNS])
SYNTHETIC = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("Dia", "Marcacao_Ponto", "Faltas", "AD_NOT", "H_E_100", "H_E_50", "H_NEG", "COMP_DIA", "SALDO")]
    + [T.StructField("Pagina", T.IntegerType())]
)
USERS = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("username", T.StringType(), False), T.StructField("password", T.BinaryType(), False)])

# Fixed values, layout A.
WEEKDAYS = ("Seg", "Ter", "Qua", "Qui", "Sex", "Sab", "Dom")
SATURDAYS = ("Sáb", "SAB", "sab", "Sabado", "sábado")
HEADER_A = (("Dia", "Data"), ("Marcação", "Situação"))
END_WORDS_A = ("assinatura", "funcionário", "chefia", "visto", "total", "observações")
SPECIAL_A = ("FOLG", "COMP", "FER", "INTEGRAÇÃO", "INTERAÇÃO", "ATESTADO", "MÉDICO", "FALTA", "LICENÇA", "FÉRIAS")
DELIMITERS_A = (
    "MARCAÇÃO OU", "FALTAS", "FALTA", "AD.NOT", "AD NOT", "ADNOT", "H.E.100%", "H E 100%", "HE 100%", "HE100%", "H.E.NEG", "H E NEG", "HE NEG",
    "HENEG", "FALTS", "FALT", "FAULT", "A.NOT", "ANOT", "AD-NOT", "H.E100%", "HE.100%", "H.E.100", "HE.100", "H.E50%", "HE.50%", "HE50%", "H.E.50",
    "HE.50", "H.NEG", "HNEG", "H NEG", "H-NEG", "H.N", "HN", "NEG", "C.DIA", "CDIA", "C DIA", "C-DIA", "C.D", "CD", "COMP.DIA", "S.POS", "SPOS",
    "S POS", "S-POS", "S.P", "SP", "POS", "S.N", "SN", "H.SUP", "HSUP", "H SUP", "H-SUP", "H.S", "HS", "SUP", "SALDO", "SALD", "SAL", "TOTAL", "TOT",
    "VISTO", "CHEFIA", "ASSINATURA", "FUNCIONARIO", "FUNCIONÁRIO", "ATESTADO", "MEDICO", "MÉDICO", "LICENÇA", "LICENCA", "FÉRIAS", "FERIAS",
)

# Fixed values, layout B.
SPECIAL_B = ("FOLG", "COMP", "FER", "ATESTADO", "REPOSO", "FOLGA", "DESCANSO", "FERIADO", "ABONO", "FÉRIAS", "0100")
END_PHRASES_B = (
    "Hrs Normais", "Ad. Not.", "Total for the Month", "Assinatura do Funcionário", "assinatura", "funcionário", "chefia",
    "visto", "total", "observações", "resumo", "Período Banco Horas:", "BH do Mês:",
)
WEEKDAYS_FROM_SUNDAY = ("Dom", "Seg", "Ter", "Qua", "Qui", "Sex", "Sab")

DATE = "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
TIME = r"\b([0-2]?[0-9]:[0-5][0-9])\b"
DOTTED = r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"


#: prefix of a result file's display name, where the caller gives none
PREFIX = "cartao"
