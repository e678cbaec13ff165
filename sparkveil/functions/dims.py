"""Closed vocabularies: entities, policies, anchors and area codes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

# Entities in order of precedence, with tier, redacted by default, token prefix, group.
ENTITIES = (
    ("CPF", "gate", True, "CPF", "ident"),
    ("CNPJ", "gate", True, "CNPJ", "ident"),
    ("PROCESSO_CNJ", "measured", True, "PROC", "ident"),
    ("CNS", "measured", True, "CNS", "ident"),
    ("PIS_PASEP", "measured", True, "PIS", "ident"),
    ("TITULO_ELEITOR", "measured", True, "TE", "ident"),
    ("CNH", "measured", True, "CNH", "ident"),
    ("RG", "measured", True, "RG", "ident"),
    ("CEP", "measured", True, "CEP", "contato"),
    ("EMAIL", "measured", True, "MAIL", "contato"),
    ("TELEFONE", "measured", True, "TEL", "contato"),
    ("PERSON", "gate", True, "P", "ident"),
    ("ENDERECO", "best-effort", True, "END", "contato"),
    ("ORGANIZATION", "best-effort", False, "ORG", "contexto"),
    ("LOCATION", "best-effort", False, "LOC", "contato"),
    ("DATE_TIME", "best-effort", False, "DATA", "contexto"),
)
MANUAL_PREFIX = "TRECHO"
NAMES = tuple(e[0] for e in ENTITIES)
WEIGHT = {name: len(NAMES) - i for i, name in enumerate(NAMES)}
REDACTED = tuple(e[0] for e in ENTITIES if e[2])
PREFIX = {e[0]: e[3] for e in ENTITIES} | {"MANUAL": MANUAL_PREFIX}
OPERATORS = ("tarja", "pseudonimo", "manter", "mascara")
REMOVING = ("tarja", "pseudonimo")
NOT_IMPLEMENTED = ("mascara",)

# Thresholds, look-back and tier scores.
THRESHOLD, RESEND_THRESHOLD, LOOK_BACK = 0.35, 0.20, 40
MASKED_SCORE, ANCHORED_SCORE, AMBIGUOUS_SCORE = 0.50, 0.45, 0.20

# Area codes in use.
AREA_CODES = (11, 12, 13, 14, 15, 16, 17, 18, 19, 21, 22, 24, 27, 28, 31, 32, 33, 34, 35, 37, 38, 41, 42, 43, 44, 45, 46, 47, 48, 49, 51, 53, 54, 55, 61, 62, 63, 64, 65, 66, 67, 68, 69, 71, 73, 74, 75, 77, 79, 81, 82, 83, 84, 85, 86, 87, 88, 89, 91, 92, 93, 94, 95, 96, 97, 98, 99)

# Words that tell identifiers of one shape apart.
TELLING = {
    "CNH": ("cnh", "habilitacao", "renach", "condutor", "detran", "registro cnh"),
    "PIS_PASEP": ("pis", "pasep", "nit", "nis"),
    "CPF": ("cpf", "cadastro de pessoa", "cadastro nacional da pessoa fisica"),
}


def fold(text: str) -> str:
    """Lower case without accents, as anchors are compared."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


_LATIN = map(chr, [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)])
_FOLDABLE = [c for c in _LATIN if len(fold(c)) == 1 and fold(c) != c and c == c.lower() and fold(c) not in "\\'"]
#: Letters with one plain letter each, and after them the combining marks, which have none and go.
ACCENTED, PLAIN = "".join(_FOLDABLE) + "".join(map(chr, range(0x300, 0x370))), "".join(map(fold, _FOLDABLE))


def entity_table(spark: SparkSession) -> DataFrame:
    """(entity, tier, redacted, prefix, grp, weight), 16 rows."""
    return spark.createDataFrame([(*e, WEIGHT[e[0]]) for e in ENTITIES], "entity string, tier string, redacted boolean, prefix string, grp string, weight int")
