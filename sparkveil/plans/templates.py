"""Texts with identifiers whose places are known, made from table keys, in SQL that both engines read.

`people` gives the identifiers, staged so that each step reads the one before. Texts are concatenations of pieces,
so gold offsets are sums of lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.functions import generators as g


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, one column an entity) for each customer. Keys are few bytes and texts made of them many, so keys are dealt over
    all cores first."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    return g.with_identifiers(keys.repartition(spark.sparkContext.defaultParallelism, "k"))


def _sum_sql(x: str, n: int, weight: str) -> str:
    """The sum over i = 1..n of the i-th digit of x by a weight, an expression of i."""
    return f"list_sum([({weight}) * substr({x}, i, 1)::INT for i in range(1, {n + 1})])::BIGINT"


def _eleven(t: str) -> str:
    return f"CASE WHEN {t} % 11 IN (0, 1) THEN 0 ELSE 11 - {t} % 11 END"


def people_sql() -> str:
    """The same people for the oracle, worked out on its own: weights are formulas of the place, digits come one after
    another, and no text is shared with what the engine runs but the spread of the keys."""
    key = lambda n, salt=0: f"lpad(((k * {7919 + 10 * salt} + {104729001 + 31 * salt}) % {10**n})::VARCHAR, {n}, '0')"
    areas = "[" + ", ".join(f"'{a}'" for a in (11, 21, 31, 41, 51, 61, 71, 81, 85, 91, 47, 19)) + "]"
    steps = [
        {
            "f": key(9), "j": f"{key(8, 1)} || '0001'", "p": key(10, 2), "h": key(9, 3), "t": f"{key(8, 4)} || lpad((1 + k % 28)::VARCHAR, 2, '0')", "s": f"(1 + k % 2) || {key(10, 5)}", "n": key(7, 6), "r": key(8, 7), "cep": key(8, 8),
            "y": "(2015 + k % 12)::VARCHAR || substr('12458', (1 + k % 5)::INT, 1) || lpad((1 + k % 26)::VARCHAR, 2, '0') || lpad((k % 10000)::VARCHAR, 4, '0')",
            "telefone": f"{areas}[(k % 12 + 1)::INT] || CASE WHEN k % 2 = 0 THEN '9' || {key(8, 9)} ELSE (2 + k % 4) || {key(7, 9)} END",
        },
        {"f1": _sum_sql("f", 9, "11 - i"), "j1": _sum_sql("j", 12, "2 + (12 - i) % 8"), "p1": _sum_sql("p", 10, "2 + (10 - i) % 8"), "h1": _sum_sql("h", 9, "10 - i"), "h2": _sum_sql("h", 9, "i"), "t1": _sum_sql("t", 8, "i + 1"), "s1": _sum_sql("s", 11, "16 - i"), "r1": _sum_sql("r", 8, "i + 1")},
        {"fa": f"f || ({_eleven('f1')})", "ja": f"j || ({_eleven('j1')})", "pis_pasep": f"p || ({_eleven('p1')})", "ta": "t || CASE WHEN t1 % 11 = 10 THEN 0 ELSE t1 % 11 END", "hv": "h2 % 11 - CASE WHEN h1 % 11 = 10 THEN 2 ELSE 0 END", "rg": "r || CASE WHEN r1 % 11 = 10 THEN 'X' ELSE (r1 % 11)::VARCHAR END",
         "cns": "s || CASE WHEN s1 % 11 = 1 THEN '001' || (11 - (s1 + 2) % 11) % 11 ELSE '000' || (11 - s1 % 11) % 11 END"},
        {"f2": _sum_sql("fa", 10, "12 - i"), "j2": _sum_sql("ja", 13, "2 + (13 - i) % 8"), "t2": "7 * substr(ta, 9, 1)::INT + 8 * substr(ta, 10, 1)::INT + 9 * substr(ta, 11, 1)::INT", "hw": "CASE WHEN hv < 0 THEN hv + 11 ELSE hv END", "v": "98 - ((n || y || '00')::HUGEINT % 97)"},
        {"cpf": f"fa || ({_eleven('f2')})", "cnpj": f"ja || ({_eleven('j2')})", "titulo_eleitor": "ta || CASE WHEN t2 % 11 = 10 THEN 0 ELSE t2 % 11 END", "cnh": "h || CASE WHEN h1 % 11 = 10 THEN 0 ELSE h1 % 11 END || CASE WHEN hw >= 10 THEN 0 ELSE hw END", "processo_cnj": "n || lpad(v::VARCHAR, 2, '0') || y"},
    ]
    sql = "(SELECT c_custkey AS k FROM customer)"
    for i, step in enumerate(steps):
        sql = f"(SELECT s{i}.*, " + ", ".join(f"{e} AS {name}" for name, e in step.items()) + f" FROM {sql} s{i})"
    return f"(SELECT k, {', '.join(e.lower() for e in g.MADE)} FROM {sql})"


#: For each entity: texts before the value, how the value is written, the score it gets (None: not found), and
#: whether it is marked as failing its check.
VARIANTS: dict[str, list[tuple[str, str, float | None, bool]]] = {
    "CPF": [("Pagamento a ", "masked", 1.0, False), ("Pagamento a ", "masked_bad", 0.6, True), ("CPF: ", "raw_bad", 0.45, True), ("Nota fiscal ", "raw_bad", None, False), ("Registro ", "raw", 1.0, False)],
    "CNPJ": [("Empresa ", "masked", 1.0, False), ("Empresa ", "masked_bad", 0.7, True), ("Chave PIX: ", "raw_bad", 0.45, True), ("1920 pixels. Lote ", "raw_bad", None, False)],
    "CNS": [("Cadastro ", "masked", 1.0, False), ("Cadastro ", "masked_bad", None, False), ("Cartao SUS ", "masked_bad", 0.6, True), ("Cadastro ", "raw", 1.0, False), ("Paciente ", "raw_bad", 0.45, True)],
    "PIS_PASEP": [("PIS ", "masked", 1.0, False), ("Numero ", "masked", 0.2, False), ("Numero ", "masked_bad", 0.7, True), ("CTPS ", "raw_bad", 0.45, True), ("Numero ", "raw", 0.2, False)],
    "PROCESSO_CNJ": [("Feito ", "masked", 1.0, False), ("Feito ", "masked_bad", 0.8, True), ("Autos ", "raw_bad", 0.45, True), ("Feito ", "raw_bad", None, False)],
    "CNH": [("CNH ", "raw", 1.0, False), ("Numero ", "raw", 0.2, False), ("DETRAN ", "raw_bad", 0.45, True), ("Numero ", "raw_bad", None, False)],
    "TITULO_ELEITOR": [("Numero ", "masked", 1.0, False), ("Numero ", "masked_bad", None, False), ("Zona ", "masked_bad", 0.5, True), ("Eleitor ", "raw_bad", 0.45, True)],
    "RG": [("Doc ", "masked", 1.0, False), ("Doc ", "masked_bad", 0.5, True), ("RG ", "raw_bad", 0.45, True), ("Doc ", "raw_bad", None, False)],
    "CEP": [("Local ", "masked", 0.5, False), ("Local ", "raw", 0.1, False)],
    "TELEFONE": [("Fale ", "masked", 1.0, False), ("Fale ", "masked_bad", 0.6, True), ("Ramal ", "spaced", 1.0, False)],
    "EMAIL": [("Escreva a ", "masked", 1.0, False), ("Escreva a ", "masked_bad", 0.75, True)],
    "ENDERECO": [("Mora na ", "masked", 0.5, False), ("Mora na ", "masked_bad", None, False)],
}


def written(entity: str, how: str) -> str:
    """SQL of a value of the people table, written one way."""
    c = entity.lower()
    if entity == "EMAIL":
        return "concat('cliente', cast(k as string), '@exemplo.com.br')" if how == "masked" else "concat('cliente', cast(k as string), '@exemplo..com')"
    if entity == "ENDERECO":
        return "concat('Rua das Flores, ', cast(k % 9000 as string))" if how == "masked" else "concat('Viagem das Flores, ', cast(k % 9000 as string))"
    if entity == "TELEFONE":
        n = f"(length({c}) - 6)"
        parts = f"substr({c}, 3, {n}), '-', substr({c}, length({c}) - 3, 4)"
        area = "'00'" if how == "masked_bad" else f"substr({c}, 1, 2)"
        return f"concat('(', {area}, ') ', {parts})" if how != "spaced" else f"concat({area}, ' ', {parts})"
    value = g.broken(c) if how.endswith("bad") else c
    if how.startswith("raw"):
        return f"({value})"
    # Masks split a value into pieces; a value is broken in its last digit alone, so pieces of both are aligned.
    return g.masked(f"({value})" if how.endswith("bad") else c, g.MASKS[entity])


def scan_text(entity: str) -> str:
    """SQL of a text with one value of the entity, its variant by key."""
    n = len(VARIANTS[entity])
    return "case " + " ".join(f"when k % {n} = {i} then concat('{before}', {written(entity, how)}, ' em dia.')" for i, (before, how, _, _) in enumerate(VARIANTS[entity])) + " end"


def expected_sql(entity: str) -> str:
    """The oracle of a scan: places from the lengths of the pieces, scores by variant."""
    n = len(VARIANTS[entity])
    parts = []
    for i, (before, how, score, bad) in enumerate(VARIANTS[entity]):
        if score is not None:
            note = "'checksum_invalido'" if bad else "CAST(NULL AS VARCHAR)"
            parts.append(f"SELECT k AS doc_id, {len(before)} AS \"start\", {len(before)} + length({written(entity, how)}) AS \"end\", '{entity}' AS entity, {score}::DOUBLE AS score, {note} AS note FROM p WHERE k % {n} = {i}")
    return f"WITH p AS {people_sql()} " + " UNION ALL ".join(parts)


_FILLER = "'As partes ajustam o que segue, na forma da lei e de boa vontade, sem prejuizo de outras garantias; o que aqui falta rege-se pelo costume. '"
_NL = "chr(10)"


def _slot(entity: str, how: str = "masked") -> tuple[str, str]:
    return written(entity, how), entity


#: Texts of five kinds: pieces of SQL that both engines read, and the entity each is; None for plain words.
GENRES: dict[str, list[tuple[str, str | None]]] = {
    "contrato": [("'Contrato de servicos. CPF '", None), _slot("CPF"), ("', telefone '", None), _slot("TELEFONE"), ("', e-mail '", None), _slot("EMAIL"), ("', CNPJ '", None), _slot("CNPJ"), ("', CEP '", None), _slot("CEP"), ("'. '", None), (f"repeat({_FILLER}, cast(1 + k % 4 as int))", None), ("'Repetido: '", None), _slot("CPF"), ("'.'", None)],
    "peticao": [("'Autos '", None), _slot("PROCESSO_CNJ"), (f"concat('.', {_NL}, 'O autor, identidade RG ')", None), _slot("RG"), ("', inscrito no CPF '", None), _slot("CPF"), (f"concat(',', {_NL}, 'residente na ')", None), _slot("ENDERECO"), ("'. '", None), (_FILLER, None)],
    "prontuario": [("'Paciente com cartao SUS '", None), _slot("CNS"), ("', contato '", None), _slot("TELEFONE", "spaced"), ("'. '", None), (_FILLER, None), ("'Residente na '", None), _slot("ENDERECO"), ("' e CEP '", None), _slot("CEP"), ("'.'", None)],
    "rh": [("'Admissao. PIS/PASEP: '", None), _slot("PIS_PASEP"), ("'. '", None), (_FILLER, None), ("'Habilitacao do condutor, CNH '", None), _slot("CNH", "raw"), ("'. '", None), (_FILLER, None), ("'Titulo de eleitor '", None), _slot("TITULO_ELEITOR"), ("'; e-mail '", None), _slot("EMAIL"), ("'.'", None)],
    "oficio": [(f"repeat({_FILLER}, cast(k % 7 as int))", None), ("'Ao orgao de CNPJ '", None), _slot("CNPJ"), ("', sobre o processo '", None), _slot("PROCESSO_CNJ"), ("', aos cuidados de '", None), _slot("EMAIL"), ("'.'", None)],
}
#: Beneath every third text: numbers of the right form whose check digits are wrong, beside the words that name them.
ANNEX: list[tuple[str, str | None]] = [(f"concat({_NL}, 'Anexo de pendencias. CPF: ')", None), _slot("CPF", "masked_bad"), (f"concat(';', {_NL}, 'empresa de CNPJ ')", None), _slot("CNPJ", "masked_bad"), (f"concat(';', {_NL}, {_FILLER}, 'condutor autuado, CNH ')", None), _slot("CNH", "raw_bad"), ("'.'", None)]


def _kinds() -> list[tuple[str, list[tuple[str, str | None]]]]:
    """A condition on the key and the pieces of its texts, for each kind with and without the annex."""
    return [(f"k % 5 = {i} and k % 3 {'=' if annex else '<>'} 0", pieces + (ANNEX if annex else [])) for i, pieces in enumerate(GENRES.values()) for annex in (True, False)]


def text_sql(shown=lambda piece, entity: piece) -> str:
    """SQL of the texts, with each piece as `shown` has it."""
    return "case " + " ".join(f"when {when} then concat({', '.join(shown(p, e) for p, e in pieces)})" for when, pieces in _kinds()) + " end"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, genre, text) of a text for each customer, of the kind that its key says."""
    genre = F.get(F.array(*map(F.lit, GENRES)), (F.col("k") % 5).cast("int"))
    return people(spark, sf_dir).select(F.col("k").alias("doc_id"), genre.alias("genre"), F.expr(text_sql()).alias("text"))


def gold_sql() -> str:
    """The texts' spans by construction, for the oracle: doc_id, label, start, end, value; places are sums of lengths."""
    parts = []
    for when, pieces in _kinds():
        for i, (piece, entity) in enumerate(pieces):
            if entity:
                before = " + ".join(f"length({p})" for p, _ in pieces[:i])
                parts.append(f"SELECT k AS doc_id, '{entity}' AS label, {before} AS \"start\", {before} + length({piece}) AS \"end\", {piece} AS value FROM p WHERE {when}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)})"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in Spark: the pieces of a text as an array, and a running sum of their lengths."""
    pieces = "case " + " ".join(f"when {when} then array({', '.join('struct(' + p + ' as value, ' + (repr(e) if e else 'cast(null as string)') + ' as label)' for p, e in parts)})" for when, parts in _kinds()) + " end"
    span = "struct<label:string,start:int,end:int,value:string>"
    fold = f"aggregate(pieces, struct(0 as at, cast(array() as array<{span}>) as out), (a, p) -> struct(a.at + length(p.value) as at, if(p.label is null, a.out, array_append(a.out, struct(p.label as label, a.at as start, a.at + length(p.value) as end, p.value as value))) as out), a -> a.out)"
    return people(spark, sf_dir).select("k", F.expr(pieces).alias("pieces")).select(F.col("k").alias("doc_id"), F.inline(F.expr(fold)))
