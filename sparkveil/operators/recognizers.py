"""Pattern recognisers with evidence tiers.

A recogniser scans text for its patterns and weighs each match by its check digits, its form and the words before
it. Everything is one projection of literal patterns, so a scan is one pass without a shuffle and new documents are
independent of each other. A text is looked through once for each pattern, once for all runs of bare digits together;
what is found goes as one array through steps that are each written once, whatever the number of recognisers, so the
plan stays small. Digits of any script count as digits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions import checkdigits as cd
from sparkveil.functions import dims, text
from sparkveil.operators import resolve

#: array element of detections
SPAN = "struct<start:int,end:int,entity:string,score:double,note:string>"
INVALID = "checksum_invalido"
_FLAGS = "(?ismU)"


@dataclass(frozen=True)
class Recognizer:
    """Patterns with base scores; a validator given a SQL expression of the value and one of its digits; the words
    that anchor it; whether its form is shared with another identifier."""

    entity: str
    patterns: tuple[tuple[str, float], ...]
    validator: object = None
    anchors: tuple[str, ...] = ()
    ambiguous: bool = False


_STREET = r"(?:Rua|Av\.?|Avenida|Travessa|Alameda|Praça|Rodovia|Estrada|Largo|Viela|Quadra)"

# Patterns, base scores and anchor words.
RECOGNIZERS: dict[str, Recognizer] = {
    r.entity: r
    for r in (
        Recognizer("CPF", ((r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", 0.6), (r"(?<!\d)\d{11}(?!\d)", 0.3)), lambda v, d: cd.cpf_valid(d), ("cpf", "c.p.f", "cadastro de pessoa física", "cadastro de pessoas físicas", "inscrito no cpf", "portador do cpf", "cpf/mf", "cpf nº", "cpf n°", "chave pix", "chave-pix")),
        Recognizer("CNPJ", ((r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", 0.7), (r"(?<!\d)\d{14}(?!\d)", 0.3)), lambda v, d: cd.cnpj_valid(d), ("cnpj", "c.n.p.j", "cadastro nacional da pessoa jurídica", "inscrita no cnpj", "cnpj/mf", "cnpj nº", "pessoa jurídica", "chave pix", "chave-pix")),
        Recognizer("CNS", ((r"(?<!\d)\d{3}[\s.]\d{4}[\s.]\d{4}[\s.]\d{4}(?!\d)", 0.6), (r"(?<!\d)\d{15}(?!\d)", 0.4)), lambda v, d: cd.cns_valid(d), ("cns", "cartão nacional de saúde", "cartão sus", "sus", "número do cartão", "cartão nacional", "prontuário", "paciente")),
        Recognizer("PIS_PASEP", ((r"\b\d{3}\.\d{5}\.\d{2}-\d\b", 0.7), (r"(?<!\d)\d{11}(?!\d)", 0.25)), lambda v, d: cd.pis_valid(d), ("pis", "pasep", "pis/pasep", "nit", "nis", "número de inscrição", "inscrição do trabalhador", "fgts", "ctps"), ambiguous=True),
        Recognizer("PROCESSO_CNJ", ((r"\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b", 0.8), (r"(?<!\d)\d{20}(?!\d)", 0.4)), lambda v, d: cd.cnj_valid(d), ("processo", "autos", "processo nº", "autos nº", "ação", "execução", "distribuído", "vara", "comarca", "tribunal")),
        Recognizer("CNH", ((r"(?<!\d)\d{11}(?!\d)", 0.2),), lambda v, d: cd.cnh_valid(d), ("cnh", "carteira nacional de habilitação", "habilitação", "registro cnh", "número de registro", "renach", "condutor", "detran"), ambiguous=True),
        Recognizer("TITULO_ELEITOR", ((r"(?<!\d)\d{4}[\s.]\d{4}[\s.]\d{4}(?!\d)", 0.5), (r"(?<!\d)\d{12}(?!\d)", 0.3)), lambda v, d: cd.titulo_valid(d), ("título de eleitor", "titulo eleitoral", "inscrição eleitoral", "zona", "seção", "tre", "eleitor")),
        Recognizer("RG", ((r"\b\d{1,2}\.\d{3}\.\d{3}-[\dXx]\b", 0.5), (r"(?<![\d.])\d{7,9}-[\dXx]\b", 0.4), (r"(?<!\d)\d{7,9}(?!\d)", 0.15)), lambda v, d: cd.rg_valid(v), ("rg", "r.g", "registro geral", "identidade", "carteira de identidade", "cédula de identidade", "documento de identidade", "portador do rg", "rg nº", "ssp", "expedido por", "órgão expedidor")),
        Recognizer("CEP", ((r"\b\d{5}-\d{3}\b", 0.5), (r"(?<!\d)\d{8}(?!\d)", 0.1)), None, ("cep", "c.e.p", "código postal", "endereço", "logradouro", "rua", "avenida", "bairro", "município", "residente", "domiciliado")),
        Recognizer("TELEFONE", ((r"\(\d{2}\)\s?9?\d{4}[-\s]?\d{4}\b", 0.6), (r"\+55\s?\(?\d{2}\)?\s?9?\d{4}[-\s]?\d{4}\b", 0.7), (r"(?<!\d)\d{2}\s9?\d{4}[-\s]\d{4}(?!\d)", 0.4)), lambda v, d: cd.phone_valid(d), ("telefone", "tel", "fone", "celular", "whatsapp", "contato", "ramal", "telefone para contato", "tel.", "cel.")),
        Recognizer("EMAIL", ((r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.75),), lambda v, d: cd.email_valid(v), ("e-mail", "email", "correio eletrônico", "contato", "endereço eletrônico")),
        Recognizer("ENDERECO", ((rf"\b{_STREET}\s+[A-ZÁÂÃÀÉÊÍÓÔÕÚÇ][\w'ÁÂÃÀÉÊÍÓÔÕÚÇáâãàéêíóôõúç.\- ]{{2,60}},\s*(?:n[º°.]?\s*)?\d{{1,6}}", 0.5),), None, ("endereço", "residente", "domiciliado", "logradouro", "sede", "estabelecido", "com sede", "residente e domiciliado")),
    )
}


#: A pattern of bare digits: a run of so many, with no digit on either side.
_RUN = re.compile(r"\(\?<!\\d\)\\d\{(\d+)(?:,(\d+))?\}\(\?!\\d\)")
_SOLID = r"(?U)\S"
_HIT = "struct<start:int,end:int,entity:string,base:double,value:string>"
_ELEMENT = "struct<start:int,end:int,entity:string,first:double,score:double,note:string,told:boolean>"


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _hits_sql(body: str, chosen: tuple[Recognizer, ...]) -> str:
    """All matches of all patterns: array<_HIT>. Runs of digits are found once and dealt by their length."""
    parts, runs = [], []
    for r in chosen:
        for pattern, base in r.patterns:
            if run := _RUN.fullmatch(pattern):
                runs.append((int(run[1]), int(run[2] or run[1]), r.entity, float(base)))
            else:
                parts.append(f"transform({text.matches_sql(body, _FLAGS + pattern)}, h -> struct(h.start as start, h.end as end, '{r.entity}' as entity, {float(base)}d as base, h.value as value))")
    if runs:
        kinds = "array(" + ", ".join(f"struct({a} as least, {b} as most, '{e}' as entity, {x}d as base)" for a, b, e, x in runs) + ")"
        found = text.matches_sql(body, _FLAGS + rf"(?<!\d)\d{{{min(r[0] for r in runs)},{max(r[1] for r in runs)}}}(?!\d)")
        dealt = f"transform(filter({kinds}, k -> length(h.value) between k.least and k.most), k -> struct(h.start as start, h.end as end, k.entity as entity, k.base as base, h.value as value))"
        parts.append(f"flatten(transform({found}, h -> {dealt}))")
    return f"flatten(array({', '.join(parts)}))" if parts else f"cast(array() as array<{_HIT}>)"


def _weighed_sql(hits: str, column: str, chosen: tuple[Recognizer, ...]) -> str:
    """Hits with their score before and after the evidence, their note, and whether a word tells their shape."""
    checked = [r for r in chosen if r.validator]
    seen = f"transform({hits}, h -> struct(h.start as start, h.end as end, h.entity as entity, h.base as base, h.value as value, {text.ascii_digits_sql('h.value')} as plain, {resolve.window_sql(column, 'h.start')} as window))"
    valid = "case h.entity " + " ".join(f"when '{r.entity}' then {r.validator('h.plain', 'h.digits')}" for r in checked) + " else false end" if checked else "false"
    anchors = "map(" + ", ".join(f"'{r.entity}', array({_quoted(tuple(dict.fromkeys(map(dims.fold, r.anchors))))})" for r in chosen if r.anchors) + ")"
    near = f"exists(coalesce(element_at({anchors}, h.entity), array()), t -> contains(h.window, t))"
    told = resolve.told_sql("h.entity", "h.window")
    digits = f"transform({seen}, h -> struct(h.*, regexp_replace(h.plain, '[^0-9]', '') as digits))".replace("h.*", "h.start as start, h.end as end, h.entity as entity, h.base as base, h.plain as plain, h.window as window")
    facts = f"transform({digits}, h -> struct(h.start as start, h.end as end, h.entity as entity, h.base as base, h.plain rlike '[-./]' as masked, {valid} as valid, {near} as near, {told} as told))"
    free = _quoted(tuple(r.entity for r in chosen if not r.validator)) or "''"
    ambiguous = _quoted(tuple(r.entity for r in chosen if r.ambiguous)) or "''"
    score = f"case when h.entity in ({free}) then h.base when h.valid then if(h.entity in ({ambiguous}) and not h.near, {dims.AMBIGUOUS_SCORE}d, 1.0d) when h.masked then greatest(h.base, {dims.MASKED_SCORE}d) when h.near then greatest(h.base, {dims.ANCHORED_SCORE}d) end"
    note = f"if(h.entity in ({free}) or h.valid, cast(null as string), '{INVALID}')"
    return f"transform({facts}, h -> struct(h.start as start, h.end as end, h.entity as entity, if(h.valid, 1.0d, h.base) as first, {score} as score, {note} as note, h.told as told))"


def _uncontained_sql(spans: str, by: str) -> str:
    """Spans but those within one of their entity that ranks before them: higher `by`, then earlier, then longer."""
    within = "y.entity = x.entity and y.start <= x.start and y.end >= x.end"
    before = f"(y.{by} > x.{by} or (y.{by} = x.{by} and (y.start < x.start or (y.start = x.start and y.end > x.end))))"
    return f"filter({spans}, x -> not exists({spans}, y -> {within} and {before}))"


def _scanned(docs: DataFrame, chosen: tuple[Recognizer, ...], column: str, out: str, finish) -> DataFrame:
    """docs with `out`: of each cluster of overlapping hits what `finish` makes of those that the tiers leave."""
    mine = "_hits"
    while any(mine == c.lower() for c in docs.columns):
        mine += "_"
    weighed = resolve.clusters_sql(_weighed_sql(mine, f"`{column}`", chosen), _ELEMENT)
    left = f"transform({weighed}, c -> array_distinct(c))"
    left = f"transform({left}, c -> filter({_uncontained_sql('c', 'first')}, x -> x.score is not null))"
    whole = f"flatten({finish(left)})"
    hits = _hits_sql(f"`{column}`", chosen)
    at = docs.withColumn(mine, F.expr(f"if(`{column}` rlike {text.sql_string(_SOLID)}, {hits}, cast(array() as array<{_HIT}>))"))
    return text.with_bound(at, {out: F.expr(whole)}).drop(mine)


_PLAIN = "struct(x.start as start, x.end as end, x.entity as entity, x.score as score, x.note as note)"


def scan(docs: DataFrame, entity: str, *, column: str = "text", out: str = "spans") -> DataFrame:
    """Add `out`: array of SPAN, what one recogniser finds, with tiers applied. Null and blank texts have none."""
    return _scanned(docs, (RECOGNIZERS[entity],), column, out, lambda left: f"transform({left}, c -> transform(c, x -> {_PLAIN}))")


def detect(docs: DataFrame, *, column: str = "text", out: str = "spans", threshold: float = dims.THRESHOLD, entities: tuple[str, ...] | None = None) -> DataFrame:
    """Add `out`: what all recognisers find from the threshold on, told apart by anchors and with overlaps resolved.
    Null and blank texts have none. Spans that share no position do not touch each other's fate, so each step works
    within clusters of overlapping ones."""
    chosen = tuple(r for e, r in RECOGNIZERS.items() if entities is None or e in entities)

    def finish(left: str) -> str:
        kept = f"transform({left}, c -> {_uncontained_sql('c', 'score')})"
        kept = f"transform({kept}, c -> filter(c, x -> x.score >= {float(threshold)}d and x.end > x.start))"
        kept = f"transform({kept}, c -> {resolve.without_rivals_sql('c')})"
        return f"transform({kept}, c -> {resolve.greedy_sql('c')})"

    return _scanned(docs, chosen, column, out, finish)


def exploded(detected: DataFrame, *, spans: str = "spans", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a span: keys, start, end, entity, score, note."""
    return detected.select(*keys, F.inline_outer(spans)).where("start IS NOT NULL")
