"""Check digits as SQL expressions over a string of digits.

Each function takes the text of a SQL expression and returns the text of another, so the algebra stays in Catalyst (no
UDF) and can stand inside lambda functions too. What is used twice is bound once: digits are an array made by one
`split`, sums are fields of a struct, so expressions grow with the rules and not with their nesting.
"""

from __future__ import annotations

from collections.abc import Sequence

from sparkveil.functions.dims import AREA_CODES


def bind(x: str, name: str, body: str) -> str:
    """body, in which `name` stands for x, worked out once."""
    return f"element_at(transform(array({x}), {name} -> {body}), 1)"


def digits(x: str) -> str:
    return f"transform(split({x}, ''), c -> try_cast(c as int))"


def weighted(d: str, weights: Sequence[int]) -> str:
    """The weighted sum of an array of digits; weights beyond its length count nothing."""
    return f"aggregate(zip_with({d}, array({', '.join(map(str, weights))}), (p, w) -> coalesce(p * w, 0)), 0, (t, v) -> t + v)"


def mod11(total: str) -> str:
    """Remainders 0 and 1 give 0, others 11 minus the remainder."""
    return f"if({total} % 11 < 2, 0, 11 - {total} % 11)"


def capped(total: str) -> str:
    """The remainder by 11, with 10 as 0."""
    return f"{total} % 11 % 10"


def repeated(x: str) -> str:
    """All digits the same; false for the empty string."""
    return f"({x} <> '' and {x} = repeat(substr({x}, 1, 1), length({x})))"


# Weights of the sums.
CPF_1, CPF_2 = range(10, 1, -1), range(11, 2, -1)
CNPJ_1, CNPJ_2 = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3)
PIS = (3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
CNS = range(15, 0, -1)
CNH_1, CNH_2 = range(9, 0, -1), range(1, 10)
TITULO_1, TITULO_2 = range(2, 10), (0, 0, 0, 0, 0, 0, 0, 0, 7, 8)
RG = range(2, 10)


def _two(b: str, first: Sequence[int], second: Sequence[int], own: int, rule) -> str:
    """Two check digits: a rule of the first sum, and of the second sum with the first digit `own` times."""
    sums = bind(digits(b), "d", f"struct({weighted('d', first)} as a, {weighted('d', second)} as b)")
    return bind(bind(sums, "s", f"struct({rule('s.a')} as v, s.b as b)"), "s", f"concat(cast(s.v as string), cast({bind(f's.b + {own} * s.v', 't', rule('t'))} as string))")


def cpf_check(b: str) -> str:
    """The check digits of nine digits."""
    return _two(b, CPF_1, CPF_2, 2, mod11)


def cnpj_check(b: str) -> str:
    """The check digits of twelve digits."""
    return _two(b, CNPJ_1, CNPJ_2, 2, mod11)


def titulo_check(b: str) -> str:
    """The check digits of eight digits and the state's two."""
    return _two(b, TITULO_1, TITULO_2, 9, capped)


def pis_check(b: str) -> str:
    """The check digit of ten digits."""
    return bind(weighted(digits(b), PIS), "t", f"cast({mod11('t')} as string)")


def cnh_check(b: str) -> str:
    """The check digits of nine digits. A first remainder of 10 is 0 and takes 2 off the second; what is then negative
    wraps, 10 is 0."""
    sums = bind(digits(b), "d", f"struct({weighted('d', CNH_1)} % 11 as a, {weighted('d', CNH_2)} % 11 as b)")
    second = bind("s.b - if(s.a >= 10, 2, 0)", "t", "if(t < 0, t + 11, t) % 11 % 10")
    return bind(sums, "s", f"concat(cast(if(s.a >= 10, 0, s.a) as string), cast({second} as string))")


def cns_tail(b: str) -> str:
    """The last four digits after eleven: 000 and a check digit; where that is 10, 001 and the digit after two more in
    the sum."""
    return bind(weighted(digits(b), CNS), "t", "if((11 - t % 11) % 11 = 10, concat('001', cast((11 - (t + 2) % 11) % 11 as string)), concat('000', cast((11 - t % 11) % 11 as string)))")


def cnj_check(x: str) -> str:
    """98 minus the number with its check digits moved to the end as zeros, modulo 97. x: 20 digits."""
    return f"(98 - cast(cast(concat(substr({x}, 1, 7), substr({x}, 10, 11), '00') as decimal(38, 0)) % 97 as int))"


def rg_digit(b: str) -> str:
    """The check character of eight digits."""
    return bind(weighted(digits(b), RG), "t", "if(t % 11 = 10, 'X', cast(t % 11 as string))")


def _valid(x: str, n: int, test: str) -> str:
    """test of x, bound as `x`, for n digits that are not all the same."""
    return bind(x, "x", f"if(x rlike '^[0-9]{{{n}}}$' and not {repeated('x')}, {test}, false)")


def cpf_valid(x: str) -> str:
    return _valid(x, 11, f"{cpf_check('substr(x, 1, 9)')} = substr(x, 10)")


def cnpj_valid(x: str) -> str:
    return _valid(x, 14, f"{cnpj_check('substr(x, 1, 12)')} = substr(x, 13)")


def cns_valid(x: str) -> str:
    return _valid(x, 15, f"substr(x, 1, 1) in ('1', '2', '7', '8', '9') and {weighted(digits('x'), CNS)} % 11 = 0")


def pis_valid(x: str) -> str:
    return _valid(x, 11, f"{pis_check('substr(x, 1, 10)')} = substr(x, 11)")


def cnh_valid(x: str) -> str:
    return _valid(x, 11, f"{cnh_check('substr(x, 1, 9)')} = substr(x, 10)")


def titulo_valid(x: str) -> str:
    return _valid(x, 12, f"cast(substr(x, 9, 2) as int) between 1 and 28 and {titulo_check('substr(x, 1, 10)')} = substr(x, 11)")


def cnj_valid(x: str) -> str:
    return bind(x, "x", f"if(x rlike '^[0-9]{{20}}$', {cnj_check('x')} = cast(substr(x, 8, 2) as int), false)")


def rg_valid(value: str) -> str:
    """Of a document number as written, in the one form that has a known check digit; other forms fail."""
    plain = "upper(replace(replace(x, '.', ''), '-', ''))"
    form = "^[0-9]{2}[.]?[0-9]{3}[.]?[0-9]{3}-?[0-9Xx]$"
    return bind(value, "x", f"if(x rlike '{form}', " + bind(plain, "y", f"{rg_digit('substr(y, 1, 8)')} = substr(y, 9, 1)") + ", false)")


def area_valid(x: str) -> str:
    return f"(length({x}) = 2 and {x} in ({', '.join(repr(str(c)) for c in AREA_CODES)}))"


def phone_valid(x: str) -> str:
    """Ten or eleven digits after the country's, with an area code in use; eleven start with 9, ten with 2 to 5."""
    own = bind(x, "x", "if(x like '55%' and length(x) in (12, 13), substr(x, 3), x)")
    return bind(own, "x", f"((length(x) = 11 and substr(x, 3, 1) = '9') or (length(x) = 10 and substr(x, 3, 1) in ('2', '3', '4', '5'))) and {area_valid('substr(x, 1, 2)')}")


def email_valid(value: str) -> str:
    """No double dot, and a domain that neither starts nor ends with a dot."""
    domain = "substring_index(x, '@', -1)"
    return bind(value, "x", f"(x like '%@%' and x not like '%..%' and {domain} like '%.%' and {domain} not like '.%' and {domain} not like '%.')")
