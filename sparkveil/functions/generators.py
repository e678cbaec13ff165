"""Synthetic identifiers as SQL expressions over a key, deterministic and without collisions of shape."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.functions import checkdigits as cd

# The area codes generated numbers use.
PHONE_AREAS = (11, 21, 31, 41, 51, 61, 71, 81, 85, 91, 47, 19)


def base(k: str, n: int, salt: int = 0) -> str:
    """n digits of the key, spread by a multiplier that is odd and prime to ten."""
    return f"lpad(cast(({k} * {7919 + 2 * salt * 5} + {104729001 + 31 * salt}) % {10**n} as string), {n}, '0')"


def _phone(k: str) -> str:
    """A mobile number for even keys, a landline for odd ones."""
    area = f"element_at(array({', '.join(repr(str(a)) for a in PHONE_AREAS)}), cast({k} % {len(PHONE_AREAS)} + 1 as int))"
    return f"concat({area}, if({k} % 2 = 0, concat('9', {base(k, 8, 9)}), concat(cast(2 + {k} % 4 as string), {base(k, 7, 9)})))"


def _with_check(head: str, check) -> str:
    return cd.bind(head, "b", f"concat(b, {check('b')})")


def made(k: str) -> dict[str, str]:
    """SQL of each entity's digits from a key."""
    tail = f"concat(cast(2015 + {k} % 12 as string), substr('12458', cast(1 + {k} % 5 as int), 1), lpad(cast(1 + {k} % 26 as string), 2, '0'), lpad(cast({k} % 10000 as string), 4, '0'))"
    process = cd.bind(f"concat({base(k, 7, 6)}, '00', {tail})", "x", f"concat(substr(x, 1, 7), lpad(cast({cd.cnj_check('x')} as string), 2, '0'), substr(x, 10))")
    return {
        "cpf": _with_check(base(k, 9), cd.cpf_check),
        "cnpj": _with_check(f"concat({base(k, 8, 1)}, '0001')", cd.cnpj_check),
        "pis_pasep": _with_check(base(k, 10, 2), cd.pis_check),
        "cnh": _with_check(base(k, 9, 3), cd.cnh_check),
        "titulo_eleitor": _with_check(f"concat({base(k, 8, 4)}, lpad(cast(1 + {k} % 28 as string), 2, '0'))", cd.titulo_check),
        "cns": _with_check(f"concat(cast(1 + {k} % 2 as string), {base(k, 10, 5)})", cd.cns_tail),
        "processo_cnj": process,
        "rg": _with_check(base(k, 8, 7), cd.rg_digit),
        "cep": base(k, 8, 8),
        "telefone": _phone(k),
    }


#: Entities with generated identifiers; each has a column of its name in lower case.
MADE = ("CPF", "CNPJ", "PIS_PASEP", "CNH", "TITULO_ELEITOR", "CNS", "PROCESSO_CNJ", "RG", "CEP", "TELEFONE")


def with_identifiers(df: DataFrame, key: str = "k") -> DataFrame:
    """Add a column of digits for each entity of MADE, from a key column. Columns that are not read are not made."""
    sql = made(f"`{key}`")
    return df.withColumns({e.lower(): F.expr(sql[e.lower()]) for e in MADE})


def broken(x: str) -> str:
    """The last digit moved on by one; X becomes 0."""
    head, last = f"substr({x}, 1, length({x}) - 1)", f"substr({x}, length({x}), 1)"
    return f"concat({head}, case when {last} = 'X' then '0' else cast((cast({last} as int) + 1) % 10 as string) end)"


def masked(x: str, mask: str) -> str:
    """Put the characters of x in place of the # of a mask, in order."""
    parts, i = [], 1
    for run in re.findall(r"#+|[^#]+", mask):
        if run[0] == "#":
            parts.append(f"substr({x}, {i}, {len(run)})")
            i += len(run)
        else:
            parts.append(f"'{run}'")
    return "concat(" + ", ".join(parts) + ")"


MASKS = {"CPF": "###.###.###-##", "CNPJ": "##.###.###/####-##", "PIS_PASEP": "###.#####.##-#", "PROCESSO_CNJ": "#######-##.####.#.##.####", "RG": "##.###.###-#", "CEP": "#####-###", "CNS": "### #### #### ####", "TITULO_ELEITOR": "#### #### ####"}
