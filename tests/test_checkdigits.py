import pytest
from pyspark.sql import functions as F

from sparkveil.functions import checkdigits as cd
from sparkveil.functions import generators as g

CASES = {
    cd.cpf_valid: {"52998224725": True, "11144477735": True, "52998224726": False, "11111111111": False, "00000000000": False, "1234567890": False, "123456789012": False, "": False},
    cd.cnpj_valid: {"11222333000181": True, "11222333000182": False, "00000000000000": False, "1122233300018": False},
    cd.pis_valid: {"52998224726": True, "22393559907": False},
    cd.cnh_valid: {"22393559907": True, "96510020000": True, "52998224725": False},
    cd.area_valid: {"11": True, "85": True, "00": False, "20": False, "123": False},
    cd.phone_valid: {"11987654321": True, "5511987654321": True, "1132654321": True, "11887654321": False, "00987654321": False, "1192654321": False, "119": False},
    cd.email_valid: {"a@b.co": True, "a@b..co": False, "a@.b.co": False, "a..b@c.de": False, "ab": False},
    cd.cnj_valid: {"00012341320208260100": True, "00012345620208260100": False},
}


@pytest.mark.parametrize("check", CASES, ids=lambda f: f.__name__)
def test_known_values(spark, check):
    rows = spark.createDataFrame([(x,) for x in CASES[check]], "x string")
    assert {r["x"]: r["ok"] for r in rows.select("x", F.expr(check("x")).alias("ok")).collect()} == CASES[check]


VALID = {"CPF": cd.cpf_valid, "CNPJ": cd.cnpj_valid, "PIS_PASEP": cd.pis_valid, "CNH": cd.cnh_valid, "TITULO_ELEITOR": cd.titulo_valid, "CNS": cd.cns_valid, "PROCESSO_CNJ": cd.cnj_valid, "RG": cd.rg_valid}


def test_generated_identifiers_validate_and_mutated_ones_fail(spark):
    people = g.with_identifiers(spark.range(1, 2001).withColumnRenamed("id", "k"))
    for entity, check in VALID.items():
        c = entity.lower()
        row = people.agg(F.count_if(F.expr(check(c))).alias("ok"), F.count_if(F.expr(check(g.broken(c)))).alias("bad"), F.countDistinct(c).alias("n")).first()
        assert (row["ok"], row["bad"]) == (2000, 0), entity
        assert row["n"] > 1990, entity


def test_masks(spark):
    row = spark.createDataFrame([("52998224725",)], "x string").select(F.expr(g.masked("x", g.MASKS["CPF"])).alias("m")).first()
    assert row["m"] == "529.982.247-25"


def test_rg_with_letter(spark):
    found = spark.range(1, 400).withColumnRenamed("id", "k").transform(g.with_identifiers).where("rg like '%X'")
    assert found.count() > 0 and found.where(F.expr(f"not {cd.rg_valid('rg')}")).count() == 0
