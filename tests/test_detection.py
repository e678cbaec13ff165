import pytest

from sparkveil.functions import dims
from sparkveil.operators import recognizers, resolve

FILLER = "Este trecho ocupa a janela inteira com palavras comuns. "
TEXTS = [
    ("CPF", "Pagamento referente a 529.982.247-25 na conta corrente.", [(1.0, None)]),
    ("CPF", "Registro 52998224725 arquivado.", [(1.0, None)]),
    ("CPF", "Consta no cadastro o número 529.982.247-26 sem conferência.", [(0.6, recognizers.INVALID)]),
    ("CPF", "CPF: 52998224726", [(0.45, recognizers.INVALID)]),
    ("CPF", "CPF/MF sob o nº 52998224726", [(0.45, recognizers.INVALID)]),
    ("CPF", "Nota fiscal 52998224726 emitida em janeiro.", []),
    ("CPF", "Protocolo 20260830112 e Processo 12345678901", []),
    ("CPF", "CPF " + 2 * FILLER + "52998224726", []),
    ("CPF", "Chave PIX: 12345678900", [(0.45, recognizers.INVALID)]),
    ("CNPJ", "Chave PIX: 61904327000118", [(0.45, recognizers.INVALID)]),
    ("CNPJ", "Tela de 1920 pixels. Codigo 61904327000118 do lote.", []),
    ("CNH", "Número 96510020000 no rodapé", [(0.2, None)]),
    ("CNH", "Habilitação 96510020000", [(1.0, None)]),
    ("TELEFONE", "telefone (11) 98765-4321", [(1.0, None)]),
    ("TELEFONE", "ligue (00) 98765-4321", [(0.6, recognizers.INVALID)]),
    ("EMAIL", "fulano@exemplo.com.br", [(1.0, None)]),
    ("EMAIL", "fulano@exemplo..com", [(0.75, recognizers.INVALID)]),
    ("CEP", "CEP 01310-100", [(0.5, None)]),
    ("RG", "RG 12.345.678", []),
    ("ENDERECO", "residente na Rua das Flores, nº 123, centro", [(0.5, None)]),
    ("ENDERECO", "residente na Rua das Flores,\u00a0123, centro", [(0.5, None)]),
    ("CPF", "Pagamento a ٥٢٩.٩٨٢.٢٤٧-٢٥ hoje", [(1.0, None)]),
    ("CPF", "Pagamento a ５２９９８２２４７２５ hoje", [(1.0, None)]),
    ("CPF", "CPF\u00a052998224726", [(0.45, recognizers.INVALID)]),
    ("CNH", "HABILITAC\u0327A\u0303O 96510020000", [(1.0, None)]),
]


@pytest.mark.parametrize("entity", sorted({e for e, _, _ in TEXTS}))
def test_evidence_tiers(spark, entity):
    rows = [(i, text) for i, (e, text, _) in enumerate(TEXTS) if e == entity]
    out = recognizers.scan(spark.createDataFrame(rows, "doc_id int, text string"), entity).collect()
    for r in out:
        want = TEXTS[r["doc_id"]][2]
        assert [(s["score"], s["note"]) for s in r["spans"]] == want, r["text"]
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(r["text"])


def test_offsets_count_code_points(spark):
    text = "😀 CPF 529.982.247-25 e 111.444.777-35"
    spans = recognizers.scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), "CPF").first()["spans"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["529.982.247-25", "111.444.777-35"]


def test_detect_whole_text(spark):
    text = "Maria, CPF nº 529.982.247-25, CNPJ/MF 11.222.333/0001-81, fulano@exemplo.com.br, tel (11) 98765-4321."
    rows = [(1, text), (2, "   "), (3, None)]
    out = {r["doc_id"]: r["spans"] for r in recognizers.detect(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [(s["entity"], text[s["start"] : s["end"]]) for s in out[1]] == [("CPF", "529.982.247-25"), ("CNPJ", "11.222.333/0001-81"), ("EMAIL", "fulano@exemplo.com.br"), ("TELEFONE", "(11) 98765-4321")]
    assert out[2] == [] and out[3] == []


def spans_frame(spark, text, spans):
    return spark.createDataFrame([(1, text, spans)], "doc_id int, text string, spans array<struct<start:int,end:int,entity:string,score:double,note:string>>")


@pytest.mark.parametrize(
    ("before", "kept"),
    [("CNH n ", ["CNH"]), ("PIS/PASEP: ", ["PIS_PASEP"]), ("Numero de referencia ", ["CPF", "CNH", "PIS_PASEP"]), ("CPF/CNH ", ["CPF", "CNH", "PIS_PASEP"]), ("HABILITAÇÃO n ", ["CNH"]), ("CNH" + " " * 80, ["CPF", "CNH", "PIS_PASEP"])],
)
def test_anchors_tell_shapes_apart(spark, before, kept):
    spans = [(len(before), len(before) + 11, e, 1.0, None) for e in ("CPF", "CNH", "PIS_PASEP")]
    out = resolve.disambiguate(spans_frame(spark, before + "22393559907", spans)).first()["spans"]
    assert sorted(s["entity"] for s in out) == sorted(kept)


def test_overlaps_go_by_precedence(spark):
    spans = [(50, 60, "EMAIL", 0.7, None), (0, 14, "CPF", 1.0, None), (5, 20, "PERSON", 0.9, None), (55, 70, "PERSON", 0.9, None)]
    out = resolve.resolve(spans_frame(spark, "x" * 80, spans)).first()["spans"]
    assert [(s["start"], s["end"], s["entity"]) for s in out] == [(0, 14, "CPF"), (50, 60, "EMAIL")]
    assert resolve.only(spans_frame(spark, "x", [(0, 1, "ORGANIZATION", 0.9, None)])).first()["spans"] == []


def test_vocabulary():
    assert len(dims.NAMES) == 16 and dims.WEIGHT["CPF"] == 16 and dims.WEIGHT["DATE_TIME"] == 1 and len(dims.REDACTED) == 13
    assert dims.fold("HABILITAÇÃO Nº") == "habilitacao no"


def test_two_thousand_spans_in_a_text(spark):
    text = "".join(f"CPF 529.982.247-25, CEP 01310-{i % 1000:03d}; " for i in range(1000))
    found = recognizers.detect(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    spans = found.first()["spans"]
    assert len(spans) == 2000 and all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:]))
    assert {text[s["start"] : s["end"]] for s in spans if s["entity"] == "CPF"} == {"529.982.247-25"}


def test_plan_of_detection_stays_small_and_filters_are_not_copied(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    found = recognizers.detect(docs).where("size(spans) > 0 AND doc_id > 0")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 15 and len(plan) < 50_000
    assert plan.index("size(spans") < plan.index("inline") < plan.rindex("doc_id")


def test_blank_texts_of_any_white_space(spark):
    rows = [(1, "\n\t \u00a0"), (2, ""), (3, None)]
    assert all(r["spans"] == [] for r in recognizers.detect(spark.createDataFrame(rows, "doc_id int, text string")).collect())
