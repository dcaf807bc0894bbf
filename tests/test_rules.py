import pytest
from pyspark.sql import functions as F

from noticeflow.operators import rules

CUP = "H74D25002610006"


def judge(spark, title, body, cup=CUP, clp=""):
    row = spark.createDataFrame([(title, "https://x.it/1", body, cup, clp)], "title string, url string, text string, cup string, clp string")
    return rules.with_rule_verdict(row).first().rule


@pytest.mark.parametrize("title, category, relevant", [
    ("Avviso di selezione esperti", "", True),
    ("l'accordo di concessione", "", True),
    ("Avviso corso di formazione", "", False),
    ("Avviso corso intelligenza artificiale", "", True),
    ("Menu della mensa", "Circolari", False),
    ("Bando", "D.M. 219", True),
])
def test_prefilter(spark, title, category, relevant):
    row = spark.createDataFrame([(title, category)], "t string, c string")
    assert row.select(rules.prefilter(F.col("t"), F.col("c")).alias("x")).first().x is relevant


def test_exact_code_is_high(spark):
    v = judge(spark, "Avviso pubblico", f"procedura di selezione CUP {CUP}")
    assert (v.is_match, v.confidence, v.opportunity_type) == (True, "high", "avviso pubblico")
    assert v.reason == (f"Identificativo di progetto esatto trovato ({CUP.lower()}) insieme a termini di bando "
                        "(avviso pubblico, procedura di selezione).")


def test_mixed_framing_is_ambiguous(spark):
    v = judge(spark, "Avviso pubblico", f"CUP {CUP} personale interno ed esperti esterni")
    assert (v.is_match, v.confidence, v.ambiguous) == (True, "medium", True)


def test_empty_codes_never_hit(spark):
    v = judge(spark, "Avviso pubblico", "procedura di selezione", cup="", clp="")
    assert not v.is_match and v.reason.startswith("Linguaggio di bando presente")


def test_context_needs_three_references(spark):
    two = judge(spark, "Avviso pubblico", "intelligenza artificiale, snodi formativi", cup="")
    three = judge(spark, "Avviso pubblico", "intelligenza artificiale, snodi formativi, m4c1i2.1", cup="")
    assert not two.is_match and "(2 riferimento/i)" in two.reason
    assert three.is_match and three.confidence == "medium"


def test_funding_decree_is_not_negative(spark):
    v = judge(spark, "Avviso pubblico", f"visto il decreto di assegnazione del finanziamento, CUP {CUP}")
    assert v.is_match


def test_role_between_the_words_is_negative(spark):
    v = judge(spark, "Decreto", "decreto di assegnazione al dirigente scolastico dell’incarico")
    assert not v.is_match and "decreto di assegnazione ... dell'incarico" in v.reason


def test_declaration_only_counts_in_the_title(spark):
    assert not judge(spark, "DICHIARAZIONE ASSENZA DI CONFLITTO DI INTERESSE", f"avviso pubblico {CUP}").is_match
    assert judge(spark, "Avviso pubblico esperti", f"{CUP} allegati: dichiarazione assenza di conflitto di interesse.pdf").is_match


def test_negative_words_deep_in_the_body_do_not_count(spark):
    body = f"CUP {CUP} " + "parola " * 400 + "seguendo l'ordine di graduatoria"
    assert judge(spark, "Avviso pubblico", body).is_match
    assert not judge(spark, "Avviso pubblico", "graduatoria " + body).is_match


@pytest.mark.parametrize("extra, reserved", [
    ("indire nuovo avviso oppure ricercare all'esterno; esterni", True),
    ("indire nuovo avviso oppure ricercare all'esterno; per esterni: partita iva", False),
    ("esigenza di ricorrere a soggetti esterni, in via subordinata", False),
    ("dipendente di altra P.A., ovvero se è esperto esterno", True),
])
def test_internal_only(spark, extra, reserved):
    v = judge(spark, "Avviso pubblico", f"CUP {CUP} riservato a personale interno. {extra}")
    assert v.reason.startswith("Selection appears reserved") is reserved


def test_gate(spark):
    rule = "struct<is_match:boolean,confidence:string,reason:string,opportunity_type:string,deadline:string,ambiguous:boolean>"
    medium, high = (True, "medium", "r", "t", "d", False), (True, "high", "r", "t", "d", False)
    mixed, none = (True, "medium", "r", "t", "d", True), (False, "low", "r", "t", "d", False)
    rows = [(1, medium, None, ""), (2, high, None, ""), (3, mixed, None, ""), (4, mixed, "x", "boom"), (5, medium, None, "boom"),
            (6, medium, "IGNORE | no", ""), (7, mixed, "MATCH | low | z", ""), (8, none, "MATCH", "")]
    df = spark.createDataFrame(rows, f"i int, rule {rule}, answer string, error string")
    out = {r.i: r for r in rules.with_gate(df).collect()}
    assert [out[i].gate_stage for i in range(1, 9)] == [
        None, None, "ai_unavailable_deferred_ambiguous", "ai_unavailable_deferred_ambiguous", None, "ai_rejected", None, "rule_rejected"]
    assert out[1].final.reason == "NON VERIFICATO DA AI - possibile opportunità basata solo sulle regole (AI non consultata - mode/budget/key). r"
    assert "(AI non disponibile: boom). r" in out[5].final.reason and out[2].final.reason == "r"
    assert (out[7].final.confidence, out[7].final.ai_used, out[7].final.deadline) == ("low", True, "non specificata")
    free = {r.i: r.gate_stage for r in rules.with_gate(df, verification_required=False).collect()}
    assert free[3] is None and free[4] is None


def test_callers_bring_their_own_lists(spark):
    from noticeflow import vocab

    df = spark.createDataFrame([("Bando zebra", "u", "testo zebra per tutti", "", "")], "title string, url string, text string, cup string, clp string")
    mine = vocab.own(CALL_CORE_TERMS=("zebra",), PROJECT_CONTEXT_TERMS=("testo", "tutti", "per"), STRONG_NEGATIVE_TERMS=(), NEGATIVE_TERMS=())
    assert not rules.with_rule_verdict(df).first().rule.is_match
    assert rules.with_rule_verdict(df, terms=mine).first().rule.is_match
    closed = vocab.own(CALL_CORE_TERMS=("zebra",), STRONG_NEGATIVE_TERMS=("bando",))
    assert not rules.with_rule_verdict(df, terms=closed).first().rule.is_match
    with pytest.raises(KeyError):
        vocab.own(NO_SUCH_LIST=())
