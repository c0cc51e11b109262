import re

import pytest

from ionloom.llm import personal as P

GIVEN = ["Brendor", "Brengo", "Brenina", "Dardor", "Dargo", "Darina", "Nisdor", "Nisgo", "Nisina"]
FAMILY = ["Abracre", "Abramark", "Abrolm", "Caldracre", "Caldramark", "Caldrolm", "Wexlacre", "Wexlamark", "Emkolm", "Wexlill-Anz", "Abrill-Anz", "Caldrill-Anz"]
FINDER = P.Finder(P.Names(GIVEN, FAMILY))


def found(text):
    return {(s.kind, P.as_written(text[s.start : s.end])) for s in FINDER.spans(text)}


CASES = {
    "Reach a.b+c@mail.example or x_y [at] inbox.test or me at post dot example.": {("email", "a.b+c@mail.example"), ("email", "x_y [at] inbox.test"), ("email", "me at post dot example")},
    "The e-mail of t****@[...] was struck.": set(),
    "by telephone on +44 1632 960 335. 13. The": {("phone", "+44 1632 960 335")},
    "The number (731) 555-0175 appears, by telephone on 555-0109.": {("phone", "(731) 555-0175"), ("phone", "555-0109")},
    "gave the number 030/23125 341 and left": {("phone", "030/23125 341")},
    "The\nnumber 01 99 00 89\n79 appears": {("phone", "01 99 00 89 79")},
    "The sum of 01 900 000 crowns (file ref. 0387-824-38), Invoice 2035-118-77.": set(),
    "A number ending in ...21, account ***69, sheet 4471.": set(),
    "(identity no. QQ 32 38 68 C) and (Kennnummer QQ172545B)": {("id_number", "QQ 32 38 68 C"), ("id_number", "QQ172545B")},
    "personal number 972-14-9384, identity no. X35919311K, identity no. 665.532.504-11": {("id_number", "972-14-9384"), ("id_number", "X35919311K"), ("id_number", "665.532.504-11")},
    "card 4111 1111 1111 1111 and account GB82 WEST 1234 5698 7654 32": {("id_number", "4111 1111 1111 1111"), ("id_number", "GB82 WEST 1234 5698 7654 32")},
    "items 4111 1111 1111 1112 of the case": set(),
    "residing at Flat 17, 152c St Orla's Close, Blenbeck ZN24 1TK, gave": {("address", "Flat 17, 152c St Orla's Close, Blenbeck ZN24 1TK")},
    "found at 47 Lantern St.. The": {("address", "47 Lantern St.")},
    "at 63 Bellwether Ave. On appeal, 47 Lantern St., Marwick QX1 7LD until": {("address", "63 Bellwether Ave"), ("address", "47 Lantern St., Marwick QX1 7LD")},
    "page 1\n\n12 Regional Court Quillmere": set(),
    "See the map of Mill Lane and Harbour Row in Elmditch.": set(),
    "wohnhaft Mühlweg 180, 05711 Quillsund, wurde": {("address", "Mühlweg 180, 05711 Quillsund")},
    "domicilié au 136, avenue des Tanneurs, 16537 Elmhaven, a": {("address", "136, avenue des Tanneurs, 16537 Elmhaven")},
    "Before Judge Darina Wexlill-Anz": {("name", "Darina Wexlill-Anz")},
    "Brendor\nAbrolm v. Caldrolm & Sons GmbH": {("name", "Brendor Abrolm")},
    "Wexlacre, Nisgo at 1": {("name", "Wexlacre, Nisgo")},
    "W. Caldramark's account": {("name", "W. Caldramark")},
    "Dr. Wexlolm-Abracre was not": {("name", "Wexlolm-Abracre")},
    "A.B. v. C.D. Abrill-Anz, sitting alone": {("name", "Abrill-Anz")},
    "K. v. Wexlolm Brothers Ltd, [NAME] and [redacted] of Norrhaven": set(),
    "BRENINA ABRAMARK signed": {("name", "BRENINA ABRAMARK")},
    "Le courrier de M. Abrolm fut lu par la cour et les parties du litige": {("name", "Abrolm")},
}


@pytest.mark.parametrize("text", list(CASES))
def test_cases(text):
    assert found(text) == CASES[text]


def test_listed_names_of_any_length():
    finder = P.Finder(P.Names([*GIVEN, "Bo"], [*FAMILY, "Kim", "Ng", "Lee"]))
    got = {P.as_written(t) for text in ("Judge Kim sat.", "Brendor Lee and Bo Ng spoke.", "Ng, Brengo at 1", "the lee of Kim") for s in finder.spans(text) for t in [text[s.start : s.end]]}
    assert got == {"Kim", "Brendor Lee", "Bo Ng", "Ng, Brengo"}


@pytest.mark.parametrize("name", ["a" * 100, "x." * 200 + "y"])
def test_long_addresses_are_found_whole(name):
    mail = f"{name}@{'sub.' * 40}host.example"
    assert found(f"wrote to {mail}, then") == {("email", mail)}
    assert found(f"wrote to {mail}") == {("email", mail)}
    assert found("x" * 3000 + "@") == set()


def test_brackets_with_blanks():
    assert found("mail j.doe [ at ] host [ dot ] org now") == {("email", "j.doe [ at ] host [ dot ] org")}


def test_numbers_are_not_cut_at_the_end_of_what_is_seen():
    for pad in range(40):
        text = "telephone +44 1632 960 335" + "-" + "9" * pad + "x and so on"
        assert not any(v == "+44 1632 960 335" for _, v in found(text))


def test_amounts_are_no_numbers_to_call():
    assert found("call it 01 90 00 00 00 euros") == set()
    assert found("call 01 90 00 00 00 now") == {("phone", "01 90 00 00 00")}


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("GB82WEST12345698765432") and not P.mod97("GB82WEST12345698765433")
    assert P.two_check_digits("52998224725") and not P.two_check_digits("52998224726")
    assert P.letter_mod23("X1234567L") and not P.letter_mod23("X1234567A")


SCHEMA = "doc_id long, text string, kind string, found string"


def tables(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts], SCHEMA)
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, "given")], "name string, name_type string")
    return docs, names


def test_find_and_mask(spark):
    text = "Abrolm wrote to a@b.example. Abrolm and Brengo Abrolm live at 12 Mill Row, Elmfold. " + "Plain words. " * 50_000
    docs, names = tables(spark, [(1, text), (2, None), (3, ""), (1, "Abrolm")])
    got = sorted(tuple(r) for r in P.find_personal(docs, names).collect())
    assert got == [(1, "address", "12 Mill Row, Elmfold"), (1, "email", "a@b.example"), (1, "name", "Abrolm"), (1, "name", "Abrolm"), (1, "name", "Brengo Abrolm")]
    masked = {(r.doc_id, r.n_masked): r.text for r in P.mask_personal(docs, names).collect()}
    assert masked[(1, 5)].startswith("[NAME] wrote to [EMAIL]. [NAME] and [NAME] live at [ADDRESS]. Plain")
    assert masked[(2, 0)] is None and masked[(3, 0)] == "" and masked[(1, 1)] == "[NAME]"
    assert not re.search("Abrolm|a@b", masked[(1, 5)])


def test_long_name_lists_tell_the_same(spark):
    text = "Brendor\nAbrolm v. Caldrolm & Sons GmbH. Dr. Wexlolm-Abracre was not. W. Caldramark and Wexlill-Anz"
    docs, names = tables(spark, [(1, text), (2, None), (3, "Darina Emkolm")])
    want = {tuple(r) for r in P.find_personal(docs, names).collect()}
    got = P.find_personal(docs, names, name_limit=3).collect()
    assert len(want) > 3 and {tuple(r) for r in got} == want
    assert P.mask_personal(docs, names, name_limit=3).filter("doc_id = 3").first().text == "[NAME]"


def test_empty(spark):
    docs, names = tables(spark, [(1, "x")])
    assert P.find_personal(docs.limit(0), names).collect() == []
    assert P.find_personal(docs, names.limit(0)).collect() == []
    with pytest.raises(ValueError):
        P.load_names(names, limit=3)
