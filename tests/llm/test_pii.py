import re
import time

import pytest

from quaymark.llm import pii

LISTED = [("Mira", "given"), ("Noemi", "given"), ("Pavel", "given"), ("Björn", "given"), ("Mark", "given"), ("Will", "given"), ("Tolvarin", "family"), ("O'Dunlary", "family"), ("van der Krooch", "family"), ("Birkwald-Toll", "family"), ("Shard", "family"), ("Lattice", "family")]
NAMES = pii.Names.of(LISTED)

CASES = [
    ("write to mira.tolvarin+x@dept.tolva.test now", [("email", "mira.tolvarin+x@dept.tolva.test")]),
    ("forward to quirin99[at]mail.example.net or mailto:hazel17 (at) brekmoor (dot) example", [("email", "quirin99[at]mail.example.net"), ("email", "hazel17 (at) brekmoor (dot) example")]),
    ("o hhollenbruck at example dot com ok", [("email", "hhollenbruck at example dot com")]),
    ("Use tidewater@4.2.1 and '@tidewater/core@2.1.0' cc @platform-crew @Override", []),
    ("tel:13035550190 and (904) 555-0198, +44 (0)20 7946 0711", [("phone", "13035550190"), ("phone", "(904) 555-0198"), ("phone", "+44 (0)20 7946 0711")]),
    ("call 030/23125915 or 01 99 00 84 49 or 0049 30 23125476.", [("phone", "030/23125915"), ("phone", "01 99 00 84 49"), ("phone", "0049 30 23125476")]),
    ("at +1 617‑555‑0137 KX-1389", [("phone", "+1 617‑555‑0137")]),
    ("batch 4412-88-12012 uuid 00000000-0000-4000-8000-000000000012 ip=10.8.0.4 price 1.555.019 units, version 030.23.1, Build 2025-03-25, ticket 555-0199", []),
    ("has SSN 910 03 3931 on file, ssn=929061968, 914-31-9878", [("id_number", "910 03 3931"), ("id_number", "929061968"), ("id_number", "914-31-9878")]),
    ("NINO QQ035575D and QQ 79 78 53 D, passport KW4139975, passport.js is outdated", [("id_number", "QQ035575D"), ("id_number", "QQ 79 78 53 D"), ("id_number", "KW4139975")]),
    ("lives at 66 Copperfield Row Court, Apt 24.", [("address", "66 Copperfield Row Court")]),
    ("Kunde wohnt Birkenhainstr. 196b. Am Alten Hof 149a", [("address", "Birkenhainstr. 196b"), ("address", "Am Alten Hof 149a")]),
    ("habite 28, rue des Ormeaux. vive en Avenida del Molino Viejo n.º 59", [("address", "28, rue des Ormeaux"), ("address", "Avenida del Molino Viejo n.º 59")]),
    ("12 Court filings and 7 Lane markers are test data.", []),
    ("Dr. Tolvarin and M. Birkwald-Toll, O'DUNLARY; Noemi", [("name", "Tolvarin"), ("name", "M. Birkwald-Toll"), ("name", "O'DUNLARY"), ("name", "Noemi")]),
    ("Reported by Tolvarin, Noemi and Pavel van der Krooch", [("name", "Tolvarin, Noemi"), ("name", "Pavel van der Krooch")]),
    ("Mark as solved. Will Shard splits help? Mark Lattice entries as stale.", []),
    ("Reported by Mark Lattice", [("name", "Mark Lattice")]),
    ("Mira el servicio", []),
    (None, []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_entities(text, want):
    assert [(e.kind, text[e.start : e.end]) for e in pii.find_all(text, NAMES)] == want


def test_positions_count_code_points():
    text = "🙏 日本 noemi@example.org"
    assert pii.find_all(text, NAMES)[0].start == 5


def test_placeholders_keep_the_rest():
    text = "Hi Noemi, call +1 617 555 0137 or Noemi's office: +1 617 555 0137"
    assert pii.placeholders(text, pii.find_all(text, NAMES)) == "Hi [NAME_1], call [PHONE_1] or [NAME_1]'s office: [PHONE_1]"
    assert pii.placeholders(None, []) is None and pii.placeholders("", []) == ""


def test_surrogates():
    s = pii.Surrogates(b"k", NAMES)
    text = "Pavel Tolvarin (PAVEL.TOLVARIN@TOLVA.TEST) +49 30 23125 783; pavel, SSN 910 03 3931; 28, rue des Ormeaux"
    out = s.text(text, pii.find_all(text, NAMES))
    assert out == s.text(text, pii.find_all(text, NAMES)) and "avel" not in out and "Ormeaux" not in out and "910 03" not in out
    assert re.search(r"\+49 \d\d \d{5} \d{3}; ", out) and "rue des " in out and ".TEST)" in out
    given = out.split()[0]
    assert given.istitle() and given.lower() in out.split("; ")[1]  # the same person again, in the other case
    assert pii.Surrogates.gender(given.lower()) == pii.Surrogates.gender("pavel")
    # different entities stay different
    assert len({s.digits(f"{i:05d}") for i in range(100_000)}) == 100_000
    words = [t.split()[-1].lower() for t, _ in LISTED]
    assert len({s.word(w) for w in words}) == len(set(words)) and all(s.word(w) != w for w in words)
    assert pii.Surrogates(b"other", NAMES).digits("910033931") != s.digits("910033931")


def test_an_initial_fits_the_surrogate_of_its_name():
    s = pii.Surrogates(b"k", pii.Names.of([*LISTED, ("Зоя", "given"), ("Éloi", "given")]))
    for token in ("noemi", "pavel", "зоя", "éloi"):
        assert s.word(token)[0] == s.word(token[0]) != token[0]
    whole, short = s.replace("name", "Pavel Tolvarin"), s.replace("name", "P. Tolvarin")
    assert short == f"{whole[0]}. {whole.split()[1]}"


def test_thousands_of_entities_take_linear_time():
    one = "call +1 617 555 0137, Noemi Tolvarin; "
    pii.find_all(one * 50, NAMES)
    took = []
    for n in (1000, 4000):
        start = time.perf_counter()
        assert len(pii.find_all(one * n, NAMES)) == 2 * n
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0]


def test_ordinary_words_after_that_are_no_names():
    names = pii.Names.of([*LISTED, ("Will", "given"), ("Rose", "given")])
    assert pii.find_all("with E-1, debug that Will this break batch 44? Rose from 12 to 40 retries.", names) == []
    assert [e.start for e in pii.find_all("it told Will about row 3", names)] == [8]


def test_long_names_are_whole():
    text = "by Noemi Pavel Noemi Pavel Noemi Pavel Noemi Tolvarin."
    assert [(e.start, e.end) for e in pii.find_all(text, NAMES)] == [(3, len(text) - 1)]


def test_different_words_stay_different():
    names = pii.Names.of([*LISTED, ("Зоя", "given")])
    names.add("crathmoor", "family")
    s = pii.Surrogates(b"k", names)
    abc = "abcdefghijklmnopqrstuvwxyz"
    assert len({s.replace("name", f"{c}. Tolvarin") for c in abc.upper()}) == 26
    assert all(s.word(c) != c for c in abc)
    short = [a + b + c for a in abc for b in abc for c in ("", *abc)]
    assert len({s.replace("email", f"{w}@a.test") for w in short}) == len(short)
    assert len({s.replace("email", f"me@{w}.test") for w in short}) == len(short)
    streets = short + [w + e for w in short[:700] for e in ("weg", "str", "platz")]
    assert len({s.replace("address", f"12 {w} Street") for w in streets}) == len(set(streets))
    # listed, learned and coined names among other words
    words = set(short) | set(names.kinds) | set(s.map.values())
    assert len({s.word(w) for w in words}) == len(words)
    # the script stays, and so does the form of a host
    assert all("\u0400" <= c <= "\u04ff" for w in ("мир", "Зоя", "Я") for c in s.word(w))
    assert "é" != s.word("É").lower() and not s.word("É").isascii()
    assert re.fullmatch(r"\w+@[a-z]{4}\d-[a-z]{2}\.test", s.replace("email", "me@mail7-eu.test"))


def test_names_are_completed_from_the_corpus(spark):
    texts = [f"Reported by Noemi Crathmoor about row {i}" for i in range(4)] + ["Please look. Please wait."] * 5 + [None, ""]
    df = spark.createDataFrame([("t", i, t, 1) for i, t in enumerate(texts)], "src_table string, src_id long, text string, pii_type int")
    names = pii.learn_names(df, LISTED)
    assert names.learned == {"crathmoor"}
    rows = pii.detect(spark.createDataFrame([("t", 1, "ask CRATHMOOR", 1), (None, None, "Crathmoor, Noemi", 2)], df.schema), names, b"k").collect()
    assert sorted((r["src_id"] or 0, r["pii_type"], r["start_pos"]) for r in rows) == [(0, "name", 0), (1, "name", 4)]
    assert pii.detect(df.limit(0), names, b"k").collect() == []
    whole = {(r["src_id"], r["start_pos"]): r["surrogate"] for r in pii.detect(df, names, b"k").collect()}
    assert whole[(0, 12)] in pii.replace(df, names, b"k").where("src_id = 0").first()["surrogate"]
    out = {r["src_id"]: r for r in pii.replace(df, names, b"k").collect()}
    assert len(out) == len(texts) and out[4]["redacted"] == texts[4] and out[9]["redacted"] is None and out[0]["redacted"] == "Reported by [NAME_1] about row 0"


def test_what_stands_around_names_is_learned(spark):
    known = ["Noemi", "Pavel", "Björn", "Tolvarin", "Pemberlow"]
    listed = [*LISTED, ("Pemberlow", "family"), ("Reed", "family")]
    texts = [f"We escorted {known[i % 5]} downstairs at noon" for i in range(20)] + [f"We escorted Okafor downstairs, row {i}" for i in range(3)] + ["We escorted Monday downstairs"] + [f"The Reed bends, {i}" for i in range(30)] + ["The lock stays. The rest is fine."] * 40 + [None, ""]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "src_table string, src_id long, text string")
    names = pii.learn_names(df, listed)
    assert "escorted " in names.left and " downstairs" in names.right and "okafor" in names.learned and "monday" not in names.learned
    assert "reed" in names.ordinary and "noemi" not in names.ordinary
    found = pii.find_all("Then we escorted Okafor downstairs. The Reed bends. They escorted Reed downstairs.", names)
    assert [e.start for e in found] == [17, 66]


def test_very_long_text():
    text = "word 12 " * 100_000 + "Noemi Tolvarin"
    assert [(e.kind, e.start) for e in pii.find_all(text, NAMES)] == [("name", 800_000)]
