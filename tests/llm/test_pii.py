"""Personal information: sentences written by hand, apart from the generator and from the test tables."""

import re

import pytest

from gistmap.llm import pii

# (text with the true spans in braces: {kind|value})
HAND = """
Reach {name|Anna Kowalska} at her desk.
I met {name|José García} yesterday.
The patient, {name|Robert Miller}, arrived late.
Interview with {name|Laura Chen}
She married {name|David Jones} in 2010.
{name|Priya Sharma} and {name|Tom Becker} share an office.
We are sorry to hear that {name|Ingrid Larsen} has left the company.
Please forward this to {name|Ahmed Hassan} before Friday.
Photo: {name|Marta Nowak}
The keys are with {name|P. Lindqvist} until Monday.
Professor {name|Elena Rossi} gave the lecture.
Have you seen {name|Michael O'Brien} today?
The goal was scored by {name|Luis Fernández} in the last minute.
Kind regards,
{name|Hannah Weber}
Mein Onkel {name|Klaus Hoffmann} fährt Bus.
Ich habe {name|Sabine Krüger} im Supermarkt gesehen.
Der Vortrag von {name|Stefan Vogel} war gut besucht.
Hier wohnt {name|Lukas Baumgartner}.
Ma cousine {name|Camille Laurent} arrive demain.
Nous avons dîné avec {name|Pierre Moreau} samedi.
Le chèque est signé {name|Hélène Girard}.
Mi abuela {name|Carmen Navarro} cocina muy bien.
Hablé con {name|Diego Romero} por la tarde.
El premio fue para {name|Lucía Santos}.
{name|Yuki Tanaka} forgot an umbrella.
The report names {name|Dmitri Sokolov} as the driver.
Phone the plumber on {phone|(415) 555-2671} today.
You can text {phone|+1 212 555 0199} at night.
The help desk is {phone|1-800-555-0143}.
Mobile: {phone|07700 900461}
London office {phone|+44 20 7946 0018}
Ruf in der Praxis an: {phone|089/4521730}.
Meine Handynummer ist {phone|0171 2345678}.
Die Zentrale erreichen Sie unter {phone|+49 40 123456}.
Anmeldung telefonisch: {phone|030/901820}
Mon téléphone fixe : {phone|01 42 68 53 00}
Appelez le {phone|+33 6 12 34 56 78} après 18 h.
Mi móvil es {phone|612 345 678}.
Llama al {phone|+34 915 22 33 44} si llueve.
Call our branch in Milan, {phone|+39 02 1234 5678}, for help.
My sister's number is {phone|555-867-5309}.
Fax: {phone|+41 44 668 18 00}
Warsaw: {phone|+48 22 555 01 02}
Write to {email|jane.doe@company.com} first.
{email|support@help.example.org} answers within a day.
Meine Mailadresse: {email|m.schulz99@posteo.de}
Envoyez tout à {email|c.lefevre@univ-lyon.fr} avant lundi.
Escríbeme a {email|pablo_ruiz@correo.es}.
Contact {email|bob (at) site.example} for keys.
or {email|sales [at] shop [dot] example} if urgent
the old one, {email|k.ito@mail.co.jp}, bounced
{email|ANNA.K@FIRMA.PL} is spelled with capitals.
({email|x.y+z@web.dev})
Ask {email|office@city.gov}, not me.
My social security number is {id_number|123-45-6789}.
The tax office wrote to the person with ID {id_number|987 65 4321}.
National Insurance number {id_number|AB 12 34 56 C} is on the payslip.
Passport {id_number|C01X00T47} was stolen in Rome.
His passport number, {id_number|K1234567}, is on page two.
Steuer-Identifikationsnummer: {id_number|12 345 678 901}
Der Personalausweis {id_number|L01X00T47} läuft ab.
Mi DNI es {id_number|12345678Z}.
El NIE {id_number|X1234567L} sigue vigente.
Numéro de sécurité sociale : {id_number|1 84 12 76 451 089 46}
my tax id is {id_number|123456789} as you know
Her identity card shows {id_number|123 456 789}.
Codice fiscale {id_number|RSSMRA85T10A562S}
She moved into {address|14 Elm Close} last spring.
The bakery is at {address|221 Baker Street}.
Deliver it to {address|1600 Amphitheatre Parkway}, please.
His studio, {address|77 Massachusetts Ave}, is open on Sundays.
We meet at {address|350 Fifth Avenue, Suite 12} at ten.
{address|8 Kingsway Gardens} has been sold.
Das Paket liegt in der {address|Schillerstraße 12}.
Wir treffen uns {address|Am Markt 5}.
Die Praxis ist jetzt in der {address|Leopoldstr. 48}.
Er wohnt seit Jahren im {address|Birkenweg 3a}.
Unser Laden: {address|Berliner Straße 101}
J'habite au {address|7 Rue Victor Hugo}.
Le cabinet se trouve {address|15 bis, avenue de la République}.
Rendez-vous au {address|3 place Bellecour}.
Vivimos en la {address|Calle Mayor 21}.
La clínica está en {address|Avenida de América, 47}.
Il negozio è in {address|Via Garibaldi 9}.
"""

NOTHING = """
Order 4471982 was shipped on 2024-03-18.
The Doppler effect and the Fourier transform are in chapter 12.
We flew to New York and then to San Francisco.
Version 10.4.12 runs on port 8080.
The Golden Gate Bridge is closed on Monday.
Please open Visual Studio and press Run.
The result, 3.14159265, has nine digits.
Dieses Wochenende fahren wir an die Ostsee. Der Zug kostet 49 Euro.
Die Bundesregierung und der Bundestag beraten im Herbst.
Le Conseil Municipal se réunit mardi.
La Universidad Nacional abre en septiembre.
IPv4 192.168.10.25 and ISBN 978-3-16-148410-0
The package @angular/core has 12 files.
Between 1990 and 2005 there were 12345678 visitors.
In Open Source projects, Pull Requests are reviewed.
Happy Birthday! Merry Christmas! See You Soon.
"""


def hand_written():
    for line in re.split(r"\n(?=[^\n])", HAND.strip()):
        text, spans, at = "", set(), 0
        for m in re.finditer(r"\{(\w+)\|([^}]*)\}", line):
            text += line[at : m.start()]
            spans.add((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        yield text + line[at:], spans


@pytest.fixture(scope="module")
def detector():
    return pii.trained_detector(["Albrina", "Corvane"])


def test_sentences_written_by_hand(detector):
    cases = list(hand_written())
    hit, true, found, missed = {k: 0 for k in pii.KINDS}, {k: 0 for k in pii.KINDS}, {k: 0 for k in pii.KINDS}, []
    for (text, want), spans in zip(cases, detector.find_all([t for t, _ in cases])):
        for k in pii.KINDS:
            true[k] += sum(s[0] == k for s in want)
            found[k] += sum(s[0] == k for s in spans)
            hit[k] += sum(s[0] == k for s in want & set(spans))
        if want != set(spans):
            missed.append((text, [(k, text[a:b]) for k, a, b in spans]))
    print({k: f"{hit[k]}/{true[k]} found {found[k]}" for k in pii.KINDS}, *missed, sep="\n")
    assert all(hit[k] >= 0.9 * true[k] and hit[k] >= 0.9 * found[k] for k in pii.KINDS)


def test_nothing_personal(detector):
    lines = NOTHING.strip().split("\n")
    wrong = [(t, [(k, t[a:b]) for k, a, b in s]) for t, s in zip(lines, detector.find_all(lines)) if s]
    print(*wrong, sep="\n")
    assert len(wrong) <= 1


def test_training_texts_are_not_those_of_the_tables(small):
    import duckdb

    from gistmap.llm.pii_texts import POSITIVE

    texts = [r[0] for r in duckdb.sql(f"SELECT DISTINCT text FROM '{small}/../sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    whole = "\n".join(texts)
    for templates in POSITIVE.values():
        for t in templates:
            head, _, tail = t.partition("{}")
            if len(head.split()) >= 3:
                assert head.strip() not in whole, t
            if len(tail.split()) >= 3:
                assert tail.strip() not in whole, t


def test_a_long_list_of_names_is_joined_with_the_same_result(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    names = spark.read.parquet(f"{small}/given_names.parquet")
    d = pii.Detector(sorted(r.given_name for r in names.collect())).fit(1_500)
    one = pii._spans(docs, names, "text", False, detector=d).collect()
    d.given = frozenset()
    two = pii._spans(docs, names, "text", False, detector=d, max_names=5).collect()
    key = lambda rows: sorted((r.doc_id, tuple(map(tuple, r.spans))) for r in rows)
    assert key(one) == key(two)


def test_redaction(detector, spark):
    t = "My colleague Corvane Testman asked. Call me on +49 30 23125 118 or write to a.b@mail.example. Order no. 10741277."
    assert pii._redacted(t, detector.find_all([t])[0]) == "My colleague [NAME] asked. Call me on [PHONE] or write to [EMAIL]. Order no. 10741277."
    docs = spark.createDataFrame([(1, None), (2, ""), (3, t)], "doc_id bigint, text string")
    names = spark.createDataFrame([("Corvane",), (None,)], "given_name string")
    out = {r.doc_id: r.text for r in pii._spans(docs, names, "text", True, detector=detector).collect()}
    assert out[1] is None and out[2] == "" and "[PHONE]" in out[3]
    assert pii.found_spans(docs.limit(0), names).count() == 0
