"""Seeded synthetic texts with labelled personal information, for training.

Sentences are put together from openings, verbs and places that take a value of any kind in free positions, in English,
German, French and Spanish, and from sentences whose numbers, codes and capitalised words are nothing personal. They
are written for training and are not sentences of any table.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")

# Given names that are common in several countries, and family names.
GIVEN = "Anna Maria José Robert Laura David Tom Peter Paul Mary John James Michael Sarah Emma Sophie Julia Lena Lukas Jonas Felix Max Hans Karl Klaus Jürgen Wolfgang Sabine Petra Monika Ursula Jean Pierre Marie Claire Luc Camille Chloé Antoine François Hélène Nicolas Juan Carlos Luis Miguel Javier Carmen Lucía Sofía Elena Pablo Diego Pedro Antonio Ana Giulia Marco Luca Giovanni Francesca Paolo Sven Lars Erik Ingrid Astrid Olga Ivan Dmitri Natasha Sergei Piotr Katarzyna Jan Zofia Ahmed Mohammed Fatima Ali Omar Aisha Yusuf Layla Wei Li Mei Jun Yuki Hiroshi Kenji Sakura Priya Raj Arjun Ananya Vikram Min Ji Daniel Thomas William George Edward Henry Charles Alice Helen Grace Lucy Oliver Jack Harry Emily Olivia Jessica Ashley Brian Kevin Steven Mark Andrew Matthew Joshua Rachel Hannah Rebecca Nina Eva Clara Ida Nora Leo Noah Liam Mia Zoe Ben Sam Kim Alex Martin Simon Philipp Stefan Andreas Christian Markus".split()
FAMILY = "Smith Jones Miller Brown Taylor Wilson Davies Evans Walker Wright Hughes Murphy Kelly Martin Schmidt Müller Becker Weber Wagner Hoffmann Schulz Krüger Vogel Lehmann Kowalski Kowalska Nowak Wiśniewska Novák Svoboda Horváth Nagy Popescu Ionescu García Fernández López Martínez Sánchez Pérez Romero Navarro Silva Santos Oliveira Pereira Rossi Russo Ferrari Bianchi Esposito Dubois Lefèvre Moreau Laurent Girard Fontaine Mercier Andersson Johansson Hansen Nielsen Larsen Virtanen Korhonen Ivanov Petrova Sokolov Smirnova Yılmaz Demir Kaya Chen Wang Zhang Liu Tanaka Suzuki Yamamoto Kim Park Nguyen Tran Patel Singh Gupta Sharma Hassan Khan Haddad Okafor Mensah Abebe O'Brien O'Connor McDonald MacLeod Cohen Levy Peeters Jansen Bakker".split()
_SYL = "ba be bri ca co da del dor el fa fen gal hal in jor ka kel la lin ma mor na nel or pa per qui ra ren sa sel ta tor u val wen yor za".split()
_ENDS = "berg mann stein ford ton worth ski ska sen son ez ini elli ova quist holm wood field shaw well hurst mark din brandt".split()
# People named by what they are to somebody.
ROLES = {
    "en": "friend boss sister brother uncle aunt neighbour teacher doctor lawyer assistant landlord trainer colleague cousin".split(),
    "de": "Freund Freundin Chef Chefin Schwester Bruder Onkel Tante Nachbar Nachbarin Lehrer Lehrerin Ärztin Anwalt Kollege Kollegin Vermieter Cousine Trainer".split(),
    "fr": "ami amie chef sœur frère oncle tante voisin voisine professeur avocate collègue cousin médecin".split(),
    "es": "amigo amiga jefe jefa hermana hermano tío tía vecino vecina profesora abogado colega primo médica".split(),
}
# Nouns of things that carry names, and words that begin names of things.
THINGS = "Valley Method Theorem Filter Museum University College Institute Hotel Bridge Park Library Station Airport River Lake Mountain Island Church School Hospital Company Group Foundation Prize Award Project Server Studio Dashboard Framework Protocol Schema Engine Manager Editor Suite Cloud Store Market Theatre Festival Cup League Army Council Court Effect Law Principle Test Index Scale Cycle Rectifier Amplifier Transform Distribution Process Chain Tree Sort Search Table Map Code Score".split()
_NOUNS = "Haushalt Packliste Wörterbuch Fahrplan Rezept Garten Fenster Rechnung Vertrag Schlüssel Bildschirm Tastatur Datei Ordner Messung Ergebnis Vergleich Werkzeug Anleitung Zutat Temperatur Mischung Stunde Woche Reise Koffer Wohnung Miete Steuer Prüfung Aufgabe Lösung Gleichung Kurve Schleife Liste Tabelle Spalte Zeile Speicher Netzwerk Drucker Pflanze Boden Wasser Muskel Übung Pause Schlaf Absatz Satz Titel Quelle".split()
_WORDS = "river stone garden paper window simple morning engine letter market copper silver forest bridge violet winter summer little common number answer table chair light sound water cloud plate report budget printer invoice".split()
_STREETS = "Elm|Oak|Maple|Birch|Cedar|Willow|Church|Station|Mill|Park|High|King|Queen|Victoria|Harbour|Meadow|River|Hill|Orchard|Juniper|Lincoln|Franklin|Jefferson|Kingfisher|Stone Hill|Old Ferry|Long Meadow|North Gate|Market|Saint Mary".split("|")
_TYPES = "Street St. Avenue Ave Road Rd Lane Ln Boulevard Blvd Court Ct Drive Way Place Terrace Square Close Crescent Gardens Grove Hill Row Walk Mews Parkway Circle Trail".split()
_DE = "Ahornfeld Buchenhain Lindenhof Sonnenberg Rosengarten Tannenbach Haupt Schiller Goethe Bahnhof Garten Berg Wald Kirch Schul Mozart Eichen Mühlen".split()
_FR = "des Vieux Tilleuls|du Grand Pont|de la Croix Verte|des Trois Moulins|du Lac Bleu|de la Source|Victor Hugo|Pasteur|de la République|du Général Leclerc|Jean Jaurès|de l'Église|d'Alsace|des Lilas|Saint-Michel".split("|")
_ES = "de la Rosa|del Puente Nuevo|de los Olmos|Monte Claro|de la Sierra Alta|del Prado|Mayor|Cervantes|de Alcalá|de la Constitución|San Juan|Real|de las Flores".split("|")
_IT = "Roma|Garibaldi|Giuseppe Verdi|Dante Alighieri|della Libertà|San Marco|Mazzini".split("|")


def _street(r: random.Random) -> str:
    """One to three words."""
    x = r.random()
    if x < 0.5:
        return r.choice(_STREETS)
    second = r.choice("Hill Gate Mill Ferry Meadow Bridge Field Wood Lake Quarry Ridge Bay".split())
    first = r.choice("Old North South East West Upper Lower New Long Great Saint Black White".split())
    return f"{first} {second}" if x < 0.75 else f"{r.choice(_STREETS).split()[0]} {second}" if x < 0.85 else _name_word(r) if x < 0.95 else f"{first} {r.choice(_STREETS).split()[0]} {second}"


def _name_word(r: random.Random, n: int | None = None) -> str:
    return "".join(r.choice(_SYL) for _ in range(n or r.randint(2, 4))).capitalize()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _fill(r: random.Random, pattern: str) -> str:
    """Digits for {n}; none starts with 0."""
    return re.sub(r"\{(\d+)\}", lambda m: r.choice("123456789") + _digits(r, int(m[1]) - 1), pattern)


PHONE_FORMS = [
    "+49 {2} {5} {3}", "+49 {3} {7}", "+49 {3}/{6}", "0049 {2} {5}-{3}", "0{2}/{6}", "0{2}/{8}", "0{3}/{5}-{2}", "0{2} {7}", "0{3} {6}", "0{4} {5}", "(0{2}) {6}", "(0{2}) {4} {4}", "(0{3}) {7}", "0{3}-{7}", "0{3} {3} {4}",
    "+1 {3} {3} {4}", "+1{3}{3}{4}", "+1-{3}-{3}-{4}", "+1 ({3}) {3}-{4}", "({3}) {3}-{4}", "{3}.{3}.{4}", "{3}-{3}-{4}", "{3} {3} {4}", "1-{3}-{3}-{4}", "1-{3}-{3}-{4} ext. {3}", "({3}){3}-{4} x{2}",
    "+44 20 {4} {4}", "+44 7{3} {6}", "0{4} {6}", "07{3} {6}", "+33 {1} {2} {2} {2} {2}", "0{1} {2} {2} {2} {2}", "0{1}.{2}.{2}.{2}.{2}", "0{1}{2}{2}{2}{2}", "+34 {3} {2} {2} {2}", "+34 {3} {3} {3}", "6{2} {3} {3}", "9{2} {2} {2} {2}",
    "+39 0{1} {4} {4}", "+39 3{2} {7}", "+31 6 {8}", "+41 {2} {3} {2} {2}", "+43 {3} {7}", "+48 {3} {3} {3}", "+46 {2}-{3} {2} {2}", "+55 {2} 9{4}-{4}", "+91 {5} {5}", "+81 {2}-{4}-{4}", "+86 {3} {4} {4}", "+61 4{2} {3} {3}", "+351 {3} {3} {3}", "+420 {3} {3} {3}",
]
ID_FORMS = [
    "d3-d2-d4", "d3 d2 d4", "d8L", "d8-L", "Xd7L", "X-d7-L", "LL d2 d2 d2 A", "LLd6A", "d2 d3 d3 d3", "d11", "1 d2 d2 d2 d3 d3 d2", "2 d2 d2 d2 d3 d3", "1d14", "Ld8", "Ld2Ld1Ld3", "LLd7", "d9", "d3-d3-d3", "d3 d3 d3", "d2/d3/d5", "d3.d3.d3-d2", "d6-d4", "d4 d4 d4",
    "LLLLLLd2Ld2Ld3L", "d10", "Ld7", "d8", "d12",
]


def _id(r: random.Random) -> str:
    out = re.sub(r"d(\d+)", lambda m: _digits(r, int(m[1])), r.choice(ID_FORMS[:12] if r.random() < 0.6 else ID_FORMS))
    return re.sub(r"[LAX]", lambda m: r.choice({"L": "BCDEFGHJKLMNPRSTVWXYZ", "A": "ABCD", "X": "XYZ"}[m[0]]), out)


def make(kind: str, r: random.Random, given: list[str]) -> str:
    """A value of a kind."""
    if kind == "email":
        first, last = (r.choice(GIVEN), r.choice(FAMILY)) if r.random() < 0.4 else (_name_word(r), _name_word(r))
        ascii_ = lambda w: re.sub(r"[^a-z]", "", w.lower())
        user = r.choice(["{a}.{b}", "{a}-{b}", "{b}_{a}", "{a}{n}", "{a}+work", "{i}{b}", "{a}", "info", "{a}.{i}.{b}"]).format(a=ascii_(first) or "ana", b=ascii_(last) or "lo", n=r.randint(1, 99), i=r.choice("abcd"))
        host = r.choice(["mail.example", "team.site.example", "post.test", "web-box.invalid", "uni.dept.example", "firm.com", "box.org", "company.co.uk", "haus.de", "provider.net", "lab.edu", "tienda.es", "atelier.fr", "x.io"])
        style = r.randint(0, 8)
        s = f"{user}@{host}"
        if style == 1:
            s = f"{user} (at) {host}"
        elif style == 2:
            s = f"{user} [at] {host.replace('.', ' [dot] ')}"
        elif style == 3:
            s = f"{user} AT {host.replace('.', ' DOT ')}"
        elif style == 4:
            s = f"{user} at {host.replace('.', ' dot ')}"
        elif style == 5:
            s = f"{user}(at){host.replace('.', '(dot)')}"
        return s.upper() if r.random() < 0.12 else s
    if kind == "phone":
        s = _fill(r, r.choice(PHONE_FORMS))
        return s + (r.choice([" ext. ", " x", " ext ", " extension "]) + _digits(r, 3) if "ext" not in s and "x" not in s and r.random() < 0.12 else "")
    if kind == "id_number":
        return _id(r)
    if kind == "address":
        n = r.randint(1, 999)
        flat = r.choice(["", "", "", f", Apt {r.randint(1, 99)}", f" #{r.randint(1, 40)}B", f", Flat {r.randint(1, 20)}", f" Unit {r.randint(1, 9)}", f", Suite {n}"])
        return r.choice([
            f"{n} {_street(r)} {r.choice(_TYPES)}" + flat, f"{n}{r.choice('ABab')} {_street(r)} {r.choice(_TYPES)}",
            r.choice(["", "", "Alte ", "Große "]) + r.choice(_DE) + r.choice("weg allee straße strasse str. gasse platz ring damm ufer".split()) + f" {r.randint(1, 150)}" + r.choice(["", "a", "b", " c"]),
            f"{r.choice(['Berliner Straße', 'Lange Gasse', 'Am Markt', 'Unter den Linden', 'An der Mühle', 'Zum Hafen', 'Hamburger Allee', 'Neue Straße', 'Kurze Str.'])} {r.randint(1, 150)}",
            f"{n}{r.choice([' ', ', ', ' bis ', ' ter '])}{r.choice('rue bd avenue chemin Rue Avenue Boulevard place quai impasse allée av.'.split())} {r.choice(_FR)}",
            f"{r.choice(['Calle ', 'Avenida ', 'C/ ', 'Paseo ', 'Plaza ', 'Camino ', 'calle ', 'avenida '])}{r.choice(_ES)}{r.choice([' ', ', ', ', n.º ', ' n.º ', ' nº ', ', núm. '])}{r.randint(1, 150)}" + r.choice(["", "", ", 2.º B", ", 3º"]),
            f"{r.choice(['Via ', 'Piazza ', 'Corso ', 'Viale '])}{r.choice(_IT)}{r.choice([' ', ', '])}{r.randint(1, 150)}",
            f"{r.choice(['Hoofd', 'Keizers', 'Prinsen', 'Kerk', 'Molen'])}{r.choice(['straat', 'gracht', 'laan', 'plein', 'weg'])} {r.randint(1, 300)}",
        ])
    return make_name(r, given)


def _given(r: random.Random, given: list[str]) -> str:
    x = r.random()
    return r.choice(given) if given and x < 0.3 else r.choice(GIVEN) if x < 0.6 else _name_word(r)


def _family(r: random.Random) -> str:
    x = r.random()
    f = r.choice(FAMILY) if x < 0.35 else _name_word(r) if x < 0.65 else _name_word(r, 1) + r.choice(_ENDS) if x < 0.85 else (r.choice(_WORDS).capitalize() + r.choice(_ENDS))
    return f + (f"-{r.choice(FAMILY)}" if r.random() < 0.08 else "")


def make_name(r: random.Random, given: list[str]) -> str:
    first, family = _given(r, given), _family(r)
    middle = f" {r.choice('ABCDKLMRST')}." if r.random() < 0.15 else ""
    part = r.choice(["van der ", "von ", "de la ", "van ", "de ", "del ", "di "]) if r.random() < 0.12 else ""
    s = f"{family}, {first}" if r.random() < 0.1 else f"{first if r.random() < 0.75 else first[0] + '.'}{middle} {part}{family}"
    return s.upper() if r.random() < 0.1 and "." not in s else s


POSITIVE = {
    "email": [
        "Mail {} about the remaining ones.", "Send questions to {} please.", "{} is where the bills go.", "His address is {} since June.", "From: {}", "cc {} as well", "({})", "Reply-to {}, not to me.", "Is {} still in use?", "I forgot the password of {} again.",
        "Meine Adresse lautet {} seit Mai.", "Alles Weitere an {} senden.", "Kontakt: {}", "Rechnung bitte per Mail ({}).", "Frag einfach {} danach.", "Mon adresse est {} depuis mai.", "Les factures vont à {} chaque mois.", "Réponds à {} si possible.", "Contact : {}",
        "Mi correo es {} desde mayo.", "Las facturas van a {} cada mes.", "Responde a {} si puedes.", "Correo: {}", "email {} or ask at the desk", "- {}", "You'll find me under {} most days.",
    ],
    "phone": [
        "Ring {} after six.", "Phone: {}", "My mobile is {} now.", "The doctor can be reached under {} until noon.", "Dial {} and wait for the tone.", "tel. {}", "Fax {}", "WhatsApp {} works best.", "If nobody opens, phone {}.", "{} is the number of the school.", "Our hotline {} is busy.", "She left the number {} on the desk.", "Call {} or write.", "Contact the driver on {}.",
        "Telefon: {}", "Unter {} ist immer jemand da.", "Handy {}", "Ruf bitte {} an.", "Die Nummer der Schule ist {}.", "Durchwahl im Büro: {}", "Notruf der Werkstatt: {}", "Téléphone : {}", "Rappelle le {} avant midi.", "On peut joindre l'école au {}.", "Mon portable : {}",
        "Teléfono: {}", "Puedes marcar el {} por la tarde.", "El número de la escuela es el {}.", "Móvil {}", "Avísame en el {} cuando llegues.", "text me: {}", "or by phone ({})", "- {} (office)",
    ],
    "id_number": [
        "SSN: {}", "Her national insurance number is {} as far as I know.", "The clerk typed {} as the passport number.", "Tax number {} does not match.", "ID card {} was found in the bus.", "Enter the social security number {} here.", "identity document {} expired", "Personal ID: {}", "The passport {} belongs to my aunt.", "My driving licence says {}.", "the person with ID {} moved away",
        "Steuer-ID: {}", "Die Sozialversicherungsnummer {} fehlt im Formular.", "Personalausweis {} ist abgelaufen.", "Reisepass Nr. {} wurde gestohlen.", "Als Identifikationsnummer steht dort {}.", "Numéro fiscal : {}", "Le passeport {} est perdu.", "Sa carte d'identité porte le numéro {}.", "N° de sécurité sociale {}", "DNI {}", "El pasaporte {} está vencido.", "NIE: {}", "Su número de la seguridad social es el {}.", "Número fiscal {}", "{} is the number on my identity card.",
    ],
    "address": [
        "We live at {} now.", "The parcel goes to {}.", "Her flat at {} is small.", "Address: {}", "Meet me outside {} at noon.", "{} is for sale.", "The fire at {} was put out.", "Turn left and stop at {}.", "{}\nSpringfield", "Home: {}, second floor", "He grew up at {}, near the park.", "The office moved from {} last year.",
        "Wir wohnen jetzt {}.", "Anschrift: {}", "Das Paket geht an die Adresse {}.", "Das Büro in der {} ist zu.", "{}\n10115 Stadt", "Treffpunkt ist vor dem Haus {}.", "Nous habitons {} maintenant.", "Adresse : {}", "Le colis part pour le {}.", "Le bureau du {} est fermé.", "{}\n75010 Ville", "Mi piso está en {} desde mayo.", "Dirección: {}", "El paquete va a {}.", "La oficina de {} está cerrada.", "- {}",
    ],
    "name": [
        "My {en} {} knows it.", "our {en} {} left early", "Is your {en} {} at home?", "Mein {de} {} weiß das.", "unsere {de} {} kommt später", "Ist deine {de} {} da?", "Die {de} {} ist nett.", "Ma {fr} {} le sait.", "notre {fr} {} viendra", "Mi {es} {} lo sabe.", "nuestra {es} {} llega tarde",
        "Guten Tag Herr {}, wie geht es?", "Ich rufe für Frau {} an.", "an Herrn {} weiterleiten", "chez M. {} demain", "pour Mme {} seulement", "para el señor {} solo", "for Mrs. {} only", "Sir {} was there.",
        "{} will come on Friday.", "{} asked for more.", "{} has two dogs.", "The photo was taken by {}.", "a song by {}", "Written by {}.", "sent by {} in May", "{} said it first.", "{} hat gefragt.", "{} war da.", "{} a demandé.", "{} dijo que sí.", "Reach {} at the desk.", "I met {} last night.", "The patient, {}, came too late.", "An interview with {}", "She married {} two years ago.", "{} lives next door.", "We thank {} for the photos.", "A letter from {} came today.", "Ask {} or wait.", "The winner was {}.", "{}'s car is blue.", "according to {}, it rained", "Author: {}", "Name: {}", "Signed, {}", "Yours\n{}", "Best\n{}\n", "Hi {}, how are you?", "Dear {},", "To {} and the team", "Mr. {} is out.", "Dr. {} wrote the report.", "my boss {} agrees", "{} plays the piano.", "{} from Leeds won.", "When {} arrived, we left.", "both {} and the dog slept", "This was painted by {} in 1990.", "He gave {} a book.", "Yesterday {} called twice.", "I think {} is right.", "The book by {} is long.", "It belongs to {}.", "{} never answered me.", "{} can explain it.", "- {}", "Prof. {} teaches here.", "Please welcome {}!", "on behalf of our director {}", "({})",
        "Gestern traf ich {} im Zug.", "{} wohnt nebenan.", "Herr {} ist krank.", "Frau {} hat angerufen.", "Der Brief ist von {}.", "Frag {} danach.", "Unser Nachbar {} hilft gern.", "Viele Grüße\n{}", "Gewonnen hat {}.", "Liebe Grüße\n{}\n", "Laut {} regnet es.", "Das Buch von {} ist lang.", "Autor: {}", "Heute kommt {} vorbei.", "Meine Tante {} backt.", "{} spielt Klavier.", "Ich danke {} für alles.",
        "J'ai vu {} hier soir.", "{} habite à côté.", "M. {} est malade.", "Mme {} a téléphoné.", "La lettre vient de {}.", "Demande à {} plutôt.", "Bien à vous\n{}", "Notre voisin {} aide volontiers.", "Le gagnant est {}.", "Selon {}, il pleut.", "Le livre de {} est long.", "Merci à {} pour tout.", "Ma tante {} fait des gâteaux.", "Auteur : {}", "{} joue du piano.", "Amitiés\n{}\n",
        "Ayer vi a {} en el tren.", "{} vive al lado.", "El señor {} está enfermo.", "La doctora {} llamó.", "La carta es de {}.", "Pregunta a {} mejor.", "Saludos\n{}", "Nuestro vecino {} ayuda siempre.", "Ganó {} otra vez.", "Según {}, llueve.", "El libro de {} es largo.", "Gracias a {} por todo.", "Mi tía {} hace pan.", "Autora: {}", "{} toca el piano.", "Un abrazo\n{}\n",
    ],
}
NEGATIVE = [
    "Order {8} left at 12:{2}.", "Version {1}.{1}.{1} is out.", "Case {2}-{1}-{2} is closed.", "ISBN 978-{1}-{3}-{3}-{1}", "The box 192.{1}.{1}.{1} is down.", "It is 0.{4} after {2} rounds.", "from 20{2}-01-1{1} to 20{2}-02-2{1}", "Build {h} fails.", "3.14159{6} and so on", "Set stock@checkout to {2}.", "Load @tools/{w} in {T}.",
    "The {F} filter is old.", "We used the {F} method.", "A {F} plot shows it.", "The {F} {T} opens at nine.", "In {N} {T} it snows.", "{T} {N} is closed.", "the {W} {T} and the {W} {W}", "Page {1}, chapter {2}, in {N} {T}.", "{F} {T} is a good place.", "the University of {N}", "Hotel {N} has {2} rooms.", "Lake {N} is deep.", "Mount {N} is {4} m high.", "The {W} {W} works, the {W} does not.", "# {W} {W}", "## {W} {W} {W}", "{W} {W}: {2}", "Our {W} Team meets on Monday Morning.", "They sell {W} Pro and {W} Plus.", "HTTP Status {3}, JSON Schema {1}", "Visual {T} and Open {T}", "North {N} and South {N}", "Happy New Year! Good Morning! Dear Sir or Madam,", "New York, San Francisco and Los Angeles are far.", "The United States and Great Britain", "In {N} Street there is a shop.", "Invoice {6}, item {7}", "Serial {h}{4}", "The port is {4}, the pid {5}.", "The sum is {3},{3} or {9}.", "{2} of {3} rows, {8} bytes", "on {2}.0{1}.20{2} at {2}:{2}", "Ref. {3}/{4}/{2}", "IBAN? No. Flight {W} {3}.", "timestamp 1{9}", "{9} ms", "track {10} on the map",
    "Do {N} and I agree? Yes.", "Why Not? What Next? How So?", "Start Here. Stop There. Then Wait.", "Once the {w} is done, Look again.", "I like {N}. Many do. Some {w} helps.", "If {N} fails, Try {N}.", "Think of it. Keep a list. Most of them work. This is it. There is more.", "Buy two books. See Section {2}. Read Part {1}.", "In practice, Use {W}. For example, Put it away. To be fair, Let it go.", "Step One, Step Two",
    "Sobald {G} fertig ist, geht es. Wenn {G} fehlt, warte.", "Das Problem mit {G} und {G} ist klar. Viele {G} helfen.", "Zuerst {G}, dann {G}. Ein {G} reicht.", "In den meisten Fällen ist {G} gut. Wichtig ist {G}.", "Welche {G} passt? Noch ein {G}. Am Ende zählt {G}.", "Die {G} {G} sind neu. Der {G} ist alt.", "Bei {G} hilft {G}. Ohne {G} geht nichts. Für {G} gilt {G}.", "Warum {G} wichtig ist. Kurz: {G}. Bitte {G} prüfen.", "Montag Abend und Dienstag Morgen", "Das {F} Verfahren ist alt. Das Museum {N} auch.", "{2}:{2} Uhr, {G} {2}", "Erst {G} lesen, dann {G} schreiben, danach {G} löschen.",
    "En bref : Dans la plupart des cas, {w} suffit. Beaucoup de gens aident. Une fois prêt, attends.", "Pour finir : Il faut attendre. Le Musée {N} est fermé. La méthode {F} marche.", "Quelles erreurs ? Comment faire ? Peux-tu aider ? Merci Beaucoup.", "Les États Unis et la Nouvelle {N}",
    "Para terminar: Primero escribe. Muchas guías ayudan. Cuando sea posible, espera.", "En resumen: No hace falta. El Museo {N} cierra. El método {F} sirve.", "Qué Hacer. Cómo Empezar. Por Qué No. Muchas Gracias.", "Nueva {N} y Gran {T}",
    "Mail me@ or @home later.", "Meet at 5 at {w} dot corner.", "Look at the dot at the end.", "a at b", "I moved {2} boxes in {1} rooms.", "12 angry men and {2} small rooms", "{2} Big Trees stand here.", "Open {2} Doors in the {W} House.", "Route {2}, Gate {1}, Platform {1}",
]


def labelled_texts(n: int, given: list[str], seed: int = 5) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Seeded synthetic texts with the true spans: (text, {(kind, start, end)})."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", set()
        for _ in range(r.randint(3, 7)):
            if r.random() < 0.5:
                kind = r.choice(KINDS + ("name",))
                template, value = r.choice(POSITIVE[kind]), make(kind, r, given)
                template = re.sub(r"\{(en|de|fr|es)\}", lambda m: r.choice(ROLES[m[1]]), template)
                at = len(text) + template.index("{}")
                text += template.replace("{}", value)
                spans.add((kind, at, at + len(value)))
            else:
                t = r.choice(NEGATIVE)
                t = re.sub(r"\{(\d+)\}", lambda m: _digits(r, int(m[1])), t)
                t = re.sub(r"\{h\}", lambda m: "".join(r.choice("0123456789abcdef") for _ in range(10)), t)
                t = re.sub(r"\{N\}", lambda m: _name_word(r) if r.random() < 0.5 else r.choice(GIVEN + FAMILY) if r.random() < 0.3 else _name_word(r, 2), t)
                t = re.sub(r"\{F\}", lambda m: _family(r), t)
                t = re.sub(r"\{T\}", lambda m: r.choice(THINGS), t)
                t = re.sub(r"\{W\}", lambda m: r.choice(_WORDS).capitalize(), t)
                t = re.sub(r"\{G\}", lambda m: r.choice(_NOUNS) if r.random() < 0.7 else r.choice(_NOUNS) + r.choice(_NOUNS).lower(), t)
                text += re.sub(r"\{w\}", lambda m: r.choice(_WORDS), t)
            text += r.choice([" ", " ", " ", "\n\n", "\n"])
        out.append((text, spans))
    return out
