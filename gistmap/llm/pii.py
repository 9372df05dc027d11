"""Personal information in free text: candidates, boosted trees, calibrated selection.

High-recall generators propose overlapping spans of five kinds (email, phone, id_number, address, name). Per kind a
gradient-boosted classifier scores a span from its format and its context: shapes of numbers, words before and after, whether
a word is known to a public vocabulary in lower case or only capitalised. It is trained here on ``TRAIN_TEXTS`` synthetic
labelled texts (``pii_texts``; a fixed bound), calibrated on a held-out third and cut at the threshold that is best
there, once per process and list of names. Accepted spans that overlap are settled by score, then length.

Given names come from a reference list. A list of up to ``MAX_NAMES`` is broadcast; of a longer one each
text gets the names that occur in it by a join, so both ways give the same features.

Texts are read whole, in Arrow batches, without a shuffle (but for that join). Defined results: a null text has no
spans and stays null when redacted; an empty text stays empty; repeated spans of a text are one
row of kind and value but are all redacted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmap.llm.boosting import BoostedTrees
from gistmap.llm.pii_texts import FAMILY, GIVEN, KINDS, ROLES, THINGS, labelled_texts
from gistmap.llm.tokenizer import vocabulary_path
from gistmap.runtime import spread

TRAIN_TEXTS = 6_000
#: Names up to which the list is broadcast, and names of a longer one that are used in training texts.
MAX_NAMES, TRAIN_NAMES = 500_000, 2_000

# --- candidate generators ----------------------------------------------------------------------

_AT = r"(?:@|[ ]?[\[(][ ]?at[ ]?[\])][ ]?|[ ](?:AT|at)[ ])"
_DOT = r"(?:\.|[ ]?[\[(][ ]?(?:dot|punkt|point|punto)[ ]?[\])][ ]?|[ ](?:DOT|dot|punkt|punto)[ ])"
#: The sign between user and host; the user is the run of letters before it, the host what matches after.
_SIGN, _DOT_SIGN = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_USER = re.compile(r"[\w.+%-]*[A-Za-z0-9_]$")
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*", re.I)
_NOT_USER = re.compile(r"[^\w.+%-]")

_EXT = r"(?:[ ]?,?[ ]?(?:ext\.?|extension|x|durchwahl|poste|int\.|app\.)[ ]?\d{1,5}(?!\d))?"
PHONES = [
    ("intl", r"(?:\+|\b00)[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,12}\)?){1,7}"),
    ("area", r"\(\d{2,5}\)[ ]?\d{3,8}(?:[ .\-]?\d{2,5})?"),
    ("nanp", r"\b(?:1[\-. ])?\d{3}[\-. ]\d{3}[\-. ]\d{4}"),
    ("slash", r"\b0\d{1,4}/\d{4,9}(?:-\d{1,4})?"),
    ("pairs", r"\b0\d(?:[ .\-]?\d\d){4}"),
    ("plain", r"\b0\d{1,4}[ \-]\d{3,8}(?:[ \-]?\d{3,5})?"),
    ("run", r"\b\d[\d ()./\-]{5,}\d"),
]
_PHONES = [(n, re.compile(p + _EXT, re.I)) for n, p in PHONES]
IDS = [
    ("ssn", r"\d{3}([\- ])\d{2}\1\d{4}"),
    ("eight_letter", r"\d{8}-?[A-Z]"),
    ("letter_seven", r"[XYZ]-?\d{7}-?[A-Z]"),
    ("nino", r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]"),
    ("eleven", r"\d{2} \d{3} \d{3} \d{3}|\d{11}"),
    ("fifteen", r"[12] \d\d \d\d \d[\dAB] \d{3} \d{3}(?: \d\d)?|[12]\d{14}"),
    ("document", r"[A-Z](?=[A-Z0-9]{8}\b)(?=\w*\d\w*\d\w*\d)[A-Z0-9]{8}|[A-Z]{1,2}\d{6,8}"),
    ("threes", r"\d{3}[ \-.]\d{3}[ \-.]\d{3}(?:-\d\d)?|\d{4} \d{4} \d{4}|\d\d/\d{3}/\d{5}|\d{6}-\d{4}"),
    ("sixteen", r"[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]"),
    ("digits", r"\d{6,12}"),
]
_IDS = [(n, re.compile(rf"(?<![\w@.+\-])(?:{p})(?![\w@]|[.\-]\d)")) for n, p in IDS]

_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]+"
_WAYS = r"Street|St\.|St|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln|Boulevard|Blvd|Court|Ct|Drive|Dr\.?|Way|Place|Pl\.?|Terrace|Square|Parkway|Close|Crescent|Gardens|Grove|Hill|Row|Walk|Mews|Circle|Trail|Alley|Highway|Loop|Quay"
_FLAT = r"(?:,? (?:Apt|Apartment|Unit|Suite|Flat|Ste)\.? ?#?\w{1,5}|,? #\w{1,5})?"
ADDRESSES = [
    ("number_first", rf"\b\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{_WAYS})(?![\w])\.?{_FLAT}"),
    ("number_last", r"\b(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Am|Im|Zum|Zur|An der|Auf der) )?[A-ZÄÖÜ][a-zäöüß\-]+(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|straat|gracht|laan|plein) \d{1,4}(?: ?[a-z])?\b"),
    ("two_words", rf"\b(?:{_CAP} (?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm|Ufer)|(?:Am|Im|Zum|Zur|An der|Auf der|Auf dem|Unter den|In der|Hinter der|Vor dem) {_CAP}) \d{{1,4}}(?: ?[a-z])?\b"),
    ("rue", rf"\b\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:[Rr]ue|[Bb]d|[Bb]oulevard|[Aa]venue|[Aa]v\.|[Cc]hemin|[Aa]llée|[Pp]lace|[Qq]uai|[Ii]mpasse|[Cc]ours|[Rr]oute) (?:de la |de l['’]|des |du |de |d['’]|l['’])?{_CAP}(?:[ \-]{_CAP})*"),
    ("calle", rf"(?:\b(?:[Cc]alle|[Aa]venida|[Aa]vda\.?|Av\.|[Pp]aseo|[Pp]laza|[Cc]amino|[Cc]arrera|[Rr]onda|Rua|Via|Viale|Corso|Piazza)|\bC/) ?(?:de la |de los |de las |del |della |dei |das |dos |da |de )?{_CAP}(?: {_CAP})*,? (?:n\.?º ?|nº ?|núm\. ?)?\d{{1,4}}(?:,? \d{{1,2}}\.?[ºª] ?[A-Z]?\b)?"),
]
_ADDRESSES = [(n, re.compile(p)) for n, p in ADDRESSES]

_WORD = r"(?:[A-ZÀ-ÖØ-ÞĀ-Ž][a-zß-öø-ÿā-žșț’']+(?:[A-Z][a-zß-öø-ÿā-ž]+)?|[A-ZÀ-ÖØ-ÞĀ-Ž]{2,}|O[’'][A-Z][a-z]+)"
_FAM = rf"(?:(?:van der|van den|van|von|vom|zu|de la|de los|de|del|della|di|da|du|le|la|VAN DER|VAN|VON|DE LA|DE) )?{_WORD}(?:-{_WORD})?"
NAMES = [
    ("given_first", rf"(?:{_WORD}|[A-ZÀ-ÖØ-Þ]\.)(?: [A-ZÀ-ÖØ-Þ]\.)? {_FAM}"),
    ("family_first", rf"{_FAM}, {_WORD}(?: [A-ZÀ-ÖØ-Þ]\.)?"),
]
_NAMES = [(n, re.compile(rf"(?<![\w@.+\-’'])(?:{p})(?![\w@+]|[.\-_+]\w|-)")) for n, p in NAMES]
# a name has a second word that is capitalised or a particle
_STARTS = re.compile(r"(?<![\w@.+\-’'])(?:[A-ZÀ-ÖØ-ÞĀ-Ž]\S*|van|von|de) (?=[A-ZÀ-ÖØ-ÞĀ-Ž]|(?:van|von|vom|zu|de|del|della|di|da|du|le|la|der|den|los) )")

# Words that stand around names, in English, German, French and Spanish.
TITLES = set("dr dr. herrn mr mr. mrs mrs. ms ms. prof prof. herr herr frau mme m. mlle monsieur madame señor señora sr. sra. don doña sir".split())
PLACES = set("with by from for to of and or about like than at in on met meet see saw ask asked call called named is was mit von für bei an und oder zu laut nach heißt ist par de avec pour à chez et ou selon vu con por para a y o según es".split())
VERBS = set("will can may must should would could is was has had does did says said asks asked wrote writes told tells called calls thinks thought knows knew came comes went goes works worked lives lived wants wanted gave gives made makes plays and or ist war hat wird kann soll muss sagt sagte fragt fragte schrieb schreibt kam kommt wohnt ruft rief und est a était va peut doit dit demande écrit habite vient et es fue ha va puede debe dijo dice pregunta preguntó escribió vive llamó y".split())
ARTICLES = set("the a an der die das ein eine den dem le la les un une el los las una in im".split())
COMMON = set("i you we he she it they this that these there what why how when where who which many most some one once start keep think let help write give please can could should would is are do does if in on at for from to of my our your the a an and or but so as by no not yes put looking after before practice experience example tel text contact call order version ticket passport host result commit see chapter use set ship what mein meine ich du wir es das die der den dem ein eine wenn in im aus zum zur kurz noch viele wichtig sobald schreib wie was warum welche hilf gib ist kannst für mit und oder nicht bitte ruf je tu nous il elle on ce cette le la les un une des du de dans pour par si une fois beaucoup autre pourquoi comment quelles aide donne est peux mon ma mes appelle yo tú me mi mis el los las una en por para si cuando muchas otra primero cómo qué ayúdame dame es puedes lo llámame manda envíalo vivo escribo".split())
ID_CUES = re.compile(r"(?:passport|identity|identification|ids?|tax|security|insurance|national|licen[cs]e|document|ssn|ausweis\w*|\w*steuer\w*|sozialversicherungs\w*|\w*personal\w*|\w*pass|identifikations\w*|pièce|identité|sécurité|fiscale?|passeport|documento|identidad|dni|nie|nif|pasaporte|seguridad|codice|bsn|pesel)\b", re.I)
BAD_CUES = re.compile(r"(?:order|isbn|issn|ticket|case|version|build|commit|host|box|ip|result|page|chapter|invoice|serial|item|room|from|until|to|ran|ref\.?|flight|port|pid|sum|timestamp|bytes|bestellung|rechnung|commande|pedido|artikel|bundle|release|batch|track|route|gate|platform)\b[ .:#no]*$", re.I)
CALL_CUES = re.compile(r"(?:call|text|tel|phone|telephone|mobile|cell|fax|number|reach|reached|ring|dial|whatsapp|hotline|ruf|anruf|nummer|telefon|handy|durchwahl|erreich\w*|appelle|rappelle|numéro|téléphone|portable|joindre|llám\w*|marcar|número|teléfono|móvil|contact)\b", re.I)
HOME_CUES = re.compile(r"(?:ship|moved|live|lives|living|workshop|at|address|deliver|send|visit|outside|home|wohn\w*|liefern|adresse|anschrift|in|habit\w*|livrer|au|vivo|vive|envía\w*|dirección|en)\b", re.I)
_SUFFIX = re.compile(r"(?:berg|mann|stein|ford|ton|worth|sk[aiy]|sen|son|ez|ini|elli|ov|ova|ev|eva|quist|holm|wood|field|shaw|well|hurst|din|brandt|er|ic|ić|u|o|i|a)$", re.I)
_NOUNISH = re.compile(r"(?:ung|heit|keit|schaft|tion|weg|zug|plan|satz|teig|ment|ness|ing|ity|ance|ence|age|ure|ismus|tät|dad|ción)s?$", re.I)
_ROLES = frozenset(w.lower() for v in ROLES.values() for w in v)
_GIVEN, _FAMILY, _THINGS = frozenset(w.lower() for w in GIVEN), frozenset(w.lower() for w in FAMILY), frozenset(w.lower() for w in THINGS)


# places where numbers start, and words without which an address that ends in its number cannot be
_PHONE_AT = re.compile(r"(?<![\w+@.])[+(]?\d")
_ID_AT = re.compile(r"(?<![\w@.+\-])(?:[A-Z]{1,6}[\- ]?)?(\d)")
_NUMBER_AT, _DIGIT = re.compile(r"\b\d"), re.compile(r"\d")
_NEEDS = {
    "number_last": ("straße ", "strasse ", "str. ", "weg ", "allee ", "platz ", "gasse ", "ring ", "damm ", "ufer ", "straat ", "gracht ", "laan ", "plein "),
    "two_words": ("Straße ", "Strasse ", "Str. ", "Weg ", "Allee ", "Platz ", "Gasse ", "Ring ", "Damm ", "Ufer ", "Am ", "Im ", "Zum ", "Zur ", "An der ", "Auf de", "Unter den ", "In der ", "Hinter der ", "Vor dem "),
    "calle": ("alle", "venida", "vda", "Av.", "aseo", "laza", "amino", "arrera", "onda", "C/", "Rua", "Via", "orso", "iazza"),
}


def _cut_groups(s: str) -> Iterator[str]:
    """The span and its beginnings at every digit group."""
    yield s
    for m in reversed(list(re.finditer(r"[ .\-/]", s))):
        head = s[: m.start()].rstrip(" ,")
        if sum(c.isdigit() for c in head) >= 8:
            yield head


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, generator) of every span proposed; spans overlap."""
    out: dict[tuple[str, int, int], str] = {}
    for sign in _SIGN.finditer(text):
        # the run of letters before the sign, found backwards word by word
        at = sign.start()
        while at and not _NOT_USER.match(text, at - 1):
            at -= 1
        while at < sign.start() and not (text[at].isascii() and text[at].isalnum()):
            at += 1
        host = _HOST.match(text, sign.end())
        if host is None or not _USER.match(text[at : sign.start()]) or text[at - 1 : at] in tuple(".+-@") and at:
            continue
        out.setdefault(("email", at, host.end()), "full")
        # a spelled-out domain may have run into the sentence: every end after a dot counts
        for d in list(_DOT_SIGN.finditer(text, sign.end(), host.end()))[1:]:
            out.setdefault(("email", at, d.start()), "short")
    if _DIGIT.search(text):
        reach = dict.fromkeys([n for n, _ in _PHONES], 0)
        for anchor in _PHONE_AT.finditer(text):
            for name, p in _PHONES:
                if anchor.start() < reach[name] or (m := p.match(text, anchor.start())) is None:
                    continue
                reach[name] = m.end()
                spans = _cut_groups(m.group()) if name in ("intl", "run") else (m.group(),)
                for s in spans:
                    if sum(c.isdigit() for c in s) >= 7:
                        out.setdefault(("phone", m.start(), m.start() + len(s)), name)
        reach = dict.fromkeys([n for n, _ in _IDS], 0)
        for anchor in _ID_AT.finditer(text):
            # with the letters before the number, and without
            for at in sorted({anchor.start(), anchor.start(1)}):
                for name, p in _IDS:
                    if at >= reach[name] and (m := p.match(text, at)) is not None:
                        reach[name] = m.end()
                        out.setdefault(("id_number", m.start(), m.end()), name)
        for name, p in _ADDRESSES:
            if name not in _NEEDS:
                found = [m for anchor in _NUMBER_AT.finditer(text) if (m := p.match(text, anchor.start()))]
            else:
                found = p.finditer(text) if any(w in text for w in _NEEDS[name]) else ()
            for m in found:
                # a full stop may belong to an abbreviation or end the sentence
                out.setdefault(("address", m.start(), m.end()), name)
                if m.group().endswith("."):
                    out.setdefault(("address", m.start(), m.end() - 1), name)
    starts = [m.start() for m in _STARTS.finditer(text)]
    for name, p in _NAMES:
        for at in starts:
            m = p.match(text, at)
            if m:
                out.setdefault(("name", m.start(), m.end()), name)
    return [(k, a, b, n) for (k, a, b), n in out.items()]


_GEN = {n: i for i, n in enumerate(["full", "short", *[n for n, _ in PHONES], *[n for n, _ in IDS], *[n for n, _ in ADDRESSES], *[n for n, _ in NAMES]])}


@lru_cache(maxsize=1)
def vocabulary(path: str) -> dict[str, int]:
    """Ranks of the words a public vocabulary holds as one token after a space: low ranks are frequent words."""
    import base64

    out: dict[str, int] = {}
    with open(path, "rb") as f:
        for rank, line in enumerate(f):
            token = base64.b64decode(line.split()[0]).decode("utf-8", "replace") if line.strip() else ""
            if token[:1] == " " and token[1:].isalpha():
                out.setdefault(token[1:], rank)
    return out


_PREV = re.compile(r"(\S+)\s*$")
_NEXT = re.compile(r"\s*(\S+)")
_PLAIN = str.maketrans("", "", ".,;:!?()[]\"'’“”„«»")
_AFTER_STOP = re.compile(r"[.!?:…][\"'”»)]*\s*$")


class Words:
    """What is known of words: ranks in the public vocabulary, common names, function words and endings."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.memory: dict[str, tuple] = {}

    def rank(self, word: str) -> float:
        r = self.ranks.get(word)
        return 20.0 if r is None else math.log2(r + 2)

    def of(self, word: str) -> tuple:
        """(rank in lower case, rank as a name, common given, common family, function word, thing, noun ending, name ending, letters)."""
        hit = self.memory.get(word)
        if hit is None:
            if len(self.memory) > 200_000:
                self.memory.clear()
            low = word.lower()
            hit = self.memory[word] = (
                self.rank(low), self.rank(low.capitalize()), low in _GIVEN, low in _FAMILY, low in COMMON, low in _THINGS or low in STREET_ENDS, _NOUNISH.search(low) is not None, _SUFFIX.search(low) is not None, len(word),
            )
        return hit


STREET_ENDS = set("street st. st avenue ave lane road court blvd drive".split())


def _name_features(text: str, span: str, start: int, end: int, before: str, after: str, words: Words, known: frozenset[str]) -> list:
    parts = [w.strip(".,") for w in span.split()]
    head, tail = parts[0], parts[-1]
    family_first = "," in span
    if family_first:
        head, tail = tail, head
    h, t = words.of(head), words.of(tail)
    p = _PREV.search(before)
    prev = p[1].translate(_PLAIN) if p else ""
    low = prev.lower()
    n = _NEXT.match(after)
    nxt = n[1].translate(_PLAIN) if n else ""
    glue = after[:1]
    kind_before = 0 if not before.strip() else 1 if before.endswith("\n") else 2 if _AFTER_STOP.search(before) else 3 if before.rstrip()[-1:] in ",;(–-" else 4 if prev[:1].isupper() else 5 if prev[:1].isdigit() else 6
    kind_after = 0 if not after else 1 if glue == "\n" else 2 if glue in ".!?" else 3 if glue in ",;:)" else 4 if glue in "'’" else 5 if nxt[:1].isupper() else 6 if nxt[:1].isdigit() else 7
    middle = [words.of(w) for w in parts[1:-1]]
    return [
        *h, *t, head.lower() in known, tail.lower() in known, family_first, len(head) == 1, len(tail) == 1, span.isupper(), "-" in span, len(parts), sum(len(w) == 1 for w in parts), any(m[0] < 20 for m in middle), any(m[5] for m in middle),
        kind_before, kind_after, words.rank(low), words.rank(nxt.lower()), words.rank(prev) if prev[:1].isupper() else 0, low in TITLES or low + "." in TITLES, parts[0].lower() in TITLES or parts[0].lower() + "." in TITLES, low in _ROLES, parts[0].lower() in _ROLES, low in ARTICLES, low in PLACES, low in COMMON, nxt.lower() in VERBS, nxt.lower() in _THINGS or nxt.lower() in STREET_ENDS,
        nxt[:1].islower() and glue == " ", before[-2:-1] == "." and before[-3:-2].isupper(), min(h[0], t[0]), max(h[0], t[0]), h[0] - h[1], t[0] - t[1], low == parts[0].lower(), low in known or low in _GIVEN,
    ]


def features(text: str, kind: str, start: int, end: int, gen: str, words: Words, known: frozenset[str], longest: int) -> list[float]:
    """Format and context of one span, all ordinal."""
    span = text[start:end]
    before, after = text[max(0, start - 48) : start], text[end : end + 32]
    base = [_GEN[gen], len(span), end < longest, start == 0 or text[start - 1] == "\n", end == len(text) or text[end] == "\n"]
    if kind == "name":
        return [float(v) for v in base + _name_features(text, span, start, end, before, after, words, known)]
    digits = sum(c.isdigit() for c in span)
    base += [digits, span.count(" "), bool(BAD_CUES.search(before)), before[-1:].isdigit() or (before[-1:] in ".-/, " and before[-2:-1].isdigit()), after[:1].isdigit() or (after[:1] in ".-/" and after[1:2].isdigit())]
    if kind == "email":
        label = re.split(_DOT, re.split(_AT, span, maxsplit=1, flags=re.I)[-1], flags=re.I)
        extra = ["@" in span, len(label), len(label[-1]), label[-1].isalpha(), bool(re.search(r"[\[(]|[ ](?:AT|DOT)[ ]", span)), bool(re.match(rf"{_DOT}[A-Za-z]", after, re.I)), " at " in span, " dot " in span, len(label[-1]) <= 8, words.rank(label[-1].lower()), words.rank(label[0].lower()), span[0].isdigit()]
    elif kind == "phone":
        groups = [len(g) for g in re.findall(r"\d+", re.split(r"(?i)[ ,]*(?:e?x|durch|poste|int|app)", span)[0])]
        extra = [
            span.startswith("+"), span.startswith("00"), span.startswith("0"), "(" in span, "/" in span, span.count("."), span.count("-"), sum(groups), len(groups), groups[0], groups[-1], max(groups), min(groups), groups[1] if len(groups) > 1 else 0,
            bool(CALL_CUES.search(before[-24:])), bool(CALL_CUES.search(after[:24])), bool(ID_CUES.search(before[-30:])), bool(re.match(r"\d{4}-\d\d-\d\d$", span)), bool(re.match(r"[ ]?(?:ext|x\d|poste)", after)), before[-1:] in "+#(", bool(re.match(r"\s?(?:ms|bytes|rows|%|€|\$)", after)),
        ]
    elif kind == "id_number":
        extra = [bool(ID_CUES.search(before[-44:])), bool(ID_CUES.search(after[:28])), bool(CALL_CUES.search(before[-16:])), span[:1].isalpha(), span[-1:].isalpha(), span.count("-"), span.count("."), span.isdigit(), before[-1:] in "+/.)(", sum(c.isalpha() for c in span), bool(re.match(r"\s?(?:ms|bytes|rows|%|€|\$)", after))]
    else:
        first = span.split()[0].rstrip(",")
        extra = [bool(HOME_CUES.search(before[-18:])), bool(re.match(r",? (?:Apt|Unit|Flat|Suite|#)", after)), span[-1:].isdigit(), bool(re.match(r",?\s+[A-ZÀ-Þ\d]", after)), after[:1] in ".,\n", first.isdigit(), span[-1:] == ".", span.endswith("St."), after[:1] == ".", sum(w[:1].isupper() for w in span.split()), words.rank(span.split()[-1].strip(".").lower())]
    return [float(v) for v in base + extra]


class Detector:
    """Five calibrated classifiers and their thresholds."""

    def __init__(self, given: list[str], vocabulary_file: str | None = None):
        self.names = sorted(given)
        self.given = frozenset(g.lower() for g in given)
        self.words = Words(vocabulary(vocabulary_file or vocabulary_path()))
        self.models: dict[str, tuple[BoostedTrees, float]] = {}

    def _table(self, text: str, known: frozenset[str]) -> list[tuple[str, int, int, list[float]]]:
        spans = candidates(text)
        longest: dict[tuple[str, int], int] = {}
        for k, a, b, _ in spans:
            longest[k, a] = max(b, longest.get((k, a), 0))
        # whether a span is the tail of one of its kind that starts earlier
        inner, reach = set(), {}
        for k, a, b, _ in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
            at, end = reach.get(k, (-1, -1))
            if at < a and end >= b:
                inner.add((k, a, b))
            if b > end:
                reach[k] = (a, b)
        return [(k, a, b, [*features(text, k, a, b, g, self.words, known, longest[k, a]), float((k, a, b) in inner)]) for k, a, b, g in spans]

    def fit(self, texts: int = TRAIN_TEXTS, seed: int = 5) -> Detector:
        """Two thirds of the texts grow the trees, the others calibrate them and set the thresholds."""
        rows: dict[str, list] = {k: [] for k in KINDS}
        for i, (text, true) in enumerate(labelled_texts(texts, self.names, seed)):
            for k, a, b, f in self._table(text, self.given):
                rows[k].append((i % 3 == 0, (k, a, b) in true, f))
        self.quality: dict[str, float] = {}
        for k, found in rows.items():
            held = np.array([x[0] for x in found])
            y = np.array([x[1] for x in found], float)
            x = np.array([x[2] for x in found])
            model = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
            p, t = model.predict(x[held]), y[held]
            cuts = np.linspace(0.2, 0.8, 25)
            f1 = [2 * (t * (p >= c)).sum() / max(1.0, t.sum() + (p >= c).sum()) for c in cuts]
            best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
            self.models[k] = (model, float(cuts[best[len(best) // 2]]))
            self.quality[k] = float(max(f1))
        return self

    def find_all(self, texts: list[str | None], known: list | None = None) -> list[list[tuple[str, int, int]]]:
        """The accepted spans of each text, none overlapping, in order. ``known``: given names per text, else those of the detector."""
        tables = [self._table(t, self.given if known is None else frozenset(known[i] or ())) if t else [] for i, t in enumerate(texts)]
        flat = [(i, *row) for i, rows in enumerate(tables) for row in rows]
        score = np.zeros(len(flat))
        for k in KINDS:
            at = [n for n, row in enumerate(flat) if row[1] == k]
            if at:
                model, cut = self.models[k]
                p = model.predict(np.array([flat[n][4] for n in at]))
                score[at] = np.where(p >= cut, p + 1.0, 0.0)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        by_text: dict[int, list] = {}
        for n, (i, k, a, b, _) in enumerate(flat):
            if score[n]:
                by_text.setdefault(i, []).append((-(KINDS.index(k) == 0), -round(score[n], 2), a - b, a, b, k))
        for i, spans in by_text.items():
            taken: list[tuple[int, int]] = []
            for _, _, _, a, b, k in sorted(spans):
                if all(b <= x or y <= a for x, y in taken):
                    taken.append((a, b))
                    out[i].append((k, a, b))
            out[i].sort(key=lambda s: s[1])
        return out


_TRAINED: dict[tuple, Detector] = {}


def trained_detector(given: list[str]) -> Detector:
    """The detector for a list of given names; trained on the driver, once per list."""
    key = tuple(given)
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = Detector(given).fit()
    return _TRAINED[key]


def _spans(df: DataFrame, names: DataFrame | None, text: str, redact: bool, *, max_names: int = MAX_NAMES, detector: Detector | None = None) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    df = spread(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")))
    listed = None if names is None else names.where("given_name is not null").groupBy(F.lower("given_name").alias("name")).agg(F.min("given_name").alias("given_name"))
    rows = [] if listed is None else [r[0] for r in listed.select("given_name").limit(max_names + 1).collect()]
    joined = len(rows) > max_names
    # of a long list, the smallest names serve for training
    detector = detector or trained_detector([r[0] for r in listed.orderBy("given_name").select("given_name").limit(TRAIN_NAMES).collect()] if joined else sorted(rows))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[:-1])
    if joined:
        # the listed names among a text's capitalised words; equal texts share them
        key = F.xxhash64("__text", F.length("__text"))
        words = F.array_distinct(F.transform(F.regexp_extract_all("__text", F.lit(r"(\p{Lu}[\p{L}'’]*)"), 1), F.lower))
        pairs = df.where(F.length("__text") > 0).select(key.alias("__key"), F.explode(words).alias("name")).distinct()
        found = pairs.join(listed, "name").groupBy("__key").agg(F.collect_set("name").alias("__known"))
        df = df.withColumn("__key", key).join(found, "__key", "left").select(*[F.col(f"`{c}`") for c in keep], "__text", "__known")
    shared = df.sparkSession.sparkContext.broadcast(detector)
    at_text = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                texts = b.column(at_text).to_pylist()
                spans = found.find_all(texts, b.column(at_text + 1).to_pylist() if joined else None)
                if redact:
                    out = pa.array([None if t is None else _redacted(t, s) for t, s in zip(texts, spans)], pa.string())
                    yield pa.RecordBatch.from_arrays([*b.columns[:at_text], out], names=[*keep, text])
                else:
                    rows = [[{"kind": k, "value": t[x:y], "start": x} for k, x, y in s] for t, s in zip(texts, spans)]
                    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([*b.columns[:at_text], pa.array(rows, kind)], names=[*keep, "spans"])

    last = f"`{text}` string" if redact else "spans array<struct<kind: string, value: string, start: bigint>>"
    return df.mapInArrow(run, fields + last)


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for k, a, b in spans:
        parts += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def found_spans(documents: DataFrame, names: DataFrame | None) -> DataFrame:
    """(doc_id, kind, value), one row per document, kind and value exactly as in the text."""
    rows = _spans(documents.select("doc_id", "text").where(F.length("text") > 0), names, "text", redact=False)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.value").distinct()


def redacted_texts(documents: DataFrame, names: DataFrame | None) -> DataFrame:
    """``documents`` with typed placeholders such as [EMAIL] in ``text``; other columns as they are."""
    return _spans(documents, names, "text", redact=True)
