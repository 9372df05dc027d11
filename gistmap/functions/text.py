"""Scalar functions and predicates on terms and texts, as Column expressions (JVM) where they can be."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nouns that rarely define a topic on their own.
MODIFIER_NOUNS = """stop station schedule minute hour time price rating total level side end start rest form case state method path area goal
context concept difference table error standard series sum student final walk ride travel stay deal night morning evening afternoon number
amount size type kind part section line page item option step point example version update change detail note second week month year day bed
room ticket reservation route direction distance duration cost fee""".split()
# Topic stopwords.
STOPWORDS = """thing way code file stuff something anything everything someone people person place time day week month year lot bit kind type
part example question answer idea point issue problem help need want use make get go do work data info information link page site app tool
system process step option list number text word line section document image photo picture video email message chat conversation prompt
response output input result version update change detail note today tomorrow yesterday you your yours it its this that these those they them
their we us our he she his her who whom which what where when why how both all each every other another same such itself myself yourself one
two three four five first second third zero ten breakdown summary key value term solution rule logic function computer""".split()
# Patterns of terms too specific to name a topic.
SPECIFIC = [
    r"^\\", r"\$", r"\d:\d", r"\b(?:am|pm)\b", r"^\d", r"\d+\s*(?:cm|mm|km|mi|ft|lb|kg|mph|kph)\b", r"^\d+(?:\.\d+)?(?:\s+\d+(?:\.\d+)?)*$",
    r"^[\d$./:-]+$", r"[_+]", r"https?://", r"\\", r"[{}<>]", r"[\"`]", r"[\[\]]", r"[()]",
]
# Trailing fillers, determiners and hyphenated compounds.
TRAILING = "explain describe show tell discuss cover please help give provide ask want need in on at for to of with about into".split()
DETERMINERS = "this that these those my your his her its our their what which whose".split()
COMPOUNDS = "little-o big-o big-theta big-omega n-gram n-grams p-value p-values t-test z-score r-squared k-means k-nearest".split()


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def html_to_text(c: Column) -> Column:
    """Tags to spaces, then references resolved, white space collapsed and trimmed. Null stays null."""
    plain = html_unescape(F.regexp_replace(c, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def user_text(title: Column) -> Column:
    """The title without a leading "Prompted"; blank gives null."""
    t = F.regexp_replace(title, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?iU)^Prompted\s+", "")
    return F.nullif(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), F.lit(""))


def chat_id(details: Column) -> Column:
    """The id in the first detail's url (or name): what follows the last ``/app/`` up to ``?``, else the whole url."""
    first = F.try_element_at(details, F.lit(1))
    url = F.trim(F.coalesce(F.nullif(F.trim(first["url"]), F.lit("")), first["name"]))
    tail = F.substring_index(F.substring_index(url, "/app/", -1), "?", 1)
    return F.nullif(F.when(url.contains("/app/"), F.trim(tail)).otherwise(url), F.lit(""))


def strip_non_discursive(c: Column) -> Column:
    """Formulas, assignments and command-line flags become spaces, in this order."""
    c = F.regexp_replace(c, r"(?s)\$\$.*?\$\$", " ")
    c = F.regexp_replace(c, r"\$[^$\n]+\$", " ")
    c = F.regexp_replace(c, r"(?U)\b\w+\s*=\s*\S+", " ")
    return F.regexp_replace(c, r"(?U)(?<!\w)--?[A-Za-z][\w-]*", " ")


def strip_determiner(c: Column) -> Column:
    """A leading determiner goes if two characters remain."""
    cut = F.regexp_replace(c, rf"^(?:{'|'.join(DETERMINERS)})\s+", "")
    return F.when(F.length(cut) >= 2, cut).otherwise(c)


def repair_boundary(c: Column) -> Column:
    """Stray signs at both ends go, known compounds stay; fewer than two characters give null."""
    cut = F.trim(F.regexp_replace(c, r"^[-_~+=/]+|[-_~+=/]+$", ""))
    return F.when(F.lower(c).isin(COMPOUNDS), c).when(F.length(cut) >= 2, cut)


def ends_with_fragment(c: Column) -> Column:
    return F.length(F.element_at(F.split(F.trim(c), r"\s+"), -1)) < 2


def is_too_specific(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c, r"\D", ""))
    return c.rlike("|".join(f"(?:{p})" for p in SPECIFIC)) | (digits > 0.35 * F.length(c)) | c.rlike(r"^\d+$")


def is_valid_term(c: Column) -> Column:
    return c.isNotNull() & (F.length(c) >= 2) & ~c.isin(sorted(set(STOPWORDS) | set(MODIFIER_NOUNS))) & ~is_too_specific(c)


def count_norm(c: Column) -> Column:
    """White space collapsed, lower case, no possessive, no leading article."""
    c = F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    c = F.regexp_replace(c, r"(?:'s)$|'$", "")
    return F.regexp_replace(c, r"^(?:the|a|an) ", "")


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("topic"))


def snippet(c: Column, n: int) -> Column:
    flat = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    x, y = words(F.lower(a)), words(F.lower(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def singular(c: Column) -> Column:
    """Rule-based lemma of a noun."""
    return (
        F.when(c.rlike("^.{2,}ies$"), F.regexp_replace(c, "ies$", "y"))
        .when(c.rlike("(?:ss|us|is)$"), c)
        .when(c.rlike("^.{3,}s$"), F.regexp_replace(c, "s$", ""))
        .otherwise(c)
    )


def root(c: Column) -> Column:
    """Lower lemmas of a term without trailing fillers, joined by spaces."""
    lemmas = F.transform(words(F.lower(c)), singular)
    text = F.concat_ws(" ", lemmas)
    return F.trim(F.regexp_replace(text, rf"(?:(?:^| )(?:{'|'.join(TRAILING)}))+$", ""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _jaro_winkler(s: str, t: str) -> float:
    """Jaro similarity with the prefix bonus applied always (prefix up to 4, weight 0.1)."""
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(len(s), len(t)) // 2 - 1
    taken = [False] * len(t)
    left = []
    for i, x in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not taken[j] and t[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, k in zip(t, taken) if k]
    m = len(left)
    swapped = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(s) + m / len(t) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(s[:4], t[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def _chunks(text: str | None, most: int) -> list[str]:
    """Sentence chunks of at most ``most`` words; a longer sentence is cut between words; never empty."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for sentence in re.split(r"(?<=[.!?])\s+", (text or "").strip()):
        ws = sentence.split()
        if size + len(ws) > most and held:
            out.append(" ".join(held))
            held, size = [], 0
        while len(ws) > most:
            out.append(" ".join(ws[:most]))
            ws = ws[most:]
        if ws:
            held.append(" ".join(ws))
            size += len(ws)
    if held or not out:
        out.append(" ".join(held))
    return out


def split_chunks(most: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _chunks(t, most))

    return run


def words_of(token: str | None) -> tuple[str, ...]:
    """The words of a token that may be a merged phrase."""
    return tuple((token or "").split())


def stopwords(*sources) -> frozenset[str]:
    """The union of any number of lists of words, trimmed and in lower case; null lists and blank words are left out. Without lists: the built-in ones."""
    lists = sources or (STOPWORDS, MODIFIER_NOUNS)
    return frozenset(w.strip().lower() for words in lists if words is not None for w in words if w and w.strip())
