"""Broken prompt and response pairs, each with the type of its defect.

1. Answers are cleaned of markup (structure kept) and split into units: sentences, list items and lines.
2. The units of all different answers are counted and sorted by text (range partitions). In this order the
   units that go on from a broken one are its next neighbours with that common prefix, so cumulative counts at both ends of this
   stretch tell how many there are, and how many go on inside its last word.
3. An answer without a sign of its end is judged by rates: how often its last unit stands complete, how often it goes
   on, how often different answers end with it and, where none of this is known, how often its last word ends a unit. Answers
   whose length is a sharp peak among open-ended ones are cut by a length limit.
4. Rules for emptiness and copies, a sentence classifier for refusals (``refusals``) and a letter model for languages
   (``languages``). The first defect that holds is reported: empty, copy, refusal, wrong_language, truncated.

All counts are over different answers, so copies neither vouch for each other nor make a length limit and share one verdict,
and all are compared as rates, so a corpus of the same kind but another size gives the same verdicts. Units are
compared by value, not in groups: no frequent text gathers in a task. Defined results: a null or blank prompt
makes no pair; a null answer is empty; repeated exports of a chat (same turns) give one row.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmap.llm import languages, refusals
from gistmap.llm.conversations import uniform_role
from gistmap.llm.markup import clean_text
from gistmap.runtime import scratch_table, spread

#: Different answers that must end alike to make a set phrase, and the share of these among all that go on or end there.
SET_PHRASE, SET_SHARE = 3, 0.8
#: Share of a unit's occurrences that stand complete, and of a word's that end a unit, from which an open end is complete.
WHOLE_SHARE, END_SHARE = 0.5, 0.3
#: How far the number of open ends of one length must exceed that of the lengths around it to be a limit.
SPIKE, SIGMAS = 8, 5
#: Lead per word by which one language must be more likely than another to be called so.
SURE_LEAD = 0.35

# Names of languages in which a prompt can ask for an answer, and words for translating.
ASKS = re.compile(r"(?i)\b(?:english|german|french|spanish|italian|portuguese|dutch|swedish|danish|polish|turkish|japanese|chinese|korean|russian|arabic|translat\w*|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|italienisch\w*|übersetz\w*|inglés|alemán|francés|español|castellano|italiano|tradu\w+|anglais|allemand|français|espagnol|italien|language|sprache|idioma|langue)\b")

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+(?=\S)|\n+")
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = set("e.g. i.e. fig. figs. no. nr. vs. cf. ca. approx. eq. sec. ch. vol. p. pp. dr. mr. mrs. ms. prof. st. z.b. bzw. usw. d.h. u.a. abb. s. evtl. ggf. inkl. p.ex. ex. c.-à-d. env. art. chap. n.º nº núm. pág. págs. p.ej. ej. sr. sra. dra. etc". split()) - {"etc"}
_LINK_TAIL = re.compile(r"(?:</a>|\]\([^()\s]+\)|\]\])\s*(?:</\w+>\s*)*$", re.I)
_OPEN_TAIL = re.compile(r"[,;:(\[{“„«‘–—-]$|[\s(]['\"]$|n\.?º$|[&/=+]$")


def words(text: str) -> list[str]:
    return re.findall(r"[\w'’]+", text.lower())


_SPACE = re.compile(r"\s")


def normal_words(text: str, most: float = math.inf) -> list[str]:
    """Words without case, accents and punctuation; of a text of more than ``most`` words not all."""
    out, at = [], 0
    while at < len(text) and len(out) <= most:
        # pieces end before a space, where neither words nor accents go on
        space = _SPACE.search(text, at + 1_000)
        piece, at = (text[at : space.start()], space.start()) if space else (text[at:], len(text))
        flat = piece.lower() if piece.isascii() else "".join(c for c in unicodedata.normalize("NFKD", piece.casefold()) if not unicodedata.combining(c))
        out += re.findall(r"\w+", flat)
    return out


def readable(text: str | None) -> bool:
    """Whether anything in a text can be read: letters, digits or symbols (emoji)."""
    return any(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "So" for c in text or "")


def is_copy(prompt: str, answer: str) -> bool:
    """The prompt again: nothing added, at most a lost word (in eight) and changes of writing."""
    p = normal_words(prompt)
    a = normal_words(answer, len(p) + 1)
    if not a or len(a) > len(p) + 1:
        return False
    lost = max(1, len(p) // 8)
    if len(a) < len(p) - lost - 1:
        return False
    return p == a or _aligned(p, a, lost)


def _aligned(p: list[str], a: list[str], lost: int) -> bool:
    """Whether the words ``p`` become ``a`` at a cost of at most ``lost``: a lost word costs 1, a new or another one 3 (before
    the first word 1), one written differently (small edit) nothing.

    Costs never fall along a diagonal (a number of words lost less words new), so it is enough to know for each cost how far
    every diagonal reaches. The result is that of the full table at any length; the time is that of the words and of the
    square of ``lost``.
    """
    known = set(p)
    strange = [y for y in a if y not in known]
    if len(strange) > lost:
        # words of which the prompt has none alike cost at least 1 each
        alike = set().union(*map(_shortened, known))
        if sum(alike.isdisjoint(_shortened(y)) for y in strange) > lost:
            return False
    n, m = len(p), len(a)
    end = n - m
    reach: list[dict[int, int]] = [{}, {}, {}]
    for cost in range(lost + 1):
        three, one, now = reach[-3], reach[-1], {}
        left = lost - cost
        # only diagonals from which what is left suffices for the last one
        for k in range(max(-cost, end - left), min(cost, end + left // 3) + 1):
            i = max(one.get(k, -1), one.get(k - 1, -2) + 1, three.get(k + 1, -1), three.get(k, -2) + 1, 0 if k == -cost else -1)
            i = min(i, n, m + k)
            if i < 0:
                continue
            while i < n and i - k < m and (p[i] == a[i - k] or (len(p[i]) > 3 and _close(p[i], a[i - k]))):
                i += 1
            now[k] = i
        if now.get(end) == n:
            return True
        reach = [*reach[1:], now]
    return False


def _shortened(x: str) -> set[str]:
    """The word and what is left of it without one letter: words at most one edit or swap apart have one of these in common."""
    return {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}


def _close(x: str, y: str) -> bool:
    """At most one edit or swap."""
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    return x[i + 1 :] == y[i + 1 :] or x[i + 1 :] == y[i:] or x[i:] == y[i + 1 :] or (x[i : i + 2] == y[i : i + 2][::-1] and x[i + 2 :] == y[i + 2 :])


def is_refusal(answer: str) -> bool:
    """Declines, and every sentence declines or goes with declining."""
    return refusals.is_refusal([s for s in _SENTENCE.split(answer) if readable(s)])


_CODE = re.compile(r"(?s)```.*?(?:```|\Z)|`[^`]*`|https?://\S+")


def wrong_language(prompt: str, answer: str) -> bool:
    """The answer as a whole is in another language than the prompt, which asked for none."""
    p, p_lead, p_seen = languages.language(_CODE.sub(" ", prompt))
    if p is None or p_seen < 3 or p_lead < SURE_LEAD or ASKS.search(prompt):
        return False
    prose = _CODE.sub(" ", answer)
    a, a_lead, a_seen = languages.language(prose)
    if a is None or a == p or a_seen < 4 or languages.lead(prose, a, p) < SURE_LEAD:
        return False
    # single sentences in the prompt's language do not change what the answer is as a whole
    own = other = 0
    for s in _SENTENCE.split(prose):
        t, lead, seen = languages.language(s)
        if t and seen >= 4 and lead >= SURE_LEAD:
            own, other = own + (t == p), other + (t != p)
    return 2 * own <= other


def last_unit(answer: str) -> tuple[str, str]:
    """(state, unit): state is ``closed``, ``broken``, or ``open`` (no sign of an end; corpus counts decide)."""
    text = answer.rstrip()
    if text.count("```") % 2:
        return "broken", ""
    lines = text.split("\n")
    if len(re.findall(r"\\begin\{", text)) > len(re.findall(r"\\end\{", text)):
        return "broken", ""
    tail = re.sub(r"^```\s+", "", lines[-1].strip())
    block = re.search(r"```[^\n]*\n(.*?)\n?```$", text, re.S)
    if block:
        body = block.group(1)
        uneven = any(body.count(a) > body.count(b) for a, b in ("()", "[]", "{}"))
        return ("broken" if uneven or body.rstrip().endswith((":", ",", "(", "=")) else "closed"), ""
    if tail.startswith("|"):
        return "closed", ""
    if re.search(r"(?:https?://\S+|\\\]|\\\)|\$\$?|`)$", tail) or re.fullmatch(r"#{1,6} .*", tail):
        return "closed", ""
    item = re.match(r"(?:[-*+]|\d{1,3}[.)])\s+(.*)", tail)
    body = item.group(1) if item else tail
    unit = _SENTENCE.split(body)[-1].strip()
    bare = re.sub(r"[\"'”»)\]*_]+$", "", unit)
    last = unit.split()[-1].lower() if unit.split() else ""
    if bare[-1:] in ".!?…":
        two = "".join(unit.split()[-2:]).lower()
        if last.lstrip("(") in ABBREVIATIONS or two in ABBREVIATIONS or re.fullmatch(r"\(?(?:[a-z]\.){1,3}", last):
            return "broken", unit
        return "closed", unit
    if _OPEN_TAIL.search(unit):
        return "broken", unit
    if re.search(r"[\U0001F300-\U0001FAFF☀-➿]️?$", unit) or re.search(r"[\"”»]$", unit):
        return "closed", unit
    if item:
        others = []
        for line in reversed(lines[:-1]):
            m = re.match(r"\s*(?:[-*+]|\d{1,3}[.)])\s+(.*)", line)
            if not m and line.strip():
                break
            others += [m.group(1)] if m else []
        if others and all(o[-1:] not in ".!?" for o in others) and len(unit.split()) <= 6:
            return "listed", unit
    return "open", unit


# --- DataFrames ---------------------------------------------------------------------------------

_CLOSERS = re.compile(r"[.!?…\"'”»)\]*_\s]+$")
_ITEM = re.compile(r"\s*(?:[-*+>#|]+|\d{1,9}[.)])\s+")


def units_of(answer: str, state: str, last: str) -> list[tuple[str, bool]]:
    """(unit, whether it is complete) of an answer; its last unit is complete only if the answer is closed."""
    out = []
    lines = _CODE.sub(" ", answer).split("\n")
    for line in lines:
        m = _ITEM.match(line)
        parts = _SENTENCE.split(line[m.end() :] if m else line)
        out += [(u, True) for u in (_CLOSERS.sub("", p).strip() for p in parts) if u]
    if state in ("open", "listed"):
        bare = _CLOSERS.sub("", last).strip()
        if out and out[-1][0] == bare:
            out[-1] = (bare, False)
    elif state == "broken" and out:
        out.pop()
    return out


def prompt_pairs(entries: DataFrame, conversations: DataFrame) -> DataFrame:
    """(origin, record_key, turn_index, prompt, answer) of all pairs."""
    title = F.regexp_replace("title", r"(?i)^[\s\p{Z}]*prompted(?:[\s\p{Z}]+|$)", "")
    filled = lambda c: F.coalesce(F.regexp_replace(c, r"[\s\p{Z}\p{C}]+", "") != "", F.lit(False))
    parts = F.filter(F.transform("safeHtmlItem", lambda x: x["html"]), lambda h: h.isNotNull())
    a = entries.where(filled(F.col("title"))).select(
        F.lit("raw_entries").alias("origin"), F.col("entry_id").cast("string").alias("record_key"), F.lit(0).cast("bigint").alias("turn_index"),
        title.alias("prompt"), F.concat_ws("\n", parts).alias("answer"),
    )
    turns = conversations.select("chat_id", F.inline("turns")).select(
        "chat_id", F.col("turn_index").cast("bigint").alias("turn_index"), uniform_role(F.col("role")).alias("role"), "text"
    )
    turns = turns.where(F.col("chat_id").isNotNull() & F.col("turn_index").isNotNull()).distinct()
    asked = turns.where((F.col("role") == "user") & filled(F.col("text"))).select("chat_id", "turn_index", F.col("text").alias("prompt"))
    said = turns.where(F.col("role") == "assistant").select("chat_id", (F.col("turn_index") - 1).alias("turn_index"), F.coalesce("text", F.lit("")).alias("answer"))
    b = asked.join(said, ["chat_id", "turn_index"]).select(F.lit("conversations").alias("origin"), F.col("chat_id").alias("record_key"), "turn_index", "prompt", "answer")
    return spread(a).unionByName(b)


PAIR = "origin string, record_key string, turn_index bigint, defect string, state string, unit string, size int, same string, units array<struct<unit: string, whole: boolean>>"
_UNITS = pa.list_(pa.struct([("unit", pa.string()), ("whole", pa.bool_())]))


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """Add ``defect`` by the rules of one pair alone, ``state``, ``unit``, ``size`` of the answer's end, ``same``, equal for equal answers, and its units."""
    names = pairs.columns
    p, a = names.index("prompt"), names.index("answer")

    def judge(prompt: str | None, raw: str | None) -> tuple:
        answer = clean_text(raw or "") or ""
        if not readable(answer):
            return "empty", "closed", "", 0, None, None
        prompt = clean_text(prompt or "") or ""
        if is_copy(prompt, answer):
            return "copy", "closed", "", len(answer), None, None
        if is_refusal(answer):
            return "refusal", "closed", "", len(answer), None, None
        if wrong_language(prompt, answer):
            return "wrong_language", "closed", "", len(answer), None, None
        state, unit = last_unit(answer)
        # a whole link at the end closes what stands before it
        if state == "open" and _LINK_TAIL.search(raw):
            state = "closed"
        bare = _CLOSERS.sub("", unit).strip() if state in ("open", "listed") else ""
        return None, state, bare, len(answer), hashlib.blake2b(answer.encode("utf-8", "replace"), digest_size=16).hexdigest(), units_of(answer, state, unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [judge(x, y) for x, y in zip(b.column(p).to_pylist(), b.column(a).to_pylist())]
            cols = [pa.array([d[i] for d in done], pa.string()) for i in range(3)] + [pa.array([d[3] for d in done], pa.int32()), pa.array([d[4] for d in done], pa.string())]
            cols.append(pa.array([d[5] and [{"unit": u, "whole": w} for u, w in d[5]] for d in done], _UNITS))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)] + cols, names=[*names[:3], "defect", "state", "unit", "size", "same", "units"])

    return pairs.mapInArrow(run, PAIR)


#: Stretches of continuations after a unit, as (first, last) next signs; those after the first stretch go on inside a word.
_STRETCHES = [("", "\U0010ffff"), ("0", ":"), ("A", "["), ("a", "{"), ("\u00c0", "\u2000")]


def continuations(units: DataFrame, ends: DataFrame) -> DataFrame:
    """(unit, longer, inside) of the distinct ``ends`` (column unit): how many of ``units`` (unit, n) go on from it,
    and how many of these inside its last word.

    Both are sorted together by range. Units that go on from one are the stretch right after it, so each end sends
    marks for both ends of its stretches into the order, and takes the cumulative counts there; every partition counts
    for itself, and the totals of the partitions (one row each) are added afterwards.
    """
    marks = [(unit, sign) for k, stretch in enumerate(_STRETCHES) for unit, sign in ((k, -1), (k, 1))]
    keys = F.array(*[F.struct(F.concat("unit", F.lit(_STRETCHES[k][0 if sign < 0 else 1])).alias("key"), F.lit(k).alias("stretch"), F.lit(sign).alias("sign")) for k, sign in marks])
    asked = ends.select("unit").where("unit <> ''").distinct().select(F.col("unit").alias("end"), F.inline(keys)).withColumn("n", F.lit(0).cast("bigint"))
    counted = units.select(F.lit(None).cast("string").alias("end"), F.col("unit").alias("key"), F.lit(None).cast("int").alias("stretch"), F.lit(None).cast("int").alias("sign"), "n")
    # a unit comes before the marks at its own text: it is not longer than itself
    both = counted.unionByName(asked).repartitionByRange("key").sortWithinPartitions("key", F.col("end").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["end", "stretch", "sign", "part", "n"]
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for end, stretch, sign, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                total += n
                if end is not None:
                    out.append((end, stretch, sign, part, total))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int32()), pa.array([None], pa.int32()), pa.array([part], pa.int32()), pa.array([total], pa.int64())], names=names)

    counted = scratch_table(both.mapInArrow(run, "end string, stretch int, sign int, part int, n bigint"), "cumulated")
    totals = counted.where("end is null").select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = counted.where("end is not null").join(F.broadcast(totals), "part")
    found = (F.col("n") + F.col("before")) * F.col("sign")
    return at.groupBy(F.col("end").alias("unit")).agg(F.sum(F.when(F.col("stretch") == 0, found)).alias("longer"), F.sum(F.when(F.col("stretch") > 0, found)).alias("inside"))


def found_defects(entries: DataFrame, conversations: DataFrame) -> DataFrame:
    """(origin, record_key, turn_index, defect): one row per defective pair."""
    pairs = scratch_table(judged_pairs(prompt_pairs(entries, conversations)), "pairs")
    sound = pairs.where(F.col("defect").isNull())
    ends = sound.where(F.col("state").isin("open", "listed") & (F.col("unit") != ""))
    # copies of an answer count once and share its verdict
    answers = sound.select("same", "units").dropDuplicates(["same"]).select(F.inline("units"))
    units = scratch_table(answers.groupBy("unit").agg(F.count("*").alias("n"), F.count_if("whole").alias("whole")), "units")
    closing = ends.select("same", "unit", "size", "state").distinct()
    often = closing.groupBy("unit").agg(F.count("*").alias("times"))
    longer = continuations(units, often)
    word = F.element_at(F.split("unit", " "), -1)
    spoken = units.where("whole > 0").select(F.explode(F.split("unit", " ")).alias("last"), "whole").groupBy("last").agg(F.sum("whole").alias("spoken"))
    closed = units.where("whole > 0").select(word.alias("last"), "whole").groupBy("last").agg(F.sum("whole").alias("closed"))
    facts = often.join(longer, "unit", "left").join(units.select("unit", "whole"), "unit", "left").withColumn("last", word)
    lasts = facts.select("last").distinct().join(spoken, "last").join(closed, "last", "left").select("last", (F.coalesce("closed", F.lit(0)) / F.col("spoken")).alias("end_share"))
    facts = facts.join(lasts, "last", "left").select("unit", "times", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("longer", "inside", "whole")], F.coalesce("end_share", F.lit(0.0)).alias("end_share"))
    # what stands for the unit as a whole, and against it
    whole = (F.col("whole") > 0) & (F.col("whole") >= WHOLE_SHARE * (F.col("whole") + F.col("longer")))
    phrase = (F.col("times") >= SET_PHRASE) & (F.col("times") >= SET_SHARE * (F.col("times") + F.col("longer"))) & (F.col("inside") == 0)
    known_end = F.col("end_share") >= END_SHARE
    short = F.size(F.split("unit", " ")) < 3
    complete = whole | phrase | ((F.col("longer") == 0) & (known_end | short))
    facts = facts.select("unit", (~complete).alias("cut_open"), (F.col("inside") > F.col("whole")).alias("cut_listed"))
    sizes = closing.where("state = 'open'").groupBy("size").agg(F.count("*").alias("n"))
    nearby = sizes.select(F.col("n").alias("n2"), F.explode(F.sequence(F.col("size") - 10, F.col("size") + 10)).alias("size"))
    around = sizes.join(nearby, "size").groupBy("size", "n").agg(((F.sum("n2") - F.first("n")) / 20).alias("near"))
    limits = around.where((F.col("n") > SPIKE * F.col("near")) & (F.col("n") - F.col("near") > SIGMAS * F.sqrt(F.col("near") + 1))).select("size", F.lit(True).alias("limit"))
    # verdicts per different end, then per answer
    judged = closing.join(facts, "unit").join(limits, "size", "left")
    cut = F.when(F.col("state") == "open", F.col("cut_open") | F.coalesce("limit", F.lit(False))).otherwise(F.col("cut_listed"))
    keys = ["origin", "record_key", "turn_index"]
    broken = sound.where(F.col("state") == "broken").select(keys).unionByName(ends.select(*keys, "same").join(judged.where(cut).select("same"), "same", "left_semi").select(keys))
    return pairs.where(F.col("defect").isNotNull()).select(*keys, "defect").unionByName(broken.withColumn("defect", F.lit("truncated"))).distinct()
