"""Personal information inside free text: candidate spans, boosted trees, calibrated thresholds.

Generators with high recall propose overlapping spans; boosted trees score each by its format and context;
where accepted spans overlap, the longest, then the most probable, is kept. The trees are trained on a bounded sample of
documents. Rules of high precision label some of its candidates: words that announce a kind of data, titles, and forms
that are none. They are no features of the trees, which see a candidate's form and the words around it, and decide of all
candidates, those without any such word, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import BoostedTrees, best_threshold, calibration, sigmoid

KINDS = ("name", "email", "phone", "id_number", "address")

# Forms of address, and particles of surnames.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Captain Judge Justice Master Sir Lord Lady Dame Herr Frau Richter Richterin M Mme Mlle Me Madame Monsieur Maître Juge".split()
PARTICLES = frozenset("von van der den de la di du zu".split())

# Words that go on the name of a company, body or statute.
COMPANY = frozenset(
    """ltd limited plc llp llc inc corp co gmbh ag kg se sa sarl bv nv ab oy holdings group bank trust authority mutual co-operative cooperative dairies rail textiles
    freight power insurance chemicals stadtwerke housing bros brothers partners university council ministry department court tribunal bench division harbour act code
    rules ordinance statute regulations street road lane avenue close row rise quay works""".split()
)

# Further words that are part of headings, courts and dates or start sentences, and are not of persons' names.
OTHERS = COMPANY | frozenset(
    """courts high appeal county land commercial amtsgericht landgericht oberlandesgericht verwaltungsgericht gericht cour chambre section sections acts order headnote
    leitsatz sommaire tenor dispositif page seite exhibit counsel costs before no nr docket paragraph corrected version fassung nothing that the this in as it we see
    service notices tel fax phone telefon téléphone id nat box personenkennzahl ausweis ausweisnummer passport identity identité january february march april may june july august september october november december januar februar märz mai juni juli oktober
    dezember janvier février mars avril juin juillet août septembre octobre novembre décembre auf der die das den dem nach vgl az und für von ortstermin schreiben
    le la les voir dans comme visite notification juge richter judge re administrative copie kopie cc of and at by to or d'appel""".split()
)

_L = r"[^\W\d_]"
_UP = r"[A-ZÀ-ÖØ-ÞĀĆČĎĐĒĘĚĞĢĪĶŁŃŇŌŐŒŘŚŠŤŪŮŰŹŻŽ]"
# A word of a name, an initial, a particle, or a title with its point.
_TOKEN = re.compile(rf"(?:[aAeE][lL]-)?{_UP}(?:[\w’'\-]*\w|\.(?!\w))|(?:[vV]on|VON|[vV]an|VAN|der|DER|den|DEN|[dD]e|DE|[lL]a|LA|di|du|zu)(?!\w)")
_POINT = r"(?:(?<=\b[DM]r)\.|(?<=\bM[rm]s)\.|(?<=Prof)\.)?"
_RUN = re.compile(rf"{_UP}(?<![\w\-’'].)(?:[\w’'\-]*\w|\.(?!\w)){_POINT}(?:,?\s+(?:{_TOKEN.pattern}){_POINT})+")
_ABBREVIATION = re.compile(r"[B-DF-HJ-NP-TV-XZ]{2,5}")

# Where an address of electronic mail has its sign, or what is written for it. Its local part has at most 64 characters (RFC 5321).
_SIGNS = ("@", *(o + s + w for o in "[({" for s in ("", " ") for w in ("at", "AT")))
_AT = re.compile(r"@|[\[({]\s?(?:at|AT)\s?[\])}]")
_LOCAL = re.compile(r"[\w.+\-]{0,63}\w\s?$")
_DOMAIN = re.compile(r"\s?\w[\w\-]*(?:(?:\.|\s?[\[({]\s?(?:dot|DOT|punkt|point)\s?[\])}]\s?)\w[\w\-]*)+")
_EXT = r"(?:\s*(?:,\s*)?(?:ext\.?|extension|x|Durchwahl|Dw\.?|App\.?|poste)\s*\d{1,5})?"
# Digits and separators, six or more: only there a number is looked for.
_DENSE = re.compile(r"\d[\d+()\-./–‑ \t\n]{4,}\d")
_DIGITS = re.compile(rf"[\d+(](?<![\w.\-/–].)(?:(?<=\d)\d*|(?<=[+(])\+?\s?\d+)(?:\)?[ \-./–‑\t\n]{{0,2}}\(?\d+\)?)+{_EXT}")
_LETTERED = re.compile(r"[A-Z](?<!\w.)[A-Z]{0,2}[ \n/]?\d\d+(?:[/ \n]\d+)*(?:\s?[A-Z](?!\w))?\b(?!-\d)")
_ORDINARY = re.compile(r"\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{2}-\d{2}|\d{4}/\d{4}|\d+/\d\d|[\d.]+,\d\d|[\d,]+\.\d\d|\d+ \((?:1[89]|20)\d\d\)?")
_S = r"[ \t\n ]+"
_TOWN = rf"{_UP}{_L}+(?:-{_UP}{_L}+)*"
_POST = r"(?:\d{4,5}|[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2})"
_HOUSE = rf"\d{{1,4}}\s?[A-Za-z]?(?:{_S}(?:bis|ter|quater))?"
_TAIL = rf"(?:,{_S}|{_S}(?:in|à|at|en){_S})(?:{_POST}{_S})?{_TOWN}(?:,?{_S}{_POST}(?!\w))?"
_UNIT = rf"(?:Flat|Unit|Apartment|Apt\.?|Suite|Room|Wohnung|Whg\.?|Appartement|Appt\.?|App\.?){_S}\d{{1,4}}[A-Za-z]?"
_BOX = rf"(?:P\.\s*O\.\s*Box|PO\s+Box|Box|Postfach|B\.?P\.?|Boîte{_S}postale|Case{_S}postale){_S}\d{{1,6}}"
_STREET_WORD = rf"(?:St\.|{_UP}(?:{_L}|['’])+(?:-{_UP}{_L}+)*)"
_RUE = rf"(?:rue|avenue|boulevard|place|quai|chemin|allée|impasse|cours|route)(?:{_S}(?:de|du|des|la|le|les|d['’]|l['’]))*(?:\s*{_STREET_WORD}){{1,4}}"
_KIND_OF_STREET = r"(?:Street|St\.|Road|Rd\.|Lane|Avenue|Row|Rise|Quay|Close|Court|Place|Square|Drive|Way|Terrace|Crescent)"
# With the number first, or a box; and with the street first. What reaches from the number to the town decides, however long it is.
_NUMBERED = re.compile(
    rf"(?:{_UNIT}(?:,{_S}|/))?(?:\d{{1,4}}{_L}?(?:{_S}{_STREET_WORD}){{1,4}}|{_HOUSE},?{_S}{_RUE}){_TAIL}|{_BOX}{_TAIL}"
)
_STREET_FIRST = re.compile(
    rf"(?:{_UP}{_L}*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|steig|markt|graben|hof|kai)|(?:Am|An der|An den|Im|In der|Auf der|Zum|Zur|Alte|Alter|Neue|Neuer)(?:{_S}{_STREET_WORD}){{1,3}})"
    rf"{_S}\d{{1,4}}\s?[A-Za-z]?(?:\s*/\s*\d{{1,4}})?{_TAIL}"
)
_NO_NUMBER = re.compile(rf"(?:{_STREET_WORD}{_S}){{1,3}}{_KIND_OF_STREET}{_TAIL}|{_RUE}{_TAIL}")
_UNIT_LEFT = re.compile(rf"(?<!\w){_UNIT}(?:,{_S}|/)$")
_BOX_LEFT = re.compile(rf"(?<!\w)(?:P\.\s*O\.\s*Box|PO\s+Box|Box|Postfach|B\.?P\.?|(?:Boîte|Case){_S}postale){_S}$")
_WORDS = re.compile(r"\b[^\W\d_]")
# A number and what may follow it in an address: capitalised words that lead to a town, a French street, or a town and its postcode.
_HOUSE_NUMBER = re.compile(
    rf"\d\s?[A-Za-z]?(?:\s+(?:bis|ter|quater))?(?:,?\s+(?=(?:{_UP}[\w.'’\-]+\s+){{0,3}}{_UP}[\w.'’\-]+(?:,\s|\s+(?:in|à|at|en)\s)|(?:rue|avenue|boulevard|place|quai|chemin|allée|impasse|cours|route)\b)"
    rf"|(?:,\s+|\s+(?:in|à|at|en)\s+)(?:{_POST}\s+)?(?={_UP}))"
)
_POSTED = re.compile(rf",{_S}(?:{_POST}{_S}{_UP}|{_UP}{_L}+(?:-{_UP}{_L}+)*,?{_S}{_POST}(?!\w))")
_STREETS = re.compile(r"(?i)\b(?:street|lane|road|avenue|row|rise|quay|close|court|place|square|drive|way|box|rue|quai|allée|chemin|boulevard|impasse|postfach|bp)\b|straße|weg\b|gasse|platz|ufer|damm|ring\b|^(?:Am|Im|An|Zum|Zur)\s")
_HAS_POST = re.compile(rf"(?<!^)(?<!\w){_POST}(?!\w)")
_HIDDEN = re.compile(r"[█▇▓■*_]|\bx{2,}|\[[^\]]{0,30}$")
_BLOCKED = re.compile(r"[█▇▓■]|\*{2,}|_{2,}|\bx{2,}")
_CITED = re.compile(r"[^;\n]{0,90}?(?:\[\d{4}\]|\(\d{4}\)|,\s\d+\s\w+\.\s\w+\.)")
_AGAINST = re.compile(r"(?:^|[\s(])(?:v|vs|gegen|c/|contre)\.?\s*$")
_VERSUS = re.compile(r"\s+(?:v|vs|gegen|c/|contre)\.?\s")

# Words that announce a kind of number, read from the left, and words that announce another.
_SAYS = {
    "phone": r"(?:tel|tél|phone|fax|mobile|mobil|telefon|téléphone|call|cell)\s?\.?\s?:?",
    "id_number": r"(?:identity\s+(?:number|card(?:\s+no\.)?)|\bid\s?(?:no\.)?:|card\s+no\.|ausweis(?:\s+nr\.|nummer)|personenkennzahl|carte\s+n°|d['’]identité|passport(?:\s+no\.)?|identité\s+nationale\s*:?)",
}
_ANNOUNCE = {k: re.compile(rf"(?:{a})\s*$", re.I) for k, a in _SAYS.items()}
_ELSE = re.compile(r"(?i)(?:docket|case|file|dossier|az\.|§+|sections?|art(?:icle|ikel)?\.?|paragraphs?|pages?|seite|sum\s+of|costs\s+of|somme\s+de|betrag\s+von|[$€£])\s*$")
_CODE = re.compile(r"(?<!\w)[A-Z]{1,4}[ \-/]$")
_NAMED = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr)\.?|\b(?:Herr|Frau|Captain|Mme|Judge|Justice|Richter|Richterin|Juge)\s?:?)\s+$")
_RESTS = re.compile(rf"\s*[.;,)](?:\s|$)|[ ]+(?!(?:{'|'.join(sorted(PARTICLES))})\s)[a-zàéè]|\n|\s*$")


@lru_cache(maxsize=200_000)
def shape(span: str) -> str:
    """Digits as 9, capitals as A, small letters as a, runs of letters as one; a line's end is a blank."""
    span = re.sub(r"(ext\.?|x|poste|App\.?|Dw\.?)(\s*)\d+$", r"\1\g<2>0", span)
    return re.sub(r"a+", "a", re.sub(r"A+", "A", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "9", re.sub(r"\s+", " ", span)))))


@dataclass(slots=True)
class Candidate:
    """A span and the kinds it may be of."""

    start: int
    end: int
    kinds: tuple[str, ...]
    form: int = 0


_NUMBER_KINDS = (("phone",), ("phone", "id_number"))
_FORMS = re.compile(r"(p*w,wi*w?)|(w{1,3}i*p*w)|(i+p*w)")


@lru_cache(maxsize=100_000)
def _names_of_run(run: str) -> tuple[tuple[int, int, int], ...]:
    """Start, end and form of the sub-spans of a run of capitalised words that have the form of a name.

    Forms: 1 SURNAME, Given; 2 up to three given names and surname; 3 initials and surname; 4 surname after a title.
    """
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(run)]
    n, kinds, out = len(tokens), [], []
    comma = [i > 0 and run[tokens[i - 1][1] : tokens[i - 1][1] + 1] == "," for i in range(n)]
    for i, (_, _, t) in enumerate(tokens):
        if t[-1] == ".":
            kinds.append("i")
        elif t.lower() in PARTICLES:
            kinds.append("p")
        elif t.lower() in OTHERS or t in TITLES or t[:2] in ("L'", "L’") or _ABBREVIATION.fullmatch(t) and not (i + 1 < n and comma[i + 1]):
            kinds.append("x")
        else:
            kinds.append("w")
    titled = [i > 0 and tokens[i - 1][2].rstrip(".") in TITLES for i in range(n)]
    for i in range(n):
        if kinds[i] == "x":
            continue
        if titled[i] and not comma[i]:
            j = i
            while j < n - 1 and kinds[j] == "p":
                j += 1
            if kinds[j] == "w":
                out.append((tokens[i][0], tokens[j][1], 4))
        form = ""
        for j in range(i, n):
            if kinds[j] == "x":
                break
            if j > i and comma[j]:
                if kinds[j - 1] != "w" or not tokens[j - 1][2].isupper() or "," in form:
                    break
                form += ","
            form += kinds[j]
            m = _FORMS.fullmatch(form)
            if m:
                out.append((tokens[i][0], tokens[j][1], m.lastindex))
            if form.count("w") > 3 and "," not in form:
                break
    return tuple(out)


def _name_candidates(text: str) -> Iterator[Candidate]:
    for run in _RUN.finditer(text):
        lo = run.start()
        for a, b, form in _names_of_run(run[0]):
            yield Candidate(lo + a, lo + b, ("name",), form)


# Where a sentence ends within a run of numbers, but for the point of what stands before an extension.
_SENTENCE = re.compile(r"(?<!ext)(?<!App)(?<!Dw)\.\s")


@lru_cache(maxsize=100_000)
def _numbers_of_run(whole: str) -> tuple[tuple[int, int], ...]:
    """Spans of a run of digits and separators that may be a number: the run, and the parts between wider separators."""
    if len(whole) < 7 or _ORDINARY.fullmatch(whole):
        return ()
    spans = {(0, len(whole))}
    for cut in re.finditer(r"\n+|(?<!ext)\.\s|\s\(|\t", whole):
        spans |= {(0, cut.start()), (cut.end(), len(whole))}
    tail = re.search(r"\s\d{1,2}[/.]\d{1,2}[/.]\d{4}$|\s\d{4}-\d{2}-\d{2}$", whole)
    if tail:
        spans.add((0, tail.start()))
    out = []
    for a, b in sorted(spans):
        part = whole[a:b].rstrip(" \n\t.-/–(")
        if 6 <= sum(map(str.isdigit, part)) <= 20 and not _ORDINARY.fullmatch(part.strip("()")) and "\n\n" not in part and not _SENTENCE.search(part):
            out.append((a, a + len(part)))
    return tuple(out)


def _number_candidates(text: str) -> Iterator[Candidate]:
    """Numbers of six digits or more; the same span may be a phone's and an identity's."""
    for dense in _DENSE.finditer(text):
        if sum(map(str.isdigit, dense[0])) < 6:
            continue
        at = dense.start()
        while at and text[at - 1] in "+(":
            at -= 1
        while at < dense.end():
            if not (m := _DIGITS.match(text, at)):
                if not (near := _DIGITS.search(text, at, dense.end())):
                    break
                m = _DIGITS.match(text, near.start())
            yield from _spans_at(text, m.start(), m[0])
            at = m.end()
    for m in _LETTERED.finditer(text):
        yield from _spans_at(text, m.start(), m[0])


def _spans_at(text: str, start: int, run: str) -> Iterator[Candidate]:
    for a, b in _numbers_of_run(run):
        a, b = a + start, b + start
        part = text[a:b]
        # A bracket opened before the run belongs to it.
        if ")" in part and "(" not in part and a and text[a - 1] == "(":
            a, part = a - 1, "(" + part
        if part.count("(") == part.count(")"):
            yield Candidate(a, b, _NUMBER_KINDS[sum(map(str.isdigit, part)) <= 14])


def _emails(text: str) -> Iterator[Candidate]:
    if not any(sign in text for sign in _SIGNS):
        return
    for m in _AT.finditer(text):
        local, domain = _LOCAL.search(text, max(0, m.start() - 65), m.start()), _DOMAIN.match(text, m.end())
        if local and domain:
            yield Candidate(m.start() - len(local[0]), domain.end(), ("email",))


def _reaching(pattern: re.Pattern, text: str, start: int, at: int) -> Iterator[tuple[int, int]]:
    """The longest match that begins with a word between ``start`` and ``at`` and reaches beyond."""
    for word in _WORDS.finditer(text, start, at):
        found = pattern.match(text, word.start())
        if found and found.end() > at:
            yield found.span()
            return


def _addresses(text: str) -> Iterator[Candidate]:
    """Addresses lie around a unit's, house's or box's number, or between a street's and a town's name with a postcode."""
    found: list[tuple[int, int]] = []
    for m in _HOUSE_NUMBER.finditer(text):
        at = m.start()
        while at and text[at - 1].isdigit():
            at -= 1
        if text[at - 2 : at - 1].isalpha() or text[at - 2 : at - 1] in "./":
            start = max(text.rfind(x, 0, at - 2) for x in ".:;,") + 1
            found += _reaching(_STREET_FIRST, text, start, at)
        if found and at < found[-1][1] or m.start() - at > 5:
            continue
        # A unit's number is written before the house's, a box's word before its number.
        unit = _UNIT_LEFT.search(text, max(0, at - 24), at) or _BOX_LEFT.search(text, max(0, at - 24), at)
        first = unit.start() if unit else at
        if (unit or m.start() - at < 4 and (not at or text[at - 1] not in ".,/-–")) and (whole := _NUMBERED.match(text, first)):
            found.append(whole.span())
    for m in _POSTED.finditer(text):
        if not any(a <= m.start() < b for a, b in found):
            start = max(max(text.rfind(x, 0, m.start() - 4) for x in (".", ":", ";", "\n\n")), 0)
            found += _reaching(_NO_NUMBER, text, start, m.start())
    for a, b in found:
        yield Candidate(a, b, ("address",))


def candidates(text: str) -> list[Candidate]:
    """All spans that might be personal data; they may overlap."""
    spans = {(c.start, c.end, c.kinds): c for c in _addresses(text)}
    return [*_emails(text), *spans.values(), *_number_candidates(text), *_name_candidates(text)]


def _word(text: str) -> str:
    return text.strip(" \t\n.,;:()[]").lower()


def _number_free(text: str) -> str:
    return "9" if text[:1].isdigit() else text


_GOES_ON = re.compile(r"\s?[\-./–(]?\s?\d")
_COMES_FROM = re.compile(r"\d\s?[\-./–)]?\s?$")


def is_cited(left: str, after: str) -> bool:
    """Whether a span is a party in the title of a cited ruling, which its year or reporter follows."""
    return (_VERSUS.match(after) or left[-8:-1].strip() and _AGAINST.search(left[-12:])) and _CITED.match(after) is not None


def is_french(text: str) -> bool:
    """Whether the words around are French, where "M." and "Me" are titles."""
    return text.count(" le ") + text.count(" la ") + text.count(" du ") + text.count(" est ") > text.count(" the ") + text.count(" der ") + text.count(" of ")


def mister_is_title(text: str, c: Candidate) -> bool:
    """Whether the "M." or "Me" at or before a span is a title: in French, but for a judge's initial after "Juge :"."""
    judge = text[max(0, c.start - 12) : c.start].rstrip("M. \n").endswith("Juge :")
    return not judge and is_french(text[max(0, c.start - 300) : c.end + 300])


@lru_cache(maxsize=200_000)
def _name_keys(span: str, form: int) -> tuple[str, str, str, str]:
    words = [w for w in re.split(r"[\s,]+", span) if len(w) > 2 and w.lower() not in PARTICLES]
    words = words[::-1] if form == 1 else words
    first, last = (words[0].lower(), words[-1].lower()) if words else ("", "")
    return f"g:{first if form in (1, 2) else ''}", f"e:{last[-4:]}", f"b:{last[:3]}", f"f:{form}"


# What stands between the parties of a case.
_BETWEEN = frozenset(("v", "v.", "vs", "vs.", "gegen", "c/", "contre"))


def describe(text: str, c: Candidate) -> tuple[list[str], list[float]]:
    """What a candidate is known by (its context, its shape, the parts of a name), and features that need no dictionary."""
    span = text[c.start : c.end]
    left, after = text[max(0, c.start - 40) : c.start], text[c.end : c.end + 110]
    before, behind = left.split(), after[:40].split(None, 2)
    nearest, following = before[-1] if before else "", behind[0] if behind else ""
    r1 = after[:1].strip() + _word(following)
    r2 = f"{_number_free(following)} {_number_free(behind[1])}".lower() if len(behind) > 1 else following.lower()
    name = c.form > 0
    keys = [f"l:{_number_free(_word(nearest))}", f"L:{_number_free(before[-2]) if len(before) > 1 else ''} {_number_free(nearest)}".lower(), f"r:{_number_free(r1)}", f"R:{r2}"]
    keys += _name_keys(span, c.form) if name else (f"s:{shape(span)}" if c.kinds[0] == "phone" else "", "", "", "")
    hidden = _HIDDEN.search(left[-2:] + after[:2]) is not None
    inside = left[-1:].isalnum() or after[:1].isalnum()
    kept = left.rstrip()
    sentence = kept[-1:] in ".;:!?" or "\n" in left[len(kept) :] or nearest.strip("[](§).").isdigit()
    out = [len(span), span.count(" "), "\n" in span, hidden, c.form, inside, span.isupper(), "\n\n" in span, sentence, left[-1:] == "(" and after[:1] == ")"]
    if name:
        blank = after[:1] in (" ", "\n")
        other = following == "&" or blank and _word(following) in COMPANY
        mister = span.startswith(("M. ", "M.\n")) or left.endswith(("M. ", "M.\n"))
        french = mister and mister_is_title(text, c)
        # Whether a capitalised word that is no title, or an initial, goes on into the span, or out of it.
        joined = nearest[:1].isupper() and len(kept) < len(left) and nearest.rstrip(",").rstrip(".").replace("-", "").isalpha() and nearest.rstrip(".") not in TITLES
        cited = (following in _BETWEEN or nearest.lstrip("(") in _BETWEEN) and is_cited(left[-30:], after)
        onward = blank and following[:1].isupper() or after[:1] == "-" and after[1:2].isupper()
        out += [other, cited, 0 if not french else 1 if span[0] == "M" and span[1] == "." else -1, mister and not french, joined, onward, 0, 0, 0, 0]
    elif c.kinds[0] == "phone":
        out += [0, 0, 0, 0, 0, 0, sum(map(str.isdigit, span)), _CODE.search(left[-6:]) is not None, _GOES_ON.match(after) is not None, _COMES_FROM.search(left[-4:]) is not None]
    else:
        out += [0, 0, 0, 0, 0, 0, _STREETS.search(span) is not None, _HAS_POST.search(span) is not None, any(map(str.isdigit, span.partition(",")[0])), nearest[:1].isdigit()]
    return keys, out


def label(text: str, c: Candidate, kind: str) -> int | None:
    """What the rules of high precision say: 1, 0, or None where they say nothing."""
    left, right = text[max(0, c.start - 70) : c.start], text[c.end : c.end + 110]
    span = text[c.start : c.end]
    if left[-1:].isalnum() or right[:1].isalnum() or _BLOCKED.search(span) or "\n\n" in span:
        return 0
    if kind == "email":
        return 1
    if kind == "address":
        if not _STREETS.search(span):
            return 0
        starts = re.search(r"(?:^|\n\s*|\.\s+)[\[(§]?$", left)
        return None if starts else 1
    if kind in ("phone", "id_number"):
        if _ORDINARY.fullmatch(span):
            return 0
        if _GOES_ON.match(right) and "\n" not in right[:2] or re.match(r"\s*(?:ext\.?|x)\s*\d", right) or re.search(r"[\d+]\s?[\-./–)]?\s?$", left) and "\n" not in left[-2:]:
            return 0 if not re.match(r"\s+\d{1,2}[/.]\d|\s+\d{4}-", right) else None
        if re.search(r"\t|\s\d{1,2}[/.]\d{1,2}[/.]\d{4}$", span):
            return 0
        if _ANNOUNCE[kind].search(left):
            # Over a line's end the number may go on, or the next paragraph's begin: its shape, known from others, will tell.
            return None if "\n" in span or re.match(r"\n[ ]?\d", right) else 1
        other = "id_number" if kind == "phone" else "phone"
        return 0 if _ANNOUNCE[other].search(left) or _ELSE.search(left) or _CODE.search(left[-6:]) else None
    words = re.split(r"[\s,]+", span)
    after = right[:30].split()
    if after and right[:1] in " \n" and (_word(after[0]) in COMPANY or after[0] == "&") or is_cited(left, right):
        return 0
    if c.form == 3 and span.startswith("M.") and mister_is_title(text, c):
        return 0
    if any(_word(w) in OTHERS and w.lower() not in PARTICLES for w in words):
        return 0
    if re.match(rf"[ \n]{_UP}", right) and not re.match(rf"\n{_UP}", right) or re.match(rf"-{_UP}", right):
        return 0
    if c.form == 4 and re.search(r"(?:\bM\.|\bMe)\s+$", left):
        return int(mister_is_title(text, c))
    if re.match(rf"\s+(?:{'|'.join(sorted(PARTICLES))})\s+{_UP}", right):
        return 0
    if _NAMED.search(left) and _RESTS.match(right):
        return 1
    if c.form < 4 and "\n" not in span and re.search(r"\n\s*$", left) and _VERSUS.match(right):
        return 1
    if c.form == 1 and _RESTS.match(right) and re.search(r"[.;:)]\s+$|\n\s*(?:[\[(§]?\d+[\])]?\.?\s+)?$|[a-z]\s+$", left):
        return 1
    if left[-1:] == "(" and right[:1] == ")" and c.form < 4:
        return 1
    return None


def _surface(span: str, kind: str) -> str:
    """A name by its longest word, a number by itself."""
    return max(re.split(r"[\s,.]+", span), key=len).lower() if kind == "name" else " ".join(span.split())


@dataclass
class Detector:
    """What is known of the candidates' keys by kind, trees over all kinds, what each kind's own trees add, and each kind's scale and threshold."""

    known: dict[str, dict[str, float]] = field(default_factory=dict)
    common: BoostedTrees | None = None
    trees: dict[str, BoostedTrees] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def features(self, rows: list[tuple[str, list[str], list[float]]]) -> np.ndarray:
        """Of (kind, keys, plain): the keys' weights in that kind, the plain features, and which kind."""
        own = {k: (self.known.get(k, {}).get, [float(k == x) for x in KINDS]) for k in KINDS}
        return np.array([[*[own[kind][0](k, 0.0) for k in keys], *plain, *own[kind][1]] for kind, keys, plain in rows], float).reshape(len(rows), -1)

    def scores(self, kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.common is None:
            return np.full(len(x), -9.0)
        out = self.common.score(x)
        for kind, trees in self.trees.items():
            at = np.flatnonzero(kinds == kind)
            if len(at):
                out[at] += trees.score(x[at])
        return out

    @staticmethod
    def fit(texts: list[str], seed: int = 5) -> "Detector":
        """From a sample of texts: some teach the keys, some the trees, some calibrate.

        The rules are sure of some candidates. What they say nothing of is labelled by another view of it: a
        number by its shape, a name by its words elsewhere in the text or by the words around it, if
        almost all sure candidates that share these are of one class (co-training: the shapes of announced
        numbers label those nothing announces, and the words around titled names those without title). These
        labels owe nothing to the rules' own words, and they calibrate scales and thresholds, too.
        """
        detector = Detector()
        part = np.random.default_rng(seed).choice(3, len(texts), p=[0.3, 0.45, 0.25])
        seen: list[tuple[int, str, int | None, tuple[list[str], list[float]], tuple[int, int], tuple[str, ...], set]] = []
        for i, text in enumerate(texts):
            found = [(c, kind, label(text, c, kind)) for c in candidates(text) for kind in c.kinds]
            sure = [(c.start, c.end, kind) for c, kind, y in found if y]
            own = {(kind, _surface(text[a:b], kind)) for a, b, kind in sure}
            described: dict[int, tuple[list[str], list[float]]] = {}
            for c, kind, y in found:
                # What overlaps a sure span of its kind without being it is none, if it is shorter.
                if any(c.start < b and a < c.end and kind == k and c.end - c.start < b - a for a, b, k in sure):
                    y = 0
                if id(c) not in described:
                    described[id(c)] = describe(text, c)
                keys = described[id(c)][0]
                views = (f"{kind}{keys[4]}",) if kind in ("phone", "id_number") else (f"{kind}{keys[1]}", f"{kind}{keys[3]}") if kind == "name" else ()
                seen.append((i, kind, y, described[id(c)], (c.start, c.end), views, (kind, _surface(text[c.start : c.end], kind)) in own and kind == "name"))
        for _ in range(2):
            odds: dict[str, list[int]] = {}
            for _, kind, y, _, _, views, _ in seen:
                if y is not None:
                    for v in views:
                        odds.setdefault(v, [0, 0])[y] += 1
            again = []
            for i, kind, y, about, span, views, known in seen:
                if y is None:
                    votes = [odds[v] for v in views if v in odds and sum(odds[v]) >= 3]
                    yes, no = any(b >= 0.9 * (a + b) for a, b in votes), any(a >= 0.95 * (a + b) for a, b in votes)
                    y = 1 if (yes or known) and not (no and kind != "name") else 0 if no and not yes else None
                again.append((i, kind, y, about, span, views, known))
            seen = again
        sure_at: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for i, kind, y, _, span, _, _ in seen:
            if y:
                sure_at.setdefault((i, kind), []).append(span)
        rows: list[list[tuple[str, list[str], list[float], int]]] = [[], [], []]
        for i, kind, y, about, (lo, hi), _, _ in seen:
            if any(lo < b and a < hi and hi - lo < b - a for a, b in sure_at.get((i, kind), ())):
                y = 0
            if y is not None:
                rows[part[i]].append((kind, *about, y))
        counts: dict[str, dict[str, list[float]]] = {k: {} for k in KINDS}
        for kind, keys, _, y in rows[0]:
            for k in keys:
                if k:
                    counts[kind].setdefault(k, [0.5, 0.5])[y] += 1
        detector.known = {kind: {k: float(np.log(b / a)) for k, (a, b) in own.items() if a + b >= 3} for kind, own in counts.items()}
        fit, held = rows[1] or rows[0] or rows[2], rows[2] or rows[1] or rows[0]
        if not fit:
            return detector
        x, y, kinds = detector.features([r[:3] for r in fit]), np.array([r[3] for r in fit], float), np.array([r[0] for r in fit])
        detector.common = BoostedTrees(depth=6, trees=60).fit(x, y)
        start = detector.common.score(x)
        for kind in KINDS:
            at = np.flatnonzero(kinds == kind)
            if len(at):
                detector.trees[kind] = BoostedTrees(depth=5, trees=100).fit(x[at], y[at], start=start[at])
        x, y, kinds = detector.features([r[:3] for r in held]), np.array([r[3] for r in held], float), np.array([r[0] for r in held])
        s = detector.scores(kinds, x)
        for kind in KINDS:
            at = np.flatnonzero(kinds == kind)
            detector.scales[kind] = calibration(s[at], y[at])
            a, b = detector.scales[kind]
            detector.thresholds[kind] = best_threshold(sigmoid(a * s[at] + b), y[at])
        return detector

    def find(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """Of each text the spans found: kind, start, end, probability; none overlap."""
        where: list[tuple[int, int, int]] = []
        rows: list[tuple[str, list[str], list[float]]] = []
        for i, text in enumerate(texts):
            for c in candidates(text) if text else ():
                keys, out = describe(text, c)
                for kind in c.kinds:
                    where.append((i, c.start, c.end))
                    rows.append((kind, keys, out))
        found: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
        if rows and self.common is not None:
            kinds = np.array([r[0] for r in rows])
            s = self.scores(kinds, self.features(rows))
            a, b, least = (np.array([f[k] for k in KINDS]) for f in ({k: v[0] for k, v in self.scales.items()}, {k: v[1] for k, v in self.scales.items()}, self.thresholds))
            which = np.array([KINDS.index(r[0]) for r in rows])
            p = sigmoid(a[which] * s + b[which])
            for j in np.flatnonzero(p >= least[which]):
                i, lo, hi = where[j]
                found[i].append((float(p[j]), lo, hi, rows[j][0]))
        out = []
        order = {"email": 0, "address": 1, "phone": 2, "id_number": 2, "name": 3}
        for spans in found:
            kept: list[tuple[str, int, int, float]] = []
            for score, a, b, kind in sorted(spans, key=lambda s: (order[s[3]], s[1] - s[2], -s[0], s[1])):
                if all(b <= x or a >= y for _, x, y, _ in kept):
                    kept.append((kind, a, b, score))
            out.append(sorted(kept, key=lambda s: s[1]))
        return out


def train(docs: DataFrame, id_: str, text: str, sample: int = 1_200, longest: int = 40_000) -> Detector:
    """A detector from at most ``sample`` documents, chosen by a hash of their ids; of those, none longer than ``longest``.

    The bounds hold for training only: detection reads every text whole. The number of rows, which a columnar
    file states without being read, gives a first cut by hash, so what the tasks send for the ranking stays
    near the sample's size at any scale.
    """
    share = min(1.0, 1.5 * sample / max(1, docs.count()))
    rows = docs.select(F.xxhash64(id_).alias("h"), F.col(id_).alias("i"), F.col(text).alias("t"))
    likely = rows.where((F.pmod("h", F.lit(1 << 40)) < share * float(1 << 40)) & F.length("t").between(1, longest))
    return Detector.fit([r.t for r in likely.orderBy("h", "i").limit(sample).select("t").collect()])


def find_personal(docs: DataFrame, id_: str = "doc_id", text: str = "text", detector: Detector | None = None) -> DataFrame:
    """Every occurrence: ``id_``, ``kind``, ``start_char``, ``end_char``, ``probability``, ``surface``.

    Positions count code points from 0, the end is exclusive; spans of a text don't overlap. Null and empty
    texts have none, repeated rows give repeated results, an empty table gives an empty one, other columns
    are ignored. Texts are read whole.
    """
    known = detector or train(docs, id_, text)
    kind = dict(docs.dtypes)[id_]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column("t").to_pylist()
                found = known.find(texts)
                at = [i for i, spans in enumerate(found) for _ in spans]
                flat = [s for spans in found for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("i").take(pa.array(at, pa.int64())), pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int64()),
                        pa.array([s[2] for s in flat], pa.int64()), pa.array([s[3] for s in flat], pa.float64()), pa.array([texts[i][s[1] : s[2]] for i, s in zip(at, flat)], pa.string()),
                    ],
                    names=[id_, "kind", "start_char", "end_char", "probability", "surface"],
                )

    rows = docs.select(F.col(id_).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    return rows.mapInArrow(scan, f"`{id_}` {kind}, kind string, start_char bigint, end_char bigint, probability double, surface string")


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """``text`` with every span replaced by its kind in brackets."""
    if text is None:
        return None
    for kind, a, b, _ in sorted(spans, key=lambda s: -s[1]):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def redact_personal(docs: DataFrame, id_: str = "doc_id", text: str = "text", detector: Detector | None = None) -> DataFrame:
    """``id_``, the text with typed placeholders for what ``find_personal`` finds, and the number of placeholders; null stays null."""
    known = detector or train(docs, id_, text)
    kind = dict(docs.dtypes)[id_]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            found = known.find(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), pa.array([redact(t, s) for t, s in zip(texts, found)], pa.string()), pa.array([len(s) for s in found], pa.int32())], names=[id_, text, "redactions"]
            )

    return docs.select(F.col(id_).alias("i"), F.col(text).alias("t")).mapInArrow(scan, f"`{id_}` {kind}, `{text}` string, redactions int")


def summary(found: DataFrame) -> DataFrame:
    """Occurrences and documents by kind."""
    return found.groupBy("kind").agg(F.count("*").alias("found"), F.mean("probability").alias("probability"))


__all__ = ["BoostedTrees", "Candidate", "Detector", "candidates", "find_personal", "redact_personal", "summary", "train"]
