"""Problem 4: personal information inside free text.

Method: regular expressions propose spans, validators confirm or weaken them (numbering plans, the rules and
check digits of national identity numbers, Luhn, mod 97), and words nearby adjust the score: a cue such as
"call me on" raises it, one such as "tracking" lowers it. Spans of at least ``THRESHOLD`` are kept, the better
of overlapping ones first, and replaced by typed placeholders such as ``[PHONE]``; the rest of the text stays
as it is. Names are decided by the class of the cue before them, their shape (two or more capitalised words),
a list of common given names and their place (a sign-off ends a text or a line), not by surnames.

A rule runs only on texts in which its *probe*, a simpler pattern that every match holds, is found; probes
are searched in whole Arrow columns at once.

Defined results: HTML entities are decoded and invisible format characters dropped before anything is
matched; null and empty texts hold nothing; each distinct ``(row, field, type, text)`` is reported once
however often it occurs; whole texts are read whatever their length; empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import ship

THRESHOLD = 0.5
NEAR = 36  # characters before a span in which a cue counts
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")

STREET = "street|st|road|rd|avenue|ave|close|lane|ln|drive|dr|court|ct|way|place|pl|crescent|cres|terrace|ter|square|sq|boulevard|blvd|gardens|grove|row|walk|mews|parkway|pkwy|highway|hwy"
PLAIN_WORDS = frozenset(
    "a an and are as at be but by can do for from get had has have he her his how i if in into is it its just me my no not of off on one or our out photos please she so some songs than that the their them then they this times to under up was we were what when which while who will with within without you your hours minutes days weeks percent years apple support team customer service everyone everybody nobody here there very really getting still only also sorry hello hi thanks thank good great all any because after before since about again network name model tag version already did no luck mac mini pro watch touch face id store music air series tv home pod macbook iphone ipad imac siri error code screen battery update cloud card phone email mail day night morning time regards best kind dear wishes second third first last next try message waiting lost broken fixed done help helping using trying going working".split()
)
ORDINARY = re.compile(r"(?:ing|ed|ly|tion|ment|able|ful|less|ness|ous|ity)$")  # endings of words, not of names
# Common given names of English, German, French and Spanish speaking countries and of their immigrants.
GIVEN = frozenset(
    "james john robert michael david william richard joseph thomas charles daniel matthew anthony mark steven paul andrew joshua kevin brian george edward jason ryan jacob eric jonathan stephen larry justin scott brandon benjamin samuel gregory frank patrick jack oliver harry noah leo oscar henry hugo lucas adam alex peter simon martin philip ian owen liam ethan logan "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy sandra ashley emily kimberly donna michelle carol amanda melissa deborah stephanie rebecca laura helen anna amy angela emma olivia ava sophia isabella mia charlotte amelia evelyn grace chloe lucy ruby ella isla julia clara eva alice rose jane kate claire hannah rachel wilma nina petra "
    "hans karl klaus jürgen stefan lukas felix jonas heike ursula sabine monika ingrid greta pierre jean luc michel camille élodie amélie louis jules marie juan carlos josé luis miguel pedro diego maria carmen lucía elena sofia pilar ivan tomas omar ahmed mohammed muhammad ali yusuf fatima nadia amina leila priya wei mei chen raj kofi kwame ibrahim quentin mina".split()
)


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return len(digits) > 1 and total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number in ISO 13616 form has the right check digits."""
    code = re.sub(r"\W", "", code).upper()
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", code)) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def phone_plan(text: str) -> float:
    """How well a number fits a numbering plan: North American, British, French, German, Spanish or international."""
    d = re.sub(r"\D", "", text)
    if text.lstrip().startswith("+"):
        if d.startswith("1"):
            return 0.3 if re.fullmatch(r"1[2-9]\d{2}[2-9]\d{6}", d) else -0.3
        return 0.3 if 9 <= len(d.replace("440", "44", 1) if d.startswith("440") else d) <= 15 else -0.3
    if re.fullmatch(r"0[1-9]\d{8,9}", d):
        return 0.2
    if re.fullmatch(r"1?[2-9]\d{2}[2-9]\d{6}", d):
        return 0.1
    if re.fullmatch(r"0[1-9]\d{7,10}", d) or (re.fullmatch(r"[67]\d{8}", d) and " " in text):
        return 0.0
    return -0.4


def iso7064(digits: str) -> bool:
    """Whether the last digit is the ISO 7064 mod 11,10 check digit of the others."""
    p = 10
    for c in digits[:-1]:
        p = (int(c) + p) % 10 or 10
        p = p * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def identity(found: str) -> float:
    """How well a number keeps the rules of an identity number of its form; 0 where the form has no rules."""
    x = re.sub(r"[\s.-]", "", found).upper()
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", found):  # US: area, group and serial, or a taxpayer's number
        area, group = int(x[:3]), int(x[3:5])
        if area >= 900:
            return 0.1 if 50 <= group <= 99 and group not in (66, 67, 68, 69, 89, 93) else -0.1
        return 0.2 if area not in (0, 666) and group and x[5:] != "0000" else -0.2
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", x):  # British national insurance: letters that may begin it
        return 0.2 if re.match(r"(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]", x) else -0.05
    if re.fullmatch(r"[\dXYZ]\d{7}[A-Z]", x):  # Spanish: the letter is the number modulo 23
        n = int("XYZ".find(x[0]) if x[0] in "XYZ" else x[0]) * 10**7 + int(x[1:8])
        return 0.4 if "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23] == x[8] else -0.3
    if re.fullmatch(r"[12]\d{14}", x):  # French: the key is 97 less the number modulo 97
        return 0.6 if 97 - int(x[:13]) % 97 == int(x[13:]) and 1 <= int(x[3:5]) <= 99 else -0.3
    if re.fullmatch(r"[1-9]\d{10}", x):  # German tax number
        return 0.25 if iso7064(x) else 0.0
    if re.fullmatch(r"\d{9}", x):  # Canadian
        return 0.1 if luhn(x) else 0.0
    return 0.0


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    base: float
    cue: re.Pattern | None = None
    probe: str = ""  # RE2, without regard to case: what every match holds


def _rx(p: str, flags: int = re.I) -> re.Pattern:
    return re.compile(p, flags)


NOT_PERSONAL = _rx(r"\b(?:order|case|serial|part|error|tracking|invoice|build|ticket|version|ref|reference|code|sku|imei|parcel)\b[\s:#.]*(?:no\.?|number|#|id|code)?[\s:#.]*$")
PHONE_CUE = _rx(
    r"\b(?:tel|telephone|phone|mobile|cell|text|ring|call|call me on|call ?back|whatsapp|sms|fax|dial|number is|my number|reach me|ring you on|contact|telefon|handy|mobil|anrufen|t[ée]l[ée]phone|portable|appelez|tel[ée]fono|m[óo]vil|ll[áa]m[ae])\b[^.!?]{0,24}$|\bis\s*$"
)
PHONE_AFTER = _rx(r"^\W{0,3}(?:is |still )?(?:the right number|your number|my number|after (?:six|\w+)|please|between|anytime)")
ID_CUE = _rx(
    r"(?:\bssn|\bsocial(?: security)?|\bsoc(?:ial)?\.? sec(?:urity)?|\bni\b|\bnino|\bnational insurance|\btax(?:payer)?(?: id(?:entification)?)?|\btin\b|\bpassport|\blicen[cs]e|\blicen[cs]e plate|\bidentity card|\bidentity|\bid card|\bnational id|\bpermit|\bsin\b"
    r"|\bsteuer-?(?:id|nummer)|\bidnr|\b(?:personal)?ausweis(?:nummer)?|\breisepass(?:nummer)?|\bsozialversicherungs?-?(?:nummer)?|\bführerschein(?:nummer)?|\bpasseport|\bcarte d.identit[ée]|\bs[ée]curit[ée] sociale|\bpermis|\bpasaporte|\bdni\b|\bnie\b|\bnif\b|\bseguridad social)"
    r"(?:[\s:#.,;-]|\bno\b|\bnumber\b|\bnr\b|\bis\b|\bit['’]s\b|\bid\b|\bmy\b|\bcard\b|\b[’']s\b|\bnummer\b|\bist\b|\blautet\b|\bnum[ée]ro\b|\best\b|\bes\b|\bn[úu]mero\b)*$"
)
ADDRESS_CUE = _rx(
    r"\b(?:address|live at|lives at|living at|deliver(?:ed)? to|ship(?:ped)?(?: it)? to|comes to|goes to|moved to|pick (?:it|them) up at|send it to|sent to|visit|based at|home is|at|wohne?(?: in)?(?: der)?|adresse|anschrift|habite(?: au)?|j.habite|domicilio|direcci[óo]n|vivo en)\b[\s:,]*$"
)
MAIL_CUE = _rx(r"\b(?:e-?mail|mail|write to|reach me at|login|went to|steps to|account|contact|address)\b[^.!?]{0,20}$")

_PART = r"[^\W_](?:[\w.+%-]*[\w])?"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_D, _S = r"\p{Nd}", r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"  # Python's \d and \s, for probes
_TEN = rf"{_D}(?:[^\p{{L}}\p{{Nd}}]{{0,4}}{_D}){{7}}"  # eight digits in a row of groups
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_OF = r"(?:(?i:de|du|des|del|della|di|la|le|les|los|las|el|y|von|der|dem|den)\s+|[ldLD]['’]\s?)*"
RULES = [
    Rule("email", _rx(rf"(?<![\w@+.%-]){_PART}@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+"), 0.8, MAIL_CUE, r"[\p{L}\p{N}_]@[\p{L}\p{N}]"),
    Rule("email", _rx(rf"(?<![\w@+.%-]){_PART}\s?[\[({{]\s?at\s?[\])}}]\s?[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+"), 0.7, MAIL_CUE, rf"[\[({{]{_S}?at{_S}?[\])}}]"),
    Rule("email", _rx(rf"(?<![\w@+.%-]){_PART}\sat\s[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*\s?(?:\sdot\s|[\[({{]\s?dot\s?[\])}}])\s?[^\W_]{{2,}}"), 0.6, MAIL_CUE, rf"{_S}at{_S}[^@]*dot"),
    Rule("email", _rx(rf"(?<![\w@+.%-]){_PART}@[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*(?:\sdot\s|\s?[\[({{]\s?dot\s?[\])}}]\s?)[^\W_]{{2,}}"), 0.7, MAIL_CUE, r"@.*dot"),
    Rule("email", _rx(rf"(?<![\w@+.%-]){_PART}\sat\s[^\W_][\w-]*(?:\.[^\W_][\w-]*)+"), 0.15, MAIL_CUE, rf"{_S}at{_S}[^\s.]+\.[^\s]"),
    Rule("phone", _rx(r"(?<![\w.,#/+-])(?:\+\d{1,3}[\s.-]?)?(?:\(0?\d{1,4}\)[\s.-]?)?\d{2,5}(?:[\s.-]?\d{3,4}){1,3}(?![\w/]|[.-]\d)"), 0.3, PHONE_CUE, _TEN),
    Rule("phone", _rx(r"(?<![\w.,#/+-])(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}(?![\w/]|[.-]\d)"), 0.4, PHONE_CUE, _TEN),
    Rule("phone", _rx(r"(?<![\w.,#/+-])\+44\s?(?:\(0\)\s?)?\d{2,4}[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?![\w/]|[.-]\d)"), 0.5, PHONE_CUE, rf"\+44{_S}?\(?{_D}"),
    Rule("phone", _rx(r"(?<![\w.,#/+-])(?:(?:\+|00)33\s?(?:\(0\)\s?)?|0)[1-9](?:[\s.-]?\d{2}){4}(?![\w/]|[.-]\d)"), 0.3, PHONE_CUE, _TEN),
    Rule("phone", _rx(r"(?<![\w.,#/+-])(?:(?:\+|00)49\s?(?:\(0\)\s?)?|0)[1-9]\d{1,4}\s?[/-]?\s?\d{3,8}(?:[\s-]\d{1,5}){0,2}(?![\w/]|[.-]\d)"), 0.3, PHONE_CUE, _TEN),
    Rule("id_number", _rx(r"(?<![\w.,#/+-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w/]|[.-]\d)"), 0.4, ID_CUE, rf"{_D}{{3}}[- ]{_D}{{2}}[- ]{_D}{{4}}"),
    Rule("id_number", _rx(r"(?<![\w.,/+-])[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-d](?![\w/])"), 0.4, ID_CUE, rf"[a-z\x{{17f}}\x{{212a}}]{{2}}{_S}?{_D}{{2}}{_S}?{_D}{{2}}{_S}?{_D}{{2}}{_S}?[a-d]"),
    Rule("id_number", _rx(r"(?<![\w.,/+-])[a-z]\d{3}-\d{4}-\d{4}(?![\w/]|-\d)"), 0.45, ID_CUE, rf"{_D}{{3}}-{_D}{{4}}-{_D}{{4}}"),
    Rule("id_number", _rx(r"(?<![\w.,/+-])(?:[a-z]{1,2}\d{6,9}|\d{9,11}|\d{2}[ .]\d{3}[ .]\d{3}[ .]\d{3}|\d{3}[ -]\d{3}[ -]\d{3,4})(?![\w/]|[.-]\d)"), 0.1, ID_CUE, rf"{_D}(?:[ .-]?{_D}){{5}}"),
    Rule("id_number", _rx(r"(?<![\w.,/+-])(?:\d{8}|[xyz]-?\d{7})-?[a-z](?![\w/])"), 0.15, ID_CUE, rf"{_D}{{7}}-?[a-z\x{{17f}}\x{{212a}}]"),
    Rule("id_number", _rx(r"(?<![\w.,/+-])[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}(?![\w/]|[.-]\d)"), 0.2, ID_CUE, rf"{_D}(?:{_S}?{_D}){{14}}"),
    Rule("street_address", _rx(rf"(?<![\w.,#/+-])\d{{1,5}}\s?[a-z]?(?:\s?-\s?\d{{1,4}})?,?\s+(?:[^\W\d_][\w'’-]*\.?\s+){{1,3}}?(?:{STREET})(?![\w'’-])"), 0.35, ADDRESS_CUE, rf"{_D}.*{_S}(?:{STREET})\b"),
    # French: number, type, name; Spanish and Italian: type, name, number; German: the type joined to the name or after it.
    Rule("street_address", _rx(rf"(?<![\w.,#/+-])\d{{1,4}}(?:\s?(?i:bis|ter|quater))?,?\s+(?i:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|passage|ruelle)\s+{_OF}{_CAP}(?:[ -]{_OF}{_CAP}){{0,3}}", 0), 0.5, ADDRESS_CUE, rf"{_D}.*{_S}(?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|passage|ruelle){_S}"),
    Rule("street_address", _rx(rf"(?<![\w@])(?i:calle|c/|avenida|avda\.?|plaza|paseo|camino|carretera|ronda|via|viale|piazza|corso)\s+{_OF}{_CAP}(?:\s+{_OF}{_CAP}){{0,3}},?\s+(?i:n[.º°o]*\s*)?\d{{1,4}}(?![\w/]|[.,-]\d)", 0), 0.5, ADDRESS_CUE, rf"(?:c/|calle|av|plaza|paseo|camino|carretera|ronda|via|piazza|corso).*{_D}"),
    Rule("street_address", _rx(r"(?<![\w@])(?:[A-ZÄÖÜ][\wäöüß-]*(?i:straße|strasse|str\.|weg|platz|allee|gasse|damm|ufer)|[A-ZÄÖÜ][\wäöüß-]*(?:[ -][A-ZÄÖÜ][\wäöüß-]*)?[ -](?:Straße|Strasse|Str\.|Allee|Platz|Gasse|Weg))\s+\d{1,4}\s?[a-h]?(?![\w/]|[.,-]\d)", 0), 0.5, ADDRESS_CUE, rf"(?:str|weg|platz|allee|gasse|damm|ufer).*{_D}"),
    Rule("card_number", _rx(r"(?<![\w.,#/+-])\d(?:[ -]?\d){12,18}(?![\w/]|[.-]\d)"), 0.1, None, rf"{_D}(?:[ -]?{_D}){{12}}"),
    Rule("account_number", _rx(r"(?<![\w])[a-z]{2}\d{2}(?:\s?[a-z0-9]{4}){2,7}(?:\s?[a-z0-9]{1,3})?(?!\w)"), 0.1, None, rf"[a-z\x{{17f}}\x{{212a}}]{{2}}{_D}{{2}}"),
]

_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_FAMILY = rf"(?:{_WORD})(?:-{_WORD})*"
_NAME = rf"({_WORD}(?:-{_WORD})?(?:\s+[^\W\d_]\.?(?=\s)){{0,2}}(?:\s+(?:van|von|de|der|den|di|da|del|la|le|bin|ibn|al|el|mac|ter))*\s+{_FAMILY})(?![\w@])"
_TITLE = r"(?:(?:mr|mrs|ms|miss|dr|prof|sir|madam)\.?\s+)?"
_KIN = "sister|brother|wife|husband|mother|father|mum|mom|dad|son|daughter|friend|boss|colleague|partner|neighbou?r|doctor|dentist|assistant|manager|flatmate|roommate|landlord|aunt|uncle|cousin|niece|nephew|girlfriend|boyfriend|fianc[ée]e?|client|grandmother|grandfather"
# (pattern, base, whether the end of a line or text speaks for a name, probe)
NAME_RULES = [
    (_rx(rf"\b(?:my (?:full )?name is|(?:my|full|his|her)? ?name\s?:|(?:is |are )?registered (?:to|for|under)|account holder(?: is)?\s?:?|in the name of|under the name(?: of)?|(?:device|account|order|contract|phone|line|booked|booking) (?:is )?under|mein name ist|ich hei(?:ß|ss)e|je m.appelle|mon nom est|me llamo|mi nombre es)\s+{_TITLE}{_NAME}"), 0.6, False, r"name|registered|holder|under|hei.*e|appelle|nom|llamo|nombre"),
    (_rx(rf"(?<!\w)is\s+{_TITLE}{_NAME}(?=\s+the account holder)"), 0.6, False, "account holder"),
    (_rx(rf"\b(?:this is|regards,?|best wishes,?|sincerely,?|cheers,?|ask for|dear|thank you,|thanks,|hello|hi|signed,?|yours,?|call for|speak to|attn:?|contact|named|gr[üu](?:ß|ss)e,?|cordialement,?|saludos,?)\s+{_TITLE}{_NAME}"), 0.3, True, r"\b(?:this is|regards|best wishes|sincerely|cheers|ask for|dear|thank you,|thanks,|hello|hi|signed|yours|call for|speak to|attn|contact|named|gr[üu](?:ß|ss)e|cordialement|saludos)"),
    (_rx(rf"\b(?:my|our|his|her|their)\s+(?:{_KIN}),?\s+(?:is\s+|called\s+|named\s+)?{_TITLE}{_NAME}"), 0.3, False, rf"\b(?:my|our|his|her|their){_S}+(?:{_KIN})"),
    (_rx(rf"(?<!\w)(?:mr|mrs|ms|miss|dr|prof|herr|frau|monsieur|madame|señora?)\.?\s+{_NAME}"), 0.3, False, r"\b(?:mr|mrs|ms|miss|dr|prof|herr|frau|monsieur|madame|señora?)\b"),
    (_rx(rf"(?<!\w)(?:i am|i['’]m|it['’]s|here is|ich bin|je suis|soy)\s+{_NAME}"), 0.1, True, r"\b(?:i am|i['’]m|it['’]s|here is|ich bin|je suis|soy)"),
    (_rx(rf"(?:^|(?<=[\s.!?)\]]))[-–—~]\s?{_TITLE}{_NAME}"), 0.2, True, r"[-–—~]"),
]


def _name_score(text: str, a: int, b: int, ends: bool) -> float:
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", text[a:b])
    full = [w for w in words if len(w) > 1]
    if len(full) < 2 or any(w.lower() in PLAIN_WORDS for w in full):
        return -1.0
    score = 0.25 if all(re.match(r"[^\W\d_a-zà-ÿ]", w) and not w.isupper() for w in (full[0], full[-1])) else 0.0
    if not score and text[max(0, a - NEAR) : b + 12].islower() and not any(ORDINARY.search(w) for w in full):
        score += 0.15  # nothing nearby is written with capitals
    if full[0].lower() in GIVEN:
        score += 0.3
    if ends and re.match(r"\W*(?:[\n.,;!]|$)", text[b : b + 40]):
        score += 0.1
    return score


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def readable(text: str) -> str:
    """The text with entities decoded and invisible format characters dropped."""
    if "&" in text:
        text = html.unescape(text)
    return INVISIBLE.sub("", text)


ALL_RULES = [*RULES, *NAME_RULES]
PROBES = [r.probe if isinstance(r, Rule) else r[3] for r in ALL_RULES]


def _proposals(text: str, wanted: list[int] | range) -> Iterator[Span]:
    for n in wanted:
        if n >= len(RULES):
            pattern, base, ends, _ = ALL_RULES[n]
            for m in pattern.finditer(text):
                score = base + _name_score(text, *m.span(1), ends)
                if score >= THRESHOLD:
                    yield Span("person_name", *m.span(1), score)
            continue
        rule = RULES[n]
        for m in rule.pattern.finditer(text):
            a, b = m.span()
            before, found = text[max(0, a - NEAR) : a], m.group()
            score = rule.base
            if rule.cue is not None and rule.cue.search(before):
                score += 0.4
            if NOT_PERSONAL.search(before):
                score -= 0.6
            if rule.kind == "phone":
                score += phone_plan(found) + (0.2 if PHONE_AFTER.search(text[b : b + 24]) else 0)
                if ID_CUE.search(before):
                    score -= 0.5
                if not 9 <= sum(c.isdigit() for c in found) <= 15:
                    score -= 1
            elif rule.kind == "id_number":
                score += identity(found)
            elif rule.kind == "street_address":
                words = re.findall(r"[^\W\d_][\w'’-]*", found)
                if len(words[0]) == 1 and len(words) > 2:
                    words = words[1:]
                if rule.pattern.flags & re.I:
                    if any(w.lower() in PLAIN_WORDS for w in words[:-1]):
                        continue
                    if all(w[0].isupper() for w in words):
                        score += 0.2
            elif rule.kind == "card_number":
                score += 0.6 if luhn(re.sub(r"\D", "", found)) else -1
            elif rule.kind == "account_number":
                score += 0.7 if mod97(found) else -1
            if score >= THRESHOLD:
                yield Span(rule.kind, a, b, score)


def spans(text: str, wanted: list[int] | range = range(len(ALL_RULES))) -> list[Span]:
    """The kept spans of a readable text, in order; overlaps go to the better, then the longer one."""
    kept: list[Span] = []
    for s in sorted(_proposals(text, wanted), key=lambda s: (-s.score, s.start - s.end, s.start)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def plain(found: str) -> str:
    return "".join(c for c in found.lower() if c.isalnum())


def redact(text: str | None) -> str | None:
    """The readable text with a typed placeholder in place of each span."""
    return None if text is None else _redacted(*next(_with_spans([text])))


def _redacted(text: str, found: list[Span]) -> str:
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


def _with_spans(texts: list[str | None]) -> Iterator[tuple[str, list[Span]]]:
    """Each readable text with its spans; a rule runs on the texts its probe is found in."""
    clean = [readable(t) if t else "" for t in texts]
    column = pa.array(clean, pa.large_string())
    probed = {p: pc.match_substring_regex(column, "(?s)" + p, ignore_case=True).to_numpy(zero_copy_only=False) for p in set(PROBES)}
    hits = np.stack([probed[p] for p in PROBES], axis=1)
    for text, hit, some in zip(clean, hits, hits.any(axis=1)):
        yield text, spans(text, np.flatnonzero(hit).tolist()) if some else []


TYPES = ("email", "phone", "id_number", "street_address", "person_name")


def _find(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            ids = batch.column("row_id").to_pylist()
            for f in fields:
                for i, (text, found) in zip(ids, _with_spans(batch.column(f).to_pylist())):
                    out.update((i, f, s.kind, plain(text[s.start : s.end])) for s in found)
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*sorted(out))], names=["row_id", "text_field", "pii_type", "pii_text"])

    return run


def find(df: DataFrame, fields: list[str], row_id: str = "row_id") -> DataFrame:
    """``(row_id, text_field, pii_type, pii_text)``, each distinct row once."""
    ship(df.sparkSession)
    source = df.select(F.col(row_id).cast("long").alias("row_id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return source.mapInArrow(_find(fields), "row_id long, text_field string, pii_type string, pii_text string").distinct()


def _redact_all(texts: list[str | None]) -> pa.Array:
    return pa.array([None if raw is None else _redacted(*x) for raw, x in zip(texts, _with_spans(texts))], pa.string())


def _redact(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("row_id"), *(_redact_all(batch.column(f).to_pylist()) for f in fields)], names=["row_id", *fields])

    return run


def redacted(df: DataFrame, fields: list[str], row_id: str = "row_id") -> DataFrame:
    """``row_id`` and the fields with placeholders."""
    ship(df.sparkSession)
    source = df.select(F.col(row_id).cast("long").alias("row_id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return source.mapInArrow(_redact(fields), "row_id long, " + ", ".join(f"`{f}` string" for f in fields))
