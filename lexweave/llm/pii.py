"""Personal information inside free text (problem 3).

A transducer turns a text into a shadow in which homoglyphs, full-width characters, hidden characters, spelled
digits and disguised at and dot signs are plain; it keeps the places where lengths differ, so that every span found
in the shadow is mapped back to the characters of the source. Identifiers are recognised on the shadow: email
addresses, telephone numbers, personal documents, street addresses and names of persons. Overlaps go to the kind
that is most specific (email, document, address, telephone, name).

Defined results: null, empty and blank texts hold nothing and come out unchanged; spans never overlap, count code
points of the source and end after the last character; equal texts give equal spans; extra columns are ignored; a
text of any length is read whole, in time that grows with its length.

Words that are Greek or Cyrillic throughout (four letters or more) are left as they are; everything else is flattened.
Rules that look at a bounded part of the text: what introduces or excludes a number stands within 32 characters before
it, a person who acts within 48 characters before the verb, a German street name has at most 80 characters.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.session import spread

KINDS = ("EMAIL", "ID", "ADDRESS", "PHONE", "NAME")
PLACEHOLDER = {"EMAIL": "[EMAIL]", "PHONE": "[TELEFONO]", "ID": "[DOCUMENTO]", "ADDRESS": "[INDIRIZZO]", "NAME": "[NOME]"}

# ---------------------------------------------------------------- the transducer

#: Letters that look like Latin ones (fixed values).
_LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХҮаеіјорсхуѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABESIJKMHOPCTXYaeijopcxysdhABEZHIKMNOPTYX"))
_FLAT = {ord(k): v for k, v in _LOOKALIKES.items()}
_FLAT |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}
_FLAT |= {c: " " for c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xA0, 0x2007, 0x2009, 0x202F, 0x3000)}
_FLAT |= {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013)}
_FLAT |= {0x2019: "'", 0x2018: "'", 0x00B4: "'", 0x0060: "'"}
#: Whole words of another alphabet, which are no disguise.
_FOREIGN = re.compile(r"((?<![^\W\d_])[\u0370-\u04ff]{4,}(?![^\W\d_]))")
_DIGITS = {"zero": "0", "uno": "1", "due": "2", "tre": "3", "quattro": "4", "cinque": "5", "sei": "6", "sette": "7", "otto": "8", "nove": "9"}
_DIGIT = "|".join(_DIGITS)
_AT = r"\s*[(\[{<]\s*(?:at|chiocciola|et)\s*[)\]}>]\s*|\s+(?:chiocciola)\s+"
_DOT = r"\s*[(\[{<]\s*(?:dot|punto)\s*[)\]}>]\s*"
_DISGUISE = re.compile(
    rf"(?P<hidden>[\u00ad\u200b-\u200f\u2060\ufeff]+)|(?P<at>(?<=[\w+-])(?:{_AT})(?=\w))|(?P<dot>(?<=\w)(?:{_DOT})(?=\w))"
    rf"|(?P<digits>(?<![\w])(?:{_DIGIT})(?:[\s,.-]+(?:{_DIGIT})){{5,14}}(?!\w))|(?P<mixed>(?<=\d{3})[OoIl](?=\d{3}))",
    re.I,
)
_HINT = re.compile(r"[(\[{<]\s*(?:at|chiocciola|et|dot|punto)\s*[)\]}>]|chiocciola", re.I)
_HIDDEN = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]|\d{3}[OoIl]\d{3}")
#: Anything but the characters that need no translation.
_ODD = re.compile(r"[^\n\x20-\x5f\x61-\x7e\xa1-\xb3\xb5-\xff’‘“”«»„…€]")


class Shadow:
    """The plain form of a text and the way back to its characters."""

    def __init__(self, text: str):
        if _ODD.search(text):
            flat = "".join(x if k % 2 else x.translate(_FLAT) for k, x in enumerate(_FOREIGN.split(text)))
        else:
            flat = text.replace("\n", " ").replace("’", "'")
        self.text, self.at, self.src = flat, [0], [0]
        low = flat.lower()
        if not (_HINT.search(flat) or _HIDDEN.search(flat) or sum(map(low.count, _DIGITS)) > 5):
            return
        parts, end, size = [], 0, 0
        for m in _DISGUISE.finditer(flat):
            plain = {"hidden": "", "at": "@", "dot": "."}.get(m.lastgroup)
            if m.lastgroup == "digits":
                plain = "".join(_DIGITS[w.lower()] for w in re.findall(_DIGIT, m.group(), re.I))
            elif m.lastgroup == "mixed":
                plain = "0" if m.group() in "Oo" else "1"
            parts += [flat[end : m.start()], plain]
            size += m.start() - end
            for k in range(len(plain)):
                # every plain character but the first points to the end of what it stands for
                self.at.append(size + k)
                self.src.append(m.start() if k == 0 else m.end())
            size += len(plain)
            self.at.append(size)
            self.src.append(m.end())
            end = m.end()
        parts.append(flat[end:])
        self.text = "".join(parts)

    def back(self, a: int, b: int) -> tuple[int, int]:
        """Source span of the shadow span [a, b)."""
        return self._one(a), self._one(b - 1, True) if b > a else self._one(a)

    def _one(self, p: int, last: bool = False) -> int:
        k = bisect_right(self.at, p) - 1
        if not last:
            return self.src[k] + p - self.at[k]
        if k + 1 < len(self.at) and self.at[k + 1] == p + 1:
            return self.src[k + 1]  # the end of what one plain character stands for
        return self.src[k] + p - self.at[k] + 1


# ---------------------------------------------------------------- the recognisers

_LABEL = r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?|[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?)"
#: What follows the name of an address: its sign and domain.
_DOMAIN = re.compile(rf"@(?:{_LABEL}\.)+(?:[a-z]{{2,}}|[A-Z]{{2,}})(?![\w@])|@(?:{_LABEL}\.)+(?:[a-z]{{2,}}|[A-Z]{{2,}})(?=\.?[A-ZÀ-Þ][a-z])")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, from each sign outward; no run of letters without a sign is looked at."""
    at, last = text.find("@"), 0
    while at >= 0:
        a, k = at, at
        while k > last and (text[k - 1].isalnum() or text[k - 1] in "_.+'-"):
            k -= 1
            if text[k].isalnum() or text[k] == "_":
                a = k
        if a < at and (m := _DOMAIN.match(text, at)):
            yield a, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


_TAX = r"[A-Za-z]{3}\s?[A-Za-z]{3}\s?\d{2}[A-Za-z]\d{2}\s?[A-Za-z]\d{3}[A-Za-z]"
_ID = re.compile(rf"(?<!\w)(?:{_TAX}|[A-Z]{{2}}\s?\d{{7}}|[A-Z]{{2}}\s?\d{{5}}\s?[A-Z]{{2}}|[A-Z]\d{{8}}[A-Z]|[A-Z]{{2}}\d{{7}}[A-Z])(?!\w)")
_SSN = re.compile(r"(?i:\bssn|\bsocial\ssecurity)\W{0,4}(?i:(?:n|no|number)\W{0,3})?(\d{3}-\d{2}-\d{4})(?![\w-])")
_ID_CUE = re.compile(r"(?i)(?:passap\w*|patente\w*|identit\w*|documento|c\.\s?i\.|carta)\W{0,3}(?:(?:n|nr|num|numero|rilasciat\w+)\W{0,3})*$")
_NO_ID = re.compile(r"(?i)(?:iban|iva|p\.\s?iva|conto|prot|targa|lotto)\W{0,4}(?:n\W{0,3})?$")

_PHONE = re.compile(
    r"(?<![\w.,/€+-])(?:"
    r"(?:\+|00)39[\s.-]?(?:\(0?\d{2,4}\)|\d{2,4})(?:[\s./-]?\d{2,7}){1,4}"
    r"|\(0\d{1,3}\)\s?\d{2,4}(?:[\s.-]?\d{2,4}){1,2}"
    r"|3\d{2}[\s.-]\d{2,3}[\s.-]?\d{2,3}[\s.-]?\d{2,4}"
    r"|3\d{2}[\s./-]\d{6,7}|3\d{8,9}"
    r"|0\d{1,3}\s?[/-]\s?\d{5,8}"
    r"|0\d{1,3}\s\d{3}\s?\d{3,4}"
    r"|\(\d{3}\)\s?\d{3}-\d{4}|0[1-9](?:[ .]\d{2}){4}|\+(?!39)[1-9]\d{0,2}(?:[\s.-]?\(?\d{1,4}\)?)(?:[\s.-]?\d{2,4}){2,4}"
    r")(?![\w/-]|[.,]\d|\s?(?:€|euro|EUR))"
)
_NO_PHONE = re.compile(r"(?i)(?:prot|conto|iva|iban|cartella|fattura|sent|fasc|rif|r\.g|atto|codice|ric|bonifico|lotto)\W{0,4}(?:(?:n|nr)\W{0,3})?$|(?:€|eur|euro)\s?$|(?:\bn|\bnr|n°)\W{0,2}$")

_U, _L = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_TOWN = rf"[{_U}][\w']+(?:\s(?:di|del|della|dei|sul|sulla|in|al|d')\s?[{_U}][{_L}']+|\s[{_U}][{_L}']+)*"
_STREET = (
    rf"(?:(?i:v\.?\s?le|viale|via|c\.?so|corso|p\.?zza|piazza(?:le|tta)?|largo|vicolo|strada|contrada|c\.da|lungomare|borgo|salita|vico|traversa|galleria|l\.go|str\.)\s+"
    rf"(?:\d{{1,2}}\s)?(?:(?i:del|della|delle|degli|dei|dello|dell'|di|de|d')\s?)?[{_U}][\w']+(?:\s(?:(?i:del|della|delle|degli|dei|di|da|e)\s)?[{_U}][{_L}'\w]*\.?){{0,4}}"
    rf"|[{_U}][\w-]{{1,80}}(?i:straße|strasse|gasse|weg|platz|allee|ring|ufer)|[{_U}][\w-]{{1,80}}(?i:\s(?:straße|strasse|street|road|lane|avenue)))"
)
_ADDRESS = re.compile(
    rf"(?<![\w@.])(?:{_STREET})"
    rf"(?:\s?,)?\s*(?:(?i:n\.?\s?°|n\.|nr\.|num\.|n|numero|civico)\s?)?\d{{1,4}}(?:\s?/\s?[\dA-Za-z]{{1,2}}|\s(?i:bis|ter|quater)|\s?[a-zA-F])?(?!\w|[.,]\d)"
    rf"(?:\s?,\s*(?i:scala|sc\.|int\.|interno|piano|appartamento|app\.|lotto|pal\.)\s?\w{{1,4}}(?!\w))*"
    rf"(?:(?:\s?,|\s?-)?\s*\d{{5}}\s+{_TOWN}(?:\s?\([A-Z]{{2}}\))?|\s+-\s+{_TOWN}(?:\s?\([A-Z]{{2}}\))?|\s?,\s{_TOWN}\s?\([A-Z]{{2}}\))?"
)
#: Addresses that begin with the number of the house.
_NUMBER_FIRST = re.compile(
    rf"(?<![\w.,/-])\d{{1,5}}(?:\s?(?:bis|ter))?,?\s+(?:(?i:rue|avenue|boulevard|chemin|quai|impasse)\s+(?:(?:de|du|des|la|le|les|l'|d')\s?){{0,2}}[{_U}][\w'-]{{1,40}}(?:\s(?:(?:de|du|des|la)\s)?[{_U}][\w'-]{{1,40}}){{0,3}}"
    rf"|[{_U}][{_L}]{{2,40}}(?:\s[{_U}][{_L}]{{2,40}}){{0,2}}\s(?:Street|Road|Lane|Avenue|Drive|Square))(?:\s?,\s*(?:\d{{5}}\s+)?{_TOWN})?(?!\w)"
)

#: Given names common in England, France, Germany and Spain (fixed values).
ABROAD = "john james robert michael william david richard charles george mary elizabeth susan margaret sarah emily jean pierre jacques françois philippe claire sophie isabelle hans klaus jürgen wolfgang peter heinrich ingrid ursula josé juan carlos miguel manuel carmen isabel"
#: Given names and pet forms common in Italy (fixed values).
GIVEN = """
maria teresa|pier paolo|alessandra|alessandro|alessia|alessio|alfredo|alice|andrea|angela|angelo|anna|antonella|antonia|antonietta|antonino|antonio|arturo|aurora|
beatrice|benedetta|berenice|bruno|carla|carlo|carmela|caterina|cecilia|chiara|cinzia|clara|claudia|claudio|concetta|cristina|daniela|daniele|dario|davide|debora|diego|domenica|domenico|
edoardo|elena|eleonora|elisa|elisabetta|emanuele|emilia|emilio|enrico|ernesto|ettore|eugenio|fabio|fabrizio|federica|federico|filippo|filomena|fiorella|flavia|franca|francesca|francesco|franco|fulvio|
gabriele|gaetano|gennaro|giacomo|gianni|ginevra|giorgia|giorgio|giovanna|giovanni|giulia|giulio|giuseppe|giuseppina|grazia|guido|ida|ilaria|irene|jolanda|iolanda|iole|laura|leonardo|letizia|lorenzo|luca|lucia|luciano|luigi|luigia|luisa|
marcello|marco|margherita|maria|mario|marta|martina|massimo|matteo|maurizio|michele|monica|niccolò|niccolo|nicola|nicolò|nicolo|nunzia|ornella|oreste|otello|paola|paolo|pasquale|patrizia|piero|pietro|raffaele|raffaella|renato|riccardo|rita|roberta|roberto|rocco|rosa|rosaria|ruggero|
salvatore|sandra|sandro|sara|serena|sergio|silvia|simona|simone|sofia|stefania|stefano|tancredi|teresa|tommaso|ubaldo|umberto|valentina|valeria|vincenza|vincenzo|vittoria|vittorio|zoè|zoe|
ale|betta|cate|lella|lele|mena|nanni|nico|tina|tonio|tonia|tonino|turi|pierpa|ila|nice|enzo|beppe|pino|gigi|rino|titti|lina|peppe|ciccio|dino|gino|totò|toni|franci|cetta|concettina|enza|lollo|lori|micky|miche|rosy|sal|vale|vince|bice|ninni|nina|nino|memo|mimmo|chicca|chicco|fede|gio|gianna|giusi|peppina|pina|rugge|tano|ubi|uba
""".replace("\n", "")
_GIVEN = "(?i:" + "|".join(sorted(GIVEN.split("|") + ABROAD.split(), key=len, reverse=True)).replace(" ", r"\s+") + ")'?"
_FAMILY = rf"(?:(?:De|Di|Del|Della|D')\s?)?(?:[{_U}][{_L}]{{2,}}(?:['-][{_U}]?[{_L}]+)?|[{_U}]{{3,}})"
_INITIAL = rf"[{_U}]\."
_LOWER = rf"[{_L}]{{4,}}"

_FULL = rf"{_GIVEN}\s+{_FAMILY}|(?:{_INITIAL}\s?){{1,2}}{_FAMILY}|{_FAMILY},?\s+{_GIVEN}(?![\w.])|{_FAMILY},?\s+{_INITIAL}(?:\s?{_INITIAL})?"
_FREE = re.compile(rf"(?<![\w@.+'-])(?:(?P<a>{_GIVEN}\s+(?:[{_U}][{_L}]{{4,}}|[{_U}]{{5,}}))|(?P<d>(?:[{_U}][{_L}]{{5,}}|[{_U}]{{5,}}),?\s+(?=[{_U}]){_GIVEN}))(?![\w@-])")
_CUED = re.compile(
    rf"(?:{_FULL}|[{_U}][{_L}]{{2,3}}\.\s?{_FAMILY}|{_GIVEN}\s+{_LOWER}|{_LOWER},?\s+{_GIVEN}|{_FAMILY}(?:\s+[{_U}][{_L}]{{1,}})?\s+(?:[{_U}][{_L}]{{2,}}))(?![\w@])"
)
_ALONE = re.compile(rf"(?:[{_U}][{_L}]{{4,}}|[{_U}]{{5,}})(?![\w@.])")
_TITLE = r"sig\.?\s?(?:ra|na|nora)?\.?|signor[ae]?|avv\.(?:\s?to)?|avvocato|dott\.?\s?(?:ssa|re)?\.?|dottor(?:essa)?|prof\.?\s?(?:ssa)?\.?|ing\.|arch\.|geom\.|rag\.|on\.le"
_DATE = r"\d{1,2}°?(?:\s\w+\s|[./-]\d{1,2}[./-])\d{4}"
_CUE = re.compile(
    rf"(?<![\w])(?:(?P<title>{_TITLE})|teste|ricorrente|comparso|comparsa|esibit[oa]\s+da|ha\s+detto|affidat[ao]\s+a|contattare|digitalmente\s+il\s+{_DATE}\s?,|intestat[ao]\s+al?\s+(?:signor|sig\.)|(?P<list>eredi\s?:|tra))\s+?(?=\S)",
    re.I,
)
_ACTS = re.compile(
    rf"(?<![\w.@])(?<!\w\. )({_GIVEN}\s+{_LOWER}|{_LOWER},?\s+{_GIVEN}|{_INITIAL}\s?{_FAMILY}|{_FAMILY},?\s+{_INITIAL}|[{_U}][{_L}]{{2,3}}\.\s{_FAMILY}|{_FAMILY},?\s+{_GIVEN})(?=\s(?i:ha|aveva|è)\s)"
)
_PREFIXES = {g[:k] for g in GIVEN.split("|") for k in (3, 4) if len(g) > 4}
_BRACKET = re.compile(r"\s?\(\s?")
_AND = re.compile(r"\s?(?:,|;|\be\b|\bed\b)\s+(?:e\s+)?")
_NOT_NAMES = frozenset("justice corte tribunale giudice procura banca società consulente commissario direttore presidente sindaco legge codice cassa comune fratelli gruppo".split())
_FIRM_AFTER = re.compile(r"(?i)\s+(?:s\.?p\.?a|s\.?r\.?l|s\.?n\.?c|soc\.|onlus|scarl|società|& c)\b")


def _name_at(text: str, p: int, shouting: bool, title: bool) -> tuple[int, int] | None:
    m = _CUED.match(text, p)
    if m and (not shouting or not m.group().isupper() or re.search(rf"\b{_GIVEN}(?!\w)", m.group())):
        words = m.group().lower().split()
        if not _NOT_NAMES.intersection(w.strip(".,") for w in words):
            return m.span()
    if title and (m := _ALONE.match(text, p)) and not (shouting and m.group().isupper()) and m.group().lower() not in _NOT_NAMES:
        return m.span()
    return None


_WORD = re.compile(r"[^\W\d_]+")
#: What a word may begin: a cue to a name, an address, a given name, an act of a person.
_CUE_WORDS = "sig signor signora signore avv avvocato dott dottor dottoressa dottore prof ing arch geom rag on teste ricorrente comparso comparsa esibito esibita ha affidata affidato contattare digitalmente eredi tra"
_STREET_WORDS = "v viale via c corso p piazza piazzale piazzetta largo vicolo strada contrada lungomare borgo salita vico traversa galleria l str vle cso pzza"
_NUMBERED = "rue avenue boulevard chemin quai impasse street road lane drive square".split()
_TABLE: dict[str, int] = {}
for _bit, _words in ((1, _CUE_WORDS.split()), (2, _STREET_WORDS.split()), (4, [g.split()[0] for g in GIVEN.split("|") + ABROAD.split()]), (8, ["ha", "aveva", "è"]), (16, _NUMBERED)):
    for _w in _words:
        _TABLE[_w] = _TABLE.get(_w, 0) | _bit
_GERMAN = ("straße", "strasse", "gasse", "weg", "platz", "allee", "ring", "ufer", "street", "road")


def _anchors(text: str) -> tuple[list[int], list[int], list[int], list[int], bool]:
    """Places where a cue, an address, a given name (with the word before it) or an act may stand; whether a street is named the other way round."""
    cues: list[int] = []
    streets: list[int] = []
    given: list[int] = []
    acts: list[int] = []
    before, numbered = -1, False
    get = _TABLE.get
    for m in _WORD.finditer(text):
        w = m.group().lower()
        bits = get(w, 0)
        if bits:
            if bits & 1:
                cues.append(m.start())
            if bits & 2:
                streets.append(m.start())
            if bits & 4:
                if before >= 0:
                    given.append(before)
                given.append(m.start())
            if bits & 8:
                acts.append(m.start())
            numbered |= bits > 15
        elif len(w) > 6 and w.endswith(_GERMAN):
            streets.append(m.start())
            if before >= 0:
                streets.append(before)
        before = m.start()
    return cues, streets, given, acts, numbered


def _names(text: str, taken: list[tuple[int, int, str]], cues: list[int], given: list[int], acts: list[int]) -> Iterator[tuple[int, int]]:
    for at in cues:
        c = _CUE.match(text, at)
        if not c:
            continue
        p = c.end()
        while p < len(text) and text[p] == " ":
            p += 1
        cue = c.group()
        shouting = cue.isupper()
        listed = c.group("list")
        got = _name_at(text, p, shouting, bool(c.group("title")) or cue.lower().startswith(("teste", "ricorr", "compars", "esibit", "ha", "affid", "contatt")))
        if not got:
            continue
        if listed and cue.lower().startswith("tra"):
            # "tra" is a common word: it needs a second name
            a = _AND.match(text, got[1])
            other = a and _name_at(text, a.end(), shouting, False)
            if not other:
                continue
            yield from (got, other)
            continue
        yield got
        while listed and (a := _AND.match(text, got[1])) and a.group().strip() != ";" and (got := _name_at(text, a.end(), shouting, False)):
            yield got
    for _, p, kind in taken:
        # whose number it is, in brackets after it
        if kind == "PHONE" and (m := _BRACKET.match(text, p)) and (got := _name_at(text, m.end(), False, True)):
            yield got
    for at in acts:
        low = max(0, at - 48)
        # a person who acts has a capital or a listed given name
        if text[low:at].islower() and bisect_right(given, at) == bisect_right(given, low - 1):
            continue
        m = _ACTS.search(text, low, min(len(text), at + 8))
        if m and text[m.end() : at].isspace():
            short = m.group(1).split(".")[0]
            if len(short) < 3 or short.lower() in _PREFIXES or "." not in m.group(1)[:5]:
                yield m.span(1)
    last = -1
    for at in given:
        m = _FREE.match(text, at) if at >= last else None
        if not m:
            continue
        last = m.end()
        before = text[max(0, m.start() - 8) : m.start()].lower()
        if before.endswith(("legge ", "san ", "santa ", "di san ")) or _FIRM_AFTER.match(text, m.end()):
            continue
        yield m.span()


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each item, in order, without overlaps."""
    if not text or text.isspace():
        return []
    shadow = Shadow(text)
    t = shadow.text
    got: list[tuple[int, int, str]] = []  # in order, without overlaps

    def free(a: int, b: int) -> bool:
        k = bisect_right(got, (a, b, "~"))
        return (not k or got[k - 1][1] <= a) and (k == len(got) or got[k][0] >= b)

    def take(a: int, b: int, kind: str) -> None:
        insort(got, (a, b, kind))

    for a, b in _emails(t):
        take(a, b, "EMAIL")
    for m in _ID.finditer(t):
        tax = len(re.sub(r"\s", "", m.group())) == 16
        before = t[max(0, m.start() - 32) : m.start()]
        if (tax or _ID_CUE.search(before) or not _NO_ID.search(before)) and free(*m.span()):
            take(*m.span(), "ID")
    for m in _SSN.finditer(t) if "-" in t else ():
        if free(*m.span(1)):
            take(*m.span(1), "ID")
    cues, streets, given, acts, numbered = _anchors(t)
    for m in _NUMBER_FIRST.finditer(t) if numbered else ():
        if free(*m.span()):
            take(*m.span(), "ADDRESS")
    for at in streets:
        m = _ADDRESS.match(t, at)
        if m and free(*m.span()) and not (m.group().isupper() and not re.search(r"\d{5}", m.group())):
            take(*m.span(), "ADDRESS")
    for m in _PHONE.finditer(t):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 14 and free(*m.span()) and not _NO_PHONE.search(t[max(0, m.start() - 16) : m.start()]):
            take(*m.span(), "PHONE")
    for a, b in _names(t, list(got), cues, given, acts):
        if free(a, b):
            take(a, b, "NAME")
    return sorted((*shadow.back(a, b), k) for a, b, k in got)


def redact(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    """The text with each item replaced by its typed placeholder."""
    if not items:
        return text
    parts, end = [], 0
    for a, b, k in items:
        parts += [text[end:a], PLACEHOLDER[k]]
        end = b
    return "".join([*parts, text[end:]])


def personal_items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each item: ``id_col``, ``start_pos``, ``end_pos``, ``kind``."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], ([], [], [])
            for k, t in enumerate(b.column(1).to_pylist()):
                for item in find(t):
                    rows.append(k)
                    for c, v in zip(cols, item):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int32())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["id", "start_pos", "end_pos", "kind"]
            )

    kind = src.schema["id"].dataType.simpleString()
    return spread(src).mapInArrow(run, f"id {kind}, start_pos int, end_pos int, kind string").withColumnRenamed("id", id_col)


def redacted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (``id_col``, text, items): each text, readable, with placeholders, and how many it holds."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t in b.column(1).to_pylist():
                items = find(t)
                texts.append(redact(t, items))
                counts.append(len(items))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["id", "redacted_text", "items"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("redacted_text", T.StringType()), T.StructField("items", T.IntegerType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
