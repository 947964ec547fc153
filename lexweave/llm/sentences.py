"""Sentence boundaries across languages and scripts (problem 2).

A pushdown automaton reads the marks of a text from left to right. Its stack holds the quotations and brackets
that are open; its state holds where the running sentence began and whether an enumerator opened it. At a
terminator the reversed abbreviation trie is walked backwards; the kind found there, the script and what follows
decide. Offsets count code points, the end lies after the last character.

Defined results: a null, empty or blank text has no sentences; outer white space belongs to none; a text without
any mark is one sentence; an opening mark whose partner is missing is read as ordinary text; texts of any length
are read whole, in time that grows with their length; repeated rows each give their sentences; extra columns are
ignored.

Rules that look at a bounded part of the text: a Greek question mark (;) needs a Greek letter among the 60 characters
before it; a line in capitals is a heading up to 45 characters, one that opens with a numbered part of a law up to 60.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.session import spread

#: Abbreviations after which a sentence goes on (fixed values).
NEVER = """
art artt all co comma lett n nr nn num núm prot rif fasc sent proc sez doc pag pagg p pp fg mapp sub cfr cf v vs r.g c.f p.iva part
cass trib app civ pen trib t.a.r tar cons c.d cd d.lgs d.lgs d.l d.m d.p.r l dott avv sig sigg sig.ra prof ing arch geom rag on mod int tel cell fax
cap capo tit par parr ca circa rel pres es gent spett egr ill mons rev dr jur abs az lt vgl urt zzgl bzw bsp str s h i d z b u
no sec approx ref mr mrs ms messrs mme mlle mm al env ex apdo exp sr sra srta dña ud uds ej ap pág άρθ παρ κ βλ αρ π.χ σελ δρ κκ
giur un lav serv amb ind alim cons irr ult succ min pubbl fall ass cult fin cart fond trasp immob autol coop.agr agr cant nav costr gen lab farm off mecc gr str fr f.lli flli soc
i.a s.a o.m c.g l.f c.a c.n a.c c.i e.g i.e viz inc.no op cit ibid vol fig tab lin reg dec dir circ ord conv disp att
डॉ श्री सं क्र د م أ ص رقم
""".split()
#: Abbreviations that may close a sentence if a new one visibly begins after them (fixed values).
MAYBE = """
s.p.a s.r.l s.n.c s.a.s s.c.a.r.l s.c.a r.l o.n.l.u.s coop spa srl snc sas scarl onlus ecc etc c.p.c c.c c.p c.p.p a.m p.m uhr mq mc km a.c d.c inc ltd co.ltd usw
""".split()
#: Company forms written like short names (fixed values).
FORMS = {"spa", "srl", "snc", "sas"}

OPEN = {"«": "»", "“": "”", "„": "“", "(": ")", "[": "]", "「": "」", "『": "』", "《": "》", "（": "）", "【": "】", "‹": "›", "〈": "〉"}
CLOSE = {c for c in OPEN.values()} | {"”", "“"}
TERMINATORS = ".!?…。！？｡؟।॥۔។៕။።፧։།"
#: Marks that end a sentence by themselves: Indic, Urdu, Khmer, Burmese, Ethiopic, Armenian, Tibetan.
FULL_STOPS = "।॥۔؟។៕။።፧։།"
WIDE = "。！？｡"

_EVENT = re.compile(r'[.…]+|[!?。！？｡؟।॥۔។៕။።፧։།;;\n\x0c«»“”„"()\[\]「」『』《》（）【】‹›〈〉]|(?<=\S)[ \t]+(?=[฀-๿຀-໿])')
_PAIR = re.compile(r'[«»“”„"()\[\]「」『』《》（）【】‹›〈〉]')
_ENUM = re.compile(r"(?:\(?(?:\d{1,3}(?:\.\d{1,3}){0,3}(?:[-\s]?(?:bis|ter|quater|quinquies))?|[a-zA-Z]{1,2}|[ivxlcIVXLC]{1,6})(?:[.)]|\.\))|[-–—•*·]|§\s?\d+\.?)(?=\s)")
_HEAD = re.compile(r"(?:(?i:capo|titolo|sezione|parte|libro|art(?:icolo|\.)?|allegato|section|kapitel|chapter|chapitre)\s+[\dIVXLCivxlc]+\b)")
_NAME4 = re.compile(r"(?<![^\W\d_])[A-ZÀ-Þ][a-zà-ÿ]{2,3}$")
_SPACE = re.compile(r"\s*")
_WORD = re.compile(r"\S+")
_OPENING = re.compile(r"(?:[A-ZÀ-Þ][a-zà-ÿ]+|[A-ZÀ-Þ])[’' ,]?")
_LINK, _SMALL = re.compile("@|://"), re.compile("[a-zß-öø-ÿа-яα-ω]")
_LOWER_GOES_ON = re.compile(r"[a-zà-ÿα-ωά-ώ]")


def _build() -> dict:
    root: dict = {}
    for kind, words in (("N", NEVER), ("M", MAYBE)):
        for w in words:
            at = root
            for ch in reversed(w):
                at = at.setdefault(ch, {})
            at["$"] = kind
    return root


_TRIE = _build()


def _abbreviation(text: str, dot: int, floor: int) -> str | None:
    """Kind of the longest abbreviation that ends at ``dot``, walking the reversed trie to the left."""
    if text[dot - 4 : dot] in ("Coop", "COOP") and not text[max(0, dot - 9) : dot - 4].strip().lower().endswith("soc."):
        return "N"
    at, i, found = _TRIE, dot - 1, None
    while i >= floor:
        at = at.get(text[i].lower())
        if at is None:
            break
        if "$" in at and (i == floor or not text[i - 1].isalnum()):
            # an abbreviation inside a longer dotted word counts only as a whole, but after an elision it stands alone
            if not (i - 1 >= floor and text[i - 1] == "." and i - 2 >= floor and text[i - 2].isalpha() and (i - 3 < floor or not text[i - 3].isalnum())) or found is None:
                found = at["$"]
        i -= 1
    return found


def _pairs(text: str) -> dict[int, int]:
    """Matching marks by place; those without a partner are left out, as are pairs over an empty line.

    Every mark is put on the stack and taken off it once; where each kind of mark lies in the stack is kept beside it.
    """
    stack: list[tuple[str, int, bool]] = []
    lies: dict[str, list[int]] = {}
    low = 0  # open German quotes, which “ closes
    blank: list[int] | None = None
    out: dict[int, int] = {}
    for m in _PAIR.finditer(text):
        ch, i = m.group(), m.start()
        if ch == '"':
            want = ch if lies.get(ch) and not (i == 0 or text[i - 1].isspace()) else None
        elif ch == "“" and low:
            want = ch
        else:
            want = None if ch in OPEN else ch
        if want is None:
            closer = OPEN.get(ch, ch)
            lies.setdefault(closer, []).append(len(stack))
            stack.append((closer, i, ch == "„"))
            low += ch == "„"
            continue
        if not lies.get(want):
            continue
        k = lies[want][-1]
        j = stack[k][1]
        if blank is None:
            blank = [x.start() for x in re.finditer("\n(?=\n)", text)]
        at = bisect_left(blank, j)
        if at == len(blank) or blank[at] > i - 2:
            out[j] = i
        while len(stack) > k:
            closer, _, german = stack.pop()
            lies[closer].pop()
            low -= german
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence of ``text``, in order."""
    if not text:
        return []
    begin, stop = _trimmed(text, 0, len(text))
    if begin == stop:
        return []
    pairs = _pairs(text)
    closers = set(pairs.values())
    out: list[tuple[int, int]] = []
    depth = 0
    start = begin
    widest = 0
    if "\n" in text:
        widest = max(map(len, text.split("\n")))

    def cut(end: int) -> None:
        nonlocal start
        a, b = _trimmed(text, start, min(end, stop))
        if a < b:
            out.append((a, b))
            start = b
        start = _SPACE.match(text, max(end, start)).end()

    skip = begin
    line = line0 = 0  # where the running line began, and the one that a break ends
    run, run_stops = (0, 0), (0, 0)  # the last runs of terminators: where they began and end
    token = (0, 0, -1)  # the last run without blanks: begin, end, its last @
    link_at, small_at = -1, -1  # the first address or link of the token, and its first small letter
    m_enum = _ENUM.match(text, start)
    enum_end = m_enum.end() if m_enum else start

    for m in _EVENT.finditer(text, begin, stop):
        i, mark = m.start(), m.group()
        first = mark[0]
        if first in "\n\x0c":
            line0, line = line, i + 1
        if i < skip or i < start:
            continue
        if i in pairs:
            depth += 1
            continue
        if i in closers:
            depth = max(0, depth - 1)
            if depth:
                continue
            # The sentence may end with what was quoted or bracketed.
            k = i - 1
            while k > start and text[k].isspace():
                k -= 1
            if text[k] not in TERMINATORS or first in ")]）】" and text[k] in ".…" and text[max(0, k - 2) : k + 1] in ("...", "…"):
                continue
            if first in "）)]】":
                word_abbr = text[k] == "." and _abbreviation(text, k, start)
                if word_abbr:
                    continue
            end = i + 1
            while end < stop and end in closers:
                end += 1
            nxt = _SPACE.match(text, end).end()
            if nxt >= stop:
                cut(stop)
            elif nxt == end:
                if text[nxt].isupper() and first not in "」』》）】" and first not in ")]":
                    cut(end)
            elif text[nxt].isupper() or text[nxt] in "«“„\"¿¡「" or _ENUM.match(text, nxt):
                # A name after a spoken sentence goes on only with a small letter; a capital opens the next one.
                cut(end)
            else:
                continue
            m_enum = _ENUM.match(text, start)
            enum_end = m_enum.end() if m_enum else start
            skip = start
            continue
        if depth:
            continue
        if first in "\n\x0c":
            here = text[max(line0, start) : i].strip()
            if not here or here[-1] in ",;:-–(«“„":
                continue
            end = _SPACE.match(text, i).end()
            if end >= stop:
                break
            blank = "\n" in text[i + 1 : end] or "\x0c" in text[i:end]
            nxt = text[end]
            opens = nxt.isupper() or nxt in "«“„\"¿¡「(" or nxt.isdigit() or not _LOWER_GOES_ON.match(nxt) or bool(_ENUM.match(text, end))
            at_line_start = _trimmed(text, line0, i)[0] >= start
            word = _WORD.match(text, end).group()
            fits = len(here) + 1 + len(word) <= widest
            thai = "฀" <= nxt <= "໿"
            if thai:
                pass
            elif at_line_start and len(here) <= 60 and (here.isupper() and 3 < len(here) <= 45 and not re.search(r"\d", here) and (blank or not text[end : end + 30].isupper()) or _HEAD.match(here)) and (fits or blank):
                pass
            elif at_line_start and len(here) <= 45 and opens and (fits or blank) and here[0].isupper() and not re.search(r"\d", here):
                pass
            elif blank and opens and (nxt.isupper() or _ENUM.match(text, end)) and len(here) > 0 and not here[-1].isalpha():
                pass
            elif blank and opens and nxt.isupper() and fits:
                pass
            else:
                continue
            cut(i)
        elif first in " \t":
            cut(i)
        elif first in ";;":
            k = i - 1
            while k > start and not text[k].isalpha():
                k -= 1
            near = sum("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in text[max(start, i - 60) : i])
            if not near or first == ";" and near < 10 or not (i + 1 >= stop or text[i + 1].isspace()):
                continue
            cut(i + 1)
        elif first in FULL_STOPS or first in WIDE or first in "!?":
            if not run[0] <= i < run[1]:
                end = m.end()
                while end < stop and (text[end] in TERMINATORS or end in closers):
                    end += 1
                run = (i, end)
            end = run[1]
            nxt = _SPACE.match(text, end).end()
            if nxt < stop:
                if nxt == end and first in "!?" and not text[nxt].isupper() and text[nxt] not in "«“„¿¡\"(":
                    continue
                if first in "!?" and _LOWER_GOES_ON.match(text[nxt]):
                    continue
            cut(end)
        elif first not in OPEN:
            # Periods, omissions, and closing marks without a partner, which a terminator may stand before.
            end = m.end()
            if mark == "." and i > 0 and i + 1 < len(text) and text[i - 1].isdigit() and text[i + 1].isdigit():
                continue
            if i < enum_end:
                continue
            if run_stops[0] <= i < run_stops[1]:
                end = run_stops[1]
            else:
                while end < stop and (text[end] in "!?.…" or end in closers):
                    end += 1
                run_stops = (i, end)
            nxt = _SPACE.match(text, end).end()
            if nxt >= stop:
                cut(stop)
                break
            follow = text[nxt]
            capital = follow.isupper() or follow in "«“„\"¿¡「‹" or (follow == "(" and nxt + 1 < stop and text[nxt + 1].isupper())
            fresh = capital or bool(_ENUM.match(text, nxt))
            if "…" in mark or len(mark) >= 3:
                if nxt == end or not capital or text[max(0, i - 3) : i].isupper() and text[nxt : nxt + 2].isupper():
                    continue
            elif nxt == end:
                # No space: only a word or number before and a new capitalised word after.
                if not capital or text[i - 1].isspace() or not (text[i - 1].isalnum() or text[i - 1] in "%€)»”\"°"):
                    continue
                if not token[0] <= i < token[1]:
                    a = i
                    while a > 0 and not text[a - 1].isspace():
                        a -= 1
                    b = _WORD.match(text, i).end()
                    token = (a, b, text.rfind("@", a, b))
                    link_at = small_at = -1
                a = max(token[0], start)
                if token[2] >= nxt and not text.startswith(("«", "“", "("), nxt):
                    continue
                if link_at < a:
                    link_at = link.start() if (link := _LINK.search(text, a, token[1])) else token[1]
                if small_at < a:
                    small_at = small.start() if (small := _SMALL.search(text, a, token[1])) else token[1]
                if link_at < i or text[a : a + 3].lower() == "www":
                    if not _OPENING.match(text, nxt) or small_at >= i:
                        continue
                k = i
                while k > a and (text[k - 1].isalnum() or text[k - 1] == "_"):
                    k -= 1
                tail = text[k:i]
                if len(tail) == 1 and tail.isalpha():
                    continue
                kind = _abbreviation(text, i, start)
                if kind == "N" or kind == "M" and not re.match(r"[A-ZÀ-Þ][a-zà-ÿ’']", text[nxt : nxt + 2]):
                    continue
                if follow.isupper() and nxt + 1 < stop and not (text[nxt + 1].islower() or text[nxt + 1] in "’' ") and not text[nxt : nxt + 3].isupper():
                    continue
                if tail.isupper() and tail.isalpha() and len(tail) <= 2:
                    continue
            else:
                kind = _abbreviation(text, i, start)
                if kind == "N":
                    continue
                if kind == "M":
                    if not capital and not ("\n" in text[end:nxt] and fresh):
                        continue
                else:
                    k = i - 1
                    while k >= start and text[k].isalnum():
                        k -= 1
                    word = text[k + 1 : i]
                    if len(word) == 1 and word.isalpha():
                        continue
                    if _NAME4.search(text, max(start, i - 6), i) and word.lower() not in FORMS and follow.isupper() and k + 1 >= start and text[nxt + 1 : nxt + 2].islower() and len(word) == 4:
                        before = text[max(start, k - 12) : k + 1].rstrip()
                        if not before or k + 1 == start or (before[-1] != "." or _abbreviation(text, max(start, k - 12) + len(before) - 1, start) == "N"):
                            continue
                    if _LOWER_GOES_ON.match(follow) and not fresh:
                        continue
            cut(end)
        else:
            continue  # an opening mark without a partner
        m_enum = _ENUM.match(text, start)
        enum_end = m_enum.end() if m_enum else start
        skip = start
    if start < stop:
        a, b = _trimmed(text, start, stop)
        if a < b:
            out.append((a, b))
    return out


def sentence_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each sentence: ``id_col``, ``start_pos``, ``end_pos``."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, ends = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for x, y in spans(t):
                    rows.append(k)
                    starts.append(x)
                    ends.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "start_pos", "end_pos"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    return spread(src).mapInArrow(run, schema).toDF(id_col, "start_pos", "end_pos")
