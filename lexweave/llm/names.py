"""Variant spellings of names typed by people (problem 4).

Every text is parsed into a core (surname, or the coined word of a firm; the whole name where no part is listed) and
the rest (given name, initial, short or pet form; line of business, legal form). The cores are joined within one edit
of a true metric by metric-space partitioning (``metric.radius_join``), whatever their length.

An entity then takes the identity (core, given name or business) that fits: full names go to the most frequent
spelling of their core within the radius that has the same given name or business; initials, short forms and bare
surnames or coined words take an identity only if exactly one fits. Pairs are the entities of one identity. Lists of
given names, pet forms and lines of business are a parameter (``Lexicon``). A full name without a listed part is its
words in alphabetic order, joined by the same radius; initials and bare surnames meet it by each of its words.

Defined results: null, blank and texts with digits (dates, sums, laws, dockets) name nobody; copies of a text share
their identity; what fits several identities stays alone; labels are not read; names of any length are compared whole;
extra columns are ignored. ``classes`` gives one row for each entity and never grows beyond the input; ``pairs`` gives
all pairs, so its rows are its size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.metric import one_edit, radius_join
from lexweave.session import checkpointed, spread

#: Given names (fixed values).
GIVEN = """salvatore nicolò niccolò zoè ginevra fulvio otello federico federica domenico domenica raffaele raffaella caterina giuseppe giuseppina eleonora ettore tancredi jolanda
concetta antonio antonia antonietta michele michela margherita ubaldo lorenzo lorenza elisabetta luigi luisa luigia alessandra alessandro roberto roberta ruggero francesca francesco vincenzo vincenza giovanni giovanna
berenice ilaria filomena maria anna marco matteo luca andrea paolo paola pietro stefano stefania carlo carla mario giorgio giorgia elena laura chiara sara simone simona davide daniele daniela
massimo sergio bruno enrico emilio giulia giulio claudio claudia silvia lucia angelo angela rosa teresa rita marta martina valentina cristina patrizia fabio alberto alberta umberto
pasquale rocco gennaro nunzia carmela immacolata bianca irene ida ernesto guido renato riccardo tommaso vittorio vittoria""".split()
DOUBLE = ("maria teresa", "pier paolo", "anna maria", "maria grazia", "maria pia", "gian luca", "gian carlo", "pier luigi", "maria luisa")
#: Pet forms and the name they stand for (fixed values).
PET = dict(x.split(":") for x in """nico:nicolò sandro:alessandro sandra:alessandra renzo:lorenzo pierpa:pier_paolo nora:eleonora baldo:ubaldo tina:concetta berto:roberto roby:roberto pina:giuseppina lele:raffaele
enzo:vincenzo lino:michele tonia:antonietta mimmo:domenico betta:elisabetta elisa:elisabetta maritè:maria_teresa totò:salvatore turi:salvatore rina:caterina franca:francesca franco:francesco checco:francesco chicca:francesca
iole:jolanda nice:berenice tonino:antonio toni:antonio lella:raffaella rita:margherita beppe:giuseppe peppe:giuseppe pino:giuseppe mena:filomena gianni:giovanni nanni:giovanni gino:luigi gigi:luigi
chicco:francesco peppino:giuseppe pippo:giuseppe gianna:giovanna giusy:giuseppina""".split())
#: Pet forms that may stand for several names: they are short forms.
SHORT = {"ale", "fede", "ila", "cate", "vale", "fra", "dani", "simo", "ste"}
#: Lines of business (fixed values).
BUSINESS = """cartiere|finanziaria|fonderie|trasporti|immobiliare|autolinee|cantieri navali|consorzio irriguo|cooperativa agricola|costruzioni generali|industrie alimentari|laboratori farmaceutici|officine meccaniche|servizi ambientali|
associazione culturale|fratelli|gruppo|studio legale|banca popolare|tipografia|editrice""".replace("\n", "").split("|")
#: Legal forms (fixed values), longest first.
FORMS = [
    (re.compile(p), f)
    for p, f in (
        (r"\bsociet[aà]' per azioni\b|\bsociet[aà] per azioni\b|\bs\.? ?p\.? ?a\b\.?", "spa"),
        (r"\bsociet[aà] a responsabilit[aà] limitata\b|\bs\.? ?r\.? ?l\b\.?", "srl"),
        (r"\bsociet[aà] in nome collettivo\b|\bs\.? ?n\.? ?c\b\.?", "snc"),
        (r"\bsociet[aà] in accomandita semplice\b|\bs\.? ?a\.? ?s\b\.?", "sas"),
        (r"\bsociet[aà] cooperativa\b|\bsoc\.? ?coop\b\.?|\bs\.? ?c\.? ?a\.? ?r\.? ?l\b\.?", "coop"),
        (r"\bo\.? ?n\.? ?l\.? ?u\.? ?s\b\.?", "onlus"),
    )
]
_SCARL = re.compile(r"\bs\.? ?c\.? ?a\.? ?r\.? ?l\b\.?")
_DROP = re.compile(r"\bin liquidazione\b|^la\b|\bditta\b|[\"«»“”„]")
_TITLE = re.compile(r"^(?:sig\.? ?(?:ra|na)\.?|sig\.?|avv\.?|avvocato|dott\.? ?ssa\.?|dott\.?|dottor(?:essa)?|prof\.? ?ssa\.?|prof\.?|ing\.|arch\.|geom\.|rag\.|on\.? ?le\.?|on\.|signor[ae]?|dr\.)\s+")


def plain(s: str) -> str:
    """Lower case without accents and apostrophes."""
    if s.isascii():
        return s.lower().replace("'", "").replace("`", "")
    s = unicodedata.normalize("NFD", s.lower())
    return "".join(c for c in s if not unicodedata.combining(c) and c not in "'’`´")


def squeezed(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", plain(s))


#: In the place of a given name or line of business: a whole name without a listed part.
WHOLE = "*"


def _lesser(word: str) -> set[str]:
    """The word and what is left of it without one character; words within one edit share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Lexicon:
    """Lists that help to tell given names and lines of business; any may be empty."""

    def __init__(self, given: list[str] = (), double: list[str] = (), pet: dict[str, str] | None = None, short: set[str] = frozenset(), lines: list[str] = ()):  # type: ignore[assignment]
        self.short, self.lines = set(short), tuple(lines)
        self.double = [(squeezed(d), [(squeezed(w), w) for w in d.split()]) for d in double]
        self.names = {squeezed(g): squeezed(g) for g in (*given, *double)} | {plain(p): squeezed(g.replace("_", " ")) for p, g in (pet or {}).items()}
        self.long = sorted({(squeezed(g), plain(g)) for g in given if len(squeezed(g)) > 4})
        self.line_words = {plain(w): b for b in lines for w in b.split()}
        self.near: dict[str, set[int]] = {}
        for k, pair in enumerate(self.long):
            for x in set().union(*map(_lesser, pair)):
                self.near.setdefault(x, set()).add(k)
        self.given, self.business = lru_cache(200_000)(self._given), lru_cache(200_000)(self._business)

    def _given(self, token: str) -> str | None:
        """Canonical given name of a token, also with one edit."""
        p, s = plain(token), squeezed(token)
        if p in self.names:
            return self.names[p]
        if s in self.names:
            return self.names[s]
        if len(p) >= 4:
            met = set().union(*(self.near.get(x, ()) for x in _lesser(s) | _lesser(p)))
            for g, whole in (self.long[k] for k in sorted(met)):
                if one_edit(s, g) or one_edit(p, whole):
                    return g
        return None

    def _business(self, token: str) -> str | None:
        """The line of business a word belongs to: whole, cut short, or with one edit."""
        dot, w = token.endswith("."), plain(token.rstrip("."))
        if w in self.line_words:
            return self.line_words[w]
        if w in ("flli", "lli", "f.lli") and "fratelli" in self.lines:
            return "fratelli"
        if dot and len(w) >= 3:
            hits = {b for x, b in self.line_words.items() if x.startswith(w)}
            return hits.pop() if len(hits) == 1 else None
        if len(w) >= 6:
            for x, b in self.line_words.items():
                if abs(len(x) - len(w)) < 2 and one_edit(w, x):
                    return b
        return None


def parse(text: str | None, lexicon: Lexicon | None = None) -> tuple[str, str, str, str, str] | None:
    """(kind, core, full, short, form): ``full`` the whole given name or business, ``short`` an initial or cut form."""
    lx = lexicon or ITALIAN
    if not text or text.isspace() or re.search(r"\d|€", text):
        return None
    t = " ".join(text.replace("’", "'").split())
    low = t.lower()
    form = ""
    rest = _DROP.sub(" ", low).strip()
    if _SCARL.search(rest):
        rest, form = _SCARL.sub(" ", rest), "coop"
    for p, f in FORMS:
        if p.search(rest):
            rest, form = p.sub(" ", rest), form or f
    firm = bool(form) or "ditta" in low.split() or any(c in text for c in "«»\"“”") or low.startswith("la ")
    rest = rest.replace("f.lli", "fratelli").replace("&", " ")
    titled = False
    if not firm:
        while m := _TITLE.match(rest):
            rest, titled = rest[m.end() :], True
    initials = re.match(r"^((?:[a-z]\.){2,})\s*(?=\S)", rest)
    tokens = [x for x in re.split(r"[\s,]+", re.sub(r"(?<=[a-z]\.)(?=[^\W\d_]{3})", " ", rest)) if x.strip(".-'")]
    lines = [lx.business(x) for x in tokens]
    if not firm and not titled and any(lines) and not any(lx.given(x) for x in tokens):
        firm = True
    if initials and not titled and not any(lx.given(x) for x in tokens):
        firm = True
    if firm:
        core, kinds = [], []
        for x, b in zip(tokens, lines):
            if b:
                kinds.append(b)
            elif re.fullmatch(r"(?:[a-z]\.){2,}", x):
                letters = x.replace(".", "")
                kinds += [b for b in lx.lines if "".join(w[0] for w in b.split()) == letters][:1]
            elif x not in ("e", "ed", "di", "del", "dei", "la", "il", "soc.", "societa", "società"):
                core.append(plain(x).replace("-", "").strip("."))
        line = max(sorted(set(kinds)), key=kinds.count) if kinds else ""
        name = " ".join(sorted(c for c in core if c))
        if " " in name and not line:
            line = WHOLE
        return ("org", name, line, "", form) if name else ("org", line, line, "", form) if line else None
    # persons
    joined = " ".join(tokens)
    full = short = ""
    known = [(lx.given(x), plain(x)) for x in tokens]
    for d, ws in lx.double:
        for k in range(len(tokens) - 1):
            if all(g == q or one_edit(x, w) for (g, x), (q, w) in zip(known[k : k + 2], ws)):
                full = d
                del tokens[k : k + 2]
                break
        if full:
            break
    if not full:
        ranked = []
        for k, x in enumerate(tokens):
            bare = x.rstrip(".")
            if len(bare) == 1 and x.endswith("."):
                ranked.append((2, k, "short", plain(bare)))
            elif x.endswith(".") and len(bare) <= 5:
                ranked.append((1, k, "short", squeezed(bare)))
            elif plain(x) in lx.short:
                ranked.append((1, k, "short", squeezed(x)))
            elif g := lx.given(x):
                exact = plain(x) in lx.names or squeezed(x) in lx.names
                ranked.append((0 if exact else 3, k, "full", g))
        if ranked and len(tokens) > 1:
            _, k, what, value = min(ranked)
            if what == "full":
                full = value
            else:
                short = value
            del tokens[k]
        elif len(tokens) > 1:
            # no part is listed: the whole name, its words in alphabetic order
            full = WHOLE
            tokens.sort(key=lambda x: plain(x))
    core = (" " if full == WHOLE else "").join(plain(x).strip(".-") for x in tokens)
    return ("person", core, full, short, "") if core and joined else None


ITALIAN = Lexicon(GIVEN, DOUBLE, PET, SHORT, BUSINESS)
PLAIN = Lexicon()


def read(text: str | None, lexicon: str) -> tuple[str, str, str, str, str] | None:
    return parse(text, {"italian": ITALIAN, "none": PLAIN}[lexicon])




def parsed(texts: DataFrame, lexicon: str = "italian") -> DataFrame:
    """Rows (text, kind, core, full, short, form, parts) of the texts that name somebody; ``parts`` are the words of a whole name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(t, p) for t in b.column(0).to_pylist() if (p := read(t, lexicon))]
            cols = [pa.array([p[i] for _, p in got], pa.string()) for i in range(5)]
            words = [p[1].split() if p[2] == WHOLE else [] for _, p in got]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), *cols, pa.array(words, pa.list_(pa.string()))], ["text", "kind", "core", "full", "short", "form", "parts"])

    return texts.mapInArrow(run, "text string, kind string, core string, full string, short string, form string, parts array<string>")


def _rooted(ident: DataFrame, near: DataFrame) -> DataFrame:
    """ident(kind, core, full, n) with ``root``: the most frequent spelling of the core within the radius, and of that one, to the end."""
    spark = ident.sparkSession
    step = spark.sql(
        """
        SELECT i.kind, i.core, i.full, min_by(j.core, (-j.n, j.core)) AS root
        FROM {i} i JOIN {m} m ON i.core = m.a JOIN {i} j ON j.core = m.b AND j.kind = i.kind AND j.full = i.full GROUP BY i.kind, i.core, i.full
        """,
        i=ident, m=near,
    )
    root = checkpointed(step)
    while True:
        on = spark.sql("SELECT a.kind, a.core, a.full, b.root, b.root <> a.root AS moved FROM {r} a JOIN {r} b ON b.kind = a.kind AND b.full = a.full AND b.core = a.root", r=root)
        on = checkpointed(on)
        root = on.drop("moved")
        if on.where("moved").isEmpty():
            return root


def classes(df: DataFrame, id_col: str, text_col: str, lexicon: str = "italian") -> DataFrame:
    """Rows (``id_col``, identity): who each entity is; null identity for those that name nobody or fit several."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    forms = checkpointed(parsed(spread(src.where("text IS NOT NULL").select("text")), lexicon).distinct())
    words = forms.select(F.explode("parts").alias("core"))
    cores = checkpointed(forms.select("core").unionByName(words).distinct())
    near = radius_join(cores).unionByName(cores.select(F.col("core").alias("a"), F.col("core").alias("b"), F.lit(0).alias("d")))
    near = checkpointed(near)
    ident = checkpointed(forms.where("full <> ''").groupBy("kind", "core", "full").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.nullif("form", F.lit(""))).alias("forms"), F.first("parts").alias("parts")))
    root = _rooted(ident, near)
    part = forms.where("full = ''")
    # where an initial, a short form or a bare surname may meet an identity: its core, or each word of a whole name
    keys = spark.sql(
        """
        SELECT kind, root, full, forms, explode(CASE WHEN size(parts) = 0 THEN array(struct(core AS at, array(full) AS givens))
          ELSE transform(parts, (w, k) -> struct(w AS at, filter(parts, (x, l) -> l <> k) AS givens)) END) AS k
        FROM {i} JOIN {r} USING (kind, core, full)
        """,
        i=ident, r=root,
    )
    fits = spark.sql(
        """
        SELECT p.text, 2 * m.d + CASE WHEN p.form = '' OR array_contains(j.forms, p.form) THEN 0 ELSE 1 END AS d, j.root, j.full
        FROM {p} p JOIN {m} m ON p.core = m.a JOIN {k} j ON j.kind = p.kind AND j.k.at = m.b
        WHERE (p.short = '' OR exists(j.k.givens, g -> startswith(g, p.short))) AND (p.form = '' OR size(j.forms) = 0 OR array_contains(j.forms, p.form))
        """,
        p=part, m=near, k=keys,
    )
    # the closest identities of a text, if they are one
    closest = checkpointed(fits.groupBy("text").agg(F.min_by(F.struct("root", "full"), F.struct("d", "root", "full")).alias("one"), F.max_by(F.struct("root", "full"), F.struct(-F.col("d"), "root", "full")).alias("other")))
    only = closest.where("one = other").select("text", "one.root", "one.full")
    # what meets no identity: the same core within the radius and the same short form; bare words are themselves alone
    left = part.join(closest.select("text"), "text", "left_anti").withColumn("full", F.concat(F.lit("~"), "short", "form"))
    named = left.where("short <> '' OR kind = 'org'")
    own = _rooted(named.groupBy("kind", "core", "full").agg(F.count(F.lit(1)).alias("n")), near)
    identity = lambda d: d.select("text", F.concat_ws("|", "kind", "root", "full").alias("identity"))
    found = identity(forms.where("full <> ''").join(root, ["kind", "core", "full"]))
    found = found.unionByName(identity(part.select("text", "kind").join(only, "text"))).unionByName(identity(named.select("text", "kind", "core", "full").join(own, ["kind", "core", "full"])))
    found = found.unionByName(left.where("short = '' AND kind <> 'org'").select("text", F.concat(F.lit("text|"), "text").alias("identity")))
    return src.join(found, "text", "left").select(F.col("id").alias(id_col), "identity")


def pairs(df: DataFrame, id_col: str, text_col: str, lexicon: str = "italian") -> DataFrame:
    """Rows (id_a, id_b): every pair of entities of one identity, the smaller id first."""
    who = checkpointed(classes(df, id_col, text_col, lexicon).where("identity IS NOT NULL").select(F.col(id_col).alias("id"), "identity"))
    other = who.select(F.col("id").alias("id_b"), F.col("identity").alias("other"))
    return who.join(other, (F.col("identity") == F.col("other")) & (F.col("id") < F.col("id_b"))).select(F.col("id").alias("id_a"), "id_b")
