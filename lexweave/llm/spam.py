"""Keyword-stuffed and link-list pages (problem 10).

Each text is described by features of its windows of ``WINDOW`` tokens, of which the median over the windows counts,
so a page is judged by what it mainly consists of: density of links and tags, repetition of words, entropy of the
words, share of function words, density of figures. Location and scale of every feature are the median and the
median absolute deviation over all documents of the language; the scatter is the correlation of the winsorised
scores over all documents, so that a minority of spam cannot move it. A page is spam if its Mahalanobis distance is
beyond ``distance`` and the score along the spam direction (more links, tags and repetition, less entropy,
fewer function words and figures) beyond ``along``.

The only values sent to the driver are per language: at most languages x features^2 numbers.

Tokens are what blanks part; scripts written without blanks are cut into pairs of characters, and unspaced lists at
their commas and bars. The language of a text is told from all its characters and words.

Defined results: null, empty and blank texts and texts of fewer than ``LEAST`` tokens are never spam; a text
whose language cannot be told is held against the most frequent one (the declared one, often wrong, only settles
near ties); languages with few documents lean on
the scatter of all; repeated rows are judged each; extra columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import checkpointed, spread

WINDOW, LEAST = 50, 12
FEATURES = ("links", "repeats", "entropy", "function_words", "figures")
#: Smallest scale of a feature, for features that hardly vary among prose.
FLOOR = {"links": 0.03, "repeats": 0.06, "entropy": 0.02, "function_words": 0.04, "figures": 0.05}
#: Signs of the spam direction.
DIRECTION = {"links": 1.0, "repeats": 0.5, "entropy": -0.25, "function_words": -1.5, "figures": -0.6}
#: Documents by which the scatter of all is weighed against a language's own.
SHRINK = 200

#: Frequent function words by language (fixed values).
FUNCTION_WORDS = {
    "it": "il lo la i gli le l un uno una di a da in con su per tra fra del dello della dei degli delle dell al allo alla ai agli alle all dal dallo dalla dai dagli dalle dall nel nello nella nei negli nelle nell sul sullo sulla sui sugli sulle sull e ed o ma se che non è ha si cui come anche ogni quale fu sono",
    "en": "the a an of to in on at by for from with and or but if that not is are was were has have had be it its as this which under when did",
    "fr": "le la les l un une des de du d à au aux en dans sur par pour avec et ou mais si que qui ne pas n est a été il elle se ce cette au selon depuis était",
    "de": "der die das den dem des ein eine einer und oder in im an am auf bis von vom zu zum zur mit für ist hat wird wer wenn doch unter auf nicht ab nach sich noch seit",
    "es": "el la los las un una de del a al en con por para y o pero si que no es se su sobre desde lo como más le fue ha debe",
    "pt": "o a os as um uma de do da dos das em no na nos nas por pelo pela para com e ou mas se que não é foi são ao à aos às seu sua como mais ser está",
    "nl": "de het een van in op te en of maar dat die niet is was zijn aan met voor door bij naar om uit ook als dan wordt heeft over",
    "el": "ο η το οι τα του της των τον την στο στη στην στον και ή να με για από που δεν είναι σε ότι ως κατά αλλά θα",
    "ru": "и в во не на что с со как по из к ко у за от о об для но или а же это его её их он она был была было были при",
    "ar": "في من على إلى عن أن إن لا ما هذا هذه التي الذي و أو مع كان كانت قد بعد قبل بين كل ثم لم",
    "hi": "का के की में से को और या है हैं था थे थी ने पर यह वह कि नहीं एक इस उस भी तो ही लिए द्वारा जो",
}
#: Frequent characters and words of scripts without blanks (fixed values).
UNSPACED_WORDS = {"zh": "的 了 是 在 和 与 不 也 有 其 及 为 對 对 以 之", "ja": "の は を に が と で も た て し な る い", "th": "ที่ และ ใน ของ เป็น การ ให้ ได้ ว่า ไม่ มี จาก"}
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_RUNS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]{1,4}|[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]{1,2}|[^\s\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff、，。；|]+")
_COMMON = {k: re.compile("|".join(v.split())) for k, v in UNSPACED_WORDS.items()}
#: A list written without blanks: three items or more between commas, bars or semicolons.
_TIGHT = re.compile(r"[,;|][^\s,;|]+[,;|][^\s,;|]+[,;|]")
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_FIGURE = re.compile(r"(?<!\S)[^\s\d]*\d")
_WORD = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"(?i)https?:|www\.|href=|</?a\b|\]\(|\w\.(?:[a-z]{2,10})/|^#\w")
_RUN = re.compile(r"^[#;,\s]*[^\W\d_]{13,}[;,]?$|[a-zà-ÿ][A-ZÀ-Þ][a-zà-ÿ]")
_SCRIPTS = {"ru": "[\u0400-\u04ff]+", "ja": "[\u3040-\u30ff]+", "zh": "[\u4e00-\u9fff]+", "th": "[\u0e00-\u0e7f]+", "hi": "[\u0900-\u097f]+", "ar": "[\u0600-\u06ff]+", "el": "[\u0370-\u03ff]+"}
_SCRIPTS = {k: re.compile(v) for k, v in _SCRIPTS.items()}
_BEYOND = re.compile(r"[\u0370-\u109f\u1780-\u17ff\u3040-\u9fff]")


def _tokens(text: str) -> list[str]:
    """What blanks part; scripts without blanks in pairs of characters, unspaced lists by item."""
    unspaced = _UNSPACED.search(text) is not None
    if not unspaced and not _TIGHT.search(text):
        return text.split()
    out = []
    for t in text.split():
        if unspaced and _UNSPACED.search(t):
            out += _RUNS.findall(t)
        elif _TIGHT.search(t) and "://" not in t and "href" not in t:
            out += [x for x in re.split(r"[,;|]", t) if x]
        else:
            out.append(t)
    return out


def _language(words: list[str], text: str, declared: str | None) -> str:
    if _BEYOND.search(text):
        letters = sum(map(len, _WORD.findall(text)))
        for lang, runs in _SCRIPTS.items():
            if sum(map(len, runs.findall(text))) > 0.3 * letters:
                return lang
    n = Counter(words)
    share = {k: sum(n[w] for w in s) for k, s in _SETS.items()}
    best = max(share, key=lambda k: share[k])
    if declared in share and share[declared] >= 0.8 * share[best]:
        best = declared
    return best if share[best] > 0.12 * len(words) else ""


def features(text: str | None, declared: str | None = None) -> tuple[str, tuple[float, ...]] | None:
    """Detected language ('' if unknown) and the medians over the windows, None for texts too short to judge."""
    tokens = _tokens(text or "")
    if len(tokens) < LEAST:
        return None
    windows = max(1, round(len(tokens) / WINDOW))
    cuts = [round(k * len(tokens) / windows) for k in range(windows + 1)]
    parts = [tokens[a:b] for a, b in zip(cuts, cuts[1:])]
    words = [_WORD.findall(" ".join(p).lower()) for p in parts]
    lang = _language(words[0] if windows == 1 else [w for ws in words for w in ws], text, declared)
    function = _SETS.get(lang) or _SETS["it"]
    known = lang in _SETS or lang == ""
    common = _COMMON.get(lang)
    cols: tuple[list[float], ...] = ([], [], [], [], [])
    for toks, ws in zip(parts, words):
        n, m = len(toks), max(1, len(ws))
        content = toks if common else [w for w in ws if len(w) > 3]
        c = len(content)
        repeats, entropy = 0.0, 1.0
        if c > 4:
            counts = Counter(content)
            repeats = 1 - len(counts) / c
            if repeats:
                entropy = 1 - sum([v * log(v) for v in counts.values() if v > 1]) / (c * log(c))
        link = sum([1 for t in toks if (len(t) > 8 or t[0] == "#" or "<" in t) and (_LINK.search(t) or _RUN.search(t))])
        if common:
            joined = "".join(toks)
            usual = sum(map(len, common.findall(joined))) / max(1, len(joined))
        else:
            usual = len([1 for w in ws if w in function]) / m if known else 0.3
        values = (link / n, repeats, entropy, usual, len(_FIGURE.findall(" ".join(toks))) / n)
        for col, v in zip(cols, values):
            col.append(v)
    if windows == 1:
        return lang, tuple(col[0] for col in cols)
    return lang, tuple(_median(col) for col in cols)


def _median(values: list[float]) -> float:
    values.sort()
    k = len(values) // 2
    return values[k] if len(values) % 2 else (values[k - 1] + values[k]) / 2


def described(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (id, declared, lang, features) of the documents long enough to be judged."""
    src = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("declared"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, d) for t, d in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
            keep = pa.array([k for k, g in enumerate(got) if g], pa.int32())
            got = [g for g in got if g]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(keep), b.column(1).take(keep), pa.array([g[0] for g in got], pa.string()), *(pa.array([g[1][i] for g in got], pa.float64()) for i in range(len(FEATURES)))],
                ["id", "declared", "lang", *FEATURES],
            )

    kind = src.schema["id"].dataType.simpleString()
    return spread(src).mapInArrow(run, f"id {kind}, declared string, lang string, {', '.join(f'{f} double' for f in FEATURES)}")


def spam_scores(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (``id_col``, language, distance, along) of the documents long enough to be judged."""
    spark = df.sparkSession
    docs = checkpointed(described(df, id_col, text_col, lang_col))
    mode = docs.where("lang != ''").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(1).collect()
    common = mode[0]["lang"] if mode else "it"
    docs = docs.withColumn("language", F.when(F.col("lang") != "", F.col("lang")).otherwise(F.lit(common)))
    # Location and scale: bounded by the number of languages.
    med = docs.groupBy("language").agg(*(F.percentile_approx(f, 0.5, 20_000).alias(f"m_{f}") for f in FEATURES))
    med = checkpointed(med)
    dev = docs.join(F.broadcast(med), "language").groupBy("language").agg(*(F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{f}")), 0.5, 20_000).alias(f"s_{f}") for f in FEATURES))
    stats = F.broadcast(checkpointed(med.join(dev, "language")))
    scored = docs.join(stats, "language").select(
        "id", "language", *(((F.col(f) - F.col(f"m_{f}")) / F.greatest(1.4826 * F.col(f"s_{f}"), F.lit(FLOOR[f]))).alias(f"z_{f}") for f in FEATURES)
    )
    z = [f"z_{f}" for f in FEATURES]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    clip = lambda c: F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.col(c)))
    sums = scored.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *(F.sum(clip(z[i]) * clip(z[j])).alias(f"c{i}_{j}") for i, j in pairs)).collect()

    def matrix(rows) -> tuple[float, np.ndarray]:
        c = np.zeros((len(z), len(z)))
        for r in rows:
            for i, j in pairs:
                c[i, j] += r[f"c{i}_{j}"]
        c = c + np.triu(c, 1).T
        n = sum(r["n"] for r in rows)
        return n, c

    def correlation(c: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(np.diag(c), 1e-9))
        return c / d[:, None] / d[None, :]

    if not sums:
        return docs.select(F.col("id").alias(id_col), "language", F.lit(0.0).alias("distance"), F.lit(0.0).alias("along"))
    _, total = matrix(sums)
    pooled = correlation(total)
    u = np.array([DIRECTION[f] for f in FEATURES])
    u /= np.linalg.norm(u)
    rows = []
    for r in sums:
        n, c = matrix([r])
        own = (n * correlation(c) + SHRINK * pooled) / (n + SHRINK)
        inv = np.linalg.inv(0.8 * own + 0.2 * np.eye(len(z)))
        rows.append((r["language"], [float(v) for v in inv.ravel()]))
    scatter = F.broadcast(spark.createDataFrame(rows, "language string, inv array<double>"))
    add = lambda terms: reduce(Column.__add__, terms)
    k = len(z)
    return scored.join(scatter, "language").select(
        F.col("id").alias(id_col),
        "language",
        F.sqrt(F.greatest(F.lit(0.0), add(F.col(z[i]) * F.col(z[j]) * F.col("inv")[i * k + j] for i in range(k) for j in range(k)))).alias("distance"),
        add(F.col(z[i]) * float(u[i]) for i in range(k)).alias("along"),
    )


def spam_pages(df: DataFrame, id_col: str, text_col: str, lang_col: str, distance: float = 7.0, along: float = 7.6) -> DataFrame:
    """The ids of the pages that are spam."""
    return spam_scores(df, id_col, text_col, lang_col).where((F.col("distance") > distance) & (F.col("along") > along)).select(id_col)
