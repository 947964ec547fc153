"""Entity extraction and classification behind exchangeable callables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels of the default extractor (fixed values) and a rule for each. Without a model it knows only what has a form or a usual word.
RULES = {
    "data": r"\b\d{1,2}°?\s+(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\s+\d{4}\b|\b\d{1,2}[/.]\d{1,2}[/.]\d{4}\b",
    "importo": r"€\s?\d[\d.]*(?:,\d+)?|\b\d[\d.]*(?:,\d+)?\s?(?:€|euro\b)|\bEUR\s?\d[\d.,]*\d",
    "legge": r"\b(?:art\.|articolo)\s?\d+(?:-\w+)?[^.;\n]{0,40}?(?:L\.|d\.lgs\.|codice)[^,.;\n]{0,40}",
    "numero": r"\b(?:n\.|nr\.|R\.G\.)\s?\d+[/-]\d{4}\b",
    "persona": r"\b(?:avv\.|dott\.(?:ssa)?|sig\.(?:ra)?|prof\.(?:ssa)?|ing\.|notaio)\s(?:[A-ZÀ-Þ][\w'’]+\s?){1,3}",
    "indirizzo": r"\b(?:[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Ll]argo|[Vv]icolo)\s(?:[A-ZÀ-Þ]?[\w'’]+\s?){1,4},?\s(?:n\.\s?)?\d+(?:/\w+)?",
    "ente giuridico": r"\b(?:Tribunale|Corte (?:d['’]appello|di cassazione|dei conti|costituzionale)|Comune|Provincia|Regione|Ministero|Procura)(?:\s(?:di|del|della|dell['’])\s?[A-ZÀ-Þ]?[\w'’]+)?",
    "organizzazione": r"\b(?:Associazione|Fondazione|Sindacato|Consorzio|Comitato|Ordine)\s(?:(?:di|del|della|degli|dei)\s)?(?:[A-ZÀ-Þ][\w'’]+\s?){1,4}",
    "località": r"\b\d{5}\s[A-ZÀ-Þ][\w'’]+(?:\s[A-ZÀ-Þ][\w'’]+)*(?:\s\([A-Z]{2}\))?",
    "ruolo": r"\b(?:il|la|lo|l['’])\s?(?:ricorrente|resistente|convenut[oa]|attore|attrice|appellante|appellat[oa]|imputat[oa]|curatore|custode|giudice|notaio|perito|consulente tecnico)\b",
    "procedura legale": r"\b(?:ricorso|decreto ingiuntivo|atto di citazione|opposizione|appello|esecuzione (?:immobiliare|mobiliare)|sequestro conservativo|mediazione|concordato preventivo)\b",
    "contratto": r"\bcontratto\s(?:di|d['’])\s?\w+(?:\s\w+)?|\b(?:locazione|compravendita|mutuo|appalto|comodato)\b",
    "soggetto": r"\b(?:creditore|debitore|locatore|conduttore|datore di lavoro|lavoratore|lavoratrice|erede|condomino)\b",
    "oggetto": r"\b(?:immobile|terreno|fondo|veicolo|autovettura|merce|canone|servitù|ipoteca)\b",
    "azienda": r"\b(?:[A-Z]\w+\s){1,4}(?:S\.p\.A\.|S\.r\.l\.|S\.n\.c\.|soc\. coop\.|onlus)",
}


def rule_entities(texts: list[str]) -> list[list[dict[str, str]]]:
    rules = [(label, re.compile(p)) for label, p in RULES.items()]
    return [[{"text": m.group().strip(), "label": label} for label, p in rules for m in p.finditer(t or "")] for t in texts]


def extract(text: Column, provider: Callable[[], Callable[[list[str]], list[list[dict[str, str]]]]] | None = None) -> Column:
    """array<struct<text,label>> of a text; a failing batch gives empty lists."""

    @F.pandas_udf("array<struct<text:string,label:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider() if provider else rule_entities
        for s in batches:
            try:
                yield pd.Series(model([x if isinstance(x, str) else "" for x in s]))
            except Exception:  # noqa: BLE001
                yield pd.Series([[] for _ in s])

    return run(text)


def classify(text: Column, provider: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """Class of the largest logit; 0 where the model fails."""

    @F.pandas_udf(T.IntegerType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for s in batches:
            try:
                yield pd.Series([max(range(len(v)), key=lambda k: v[k]) for v in model(list(s))])
            except Exception:  # noqa: BLE001
                yield pd.Series([0] * len(s))

    return run(text)


def train_classifier(rows: DataFrame, text_col: str = "text", label_col: str = "labels", features: int = 1 << 14):
    """Logistic regression over hashed words, as a pipeline model; the training rows are distributed, not collected."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    steps = [RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_w", outputCol="_f", numFeatures=features), LogisticRegression(featuresCol="_f", labelCol=label_col, maxIter=50, regParam=0.01)]
    return Pipeline(stages=steps).fit(rows)


def aligned_spans(tokens: Column, spans: Column) -> Column:
    """Character spans cut back to whole tokens inside them; spans without one are dropped. Both are arrays of (start, end[, label])."""

    def fit(s: Column) -> Column:
        inside = F.filter(tokens, lambda t: (t["start"] >= s["start"]) & (t["end"] <= s["end"]))
        return F.when(F.size(inside) > 0, F.struct(F.array_min(F.transform(inside, lambda t: t["start"])).alias("start"), F.array_max(F.transform(inside, lambda t: t["end"])).alias("end"), s["label"].alias("label")))

    return F.filter(F.transform(spans, fit), lambda x: x.isNotNull())
