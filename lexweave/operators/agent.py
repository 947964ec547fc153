"""The loop that lets a language model query the graph, with the model as a plain callable."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions import vectors as vec
from lexweave.operators import law, search
from lexweave.schema import SESSION_RESULT

PROMPT = (
    "Domanda: {question}\nPasso {iteration} di {iterations}.\nDocumenti: {documents}\nContesti:\n{contexts}\n"
    "Rispondi con chiamate <api>strumento('documento','testo')</api> fra search_by_embedding, search_by_text, search_by_category, "
    "search_article('numero','legge'), wide_search('testo','legge'), o con <api>end_querying(risposta)</api>."
)


class Call(NamedTuple):
    func: str
    arg1: str
    arg2: str


class Answer(NamedTuple):
    question: str
    model_responses: list[str]
    final_answer: str | None
    contexts: list[tuple[Call, list[Row]]]


def parse(spark, response: str) -> list[Call]:
    """The calls of one response; an answer is unescaped."""
    df = spark.createDataFrame([(response,)], "r string").select(F.explode(tx.tool_calls(F.col("r"))).alias("c")).select("c.*")
    return [Call(r.func, unescape(r.arg1) if r.func == "end_querying" else r.arg1, r.arg2) for r in df.collect()]


def combine(contexts: list) -> list:
    """Contexts as they are: one entry for each call."""
    return contexts


class Session:
    """A question-and-answer session over a graph and a law corpus.

    ``model`` gives the text of a prompt; ``embedder`` the vectors of texts. Every call is one small query whose rows
    are at most ``limit``; the tables stay where they are.
    """

    def __init__(self, graph: search.Graph, documents: DataFrame, model: Callable[[str], str], embedder=None, limit: int = 5, iterations: int = 10):
        self.graph, self.documents, self.model, self.limit, self.iterations = graph, documents, model, limit, iterations
        self.embedder = embedder or vec.hash_embedding

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder([text])[0]]

    def run(self, call: Call) -> DataFrame:
        doc, text = call.arg1 or None, call.arg2
        if call.func == "search_by_embedding":
            return search.by_vector(self.graph, self._vector(text), doc, self.limit)
        if call.func == "search_by_text":
            return search.by_text(self.graph, text, doc, self.limit)
        if call.func == "search_by_category":
            return search.by_category(self.graph, text, doc, self.limit)
        if call.func == "search_article":
            number, name = (call.arg1, call.arg2) if call.arg1 else (call.arg2, None)
            return law.lookup(self.graph.nodes, self.documents, number, name)
        if call.func == "wide_search":
            what, name = (call.arg1, call.arg2) if call.arg1 else (call.arg2, None)
            return law.wide_search(self.graph.nodes, self.documents, self._vector(what), what, name)
        raise ValueError(f"unknown tool {call.func}")

    def ask(self, question: str, names: list[str] | None = None) -> Answer:
        """Runs the loop until an answer, a response without a valid call, or the last iteration. A failing call is left out."""
        spark = self.graph.chunks.sparkSession
        responses: list[str] = []
        contexts: list[tuple[Call, list[Row]]] = []
        for k in range(1, self.iterations + 1):
            shown = "\n".join(f"{c.func}({c.arg1}, {c.arg2}): {[r.asDict() for r in rows]}" for c, rows in combine(contexts))
            response = self.model(PROMPT.format(question=question, iteration=k, iterations=self.iterations, documents=", ".join(names or []), contexts=shown))
            responses.append(response)
            calls = parse(spark, response)
            if not calls:
                break
            for c in calls:
                if c.func == "end_querying":
                    return Answer(question, responses, c.arg1, contexts)
                try:
                    contexts.append((c, self.run(c).collect()))
                except Exception as e:  # noqa: BLE001 - the loop goes on without a failed call
                    contexts.append((c, [Row(error=str(e)[:200])]))
        return Answer(question, responses, None, contexts)


def results(spark, answers: list[Answer]) -> DataFrame:
    return spark.createDataFrame([(a.question, a.model_responses, a.final_answer) for a in answers], SESSION_RESULT)
