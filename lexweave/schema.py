"""Types of the two graphs and of the result rows."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _d, _i, _l = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
F = T.StructField

ENTITY = T.StructType([F("text", _s), F("label", _s)])
CHUNK_HIT = T.StructType(
    [
        F("text", _s), F("chunk_id", _s), F("similarity", _d), F("source", _s),
        F("prev_chunks", T.ArrayType(_s)), F("next_chunks", T.ArrayType(_s)),
        F("entities", T.ArrayType(ENTITY)), F("related", T.ArrayType(T.StructType([F("text", _s)]))),
    ]
)
ARTICLE_HIT = T.StructType([F("titolo", _s), F("rubrica", _s), F("contenuto", _s), F("law_name", _s)])
WIDE_HIT = T.StructType([F("strategy", _s), F("source", _s), F("titolo", _s), F("contenuto", _s), F("similarity", _d)])
KB_NODE = T.StructType(
    [
        F("node_id", _s), F("doc_id", _s), F("parent_id", _s), F("label", _s), F("nome_legge", _s), F("titolo", _s), F("rubrica", _s),
        F("contenuto", _s), F("source", _s), F("child_pos", _i), F("depth", _i), F("props", T.MapType(_s, _s)),
    ]
)
RELATED = T.StructType([F("src_id", _s), F("dst_id", _s), F("text", _s), F("kind", _s)])
RELATED_JSONL = T.StructType([F("article_number", _s), F("text", _s), F("_corrupt_record", _s)])
SESSION_RESULT = T.StructType([F("question", _s), F("model_responses", T.ArrayType(_s)), F("final_answer", _s)])
SPAN = T.StructType([F("start", _i), F("end", _i), F("label", _s)])
EMPTY_RELATED = "src_id string, dst_id string, text string, kind string"
