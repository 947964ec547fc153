"""Normalisation of statutory texts: column expressions for the patterns, windows over lines for the structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import spread

#: Kinds of headings, the first that matches a line start counts (fixed values).
SECTIONS = [(k, rf"(?i)^{k}\s+[IVXLC]+") for k in ("PARTE", "LIBRO", "TITOLO", "CAPO", "SEZIONE")] + [("ARTICOLO", r"(?i)^Art\.*\s*\d+")]
#: Ordinals of inserted articles (fixed values).
ORDINALS = "bis|ter|quater|quinquies|sexies|septies|octies|novies|decies"

#: Blocks that are dropped from a text (fixed values): updates, dashed blocks, validity lines, double brackets.
BLOCKS = [r"(?s)AGGIORNAMENTO.*?(?=\n\n)", r"(?s)-{3,}.*?-{3,}", r"(?s)Vigente al.*?\n", r"(?s)\({2}.*?\){2}"]
#: Double brackets that do not hold an article.
LOOSE_BRACKETS = r"(?s)\(\((?!Art\.?\s*\d).*?\)\)"


def section_kind(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SECTIONS):
        out = F.when(line.rlike(pattern), kind).otherwise(out)
    return out


def without_note_markers(text: Column) -> Column:
    """Drops markers like (12) unless a line has one after an article number."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\([0-9]+\))"), 1))
    loose = F.filter(marks, lambda m: ~F.rlike(text, F.concat(F.lit(r"Art\.?\s*\d+.*\Q"), m, F.lit(r"\E"))))
    return F.aggregate(loose, text, lambda acc, m: F.replace(acc, m, F.lit("")))


def without_updates(text: Column, keep_articles: bool = False) -> Column:
    """Drops update blocks, dashed blocks, validity lines and double brackets (``keep_articles``: not ((Art. ...)))."""
    x = text
    for pattern in [*BLOCKS[:-1], LOOSE_BRACKETS if keep_articles else BLOCKS[-1]]:
        x = F.regexp_replace(x, pattern, "")
    return x


def collapsed(text: Column) -> Column:
    """One blank for runs of blanks, two line breaks at most, no white space at line ends; one line for a decree's opening."""
    head = F.regexp_extract(text, r"(?s)\A(DECRETO LEGISLATIVO.*?)(?=\n\n)", 1)
    opened = F.when(head != "", F.concat(F.trim(F.regexp_replace(head, r"\s+", " ")), F.lit("\n\n"), F.substring(text, F.length(head) + 1, F.length(text)))).otherwise(text)
    x = F.regexp_replace(F.regexp_replace(opened, " +", " "), r"\n{3,}", "\n\n")
    lines = F.transform(F.split(x, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda s: F.regexp_replace(s, r"\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n\z", "")


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, line_no, line, kind, section, paragraph): headings are carried forward; blank lines and headings open paragraphs."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kind = section_kind(F.col("line"))
    blank = F.trim(F.regexp_replace("line", r"\s+", " ")) == ""
    return rows.withColumn("kind", F.when(~blank, kind)).withColumn("blank", blank).select(
        "id", "line_no", "line", "kind", "blank", F.last("kind", ignorenulls=True).over(w).alias("section"),
        F.sum(F.when(F.col("blank") | F.col("kind").isNotNull(), 1).otherwise(0)).over(w).alias("paragraph"),
    )


def _article_lines(lines: Column) -> Column:
    """An article: number line, title line, then the numbered parts, each after an empty line."""
    head = F.element_at(lines, 1)
    # the form of a number line (fixed value)
    pattern = rf"(?i)^Art\.*\s*(\d+(?:[-\s]?(?:{ORDINALS}))?(?:\s*\.\s*\d+)?)\s*(.*)$"
    number = F.regexp_extract(head, pattern, 1)
    number = F.regexp_replace(F.regexp_replace(number, rf"(?i)\s*({ORDINALS})", " $1"), r"\s*\.\s*", ".")
    title = F.trim(F.regexp_extract(head, pattern, 2))
    body = F.transform(F.slice(lines, 2, F.size(lines)), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    # lines before the first numbered part are dropped
    first = F.array_position(F.transform(body, lambda s: s.rlike(r"^\d+\.")), True)
    kept = F.when(first > 0, F.slice(body, first.cast("int"), F.size(body))).otherwise(F.array().cast("array<string>"))
    spaced = F.flatten(F.transform(kept, lambda s: F.when(s.rlike(r"^\d+\."), F.array(F.lit(""), s)).otherwise(F.array(s))))
    opening = F.when(F.regexp_extract(head, pattern, 2) != "", F.array(F.concat(F.lit("Art. "), F.trim(number)), title)).otherwise(F.array(F.concat(F.lit("Art. "), F.trim(number))))
    return F.when(head.rlike(pattern), F.concat(opening, spaced)).otherwise(lines)


def _heading_lines(lines: Column) -> Column:
    rest = F.transform(F.slice(lines, 2, F.size(lines)), lambda s: F.regexp_replace(s, r"\s+$", ""))
    first = F.array(F.upper(F.regexp_replace(F.element_at(lines, 1), r"^\s+|\s+$", "")))
    return F.when(F.size(lines) > 1, F.concat(first, F.array(F.lit("")), rest)).otherwise(first)


def structured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (``id_col``, clean_text): paragraphs laid out by the section they stand in.

    Each text is taken apart and put together again where it lies; nothing is exchanged.
    """
    blank = lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) == ""
    rows = df.select(F.col(id_col).alias("id"), F.split(F.coalesce(text_col, F.lit("")), "\n").alias("l"))
    # paragraphs begin at blank lines and at headings
    begins = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: (i == 0) | blank(F.get("l", i)) | section_kind(F.get("l", i)).isNotNull())
    rows = rows.select("id", "l", begins.alias("b"))
    parts = F.transform("b", lambda i, k: F.filter(F.slice("l", i + 1, F.coalesce(F.get("b", k + 1), F.size("l")) - i), lambda s: ~blank(s)))
    rows = rows.select("id", F.filter(parts, lambda p: F.size(p) > 0).alias("p"))
    # the section of each paragraph as one letter, carried forward: a run is a letter and the paragraphs without one after it
    letter = lambda p: F.when(section_kind(F.get(p, 0)) == "ARTICOLO", "A").when(section_kind(F.get(p, 0)).isNotNull(), "H").otherwise("_")
    runs = F.regexp_extract_all(F.array_join(F.transform("p", letter), ""), F.lit("([AH]_*|_+)"), 1)
    rows = rows.select("id", "p", F.flatten(F.transform(runs, lambda r: F.array_repeat(F.substring(r, 1, 1), F.length(r)))).alias("s"))
    laid = F.zip_with("p", "s", lambda p, s: F.array_join(F.when(s == "A", _article_lines(p)).when(s == "H", _heading_lines(p)).otherwise(p), "\n"))
    return rows.select(F.col("id").alias(id_col), F.array_join(laid, "\n").alias("clean_text"))


def cleaned(df: DataFrame, id_col: str, text_col: str, keep_articles: bool = False) -> DataFrame:
    """The whole normalisation: rows (``id_col``, clean_text). Null texts give an empty one; ids must be unique."""
    x = collapsed(without_updates(without_note_markers(F.col(text_col)), keep_articles))
    return structured(spread(df.select(id_col, text_col)).select(F.col(id_col), x.alias("normal_text")), id_col, "normal_text")
