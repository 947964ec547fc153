"""Mapping free-entered values to a canonical list (problem 1), in SQL only.

``pigeonhole_join`` finds all pairs of strings within k edits. A reference string is cut into 2 (k + 1) segments, of
which k edits leave at least k + 2 unchanged, so of any k + 1 of them at least one stands unchanged in the value; the
k + 1 rarest are indexed, by (length, place, substring), and what all references have in common is not. In the value a
segment is shifted by at most (k + difference of the lengths) / 2. The pairs met by equality are verified with the
built-in levenshtein. Digits of a string admit no edit: they are kept apart, and are part of every key.

``map_laws`` applies it to names of laws: every mapped row comes through the join. Values and references are brought to
the same written forms first: a numbered act is its kind with number, year and, where given, day and month; a named act
is its name, and its subject with a mark of the kind before or behind; a name with words cut short is the first letters
of its words, joined without edits and verified word by word. References have their own name in these forms, and the
kinds in their usual abbreviations (``ALIASES``, a parameter). Of the entries met the nearest is taken; values that
meet none, or several equally near, come out through an anti-join with -1.

Defined results: null and blank values have no row; each other row of the input has exactly one, repeated rows
included; an empty reference list gives -1 throughout; extra columns are ignored. Values of any length are compared
whole; beyond the longest reference length plus k they meet nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexweave.session import checkpointed

#: Edits allowed by the number of letters: one to four characters name a kind by an abbreviation, in which every letter counts.
EDITS = "CASE WHEN {n} < 5 THEN 0 WHEN {n} < 8 THEN 2 WHEN {n} < 24 THEN 3 ELSE 4 END"
MOST = 4

#: Written forms of the kinds of numbered acts, without blanks and marks (fixed values).
ALIASES = {
    "legge": "legge l",
    "decreto-legge": "decretolegge dl decrlegge",
    "decreto legislativo": "decretolegislativo dlgs decrlegvo decrlgs dleg dlegvo decrlegisl",
    "decreto ministeriale": "decretoministeriale decretomin dm decrmin",
    "decreto del presidente della repubblica": "decretodelpresidentedellarepubblica decretopresidentedellarepubblica decretopresidenterepubblica dpr decrpresrep decretopresrep",
}
MONTHS = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()


def pigeonhole_join(values: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows (form, v, digits, rid, r, d) of all pairs within the edits allowed.

    values(form, v, digits), distinct; refs(form, rid, r, digits, k), k of at most ``MOST``. Strings meet within a form
    and with equal digits. A pair met by several strings of a reference comes out for each.
    """
    spark = values.sparkSession
    # segment i of a string of length n, cut into m: the first ones are one character shorter where it does not divide
    pos = "i * (n DIV m) + greatest(0, i - (m - n % m))"
    size = "n DIV m + CASE WHEN i >= m - n % m THEN 1 ELSE 0 END"
    cut = "greatest(k + 1, least(2 * (k + 1), n DIV 2))"
    ref = spark.sql(
        f"""
        SELECT *, substring(r, {pos} + 1, {size}) AS seg FROM (
          SELECT *, explode(sequence(0, m - 1)) AS i FROM (
            SELECT *, {cut} AS m FROM (SELECT DISTINCT form, rid, r, digits, k, length(r) AS n FROM {{refs}} WHERE length(r) > 0)))
        """,
        refs=refs,
    )
    # the k + 1 rarest segments of each string
    ref = spark.sql(
        """
        SELECT form, rid, r, digits, k, n, m, i, seg FROM (
          SELECT r.*, row_number() OVER (PARTITION BY form, rid, r, digits ORDER BY c, i) AS place
          FROM {r} r JOIN (SELECT form, n, k, digits, i, seg, count(*) AS c FROM {r} GROUP BY ALL) USING (form, n, k, digits, i, seg))
        WHERE place <= k + 1
        """,
        r=ref,
    )
    ref = checkpointed(ref)
    # the planner does not foresee how many substrings a value gives, so it is told not to broadcast them
    query = f"""
    WITH shape AS (SELECT DISTINCT form, n, k, m, i, {size} AS size, {pos} AS pos FROM {{ref}}),
    val AS (
      SELECT form, v, digits, n, k, i, substring(v, at + 1, size) AS seg FROM (
        SELECT *, explode(sequence(greatest(0, pos + ceil((len - n - k) / 2)), least(len - size, pos + floor((len - n + k) / 2)))) AS at
        FROM (SELECT form, v, digits, length(v) AS len, explode(sequence(greatest(1, length(v) - {MOST}), length(v) + {MOST})) AS n FROM {{values}}
              WHERE length(v) BETWEEN 1 AND (SELECT coalesce(max(n), 0) FROM {{ref}}) + {MOST}) JOIN shape USING (form, n)
        WHERE abs(len - n) <= k AND greatest(0, pos + ceil((len - n - k) / 2)) <= least(len - size, pos + floor((len - n + k) / 2)))
    )
    SELECT * FROM (
      SELECT form, v, digits, rid, r, levenshtein(v, r, k) AS d FROM (
        SELECT /*+ MERGE(val) */ DISTINCT form, val.v, digits, ref.rid, ref.r, k FROM val JOIN {{ref}} ref USING (form, n, k, digits, i, seg)))
    WHERE d >= 0
    """
    return spark.sql(query, ref=ref, values=values)


def _cleaned(column: str) -> str:
    """SQL: the value without decoration: file endings, notes, parts of acts before the name."""
    x = f"lower({column})"
    for pattern, by in (
        (r"[_\\s\\u00a0]+", " "),
        (r"[’`´\\x27]", "~"),
        (r"\\.(json|pdf|txt|xml|docx?)\\s*$", ""),
        (r"[\\s*;.,]+$", ""),
        (r"(,? e succ\\.? mod\\.?|,? e s\\.? ?m\\.? ?i\\.?|\\(testo coordinato\\)|- testo vigente|\\(agg\\.?\\)|,? e successive modific\\w+)[\\s*;.]*$", ""),
        (r"[\\s*;.,]+$", ""),
        (r"^\\s*(artt?\\.? ?[0-9]+(-[0-9]+)?(-?(bis|ter|quater))?|allegato [a-z0-9]+ (al|alla|allo|all~)|all\\. ?[a-z0-9]+ al)[ ,]+(del(la|lo|l~)? )?", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}')"
    return f"trim({x})"


def _acts(rows: DataFrame, column: str) -> DataFrame:
    """Adds (kind_text, number, year, day, month) to rows whose ``column`` names a numbered act."""
    spark = rows.sparkSession
    x = f"regexp_replace({column}, ' - .*$', '')"
    names = "|".join(m[3:] and f"{m}|{m[:3]}" for m in MONTHS)
    text_date = f"'([0-9]{{{{1,2}}}})°? ?({names})\\\\.? ?([0-9]{{{{4}}}})'"
    source = f"""
    SELECT * EXCEPT (cut, in_words), CASE WHEN in_words = '' THEN cut ELSE replace(cut, in_words, concat(' <', regexp_extract(in_words, '^[0-9]+', 0), '/',
      (locate(substring(regexp_extract(in_words, {text_date}, 2), 1, 3), '{"".join(m[:3] for m in MONTHS)}') + 2) DIV 3, '/', regexp_extract(in_words, '[0-9]+$', 0), '> ')) END AS worded
    FROM (SELECT *, regexp_extract(cut, {text_date}, 0) AS in_words FROM (SELECT *, {x} AS cut FROM {{rows}}))
    """
    rows = spark.sql(source, rows=rows)
    x = "regexp_replace(worded, '(^|[^0-9<])([0-9]{{1,2}})[/.-]([0-9]{{1,2}})[/.-]([0-9]{{4}})', '$1 <$2/$3/$4> ')"
    marked = f"SELECT *, regexp_extract(marked, '<[0-9]+/[0-9]+/[0-9]+>', 0) AS dated FROM (SELECT * EXCEPT (worded), {x} AS marked FROM {{rows}})"
    # written out, so that the expressions do not multiply when they are merged
    rows = checkpointed(spark.sql(marked, rows=rows))
    query = """
    SELECT *,
      CASE WHEN dated <> '' THEN regexp_extract(dated, '<([0-9]+)/', 1) END AS day_,
      CASE WHEN dated <> '' THEN regexp_extract(dated, '/([0-9]+)/', 1) END AS month_,
      regexp_replace(regexp_replace(replace(marked, dated, ' '), '/ ?~[0-9]{{2}}', ' '), ' +', ' ') AS rest
    FROM {rows}
    """
    parsed = checkpointed(spark.sql(query, rows=rows))
    query = """
    SELECT name, rid,
      CAST(CASE WHEN dated <> '' THEN regexp_extract(dated, '/([0-9]+)>', 1) WHEN after <> '' THEN after WHEN lead_year <> '' THEN lead_year END AS INT) AS year,
      CAST(CASE WHEN dated <> '' THEN nullif(regexp_extract(rest, '([0-9]+)', 1), '') WHEN after <> '' THEN before
        WHEN lead_year <> '' THEN nullif(regexp_extract(rest, '^ ?[0-9]{{4}}[^0-9]+([0-9]+)', 1), '') END AS BIGINT) AS number,
      CAST(day_ AS INT) AS day, CAST(month_ AS INT) AS month,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, 'del ?(?=[0-9]|$)', ' '), '[0-9]+', ' '), '(^|[^a-z])(nr?|num)(?=[^a-z]|$)', '$1 '), '[^a-zà-ÿ]', '') AS kind_text
    FROM (SELECT *,
      regexp_extract(rest, '([0-9]{{1,9}}) ?(?:/|-|del) ?([0-9]{{4}})([^0-9]|$)', 1) AS before,
      regexp_extract(rest, '([0-9]{{1,9}}) ?(?:/|-|del) ?([0-9]{{4}})([^0-9]|$)', 2) AS after,
      regexp_extract(rest, '^ ?([0-9]{{4}}),', 1) AS lead_year FROM {parsed})
    """
    return spark.sql(query, parsed=parsed)


def _letters(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-zà-ÿ]+', ' '), ' +', ' '))"


def map_laws(docs: DataFrame, refs: DataFrame, id_col: str = "kb_id", name_col: str = "nome_legge", ref_id: str = "ref_id", ref_name: str = "nome_legge", aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows (``id_col``, ref_id): the entry each name means, -1 for none."""
    spark = docs.sparkSession
    names = spark.sql(f"SELECT {id_col} AS id, {name_col} AS name FROM {{docs}} WHERE trim(regexp_replace({name_col}, '\\\\s+', ' ')) <> ''", docs=docs)
    # names and references go the same way: rid is null for names
    texts = checkpointed(
        spark.sql(
            f"""
            SELECT name, CAST(NULL AS BIGINT) AS rid, {_cleaned('name')} AS x FROM (SELECT DISTINCT name FROM {{names}})
            UNION ALL SELECT {ref_name}, CAST({ref_id} AS BIGINT), {_cleaned(ref_name)} FROM {{refs}} WHERE {ref_name} IS NOT NULL
            """,
            names=names, refs=refs,
        )
    )
    kinds = [(k, f) for k, forms in (ALIASES if aliases is None else aliases).items() for f in forms.split()]
    kinds = spark.createDataFrame(kinds, "kind string, alias string")

    # Numbered acts: the kind as a string, number, year and date as digits.
    acts = _acts(spark.sql("SELECT name, rid, x FROM {t} WHERE regexp_replace(x, ' - .*$', '') RLIKE '[0-9]'", t=texts), "x")
    short, dated = "concat(number, '/', year)", "concat(number, '/', year, '@', day, '.', month)"
    act_values = spark.sql(f"SELECT name, 'act' AS form, kind_text AS v, CASE WHEN day IS NULL THEN {short} ELSE {dated} END AS digits FROM {{a}} WHERE rid IS NULL AND number IS NOT NULL AND year IS NOT NULL AND (day IS NULL) = (month IS NULL)", a=acts)
    act_refs = spark.sql(
        f"""
        SELECT 'act' AS form, rid, r, explode(filter(array_distinct(array({short}, {dated})), y -> y IS NOT NULL)) AS digits, {EDITS.format(n="length(r)")} AS k FROM (
          SELECT DISTINCT a.*, coalesce(w.alias, a.kind_text) AS r FROM {{a}} a LEFT JOIN {{k}} same ON a.kind_text = same.alias LEFT JOIN {{k}} w ON w.kind = same.kind
          WHERE a.rid IS NOT NULL AND number IS NOT NULL AND year IS NOT NULL)
        """,
        a=acts, k=kinds,
    )

    # Named acts: the name in letters; the subject with a mark of the kind; the first letters of words cut short.
    opening = "^(codice|cod|c|testo unico|testo un|tu)( delle disposizioni| disp)?( in materia| in mat)?( di| della| del| dei| delle| su)? "
    kind_of = "CASE WHEN v RLIKE '^(testo un|tu )' OR v RLIKE ' (tu|testo unico)$' THEN 'tu' WHEN v RLIKE '^(codice|cod|c) ' OR v RLIKE ' (codice|cod|c)$' THEN 'codice' END"
    named = checkpointed(
        spark.sql(
            f"""
            SELECT *, regexp_replace(regexp_replace(v, '{opening}', ''), ' (codice|cod|c|testo unico|tu)$', '') AS s, {kind_of} AS kind
            FROM (SELECT name, rid, regexp_replace({_letters('x')}, '(^| )t u( |$)', '$1tu$2') AS v FROM {{t}} WHERE NOT x RLIKE '[0-9]')
            """,
            t=texts,
        )
    )
    cut = "array_join(transform(split(s, ' '), w -> substring(w, 1, 2)), ' ')"
    named_values = spark.sql(
        f"""
        SELECT name, 'name' AS form, v, '' AS digits FROM {{n}} WHERE rid IS NULL AND v <> ''
        UNION ALL SELECT name, 'name', concat(s, ' ', kind), '' FROM {{n}} WHERE rid IS NULL AND kind IS NOT NULL AND s <> ''
        UNION ALL SELECT name, 'cut', concat({cut}, ' ', kind), '' FROM {{n}} WHERE rid IS NULL AND kind IS NOT NULL AND name RLIKE '[A-Za-z]{{{{2,}}}}[.]'
        """,
        n=named,
    )
    named_refs = spark.sql(
        f"""
        SELECT 'name' AS form, rid, v AS r, '' AS digits, {EDITS.format(n="length(v)")} AS k FROM {{n}} WHERE rid IS NOT NULL
        UNION ALL SELECT 'name', rid, explode(array(concat(s, ' ', kind), concat(kind, ' ', s), s)), '', {EDITS.format(n="length(s)")} FROM {{n}} WHERE rid IS NOT NULL AND kind IS NOT NULL AND s <> ''
        UNION ALL SELECT 'cut', rid, concat({cut}, ' ', kind), '', 0 FROM {{n}} WHERE rid IS NOT NULL AND kind IS NOT NULL AND s <> ''
        """,
        n=named,
    )
    values = checkpointed(act_values.unionByName(named_values))
    met = pigeonhole_join(values.select("form", "v", "digits").distinct(), act_refs.unionByName(named_refs))
    # the kind of an act must be the nearest of all kinds; words cut short must each begin the word they stand for
    found = spark.sql(
        """
        SELECT w.name, m.rid, m.d FROM {w} w JOIN {m} m USING (form, v, digits) CROSS JOIN (SELECT collect_list(alias) AS every FROM {k})
        LEFT JOIN (SELECT name, split(s, ' ') AS words FROM {n} WHERE rid IS NULL) c ON form = 'cut' AND c.name = w.name
        LEFT JOIN (SELECT rid AS id, split(s, ' ') AS words FROM {n} WHERE rid IS NOT NULL) f ON form = 'cut' AND f.id = m.rid
        WHERE CASE form WHEN 'act' THEN m.d = 0 OR (2 * m.d < length(v) AND forall(every, a -> levenshtein(v, a) >= m.d))
          WHEN 'cut' THEN size(c.words) = size(f.words) AND forall(zip_with(c.words, f.words, (a, b) -> startswith(b, a)), ok -> ok) ELSE true END
        """,
        w=values, m=met, k=kinds, n=named,
    )
    # the nearest entries of a name; it is mapped if they are one
    chosen = spark.sql(
        """
        SELECT name, one.rid FROM (SELECT name, min(struct(d, rid)) AS one, max_by(struct(d, rid), struct(-d, rid)) AS other FROM {f} GROUP BY name) WHERE one = other
        """,
        f=found,
    )
    chosen = checkpointed(chosen)
    mapped = spark.sql("SELECT /*+ MERGE(c) */ n.id, c.rid FROM {n} n JOIN {c} c ON n.name = c.name", n=names, c=chosen)
    unmatched = spark.sql("SELECT /*+ MERGE(c) */ n.id, CAST(-1 AS BIGINT) AS rid FROM {n} n LEFT ANTI JOIN {c} c ON n.name = c.name", n=names, c=chosen)
    return spark.sql(f"SELECT id AS {id_col}, rid AS ref_id FROM {{a}} UNION ALL SELECT id, rid FROM {{b}}", a=mapped, b=unmatched)
