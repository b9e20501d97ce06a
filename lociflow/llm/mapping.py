"""Mapping freely typed values to a canonical list: a partition-based pigeonhole join in SQL.

1. Each distinct value is written in a plain form (full-width, Greek and look-alike letters folded, case and
   punctuation dropped), once as it stands and once without labels such as "gene", "human" or a version.
2. A plain form that equals that of a listed key names the key's entry.
3. For the rest, each name of the list is cut into k+1 segments. A value within k edits holds one of them
   unchanged, shifted by at most k places: an equi-join on (name length, segment number, text) finds all
   candidates, built-in levenshtein verifies them. One swap of neighbouring letters counts as one edit.
4. Values without an entry come out of an anti-join as unmatched.

Identifiers and full names only match in step 2: a changed digit there names something else.

Scale: everything works on distinct values (a value that a third of all rows hold is one row), joins are
equi-joins on short texts of bounded number per value, and no side is broadcast by hint.

Defined results: null and blank values are left out; ties in distance go to the smallest canonical entry;
repeated rows give one result per id; empty tables give empty results (an empty list: all unmatched); a null or
blank key of the list is ignored; a key claimed by two entries names the smaller one; a value
longer than the longest name by more than k can only match by equality.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

from lociflow.session import cut

UNMATCHED = "UNMATCHED"
#: Letters of other scripts that look like Latin capitals. Fixed values.
LOOK_ALIKE = str.maketrans("АВЕЅІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABESIJKMHOPCTYXABEZHIKMNOPTYX")
#: Labels around a typed gene name. Fixed values.
LABELS_BEFORE = ("gene id", "geneid", "gene", "human", "hs", "entrez", "ensembl", "hgnc", "symbol")
LABELS_AFTER = ("protein", "gene", "human", "homo sapiens")


def _translate(column: str) -> str:
    """Full-width forms, accented capitals and look-alikes to plain capitals, by rule."""
    pairs = {chr(c): unicodedata.normalize("NFKC", chr(c)).upper() for c in range(0xFF01, 0xFF5F)}
    for c in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(c))[0].upper()
        if base.isascii() and base.isalpha():
            pairs[chr(c)] = base
    pairs |= {chr(k): chr(v) for k, v in LOOK_ALIKE.items()}
    pairs = {k: v for k, v in pairs.items() if len(v) == 1 and (v.isalnum() or v in " -:()._^")}
    return f"translate({column}, '{''.join(pairs)}', '{''.join(pairs.values())}')"


def _spell_greek(column: str) -> str:
    """Greek small letters by their names: δ becomes delta."""
    for c in range(0x3B1, 0x3CA):
        name = unicodedata.name(chr(c)).removeprefix("GREEK SMALL LETTER ")
        if name.isalpha():
            column = f"replace({column}, '{chr(c)}', '{name}')"
    return column


def _swap(x: str, pattern: str, by: str, duck: bool) -> str:
    """regexp_replace of all matches, in Spark's or DuckDB's spelling; a group in by is written $1."""
    if duck:
        return f"regexp_replace({x}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"regexp_replace({x}, '{pattern.replace(chr(92), chr(92) * 2)}', '{by}')"


def plain_sql(column: str, duck: bool = False) -> str:
    return _swap(_translate(f"upper({_spell_greek(column)})"), "[^A-Z0-9]", "", duck)


def stripped_sql(column: str, duck: bool = False) -> str:
    """The text without labels, remarks in brackets, footnote marks and version numbers, in plain form."""
    before, after = "|".join(LABELS_BEFORE).upper(), "|".join(LABELS_AFTER).upper()
    x = _translate(f"upper({_spell_greek(column)})")
    for pattern, by in (
        (rf"[(][^()A-Z0-9]*[)]|[(](?:{after})[)]", " "),
        (r"\^[0-9]+\s*$", ""),
        (rf"^[^A-Z0-9]*(?:{before})(?:\s*:\s*|\s+)", ""),
        (rf"(?:_|\s+)(?:{after})[^A-Z0-9]*$", ""),
        (r"^([^A-Z0-9]*ENS[A-Z]*[0-9]+)[.][0-9]+[^A-Z0-9]*$", "$1"),
        ("[^A-Z0-9]", ""),
    ):
        x = _swap(x, pattern, by, duck)
    return x


def brute_force_sql(values: str, keys: str, k: int = 2) -> str:
    """DuckDB: (value, entry) of the distinct values by comparing each with every key; what match_values must give."""
    return f"""
        SELECT value, coalesce(arg_min(e.entry, e.o), any_value(n.entry), '{UNMATCHED}') AS entry FROM (
            SELECT value, plain, CASE WHEN stripped = '' THEN plain ELSE stripped END AS stripped FROM (
                SELECT value, {plain_sql("value", True)} AS plain, {stripped_sql("value", True)} AS stripped FROM (SELECT DISTINCT value FROM {values}))) f
        LEFT JOIN (
            SELECT p AS name, min(entry) AS entry, o FROM (SELECT {plain_sql("key", True)} AS p, entry, o FROM {keys}, (SELECT unnest([0, 1]) AS o) WHERE entry IS NOT NULL AND key IS NOT NULL) WHERE p <> '' GROUP BY ALL
        ) e ON e.name = CASE e.o WHEN 0 THEN f.plain ELSE f.stripped END
        LEFT JOIN (
            SELECT s, arg_min(entry, (d, entry)) AS entry FROM (
                SELECT s, x.entry, CASE WHEN damerau_levenshtein(s, name) = 1 THEN 1 ELSE levenshtein(s, name) END AS d
                FROM (SELECT DISTINCT CASE WHEN stripped = '' THEN plain ELSE stripped END AS s FROM (SELECT {plain_sql("value", True)} AS plain, {stripped_sql("value", True)} AS stripped FROM (SELECT DISTINCT value FROM {values})))
                JOIN (SELECT {plain_sql("key", True)} AS name, min(entry) AS entry FROM {keys} WHERE fuzzy AND entry IS NOT NULL GROUP BY 1) x
                ON length(name) > {k} AND abs(length(s) - length(name)) <= {k} AND levenshtein(s, name) <= {k}) GROUP BY 1
        ) n ON n.s = f.stripped
        GROUP BY value"""


def match_values(spark: SparkSession, values: DataFrame, keys: DataFrame, k: int = 2) -> DataFrame:
    """values(value), keys(key, entry, fuzzy boolean) -> value, entry, distance (0: equal in plain form).

    entry is UNMATCHED and distance null for a value that no key is close to. One row per distinct value.
    """
    forms = spark.sql(
        f"""SELECT value, plain, CASE WHEN stripped = '' THEN plain ELSE stripped END AS stripped FROM (
              SELECT value, {plain_sql("value")} AS plain, {stripped_sql("value")} AS stripped
              FROM (SELECT DISTINCT value FROM {{v}} WHERE trim(regexp_replace(value, '[\\\\s\\u00a0]', '')) <> ''))""",
        v=values,
    )
    forms = cut(forms)
    list_ = spark.sql(f"SELECT p AS name, min(entry) AS entry, max(fuzzy) AS fuzzy FROM (SELECT {plain_sql('key')} AS p, entry, fuzzy FROM {{l}} WHERE entry IS NOT NULL) WHERE p <> '' GROUP BY p", l=keys)
    list_ = cut(list_)
    equal = spark.sql(
        """SELECT value, min_by(entry, o) AS entry FROM (
             SELECT f.value, x.entry, f.o FROM (SELECT value, plain AS p, 0 AS o FROM {f} UNION ALL SELECT value, stripped, 1 FROM {f} WHERE stripped <> plain) f
             JOIN {x} x ON f.p = x.name) GROUP BY value""",
        f=forms, x=list_,
    )
    equal = cut(equal)
    rest = spark.sql("SELECT stripped AS s, value FROM {f} f LEFT ANTI JOIN {e} e ON f.value = e.value WHERE stripped <> ''", f=forms, e=equal)
    # segment i of a name of n letters: from i * n div (k+1), the last ends with the name
    segments = spark.sql(
        f"""SELECT name, entry, n, i, substring(name, a + 1, b - a) AS piece FROM (
              SELECT name, entry, n, i, cast(floor(i * n / {k + 1}) AS INT) AS a, cast(floor((i + 1) * n / {k + 1}) AS INT) AS b FROM (
                SELECT name, entry, length(name) AS n, explode(sequence(0, {k})) AS i FROM {{x}} WHERE fuzzy AND length(name) > {k}))""",
        x=list_,
    )
    probes = spark.sql(
        f"""SELECT s, n, i, substring(s, p + 1, b - a) AS piece FROM (
              SELECT s, n, i, a, b, explode(sequence(greatest(0, a - {k}), a + {k})) AS p FROM (
                SELECT s, n, i, cast(floor(i * n / {k + 1}) AS INT) AS a, cast(floor((i + 1) * n / {k + 1}) AS INT) AS b FROM (
                  SELECT s, n, explode(sequence(0, {k})) AS i FROM (
                    SELECT s, explode(sequence(greatest({k + 1}, length(s) - {k}), length(s) + {k})) AS n FROM (SELECT DISTINCT s FROM {{r}}) WHERE length(s) BETWEEN 1 AND (SELECT max(length(name)) + {k} FROM {{x}} WHERE fuzzy)))))
            WHERE p + b - a <= length(s)""",
        r=rest, x=list_,
    )
    near = spark.sql(
        f"""SELECT s, min(struct(d, entry)) AS best FROM (
              SELECT s, entry, CASE WHEN n = length(s) AND d = 2 AND exists(sequence(1, n - 1), j ->
                         s = concat(left(name, j - 1), substring(name, j + 1, 1), substring(name, j, 1), substring(name, j + 2))) THEN 1 ELSE d END AS d
              FROM (SELECT s, name, entry, n, levenshtein(s, name, {k}) AS d FROM (
                      SELECT DISTINCT p.s, x.name, x.entry, x.n FROM {{p}} p JOIN {{x}} x ON p.n = x.n AND p.i = x.i AND p.piece = x.piece))
              WHERE d >= 0) GROUP BY s""",
        p=probes, x=segments,
    )
    close = spark.sql("SELECT r.value, n.best.entry AS entry, n.best.d AS distance FROM {r} r JOIN {n} n ON r.s = n.s", r=rest, n=near)
    found = cut(spark.sql("SELECT value, entry, 0 AS distance FROM {e} UNION ALL SELECT value, entry, distance FROM {c}", e=equal, c=close))
    return spark.sql(
        f"SELECT value, entry, distance FROM {{m}} UNION ALL SELECT f.value, '{UNMATCHED}', cast(null AS INT) FROM {{f}} f LEFT ANTI JOIN {{m}} m ON f.value = m.value",
        m=found, f=forms,
    )


def gene_keys(spark: SparkSession, genes: DataFrame) -> DataFrame:
    """Every key by which gene_info names a gene; only symbols and aliases may be misspelled."""
    return spark.sql(
        """SELECT symbol AS key, symbol AS entry, true AS fuzzy FROM {g}
           UNION ALL SELECT explode(aliases), symbol, true FROM {g}
           UNION ALL SELECT ensembl_id, symbol, false FROM {g} UNION ALL SELECT entrez_id, symbol, false FROM {g} UNION ALL SELECT name, symbol, false FROM {g}""",
        g=genes,
    )
