"""Fill-in-middle transformation by splitting at lookaround boundaries.

A grammar of units is a list of neighbouring classes that stay together: (left, right) means
that no unit ends between a character of ``left`` and one of ``right``. It is translated to a
zero-width regular expression that matches at every other position inside a text, so Spark's
``split`` cuts there and its pieces, joined, are the text again. An empty text has no units,
which ``split`` can't say (it gives one empty piece), so it is handled apart.

Everything is a column of built-in functions: no shuffle, and no state beyond one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units: runs of ASCII letters, and any other character alone.
LETTER_RUNS = [("[A-Za-z]", "[A-Za-z]")]
CHARACTERS: list[tuple[str, str]] = []
LINES = [(r"[^\n]", r"[\s\S]")]
#: White space belongs to the word that follows it.
WORDS = [(r"\S", r"\S"), (r"\s", r"[\s\S]")]
#: Of 100 texts, those from PLAIN_FROM on stay plain, and of the others as many as SPM are written with the suffix first.
PLAIN_FROM, SPM = 90, 20


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The zero-width expression of all positions inside a text where one unit ends and the next begins.

    Each pair is asked for from its right character on, as most positions are settled by that
    one. The halves of a character beyond the first plane are one character.
    """
    apart = "".join(f"(?:(?!{right})|(?<!{left}))" for left, right in grammar)
    return r"(?!^|\z|[\uDC00-\uDFFF])" + apart


def units(text: Column, grammar: list[tuple[str, str]]) -> Column:
    """The units of a text, in order; joined they are the text. None for an empty text, NULL for NULL."""
    return F.when(text.isNull() | (text != ""), F.split(text, boundary(grammar), -1)).otherwise(F.array().cast("array<string>"))


def _group(digest: Column, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _joined(pieces: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(pieces, start.cast("int"), length.cast("int")), "")


def fill_in_middle(docs: DataFrame, grammar: list[tuple[str, str]] = LETTER_RUNS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output) of every row.

    Two hashes of the id choose the cuts among the n + 1 places between units, a third whether
    the text stays plain, a fourth the order (psm or spm). A NULL text is an empty one; empty
    texts, and texts that hold a mark already, are plain, with NULL parts. A NULL id hashes as
    no digits. Repeated rows each give a row, an empty table none; other columns are dropped.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = rows.select("*", digest.alias("_digest"), units(F.col("text"), grammar).alias("_units"))
    rows = rows.select("*", F.size("_units").cast("long").alias("n"))
    one, two = (_group(F.col("_digest"), k) % (F.col("n") + 1) for k in (1, 2))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_group(F.col("_digest"), 3) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(_group(F.col("_digest"), 4) % 100 < SPM, "spm").otherwise("psm")
    rows = rows.select("*", F.least(one, two).alias("_low"), F.greatest(one, two).alias("_high"), form.alias("form"))
    cut = lambda start, length: F.when(F.col("form") != "plain", _joined(F.col("_units"), start, length))
    parts = {"prefix": cut(F.lit(1), F.col("_low")), "middle": cut(F.col("_low") + 1, F.col("_high") - F.col("_low")), "suffix": cut(F.col("_high") + 1, F.col("n") - F.col("_high"))}
    rows = rows.select("doc_id", "text", "n", "form", *[x.alias(name) for name, x in parts.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.select("*", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))


def restored(made: DataFrame) -> DataFrame:
    """Add the text that an output came from, by its form: the parts between its marks, which no part holds, in their order."""
    parts = F.when(F.col("form") != "plain", F.split(F.substring("output", 4, 2**31 - 1), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1))
    rows = made.select("*", parts.alias("_parts"))
    at = lambda *order: F.concat(*[F.col("_parts")[i] for i in order])
    text = F.when(F.col("form") == "psm", at(0, 2, 1)).when(F.col("form") == "spm", at(1, 2, 0)).otherwise(F.col("output"))
    return rows.select("*", text.alias("restored")).drop("_parts")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row, the last from output and form alone."""
    made = restored(fill_in_middle(docs).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    chars = lambda c: F.char_length(c).cast("long").alias(f"{c}_chars")
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest("output"), digest("restored"))


#: DuckDB's expressions have no lookaround: it lists the units by matching them.
ORACLE_SQL = f"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
cut AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
  CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM hashed),
placed AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
    WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:n], ''), '') AS s FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts"""
