"""License scan by canonical digest: whole texts, and whole lines, joined by digest to known licence texts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .licenses import DIGESTS, EQUIVALENT, LICENSES

#: A line that only says whose copyright it is, with a year or a sign.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;%<!-]*(copyright[^\n]*([0-9]{4}|\(c\)|©|<year>|\[year\])|\(c\)|©)[^\n]*$"
#: ASCII that is neither letter nor digit, and typographic quotes, dashes and spaces.
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{2000}-\x{206f}]+"
#: Most known texts have it, and all whose digest alone is known.
ANCHOR = "licen"
RESERVED = " all  rights  reserved "


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words parted by single spaces, one spelling for each word."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), PUNCTUATION, "  ")
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    padded = functools.reduce(lambda x, pair: F.replace(x, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), EQUIVALENT, padded)
    return F.trim(F.replace(F.replace(padded, F.lit(RESERVED), F.lit("")), F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "UTF-8"), 256)


def known(spark: SparkSession, licenses=LICENSES) -> DataFrame:
    """(license_id, known): the digests of the known texts and those of whole licence files, one row for each distinct digest."""
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in licenses)))
    files = F.explode(F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(d).alias("known")) for i, d in DIGESTS)))
    every = spark.range(1).select(rows.alias("r")).select("r.license_id", digest(F.col("r.text")).alias("known")).union(spark.range(1).select(files.alias("r")).select("r.*"))
    return every.groupBy("known").agg(F.min("license_id").alias("license_id"))


def anchors(spark: SparkSession, licenses=LICENSES) -> list[str]:
    """Strings of which every line that is a known text has one, in lower case; none at all if a known text offers none.

    A word of a canonical text that no spelling is replaced by stood in the line as it is;
    ANCHOR also stands in each spelling of the words that hold it.
    """
    made = {new for _, new in EQUIVALENT}
    rows = F.explode(F.array(*(F.lit(t) for _, t in licenses)))
    out: set[str] = {ANCHOR} if DIGESTS else set()
    for r in spark.range(1).select(rows.alias("t")).select(canonical(F.col("t")).alias("t")).collect():
        own = [w for w in r["t"].split(" ") if w and w not in made]
        if ANCHOR not in r["t"] and not own:
            return []
        if ANCHOR in r["t"]:
            out.add(ANCHOR)
        elif not out.intersection(own):
            out.add(min(own, key=lambda w: (-len(w), w)))
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses=LICENSES) -> DataFrame:
    """(id, digest, license_id, notices): each row's canonical digest and the licences it stands for. An empty table gives no rows.

    license_id is the licence whose known text is the row's entire text, else null. notices
    lists, sorted and joined by commas, the licences whose known text is an entire line of it
    (empty if none). A null text counts as empty; the empty text is no licence. Rows are kept
    as they are, repeated ones too, null ids too; texts of any length are read whole. Where two
    known texts have one digest, the first identifier in order counts. Extra columns are ignored.
    The known digests are a fixed list of a few dozen rows, so both joins broadcast it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines, marks = F.split(text, "\n"), anchors(spark, licenses)
    if marks:
        lines = F.filter(lines, lambda x: functools.reduce(lambda a, b: a | b, (F.contains(F.lower(x), F.lit(m)) for m in marks)))
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), digest(text).alias("digest"), F.array_distinct(F.transform(lines, digest)).alias("lines"))
    rows = materialize(rows, "digests")
    of = F.broadcast(known(spark, licenses))
    noted = rows.select("n", F.explode("lines").alias("line")).join(of, F.col("line") == F.col("known"))
    noted = noted.groupBy("n").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    whole = rows.join(of, F.col("digest") == F.col("known"), "left")
    return whole.join(noted, "n", "left").select("id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def scan_sql() -> str:
    """The same in DuckDB SQL, over the view documents. Every line is looked up, whatever words it has."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def sql(text: str) -> str:
        x = f"regexp_replace(regexp_replace(lower({text}), {quote(COPYRIGHT_LINE)}, '', 'g'), {quote(PUNCTUATION)}, '  ', 'g')"
        x = f"(' ' || {x} || ' ')"
        for a, b in EQUIVALENT:
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"sha256(trim(replace(replace({x}, '{RESERVED}', ''), '  ', ' ')))"

    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in LICENSES)
    files = ", ".join(f"('{i}', '{d}')" for i, d in DIGESTS)
    return f"""
        WITH k AS (SELECT min(i) AS license_id, known FROM (SELECT i, {sql("t")} AS known FROM (VALUES {values}) v(i, t) UNION ALL SELECT * FROM (VALUES {files}) f(i, known)) GROUP BY known),
        d AS (SELECT doc_id, {sql("coalesce(text, '')")} AS digest FROM documents),
        l AS (SELECT DISTINCT doc_id, {sql("line")} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
        n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM l JOIN k ON l.digest = k.known GROUP BY 1)
        SELECT d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') AS notices
        FROM d LEFT JOIN k ON d.digest = k.known LEFT JOIN n USING (doc_id)
    """
