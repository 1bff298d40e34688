"""Lines that many documents share.

Each text is split into lines, each line normalised and hashed; distinct documents are counted for each hash, and
lines of more than ``most`` documents are dropped. Only hashes travel for the count (eight bytes a line); the texts
meet the positions that they lose by a 128-bit key of the text, and keep the rest in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import col, stored, text_key


def normalised(line: Column) -> Column:
    """Lower case, without blanks at the ends, runs of blanks as one."""
    # most lines have neither: a search of bytes is cheaper than a translation
    spaced = F.when(F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")), F.translate(line, "\t\r", "  ")).otherwise(line)
    return F.lower(F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 10) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row; text is without the lines that more than ``most`` documents have.

    Blank lines are never dropped. A document is an id (a row without id counts as a document by its text), so
    rows that repeat an id count once. A null text stays null, with 0 lines; the empty text has one (blank) line. A
    text all of whose lines go becomes empty. A text of any length is read whole, a line of any length hashed whole. An
    empty table gives no rows. Other columns are ignored, whatever their names. Ids are cast to long, what can't be is an
    error."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    k1, k2 = text_key(F.col("text"))
    lines = F.split("text", "\n", -1)
    # a line is a row before it is hashed: that stays in generated code, a function over arrays wouldn't
    each = rows.where("text IS NOT NULL").select(F.coalesce("doc_id", k1).alias("doc"), k1.alias("k1"), k2.alias("k2"), F.posexplode(lines).alias("pos", "line"))
    hashed = stored(each.select("doc", "k1", "k2", "pos", F.xxhash64(normalised(F.col("line"))).alias("h")).where(F.col("h") != F.xxhash64(F.lit(""))), "line-hashes")
    common = hashed.groupBy("h").agg(F.countDistinct("doc").alias("n")).where(F.col("n") > most).select("h")
    gone = hashed.join(common, "h").groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    keyed = rows.withColumn("k1", k1).withColumn("k2", k2)
    met = keyed.join(gone, ["k1", "k2"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return met.select("doc_id", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


SQL = """
    WITH split AS (
        SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
    ), lines AS (
        SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split WHERE text IS NOT NULL
    ), clean AS (
        SELECT doc_id, line, pos, lower(trim(regexp_replace(translate(line, chr(9) || chr(13), '  '), ' +', ' ', 'g'))) AS norm FROM lines
    ), common AS (
        SELECT norm FROM clean WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) > 10
    )
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.norm IS NULL), '') AS text,
           count(*) AS n_lines, count(common.norm) AS n_dropped
    FROM clean LEFT JOIN common USING (norm) GROUP BY doc_id
"""
