"""Line dedup: drop lines that many documents share.

Lines are exploded once, as (document, position, hash of the normalised line), and written to a checkpoint.  From it distinct
documents are counted for each hash, and the hashes over the threshold are joined back to the exploded rows: what goes
back to a document are the positions of the lines it loses, and its text is reassembled by position from the others.
All of it is built-in expressions; the shuffles carry 12-byte hashes, not lines.  Counting is by (hash, document)
first and by hash then, both with map-side sums, so a line in every document is no hot task; the way back is an
inner join that adaptive execution splits where a line is hot.  Positions are taken out as a set, so the work on a text
grows with its lines, however many of them go.

Cases: null or empty text is one empty line and stays (null stays null).  A null document id counts as one
document that comes before all others.  Rows that repeat an id are one document for the counts and are treated alike.  Columns
of the input stay as they are, but those named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, persist

#: Fixed by the contract: white space stripped from both ends of a line.
STRIP = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(line: Column) -> Column:
    """White space off both ends; lines without any there, as most are, aren't walked through."""
    ends = reduce(or_, [test(x) for x in STRIP for test in (line.startswith, line.endswith)])
    return F.when(ends, F.btrim(line, F.lit(STRIP))).otherwise(line)


def lowered(line: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    ascii_only = F.octet_length(line) == F.char_length(line)  # there, lower() does just that, and is many times faster
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """_id, _text (hash of the text: rows may repeat an id), _pos and 96 bits (_a, _c) of each line's key of at least `least` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the text's hash is computed below the explode, not for each line
    each = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.split(text, "\n", -1).alias("_lines"))
    each = each.select("_id", "_text", F.posexplode("_lines").alias("_pos", "_line"))
    each = each.filter(F.octet_length("_line") >= least)  # no more code points than bytes
    # step by step, so that each is computed once
    each = each.select("_id", "_text", "_pos", trimmed(F.col("_line")).alias("_line"))
    each = each.select("_id", "_text", "_pos", F.char_length("_line").alias("_n"), lowered(F.col("_line")).alias("_line"))
    each = each.select("_id", "_text", "_pos", "_n", F.xxhash64("_line").alias("_a"), F.hash("_line").alias("_c"))
    return persist(each).filter(F.col("_n") >= least).drop("_n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`docs` with its text less the repeated lines, and n_lines, n_dropped.

    A line is dropped if its key has at least `min_chars` code points and occurs in at least `min_docs` distinct
    documents, of which this isn't the one with the largest id.
    """
    keys = line_keys(docs, id_col, text_col, min_chars)
    shared = (
        keys.groupBy("_a", "_c", "_id").agg(F.lit(1).alias("_one"))
        .groupBy("_a", "_c").agg(F.count("*").alias("_n"), F.max("_id").alias("_last"))
        .filter(F.col("_n") >= min_docs)
    )
    drops = (
        dealt_anew(keys, "_a").join(dealt_anew(shared, "_a"), ["_a", "_c"])
        .filter(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy("_id", "_text").agg(F.collect_set("_pos").alias("_drop"))
    )
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_key"), F.xxhash64(whole).alias("_hash"))
    joined = rows.join(drops, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left")
    text = F.col("_row")[text_col]
    known = F.coalesce(text, F.lit(""))
    # _lines is used twice below: so it stays a step of its own, and isn't split again for each position
    joined = joined.select("_row", "_drop", F.when(F.col("_drop").isNotNull(), F.split(known, "\n", -1)).alias("_lines"))
    n = F.when(F.col("_drop").isNull(), F.octet_length(known) - F.octet_length(F.replace(known, F.lit("\n"))) + 1).otherwise(F.size("_lines"))
    joined = joined.select("_row", "_drop", "_lines", n.alias("_n"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_drop"))
    made = {
        text_col: F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")),
        "n_lines": F.col("_n").cast("long"),
        "n_dropped": F.coalesce(F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")), F.lit(0)).cast("long"),
    }
    names = [c for c in docs.columns if c not in made] + list(made)
    return joined.select(*[made[c].alias(c) if c in made else F.col("_row")[c].alias(c) for c in names])


def line_digest(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = """
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM base),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND k.doc_id <> s.last) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
