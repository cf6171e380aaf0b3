r"""Lines that several documents hold, kept in the first document alone.

A line's key is the line without `[\x20\x09-\x0D]` at both ends, A-Z lower-cased.  Keys of
at least ``least`` code points are hashed to 128 bits.  The hashes, with document and
position, are range-partitioned and sorted by document and position within; the first
row of a hash names the document that keeps its lines, and every later row of another
document is a dropped line.  That first document streams along the sorted rows, so no key is ever held.

**Hot keys.**  A key with over a quarter of a partition's rows is dealt into slices by
document, each a range of its own.  Such keys are found by frequent-item sketches, a few
dozen counters for each part of the hash space, about forty a partition in all; a key
that they miss only makes its partition larger.  The slices' first documents meet in a table
with at most ``HOT`` keys for each part of the hash space, so it is broadcast.

**Bitmaps.**  What is returned for a document is a bitmap of its lines, not its text: for every
word of 64 lines that loses some, the number of whole words kept before it and
the bits of the dropped lines.  Documents that lose no line have no row.

Everything is built-in functions.  The rows of hashes are written once to the shared folder,
as three steps read them.

Null and empty texts are one empty line.  Documents are told apart by id: rows with the same
id are one document and keep their lines against each other; those without an id are one
document, the last.  Each row of the input has its own result.  Lines of one document
alone always stay, however often it repeats them.  An empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import table
from kinfold.shared import drop_shared, write_counted, write_shared

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Counters of a sketch, the keys that it can name, and counters for each partition.
COUNTERS, HOT, PER_PARTITION = 64, 32, 40
WORD = 64


def lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _row(text: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def hashed_lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(h1, h2, doc, row, pos) of each line with a long enough key."""
    lowered = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), "\n", -1)
    each = docs.select(F.col(key).alias("doc"), _row(text).alias("row"), F.posexplode(lowered).alias("pos", "line"))
    each = each.select("doc", "row", "pos", F.btrim("line", F.lit(SPACE)).alias("line")).where(F.length("line") >= least)
    return each.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "doc", "row", "pos")


def hot_keys(rows: DataFrame, n: int, partitions: int) -> DataFrame:
    """(h1, slices): hashes with over a quarter of a partition's rows, and how many slices they need."""
    parts = max(1, PER_PARTITION * partitions // COUNTERS)
    found = rows.groupBy(F.pmod("h1", F.lit(parts)).alias("part")).agg(F.expr(f"approx_top_k(h1, {HOT}, {COUNTERS})").alias("top"))
    found = found.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h1"), F.col("t.count").alias("n"))
    share = max(1.0, n / (4 * partitions))
    return found.where(F.col("n") > share).select("h1", F.ceil(F.col("n") / share).cast("int").alias("slices"))


def dropped_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(doc, row, n_dropped, words) of each document that loses lines; see the module's text.

    words: (skip, bits) in order, ``skip`` words of kept lines before each.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, rows_path, n = write_counted(hashed_lines(docs, key, text, least), "lines")
    sliced = rows.join(F.broadcast(hot_keys(rows, n, partitions)), "h1", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("doc"), F.col("slices")))
    dealt = sliced.repartitionByRange("h1", "h2", "slice")
    order = Window.partitionBy("h1", "h2", "slice").orderBy(F.col("doc").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = dealt.withColumn("first", F.first("doc").over(order))
    later, later_path = write_shared(first.where((F.col("slices") > 1) | ~F.col("doc").eqNullSafe(F.col("first"))), "later")
    firsts = later.where("slices > 1").groupBy("h1", "h2").agg(F.min("first").alias("very_first"))
    named = later.join(F.broadcast(firsts), ["h1", "h2"], "left").withColumn("first", F.when(F.col("slices") > 1, F.col("very_first")).otherwise(F.col("first")))
    gone = named.where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "row", F.floor(F.col("pos") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, pos % {WORD})").alias("bit"))
    words = gone.groupBy("doc", "row", "word").agg(F.bit_or("bit").alias("bits"))
    maps = words.groupBy("doc", "row").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    skip = lambda x, i: F.struct((x["word"] - F.coalesce(F.get("w", i - 1)["word"], F.lit(-1)) - 1).alias("skip"), x["bits"].alias("bits"))
    out, _ = write_shared(maps.select("doc", "row", "n_dropped", F.transform("w", skip).alias("words")), "bitmaps")
    drop_shared(spark, rows_path, later_path)
    return out


def kept_text(text: str, words: str) -> Column:
    """The text without the lines that a bitmap drops; a null bitmap drops none."""
    dense = F.flatten(F.transform(words, lambda x: F.concat(F.array_repeat(F.lit(0).cast("long"), x["skip"]), F.array(x["bits"]))))
    stays = lambda d: lambda line, i: F.coalesce(F.get(d, F.floor(i / WORD).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD)), F.lit(0)) == 0
    # The words are spread out once for a text, not for each line.
    cut = F.transform(F.array(F.struct(dense.alias("d"), lines(text).alias("l"))), lambda s: F.array_join(F.filter(s["l"], stays(s["d"])), "\n"))[0]
    return F.when(F.col(words).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(cut)


def with_bitmaps(docs: DataFrame, maps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (key, text) with n_dropped and words, null where no line goes."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), _row(text).alias("r"))
    return rows.join(maps, F.col("k").eqNullSafe(F.col("doc")) & (F.col("r") == F.col("row")), "left").select(F.col("k").alias(key), F.col("t").alias(text), "n_dropped", "words")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    both = with_bitmaps(docs, dropped_bitmaps(docs))
    return both.select("doc_id", F.size(lines("text")).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept_text("text", "words"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op11_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
g AS (SELECT k.r, k.line, k.pos, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.first AS gone FROM k LEFT JOIN f ON f.key = k.key),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM s JOIN d USING (r)
""",
}
