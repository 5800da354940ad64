"""Line dedup: a suffix array over line ids by distributed prefix doubling.

The corpus is one sequence of lines per document. A suffix starts at a line and ends with its document. Doubling gives,
for k = 0, 1, 2 ..., the class of suffixes that agree on their first 2**k lines, named by its smallest position; classes
nest, so sorting suffixes by their class names at all levels is a suffix array in which each class is one interval
(the order of lines is that of first appearance). Suffixes in classes of one are settled and leave, so later rounds
carry only what still repeats. Descending again from the longest level, the classes of equal prefixes of every length
are the longest-common-prefix intervals of the array; they give each suffix the length of its longest copy at an earlier
position. Runs of at least ``min_words`` words that have an earlier copy are deleted.

All steps are joins and minima by key. A line that a third of the corpus has is one key of a minimum, which is
pre-aggregated, and one side of a join on a table with one row a key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, drop_table, fresh, persist_table, with_row_id

#: A repeated run counts from so many words.
MIN_WORDS = 50


def line_table(docs: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """One row per line that is not blank.

    Columns: _row, pos (a unique long that ascends with id, row and line, null ids first), seq (1, 2, ... in its text),
    line and nxt (indices in the text of this line and the next that is not blank), h1, h2 (128 bits of hash), words, upto
    (words so far in the text).
    """
    lines = docs.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"), F.split(text_col, "\n").alias("_all"))
    lines = lines.select("_row", "_id", F.size("_all").alias("_n"), F.posexplode("_all").alias("line", "s")).filter(F.col("s").rlike(r"\S"))
    spaced = F.col("s")
    for c in "\t\r\x0b\f":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = F.size(F.array_remove(F.split(spaced, " "), ""))
    narrow = lines.select("_row", "_id", "_n", "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), words.alias("words"))
    narrow = persist_table(narrow)
    w = Window.partitionBy("_id", "_row").orderBy("line")
    placed = narrow.repartitionByRange("_id", "_row").select(
        "_row",
        F.row_number().over(w).alias("seq"),
        "line",
        F.coalesce(F.lead("line").over(w), F.col("_n")).alias("nxt"),
        "h1",
        "h2",
        "words",
        F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    out = persist_table(placed.withColumn("pos", F.monotonically_increasing_id()))
    drop_table(narrow)
    return out


def _named(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members whose class under keys has another member: _row, seq, pos, rank, the smallest pos of the class."""
    names = members.groupBy(*keys).agg(F.min("pos").alias("_first"), F.count("*").alias("_many")).filter("_many > 1")
    return members.join(names, keys).select("_row", "seq", "pos", F.col("_first").alias("rank"))


def doubling(lines: DataFrame) -> list[DataFrame]:
    """Tables for k = 0, 1, ...: _row, seq, pos, rank of each suffix that shares its first 2**k lines with another."""
    levels: list[DataFrame] = []
    level = persist_table(_named(lines, ["h1", "h2"]))
    while level.take(1):
        levels.append(level)
        after = level.select("_row", (F.col("seq") - (1 << (len(levels) - 1))).alias("seq"), F.col("rank").alias("rank2"))
        level = persist_table(_named(level.join(after, ["_row", "seq"]), ["rank", "rank2"]))
    drop_table(level)
    return levels


def suffix_array(levels: list[DataFrame]) -> DataFrame:
    """The suffix array where lines repeat: _row, seq, pos, rank_0 ... rank_K, sorted so that each class is an interval.

    rank_k is the first position of the class that shares 2**k lines, null for a class of one.
    """
    out = levels[0].withColumnRenamed("rank", "rank_0")
    for k, level in enumerate(levels[1:], 1):
        out = out.join(level.select("pos", F.col("rank").alias(f"rank_{k}")), "pos", "left")
    return out.orderBy(*[f"rank_{k}" for k in range(len(levels))], "pos")


def earlier_copies(levels: list[DataFrame]) -> DataFrame:
    """_row, seq, pos, length: for each suffix that has one, the lines of its longest copy at an earlier position.

    At level k there stands one member, the first, of each class of 2**(k+1) lines, in the group of its class of 2**k
    lines. Steps t = K-1 ... 0 split each group of a level above t by the next 2**t lines. Members that are not the
    first of their part go on in it, with a longer prefix; the first of each part stays, to be compared at the old
    length, and goes along as the earlier copy of the others. A group is known by its first position, gid; each suffix
    with an earlier copy ends in one group in which it is not the first, and that group's prefix is the interval of
    the array that holds both.
    """
    cols = ["_row", "seq", "pos", "k", "length", "gid"]
    now = None
    for k, level in enumerate(levels):
        at = level
        if k + 1 < len(levels):
            longer = levels[k + 1].select("pos", F.col("rank").alias("_longer"))
            at = at.join(longer, "pos", "left").filter("_longer is null or _longer = pos")
        at = at.select("_row", "seq", "pos", F.lit(k).alias("k"), F.lit(1 << k).alias("length"), F.col("rank").alias("gid"))
        now = at if now is None else now.unionByName(at)
    now = persist_table(now)
    for t in range(len(levels) - 2, -1, -1):
        more = levels[t].select("_row", F.col("seq").alias("_at"), F.col("rank").alias("more"))
        go = now.filter(F.col("k") > t).withColumn("_at", F.col("seq") + F.col("length")).join(more, ["_row", "_at"], "left")
        part = ["k", "length", "gid", "more"]
        first = go.filter("more is not null").groupBy(*part).agg(F.min("pos").alias("first"), F.count("*").alias("_many")).filter("_many > 1").drop("_many")
        go = go.join(first, part, "left")
        stay = go.filter("first is null or first = pos").select(*cols)
        down = go.filter("first is not null").withColumn("length", F.col("length") + (1 << t)).withColumn("gid", F.col("first")).select(*cols)
        new = persist_table(now.filter(F.col("k") <= t).select(*cols).unionByName(stay).unionByName(down))
        drop_table(now)
        now = new
    return now.filter("gid <> pos").select("_row", "seq", "pos", "length")


def repeated_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame | None:
    """Lines of a line_table with a column deleted, for texts that lose a line; None where no line repeats."""
    levels = doubling(lines)
    if not levels:
        return None
    copies = earlier_copies(levels)
    ends = lines.select("_row", F.col("seq").alias("end"), F.col("upto").alias("_to"))
    runs = copies.join(lines.select("pos", "upto", "words"), "pos").withColumn("end", F.col("seq") + F.col("length") - 1).join(ends, ["_row", "end"])
    runs = persist_table(runs.filter(F.col("_to") - F.col("upto") + F.col("words") >= min_words).select("_row", "pos", "end"))
    for level in levels:
        drop_table(level)
    w = Window.partitionBy("_row").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.join(runs.select("_row").distinct(), "_row", "left_semi")
        .join(runs.select("pos", "end"), "pos", "left")
        .withColumn("deleted", F.coalesce(F.max("end").over(w) >= F.col("seq"), F.lit(False)))
        .select("_row", "line", "nxt", "deleted")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs of ``min_words`` words or more.

    Lines are what newlines separate, compared exactly; words are what ASCII whitespace separates. Blank lines belong to no run; they go with the line before them.
    Adds n_lines and n_deleted (long). A null text stays null, with no lines; an empty text stays empty. Equal rows and
    repeated ids are documents of their own; the earlier copy is the one with the smaller id, row in the table and
    line, null ids first. An empty table gives an empty table. Other columns pass through; n_lines and n_deleted of the
    input are replaced.
    """
    docs = docs.drop("n_lines", "n_deleted")
    row = fresh(docs, "_row")
    rows = with_row_id(docs, row)
    split = F.split(F.col(text_col), "\n")
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long")
    flagged = repeated_lines(line_table(rows, row, id_col, text_col), min_words)
    if flagged is None:
        return rows.drop(row).withColumns({"n_lines": n_lines, "n_deleted": F.lit(0).cast("long")})
    flags = flagged.groupBy(F.col("_row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("line", "nxt", "deleted"))).alias("_f"))
    flags = flags.select(
        row, F.expr("concat(array_repeat(false, _f[0].line), flatten(transform(_f, x -> array_repeat(x.deleted, x.nxt - x.line))))").alias("_gone")
    )
    gone = fresh(docs, "_gone_flags")
    out = rows.join(flags.withColumnRenamed("_gone", gone), row, "left")
    kept = F.filter(split, lambda x, i: ~F.get(F.col(gone), i))
    n_deleted = F.coalesce(F.size(F.filter(gone, lambda x: x)), F.lit(0))
    return out.withColumns(
        {
            "n_lines": n_lines,
            "n_deleted": F.when(F.col(gone).isNull(), 0).otherwise(n_deleted).cast("long"),
            text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
        }
    ).drop(row, gone)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, text without later copies of repeated line runs, n_lines, n_deleted."""
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
