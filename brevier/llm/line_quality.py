"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Lines are normalised and hashed with their host, 128 bits a line; each document (id) counts once for each of its
lines. A line is boilerplate for a host if more than max_documents of the host's documents hold it, however many
documents the host has. Boilerplate is removed, and a document that loses more than max_removed of its words is
depleted. The documents are read once: statistics and line hashes are written to a table from which the rest
follows. Counts are pre-aggregated before the shuffle; only lines of over max_documents rows are joined back, and
those, hot by their nature, are dealt over SALTS keys each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevier.llm.common import WORD_BREAK_JAVA, cut


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK_JAVA), lambda w: w != "")


#: Keys over which the rows of one frequent line are dealt.
SALTS = 16


def lines_of(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalised_line(line: Column) -> Column:
    """Lower case, runs of digits as 0, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), WORD_BREAK_JAVA, " "))


def base_statistics(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    n_repeat_words counts the words that lie in a window of `window` words found twice or more in the text.
    Windows are compared by hash. Most texts repeat none, which the number of distinct hashes tells; for the
    others hashes are sorted with their places, and each place that has an equal neighbour adds its words up
    to the next such place.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn("__words", words_of(F.col(text_col))).withColumn("__lines", lines_of(F.col(text_col)))
    hashed = split.withColumn("__each", F.transform("__words", lambda w: F.xxhash64(w))).withColumn(
        "__hashes",
        F.expr(
            f"""if(size(__each) >= {window},
                   transform(sequence(1, size(__each) - {window - 1}), i -> xxhash64(slice(__each, i, {window}))),
                   cast(array() as array<bigint>))"""
        ),
    )
    placed = hashed.withColumn(
        "__placed",
        F.expr(
            """if(size(array_distinct(__hashes)) < size(__hashes),
                  sort_array(transform(__hashes, (h, i) -> struct(h, i))),
                  cast(array() as array<struct<h: bigint, i: int>>))"""
        ),
    )
    repeated = F.expr(
        f"""aggregate(
              sort_array(transform(
                filter(__placed, (x, k) -> (k > 0 and get(__placed, k - 1).h = x.h)
                                           or (k < size(__placed) - 1 and get(__placed, k + 1).h = x.h)),
                x -> x.i)),
              named_struct('total', 0L, 'last', {-window}),
              (a, i) -> named_struct('total', a.total + least({window}, i - a.last), 'last', i),
              a -> a.total)"""
    )
    return placed.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )


def line_keys(text: Column, host: Column) -> Column:
    """(a, b, n) for each line with a word: 128 bits of host and normalised line, and its number of words."""
    normal = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normalised_line), lambda x: x != "")
    return F.transform(
        normal,
        lambda x: F.struct(F.xxhash64(host, x).alias("a"), F.xxhash64(F.lit("line"), x, host).alias("b"), F.size(F.split(x, " ")).alias("n")),
    )


def removed_words(rows: DataFrame, max_documents: int) -> DataFrame:
    """(row, removed): the words in lines that more than max_documents documents hold. rows: (row, id, lines)."""
    line = ["a", "b"]
    held = rows.select("row", "id", F.explode("lines").alias("line")).select("row", "id", "line.*")
    # Rows are at least documents: few lines are left whose documents have to be told apart.
    likely = held.groupBy(*line).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > max_documents).select(*line)
    salted = likely.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = cut(held.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, [*line, "salt"]).select("row", "id", *line, "n"))
    frequent = (
        found.groupBy(*line, "id").agg(F.lit(1).alias("one"))
        .groupBy(*line).agg(F.count("*").alias("n_documents")).where(F.col("n_documents") > max_documents)
        .select(*line, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    return (
        found.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        .join(frequent, [*line, "salt"])
        .groupBy("row")
        .agg(F.sum("n").alias("removed"))
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeated: int = 30,
    max_documents: int = 20,
    max_removed: float = 0.5,
) -> DataFrame:
    """One row for each row of docs: id, base statistics, n_removed_words, base_failed, kept.

    base_failed: fewer than min_words words, or more than max_repeated percent of them in repeated 8-word
    windows. kept: neither base_failed nor depleted. A null text has no words; a null host is a host like any
    other; a null id stays null. Rows are judged one by one, but rows with one id, and all those with a null id, count
    as one document that holds a line. The limit does not loosen with the host: a line in 21 documents of a host with
    a third of all rows goes as one in 21 documents of a small host does.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")
    )
    base = cut(base_statistics(rows.withColumn("lines", line_keys(F.col("text"), F.col("host")))).drop("text", "host"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    gone = F.coalesce("removed", F.lit(0).cast("long"))
    return (
        base.drop("lines")
        .join(removed_words(base.select("row", "id", "lines"), max_documents), "row", "left")
        .select(
            "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            gone.alias("n_removed_words"), failed.alias("base_failed"),
            (~failed & (gone <= max_removed * F.col("n_words"))).alias("kept"),
        )
    )
