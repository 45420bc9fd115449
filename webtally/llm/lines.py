"""Line deduplication by a suffix array over line ids, in DataFrame operations only.

Every distinct text is a sequence of line ids. Only lines that occur at least twice can be part of a repeated run, so the
sequences fall into stretches of such lines. Prefix doubling ranks the suffixes of all stretches by their first 1, 2, 4,
... lines: the rank of a suffix is the number of suffixes that sort before it, so equal ranks are an interval of the
suffix array whose members share that many lines. A run counts from ``min_words`` words on, so it is made of windows that
reach that many words, with at most ``min_words`` lines each; doubling stops at that length. Suffixes that share a
window's first n lines, the interval of longest common prefix n, are those with equal ranks at the largest power of two
up to n, both at the window's start and so that a second step ends with the window. In each interval all windows but the
first are later copies. The windows anchored at a start and those anchored at an end together cover every maximal run of
at least ``min_words`` words, and nothing else.

Ranks are counts below a key, summed in two levels, so no task sees all suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from webtally.llm.common import stored, table

MIN_WORDS = 50
#: Intervals of a key over which counts below it are summed in two levels.
BINS = 1024


def _words(line: Column) -> Column:
    """Pieces between white space, tabs and carriage returns included; a line without any is blank."""
    return F.regexp_count(line, F.lit(r"\S+"))


def _below(df: DataFrame, within: list[str], order: str, bin_of: Column, name: str) -> DataFrame:
    """``df`` (distinct ``within`` and ``order``, with a count ``n``) and ``name``: the sum of n of rows of the same
    ``within`` that have a smaller ``order``. Bins must rise with the order."""
    df = df.withColumn("_bin", bin_of)
    inside = Window.partitionBy(*within, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*within).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = df.groupBy(*within, "_bin").agg(F.sum("n").alias("_n"))
    bins = bins.select(*within, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return df.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bins, [*within, "_bin"]).withColumn(
        name, F.col("_before") + F.col("_inside")).drop("_bin", "_before", "_inside")


def repeated_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Windows that are later copies, as (tid, a, b): numbers of a text's first and last line in it. ``lines``: tid, place
    (among lines that aren't blank), number (among all), line (id), words (1 at least), first (what orders texts)."""
    counts = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")
    # Rank of single lines: by id, in bins of its first ten bits.
    top = F.conv(F.hex(F.substring("line", 1, 2)), 16, 10).cast("int")
    ranked = _below(counts.withColumn("one", F.lit(1)), ["one"], "line", F.shiftright(top, 6), "r0").select("line", "r0")
    kept = lines.join(ranked, "line").drop("line")
    by_place = Window.partitionBy("tid").orderBy("place")
    kept = kept.withColumn("stretch", F.col("place") - F.row_number().over(by_place))
    ranks = stored(kept, "ranks")
    levels = 1
    while 2 ** levels <= min_words:
        ranks = stored(_doubled(ranks, levels), "ranks")
        levels += 1
    ahead = Window.partitionBy("tid", "stretch").orderBy("place").rowsBetween(0, min_words - 1)
    behind = Window.partitionBy("tid", "stretch").orderBy("place").rowsBetween(-min_words + 1, 0)

    def reach(words: Column) -> Column:
        """How many of the words counts reach ``min_words``; null if all don't."""
        end = F.aggregate(
            words, F.struct(F.lit(0).alias("n"), F.lit(0).alias("s")),
            lambda a, x: F.when(a["s"] >= min_words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"))))
        return F.when(end["s"] >= min_words, end["n"])

    sized = ranks.select(
        "tid", "place", "first", reach(F.collect_list("words").over(ahead)).alias("start_size"),
        reach(F.reverse(F.collect_list("words").over(behind))).alias("end_size"))
    windows = sized.select("tid", "first", F.explode(F.array(
        F.struct(F.col("place").alias("at"), F.col("start_size").alias("size")),
        F.struct((F.col("place") - F.col("end_size") + 1).alias("at"), F.col("end_size").alias("size")),
    )).alias("w")).select("tid", "first", "w.at", "w.size").where(F.col("size").isNotNull()).distinct()
    level = F.floor(F.log2(F.col("size") + 0.5)).cast("int")
    windows = windows.withColumn("level", level).withColumn("second", F.col("at") + F.col("size") - F.pow(F.lit(2), "level").cast("int"))
    places = ranks.select("tid", "place", "number", F.array(*[f"r{k}" for k in range(levels)]).alias("r"))
    windows = windows.join(places.select("tid", F.col("place").alias("at"), F.col("number").alias("a"), F.col("r").alias("start")), ["tid", "at"])
    windows = windows.join(places.select("tid", F.col("place").alias("second"), F.col("r").alias("end")), ["tid", "second"])
    windows = windows.select(
        "tid", "first", "at", "a", "size", F.get("start", F.col("level")).alias("ra"), F.get("end", F.col("level")).alias("rb"))
    place = F.struct("first", "tid", "at")
    earliest = windows.groupBy("size", "ra", "rb").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    earliest = stored(earliest, "intervals")  # so that adaptive execution can split a common interval in the join
    later = windows.join(earliest, ["size", "ra", "rb"]).where(place > F.col("earliest")).select(
        "tid", "a", (F.col("at") + F.col("size") - 1).alias("end"))
    return later.join(places.select("tid", F.col("place").alias("end"), F.col("number").alias("b")), ["tid", "end"]).select("tid", "a", "b")


def _doubled(ranks: DataFrame, level: int) -> DataFrame:
    """``ranks`` with the rank by 2^level lines. Where a stretch ends earlier, what is missing sorts first (-1)."""
    old, new, step = f"r{level - 1}", f"r{level}", 2 ** (level - 1)
    later = ranks.select("tid", "stretch", (F.col("place") - step).alias("place"), F.col(old).alias("next"))
    pairs = ranks.join(later, ["tid", "stretch", "place"], "left").withColumn("next", F.coalesce("next", F.lit(-1)))
    counted = pairs.groupBy(old, "next").agg(F.count("*").alias("n"))
    width = ranks.agg((F.max("r0") / BINS + 1).cast("bigint")).first()[0] or 1
    placed = _below(counted, [old], "next", F.floor(F.col("next") / width), "_less").select(
        old, "next", (F.col(old) + F.col("_less")).alias(new))
    return pairs.join(placed, [old, "next"]).drop("next")


def dedup(documents: DataFrame, min_words: int = MIN_WORDS, column: str = "text") -> DataFrame:
    """``documents`` (doc_id, ``column``, ...) without later copies of runs of lines that have ``min_words`` words
    together; a run's first copy, by doc_id and place, stays. Added are lines_removed and lines_left (blank lines not
    counted).

    Lines are what newlines part; blank ones neither count nor break a run, and go if the lines around them all go. A copy
    of a whole text of at least ``min_words`` words loses all its lines and becomes "". Rows that repeat both doc_id and
    text are one document and stay alike; a null doc_id comes after all others. Null texts stay null, empty ones empty.
    Other columns stay; those named like the added ones are replaced; an empty table stays empty."""
    documents = documents.drop("lines_removed", "lines_left")
    parts = F.split(column, "\n")
    tid = F.unhex(F.md5(F.col(column).cast("binary")))
    first = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1))
    solid = F.filter(
        F.transform(parts, lambda x, i: F.struct(i.alias("number"), _words(x).alias("words"), F.unhex(F.md5(x.cast("binary"))).alias("line"))),
        lambda s: s["words"] > 0)
    # A text is hashed below the explosion, once and not for each of its lines.
    hashed = documents.where(F.col(column).isNotNull()).select(first.alias("first"), tid.alias("tid"), column)
    lines = hashed.select("first", "tid", F.posexplode(solid).alias("place", "s")).select("first", "tid", "place", "s.*")
    lines = stored(lines.groupBy("tid", "place", "number", "line", "words").agg(F.min("first").alias("first")), "lines")
    spans = _merged(repeated_windows(lines, min_words))
    texts = lines.groupBy("tid").agg(
        F.min("first").alias("_holder"), F.sum("words").alias("_words"), F.count("*").cast("int").alias("_solid"))
    marks = stored(texts.join(spans, "tid", "left").withColumnRenamed("tid", "_tid"), "marks")  # as above, for common texts
    marked = documents.withColumn("_tid", tid).join(marks, "_tid", "left")
    whole = F.coalesce((first > F.col("_holder")) & (F.col("_words") >= min_words), F.lit(False))
    cut = F.col("_spans").isNotNull()
    # Only texts that lose some of their lines are taken apart again.
    kept = F.when(~whole & cut, F.filter(parts, lambda x, i: ~F.exists("_spans", lambda s: i.between(s["a"], s["b"]))))
    text = F.when(whole, "").when(cut, F.array_join("_kept", "\n")).otherwise(F.col(column))
    solid_left = F.size(F.filter("_kept", lambda x: x.rlike(r"\S")))
    all_lines = F.coalesce("_solid", F.lit(0))
    left = F.when(whole, 0).when(cut, solid_left).otherwise(all_lines)
    return marked.withColumn("_kept", kept).select(
        *[text.alias(column) if c == column else F.col(c) for c in documents.columns],
        (all_lines - left).alias("lines_removed"), left.alias("lines_left"))


def _merged(windows: DataFrame) -> DataFrame:
    """The maximal runs that a text's windows cover, as an array ``_spans`` of (a, b)."""
    order = Window.partitionBy("tid").orderBy("a", "b")
    begins = F.coalesce(F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    runs = windows.distinct().withColumn("_begins", begins.cast("int"))
    runs = runs.withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("tid", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document with what is left of it."""
    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "lines_removed", "lines_left", F.md5(F.col("text").cast("binary")).alias("text_md5"), "text")


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without later copies of runs; those that lose all their lines go, with n_chars anew."""
    left = dedup(docs).where((F.col("lines_removed") == 0) | (F.col("lines_left") > 0))
    counted = F.when(F.col("lines_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", counted).select(*docs.columns)
