"""Line deduplication: runs of lines that occur earlier in the corpus are deleted, by a suffix array over line ids.

All documents, in the order of their keys, are one sequence of line ids. The suffix array is built by distributed prefix
doubling: the rank of a suffix by its first 2k lines is the rank of the pair (its rank by k lines, that of the suffix k lines on).
Ranks come from a range-partitioned sort of the distinct pairs, so that a frequent line is one row there, not many. A suffix leaves
as soon as no other shares its prefix; ranks of what is left keep the order of the suffix array.

The suffixes whose longest common prefix with each other is m lines or more are an interval of the suffix array: neighbours in it, since
they sort by those m lines first. Two suffixes lie in one interval of at least m exactly if they have equal blocks of k lines at their start
and at their line m - k, for the k = 2^j with k <= m < 2k: the two blocks overlap and cover the m lines. So (m, rank of the first
block, rank of the last) names each interval by ranks of one doubling level, without a pass over neighbours that one task would make.
The earliest suffix of an interval stays; the same lines of the others are later copies.

A run counts if it has `min_words` words, so the intervals asked for are those of the shortest runs that reach it, from each line on
and back from each line: their length depends on the run's own lines only, so equal runs ask for the same interval, and together they
cover every line of every longer run, up to the maximal ones. Doubling ends once blocks are as long as the longest of these.
Overlapping copies unite to maximal repeated runs, which are cut out of the texts.

DataFrame functions only. Rows are lines that repeat; nothing but the lengths that occur comes to the driver. Each level is a plan of its own, whose
result is stored, so that plans stay small however many levels there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, stored, unused

#: What tells documents apart: key and digest of the text. Rows equal in both are one document.
DOCUMENT = ("key", "digest")
#: Up to so many documents with runs (4 MB of hashes) are broadcast, so that only their texts are shuffled; with more, all are.
BROADCAST_ROWS = 500_000
#: A word is a run of characters other than the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _ranked(distinct: DataFrame, *by: str) -> DataFrame:
    """Adds `rank`: increasing in the order of `by`, from a range-partitioned sort; stored, since it depends on where the ranges are cut."""
    placed = distinct.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(placed.withColumn("rank", F.monotonically_increasing_id()), "lines-ranks")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(key, digest, pos, words, rank) of the lines that occur more than once, from (key, digest, text)."""
    lines = docs.select(*DOCUMENT, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select(*DOCUMENT, "pos", _digest(F.col("line")).alias("line"), F.regexp_count("line", F.lit(WORD)).alias("words"))
    frequent = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    found = lines.join(_ranked(frequent, "line"), "line").select(*DOCUMENT, "pos", "words", "rank")
    return found.repartition(*DOCUMENT).dropDuplicates([*DOCUMENT, "pos"])


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Adds `stretch`, which tells maximal sequences of neighbouring repeated lines apart, and the words `before` the line in it; too short ones go."""
    document = Window.partitionBy(*DOCUMENT)
    with_stretch = lines.withColumn("stretch", F.col("pos") - F.row_number().over(document.orderBy("pos")))
    within = Window.partitionBy(*DOCUMENT, "stretch")
    total = F.sum("words").over(within)
    before = F.sum("words").over(within.orderBy("pos")) - F.col("words")
    return with_stretch.withColumn("before", before).withColumn("total", total).where(F.col("total") >= min_words).drop("total")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(key, digest, start, length): from each line on, and back from each line, the fewest lines with min_words words within a stretch.

    Boundaries between lines are points at the number of words before them. One sort merges points with the places asked
    for: each takes the next point from there, forwards or backwards.
    """
    end, after = F.col("pos") + 1, F.col("before") + F.col("words")
    marks = F.array(
        F.struct(F.lit(True).alias("point"), F.col("before").alias("at"), F.col("pos").alias("pos"), F.lit("").alias("way")),
        F.struct(F.lit(True).alias("point"), after.alias("at"), end.alias("pos"), F.lit("").alias("way")),
        F.struct(F.lit(False).alias("point"), (F.col("before") + min_words).alias("at"), F.col("pos").alias("pos"), F.lit("on").alias("way")),
        F.struct(F.lit(False).alias("point"), (after - min_words).alias("at"), end.alias("pos"), F.lit("back").alias("way")),
    )
    stretch = [*DOCUMENT, "stretch"]
    rows = lines.select(*stretch, F.explode(marks).alias("m")).select(*stretch, "m.*")
    point = F.last(F.when(F.col("point"), F.col("pos")), ignorenulls=True)
    so_far = lambda *order: Window.partitionBy(*stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("next", point.over(so_far(F.desc("at"), F.desc("point"), F.desc("pos"))))
    rows = rows.withColumn("previous", point.over(so_far(F.asc("at"), F.desc("point"), F.asc("pos"))))
    start = F.when(F.col("way") == "on", F.col("pos")).otherwise(F.col("previous"))
    stop = F.when(F.col("way") == "on", F.col("next")).otherwise(F.col("pos"))
    runs = rows.where("not point").select(*DOCUMENT, start.alias("start"), (stop - start).alias("length"))
    return runs.where("length > 0").distinct()


def reached(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, digest, reach, pos, rank) of the lines, with the length of the longest run that their document asks for."""
    of = [f"_{c}" for c in DOCUMENT]
    reach = runs.groupBy(*[F.col(c).alias(o) for c, o in zip(DOCUMENT, of, strict=True)]).agg(F.max("length").alias("reach"))
    return lines.join(reach, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))).select(*DOCUMENT, "reach", "pos", "rank")


def doubled(blocks: DataFrame, k: int) -> DataFrame:
    """Ranks by 2k lines from ranks by k lines; suffixes whose 2k lines occur once leave, and documents that ask for no run of 2k lines (`reach`).

    Equal runs are asked for by all documents that have them, so none of a run's copies leaves before the others.
    """
    order = Window.partitionBy(*DOCUMENT).orderBy("pos")
    pairs = blocks.where(F.col("reach") >= 2 * k).withColumn("second", F.lead("rank", k).over(order)).withColumn("at", F.lead("pos", k).over(order)).where(F.col("at") == F.col("pos") + k)
    pairs = pairs.select(*DOCUMENT, "reach", "pos", F.col("rank").alias("first"), "second")
    shared = pairs.groupBy("first", "second").agg(F.count("*").alias("n")).where("n > 1").select("first", "second")
    return stored(pairs.join(_ranked(shared, "first", "second"), ["first", "second"]).select(*DOCUMENT, "reach", "pos", "rank"), "lines-blocks")


def intervals(runs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Runs of k to 2k - 1 lines with the ranks `head` and `tail` of the blocks that cover them: equal ones are one interval of the suffix array.

    A run without a repeated block at either end occurs once and is left out.
    """
    ends = F.array(F.struct("start", F.lit(True).alias("first")), F.struct((F.col("start") + F.col("length") - k).alias("start"), F.lit(False).alias("first")))
    asked = runs.where(F.col("length").between(k, 2 * k - 1)).select(*DOCUMENT, "start", "length", F.explode(ends).alias("end"))
    asked = asked.select(*DOCUMENT, F.col("start").alias("from"), "length", F.col("end.start").alias("pos"), F.col("end.first").alias("first"))
    placed = blocks.select(*[F.col(c).alias(f"_{c}") for c in DOCUMENT], F.col("pos").alias("_pos"), "rank")
    here = F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")) & (F.col("pos") == F.col("_pos"))
    rank_of = lambda first: F.max(F.when(F.col("first") == first, F.col("rank")))
    named = asked.join(placed, here).groupBy(*DOCUMENT, F.col("from").alias("start"), "length").agg(rank_of(True).alias("head"), rank_of(False).alias("tail"))
    return named.where("head is not null and tail is not null")


def later_copies(named: DataFrame) -> DataFrame:
    """(key, digest, start, length) of the members of each interval but the earliest, from intervals().

    The earliest members, one of each interval, are taken away by their places: members never meet by interval, but for partial minima.
    """
    earliest = named.groupBy("length", "head", "tail").agg(F.min(F.struct(*DOCUMENT, "start")).alias("e"))
    earliest = earliest.select(F.col("length").alias("_length"), *[F.col(f"e.{c}").alias(f"_{c}") for c in (*DOCUMENT, "start")])
    same = F.col("key").eqNullSafe(F.col("_key"))
    for c in ("digest", "start", "length"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    return named.join(earliest, same, "left_anti").select(*DOCUMENT, "start", "length")


def maximal_runs(copies: DataFrame) -> DataFrame:
    """(key, digest, runs): the union of the copied runs of each document, as sorted disjoint (start, stop)."""
    order = Window.partitionBy(*DOCUMENT).orderBy("start", "stop")
    rows = copies.select(*DOCUMENT, "start", (F.col("start") + F.col("length")).alias("stop"))
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = rows.groupBy(*DOCUMENT, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy(*DOCUMENT).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(key, digest, runs) of the documents with repeated runs: `runs` are the line ranges to delete, `digest` is the text's MD5.

    Rows are in order of key, then digest; the first occurrence of a run stays. Null and empty texts have no runs.
    """
    docs = df.select(F.col(key).alias("key"), _digest(F.col(text)).alias("digest"), F.col(text).alias("text")).where("text is not null")
    lines = stored(stretches(repeated_lines(docs), min_words), "lines-repeated")
    runs = stored(shortest_runs(lines, min_words), "lines-shortest")
    levels = {r[0] for r in runs.select(F.length(F.bin("length")) - 1).distinct().collect()}  # a few small numbers
    blocks, copies = stored(reached(lines, runs), "lines-blocks"), runs.limit(0)
    for level in range(max(levels, default=-1) + 1):
        if level:
            shorter, blocks = blocks, doubled(blocks, 1 << level - 1)
            release(shorter)
        if level in levels:
            named = stored(intervals(runs, blocks, 1 << level), "lines-intervals")
            copies = copies.unionByName(stored(later_copies(named), "lines-copies"))
            release(named)
    release(lines, runs, blocks)
    return stored(maximal_runs(copies.distinct()), "lines-runs")


def _kept(text: Column, runs: Column) -> Column:
    """The lines of a text outside the sorted disjoint runs."""

    def between(lines):
        def part(j):
            start = F.when(j == 0, 0).otherwise(F.get(runs, j - 1)["stop"])
            stop = F.when(j == F.size(runs), F.size(lines)).otherwise(F.get(runs, j)["start"])
            return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), part)), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n", -1)), between), F.lit(0))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, deleted: str = "deleted_lines") -> DataFrame:
    """The rows with later copies of repeated line runs deleted from `text`, and the number of deleted lines.

    A line goes if it lies in a run of at least `min_words` words that also occurs earlier: in a row of a smaller key (null
    smallest), in one of the same key and a smaller digest, or further up in the text. Lines are equal only if all their characters are. Rows equal in key and
    text are one document: none is a copy of the other, and all are treated alike. Null texts stay null and empty ones
    empty, with 0 deleted lines; a text that loses all its lines becomes empty. All rows and columns are kept; a column called like
    `deleted` is replaced.
    """
    own_key, own_digest, runs, own = unused(df, "_key", "_digest", "_runs", "_document")
    found = find_runs(df, key, text, min_words).toDF(own_key, own_digest, runs)
    rows = df.drop(deleted)
    untouched = None
    if found.count() <= BROADCAST_ROWS:
        marked, documents = rows.withColumn(own, F.xxhash64(key, _digest(F.col(text)))), F.broadcast(found.select(F.xxhash64(own_key, own_digest).alias(own)))
        untouched = marked.join(documents, own, "left_anti").drop(own).withColumn(deleted, F.lit(0))
        rows = marked.join(documents, own, "left_semi").drop(own)
    joined = rows.join(found, F.col(key).eqNullSafe(F.col(own_key)) & (_digest(F.col(text)) == F.col(own_digest)), "left")
    count = F.coalesce(F.aggregate(runs, F.lit(0), lambda n, r: n + r["stop"] - r["start"]), F.lit(0))
    cut = F.when(F.col(runs).isNull(), F.col(text)).otherwise(_kept(F.col(text), F.col(runs)))
    touched = joined.withColumns({text: cut, deleted: count}).drop(own_key, own_digest, runs)
    return touched if untouched is None else touched.unionByName(untouched)
