"""Repeated runs of lines, found by prefix doubling; later copies are deleted.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.stage import in_struct, staged

#: Words from which a repeated run of lines is deleted.
LEAST_WORDS = 50
#: Bytes up to which the list of deleted runs is broadcast, so that no text is shuffled.
BROADCAST_BYTES = 16 << 20


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, th, idx, h1, h2, w`` of every line that has a word; th tells texts apart."""
    lines = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("idx", "line")
    )
    return lines.select(
        "doc_id", "th", "idx", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        F.regexp_count("line", F.lit(r"\S+")).alias("w"),
    ).filter("w > 0")


def sequence_table(lines: DataFrame, least: int) -> DataFrame:
    """The concatenated sequence: ``p`` rises by doc_id and line, without gaps in a text.

    ``n``: place in the text's sequence, ``left``: lines from here to its end. ``f_len``:
    the shortest run from here, ``b_len``: up to here, that has ``least`` words, or null.
    """
    placed = (
        lines.repartitionByRange(F.col("doc_id").asc_nulls_last(), "th")
        .dropDuplicates(["doc_id", "th", "idx"])
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "th", "idx")
        .withColumn("p", F.monotonically_increasing_id())
    )
    text = Window.partitionBy("doc_id", "th")
    placed = staged(placed, "lines")
    counted = placed.select(
        "*",
        (F.row_number().over(text.orderBy("p")) - 1).alias("n"),
        F.sum("w").over(text.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)).alias("after"),
        F.count("*").over(text).alias("size"),
        F.sum("w").over(text).alias("total"),
    ).withColumn("before", F.col("after") - F.col("w"))
    near = F.max("n").over(text.orderBy("before").rangeBetween(Window.unboundedPreceding, least - 1))
    far = F.max("n").over(text.orderBy("after").rangeBetween(Window.unboundedPreceding, -least))
    return counted.select(
        "p", "doc_id", "th", "h1", "h2", "n",
        (F.col("size") - F.col("n")).alias("left"),
        F.when(F.col("total") - F.col("before") >= least, near + 1 - F.col("n")).alias("f_len"),
        F.when(F.col("after") >= least, F.col("n") - F.coalesce(far, F.lit(-1))).alias("b_len"),
    )


def _repeated(rows: DataFrame, keys: list[str], at: str, first: str) -> DataFrame:
    """``rows`` whose keys occur more than once, with the first place they occur at.

    Counted before the shuffle and staged, so the join back is of two plain tables and a
    hot key's partition can be split.
    """
    classes = rows.groupBy(*keys).agg(F.min(at).alias(first), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    return rows.join(staged(classes, "classes"), keys)


def later_copies(seq: DataFrame, least: int) -> DataFrame:
    """``doc_id, th, n, len``: runs of ``least`` words that occur earlier in the sequence.

    Prefix doubling: the class of the run of 2^k lines at a place, named by the first place
    that has it, is the pair of two classes of 2^(k-1) lines. Places of one class are an
    interval of the suffix array with a common prefix of 2^k lines; classes of one place are
    closed and left out. The class of any run is the pair of the classes that cover it from
    either end. Every repeated run of ``least`` words is covered by its shortest runs of so
    many words, from each line on and up to each line, and these copy an earlier place too.
    """
    alive = staged(_repeated(seq, ["h1", "h2"], "p", "name").drop("h1", "h2"), "alive")
    runs = alive.select("doc_id", "th", "n", F.col("p").alias("start"), F.col("f_len").alias("len")).unionByName(
        alive.select("doc_id", "th", (F.col("n") - F.col("b_len") + 1).alias("n"), (F.col("p") - F.col("b_len") + 1).alias("start"), F.col("b_len").alias("len"))
    )
    runs = staged(runs.filter("len is not null").distinct(), "runs")
    longest = runs.agg(F.max("len")).first()[0] or 0
    alive = alive.select("p", "name", "left")
    found, step = [], 1
    while step <= longest:
        here = runs.filter(F.col("len").between(step, 2 * step - 1)).withColumn("second", F.col("start") + F.col("len") - step)
        named = here.join(alive.select(F.col("p").alias("start"), F.col("name").alias("a")), "start")
        named = named.join(alive.select(F.col("p").alias("second"), F.col("name").alias("b")), "second")
        named = staged(named.select("doc_id", "th", "n", "start", "len", "a", "b"), "named")
        found.append(_repeated(named, ["len", "a", "b"], "start", "first").filter("start > first").select("doc_id", "th", "n", "len"))
        pairs = alive.filter(F.col("left") >= 2 * step).join(alive.select((F.col("p") - step).alias("p"), F.col("name").alias("next")), "p")
        pairs = staged(pairs, "pairs")
        alive = staged(_repeated(pairs, ["name", "next"], "p", "both").select("p", F.col("both").alias("name"), "left"), "alive")
        step *= 2
    out = found[0] if found else runs.select("doc_id", "th", "n", "len").limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def maximal_runs(runs: DataFrame) -> DataFrame:
    """``doc_id, th, removed``: overlapping and touching runs of each text as one."""
    text = Window.partitionBy("doc_id", "th").orderBy("n", "end")
    runs = runs.withColumn("end", F.col("n") + F.col("len"))
    reach = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    parted = runs.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("n")).cast("int"))
    islands = parted.withColumn("island", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "th", "island").agg(F.min("n").alias("a"), F.max("end").alias("b"))
    return spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("removed"))


def line_dedup(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``.

    A run of whole lines with at least ``least`` words (stretches without white space) is
    deleted if the same lines start at an earlier place: a smaller doc_id, or further up in
    the same text; the first copy stays. Lines are compared as they are; lines without a
    word aren't compared, and go with the line with words before them. Runs may overlap.

    Adds ``n_lines``, ``n_removed`` and ``removed``, the deleted ranges of line numbers
    (from 0, end exclusive); columns of these names are replaced. Null text stays null with
    0 lines. Null doc_ids come last. Rows that repeat both doc_id and text are one text and
    get the same result; rows that repeat a doc_id with another text are texts of their own.
    An empty table gives no rows.
    """
    plain = docs.select("doc_id", "text")
    seq = staged(sequence_table(staged(line_table(plain), "hashes"), least), "sequence")
    gone = staged(maximal_runs(later_copies(seq, least)), "removed").select(
        F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), F.col("removed").alias("gone")
    )
    # broadcast by the bytes it takes: 32 a text and 16 a run
    if gone.agg(F.coalesce(F.sum(32 + 16 * F.size("gone")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    rows = in_struct(docs, [c for c in kept if c != "text"], id=docs["doc_id"], text=docs["text"], th=F.xxhash64(docs["text"]))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    lines = joined.withColumn("lines", F.split("text", "\n"))
    cut = lines.withColumn(
        "cut",
        F.expr(
            """if(gone is null, null, transform(
                 array(filter(transform(lines, (l, i) -> if(l rlike '\\\\S', i, null)), i -> i is not null)),
                 full -> transform(gone, g -> struct(full[int(g.a)] as a, coalesce(get(full, int(g.b)), size(lines)) as b))
               )[0])"""
        ),
    )
    # what lies between the deleted ranges, before the first and after the last
    left = F.expr(
        """flatten(transform(sequence(0, size(cut)), k -> slice(lines,
             if(k = 0, 0, cut[k - 1].b) + 1,
             if(k = size(cut), size(lines), cut[k].a) - if(k = 0, 0, cut[k - 1].b))))"""
    )
    none = F.array().cast("array<struct<a: int, b: int>>")
    gap = F.aggregate("cut", F.lit(0), lambda n, c: n + c["b"] - c["a"])
    shortened = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return cut.select(
        *[(shortened if c == "text" else F.col("row").getField(c)).alias(c) for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.coalesce(gap, F.lit(0)).alias("n_removed"),
        F.coalesce("cut", none).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with shortened texts; a document of which nothing with a word is left goes."""
    done = line_dedup(docs.withColumnsRenamed(own := {c: f"own {c}" for c in ("n_lines", "n_removed", "removed") if c in docs.columns}), least)
    kept = done.filter("n_removed = 0 or text rlike '\\\\S'").drop("n_lines", "n_removed", "removed")
    kept = kept.withColumnsRenamed({b: a for a, b in own.items()})
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else kept.select(*docs.columns)
