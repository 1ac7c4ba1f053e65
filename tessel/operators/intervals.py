"""Intervals: 1-based and inclusive; overlap and neighbour joins that are cut by chromosome and bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", first: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """Least start and greatest end of each group; ``first`` = {new: column} takes the value of the first row by ``order``."""
    more = [F.min_by(c, order).alias(n) for n, c in (first or {}).items()]
    return rows.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end), *more)


def grouped_segments(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", strand: str | None = None) -> DataFrame:
    """Segments of each group as an array sorted by place; the strand of the first."""
    seg = F.struct(F.col(start).alias("start"), F.col(end).alias("end"))
    more = [F.min_by(strand, F.struct(start, end)).alias(strand)] if strand else []
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(seg)).alias("segments"), *more)


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(left: DataFrame, right: DataFrame, key: str, start: str = "start", end: str = "end", width: int = 10_000) -> DataFrame:
    """Pairs of rows of one key whose intervals overlap; columns get the prefixes ``l_`` and ``r_``, and ``overlap``.

    Both sides are dealt by (key, bin), so a long chromosome is spread over many tasks.  A pair is emitted in the bin in
    which the later of the two starts, so no duplicates have to be removed.
    """
    a = left.select([F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("__bin", F.explode(_bins(F.col(f"l_{start}"), F.col(f"l_{end}"), width)))
    b = right.select([F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("__bin", F.explode(_bins(F.col(f"r_{start}"), F.col(f"r_{end}"), width)))
    later = F.greatest(f"l_{start}", f"r_{start}")
    sooner = F.least(f"l_{end}", f"r_{end}")
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (a["__bin"] == b["__bin"]) & (later <= sooner) & (a["__bin"] == F.floor(later / width))
    return a.join(b, on).drop("__bin").withColumn("overlap", sooner - later + 1)


def self_overlaps(rows: DataFrame, key: str, row_id: str, start: str = "start", end: str = "end", width: int = 10_000) -> DataFrame:
    """Unordered pairs (id_1 < id_2) of overlapping rows and the size of the overlap, summed over their segments."""
    pairs = overlap_join(rows, rows, key, start, end, width).where(F.col(f"l_{row_id}") < F.col(f"r_{row_id}"))
    return pairs.groupBy(F.col(f"l_{row_id}").alias("id_1"), F.col(f"r_{row_id}").alias("id_2")).agg(F.sum("overlap").alias("intersection_size"))


def segments_overlap(a: Column, b: Column) -> Column:
    """Bases that two arrays of segments share."""
    return F.aggregate(
        F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.greatest(F.lit(0).cast("long"), F.least(x["end"], y["end"]).cast("long") - F.greatest(x["start"], y["start"]).cast("long") + 1)))),
        F.lit(0).cast("long"),
        lambda s, v: s + v,
    )


def neighbours(rows: DataFrame, key: str, row_id: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each row's nearest end before its start and nearest start after its end, on the same key.

    The greatest end below a start is not simply that of the row before, so both are taken from a line of events:
    a running maximum of ends, and a running minimum of starts from the other side.  Keys are sorted, not paired.
    """
    ends = rows.select(F.col(key), F.col(end).alias("at"), F.lit(0).alias("kind"), F.col(end).alias("edge"), F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id))
    starts = rows.select(F.col(key), F.col(start).alias("at"), F.lit(0).alias("kind"), F.col(start).alias("edge"), F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id))
    ask_before = rows.select(F.col(key), F.col(start).alias("at"), F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("edge"), F.col(row_id))
    ask_after = rows.select(F.col(key), F.col(end).alias("at"), F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("edge"), F.col(row_id))
    up = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(key).orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ends.unionByName(ask_before).withColumn("upstream_end", F.max("edge").over(up)).where("kind = -1").select(row_id, "upstream_end")
    after = starts.unionByName(ask_after).withColumn("downstream_start", F.min("edge").over(down)).where("kind = -1").select(row_id, "downstream_start")
    return before.join(after, row_id)


def trim_to_neighbours(rows: DataFrame, key: str, row_id: str, flank: int, start: str = "start", end: str = "end") -> DataFrame:
    """Windows with ``flank`` on both sides, cut short at the nearest neighbours; a window that would vanish stays whole."""
    near = neighbours(rows, key, row_id, start, end)
    low, high = F.greatest(F.lit(1).cast("long"), F.col(start) - flank), F.col(end) + flank
    out = rows.join(near, row_id).withColumns({"__low": F.greatest(low, F.coalesce(F.col("upstream_end") + 1, low)), "__high": F.least(high, F.coalesce(F.col("downstream_start") - 1, high))})
    fine = F.col("__low") <= F.col("__high")
    return out.select(row_id, key, F.when(fine, F.col("__low")).otherwise(low).alias("window_start"), F.when(fine, F.col("__high")).otherwise(high).alias("window_end"))


def offset_segments(anchor: Column, strand: Column, low: int, high: int, length: Column) -> Column:
    """Segments at offsets ``low`` to ``high`` from the anchor along the strand, without offset 0, within [1, length]."""
    if low > high:
        raise ValueError("the window's start is after its end")
    parts = [(a, b) for a, b in ((low, min(high, -1)), (max(low, 1), high)) if a <= b]

    def one(a: int, b: int) -> Column:
        s = F.when(strand == "-", anchor - b).otherwise(anchor + a)
        e = F.when(strand == "-", anchor - a).otherwise(anchor + b)
        return F.struct(F.greatest(s, F.lit(1)).cast("long").alias("start"), F.least(e, length).cast("long").alias("end"))

    found = F.array(*[one(a, b) for a, b in parts])
    return F.array_sort(F.filter(found, lambda x: x["start"] <= x["end"]))


def total_length(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"] + 1)


def centre_trim(segments: Column, most: int) -> Column:
    """At most ``most`` bases from the middle: half of what is too much, rounded down, goes on the left."""
    excess = F.greatest(total_length(segments) - most, F.lit(0).cast("long"))
    left = F.floor(excess / 2)

    def cut(segs: Column, n: Column, from_left: bool) -> Column:
        order = segs if from_left else F.reverse(segs)
        empty = F.slice(segs, 1, 0)

        def step(a: Column, x: Column) -> Column:
            size = x["end"] - x["start"] + 1
            rest = F.struct((x["start"] + a["left"]).alias("start"), x["end"].alias("end")) if from_left else F.struct(x["start"].alias("start"), (x["end"] - a["left"]).alias("end"))
            return F.struct(
                F.greatest(a["left"] - size, F.lit(0).cast("long")).alias("left"),
                F.when(size > a["left"], F.concat(a["kept"], F.array(rest))).otherwise(a["kept"]).alias("kept"),
            )

        out = F.aggregate(order, F.struct(n.cast("long").alias("left"), empty.alias("kept")), step, lambda a: a["kept"])
        return out if from_left else F.reverse(out)

    return cut(cut(segments, left, True), excess - left, False)


def segment_sequence(contig: Column, segments: Column) -> Column:
    """Letters of the segments on the forward strand, joined."""
    return F.array_join(F.transform(segments, lambda x: F.substring(contig, x["start"].cast("int"), (x["end"] - x["start"] + 1).cast("int"))), "")


def tss_window(tss: Column, width: int, length: Column) -> Column:
    """0-based half-open window of even width around a 1-based start site; null where it leaves the chromosome."""
    if width % 2:
        raise ValueError("an even width is wanted")
    s = tss - 1 - width // 2
    return F.when((s >= 0) & (s + width <= length), F.struct(s.cast("long").alias("start"), (s + width).cast("long").alias("end")))


def flank_window(start: Column, end: Column, strand: Column, length: Column, flank: int = 10_000, largest: int = 130_000, body: int = 120_000) -> Column:
    """A gene with ``flank`` on both sides, within its chromosome; of very long genes only the first ``body`` bases."""
    long = end - start + 1 > largest
    s = F.when(long & (strand == "-"), end - body + 1).otherwise(start)
    e = F.when(long & (strand != "-"), start + body - 1).otherwise(end)
    return F.struct(F.greatest(F.lit(1), s - flank).cast("long").alias("start"), F.least(length, e + flank).cast("long").alias("end"))


def merge_intervals(rows: DataFrame, key: str, start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Intervals of a key joined where the next starts at most ``gap`` after the greatest end so far."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.coalesce(F.col(start) > F.max(end).over(before) + gap, F.lit(True)).cast("int")
    grouped = rows.select(key, start, end).withColumn("__new", new).withColumn("__group", F.sum("__new").over(upto))
    return grouped.groupBy(key, "__group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__group")


def free_intervals(occupied: DataFrame, lengths: DataFrame, key: str, length: str = "length", start: str = "start", end: str = "end") -> DataFrame:
    """The gaps of [1, length] that merged intervals leave; whole chromosomes where nothing is occupied."""
    merged = merge_intervals(occupied, key, start, end)
    order = Window.partitionBy(key).orderBy(start)
    inner = merged.select(key, (F.coalesce(F.lag(end).over(order), F.lit(0).cast("long")) + 1).alias(start), (F.col(start) - 1).alias(end))
    last = lengths.join(merged.groupBy(key).agg(F.max(end).alias("__last")), key, "left").select(key, (F.coalesce("__last", F.lit(0).cast("long")) + 1).alias(start), F.col(length).cast("long").alias(end))
    return inner.unionByName(last).where(F.col(start) <= F.col(end))
