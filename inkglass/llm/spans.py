"""Long exact spans shared between records.

A sparse de Bruijn graph: token k-mers are the edges that texts walk along; of
each few neighbouring k-mers the one of least hash stands for them, so that
every span of the given length holds at least one.  K-mers of more than one
record are kept, and paths that every text walks whole, without a branch, a
beginning or an end inside, are compacted to one piece.  All records that have
any run of a piece have all of it, so a piece is verified by its source
coordinates as one row; only runs of ``least`` characters that reach over a
piece's ends are verified one by one.  Either must stand, character for
character, in another record without a source in common.

Fixed meaning: null, empty and short texts share nothing; a null or empty
list of sources has nothing in common with any; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, keep

LEAST = 200
#: Tokens: runs of up to LONGEST letters and digits; of longer runs each character; any other character.
LONGEST = 10
#: Sets of sources up to this size are compared by counting subsets, larger ones one by one.
SUBSETS_UP_TO = 10
_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def _geometry(least: int) -> tuple[int, int]:
    """(k, w): tokens of a k-mer and k-mers of a window, so that a span holds one whatever its words are."""
    tokens = (least - 2 * LONGEST) * 2 // (LONGEST + 1)
    k = max(1, tokens * 3 // 4)
    return k, max(1, tokens - k + 1)


class _Hashes:
    """Hashes of any part of a text, from two running sums."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, text: str, bases=(_B1, _B2)):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes)
        mixed = (self.codes.astype(np.uint64) + np.uint64(0x2545F491)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        self.sums, self.back = [], []
        for base in bases:
            up, down = self._powers(base, n + 1)
            self.sums.append(np.concatenate(([np.uint64(0)], np.cumsum(mixed * up[:n], dtype=np.uint64))))
            self.back.append(down)

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = cls.powers.get(base)
        if got is None or len(got[0]) < n:
            size = max(4096, 2 * n)
            inverse = pow(base, -1, 1 << 64)
            got = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64))) for b in (base, inverse))
            cls.powers[base] = got
        return got

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        x = (self.sums[which][end] - self.sums[which][start]) * self.back[which][start]
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


_WORDLIKE: list[np.ndarray] = []


def _is_word(codes: np.ndarray) -> np.ndarray:
    if not _WORDLIKE:
        _WORDLIKE.append(np.array([chr(c).isalnum() for c in range(0x20000)]))
    return _WORDLIKE[0][np.minimum(codes, 0x1FFFF)]


def token_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a text."""
    n = len(codes)
    word = _is_word(codes)
    begin = np.ones(n, bool)
    begin[1:] = ~(word[1:] & word[:-1])
    starts = np.nonzero(begin)[0]
    lengths = np.diff(np.append(starts, n))
    long = np.repeat(lengths > LONGEST, lengths)
    begin |= long
    starts = np.nonzero(begin)[0]
    return starts, np.append(starts[1:], n)


def _minimal(h: _Hashes, k: int, w: int):
    """Starts and ends of tokens, hashes of k-mers, and of each window of k-mers the one of least hash."""
    starts, ends = token_bounds(h.codes)
    n = len(starts) - k + 1
    if n < 1:
        return starts, ends, None, None
    mers = h.of(starts[:n], ends[k - 1 :])
    if n < w:
        return starts, ends, mers, np.array([mers.argmin()])
    return starts, ends, mers, np.lib.stride_tricks.sliding_window_view(mers, w).argmin(1) + np.arange(n - w + 1)


def _anchors(least: int):
    k, w = _geometry(least)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(5)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts, ends, mers, least_of = _minimal(_Hashes(text, (_B1,)), k, w)
                if mers is None:
                    continue
                pick = np.unique(least_of)
                for column, x in zip(out, (np.full(len(pick), i), np.arange(len(pick)), starts[pick], ends[pick + k - 1], mers[pick].view(np.int64))):
                    column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds)], ["id", "nth", "at", "upto", "mer"])

    return go


def pieces(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, piece, at, last, upto) of each piece of repeated k-mers, per record:
    the starts of its first and last one, and its end; ``texts`` has id (long) and text."""
    mers = keep(texts.where(F.length("text") >= least).select("id", "text").mapInArrow(_anchors(least), "id long, nth int, at int, upto int, mer long"))
    repeated = mers.groupBy("mer").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("mer")
    walked = mers.join(repeated, "mer", "left_semi").distinct()
    along = Window.partitionBy("id").orderBy("nth")
    # the step into each k-mer and out of it, with its length; 0 where a text's walk begins or ends
    step = lambda here, of: F.when(of("nth").over(along) == here, F.xxhash64(of("mer").over(along), F.abs(of("at").over(along) - F.col("at")))).otherwise(F.lit(0).cast("long"))
    steps = cut(walked.withColumns({"into": step(F.col("nth") - 1, F.lag), "out": step(F.col("nth") + 1, F.lead)}))
    one_way = lambda c: (F.min(c) == F.max(c)) & (F.max(c) != 0)
    nodes = steps.groupBy("mer").agg(one_way("into").alias("one_in"), one_way("out").alias("one_out"))
    marked = steps.join(nodes, "mer")
    joined = F.col("one_in") & F.coalesce(F.lag("one_out").over(along), F.lit(False))
    path = marked.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("piece", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return path.groupBy("id", "piece").agg(F.min("at").alias("at"), F.max("at").alias("last"), F.max("upto").alias("upto"))


def _runs(least: int):
    """Pieces of at least ``least`` characters, and the runs of ``least`` characters
    outside them that may be shared: all k-mers that stand for their windows
    inside the run are repeated.  Any shared run is one of them, because its
    inside, but for the words at its ends, has the same k-mers standing for it
    wherever it stands."""
    k, w = _geometry(least)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(5)]
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in range(3))):
                h = _Hashes(text)
                n = len(h.codes) - least + 1
                starts, ends, mers, least_of = _minimal(h, k, w)
                if mers is None or n < 1:
                    continue
                again, inside, long = np.zeros(len(starts), bool), np.zeros(n + 1, np.int64), []
                for s in spans:
                    again[(starts >= s["at"]) & (starts <= s["last"])] = True
                    if s["upto"] - s["at"] >= least:
                        inside[s["at"]] += 1
                        inside[s["upto"] - least + 1] -= 1
                        long.append((s["at"], s["upto"]))
                wide = min(w, len(mers))
                first, upto = starts[: len(least_of)], ends[k + wide - 2 : k + wide - 2 + len(least_of)]
                good = again[least_of]
                count = np.zeros((2, n + 1), np.int64)
                lo, hi = np.maximum(upto - least, 0), np.minimum(first, n - 1)
                ok = good & (lo <= hi)
                np.add.at(count[0], lo[ok], 1)
                np.add.at(count[0], hi[ok] + 1, -1)
                lo, hi = np.maximum(upto - least + LONGEST, 0), np.minimum(first - LONGEST, n - 1)
                bad = ~good & (lo <= hi)
                np.add.at(count[1], lo[bad], 1)
                np.add.at(count[1], hi[bad] + 1, -1)
                have = np.cumsum(count, axis=1)[:, :-1]
                at = np.nonzero((have[0] > 0) & (have[1] == 0) & (np.cumsum(inside)[:-1] == 0))[0]
                end = at + least
                if long:
                    at, end = (np.concatenate((x, y)) for x, y in zip((at, end), np.array(long, np.int64).T))
                for column, x in zip(out, (np.full(len(at), i), at, end, h.of(at, end).view(np.int64), h.of(at, end, 1).view(np.int64))):
                    column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds)], ["id", "at", "upto", "h1", "h2"])

    return go


def _subsets(c: Column) -> Column:
    """All subsets of an array but the empty one: a hash of each, and the sign it counts with."""
    empty = F.array(F.array().cast("array<bigint>"))
    every = F.aggregate(c, empty, lambda acc, x: F.concat(acc, F.transform(acc, lambda a: F.concat(a, F.array(x)))))
    return F.transform(F.filter(every, lambda a: F.size(a) > 0), lambda a: F.struct(F.when(F.size(a) % 2 == 1, 1).otherwise(-1).alias("sign"), F.xxhash64(a).alias("subset")))


def shared_stretches(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, start_at, end_at) of the longest stretches of each record covered by
    shared spans; ``records`` has id (long), text and sources (array of strings).
    """
    # sources are compared by 64-bit hashes of their names
    coded = F.array_sort(F.array_distinct(F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.xxhash64(s))))
    rows = records.select("id", "text", coded.alias("sources"))
    spans = pieces(rows, least).groupBy("id").agg(F.collect_list(F.struct("at", "last", "upto")).alias("spans"))
    spans = cut(spans)
    one = rows.join(spans, "id").dropDuplicates(["id"])
    where = one.select("id", "text", "spans").mapInArrow(_runs(least), "id long, at int, upto int, h1 long, h2 long")
    sets = rows.join(spans, "id", "left_semi").dropDuplicates(["id"]).select("id", "sources", F.when(F.size("sources") == 0, F.xxhash64(F.lit("none"), F.col("id"))).otherwise(F.xxhash64("sources")).alias("set_key"))
    runs = cut(where.join(sets, "id"))
    witness = F.struct("set_key", "id", "sources")
    groups = runs.groupBy("h1", "h2").agg(F.min(witness).alias("a"), F.max(witness).alias("b"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("first", "last")
    apart = lambda w: (F.col(f"{w}.id") != F.col("id")) & ~F.arrays_overlap(F.col(f"{w}.sources"), F.col("sources"))
    judged = runs.join(groups, ["h1", "h2"]).withColumn("sure", F.coalesce(apart("a") | apart("b"), F.lit(False)))
    sure = judged.where("sure").select("id", "at", "upto")
    # neither the first nor the last set of sources is apart: look at all of them
    open_rows = judged.where(~F.col("sure") & (F.col("a.set_key") != F.col("b.set_key"))).select("h1", "h2", "id", "at", "upto", "set_key", "sources")
    open_rows = cut(open_rows)
    asked = open_rows.select("h1", "h2", "set_key", "sources").distinct()
    all_sets = runs.select("h1", "h2", "set_key", "sources").join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").distinct()
    small = F.size("sources") <= SUBSETS_UP_TO
    counted = all_sets.where(small).select("h1", "h2", F.explode(_subsets(F.col("sources"))).alias("s")).groupBy("h1", "h2", "s.subset").count()
    total = all_sets.groupBy("h1", "h2").agg(F.count("*").alias("sets"), F.max(F.when(~small, 1).otherwise(0)).alias("large"))
    meets = asked.where(small).select("h1", "h2", "set_key", F.explode(_subsets(F.col("sources"))).alias("s")).select("h1", "h2", "set_key", "s.sign", "s.subset")
    meeting = meets.join(counted, ["h1", "h2", "subset"], "left").groupBy("h1", "h2", "set_key").agg(F.sum(F.col("sign") * F.coalesce("count", F.lit(0))).alias("meeting"))
    by_count = meeting.join(total.where("large = 0"), ["h1", "h2"]).where("meeting < sets").select("h1", "h2", "set_key")
    others = all_sets.select("h1", "h2", F.col("sources").alias("other"))
    rest = asked.join(total.where("large = 1").select("h1", "h2"), ["h1", "h2"], "left_semi").alias("x")
    one_by_one = rest.join(others.alias("y"), (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")) & ~F.arrays_overlap("sources", "other"), "left_semi").select("h1", "h2", "set_key")
    late = open_rows.join(by_count.unionByName(one_by_one), ["h1", "h2", "set_key"], "left_semi").select("id", "at", "upto")
    along = Window.partitionBy("id").orderBy("at", "upto").rowsBetween(Window.unboundedPreceding, -1)
    good = sure.unionByName(late).distinct().withColumn("new", F.when(F.col("at") > F.max("upto").over(along), 1).otherwise(0))
    stretch = good.withColumn("stretch", F.sum("new").over(Window.partitionBy("id").orderBy("at", "upto").rowsBetween(Window.unboundedPreceding, 0)))
    return stretch.groupBy("id", "stretch").agg(F.min("at").alias("start_at"), F.max("upto").alias("end_at")).drop("stretch")


def shared_share(records: DataFrame, stretches: DataFrame) -> DataFrame:
    """(id, n_chars, shared_chars, share) of every record with a text."""
    per = stretches.groupBy("id").agg(F.sum(F.col("end_at") - F.col("start_at")).cast("long").alias("shared_chars"))
    sizes = records.where("text <> ''").select("id", F.length("text").cast("long").alias("n_chars")).groupBy("id").agg(F.max("n_chars").alias("n_chars"))
    out = sizes.join(per, "id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return out.withColumn("share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))
