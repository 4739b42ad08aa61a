"""Exact copies: groups, the copy that is kept, and what the others waste.

A cascade from cheap to dear: only sizes that occur twice are fingerprinted,
only fingerprints that occur twice are hashed in full.  Groups are made by
aggregation with partial results, never by collecting a group, so a third of
all rows may be copies of one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .pages import alike

QUICK = 64 * 1024
SQUARE = 4000


def fingerprint(content: Column, size: Column) -> Column:
    """Digest of the first and last 64 KB and the size of a binary; all of it up to 128 KB."""
    head = F.substring(content, 1, QUICK)
    rest = F.substring(content, F.greatest(F.lit(QUICK), F.length(content) - QUICK) + 1, F.lit(QUICK))
    return F.sha2(F.concat(F.coalesce(head, F.lit(b"")), F.when(F.length(content) > QUICK, rest).otherwise(F.lit(b"")), F.encode(size.cast("string"), "UTF-8")), 256)


def file_hashes(files: DataFrame, key: str = "path", content: str = "content", size: str = "size") -> DataFrame:
    """(key, size, hash) of files that may have copies; ``content`` is read only for those."""
    sizes = files.where(F.col(size) > 0).groupBy(F.col(size).alias("size")).count().where("count > 1").select("size")
    quick = files.join(sizes, files[size] == sizes["size"], "left_semi").select(F.col(key).alias("key"), F.col(size).alias("size"), F.col(content).alias("content")).withColumn("quick", fingerprint(F.col("content"), F.col("size")))
    again = quick.groupBy("quick").count().where("count > 1").select("quick")
    return quick.join(again, "quick", "left_semi").select(F.col("key").alias(key), "size", F.when(F.col("size") <= 2 * QUICK, F.col("quick")).otherwise(F.sha2("content", 256)).alias("hash"))


def groups(rows: DataFrame, key: Column, digest: Column, weight: Column, order: Column) -> DataFrame:
    """(hash, copies, kept, wasted): ``order`` says which copy is kept (the least).

    Null digests are no copies of anything; empty texts are.
    """
    one = rows.select(key.alias("key"), digest.alias("hash"), weight.alias("weight"), order.alias("ord")).where("hash is not null")
    agg = one.groupBy("hash").agg(F.count("*").alias("copies"), F.min(F.struct("ord", "key", "weight")).alias("k"), F.sum("weight").alias("all"))
    return agg.where("copies > 1").select("hash", "copies", F.col("k.key").alias("kept"), (F.col("all") - F.col("k.weight")).alias("wasted"))


def extras(rows: DataFrame, key: Column, digest: Column, weight: Column, order: Column) -> DataFrame:
    """(extra, kept) of every copy that is not kept."""
    kept = groups(rows, key, digest, weight, order)
    each = rows.select(key.alias("extra"), digest.alias("hash"))
    return each.join(kept, "hash").where("extra <> kept").select("extra", "kept")


def keeper_order(name: Column, modified: Column, path: Column, organized: Column, reviewed: Column) -> Column:
    """Organized copies first (those in review last among them); else clear names,
    names without a copy suffix, old files, shallow paths."""
    from ..functions.names import is_meaningful, strip_copy_suffix

    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    zero = F.lit(0)
    return F.struct(
        (~organized).cast("int").alias("a"), F.when(organized, reviewed.cast("int")).otherwise(zero).alias("b"),
        F.when(organized, zero).otherwise((~is_meaningful(name)).cast("int")).alias("c"), F.when(organized, zero).otherwise((strip_copy_suffix(name) != name).cast("int")).alias("d"),
        F.when(~organized, modified).alias("e"), F.when(organized, zero).otherwise(depth).alias("f"), path.alias("g"),
    )


def near_pairs(rows: DataFrame, least: float = 0.92, length: float = 0.2) -> DataFrame:
    """(kept, other, dice) of texts that are equal or alike; ``rows`` has id and norm.

    Equal texts come first: each is paired with the least id of its group, and
    that one stands for the group in the pairs of different texts, so that large
    groups make as many rows as they have members.  Different texts are found
    exactly: bags of together n pairs of characters that are alike by ``least``
    differ in at most (1 - least) * n, so of more parts than that, into which
    all kinds of pairs are dealt, one at least is the same in both.  Long texts
    of one language have parts in common without being alike; they are compared
    by sketches instead, see :func:`_near_long`.
    """
    whole = cut(rows.where("norm <> ''").groupBy("norm").agg(F.min("id").alias("kept")))
    equal = rows.join(whole.hint("merge"), "norm").where("id <> kept").select("kept", F.col("id").alias("other"), F.lit(1.0).alias("dice"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in zip(batch.column(0), batch.column(1).to_pylist()):
                keys, sign = _keys(s, least)
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * n, i.type), pa.array([len(s)] * n, pa.int32()), pa.array([sign] * n, pa.int64()), pa.array([m for m, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int64())], ["kept", "size", "sign", "parts", "part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dice = [alike(a, b, least) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dice, pa.float64())], ["kept", "other", "dice"])

    kind = rows.schema["id"].dataType.simpleString()
    keys = cut(whole.where((F.length("norm") >= 2) & (_band(F.length("norm"), least) <= _long(least))).select("kept", "norm").mapInArrow(blocks, f"kept {kind}, size int, sign long, parts int, part long"))
    total = F.col("size") + F.col("n") - 2
    near = F.abs(F.col("size") - F.col("n")) <= F.greatest("size", "n") * length
    other = keys.withColumnsRenamed({"kept": "other", "size": "n", "sign": "sign_2"})
    # a pair of characters that only one of them has changes one bit at most
    near &= F.bit_count(F.col("sign").bitwiseXOR(F.col("sign_2"))) <= total * (1 - least) + 1e-6
    met = keys.join(other.hint("merge"), ["parts", "part"]).where((F.col("kept") < F.col("other")) & near & (F.greatest("size", "n") - 1 <= total * (1 - least / 2) + 1e-6)).select("kept", "other")
    met = cut(met.unionByName(_near_long(whole, least, length)).distinct())
    texts = met.join(whole.select("kept", F.col("norm").alias("a")).hint("merge"), "kept").join(whole.select(F.col("kept").alias("other"), F.col("norm").alias("b")).hint("merge"), "other").select("kept", "other", "a", "b")
    alike_ones = texts.mapInArrow(compare, f"kept {kind}, other {kind}, dice double").where(F.col("dice") >= least)
    return equal.unionByName(alike_ones)


def _band(length: Column, least: float) -> Column:
    """Bands of lengths such that texts alike by ``least`` are of one band or of neighbouring ones."""
    return F.floor(F.log(F.greatest(length - 1, F.lit(1)).cast("double")) / F.log(F.lit(1.001 * (2 - least) / least)))


def _long(least: float) -> int:
    """The band from which texts are compared by sketches: where 64 bits cannot tell them apart any more."""
    return int(log(90) / log(1.001 * (2 - least) / least))


@lru_cache(maxsize=1 << 16)
def _place(g: str, n: int) -> int:
    """64 bits for the n-th pair of characters of a kind."""
    return crc32(f"{g}{n}".encode(errors="surrogatepass")) * 0x9E3779B97F4A7C15 & (1 << 64) - 1


def _near_long(whole: DataFrame, least: float, length: float) -> DataFrame:
    """(kept, other) of long texts that can be alike: all pairs of neighbouring bands by sketches.

    A sketch has about as many bits as its text has pairs of characters, each
    the parity of some kinds of them, so a kind that only one text has changes
    one bit at most.  Texts of a band are dealt to squares of some thousand by
    some thousand, which are compared as whole arrays.
    """
    of_band = _band(F.length("norm"), least)
    rows = whole.where((F.length("norm") >= 2) & (of_band >= _long(least))).select("kept", "norm", of_band.cast("int").alias("band"))
    counts = {r["band"]: r["n"] for r in rows.groupBy("band").agg(F.count("*").alias("n")).collect()}  # as many as the logarithm of the longest text
    squares = {b: 1 + (counts.get(b, 0) + counts.get(b + 1, 0)) // SQUARE for b in {*counts, *(b - 1 for b in counts)}}
    kind = whole.schema["kept"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s, band in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen: Counter = Counter()
                places = []
                for k in range(len(s) - 1):
                    g = s[k : k + 2]
                    places.append(_place(g, seen[g]))
                    seen[g] += 1
                squared, groups, one, two, upper, sketches = [], [], [], [], [], []
                for low in (band, band - 1):
                    bits = max(6, int((low + 1) * log(1.001 * (2 - least) / least) / log(2)) + 1)
                    sketch = 0
                    for h in places:
                        sketch ^= 1 << (h >> 64 - bits)
                    n = squares[low]
                    mine = crc32(repr(i.as_py()).encode()) % n
                    squared += [mine] * n
                    for other in range(n):
                        groups.append(low)
                        one.append(min(mine, other))
                        two.append(max(mine, other))
                        upper.append(low < band)
                        sketches.append(sketch.to_bytes(1 << bits - 3, "little"))
                m = len(groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()] * m, i.type), pa.array([len(s)] * m, pa.int32()), pa.array(squared, pa.int32()), pa.array(groups, pa.int32()), pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(upper, pa.bool_()), pa.array(sketches, pa.binary())],
                    ["kept", "size", "mine", "band", "one", "two", "upper", "sketch"],
                )

    def compare(t: pa.Table) -> pa.Table:
        one, two, mine = t["one"][0].as_py(), t["two"][0].as_py(), t["mine"].to_numpy()
        ids, sizes, upper = t["kept"].combine_chunks(), t["size"].to_numpy().astype(np.int64), t["upper"].to_numpy()
        bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
        left, right = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
        left = left[np.argsort(sizes[left], kind="stable")]
        right = right[np.argsort(sizes[right], kind="stable")]
        found = []
        step = max(1, 4_000_000 // max(1, len(right) * bits.shape[1]))
        for at in range(0, len(left), step):
            a = left[at : at + step]
            # right ones of sizes that can do, by the sizes of these
            lo, hi = np.searchsorted(sizes[right], [(sizes[a[0]] - 1) * least / (2 - least), (sizes[a[-1]] - 1) * (2 - least) / least + 3])
            b = right[max(0, lo - 1) : hi]
            n, m = sizes[a][:, None], sizes[b][None, :]
            ok = np.abs(n - m) <= np.maximum(n, m) * length
            ok &= np.maximum(n, m) - 1 <= (n + m - 2) * (1 - least / 2) + 1e-6
            ok &= ~(upper[a][:, None] & upper[b][None, :])
            changed = np.zeros(ok.shape, np.int64)
            for w in range(bits.shape[1]):
                changed += np.bitwise_count(bits[a, w][:, None] ^ bits[b, w][None, :])
            ok &= changed <= (n + m - 2) * (1 - least) + 1e-6
            x, y = np.nonzero(ok)
            found.append((a[x], b[y]))
        x, y = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pa.table({"kept": ids.take(pa.array(x)), "other": ids.take(pa.array(y))})

    dealt = rows.repartition(F.col("kept")).mapInArrow(deal, f"kept {kind}, size int, mine int, band int, one int, two int, upper boolean, sketch binary")
    return dealt.groupBy("band", "one", "two").applyInArrow(compare, f"kept {kind}, other {kind}").where("kept <> other").select(F.least("kept", "other").alias("kept"), F.greatest("kept", "other").alias("other"))


def _ladder(n: int) -> int:
    """The numbers of parts in use: a few for each size, so that long texts have few keys."""
    m = 1
    while m < n:
        m = max(m + 1, m * 9 // 8)
    return m


def _keys(s: str, least: float) -> tuple[list[tuple[int, int]], int]:
    """(number of parts, key of one part) for all numbers of parts that a text alike to this one can share,
    and a sign of 64 bits, each the parity of some of its pairs of characters."""
    size, seen, kinds, out, sign = len(s) - 1, Counter(), [], [], 0
    for i in range(size):
        g = s[i : i + 2]
        kinds.append(int.from_bytes(blake2b(f"{g}{seen[g]}".encode(), digest_size=7).digest()))  # the second of a kind is another than the first
        sign ^= 1 << kinds[-1] // 1_000_003 % 64
        seen[g] += 1
    first, last = (_ladder(int((1 - least) * (size + n) + 1e-6) + 1) for n in (int(size * least / (2 - least)), int(size * (2 - least) / least) + 1))
    m = first
    while m <= last:
        parts: dict[int, list[int]] = {k: [] for k in range(m)}
        for h in kinds:
            parts[h % m].append(h)
        for k, part in parts.items():
            out.append((m, int.from_bytes(blake2b(repr((k, sorted(part))).encode(), digest_size=8).digest(), signed=True)))
        m = max(m + 1, m * 9 // 8)
    return out, sign - (1 << 64) if sign >> 63 else sign
