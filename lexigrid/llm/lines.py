"""Line dedup by a segment-partition edit join.

Lines (trimmed, with a word) are equal if their hashes are, and near if both have least_chars or more code points and
their edit distance is at most radius. A line is cut into radius + 1 segments; a near partner, which is no shorter, holds
one of them whole, at one of a few places that the two lengths allow. Segments and such substrings are hashed with the
length they stand for, and lines meet where hashes agree. Distances are verified with a banded bit-parallel scan.

Small buckets give pairs. Of a large bucket (one segment shared by more than BUCKET lines) the lines are dealt into tiles
by hash, and tiles are compared pairwise; a pair of tiles returns a spanning forest of its links, never all pairs, and
lines already joined in it are not verified again. Both ways are exact: no link between different lines is lost.

Of all lines of a class the first occurrence stays, in the order of doc_id (rows without one last), then of the rows'
names (see ``numbered``), then of the lines in the text.

Defined results: null text has no line; lines without a word are never duplicates, and stay where any other line does;
every row is a document of its own, whether it repeats a doc_id or has none, so of two equal rows the later loses its
lines; a document that loses every line with a word is dropped by ``dedup_lines`` and listed by ``op6``; an empty table
gives an empty result; other columns pass through, whatever their names; very long texts are cut into lines like any
other, and a very long line meets only lines within radius of its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import connected_components, numbered, pieces, staged

RADIUS, LEAST_CHARS, BUCKET, TILE = 2, 24, 48, 128
#: Rows that a worker gathers before it sends them on: what it holds doesn't grow with a document, or with a batch.
HELD = 1 << 16
#: Slices into which the places of a line are dealt, so that a line of a third of all rows is no single task's work.
SALTS = 64
STRIP = " \t\n\v\f\r"
PROBE, INDEX = 1, 2


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a line of n characters; the last ones are the longer."""
    short, extra = divmod(n, parts)
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - extra)
        out.append((at, size))
        at += size
    return out


def layout(n: int, radius: int, least: int) -> list[tuple[int, int, int, int]]:
    """(seed, start, length, role) of every substring of a line of n characters that is hashed."""
    found: dict[tuple[int, int, int], int] = {}
    for other in range(max(least, n - radius), n + 1):
        shift = n - other
        for k, (at, size) in enumerate(segments(other, radius + 1)):
            low = max(at - k, at + shift - (radius - k), 0)
            high = min(at + k, at + shift + (radius - k), n - size)
            for start in range(low, high + 1):
                found[other * (radius + 1) + k, start, size] = PROBE
    for k, (at, size) in enumerate(segments(n, radius + 1)):
        found[n * (radius + 1) + k, at, size] = PROBE | INDEX
    return [(*key, role) for key, role in found.items()]


def _key_batches(radius: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, known, seen, keys, lines = xxhash.xxh64_intdigest, {}, set(), [], []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, lines)], ["key", "line"])
            keys.clear()
            lines.clear()
            return out

        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                for found in re.finditer(r"[^\n]+", text or ""):
                    line = found[0].strip(STRIP)
                    n = len(line)
                    if n < least:
                        continue
                    own = digest(line.encode(), 42)
                    if own in seen:  # spares most repeats; those that remain meet later
                        continue
                    seen.add(own)
                    for seed, at, size, role in known.get(n) or known.setdefault(n, layout(n, radius, least)):
                        keys.append(digest(line[at : at + size].encode(), seed) & ~3 | role)
                        lines.append(own)
                    if len(keys) >= HELD:
                        yield sent()
                    if len(seen) > 200_000:
                        seen.clear()
                    if len(known) > 5_000:
                        known.clear()
        if keys:
            yield sent()

    return run


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: pairs of small buckets (key null), and the rows of large ones (key set)."""

    def emit(key: np.ndarray, line: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.diff(key >> 2, prepend=~(key[:1] >> 2)))
        size = np.diff(new, append=len(key))
        a, b, hot = [], [], []
        for at, n in zip(new[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            own, role = line[at : at + n], key[at : at + n] & 3
            first = np.unique(own, return_index=True)[1]
            if len(first) < 2 or not (role & INDEX).any():
                continue
            if n > BUCKET:
                hot.append(np.arange(at, at + n)[np.sort(first)])
                continue
            for x in np.unique(own[(role & INDEX) > 0]).tolist():
                for y in np.unique(own).tolist():
                    if x != y:
                        a.append(min(x, y))
                        b.append(max(x, y))
        if a:
            pair = np.unique(np.array([a, b], np.int64), axis=1)
            yield pa.RecordBatch.from_arrays([pa.nulls(pair.shape[1], pa.int64()), pa.array(pair[0]), pa.array(pair[1])], ["key", "a", "b"])
        if hot:
            rows = np.concatenate(hot)
            yield pa.RecordBatch.from_arrays([pa.array(key[rows] >> 2), pa.array(line[rows]), pa.nulls(len(rows), pa.int64())], ["key", "a", "b"])

    held_key, held_line, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        key, line = (np.concatenate([held, c.to_numpy(zero_copy_only=False)]) for held, c in zip((held_key, held_line), batch.columns, strict=True))
        if large is not None:  # the rest of a bucket of which a part has gone out as large
            part = (key >> 2) == large
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[part] >> 2), pa.array(line[part]), pa.nulls(int(part.sum()), pa.int64())], ["key", "a", "b"])
                key, line = key[~part], line[~part]
        held_key, held_line = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(key):
            continue
        last = int(np.searchsorted(key >> 2, key[-1] >> 2))
        if len(key) - last > 4096:  # a large bucket isn't held until it ends
            large, tail = key[-1] >> 2, slice(last, None)
            yield pa.RecordBatch.from_arrays([pa.array(key[tail] >> 2), pa.array(line[tail]), pa.nulls(len(key) - last, pa.int64())], ["key", "a", "b"])
        else:
            held_key, held_line = key[last:], line[last:]
        yield from emit(key[:last], line[:last])
    yield from emit(held_key, held_line)


def within(a: str, b: str, radius: int) -> bool:
    """Whether the edit distance of a and b is at most radius: a bit-parallel scan of the band beside the diagonal.

    Bit d of a state of e edits stands for the places of b reached from the present place of a, shifted by d - radius.
    """
    if abs(len(a) - len(b)) > radius:
        return False
    at = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        at += 1
    a, b = a[at:], b[at:]
    while a and b and a[-1] == b[-1]:
        cut = 1
        while cut * 2 <= min(len(a), len(b)) and a[-cut * 2 :] == b[-cut * 2 :]:
            cut *= 2
        a, b = a[:-cut], b[:-cut]
    if not a or not b:
        return len(a) + len(b) <= radius
    width = 2 * radius + 1
    full = (1 << width) - 1
    # state[e]: places b[i + d - radius] reachable after i characters of a with e edits
    state = [0] * (radius + 1)
    state[0] = 1 << radius
    for e in range(1, radius + 1):
        state[e] = (state[e - 1] | state[e - 1] << 1) & full
    for i, x in enumerate(a):
        match = 0
        for d in range(width):
            j = i + d - radius
            if 0 <= j < len(b) and b[j] == x:
                match |= 1 << d
        before = state
        state = [before[0] & match]
        for e in range(1, radius + 1):
            # a match or a substitution stays on its diagonal; a deletion from a moves down one, an insertion up one
            now = (before[e] & match) | before[e - 1] | before[e - 1] >> 1
            state.append((now | state[e - 1] << 1) & full)
        if not any(state):
            return False
    d = len(b) - len(a) + radius
    return 0 <= d < width and any(s >> d & 1 for s in state)


def _verify_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([within(x, y, radius) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def _profile(texts: list[str]) -> np.ndarray:
    """Counts of characters by 32 classes: one edit moves a profile by 2 at most."""
    out = np.zeros((len(texts), 32), np.int32)
    for k, t in enumerate(texts):
        out[k] = np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 31, minlength=32)
    return out


def _tile_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u.clear()
            v.clear()
            return out

        for batch in pieces(batches, rows=1):  # a pair of tiles
            for row in batch.to_pylist():
                a, b = row["a"], row["b"]
                lines, texts = [x["line"] for x in a + b], [x["text"] for x in a + b]
                sums, root = _profile(texts), list(range(len(lines)))

                def find(x: int, root: list[int] = root) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for i in range(len(a)):
                    near = np.flatnonzero(np.abs(sums[len(a) :] - sums[i]).sum(axis=1) <= 2 * radius) + len(a)
                    for j in near.tolist():
                        if lines[i] != lines[j] and find(i) != find(j) and within(texts[i], texts[j], radius):
                            root[find(j)] = find(i)
                            u.append(lines[i])
                            v.append(lines[j])
            if len(u) >= HELD:
                yield sent()
        if u:
            yield sent()

    return run


def occurrences(rows: DataFrame) -> DataFrame:
    """(n, doc_id, at, line, text) of each line of rows (n, doc_id, text); line is the hash of the trimmed text, null if it has no word."""
    each = rows.select("n", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    trimmed = each.withColumn("text", F.btrim("text", F.lit(STRIP)))
    return trimmed.withColumn("line", F.when(F.col("text") != "", F.xxhash64("text")))


def near_lines(rows: DataFrame, radius: int = RADIUS, least: int = LEAST_CHARS) -> DataFrame:
    """Links (u, v) that connect all near lines of rows, by hash."""
    keys = rows.select("text").mapInArrow(_key_batches(radius, least), "key long, line long")
    dealt = keys.repartition(F.shiftright("key", 2)).sortWithinPartitions("key")
    met = staged(dealt.mapInArrow(_bucket_batches, "key long, a long, b long"), "met")
    pairs = met.where("key is null").select("a", "b").distinct()
    hot = met.where("key is not null").select("key", F.col("a").alias("line")).distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("line")).union(hot.select("line")).distinct()
    # Repeats of a line go map-side, before any text moves.
    texts = occurrences(rows).select("line", "text").where(F.length("text") >= least).groupBy("line").agg(F.min("text").alias("text"))
    texts = staged(texts.join(wanted, "line", "left_semi"), "line-texts")
    left, right = texts.select(F.col("line").alias("a"), F.col("text").alias("x")), texts.select(F.col("line").alias("b"), F.col("text").alias("y"))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify_batches(radius), "u long, v long")
    if not hot.isEmpty():
        parts = hot.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
        tiles = hot.join(parts, "key").join(texts, "line").groupBy("key", F.expr("cast(pmod(xxhash64(line), parts) as int)").alias("part"))
        tiles = staged(tiles.agg(F.collect_list(F.struct("line", "text")).alias("lines")), "line-tiles")  # about TILE lines
        one, two = tiles.select("key", F.col("part").alias("p"), F.col("lines").alias("a")), tiles.select("key", F.col("part").alias("q"), F.col("lines").alias("b"))
        both = one.join(two, "key").where("p <= q").select("a", "b")
        links = links.union(both.mapInArrow(_tile_batches(radius), "u long, v long"))
    return links


def marked_lines(rows: DataFrame, radius: int = RADIUS, least: int = LEAST_CHARS) -> DataFrame:
    """(n, doc_id, at, line, duplicate, near) of each line of rows (n, doc_id, text): near marks duplicates of a line that differs.

    The first place of a class comes from sums by line and slice; it goes back to the slices, then to the places, so no
    join gathers the places of a common line.
    """
    classes = connected_components(near_lines(rows, radius, least), "lines").withColumnRenamed("node", "line")
    places = staged(occurrences(rows).select("n", "doc_id", "at", "line"), "places")
    worded = places.where("line is not null").withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "at")
    sliced = worded.groupBy("line", "salt").agg(F.min(order).alias("place"), F.count("*").alias("c"))
    lined = sliced.groupBy("line").agg(F.min("place").alias("place"), F.sum("c").alias("c")).join(classes, "line", "left")
    lined = lined.withColumn("class", F.coalesce("component", "line"))
    first = lined.groupBy("class").agg(F.min(F.struct("place", "line")).alias("first"), F.sum("c").alias("all"))
    # Lines of which there is one, and none near, have no duplicate: they needn't meet their places again.
    several = lined.join(first.where("all > 1"), "class").select("line", F.col("first.place").alias("first"), (F.col("line") != F.col("first.line")).alias("near"))
    several = staged(sliced.select("line", "salt").join(several, "line"), "several")
    marked = worded.join(several, ["line", "salt"], "left").select(
        "n", "doc_id", "at", "line", F.coalesce(order > F.col("first"), F.lit(False)).alias("duplicate"), F.coalesce("near", F.lit(False)).alias("near")
    )
    return marked.union(places.where("line is null").select("n", "doc_id", "at", "line", F.lit(False), F.lit(False)))


def duplicate_lines(docs: DataFrame, radius: int = RADIUS, least: int = LEAST_CHARS) -> DataFrame:
    """marked_lines of docs."""
    return marked_lines(docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", "text"), radius, least)


def dedup_lines(docs: DataFrame, radius: int = RADIUS, least: int = LEAST_CHARS) -> DataFrame:
    """Rows of docs without the later occurrences of lines; n_chars, if there, is counted anew."""
    rows = numbered(docs, "line-rows")
    flags = marked_lines(rows.select("n", "row.doc_id", "row.text"), radius, least).groupBy("n").agg(
        F.max("duplicate").alias("any"),
        F.max(F.col("line").isNotNull() & ~F.col("duplicate")).alias("left"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "duplicate"))), lambda x: x["duplicate"]).alias("flags"),  # one row's lines
    )
    held = rows.join(flags.where("any").select("n", "left", "flags"), "n", "left").where("coalesce(left, true)")
    text = F.expr("case when flags is null then row.text else array_join(filter(split(row.text, '\\n'), (x, i) -> not get(flags, i)), '\\n') end")
    held = held.select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0))}
    return held.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each document with a line: its lines, those that are duplicates, and of these those that only are near."""
    marked = duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return marked.groupBy("n").agg(
        F.first("doc_id").alias("doc_id"),
        F.count("line").alias("n_lines"),
        F.count_if("duplicate").alias("n_duplicates"),
        F.count_if(F.col("duplicate") & F.col("near")).alias("n_near"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("duplicate"), F.col("at")))), ",").alias("duplicates"),
    ).drop("n")
