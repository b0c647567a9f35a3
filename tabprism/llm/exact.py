"""Exact duplicates (operator 13): Grace hash deduplication that compares complete texts.

1. **Inside each scan task** an open-addressing table collapses equal texts, at
   most ``table_bytes`` of distinct text at a time.  Every document becomes a
   narrow member row (row, representative, SHA-256); every distinct text of a
   table becomes one representative (text, copies, top row).  So copies are
   pre-aggregated before anything is exchanged, however many there are.
2. **Hot texts:** a content hash with more than ``merge`` representatives is merged
   in salted groups of about ``merge``, round by round, until none is left.
3. **Grace recursion:** representatives that fit ``fan_out`` tables go through one
   exchange by content hash, and each task fills an open-addressing table.  More
   than that is first written to spill files in the shared folder, one per
   hash range, and each file is taken on its own, by other hash bits.  A table
   that is full settles what it holds; records that match none of its entries
   are spilled to the next level.
4. Totals per representative go back to the members in an equi-join on the
   representative, which holds no more members than one task's table counted.

The hash only picks slots and partitions; equality is decided by comparing
complete contents.

Defined results: null texts equal the empty text; of equal texts the row with
the largest key stays, a null key is the smallest, and among rows with equal
keys the first as written (one row) stays; repeated rows get a row each; an empty
table gives no row.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprism.llm.common import materialise

#: A representative as it travels: content hash, bytes, copies, the largest key with its row, and the text.
TRAVELS = ["rep", "h", "size", "copies", "top", "top_row", "body"]


class ContentTable:
    """Open-addressing hash table of whole texts with linear probing, at most half full.

    ``find`` gives the entry of a text, or None when the text is new and the table
    already holds ``limit`` bytes; from then on it takes no new text.
    """

    def __init__(self, limit: int):
        self.limit, self.bytes, self.closed = limit, 0, False
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.bodies: list[bytes] = []

    def find(self, h: int, body: bytes) -> int | None:
        slots, hashes, mask = self.slots, self.hashes, self.mask
        at = h & mask
        while (entry := slots[at]) >= 0:
            if hashes[entry] == h and self.bodies[entry] == body:
                return entry
            at = (at + 1) & mask
        if self.closed or (hashes and self.bytes + len(body) > self.limit):
            self.closed = True
            return None
        slots[at] = len(hashes)
        hashes.append(h)
        self.bodies.append(body)
        self.bytes += len(body) + 100
        if 2 * len(hashes) > mask:
            self._grow()
        return len(hashes) - 1

    def _grow(self) -> None:
        self.mask = 4 * len(self.slots) - 1
        self.slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


class Groups(ContentTable):
    """A content table that also counts copies and keeps the top row of each entry."""

    def __init__(self, limit: int):
        super().__init__(limit)
        self.copies: list[int] = []
        self.tops: list[tuple] = []

    def add(self, h: int, body: bytes, copies: int, top, row: int) -> int | None:
        entry = self.find(h, body)
        if entry is None:
            return None
        rank = (top is not None, top or 0, -row)
        if entry == len(self.copies):
            self.copies.append(copies)
            self.tops.append(rank)
        else:
            self.copies[entry] += copies
            if rank > self.tops[entry]:
                self.tops[entry] = rank
        return entry

    def top(self, entry: int) -> tuple:
        named, key, row = self.tops[entry]
        return (key if named else None), -row


def content_hash(body: bytes) -> int:
    """64-bit content hash as a signed integer."""
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


def _first_number() -> int:
    """First number of a task's own range of row and representative numbers."""
    return TaskContext.get().partitionId() << 36


def _rows(columns: dict[str, tuple[pa.DataType, list]], size: int = 4_000_000):
    """Record batches of the columns, cut by bytes of ``body`` when it holds any."""
    bodies = columns["body"][1] if "body" in columns else []
    n = len(next(iter(columns.values()))[1])
    at = 0
    while at < n:
        end, held = at, 0
        while end < n and (end == at or held < size) and end - at < 20_000:
            held += len(bodies[end] or b"") if bodies else 0
            end += 1
        yield pa.RecordBatch.from_arrays([pa.array(v[at:end], t) for t, v in columns.values()], list(columns))
        at = end


def local_groups(docs: DataFrame, key: str, text: str, table_bytes: int) -> DataFrame:
    """Members (copies is null) and representatives (row is null) of every scan task, written once."""
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("body"))

    def run(batches):
        row = rep = _first_number()
        table = Groups(table_bytes)

        def flush():
            tops = [table.top(e) for e in range(len(table.copies))]
            n = len(tops)
            yield from _rows({
                "rep": (pa.int64(), [rep + e for e in range(n)]), "row": (pa.int64(), [None] * n),
                "key": (pa.int64(), [None] * n), "digest": (pa.string(), [None] * n),
                "h": (pa.int64(), table.hashes), "size": (pa.int64(), [len(b) for b in table.bodies]), "copies": (pa.int64(), table.copies),
                "top": (pa.int64(), [t[0] for t in tops]), "top_row": (pa.int64(), [t[1] for t in tops]),
                "body": (pa.binary(), table.bodies)})

        for batch in batches:
            keys, reps, digests = batch.column("key").to_pylist(), [], []
            first = row
            for k, scalar in zip(keys, batch.column("body")):
                body = scalar.as_py() or b""
                h = content_hash(body)
                entry = table.add(h, body, 1, k, row)
                if entry is None:
                    yield from flush()
                    rep += len(table.copies)
                    table = Groups(table_bytes)
                    entry = table.add(h, body, 1, k, row)
                reps.append(rep + entry)
                digests.append(hashlib.sha256(body).hexdigest())
                row += 1
            n = len(keys)
            none = (pa.int64(), [None] * n)
            yield from _rows({"rep": (pa.int64(), reps), "row": (pa.int64(), list(range(first, row))), "key": (pa.int64(), keys),
                              "digest": (pa.string(), digests), "h": none, "size": none, "copies": none, "top": none, "top_row": none,
                              "body": (pa.binary(), [None] * n)})
        yield from flush()

    return materialise(plain.mapInArrow(run, "rep long, row long, key long, digest string, h long, size long, copies long, "
                                             "top long, top_row long, body binary"), "local-groups")


def _tables(records: DataFrame, table_bytes: int, keep_bodies: bool = False) -> DataFrame:
    """One table per partition.

    Settled records carry ``root``, the first representative of their group, and the
    group's copies and top row; with ``keep_bodies`` the root's own record keeps the
    text.  Records that did not fit come out as they went in, ``root`` null.
    """
    def run(batches):
        table, reps, entries = Groups(table_bytes), [], []
        for batch in batches:
            over: list[int] = []
            cols = {c: batch.column(c).to_pylist() for c in TRAVELS[:-1]}
            for i, scalar in enumerate(batch.column("body")):
                entry = table.add(cols["h"][i], scalar.as_py(), cols["copies"][i], cols["top"][i], cols["top_row"][i])
                if entry is not None:
                    reps.append(cols["rep"][i])
                    entries.append(entry)
                else:
                    over.append(i)
            if over:
                left = batch.take(pa.array(over, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(over), pa.int64()), *[left.column(c) for c in TRAVELS]], ["root", *TRAVELS])
        first: dict[int, int] = {}
        for rep, entry in zip(reps, entries):
            first.setdefault(entry, rep)
        tops = [table.top(e) for e in range(len(table.copies))]
        yield from _rows({
            "root": (pa.int64(), [first[e] for e in entries]), "rep": (pa.int64(), reps),
            "h": (pa.int64(), [table.hashes[e] for e in entries]), "size": (pa.int64(), [len(table.bodies[e]) for e in entries]),
            "copies": (pa.int64(), [table.copies[e] for e in entries]),
            "top": (pa.int64(), [tops[e][0] for e in entries]), "top_row": (pa.int64(), [tops[e][1] for e in entries]),
            "body": (pa.binary(), [table.bodies[e] if keep_bodies and r == first[e] else None for r, e in zip(reps, entries)])})

    return records.select(*TRAVELS).mapInArrow(run, "root long, rep long, h long, size long, copies long, top long, top_row long, body binary")


def merge_hot(reps: DataFrame, table_bytes: int, merge: int) -> tuple[DataFrame, list[DataFrame]]:
    """Representatives with no hash held by many more than ``merge`` of them, and the (rep, root) map of each round."""
    maps: list[DataFrame] = []
    while True:
        hot = materialise(reps.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > merge), "hot-hashes")
        sums = hot.agg(F.sum(F.ceil(F.col("n") / merge)).alias("groups"), F.sum("n").alias("n")).first()
        if not sums["n"]:
            return reps, maps
        salt = F.pmod(F.xxhash64("rep", F.lit(len(maps))), F.ceil(F.col("n") / merge))
        salted = reps.join(hot, "h").repartition(min(int(sums["groups"]), 4096), F.col("h"), salt)
        merged = materialise(_tables(salted, table_bytes, keep_bodies=True), "merged")
        maps.append(merged.where(F.col("root").isNotNull()).select("rep", "root"))
        fused = merged.where(F.col("body").isNotNull()).select(*TRAVELS)
        reps = materialise(reps.join(hot, "h", "left_anti").select(*TRAVELS).unionByName(fused), "representatives")
        if 2 * fused.count() > sums["n"]:       # groups of equal texts would be halved: these are different texts of one hash
            return reps, maps


def settle(reps: DataFrame, table_bytes: int, fan_out: int, level: int = 0) -> list[DataFrame]:
    """(rep, copies, top, top_row) of the whole group for every representative, one frame per finished part."""
    size = reps.agg(F.sum(F.col("size") + 100).alias("s")).first()["s"]
    if size is None:
        return []
    # about two thirds of a table per partition, so that few records are left for the next level
    parts = int(-(-3 * size // (2 * table_bytes)))
    if parts > fan_out:
        spills = -(-parts // fan_out)
        files = materialise(reps.withColumn("spill", F.pmod(F.xxhash64("h", F.lit(-1 - level)), F.lit(spills))),
                            f"spill-{level}", partition_by="spill")
        done = []
        for i in range(spills):     # a wider fan below, so that a hash range that can't be split comes to an end
            done += settle(files.where(F.col("spill") == i).select(*TRAVELS), table_bytes, 2 * fan_out, level + 1)
        return done
    dealt = reps.select(*TRAVELS).repartition(parts, F.xxhash64("h", F.lit(level)))
    out = materialise(_tables(dealt, table_bytes), f"settled-{level}")
    done = [out.where(F.col("root").isNotNull()).select("rep", "copies", "top", "top_row")]
    return done + settle(out.where(F.col("root").isNull()).select(*TRAVELS), table_bytes, fan_out, level + 1)


def _solve(docs: DataFrame, key: str, text: str, table_bytes: int, fan_out: int, merge: int) -> tuple[DataFrame, DataFrame]:
    found = local_groups(docs, key, text, table_bytes)
    reps, maps = merge_hot(found.where(F.col("copies").isNotNull()).select(*TRAVELS), table_bytes, merge)
    parts = settle(reps, table_bytes, fan_out)
    totals = reduce(DataFrame.unionByName, parts) if parts else reps.select("rep", "copies", "top", "top_row")
    for m in reversed(maps):
        back = m.join(totals.withColumnRenamed("rep", "root"), "root").select("rep", "copies", "top", "top_row")
        totals = totals.join(m.select("rep"), "rep", "left_anti").unionByName(back)
    return found, totals


def find_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = 64 << 20, fan_out: int = 4096,
                merge: int = 64) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256."""
    found, totals = _solve(docs, key, text, table_bytes, fan_out, merge)
    members = found.where(F.col("copies").isNull()).select("rep", "row", "key", "digest")
    return members.join(totals, "rep").select(
        F.col("key").alias(key), F.col("top").alias("keep_id"), F.col("copies").alias("group_size"),
        (F.col("row") == F.col("top_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = 64 << 20, fan_out: int = 4096,
                merge: int = 64) -> DataFrame:
    """(key, text) of the rows that stay; a null text comes back empty."""
    found, totals = _solve(docs, key, text, table_bytes, fan_out, merge)
    reps = found.where(F.col("copies").isNotNull()).select("rep", F.col("top_row").alias("own_row"), "body")
    return (reps.join(totals, "rep").where(F.col("own_row") == F.col("top_row"))
            .select(F.col("top").alias(key), F.col("body").cast("string").alias(text)))
