"""Suffix-array dedup (operator 6): threshold-bounded interval expansion on a BWT.

Removes every byte covered by a ``length``-byte string that also starts in a
document with a smaller id.  A suffix array of the whole corpus in one place is
out of the question, so strings are first brought together that can be equal:

1. **Anchors.**  Of the 16-byte strings in a window of ``length`` bytes the one
   with the smallest hash is its anchor, so equal windows have equal anchors.
   Neighbouring windows mostly share one; such a run of windows is a *context*,
   its bytes cover all of the run's windows.
2. **Meeting by anchor** (shuffle by the anchor's hash, three numbers a context):
   anchors of one document only are done.  Of equal contexts all but the one
   with the smallest id are covered whole.  Where an anchor has several
   different contexts, one of each kind, the one with the smallest id, is
   *open*: it has to be compared with the others.
3. **Expansion** (shuffle by the anchor's hash, bytes of open contexts only):
   equal windows lie alike around their anchor, so a context that is the only one
   of its anchor with its 17 bytes before it, and with those behind it, is done.
   The other contexts of a task are joined to one text, blocks hold whole anchors.  Its suffixes are
   ordered up to ``length`` bytes, which gives the Burrows-Wheeler transform.
   Breadth-first backward extension then finds common prefixes by increasing
   value: rows j of one first byte are split at value l+1 where the rows that
   precede them in text were split at value l.  It stops at ``length``; rows not
   split by then have their first ``length`` bytes in common, and the smallest id among
   them covers the others.
4. **Removal:** ranges go back to their document by its id and are united.

Texts that are equal as a whole are settled by their SHA-256 before step 1, so
only the first of a group of copies is searched.  Hot anchors carry a document
only once per different context.

Defined results: null texts are empty; texts shorter than ``length`` stay; a
null id counts as larger than any other, and rows with equal ids (null ids
too) never remove from each other; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprism.llm.common import materialise

K = 16
#: Bytes that are searched at once; longer texts are cut with an overlap.
CHUNK = 4_000_000
#: Symbols of a block of the expansion, unless one anchor alone has more.
BLOCK = 3_000_000
NO_ID = (1 << 63) - 1
#: In a row's place: the low half is a start within the text, or this mark of ranges that are settled.
SETTLED = 1 << 31
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# ---- anchors ----------------------------------------------------------------

def contexts(buf: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, first and last window start, and bytes before the anchor, of each run of windows.

    ``bounds`` are the ends of the texts that ``buf`` joins; no window crosses one.
    """
    none = np.zeros(0, np.int64)
    n, windows = len(buf), length - K + 1
    if n < length:
        return none, none, none, none, none
    words = np.ndarray((n - 7,), "<u8", buf, strides=(1,))
    h = (words[:-8] * _C1) ^ (words[8:] * _C2 >> np.uint64(23))
    h ^= h >> np.uint64(32)
    h *= _C3
    h ^= h >> np.uint64(29)
    # hash first, then place: the smallest is the leftmost of equal hashes
    best = (h & ~np.uint64(0xFFFFFF)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(0xFFFFFF))
    reach = 1
    while reach < windows:
        step = min(reach, windows - reach)
        best = np.minimum(best[:-step], best[step:])
        reach += step
    place = (best & np.uint64(0xFFFFFF)).astype(np.int64)       # CHUNK is below 2**24
    ok = np.ones(len(place), bool)
    for e in bounds[:-1].tolist():
        ok[max(0, e - length + 1):e] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, none, none
    spot = place[at]
    new = np.concatenate(([True], (spot[1:] != spot[:-1]) | (at[1:] != at[:-1] + 1)))
    first = at[new]
    last = at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]
    anchor = spot[new]
    digest = xxhash.xxh3_64_intdigest
    c = np.fromiter((digest(buf[s:e], o) for s, e, o in zip(first.tolist(), (last + length).tolist(), (anchor - first).tolist())),
                    np.uint64, len(first))
    # 48 bits are enough to bring equal anchors together, and zero bytes beside others cost no space in a shuffle
    return (h[anchor] & ~np.uint64(0xFFFF)).view(np.int64), c.view(np.int64), first, last, anchor - first


def text_tag(th: np.ndarray) -> np.ndarray:
    """The high half of a row's place: tells texts under one id apart."""
    return th >> 32 << 32


def _joined(texts: list[bytes], length: int):
    """Groups of whole texts, or overlapping cuts of a long one: (text numbers, offsets, bytes, ends)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > CHUNK:
            for at in range(0, len(t) - length + 1, CHUNK - length + 1):
                part = t[at:at + CHUNK]
                yield [i], [at], part, np.array([len(part)])
            continue
        if group and size + len(t) > CHUNK // 2:
            yield group, [0] * len(group), b"".join(texts[g] for g in group), np.cumsum([len(texts[g]) for g in group])
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield group, [0] * len(group), b"".join(texts[g] for g in group), np.cumsum([len(texts[g]) for g in group])


def text_contexts(texts: list[bytes], length: int):
    """Per group of texts: (text number, hash, context hash, first start, last start), starts within the text."""
    for *found, _ in _led_contexts(texts, length):
        yield found


def _led_contexts(texts: list[bytes], length: int):
    """As ``text_contexts``, and how many bytes of each context lie before its anchor."""
    for numbers, offsets, buf, ends in _joined(texts, length):
        h, c, first, last, lead = contexts(buf, ends, length)
        which = np.searchsorted(ends, first, side="right")
        base = np.concatenate(([0], ends[:-1]))[which] - np.array(offsets)[which]
        yield np.array(numbers)[which], h, c, first - base, last - base, lead


def _emit_anchors(length: int):
    def run(batches):
        for b in batches:
            keys = b.column("key").to_numpy()
            texts = [t.encode("utf-8") for t in b.column("text").to_pylist()]
            for which, h, c, _, _ in text_contexts(texts, length):
                mixed = c.view(np.uint64) ^ (which.astype(np.uint64) * _C1)
                once = np.unique(mixed, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(h[once]), pa.array(c[once]), pa.array(keys[which[once]])], ["h", "c", "key"])
    return run


# ---- meeting by anchor ------------------------------------------------------

def meet(h: np.ndarray, c: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that matter: (key, context hash, open).  Closed rows are covered whole."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = hs[1:] == hs[:-1]
    shared = np.zeros(len(h), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    if not len(order):
        return key[:0], c[:0], np.zeros(0, bool)
    h, c, key = h[order], c[order], key[order]
    order = np.lexsort((key, c, h))
    h, c, key = h[order], c[order], key[order]
    head_h = np.concatenate(([True], h[1:] != h[:-1]))
    head_c = head_h | np.concatenate(([True], c[1:] != c[:-1]))
    group_h, group_c = np.cumsum(head_h) - 1, np.cumsum(head_c) - 1
    least_h = np.minimum.reduceat(key, np.flatnonzero(head_h))
    most_h = np.maximum.reduceat(key, np.flatnonzero(head_h))
    least_c = key[head_c]
    kinds = np.bincount(group_h[head_c], minlength=len(least_h))
    covered = key > least_c[group_c]
    several = (kinds[group_h] > 1) & (least_h[group_h] < most_h[group_h])
    opened = several & head_c
    keep = covered | opened
    return key[keep], c[keep], opened[keep]


def _meet_partition(batches):
    """Rows (key, fate): the context hash, its lowest bit set if it is open."""
    rows = [(b.column("h").to_numpy(), b.column("c").to_numpy(), b.column("key").to_numpy()) for b in batches]
    if not rows:
        return
    key, c, opened = meet(*(np.concatenate(x) for x in zip(*rows)))
    fate = (c & ~np.int64(1)) | opened
    for at in range(0, len(key), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(key[at:at + 200_000]), pa.array(fate[at:at + 200_000])], ["key", "fate"])


def _doc_rows(length: int, at_once: int = 512):
    """Texts with their contexts' fate to covered ranges and open contexts (bytes)."""
    def rows_of(b):
        keys, ths = b.column("key").to_numpy(), b.column("th").to_numpy()
        tags = text_tag(ths)
        texts = [t.encode("utf-8") for t in b.column("text").to_pylist()]
        salt = np.arange(b.num_rows, dtype=np.uint64) * _C1
        fates = b.column("fates")
        flat = fates.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(b.num_rows), np.diff(fates.offsets.to_numpy()))
        known = (flat & ~np.uint64(1)) ^ salt[owner]
        flag = flat & np.uint64(1)
        order = np.lexsort((flag, known))      # a covered context is before an open one of the same hash
        known, flag = known[order], flag[order]
        whole_rows, open_rows = [], []
        for which, h, c, first, last, lead in _led_contexts(texts, length):
            mixed = (c.view(np.uint64) & ~np.uint64(1)) ^ salt[which]
            at = np.minimum(np.searchsorted(known, mixed), len(known) - 1)
            hit = known[at] == mixed
            whole = hit & (flag[at] == 0)
            whole_rows.append(np.column_stack([which[whole], first[whole], last[whole] + length]))
            o = hit & ~whole
            open_rows.append((which[o], h[o], first[o], last[o] + length, lead[o]))
        whole = np.concatenate(whole_rows) if whole_rows else np.zeros((0, 3), np.int64)
        whole = whole[np.argsort(whole[:, 0], kind="stable")]
        docs, starts = np.unique(whole[:, 0], return_index=True)
        ranges = [merge_ranges(r).astype("<i4").tobytes() for r in np.split(whole[:, 1:], starts[1:])] if len(docs) else []
        yield made(ths[docs], keys[docs], tags[docs] | SETTLED, ranges)
        for which, h, first, end, lead in open_rows:
            for i in range(0, len(which), 50_000):
                part = slice(i, i + 50_000)
                # the first two bytes say where the anchor begins
                cut = [n.to_bytes(2, "little") + texts[w][s:e] for w, s, e, n in zip(which[part].tolist(), first[part].tolist(), end[part].tolist(), lead[part].tolist())]
                yield made(h[part], keys[which[part]], tags[which[part]] | first[part], cut)

    def made(h, key, place, cut):
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h, key, place)), pa.array(cut, pa.binary())],
                                          ["h", "key", "place", "bytes"])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, at_once):
                yield from rows_of(b.slice(i, at_once))
    return run


# ---- expansion --------------------------------------------------------------

def paired(h: np.ndarray, rows: list[bytes], length: int) -> np.ndarray:
    """Open contexts (two lead bytes + bytes) that can have ``length`` bytes in common with another of their anchor.

    Common windows lie alike around the anchor, so they hold half of the other
    bytes before it or half of them behind it: both contexts have the anchor
    with these bytes.  Contexts that are alone with either are done.
    """
    side = (length - K) // 2
    digest, none = xxhash.xxh3_64_intdigest, np.uint64(0)
    left, right = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
    for i, r in enumerate(rows):
        at = 2 + r[0] + (r[1] << 8)
        if at - 2 >= side:
            left[i] = digest(r[at - side:at + K]) | 1
        if at + K + side <= len(r):
            right[i] = digest(r[at:at + K + side]) | 1
    keep = np.zeros(len(rows), bool)
    for part in (left, right):
        mixed = np.where(part == none, none, (part ^ h.view(np.uint64) * _C1) | np.uint64(1))
        _, inverse, counts = np.unique(mixed, return_inverse=True, return_counts=True)
        keep |= (mixed != none) & (counts[inverse] > 1)
    return keep


def bounded_suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts ordered by their first ``depth`` symbols or more (symbols below 512)."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | padded[i:i + n]
    order = np.argsort(key)              # rows that are equal so far may come in any order
    ranked = key[order]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.empty(n, np.uint64)        # place of the first row that is equal so far
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    have = 7
    while have < depth:
        # only rows that are still tied are ordered by what follows
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        rows = order[tied]
        after = np.zeros(len(rows), np.uint64)
        inside = rows + have < n
        after[inside] = rank[rows[inside] + have] + np.uint64(1)
        key = (rank[rows] << np.uint64(32)) | after
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        order[tied], head[tied] = rows, first
        rank[rows] = np.maximum.accumulate(np.where(first, tied, 0))
        have *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each row of the ordered suffixes: its common prefix with the row before, ``limit`` if that long or longer.

    ``order`` must be right up to ``limit`` symbols.  Values are found in
    increasing order from the Burrows-Wheeler transform alone.
    """
    n = len(text)
    bwt = text[order - 1]
    before = np.argsort(bwt, kind="stable")     # row j is row before[j] with one symbol put in front
    value = np.full(n, limit, np.int64)
    split = np.concatenate(([True], bwt[before[1:]] != bwt[before[:-1]]))
    value[split] = 0
    rest = np.flatnonzero(~split)
    upper, lower = before[rest - 1], before[rest]
    for level in range(1, limit):
        if not len(rest):
            break
        interval = np.cumsum(split, dtype=np.int32)
        now = interval[lower] != interval[upper]
        if not now.any():
            break       # no interval was split: none will be at a larger value
        found = rest[now]
        value[found] = level
        split[found] = True
        stay = ~now
        rest, upper, lower = rest[stay], upper[stay], lower[stay]
    return value


def covered_windows(parts: list[bytes], keys: np.ndarray, length: int) -> list[np.ndarray]:
    """Per part: the window starts whose string also starts in a part with a smaller key."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    text = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8).astype(np.uint16) + 1
    text[ends - 1] = 0
    order = bounded_suffix_order(text, length)
    value = common_prefixes(text, order, length)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)[order]
    window = order + length <= starts[owner] + sizes[owner]
    heads = np.flatnonzero(value < length)
    least = np.minimum.reduceat(np.where(window, keys[owner], NO_ID), heads)
    group = np.cumsum(value < length) - 1
    hit = window & (keys[owner] > least[group])
    at = order[hit] - starts[owner[hit]]
    who = owner[hit]
    by = np.lexsort((at, who))
    return np.split(at[by], np.searchsorted(who[by], np.arange(1, len(parts))))


def merge_ranges(ranges: np.ndarray) -> np.ndarray:
    """Union of (start, end) rows as sorted maximal runs; touching runs are one."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    new = np.concatenate(([True], r[1:, 0] > reach[:-1]))
    heads = np.flatnonzero(new)
    return np.column_stack([r[heads, 0], reach[np.append(heads[1:] - 1, len(r) - 1)]])


def _expand_partition(length: int):
    def block(rows):
        got = covered_windows([r[2] for r in rows], np.array([r[0] for r in rows], np.int64), length)
        out = [[], [], []]
        for (key, place, _), starts in zip(rows, got):
            if len(starts):
                first = (place & SETTLED - 1) + starts
                out[0].append(key)
                out[1].append(place >> 32)
                out[2].append(merge_ranges(np.column_stack([first, first + length])).astype("<i4").tobytes())
        return out

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())],
                                          ["key", "tag", "ranges"])

    def run(batches):
        held: list[list] = [[], [], []]
        bodies: list[bytes] = []
        for b in batches:
            place = b.column("place").to_numpy()
            done = place & 0xFFFFFFFF == SETTLED
            if done.any():
                some = b.take(pa.array(np.flatnonzero(done)))
                yield made([some.column("key").to_pylist(), (place[done] >> 32).tolist(), some.column("bytes").to_pylist()])
            if not done.all():
                some = b.take(pa.array(np.flatnonzero(~done)))
                for out, v in zip(held, (some.column("h").to_numpy(), some.column("key").to_numpy(), place[~done])):
                    out.append(v)
                bodies += some.column("bytes").to_pylist()
        if not bodies:
            return
        h, key, place = (np.concatenate(v) for v in held)
        kept = np.flatnonzero(paired(h, bodies, length))
        kept = kept[np.argsort(h[kept], kind="stable")]
        h, rows = h[kept].tolist(), [(k, p, bodies[i][2:]) for i, k, p in zip(kept.tolist(), key[kept].tolist(), place[kept].tolist())]
        bodies.clear()
        at = 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (size < BLOCK or h[end] == h[end - 1]):
                size += len(rows[end][2]) + 1
                end += 1
            out = block(rows[at:end])
            if out[0]:
                yield made(out)
            at = end
    return run


def _apply(with_kept: bool):
    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            tags = text_tag(b.column("th").to_numpy()) >> 32
            for key, th, tag, text, found in zip(b.column("key").to_pylist(), b.column("th").to_pylist(), tags.tolist(),
                                                 b.column("text").to_pylist(), b.column("found").to_pylist()):
                raw = text.encode("utf-8")
                mine = [np.frombuffer(f["ranges"], "<i4").reshape(-1, 2) for f in found if f["tag"] == tag]
                runs = merge_ranges(np.concatenate(mine).astype(np.int64)) if mine else np.zeros((0, 2), np.int64)
                cuts = [0, *runs.ravel().tolist(), len(raw)]
                kept = b"".join(raw[cuts[i]:cuts[i + 1]] for i in range(0, len(cuts), 2))
                for col, v in zip(cols, (key, th, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept).hexdigest(),
                                         kept if with_kept else None)):
                    col.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["key", "th", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


# ---- the operator -----------------------------------------------------------

def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50,
                   with_kept: bool = False, bytes_per_task: int = 48_000_000) -> DataFrame:
    """One row per row: key, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left)."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = plain.select(F.coalesce("id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("th"), "text")
    facts = materialise(plain.select("id", F.coalesce("id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("th"),
                                     F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")),
                        "text-digests")
    firsts = facts.groupBy("sha").agg(F.min("key").alias("first"))
    facts = facts.join(firsts, "sha").withColumn("copy", F.col("key") > F.col("first"))
    total = facts.where(~F.col("copy")).agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    tasks = max(1, -(-int(total) // bytes_per_task))

    # texts are joined by id throughout, so that one exchange of them serves every step
    searched = facts.where(~F.col("copy") & (F.col("n_bytes") >= length)).select("key").distinct()
    anchors = (d.join(searched, "key").select("key", "th", "text")
               .mapInArrow(_emit_anchors(length), "h long, c long, key long"))
    fates = (anchors.repartition(tasks, "h").mapInArrow(_meet_partition, "key long, fate long")
             .groupBy("key").agg(F.collect_list("fate").alias("fates")))
    spread = (d.join(fates, "key").select("key", "th", "text", "fates")
              .mapInArrow(_doc_rows(length), "h long, key long, place long, bytes binary"))
    ranges = spread.repartition(tasks, "h").mapInArrow(_expand_partition(length), "key long, tag int, ranges binary")
    found = ranges.groupBy("key").agg(F.collect_list(F.struct("tag", "ranges")).alias("found"))
    cut = (d.join(found, "key").select("key", "th", "text", "found")
           .mapInArrow(_apply(with_kept), "key long, th long, n_removed long, n_spans long, kept_sha256 string, kept binary")
           .dropDuplicates(["key", "th"]))
    out = facts.join(cut, ["key", "th"], "left")
    gone = F.col("copy") & (F.col("n_bytes") >= length)
    cols = [F.col("id").alias(key), "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    if with_kept:
        # null: the text is kept as it is
        cols.append(F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*cols)
