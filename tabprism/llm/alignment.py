"""Cross-tokenizer alignment (operator 11): which tokens of two tokenizers share bytes.

1. **Incidence matrices:** the tokens of several documents lie one after the other on
   one byte axis.  A tokenizer's token-byte incidence matrix, token-group
   incidence matrix and their transposes are held in compressed sparse rows.
2. **Gustavson row products:** A times B transposed over bytes gives the overlap links (an
   entry is the number of shared bytes); the same product over groups (bytes
   between offsets where tokens of both end) gives the shared-group links.
   Only the sizes of the second are needed per document; ``token_links`` gives both whole.
3. **Pair counts:** every task counts id pairs per block of documents, so that a pair
   travels once per block however often it occurs, then Spark sums them, finds each
   B id's highest count, and sends the counts back to the blocks that asked.
4. **Per document:** its row of a document-pair matrix times the counts gives
   ``count_sum``, times the highest-count flags ``n_best``.

Texts whose joined token bytes differ from space + text under either tokenizer,
and null and empty ones, have no tokens: all counts 0 and an empty
``groups_sha256``.  Special tokens' strings inside texts are plain text.

Other defined results: repeated rows and null keys get rows of their own; ties for the
highest count all count as best; an empty table gives no row.  Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprism.llm.common import materialise, process_cache, strings
from tabprism.llm.packing import BytePairIds, byte_alphabet

#: Fixed value: the character that stands for a space in pieces.
PIECE_SPACE = "▁"

#: Characters of text whose matrices are built at a time, and document-pair entries and documents per block.
CHARACTERS = 1_000_000
BLOCK_ENTRIES = 1_000_000
BLOCK_ROWS = 20_000


# ---- sparse rows

@dataclass
class SparseRows:
    """Compressed sparse rows: row i has columns indices[indptr[i]:indptr[i + 1]] with values data."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of_entry(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    def transposed(self) -> SparseRows:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return SparseRows(indptr, self.row_of_entry()[order], self.data[order], self.rows)

    def some_rows(self, start: int, end: int) -> SparseRows:
        a, b = self.indptr[start], self.indptr[end]
        return SparseRows(self.indptr[start:end + 1] - a, self.indices[a:b], self.data[a:b], self.columns)


def token_bytes(lengths: np.ndarray) -> SparseRows:
    """Token-byte incidence: a token holds the next ``lengths`` bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return SparseRows(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int64), int(ends[-1]))


def token_groups(group: np.ndarray, groups: int) -> SparseRows:
    """Token-group incidence: a token lies in one group."""
    return SparseRows(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


def product_sizes(a: SparseRows, b: SparseRows) -> np.ndarray:
    """Multiplications that each row of ``a`` times ``b`` takes (Gustavson's first pass)."""
    work = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return work[a.indptr[1:]] - work[a.indptr[:-1]]


def gustavson(a: SparseRows, b: SparseRows) -> SparseRows:
    """``a`` times ``b``: row i is the sum of the rows of ``b`` that row i of ``a`` names, times its values."""
    sizes = np.diff(b.indptr)[a.indices]
    start, owner, value = b.indptr[:-1][a.indices], a.row_of_entry(), a.data
    if len(sizes) and sizes.max() == 1 == sizes.min():
        at = start
    else:
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + sizes, sizes)
        owner, value = np.repeat(owner, sizes), np.repeat(value, sizes)
    column, value = b.indices[at], value * b.data[at]
    place = owner * b.columns + column
    if (place[1:] < place[:-1]).any():
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
    data = np.add.reduceat(value, first) if len(first) else value[:0]
    owner, column = np.divmod(place[first], max(b.columns, 1))
    return SparseRows(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=a.rows))]), column, data, b.columns)


# ---- tokenizers

class Pair:
    """Both tokenizers, the bytes of their tokens, and the decimal texts of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = BytePairIds(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {ch: b for b, ch in enumerate(byte_alphabet())}
        special = {i: t.content for i, t in self.a.tokenizer.get_added_tokens_decoder().items()}
        known = {i: t for t, i in self.a.tokenizer.get_vocab().items()}
        self.a_bytes = [special[i].encode() if i in special else bytes(byte[c] for c in known.get(i, "")) for i in range(max(known) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(PIECE_SPACE, " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        # ids followed by what separates them: A, A at its group's end, B, B at its group's end
        self.shown = np.array([f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends
                               for i in range(n)], object)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a text under both, or none where they don't give back its bytes."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        want = (" " + text).encode()
        a = np.frombuffer(self.a.encode(" " + text), self.a.dtype).astype(np.int64)
        b = np.array(self.b.encode(text), np.int64)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != want or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != want:
            return none, none
        return a, b


def tokenizers(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers per Python worker."""
    cache = process_cache()
    if (a_path, b_path) not in cache:
        cache[a_path, b_path] = Pair(a_path, b_path)
    return cache[a_path, b_path]


# ---- a few documents on one byte axis

@dataclass
class Axis:
    """Tokens of several documents, one after the other, with their groups and matrices."""

    a: np.ndarray               # ids
    b: np.ndarray
    a_doc: np.ndarray           # document of each token
    b_doc: np.ndarray
    a_group: np.ndarray         # group of each token, numbered over all documents
    b_group: np.ndarray
    group_doc: np.ndarray
    a_last: np.ndarray          # token ends its group
    b_last: np.ndarray
    overlap: SparseRows         # A tokens by B tokens: shared bytes

    def shared(self) -> tuple[SparseRows, SparseRows]:
        """A's token-group matrix and B's transposed: their product is the shared-group links."""
        groups = len(self.group_doc)
        return token_groups(self.a_group, groups), token_groups(self.b_group, groups).transposed()


def lay_out(pair: Pair, texts: list[str]) -> Axis:
    found = [pair.ids(t) for t in texts]
    none = [np.empty(0, np.int64)]
    a, b = (np.concatenate(none + [f[i] for f in found]) for i in (0, 1))
    a_doc, b_doc = (np.repeat(np.arange(len(texts)), [len(f[i]) for f in found]) for i in (0, 1))
    a_rows, b_rows = token_bytes(pair.a_size[a]), token_bytes(pair.b_size[b])
    a_ends, b_ends = a_rows.indptr[1:], b_rows.indptr[1:]
    # every document's last tokens end together, so no group spans two documents
    ending = np.zeros(a_rows.columns + 1, bool)
    ending[a_ends] = True
    b_last = ending[b_ends]
    cuts = b_ends[b_last]
    ending[:] = False
    ending[cuts] = True
    return Axis(a, b, a_doc, b_doc, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), b_doc[b_last], ending[a_ends], b_last,
                gustavson(a_rows, b_rows.transposed()))


def group_texts(pair: Pair, axis: Axis, docs: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document's groups."""
    groups, n_a = len(axis.group_doc), len(axis.a)
    a_before = np.concatenate([[0], np.cumsum(np.bincount(axis.a_group, minlength=groups))])
    b_before = np.concatenate([[0], np.cumsum(np.bincount(axis.b_group, minlength=groups))])
    place = np.empty(n_a + len(axis.b), np.int64)
    place[np.arange(n_a) + b_before[axis.a_group]] = axis.a + len(pair.a_bytes) * axis.a_last
    place[np.arange(len(axis.b)) + a_before[axis.b_group + 1]] = axis.b + 2 * len(pair.a_bytes) + len(pair.b_bytes) * axis.b_last
    shown = pair.shown[place].tolist()
    ends = np.cumsum(np.bincount(axis.a_doc, minlength=docs) + np.bincount(axis.b_doc, minlength=docs)).tolist()
    return ["".join(shown[s:e])[:-1] for s, e in zip([0, *ends], ends)]


def _slices(column: list[str], size: int):
    """Index ranges of texts of about ``size`` characters, at least one text each."""
    at = 0
    while at < len(column):
        end, held = at, 0
        while end < len(column) and (end == at or held + len(column[end]) <= size):
            held += len(column[end])
            end += 1
        yield at, end
        at = end


# ---- over a table

COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def count_pairs(docs: DataFrame, key: str, text: str, a_path: str, b_path: str) -> DataFrame:
    """Document rows (pair is null: counts, and the row's pairs in its block) and pair rows (block, at, pair, links), written once."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = plain.schema["key"].dataType.simpleString()

    def run(batches):
        pair = tokenizers(a_path, b_path)
        width = len(pair.b_bytes)
        cells = len(pair.a_bytes) * width
        block = TaskContext.get().partitionId() << 32
        keys, facts, digests, entries = [], [], [], []
        key_type = None

        def flush():
            n = len(keys)
            doc, code, times = (np.concatenate([e[i] for e in entries] + [np.empty(0, np.int64)]) for i in range(3))
            pairs, at = np.unique(code, return_inverse=True)
            links = np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64)
            order = np.argsort(-links, kind="stable")           # frequent pairs get small numbers
            rank = np.empty(len(pairs), np.int64)
            rank[order] = np.arange(len(pairs))
            at = rank[at]
            order = np.lexsort((at, doc))
            at, times = at[order].astype("<u4"), times[order].astype("<u4")
            ends = np.cumsum(np.bincount(doc, minlength=n)).tolist()
            cut = list(zip([0, *ends], ends))
            for s in range(0, n, 2_000):
                some = cut[s:s + 2_000]
                m = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.array(keys[s:s + m], key_type), *[pa.array([f[i] for f in facts[s:s + m]], pa.int64()) for i in range(len(COUNTS))],
                     pa.array(digests[s:s + m]), pa.array([at[x:y].tobytes() for x, y in some], pa.binary()),
                     pa.array([times[x:y].tobytes() for x, y in some], pa.binary())], names)
            by = np.argsort(rank)
            for s in range(0, len(pairs), 50_000):
                some = by[s:s + 50_000]
                m = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * m, pa.int64()), pa.array(np.arange(s, s + m)), pa.array(pairs[some]), pa.array(links[some]),
                     pa.nulls(m, key_type), *[pa.nulls(m, pa.int64())] * len(COUNTS), pa.nulls(m, pa.string()),
                     pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names)

        held = 0
        for batch in batches:
            key_type = batch.schema.field("key").type
            texts, all_keys = strings(batch, "text"), batch.column("key").to_pylist()
            for s, e in _slices(texts, CHARACTERS):
                axis = lay_out(pair, texts[s:e])
                m = e - s
                a_row = axis.overlap.row_of_entry()
                doc = axis.a_doc[a_row]
                sizes = product_sizes(*axis.shared())
                shared = np.bincount(axis.a_doc, weights=sizes, minlength=m).astype(np.int64)
                facts += zip(*(np.bincount(x, minlength=m).tolist() for x in (axis.a_doc, axis.b_doc, axis.group_doc, doc)), shared.tolist())
                digests += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(pair, axis, m)]
                code, times = np.unique(doc * cells + axis.a[a_row] * width + axis.b[axis.overlap.indices], return_counts=True)
                entries.append((code // cells + len(keys), code % cells, times))
                keys += all_keys[s:e]
                held += len(code)
                if held >= BLOCK_ENTRIES or len(keys) >= BLOCK_ROWS:
                    yield from flush()
                    block += 1
                    keys, facts, digests, entries, held = [], [], [], [], 0
        if keys:
            yield from flush()

    names = ["block", "at", "pair", "links", "key", *COUNTS, "digest", "pairs", "times"]
    schema = f"block long, at long, pair long, links long, key {kind}, {', '.join(f'{c} long' for c in COUNTS)}, digest string, pairs binary, times binary"
    return materialise(plain.mapInArrow(run, schema), "pair-counts")


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256."""
    import sentencepiece
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    found = count_pairs(docs, key, text, a_path, b_path)
    kind = found.schema["key"].dataType.simpleString()
    asked = found.where(F.col("pair").isNotNull()).select("block", "at", "pair", "links")
    totals = materialise(asked.groupBy("pair").agg(F.sum("links").alias("count")).withColumn("b", F.col("pair") % width), "pair-totals")
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    scored = totals.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("block", "at", "pair").join(scored, "pair").select(F.col("block").alias("to"), "at", "count", "best")
    rows = found.where(F.col("pair").isNull()).select("block", "key", *COUNTS, "digest", "pairs", "times")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
        n_best, sums = [], []
        for p, t in zip(left.column("pairs").to_pylist(), left.column("times").to_pylist()):
            p, t = np.frombuffer(p, "<u4"), np.frombuffer(t, "<u4").astype(np.int64)
            n_best.append(int(t @ best[p]))
            sums.append(sum((t * count[p]).tolist()))
        return pa.table([left.column("key"), *[left.column(c) for c in COUNTS], pa.array(n_best, pa.int64()),
                         pa.array([s if s < 2 ** 63 else None for s in sums], pa.int64()), left.column("digest")], names)

    names = ["key", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = f"key {kind}, {', '.join(f'{c} long' for c in names[1:-1])}, groups_sha256 string"
    out = rows.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(weigh, schema)
    return out.withColumnRenamed("key", key)


def token_links(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", kind: str = "overlap",
                per_row: int = 1_000_000) -> DataFrame:
    """The links themselves: key, a and b (token positions in the document), weight (shared bytes, or 1 for kind "shared").

    A document's links come in rows of about ``per_row`` links, in order; a document without links has no row.
    """
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_kind = plain.schema["key"].dataType.simpleString()

    def run(batches):
        pair = tokenizers(a_path, b_path)
        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), strings(batch, "text")):
                axis = lay_out(pair, [t])
                left, right = axis.shared()
                done = np.cumsum(product_sizes(left, right) if kind == "shared" else np.diff(axis.overlap.indptr))
                at = 0
                while at < len(axis.a):
                    end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + per_row, "right")))
                    found = gustavson(left.some_rows(at, end), right) if kind == "shared" else axis.overlap.some_rows(at, end)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], batch.schema.field("key").type),
                         *[pa.array([v.astype(np.int32)], pa.list_(pa.int32())) for v in (found.row_of_entry() + at, found.indices, found.data)]],
                        ["key", "a", "b", "weight"])
                    at = end

    made = plain.mapInArrow(run, f"key {key_kind}, a array<int>, b array<int>, weight array<int>")
    return made.withColumnRenamed("key", key)
