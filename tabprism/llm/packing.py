"""Packing (operator 4): documents in space-filling-curve order.

1. **One pass over the texts:** token ids (byte-level BPE, then an end id), and the
   document's vector: token counts hashed to ``2**12`` columns, L2-normalised
   after a square root, projected to ``DIMS`` dimensions by fixed random signs.
   Ids are written once, two or four bytes each.
2. **Curve:** each dimension is standardised by its mean and deviation over all
   documents, cut into ``2**BITS`` cells of equal normal probability, and the
   Hilbert index of the cell is the sort key.
3. **Layout:** only (row, key, length) are range-sorted by the key; running sums
   inside range partitions plus one total per partition give each document's
   place in one long stream.
4. **Cut:** the stream is cut every ``length`` tokens; what is left at its very end
   is cut at powers of two.  So nothing is padded.  Ids meet their place in an
   equi-join on the row, and each row is cut on its own.

``<|endoftext|>`` and the like inside a text are ordinary text.

Defined results: null texts are empty (the end id alone); repeated rows and
repeated or null keys are rows of their own; ties on the curve are ordered by
row; an empty table gives no piece.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tabprism.llm.common import materialise, process_cache, strings

DIMS = 4
BITS = 10
HASHED = 1 << 12

#: Texts of these characters alone take the leaner of two libraries.
_PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")

#: Fixed value: how byte-level BPE cuts a text into pieces (the possessive form of its pattern).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes take the
    code points from 256 on, in order.
    """
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class BytePairIds:
    """Ids of whole texts as packed little-endian integers, for a byte-level BPE vocabulary file.

    Texts of plain Latin characters are encoded by ``tiktoken`` from the same
    vocabulary, which gives equal ids in a third of the time; any other text by
    ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        table = {ch: b for b, ch in enumerate(byte_alphabet())}
        special = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {bytes(table[ch] for ch in t): i for t, i in self.tokenizer.get_vocab().items() if i not in special}
        self.plain = tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = (self.plain.encode_ordinary(text) if _PLAIN.fullmatch(text)
               else self.tokenizer.encode(text, add_special_tokens=False).ids)
        return np.array(ids, self.dtype).tobytes()


def projection() -> np.ndarray:
    """Fixed random signs, one row per hashed column."""
    return np.random.default_rng(20).choice([-1.0, 1.0], size=(HASHED, DIMS))


def document_vector(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Low-dimensional place of a token sequence."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.sqrt(np.bincount(hashed, minlength=HASHED))
    return counts @ matrix / max(1.0, float(np.sqrt((counts * counts).sum())))


def tokenize(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """(row, key, n, v0.., ids) per row of ``docs``, written once; ``row`` is unique."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    places = [f"v{i}" for i in range(DIMS)]

    def run(batches):
        cache = process_cache()
        if tokenizer not in cache:
            cache[tokenizer] = BytePairIds(tokenizer)
        made, matrix = cache[tokenizer], projection()
        tail = np.array([end_id], made.dtype).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                ids = [made.encode(t) + tail for t in strings(batch, "text")]
                arrays = [np.frombuffer(b, made.dtype) for b in ids]
                v = np.array([document_vector(a, matrix) for a in arrays]).reshape(-1, DIMS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array([len(a) for a in arrays], pa.int64()),
                     *[pa.array(v[:, i], pa.float64()) for i in range(DIMS)], pa.array(ids, pa.binary())],
                    ["key", "n", *places, "ids"])

    schema = f"key {kind}, n long, {', '.join(f'{p} double' for p in places)}, ids binary"
    return materialise(plain.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "token-ids")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve index of integer points (points x dimensions), each below 2**bits."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:                      # undo excess work of the rotations, from the top bit down
        p = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):            # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):   # interleave, most significant bits first
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out


def _cells(z: np.ndarray, bits: int) -> np.ndarray:
    """Cells of about equal normal probability (logistic approximation of the normal curve)."""
    u = 1.0 / (1.0 + np.exp(-1.702 * np.clip(z, -20, 20)))
    return np.minimum((u * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def curve_keys(tokens: DataFrame) -> DataFrame:
    """(row, n, curve): Hilbert index of each document's standardised place."""
    places = [f"v{i}" for i in range(DIMS)]
    s = tokens.agg(*[F.avg(p).alias(f"m{p}") for p in places], *[F.stddev_pop(p).alias(f"s{p}") for p in places]).first()
    mean = np.array([s[f"m{p}"] or 0.0 for p in places])
    dev = np.array([s[f"s{p}"] or 1.0 for p in places])

    @F.pandas_udf(LongType())
    def curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        z = (np.column_stack([a, b, c, d]).reshape(-1, DIMS) - mean) / dev
        return pd.Series(hilbert_index(_cells(z, BITS), BITS).astype(np.int64))

    return tokens.select("row", "n", curve(*places).alias("curve"))


def stream_places(keys: DataFrame) -> tuple[DataFrame, int]:
    """(row, n, start): place of each row in the stream along the curve; and the stream's length."""
    ranged = (keys.repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
              .withColumn("part", F.spark_partition_id()))
    schema = StructType([*ranged.schema.fields, StructField("inside", LongType())])

    def running(batches):
        carry = 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = np.cumsum(n) + carry
            carry = int(ends[-1]) if len(n) else carry
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - n, pa.int64())], [*b.schema.names, "inside"])

    placed = materialise(ranged.mapInArrow(running, schema), "curve-order")
    totals = placed.groupBy("part").agg(F.sum("n").alias("t")).orderBy("part").collect()    # one row per range partition
    rows, at = [], 0
    for r in totals:
        rows.append((r["part"], at))
        at += r["t"]
    offsets = keys.sparkSession.createDataFrame(rows, "part int, base long")
    return placed.join(F.broadcast(offsets), "part").select("row", (F.col("inside") + F.col("base")).alias("start")), at


def tail_cuts(total: int, length: int) -> list[int]:
    """Where the rest after the last full sequence is cut: at falling powers of two."""
    cuts, at = [], total - total % length
    for b in range(length.bit_length(), -1, -1):
        if (total - at) >> b & 1:
            at += 1 << b
            cuts.append(at)
    return cuts


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = 2048,
         end_id: int = 1) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    tokens = tokenize(docs, key, text, tokenizer, end_id)
    places, total = stream_places(curve_keys(tokens))
    full, tail = total // length, tail_cuts(total, length)
    kind = tokens.schema["key"].dataType.simpleString()
    joined = tokens.select("row", "key", "n", "ids").join(places.withColumnRenamed("start", "place"), "row")

    def cut(batches):
        bounds = [full * length, *tail]
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for k, n, place, ids in zip(*(b.column(c).to_pylist() for c in ("key", "n", "place", "ids"))):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                at = place
                while at < place + n:
                    if at < full * length:
                        seq = at // length
                        begin, end = seq * length, (seq + 1) * length
                    else:
                        i = next(i for i, e in enumerate(tail) if at < e)
                        seq, begin, end = full + i, bounds[i], bounds[i + 1]
                    stop = min(end, place + n)
                    for col, v in zip(out, (k, at - place, stop - at, wide[at - place:stop - place].tobytes(), n, seq, at - begin)):
                        col.append(v)
                    at = stop
                if sum(map(len, out[3])) > 8_000_000:
                    yield piece(out, b.schema.field("key").type)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield piece(out, b.schema.field("key").type)

    def piece(out, key_type):
        types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                          ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    made = joined.mapInArrow(cut, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return made.withColumnRenamed("key", key)


def crc_of(ids: bytes) -> int:
    """CRC-32 of packed ids, as the query's SQL function computes it."""
    return zlib.crc32(ids)
