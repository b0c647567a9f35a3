"""Quality rules (operator 1): base counts of a text and cross-document line frequency.

1. **Per document** (one Arrow pass over whole texts): words, symbols, repeated
   lines and repeated three-word windows, and the hashes of the normalised
   lines (words joined by one space, A-Z lowered) with their words.  The
   result, one narrow row per document, is written once and read by the rest.
2. **Line frequency:** distinct documents per (host, line).  Documents with
   equal text on one host count once, so plain copies don't turn a text into
   boilerplate; a line counts once per document.  Both steps are counts that
   combine before the shuffle, whatever share of rows holds one line.
3. **Verdict:** lines found in more than ``max_docs_per_host`` documents of the
   host are removed (an equi-join on the line's key, that Spark splits when
   it is skewed), and a document is rejected when the rest holds less than
   ``min_kept_share`` of its words.

Defined results: null and empty texts have all counts 0, fail the base rules
and aren't kept; a null host is a host of its own; repeated rows get a row
each.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprism.llm.common import map_batches, materialise, strings

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:       # three numbers no longer fit one integer
        pairs = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1]
        windows = pairs * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def text_facts(text: str, host: str | None) -> tuple:
    """(base counts..., line keys, words per line key) of one text."""
    raw = text.encode("utf-8")
    words = raw.split()
    spaces = sum(raw.count(c) for c in b" \t\n\v\f\r")
    symbols = sum(raw.count(c) for c in SYMBOLS.encode())
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    repeats = 0
    salt = b"\x01" + host.encode("utf-8") + b"\n" if host is not None else b"\x00\n"
    for line in raw.split(b"\n"):
        in_line = line.split()
        if not in_line:
            continue
        if line in seen:
            repeats += 1
        else:
            seen.add(line)
        key = xxhash.xxh3_64_intdigest(salt + b" ".join(in_line).lower()) - (1 << 63)
        lines[key] = lines.get(key, 0) + len(in_line)
    return (len(words), len(text) - spaces, symbols, repeats, repeated_words(words), list(lines), list(lines.values()))


def _facts(batch: pa.RecordBatch):
    rows = [text_facts(t, h) for t, h in zip(strings(batch, "text"), batch.column("host").to_pylist())]
    cols = list(zip(*rows)) if rows else [()] * 7
    digest = [xxhash.xxh3_64_intdigest(t.encode("utf-8")) - (1 << 63) for t in strings(batch, "text")]
    arrays = ([batch.column("key"), pa.array(digest, pa.int64())]
              + [pa.array(c, pa.int64()) for c in cols[:5]]
              + [pa.array(c, pa.list_(pa.int64())) for c in cols[5:]])
    yield pa.RecordBatch.from_arrays(arrays, ["key", "digest", *BASE, "lines", "line_words"])


def document_facts(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One narrow row per document: row, key, digest, base counts, lines and line_words."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(host).cast("string").alias("host"))
    kind = plain.schema["key"].dataType.simpleString()
    schema = f"key {kind}, digest long, {', '.join(f'{c} long' for c in BASE)}, lines array<long>, line_words array<long>"
    return materialise(map_batches(plain, _facts, schema).withColumn("row", F.monotonically_increasing_id()), "line-facts")


def frequent_lines(facts: DataFrame, max_docs_per_host: int) -> DataFrame:
    """Keys of the (host, line) pairs found in more than ``max_docs_per_host`` distinct documents."""
    return (facts.select("digest", F.explode("lines").alias("line"))
            .groupBy("line", "digest").agg(F.lit(1).alias("one"))
            .groupBy("line").agg(F.count("one").alias("docs"))
            .where(F.col("docs") > max_docs_per_host).select("line"))


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                    max_docs_per_host: int = 20, min_kept_share: float = 0.3, min_words: int = 50,
                    max_repeat_percent: int = 50) -> DataFrame:
    """One row per document: key, base counts, ``removed_words``, base_failed and kept."""
    facts = document_facts(docs, key, text, host)
    lines = facts.select("row", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    removed = (lines.join(frequent_lines(facts, max_docs_per_host), "line")
               .groupBy("row").agg(F.sum("words").alias("removed_words")))
    out = facts.drop("lines", "line_words", "digest").join(removed, "row", "left")
    gone = F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.select(F.col("key").alias(key), *BASE, gone.alias("removed_words"), failed.alias("base_failed"),
                      (~failed & (F.col("n_words") - gone >= min_kept_share * F.col("n_words"))).alias("kept"))
