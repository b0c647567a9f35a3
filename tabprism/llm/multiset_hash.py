"""Document fingerprints (operator 8, native): homomorphic multiset hash.

A text is a multiset of paragraphs: pieces between line breaks, and between
sentence ends within a line, white space cut at both sides, empty ones left
out.  Each paragraph is hashed (two SHA-256) to 8 words of 60 bits.  A word has
a value of 15 bits and twice 20 bits that choose a level, the number of zeros they end
with (19 at most).  Each of these 16 choices has a lane per level: the lane of the
chosen level takes the value, the 19 others nothing.  So a level sees half of what the
one below it sees, and the levels of a choice see different paragraphs.  A document's fingerprint is the number of its paragraphs modulo 2**32 and the lane-wise sum of
their vectors modulo 2**16.  So it does
not depend on the paragraphs' order, and paragraphs are inserted and deleted by
adding and subtracting their vectors (``insert``, ``delete``).

**Likeness.**  A lane of level j stays equal under d differing paragraphs with
probability about (1 - 2**-(j+1))**d, so the number of equal lanes estimates d (as
strata estimators for set differences do); likeness is
``1 - d / (paragraphs of both)``, at least 0; equal fingerprints have 1.  For any
d up to 2**19 some levels are neither all equal nor all different; the estimate of
d is off by about a sixth (one standard deviation), so the likeness by a sixth of
the differing share.

All expressions are built-in SQL functions; nothing leaves the JVM.

Defined results: null texts are empty; empty texts have the all-zero fingerprint;
texts of any length are hashed whole; repeated rows get a row each and an empty
table none; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprism.llm.common import free_tag, materialise

LEVELS = 20
#: Levels that are summed word by word; the rest, a 256th of the words, in one list.
LOW = 8
#: A hash gives four words of 60 bits, a word two of a level's lanes; hash k is taken of the paragraph after the text of SALTS[k].
SALTS = ["", "1"]
WORDS = 4 * len(SALTS)
PER_LEVEL = 2 * WORDS
LANES = LEVELS * PER_LEVEL
VALUE_BITS = 15
LANE_MOD = 1 << 16
COUNT_MOD = 1 << 32

#: White space after a sentence's last mark ends a paragraph, as line breaks do.
SENTENCE_END = r"([.!?])[ \t\r\f\x0b]+"
_BLANKS = " \t\r\f\x0b"


def expected_equal(d: float) -> float:
    """Expected number of equal lanes for d differing paragraphs."""
    return PER_LEVEL * sum((1.0 - 2.0 ** -min(j + 1, LEVELS - 1)) ** d for j in range(LEVELS))


def difference_table() -> list[float]:
    """For 0 to LANES equal lanes: the number of differing paragraphs that makes this expected.

    Bisected; at least 1 where a lane differs, rounded to 6 digits.
    """
    out = []
    for equal in range(LANES + 1):
        lo, hi = 1.0, 1e9
        for _ in range(100):
            mid = (lo * hi) ** 0.5
            lo, hi = (mid, hi) if expected_equal(mid) > equal else (lo, mid)
        out.append(round(lo, 6))
    out[0] = 1e9
    return out


def paragraphs(text: Column) -> Column:
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "$1\n"), "\n")
    return F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(_BLANKS))), lambda p: p != "")


def with_fingerprint(df: DataFrame, text: str, lanes: str) -> DataFrame:
    """Adds ``lanes``: array of the paragraph count and the lane sums (longs); a column of that name gives way."""
    kept = [c for c in df.columns if c != lanes]
    tag = free_tag(df.columns)
    units, hashes, words = f"{tag}units", [f"{tag}sha_{k}" for k in range(len(SALTS))], [f"{tag}word_{k}" for k in range(WORDS)]
    out = df.withColumn(units, paragraphs(F.col(text)))
    names = [f"`{c}`" for c in kept]
    out = out.selectExpr(*names, units, *[f"transform({units}, p -> sha2(concat('{salt}', p), 256)) AS {h}" for h, salt in zip(hashes, SALTS)])
    out = out.selectExpr(*names, f"array(CAST(size({units}) AS BIGINT) % {COUNT_MOD}L) AS {tag}count",
                         *[f"transform({hashes[k // 4]}, h -> CAST(conv(substring(h, {1 + 15 * (k % 4)}, 15), 16, 10) AS BIGINT)) AS {w}"
                           for k, w in enumerate(words)])
    # low levels: sums of the words that reach a level or a higher one; what is left is halved from level to level
    left = [f"{tag}left_{k}" for k in range(PER_LEVEL)]
    total = [f"aggregate({w}, 0L, (a, x) -> a + {VALUE}) % {LANE_MOD}L" for w in words for _ in range(2)]
    held, parts = [words[k // 2] for k in range(PER_LEVEL)], [f"{tag}count"]
    for level in range(LOW + 1):
        sums = total if not level else [f"aggregate({w}, 0L, (a, x) -> a + {VALUE}) % {LANE_MOD}L" for w in left]
        rest = left if level == LOW else [f"filter({h}, x -> (x & {1 << place(k, level)}L) = 0L) AS {w}" for k, (h, w) in enumerate(zip(held, left))]
        out = out.selectExpr(*names, *parts, f"array({', '.join(sums)}) AS {tag}level_{level}", *rest)
        held = left
        parts.append(f"{tag}level_{level}")
    # the few words beyond them, in one list: lane and value of each, and what a lane's own sum up to
    def zeros(k):
        bits = f"(shiftright(x, {place(k, 0)}) | {1 << LEVELS - 1}L)"
        return f"bit_count(({bits} & -{bits}) - 1L)"

    places = [f"transform({w}, x -> shiftleft(({zeros(k)} - {LOW}) * {PER_LEVEL}L + {k}L, 16) | {VALUE})" for k, w in enumerate(left)]
    out = out.selectExpr(*names, *parts, f"concat({', '.join(places)}) AS {tag}high")
    high = (f"transform(sequence(0L, {(LEVELS - LOW) * PER_LEVEL - 1}L), l -> IF(size({tag}high) = 0, 0L, "
            f"aggregate(filter({tag}high, y -> shiftright(y, 16) = l), 0L, (a, y) -> a + (y & 65535L)) % {LANE_MOD}L))")
    own = [F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(LANE_MOD))) for a, b in zip(parts[1:-1], parts[2:])]
    return out.select(*names, F.concat(parts[0], *own, F.expr(high)).alias(lanes))


#: SQL of the value of a word x: the bits above its two choices of a level.
VALUE = f"(shiftright(x, {2 * LEVELS}) & {(1 << VALUE_BITS) - 1}L)"


def place(lane: int, bit: int) -> int:
    """Place in a word of a bit of a lane's choice of its level."""
    return LEVELS * (lane % 2) + bit


def as_text(lanes: Column) -> Column:
    """8 hexadecimal digits of the count and 4 of each lane."""
    digits = F.transform(lanes, lambda v, i: F.lpad(F.lower(F.hex(v)), F.when(i == 0, 8).otherwise(4), F.lit("0")))
    return F.array_join(digits, "")


def insert(lanes: Column, more: Column) -> Column:
    """Fingerprint of the union of two multisets."""
    return F.zip_with(F.transform(lanes, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), more,
                      lambda a, b: F.pmod(a["v"] + b, F.when(a["i"] == 0, COUNT_MOD).otherwise(LANE_MOD)))


def delete(lanes: Column, less: Column) -> Column:
    """Fingerprint after the paragraphs of ``less`` are taken away."""
    return F.zip_with(F.transform(lanes, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), less,
                      lambda a, b: F.pmod(a["v"] - b, F.when(a["i"] == 0, COUNT_MOD).otherwise(LANE_MOD)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common paragraphs of two fingerprints, 0 to 1."""
    equal = F.size(F.filter(F.slice(F.zip_with(a, b, lambda x, y: x == y), 2, LANES), lambda same: same))
    table = F.expr("array(" + ", ".join(f"{d!r}D" for d in difference_table()) + ")")
    d = F.greatest(F.element_at(table, equal + 1), F.abs(a[0] - b[0]).cast("double"))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - d / F.greatest(a[0] + b[0], F.lit(1))))


def with_next(df: DataFrame, key: str, value: str, per_bucket: int = 4096) -> tuple[DataFrame, Window]:
    """Rows of (key, value) with their successor at hand, in one exchange.

    Rows are cut into buckets of neighbouring keys (about ``per_bucket`` rows
    where keys are evenly spread), and a bucket also gets the first row of the
    next bucket, the last one the first row of all.  Returns the frame, with
    ``_own`` false for these visitors, and the window of a bucket: ``lead`` over
    it gives the successor.  Order: key, then value; null keys come first.
    """
    bounds = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = bounds["lo"] or 0, bounds["hi"] or 0
    stride = max(1, -(-(hi - lo + 1) * per_bucket // max(1, bounds["n"])))
    cut = df.select(key, value, F.coalesce(F.floor((F.col(key) - F.lit(lo)) / F.lit(stride)), F.lit(-1)).cast("long").alias("_bucket"))
    # one row per bucket; the bucket before it, found within 4096 buckets and then between those
    heads = cut.groupBy("_bucket").agg(F.min(key).alias("_head")).withColumn("_group", F.floor(F.col("_bucket") / 4096))
    groups = heads.groupBy("_group").agg(F.max("_bucket").alias("_last")).select(
        "_group", F.lag("_last").over(Window.orderBy("_group")).alias("_before_group"))
    inside = F.lag("_bucket").over(Window.partitionBy("_group").orderBy("_bucket"))
    heads = (heads.withColumn("_before", inside).join(groups, "_group")
             .select("_head", F.coalesce("_before", "_before_group").alias("_to")).where(F.col("_head").isNotNull()))
    last = cut.groupBy().agg(F.max("_bucket").alias("_to"), F.min(key).alias("_head")).where(F.col("_head").isNotNull())
    visits = (heads.where(F.col("_to").isNotNull()).select("_head", "_to", F.lit(1).alias("_late"))
              .unionByName(last.select("_head", "_to", F.lit(2).alias("_late")))
              .groupBy("_head").agg(F.collect_list(F.struct("_to", "_late")).alias("_visits")))   # two at most
    # written first, so that its size is known and a small one is broadcast before texts are exchanged for the join
    visits = materialise(visits, "bucket-heads")
    own = F.array(F.struct(F.col("_bucket").alias("_to"), F.lit(0).alias("_late")))
    spread = (cut.join(visits, F.col(key) == F.col("_head"), "left")
              .select(key, value, F.explode(F.concat(own, F.coalesce("_visits", F.array().cast("array<struct<_to:bigint,_late:int>>")))).alias("_p"))
              .select(key, value, F.col("_p._to").alias("_bucket"), F.col("_p._late").alias("_late")))
    window = Window.partitionBy("_bucket").orderBy("_late", F.col(key).asc_nulls_first(), value)
    return spread.withColumn("_own", F.col("_late") == 0), window
