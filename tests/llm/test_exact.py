"""Grace hash deduplication against grouping by whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabprism.llm import exact


def slow_groups(rows):
    by = defaultdict(list)
    for key, text in rows:
        by[text or ""].append(key)
    out = Counter()
    for text, keys in by.items():
        top = max(keys, key=lambda k: (k is not None, k or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = True
        for k in sorted(keys, key=lambda k: k != top):
            out[k, top, len(keys), kept, digest] += 1
            kept = False        # one row of each group stays
    return out


def check(df, texts=False, **how):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = exact.find_groups(df, **how)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == slow_groups(rows)
    if not texts:
        return
    stay = Counter((r["doc_id"], r["text"]) for r in exact.deduplicate(df, **how).collect())
    assert stay == Counter((top, t) for t, top in
                           {t or "": max((k for k, u in rows if (u or "") == (t or "")), key=lambda k: (k is not None, k or 0))
                            for _, t in rows}.items())


def test_edges(edge_docs, no_docs):
    check(edge_docs, texts=True)
    check(edge_docs, table_bytes=150_000, merge=2)
    assert exact.find_groups(no_docs).collect() == []
    assert exact.deduplicate(no_docs).collect() == []


def copies(spark, n=1500):
    r = random.Random(11)
    texts = [f"text {i} " + "ab c" * r.randint(0, 40) for i in range(300)] + ["hot " * 30] * 250
    return spark.createDataFrame([(i, r.choice(texts), i) for i in range(n)], "doc_id long, text string, rep int").repartition(12)


def test_full_tables_spill_to_the_next_level(spark):
    """Tables of a few texts: several levels, spill files and merges of the hot text."""
    df = copies(spark)
    check(df, table_bytes=8_000, merge=100)
    check(df, table_bytes=40_000, fan_out=3, merge=100)


def test_hot_texts_are_merged_first(spark):
    df = copies(spark)
    found = exact.local_groups(df, "doc_id", "text", 3_000)
    reps = found.where(F.col("copies").isNotNull()).select(*exact.TRAVELS)
    most = reps.groupBy("h").count().agg(F.max("count").alias("m")).first()["m"]
    merged, maps = exact.merge_hot(reps, 1 << 20, merge=3)
    assert most > 10 and len(maps) > 1
    assert merged.groupBy("h").count().agg(F.max("count").alias("m")).first()["m"] <= 3
    assert merged.agg(F.sum("copies").alias("n")).first()["n"] == 1500


def test_table_compares_contents():
    """Equal hashes never make equal texts."""
    table = exact.Groups(1 << 20)
    assert [table.add(7, t, 1, k, k) for k, t in enumerate((b"a", b"b", b"a", b"", b"b"))] == [0, 1, 0, 2, 1]
    assert table.copies == [2, 2, 1] and [table.top(e) for e in range(3)] == [(2, 2), (4, 4), (3, 3)]
    for i in range(5000):
        assert table.add((7 + i % 3) << 40 | i % 97, b"%d" % i, 1, None, i) == 3 + i
    assert table.add(7, b"b", 1, 9, 9) == 1 and table.top(1) == (9, 9)
    full = exact.Groups(150)
    assert [full.add(h, t, 1, None, h) for h, t in ((1, b"x" * 99), (2, b"y"), (1, b"x" * 99), (3, b""))] == [0, None, 0, None]


def test_equal_hashes_end(spark, monkeypatch):
    """One hash for all texts: merging and the recursion still end, with right groups."""
    monkeypatch.setattr(exact, "content_hash", lambda body: 5)
    df = spark.createDataFrame([(i, f"t{i % 40}") for i in range(120)], "doc_id long, text string").repartition(3)
    check(df, table_bytes=8000, fan_out=1, merge=4)
