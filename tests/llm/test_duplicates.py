"""SimHash classes, components and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabprism.llm import repeats, simhash
from tabprism.llm.components import components


def slow_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(nodes, linked):
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(nodes))]


def test_fingerprint_matches_the_rule_and_spark(spark, edge_docs):
    for r in edge_docs.select("text").collect():
        assert simhash.fingerprint(r["text"] or "", 3) == slow_fingerprint(r["text"], 3)
    assert spark.sql("select xxhash64('ab cd ef') h").first()["h"] % 2**64 == xxhash.xxh64_intdigest(b"ab cd ef", 42)


def check_links(spark, values, max_bits, bucket):
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), max_bits, bucket).collect()}
    want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits}
    assert got == want


def test_links_are_complete(spark):
    r = random.Random(4)
    values = set()
    for _ in range(12):
        seed = r.getrandbits(64)
        values.add(seed)
        for _ in range(12):
            v = seed
            for b in r.sample(range(64), r.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    for max_bits in (0, 1, 2, 3):
        check_links(spark, values, max_bits, 64)


def test_links_in_full_buckets(spark):
    """Many fingerprints share a segment: they are indexed again inside the bucket."""
    r = random.Random(6)
    values = {(0xABCDEF01 << 32) | (r.getrandbits(9) << 5) for _ in range(120)} | {(r.getrandbits(8) << 40) | 7 for _ in range(60)}
    check_links(spark, values, 2, 8)


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)]
    edges += [(300, i) for i in range(301, 340)] + [(5, 5), (None, 3)]
    got = {x["vertex"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({v for e in edges for v in e if v is not None})
    real = {frozenset(e) for e in edges if None not in e}
    root = dict(zip(nodes, slow_classes(nodes, lambda a, b: frozenset((a, b)) in real)))
    least = {}
    for n in nodes:
        least.setdefault(root[n], n)
    assert got == {n: least[root[n]] for n in nodes if least[root[n]] != n}


def test_near_duplicate_classes(spark, edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"], 3) for r in rows]
    roots = slow_classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, c in zip(rows, roots):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, roots))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(no_docs).collect() == []


def slow_removed(rows, length):
    out = []
    for i, (key, text) in enumerate(rows):
        raw = (text or "").encode()
        key = repeats.NO_ID if key is None else key
        smaller = [(t or "").encode() for k, t in rows if (repeats.NO_ID if k is None else k) < key]
        known = {t[s:s + length] for t in smaller for s in range(len(t) - length + 1)}
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if raw[s:s + length] in known:
                gone[s:s + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((rows[i][0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_covered_windows():
    r = random.Random(1)
    for _ in range(150):
        n = r.choice([3, 5, 8, 12])
        parts = [bytes(r.choice(b"ab") for _ in range(r.randint(n, 24))) for _ in range(r.randint(2, 6))]
        keys = np.array([r.randint(0, 4) for _ in parts])
        got = repeats.covered_windows(parts, keys, n)
        for i, p in enumerate(parts):
            assert got[i].tolist() == [s for s in range(len(p) - n + 1)
                                       if any(keys[j] < keys[i] and p[s:s + n] in parts[j] for j in range(len(parts)))]


def test_common_prefixes():
    r = random.Random(8)
    for _ in range(50):
        text = np.array([r.choice([1, 2, 3]) for _ in range(40)] + [0], np.uint16)
        order = repeats.bounded_suffix_order(text, 10)
        got = repeats.common_prefixes(text, order, 10)
        s = [bytes(text[i:].astype(np.uint8)) for i in order]
        for j in range(1, len(s)):
            common = 0
            while common < 10 and common < min(len(s[j]), len(s[j - 1])) and s[j][common] == s[j - 1][common]:
                common += 1
            assert got[j] == common


def test_repeats_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    got = repeats.remove_repeats(edge_docs, with_kept=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == slow_removed(rows, 50)
    assert repeats.remove_repeats(no_docs).collect() == []


def test_repeats_random_passages(spark):
    r = random.Random(11)
    passages = ["".join(r.choice("abcd éü.") for _ in range(r.randint(40, 160))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            a = r.randint(0, 20)
            p = p[a:] if r.random() < 0.5 else p[:len(p) - a]
            parts.append(p if r.random() < 0.8 else p[:30] + "#" + p[30:])
            parts.append("".join(r.choice("xyz") for _ in range(r.randint(0, 30))))
        rows.append((r.randint(0, 50), "".join(parts)))
    rows += [(60 + i, "ab" * 200) for i in range(3)] + [(70, "ab" * 90 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.remove_repeats(df, bytes_per_task=3000).collect()
    assert Counter(tuple(r) for r in got) == slow_removed(rows, 50)


def test_long_text_is_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 400)
    r = random.Random(2)
    raw = bytes(r.choice(b"abcdefgh") for _ in range(3000))
    windows = []
    for _, _, _, first, last in repeats.text_contexts([raw, b"tiny", raw[:350]], 50):
        windows += [s for f, e in zip(first, last) for s in range(f, e + 1)]
    assert Counter(windows) == Counter([*range(2951), *range(301)])


def test_kept_texts(spark):
    shared = "this passage of more than fifty bytes stands in several documents. "
    df = spark.createDataFrame([(1, "one " + shared + "1"), (2, "two " + shared + "2"), (3, "three")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df, with_kept=True).collect()}
    assert bytes(got[2]["kept"]) == b"two2" and got[2]["n_spans"] == 1 and got[1]["n_removed"] == 0
    assert F is not None


def test_unpaired_contexts_are_told_apart():
    """A context stays if another of its anchor has the same bytes on one side, long enough for a common string."""
    anchor, r = b"0123456789abcdef", random.Random(12)

    def noise(n):
        return bytes(r.randint(1, 255) for _ in range(n))

    def row(left, right):
        return len(left).to_bytes(2, "little") + left + anchor + right

    left, right = noise(34), noise(34)
    rows = [row(left, noise(34)), row(left, noise(34)), row(noise(17) + left[17:], noise(20)), row(noise(18) + left[18:], noise(34)),
            row(noise(34), right), row(noise(30), right[:17] + noise(9)), row(noise(34), right[:16] + noise(18)), row(b"", right), row(left[-5:], b"")]
    h = np.zeros(len(rows), np.int64)
    assert repeats.paired(h, rows, 50).tolist() == [True, True, True, False, True, True, False, True, False]
    assert not repeats.paired(np.arange(len(rows)), rows, 50).any()
    assert repeats.paired(h[:0], [], 50).tolist() == []
