"""Packing, archives, URL rules, mixing and multiset hashes against brute force and round trips."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprism.llm import mixing, multiset_hash, packing, queries, url_rules, warc
from tabprism.llm.common import materialise
from tabprism.sources.scratch import scratch_path

# ---- packing


@pytest.fixture(scope="session")
def path():
    return queries.tokenizer_path()


def test_ids_equal_the_tokenizer(path):
    made = packing.BytePairIds(path)
    texts = ["", "a  b", "a\nb \n c", "it's don't I'M 12,345.6", " é\u00a0ü ß", "日本語 テスト", "<|endoftext|> x", "a\r\n\tb  ", "\x1c\x85 z",
             "x" * 3000, "Ünï çødé ½ ²", "\x00"]
    for t in texts:
        ids = made.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(made.encode(t), made.dtype).tolist() == ids, t


def test_hilbert_curve_is_a_walk_through_all_cells():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = packing.hilbert_index(cells, bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_tail_cuts():
    for total in (0, 1, 5, 2047, 2048, 2049, 5000):
        cuts = packing.tail_cuts(total, 2048)
        at = total - total % 2048
        assert (cuts or [at])[-1] == total
        for c in cuts:
            assert (c - at) & (c - at - 1) == 0
            at = c


def check_pieces(pieces, rows, path, length):
    made = packing.BytePairIds(path)
    want = Counter((k, zlib.crc32(np.append(np.frombuffer(made.encode(t or ""), made.dtype), 1).astype("<u4").tobytes())) for k, t in rows)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        assert len(p["ids"]) == 4 * p["length"] > 0
    assert sorted(sequences) == list(range(len(sequences)))
    for got in sequences.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at
            at += n
        assert at == length or at < length and at & (at - 1) == 0
    # documents come back whole: pieces of one row meet in start and the stream's order
    stream = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    found, held = Counter(), b""
    for p in stream:
        assert p["start"] * 4 == len(held)
        held += bytes(p["ids"])
        if len(held) == 4 * p["doc_tokens"]:
            found[p["doc_id"], zlib.crc32(held)] += 1
            held = b""
    assert found == want and not held


def test_packing_edges(edge_docs, no_docs, path):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    check_pieces(packing.pack(edge_docs, path, length=64).collect(), rows, path, 64)
    assert packing.pack(no_docs, path).collect() == []


def test_neighbours_share_words(spark, path):
    """Documents of one vocabulary lie closer on the curve than by chance."""
    r = random.Random(1)
    topics = [[f"{a}{b}" for a in x for b in ("alo", "ert", "iny", "orp")] for x in ("bcdf", "ghjk", "lmnp", "qrst")]
    rows = [(i, " ".join(r.choice(topics[i % 4]) for _ in range(150))) for i in range(200)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, length=4096).collect()
    order = [p["doc_id"] % 4 for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
    assert np.mean([a == b for a, b in zip(order, order[1:])]) > 0.5


# ---- archives

PAGE = "page_id long, url string, html string, type string, _sum string"


def pages_frame(spark):
    long = "<html>" + "x" * 1200 + "é</html>"
    rows = [(1, "http://a.example.com/x", long), (2, "http://a.example.com/y", long), (9, None, long), (3, "u\r\nX: y", "short"),
            (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "v", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40),
            (None, "w", "y" * 2000), (None, "w", "y" * 2000), (8, "z", "q" * 3000), (8, "z", "q" * 3000), (10, "z", "z\n" * 100_000)]
    return spark.createDataFrame([(*r, "t", "s") for r in rows], PAGE).repartition(3)


def test_archive_round_trip(spark):
    pages = pages_frame(spark)
    where = warc.write_warc(pages, scratch_path(spark, "warc-test"), records_per_file=4)
    records = warc.read_warc(spark, where)
    assert {r["type"]: r["n"] for r in records.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        "request": 13, "metadata": 13, "response": 11, "revisit": 2}
    captures = materialise(warc.assemble(records), "captures")
    assert captures.where("request is null or metadata is null").count() == 0
    by = defaultdict(list)
    for r in warc.resolve_revisits(captures).collect():
        by[r["page_id"]].append(tuple(r)[1:])
    for row in pages.collect():
        body = (row["html"] or "").encode()
        first = 9 if row["page_id"] in (1, 2) else None
        assert (len(body), hashlib.sha1(body).hexdigest(), "revisit" if first else "response", first) in by[row["page_id"]]
    assert {k: len(v) for k, v in by.items()} == {**{i: 1 for i in (1, 2, 9, 3, 4, 5, 6, 7, 10)}, None: 2, 8: 2}
    stored = {r["page_id"]: bytes(r["payload"]) for r in captures.where("response.payload is not null").select(
        F.col("metadata.page_id").cast("long").alias("page_id"), "response.payload").collect()}
    assert stored[7] == pages.where("page_id = 7").first()["html"].encode()


def test_assembly_joins_no_payloads(spark, monkeypatch):
    """Length and digest of a payload are taken before the joins: no input of a join holds the payload."""
    where = warc.write_warc(pages_frame(spark), scratch_path(spark, "warc-narrow"))
    read = []
    monkeypatch.setattr(warc, "materialise", lambda df, name: read.append(df) or materialise(df, name))
    assert warc.resolve_revisits(warc.assemble(warc.read_warc(spark, where))).count() == 13

    def nodes(plan):
        return [plan, *(n for i in range(plan.children().size()) for n in nodes(plan.children().apply(i)))]

    joins = [n for n in nodes(read[0]._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert len(joins) == 2
    for side in (j.children().apply(i) for j in joins for i in (0, 1)):
        assert "binary" not in side.schema().catalogString()


def test_archive_of_nothing(spark):
    where = warc.write_warc(spark.createDataFrame([], PAGE), scratch_path(spark, "warc-none"))
    assert warc.resolve_revisits(warc.assemble(warc.read_warc(spark, where))).collect() == []


def test_record_parser_refuses_damage():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [bytes(r["block"]) for r in warc.parse_records(good * 2)] == [b"abc", b"abc"]
    assert warc._inflate(gzip.compress(good) + gzip.compress(good)) == good * 2
    for bad in (good[:-5], b"junk" + good, good.replace(b"3\r", b"7\r")):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


# ---- URL rules

def slow_verdict(url, patterns):
    import re
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match("[^/?#]*", rest).group() if rest is not None else ""
    path = re.match("[^/?#]*([^?#]*)", rest).group(1) if rest is not None else ""
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = sorted((-len(h + p), h + p, v) for h, p, v in queries.HOST_RULES
                  if (host == h or host.endswith("." + h)) and path.startswith(p))
    low = "".join(c.lower() if c.isascii() else c for c in url) if url else ""
    hits = [url_rules.compile_pattern(p) for p in patterns]
    hits = [ex for rx, _, ex in hits if url and re.search(rx, low)]
    verdict = fits[0][2] if fits else "allow" if True in hits or not hits else "block"
    return host, path, fits[0][1] if fits else None, verdict


def test_url_rules(spark):
    patterns = [*queries.PATTERN_RULES, "*track*er*", "|ftp://", "swf|", "/ad^", "@@/ad^good"]
    urls = ["http://Example.NET/en/1", "https://www.example.net/fr/", "http://xnet/a", "http://net/", "https://net", "http://a.example.com/de/x",
            "https://b.org/fr/q?x#y", "http://www.casino-win.example.com/a", "http://casino-wins.example.com", "http://spam-farm.example.org/es/1",
            "http://spam-farm.example.org/de/1", "no scheme casino-win.", "", None, "http://h.com/banner/ads/x", "http://h.com/x?a=1&affid=3&clickid=9",
            "http://h.com/trackxer", "ftp://h.com/", "http://h.com/a.swf", "http://h.com/ad?x", "http://h.com/ad/good", "http://h.com/add",
            "http://É.org/fr/", "http://h.com/" + "a/" * 5000 + "ad", "://", "http://h\n.com/ad/x", "http://h.com/a.swf"]
    df = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)], "page_id long, url string, rule string, _url string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_rules.judge_urls(df, "page_id", "url", queries.HOST_RULES, patterns).collect()}
    assert got == {i: slow_verdict(u, patterns) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(df.limit(0), "page_id", "url", queries.HOST_RULES, patterns).collect() == []
    assert {r["verdict"] for r in url_rules.judge_urls(df, "page_id", "url", [], []).collect()} == {"allow"}


def test_hosts_of_very_many_labels(spark):
    hosts = ["a." * 100_000 + "example.net", "a." * 100_000 + "xexample.net", "example.net" + ".a" * 100_000]
    df = spark.createDataFrame([(i, f"http://{h}/en/x") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r["page_id"]: (len(r["host"]), r["rule"], r["verdict"]) for r in
           url_rules.judge_urls(df, "page_id", "url", queries.HOST_RULES, queries.PATTERN_RULES).collect()}
    assert got == {0: (200_011, "example.net/en/", "allow"), 1: (200_012, "net/", "block"), 2: (200_011, None, "allow")}


def test_pattern_tokens():
    assert url_rules.compile_pattern("||cheap-pills.")[1] == ["cheap", "pills"]
    assert url_rules.compile_pattern("ads*foo/bar")[1] == []
    assert url_rules.compile_pattern("/ads*foo/bar^")[1] == ["bar"]
    assert url_rules.compile_pattern("|http://x|")[1] == ["http", "x"]


# ---- mixing

def mix_frame(spark):
    r = random.Random(3)
    rows = [(i, "big" if i < 600 else f"s{i % 5}", " ".join("w" for _ in range(r.randint(1, 30)))) for i in range(900)]
    rows += [(None, None, "x y z"), (1000, None, "x y z"), (1001, "none", None), (1002, "none", ""), (5, "big", "a b"), (5, "big", "a b")]
    return spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, source string, text string, weight double, _copies int")


def test_mix_meets_its_targets(spark):
    df = mix_frame(spark)
    for entropy, limit in ((0.9, None), (None, 1.5), (0.98, 2.0)):
        rows = mixing.mix_sources(df, target_entropy=entropy, max_repeats=limit, blocks=64).collect()
        weight = {r["source"]: r["mix_weight"] for r in rows if r["mix_weight"] > 0}
        epochs = {r["source"]: r["mix_epochs"] for r in rows if r["mix_weight"] > 0}
        assert sum(weight.values()) == pytest.approx(1)
        h = -sum(w * math.log(w) for w in weight.values()) / math.log(len(weight))
        ratio = max(epochs.values()) / min(epochs.values())
        if entropy and not limit:
            assert h == pytest.approx(entropy, abs=1e-4)
        if limit:
            assert ratio <= limit * (1 + 1e-6)
            assert ratio == pytest.approx(limit, rel=1e-4) or entropy is not None and h >= entropy - 1e-6
        # every row at least once, no more than the epochs rounded up; emitted tokens near the quota
        seen = Counter(r["doc_id"] for r in rows)
        assert set(seen) == {r["doc_id"] for r in df.select("doc_id").collect()}
        sizes = defaultdict(int)
        for r in df.collect():
            sizes[r["source"]] += len((r["text"] or "").split())
        emitted = defaultdict(int)
        for r in rows:
            assert r["mix_tokens"] == len((r["text"] or "").split())
            assert r["mix_epoch"] < math.ceil(r["mix_epochs"] - 1e-9)
            emitted[r["source"]] += r["mix_tokens"]
        for s, e in epochs.items():
            assert emitted[s] == pytest.approx(e * sizes[s], abs=max(60, 0.05 * sizes[s]))


def test_mix_emits_block_permutations(spark):
    """Row by row: every epoch of a source is its blocks in the order of that epoch, the last one cut where it comes nearest to the quota."""
    df = mix_frame(spark)
    blocks, seed = 64, 17
    tokens = {}
    block = {r["doc_id"]: r["b"] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).alias("b")).collect()}
    got = defaultdict(list)
    for r in mixing.mix_sources(df, target_entropy=0.9, max_repeats=None, blocks=blocks).collect():
        got[r["source"]].append(r)
        tokens[r["source"]] = r["mix_epochs"]
    inputs = defaultdict(list)
    for r in df.collect():
        inputs[r["source"]].append((r["doc_id"], len((r["text"] or "").split())))
    assert set(got) == set(inputs)
    for source, rows in got.items():
        held = inputs[source]
        total, epochs = sum(n for _, n in held), tokens[source]
        by_block = defaultdict(int)
        for k, n in held:
            by_block[block[k]] += n
        for epoch in range(math.ceil(epochs - 1e-9)):
            mine = [r for r in rows if r["mix_epoch"] == epoch]
            places = {}
            for r in mine:      # a block has one place in an epoch, and another in the next
                assert places.setdefault(block[r["doc_id"]], r["mix_position"]) == r["mix_position"]
            assert len(set(places.values())) == len(places)
            if epoch < math.floor(epochs + 1e-9):
                assert Counter(r["doc_id"] for r in mine) == Counter(k for k, _ in held)
                continue
            # the cut epoch: whole blocks, and one more or one less is not nearer to the quota
            assert Counter(r["doc_id"] for r in mine) == Counter(k for k, _ in held if block[k] in places)
            rest = (epochs - math.floor(epochs)) * total
            taken = sum(by_block[b] for b in places)
            last = by_block[max(places, key=places.get)] if places else 0
            assert taken - last / 2 <= rest + 1e-6
            if len(places) < len(by_block):
                assert taken + max(n for b, n in by_block.items() if b not in places) / 2 >= rest - 1e-6


def test_mix_budget_and_edges(spark, edge_docs, no_docs):
    df = mix_frame(spark)
    rows = mixing.mix_sources(df, target_entropy=None, max_repeats=None, budget=4000, blocks=64).collect()
    assert sum(r["mix_tokens"] for r in rows) == pytest.approx(4000, rel=0.1)
    assert mixing.mix_sources(no_docs).collect() == []
    got = mixing.mix_sources(edge_docs).collect()
    assert Counter(r["doc_id"] for r in got if r["mix_epoch"] == 0) == Counter(r["doc_id"] for r in edge_docs.collect())
    assert all(r["weight"] == 4 and r["row"] == 1 for r in got)


def test_word_count(spark):
    import re
    texts = ["", None, " ", "a", " a b ", "\t\na\r\n", "a\x0bb\x0c", "é ü\u00a0x", "a  b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n")).collect()
    for r in got:
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["t"] or ""))


# ---- multiset hash

def slow_print(text):
    import re
    pieces = re.sub(r"([.!?])[ \t\r\f\x0b]+", "\\1\n", text or "").split("\n")
    units = [u for u in (p.strip(" \t\r\f\x0b") for p in pieces) if u]
    lanes = [0] * 320
    for u in units:
        digits = [hashlib.sha256(salt + u.encode()).hexdigest()[:60] for salt in (b"", b"1")]
        words = [int(d[15 * k:15 * k + 15], 16) for d in digits for k in range(4)]
        for lane in range(320):
            level, word = lane // 16, words[lane % 16 // 2]
            bits = word >> 20 * (lane % 2) & 0xFFFFF
            if bits % (1 << level) == 0 and (level == 19 or bits >> level & 1):
                lanes[lane] += word >> 40 & 0x7FFF
    return f"{len(units):08x}" + "".join(f"{v % 65536:04x}" for v in lanes)


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r["i"]: (r["p"], r["f"]) for r in multiset_hash.with_fingerprint(df, "t", "f").select(
        "i", "f", multiset_hash.as_text(F.col("f")).alias("p")).collect()}


def test_fingerprint_rule(spark, edge_docs):
    texts = [r["text"] for r in edge_docs.select("text").collect()]
    got = prints(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == [slow_print(t) for t in texts]


def test_order_insertion_and_deletion(spark):
    a, b = ["one line.", "two", "two", "three!"], ["four", "one line."]
    df = multiset_hash.with_fingerprint(spark.createDataFrame([("\n".join(a), "\n".join(b), "\n".join([*b, *a][::-1]))], "a string, b string, c string"), "a", "fa")
    for c in "bc":
        df = multiset_hash.with_fingerprint(df, c, f"f{c}")
    r = df.select("fa", "fb", "fc", multiset_hash.insert(F.col("fa"), F.col("fb")).alias("sum"),
                  multiset_hash.delete(F.col("fc"), F.col("fb")).alias("rest")).first()
    assert r["sum"] == r["fc"] and r["rest"] == r["fa"] != r["fb"]


def test_likeness_follows_common_paragraphs(spark):
    r = random.Random(5)
    lines = [f"paragraph {r.getrandbits(60)}" for _ in range(400)]
    for share in (0.0, 0.5, 0.9, 1.0):
        values = []
        for n in (20, 60, 150):
            same = int(n * share)
            df = spark.createDataFrame([("\n".join(lines[:n]), "\n".join(lines[:same] + [f"new {i}" for i in range(n - same)]))], "a string, b string")
            df = multiset_hash.with_fingerprint(multiset_hash.with_fingerprint(df, "a", "fa"), "b", "fb")
            values.append(df.select(multiset_hash.likeness(F.col("fa"), F.col("fb")).alias("v")).first()["v"])
        assert all(0 <= v <= 1 for v in values) and np.mean(values) == pytest.approx(share, abs=0.2)
        assert share < 1 or values == [1.0] * 3


def test_likeness_of_long_texts(spark):
    """Texts that share half of their paragraphs, whatever their length."""
    r = random.Random(14)
    rows = []
    for n in (150, 500, 2_000, 20_000):
        common = [f"shared {r.getrandbits(60)}" for _ in range(n // 2)]
        a, b = ("\n".join(common + [f"{side} {r.getrandbits(60)}" for _ in range(n // 2)]) for side in "ab")
        rows.append((n, a, b))
    df = spark.createDataFrame(rows, "n int, a string, b string").repartition(4)
    df = multiset_hash.with_fingerprint(multiset_hash.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = {x["n"]: x["v"] for x in df.select("n", multiset_hash.likeness(F.col("fa"), F.col("fb")).alias("v")).collect()}
    assert all(abs(v - 0.5) <= 0.15 for v in got.values()), got


def test_successors(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in edge_docs.select("doc_id", "text").collect()]
    rows += [(10**6 + 7 * i, f"far {i}") for i in range(30)] + [(-5, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    named = next(r for r in ordered if r[0] is not None)
    want = Counter((a, b[1]) for a, b in zip(ordered, [*ordered[1:], named]))
    for size in (1, 3, 4096):
        out, window = multiset_hash.with_next(df, "doc_id", "text", per_bucket=size)
        got = out.withColumn("next", F.lead("text").over(window)).where("_own").collect()
        assert Counter(((r["doc_id"], r["text"]), r["next"]) for r in got) == want
    assert multiset_hash.with_next(no_docs, "doc_id", "text")[0].collect() == []
