"""Cross-tokenizer alignment against token-by-token brute force."""

import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprism.llm import alignment, queries

PATHS = (queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*PATHS)


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


@lru_cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(PATHS[0])
    a_tok.encode_special_tokens = True
    return a_tok, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def slow_tokens(text):
    """(id, start, end) under both, straight from the libraries; none where bytes differ."""
    a_tok, b_tok = libraries()
    byte = {c: b for b, c in enumerate(alignment.byte_alphabet())}
    if not text:
        return [], []
    a = a_tok.encode(" " + text, add_special_tokens=False)
    b = b_tok.encode(text)
    a_bytes = [bytes(byte[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b_tok.id_to_piece, b)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], []
    return [(i, *s) for i, s in zip(a.ids, spans(a_bytes))], [(i, *s) for i, s in zip(b, spans(b_bytes))]


def slow_rows(rows):
    made, count = [], Counter()
    for key, text in rows:
        a, b = slow_tokens(text)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        shown, shared, low = [], 0, 0
        for c in cuts:
            ga, gb = [i for i, s, e in a if low < e <= c], [i for i, s, e in b if low < e <= c]
            shown.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            shared += len(ga) * len(gb)
            low = c
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e] if len(a) < 400 else near_links(a, b)
        count.update(links)
        made.append((key, len(a), len(b), len(cuts), len(links), shared, links, ";".join(shown)))
    top = defaultdict(int)
    for (i, j), n in count.items():
        top[j] = max(top[j], n)
    return Counter((k, na, nb, g, n, sh, sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(t.encode()).hexdigest() if t else "") for k, na, nb, g, n, sh, links, t in made)


def near_links(a, b):
    out, at = [], 0
    for i, s, e in a:
        while at and b[at - 1][2] > s:
            at -= 1
        while b[at][2] <= s:
            at += 1
        j = at
        while j < len(b) and b[j][1] < e:
            out.append((i, b[j][0]))
            j += 1
    return out


TEXTS = ["a  b", " lead", "it's don't I'M 12,345.6", "日本語 テスト und ½ ﬁ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ piece ▁", "a\r\n\tb  ",
         "\x00 \x1c\x85", "é é 👩‍👩‍👧 ௵", "x" * 500, "the cat the cat the cat", "Straße übermäßig électricité"]


def test_documents(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], (r["text"] or "")[:4000] if r["text"] else r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, block int, pair string").repartition(3)
    got = alignment.align(df, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]
    want = slow_rows(rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(n for r, n in want.items() if r[1] == 0) == 3 and sum(n for r, n in want.items() if r[5] > r[4]) > 5
    assert alignment.align(no_docs, *PATHS).collect() == []


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, TEXTS[i % len(TEXTS)] + " " + TEXTS[i * 7 % 5]) for i in range(40)]
    monkeypatch.setattr(alignment, "CHARACTERS", 30)
    monkeypatch.setattr(alignment, "BLOCK_ENTRIES", 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert alignment.count_pairs(df, "doc_id", "text", *PATHS).agg(F.countDistinct("block").alias("n")).first()["n"] > 5
    assert Counter(tuple(r) for r in alignment.align(df, *PATHS).collect()) == slow_rows(rows)


def test_long_text_whole(spark):
    text = "".join(chr(97 + i * i % 23) + " " * (i % 3 == 0) for i in range(60_000))
    got = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), *PATHS).collect()
    assert Counter(tuple(r)[:5] + tuple(r)[6:] for r in got) == Counter(
        k[:5] + k[6:] for k in slow_rows([(1, text)]))


def test_links(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kind in ("overlap", "shared"):
        for per_row in (3, 1000):
            got = defaultdict(list)
            for r in alignment.token_links(df, *PATHS, kind=kind, per_row=per_row).collect():
                got[r["doc_id"]] += zip(r["a"], r["b"], r["weight"])
            for key, text in rows:
                a, b = slow_tokens(text)
                if kind == "overlap":
                    want = [(i, j, min(e, v) - max(s, u)) for i, (_, s, e) in enumerate(a) for j, (_, u, v) in enumerate(b) if s < v and u < e]
                else:
                    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
                    want = [(i, j, 1) for i, (_, _, e) in enumerate(a) for j, (_, _, v) in enumerate(b)
                            if np.searchsorted(cuts, e) == np.searchsorted(cuts, v)]
                assert got[key] == want


def dense(m):
    out = np.zeros((m.rows, m.columns), int)
    out[m.row_of_entry(), m.indices] = m.data
    return out


def test_gustavson_equals_dense_products():
    r = np.random.default_rng(3)

    def sparse(rows, columns, share):
        d = r.integers(1, 5, (rows, columns)) * (r.random((rows, columns)) < share)
        return alignment.SparseRows(np.concatenate([[0], np.cumsum((d > 0).sum(1))]), np.nonzero(d)[1], d[d > 0], columns)

    for n, k, m, share in ((5, 4, 6, 0.5), (30, 20, 10, 0.2), (3, 3, 3, 0.0), (0, 4, 2, 0.5), (4, 0, 2, 0.5), (1, 50, 1, 0.9)):
        a, b = sparse(n, k, share), sparse(k, m, share)
        made = alignment.gustavson(a, b)
        assert (dense(made) == dense(a) @ dense(b)).all() and made.rows == n
        assert (np.diff(made.indptr) <= alignment.product_sizes(a, b)).all()
        assert (dense(a.transposed()) == dense(a).T).all()
        if n > 2:
            assert (dense(a.some_rows(1, 3)) == dense(a)[1:3]).all()


def test_ids_equal_the_libraries(pair):
    for t in TEXTS + ["", None]:
        a, b = pair.ids(t or "")
        assert ([i for i, *_ in slow_tokens(t)[0]], [i for i, *_ in slow_tokens(t)[1]]) == (a.tolist(), b.tolist())
