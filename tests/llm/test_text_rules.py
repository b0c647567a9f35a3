"""Quality rules, personal data and the quality classifier against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprism.llm import line_rules, nbsvm, semicrf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in lines
            lines.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered))


def test_base_counts(edge_docs):
    rows = edge_docs.select("text").collect()
    got = line_rules.judge_documents(edge_docs).collect()
    assert Counter(tuple(r[c] for c in line_rules.BASE) for r in got) == Counter(slow_counts(r["text"]) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_repeated_words_property():
    r = random.Random(3)
    for _ in range(200):
        words = [r.choice("abc") for _ in range(r.randint(0, 25))]
        assert line_rules.repeated_words([w.encode() for w in words]) == slow_counts(" ".join(words))[4]


def test_line_frequency_counts_distinct_texts_per_host(spark):
    body = " ".join(f"w{i}" for i in range(60))
    boiler = " ".join(f"menu{i}" for i in range(200))
    rows = [(i, f"{boiler}\n{body} {i}", "a") for i in range(5)]          # five texts share the line on host a
    rows += [(10 + i, f"{boiler}\nMENU other {i} {body}", "b") for i in range(2)]
    rows += [(20 + i, body + " same", "c") for i in range(9)]              # copies of one text count once
    rows += [(30, f"{boiler.upper()}\n{body} up", "a")]                    # lines are compared with A-Z lowered
    got = {r["doc_id"]: r for r in line_rules.judge_documents(
        spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs_per_host=4).collect()}
    assert [got[i]["removed_words"] for i in range(5)] == [200] * 5 and not any(got[i]["kept"] for i in range(5))
    assert got[30]["removed_words"] == 200
    assert all(got[i]["kept"] and got[i]["removed_words"] == 0 for i in (10, 11, *range(20, 29)))


def test_quality_rules_empty(no_docs):
    assert line_rules.judge_documents(no_docs).collect() == []


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True,
                  k == 2 and 14 <= len(digits) <= 19 and semicrf.luhn(digits), 10 <= len(digits) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_random():
    r = random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice("ab1234@.+-() \n_9é") for _ in range(r.randint(0, 60)))
        assert semicrf.base_spans(text) == slow_spans(text), text


def test_base_spans_long_runs_are_linear():
    assert semicrf.base_spans("a" * 300_000 + "1" * 300_000 + "@" * 1000) == []


def test_field_adds_forms_the_patterns_miss(spark):
    r = random.Random(2)
    rows = []
    for i in range(60):
        d = "".join(r.choice("23456789") for _ in range(10))
        rows.append((i, f"call us on +1 ({d[:3]}) {d[3:6]}-{d[6:]} or write to u{i}@mail{i}.example.com today, "
                        f"room {r.randint(1, 900)} of {r.randint(1000, 90000)} in 2024-0{i % 9 + 1}-11, token = \"{'%040x' % r.getrandbits(160)}\""))
    w = semicrf.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    base, spans = semicrf.all_spans("the phone (415) 555-2671 is old and room 512 of 7000 is not", w)
    assert base == [] and spans == [(10, 3, 24)]
    base, spans = semicrf.all_spans("a token = \"24be64439e3e49cf46b2d7c90f3602a3\" here", w)
    assert [semicrf.KINDS[k] for _, k, _ in spans] == ["secret"]
    assert semicrf.all_spans("in 2023 there were 12 of 3,400 and 5.5 %", w)[1] == []


def test_decode_is_the_best_segmentation():
    """Dynamic programming against all segmentations of short zones."""
    r = random.Random(7)
    rng = np.random.default_rng(1)
    for _ in range(40):
        text = " ".join(r.choice(["12", "a@b", "x", "+1", "55-5"]) for _ in range(4))
        w = rng.normal(size=(len(semicrf.KINDS), semicrf.N_FEATURES))
        for tokens in semicrf.zones(text):
            first, last, feats = semicrf.candidates(text, tokens)
            gain = (feats @ w.T).max(1) if len(first) else np.zeros(0)

            def best(i):
                if i >= len(tokens):
                    return 0.0
                return max([best(i + 1)] + [gain[c] + best(last[c]) for c in range(len(first)) if first[c] == i])

            spans = {(tokens[first[c]][0], tokens[last[c] - 1][1]): gain[c] for c in range(len(first))}
            assert sum(spans[s, e] for s, _, e in semicrf.decode(text, tokens, w)) == pytest.approx(best(0))


def test_no_zone_cuts_a_span():
    """Zones, decoded in blocks, against the whole text as one zone: long lists, far marks, long words and gaps."""
    r = random.Random(11)
    rng = np.random.default_rng(4)
    words = ["call", "phone", ":", "mail", "room", "x" * 70, "y" * 200, " " * 90, "\n", "at", " dot ", "host"]
    for k in range(30):
        share = (0.02, 0.3, 0.95)[k % 3]
        text = " ".join(f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}" if r.random() < share / 2
                        else r.choice(["12.5", "a@b.cd", "4556 7375 8689 9855", "u@" + "z" * 90 + ".org"]) if r.random() < share
                        else r.choice(words) for _ in range(400))
        w = rng.normal(size=(len(semicrf.KINDS), semicrf.N_FEATURES))
        whole = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W_]+|\S", text)]
        first, last, feats = semicrf.candidates(text, whole)
        gain = (feats @ w.T).max(1) if len(first) else np.zeros(0)
        best = [0.0]
        ends = {}
        for c, j in enumerate(last.tolist()):
            ends.setdefault(j, []).append(c)
        for j in range(1, len(whole) + 1):
            best.append(max([best[-1], *(best[first[c]] + gain[c] for c in ends.get(j, []))]))
        value = {(whole[i][0], whole[j - 1][1]): g for i, j, g in zip(first.tolist(), last.tolist(), gain)}
        found = [s for begin, end in semicrf.zone_ranges(text) for s in semicrf.decode(text, semicrf.zone_tokens(text, begin, end), w)]
        assert all(a[2] <= b[0] for a, b in zip(found, found[1:]))
        assert sum(value[s, e] for s, _, e in found) == pytest.approx(best[-1])


def test_every_number_of_a_long_list_is_found():
    w = np.zeros((len(semicrf.KINDS), semicrf.N_FEATURES))
    w[:, 0] = -6
    for name, value in (("brackets", 4), ("digits 10-15", 4), ("tokens", -1)):
        w[3, semicrf.FEATURES.index(name)] = value
    numbers = [f"({200 + i % 700}) {201 + i % 500}-{1000 + i}" for i in range(2000)]
    text = " ".join(f"tel {n}" for n in numbers)
    base, spans = semicrf.all_spans(text, w)
    assert base == [] and [text[s:e] for s, _, e in spans] == numbers
    assert list(semicrf.zone_ranges("1" + "a" * 200_000 + "1" + " " * 200_000 + "@")) != []


def test_personal_data_edges(edge_docs, no_docs):
    w = semicrf.fit(edge_docs)
    got = semicrf.find_personal_data(edge_docs.select("doc_id", "text"), w).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        mine = slow_spans(r["text"] or "")
        assert r["base"] == semicrf.digest_text(mine)
        assert [r[f"n_{k}"] for k in semicrf.BASE_KINDS] == [sum(s[1] == i for s in mine) for i in range(4)]
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
    assert semicrf.fit(no_docs) is None
    assert semicrf.find_personal_data(no_docs, None).collect() == []
    masked = {r["doc_id"]: r["text"] for r in semicrf.mask(edge_docs, w).collect()}
    assert "@" not in masked[10] and "4510" not in masked[10] and "9855" not in masked[10] and masked[4] is None


def test_training_windows_reach_the_end_of_a_text(spark):
    """Matches only at the end of long texts full of other numbers still teach the field."""
    numbers = " ".join(f"lot {i} of {i * 7}" for i in range(3000))
    window = semicrf.training_windows(numbers + " write to jo.doe@mail.example.com now", 16, 4)
    assert "jo.doe@mail.example.com" in window and len(window) < 6 * 250
    many = " ... ".join(f"a{i}@b{i}.example.org" + " x" * 200 for i in range(40))
    assert semicrf.training_windows(many, 16, 4).count("\n") + 1 <= 20
    assert semicrf.training_windows("", 16, 4) == "" and semicrf.training_windows("no digit", 16, 4) == ""
    rows = [(i, numbers + f" mail user{i}@host{i}.example.com today") for i in range(30)]
    w = semicrf.fit(spark.createDataFrame(rows, "doc_id long, text string"), max_rows=12)
    assert w is not None and w[0].any()
    with pytest.warns(UserWarning, match="no personal data"):
        assert semicrf.fit(spark.createDataFrame([(1, "lot 7 of 9")], "doc_id long, text string")) is None


def test_clashing_names_give_way(spark):
    from tabprism.llm import mixing, multiset_hash, nbsvm
    docs = spark.createDataFrame([(1, "mail a.b@example.com now", "s", 5, "x", "t", 0.5)],
                                 "doc_id long, text string, source string, n_email int, base string, _text string, mix_weight double")
    found = semicrf.find_personal_data(docs, None)
    assert found.columns == ["doc_id", "text", "source", "_text", "mix_weight", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
    assert found.first()["n_email"] == 1 and found.first()["_text"] == "t"
    mixed = mixing.mix_sources(docs)
    assert mixed.columns.count("mix_weight") == 1 and mixed.first()["mix_weight"] == 1.0
    prints = multiset_hash.with_fingerprint(docs.withColumnRenamed("_text", "_units"), "text", "base")
    assert prints.columns == ["doc_id", "text", "source", "n_email", "_units", "mix_weight", "base"] and prints.first()["_units"] == "t"
    model = nbsvm.fit_rows([], np.zeros(0, np.int64), 10)
    assert nbsvm.score(docs, model, name="base").columns[-1] == "base"


def make_labelled(spark, n, seed):
    r = random.Random(seed)
    good = ["the", "river", "stone", "walks", "slowly", "under", "bright", "clouds", "and", "birds"]
    rows = []
    for i in range(n):
        y = r.random() < 0.6
        words = [r.choice(good) for _ in range(r.randint(20, 60))]
        rows.append((i, " ".join(words) if y else " ".join(w.upper() + "!!" if r.random() < 0.6 else w for w in words), int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_classifier_held_out_accuracy(spark):
    train, test = make_labelled(spark, 300, 1), make_labelled(spark, 200, 2)
    model = nbsvm.fit(train.select("doc_id", "text"), train.select("doc_id", "quality"), bits=14)
    got = nbsvm.score(test, model).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(r["score"] >= 0.7) == bool(r["quality"]) for r in got]) > 0.97


def test_classifier_bound_and_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (None, 1), (9, None), (11, 7), (99, 0)], "doc_id long, quality int")
    rows, y = nbsvm.training_rows(edge_docs, labels, "doc_id", "text", "quality", 2, 12, 50)
    assert len(y) <= 2 and all(len(r) <= 50 for r in rows)
    model = nbsvm.fit(edge_docs, labels, bits=12)
    got = nbsvm.score(edge_docs, model, keep=["doc_id"]).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5, 6)}) == 1
    one = nbsvm.fit(edge_docs, labels.where("quality = 1"), bits=12)
    assert nbsvm.score(edge_docs, one, keep=["doc_id"]).first()["score"] > 0.9
    none = nbsvm.fit(no_docs, labels.where("false"), bits=12)
    assert nbsvm.score(edge_docs, none, keep=["doc_id"]).first()["score"] == pytest.approx(0.5)
    assert nbsvm.score(no_docs, model).collect() == []


def test_training_sample_is_the_same_in_any_layout(spark):
    """Ids that repeat more often than the bound allows: the same rows whatever the partitions."""
    rows = [(i % 3, f"word{i} text number {i} of 12 mail u{i}@m{i}.org") for i in range(90)]
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    seen, fields = [], []
    for order, parts in ((rows, 1), (rows[::-1], 5), (rows[45:] + rows[:45], 3)):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        cols, y = nbsvm.training_rows(docs, labels, "doc_id", "text", "quality", 3, 12, 1000)
        seen.append(([c.tolist() for c in cols], y.tolist()))
        fields.append(semicrf.fit(docs, max_rows=3).tolist())
    assert len(seen[0][1]) == 6 and seen[0] == seen[1] == seen[2] and fields[0] == fields[1] == fields[2]


def test_dual_coordinate_descent_reaches_the_optimum():
    """Duality gap of the hinge-loss problem closes."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    indptr, cols = np.arange(0, 361, 6), np.tile(np.arange(6), 60)
    w = nbsvm.dual_coordinate_descent(indptr, cols, x.ravel(), y, 6, np.ones(60), 3000, 1)
    best = 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w[:6] + w[6])).sum()
    for _ in range(300):
        v = w + rng.normal(scale=0.03, size=7)
        assert 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:6] + v[6])).sum() >= best - 1e-3


def test_held_out_rule(spark):
    import zlib
    from tabprism.llm.queries import held_out
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)
