"""Personal data (operator 2): fixed patterns and a semi-Markov conditional random field.

**Base.**  Four patterns, leftmost and non-overlapping per kind, with checks on
the match (parts of an address, Luhn sum, number of digits) and no retries.

**Semi-CRF.**  A text is cut into tokens: runs of letters and digits, and
single other marks; white space joins.  Segments of up to ``MAX_TOKENS`` tokens
are scored as whole spans: digit counts and groups, separators, checks that
hold for the span, words around it, length.  Dynamic programming over segment
ends (semi-Markov Viterbi; forward-backward in training) chooses boundaries and
types together.  An entity must hold a digit, ``@`` or the word "dot", so only
*zones*, token runs near such an anchor, are decoded: outside of them every
segmentation has the same, constant score.  Zones have no greatest length and
reach as far as a segment can: long ones are decoded in blocks that hand their
scores on, with the same result as decoding the text in one.

Spans found by the field are added unless they overlap a base span; base spans
always stay.  Weights are trained (conditional likelihood, AdaGrad) on windows of
at most ``max_rows`` documents, those with the smallest id hashes, two thirds of them
likely to hold a match; the windows come from the whole text, at most
``matches_per_text`` around matches and ``others_per_text`` around other digits.  Base matches
are the labels, and rewritten base matches (other separators, spelled-out marks,
a lost prefix) teach the forms that the patterns miss; numbers that no pattern
accepts are the negative cases.  Key-like hexadecimal strings of 20 or more
characters after ``token``, ``key``, ``secret`` or ``password`` label the kind
``secret``.

Defined results: null and empty texts have no spans; repeated rows get a row each;
an empty table gives no row; without an entity among the training windows there is
no field (``fit`` warns) and the base patterns alone apply; offsets are code points, ends exclusive; rows are
independent of each other.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabprism.llm.common import first_rows, free_tag, map_batches, strings

#: The kinds of the base patterns, in the order of the digest.
BASE_KINDS = ["email", "ip", "card", "phone"]

KINDS = [*BASE_KINDS, "secret"]
MAX_TOKENS = 14
#: Longer spans can't be entities (characters).
MAX_SPAN = 160
#: Tokens before a span that its features look at.
GAP = 4
#: Long zones are scored in blocks of this many first tokens; the best scores are carried over.
MAX_ZONE = 240

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits begins, so the look-behind changes nothing but the cost
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)\b(?:token|key|secret|password)\b[\"'=: ]{1,6}([0-9a-f]{20,128})")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and dotted domain; each ``@`` is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at and at >= free else None
        if m:
            free = m.end()
            yield start, free
        elif at >= free:
            # the local part of a later mark cannot reach back over this one
            free = at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _only_digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_only_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---- tokens and zones -------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|\S")
_ANCHOR = re.compile(r"[0-9@]|\sdot\s")
Token = tuple[int, int, str]


def _word_edge(text: str, at: int, step: int) -> int:
    """``at``, moved by ``step`` until it is not inside a word."""
    while 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum():
        at += step
    return at


def _zone_begin(text: str, anchor: int, margin: int) -> int:
    """Where the zone of an anchor begins: ``margin`` characters and then GAP whole tokens before it."""
    at = _word_edge(text, max(0, anchor - margin), -1)
    for _ in range(GAP):
        while at and text[at - 1].isspace():
            at -= 1
        at = _word_edge(text, max(0, at - 1), -1)
    return at


def zone_ranges(text: str, margin: int = MAX_SPAN) -> Iterator[tuple[int, int]]:
    """(begin, end) around digits and ``@``, apart from each other; no segment that may be an entity reaches out of one."""
    begin, last, stop = -1, 0, 0
    for m in _ANCHOR.finditer(text):
        if begin >= 0:
            if m.start() - margin > max(stop, last + margin) and last + margin > stop:
                stop = _word_edge(text, last + margin, 1)
            # stop only grows, so no word is walked again for each of its anchors
            if m.start() - margin <= max(stop, last + margin):
                last = m.end()
                continue
        own = _zone_begin(text, m.start(), margin)
        if begin < 0:
            begin = own
        elif own >= stop:
            yield begin, stop
            begin = own
        last = m.end()
    if begin >= 0:
        yield begin, max(stop, _word_edge(text, min(len(text), last + margin), 1))


def zone_tokens(text: str, begin: int, end: int) -> Iterator[Token]:
    return ((t.start(), t.end(), t.group()) for t in _TOKEN.finditer(text, begin, end))


def zones(text: str, margin: int = MAX_SPAN) -> Iterator[list[Token]]:
    """Token lists around digits and ``@``; each anchor is in one zone."""
    for begin, end in zone_ranges(text, margin):
        yield list(zone_tokens(text, begin, end))


# ---- whole-span features ----------------------------------------------------

_CUES = {"email": ["mail", "email", "contact", "at"], "ip": ["ip", "host", "address", "server"],
         "card": ["card", "visa", "account", "credit"], "phone": ["phone", "tel", "call", "fax", "mobile"],
         "secret": ["token", "key", "secret", "password"]}
FEATURES = ["bias", "digits 14-19", "digits 10-15", "digits 7-9", "digits under 7", "digits over 19", "luhn", "four parts under 256",
            "four parts", "starts with plus", "brackets", "one separator kind", "only digits", "has @", "has spelled at and dot", "dotted domain",
            "hexadecimal", "long hexadecimal", "letters and digits", "spaces inside", "ends with mark", "starts with mark",
            "cue before", "other cue before", "touches digit", "touches letter", "touches mark", "tokens", "letters only", "three dots",
            "quotes around", "decimal or date form"]
N_FEATURES = len(FEATURES)


def span_features(text: str, tokens: list[Token], i: int, j: int) -> np.ndarray | None:
    """Features of tokens i to j (exclusive) as one span; None for spans that can't be an entity."""
    s, e = tokens[i][0], tokens[j - 1][1]
    span = text[s:e]
    if len(span) > MAX_SPAN or "\n" in span:
        return None
    digits = _only_digits(span)
    low = span.lower()
    spelled = " at " in low and " dot " in low
    if not digits and "@" not in span and not spelled:
        return None
    f = np.zeros(N_FEATURES)
    nd = len(digits)
    marks = {ch for ch in span if not ch.isalnum()}
    numeric = not any(ch.isalpha() for ch in span)
    parts = span.split(".")
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    f[0] = 1
    if numeric:
        f[1], f[2], f[3] = 14 <= nd <= 19, 10 <= nd <= 15, 7 <= nd <= 9
        f[4], f[5] = nd < 7, nd > 19
        f[6] = 14 <= nd <= 19 and luhn(digits)
        f[9], f[10] = span[0] == "+", "(" in span and ")" in span
        f[11] = len(marks - {"+", "(", ")"}) == 1
        f[12] = nd == len(span)
    f[7], f[8] = four and all(len(p) <= 3 and int(p) <= 255 for p in parts), four
    f[13], f[14] = span.count("@") == 1 and span[0] != "@" and span[-1] != "@", spelled
    f[15] = bool(re.search(r"@\s?[A-Za-z0-9-]+(\s?\.\s?[A-Za-z0-9-]+)+$", span)) or spelled and bool(re.search(r" dot [a-z0-9]+$", low))
    hexa = span.isascii() and all(ch in "0123456789abcdefABCDEF" for ch in span)
    f[16], f[17] = hexa, hexa and len(span) >= 20 and not numeric
    f[18] = not numeric and nd > 0 and not hexa
    f[19] = any(ch.isspace() for ch in span)
    f[20], f[21] = not span[-1].isalnum(), not span[0].isalnum() and span[0] not in "+("
    before = [t[2].lower() for t in tokens[max(0, i - GAP):i]]
    for k, words in enumerate(_CUES.values()):
        if any(b in words for b in before):
            f[22] = 1
    f[23] = bool(before) and before[-1] in "=:"
    left, right = text[s - 1:s], text[e:e + 1]
    f[24], f[25] = left.isdigit() or right.isdigit(), left.isalpha() or right.isalpha()
    f[26] = left in tuple("@.-+(%_") or right in tuple("@-%_")
    f[27] = (j - i) / MAX_TOKENS
    f[28] = nd == 0
    f[29] = span.count(".") >= 3
    f[30] = left in ('"', "'") and right in ('"', "'")
    f[31] = bool(re.fullmatch(r"[0-9]{1,6}[.,/:-][0-9]{1,4}([.,/:-][0-9]{1,4})?", span))
    return f


def candidates(text: str, tokens: list[Token], since: int = 0, until: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, end token, features) of every segment that may be an entity and begins at tokens ``since`` to ``until``."""
    n = len(tokens)
    until = n if until is None else until
    following, at = [n] * n, n      # the next token with an anchor
    for i in range(n - 1, -1, -1):
        if tokens[i][2].lower() == "dot" or _ANCHOR.search(tokens[i][2]):
            at = i
        following[i] = at
    first, last, feats = [], [], []
    for i in range(since, until):
        if not tokens[i][2][0].isalnum() and tokens[i][2] not in "+(":
            continue
        for j in range(following[i] + 1, min(n, i + MAX_TOKENS) + 1):
            if tokens[j - 1][1] - tokens[i][0] > MAX_SPAN:
                break
            if not tokens[j - 1][2][-1].isalnum():
                continue
            f = span_features(text, tokens, i, j)
            if f is not None:
                first.append(i), last.append(j), feats.append(f)
    return np.array(first, np.int64), np.array(last, np.int64), np.array(feats).reshape(-1, N_FEATURES)


# ---- the field --------------------------------------------------------------

def _blocks(tokens: Iterable[Token]) -> Iterator[tuple[list[Token], int, int]]:
    """(tokens, first, end): blocks of MAX_ZONE tokens first to end, with the tokens before and after that their segments need."""
    held, lead = [], 0
    for t in tokens:
        held.append(t)
        if len(held) == lead + MAX_ZONE + MAX_TOKENS:
            yield held, lead, lead + MAX_ZONE
            held, lead = held[lead + MAX_ZONE - GAP:], GAP
    while lead < len(held):
        end = min(len(held), lead + MAX_ZONE)
        yield held, lead, end
        held, lead = held[end - GAP if end > GAP else 0:], min(end, GAP)


def decode(text: str, tokens: Iterable[Token], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation of a zone: (start, kind number, end) spans.  Single tokens outside entities score 0.

    Scores and back pointers run on from block to block, and are let go where
    no segment of positive score crosses the end of a block.
    """
    out = []
    origin, done = 0, 0         # token numbers: of best[0], and of the block's first token
    best, back = [0.0], [None]
    ending: dict[int, list[tuple[int, float, tuple[int, int, int]]]] = {}
    for held, lead, end in _blocks(tokens):
        first, last, feats = candidates(text, held, lead, end)
        if len(first):
            scores = feats @ weights.T
            kind, gain = scores.argmax(1), scores.max(1)
            for c in np.flatnonzero(gain > 0).tolist():
                i, j = int(first[c]), int(last[c])
                ending.setdefault(done + j - lead, []).append(
                    (done + i - lead, float(gain[c]), (held[i][0], int(kind[c]), held[j - 1][1])))
        for j in range(done + 1, done + end - lead + 1):
            value, chosen = best[-1], None
            for i, g, span in ending.pop(j, ()):
                if best[i - origin] + g > value:
                    value, chosen = best[i - origin] + g, (i, span)
            best.append(value)
            back.append(chosen)
        done += end - lead
        if not ending:
            found, j = [], done
            while j > origin:
                chosen = back[j - origin]
                if chosen is None:
                    j -= 1
                else:
                    found.append(chosen[1])
                    j = chosen[0]
            out += found[::-1]
            origin, best, back = done, [0.0], [None]
    return out


def _gradient(zone, weights: np.ndarray) -> np.ndarray:
    """Gradient of the zone's conditional log likelihood (forward-backward over segments)."""
    n, first, last, feats, gold = zone
    scores = np.clip(feats @ weights.T, -30, 30)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for c, (i, j) in enumerate(zip(first.tolist(), last.tolist())):
        by_end.setdefault(j, []).append(c)
        by_start.setdefault(i, []).append(c)
    total = np.logaddexp.reduce(scores, axis=1)
    a, b = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        own = by_end.get(j)
        a[j] = a[j - 1] if not own else np.logaddexp.reduce([a[j - 1], *(a[first[c]] + total[c] for c in own)])
    for i in range(n - 1, -1, -1):
        own = by_start.get(i)
        b[i] = b[i + 1] if not own else np.logaddexp.reduce([b[i + 1], *(b[last[c]] + total[c] for c in own)])
    p = np.exp(np.minimum(0.0, a[first][:, None] + scores + b[last][:, None] - a[n]))
    return gold.T @ feats - p.T @ feats


def train(zoned: list[tuple], epochs: int = 12, rate: float = 0.5, penalty: float = 1e-3, seed: int = 5) -> np.ndarray | None:
    """Weights (kinds x features) from (tokens, first, last, features, gold) zones; None without an entity."""
    zoned = [z for z in zoned if len(z[1])]
    if not any(z[4].any() for z in zoned):
        return None
    w = np.zeros((len(KINDS), N_FEATURES))
    w[:, 0] = -2.0
    square = np.full_like(w, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for z in rng.permutation(len(zoned)):
            g = _gradient(zoned[z], w) - penalty * w
            square += g * g
            w += rate * g / np.sqrt(square)
    return w


def _rewrites(kind: int, span: str, rng: np.random.Generator) -> str:
    """A base match in a form that the base patterns miss."""
    digits = _only_digits(span)
    if kind == 0:
        return re.sub(r"\.(?=[^.@]*$)", " dot ", span.replace("@", " at ", 1)) if rng.random() < 0.7 else span.replace("@", " @ ", 1)
    if kind == 1:
        return span
    if kind == 2:
        sep = [".", "/", "  "][rng.integers(3)]
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    d = digits[-10:]
    return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"][rng.integers(3)]


def labelled_zones(text: str, rng: np.random.Generator, most: int | None = None) -> list[tuple]:
    """Training zones of a text: as it stands, and with its base matches rewritten; the first ``most`` of each if given."""
    out = []
    spans = base_spans(text)
    secrets = [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]
    gold = spans + [s for s in secrets if all(s[2] <= b[0] or s[0] >= b[2] for b in spans)]
    versions = [(text, gold)]
    if gold:
        made, new, at = [], [], 0
        for s, k, e in sorted(gold):
            if s < at:
                continue
            made.append(text[at:s])
            span = text[s:e] if k == 4 else _rewrites(k, text[s:e], rng)
            start = sum(map(len, made))
            new.append((start, k, start + len(span)))
            made.append(span)
            at = e
        versions.append(("".join([*made, text[at:]]), new))
    for body, marks in versions:
        for tokens in list(zones(body, 60))[:most]:
            first, last, feats = candidates(body, tokens)
            where = {(tokens[i][0], tokens[j - 1][1]): c for c, (i, j) in enumerate(zip(first.tolist(), last.tolist()))}
            gold = np.zeros((len(first), len(KINDS)))
            taken = -1
            for s, k, e in sorted(marks):
                if (s, e) in where and s >= taken:
                    gold[where[(s, e)], k] = 1
                    taken = e
            out.append((len(tokens), first, last, feats, gold))
    return out


#: Texts that are likely to hold a match of a base kind or a secret; only the choice of training texts uses it.
LIKELY = (r"@[A-Za-z0-9-]+\.[A-Za-z0-9]|\+[0-9][ ().0-9-]{8,}[0-9]|[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]|[0-9]([ -]?[0-9]){13}"
          r"|(?i:token|key|secret|password)[\"'=: ]{1,6}[0-9a-fA-F]{20}")
#: Texts where the field finds zones at all.
ZONED = r"[0-9@]|\sdot\s"


def training_windows(text: str, matches: int, others: int) -> str:
    """Neighbourhoods (-80, +160 characters) of a text's digits and marks, one per line, from the whole text.

    Those around a match or secret come first: all up to ``matches``; of the rest
    ``others``.  Beyond that the ones with the smallest hashes are taken.
    """
    found = [s for s, _, _ in base_spans(text)] + [m.start(1) for m in _SECRET.finditer(text)]
    sizes, places = (matches, others), (found, [m.start() for m in _ANCHOR.finditer(text)])
    keep: list[tuple[int, int]] = []
    for most, marks in zip(sizes, places):
        cuts = {(max(0, m - 80), m + 160) for m in marks if not any(a <= m < b for a, b in keep)}
        by_hash = sorted(cuts, key=lambda c: (xxhash.xxh3_64_intdigest(text[c[0]:c[1]].encode("utf-8", "replace"), c[0]), c))
        for cut in by_hash:
            if most == 0:
                break
            if not any(a < cut[1] and cut[0] < b for a, b in keep):
                keep.append(cut)
                most -= 1
    return "\n".join(text[a:b] for a, b in sorted(keep))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = 300, plain_share: float = 1 / 3,
        matches_per_text: int = 16, others_per_text: int = 4) -> np.ndarray | None:
    """Train on at most ``max_rows`` texts with the smallest id hashes, ``plain_share`` of them without a likely match.

    Of repeated ids twice as many rows at most.  A text gives up to
    ``matches_per_text`` windows around matches and ``others_per_text`` around other
    digits, chosen by hash from the whole text.  Without an entity in any of them
    there is no field: a warning says so, and only the base patterns apply.
    """
    spans = docs.where(F.col(text).rlike(ZONED)).select(F.col(key).alias("_key"), F.col(text).rlike(LIKELY).alias("_likely")).where(F.col("_key").isNotNull())
    plain = int(max_rows * plain_share)
    # an id with texts of both kinds counts as likely
    ids = [spans.where(kind).orderBy(F.xxhash64("_key"), "_key").limit(n).select("_key")
           for kind, n in ((F.col("_likely"), max_rows - plain), (~F.col("_likely"), plain))]
    picked, counts = first_rows(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")), ids[0].unionByName(ids[1]).distinct(), 2 * max_rows)
    schema = StructType([picked.schema["_text"], picked.schema["_key"], StructField("t", StringType())])
    names = schema.names

    # only the windows reach the driver
    def run(batch):
        cut = [training_windows(t, matches_per_text, others_per_text) for t in strings(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("_text"), batch.column("_key"), pa.array(cut, pa.string())], names)

    sample = sorted(r["t"] for r in map_batches(picked, run, schema).collect() for _ in range(counts[tuple(r)[:2]]))
    rng = np.random.default_rng(3)
    weights = train([z for t in sample for z in labelled_zones(t, rng)])
    if weights is None:
        warnings.warn(f"no personal data in {len(sample)} sampled texts: only the base patterns apply", stacklevel=2)
    return weights


def all_spans(text: str, weights: np.ndarray | None) -> tuple[list, list]:
    """(base spans, base and added spans), each by start, then kind."""
    base = base_spans(text)
    if weights is None:
        return base, base
    added = []
    for begin, end in zone_ranges(text):
        for s, k, e in decode(text, zone_tokens(text, begin, end), weights):
            if all(e <= b[0] or s >= b[2] for b in base):
                added.append((s, k, e))
    return base, sorted(base + added)


def digest_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, weights: np.ndarray | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and, per row, n_<kind> of the base kinds, ``base`` and ``spans`` (kind:start:end texts).

    Kept columns with one of these names give way to the results.
    """
    counts = [f"n_{k}" for k in BASE_KINDS]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*counts, "base", "spans")]
    searched = free_tag(keep) + "text"
    fields = docs.select(*keep, F.col(text).alias(searched))
    schema = StructType([fields.schema[c] for c in keep] + [StructField(c, LongType()) for c in counts]
                        + [StructField(c, StringType()) for c in ("base", "spans")])
    names = [f.name for f in schema.fields]

    def run(batch):
        found = [all_spans(t, weights) for t in strings(batch, searched)]
        kept = [batch.column(c) for c in batch.schema.names if c != searched]
        number = [pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(BASE_KINDS))]
        yield pa.RecordBatch.from_arrays(
            [*kept, *number, pa.array([digest_text(b) for b, _ in found], pa.string()),
             pa.array([digest_text(a) for _, a in found], pa.string())], names)

    return map_batches(fields, run, schema)


def mask(docs: DataFrame, weights: np.ndarray | None, text: str = "text") -> DataFrame:
    """All columns, with every span of ``text`` replaced by its kind in angle brackets; null stays null."""
    names = docs.columns
    at = names.index(text)

    def run(batch):
        out = []
        for t in batch.column(at).to_pylist():
            if t:
                parts, end = [], 0
                for s, k, e in all_spans(t, weights)[1]:
                    if s >= end:
                        parts += [t[end:s], f"<{KINDS[k]}>"]
                        end = e
                    elif e > end:       # base spans of two kinds may overlap: hide both
                        end = e
                t = "".join([*parts, t[end:]])
            out.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)

    return map_batches(docs, run, docs.schema)
