"""Secrets in texts: fixed patterns, and a conditional random field that tags tokens.

Base spans are those of three patterns. The method's spans come from a linear-chain field (``crf.py``) over
the words of a text with the labels begin, inside and outside. A word's features are its shape (which
classes of characters it has, its length, how often the classes change), the words around it (key words,
assignment signs, code-like shapes) and the file (how many of its words have digits, how many look like
code). The field learns from the base spans of a bounded sample of texts: ``SAMPLE_TEXTS`` distinct ones with
a base span and as many without, or all if there are fewer, picked by a hash of the text, none above
``SAMPLE_CHARS`` characters.

Every word of every text is tagged. At nearly all words the label outside leads by more than any neighbour
could make up for; there the chain is cut, which leaves what Viterbi decoding finds unchanged, and only the
runs between are decoded. A decoded span loses quotes and brackets at its ends, and counts if it touches no
base span.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a null text counts as empty and has no spans. If no text of
the sample holds a base span, there is nothing to learn and the base spans are all. Repeated rows and null
ids are scanned like any. Other columns, of any name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import Scan
from .common import as_batch, byte_texts, frugal, slices, text_of
from .crf import ChainCRF, fit

# The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "tagged")
_KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

SAMPLE_TEXTS = 400
SAMPLE_CHARS = 20_000
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
_EDGES = "\"'`()[]{}<>,;"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base spans, by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out, key=lambda s: (s[0], s[2]))


# ------------------------------------------------------------------ features
_DIGIT, _UPPER, _LOWER, _HEXA, _SIGN, _MARK, _OTHER = range(7)
_CLASS = np.zeros((7, 256), bool)
_CLASS[_DIGIT, 48:58] = True
_CLASS[_UPPER, 65:91] = True
_CLASS[_LOWER, 97:123] = True
_CLASS[_HEXA, [*range(48, 58), *range(97, 103)]] = True
_CLASS[_SIGN, [ord(c) for c in "=:"]] = True
_CLASS[_MARK, [ord(c) for c in "\"'`/+_-$@.{}();<>"]] = True
_CLASS[_OTHER, 128:] = True
#: Two packed counters: up to four classes of 16 bits each (longer words wrap, which only blurs a feature).
_PACKED = [sum(_CLASS[c].astype(np.uint64) << np.uint64(16 * i) for i, c in enumerate(part))
           for part in ((_DIGIT, _UPPER, _LOWER, _HEXA), (_SIGN, _MARK, _OTHER))]
_KIND = np.where(_CLASS[_DIGIT], 1, np.where(_CLASS[_UPPER], 2, np.where(_CLASS[_LOWER] | _CLASS[_OTHER], 3, 0)))
_LENGTHS = np.array([2, 4, 8, 12, 16, 20, 24, 32, 40, 64])
_KEYWORDS = re.compile(rb"passw|secret|token|api_?key|credential|auth|akia|key")
CARDS = [64, 11, 5, 5, 4, 64, 64, 4, 16]


class Tokens:
    """Words of many texts and their features."""

    def __init__(self, texts: list[bytes]):
        self.scan = scan = Scan(texts)
        data = scan.data
        self.a, self.b = a, b = scan.words()
        self.text = text = scan.text_of(a)
        self.per_text = np.bincount(text, minlength=scan.n)
        packed = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(p[data]))) for p in _PACKED]
        counts = [x[b] - x[a] for x in packed]

        def count(part: int, place: int) -> np.ndarray:
            return ((counts[part] >> np.uint64(16 * place)) & np.uint64(0xFFFF)).astype(np.int64)

        size = b - a
        digit, upper, lower, hexa = (count(0, i) for i in range(4))
        sign, mark, other = (count(1, i) for i in range(3))
        shape = ((digit > 0) | (upper > 0) << 1 | (lower > 0) << 2 | (sign > 0) << 3 | (mark > 0) << 4
                 | (other > 0) << 5).astype(np.int64)
        kind = _KIND[data]
        change = np.concatenate(([0], np.cumsum(kind[1:] != kind[:-1])))
        changes = np.digitize(change[b - 1] - change[a], [1, 3, 6, 12])
        digits = np.digitize(digit / np.maximum(size, 1), [0.01, 0.2, 0.5, 0.95])
        hexes = np.digitize(hexa / np.maximum(size, 1), [0.5, 0.8, 0.94])
        coded = (digit > 0) & (size >= 16)
        low = scan.raw.lower()
        key = np.zeros(len(a), np.int64)
        hits = [m.start() for m in _KEYWORDS.finditer(low)] if len(a) else []
        if hits:
            key[np.searchsorted(a, np.array(hits), side="right") - 1] = 1
        link = ((sign > 0) & (size <= 2)).astype(np.int64)
        before = np.zeros(len(a), np.int64)
        state = key + 2 * link
        at = np.arange(len(a))
        for back in (1, 2):
            same = at >= back
            same[back:] &= text[back:] == text[:-back]
            before[same] += state[at[same] - back] << (2 * (back - 1))
        prev, following = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        if len(a) > 1:
            same = np.flatnonzero(text[1:] == text[:-1])
            prev[same + 1] = shape[same]
            following[same] = shape[same + 1]
        total = np.maximum(self.per_text, 1)
        file = (np.digitize(np.bincount(text, digit > 0, scan.n) / total, [0.001, 0.05, 0.3])
                + 4 * np.digitize(np.bincount(text, coded, scan.n) / total, [0.0005, 0.01, 0.1]))
        self.features = np.stack([shape, np.digitize(size, _LENGTHS), digits, changes, hexes, prev, following,
                                  state, before], axis=1)
        self.file = file[text]

    def rows(self) -> np.ndarray:
        return np.column_stack((self.features, self.file))


ALL_CARDS = [*CARDS, 16]


def has_base_span() -> Column:
    """Whether ``base_spans`` finds any in the column ``text``."""
    low = F.lower("text")
    named = F.lit(False)
    for key in _KEYS:  # a plain search spares most texts the pattern
        named = named | low.contains(key.decode())
    # All matches, since a shorter one may hide the next, as in Python.
    values = F.regexp_extract_all("text", F.lit("(?i)" + ASSIGN.pattern), F.lit(2))
    return ((named & F.exists(values, lambda v: F.length(v) >= LEAST_ASSIGN))
            | (F.col("text").contains("AKIA") & F.col("text").rlike(f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"))
            | F.col("text").rlike(f"[0-9a-f]{{{LEAST_HEX},}}"))


def training_texts(docs: DataFrame) -> list[str]:
    """A bounded sample of the distinct texts: some with a base span, and some without."""
    text = text_of(docs)
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("order")).where(
        (F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    hit = has_base_span()
    # Distinct texts of either class; copies are merged inside their own tasks.
    held, n = rows.select("order", hit.alias("hit")).distinct().agg(
        F.count_if("hit"), F.count(F.lit(1))).head()
    out = []
    for has, among in ((hit, held), (~hit, n - held)):
        # A hash threshold lets through about three times as many as needed, however many tasks there are.
        share, best = 3 * SAMPLE_TEXTS / max(among, 1), []
        while among:
            few = F.pmod("order", F.lit(1 << 30)) <= min(1.0, share) * (1 << 30)
            one = rows.where(few & has).groupBy("order").agg(F.min("text").alias("text"))
            best = one.orderBy("order").limit(SAMPLE_TEXTS).select("text").collect()
            if share >= 1 or len(best) >= SAMPLE_TEXTS:
                break
            share *= 4
        out += [r["text"] for r in best]
    return out


def learn(docs: DataFrame) -> ChainCRF | None:
    """The field fitted to the base spans of the sample; None if there are none."""
    texts = training_texts(docs)
    spans = [base_spans(t) for t in texts]
    # Each text with spans is learned from once more with their letters in upper case, and once with a
    # letter in two so, lest the field know the given alphabets only.
    for t, own in [x for x in zip(texts, spans, strict=True) if x[1]]:
        for every in (1, 2):
            new = list(t)
            for a, b, _ in own:
                new[a:b:every] = [c.upper() if c.isascii() else c for c in new[a:b:every]]
            texts.append("".join(new))
            spans.append(own)
    tokens = Tokens([t.encode() for t in texts])
    rows, ends = tokens.rows(), np.cumsum(tokens.per_text)
    sequences, found = [], 0
    for i, (t, own, n, end) in enumerate(zip(texts, spans, tokens.per_text, ends, strict=True)):
        label = np.full(n, OUTSIDE)
        begin = tokens.a[end - n:end] - tokens.scan.at[i]
        stop = tokens.b[end - n:end] - tokens.scan.at[i]
        busy = -1
        for a, b, _ in own:
            a, b = len(t[:a].encode()), len(t[:b].encode())
            mine = np.flatnonzero((begin < b) & (stop > a))
            mine = mine[mine > busy]
            if len(mine):
                label[mine], label[mine[0]] = INSIDE, BEGIN
                busy = mine[-1]
                found += 1
        for at in range(0, n, 48):  # texts are learned from in parts
            part = label[at:at + 48]
            if (part != OUTSIDE).any() or (at // 48 + i) % 4 == 0:
                sequences.append((rows[end - n + at:end - n + at + len(part)], part))
    return fit(sequences, ALL_CARDS, 3, rounds=60, penalty=0.2) if found else None


def tagged_spans(tokens: Tokens, model: ChainCRF) -> dict[int, list[tuple[int, int]]]:
    """Byte spans that the field tags in each text."""
    scores = model.scores(tokens.rows())
    sure = model.settled(scores, OUTSIDE)
    ask = np.flatnonzero(~sure)
    if not len(ask):
        return {}
    # Runs of unsettled words with the settled word (or the text's edge) on either side.
    keep = ~sure
    same = tokens.text[1:] == tokens.text[:-1]
    keep[1:] |= ~sure[:-1] & same
    keep[:-1] |= ~sure[1:] & same
    chosen = np.flatnonzero(keep)
    part = np.concatenate(([True], (np.diff(chosen) > 1) | (tokens.text[chosen[1:]] != tokens.text[chosen[:-1]])))
    starts = np.flatnonzero(part)
    lengths = np.diff(np.append(starts, len(chosen)))
    inner = scores[chosen].copy()
    first, last = chosen[starts], chosen[starts + lengths - 1]
    # A run's edges carry edge scores only at a text's own edges; a settled word is held to its label.
    held = sure[chosen]
    inner[held, BEGIN] = inner[held, INSIDE] = -1e9
    begins = tokens.text[np.maximum(first - 1, 0)] != tokens.text[first]
    begins |= first == 0
    ends = np.append(tokens.text, -1)[last + 1] != tokens.text[last]
    inner[starts[~begins]] -= model.first
    inner[(starts + lengths - 1)[~ends]] -= model.last
    label = model.decode(inner, lengths)
    out: dict[int, list[tuple[int, int]]] = {}
    at = -2
    for i, y in zip(chosen[label != OUTSIDE].tolist(), label[label != OUTSIDE].tolist(), strict=True):
        spans = out.setdefault(int(tokens.text[i]), [])
        if y == INSIDE and i == at + 1 and spans:
            spans[-1] = (spans[-1][0], int(tokens.b[i]))
        else:
            spans.append((int(tokens.a[i]), int(tokens.b[i])))
        at = i
    return out


def _suspects(scan: Scan) -> set[int]:
    """Texts that may hold a base span, found by plain searches of the bytes."""
    low, at = scan.raw.lower(), []
    for needle, where in (*((k, low) for k in _KEYS), (b"AKIA", scan.raw)):
        place = where.find(needle)
        while place >= 0:
            at.append(place)
            place = where.find(needle, place + 1)
    hexa = _CLASS[_HEXA][scan.data]
    edge = np.flatnonzero(hexa[1:] != hexa[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    at += begin[end - begin >= LEAST_HEX].tolist()
    return set((np.searchsorted(scan.at, np.array(at, np.int64), side="right") - 1).tolist())


SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])
OUT = "spans array<struct<start:int,stop:int,kind:string>>"


def _scan(model: ChainCRF | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = byte_texts(b.column("text"))
            tokens = Tokens(texts)
            found: list[list[dict]] = [[] for _ in texts]
            more = tagged_spans(tokens, model) if model is not None else {}
            for i in sorted(_suspects(tokens.scan) | set(more)):
                text = texts[i].decode(errors="replace")
                spans = base_spans(text)
                for x, y in more.get(i, ()):
                    x -= int(tokens.scan.at[i])
                    y -= int(tokens.scan.at[i])
                    word = texts[i][x:y].decode(errors="replace")
                    start = len(texts[i][:x].decode(errors="replace")) + len(word) - len(word.lstrip(_EDGES))
                    stop = start + len(word.strip(_EDGES))
                    if stop > start and not any(s < stop and start < e for s, e, k in spans if k < 3):
                        spans.append((start, stop, 3))
                found[i] = [{"start": s, "stop": e, "kind": KINDS[k]} for s, e, k in
                            sorted(spans, key=lambda s: (s[0], s[2]))]
            yield as_batch({"doc_id": b.column("doc_id"), "spans": found}, schema)
    return run


def find_secrets(docs: DataFrame, model: ChainCRF | None) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans (code points, end exclusive), by start and kind."""
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    name = rows.dtypes[0][1]
    kind = rows.limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("doc_id", kind), ("spans", pa.list_(SPAN))])
    return rows.mapInArrow(frugal(_scan(model, schema)), f"doc_id {name}, {OUT}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of each kind, base_sha256 and the spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[number(k) for k in KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def expected_digest(text: str | None) -> tuple[int, int, int, str]:
    """What the base columns must be, for tests."""
    spans = base_spans(text or "")
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)
    return (*(sum(k == x for _, _, k in spans) for x in range(3)), hashlib.sha256(joined.encode()).hexdigest())
