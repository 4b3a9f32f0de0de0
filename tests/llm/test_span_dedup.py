"""Sentence spans against a plain re-computation."""

import os
import re

from cityloom.llm.span_dedup import remove_repeated_spans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, doc string, span string, covers string"


def sentences(text):
    """(start, stop, words) with the white space that follows."""
    words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    groups, now = [], []
    for i, (a, b, w) in enumerate(words):
        now.append((a, b, w))
        gap = text[b:words[i + 1][0]] if i + 1 < len(words) else "\n"
        if w[-1] in ".!?。！？" or "\n" in gap:
            groups.append(now)
            now = []
    starts = [g[0][0] for g in groups]
    return [(g[0][0], starts[i + 1] if i + 1 < len(groups) else len(text), [w for _, _, w in g])
            for i, g in enumerate(groups)]


def brute(rows):
    first, spans = {}, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        s = sentences(t or "")
        for a in range(len(s)):
            words, b = [], a
            while b < len(s) and (b - a < 2 or len(words) < 20):
                words += s[b][2]
                b += 1
            if b - a >= 2 and len(words) >= 20:
                spans.append((i, t, a, b, tuple(words)))
                first.setdefault(tuple(words), (i, a))
    out = []
    for i, t in rows:
        s = sentences(t or "")
        dead = set()
        for j, u, a, b, w in spans:
            if (j, u) == (i, t) and (first[w][0] != i or first[w][1] != a):
                dead |= set(range(a, b))
        left, at = [], 0
        for k in sorted(dead):
            left.append((t or "")[at:s[k][0]])
            at = s[k][1]
        out.append((i, len(s), len(dead), "".join(left) + (t or "")[at:]))
    return out


def same(got, want):
    key = lambda r: (-1 if r[0] is None else r[0], r[3])
    assert sorted(((r.doc_id, r.n_sentences, r.n_removed, r.text) for r in got), key=key) == sorted(want, key=key)


def test_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = remove_repeated_spans(docs).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    same(got, brute(rows))
    texts = dict(rows)
    for r in got:
        left, at = [], 0
        for x in r.removed:
            left.append(texts[r.doc_id][at:x["start"]])
            at = x["stop"]
        assert "".join(left) + texts[r.doc_id][at:] == r.text


def passage(n, seed):
    return " ".join(f"Word{seed} goes{i} on and on for é {i}." for i in range(n))


def test_awkward_rows(spark):
    p = passage(7, 1)
    rows = [(1, None), (2, ""), (3, " \n "), (4, f"Own words here. {p} More of mine."), (5, f"Cut off at {p} other\ntail"),
            (6, p.replace(" ", " \t")), (None, f"{p} And again. {passage(4, 2)} {passage(4, 2)}"),
            (8, "a " * 50_000 + ". " + p), (9, "Yes. No. Yes. No. Yes. No."), (10, "Yes. No. Yes. No. Yes. No.")]
    docs = spark.createDataFrame([(*r, "d", "s", "c") for r in rows], SCHEMA).repartition(4)
    got = remove_repeated_spans(docs).collect()
    same(got, brute(rows))
    assert {r.doc_id for r in got if r.n_removed} == {None, 4, 5, 6, 8}
    assert remove_repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_are_one_document(spark):
    rows = [(1, passage(6, 3)), (1, passage(6, 3)), (2, passage(6, 3))]
    got = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 6)]


def all_runs(rows):
    """Sentences of each row inside a repeated run of at least 20 words, of any number of sentences."""
    first, spans = {}, []
    for i, t in sorted(rows):
        s = sentences(t)
        for a in range(len(s)):
            words = []
            for b in range(a, len(s)):
                words += s[b][2]
                if len(words) >= 20:
                    spans.append((i, a, b + 1, hash(tuple(words))))
                    first.setdefault(spans[-1][3], (i, a))
    dead = {i: set() for i, _ in rows}
    for i, a, b, w in spans:
        if first[w] != (i, a):
            dead[i] |= set(range(a, b))
    out = []
    for i, t in rows:
        s = sentences(t)
        left, at = [], 0
        for k in sorted(dead[i]):
            left.append(t[at:s[k][0]])
            at = s[k][1]
        out.append((i, len(s), len(dead[i]), "".join(left) + t[at:]))
    return out


def test_every_run_goes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 9000")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = all_runs(rows)
    same(remove_repeated_spans(docs, every_run=True).collect(), want)
    assert sum(r[2] for r in want) > sum(r[2] for r in brute(rows))


def test_tails_and_single_sentences(spark):
    def said(n, seed):
        return " ".join(f"{seed}{k}" for k in range(n)) + "."

    p = f"{said(15, 'a')} {said(15, 'b')} {said(3, 'c')}"
    lone = " ".join(f"l{k}" for k in range(50))
    rows = [(1, f"Mine. {p} Own end."), (2, f"Other words. {p} And more."), (3, lone), (4, lone),
            (5, f"Head here. {said(30, 'd')} Tail here. {said(30, 'd')}"), (6, f"{said(19, 'e')} x."), (7, f"{said(19, 'e')} y.")]
    got = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every_run=True).collect()
    same(got, all_runs(rows))
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 3, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0}
    assert {r.doc_id: r.text for r in got}[2] == "Other words. And more."


def test_rows_of_one_id_keep_their_own_text(spark):
    """Ranges found in one row leave other rows of its id, or without an id, alone."""
    p, own = passage(6, 3), "Unique first sentence of some length that nobody else has written today. Another lone one."
    twice = f"{passage(5, 7)} {passage(5, 7)}"
    rows = [(1, p), (2, p), (2, own), (None, twice), (None, f"Third unique. {own[:40]} here. And a tail of it."),
            (None, "short"), (None, None), (3, twice)]
    got = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every_run=True).collect()
    texts = sorted((str(r.doc_id), r.text) for r in got)
    assert ("2", own) in texts and ("1", p) in texts and ("2", "") in texts
    assert ("None", f"Third unique. {own[:40]} here. And a tail of it.") in texts and ("None", "short") in texts
    assert ("None", passage(5, 7) + " ") in texts and ("3", "") in texts


def test_query_removes_every_run(spark, tmp_path):
    from cityloom.llm.queries import op10_span_dedup

    lone = " ".join(f"l{k}" for k in range(50))
    spark.createDataFrame([(1, lone), (2, lone)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.untouched for r in op10_span_dedup(spark, str(tmp_path)).collect()} == {1: True, 2: False}
