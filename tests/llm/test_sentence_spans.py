"""Removal of repeated runs of sentences against a slow loop over characters."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rosterlab.llm import substring_dedup

MARKS, BLANKS = ".!?。！？।؟…", " \t\r\n"
PASSAGE = (
    "Seventeen grey herons waited beside the broken mill while a carter, who had lost both his gloves, argued "
    "with the toll keeper about copper coins; nobody else on the long road listened, for rain was coming down "
    "from the hills and every shutter in the village had been closed since noon"
)


def split(text):
    """Sentences as (begin, end, words): characters are looked at one by one."""
    words, at = [], 0
    while at < len(text):
        begin = at
        while at < len(text) and text[at] in BLANKS:
            at += 1
        if at == len(text):
            break
        start = at
        while at < len(text) and text[at] not in BLANKS + MARKS:
            at += 1
        while at < len(text) and text[at] in MARKS:
            at += 1
        words.append((begin, start, at))
    found = []
    for i, (begin, start, end) in enumerate(words):
        before = text[words[i - 1][1] : words[i - 1][2]] if i else "."
        cut = before[-1] in MARKS or hashlib.md5(before.encode()).digest()[0] < 43
        if cut or "\n" in text[begin:start]:
            found.append([begin, end, [text[start:end]]])
        else:
            found[-1][1] = end
            found[-1][2].append(text[start:end])
    return found


def expected(rows, run):
    """(id, text, sentences, removed) for each row; null ids first, then by a hash of the text."""
    seen, out = set(), {}
    for doc, _, text in sorted({(-(1 << 63) if r[0] is None else r[0], r[2], r[1] or "") for r in rows}):
        found = split(text)
        drop = set()
        for i in range(max(1, len(found) - run + 1) if found else 0):
            part = found[i : i + run]
            span = " ".join(w for s in part for w in s[2])
            if span in seen:
                drop |= set(range(i, i + len(part)))
            seen.add(span)
        left = "".join(
            c for at, c in enumerate(text) if not any(found[n][0] <= at < found[n][1] for n in drop)
        )
        out[doc, text] = (left, len(found), len(drop))
    return sorted((r[0] or -1, *out[-(1 << 63) if r[0] is None else r[0], r[1] or ""]) for r in rows)


def check(table, how):
    rows = [tuple(r) for r in table.select("doc_id", "text", F.xxhash64("text")).collect()]
    got = substring_dedup.remove_repeats(table, how).collect()
    figures = sorted((r["doc_id"] or -1, r["text"], r["n_sentences"], r["n_removed"]) for r in got)
    assert figures == expected(rows, how.run)
    return figures


@pytest.mark.parametrize("flush", [1, 12 << 20])
def test_odd_rows(spark, flush):
    alone = "".join(f"Sentence {i} of a text that no other row of the table has. " for i in range(9))
    twice = "".join(f"Line {i} of a passage that comes again further down. " for i in range(4))
    rows = [
        (1, alone), (1, alone), (1, "another text of id one"), (2, twice + "\n" + twice), (3, twice), (4, None),
        (5, ""), (6, " \n\t"), (7, "Of it."), (8, "Of it."), (None, "Of it."), (9, "a" * 5000), (10, "a" * 5000),
        (11, "..!? 。。"), (12, "日本語の文。もう一つの文！" * 8), (13, "x 日本語の文。もう一つの文！" * 8),
        (14, "word " * 3000), (15, "é " + PASSAGE), (16, "Before it stands this, " + PASSAGE + " and this after."),
    ]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, a string, at int")
    for run in (2, 6):
        figures = check(table.repartition(3), substring_dedup.Spans(run=run, flush_bytes=flush))
        if run == 6:  # the text's sentences differ by their numbers only
            assert [f[3] for f in figures if f[0] == 1 and f[1] == alone] == [0, 0]
    assert substring_dedup.remove_repeats(table.limit(0)).count() == 0


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), substring_dedup.Spans())


def test_a_passage_is_found_whatever_surrounds_it(spark):
    """Less than half of it is left, though no whole sentence by full stops lies in it."""
    rows = [(i, f"Opening number {i} runs on into {PASSAGE} up to ending number {i}.") for i in range(6)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for r in got:
        left = sum(w in r["text"] for w in ("carter", "gloves", "toll", "copper", "listened", "shutter"))
        assert left == (6 if r["doc_id"] == 0 else 0), r
        assert f"Opening number {r['doc_id']} " in r["text"] and r["text"].endswith(f"number {r['doc_id']}.")
