"""License scans against a brute-force search for phrases, with odd rows, edited quotations and look-alikes."""

import random
import re
from collections import Counter

import pytest

from arrayflow.llm import licenses

DDL = "doc_id bigint, text string, row string, words string, label string, n string, place string, quote string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def make(spark, pairs):
    return spark.createDataFrame([(k, t, "r", "w", "l", "n", "p", None) for k, t in pairs], DDL).repartition(3)


def brute(key, text):
    words = WORD.findall((text or "").translate(A_TO_Z))
    found = [(i, label) for label, phrase in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return key, len(words), len(found), min(starts, default=None), max(starts, default=None), tuple(sorted({x for _, x in found}))


def test_phrases(spark):
    rng = random.Random(3)
    words = ["cc", "by", "CC", "By", "general", "public", "License", "all", "rights", "reserved", "ALL", "x", "é", "Kept", "cſ"]
    texts = [rng.choice([" ", "\n", "-", ". "]).join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " .,; ", "cc", "cc by", "ccby", "cc.by", "İcc by", "cc by" * 3, "by cc by cc by", "cc by " * 3000, "all rights reserved", "rights reserved all"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "cc by"), (None, None), (0, texts[0]), (0, "all rights reserved")]
    got = licenses.scan(make(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], tuple(r["base_labels"])) for r in got) == Counter(
        brute(*r) for r in rows)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"]) <= set(r["labels"]) and (r["score"] == 1) >= (r["n_base"] > 0) for r in got)


def scan_one(spark, text, **options):
    return licenses.scan(make(spark, [(1, text)]), **options).first()


MIT = dict(reversed(licenses.TEMPLATES))["mit"]
LONG = max((text for _, text in licenses.TEMPLATES), key=len)


@pytest.mark.parametrize("text, labels", [
    (f"foo {LONG.upper()} bar", {"bsd"}),
    (f"foo {LONG.replace('source and', 'source code and also')} bar", {"bsd"}),
    (f"foo {LONG.replace('or without modification ', '')} bar", {"bsd"}),
    (" ".join(LONG.split()[:9]), set()),
    (" ".join(reversed(LONG.split())), set()),
    (" filler words between ".join(LONG.split()), set()),
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}),
    ("Licensed under CC BY-SA 4.0.", {"cc-by", "cc-by-sa"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("under the under the under the under the", set()),
])
def test_quotations(spark, text, labels):
    got = scan_one(spark, text)
    assert set(got["labels"]) == labels
    assert (got["score"] > 0) == bool(labels)


def test_spans(spark):
    text = f"one two {MIT} three four {MIT.replace('person', 'natural person')} five"
    spans = scan_one(spark, text)["spans"]
    n = len(MIT.split())
    assert [(s["start"], s["end"], s["label"]) for s in spans] == [(2, 2 + n, "mit"), (4 + n, 5 + 2 * n, "mit")]
    assert spans[0]["share"] == 1 > spans[1]["share"] > 0.8


def test_own_templates(spark):
    got = scan_one(spark, "um ÜBER alles", phrases={"p": "über alles"}, templates=[])
    assert got["n_base"] == 0
    assert scan_one(spark, "Um über Alles", phrases={"p": "über alles"}, templates=[])["first_word"] == 1
    for bad in ({"p": "word"}, {"a,b": "two words"}):
        with pytest.raises(ValueError):
            scan_one(spark, "text", phrases=bad)


def test_empty_and_long(spark):
    assert licenses.scan(make(spark, []).limit(0)).count() == 0
    got = scan_one(spark, "x " * 200_000 + "cc by")
    assert (got["n_words"], got["first_word"]) == (200_002, 200_000)
