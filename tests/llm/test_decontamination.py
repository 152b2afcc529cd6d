"""Decontamination against full alignments, and on odd rows."""

import random
import resource

import numpy as np
import pytest

from cohesia.llm import decontamination as dec


def fewest(item, text):
    """Fewest edits of the whole item against any part of the text."""
    cost = np.zeros(len(text) + 1, dtype=int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(cost)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(cost[j - 1] + (c != d), cost[j] + 1, new[j - 1] + 1)
        cost = new
    return int(cost.min())


def edited(r, item, n, alphabet):
    out = list(item)
    for _ in range(n):
        at = r.randrange(len(out))
        out[at : at + r.randint(0, 1)] = r.choice(("", r.choice(alphabet)))
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop"])
def test_against_full_alignment(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(250):
        m = r.choice((1, 5, 7, 8, 9, 10, 12, 15, 16, 20, 22, 23, 30, 31, 33, 40, 57, 80))
        item = "".join(r.choice(alphabet) for _ in range(m))
        e = dec.edits_allowed(m)
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) + edited(r, item, r.randint(0, e + 1), alphabet) + "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        hits = dec.Index([(1, item), (2, "never " * 9)]).search(text)
        least = fewest(dec.normal(item), dec.normal(text))
        assert bool(hits) == (least <= e), (item, text, least, e)
        if hits:
            assert hits[0][3] <= e
            assert dec.Index([(1, item)]).search(text, best=False)


def test_windows_lose_nothing(monkeypatch):
    monkeypatch.setattr(dec, "WINDOW", 500)
    monkeypatch.setattr(dec, "AT_ONCE", 50)
    r = random.Random(9)
    item = "".join(r.choice("abcdefgh ") for _ in range(90)).strip()
    index = dec.Index([(1, item)])
    for at in range(0, 1500, 37):
        text = "".join(r.choice("abcdefgh") for _ in range(at)) + "x" + edited(r, dec.normal(item), 5, "abcdefgh") + "y" + "z" * 700
        assert index.search(text), at


def test_long_periodic_text_is_bounded():
    item = "abcdefghij" * 20
    index = dec.Index([(1, item)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert index.search("abcdefghij" * 200_000, best=False)
    assert index.search("abcdefghijabcdefghij--zzy" * 1_500, best=False) == []
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


def test_rows_keep_their_own_answers(spark, monkeypatch):
    item, other = "what is the capital of the old northern kingdom", "name three rivers that never reach the open sea"
    rows = [(None, f"so {item} then"), (None, "clean"), (7, "clean words only"), (7, f"x {item} {other}"), (8, None), (9, ""), (7, f"x {item} {other}")]
    docs = spark.createDataFrame([(d, t, "a") for d, t in rows], "doc_id long, text string, `item ids.x` string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, other), (3, None), (None, "")], "item_id long, text string")
    for block in (dec.BLOCK_CHARS, 10):
        monkeypatch.setattr(dec, "BLOCK_CHARS", block)
        got = sorted(((x["doc_id"] or 0, x["contaminated"], x["n_items"], tuple(x["item_ids"])) for x in dec.report(docs, bench).collect()))
        assert got == sorted([(0, True, 1, (1,)), (0, False, 0, ()), (7, False, 0, ()), (7, True, 2, (1, 2)), (8, False, 0, ()), (9, False, 0, ()), (7, True, 2, (1, 2))])
        kept = dec.remove(docs, bench)
        assert kept.columns == docs.columns and kept.count() == 4
    assert dec.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert dec.report(docs.limit(0), bench).count() == 0
