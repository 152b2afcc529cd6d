"""Operators whose results are fixed by definition, against brute force on small fixtures and whole small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from hypothesis import given, settings
from hypothesis import strategies as st

from cohesia.llm import decontamination, html_text, licenses, packing, pii, quality, simhash, suffix_array, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None, "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, copies, a long text and rows with null columns."""
    long = " ".join(f"word{i % 97} thing{i % 31}" for i in range(9000))
    texts = [None, "", " \n\t ", "one", "Same text here today", "Same text here today", long, long + " end", "a b c d e f g h a b c d e f g h", "A\nA\nb\n\nb", "café naïve ÉTÉ 日本 😀", "x" * 3000]
    return docs(spark, texts).unionByName(spark.createDataFrame([(4, "Same text here today", None, None, None, None), (None, "no id", None, None, None, None)], SCHEMA))


@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_suffix_arrays(texts):
    for t, order in zip(texts, suffix_array.suffix_arrays([np.array(t, dtype=np.int64) for t in texts]), strict=True):
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute_repeats(rows, n=50):
    seen, out = {}, {}
    for doc in sorted({d for d, _ in rows if d is not None}):
        new = set()
        for d, text in rows:
            if d == doc:
                raw = (text or "").encode()
                gone = np.zeros(len(raw), bool)
                for i in range(len(raw) - n + 1):
                    if raw[i : i + n] in seen:
                        gone[i : i + n] = True
                    new.add(raw[i : i + n])
                spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
                out.setdefault(doc, set()).add((len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
        seen |= dict.fromkeys(new)
    return out


def test_suffix_dedup(spark, odd, monkeypatch):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(180))
    texts = [passage[:120], "".join(r.choice("ab") for _ in range(400)), "zz" * 80] + [f"{r.random()}{passage[r.randint(0, 60) : r.randint(100, 180)]}{r.random()}" for _ in range(90)] + ["zz" * 60, passage + passage]
    rows = list(enumerate(texts))
    want = brute_repeats(rows)
    for wide in (64, 3, 0):
        monkeypatch.setattr(suffix_dedup, "WIDE", wide)
        got = {x["doc_id"]: {(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"])} for x in suffix_dedup.digest(docs(spark, texts)).collect()}
        assert got == want
    with monkeypatch.context() as m:  # without the suffix arrays only regions that are equal as a whole go
        m.setattr(suffix_dedup, "earlier_strings", lambda regions, firsts, members: np.zeros(len(regions), dtype=np.int64))
        left = sum(x["n_removed"] for x in suffix_dedup.digest(docs(spark, texts)).collect())
        assert left < 0.8 * sum(n for x in want.values() for _, n, *_ in x)
    got = suffix_dedup.deduplicate(odd).collect()
    assert len(got) == odd.count()
    want = brute_repeats([(x["doc_id"], x["text"]) for x in odd.collect()])
    for x in got:
        if x["doc_id"] is None:
            assert x["n_removed"] == 0
        else:
            assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) in want[x["doc_id"]]
    assert suffix_dedup.digest(docs(spark, []).limit(0)).count() == 0


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack(odd, WORD_BPE).collect()
    by_seq: dict[int, list] = {}
    for x in rows:
        by_seq.setdefault(x["sequence_id"], []).append(x)
    for pieces in by_seq.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= packing.CAPACITY
    for d, text in [(x["doc_id"], x["text"]) for x in odd.collect() if x["doc_id"] not in (4, None)]:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted((x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows if x["doc_id"] == d)
        assert mine == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert packing.pack(odd.limit(0), WORD_BPE).count() == 0


def textbook_best_fit(histogram, capacity):
    gaps = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_pack_plan(histogram):
    patterns = packing.plan_patterns(histogram, 64)
    used: dict[int, int] = {}
    for combo, times in patterns:
        assert sum(combo) <= 64 and times > 0
        for n in combo:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    most = textbook_best_fit(histogram, 64)
    assert sum(t for _, t in packing.best_fit(histogram, 64)) == most
    assert sum(t for _, t in patterns) <= most


def test_exact_fills_beat_best_fit():
    """On lengths of many kinds the index packs fuller than best fit alone; without it that is lost."""
    r = random.Random(1)
    total = lambda plan: sum(t for _, t in plan)
    fewer = 0
    for low, high, some in ((500, 1100, 200), (1, 2049, 2048), (50, 900, 400), (300, 700, 300)):
        histogram = {n: r.randint(1, 20) for n in r.sample(range(low, high), some)}
        plain, plan = total(packing.best_fit(histogram, 2048)), total(packing.plan_patterns(histogram, 2048))
        assert plain >= plan >= -(-sum(n * c for n, c in histogram.items()) // 2048)
        fewer += plan < plain
    assert fewer >= 3


@given(st.lists(st.text(alphabet="ab thE'é日\n\t▁ 1!😀ſ", max_size=40), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_tokens_as_the_libraries_have_them(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    assert token_counts.counter(PIECE_BPE).count(texts) == [len(x) for x in model.encode(texts)]
    whole, own = Tokenizer.from_file(WORD_BPE), packing.tokenizer(WORD_BPE)
    assert [np.frombuffer(own.ids(t), "<u4").tolist() for t in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = token_counts.token_counts(odd, PIECE_BPE).collect()
    assert sorted((x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in got) == sorted((len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for t in [x["text"] for x in odd.collect()])
    counter = token_counts.counter(PIECE_BPE)
    r = random.Random(7)
    long = ["a" * 4000, "=" * 900 + "ab" * 700, " " * 1500, "é" * 1300, "日本語文章" * 900, "".join(r.choice("ACGT") for _ in range(5000)), "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(20_000))]
    for t in long:
        assert counter.count([t]) == [len(model.encode(t))]
    for letters in ("ab", "the", "inga", "eration ", "=-*", "0123456789"):
        some = ["".join(r.choice(letters) for _ in range(r.randint(1, 400))) for _ in range(300)]
        assert counter.count(some) == [len(x) for x in model.encode(some)]


def test_covering_masks_lose_nothing():
    masks, r = simhash.covering_masks(), random.Random(1)
    assert len(masks) == 15
    for _ in range(2000):
        bits = sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
        assert any(not bits & m for m in masks)


def plain_fingerprint(text):
    """Bit by bit from the definition."""
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return format(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), "016x")


def test_simhash_components(spark, odd, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 40)
    r = random.Random(2)
    start, prints = r.getrandbits(64), []
    for _ in range(300):  # a crowd around one fingerprint, and strangers
        v = start
        for b in r.sample(range(64), r.randint(0, 5)):
            v ^= 1 << b
        prints.append(v)
    prints += [r.getrandbits(64) for _ in range(50)]
    values = np.array(sorted(set(prints)), dtype=np.uint64)
    links = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    from cohesia.llm.components import connected_components
    from cohesia.session import Scratch

    scratch = Scratch(spark)
    got = {x["node"]: x["component"] for x in connected_components(simhash.near_links(links, scratch), scratch).collect()}
    monkeypatch.setattr(simhash, "SPLIT", 5)  # what no worker may hold is dealt anew, three times
    split = {x["node"]: x["component"] for x in connected_components(simhash.near_links(links.repartition(3), scratch), scratch).collect()}
    assert split == got
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            parent[max(root(i), root(int(j)))] = min(root(i), root(int(j)))
    groups: dict[int, set] = {}
    for i, v in enumerate(values.view(np.int64).tolist()):
        groups.setdefault(root(i), set()).add(v)
    want = {v: min(g) for g in groups.values() if len(g) > 1 for v in g}
    assert got == want
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(x["doc_id"], x["fingerprint"]) for x in rows} == {(x["doc_id"], plain_fingerprint(x["text"])) for x in odd.collect()}
    zero = {x["component_id"] for x in rows if x["fingerprint"] == "0" * 16}
    assert zero == {0}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_html(spark):
    page = (
        "<html><head><title>No</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><div class='ad'>Buy</div><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Head &amp; more</h1><p>First   long\nparagraph of the article<br>goes on here.</p><p>Ok.</p><form>Name <input></form></article><aside>Other</aside><div id='comments'><p>A reader writes</p></div><footer>Foot</footer>"
    )
    assert html_text.main_text(page) == "Head & more\n\nFirst long paragraph of the article goes on here.\n\nOk."
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, None), (3, "u", "", "x"), (3, "u", "<p>open <b>bold", "x")], "page_id long, url string, html string, text string")
    assert sorted((x["page_id"], x["text"], x["n_chars"]) for x in html_text.extract(rows).collect())[1:] == [(2, "", 0), (3, "", 0), (3, "open bold", 9)]


def test_pii(spark, odd):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and pii._luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    r = random.Random(4)
    for _ in range(4000):
        t = "".join(r.choice(["a", ".", "@", "-", "+", "1", "29", " ", "(", ")", "a@b.c", "10.0.0.1", "4111111111111111", "+1 555 123 4567"]) for _ in range(14))
        want = sorted((*m.span(), k) for k, p in patterns.items() for m in re.finditer(p, t) if good[k](m[0]))
        assert sorted(pii.base_spans(t)) == want
    d = pii.train()
    found = d.spans('Call (212) 555-0199, password=hunter2secret99 token = "ab12cd34ef56ab12cd34ef56" or see version 12 345 678')
    assert {k for *_, k in found} == {"phone", "secret"}
    assert d.spans("An ordinary sentence with 12 words, a date 2024-01-02 and page: introduction.") == []
    out = pii.redact(docs(spark, ["mail a.b@c.org now", None])).collect()
    assert [x["text"] for x in sorted(out, key=lambda x: x["doc_id"])] == ["mail [EMAIL] now", None]
    assert pii.find(odd).count() == odd.count() and pii.find(odd.limit(0)).count() == 0


def test_decontamination(spark, odd):
    r = random.Random(6)
    item = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(30))
    edited = item.replace(item[40:44], "zz").replace(item[90:92], "")
    rows = ["before " + item.upper() + " after", "x " + edited + " y", item[: len(item) // 2], "clean text of its own", None, "tiny q"]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny q")], "item_id long, text string")
    got = {x["doc_id"]: x["item_ids"] for x in decontamination.report(docs(spark, rows), bench).collect()}
    assert got == {0: [7], 1: [7], 2: [], 3: [], 4: [], 5: [10]}
    assert sorted(x["doc_id"] for x in decontamination.remove(docs(spark, rows), bench).collect()) == [2, 3, 4]
    assert decontamination.remove(odd, bench.limit(0)).count() == odd.count()


def test_license_scan_on_odd_texts(spark, odd):
    import duckdb

    rows = [*(x["text"] for x in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()), "MIT license; the MIT-License. Apache LICENSE", "Released under\nthe MIT License.", "Licensed under CC BY-NC 4.0", "general public license general public license"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(rows)))
    q = con.execute(licenses.oracle_sql())
    names = [c[0] for c in q.description]
    want = sorted(map(str, (dict(zip(names, x, strict=True)) for x in q.fetchall())))
    assert sorted(str({n: x[n] for n in names}) for x in licenses.scan(docs(spark, rows)).collect()) == want
    assert licenses.scan(odd).count() >= odd.count()


def test_quality(spark, odd, sf):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at: dict[tuple, list] = {}
        for i in range(len(words) - 7):
            at.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)

    for frame in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        got = quality.judge(frame).collect()
        key = lambda x: tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert sorted(map(key, got)) == sorted(brute(x["text"]) for x in frame.collect())
        assert not any(x["kept"] for x in got if x["base_failed"])
    assert quality.judge(odd.limit(0)).count() == 0
