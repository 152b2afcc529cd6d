"""Language ID with many languages and odd rows."""

import random
import resource

from cohesia.llm import langid


def test_every_language_is_learned(spark):
    """500 languages, the frequent ones late in the alphabet; the driver holds centroids, not samples."""
    r = random.Random(2)
    words = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(25)] for k in range(500)}
    rows, k = [], 0
    for lang, own in words.items():
        for _ in range(8):
            rows.append((k, " ".join(r.choice(own) for _ in range(60)), lang))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model = langid.fit(docs)
    assert sorted(set(model.langs)) == sorted(words)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    texts = [(lang, " ".join(r.choice(own) for _ in range(60))) for lang, own in words.items()]
    right = sum(a == lang for a, (lang, _) in zip(model.predict([t for _, t in texts])[0], texts, strict=True))
    assert right >= 490


def test_numbers_are_no_letters_and_names_may_be_odd(spark):
    rows = [(1, "½ ² ① ٣ 12", "en", 1), (2, "plain english words of the text", "en", 2), (2, "plain english words of the text", "en", 2), (None, "words without an id", "en", 3), (3, "ª", None, 4), (4, None, "en", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a b.c` int")
    got = langid.identify(df).collect()
    assert len(got) == 6 and [x["lang_pred"] for x in got if x["doc_id"] in (1, 4)] == ["und"] * 2
    assert not any(x["held_out"] for x in got if x["doc_id"] is None)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} <= {2, 3, None}
