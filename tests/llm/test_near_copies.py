import random

from cohesia.llm import near_copies, simhash

SCHEMA = "doc_id long, text string"


def _text(r, n=120):
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def test_pairs_beyond_three_bits_are_joined(spark):
    r = random.Random(3)
    rows, far = [], 0
    for k in range(20):
        one = _text(r)
        two = [*one[:60], "changed", *one[61:]]
        a, b = " ".join(one), " ".join(two)
        assert near_copies.similar(near_copies.shingles(a), near_copies.shingles(b))
        far += (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3
        rows += [(2 * k, a), (2 * k + 1, b)]
    assert far >= 5
    other = _text(r)
    rows += [(100, " ".join(other)), (101, " ".join([*other[:60], *_text(r, 60)])), (102, None), (103, " ")]
    got = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(x["doc_id"] for x in got.collect()) == [*range(0, 40, 2), 100, 101, 102]


def brute(rows):
    """Kept (doc_id, text) by comparing all pairs of texts."""
    sets = [set(near_copies.shingles(t).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root(i), []).append(row)
    return sorted(min(g, key=lambda x: (x[0] is None, x[0])) for g in groups.values())


def test_against_all_pairs(spark):
    r = random.Random(11)
    passage, line = _text(r, 60), _text(r, 12)
    rows, k = [], 0
    for _ in range(12):  # families: each text is a small change of an earlier one, so that ends of a chain may be unlike
        family = [_text(r, r.choice((6, 20, 60, 200)))]
        for _ in range(r.randint(1, 25)):
            one = list(r.choice(family))
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(one))
                one[at : at + r.randint(0, 2)] = _text(r, r.randint(0, 2))
            family.append(one)
        rows += [" ".join(t) for t in family]
    rows += [" ".join(_text(r, r.randint(0, 30)) + passage + _text(r, r.randint(0, 30))) for _ in range(80)]  # one passage in ever new surroundings
    rows += [" ".join(line + _text(r, r.randint(0, 4))) for _ in range(60)]  # a common line, alone or with a few words
    rows += ["", " ", "one two", "one two", "One TWO", None]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    got = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted((x["doc_id"], x["text"]) for x in got.collect()) == brute(rows)


def test_any_column_names_pass_through(spark):
    df = spark.createDataFrame([(1, "some text of words here", 1, 2, 3), (1, "some text of words here", 1, 2, 3), (2, "some text of words here", 1, 2, 3)], "doc_id long, text string, r1 int, `a b.c` int, first_id int")
    got = near_copies.keep_one(df)
    assert got.columns == df.columns and [x["doc_id"] for x in got.collect()] == [1]
    assert near_copies.keep_one(df.limit(0)).count() == 0
