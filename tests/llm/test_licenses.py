"""License scan against its SQL on odd rows, row by row."""

from cohesia.llm import licenses


def test_rows_keep_their_own_labels(spark):
    import duckdb

    notice = licenses.TEMPLATES[8][1]
    rows = [
        (1, "plain words only"), (1, "Licensed under CC BY-NC 4.0"), (1, "Licensed under CC BY-NC 4.0"), (None, "This is " + notice.upper()), (None, "nothing here"), (2, None), (3, ""), (4, "MIT license"),
        (5, "word " * 40 + notice + " word" * 200 + " apache license"), (6, ("x " * 31 + notice + " ") * 3), (7, " ".join(notice.split()[:-1])), (8, " ".join(notice.split()[:12])), (9, "½ ² mit LICENSE café"),
        (10, " ".join(f"{w} filler" for w in notice.split())), (11, " ".join(reversed(notice.split()))),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    q = con.execute(licenses.oracle_sql())
    names = [c[0] for c in q.description]
    want = sorted(map(str, (dict(zip(names, x, strict=True)) for x in q.fetchall())))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, `label.s x` string")
    got = licenses.scan(df).collect()
    assert sorted(str({n: x[n] for n in names}) for x in got) == want
    assert [x["labels"] for x in got if x["doc_id"] == 1].count("") == 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "MIT license")], "doc_id long, text string")
    plan = licenses.digest(df)._jdf.queryExecution().toString() + licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
