from cohesia.llm import near_copies


def test_null_and_repeated_ids_lose_no_text(spark):
    rows = [(None, "one clean text about rivers and boats"), (None, "quite another text on trains"), (7, "a third text of its own words"), (7, "some fourth thing entirely different here"), (7, "a third text of its own words"), (3, "quite another text on trains")]
    got = [(x["doc_id"], x["text"]) for x in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)
