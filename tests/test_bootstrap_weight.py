from cohesia.functions import external


def test_rare_classes_keep_their_weight(spark, monkeypatch):
    seen = {}
    real = external.ari_of

    def spy(table, keys):
        for r in table.groupBy("round", "t").sum("nij").collect():
            seen[r["round"], r["t"]] = r["sum(nij)"]
        return real(table, keys)

    monkeypatch.setattr(external, "ari_of", spy)
    ids = spark.range(4000).selectExpr("id as i", "if(id < 3960, 'big', if(id < 3980, 'rare', 'scarce')) as t", "cast(id % 3 as string) as p")
    external.weighted_bootstrap(ids, "t", "p", "i", rounds=3).collect()
    assert len(seen) == 9
    assert all(abs(w - 4000 / 3) < 200 for w in seen.values()), seen  # the rare ones had about 240
