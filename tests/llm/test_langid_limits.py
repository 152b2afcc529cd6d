import base64
import random

from cohesia.llm import langid

SF = "/root/testdata/sf0.01"


def test_unknown_latin_texts_and_noise_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    r = random.Random(1)
    texts = [
        "La casa è grande e il giardino dietro la cucina era pieno di fiori quando i bambini tornavano dalla scuola con gli amici della sera. ",
        "Dom był bardzo duży, a ogród za kuchnią był pełen kwiatów, kiedy dzieci wracały ze szkoły razem z przyjaciółmi z sąsiedztwa wieczorem. ",
        "Talo oli hyvin suuri ja puutarha keittiön takana oli täynnä kukkia kun lapset palasivat koulusta ystäviensä kanssa illalla kotiin. ",
        "Ev çok büyüktü ve mutfağın arkasındaki bahçe çocuklar akşam arkadaşlarıyla okuldan eve dönerken çiçeklerle doluydu her zaman. ",
        "def parse(self, args): for i in range(len(args)): self.value[i] = int(args[i]) if args[i].isdigit() else None; return self.value ",
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(300)),
        base64.b64encode(bytes(r.randrange(256) for _ in range(1500))).decode(),
    ]
    assert model.predict(texts)[2] == [True] * len(texts)
    assert model.predict([t * 8 for t in texts])[2] == [True] * len(texts)
