import random

from cohesia.llm import pii


def test_long_secrets_are_whole(spark):
    r = random.Random(8)
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    detector = pii.train()
    for n in (200, 256, 257, 601, 3000):
        value = f"{mixed(n // 3)}.{mixed(n // 3)}.{mixed(n - 2 * (n // 3) - 2)}"
        text = f"before token={value} after"
        spans = detector.spans(text)
        assert (13, 13 + n, "secret") in spans
        assert pii._replaced(text, spans) == "before token=[SECRET] after"
        plain = mixed(n)
        assert (5, 5 + n, "secret") in detector.spans(f"take {plain} now")


def test_many_signs_in_one_run_are_linear():
    text = "&".join(f"key{k}=value{k}" for k in range(20_000))
    assert all(e == len(text) for a, e, _ in pii.candidates(text) if e - a > pii.HEAD)
