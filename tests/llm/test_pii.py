"""Selected candidates by held-out precision and recall, calibration, and odd rows."""

import numpy as np
import pytest

from cohesia.llm import pii


@pytest.fixture(scope="module")
def judged():
    detector = pii.train()
    rows = pii._examples(99, 6000)
    kinds = np.array([c[2] for _, c, _ in rows])
    p = detector.probabilities(kinds.tolist(), np.array([pii.features(t, c) for t, c, _ in rows]))
    return detector, kinds, p, np.array([y for *_, y in rows])


def test_precision_and_recall_by_kind(judged):
    detector, kinds, p, y = judged
    assert set(detector.thresholds) == {"phone", "secret", "ssn", "iban", "address"}
    for kind, limit in detector.thresholds.items():
        own = kinds == kind
        chosen = p[own] >= limit
        assert y[own][chosen].mean() >= pii.PRECISION - 0.03, kind
        assert chosen[y[own] == 1].mean() >= 0.8, kind


def test_probabilities_are_calibrated_and_thresholds_act(judged):
    detector, kinds, p, y = judged
    edges = np.linspace(0, 1, 11)
    for low, high in zip(edges, edges[1:], strict=False):
        some = (p >= low) & (p < high)
        if some.sum() >= 100:
            assert abs(p[some].mean() - y[some].mean()) < 0.12, low
    assert 0 < min(detector.thresholds.values()) and len(set(detector.thresholds.values())) >= 4
    open_ = pii.Detector(detector.trees, detector.calibration, dict.fromkeys(detector.thresholds, 0.0))
    for text in ("see page: introduction of part no. 123-45-6789", "version 0123 456 7890 of it"):
        assert open_.spans(text) and not detector.spans(text)


def test_forms(judged):
    detector = judged[0]
    found = lambda t: {(t[a:b], k) for a, b, k in detector.spans(t)}
    assert found("write john (at) example (dot) com please") == {("john (at) example (dot) com", "address")}
    assert ("hunter2", "secret") in found("jdbc:mysql://root:hunter2@db/x")
    assert found("Authorization: Bearer abcDEF0123456789abcDEF0123") == {("abcDEF0123456789abcDEF0123", "secret")}
    assert found("my password is hunter2, ok") == {("hunter2", "secret")}
    for clean in ("the password is required", "Bearer of bad news: Bearer", "see https://www.example.org/path/to/page-12/index.html now", "Chapter 12: the house at the end dot"):
        assert found(clean) == set(), clean


def test_odd_rows_and_names(spark):
    long = "clean words of a text " * 60_000 + "mail a.b@c.org token=" + "ab12" * 300 + " end"
    rows = [(1, "mail a.b@c.org now", 5, "x"), (1, "nothing", 5, "x"), (None, "ip 10.0.0.1", None, None), (2, None, 1, "y"), (3, "", 1, "y"), (4, long, 1, "z"), (1, "nothing", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n a.b` int, spans string")
    out = pii.redact(df)
    assert out.columns == df.columns
    got = sorted(((x["doc_id"] or 0, x["text"], x["n a.b"]) for x in out.collect()), key=str)
    assert got[:1] == [(0, "ip [IP]", None)] and (1, "mail [EMAIL] now", 5) in got and (2, None, 1) in got and (3, "", 1) in got and len(got) == 7
    assert next(t for d, t, _ in got if d == 4).endswith("mail [EMAIL] token=[SECRET] end")
    found = pii.find(df).collect()
    assert len(found) == 7 and {x["n_ip"] for x in found if x["doc_id"] is None} == {1}
    assert pii.redact(df.limit(0)).count() == 0


def test_long_runs_take_time_in_proportion():
    for text in ("password " * 30_000, "a." * 100_000, "://a:" * 40_000, "x at y dot " * 20_000, "12-" * 60_000, "Aa0/" * 60_000):
        pii.candidates(text)
