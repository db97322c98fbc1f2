"""Components searched in few rounds, and continued with more edges."""

from quarry.llm import _shared


def test_stars_take_no_round(spark, monkeypatch):
    written, stored = [], _shared.stored
    monkeypatch.setattr(_shared, "stored", lambda *x: written.append(1) or stored(*x))
    stars = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(k, 100) for k in range(101, 140)], "a long, b long")
    assert {(r.node, r.component) for r in _shared.components(stars).collect()} == {(k, 0) for k in range(40)} | {(k, 100) for k in range(100, 140)}
    assert len(written) == 1


def test_a_centre_that_is_not_the_least_takes_one_round(spark, monkeypatch):
    written, stored = [], _shared.stored
    monkeypatch.setattr(_shared, "stored", lambda *x: written.append(1) or stored(*x))
    edges = spark.createDataFrame([(20, k) for k in range(40) if k != 20], "a long, b long")
    assert {(r.node, r.component) for r in _shared.components(edges).collect()} == {(k, 0) for k in range(40)}
    assert len(written) == 2


def test_more_edges_go_on_from_what_was_found(spark):
    first, later = [(k, k + 1) for k in range(0, 30, 2)] + [(50, 60), (60, 70)], [(1, 3), (31, 70), (80, 81), (81, 5), (2, 2), (90, 91)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    found = _shared.stored(_shared.components(frame(first)))
    rows = lambda df: sorted((r.node, r.component) for r in df.collect())
    assert rows(_shared.components_with(found, frame(later))) == rows(_shared.components(frame(first + later)))
    assert rows(_shared.components_with(_shared.stored(_shared.components(frame([]))), frame(later))) == rows(_shared.components(frame(later)))
