"""Receipts: nothing is hashed or run again that hasn't changed."""

import pytest

from folium.operators import receipts


@pytest.fixture
def counted(monkeypatch):
    calls = []
    real = receipts.set_digest
    monkeypatch.setattr(receipts, "set_digest", lambda *a: (calls.append(1), real(*a))[1])
    return calls


def rows(spark, data):
    return spark.createDataFrame(data, "id int, sha string, text string")


def test_a_derivation_is_run_once_for_each_content(spark, tmp_path, counted):
    folder, runs = str(tmp_path / "log"), []
    data = [(1, "a", "x"), (2, "b", "y")]
    watched = lambda d: receipts.Watched(rows(spark, d), "id", ("text",), ("sha",))

    def build(expected=2, failures=0, out=None):
        runs.append(1)
        return receipts.Watched(out if out is not None else rows(spark, data), "id", ("text",)), expected, failures

    assert receipts.latest(spark, folder, "d") is None
    assert receipts.derive(folder, "d", "1", watched(data), build) == "complete" and len(counted) == 2
    assert receipts.derive(folder, "d", "1", watched(data[::-1]), build) == "unchanged" and len(counted) == 2 and len(runs) == 1
    other = [(1, "c", "x"), (2, "b", "y")]  # another mark of the same content
    assert receipts.derive(folder, "d", "1", watched(other), build) == "same_content" and len(counted) == 3 and len(runs) == 1
    assert receipts.derive(folder, "d", "1", watched(other), build) == "unchanged" and len(counted) == 3
    assert receipts.derive(folder, "d", "2", watched(other), build) == "complete" and len(runs) == 2
    changed = [(1, "d", "z"), (2, "b", "y")]
    assert receipts.derive(folder, "d", "2", watched(changed), lambda: build(expected=3)) == "partial"
    assert receipts.derive(folder, "d", "2", watched(changed), lambda: build(failures=1)) == "partial"
    assert receipts.latest(spark, folder, "d")["input_mark"] == watched(other).mark()
    assert receipts.derive(folder, "d", "2", watched(changed), build) == "complete" and len(runs) == 5
    assert [r["status"] for r in receipts.log(spark, folder).orderBy("at").collect()] == ["complete", "complete", "complete", "partial", "partial", "complete"]
    assert receipts.derive(folder, "other", "1", watched(data), build) == "complete"
    out = receipts.Watched(rows(spark, data), "id", ("text",))
    assert receipts.current(folder, "d", "2", watched(changed), out) and not receipts.current(folder, "d", "1", watched(changed), out)
    assert not receipts.current(folder, "d", "2", watched(data), out) and not receipts.current(folder, "d", "2", watched(changed), receipts.Watched(rows(spark, []), "id", ("text",)))


def test_an_input_that_changes_during_the_run_is_partial(spark, tmp_path):
    folder, path = str(tmp_path / "log"), str(tmp_path / "in")
    rows(spark, [(1, "a", "x")]).write.parquet(path)
    source = receipts.Watched(spark.read.parquet(path), "id", ("text",), ("sha",))

    class Moving(receipts.Watched):
        def mark(self):
            return receipts.Watched(spark.read.parquet(path), "id", ("text",), ("sha",)).mark()

        def digest(self):
            return receipts.Watched(spark.read.parquet(path), "id", ("text",)).digest()

    def build():
        rows(spark, [(2, "b", "y")]).write.mode("append").parquet(path)
        return source, 1, 0

    assert receipts.derive(folder, "d", "1", Moving(source.rows, "id", ("text",), ("sha",)), build) == "partial"
