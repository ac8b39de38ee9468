import pyarrow as pa

from carecheck.llm import worker


class Held:
    """Stands for a DataFrame: gives back the function that its tasks run."""

    def mapInArrow(self, run, schema):
        return run


def test_a_worker_keeps_one_large_object_and_drops_it_for_other_work():
    made = []
    for name in ("parser", "parser", "codec", "codec"):
        worker.held(name, lambda name=name: made.append(name) or name)
    assert made == ["parser", "codec"] and worker._held == {"codec": "codec"}
    seen = []

    def run(batches):
        seen.append(dict(worker._held))
        yield from batches

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert list(worker.in_arrow(Held(), run, "x bigint")(iter([batch]))) == [batch]
    assert seen == [{}] and worker._held == {}


def test_line_dedup_runs_without_the_objects_of_other_operators(monkeypatch):
    from carecheck.llm import line_dedup
    monkeypatch.setattr(line_dedup, "_named_lines", lambda docs, text: Held())
    worker.held("parser", lambda: "parser")
    lines = pa.RecordBatch.from_arrays([pa.array([b"1"]), pa.array(["a line of words"])], names=["id", "line"])
    out = list(line_dedup.bands(None)(iter([lines])))
    assert out[0].num_rows == line_dedup.BANDS and worker._held == {}
