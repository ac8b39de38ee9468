"""What a task of the n-gram join holds: bounded numbers of texts and sets, with the same results."""

import tracemalloc

import numpy as np
import pyarrow as pa

from carecheck.llm import jaccard_join, shingles
from carecheck.llm.worker import held

MB = 1 << 20


class Held:
    """Stands for a DataFrame: gives back the function that its tasks run."""

    def mapInArrow(self, run, schema):
        return run


def _batch(n, words):
    texts = [" ".join(f"w{(i * 7919 + j) % 9973}" for j in range(words)) for i in range(n)] + [None, "", "two words"]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def _peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_words_are_hashed_in_little_room():
    texts = ["some words of a text " * 500] * 800  # 8 MB
    assert _peak(lambda: sum(len(h) for h in shingles.word_hashes(texts))) < 40


def test_a_survey_task_holds_little_besides_its_sets():
    batch = _batch(4000, 300)  # 9 MB of sets
    assert _peak(lambda: list(jaccard_join.survey(Held())(iter([batch])))) < 55


def test_tasks_drop_the_objects_of_other_operators():
    for make in (jaccard_join.survey, jaccard_join.shingle_sets, jaccard_join.histograms):
        held("parser", lambda: "parser")
        assert sum(b.num_rows for b in make(Held())(iter([_batch(9, 20)]))) >= 12
        from carecheck.llm.worker import _held
        assert _held == {}


def test_repeated_values_are_counted_as_by_unique(monkeypatch):
    rng = np.random.default_rng(3)
    for least in (1, 2, 3, 50):
        monkeypatch.setattr(jaccard_join, "BATCH_HOT", least)
        for n in (0, 1, 2, 400):
            every = [np.sort(rng.integers(0, 60, n, dtype=np.uint64)) for _ in range(3)]
            value, times = np.unique(np.concatenate(every), return_counts=True)
            hot, count = jaccard_join.repeated(every)
            assert hot.tolist() == value[times >= least].tolist() and count.tolist() == times[times >= least].tolist()
    assert [len(x) for x in jaccard_join.repeated([])] == [0, 0]


def test_parts_of_a_batch_give_the_same_rows(monkeypatch):
    batch = _batch(50, 12)

    def rows(make):
        return sorted(map(str, (r for b in make(Held())(iter([batch])) for r in b.to_pylist())))

    want = [rows(f) for f in (jaccard_join.survey, jaccard_join.shingle_sets, jaccard_join.histograms)]
    monkeypatch.setattr(jaccard_join, "HELD", 7)
    monkeypatch.setattr(shingles, "CHUNK", 100)
    assert [rows(f) for f in (jaccard_join.survey, jaccard_join.shingle_sets, jaccard_join.histograms)] == want
