"""What workers hold of a packed or scanned table."""

import pyarrow as pa

from ctrlspark.llm import textvec


class Frame:
    """Hands back the function that its rows would go through."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_workers_give_memory_back_before_and_between_chunks(monkeypatch):
    seen, given = [], []
    monkeypatch.setattr(textvec, "release", lambda: given.append(len(seen)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(70)), "text": ["some words"] * 70})
    for rows in textvec.per_chunk(Frame(), lambda rows, buf, offs: [rows], "doc_id long", size=1)([batch]):
        seen.append(rows)
    assert given == [0, 32, 64, 70]  # at the end only, before
