import pytest

from labelloom.functions import rules as R
from labelloom.queries import labels

COLUMNS = "rxcui string, drug_name string, set_id string, drug_names array<string>, product_context string"


@pytest.fixture
def label(spark, monkeypatch):
    """One label that names every event, each in a chunk of its own."""
    chunk = dict(chunk_type="paragraph", section_code="34084-4", section_title="ADVERSE REACTIONS", subsection_title="", column_headers=[], row_cells=[])
    texts = [f"Cases of {direct[0]} were reported in patients treated with xol." for direct, _ in R.EVENTS.values()]
    rows = [{**chunk, "chunk_id": i, "chunk_index": i, "text": t, "set_id": "S", "source_path": f"section[1]/paragraph[{i}]", "chunk_hash": f"h{i}", "parent_path": "section[1]"} for i, t in enumerate(texts)]
    real = labels.load(spark, "/root/testdata/sf0.001", "label_chunk").schema
    data = [tuple(r.get(f.name) for f in real) for r in rows]
    monkeypatch.setattr(labels, "load", lambda *a: spark.createDataFrame(data, real))
    monkeypatch.setattr(labels, "drugs_of_labels", lambda *a: spark.createDataFrame([("1", "xol", "s", ["xol"], "xol")], COLUMNS))


def test_every_event_of_the_rules(spark, sf, label):
    assert {r.normalized_event for r in labels.extracted_items(spark, "").collect()} == set(R.EVENTS)
