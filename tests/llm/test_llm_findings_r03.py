"""Findings of round 03."""

import numpy as np
import pyarrow as pa

from snapweave.llm import rows


def test_a_batch_of_long_texts_is_worked_on_in_slices():
    texts = ["é" * (k % 3000) + str(k) if k % 7 else None for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    seen = []

    def task(batches):
        for part in batches:
            seen.append(part.nbytes)
            yield part

    most = rows.SLICE_BYTES // 2
    assert batch.nbytes > most
    assert pa.Table.from_batches(rows.slices(iter([batch]), most)).to_pylist() == batch.to_pylist()
    assert pa.Table.from_batches(rows.released(task)(iter([batch] * 2))).num_rows == 6000
    assert max(seen) < 1.5 * rows.SLICE_BYTES and len(seen) > 2


def test_slices_read_like_whole_batches():
    from snapweave.llm.jaccard import _chunks
    from snapweave.llm.langid import _texts_as_bytes

    texts = pa.array(["", None, "one two", "drei é vier", "fünf"] * 3)
    part = texts.slice(3, 7)
    data, offsets = _texts_as_bytes(part)
    assert [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == [t or "" for t in part.to_pylist()]
    found = [bytes(np.asarray(d)[a:b]).decode() for _, _, d, o in _chunks(part) for a, b in zip(o, o[1:])]
    assert found == [t or "" for t in part.to_pylist()]


def test_stages_of_the_pipeline_send_small_batches(spark, table_of):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", rows.BATCH_ROWS), ("0", rows.BATCH_ROWS), ("500", 500)):
            spark.conf.set(name, given)
            corpus_pipeline.secret_scan(spark, table_of([]), "")
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
