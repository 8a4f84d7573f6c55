"""What a task holds of a batch at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomcorpus.operators import chunking, matching


def test_texts_are_looked_through_in_small_slices():
    texts = [f"{i} " + "word " * 20_000 for i in range(30)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(32)), pa.array(texts, pa.string())], ["id", "text"])
    parts = list(matching._slices(batch, "text"))
    assert max(len(data) for _, data, _ in parts) <= 1 << 20 and len(parts) > 3
    assert b"".join(data for _, data, _ in parts) == "".join(t or "" for t in texts).encode()
    assert sum(some.num_rows for some, _, _ in parts) == 32


def test_batches_of_more_rows_than_are_held_at_once(spark):
    n = 2 * chunking.ROWS + 3
    rows = [(i, None if i % 9 == 0 else f"Line {i} ends here. " * (i % 70)) for i in range(n)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    whole = {(r.id, r.position, r.chunk) for r in chunking.chunk_documents(docs, "id", "text").collect()}
    single = {(r.id, r.position, r.chunk) for r in chunking.chunk_documents(docs.repartition(n, "id"), "id", "text").collect()}
    assert whole == single and {r[0] for r in whole} == {i for i, t in rows if t}
    assert chunking.chunk_documents(docs.filter(F.lit(False)), "id", "text").collect() == []
