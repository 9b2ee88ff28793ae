import random
import tracemalloc

import pyarrow as pa
from claimbook.llm import pieces
from claimbook.llm.queries import tokenizer_file


def test_a_slice_is_freed_before_the_next_one(spark, monkeypatch):
    """The peak over four slices is that of one: a task's memory is bounded by one slice."""
    monkeypatch.setattr(pieces, "BYTES", 1 << 17)
    df = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = pieces.sample_segmentations(df, tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(20_000)) for _ in range(4)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["doc_id", "text"])

    def peak(batch):
        tracemalloc.start()
        try:
            n = sum(b.num_rows for b in run(iter([batch])))
            return n, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(rows.slice(0, 1))  # the vocabulary is loaded
    alone = max(peak(rows.slice(i, 1))[1] for i in range(4))
    n, together = peak(rows)
    assert n == 8
    assert together < 1.2 * alone
