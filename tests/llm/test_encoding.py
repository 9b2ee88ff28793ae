import sentencepiece

from claimbook.llm import pieces
from claimbook.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


def test_whole_texts_are_encoded_as_the_library_does_and_come_back(spark):
    texts = ["Plain words.", "", None, "Grüße, 你好 𝔘", "Plain words.", "many words of a text " * 5_000 + "end"]
    df = spark.createDataFrame([(i, t, "old", 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, part int")
    encoded = pieces.encode(df.repartition(3), MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in encoded.collect()}
    assert sorted(got) == list(range(len(texts))) and encoded.columns == ["doc_id", "part", "ids"]
    for i, t in enumerate(texts):
        assert got[i]["ids"] == (None if t is None else library.encode(t)) and got[i]["part"] == 3
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded, MODEL).collect()} == dict(enumerate(texts))
    assert pieces.encode(df.limit(0), MODEL).collect() == []
