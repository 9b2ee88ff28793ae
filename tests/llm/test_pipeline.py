import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from claimbook.llm import language, queries, simhash, stages
from claimbook.llm.tables import table
from reference_forms import components, fingerprint, near_copies, without_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps of the documents of the smallest data folder and some odd ones."""
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame(
        [(90_001, None, "en", "s", None), (90_002, "", None, None, 0), (90_003, "12 34", "en", "s", 5),
         (90_004, "una frase de los que no", None, "s", 23), (None, "una frase de los que no", "es", "s", 23)], docs.schema)
    out = [docs.union(odd).cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_are_the_dealt_ones():
    assert [f for _, f in corpus_pipeline.STAGES] == [
        stages.identify_language, stages.drop_near_duplicates, stages.cut_repeats, stages.drop_contaminated, stages.encode]


def test_all_but_the_last_return_documents(kept):
    assert all(df.columns == kept[0].columns for df in kept[:-1])


def test_language_stage_rejects_what_has_no_language(kept):
    gone = {r["doc_id"] for r in kept[0].join(kept[1], kept[0]["doc_id"].eqNullSafe(kept[1]["doc_id"]), "left_anti").collect()}
    assert gone == {90_001, 90_002, 90_003}
    assert kept[1].filter("doc_id = 90004").first()["lang"] == "es"


def test_one_document_of_each_group_stays(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept[1].filter("doc_id is not null").collect()]
    assert {r["doc_id"] for r in kept[2].collect()} == near_copies(rows)


def test_passages_are_cut(kept):
    want = without_repeats([(r["doc_id"], r["text"]) for r in kept[2].collect()])
    got = {r["doc_id"]: r for r in kept[3].collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if gone < n or not gone}
    for r in kept[2].collect():
        if r["doc_id"] in got:
            n, gone, text = want[r["doc_id"]]
            assert got[r["doc_id"]]["text"] == (text if gone else r["text"])
            assert got[r["doc_id"]]["n_chars"] == (len(text) if gone else r["n_chars"])


def test_contaminated_documents_go(kept, spark):
    items = [" ".join(r["text"].split()) for r in table(spark, SF, "benchmark").collect()]
    for r in kept[3].collect():
        holds = any(i in " ".join(r["text"].split()) for i in items if len(i.split()) >= 13)
        if holds:
            assert not kept[4].filter(F.col("doc_id") == r["doc_id"]).count()
    assert kept[4].count() > 0.8 * kept[3].count()


def test_encoded_rows_decode_to_their_documents(kept):
    assert kept[5].filter("not round_trip").count() == 0
    assert kept[5].select("doc_id").distinct().count() == kept[4].count()


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.registered().items() if sql])
def test_queries_match_their_sql(spark, name):
    build, sql = queries.registered()[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(sql).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r[c] for c in names) for r in build(spark, SF).collect()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order) and got


def test_entry_registers_every_operator():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.registered()} <= names
    assert {n.split("_")[0] for n in queries.registered()} == {f"op{i}" for i in range(1, 14)}


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    said = language.predict(docs.filter(language.is_held_out("doc_id")), language.fit(docs))
    right, n = said.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


def test_simhash_query_over_the_table(spark):
    rows = queries.op8_simhash(spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    ids = sorted(text)
    want = dict(zip(ids, components([fingerprint(text[i]) for i in ids], ids), strict=True))
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
