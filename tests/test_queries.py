"""All registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e
from lodestone.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_sentence_counts_has_every_document(spark, tmp_path):
    texts = {1: "One. Two.", 2: "See (Gosea. Stanford) here. Then there.", 3: "Open (never. Closed. At all", 4: "A) b. Cd (e (f. G) h. I) j. K.", 5: None, 6: "", 7: " \n "}
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sentences for r in QUERIES["sentence_counts"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 3, 5: 0, 6: 0, 7: 0}


def test_chunks_cut_beside_white_space_equal_sql(spark, tmp_path):
    """A cut at the hard limit may leave a line end at a chunk's end or beginning; SQL's trim takes blanks only."""
    texts = {1: "a" * 3999 + "\n" + "b" * 300, 2: "a" * 4000 + "\n" + "b" * 300, 3: "a" * 3999 + " " + "b" * 300, 4: "W" * 900 + " x\nab. " + "Next" * 240 + ". End.", 5: "\n" + "q" * 4100 + "\n", 6: None}
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id, chunk_index, content, char_offset"
    want = con.execute(f"select {names} from ({ORACLES['chunk_documents']}) order by 1, 2").fetchall()
    got = [tuple(r) for r in QUERIES["chunk_documents"](spark, str(tmp_path)).select(*names.split(", ")).orderBy("doc_id", "chunk_index").collect()]
    assert got == want and got[0][2].endswith("a\n")
