"""Line dedup counts documents, not rows."""

import hashlib

import duckdb

from logloom.llm.line_dedup import OP7_SQL, op7_line_dedup

LINES = [f"line number {k} that is long enough to be counted by documents" for k in range(3)]


def test_rows_that_share_an_id_are_one_document(spark, tmp_path):
    docs = [(1, LINES[0])] * 5 + [(2, LINES[1])] * 4 + [(3, LINES[1])] + [(k, LINES[2]) for k in range(4, 9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    # The oracle takes rows of one doc_id together; of the lines of documents 1 to 3 none goes.
    gone = {row[0]: row[2] for row in con.execute(OP7_SQL).fetchall()}
    got = op7_line_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["n_dropped"] for r in got} == gone == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1, 8: 0}
    assert {r["kept_sha256"] for r in got if r["doc_id"] == 2} == {hashlib.sha256(LINES[1].encode()).hexdigest()}
