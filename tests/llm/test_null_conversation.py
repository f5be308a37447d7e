import duckdb

from strophe.llm import chat_format
from tests.compare import rows


def test_rows_without_a_conversation_are_one(spark, tmp_path):
    talks = [(None, 0, "user", "hi"), (None, 1, "assistant", "there"), (1, 0, "user", "x"), (None, 2, None, None)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(chat_format.SQL)
    got = chat_format.query(spark, str(tmp_path))
    found = [tuple(r) for r in got.collect()]
    assert rows(got.columns, found) == rows([d[0] for d in want.description], want.fetchall())
    assert None in {r[0] for r in found}
