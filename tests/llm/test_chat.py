import pytest

from cantiere.llm import chat
from cantiere.llm.common import table
from oracle import compare, duck


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = [(1, 0, "ann", "hello"), (1, 1, "bob", "hi <|end|> there"), (1, 2, "carl smith", None), (1, 3, "system", "be nice"), (1, 3, "ann", "é😀"), (1, 3, "ann", "é😀"),
            (1, 70, "bob", "later"), (1, None, "ann", "when"), (1, 4, None, "who"), (2, 0, "system", "alone"), (3, 0, None, None), (None, 0, "ann", "nowhere"),
            (None, 5, "bob", ""), (4, -1, "ann", "before"), (4, 0, "ann", "now")] + [(5, i, f"p{i % 3}", f"text {i}") for i in range(300)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS part", "'x' AS participant", "3 AS messages")


def test_views_equal_sql(spark, sf, odd_turns):
    for turns in (table(spark, sf, "conversations"), odd_turns):
        con = duck(sf)
        con.register("given", turns.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        con.execute("CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM given")
        assert compare(con, chat.ROTATE_SQL, chat.rotate(turns)) is None


def test_every_speaker_is_assistant_once(odd_turns):
    rows = {(r.conv_id, r.part, r.participant): r for r in chat.rotate(odd_turns).collect()}
    view = rows[1, 0, "ann"]
    assert view.rendered == ("<|assistant|>\nhello<|end|>\n<|user name=bob|>\nhi < |end|> there<|end|>\n<|user name=carl_smith|>\n<|end|>\n"
                             "<|assistant|>\né😀<|end|>\n<|system|>\nbe nice<|end|>\n<|user name=unknown|>\nwho<|end|>\n")
    for r in rows.values():
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",") if s]
        assert all(r.rendered[:a].endswith("<|assistant|>\n") and r.rendered[a:b].endswith("<|end|>") for a, b in spans)
        assert len(spans) == r.rendered.count("<|assistant|>") and sum(b - a for a, b in spans) == r.n_masked
    assert {p for c, _, p in rows if c == 1} == {"ann", "bob", "carl smith"} and rows[2, 0, None].mask == ""
    assert {(part, p) for c, part, p in rows if c == 5} == {(i, f"p{k}") for i in range(5) for k in range(3)}
    assert rows[1, None, "bob"].n_messages == 1 and rows[4, -1, "ann"].n_messages == 1 and rows[1, 0, "ann"].n_rows == 7


def test_empty_table(odd_turns):
    assert chat.rotate(odd_turns.limit(0)).count() == 0
