"""Every query of the subpackage runs on the smallest tables."""

import pytest

from inkglass.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, small, name):
    df = llm.queries()[name](spark, small)
    rows = df.collect()
    if name == "p7_round_trip":
        assert rows and all(r.same for r in rows)


def test_columns(spark, small):
    want = {
        "p1_found": "file_id bigint, field string", "p2_found": "section_id bigint, start_at int, end_at int", "p3_found": "src string, rec_id bigint, noise string", "p4_found": "src string, rec_id bigint, kind string, start_at int",
        "p5_found": "src string, id_a bigint, id_b bigint", "p8_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint, subject string", "p7_ids": "doc_id bigint, ids array<int>",
    }
    for name, columns in want.items():
        assert ", ".join(" ".join(x) for x in llm.queries()[name](spark, small).dtypes) == columns
