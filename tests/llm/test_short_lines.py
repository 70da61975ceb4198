import pandas as pd

import corpus_pipeline
from scanloom.llm.queries import op1_line_dedup

ROWS = [(1, "ok\n\na line of more than two dozen characters\nok"), (2, "} \nok\n  \n} "), (3, "\n  \nno\n" + "x" * 23), (4, "x" * 23 + "\nok\nOk\né\né"), (5, None)]
GONE = {1: [3], 2: [1, 3], 3: [], 4: [0, 1, 4], 5: []}


def test_short_lines_that_repeat_go(spark, tmp_path, docs_of):
    pd.DataFrame(ROWS, columns=["doc_id", "text"]).to_parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["removed_lines"] for r in op1_line_dedup(spark, str(tmp_path)).collect()} == GONE
    left = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in GONE[i]) for i, t in ROWS}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs_of(ROWS), "").collect()} == left
