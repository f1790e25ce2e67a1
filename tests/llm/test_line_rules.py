"""Lines above the limit: whatever else a host holds, and what is left of the texts."""

import pytest

from quern.llm import line_rules

SHARED = " ".join(f"subscribe{k}" for k in range(6))
SCHEMA = "doc_id long, text string, source string, n_words string"


def own(i):
    return " ".join(f"u{i}n{k}" for k in range(30))


def rows_of(n):
    return [(i, f"  {SHARED}\n\n{own(i)}\n{SHARED.upper()}\n", "one", "stays") for i in range(n)]


@pytest.mark.parametrize("others", [0, 2500])
def test_other_documents_do_not_bring_a_line_back(spark, others):
    rows = rows_of(21) + [(1000 + i, f"{own(1000 + i)}\nown words", "one", "") for i in range(others)]
    got = {r.doc_id: r for r in line_rules.line_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all((got[i].removed_words, got[i].removed_lines) == (12, [0, 3]) for i in range(21))
    assert sum(r.removed_words for r in got.values()) == 21 * 12 + (2 * others if others > 20 else 0)


def test_kept_documents_lose_their_removed_lines(spark):
    rows = rows_of(21) + [(50, f"{SHARED}\n{own(50)}\n", "two", "stays"), (51, None, "one", ""), (52, SHARED, "one", ""), (None, f"{own(60)}\n{SHARED}", "one", "stays"), (None, f"{own(61)}\n{SHARED}", "one", "stays")]
    docs = spark.createDataFrame(rows + rows[:1], SCHEMA)
    got = line_rules.keep_clean(docs)
    assert got.columns == docs.columns
    want = [(i, f"\n{own(i)}\n", "one", "stays") for i in [0, *range(21)]] + [rows[21], (None, own(60), "one", "stays"), (None, own(61), "one", "stays")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert line_rules.keep_clean(docs.limit(0)).count() == 0
