from quern.llm.bpe import Recent
from quern.llm.common import STEP_TEXTS, slices


def test_slices_cover_all_texts_in_order():
    lengths = [5, 0, 10_000_000, 3, *[1] * 1000]
    spans = list(slices(lengths, most=100))
    assert spans[0][0] == 0 and spans[-1][1] == len(lengths) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(b - a <= STEP_TEXTS and (b - a == 1 or sum(lengths[a:b]) <= 100) for a, b in spans)
    assert list(slices([])) == []


def test_recent_stays_bounded_and_finds_what_it_holds():
    table = Recent(8)
    for i in range(1000):
        assert table.find(i) is None
        table.keep(i, -i)
        assert table.find(i) == -i
        assert len(table.new) <= 8 and len(table.spare) <= 2
    assert table.missed <= 16 * 8
