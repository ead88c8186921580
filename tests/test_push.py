import pytest

from delimir.functions.filters import all_, column
from delimir.plans.errors import DelimitedError
from delimir.plans.push import PushParser

DATA = b'1;Ana;SP\n2;"Jo\nao";RJ\n3;Bia;SP\n4;Caio'


def fed(write, end, k=3):
    return [write(DATA[i : i + k]) for i in range(0, len(DATA), k)] + [end()]


def test_all_forms_agree():
    new = lambda: PushParser(";")
    p = new()
    rows = [r for part in fed(p.write, p.end) for r in part]
    assert rows == [["1", "Ana", "SP"], ["2", "Jo\nao", "RJ"], ["3", "Bia", "SP"], ["4", "Caio"]]
    p = new()
    assert [r for b in fed(p.write_batch, p.end_batch) for r in b.rows()] == rows
    p = new()
    assert sum(fed(p.write_count, p.end_count)) == 4
    p = new()
    sp = column(2).equals("SP")
    assert [r for b in fed(lambda c: p.write_projected_batch(c, [2, 0], sp), lambda: p.end_projected_batch([2, 0], sp)) for r in b.rows()] == [["SP", "1"], ["SP", "3"]]
    p = new()
    assert sum(fed(lambda c: p.write_count_where_equals(c, 2, "SP"), lambda: p.end_count_where_equals(2, "SP"))) == 2
    p = new()
    assert sum(fed(lambda c: p.write_count_where_in(c, 2, ["SP", "RJ"]), lambda: p.end_count_where_in(2, ["SP", "RJ"]))) == 3
    p = new()
    assert sum(fed(lambda c: p.write_count_where_starts_with(c, 1, ""), lambda: p.end_count_where_starts_with(1, ""))) == 4
    p = new()
    both = all_(sp, column(1).has_match("^B"))
    assert sum(fed(lambda c: p.write_count_where(c, both), lambda: p.end_count_where(both))) == 1


def test_reset_and_close():
    with PushParser(",", strict=True) as p:
        p.write(b'a,"b')
        p.reset()
        assert p.write(b"x,y\n") == [["x", "y"]]
        with pytest.raises(DelimitedError, match="not supported for count filters"):
            p.write_count_where(b"", column(0).equals("x"))
    with pytest.raises(DelimitedError, match="closed"):
        p.write(b"")


def test_strict_refuses_counts_and_projections():
    p = PushParser(",", strict=True)
    for call in (lambda: p.write_count(b"a,b\n"), p.end_count, lambda: p.write_projected_batch(b"a,b\n", [0]), lambda: p.end_projected_batch([0]), lambda: p.write_count_where_equals(b"", 0, "a")):
        with pytest.raises(DelimitedError, match="strict CSV validation is not supported for"):
            call()
    assert p.write(b"a,b\n") == [["a", "b"]]
