import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from delimir.functions.filters import all_, any_, check, column, from_json, from_list, not_, parse_json, to_column, to_predicate
from delimir.functions.regex import regex
from delimir.operators.scan import filter_json
from delimir.plans.api import evaluate
from delimir.plans.errors import DelimitedError
from delimir.sources.datasource import mask_of

ROWS = [["1", "Ana", "SP"], ["2", "Joao", "RJ"], ["3", "Bia", "SP"], ["4", "Caio", "MG"], ["5"], ["", "", ""], []]
leaf = st.builds(
    lambda c, k, v: getattr(column(c), k)(v if k in ("equals", "does_not_equal", "starts_with") else [v, "SP"]),
    st.integers(0, 4),
    st.sampled_from(["equals", "does_not_equal", "is_one_of", "is_none_of", "starts_with"]),
    st.sampled_from(["", "SP", "RJ", "1", "A", "5"]),
)
trees = st.recursive(leaf, lambda t: st.one_of(st.lists(t, min_size=1, max_size=3).map(lambda x: all_(*x)), st.lists(t, min_size=1, max_size=3).map(lambda x: any_(*x)), t.map(not_)), max_leaves=6)


def kleene(f, row):
    """The logic spelled out."""
    if f.kind == "not":
        x = kleene(f.parts[0], row)
        return None if x is None else not x
    if f.kind in ("all", "any"):
        got = [kleene(p, row) for p in f.parts]
        if f.kind == "all":
            return False if False in got else None if None in got else True
        return True if True in got else None if None in got else False
    if f.column >= len(row):
        return None
    x = row[f.column]
    return {"equals": x == f.values[0], "notEquals": x != f.values[0], "in": x in f.values, "notIn": x not in f.values, "startsWith": x.startswith(f.values[0])}[f.kind]


@settings(max_examples=200, deadline=None)
@given(trees)
def test_predicate_is_kleene(f):
    p = to_predicate(f)
    for row in ROWS:
        assert p(row) == kleene(f, row) == evaluate(f, row)
    assert from_json(filter_json(f)) == f


@settings(max_examples=200, deadline=None)
@given(trees)
def test_arrow_masks_are_kleene(f):
    rows = [r for r in ROWS if r]
    assert mask_of(f, pa.array(rows, pa.list_(pa.string()))).to_pylist() == [kleene(f, r) for r in rows]


@settings(max_examples=12, deadline=None)
@given(st.lists(trees, min_size=8, max_size=8))
def test_columns_are_kleene(spark, filters):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ROWS)], "i int, fields array<string>")
    got = df.select("i", *[to_column(f, lambda c: F.get("fields", F.lit(c))).alias(f"f{k}") for k, f in enumerate(filters)]).orderBy("i").collect()
    for row, g in zip(ROWS, got, strict=True):
        assert [g[f"f{k}"] for k in range(len(filters))] == [kleene(f, row) for f in filters]


def test_limits():
    with pytest.raises(DelimitedError, match="filter column out of range: 2025"):
        column(2025)
    with pytest.raises(DelimitedError, match="filter values must not be empty"):
        column(1).is_one_of([])
    with pytest.raises(DelimitedError, match="requires at least one filter"):
        all_()
    with pytest.raises(DelimitedError, match="must be created with"):
        not_("x")
    with pytest.raises(DelimitedError, match="filter count out of range: 2025"):
        check(all_(*[column(0).equals("x")] * 2025))
    with pytest.raises(DelimitedError, match="regex filter count out of range: 33"):
        check(any_(*[column(0).has_match("x")] * 33))
    buffer = bytearray(b"SP")
    f = column(2).equals(buffer)
    buffer[0] = 0
    assert f.values == (b"SP",)
    assert from_list([]) is None
    with pytest.raises(DelimitedError, match="must contain equals"):
        from_list([{"column": 1}])


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("{", "--where must be valid JSON"),
        ("[]", "--where must be a JSON object"),
        ('{"all":[]}', "--where.all must be a non-empty array"),
        ('{"any":[]}', "--where.any must be a non-empty array"),
        ('{"not":[]}', "--where.not must be a JSON object"),
        ('{"column":2,"in":[]}', "--where.in must be a non-empty string array"),
        ('{"column":2,"notIn":[]}', "--where.notIn must be a non-empty string array"),
        ('{"column":2,"equals":"SP","extra":true}', "--where contains unknown property: extra"),
        ('{"column":2,"equals":1}', "--where.equals must be a string"),
        ('{"equals":"SP"}', "--where.column must be a number"),
        ('{"column":2025,"equals":"SP"}', "filter column out of range: 2025"),
        ('{"column":2,"regex":{"flags":"i"}}', "--where.regex.source must be a string"),
        ('{"column":2,"regex":{"source":"["}}', "Invalid regular expression"),
        ('{"column":2,"regex":{"source":"SP","flags":"g"}}', "unsupported regular expression flags: g"),
        ('{"column":2,"regex":{"source":"(?=SP)"}}', "invalid regular expression: invalid perl operator"),
        ('{"not":' * 129 + '{"column":2,"equals":"SP"}' + "}" * 129, "--where nesting exceeds 128"),
    ],
)
def test_json_errors(text, message):
    with pytest.raises(DelimitedError, match=message.replace("[", r"\[")):
        parse_json(text)


BAD = [("a(?!b)", "invalid perl operator"), (r"(a)\1", "invalid escape sequence"), (r"a\Z", "invalid escape sequence"), ("[^]", "missing ]"), ("a++", "Nothing to repeat"), ("(?<=a)b", "invalid perl operator"), ("(", "Unterminated group"), (")", "Unmatched"), ("*a", "Nothing to repeat"), ("a{1001}", "invalid repetition size"), ("a" * 4097, "exceeds 4096 UTF-8 bytes")]


@pytest.mark.parametrize(("source", "message"), BAD)
def test_regex_rejects(source, message):
    with pytest.raises(DelimitedError, match=message):
        regex(source)


def test_regex_flags():
    with pytest.raises(DelimitedError, match="duplicate regular expression flags: ii"):
        regex("a", "ii")
    assert regex(r"\/" + chr(92) + "u0041").java.endswith(r"\/\x{41}")


PATTERNS = [
    ("a$", ""), ("^b", "m"), ("a.c", ""), ("a.c", "s"), (r"\s", ""), (r"\S+$", ""), (r"\bx", ""), (r"x\b", "i"), (r"\Bx", ""), (r"[[:alpha:]]+1", ""), (r"[^[:digit:]]$", ""), (r"\w\W", "i"), ("[a&&b]", ""), ("[a[b]", ""),
    ("(?P<n>a)b", ""), (r"\d{2,3}", ""), (r"\pL+", ""), (r"\p{Greek}", ""), (r"[\x{e9}\d]", ""), ("a*?b|c+", ""), (r"^\s*$", "m"), ("ſ", "i"), ("K", "i"), ("(?i:AB)c", ""), (r"[\]\-^]", ""), ("a{,2}", ""), (r"\x41", ""), (".*", "ms"), (r"[\w.]+@", "i"), ("é", "i"),
]
PROBES = ["", "a", "a\n", "b\na", "abc", "a\nc", "a\rc", "a c", "x", "éx", "xé", " x", "ax b", "A1", "É", "k", "K", "S", "s", "ſ", "αβ", "a&b", "[b]", "12345", "\x0b", "\t", "ab", "ABc", "cc", "^", "-", "]", "a{,2}", "me@x", "a b\n\n"]  # noqa: RUF001


def test_regex_agrees_with_re2(spark):
    df = spark.createDataFrame(list(enumerate(PROBES)), "i int, v string")
    got = df.select("i", *[F.col("v").rlike(regex(s, f).java).alias(f"p{k}") for k, (s, f) in enumerate(PATTERNS)]).orderBy("i").collect()
    con = duckdb.connect()
    for k, (s, f) in enumerate(PATTERNS):
        p = f"(?{f}:{s})" if f else s
        for i, v in enumerate(PROBES):
            want = con.execute("select regexp_matches(?, ?)", [v, p]).fetchone()[0]
            assert got[i][f"p{k}"] == want, (s, f, v)


def test_local_patterns_are_the_same_dialect():
    con = duckdb.connect()
    for s, f in PATTERNS:
        p = f"(?{f}:{s})" if f else s
        for v in PROBES:
            want = con.execute("select regexp_matches(?, ?)", [v, p]).fetchone()[0]
            assert evaluate(column(0).has_match(regex(s, f)), [v]) is want, (s, f, v)
    assert evaluate(column(0).has_match(r"^\pL$"), ["é"]) is True


def test_parts_without_patterns_go_down():
    a, b, r = column(0).equals("x"), column(1).is_one_of([b"y", "z"]), column(2).has_match("q")
    assert filter_json(all_(a, r, b)) == {"all": [{"column": 0, "equals": "x"}, {"column": 1, "in": ["y", "z"]}]}
    assert filter_json(any_(a, r)) is None and filter_json(not_(all_(a, r))) is None and filter_json(r) is None
    assert filter_json(any_(a, not_(b))) == {"any": [{"column": 0, "equals": "x"}, {"not": {"column": 1, "in": ["y", "z"]}}]}
    assert filter_json(column(0).equals(b"\xff")) is None
