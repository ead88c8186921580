import hashlib
import math
import random
import re
import time

from delimir.llm.pii import digest, redacted

# the base patterns as they are asked for
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def base(text):
    return sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if good(k, m.group()))


PARTS = ["a", "b@", "c.d", "@x.y", "_", "%", " ", "+", "1", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "300.1.1.1", "+1 (555) 010-9999", "-", ".", "é", "🙂", "00000255.1.2.3", "x@y.z", "A1B2C3D4", "\n"]


def test_base_spans(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(600)]
    texts += [None, "", "a" * 100000, "1" * 50000, "x@" + "a." * 20000, "+1" + " " * 50000, "1.2." * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as spans", "2 as email")
    got = {x.doc_id: x for x in digest(df).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        joined = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t[:80]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))  # no base span: nothing to find there


def test_patterns_discover(spark):
    texts = [f"you can reach us at +1 (555) 010-{k:04d} today" for k in range(9)] + ["you can reach us at 01555010991 today", "order number 01555010992 came", "reach us at noon"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in digest(df).collect()}
    assert (got[9], got[10], got[11]) == ("id:20:31", "", "")
    out = {r.doc_id: r.text for r in redacted(df.selectExpr("*", "1 as _row", "'q' as _base")).collect()}
    assert out[0] == "you can reach us at [PHONE] today" and out[9] == "you can reach us at [ID] today" and out[10] == texts[10]


# the method spelled out over plain Python objects
def runs(text):
    """Candidates of a text whose base spans are hidden already."""
    out = []
    for m in re.finditer("[A-Za-z0-9_@#+/.-]+", text):
        whole = m.group()
        cut = re.match(".*[A-Za-z0-9]", whole)
        kept = cut.group() if cut else ""
        if len(kept) >= 5 and len(whole) <= 128 and len(re.findall("[0-9]", whole)) >= 4 and not re.search("[_@#+]", whole[len(kept) :]):
            out.append((m.start(), m.start() + len(kept)))
    return out


def patterns(before, match, first):
    w = re.findall(r"[^\W\d_]+", before)
    if not w:
        return None
    sep = re.search(r"[\W\d_]*\Z", before).group()
    start = before[: len(before) - len(sep) - len(w[-1])]
    out = [f"2 {w[-2]} {w[-1]}"] if len(w) > 1 else []
    if re.search(r"""[:=#|<>\[\](){}"'`*]""", sep) or re.search(r"\n[\W\d_]*\Z", start) or first and not re.search("\n", start) and len(w) == 1:
        out.append(f"1 {w[-1]}" + re.sub(r"\s+", " ", sep))
    return [*out, f"s {w[-1]} " + re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", match))]


def graph(texts):
    """Per text the candidates behind confident patterns."""
    weight, edges, cands = {}, set(), []
    for t in texts:
        spans = base(t)
        at = 0
        for k in range(4):
            at = 0
            for a, _, b in sorted(x for x in spans if x[1] == k):
                # the text between matches of one kind, valid or not
                at = max([m.end() for m in re.finditer(BASE[list(BASE)[k]], t) if m.end() <= a], default=0)
                for p in patterns(t[at:a].lower(), t[a:b], at == 0) or []:
                    edges.add((p, t[a:b]))
                weight[t[a:b]] = 1.0
        hidden = list(t)
        for k in range(4):
            for m in list(re.finditer(BASE[list(BASE)[k]], "".join(hidden))):
                if good(list(BASE)[k], m.group()):
                    hidden[m.start() : m.end()] = "\1" * (m.end() - m.start())
        hidden, at, last, own = "".join(hidden), 0, [], []
        for a, b in runs(hidden):
            last = patterns(hidden[at:a].lower(), hidden[a:b], at == 0) or last
            own.append((a, b, last))
            at = b
            x = hidden[a:b]
            if re.fullmatch("[0-9A-Fa-f]{32,}", x) and re.search("[0-9]", x) and re.search("[A-Fa-f]", x):
                weight[x] = 1.0
            edges |= {(p, x) for p in last}
        cands.append(own)
    seeds = set(weight)
    conf = {}
    for turn in range(4):
        conf = {}
        for p in {p for p, _ in edges}:
            w = [weight.get(i, 0.0) for q, i in edges if q == p]
            if sum(x >= 0.6 for x in w) >= 3:
                conf[p] = sum(w) / (len(w) + 1)
        if turn < 3:
            for i in {i for _, i in edges} - seeds:
                weight[i] = 1 - math.prod([1 - min(conf[p], 0.999) for p, q in edges if q == i and p in conf])
    return [[(a, b) for a, b, own in c if any(conf.get(p, 0) >= 0.6 for p in own)] for c in cands]


def test_graph_is_brute_force(spark):
    r = random.Random(12)
    some = lambda: "".join(r.choice("0123456789") for _ in range(r.randint(5, 9)))
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    forms = [
        lambda: f"mail me at {r.choice('abcd')}{some()}@x.org now",
        lambda: f"mail me at user-{some()} now",
        lambda: f'{r.choice(["token", "Token", "key"])} = "{key(40)}"',
        lambda: f'token = "{key(12)}1234"',
        lambda: f"key = {some()}, {some()}; {some()}",
        lambda: f"order {some()} of the year {r.randint(1000, 2000)}5",
        lambda: f"phone +1 (555) 010-{r.randint(1000, 9999)}",
        lambda: f"phone 555-{r.randint(1000, 9999)}",
        lambda: f"\ncode {some()}\nTel: +1 555 010 {r.randint(1000, 9999)}",
        lambda: f"Tel: {some()}",
        lambda: f"from 10.0.{r.randint(0, 255)}.{r.randint(0, 255)} and host {some()}.x",
        lambda: f"id {r.choice(['11111', '22222', '33333'])}" if r.random() < 0.5 else f"mail me at {r.choice(['11111', '22222', '33333'])}",
    ]
    texts = [" ".join(r.choice(forms)() for _ in range(r.randint(1, 4))) for _ in range(260)] + ["12345", "x 12345", ""]
    want = graph(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in digest(df).collect()}
    assert sum(map(len, want)) > 50 and sum(len(runs(t)) for t in texts) - sum(map(len, want)) > 50
    for i, w in enumerate(want):
        assert [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s.startswith("id")] == w, texts[i]
        assert got[i].n_id == len(w)


def test_many_matches_take_linear_time(spark):
    line = lambda k: f"mail a{k}@b.org, 10.0.0.{k % 250}, code {k + 10000} and +1 555 010 {1000 + k % 9000};\n"
    took = []
    for n in (3000, 24000):
        df = spark.createDataFrame([(1, "".join(map(line, range(n))))], "doc_id long, text string")
        began = time.perf_counter()
        r = digest(df).first()
        took.append(time.perf_counter() - began)
        assert (r.n_email, r.n_ip, r.n_phone) == (n, n, n)
    assert took[1] < 10 * took[0] + 5


def test_identifiers_before_punctuation(spark):
    ends = [". Then", ".", "...", "-", "/ x", "-- so", "!", "", ".)", "/."]
    texts = [f"you can reach us at +1 (555) 010-{k:04d} today" for k in range(60)] + [f"you can reach us at {n}{e}" for e in ends for n in ("01555010991", "555-8283")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in digest(df).collect()}
    out = {r.doc_id: r.text for r in redacted(df).collect()}
    for k, e in enumerate(ends):
        assert (got[60 + 2 * k], got[61 + 2 * k]) == ("id:20:31", "id:20:28"), e
        assert out[60 + 2 * k] == out[61 + 2 * k] == f"you can reach us at [ID]{e}"


def test_redaction_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, "to a@b.cd or 10.0.0.1", "k"), (1, "to a@b.cd or 10.0.0.1", "k")], "doc_id long, text string, lang string")
    got = redacted(df)
    assert got.columns == df.columns
    assert sorted(map(str, (r.text for r in got.collect()))) == ["None", "to [EMAIL] or [IP]", "to [EMAIL] or [IP]"]
    assert redacted(df.limit(0)).count() == digest(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = digest(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
