"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are spans of four base kinds and unmistakable keys (SECRET).  What stands before a seed makes its
*patterns*, from the closest to the loosest: the two words before it; the word before it with a label's
mark or at a line's start; and the word before it with the seed's own shape.  What else of identifier
shape follows the same is a candidate *instance*; the items of a list share what stands before the first.

Patterns and instances form a graph.  A seed's confidence is 1; a pattern's is the smoothed mean over
its instances, where MIN_SEEDS of them are seeds or accepted already; an instance's is the chance that
not all its patterns are wrong, and those of CONFIDENCE or more count as seeds in the next round.
After ROUNDS rounds, candidates behind patterns of at least CONFIDENCE become spans of kind ``id``.

Positions come from pairing ``split`` with ``regexp_extract_all``: the texts between matches and
the matches, whose lengths add up (in blocks, as arrays grow by copying).  The base patterns are written
so that each is tried once per run of characters and never recurses -- possessive repeats, and a start
only at a run's first character or where the last match ended -- which changes no match, and long runs
stay linear.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without these has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What may be discovered: characters of an identifier and digits among them.
LEAST_CHARS, MOST_CHARS, LEAST_DIGITS = 5, 128, 4
_ID, _JOIN = "[A-Za-z0-9_@#+/.-]", "[_@#+/.-]"
#: Such runs, not within a longer one; stops, dashes and slashes after the last letter or digit aren't part.
CANDIDATE = (
    rf"(?<!{_ID})(?=(?:[A-Za-z_@#+/.-]*+[0-9]){{{LEAST_DIGITS}}})(?={_ID}{{{LEAST_CHARS - 1}}}{_JOIN}*+[A-Za-z0-9])(?!{_ID}{{{MOST_CHARS + 1}}})"
    rf"{_JOIN}*+[A-Za-z0-9]++(?:{_JOIN}++[A-Za-z0-9]++)*+(?![/.-]*+[_@#+])"
)
#: Candidates that are seeds by their form alone: 32 or more hexadecimal digits, letters among them.
SECRET = r"\A(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+\z"
#: What makes the word before it a label.
MARK = r"[:=#|<>\[\](){}\"'`*]"
ROUNDS = 3
MIN_SEEDS = 3
CONFIDENCE = 0.6
HIDDEN = "\u0001"
#: Numbers that one step of a running sum copies at most.
SUMMED = 128


_SPANS = "array<struct<start:int,end:int,text:string,patterns:array<string>>>"


def _let(value: Column, f) -> Column:
    """f(value) with the value evaluated once, also where f uses it within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(numbers: Column) -> Column:
    """What comes before each number, added up.  In blocks of SUMMED, as appending copies what is there."""

    def sums(first: Column, array: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    total = lambda array: F.aggregate(array, F.lit(0), lambda acc, x: acc + x)
    cut = lambda n: F.transform(F.sequence(F.lit(0), ((F.size(n) - 1) / SUMMED).cast("int")), lambda k: F.slice(n, k * SUMMED + 1, F.lit(SUMMED)))
    whole = lambda blocks: F.zip_with(blocks, sums(F.lit(0), F.transform(blocks, total)), lambda block, first: sums(first, block))
    return F.when(F.size(numbers) <= SUMMED, _let(numbers, lambda n: sums(F.lit(0), n))).otherwise(_let(numbers, lambda n: F.flatten(_let(cut(n), whole))))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"\A{PART}(?:\.{PART}){{3}}\z")
    if kind == "card":
        d = F.regexp_replace(m, "[ -]", "")
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _is(kind: str):
    return lambda s: valid(kind, s["text"])


def _of(n: int):
    return lambda s: s["kind"] == n


def _numbered(n: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))


def _pairs(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<p, m>>: each match with the text before it; last the rest, with a null match."""
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(possible, cut).otherwise(F.array(F.struct(text.alias("p"), F.lit(None).cast("string").alias("m"))))


def _located(pairs: Column, contexts: bool = True) -> Column:
    """array<span> of the matches, in code points, end exclusive; with the patterns of each."""
    lengths = F.transform(pairs, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))

    def span(x, at):
        start = at + F.length(x["p"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("text"), (_patterns(x["p"], x["m"], at) if contexts else F.lit(None).cast("array<string>")).alias("patterns"))

    spans = F.zip_with(pairs, _running(lengths), span)
    return F.when(F.size(pairs) > 1, F.filter(spans, lambda x: x["text"].isNotNull())).otherwise(F.array().cast(_SPANS))


def _masked(pairs: Column, good, filler) -> Column:
    """The text with each match for which ``good`` holds replaced."""
    part = lambda x: F.concat(x["p"], F.when(x["m"].isNull(), "").when(good(x["m"]), filler(x["m"])).otherwise(x["m"]))
    return F.when(F.size(pairs) > 1, F.array_join(F.transform(pairs, part), "")).otherwise(F.try_element_at(pairs, F.lit(1))["p"])


def _patterns(before: Column, match: Column, at: Column) -> Column:
    """Patterns of a match after some text that starts at ``at``; null where that text has no letter.

    Two words: ``2 w w``; a label: ``1 w sep``; a word and the match's shape: ``s w 9a``.
    """

    def of(back: Column) -> Column:
        word = lambda n: F.reverse(F.regexp_extract(back, r"\A([^\p{L}]*+)(\p{L}++)([^\p{L}]*+)(\p{L}*+)", n))
        rest = F.regexp_extract(back, r"\A[^\p{L}]*+\p{L}++[^\p{L}\n]*+(\n?)", 1) != ""
        alone = (F.length(F.regexp_extract(back, r"\A([^\p{L}]*+\p{L}++[^\p{L}\n]*+)\z", 1)) > 0) & (at == 0)  # nothing before it in the whole text
        separator = F.regexp_replace(word(1), r"\s+", " ")
        label = F.when(separator.rlike(MARK) | rest | alone, F.concat(F.lit("1 "), word(2), separator))
        two = F.when(word(4) != "", F.concat(F.lit("2 "), word(4), F.lit(" "), word(2)))
        shape = F.concat(F.lit("s "), word(2), F.lit(" "), F.regexp_replace(F.regexp_replace(match, "[0-9]", "9"), "[A-Za-z]", "a"))
        return F.when(word(2) != "", F.array_compact(F.array(two, label, shape)))

    return _let(F.reverse(F.lower(before)), of)


def scanned(docs: DataFrame, text: str, named: bool = False) -> DataFrame:
    """docs with ``email`` .. ``phone`` (base spans), ``_found`` (candidates) and, if ``named``, ``_rest`` (the text with base spans as names, cut at candidates)."""
    digits = F.col("_digits")
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_digits", F.col("_t").rlike("[0-9]"))
    for kind in KINDS:
        possible = (F.lit(True) if kind == "email" else digits) & (F.lit(True) if NEEDS[kind] is None else F.contains(F.col("_t"), F.lit(NEEDS[kind])))
        df = df.withColumn(f"_{kind}", _pairs(F.col("_t"), BASE[kind], possible))
    for kind in KINDS:
        df = df.withColumn(kind, F.filter(_located(F.col(f"_{kind}")), _is(kind)))
    # marks of the same length keep places; names don't, but nothing around them matches otherwise
    fillers = {"_h": lambda kind, m: F.repeat(F.lit(HIDDEN), F.length(m))} | ({"_g": lambda kind, m: F.lit(f"[{kind.upper()}]")} if named else {})
    for col, filler in fillers.items():
        df = df.withColumn(col, F.col("_t"))
        for kind in KINDS:
            # the earlier kinds are hidden already, so this kind's matches are sought again where it has any
            again = _pairs(F.col(col), BASE[kind], F.size(F.col(kind)) > 0)
            df = df.withColumn("_a", again).withColumn(col, _masked(F.col("_a"), partial(valid, kind), partial(filler, kind))).drop("_a")
    df = df.withColumn("_cut", _pairs(F.col("_h"), CANDIDATE, digits)).withColumn("_found", _located(F.col("_cut")))
    if named:
        df = df.withColumn("_rest", _pairs(F.col("_g"), CANDIDATE, digits))
    return df.drop("_t", "_digits", "_cut", *fillers, *[f"_{k}" for k in KINDS])


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) from rows (pattern, instance, seed boolean): those of CONFIDENCE or more.

    Each round is written, so lineage stays short.
    """
    edges = written(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    now = edges.withColumn("weight", F.col("seed").cast("double"))

    def scored(rows: DataFrame) -> DataFrame:
        known = F.sum((F.col("weight") >= CONFIDENCE).cast("int")).alias("known")
        return rows.groupBy("pattern").agg((F.sum("weight") / (F.count("*") + 1)).alias("confidence"), known).where(F.col("known") >= MIN_SEEDS).drop("known")

    for _ in range(rounds):
        met = edges.where("not seed").join(scored(now), "pattern")
        weights = met.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("found"))
        seeds = edges.where("seed").withColumn("weight", F.lit(1.0))
        others = edges.where("not seed").join(weights, "instance", "left").withColumn("weight", F.coalesce("found", F.lit(0.0))).drop("found")
        now = written(seeds.unionByName(others), "weights")
    return scored(now).where(F.col("confidence") >= CONFIDENCE)


def detect(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rest: bool = False) -> DataFrame:
    """``_own`` (a struct of the ``keep`` columns), ``_base`` (array of struct<start, kind number, end>) and ``_more`` (array of struct<i, start, kind number, end, hit>, one for each candidate), and with ``rest`` ``_rest`` and ``_gone`` (null text).

    Null text counts as empty.  Each row is a document of its own, whatever its id; an empty table gives an empty result.
    """
    cols = [F.col(f"`{c}`") for c in keep]
    # own names first: a table may have columns called like ours
    inner = docs.select(F.struct(*cols).alias("_own"), F.col(f"`{text_col}`").alias("_text"))
    df = scanned(inner, "_text", rest)
    base = F.concat(*[F.transform(F.col(k), _numbered(n)) for n, k in enumerate(KINDS)])
    seen = F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["text"].alias("instance"), s["patterns"].alias("patterns"))) for k in KINDS])
    df = df.select(F.monotonically_increasing_id().alias("_row"), "_own", F.array_sort(base).alias("_base"), seen.alias("_seen"), "_found", *(["_rest", F.col("_text").isNull().alias("_gone")] if rest else []))
    df = written(df, "spans")
    cand = df.where(F.size("_found") > 0).select("_row", F.posexplode("_found").alias("i", "s")).select("_row", "i", "s.*")
    # items of a list have no word before them but that before the first
    cand = cand.withColumn("patterns", F.last("patterns", True).over(Window.partitionBy("_row").orderBy("i")))
    cand = written(cand.withColumnRenamed("text", "instance"), "candidates")
    seeds = df.select(F.explode("_seen").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.instance", F.lit(True).alias("seed"))
    behind = cand.select("_row", "i", "instance", F.explode("patterns").alias("pattern"))
    good = confident_patterns(seeds.unionByName(behind.select("pattern", "instance", F.col("instance").rlike(SECRET).alias("seed"))))
    hits = behind.join(good.select("pattern"), "pattern", "left_semi").select("_row", "i").distinct().withColumn("hit", F.lit(True))
    more = F.struct("i", "start", F.lit(len(KINDS)).alias("kind"), "end", F.coalesce("hit", F.lit(False)).alias("hit"))
    lists = cand.join(hits, ["_row", "i"], "left").groupBy("_row").agg(F.array_sort(F.collect_list(more)).alias("_more"))  # a text's own candidates
    empty = F.array().cast("array<struct<i:int,start:int,kind:int,end:int,hit:boolean>>")
    # rows without a candidate need no join, so their texts don't move
    some = df.where(F.size("_found") > 0).join(lists, "_row", "left")
    out = df.where(F.size("_found") == 0).withColumn("_more", empty).unionByName(some)
    return out.select("_own", "_base", "_more", *(["_rest", "_gone"] if rest else []))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans, the hash of their list, all spans, and how many were discovered.

    Null and empty texts have none; rows with one id, or one text, are documents of their own.  Whole texts of
    any length are searched; other columns may have any name.  An empty table gives an empty result.
    """
    df = detect(docs)
    counts = [F.size(F.filter("_base", _of(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    found = F.transform(F.filter("_more", lambda s: s["hit"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.select("_own.doc_id", *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("_base", found))).alias("spans"), F.size(found).cast("long").alias("n_id"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; all other columns, and null texts, as they are."""
    df = detect(docs, text_col, tuple(c for c in docs.columns if c != text_col), rest=True)
    part = lambda x, hit: F.concat(x["p"], F.when(x["m"].isNull(), "").when(hit["hit"], "[ID]").otherwise(x["m"]))  # noqa: E731  the last part has neither match nor hit
    text = F.array_join(F.zip_with("_rest", "_more", part), "")
    return df.select(*[(F.when(~F.col("_gone"), text) if c == text_col else F.col("_own")[c]).alias(c) for c in docs.columns])
