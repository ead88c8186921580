"""Language identification by compression.

Each language has a zstandard raw-content dictionary: its commonest words, counted over all training
texts, the commonest last, where matches are cheapest.  A text is encoded in chunks, in lower case, with
every dictionary; the language whose sizes sum to least is chosen.  Where the margin to the second is
narrow the row is marked ``rejected``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, remainder, slices

#: Words of a dictionary, and letters of a word that may be one: what a model may weigh.
WORDS, LETTERS = 2048, 40
#: Parts in which a language's words are ranked.
PARTS = 64
CHUNK = 2048
#: Lazy matching from four bytes on: languages differ in short strings, which fast levels skip.
SEARCH = {"min_match": 4, "hash_log": 16, "chain_log": 16, "search_log": 4, "window_log": 18, "target_length": 16}
#: A lead below this share of the second-best size is no evidence.
MARGIN = 0.004
#: How fast a lead turns into certainty in ``score``.
SHARPNESS = 40.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", words: int = WORDS) -> dict[str, bytes]:
    """Dictionaries by language, that of most texts first.

    Words are runs of letters, counted over whole texts; those as common as each other go by the alphabet.
    Rows with null text or language, and texts without letters, teach nothing; rows with one text count each.
    An empty table gives no dictionary.  The driver receives ``words`` short words a language.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l")).where("t is not null and l is not null").where(F.coalesce(remainder("i", 4) != 2, F.lit(True)))
    texts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    each = rows.select("l", F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(1, LETTERS))
    counts = each.groupBy("l", "w").agg(F.count("*").alias("n"))
    order = (F.col("n").desc(), F.col("w"))
    part = F.pmod(F.xxhash64("w"), F.lit(PARTS))  # the best of each part first, so no task ranks a whole language
    some = counts.withColumn("r", F.row_number().over(Window.partitionBy("l", part).orderBy(*order))).where(F.col("r") <= words)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(*order))).where(F.col("r") <= words)
    found: dict[str, list[str]] = {}
    for r in sorted(best.select("l", "r", "w").collect(), key=lambda r: -r["r"]):
        found.setdefault(r["l"], []).append(r["w"])
    return {l: f" {' '.join(found[l])} ".encode() for l in sorted(found, key=lambda l: (-texts[l], l))}


class Scorer:
    def __init__(self, dictionaries: dict[str, bytes], chunk: int = CHUNK):
        import zstandard as z

        self.langs, self.chunk = list(dictionaries), chunk
        self.by = []
        for l in self.langs:
            d = z.ZstdCompressionDict(dictionaries[l], dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY, write_content_size=False, write_dict_id=False, **SEARCH)
            d.precompute_compress(compression_params=p)
            self.by.append(z.ZstdCompressor(compression_params=p, dict_data=d).compress)

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode()
        chunks = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        return [sum(len(f(c)) for c in chunks) for f in self.by]

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score, rejected.  Ties go to the first language."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = min(sizes)
        at = sizes.index(best)
        second = min(sizes[:at] + sizes[at + 1 :], default=2 * best)
        score = 1 / sum(math.exp(-SHARPNESS * (s / best - 1)) for s in sizes)
        return self.langs[at], score, (second - best) / second < margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of each row.

    Null text, text without a letter, or a model without languages: ``und``, 0, rejected.  Sizes that are
    equal go to the language of most texts.  Texts are read whole, however long; rows with one id, or one
    text, get a row each; other columns aren't read and may have any name; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        s = Scorer(dictionaries)

        def f(cols):
            got = [s.predict(t, margin) for t in cols[1]]
            return {id_col: cols[0], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "rejected": [x[2] for x in got]}

        return f

    return arrow_rows(docs, make, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean", id_col, text_col)


def keep(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text_col: str = "text") -> DataFrame:
    """The rows whose language is clear, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        s = Scorer(dictionaries)
        for whole in batches:
            for b in slices(whole, at):
                yield b.filter(pa.array([not s.predict(t.as_py(), margin)[2] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
