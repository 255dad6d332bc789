"""Finding many pieces of text in a table of texts by posting lists of three-letter grams, then exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a gram.
GRAM = 3


def _grams(column: str) -> str:
    """SQL for the grams of a text, lower-cased, with their places from 1; none for shorter ones."""
    letters = f"split(lower({column}), '')"
    return f"transform(array({letters}), c -> IF(size(c) < {GRAM}, CAST(array() AS ARRAY<STRUCT<gram: STRING, at: INT>>), transform(sequence(1, size(c) - {GRAM - 1}), i -> struct(concat_ws('', slice(c, i, {GRAM})) AS gram, i AS at))))[0]"


def _distinct(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text): each distinct lower-cased text with the least key that has it."""
    return texts.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("text")).agg(F.min(key).alias("id"))


def index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, id, at): each distinct text, whatever the case, once under each of its grams and their places, by the least key that has it.

    Null texts have none; the key must be unique.
    """
    return _distinct(texts, key, text).select("id", F.explode(F.expr(_grams("text"))).alias("g")).select("g.gram", "id", "g.at")


def search(texts: DataFrame, postings: DataFrame, needles: DataFrame, key: str, text: str) -> DataFrame:
    """(needle, id): each of `needles` (needle) with the texts that have it in them, whatever the case.

    A needle is looked up by its rarest gram. Needles that have the same one at the same place and are equally long share one lookup: the
    stretch of a text that lies so about the gram is cut out once and joined with the needles as a whole, so rows grow with the texts
    and not with texts times needles. Equal texts are searched once. Needles of fewer letters than a gram meet the pieces of
    all texts, as no list can tell. Null and empty needles find nothing; repeated ones count once.
    """
    asked = needles.select("needle").where("needle IS NOT NULL AND needle <> ''").distinct().select("needle", F.lower("needle").alias("low"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    own = asked.select("low", F.explode(F.expr(_grams("low"))).alias("g")).select("low", "g.gram", "g.at")
    rarest = own.join(counts, "gram").groupBy("low").agg(F.min(F.struct("n", "gram", "at")).alias("r"))
    forms = rarest.select("r.gram", F.col("r.at").alias("place"), F.length("low").alias("letters")).distinct()
    met = postings.join(forms, "gram").select("id", (F.col("at") - F.col("place") + 1).alias("start"), "letters").where("start > 0").distinct()
    once = _distinct(texts, key, text)
    stretches = met.join(once, "id").select("text", F.expr("substring(text, start, letters)").alias("low")).distinct()
    hits = stretches.join(asked, "low").select("needle", "text").distinct()
    short = asked.where(F.length("low") < GRAM)
    if not short.isEmpty():
        pieces = once.select("text", F.explode(F.expr("flatten(transform(array(split(text, '')), c -> array_distinct(concat(c, zip_with(c, slice(c, 2, size(c)), (a, b) -> concat(a, coalesce(b, '')))))))")).alias("low"))
        hits = hits.unionByName(pieces.distinct().join(short, "low").select("needle", "text"))
    plain = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.lower(text).alias("text"))
    return hits.join(plain, "text").select("needle", "id")
