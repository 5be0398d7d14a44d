"""Spelling variants by a symmetric-delete join.

Each frequent word emits itself and its single deletions; rows that share a key are joined. Besides the shortened string a
key has a slot: 0 for the word itself, else the deleted place. Words that share string and place differ in that one code
point; a deletion that equals another word is one code point longer. So partners at distance two never meet, and every
pair is then verified to be at distance one. Of places that give one string (a double letter) the first meets whole words.

A key's group is bounded by the alphabet, not by the data: at most one word for each code point at the place. Counting
combines on the map side, so a very frequent word is one row for each task. A word's form is its near word of largest
count, if that is RATIO times its own; counts grow by that factor along forms, so there is no cycle, and pointer jumping
finds all roots in a few joins (the logarithm of the longest chain, which is itself a logarithm of the largest count).

Null, empty and wordless texts: no words. Very long texts: whole; their words leave as rows. Ties: the smallest in
code-point order. Null ids: their words stay as they are (see thinned). Repeated rows count again. Empty table: no rows.
Other columns are ignored. No Python runs on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, settle

WORD = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: thinned() takes a code point from one word in so many.
THIN = 199


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word: every run of letters, A-Z alone lower-cased."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("run"))
    plain = F.lower("run") == F.col("run")  # most runs have nothing to translate
    return found.select("doc_id", F.when(plain, F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("word"))


def _without(word: Column, place: Column) -> Column:
    """word without the code point at place, from 1."""
    return F.concat(F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word)))


def thinned(words: DataFrame, one_in: int = THIN) -> DataFrame:
    """Words as runs() gives them; where one_in divides the CRC-32 of '<doc_id>:<word>', without the code point at its remainder by the length."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    return words.withColumn("word", F.when(h % one_in == 0, _without(F.col("word"), (h % F.length("word") + 1).cast("int"))).otherwise(F.col("word")))


def frequent(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: distinct words of min_length code points and min_count occurrences and more."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: both directions of every pair that differs by one inserted, deleted or replaced code point.

    words (materialised; distinct, word and n). A written table is far smaller than its rows, and its cuts are many more, so
    Spark's guess would send them all through the driver: both joins are sort-merge joins, by hint.
    """
    place = F.explode(F.sequence(F.lit(1), F.length("word")))
    cut = words.select("word", "n", place.alias("slot")).withColumn("key", _without(F.col("word"), F.col("slot")))
    first = (F.col("slot") == 1) | (F.substring("word", F.col("slot"), F.lit(1)) != F.substring("word", F.col("slot") - 1, F.lit(1)))
    emitted = words.where(F.length("word") > 0)
    own = emitted.select(F.col("word").alias("key"), F.lit(0).alias("slot"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    cuts = cut.where(F.length("word") > 0)
    replaced = cuts.select("key", "slot", "word").join(cuts.select("key", "slot", F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), ["key", "slot"]).where("word <> near")
    longer = cuts.where(first).select("key", F.lit(0).alias("slot"), "word", "n").join(own.hint("merge"), ["key", "slot"])
    one_way = longer.select("word", "n", "near", "near_n")
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    pairs = replaced.select("word", "near", "near_n").unionByName(one_way.select(both.alias("p")).select("p.*"))
    return pairs.where(F.levenshtein("word", "near") == 1)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form (materialised: word, form): where following forms ends.

    Each round joins a word's last known form with that word's own, so that the way known doubles. Both sides are as many as
    the words with a form, though written small: a sort-merge join, by hint, as in near_pairs. Rows of one root are streamed.
    """
    known = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialise(known.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        known = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            return known


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (distinct words and counts n).

    form: the near word of largest n (ties: the smallest), if that n is ratio times the word's; else null. root: the last of
    a word's forms, the word itself if it has none.
    """

    def build() -> DataFrame:
        counted = materialise(words.select("word", "n"), "words")
        best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
        near = near_pairs(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        grows = -F.col("best.less") >= ratio * F.col("n")
        joined = counted.join(near.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(grows, F.col("best.near")).alias("form"), F.when(grows, -F.col("best.less")).alias("form_n")
        )
        formed = materialise(joined, "forms")
        rooted = roots(formed.where("form IS NOT NULL"))
        return formed.join(rooted.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

    return settle(build, "spelling")
