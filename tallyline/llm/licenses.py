"""License phrases found through a positional index of rare words.

The words of all templates are looked up in every text and kept with their positions. Of each
template the words that are rarest in the corpus (highest inverse document frequency) are its index
entries: their positions, less those in the template, give the places where it may start, and the
places on which these words agree are candidates. A candidate counts when every word of the
template's key phrase stands there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.text import WORD, ascii_lower, or_empty
from tallyline.sources.staging import stage


@dataclass(frozen=True)
class Template:
    phrase: str
    label: str
    base: bool = False


# The phrases that must be found, and the labels they stand for.
BASE_TEMPLATES = (
    Template("gnu general public license", "gpl", True),
    Template("apache license", "apache", True),
    Template("cc by", "cc-by", True),
    Template("mit license", "mit", True),
)
TEMPLATES = (
    *BASE_TEMPLATES,
    Template("gnu lesser general public license", "lgpl"),
    Template("gnu affero general public license", "agpl"),
    Template("mozilla public license", "mpl"),
    Template("eclipse public license", "epl"),
    Template("bsd license", "bsd"),
    Template("redistribution and use in source and binary forms", "bsd"),
    Template("permission is hereby granted free of charge", "mit"),
    Template("spdx license identifier", "spdx"),
    Template("cc by sa", "cc-by-sa"),
    Template("cc by nc", "cc-by-nc"),
    Template("public domain", "public-domain"),
    Template("all rights reserved", "reserved"),
)
RARE_WORDS = 2
"""Index entries per template: its rarest words, whose places must agree."""


def _postings(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    rows = [(t, word, place) for t, template in enumerate(templates) for place, word in enumerate(template.phrase.split())]
    return docs.sparkSession.createDataFrame(rows, "template int, word string, place int")


def licence_words(docs: DataFrame, templates: tuple[Template, ...], id_col: str, text_col: str) -> DataFrame:
    """One row per text: its id, its number of words and the positions of the templates' words in it."""
    vocabulary = sorted({word for template in templates for word in template.phrase.split()})
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_extract_all(ascii_lower(or_empty(F.col(text_col))), F.lit(f"({WORD})"), F.lit(1)).alias("words"),
    )
    hits = F.filter(
        F.transform("words", lambda word, i: F.struct(i.alias("at"), word.alias("word"))),
        lambda hit: hit["word"].isin(vocabulary),
    )
    counted = found.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    return counted.withColumn("uid", F.monotonically_increasing_id())


def rarest_words(hits: DataFrame, postings: DataFrame, n: int = RARE_WORDS) -> DataFrame:
    """The index entries: per template its ``n`` words of the highest inverse document frequency.

    Frequencies are counted over all texts. A word that stands in a template twice is entered at its first place.
    """
    in_texts = (
        hits.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    )
    rarest = Window.partitionBy("template").orderBy(F.coalesce("df", F.lit(0)), "word")
    return (
        postings.groupBy("template", "word")
        .agg(F.min("place").alias("place"))
        .join(F.broadcast(in_texts), "word", "left")
        .withColumn("rank", F.row_number().over(rarest))
        .filter(F.col("rank") <= n)
        .withColumn("entries", F.count("*").over(Window.partitionBy("template")))
    )


def verify_phrases(candidates: DataFrame, hits: DataFrame, postings: DataFrame) -> DataFrame:
    """The candidates ``uid, template, start`` at which every word of the template's phrase stands.

    Each word a candidate needs is looked up by text and position, so that the work grows with the number of
    candidates and not with their number times the licence words of their text.
    """
    words = postings.withColumn("length", F.count("*").over(Window.partitionBy("template")))
    needed = candidates.join(F.broadcast(words), "template").select(
        "uid", "template", "start", "length", (F.col("start") + F.col("place")).alias("at"), "word"
    )
    # Only the texts with candidates give their licence words to the look-up.
    of_texts = hits.join(candidates.select("uid").distinct(), "uid", "left_semi")
    standing = of_texts.select("uid", F.explode("hits").alias("hit")).select("uid", "hit.at", "hit.word")
    return (
        needed.join(standing, ["uid", "at", "word"])
        .groupBy("uid", "template", "start")
        .agg(F.count("*").alias("n"), F.max("length").alias("length"))
        .filter(F.col("n") == F.col("length"))
        .select("uid", "template", "start")
    )


def scan_licenses(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs`` with the licences its text names.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their smallest
    and largest start (words from 0, null without any), ``n_places`` counts those of all templates,
    ``base_labels`` and ``labels`` are distinct, sorted and joined by commas (empty without any) and
    ``score`` is 1 - 2^-n_places. A null text counts as empty. Rows with equal ids are scanned each for
    itself; an empty table gives an empty result. Other columns are not read. Writes two tables on the way.
    """
    hits = stage(licence_words(docs, templates, id_col, text_col), "licence-words")
    postings = _postings(docs, templates)
    entries = F.broadcast(rarest_words(hits, postings).select("template", "word", "place", "entries"))
    agreed = stage(
        hits.select("uid", F.explode("hits").alias("hit"))
        .select("uid", "hit.at", "hit.word")
        .join(entries, "word")
        .withColumn("start", F.col("at") - F.col("place"))
        .filter(F.col("start") >= 0)
        .groupBy("uid", "template", "start")
        .agg(F.count("*").alias("n"), F.max("entries").alias("entries"))
        .filter(F.col("n") == F.col("entries"))
        .select("uid", "template", "start"),
        "licence-candidates",
    )
    verified = verify_phrases(agreed, hits, postings)
    kinds = docs.sparkSession.createDataFrame(
        [(t, template.label, template.base) for t, template in enumerate(templates)], "template int, label string, base boolean"
    )
    base = F.col("base")
    found = (
        verified.join(F.broadcast(kinds), "template")
        .groupBy("uid")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            F.count("*").alias("n_places"),
            F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        )
    )
    n_places = F.coalesce("n_places", F.lit(0)).cast("long")
    return hits.select("uid", "doc_id", "n_words").join(found, "uid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        n_places.alias("n_places"),
        (1 - F.pow(F.lit(2.0), -n_places)).alias("score"),
    )
