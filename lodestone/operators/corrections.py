"""Dictionary and name corrections, and checks against vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phrases import holding
from .relational import first_per, nearest_name


def dictionary_hits(df: DataFrame, key: str, text: str, dictionary: DataFrame, wrong: str = "wrong") -> DataFrame:
    """Each row with each entry of the dictionary whose wrong text it contains."""
    found = holding(df, dictionary, key, text, wrong)
    return found.join(dictionary, F.col("phrase") == F.col(wrong)).drop("phrase")


def correct_dict(df: DataFrame, key: str, text: str, dictionary: DataFrame, least: float = 0.8) -> DataFrame:
    """Texts with the entries (wrong, correct, confidence) above `least` applied, longest first, and a log: key, corrected, log."""
    hits = dictionary_hits(df, key, text, dictionary.filter(F.col("confidence") > least))
    rules = hits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct((-F.length("wrong")).alias("n"), "wrong", "correct"))).alias("_rules"))
    joined = df.select(key, text).join(rules, key, "left")
    fixed = F.aggregate("_rules", F.col(text), lambda acc, r: F.replace(acc, r["wrong"], r["correct"]))
    log = F.array_join(F.transform("_rules", lambda r: F.concat(r["wrong"], F.lit("->"), r["correct"])), ";")
    return joined.select(key, F.coalesce(fixed, F.col(text)).alias("corrected"), F.coalesce(log, F.lit("")).alias("log"))


def validate_vocab(df: DataFrame, column: str, vocabulary: Sequence[str], fixes: DataFrame) -> DataFrame:
    """df with valid, and for invalid values the suggestion of fixes (wrong, correct)."""
    first = first_per(fixes.select("wrong", "correct"), ["wrong"], ["correct"]).select(F.col("wrong").alias(column), F.col("correct").alias("suggestion"))
    out = df.join(first, column, "left").withColumn("valid", F.coalesce(F.col(column).isin(list(vocabulary)), F.lit(False)))
    return out.withColumn("suggestion", F.when(~F.col("valid"), F.col("suggestion")))


def validate_alias(df: DataFrame, column: str, places: DataFrame, fixes: DataFrame) -> DataFrame:
    """df with `place` and `via`: by name, then alias (places: name, aliases), then the correction table (wrong, correct)."""
    names = places.select(F.col("name").alias(column), F.col("name").alias("_by_name")).distinct()
    aliases = first_per(places.select("name", F.explode("aliases").alias(column)), [column], ["name"]).withColumnRenamed("name", "_by_alias")
    fixed = first_per(fixes.select(F.col("wrong").alias(column), F.col("correct").alias("_by_fix")), [column], ["_by_fix"])
    out = df.join(names, column, "left").join(aliases, column, "left").join(fixed, column, "left")
    via = F.when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_alias").isNotNull(), "alias").when(F.col("_by_fix").isNotNull(), "correction").otherwise("unknown")
    return out.withColumn("via", via).withColumn("place", F.coalesce("_by_name", "_by_alias", "_by_fix")).drop("_by_name", "_by_alias", "_by_fix")


def suspicious_terms(df: DataFrame, key: str, text: str, known_bad: Sequence[str], vocabulary: DataFrame, word: str, pattern: str) -> DataFrame:
    """Known bad strings, and names (matches of pattern) that no word of the vocabulary is within two edits of: key, term, reason."""
    bad = df.select(key, F.explode(F.filter(F.array(*map(F.lit, known_bad)), lambda b: F.contains(F.lower(F.col(text)), F.lower(b)))).alias("term")).withColumn("reason", F.lit("known bad"))
    names = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("term"))
    near = nearest_name(names.select("term"), "term", vocabulary, word).select(F.col("name").alias("term"))
    unknown = names.join(near, "term", "left_anti").select(key, "term").withColumn("reason", F.lit("unknown name"))
    return bad.unionByName(unknown)
