"""Words out of search texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import written

NO_WORD = r"[^\p{L}\p{N}]+"
HAN = r"\p{IsHan}"
SCRIPT_CHANGE = r"(?<=\p{IsHan})(?!\p{IsHan})|(?<!\p{IsHan})(?=\p{IsHan})"


def split_words(text: Column | str) -> Column:
    """A text cut at everything that is no letter or digit, in lower case.

    The first and the last piece may be empty.
    """
    return F.split(F.lower(text), NO_WORD)


def explode_words(
    df: DataFrame, col: str, word: str = "word",
    tokenizer: Callable[[str], Iterable[str]] | None = None,
) -> DataFrame:
    """One row per word of ``col``; rows without words vanish.

    ``tokenizer`` replaces the built-in splitting by a Python function, run on
    Arrow batches.  A text it fails on gives one row with a null word.
    """
    others = [c for c in df.columns if c != col]
    if tokenizer is not None:
        return df.select(*others, F.explode(_tokenize(tokenizer)(F.col(col))).alias(word))
    return df.select(*others, F.explode(split_words(col)).alias(word)).filter(F.col(word) != "")


def _tokenize(tokenizer: Callable[[str], Iterable[str]]):
    def one(text: str | None) -> list[str | None]:
        try:
            return list(tokenizer(text))
        except Exception:  # the caller's tokenizer may fail in any way
            return [None]

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return tokens


def segment(df: DataFrame, col: str, dictionary: DataFrame, dict_col: str = "word") -> DataFrame:
    """Finest-grained segmentation of ``col`` by a dictionary.

    Gives the input columns but ``col``, plus ``word`` and ``n``, how often the
    text holds it:

    * every dictionary word found anywhere in a run of Han characters or of other
      letters and digits, overlapping ones included;
    * every run without Han characters as a whole, such as ``spark`` or ``0524``;
    * every Han character that no dictionary word covers.

    Texts share most of their runs, so each distinct run is cut up only once:
    count runs per text, segment the distinct runs, and join the words back to the counts.
    """
    others = [c for c in df.columns if c != col]
    pieces = explode_words(df, col, "_piece")
    # Counted as whole pieces first: texts share most of them, and each is looked at for its script once.
    counted = pieces.groupBy(*others, "_piece").agg(F.count("*").alias("_pieces"))
    # Han characters and others in one piece are runs of their own.
    one_script = F.when(
        F.rlike("_piece", F.lit(HAN)), F.split("_piece", SCRIPT_CHANGE)
    ).otherwise(F.array("_piece"))
    runs = (
        counted.select(*others, "_pieces", F.explode(one_script).alias("_run")).filter(F.col("_run") != "")
        .groupBy(*others, "_run").agg(F.sum("_pieces").alias("_runs"))
    )
    # Looking at the count keeps it in the plan of both uses of the counted runs;
    # so they are equal to Spark, and the texts are read and shuffled once.
    distinct = runs.filter(F.col("_runs") > 0).select("_run").distinct()
    found = segment_runs(distinct, "_run", dictionary, dict_col)
    return (
        runs.join(found, "_run")
        .groupBy(*others, "word").agg(F.sum("_runs").alias("n"))
    )


def segment_runs(
    runs: DataFrame, run: str, dictionary: DataFrame, dict_col: str = "word",
) -> DataFrame:
    """Words of distinct runs: ``(run, word)``, a row for each place the word is found.

    The dictionary is stored by the first two characters of its entries.  Every place of
    a run is joined with the entries that start as it does and keeps those it goes on
    with; nothing is cut into substrings.  In a run without Han characters the run itself
    is a word if no entry equals it.  In one with Han characters a character is a word if no
    hit at its place or before reaches it: a running maximum of where hits end.
    """
    entries = dictionary.select(F.lower(dict_col).alias("word")).filter(F.length("word") > 0).distinct()
    # Written, so that its size is known when the places are joined with it.
    by_start = written(
        entries.groupBy(F.left("word", F.lit(2)).alias("_start")).agg(F.collect_list("word").alias("_entries")), "dictionary")
    known = by_start.select(F.explode("_entries").alias("word"))
    has_single = by_start.agg(F.coalesce(F.max(F.length("_start") == 1), F.lit(False))).scalar()
    size, han = F.length(run), F.rlike(run, F.lit(HAN))

    def hits_in(rows: DataFrame, how: str) -> DataFrame:
        at = F.explode(F.sequence(F.lit(1), F.length(run)))
        places = rows.select(run, at.alias("_at")).withColumn("_rest", F.substring(F.col(run), F.col("_at"), F.length(run)))
        starts = F.when(has_single, F.array_distinct(F.array(F.left("_rest", F.lit(2)), F.left("_rest", F.lit(1))))).otherwise(
            F.array(F.left("_rest", F.lit(2))))
        met = places.withColumn("_start", F.explode(starts)).join(by_start, "_start", how)
        return met.withColumn("_hits", F.filter(F.coalesce("_entries", F.array().cast("array<string>")), lambda w: F.startswith("_rest", w)))

    plain, script = runs.filter(~han & (size > 0)), runs.filter(han)
    whole = plain.join(known, F.col(run) == F.col("word"), "left_anti").select(run, F.col(run).alias("word"))
    in_plain = hits_in(plain, "inner").select(run, F.explode("_hits").alias("word"))
    # A place may stand here twice, by one character and by two.
    in_script = hits_in(script, "left")
    ends = F.col("_at") + F.array_max(F.transform("_hits", lambda w: F.length(w))) - 1
    reached = F.max(ends).over(Window.partitionBy(run).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = in_script.withColumn("_reached", F.coalesce(reached, F.lit(0)))
    single = placed.filter(F.col("_reached") < F.col("_at")).select(run, "_at", F.left("_rest", F.lit(1)).alias("word")).distinct()
    return in_plain.union(whole).union(placed.select(run, F.explode("_hits").alias("word"))).union(single.select(run, "word"))
