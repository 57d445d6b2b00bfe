"""Counts, shares and audits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import markup
from quirefold.functions.metrics import cer, tag_accuracy, wer
from quirefold.operators.quantiles import quantiles
from quirefold.tables import fresh


def group_count(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most first, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def top_groups(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return group_count(df, column).limit(n)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of all rows; the total is one row, which is all that is broadcast."""
    counts, (total,) = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), fresh(df, "total")
    return counts.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(total)))).withColumn("share", F.col("n") / F.col(total)).drop(total)


def error_rates(pairs: DataFrame, truth: str, guess: str, words: bool = True) -> DataFrame:
    """Pairs with cer (and wer): null where the guess is missing.

    An edit distance costs far more a byte than reading it, so the pairs are dealt out evenly first: partitions that are
    sized by bytes, or one small input file, would leave most cores idle.
    """
    spark = pairs.sparkSession
    pairs = pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    there = F.col("status") == "ok"
    pairs = pairs.withColumn("cer", F.when(there, cer(F.col(truth), F.col(guess))))
    return pairs.withColumn("wer", F.when(there, wer(F.col(truth), F.col(guess)))) if words else pairs


def macro_average(rates: DataFrame, *keys: str) -> DataFrame:
    """Mean of the pages' rates, each page counting once; missing ones are counted apart."""
    names = [c for c in ("cer", "wer") if c in rates.columns]
    return rates.groupBy(*keys).agg(F.count_if(F.col("status") == "ok").alias("pages"), F.count_if(F.col("status") != "ok").alias("missing"), *(F.avg(c).alias(f"mean_{c}") for c in names))


def outcomes(df: DataFrame, good: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


def tag_census(df: DataFrame, key: str, text: str) -> DataFrame:
    """Openers and pages of each tag."""
    tags = df.select(key, F.explode(markup.openers(F.col(text))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("openers"), F.count_distinct(key).alias("pages"))


def break_position(df: DataFrame, text: str, mark: str = "<pb/>") -> DataFrame:
    """Median and middle half of the relative place of the page break."""
    at = F.locate(mark, F.col(text))
    place = df.where(at > 0).select(((at - 1) / F.length(text)).alias("p"))
    return quantiles(place, F.col("p"), median=0.5, low=0.25, high=0.75).withColumnRenamed("n", "pages")


def aspect_ratio(df: DataFrame, width: str, height: str) -> DataFrame:
    """Number of images and the median of width over height."""
    sized = df.where((F.col(height) > 0) & F.col(width).isNotNull())
    return quantiles(sized, F.col(width) / F.col(height), median=0.5).withColumnRenamed("n", "images")


def _pairs(body: Column) -> tuple[Column, Column]:
    """All pairs of marginal notes, and how many of them have several lines."""
    pairs = F.regexp_extract_all(body, F.lit("(?s)<m>(.*?)</m>"), F.lit(1))
    return pairs, F.size(F.filter(pairs, lambda p: F.contains(p, F.lit("\n"))))


def multiline_share(df: DataFrame, text: str, time: str) -> DataFrame:
    """By month of the files' time: one- and many-line pairs of notes, and the share of the latter (null without pairs)."""
    pairs, many = _pairs(F.col(text))
    found = df.groupBy(F.trunc(time, "month").alias("month")).agg(F.sum(F.size(pairs) - many).alias("single"), F.sum(many).alias("multi"))
    return found.withColumn("share", F.when(F.col("single") + F.col("multi") > 0, F.col("multi") / (F.col("single") + F.col("multi"))))


def note_audit(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Openers, closers, one- and many-line pairs of marginal notes, and pages where they don't balance."""
    body = F.col(text)
    opened, closed = F.regexp_count(body, F.lit("<m>")), F.regexp_count(body, F.lit("</m>"))
    pairs, many = _pairs(body)
    return df.groupBy(*keys).agg(
        F.sum(opened).alias("opened"), F.sum(closed).alias("closed"), F.sum(F.size(pairs) - many).alias("single"), F.sum(many).alias("multi"), F.count_if(opened != closed).alias("unbalanced")
    )


def length_audit(df: DataFrame, text: str, image_tokens: Column, prompt_tokens: int, most: int, per_token: float = 4.0) -> DataFrame:
    """Tokens of image, prompt and answer; too_long where the sum is over the limit."""
    answer = F.ceil(F.length(text) / per_token).cast("long")
    return df.withColumn("tokens", image_tokens + F.lit(prompt_tokens) + answer).withColumn("too_long", F.col("tokens") > most)


def repeated_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Values of the keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def crossed_nesting(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row a closer that cuts through another tag."""
    return df.select(*keys, F.explode(markup.crossing_report(F.col(text))).alias("c")).select(*keys, "c.line", "c.closer", "c.open", "c.text")


def lines_of(counts: DataFrame, column: str) -> Iterator[str]:
    """A report's lines for the console, most first, fetched a partition at a time."""
    for r in counts.orderBy(F.desc("n"), column).toLocalIterator():
        yield f"{str(r[column]):<40} {r['n']:>10}"


def markup_rates(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """Pairs with the rates of their text without tags, and the accuracy of their tags apart from it."""
    # in two steps: inside functions of arrays Spark would take names for the columns made beside them
    judged = pairs.withColumn("tag_accuracy", tag_accuracy(F.col(truth), F.col(guess)))
    return error_rates(judged.withColumns({c: markup.stripped(F.col(c)) for c in (truth, guess)}), truth, guess)
