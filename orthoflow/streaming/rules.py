"""The stateless layers over a stream of paragraphs. Book statistics need whole books, so they are a batch's work.

Normalised text and token counts run on a stream unchanged; `correct_batches` runs all rule layers, with their edit log, on each
micro-batch, with the books' tone style from an earlier batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layers
from ..operators.tokens import tokens
from ..plans.correct import ROW, layered
from ..sources.lexicon import Options


def normalised(paras: DataFrame, options: Options = Options()) -> DataFrame:
    """`paras` (stream or batch) with `text` through the Unicode, composition, punctuation and spacing layers."""
    c = F.col("text")
    if options.unicode:
        c = layers.compose(layers.clean_unicode(c))
    out = paras.withColumn("text", c)
    c = F.col("text")
    if options.punctuation:
        c = layers.punctuation(c, options)
    if options.spacing:
        c = layers.collapse_spaces(c)
    return out.withColumn("text", c)


def token_class_counts(paras: DataFrame, keys: list[str], event_time: str | None = None, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Tokens by class; with `event_time`, per window, dropping what is later than `late`."""
    if event_time is None:
        return tokens(paras, keys).groupBy("token_class").agg(F.count(F.lit(1)).alias("n"))
    toks = tokens(paras.withWatermark(event_time, late), [*keys, event_time])
    return toks.groupBy(F.window(event_time, window), "token_class").agg(F.count(F.lit(1)).alias("n"))


def correct_batches(style: DataFrame, write: Callable[[DataFrame, int], None], options: Options = Options()) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`: hands each micro-batch's paragraphs after layers 1 to 6 to `write`, with the batch's number.

    `style` (book_id, style) is a batch run's; books that it lacks have the old style. Rows: row_id (within the batch), keys, text_before,
    text, edits, doubtful. A batch that runs again gives the same rows, so `write` can make them count once by its number.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.filter("text IS NOT NULL").withColumn(ROW, F.monotonically_increasing_id())
        write(layered(rows, style, options), number)

    return run
