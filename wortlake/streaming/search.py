"""Search of a stream of texts against a lexicon at rest. An extension: the batch plan runs on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wortlake.options import LookupOptions
from wortlake.plans.pipeline import Lexicon, search


def search_stream(texts: DataFrame, lexicon: Lexicon, sink: Callable[[DataFrame, int], None], checkpoint: str, options: LookupOptions = LookupOptions()) -> StreamingQuery:
    """Starts a query over a stream (query_id, text, lang). sink gets each micro-batch's segments and its number.

    A batch may be given again after a failure under the same number: a sink that writes by number is exactly-once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sink(search(rows, lexicon, options), number)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
