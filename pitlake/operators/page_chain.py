"""What follows a page: a character budget that rolls over as many pages as it takes.

Pages get a position on their document's line of characters (running sums over slices, so a document of any length spreads over tasks). A page sees the
pages that begin within the budget after its end. Positions are cut into blocks of one budget, so pages find each other by an equi-join and a page
meets at most one budget's worth of others. Characters said to be free do not count, so pages that they fill are passed over whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.operators.prefix import running_sums
from pitlake.session import stage


def with_following(pages: DataFrame, wanted: Column, chars: int, free: Column | None = None, ends: Column | None = None, texts: DataFrame | None = None) -> DataFrame:
    """The ``wanted`` rows of ``pages`` with ``following``: the texts of the pages after each, in order, up to ``chars`` counted characters in all.

    ``pages``: doc_id, page_no, text and more. ``free`` is a number of leading characters of ``text`` that come on top of the budget; a page break
    costs one character. Nothing follows a page with ``ends``, which is itself still seen. A missing page number ends what follows, as the end of the
    document does. Of a page that is there twice each different text is seen. Rows with a null page_no or doc_id have nothing after them. ``texts``
    (doc_id, page_no, text and what ``wanted`` reads) is where the wanted pages and those that follow them are read from, if ``pages`` are costly.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    led = (F.lit(0) if free is None else F.coalesce(free, F.lit(0))).cast("bigint")
    cost = size - led + 1 if ends is None else F.when(ends, chars).otherwise(size - led + 1)
    measured = pages.where("doc_id is not null and page_no is not null").select("doc_id", "page_no", led.alias("_led"), cost.alias("_cost"), wanted.alias("_wanted"))
    thin = stage(measured.groupBy("doc_id", "page_no").agg(F.max("_led").alias("_led"), F.max("_cost").alias("_cost"), F.max("_wanted").alias("_wanted")), "pages")
    placed = running_sums(thin, ["doc_id"], ["page_no"], {"_end": F.col("_cost"), "_nth": F.lit(1)})
    # Page number less rank is constant while numbers follow each other; a gap puts more than a budget between two pages.
    stop = F.col("_end") + (F.col("page_no") - F.col("_nth")) * (chars + 1)
    line = placed.select("doc_id", "page_no", "_led", "_wanted", (stop - F.col("_cost")).alias("_start"), stop.alias("_stop"))
    block = F.floor(F.col("_start") / chars)
    nexts = line.select("doc_id", F.col("page_no").alias("_next"), "_led", "_start", block.alias("_block"))
    seen = F.array_distinct(F.array(F.floor(F.col("_stop") / chars), F.floor((F.col("_stop") + chars - 1) / chars)))
    reach = line.where("_wanted").select("doc_id", "page_no", F.col("_stop").alias("_from"), F.explode(seen).alias("_block"))
    near = (F.col("_start") >= F.col("_from")) & (F.col("_start") < F.col("_from") + chars)
    pairs = reach.join(nexts, ["doc_id", "_block"]).where(near).select(
        "doc_id", "page_no", "_next", (F.col("_led") + chars - (F.col("_start") - F.col("_from"))).cast("int").alias("_most"))
    own = pages if texts is None else texts
    openings = own.select("doc_id", F.col("page_no").alias("_next"), F.coalesce("text", F.lit("")).alias("_text"))
    opened = pairs.join(openings, ["doc_id", "_next"]).groupBy("doc_id", "page_no").agg(
        F.sort_array(F.collect_set(F.struct("_next", F.left("_text", F.col("_most")).alias("text")))).alias("_opened"))
    told = F.coalesce(F.transform("_opened", lambda o: o["text"]), F.array().cast("array<string>"))
    return own.where(wanted).join(opened, ["doc_id", "page_no"], "left").select(*own.columns, told.alias("following"))
