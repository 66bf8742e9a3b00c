"""Page clean-up and sliding-window chunks over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import clean_text, is_blank, token_count, trim_ws
from textloom.operators.numbering import range_key, shifted, written


def clean_pages(pages: DataFrame) -> DataFrame:
    """``text`` cleaned, with its ``length`` and ``num_tokens``."""
    return (
        pages.withColumn("text", clean_text(F.col("text")))
        .withColumn("length", F.length("text"))
        .withColumn("num_tokens", token_count(F.col("text")))
    )


def chunk_pages(
    pages: DataFrame,
    size: int = 2,
    step: int = 1,
    max_tokens: int = 1500,
    range_rows: int = 4096,
    dense: bool = False,
) -> DataFrame:
    """Chunks of up to ``size`` consecutive pages of a document.

    Input ``doc_name, page_number, text``; a chunk starts at every ``step``-th
    page and stops before the page that would pass ``max_tokens``.  The first
    page is always taken.  Chunks without text are dropped, the others are
    numbered from 1 within the document.

    A document is cut into ranges of ``range_rows`` page numbers.  What a range starts at,
    and which of its first ``size - 1`` pages also belong to windows of the ranges before
    it, follows from page numbers alone and is a small table joined to the pages.  So windows never need
    a whole document in one task, and the texts are read once and dealt out once; the chunks are written
    and then numbered.  ``dense=True`` promises page numbers 1..n and saves that table.
    """
    if not 1 <= size <= range_rows or step < 1:
        raise ValueError("need 1 <= size <= range_rows and step >= 1")
    measured = pages.select(
        "doc_name", "page_number", "text",
        token_count(F.col("text")).alias("_tokens"), is_blank(F.col("text")).alias("_blank"),
    )
    if dense:
        at = F.col("page_number").cast("long") - 1
        home = F.floor(at / range_rows)
        halo = (at % range_rows < size - 1) & (home > 0)
        placed = measured.withColumn("_home", home).withColumn("_first", home * range_rows)
        targets = F.when(halo, F.array(home, home - 1)).otherwise(F.array(home))
    else:
        home = F.floor(F.col("page_number") / range_rows)
        own = measured.withColumn("_home", home).withColumn("_part", range_key(["doc_name"], home))
        placed = own.join(_range_facts(pages, size, range_rows), "_part", "left")
        mine = F.filter("_halo", lambda h: h["page"] == F.col("page_number"))
        targets = F.concat(F.array("_home"), F.transform(mine, lambda h: h["range"]))
    spread = placed.withColumn("_range", F.explode(targets)).withColumn("_part", range_key(["doc_name"], F.col("_range")))
    by_page = Window.partitionBy("_part").orderBy("page_number")
    frame = by_page.rowsBetween(0, size - 1)
    facts = F.collect_list(F.struct("page_number", "_tokens", "_blank")).over(frame)
    windows = spread.select(
        "doc_name", "_part", "_range", "_home", (F.row_number().over(by_page) - 1 + F.col("_first")).alias("_at"),
        facts.alias("_pages"), F.collect_list("text").over(frame).alias("_texts"),
    ).filter((F.col("_home") == F.col("_range")) & (F.col("_at") % step == 0))

    start = F.struct(F.lit(False).alias("stop"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"))

    def take(state, page):
        stop = state["stop"] | ((state["total"] + page["_tokens"] > max_tokens) & (state["total"] > 0))
        return F.struct(
            stop.alias("stop"),
            F.when(stop, state["total"]).otherwise(state["total"] + page["_tokens"]).alias("total"),
            F.when(stop, state["n"]).otherwise(state["n"] + 1).alias("n"),
        )

    taken = windows.withColumn("_fold", F.aggregate("_pages", start, take)).withColumn(
        "_taken", F.slice("_pages", F.lit(1), F.col("_fold.n"))
    )
    kept = taken.filter(F.exists("_taken", lambda p: ~p["_blank"]))
    text = trim_ws(F.array_join(F.slice("_texts", F.lit(1), F.col("_fold.n")), "\n\n"))
    chunks = kept.select(
        "doc_name",
        "_part",
        F.row_number().over(Window.partitionBy("_part").orderBy("_at")).alias("_local"),
        F.element_at("_taken", 1)["page_number"].alias("start_page"),
        F.element_at("_taken", -1)["page_number"].alias("end_page"),
        F.array_join(F.transform("_taken", lambda p: p["page_number"].cast("string")), ",").alias("pages"),
        text.alias("text"),
        F.length(text).alias("length"),
        F.col("_fold.total").alias("num_tokens"),
    )
    numbered = shifted(written(chunks, "chunks"), "_part", ["doc_name"], "_local", "chunk_id")
    return numbered.select("doc_name", "chunk_id", "start_page", "end_page", "pages", "text", "length", "num_tokens")


def _range_facts(pages: DataFrame, size: int, range_rows: int) -> DataFrame:
    """``_part, _first, _halo`` of each range, from page numbers alone.

    ``_first`` is the position of the range's first page in its document; ``_halo`` lists, for pages that
    windows of an earlier range reach, the page and that range.
    """
    own = pages.select("doc_name", "page_number", range_key(["doc_name"], F.floor(F.col("page_number") / range_rows)).alias("_part"))
    heads = F.slice(F.array_sort(F.collect_list("page_number")), 1, max(1, size - 1))
    ranges = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), heads.alias("_heads"))
    order = Window.partitionBy(F.col("_part")["doc_name"]).orderBy(F.col("_part")["range"])
    first = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if size == 1:
        none = F.array().cast("array<struct<page:int,range:bigint>>")
        return ranges.select("_part", first.alias("_first"), none.alias("_halo"))
    near = F.reverse(F.collect_list(F.struct(F.col("_part")["range"].alias("range"), F.col("_n").alias("n"))).over(order.rowsBetween(-(size - 1), -1)))
    known = ranges.select("_part", first.alias("_first"), "_heads", near.alias("_near"))
    # pages that lie between the end of each earlier range and the start of this one
    gaps = F.transform("_near", lambda r, i: F.struct(
        r["range"].alias("range"), F.aggregate(F.slice("_near", F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("gap")
    ))
    reached = lambda page, j: F.transform(
        F.filter("_gaps", lambda g: j + 1 + g["gap"] <= size - 1), lambda g: F.struct(page.alias("page"), g["range"].alias("range"))
    )
    return known.withColumn("_gaps", gaps).select("_part", "_first", F.flatten(F.transform("_heads", reached)).alias("_halo"))
