"""Page layout: repeated headers and footers, words to lines, column bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resumelake.functions.text import extracted_text, page_signature

#: Shares of a page's height above which a block can be a header, and below which a footer; room kept free of them.
HEADER, FOOTER, PAD = 0.18, 0.82, 2.0


def repeated(blocks: DataFrame, share: float = 0.6) -> DataFrame:
    """doc_id, zone, signature, n: signatures of blocks (doc_id, page, zone, text) that come at least max(2, round(pages * share)) times; none in one page."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    n = blocks.select("doc_id", "zone", page_signature(F.col("text")).alias("signature")).where("signature <> ''").groupBy("doc_id", "zone", "signature").agg(F.count("*").alias("n"))
    return n.join(pages, "doc_id").where(F.col("pages") > 1).where(F.col("n") >= F.greatest(F.lit(2), F.bround(F.col("pages") * F.lit(share), 0))).select("doc_id", "zone", "signature", "n")


def body(blocks: DataFrame, share: float = 0.6) -> DataFrame:
    """blocks without repeated headers and footers."""
    return blocks.withColumn("signature", page_signature(F.col("text"))).join(repeated(blocks, share), ["doc_id", "zone", "signature"], "left_anti").drop("signature")


def zoned(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, y0, y1, height, text) with zone: header, footer or body, by their place on the page."""
    zone = F.when(F.col("y1") <= F.col("height") * HEADER, "header").when(F.col("y0") >= F.col("height") * FOOTER, "footer").otherwise("body")
    return blocks.withColumn("zone", zone)


def document_text(blocks: DataFrame, share: float = 0.6) -> DataFrame:
    """doc_id, text of documents from their blocks (doc_id, page, x0, y0, y1, height, text): headers and footers that repeat are learned, each page is cut
    to what lies between those that it has (the whole page if that leaves nothing), blocks follow each other from top to bottom, pages end in a form feed."""
    z = zoned(blocks).withColumn("signature", page_signature(F.col("text")))
    learned = repeated(z.where("zone <> 'body'").select("doc_id", "page", "zone", "text").unionByName(z.groupBy("doc_id", "page").agg(F.lit("body").alias("zone"), F.lit("").alias("text"))), share)
    marks = z.join(learned.select("doc_id", "zone", "signature"), ["doc_id", "zone", "signature"], "left_semi")
    cuts = marks.groupBy("doc_id", "page").agg(F.max(F.when(F.col("zone") == "header", F.col("y1") + PAD)).alias("top"), F.min(F.when(F.col("zone") == "footer", F.col("y0") - PAD)).alias("bottom"))
    held = z.join(cuts, ["doc_id", "page"], "left").withColumn("top", F.coalesce("top", F.lit(0.0))).withColumn("bottom", F.coalesce("bottom", "height"))
    inside = (F.col("bottom") <= F.col("top") + 5) | ((F.col("y1") > F.col("top")) & (F.col("y0") < F.col("bottom")))
    pages = held.where(inside).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))), lambda b: b["text"]), "\n").alias("t"))
    whole = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "t"))).alias("p"))
    return whole.select("doc_id", extracted_text(F.array_join(F.transform("p", lambda p: F.concat(p["t"], F.lit("\f"))), "")).alias("text"))


def lines(words: DataFrame, gap: float = 1.5) -> DataFrame:
    """page, block_no, line_no, x0, y0, x1, y1, text from words (page, block_no, line_no, word_no, x0, y0, x1, y1, word); a space where words are over gap apart."""
    one = F.sort_array(F.collect_list(F.struct("word_no", "x0", "x1", "word")))
    g = words.groupBy("page", "block_no", "line_no").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], one.alias("w"))
    joined = F.aggregate("w", F.struct(F.lit(None).cast("double").alias("end"), F.lit("").alias("t")), lambda a, w: F.struct(w["x1"].cast("double").alias("end"), F.concat(a["t"], F.when(a["end"].isNotNull() & (w["x0"] - a["end"] > gap), " ").otherwise(""), w["word"]).alias("t")), lambda a: a["t"])
    return g.select("page", "block_no", "line_no", "x0", "y0", "x1", "y1", joined.alias("text"))


def columns(lines_: DataFrame) -> DataFrame:
    """page, two_columns, split: from the middles of lines (page, x0, x1): over 30 on each side of the median, and a gap over 5 between the left's 90th and the right's 10th hundredth."""
    g = lines_.groupBy("page").agg(F.sort_array(F.collect_list((F.col("x0") + F.col("x1")) / 2)).alias("m"), F.collect_list(F.struct("x0", "x1")).alias("l"))
    mid = F.element_at("m", (F.floor(F.size("m") / 2) + 1).cast("int"))
    g = g.withColumn("mid", mid)
    left = F.sort_array(F.transform(F.filter("l", lambda s: (s["x0"] + s["x1"]) / 2 < F.col("mid")), lambda s: s["x1"]))
    right = F.sort_array(F.transform(F.filter("l", lambda s: (s["x0"] + s["x1"]) / 2 >= F.col("mid")), lambda s: s["x0"]))
    at = lambda xs, q: F.try_element_at(xs, (F.floor(q * (F.size(xs) - 1)) + 1).cast("int"))
    g = g.withColumn("a", left).withColumn("b", right).withColumn("end", at(F.col("a"), 0.9)).withColumn("begin", at(F.col("b"), 0.1))
    two = (F.size("a") > 30) & (F.size("b") > 30) & (F.col("begin") - F.col("end") > 5)
    return g.select("page", F.coalesce(two, F.lit(False)).alias("two_columns"), F.when(two, (F.col("begin") + F.col("end")) / 2).alias("split"))


def reading_order(lines_: DataFrame, split_of: DataFrame, band: float = 6.0) -> DataFrame:
    """page, text: lines by bands of height, left before right."""
    side = F.when(F.col("two_columns") & ((F.col("x0") + F.col("x1")) / 2 >= F.col("split")), 1).otherwise(0)
    rows = lines_.join(split_of, "page").select("page", F.struct(F.floor(F.col("y0") / band).alias("band"), side.alias("side"), "y0", "x0", "text").alias("s"))
    return rows.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]), "\n").alias("text"))
