"""Page sources and page-level operators.

A batch is one DataFrame over all files; every operator is per document, so nothing is looped on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..schemas import DENSE_CHARS, MAX_PAGES, SCAN_RATIO


def files(spark: SparkSession, path: str) -> DataFrame:
    """One row per uploaded PDF (path, size, bytes); other files are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(path)
    return found.select(F.sha1(F.concat(F.col("path"), F.col("modificationTime").cast("string"))).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size_bytes"), "content")


def opened(docs: DataFrame, encrypted: Column, error: Column) -> DataFrame:
    """A status for every document; bad ones keep their row."""
    return docs.withColumn("status", F.when(encrypted, "password_required").when(error.isNotNull(), "failed").otherwise("processing"))


def density(c: Column) -> Column:
    """Characters other than blanks and line ends."""
    return F.length(F.translate(F.coalesce(c, F.lit("")), " \n", "")).cast("int")


def page_text(pages: DataFrame, *, engine: int = 1, has_image: Column | None = None) -> DataFrame:
    """A03 (engine 1: thin and with an image is image-heavy) or A04 (engine 2: thin is image-heavy)."""
    out = pages.where(F.col("page_number") <= MAX_PAGES).withColumn("text", clean_text(F.col("text")))
    out = out.withColumn("char_count", density(F.col("text")))
    thin = F.col("char_count") < DENSE_CHARS
    return out.withColumn("is_image_heavy", thin if engine == 2 or has_image is None else thin & has_image)


def best_pages(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per page the denser text, the first on ties; pages of the second alone only if the first has none."""
    b = second.select("doc_id", "page_number", F.struct(*[c for c in second.columns if c not in ("doc_id", "page_number")]).alias("b"))
    joined = first.join(b, ["doc_id", "page_number"], "left")
    take = F.coalesce(F.col("b.char_count") > F.col("char_count"), F.lit(False))
    cols = [c if c in ("doc_id", "page_number") else F.when(take, F.col(f"b.{c}")).otherwise(F.col(c)).alias(c) for c in first.columns]
    alone = second.join(first.select("doc_id").distinct(), "doc_id", "left_anti").select(first.columns)
    return joined.select(cols).unionByName(alone)


def overlay_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """OCR text on thin pages where OCR found any."""
    o = ocr.select("doc_id", "page_number", F.col("text").alias("ocr_text"))
    joined = pages.join(o, ["doc_id", "page_number"], "left")
    use = (F.col("char_count") < DENSE_CHARS) & (F.trim(F.coalesce("ocr_text", F.lit(""))) != "")
    return joined.withColumn("ocr_used", use).withColumn("text", F.when(use, F.col("ocr_text")).otherwise(F.col("text"))).drop("ocr_text")


def ocr_confidence(tokens: DataFrame) -> DataFrame:
    """Mean confidence of the recognised tokens (negative ones aside); a page without text failed."""
    return tokens.groupBy("doc_id", "page_number").agg(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))).alias("confidence"), (F.max(F.length(F.trim(F.coalesce("token", F.lit(""))))) > 0).alias("success"))


def classify(pages: DataFrame) -> DataFrame:
    """doc_id, pages, share of image-heavy pages, pdf_type."""
    g = pages.groupBy("doc_id").agg(F.count("page_number").alias("page_count"), F.avg(F.col("is_image_heavy").cast("double")).alias("ratio"))
    kind = F.when(F.col("page_count") == 0, "unknown").when(F.col("ratio") >= SCAN_RATIO, "scanned").when(F.col("ratio") > 0, "mixed").otherwise("text")
    return g.withColumn("pdf_type", kind)


def full_text(pages: DataFrame, *, marked: bool = False) -> DataFrame:
    """D01 (pages joined by a blank line) or D02 (each page after its mark): doc_id, text."""
    piece = F.concat(F.lit("[[PAGE:"), F.col("page_number").cast("string"), F.lit("]]\n"), F.col("text")) if marked else F.col("text")
    parts = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", piece.alias("piece")))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "\n\n").alias("text"))


def dedupe_pages(pages: DataFrame) -> DataFrame:
    """One row per page, the densest, then the longest text."""
    w = Window.partitionBy("doc_id", "page_number").orderBy(F.col("char_count").desc(), F.length("text").desc(), "text")
    return pages.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
