"""OCR text and page text: joining pages, limits on images, decoding of page content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import useful_ocr_text, useful_page_text


@dataclass(frozen=True)
class ImageLimits:
    frames: int = 5
    pixels: int = 16_000_000
    total_pixels: int = 40_000_000


def ocr_rollup(pages: DataFrame, max_chars: int = 200_000) -> DataFrame:
    """pages: doc_id, pass, page, text, confidence and, where it is known, failure. One row for each document and pass: text in page order,
    a space behind each page, cut where the limit is reached; mean_confidence, n_pages, useful, success (no page failed) and failure (the
    first page's)."""
    order = Window.partitionBy("doc_id", "pass").orderBy("page", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).over(order), F.lit(0))
    room = F.greatest(F.lit(max_chars) - before, F.lit(0)).cast("int")
    cut = pages.withColumn("_part", F.when(room > 0, F.concat(F.substring(F.coalesce("text", F.lit("")), F.lit(1), room), F.lit(" "))))
    parts = F.array_sort(F.collect_list(F.struct("page", "text", "_part")))
    failed = F.col("failure") if "failure" in pages.columns else F.lit(None).cast("string")
    reason = F.min_by(failed, F.when(failed.isNotNull(), F.struct("page", "text")))
    whole = cut.groupBy("doc_id", "pass").agg(parts.alias("_p"), F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("n_pages"), reason.alias("failure"))
    whole = whole.withColumn("text", F.array_join(F.col("_p._part"), "")).drop("_p")
    return whole.withColumns({"useful": useful_ocr_text(F.col("text")), "success": F.col("failure").isNull()})


def ocr_limits(pages: DataFrame, limits: ImageLimits = ImageLimits()) -> DataFrame:
    """doc_id, over_limit, n_images of the first pass's images: too many frames, or too many pixels in one or up to one."""
    pixels = F.col("width").cast("long") * F.col("height")
    so_far = Window.partitionBy("doc_id").orderBy("page", "width", "height").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = pages.withColumn("_px", pixels).withColumn("_sum", F.sum("_px").over(so_far)).withColumn("_n", F.count(F.lit(1)).over(so_far))
    over = (F.col("_px") <= 0) | (F.col("_px") > limits.pixels) | (F.col("_sum") > limits.total_pixels) | (F.col("_n") > limits.frames)
    return seen.groupBy("doc_id").agg(F.bool_or(over).alias("over_limit"), F.count(F.lit(1)).alias("n_images"))


def cap_images(images: DataFrame, n: int, mode: str = "keep") -> DataFrame:
    """The first `n` images of each document in page order ('keep'), or a flag `over_cap` on all of a document that has more ('fail')."""
    if mode == "keep":
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "image"))
        return images.withColumn("_k", place).where(F.col("_k") <= n).drop("_k")
    return images.withColumn("over_cap", F.count(F.lit(1)).over(Window.partitionBy("doc_id")) > n)


def ocr_evidence(pages: DataFrame, limits: ImageLimits = ImageLimits()) -> DataFrame:
    """doc_id, success, text, failure, header_success, header_text, over_limit, n_images: both passes of each document side by side.

    Pages are shuffled once, by document: the roll-up, its two passes and the limits are formed of one grouping.
    """
    dealt = pages.repartition("doc_id")
    rolled = ocr_rollup(dealt)
    of = lambda p, c: F.max(F.when(F.col("pass") == p, F.col(c)))
    met = rolled.groupBy("doc_id").agg(
        of("full", "success").alias("success"), of("full", "text").alias("text"), of("full", "failure").alias("failure"),
        of("header", "success").alias("header_success"), of("header", "text").alias("header_text"),
    ).join(ocr_limits(dealt.where("pass = 'full'"), limits), "doc_id", "left")
    none = {"success": False, "header_success": False, "text": "", "header_text": "", "over_limit": False, "n_images": 0}
    return met.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in none.items()})


#: Text operands of a page's content.
LITERAL = r"\(((?:\\.|[^\\)])*)\)"
HEX = r"<([0-9A-Fa-f\s]+)>"
#: A piece of a literal is an escape or a run of plain characters; named escapes stand for control characters.
PIECE = r"(?s)(\\[0-7]{1,3}|\\[nrtbf()\\]|\\|[^\\]+)"
NAMED = {r"\n": "\n", r"\r": "\r", r"\t": "\t", r"\b": "\b", r"\f": "\f"}
#: Bytes that Windows-1252 reads as other characters than Latin-1 does.
_MOVED = {chr(i): c for i in range(0x80, 0xA0) if (c := bytes([i]).decode("cp1252", "replace")) != "�"}


def windows_1252(data: Column) -> Column:
    """Bytes as text; those that Windows-1252 leaves undefined stand for themselves."""
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(_MOVED), "".join(_MOVED.values()))


def decode_literal(value: Column) -> Column:
    """Escapes of one literal operand; an octal code has two digits or more, a single digit stays one. A literal without a
    backslash is left alone."""

    def one(piece: Column) -> Column:
        rest = F.substring(piece, 2, 3)
        # chr() takes the remainder at 256, and an octal code goes to 511
        coded = F.decode(F.unhex(F.lpad(F.hex(F.conv(rest, 8, 10).cast("int")), 4, "0")), "UTF-16BE")
        out = F.when(piece.rlike(r"^\\[0-7]{2,3}$"), coded)
        for name, char in NAMED.items():
            out = out.when(piece == name, char)
        return out.when((F.length(piece) > 1) & F.startswith(piece, F.lit("\\")), rest).otherwise(piece)

    pieces = F.regexp_extract_all(value, F.lit(PIECE), 1)
    return F.when(F.contains(value, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(value)


def decode_hex(value: Column) -> Column:
    """A hexadecimal operand as Windows-1252; an odd digit is completed with 0."""
    digits = F.regexp_replace(value, r"\s", "")
    return windows_1252(F.unhex(F.concat(digits, F.repeat(F.lit("0"), F.length(digits) % 2))))


def assemble_page_text(page_text: DataFrame) -> DataFrame:
    """page_text: doc_id, page, content (bytes). doc_id, text, useful: pages in order, in each all literals, then all hexadecimal strings."""
    read = page_text.withColumn("_c", windows_1252(F.col("content")))
    found = read.withColumns({"_lit": F.regexp_extract_all("_c", F.lit(LITERAL), 1), "_hex": F.regexp_extract_all("_c", F.lit(HEX), 1)})
    parts = F.concat(F.transform("_lit", decode_literal), F.transform("_hex", decode_hex))
    text = F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit(" "))), "")
    pages = found.select("doc_id", "page", F.coalesce(text, F.lit("")).alias("_t"))
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "_t"))), lambda x: x["_t"]), "").alias("text"))
    return whole.withColumn("useful", useful_page_text(F.col("text")))


