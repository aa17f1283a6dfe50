"""Block inference over lines: body size, running heads, headings, lists, hyphens, Markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import cell_escape, half_up, markdown_escape, mask_digits
from quire.operators.windows import joined_text, ranked_distinct, weighted_mode


@dataclass(frozen=True)
class Limits:
    """Thresholds; sizes in points or as shares of another size."""

    head_share: float = 1.15
    head_chars: int = 120
    label_chars: int = 40
    ranks: int = 3
    margin: float = 0.12
    repeats: float = 0.4
    pages: int = 3
    space: float = 0.12
    back: float = 0.5
    band: float = 1.8
    band_lines: float = 1.5


LIMITS = Limits()
# Fixed values, as patterns that all of Java, Python and RE2 read alike.
#: Signs, private-use and dingbat characters, then numbers, lower-case letters and Roman numerals with a point or bracket.
_SIGNS = "[•·▪‣◦■□▶►◆◇○●※\\-–—*]|[\ue000-\uf8ff]|[\u2700-\u27bf]"
SIGN = f"^[ ]*(?:{_SIGNS})[ ]*"
BULLET = f"^[ ]*(?:{_SIGNS}|[0-9]+[.)]|\\(?[a-z][.)]|\\(?[ivx]+[.)])[ ]*"
NUMBERED = "^([0-9]+(?:[.][0-9]+)*)[.)]? "
CAPTION = "^(?:[Ff][Ii][Gg](?:[Uu][Rr][Ee])?|[Tt][Aa][Bb][Ll][Ee]|[Tt][Aa][Bb]|[Ss][Cc][Hh][Ee][Mm][Ee]|[Cc][Hh][Aa][Rr][Tt]|그림|표|사진)[.]?[ ]*[0-9]+[.:]?[ ]"
#: Three capitals in a row, no small letter, and a capital first, but for a section's number.
CAPITALS, SMALL, BEGINS = "[A-Z][A-Z][A-Z]", "[a-z]", "^(?:[0-9]+(?:[.][0-9]+)*[ ]+)?[A-Z]"
#: What a paragraph that is over ends with.
ENDED = "[.!?:\"”)\\]]$"


def half_points(size: Column) -> Column:
    return half_up(size * 2) / 2


def body_size(line: DataFrame) -> DataFrame:
    """doc_id, key (the size of most text), weight."""
    return weighted_mode(line, ["doc_id"], half_points(F.col("size")), F.length("text"), "line_no")


def size_ranks(line: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, key, rnk: the greatest sizes above the body's, of lines short enough for headings."""
    body = body_size(line).select("doc_id", F.col("key").alias("body"))
    tall = line.join(body, "doc_id").where((half_points(F.col("size")) > limits.head_share * F.col("body")) & (F.length("text") <= limits.head_chars))
    return ranked_distinct(tall.select("doc_id", half_points(F.col("size")).alias("key")), ["doc_id"], "key", limits.ranks)


def running_key(height: float) -> Column:
    """Where a line stands and what it says but for its numbers."""
    return F.concat_ws("|", half_up(F.col("y") / height * 40).cast("string"), F.substring(mask_digits(F.col("text")), 1, 40))


def running_lines(line: DataFrame, height: float, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, key, n: heads and feet that most pages repeat, in documents of enough pages."""
    pages = line.groupBy("doc_id").agg(F.max("page_no").alias("pages")).where(F.col("pages") >= limits.pages)
    outer = (F.col("y") < limits.margin * height) | (F.col("y") > (1 - limits.margin) * height)
    keys = line.where(outer).groupBy("doc_id", running_key(height).alias("key")).agg(F.count("*").alias("n"))
    return keys.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor(limits.repeats * F.col("pages")))).select("doc_id", "key", "n")


def without_running(line: DataFrame, height: float, limits: Limits = LIMITS) -> DataFrame:
    """line without its running heads and feet (in the outer bands alone)."""
    r = running_lines(line, height, limits).select("doc_id", F.col("key").alias("_key"))
    outer = (F.col("y") < limits.margin * height) | (F.col("y") > (1 - limits.margin) * height)
    keyed = line.withColumn("_key", F.when(outer, running_key(height)))
    return keyed.join(r, ["doc_id", "_key"], "left_anti").drop("_key")


def is_heading(size: Column, body: Column, bold: Column, text: Column, limits: Limits = LIMITS) -> Column:
    """Taller than the body, or short capitals, or short, bold and without a sentence's end."""
    n = F.length(text)
    shout = (n <= 60) & text.rlike(CAPITALS) & ~text.rlike(SMALL) & text.rlike(BEGINS)
    strong = (size >= 0.85 * body) & bold & (n < 80) & ~text.rlike("[.,;:]\\z")
    return (n <= limits.head_chars) & (n > 0) & ~text.rlike(CAPTION) & ((size > limits.head_share * body) | shout | strong)


def number_depth(text: Column) -> Column:
    """1 to 4 by the parts of a leading number, 0 without one."""
    m = F.regexp_extract(text, NUMBERED, 1)
    return F.when(m == "", 0).otherwise(F.least(F.size(F.split(m, "[.]")), F.lit(4))).cast("long")


def list_item(text: Column) -> Column:
    """A list item's text without its bullet; null if it has none, or nothing behind it."""
    item = F.regexp_replace(text, BULLET, "")
    return F.when(text.rlike(BULLET) & (item != ""), item)


def hyphen_words(line: DataFrame) -> DataFrame:
    """doc_id, word: the distinct hyphenated words within lines."""
    found = F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+-[a-z]+', 0)"))
    return line.select("doc_id", found.alias("word")).distinct()


def dehyphenated(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs (doc_id, a, b: a line's last part and the next one's first) with joined: the hyphen stays if the document knows the compound."""
    w = words.select("doc_id", F.col("word").alias("_w"), F.lit(True).alias("_known"))
    j = pairs.withColumn("_w", F.concat("a", F.lit("-"), "b")).join(w, ["doc_id", "_w"], "left")
    return j.withColumn("joined", F.when(F.col("_known"), F.col("_w")).otherwise(F.concat("a", "b"))).drop("_w", "_known")


def needs_space(gap: Column, size: Column, limits: Limits = LIMITS) -> Column:
    return (gap > limits.space * size) | (gap < -limits.back * size)


def block_markdown(kind: Column, level: Column, text: Column) -> Column:
    """One block's Markdown: heading, para, item or code."""
    head = F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), text)
    return F.when(kind == "heading", head).when(kind == "item", F.concat(F.lit("- "), text)).when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(kind == "row", F.concat(F.lit("| "), cell_escape(text), F.lit(" |"))).otherwise(markdown_escape(text))


def documents_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, n_blocks, markdown of blocks (doc_id, ord, md)."""
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), joined_text("md", ["ord"], "\n\n").alias("markdown"))


def documents_json(blocks: DataFrame) -> DataFrame:
    """doc_id, json of blocks (the reader's table): an array of objects by block_id, as many fields in each as its kind has."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    one = F.struct("block_id", F.col("page_no").alias("page"), "bbox", "kind", F.when(F.col("level") > 0, F.col("level")).alias("level"), F.when(F.col("text") != "", F.col("text")).alias("text"), some("items").alias("items"), some("rows").alias("rows"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda b: b.dropFields("block_id"))
    return blocks.groupBy("doc_id").agg(F.to_json(listed).alias("json"))
