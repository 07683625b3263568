"""Words and types of documents, and chunks with their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a chunk and shared with the next, the least tail, characters kept of a text of headings only.
CHUNK, SHARED, LEAST_TAIL, MOST_HEADINGS = 170, 40, 25, 4000
#: Words that say nothing about what a text is about.
STOP_WORDS = """a an the and or but if then than that this these those of in on at to for from by with
as is are was were be been being it its it's we our us they their them he she his her you your i not no
do does did have has had will would can could should may might must about into over under after before
during between per each any all some more most other such only own same so too very s t don now""".split()
TOKEN = "[a-z0-9][a-z0-9_%.\\-]*"
#: What in a name or in the first characters of a text tells a document's type, in order.
HEAD = 1500
DOC_TYPES = (
    ("customer_feedback", ("feedback", "verbatim", "nps", "review", "survey", "complaint")),
    ("operations_report", ("operations", "ops ", "incident", "logistics", "supply", "fulfil", "fulfill")),
    ("market_intelligence", ("market", "competitor", "competitive", "intelligence", "share")),
    ("management_commentary", ("commentary", "management", "board", "cfo", "executive")),
    ("sales_report", ("sales", "pipeline", "quota", "region review")),
    ("financial_report", ("financial", "p&l", "income statement", "budget", "forecast")),
)
OTHER_TYPE = "business_document"
_HEADING = "[ \\t]{0,3}#{1,6}[ \\t]+"
_BLANKS = " \t\n\x0b\x0c\r"


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def doc_type(name: Column, text: Column) -> Column:
    """The first type one of whose marks is in the name or at the head of the text; null names and texts hold none."""
    places = [F.lower(F.coalesce(name, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, HEAD))]
    out = F.lit(OTHER_TYPE)
    for kind, marks in reversed(DOC_TYPES):
        here = [F.contains(place, F.lit(m)) for place in places for m in marks]
        test = here[0]
        for x in here[1:]:
            test = test | x
        out = F.when(test, kind).otherwise(out)
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, shared: int = SHARED) -> DataFrame:
    """(doc_id, chunk, heading, text): windows of words that share some with the next, within the block of a heading.

    A block of at most ``size`` words is one chunk with its text as it is. Of a longer one a tail of fewer than
    LEAST_TAIL words is dropped. Every chunk has its block's heading, which is one line, whatever breaks it; a text of
    headings only is one chunk. Blank and null texts have none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = lambda t: F.array_remove(F.split(t, "\\s+"), "")
    block = lambda b: F.struct(F.trim(F.regexp_extract(b, f"^{_HEADING}(.*)", 1)).alias("heading"), F.trim(F.regexp_replace(b, f"^{_HEADING}.*", ""), F.lit(_BLANKS)).alias("body"))
    blocks = F.filter(F.transform(F.split(text, f"(?m)^(?={_HEADING})"), block), lambda b: b["body"] != "")
    whole = F.array(F.struct(F.lit("").alias("heading"), F.substring(F.trim("t"), 1, MOST_HEADINGS).alias("body")))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), blocks.alias("b")).select("doc_id", F.posexplode(F.when((F.size("b") == 0) & F.col("t").rlike("\\S"), whole).otherwise(F.col("b"))).alias("block", "x"))
    own = own.select("doc_id", "block", "x.heading", "x.body", words(F.col("x.body")).alias("w"))
    starts = F.when(F.size("w") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - shared)))
    cut = own.select("*", F.explode(starts).alias("at"))
    kept = cut.where((F.col("at") == 0) | (F.size("w") - F.col("at") >= LEAST_TAIL))
    piece = F.when(F.size("w") <= size, F.col("body")).otherwise(F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " "))
    return kept.select("doc_id", (F.col("block").cast("long") * 1_000_000_000 + F.col("at")).alias("chunk"), "heading", piece.alias("text"))
