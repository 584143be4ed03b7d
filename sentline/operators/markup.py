"""Tags and entities in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions.text import regularize_ws, sub
from .segment import TAG_CLOSE, TAG_OPEN

# The entities that every markup language has, and the no-break space.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def tag_pattern(mode: str | None = "html") -> str:
    """In xml mode comments and CDATA sections count as one tag each."""
    return K.XML_TAG if mode == "xml" else K.TAG


def tags_of(text: Column, mode: str = "html") -> Column:
    """Array of the tags of a text."""
    return F.regexp_extract_all(text, F.lit(f"({tag_pattern(mode)})"), 1)


def tags(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, tag_no, tag, white space in tags as one blank."""
    t = df.select(key, F.posexplode(F.transform(tags_of(F.col(text)), lambda x: sub(x, r"[ \t\n\x0B\f\r\x{A0}]+", " "))).alias("tag_no", "tag"))
    return t.select(key, F.col("tag_no").cast("bigint").alias("tag_no"), "tag")


def split_around_tags(text: Column, mode: str = "html") -> Column:
    """Blanks around tags, so that text beside a tag is a token of its own."""
    return regularize_ws(sub(text, f"({tag_pattern(mode)})", " $1 "))


def strip_tags(text: Column, mode: str = "html") -> Column:
    """Each tag as a blank."""
    return regularize_ws(tags_blanked(text, mode))


def tags_blanked(text: Column, mode: str = "html") -> Column:
    """Each tag as a blank, white space as it was."""
    return sub(text, tag_pattern(mode), " ")


# what a rule could act on inside a tag, and a private-use character for each while the text is cut
SPECIAL = " .,;:!?()[]{}<>\"'/\\|-&"
HIDDEN = "".join(chr(0xE100 + i) for i in range(len(SPECIAL)))


def tags_hidden(text: Column, mode: str, apart: bool) -> Column:
    """Tags between TAG_OPEN and TAG_CLOSE, white space in them as one blank, with stand-ins that no rule looks at; apart:
    with blanks around, so that each is a token. tags_shown brings them back. A text that holds such stand-ins itself
    passes as it is."""
    pat = tag_pattern(mode)
    shown = lambda t: F.concat(F.lit(TAG_OPEN), F.translate(sub(t, r"[ \t\n\x0B\f\r\x{A0}]+", " "), SPECIAL, HIDDEN), F.lit(TAG_CLOSE))
    gap = " " if apart else ""
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(f"({pat})"), 1), lambda t: F.concat(F.lit(gap), shown(t), F.lit(gap))), F.array(F.lit("")))
    woven = F.array_join(F.zip_with(F.split(text, pat), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(pat) & ~text.rlike(f"[{TAG_OPEN}{TAG_CLOSE}{HIDDEN}]"), woven).otherwise(text)


def tags_shown(text: Column) -> Column:
    """Tags as they were, once the text is cut."""
    return F.when(text.contains(TAG_OPEN), F.translate(text, HIDDEN + TAG_OPEN + TAG_CLOSE, SPECIAL)).otherwise(text)


def decode_entities(text: Column) -> Column:
    for k, v in ENTITIES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text
