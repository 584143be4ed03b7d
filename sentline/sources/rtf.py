r"""RTF to text.

The rules are this project's own: control words and groups by the public RTF specification; a paragraph
end gives a blank line. A line break gives one too where the look of a heading (bold, capitals, size) changes
across it, and so does the end of a field that fills its line. `\pard` and `\plain` reset the look; `\binN` is passed over with its bytes.
Destinations that hold no text (tables of fonts, colours, styles, pictures, field instructions) are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([\r\n]+)|([^\\{}\r\n]+)")
# Groups without text, what stands for a control word, and code pages by font character set.
SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object fldinst header footer headerl headerr footerl footerr listtable listoverridetable themedata datastore generator latentstyles rsidtbl xmlnstbl".split())
WORDS = {"par": "\n\n", "sect": "\n\n", "page": "\f\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " "}
CHARSETS = {0: "cp1252", 2: "cp1252", 77: "mac_roman", 128: "shift_jis", 129: "cp949", 134: "gbk", 136: "big5", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}


# The look of plain text, by control word (bold, small capitals, capitals, half points).
PLAIN = {"b": 0, "scaps": 0, "caps": 0, "fs": 24}
FIELD = ("field",)


def fills_line(out: list[str]) -> bool:
    """Whether the text so far ends in a line that only a field wrote."""
    return bool(out) and out[-1].strip() != "" and (len(out) < 2 or out[-2].endswith("\n"))


def heading_end(out: list[str], line_look: tuple | None, broken: tuple | None, look: tuple) -> tuple[tuple, None]:
    """Called before text is written: a break after a line of another look, or after a field of its own, ends the paragraph."""
    if broken not in (None, look) and out and out[-1] == "\n" and line_look is None:
        out.append("\n")
    return (look if line_look is None else line_look), None


def parse(rtf: str | None) -> str | None:
    """Text of one RTF document; a document that is none gives its own text; null gives null."""
    if rtf is None or not rtf.startswith("{\\rtf"):
        return rtf
    out: list[str] = []
    raw = bytearray()
    page, fonts, font_no = "cp1252", {}, 0
    state = {"skip": False, "uc": 1, "font": None, "fonttbl": False, "field": False, **PLAIN}
    stack: list[dict] = []
    eat, first, at = 0, False, 0
    line_look = broken = None  # look of the line's first text, and that of the line before a break that is still a plain one

    def flush() -> None:
        if raw:
            codec = fonts.get(state["font"], page)
            out.append(bytes(raw).decode(codec, "replace"))
            raw.clear()

    def look() -> tuple:
        return tuple(state[k] for k in PLAIN)

    while m := TOKEN.match(rtf, at):
        at = m.end()
        word, num, hexa, sym, brace, eol, text = m.groups()
        if hexa is not None:
            if eat:
                eat -= 1
            elif not state["skip"]:
                line_look, broken = heading_end(out, line_look, broken, look())
                raw.append(int(hexa, 16))
            first = False
            continue
        flush()
        if brace == "{":
            stack.append(dict(state))
            first, eat = True, 0
            continue
        if brace == "}":
            inner, state = state, stack.pop() if stack else state
            if inner["field"] and not state["field"] and fills_line(out):
                broken = FIELD
            eat = 0
        elif sym is not None:
            if sym == "*" and first:
                state["skip"] = True
                continue
            if eat:
                eat -= 1
            elif not state["skip"]:
                out.append({"~": "\xa0", "_": "‑", "-": "\xad"}.get(sym, sym if sym in "\\{}" else "\n\n" if sym in "\r\n" else ""))
        elif word is not None:
            n = int(num) if num else None
            if word == "fonttbl":
                state["fonttbl"] = True
            if word in SKIPPED:
                state["skip"] = True
            elif word == "f" and n is not None:
                font_no = n
                state["font"] = n
            elif word == "fcharset" and state["fonttbl"]:
                fonts[font_no] = CHARSETS.get(n or 0, "cp1252")
            elif word == "ansicpg" and n:
                page = f"cp{n}"
                try:
                    b"".decode(page)
                except LookupError:
                    page = "cp1252"
            elif word == "mac":
                page = "mac_roman"
            elif word == "uc":
                state["uc"] = n if n is not None else 1
            elif word == "u" and n is not None:
                if not state["skip"]:
                    out.append(chr(n & 0xFFFF))
                eat = state["uc"]
            elif word == "bin" and n:
                at += max(n, 0)
            elif word in ("pard", "plain"):
                state.update(PLAIN)
            elif word in PLAIN:
                state[word] = n if n is not None else 1
            elif word == "fldrslt":
                state["field"] = True
            elif word in WORDS and not state["skip"]:
                if word == "line":
                    broken, line_look = broken or line_look, None
                elif "\n\n" in WORDS[word]:
                    broken = line_look = None
                out.append(WORDS[word])
        elif text is not None:
            if eat:
                cut = min(eat, len(text))
                text, eat = text[cut:], eat - cut
            if not state["skip"]:
                if text.strip():
                    line_look, broken = heading_end(out, line_look, broken, look())
                out.append(text)
        first = False
    flush()
    joined = "".join(out)
    # halves of a surrogate pair meet even with white space between them
    joined = re.sub("([\ud800-\udbff])\\s*([\udc00-\udfff])", lambda m: (m[1] + m[2]).encode("utf-16-le", "surrogatepass").decode("utf-16-le"), joined)
    return re.sub("[\ud800-\udfff]", "�", joined).strip()


def rtf_text(text: Column) -> Column:
    """Text of RTF documents, by an Arrow batch function: the one part of the engine that leaves the JVM."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(parse)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(text)
