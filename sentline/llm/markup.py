"""Problem 3: markup residue, found and turned into clean text that keeps its structure.

A text is cut into blocks at blank lines; code and displayed formulas are kept together and out of reach of all
patterns. The first pass takes each block by itself: stop-word density, length and link density tell prose
("good") from boilerplate and code ("bad"), and notation marks that only one language of markup has decide its
notation. The second pass gives short blocks the label of the nearest decided neighbour. Marks that several
notations or ordinary writing share (single stars and underscores, `#` lines, `''`, rows of pipes, rules of `=`)
count in good blocks, and in bad ones only beside a neighbour of their notation. All of it is SQL expressions and
windows over the blocks of a text. Stop words are counted in the texts themselves.

Null texts give no rows; texts without markup give no rows in found and come out of clean unchanged
but for blank lines. Repeated deliveries give equal rows, which are returned once.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from .common import source_texts, spread, text_hash, within
from .quality import CJK_COMMON, COMMON_WORDS, common_words

# The elements of HTML, current and obsolete.
HTML_TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "i iframe img input ins kbd label legend li link main map mark math menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress "
    "q rp rt ruby s samp script section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr mi mo mn mrow mfrac"
)
# LaTeX commands that stand without an argument.
LATEX_BARE = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Sigma Phi Psi Omega "
    "cdot cdots ldots dots leq geq neq approx equiv pm times div infty partial nabla sum prod int sqrt frac tfrac dfrac item hline toprule midrule bottomrule maketitle tableofcontents noindent "
    "newpage clearpage bigskip medskip smallskip centering LaTeX TeX textwidth linewidth quad qquad rightarrow leftarrow Rightarrow mapsto hfill vspace hspace newline linebreak pagebreak"
)

_tags = "|".join(HTML_TAGS.split())
_entities = "|".join(sorted(name2codepoint, key=lambda x: (-len(x), x)))  # named references by the standard library's table
_bare = "|".join(LATEX_BARE.split())
NEWLINE = "\ue0f0"
# characters of code and formulas that a pattern could act on, and what stands for each while a text is cleaned
SPECIAL = "\n <>&*_`~#=|{}[]()\\$^'\"!:;-+/."
HIDDEN = NEWLINE + "".join(chr(0xE110 + i) for i in range(len(SPECIAL) - 1))
# spans kept as they are: fenced and preformatted code, displayed formulas
FENCED = r"(?m:^ {0,3}```[^\n`]*\n(?s:.*?)\n {0,3}```[ \t]*$)|(?m:^ {0,3}~~~[^\n~]*\n(?s:.*?)\n {0,3}~~~[ \t]*$)"
PRE = r"(?i:<pre\b[^>]*>(?s:.*?)</pre>)"
VERBATIM = r"\\begin\{(?:verbatim|lstlisting)\*?\}(?:\[[^\]\n]*\])?(?s:.*?)\\end\{(?:verbatim|lstlisting)\*?\}"
WIKI_CODE = r"\{\{code\}\}(?s:.*?)\{\{endcode\}\}"
DISPLAY = r"\$\$(?s:[^$]+?)\$\$|\\\[(?s:.*?)\\\]|\\begin\{(?:equation|align|displaymath)\*?\}(?s:.*?)\\end\{(?:equation|align|displaymath)\*?\}"

HTML = rf"(?i:</?(?:{_tags})(?:\s[^<>]*)?/?>|<!--|-->|<!doctype|<!\[CDATA\[)|&(?:{_entities}|apos);|&#[0-9]{{1,7}};|&#[xX][0-9a-fA-F]{{1,6}};"
LATEX = (
    r"\\(?:begin|end)\s?\{|\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{|\{\\(?:bf|it|em|tt|sc|rm|sl|sf|bfseries|itshape|large|small)\b|"
    rf"\\(?:{_bare})(?![A-Za-z])|\\\[|\\\]|\\\(|\\\)|\$\$|(?<![\p{{L}}\p{{Nd}}$])\$(?=[^$\n]*(?:\\[a-zA-Z]|[\^_]\{{))[^$\n]+\$|(?<![\p{{L}}\p{{Nd}}$])\$(?=[^\s$])(?=[^$\n]*[\^_][A-Za-z0-9])[^$\n]+(?<=[^\s$])\$(?![0-9])|"
    r"(?<![\p{L}\p{Nd}])[A-Za-z][_^]\{[^{}\n]+\}|(?<!\\)\\['\"`^~=.][{]?[A-Za-z]\b|~\\[a-z]|(?m:^[^\n]*\S &[^\n]*\\\\[ \t]*$)|``[^`'\n]+''|\\[&%$#_](?=[\s\p{L}\p{Nd}])"
)
WIKI = (
    r"(?m:^={2,6}[^=\n][^\n]*?={2,6}[ \t]*$)|'''|\[\[[^\[\]\n]+\]\]|\{\{ *[A-Za-z#!:][^{}\n]*\}\}|(?m:^\{\|)|(?m:^\|-+[^|\n]*$)|(?m:^\|\}[ \t]*$)|(?m:^[|!][^\n]*(?:\|\||!!))|"
    r"(?m:^[*#:;]+ *(?:\[\[|''))|(?<![\p{L}\p{Nd}])\[https?://[^\s\]]+ [^\]\n]+\]|(?m:^#REDIRECT)|(?<!~)~~~~~?(?!~)(?=\s|$)|__(?:TOC|NOTOC|NOEDITSECTION)__"
)
MARKDOWN = (
    r"(?m:^ {0,3}#{2,6} +\S)|(?m:^ {0,3}(?:```|~~~)[^\n`]*$)|(?<![`\\])`(?!`)[^`\n\x{80}-\x{9F}\x{FFFD}]+`(?!`)|!?\[[^\[\]\n]*\]\([^()\s]+(?: \"[^\"\n]*\")?\)|(?<![\p{L}\p{Nd}_\]])\[[^\[\]\n]+\]\[[\p{L}\p{Nd} ._-]*\]|"
    r"(?m:^ {0,3}\[[^\]\n]+\]: *(?:https?|/|#|\S+\.\S))|(?<![\p{L}\p{Nd}*_\\])\*{2,3}(?=[^\s*])[^*\n]+(?<=[^\s*])\*{2,3}|(?<![\p{L}\p{Nd}*_\\])_{2,3}(?=[^\s_])(?!(?:TOC|NOTOC|NOEDITSECTION)__)[^_\n]+(?<=[^\s_])_{2,3}(?![\p{L}\p{Nd}])|"
    r"(?<!~)~~(?=[^\s~])[^~\n]+(?<=[^\s~])~~(?!~)|(?m:^ {0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$)|"
    r"(?m:^ {0,3}[-*+] \[[ xX]\] )|<https?://[^<>\s]+>"
)
PATTERNS = {"html": HTML, "latex": LATEX, "wiki": WIKI, "markdown": MARKDOWN}
ITALIC = r"(?<![\p{L}\p{Nd}`'])''(?=[^\s'])[^'\n]+''(?!')"
EMPHASIS = r"(?<![\p{L}\p{Nd}*\\])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\p{L}\p{Nd}*])|(?<![\p{L}\p{Nd}_\\])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\p{L}\p{Nd}_])"
HASH = r"(?m:^# +\S)"
PIPES = r"(?m:^\|(?![-}])[^\n]*[^|\s]\s*\|[ \t]*$)"
LINKS = r"(?i:<a\s[^>]*>.*?</a>)|!?\[[^\[\]\n]*\]\([^()\s]+\)|\[\[[^\[\]\n]+\]\]|\\(?:href|url)\{[^}]*\}(?:\{[^}]*\})?"
LONG, DENSE, SPARSE, LINKY = 140, 0.30, 0.05, 0.35
STOP_SHARE = 0.3  # share of the files of a language that hold a stop word


def blocks(texts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per block: keys, block_no, block. Code and displayed formulas are not cut."""
    t = F.regexp_replace("text", F.lit(r"\r\n?"), F.lit("\n"))
    whole = f"{FENCED}|{PRE}|{VERBATIM}|{WIKI_CODE}|{DISPLAY}"
    kept = let(t, lambda x: F.when(x.rlike(r"```|~~~|(?i:<pre\b)|\\begin\{|\{\{code\}\}|\$\$|\\\["), within(x, whole, lambda y: F.replace(y, F.lit("\n"), F.lit(NEWLINE)))).otherwise(x))
    parts = F.transform(F.split(kept, r"\n[ \t]*(?:\n[ \t]*)+"), lambda x: F.replace(x, F.lit(NEWLINE), F.lit("\n")))
    return texts.filter("text IS NOT NULL").select(*keys, F.posexplode(parts).alias("block_no", "block")).filter(F.trim(F.regexp_replace("block", "\n", " ")) != "")


def stop_words(texts: DataFrame, lang: str = "lang") -> list[str]:
    """Words that many files of their language hold; a language is what the table says, and unknown is one, too."""
    return common_words(texts.filter("text IS NOT NULL").select("text", F.coalesce(F.lower(F.trim(lang)), F.lit("und")).alias("language")), STOP_SHARE)


def first_pass(b: DataFrame, stop: list[str]) -> DataFrame:
    """Features of a block and the labels that they decide."""
    t = F.col("block")
    # inline marks of Markdown don't count on indented code lines
    running = F.regexp_replace(t, F.lit(r"(?m)^(?: {4,}|\t).*$"), F.lit(""))
    low = F.regexp_extract_all(F.lower(F.regexp_replace(t, F.lit(r"<[^<>\n]*>|&[a-zA-Z]+;|\\[a-zA-Z]+"), F.lit(" "))), F.lit(r"([\p{L}\p{M}]+)"), 1)
    b = b.withColumns({"low": low, "cjk": F.length(F.regexp_replace(t, F.lit(r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+"), F.lit("")))})
    of_words = F.size(F.filter("low", lambda w: w.isin(stop))) / F.greatest(F.size("low"), F.lit(1)) if stop else F.lit(0.0)
    density = F.when(F.col("cjk") * 2 > F.length(t), F.length(F.regexp_replace(t, F.lit(f"[^{CJK_COMMON}]+"), F.lit(""))) / F.col("cjk")).otherwise(of_words)
    link = F.length(F.array_join(F.regexp_extract_all(t, F.lit(f"({LINKS})"), 1), "")) / F.length(t)
    df = b.withColumns(
        {
            "html": t.rlike(HTML),
            "latex": t.rlike(LATEX),
            "wiki": t.rlike(WIKI),
            "markdown": running.rlike(MARKDOWN),
            "emphasis": running.rlike(EMPHASIS),
            "italic": t.rlike(ITALIC) & ~t.rlike("``"),
            "n_hash": F.regexp_count(t, F.lit(HASH)),
            "setext": _setext(t),
            "pipes": t.rlike(PIPES) & ~t.rlike(r"(?m)^\|-+[^|\n]*$|^\|\}|\|\|"),
            "length": F.length(t),
            "stop_density": density,
            "link_density": link,
        }
    ).drop("low", "cjk")
    decided = F.when(F.col("wiki") & ~F.col("markdown"), "wiki").when(F.col("markdown") & ~F.col("wiki"), "markdown").when(F.col("latex"), "latex").when(F.col("html"), "html")
    quality = (
        F.when(F.col("link_density") > LINKY, "bad")
        .when((F.col("length") >= LONG) & (F.col("stop_density") >= DENSE), "good")
        .when((F.col("length") >= LONG) & (F.col("stop_density") < SPARSE), "bad")
        .when(F.col("length") >= LONG, "near")
        .otherwise("short")
    )
    return df.withColumns({"decided": decided, "quality": quality})


def _setext(t: Column) -> Column:
    """Whether a line is underlined by a rule of about its own length."""
    lines = F.split(t, "\n")
    nxt = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit("")))
    rule = F.zip_with(lines, nxt, lambda a, n: n.rlike(r"\A(?:={3,}|-{3,})[ \t]*\z") & a.rlike(r"\A\S") & (F.abs(F.length(F.rtrim(a)) - F.length(F.rtrim(n))) <= F.greatest(F.length(F.rtrim(a)) * 0.25, F.lit(3))))
    return F.exists(rule, lambda x: x)


def second_pass(b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Ambiguous marks and short blocks take the label of the nearest decided neighbour."""
    back, ahead = W.partitionBy(*keys).orderBy("block_no"), W.partitionBy(*keys).orderBy(F.desc("block_no"))
    no, far = F.col("block_no"), F.lit(1 << 30)

    def nearest(value: str, cond: Column) -> Column:
        one = F.when(cond, F.struct(no, F.col(value).alias("v")))
        # growing frames from both ends: each block is looked at once for each
        prev, nxt = (F.last(one, True).over(w.rowsBetween(W.unboundedPreceding, -1)) for w in (back, ahead))
        dp, dn = F.coalesce(no - prev["block_no"], far), F.coalesce(nxt["block_no"] - no, far)
        return F.when(dp <= dn, prev["v"]).otherwise(nxt["v"])

    b = b.withColumns(
        {
            "near_notation": nearest("decided", F.col("decided").isin("wiki", "markdown")),
            "near_quality": nearest("quality", F.col("quality").isin("good", "bad")),
        }
    )
    quality = F.when(F.col("quality").isin("short", "near"), F.coalesce(F.col("near_quality"), F.lit("good"))).otherwise(F.col("quality"))
    b = b.withColumn("final_quality", quality)
    # a mark that may be an ordinary sign counts in running text, or beside a mark of its notation in the block or next to it
    counts = lambda n: (F.col("final_quality") == "good") | F.col(n) | F.coalesce(F.col("near_notation") == n, F.lit(False))
    # '#' lines: a lone one is a heading of Markdown, several in a row are a list of wikis; a decided neighbour outweighs both
    hash_as = F.when(F.col("wiki") & ~F.col("markdown"), "wiki").when(F.col("n_hash") >= 2, "wiki").when((F.col("near_notation") == "wiki") & F.col("block").contains("\n"), "wiki").otherwise("markdown")
    rows_as = F.coalesce(F.when(F.col("wiki"), "wiki"), F.when(F.col("markdown"), "markdown"), F.col("near_notation"), F.lit("markdown"))
    kept = lambda cond, n: F.when(cond & F.when(n == "wiki", counts("wiki")).otherwise(counts("markdown")), n)
    md, wiki = F.lit("markdown"), F.lit("wiki")
    unsure = (kept(F.col("n_hash") > 0, hash_as), kept(F.col("italic"), wiki), kept(F.col("pipes"), rows_as), kept(F.col("setext"), md), kept(F.col("emphasis"), md))
    found = F.array(*[F.when(F.col(n), n) for n in PATTERNS], *unsure)
    return b.withColumn("notations", F.array_compact(found))


def marked_blocks(texts: DataFrame, keys: tuple[str, ...], stop: list[str] | None = None) -> DataFrame:
    return second_pass(first_pass(blocks(texts, keys), stop if stop is not None else list(dict.fromkeys(COMMON_WORDS.split()))), keys)


def _sub(c: Column, *pairs: tuple[str, str]) -> Column:
    for pat, to in pairs:
        c = F.regexp_replace(c, F.lit(pat), F.lit(to))
    return c


# Named references by the standard library's table; a soft hyphen goes.
NAMED = {n: chr(cp) for n, cp in name2codepoint.items()} | {"apos": "'", "nbsp": " ", "shy": ""}


def _references(c: Column) -> Column:
    """Character references decoded; numeric ones piece by piece, those outside of Unicode left as they are."""
    parts = F.split(c, r"(?=&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)")

    def one(x: Column) -> Column:
        dec, hexa = F.regexp_extract(x, r"\A&#([0-9]{1,7});", 1), F.regexp_extract(x, r"\A&#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(dec != "", dec.try_cast("bigint")).otherwise(F.conv(hexa, 16, 10).try_cast("bigint"))
        ok = x.startswith("&#") & ((code >= 32) | (code == 10)) & (code < 1114112) & ~code.between(55296, 57343)
        return F.when(ok, F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.regexp_replace(x, r"\A&#[xX0-9a-fA-F]{1,8};", ""))).otherwise(x)

    out = F.array_join(F.transform(parts, one), "")
    names = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    known = f"&(?:{_entities}|apos);"

    def named(x: Column) -> Column:
        return F.coalesce(F.try_element_at(names, F.regexp_extract(x, "&([A-Za-z0-9]+);", 1)), x)

    return let(out, lambda x: F.when(x.rlike(known), within(x, known, named)).otherwise(x))


def _code(x: Column) -> Column:
    return F.concat(F.lit("```\n"), F.regexp_replace(x, r"\A\n+|\s+\z", ""), F.lit("\n```"))


def _hidden(c: Column) -> Column:
    """Code in fences and formulas between dollars, out of reach of the patterns that clean."""
    put = lambda x: F.translate(x, SPECIAL, HIDDEN)
    line = lambda x: F.concat(F.lit("\n\n"), put(x), F.lit("\n\n"))
    steps = (
        ("```|~~~", FENCED, lambda x: line(_code(F.regexp_replace(x, r"\A {0,3}(?:```|~~~)[^\n]*\n|\n {0,3}(?:```|~~~)[ \t]*\z", "")))),
        (r"(?i:<pre\b)", PRE, lambda x: line(_code(_references(F.regexp_replace(x, r"(?i)\A<pre\b[^>]*>(?:\s*<code\b[^>]*>)?|(?:</code>\s*)?</pre>\z|</?(?:span|b|i|em|strong)\b[^>]*>", ""))))),
        (r"\\begin\{(?:verb|lst)", VERBATIM, lambda x: line(_code(F.regexp_replace(x, r"\A\\begin\{[a-z]+\*?\}(?:\[[^\]\n]*\])?|\\end\{[a-z]+\*?\}\z", "")))),
        (r"\{\{code\}\}", WIKI_CODE, lambda x: line(_code(F.regexp_replace(x, r"\A\{\{code\}\}|\{\{endcode\}\}\z", "")))),
        (r"\$\$|\\\[|\\begin\{(?:eq|al|dis)", DISPLAY, lambda x: put(F.concat(F.lit("$ "), F.regexp_replace(x, r"\A(?:\$\$|\\\[|\\begin\{[a-z]+\*?\})\s*(?:\\label\{[^{}]*\}\s*)?|\s*(?:\$\$|\\\]|\\end\{[a-z]+\*?\})\z", ""), F.lit(" $")))),
        (r"\$", r"(?<![\p{L}\p{Nd}$])\$(?=[^$\n]*(?:\\[a-zA-Z]|[\^_]))[^$\n]+\$(?![0-9])", put),
        (r"\\\(", r"\\\((?s:.*?)\\\)", lambda x: put(F.concat(F.lit("$"), F.regexp_replace(x, r"\A\\\(\s*|\s*\\\)\z", ""), F.lit("$")))),
        ("`", r"(?<!`)`(?!`)[^`\n]+`(?!`)", lambda x: put(F.regexp_replace(x, "`", ""))),
        (r"(?i:<code\b)", r"(?i:<code\b[^>]*>(?s:.*?)</code>)", lambda x: put(_references(F.regexp_replace(x, r"(?i)</?code\b[^>]*>", "")))),
    )
    def step(has: str, span: str, fn) -> Callable[[Column], Column]:
        return lambda x: F.when(x.rlike(has), within(x, span, fn)).otherwise(x)

    for s in steps:
        c = let(c, step(*s))
    return c


def cleaned(block: Column, notations: Column) -> Column:
    """A block as plain text. Headings become lines that begin with '#', items '- ', code stands in fences,
    formulas between dollar signs, and cells are parted by tabs."""
    has = lambda n: F.array_contains(notations, n)
    safe = ~block.rlike(f"[{HIDDEN}]")
    return let(F.when(safe, _hidden(block)).otherwise(block), lambda b: _shown(_plain(b, has), safe))


def _shown(c: Column, hidden: Column) -> Column:
    return F.trim(_sub(F.when(hidden, F.translate(_sub(c, (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")), HIDDEN, SPECIAL)).otherwise(c), (r"\A\n+|\n+\z", "")))


def _plain(block: Column, has) -> Column:
    html = _references(
        _sub(
            block,
            (r"(?is)<(script|style|head)\b.*?</\1\s*>", ""), (r"(?s)<!--.*?-->|(?i)<!doctype[^>]*>", ""), (r"(?i)<h([1-6])\b[^>]*>", "\n# "), (r"(?i)<li\b[^>]*>", "\n- "),
            (r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>", "\t"), (r"(?i)<sub>([^<]*)</sub>", "_$1"), (r"(?i)<sup>([^<]*)</sup>", "^$1"),
            (r"(?i)<br\s*/?>|</(?:p|div|tr|h[1-6]|li|ul|ol|table)>", "\n"), (r"(?i)<img\b[^>]*\balt=[\"']([^\"']*)[\"'][^>]*>", "$1"), (rf"(?i)</?(?:{_tags})(?:\s[^<>]*)?/?>", ""),
        )
    )
    text = F.when(has("html"), html).otherwise(block)
    latex = _sub(
        text,
        (r"\\(?:sub)*section\*?\{([^{}]*)\}|\\chapter\*?\{([^{}]*)\}", "# $1$2"), (r"\\begin\{(?:equation|align|displaymath|math)\*?\}|\\end\{(?:equation|align|displaymath|math)\*?\}|\\\[|\\\]|\\\(|\\\)|\$\$", "\\$"),
        (r"\\(?:documentclass|usepackage|label|cite|ref|pagestyle)(?:\[[^\]]*\])?\{[^{}]*\}", ""), (r"\\(?:begin|end)\{[^{}]*\}(?:\{[^{}]*\})?", ""), (r"(?m)^[ \t]*\\item(?:\[[^\]]*\])?[ \t]*", "- "),
        (r"(?m)[ \t]*\\\\[ \t]*$", ""), (r"(?<!\\) & ", "\t"), (r"\\(?:emph|textbf|textit|texttt|underline|textsc|footnote|url|href\{[^{}]*\})\{([^{}]*)\}?", "$1"), (r"\{\\(?:bf|it|em|tt|sc|rm|sl|sf)\s+([^{}]*)\}", "$1"), (r"~", " "), (r"\\([&%$#_])", "\\$1".replace("\\$1", "$1")), (r"``([^`']*)''", "“$1”"),
    )
    text = F.when(has("latex"), latex).otherwise(text)
    wiki = _sub(
        text,
        (r"\[\[(?:File|Image|Datei|Category|Kategorie):[^\]|]*(?:\|[^\]|]*)*?\|?([^\]|]*)\]\]", "$1"), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]|]*)\]\]", "$1"), (r"\{\{[^{}]*\}\}", ""),
        (r"(?m)^\{\|.*$|^\|-.*$|^\|\}[ \t]*$", ""), (r"(?m)^[|!] *", ""), (r" *(?:\|\||!!) *", "\t"), (r"'{2,5}", ""), (r"(?m)^[*#]+ +", "- "), (r"(?m)^={2,6} *([^=\n].*?) *={2,6}[ \t]*$", "# $1"), (r"(?m)^:+ +(?!\$)(?![^\n]*\p{L}{4})(\S.*)$", "\\$ $1 \\$"), (r"(?m)^:+ +", ""), (r"\[https?://\S+ ([^\]\n]+)\]", "$1"),
    )
    text = F.when(has("wiki"), wiki).otherwise(text)
    md = _sub(
        text,
        (r"(?m)^(\S.*)\n(?:={3,}|-{3,})[ \t]*$", "# $1"), (r"(?m)^#{1,6} +(.*?)#*[ \t]*$", "# $1"), (r"!?\[([^\[\]\n]*)\]\([^()\s]+(?: \"[^\"\n]*\")?\)", "$1"), (r"(?<![\p{L}\p{Nd}_\]])\[([^\[\]\n]+)\]\[[\p{L}\p{Nd} ._-]*\]", "$1"), (r"(?m)^ {0,3}\[[^\]\n]+\]: .*$", ""),
        (r"(?m)^ {0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?", ""), (r"(?m)^\| *(.*?) *\|[ \t]*$", "$1"), (r" \| ", "\t"), (r"(?<![\p{L}\p{Nd}*_\\])([*_]{1,3})(?=[^\s*_])([^*_\n]+)(?<=[^\s*_])\1(?![\p{L}\p{Nd}])", "$2"), (r"~~([^~\n]+)~~", "$1"), (r"(?m)^[*+] +", "- "),
    )
    text = F.when(has("markdown"), md).otherwise(text)
    return text


def clean_documents(texts: DataFrame, keys: tuple[str, ...], stop: list[str] | None = None) -> DataFrame:
    """keys, clean, markup, n_blocks, n_boilerplate. The blocks of one text meet again by its keys; one text is
    the largest unit that a task holds."""
    # blocks without a mark pass as they are
    b = marked_blocks(texts, keys, stop).withColumn("clean", F.when(F.size("notations") > 0, cleaned(F.col("block"), F.col("notations"))).otherwise(F.trim(F.regexp_replace("block", r"[ \t]+\n", "\n"))))
    g = b.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("block_no", "clean"))).alias("parts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("notations")))).alias("markup"),
        F.count("*").alias("n_blocks"),
        F.count_if(F.col("final_quality") == "bad").alias("n_boilerplate"),
    )
    text = F.array_join(F.filter(F.transform("parts", lambda x: x["clean"]), lambda x: x != ""), "\n\n")
    return g.select(*keys, text.alias("clean"), F.array_join("markup", ",").alias("markup"), "n_blocks", "n_boilerplate")


def _texts(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    t = source_texts(spark, sf, "web", "legacy")
    return spread(t.select("file_id", "text")).withColumn("h", text_hash("text")), stop_words(t)


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    """file_id, clean, markup, n_blocks, n_boilerplate of web and legacy files."""
    t, stop = _texts(spark, sf)
    return clean_documents(t.dropDuplicates(["file_id", "h"]), ("file_id", "h"), stop).drop("h")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """file_id, markup: one row per web or legacy file and notation that it holds."""
    t, stop = _texts(spark, sf)
    return marked_blocks(t, ("file_id", "h"), stop).select("file_id", F.explode("notations").alias("markup")).distinct()
