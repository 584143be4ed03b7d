"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import leaks, lookalike, markup, mixing, mojibake, quality, scans, sentences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lookalike.p1_found,
    "p1_canonical": lookalike.p1_canonical,
    "p2_found": mojibake.p2_found,
    "p2_restored": mojibake.p2_restored,
    "p2_mappings": mojibake.p2_mappings,
    "p2_undecided": mojibake.p2_undecided,
    "p3_found": markup.p3_found,
    "p3_clean": markup.p3_clean,
    "p4_found": sentences.p4_found,
    "p4_units": sentences.p4_units,
    "p5_found": scans.p5_found,
    "p5_paragraphs": scans.p5_paragraphs,
    "p6_found": leaks.p6_found,
    "p6_tiles": leaks.p6_tiles,
    "p7_mix": mixing.p7_mix,
    "p7_shares": mixing.p7_shares,
    "p7_kept": mixing.p7_kept,
    "p8_found": quality.p8_found,
    "p8_stats": quality.p8_stats,
}


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The SQL has tables of its own, written down from the Unicode standard and the description of the problem. Fixed values:
# characters without ink, blanks, forms in ranges that look like what they stand for, and shapes that scripts share.
SQL_INKLESS = r"\x01-\x08\x0E-\x1F\x7F-\x9F\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{13430}-\x{1343F}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0001}\x{E0020}-\x{E007F}\x{E0100}-\x{E01EF}"
SQL_BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SQL_SHAPES = (
    ("aаɑ", "cсϲᴄⲥꮯ", "dԁ", "eеҽ", "fքꞙ", "gɡց", "hһհ", "iіιꙇ", "jјϳ", "kκ", "lӏ", "nոռ", "oоοօᴏⲟ", "pрρⲣ", "qԛգզ", "sѕꜱ", "uυսᴜ", "vνѵᴠ", "wԝաᴡ", "xх", "yуү", "zᴢ")
    + ("AАΑᎪ", "BВΒᏴ", "CСϹᏟⲤ", "DᎠ", "EЕΕᎬ", "FϜ", "GԌᏀ", "HНΗᎻⲎ", "IІΙӀⲒ", "JЈͿᎫ", "KКΚᏦⲔ", "LᏞ", "MМΜϺᎷⲘ", "NΝⲚ", "OОΟՕⲞ", "PРΡᏢⲢ", "QԚ", "RᏒ", "SЅՏᏚ", "TТΤᎢⲦ", "UՍ", "VѴᏙ", "WԜᎳ", "XХΧⲬ", "YҮΥⲨ", "ZΖᏃ")
    + ("æӕ", "ÆӔ", "əә", "ëё", "ËЁ", "ïї", "ÏЇ", "-‐‑", ":∶", "·‧∙⋅", "’ʼ")
)


def look_key_sql(col: str) -> str:
    """The look key of a text in DuckDB: compatibility forms by their tags in the Unicode database, shapes, composition."""
    one, many = dict.fromkeys(SQL_BLANKS, " "), {}
    for cp in (*range(0xB5, 0x2E80), *range(0x2E80, 0x3400), *range(0xF900, 0xFFEF)):
        tag, _, _ = unicodedata.decomposition(chr(cp)).partition(" ")
        joined = tag == "<compat>" and (cp in (0xB5, 0x587, 0x2024, 0x2103, 0x2109, 0x2E9F) or 0x132 <= cp <= 0x133 or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3 or 0x2160 <= cp <= 0x217F or 0x2F00 <= cp <= 0x2FD5 or 0xFB00 <= cp <= 0xFB06 or 0xFB13 <= cp <= 0xFB17)
        if tag in ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>") or joined:
            to = unicodedata.normalize("NFKC", chr(cp))
            if chr(cp) not in one and cp not in (0xFF9E, 0xFF9F):
                (one if len(to) == 1 else many)[chr(cp)] = to
    one |= {"\uff9e": "\u3099", "\uff9f": "\u309a"}
    shape = {c: g[0] for g in SQL_SHAPES for c in g[1:]}
    # letters with marks whose base has another's shape, as far as one character stands for the result
    for cp in range(0x370, 0x2000):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and chr(cp) not in shape and any(p in shape for p in parts):
            to = unicodedata.normalize("NFC", "".join(shape.get(p, p) for p in parts))
            if len(to) == 1:
                shape[chr(cp)] = to
    e = f"regexp_replace(replace(replace({col}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[{SQL_INKLESS}]', '', 'g')"
    # forms of several characters that occur in European and Asian text; positional Arabic forms map one to one above
    for k, v in many.items():
        if ord(k) < 0x2E80 or 0xFB00 <= ord(k) <= 0xFB06:
            e = f"replace({e}, {_quote(k)}, {_quote(v)})"
    e = f"nfc_normalize(translate({e}, {_quote(''.join(one))}, {_quote(''.join(one.values()))}))"
    return f"nfc_normalize(translate({e}, {_quote(''.join(shape))}, {_quote(''.join(shape.values()))}))"


def oracle_sql() -> dict[str, str]:
    texts = """
        SELECT 'sourcefile' AS field, file_id AS id, sourcefile AS text FROM source_files WHERE intake = 'register' AND sourcefile IS NOT NULL
        UNION
        SELECT 'targetfile', run_id, targetfile FROM target_files
        WHERE targetfile IS NOT NULL AND file_id IN (SELECT file_id FROM source_files WHERE intake = 'register')"""
    p1 = f"""
        WITH t AS MATERIALIZED ({texts}), k AS MATERIALIZED (SELECT field, id, text, {look_key_sql('text')} AS key FROM t)
        SELECT DISTINCT a.field AS field, a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.field = b.field AND a.key = b.key
        WHERE a.id < b.id AND a.text <> b.text"""
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    p6 = f"""
        WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, {words} AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS k FROM d WHERE len(w) >= 15)),
        ig AS (SELECT item_id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS k FROM i WHERE len(w) >= 15))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
    p7 = "SELECT source, true AS share_kept, true AS repeats_kept FROM mix_targets WHERE source IS NOT NULL AND target_share > 0"
    return {"p1_found": p1, "p6_found": p6, "p7_kept": p7}
