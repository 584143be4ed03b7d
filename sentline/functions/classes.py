"""Character classes as regex fragments that Java and RE2 read alike. White space is always spelled out."""

# Fixed values of the segmentation rules.
SEP = r""".,;:!?()\[\]{}<>"'/\\|\x{2B9}-\x{2BD}\x{A0}-\x{BF}\x{2012}-\x{2027}"""
QUOTE = r""""'«»‘’‚‛“”„‟\x{2B9}-\x{2BD}"""
QUANTITY = r"$%€ƒ‰¢£¥"
LBRACKET, RBRACKET = r"(\[{", r")\]}"
FLAT_SPACE = r" \t\x0B\f\x{A0}"
BULLETS = r"\-*•‣◦\x01-\x07\x0E-\x1F"
VOWELS = "aeiouyAEIOUYàáâãäåæèéêëìíîïòóôõöøùúûüýÿÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝ"
EOL = r"\r\n|\n\r|\r"
BLANK_LINE = r"\n[ \t]*(?:\n[ \t]*)+"
TAG = r"<[/!?]?[A-Za-z][^<>]*>|<!--[^<>]*-->"
XML_TAG = r"<!--(?:[^-]|-[^-])*-->|<!\[CDATA\[(?:[^\]]|\][^\]])*\]\]>|<[/!?]?[\p{L}_:][^<>]*>"
