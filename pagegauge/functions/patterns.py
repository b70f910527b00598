"""Character classes, patterns and word lists that decide results.

All patterns are in Java regex dialect.  ``(?d)`` makes ``.`` and ``^``
treat only ``\\n`` as a line end; word and digit classes are spelled out because
the JVM shorthands are ASCII-only.
"""

# --- fixed values: character classes -------------------------------------
# Texts pass through ``exprs.plain_space`` first: every horizontal space becomes
# a blank and every rare line separator a vertical tab, so ``\s`` covers all.
OTHER_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u001f"
OTHER_BREAKS = "\u000c\u001c\u001d\u001e\u0085\u2028\u2029"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_NOT_WS = r"[^\p{L}\p{N}_\s]"
DIGIT = r"\p{Nd}"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"

# --- fixed values: tokenizer ----------------------------------------------
TOKEN = WORD + "+|" + NOT_WORD_NOT_WS

# --- fixed values: text normalizer -----------------------------------------
ENTITY = r"&(#|[A-Za-z])"
# Texts without any of these are in composed form.
MAYBE_NOT_COMPOSED = r"[^\x00-˿]"
# Texts without any of these skip the space and symbol steps.
HIGH = r"[^\x00-ỿ]"
LOW_SPACES = "\u000c\u001c\u001d\u001e\u001f\u0085 ­ "
LOW_SYMBOLS = "·¸×х"
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"
RARE_ENTITY = r"&(?!lt;|gt;|quot;|#39;|#x27;|apos;|nbsp;|amp;)(#|[A-Za-z])"
BRACKETED_URL = r"<(https?://[^>\s]+)>"
BRACKETED_WEB = r"<((?:https?://|www\.)[^>\s]+)>"
BRACKETED_EMAIL = r"<([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})>"
URL = r"https?://[^\s)>\]]+"
STAR_GROUP = r"\(\s*\*+\s*\)"
PLACEHOLDER = "KeptAsIsNo"

IMG_TAG = r"(?i)<img\b[^>]*>"
MD_IMAGE_AND_LINE = r"!\[[^\]]*\]\([^)]+\)[^\n]*"
HTML_BREAK = r"(?i)<\s*br\s*/?\s*>"
HTML_BLOCK_CLOSE = r"(?i)</\s*(p|div|tr|li|h[1-6]|table|section)\s*>"
HTML_BLOCK_OPEN = r"(?i)<\s*(p|div|tr|li|h[1-6]|table|section)\b[^>]*>"
HTML_INLINE = r"(?i)</?\s*(b|strong|i|em|u|span|font|code|sup|sub)\b[^>]*>"
ANY_TAG = r"<[^>]+>"
MD_ESCAPE = r"\\([\\`*_{}\[\]()#+\-.!|])"

MD_LINK = r"\[([^\]]+)\]\([^)]+\)"
FENCE_OPEN = r"```[A-Za-z0-9_-]*"
FENCE = "```"
HEADING = r"(?md)^\s{0,3}#{1,6}\s*"
QUOTE = r"(?md)^\s*>\s*"
BULLET = r"(?md)^\s*[-*+]\s+(?=\S)"
LONE_HASHES = r"(?<!\S)#{1,6}(?!\S)"
LONE_MARKERS = r"(?<!\S)[*_]{1,3}(?!\S)"

TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
CELL_RULE = r"^:?-{3,}:?$"
LIST_BEFORE_PIPE = r"^\s*[-+*]\s+(?=\|)"

STRONG = r"(?d)(\*\*|__)(.*?)\1"
EM_STAR = r"(?<!\S)\*([^\s*][^*\n]{0,120}?[^\s*])\*(?!\S)"
EM_UNDERSCORE = r"(?<!\S)_([^\s_][^_\n]{0,120}?[^\s_])_(?!\S)"
INLINE_CODE = r"`([^`]*)`"
LEFTOVER_MARKERS = r"[*_]{1,3}"
BULLET_GLYPHS = r"[•‣․‥…‧⁃⁌⁍∙◦■-◿✀-➿·¸]"
DASHES = r"[‐-―−﹘﹣－]"
SLASHES = r"[／＼]"
DOT_OPERATORS = r"[•·∙⋅‧]"
TIMES_SIGN = "×"
CYRILLIC_HA = "х"

# The mark comes first: a search steps over other characters quickly, a leading lookbehind is tried at each of them.
COMMA_IN_NUMBER = rf",(?<={DIGIT},)\s+(?={DIGIT})"
POINT_IN_NUMBER = rf"\.(?<={DIGIT}\.)\s+(?={DIGIT})"
SPACE_PERCENT = r"\s+%"
SOFT_PUNCTUATION = rf"(?<!{DIGIT})\s*[:;]\s*(?!{DIGIT})"
SEMICOLON = r"\s*;\s*"
COLON = r"\s*:\s*"
COLON_IN_NUMBER = rf":(?<={DIGIT}:)\s+(?={DIGIT})"
COMMA = rf",(?<!{DIGIT},)\s*(?!{DIGIT})"
SPACE_BEFORE_PUNCTUATION = r"\s+([,.;:%])"
SPACE_AFTER_OPEN = r"\(\s+"
SPACE_BEFORE_CLOSE = r"\s+\)"
# Possessive groups are matched in a loop; a greedy group would recurse once per item.
DOT_RUN = r"(?:\.\s*+){3,}+"
# Prose in which the steps above change white space only: no mark of theirs, no blank before punctuation, no comma or
# point that would lose a blank.  Characters are listed one by one, which makes a class a table look-up.
_INERT = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!\"$'/=?@{}~¡¿ \n\t" + "".join(
    chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
PLAIN_TEXT = (
    r"\A[" + _INERT + r"]*(?:(?<![ \n\t])[,.](?![,.])(?!(?<=[0-9][,.])[ \n\t]++[0-9])[" + _INERT + r"]*)*+\z")
# A comma of such prose that gets its blank.
TIGHT_COMMA = r",(?<![0-9],)(?=[^ \n\t0-9])"

# --- fixed values: table-cell normalizers ------------------------------------
CELL_EMPHASIS = r"\*\*|__|\*|_|`"
CELL_ESCAPED_PIPE = r"\\([|])"
CELL_TO_UPPER_X = "×✓✗✘"
HTML_ITALIC = r"(?is)<\s*(i|em)\s*>(.*?)<\s*/\s*\1\s*>"
HTML_BOLD = r"(?is)<\s*(b|strong)\s*>(.*?)<\s*/\s*\1\s*>"
HTML_CODE = r"(?is)<\s*code\s*>(.*?)<\s*/\s*code\s*>"
MD_BOLD_UNDERSCORE = r"(?s)__(.*?)__"
MD_ITALIC_UNDERSCORE = rf"(?s)(?<!{WORD})_(?!_)(.*?)(?<!_)_(?!{WORD})"
RULE_BETWEEN_PIPES = r"(?<=\|)\s*:?-{3,}:?\s*(?=\|)"
MD_IMAGE = r"!\[[^\]]*\]\([^)]*\)"

# --- fixed values: LaTeX and plain-text fallbacks ---------------------------
LATEX_SIZING = r"\\(left|right)\s*"
FORMULAS = (
    r"(?s)\$\$(.+?)\$\$",
    r"(?s)(?<!\\)\$(?!\$)(.+?)(?<!\\)\$",
    r"(?s)\\\[(.+?)\\\]",
    r"(?s)\\\((.+?)\\\)",
)
PLAIN_IMAGE = r"!\[([^\]]*)\]\([^)]*\)"
PLAIN_LINK = r"\[([^\]]+)\]\([^)]*\)"
PLAIN_MARKERS = r"[`*_>#~-]+"
SENTENCE_GAP = r"(?<=[.!?。！？])\s+"

# --- fixed values: page content filter ----------------------------------------
FIGURE = r"(?is)<figure\b[^>]*>.*?</figure>"
FIGCAPTION = r"(?is)<figcaption\b[^>]*>.*?</figcaption>"
DIV_IMAGE = r"(?is)<div\b[^>]*>\s*<img\b[^>]*/?\s*>\s*</div>"
MD_IMAGE_AND_CAPTION = (
    r"!\[[^\]]*\]\([^)]*\)(?:\s*\n[ \t]*\n[^\n<#!*][^\n]*+(?:\n[^\n<#!*][^\n]*+)*+)?"
)
FENCED_BLOCK = r"(?s)```[\p{L}\p{N}_-]*\n.*?```"
HTML_TABLE = r"(?is)<table\b[^>]*>.*?</table>"
PIPE_TABLE = r"(?md)(?:^[ \t]*+\|[^\n]*+\n)++"
PAGE_FILE = r"^(.+?)_(\d+)\.md$"
STORED_PAGE_FILE = r"_p(\d+)\.md$"
CELL_CONTENT = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
FIGURE_WORD = r"(?i)\bfigure\b"
TABLE_OPEN = r"(?i)<table\b"
# Tables without attributes, entities or markup in their cells, whose text no cell normalizer changes.
_PLAIN_WORD = r"[!-%'-)+-;=?-\[\]^a-~À-ÖØ-фц-\u167f\u1681-ỿ]++"
PLAIN_TABLES = (
    r"^(?:<table>(?:<tr>(?:<t[dh]>(?:" + _PLAIN_WORD + "(?: " + _PLAIN_WORD + r")*+)?+</t[dh]>)++</tr>)++</table>[ \n]*+)*+$")
PLAIN_CELL = r"<t[dh]>([^<]*+)"

# --- fixed values: OCR response clean-up --------------------------------------
IMAGE_DESCRIPTION = (
    r"""(?is)<div\b[^>]*class=["'][^"']*img-(?:description|alt)[^"']*["'][^>]*>.*?</div>"""
)
IMAGE_LABEL = r"\bImage:\s+[^\n]+"
LAZY_MD_IMAGE = r"(?d)!\[.*?\]\([^)]*\)"
TABLE_WRAPPERS = r"(?i)</?(?:thead|tbody|tfoot)[^>]*>"
TABLE_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
TABLE_CELL = r"(?is)<(th|td)([^>]*)>(.*?)</(?:th|td)>"
ROWSPAN = r"""(?i)rowspan=["']?(\d+)["']?"""
COLSPAN = r"""(?i)colspan=["']?(\d+)["']?"""
ANY_TABLE = r"(?is)<table.*?</table>"
HTML_PLACEHOLDER_LINK = r"\[[^\]]*\.html\]\([^\)]*\.html\)"
HEADING_MARKS = r"(?md)^[ \t]*#{1,6}[ \t]+"

# --- fixed values: block types and use cases ----------------------------------
IMAGE_AND_CONTAINER_BLOCKS = (
    "Picture", "Figure", "FigureGroup", "PictureGroup", "TableGroup",
    "Document", "Page", "Line", "Span",
)
READABLE_SKIP_BLOCKS = (
    "Picture", "Figure", "FigureGroup", "PictureGroup", "Document", "Page", "Line", "Span",
)
VIEWER_SKIP_BLOCKS = (
    "Picture", "Figure", "Image", "FigureGroup", "PictureGroup", "Document", "Page", "Line", "Span",
)
VIEWER_SKIP_RESPONSE_BLOCKS = ("image", "figure")
READABLE_TABLE_BLOCKS = ("Table", "Form", "TableGroup")
TABLE_BLOCKS = ("Table", "Form")
USE_CASES = (
    ("UC01", "scan", "vi"), ("UC02", "scan", "en"), ("UC03", "scan", "ja"),
    ("UC04", "table", "vi"), ("UC05", "table", "en"), ("UC06", "table", "ja"),
    ("UC07", "text_layer", "vi"), ("UC08", "text_layer", "en"), ("UC09", "text_layer", "ja"),
)
LANG_LABELS = (
    ("vi", "Tiếng Việt"), ("en", "English"), ("ja", "日本語"), ("ko", "한국어"), ("zh", "中文"),
)

# --- fixed values: metrics ---------------------------------------------------
PUNCTUATION_MARKS = (",", ".", "?", "!", ";", ":")
# The capital comes first: a search steps over other characters quickly.
CAPITAL_WORD = r"\p{Lu}(?<!\S\p{Lu})"
UPLOAD_METRICS = (
    "cer", "wer", "char_f1", "word_f1", "normalized_edit_similarity",
    "table_teds_doc", "table_cell_exact_f1_mean",
)
BATCH_METRICS = (
    "cer", "wer", "normalized_edit_similarity", "char_f1", "word_f1",
    "table_teds_doc", "table_teds_matched_mean",
    "table_cell_exact_f1_mean", "table_cell_text_similarity_mean",
    "table_row_count_similarity_mean", "table_col_count_similarity_mean",
    "table_count_f1",
)
HIGHEST_IS_WORST = ("cer", "wer")
IOU_THRESHOLD = 0.5
AREA_RATIO = 1.8

# --- fixed values: file names --------------------------------------------------
SLUG_LETTERS = (
    ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L"), ("ø", "o"), ("Ø", "O"), ("ß", "ss"),
    ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "TH"),
    ("ð", "d"), ("Ð", "D"),
)
DOCUMENT_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".png", ".jpg", ".jpeg", ".webp",
)
ASSET_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".webp")
