"""Text normalizers and text extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.functions import arrow, patterns as P
from pagegauge.functions.exprs import collapse, let, lines, plain_space, single_spaces, strip, sub, where_present


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _has_entity(text: Column) -> Column:
    return F.contains(text, F.lit("&")) & text.rlike(P.ENTITY)


# --- Unicode and entities ------------------------------------------------------

def compose(text: Column) -> Column:
    """Entities decoded and NFC; Python sees only rows that may change."""
    text = _text(text)
    needed = _has_entity(text) | text.rlike(P.MAYBE_NOT_COMPOSED)
    return F.when(needed, arrow.clean_unicode(F.when(needed, text))).otherwise(text)


def unescape(text: Column) -> Column:
    text = _text(text)
    needed = _has_entity(text)
    return F.when(needed, arrow.unescape_html(F.when(needed, text))).otherwise(text)


def unescape_basic(text: Column) -> Column:
    """The common entities, JVM-side; usable inside array functions."""
    def decode(t: Column) -> Column:
        for entity, char in (
            ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
        ):
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decode(t)).otherwise(t))


def strip_invisible(text: Column) -> Column:
    """Spaces unified, zero-width characters out, line ends to ``\\n``."""
    cleaned = where_present(
        text, P.LOW_SPACES, lambda t: plain_space(F.translate(t, P.INVISIBLE, "")), high=True)
    return where_present(cleaned, "\r", lambda t: F.regexp_replace(t, r"\r\n?", "\n"))


def unify_spaces(text: Column) -> Column:
    return where_present(text, P.LOW_SPACES, plain_space, high=True)


# --- steps of the full normalizer -------------------------------------------------

def unwrap_links(text: Column) -> Column:
    return where_present(text, "<", lambda t: sub(t, (P.BRACKETED_URL, "$1"), (P.BRACKETED_EMAIL, "$1")))


def drop_images(text: Column) -> Column:
    return where_present(text, "<!", lambda t: sub(t, (P.IMG_TAG, " "), (P.MD_IMAGE_AND_LINE, " ")))


def drop_html(text: Column) -> Column:
    return where_present(text, "<", lambda t: sub(
        t, (P.HTML_BREAK, " "), (P.HTML_BLOCK_CLOSE, " "), (P.HTML_BLOCK_OPEN, " "),
        (P.HTML_INLINE, ""), (P.ANY_TAG, " "),
    ))


def drop_markdown_blocks(text: Column) -> Column:
    def fences(t: Column) -> Column:
        return F.replace(F.regexp_replace(t, P.FENCE_OPEN, " "), F.lit(P.FENCE), F.lit(" "))

    text = where_present(text, "[", lambda t: F.regexp_replace(t, P.MD_LINK, "$1"))
    text = where_present(text, "`", fences)
    return where_present(text, "#>-+*_", lambda t: sub(
        t, (P.HEADING, ""), (P.QUOTE, ""), (P.BULLET, ""), (P.HEADING, ""),
        (P.LONE_HASHES, " "), (P.LONE_MARKERS, " "),
    ))


def _flat_row(line: Column) -> Column:
    """One table line as plain text; NULL when nothing readable remains."""
    cells = F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1)
    cells = F.filter(F.transform(cells, strip), lambda c: c != "")
    cells = F.transform(cells, lambda c: F.regexp_replace(c, P.HTML_BREAK, " "))
    cells = F.filter(cells, lambda c: ~c.rlike(P.CELL_RULE))
    return F.when(F.size(cells) > 0, F.array_join(cells, " "))


def flatten_pipe_tables(text: Column) -> Column:
    """Non-blank lines, with pipe tables reduced to their cell text."""
    def line_text(line: Column) -> Column:
        return (
            F.when(line.rlike(P.TABLE_RULE), None)
            .when(F.contains(line, F.lit("|")), _flat_row(line))
            .otherwise(line)
        )
    kept = F.filter(F.transform(lines(_text(text)), strip), lambda x: x != "")
    kept = F.transform(kept, lambda x: F.regexp_replace(x, P.LIST_BEFORE_PIPE, ""))
    return F.array_join(F.filter(F.transform(kept, line_text), lambda x: x.isNotNull()), "\n")


def drop_emphasis(text: Column) -> Column:
    return where_present(text, "*_`#", lambda t: sub(
        t, (P.STRONG, "$2"), (P.EM_STAR, "$1"), (P.EM_UNDERSCORE, "$1"), (P.INLINE_CODE, "$1"),
        (P.LEFTOVER_MARKERS, " "), (P.LONE_HASHES, " "),
    ))


def unify_symbols(text: Column) -> Column:
    return where_present(text, P.LOW_SYMBOLS, lambda t: F.translate(
        sub(t, (P.DASHES, "-"), (P.SLASHES, "/"), (P.DOT_OPERATORS, " ")),
        P.TIMES_SIGN + P.CYRILLIC_HA, "xx"), high=True)


def drop_glyphs(text: Column) -> Column:
    return where_present(text, P.LOW_SYMBOLS, lambda t: F.regexp_replace(t, P.BULLET_GLYPHS, ""), high=True)


def space_punctuation(text: Column, ignore_soft_punctuation: bool = True) -> Column:
    """Every step runs only where the mark it is about occurs."""
    text = where_present(text, ",", lambda t: sub(t, (P.COMMA_IN_NUMBER, ",")))
    text = where_present(text, ".", lambda t: sub(t, (P.POINT_IN_NUMBER, ".")))
    text = where_present(text, "%", lambda t: sub(t, (P.SPACE_PERCENT, "%")))
    if ignore_soft_punctuation:
        text = where_present(text, ":;", lambda t: sub(t, (P.SOFT_PUNCTUATION, " ")))
    else:
        text = where_present(text, ":;", lambda t: sub(
            t, (P.SEMICOLON, " ; "), (P.COLON, ": "), (P.COLON_IN_NUMBER, ":")))
    text = where_present(text, ",", lambda t: sub(t, (P.COMMA, ", ")))
    text = sub(text, (P.SPACE_BEFORE_PUNCTUATION, "$1"))
    text = where_present(text, "(", lambda t: sub(t, (P.SPACE_AFTER_OPEN, "(")))
    return where_present(text, ")", lambda t: sub(t, (P.SPACE_BEFORE_CLOSE, ")")))


def _where(text: Column, part: str, found: Column) -> Column:
    """``found`` in texts that hold ``part``, an empty list elsewhere."""
    return F.when(F.contains(text, F.lit(part)), found).otherwise(F.array().cast("array<string>"))


def _mark(text: Column, pattern: str, first: Column) -> Column:
    """Replace matches by numbered placeholders, counting from ``first``."""
    pieces = F.split(text, pattern, -1)
    return F.array_join(F.transform(pieces, lambda piece, k: F.when(k == 0, piece).otherwise(
        F.concat(F.lit(f" {P.PLACEHOLDER}"), (first + k - 1).cast("string"), F.lit(" "), piece)
    )), "")


def _restore(text: Column, originals: Column) -> Column:
    def put_back(piece: Column, k: Column) -> Column:
        number = F.regexp_extract(piece, "^[0-9]+", 0)
        original = F.get(originals, number.try_cast("int"))
        return F.when(k == 0, piece).otherwise(F.concat(
            F.coalesce(original, F.concat(F.lit(P.PLACEHOLDER), number)),
            F.substring(piece, F.length(number) + 1, F.length(piece)),
        ))
    return F.array_join(F.transform(F.split(text, P.PLACEHOLDER, -1), put_back), "")


def normalize_text(
    text: Column, lowercase: bool = False, ignore_soft_punctuation: bool = True
) -> Column:
    """Readable text of a Markdown/HTML page, for character and word metrics.

    Plain prose, told by one pattern, only has its white space settled: the steps would look for their marks in vain.
    """
    def outer(t: Column) -> Column:
        urls = F.regexp_extract_all(t, F.lit(P.URL), F.lit(0))
        return let(F.struct(t.alias("text"), _where(t, "http", urls).alias("urls")), marked)

    def marked(state: Column) -> Column:
        t, urls = state["text"], state["urls"]
        t = drop_html(drop_images(F.when(F.size(urls) > 0, _mark(t, P.URL, F.lit(0))).otherwise(t)))
        t = where_present(t, "\\", lambda x: F.regexp_replace(x, P.MD_ESCAPE, "$1"))
        return let(F.struct(t.alias("text"), urls.alias("urls")), inner)

    def inner(state: Column) -> Column:
        t, urls = state["text"], state["urls"]
        stars = _where(t, "*", F.regexp_extract_all(t, F.lit(P.STAR_GROUP), F.lit(0)))
        plain = where_present(t, "*", lambda x: _mark(x, P.STAR_GROUP, F.size(urls)))
        plain = drop_markdown_blocks(plain)
        # Without pipes only line ends would change, and whitespace collapses later.
        plain = where_present(plain, "|\x0b", flatten_pipe_tables)
        plain = unify_symbols(drop_glyphs(drop_emphasis(plain)))
        plain = space_punctuation(plain, ignore_soft_punctuation)
        # The originals are part of the bound value: as an expression they would be found again for every piece.
        return let(F.struct(plain.alias("text"), F.concat(urls, stars).alias("originals")), lambda x: F.when(
            F.contains(x["text"], F.lit(P.PLACEHOLDER)), _restore(x["text"], x["originals"])).otherwise(x["text"]))

    def full(t: Column) -> Column:
        # No line end but \n is left, so blanks are all that can surround the text.
        return F.regexp_replace(F.trim(single_spaces(let(unwrap_links(strip_invisible(t)), outer))), P.DOT_RUN, " ")

    def plain(t: Column) -> Column:
        blanks = F.regexp_replace(t, "[\n\t]", " ")
        spaced = where_present(blanks, ",", lambda x: F.regexp_replace(x, P.TIGHT_COMMA, ", "))
        return F.trim(where_present(spaced, ["  "], lambda x: F.regexp_replace(x, " {2,}+", " ")))

    result = let(compose(text), lambda t: F.when(t.rlike(P.PLAIN_TEXT), plain(t)).otherwise(full(t)))
    return F.lower(result) if lowercase else result


# --- other normalizers ----------------------------------------------------------

def normalize_space(text: Column) -> Column:
    return collapse(unify_spaces(unescape(text)))


def _cell_marks(text: Column) -> Column:
    text = where_present(text, "<", lambda t: F.regexp_replace(t, P.ANY_TAG, " "))
    text = where_present(text, "*_`\\", lambda t: sub(t, (P.CELL_EMPHASIS, ""), (P.CELL_ESCAPED_PIPE, "$1")))
    return where_present(
        text, P.CELL_TO_UPPER_X + P.CYRILLIC_HA,
        lambda t: F.translate(t, P.CELL_TO_UPPER_X + P.CYRILLIC_HA, "XXXXx"))


def normalize_cell(text: Column) -> Column:
    """Light cell normalizer: markup out, look-alike symbols unified."""
    return normalize_space(_cell_marks(unescape(text)))


def normalize_cell_basic(text: Column) -> Column:
    """:func:`normalize_cell` with the common entities only; usable inside array functions."""
    return collapse(unescape_basic(_cell_marks(unescape_basic(text))))


def normalize_cell_markdown(text: Column) -> Column:
    """Cell normalizer that keeps inline Markdown and turns HTML emphasis into it."""
    return normalize_space(sub(
        unescape(text),
        (P.BRACKETED_WEB, "$1"), (P.BRACKETED_EMAIL, "$1"),
        (P.HTML_ITALIC, "*$2*"), (P.HTML_BOLD, "**$2**"), (P.HTML_CODE, "`$1`"),
        (P.ANY_TAG, " "), (P.MD_BOLD_UNDERSCORE, "**$1**"), (P.MD_ITALIC_UNDERSCORE, "*$1*"),
        (P.CELL_ESCAPED_PIPE, "$1"), (P.RULE_BETWEEN_PIPES, "---"), (P.MD_IMAGE, ""),
    ))


def normalize_latex(text: Column) -> Column:
    return sub(strip(unescape(text)), (P.LATEX_SIZING, ""), (r"\s+", ""))


def fold_words(text: Column) -> Column:
    """Lower case, punctuation out, whitespace collapsed (input already normalized)."""
    # What is no word character and no ASCII white space goes, so blanks are all that can surround the text.
    return F.trim(single_spaces(F.regexp_replace(F.lower(text), P.NOT_WORD_NOT_WS, "")))


def normalize_folded(text: Column) -> Column:
    return fold_words(normalize_text(text))


def markdown_to_plain(text: Column) -> Column:
    return normalize_space(sub(
        _text(text), (P.PLAIN_IMAGE, "$1"), (P.PLAIN_LINK, "$1"), (P.ANY_TAG, " "),
        (P.PLAIN_MARKERS, " "),
    ))


# --- tokens -------------------------------------------------------------------

def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.TOKEN), F.lit(0))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def sentences(markdown: Column) -> Column:
    """Reading-order blocks: sentences of the cell-Markdown text."""
    parts = F.split(normalize_cell_markdown(markdown), P.SENTENCE_GAP, -1)
    return F.filter(parts, lambda s: s != "")


# --- page content ----------------------------------------------------------------

def html_table_text(html: Column) -> Column:
    """Cell text of an HTML table on one line."""
    found = F.regexp_extract_all(html, F.lit(P.CELL_CONTENT), F.lit(1))
    cells = F.transform(found, lambda c: strip(F.regexp_replace(c, P.ANY_TAG, " ")))
    return F.array_join(F.filter(cells, lambda c: c != ""), " ")


def pipe_table_text(markdown: Column) -> Column:
    """Cell text of a pipe table, one line per row, rule rows skipped."""
    rows = F.filter(F.transform(lines(markdown), strip), lambda x: x.startswith("|"))
    rows = F.filter(rows, lambda x: F.translate(x, "|-: ", "") != "")
    texts = F.transform(rows, lambda x: F.array_join(F.filter(F.transform(
        F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|", -1), strip), lambda c: c != ""), " "))
    return F.array_join(F.filter(texts, lambda x: x != ""), "\n")


def replace_matches(text: Column, pattern: str, render) -> Column:
    """Replace every match by ``render(match)`` between line breaks."""
    def weave(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return let(found, lambda matches: F.array_join(F.transform(
            F.split(t, pattern, -1), lambda piece, k: F.when(k == 0, piece).otherwise(F.concat(
                F.lit("\n"), render(F.get(matches, k - 1)), F.lit("\n"), piece))), ""))
    return let(text, weave)


def filter_content(markdown: Column, live: bool = True) -> Column:
    """Page Markdown without figures, images and code; tables as plain cell text.

    The batch variant (``live=False``) keeps captions, image wrappers and pipe tables.
    """
    text = sub(_text(markdown), (P.FIGURE, ""))
    if live:
        text = sub(text, (P.FIGCAPTION, ""), (P.DIV_IMAGE, ""))
    text = sub(text, (P.MD_IMAGE_AND_CAPTION, ""), (P.FENCED_BLOCK, ""))
    if live:
        text = replace_matches(text, P.PIPE_TABLE, pipe_table_text)
    return replace_matches(text, P.HTML_TABLE, html_table_text)


def html_tables(markdown: Column) -> Column:
    """Inline HTML tables in order, numbered from 1."""
    found = F.regexp_extract_all(_text(markdown), F.lit(P.HTML_TABLE), F.lit(0))
    return F.transform(found, lambda html, k: F.struct(
        (k + 1).alias("table_id"), html.alias("html")))


def scoring_text(full_text: Column, tables: Column) -> Column:
    """Prose plus table cell text; cells are preferred over the HTML."""
    def table_text(t: Column) -> Column:
        filled = F.filter(F.transform(t["cells"], lambda c: c["text"]), lambda x: strip(x) != "")
        return F.when(F.size(t["cells"]) > 0, F.array_join(filled, " ")).otherwise(
            html_table_text(_text(t["html"])))
    parts = F.concat(F.array(_text(full_text)), F.coalesce(
        F.transform(tables, table_text), F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def block_text(markdown: Column, html: Column, lines_of_spans: Column) -> Column:
    """Text of a layout block: Markdown, else HTML, else its lines and spans."""
    from_markdown = collapse(F.regexp_replace(unify_spaces(_text(markdown)), P.LAZY_MD_IMAGE, ""))
    from_html = sub(unify_spaces(_text(html)), (P.IMG_TAG, ""), (P.IMAGE_DESCRIPTION, ""), (P.ANY_TAG, " "))
    for entity, char in (
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'),
    ):
        from_html = F.replace(from_html, F.lit(entity), F.lit(char))
    from_html = collapse(F.regexp_replace(from_html, P.IMAGE_LABEL, ""))
    spans = F.flatten(F.transform(lines_of_spans, lambda l: F.coalesce(
        F.transform(l["spans"], lambda s: F.coalesce(s["text"], F.lit(""))),
        F.array().cast("array<string>"))))
    return F.coalesce(
        F.nullif(from_markdown, F.lit("")), F.nullif(from_html, F.lit("")),
        F.nullif(strip(F.array_join(spans, " ")), F.lit("")), F.lit(""),
    )


def readable_block(block_type: Column, html: Column) -> Column:
    """Block HTML for the Markdown preview: tables stay HTML, other tags go."""
    plain = sub(
        html, (r"(?i)<br\s*/?>", "\n"), (P.IMAGE_DESCRIPTION, ""), (P.IMG_TAG, ""), (P.ANY_TAG, ""))
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    plain = strip(sub(plain, (P.IMAGE_LABEL, ""), (r"\n{3,}", "\n\n")))
    return F.when(block_type.isin(*P.READABLE_TABLE_BLOCKS), strip(html)).otherwise(plain)


def response_page_text(header: Column, markdown: Column, footer: Column) -> Column:
    """Header, body and footer of an OCR page response without tables and images."""
    parts = F.array(strip(_text(header)), strip(_text(markdown)), strip(_text(footer)))
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    return strip(sub(
        joined, (P.ANY_TABLE, "\n"), (P.HTML_PLACEHOLDER_LINK, ""), (P.MD_IMAGE, ""),
        (P.IMG_TAG, ""), (P.HEADING_MARKS, ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def block_preview(html: Column) -> Column:
    return F.substring(collapse(sub(_text(html), (P.IMG_TAG, ""), (P.ANY_TAG, " "))), 1, 120)


__all__ = [name for name in dir() if not name.startswith("_")]
