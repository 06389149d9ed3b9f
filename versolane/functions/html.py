"""HTML to plain text in built-in functions: one regex pass cuts dropped elements and comments, one cuts tags."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws

#: Elements whose content is never translated.
SKIP = ("script", "style", "code", "pre", "svg", "math", "img", "video", "audio", "source", "link", "meta", "noscript", "object", "embed", "iframe", "canvas", "map", "area")
#: Elements that may stand inside a translated block.
INLINE = ("a", "abbr", "b", "bdi", "bdo", "br", "cite", "data", "dfn", "em", "i", "kbd", "mark", "q", "rb", "rp", "rt", "rtc", "ruby", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr", "del", "ins")
#: Elements that are translated as one unit.
BLOCK = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "blockquote", "figcaption", "caption", "summary", "label", "legend", "title", "div", "section", "article", "aside", "header", "footer", "main", "details")
#: Elements dropped from language samples.
SAMPLE_SKIP = ("script", "style", "meta", "link")
#: Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: What a reference to a character may be: a decimal or hexadecimal number, or a name.
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"

TAG = "</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
MARK = "\u0001"


def dropped_pattern(skip: tuple[str, ...]) -> str:
    """Comments, declarations and the elements in `skip` with all they hold, leftmost first; an element that never ends reaches to the end."""
    holds = [t for t in skip if t not in VOID]
    return "|".join(["(?is)<!--.*?-->", "<![a-z][^>]*>", "<\\?[^>]*>", *(f"<{t}\\b[^>]*>.*?(?:</{t}\\s*>|\\z)" for t in holds)])


def _characters(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def unescape(text: Column) -> Column:
    """Character references decoded once: numbers, and the names of HTML 4. Numbers from 128 to 159 are read as Windows-1252, as browsers do; what is no character becomes U+FFFD."""
    names = _characters([*((k, chr(v)) for k, v in name2codepoint.items()), ("apos", "'")])
    odd = _characters((c, bytes([c]).decode("cp1252", "replace")) for c in range(128, 160))

    def read(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        digits = F.substring(name, 2, 8)
        code = F.when(F.lower(F.left(digits, F.lit(1))) == "x", F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).cast("int")
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        number = F.when(bad, "\ufffd").when(code.between(128, 159), F.try_element_at(odd, code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.when(F.left(name, F.lit(1)) == "#", number).when(name != "", F.try_element_at(names, name))
        return F.coalesce(F.concat(char, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece))

    def pieces_of(p: Column) -> Column:
        return F.concat(F.element_at(p, 1), F.array_join(F.transform(F.slice(p, 2, F.size(p)), read), ""))

    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.element_at(F.transform(F.array(F.split(text, "&")), pieces_of), 1))


def pieces(html: Column, skip: tuple[str, ...]) -> Column:
    """The text nodes outside `skip`, decoded and trimmed, without empty ones."""
    bare = F.regexp_replace(F.regexp_replace(html, dropped_pattern(skip), MARK), TAG, MARK)
    return F.filter(F.transform(F.split(bare, MARK), lambda x: trim_ws(unescape(x))), lambda x: x != "")


def plain_text(html: Column, skip: tuple[str, ...] = SKIP) -> Column:
    """Text nodes joined by one space. Null html: null."""
    return F.array_join(pieces(html, skip), " ")


HEADING = "(?is)<h[123]\\b[^>]*>(.*?)</h[123]\\s*>"


def heading(html: Column, otherwise: Column) -> Column:
    """The first h1, h2 or h3, its pieces joined without anything between, first 80 characters; `otherwise` if there is none or it is empty."""
    shown = F.regexp_replace(html, dropped_pattern(("script", "style")), MARK)
    name = F.array_join(pieces(F.regexp_extract(shown, HEADING, 1), ()), "")
    return F.coalesce(F.nullif(F.left(name, F.lit(80)), F.lit("")), otherwise)
