"""HTML as column expressions.

Tags and attributes are found by regular expressions that run inside the JVM, so facts about a page need
no Python. A missing attribute is null, an empty one is ``''``: some rules tell them apart.

Character references can be decoded in two places. ``unescaped`` decodes a single extracted string; what
extracts a value takes it as the default. Where many values of one page are read, ``settled`` decodes the page's markup once:
characters that would change its structure (angle brackets, quotes, white space) stand as noncharacters
until a value is ``restored``. The table of names is then in a plan once, not once a value.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelumen.functions.reuse import once_a_session

Decode = Callable[[Column], Column]

# Characters with a meaning in markup, and the noncharacters that stand for them (the last one for a literal ampersand).
SPECIAL = "<>\"'/ \t\n\f\r\x0b&"
HELD = "".join(chr(0xFDD0 + i) for i in range(len(SPECIAL)))
#: Names that count without a semicolon too, longest first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_SEPARATOR = "\x01"


def _by_reference() -> dict[str, str]:
    """Character by reference: the names of HTML 4 with ``apos``, and the numbers 128 to 159, which mean Windows-1252."""
    named = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
    numbered = {f"#{code}": bytes([code]).decode("cp1252", "ignore") for code in range(128, 160)}
    return named | {name: char for name, char in numbered.items() if char}


def _literal_map(entries: dict[str, str]) -> Column:
    """The entries as one map that is folded to a constant."""
    keys, values = _SEPARATOR.join(entries), _SEPARATOR.join(entries.values())
    return F.map_from_arrays(F.split(F.lit(keys), _SEPARATOR), F.split(F.lit(values), _SEPARATOR))


def decoded(text: Column) -> Column:
    """References of XML and HTML 4 decoded, named and numeric; each once, so ``&amp;lt;`` becomes ``&lt;``.

    Unknown names, and references without a semicolon, stay as written; numbers of no character become U+FFFD.
    """
    known = _literal_map(_by_reference())

    def resolved(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", 1)
        code = _code(name)
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.coalesce(F.try_element_at(known, F.concat(F.lit("#"), code.cast("string"))), F.when(valid, _character(code)).otherwise(F.lit("\ufffd")))
        char = F.when(name == "", F.lit(None)).when(name.startswith("#"), number).otherwise(F.try_element_at(known, name))
        return F.when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substr(part, F.length(name) + 2)))

    return _each_reference(text, resolved)


def _each_reference(text: Column, resolved: Decode) -> Column:
    """What follows each ampersand resolved; a text without one is left alone."""
    whole = F.array_join(F.transform(F.split(text, "&"), lambda part, i: F.when(i == 0, part).otherwise(resolved(part))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def _code(name: Column) -> Column:
    """The number of a reference like ``#38`` or ``#x26``; -1 beyond the last character."""
    digits = F.regexp_replace(name, "^#[xX]?0*", "")
    # More than seven digits are beyond the last character, 10FFFF.
    return F.when(F.length(digits) > 7, F.lit(-1)).when(digits == "", F.lit(0)).when(name.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("int")).otherwise(digits.try_cast("int"))


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _number_of(name: str) -> int:
    """63 bits of a name's checksums, forward and backward; no two names of HTML 5 share them."""
    return zlib.crc32(name.encode()) << 31 ^ zlib.crc32(name[::-1].encode())


def _number(name: Column) -> Column:
    """The same as an expression."""
    return F.shiftleft(F.crc32(name.cast("binary")), 31).bitwiseXOR(F.crc32(F.reverse(name).cast("binary")))


def _unescaped(text: Column, held: bool, closed: bool = False) -> Column:
    """HTML 5 references decoded: all its names, the longest that fits; some also without a semicolon.

    ``held``: characters with a meaning in markup come out as their noncharacters. ``closed``: what has no semicolon stays as written.
    """

    def out(char: str) -> str:
        return "".join(HELD[SPECIAL.index(c)] if held and c in SPECIAL[:-1] else c for c in char)

    common = {f"{n};": html5[f"{n};"] for n in name2codepoint}  # looked up in order: these first
    # By number instead of by name: numbers are compared faster, and two thousand names would fill plans.
    numbers = {_number_of(n): out(c) for n, c in (common | html5).items()}
    names = F.map_from_arrays(F.split(F.lit(_SEPARATOR.join(map(str, numbers))), _SEPARATOR).cast("array<bigint>"), F.split(F.lit(_SEPARATOR.join(numbers.values())), _SEPARATOR))
    bare = _literal_map({n: out(html5[n]) for n in _BARE})
    windows = _literal_map({str(code): bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(128, 160)})

    def resolved(part: Column) -> Column:
        number = F.regexp_extract(part, r"^(#[0-9]+|#[xX][0-9a-fA-F]+)" + ("(?=;)" if closed else ""), 1)
        code = _code(number)
        nothing = code.between(1, 8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        wrong = (code < 1) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        char = F.when(wrong, F.lit("\ufffd")).when(code.between(128, 159), F.try_element_at(windows, code.cast("string"))).when(nothing, F.lit("")).otherwise(_character(code))
        if held:
            char = F.translate(char, SPECIAL[:-1], HELD[:-1])
        name = F.regexp_extract(part, "^([^\t\n\f <&#;]{1,32};" + ("" if closed else "?") + ")", 1)
        short = F.regexp_extract(part, f"^({'|'.join(_BARE)})", 1)
        named = F.coalesce(  # a part that is null makes its whole null
            F.concat(F.try_element_at(names, _number(name)), F.substr(part, F.length(name) + 1)),
            *([] if closed else [F.concat(F.try_element_at(bare, F.nullif(short, F.lit(""))), F.substr(part, F.length(short) + 1))]),
            F.concat(F.lit("&"), part),
        )
        return F.when(number != "", F.concat(char, F.regexp_replace(F.substr(part, F.length(number) + 1), "^;", ""))).otherwise(named)

    return _each_reference(text, resolved)


def unescaped(text: Column) -> Column:
    """A piece of text with its HTML 5 references decoded."""
    return _unescaped(text, held=False)


def unescaped_closed(text: Column) -> Column:
    """The same of references that end in a semicolon only; others stay as written."""
    return _unescaped(text, held=False, closed=True)


#: A snapshot's optional column: true where only references that end in a semicolon count, as in XML.
CLOSED = "closed_references"


def unescaping(pages: DataFrame) -> Decode:
    """How pages' references are decoded: as HTML 5 has them, but for those that are marked as closed."""
    if CLOSED not in pages.columns:
        return unescaped
    return lambda text: F.when(F.col(CLOSED), unescaped_closed(text)).otherwise(unescaped(text))


def _settling() -> list[Decode]:
    """The steps of settling: own noncharacters go, ampersands that are no references are held, references are decoded."""
    within = rf"&(?=(?:{'|'.join(_BARE)})[=A-Za-z0-9])(?![A-Za-z0-9]+;)(?=[^<>]*>)"
    return [
        lambda m: F.when(m.rlike(f"[{HELD}]"), F.translate(m, HELD, "\ufffd" * len(HELD))).otherwise(m),
        lambda m: F.when(m.contains("&"), F.regexp_replace(m, within, HELD[-1])).otherwise(m),
        lambda m: _unescaped(m, held=True),
    ]


def settled(markup: Column) -> Column:
    """Markup with its references decoded once; values read from it are to be ``restored``.

    Within a tag, a name without a semicolon before a letter, digit or ``=`` is no reference (``?a=1&copy=2``).
    """
    for step in _settling():
        markup = step(markup)
    return markup


def with_settled(df: DataFrame, source: str, name: str) -> DataFrame:
    """Adds a column of markup, settled; step by step, as each reads its input several times."""
    df = df.withColumn(name, F.col(source))
    for i in range(len(_settling())):
        df = df.withColumn(name, _settling_of(name, i, CLOSED in df.columns))
    return df


@once_a_session
def _settling_of(name: str, step: int, marked: bool) -> Column:
    markup = F.col(name)
    settling = _settling()[step](markup)
    if not marked or step == 0:
        return settling
    # Where references are closed, none needs holding.
    return F.when(F.col(CLOSED), markup if step == 1 else _unescaped(markup, held=True, closed=True)).otherwise(settling)


def restored(text: Column) -> Column:
    """A value from settled markup as it reads."""
    return F.translate(text, HELD, SPECIAL)


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def without_code(html: Column) -> Column:
    """Markup without comments, scripts and styles: what words are read from."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")


def visible_text(markup: Column, decode: Decode = unescaped) -> Column:
    """Text of markup: tags become spaces, references are decoded, white space becomes single spaces."""
    text = decode(F.regexp_replace(markup, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def body_markup(html: Column) -> Column:
    """From the body tag on; null without one."""
    part = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)", 1)
    return F.when(html.rlike(r"(?i)<body\b"), part)


def word_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def tags(html: Column, name: str) -> Column:
    """All opening tags of a name (or of alternatives like ``a|button``), as strings."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{name})\b[^>]*>"), F.lit(0))


def tag_names(html: Column, names: list[str]) -> Column:
    """The names of all opening tags of the given names, lower case, in one pass."""
    return F.regexp_extract_all(F.lower(html), F.lit(rf"<({'|'.join(names)})[\s>/]"), F.lit(1))


def count_of(found: Column, name: str) -> Column:
    """How often the name is in an array without nulls."""
    return F.size(found) - F.size(F.array_remove(found, name))


def attribute(tag: Column, name: str, decode: Decode = unescaped) -> Column:
    """An attribute's decoded value; ``''`` if it is there without one; null if it is missing."""
    quoted = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    bare = F.regexp_replace(quoted, r"(?s)^[\"'](.*)[\"']$", "$1")
    return F.when(quoted != "", decode(bare)).when(has_attribute(tag, name), F.lit(""))


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)[\s\"'/]{name}(?:\s|=|/|>)")


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def element_text(html: Column, name: str, decode: Decode = unescaped) -> Column:
    """Text of the first element of a name; null if there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    return F.when(html.rlike(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>"), visible_text(inner, decode))


def metas(html: Column, decode: Decode = unescaped) -> Column:
    """array<struct<name, property, http_equiv, content>> of the meta tags."""
    return F.transform(
        tags(html, "meta"),
        lambda t: F.struct(
            attribute(t, "name", decode).alias("name"),
            attribute(t, "property", decode).alias("property"),
            attribute(t, "http-equiv", decode).alias("http_equiv"),
            attribute(t, "content", decode).alias("content"),
        ),
    )


def meta_content(found: Column, name: str) -> Column:
    """Content of the first meta of a name (exact); ``''`` if it has none, null if there is no such meta."""
    named = F.filter(found, lambda m: m["name"] == name)
    return F.when(F.size(named) > 0, F.coalesce(first(named)["content"], F.lit("")))


def rel_links(html: Column, decode: Decode = unescaped) -> Column:
    """array<struct<rel, href, media>> of the link tags; rel is an array of lower-case tokens."""
    return F.transform(
        tags(html, "link"),
        lambda t: F.struct(
            F.split(F.lower(F.trim(F.coalesce(attribute(t, "rel", decode), F.lit("")))), r"\s+").alias("rel"),
            attribute(t, "href", decode).alias("href"),
            attribute(t, "media", decode).alias("media"),
        ),
    )


def scripts(html: Column) -> Column:
    """array<struct<src, type, inline, async, defer>> of the script elements of markup that is not settled: code has no references."""
    elements = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>.*?</script\s*>"), F.lit(0))
    inline = lambda e: F.regexp_extract(e, r"(?is)^<script\b[^>]*>(.*)</script\s*>$", 1)
    pairs = F.transform(elements, lambda e: F.struct(settled(F.regexp_extract(e, r"(?is)^(<script\b[^>]*>)", 1)).alias("tag"), inline(e).alias("inline")))

    def facts(e: Column) -> Column:
        return F.struct(
            attribute(e["tag"], "src", restored).alias("src"),
            F.lower(attribute(e["tag"], "type", restored)).alias("type"),
            e["inline"].alias("inline"),
            has_attribute(e["tag"], "async").alias("async"),
            has_attribute(e["tag"], "defer").alias("defer"),
        )

    return F.transform(pairs, facts)


def anchors(html: Column, decode: Decode = unescaped) -> Column:
    """array<struct<href, rel>> of the a tags; href is null where it is missing."""
    return F.transform(
        tags(html, "a"),
        lambda t: F.struct(attribute(t, "href", decode).alias("href"), F.split(F.lower(F.coalesce(attribute(t, "rel", decode), F.lit(""))), r"\s+").alias("rel")),
    )


def images(html: Column, decode: Decode = unescaped) -> Column:
    """array<struct<src, alt, width, height, loading>>; src falls back to data-src."""
    return F.transform(
        tags(html, "img"),
        lambda t: F.struct(
            F.coalesce(F.nullif(attribute(t, "src", decode), F.lit("")), attribute(t, "data-src", decode), F.lit("")).alias("src"),
            attribute(t, "alt", decode).alias("alt"),
            attribute(t, "width", decode).alias("width"),
            attribute(t, "height", decode).alias("height"),
            attribute(t, "loading", decode).alias("loading"),
        ),
    )


def headings(html: Column, decode: Decode = unescaped) -> Column:
    """array<struct<level, text>> in document order."""
    elements = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>"), F.lit(0))
    return F.transform(
        elements,
        lambda e: F.struct(F.regexp_extract(e, r"(?i)^<h([1-6])", 1).cast("int").alias("level"), visible_text(e, decode).alias("text")),
    )


def jsonld_bodies(html: Column) -> Column:
    """Bodies of the JSON-LD scripts."""
    return F.transform(F.filter(scripts(html), lambda s: s["type"] == "application/ld+json"), lambda s: F.trim(s["inline"]))
