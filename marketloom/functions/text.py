"""Text, date, link and markup expressions for policy documents. All run inside the JVM unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode text processing defines it, and the punctuation kept by cleaning.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
KEPT = r"一-龥0-9A-Za-z ，。！？；：\"（）《》【】、\-—_"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same whitespace as characters.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c) -> Column:
    """Both ends without any Unicode whitespace."""
    return F.btrim(_col(c), F.lit(SPACES))


def clean_text(c) -> Column:
    """One space per whitespace run, no tags, only CJK, ASCII letters and digits and listed punctuation, trimmed."""
    c = F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"[{SPACE}]+", " ")
    c = F.regexp_replace(c, "<[^>]+>", "")
    return F.trim(F.regexp_replace(c, f"[^{KEPT}]", ""))


def content_hash(c) -> Column:
    return F.when(F.length(_col(c)) > 0, F.md5(_col(c)))


def short_id(c) -> Column:
    return F.substring(content_hash(c), 1, 16)


# Date forms in order of priority.
DATE_FORMS = (r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})/(\d{1,2})/(\d{1,2})")


def _date(year: Column, month: Column, day: Column) -> Column:
    """Date of three texts, null when it does not exist."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(F.length(year) > 0, F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def _match(c: Column, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(c, pattern, i) for i in (1, 2, 3))


def extract_date(c) -> Column:
    """First match of the first form that occurs; a form that occurs with an impossible date gives null."""
    c = _col(c)
    out = None
    for form in DATE_FORMS:
        found = c.rlike(form)
        value = _date(*_match(c, form))
        out = F.when(found, value) if out is None else out.when(found, value)
    return out


def publish_date(script, content, url, title, default_year: int = 2022) -> Column:
    """Publish date by falling back: script variable, last full date of the content, month and day with a year from
    the address or content, year and month of the address, date or year of the title."""
    script, content, url, title = map(_col, (script, content, url, title))
    in_script = F.coalesce(*[
        extract_date(F.regexp_extract(script, rf'var\s+{name}\s*=\s*"([^"]+)"', 1)) for name in ("writetime", "tm")])

    def last(form: str) -> Column:
        text = F.try_element_at(F.regexp_extract_all(content, F.lit(form), F.lit(0)), F.lit(-1))
        return _date(*_match(text, form))

    address_year = F.regexp_extract(url, r"/(\d{4})\d{2}/", 1)
    content_year = F.regexp_extract(content, r"(\d{4})年", 1)
    year = F.coalesce(F.nullif(address_year, F.lit("")), F.nullif(content_year, F.lit("")), F.lit(str(default_year)))
    short = r"(\d{1,2})月(\d{1,2})日"
    month_day = F.when(content.rlike(short), _date(year, F.regexp_extract(content, short, 1), F.regexp_extract(content, short, 2)))
    from_address = _date(address_year, F.regexp_extract(url, r"/(\d{4})(\d{2})/", 2), F.lit("1"))
    title_year = F.regexp_extract(title, r"(\d{4})年", 1)
    from_title = F.coalesce(_date(*_match(title, DATE_FORMS[0])), _date(title_year, F.lit("1"), F.lit("1")))
    return F.coalesce(in_script, last(DATE_FORMS[0]), last(DATE_FORMS[1]), month_day, from_address, from_title)


def iso_date(c) -> Column:
    """Date before an optional time part; anything else is null."""
    day = F.split(_col(c), "T")[0]
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))))


# Document number forms in order of priority. A word character is any letter, digit or underscore.
NUMBER_FORMS = (
    r"([京津沪渝冀豫云辽黑湘皖鲁苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][\p{L}\p{N}_]*[〔\[]\d{4}[〕\]]\d+号)",
    r"(国[\p{L}\p{N}_]*[〔\[]\d{4}[〕\]]\d+号)",
    r"(环[\p{L}\p{N}_]*[〔\[]\d{4}[〕\]]\d+号)",
    r"([\p{L}\p{N}_]+发[〔\[]\d{4}[〕\]]\d+号)",
    r"(第\d+号)",
    r"(公告\s*\d{4}年\s*第\d+号)",
)


def document_number(c) -> Column:
    """First form that occurs. The open-ended fourth form is tried only where its fixed tail occurs."""
    c = _col(c)
    found = [F.nullif(F.regexp_extract(c, form, 1), F.lit("")) for form in NUMBER_FORMS]
    found[3] = F.when(c.rlike(r"发[〔\[]\d{4}[〕\]]\d+号"), found[3])
    return F.when(c.contains("号"), F.coalesce(*found))


def without_fragment(url) -> Column:
    """Scheme, host, path and query; the fragment and the parameters of the last path segment go."""
    return F.regexp_replace(F.regexp_replace(_col(url), r"#.*$", ""), r";[^/?]*(\?|$)", "$1")


def absolute_url(link, base) -> Column:
    """Resolve a link against the address of its page and normalise it."""
    link, base = _col(link), _col(base)
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([a-z]+:)", 1)
    folder = F.concat(origin, F.regexp_extract(F.concat(base, F.lit("")), r"^[a-z]+://[^/?#]+(/(?:[^?#]*/)?)?", 1))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    joined = (
        F.when(link.startswith("http"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), link))
        .otherwise(F.concat(folder, link)))
    head = F.regexp_extract(joined, r"^([a-z]+://[^/?#]+)", 1)
    path = F.regexp_extract(joined, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    rest = F.regexp_extract(joined, r"^[a-z]+://[^/?#]+[^?#]*(.*)$", 1)
    # Dot segments: '.' disappears, '..' takes the segment before it away.
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    resolved = F.when(path.contains("/."), F.array_join(kept, "/")).otherwise(path)
    return without_fragment(F.concat(head, resolved, rest))


# File endings that are not documents, and marks of a document address.
SKIPPED_ENDINGS = ("jpg", "jpeg", "png", "gif", "css", "js", "ico")
DOCUMENT_MARKS = (".html", ".htm", ".pdf", ".doc", ".docx", "article", "content", "detail")


def is_document_url(url, marks: Sequence[str] = DOCUMENT_MARKS) -> Column:
    low = F.lower(_col(url))
    listed = "|".join(m.replace(".", r"\.") for m in marks)
    return ~low.rlike(r"\.(" + "|".join(SKIPPED_ENDINGS) + ")$") & low.rlike(f"({listed})")


def links(html) -> Column:
    """All href values, in page order."""
    return F.regexp_extract_all(_col(html), F.lit(r'href="([^"]+)"'), F.lit(1))


# Where a title is looked for, in order.
TITLE_FORMS = (
    r"(?s)<title[^>]*>(.*?)</title>", r"(?s)<h1[^>]*>(.*?)</h1>", r'(?s)<div class="title"[^>]*>(.*?)</div>',
    r'(?s)<div class="article-title"[^>]*>(.*?)</div>', r'(?s)<div id="title"[^>]*>(.*?)</div>')
REDIRECT = "您访问的链接"


def title_of(html, redirect: str = REDIRECT, forms: Sequence[str] = TITLE_FORMS) -> Column:
    """First place with more than 5 cleaned characters and no redirect notice, else the last place that exists."""
    html = _col(html)
    tried = [(html.rlike(f), clean_text(F.regexp_extract(html, f, 1))) for f in forms]
    good = [F.when((F.length(x) > 5) & ~x.contains(redirect), x) for _, x in tried]
    last = [F.when(there, x) for there, x in reversed(tried)]
    return F.coalesce(*good, *last)


def document_links(html, base, pattern: str) -> Column:
    """Absolute links of a page that match the pattern, without anchors and scripts."""
    usable = F.filter(links(html), lambda x: ~x.contains("#") & ~F.lower(x).contains("javascript:") & x.rlike(pattern))
    return F.transform(usable, lambda x: absolute_url(x, base))


# Words that end the leading clause of an official document.
DOCUMENT_TYPES = "公告|通知|办法|规定|标准|名录|目录|决定|意见|批复"


def title_from_content(content, types: str = DOCUMENT_TYPES, stop: str = "。") -> Column:
    """Leading clause up to a document-type word, else the first sentence up to 100 characters if over 10."""
    content = _col(content)
    clause = F.regexp_extract(content, f"^([^{stop}]+(?:{types}))", 1)
    sentence = F.substring(F.substring_index(content, stop, 1), 1, 100)
    chosen = F.when(F.length(clause) > 0, clause).when(F.length(sentence) > 10, sentence)
    return F.when(F.length(content) > 20, strip(chosen))


def truncated(c, length: int) -> Column:
    return F.concat(F.substring(_col(c), 1, length), F.lit("..."))


def integers(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(r"\d+"), F.lit(0))


def without_label(c, labels: Sequence[str] = ("发布时间：", "发布时间:")) -> Column:
    c = _col(c)
    for label in labels:
        c = F.replace(c, F.lit(label), F.lit(""))
    return strip(c)


def captured(c, pattern: str, default: str) -> Column:
    """First capture group, or the default when the pattern does not occur."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(c), pattern, 1), F.lit("")), F.lit(default))


def has_keyword(title, content, keyword: str) -> Column:
    """Keyword in the lower-cased title and content put together without a separator."""
    both = F.concat(F.lower(F.coalesce(_col(title), F.lit(""))), F.lower(F.coalesce(_col(content), F.lit(""))))
    return both.contains(keyword.lower())


# Cue words of the enforcement levels, strongest first.
CUES = (
    ("mandatory", ("必须", "应当", "不得")),
    ("binding", ("应", "原则上", "一般要求")),
    ("encouraged", ("鼓励", "支持", "可以", "引导")),
)


def enforcement(c, cues: Sequence[tuple[str, Sequence[str]]] = CUES, last: str = "informational") -> Column:
    c = _col(c)
    out = None
    for label, words in cues:
        hit = c.rlike("(" + "|".join(words) + ")")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


# --- text of page containers ---------------------------------------------------------------------------------------

# Named character references that pages use; others stay as they are, numbers are read as code points.
REFERENCES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "hellip": "…", "ndash": "–",
    "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "middot": "·"}
_SILENT = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
_TAG = r"(?s)<[/!?]?[a-zA-Z][^>]*>"
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);"


def _between(c: Column, pattern: str, replaced) -> Column:
    """The text with each match of ``pattern`` replaced by ``replaced(match)``; matches and what lies between meet by place."""
    found, pieces = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), F.split(c, pattern, -1)
    return F.array_join(F.zip_with(pieces, found, lambda piece, match: F.concat(piece, F.coalesce(replaced(match), F.lit("")))), "")


def unescaped(c) -> Column:
    """Character references of a text as characters."""
    names = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])

    def one(reference: Column) -> Column:
        name = F.substring(reference, F.lit(2), F.length(reference) - 2)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 9))
        number = digits.cast("long")
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(name.startswith("#"), F.when(known, letter).otherwise(F.lit("\ufffd"))).otherwise(F.coalesce(F.try_element_at(names, name), reference))

    return F.when(_col(c).contains("&"), _between(_col(c), _REFERENCE, one)).otherwise(_col(c))


def _without_markup(c: Column) -> Column:
    return unescaped(F.regexp_replace(c, _TAG, ""))


def inner_markup(c, tag: str, mark: str) -> Column:
    """Markup inside the first ``tag`` whose class or id is ``mark`` (any, if empty), nested ones of its kind included.

    The start and end tags of that kind cut the page into pieces. From the wanted start tag on, a fold counts how deep each
    tag leaves it; the container ends where the depth is back at 0, or with the page. Null without such a tag.
    """
    pattern = rf"(?is)<{tag}(?=[\s/>])[^>]*>|</{tag}\s*>"
    wanted = rf"(?is)^<{tag}\b" if not mark else rf"""(?is)^<{tag}\b[^>]*?\s(class|id)\s*=\s*("{mark}"|'{mark}'|{mark}(?=[\s>]))"""
    found, pieces = F.regexp_extract_all(_col(c), F.lit(f"({pattern})"), F.lit(1)), F.split(_col(c), pattern, -1)
    first = F.array_position(F.transform(found, lambda t: t.rlike(wanted)), True)  # from 1
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(acc: Column, tag_: Column) -> Column:
        at = acc["at"] + 1
        depth = F.when((acc["end"] > 0) | (at < first), acc["depth"]).otherwise(acc["depth"] + F.when(tag_.startswith("</"), -1).otherwise(1))
        over = (acc["end"] == 0) & (at >= first) & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(over, at).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(found, start, step, lambda acc: F.when(acc["end"] > 0, acc["end"]).otherwise(F.size(found) + 1))
    # Piece i lies before tag i + 1; inside are the pieces after the first tag and the tags up to the last.
    count = (end - first).cast("int")
    inside = F.zip_with(F.slice(pieces, (first + 1).cast("int"), count), F.slice(found, (first + 1).cast("int"), F.greatest(count - 1, F.lit(0))),
                        lambda piece, tag_: F.concat(piece, F.coalesce(tag_, F.lit(""))))
    return F.when(first > 0, F.array_join(inside, ""))


def body_text(c, containers: Sequence[tuple[str, str]], least: int = 100) -> Column:
    """Text of the first listed container with more than ``least`` characters, else of the whole page."""
    page = F.regexp_replace(_col(c), _SILENT, "")
    texts = [_without_markup(inner_markup(page, tag, mark)) for tag, mark in containers]
    chosen = F.filter(F.array(*texts), lambda t: F.length(F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))) > least)
    return F.coalesce(F.get(chosen, F.lit(0)), _without_markup(page))
