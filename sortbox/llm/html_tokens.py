"""Tags and text of an html page, in time that grows with its length.

The rules are the standard's for broken markup: a comment or a tag that is never closed runs to the
end of the page, ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text, and what is inside a script
or style is text up to its own end tag.  So is what is inside a title or textarea that has an end tag;
without one, unlike in the standard, it is read as any element.  Each character is looked at a bounded
number of times.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

START, END, TEXT = 0, 1, 2
RAW = {"script", "style", "textarea", "title"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_CLOSE = re.compile(r"[\s/]*(>?)")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in RAW}
_SHORT = re.compile("<!---?>")  # whole comments
_DIGITS = re.compile(r"&#0*([0-9]*)")
Attributes = list[tuple[str, str | None]]


def unescape(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, however long, are U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_DIGITS.sub(_number, text) if "&#" in text else text)


def _number(m: re.Match) -> str:
    digits = m[1]
    if len(digits) > 7:
        return "&#1114112"
    return f"&#{digits or '0'}" if m[0][2:] else m[0]


def _attributes(page: str, at: int) -> tuple[Attributes, bool, int]:
    """Attributes from ``at`` on, whether the tag closes itself, and where it ends (-1: never)."""
    found: Attributes = []
    while True:
        m = _CLOSE.match(page, at)
        if m[1]:
            return found, m[0].endswith("/>"), m.end()
        if m.end() == len(page):
            return found, False, -1
        m = _ATTRIBUTE.match(page, at)
        at, value = m.end(), None
        if m[2]:
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, False, -1
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
            value = unescape(value)
        found.append((m[1].lower(), value))


def tokens(page: str) -> Iterator[tuple[int, str, Attributes, bool]]:
    """START with a name, attributes and whether the tag closes itself, END with a name, or TEXT."""
    at, n, text_from = 0, len(page), 0
    endless: set[str] = set()  # raw elements that no end tag follows any more
    while True:
        lt = page.find("<", at)
        after = page[lt + 1 : lt + 2] if lt >= 0 else ""
        if lt >= 0 and not (after and after in "!?/" or after.isascii() and after.isalpha()):
            at = lt + 1
            continue
        until = n if lt < 0 else lt
        if until > text_from:
            yield TEXT, unescape(page[text_from:until]), [], False
        if lt < 0:
            return
        name = _NAME.match(page, lt + 1 if after != "/" else lt + 2)
        if not name:
            short = _SHORT.match(page, lt)
            mark = "-->" if page.startswith("<!--", lt) else ">"
            end = short.end() if short else page.find(mark, lt + 2) + len(mark)
            if end < lt:
                return
            at = text_from = end
            continue
        tag = name[0].lower()
        attributes, closed, end = _attributes(page, name.end())
        if end < 0:
            return
        at = text_from = end
        if after == "/":
            yield END, tag, [], False
            continue
        yield START, tag, attributes, closed
        if tag in RAW and not closed and tag not in endless:
            stop = _RAW_END[tag].search(page, at)
            if not stop and tag not in ("script", "style"):
                endless.add(tag)
                continue
            end = stop.start() if stop else n
            if end > at:
                yield TEXT, page[at:end], [], False
            at = text_from = end
