"""Scalar Column functions (all JVM-side, codegen friendly)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application's behaviour.
# ---------------------------------------------------------------------------
SYSTEM_LABELS = ["INBOX", "UNREAD", "IMPORTANT", "STARRED", "SENT", "DRAFT", "TRASH", "SPAM"]
NEWSLETTER_LABEL_MARKERS = ["listunsubscribe", "listid", "mailinglist"]
NEWSLETTER_PATTERNS = ["unsubscribe", "newsletter", "mailing.?list", "subscription", "opt.?out"]
TEXT_MAX_CHARS = 2048  # 512 tokens x 4 characters


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a naive datetime (or date), built from
    its text so that no session or process time zone is involved."""
    import datetime as _dt

    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def blank_to_null(c: str | Column) -> Column:
    """Python truthiness for strings: '' and NULL are both "missing"."""
    c = col(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def sender_domain(addr: str | Column) -> Column:
    """Feature domain: text after the last '@', lower-cased; 'unknown' when
    the address is NULL, empty or has no '@'."""
    a = col(addr)
    return F.when(a.contains("@"), F.lower(F.substring_index(a, "@", -1))).otherwise(F.lit("unknown"))


def raw_domain_last(addr: str | Column) -> Column:
    """Mapping-lookup domain: text after the last '@', case kept; NULL if no '@'."""
    a = col(addr)
    return F.when(a.contains("@"), F.substring_index(a, "@", -1))


def raw_domain_first(addr: str | Column) -> Column:
    """Adaptive-label domain: the second '@'-separated field (``split('@')[1]``)."""
    a = col(addr)
    return F.when(a.contains("@"), F.element_at(F.split(a, "@"), 2))


def sender_hash(addr: str | Column) -> Column:
    a = col(addr)
    return F.when((a.isNull()) | (a == ""), F.lit("")).otherwise(F.substring(F.sha2(F.lower(a), 256), 1, 16))


def is_newsletter(labels: str | Column, subject: str | Column, body: str | Column) -> Column:
    lab = F.lower(F.concat_ws(" ", F.coalesce(col(labels), F.array().cast("array<string>"))))
    by_label = F.lit(False)
    for m in NEWSLETTER_LABEL_MARKERS:
        by_label = by_label | lab.contains(m)
    text = F.lower(F.concat(F.coalesce(col(subject), F.lit("")), F.lit(" "), F.coalesce(col(body), F.lit(""))))
    by_text = text.rlike("|".join(NEWSLETTER_PATTERNS))
    return by_label | by_text


def day_of_week(ts: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts)).cast("bigint")


def hour_of_day(ts: str | Column) -> Column:
    return F.hour(col(ts)).cast("bigint")


def text_length(c: str | Column) -> Column:
    return F.coalesce(F.length(col(c)), F.lit(0)).cast("bigint")


def prepare_text(c: str | Column, max_chars: int | None = None) -> Column:
    """Collapse whitespace runs and trim.  ``max_chars`` cuts the text for an
    encoder with a bounded input (the application's encoder:
    ``TEXT_MAX_CHARS``); by default the whole text stays."""
    collapsed = F.regexp_replace(col(c), r"(?U)\s+", " ")
    out = F.regexp_replace(collapsed, r"^ | $", "")
    return F.substring(out, 1, max_chars) if max_chars else out


def body_source(body_plain: str | Column, snippet: str | Column) -> Column:
    return F.coalesce(blank_to_null(body_plain), blank_to_null(snippet), F.lit(""))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Plain substring match of any keyword (no word boundaries)."""
    out = F.lit(False)
    for k in keywords:
        out = out | text.contains(k)
    return out


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days with microsecond precision."""
    return F.timestamp_diff("MICROSECOND", earlier, later).cast("double") / F.lit(86400e6)


def user_labels(labels: str | Column) -> Column:
    sys_labels = F.array(*[F.lit(x) for x in SYSTEM_LABELS])
    return F.filter(
        F.coalesce(col(labels), F.array().cast("array<string>")),
        lambda x: ~F.array_contains(sys_labels, x) & ~x.startswith("Bot/"),
    )


def bot_labels(labels: str | Column) -> Column:
    return F.filter(F.coalesce(col(labels), F.array().cast("array<string>")), lambda x: x.startswith("Bot/"))


def capitalize_word(w: Column) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def clean_label_name(name: str | Column) -> Column:
    """Drop characters other than word characters, whitespace and '-';
    whitespace runs become '-'; every '-' separated word capitalised; if
    longer than 30 characters cut to 30 and drop the trailing partial word."""
    n = col(name)
    # Python's Unicode \w is letters, digits and '_' (Java's (?U)\w also keeps marks).
    kept = F.regexp_replace(n, r"(?U)[^\p{L}\p{N}_\s-]", "")
    stripped = F.regexp_replace(kept, r"(?U)^\s+|\s+$", "")
    dashed = F.regexp_replace(stripped, r"(?U)\s+", "-")
    words = F.filter(F.split(dashed, "-"), lambda w: w != "")
    joined = F.array_join(F.transform(words, capitalize_word), "-")
    cut = F.substring(joined, 1, 30)
    # rsplit('-', 1)[0]: everything before the last '-', or all if none.
    before_last = F.when(cut.contains("-"), F.regexp_extract(cut, r"^(.*)-[^-]*$", 1)).otherwise(cut)
    return F.when(F.length(joined) > 30, before_last).otherwise(joined)


DOMAIN_SUFFIXES = [".com", ".org", ".net", ".edu", ".io", ".co"]
DOMAIN_PREFIXES = ["www.", "mail.", "email.", "newsletters."]


def domain_to_label(domain: str | Column) -> Column:
    d = F.lower(col(domain))
    for s in DOMAIN_SUFFIXES:
        d = F.replace(d, F.lit(s), F.lit(""))
    for p in DOMAIN_PREFIXES:
        d = F.replace(d, F.lit(p), F.lit(""))
    return F.when(F.length(d) >= 3, clean_label_name(d))


def normalize_semantic_label(raw: str | Column) -> Column:
    """trim, strip quotes, '_' -> '-', capitalise each '-' part."""
    x = F.trim(col(raw))
    x = F.regexp_replace(x, "^[\"']+|[\"']+$", "")
    x = F.replace(x, F.lit("_"), F.lit("-"))
    return F.array_join(F.transform(F.split(x, "-"), capitalize_word), "-")


def infer_correct_decision(action_type: str | Column) -> Column:
    return F.when(col(action_type) == "archive", F.lit("keep")).otherwise(F.lit("archive"))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    """Named and numeric character references; NULL stays NULL."""
    return texts.map(html.unescape, na_action="ignore")


def review_snippet(snippet: str | Column) -> Column:
    """First 100 characters, then HTML-entity unescape; NULL/'' -> 'N/A'.
    Only texts with a reference go to Python."""
    cut = F.substring(col(snippet), 1, 100)
    s = F.coalesce(_unescape(F.when(cut.contains("&"), cut)), cut)
    return F.when(blank_to_null(col(snippet)).isNull(), F.lit("N/A")).otherwise(s)
