"""Text, URL and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing value in text columns.
PLACEHOLDERS = ("", "nan", "none", "nat", "null", "undefined", "n/a", "-")
# Entities that plain cleaning resolves.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


# Elements whose content is no text of the page.
DROPPED = ("script", "style", "nav", "footer", "header", "iframe", "form")


def null_if_placeholder(c: Column) -> Column:
    """The trimmed text, or null where it stands for nothing."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)


def unescaped(c: Column) -> Column:
    """Common character entities resolved, ``&amp;`` last."""
    for entity, plain in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def clean_html(c: Column) -> Column:
    """Tags to blanks, entities resolved, white space collapsed."""
    bare = F.regexp_replace(c, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(bare), r"\s+", " "))


def paragraphs(c: Column) -> Column:
    """Lines of a page: scripts, styles, menus and forms dropped, block ends to line breaks, list items with a bullet."""
    t = c
    for name in DROPPED:
        t = F.regexp_replace(t, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n• ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/?p|/?div|/?h[1-6]|/?tr|/?ul|/?ol)\b[^>]*>", "\n")
    t = unescaped(F.regexp_replace(t, r"<[^>]*>", " "))
    lines = F.transform(F.split(t, r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != "•")), "\n")


def canonical_url(c: Column) -> Column:
    """The URL in lower case without trailing slashes, blanks and fragment."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"#.*$", ""), r"/+$", "")


def hostname(c: Column) -> Column:
    """The host of a URL; null where it has none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(c), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def stable_id(host: Column, source_id: Column, url: Column) -> Column:
    """``host_id`` where the source gives an id, else ``host_hash_`` and 16 digits of the URL's hash."""
    own = null_if_placeholder(source_id)
    return F.when(own.isNotNull(), F.concat_ws("_", host, own)).otherwise(
        F.concat(host, F.lit("_hash_"), F.substring(F.sha2(canonical_url(url), 256), 1, 16))
    )


def normalised(c: Column) -> Column:
    """Lower case, everything but letters, marks, digits and underscores to blanks, in any script; blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}_]", " "), r" +", " "))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two texts; 0 where either is empty."""
    x = F.array_distinct(F.filter(F.split(normalised(a), " "), lambda w: w != ""))
    y = F.array_distinct(F.filter(F.split(normalised(b), " "), lambda w: w != ""))
    shared = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - shared
    return F.when((F.size(x) > 0) & (F.size(y) > 0), shared / total).otherwise(0.0)


def snippet(text: Column, term: str, width: int = 220) -> Column:
    """The first sentence that holds the term as a word, cut to ``width``; else the head of the text."""
    import re

    hit = F.trim(F.regexp_extract(text, rf"(?i)([^.?!;\n]*\b{re.escape(term)}\b[^.?!;\n]*)", 1))
    return F.substring(F.when(hit != "", hit).otherwise(F.trim(text)), 1, width)


def content_hash(*columns: Column) -> Column:
    """SHA-256 over the columns, nulls as empty, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def work_mode(title: Column, place: Column, text: Column) -> Column:
    """``hybrid``, ``remote``, ``on_site`` or ``unspecified``; the description counts where title and place are silent.

    Remote and on-site at once are ``unspecified`` unless hybrid is named.
    """
    head = F.lower(F.concat_ws(" ", title, place))

    def mode(c: Column) -> Column:
        hybrid, remote, site = c.rlike(r"\bhybrid\b"), c.rlike(r"\b(?:remote|work from home|home based|telecommute)\b"), c.rlike(r"\bon-?site\b|\bin office\b")
        return F.when(hybrid, "hybrid").when(remote & site, "unspecified").when(remote, "remote").when(site, "on_site")

    return F.coalesce(mode(head), mode(F.lower(text)), F.lit("unspecified"))
