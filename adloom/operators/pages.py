"""Fields of job pages: structured data wherever it nests, adapters by host, plain HTML; a registry orders them."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import ref

FIELDS = (
    "title", "company", "place", "country", "posted", "closes", "employment", "currency", "low", "high", "period", "description", "requirements", "source_id",
)
_BLOCK = re.compile(r"<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>", re.I | re.S)
_TAGS = re.compile(r"<[^>]*>")
_DROP = re.compile(r"<(script|style|nav|footer|header|iframe|form|noscript)\b[^>]*>.*?</\1\s*>", re.I | re.S)


def plain(text: object) -> str | None:
    """Text without tags and entities, white space collapsed; None for nothing."""
    if text is None or isinstance(text, (dict, list, bool)):
        return None
    t = " ".join(_TAGS.sub(" ", entities.unescape(str(text))).split())
    return t or None


def is_type(node: object, name: str) -> bool:
    """Whether a JSON-LD node has a type, given as text or among a list."""
    kind = node.get("@type") if isinstance(node, dict) else None
    return any(isinstance(k, str) and k.rsplit("/", 1)[-1] == name for k in (kind if isinstance(kind, list) else [kind]))


def nodes_of(data: object, name: str) -> Iterator[dict]:
    """All nodes of a type, however deep: in lists, ``@graph`` and values; in the order they stand."""
    stack = [data]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            if is_type(node, name):
                yield node
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))


def _first(value: object) -> object:
    return value[0] if isinstance(value, list) and value else None if isinstance(value, list) else value


def _name(value: object) -> str | None:
    value = _first(value)
    return plain(value.get("name")) if isinstance(value, dict) else plain(value)


def posting_fields(node: dict) -> dict[str, str | None]:
    """The fields of a JobPosting node."""
    place = _first(node.get("jobLocation"))
    address = place.get("address") if isinstance(place, dict) else place
    address = _first(address)
    parts = address if isinstance(address, dict) else {"addressLocality": address}
    pay = _first(node.get("baseSalary"))
    amount = pay.get("value") if isinstance(pay, dict) else None
    range_ = amount if isinstance(amount, dict) else {"value": amount if amount is not None else pay if not isinstance(pay, dict) else None}
    low = range_.get("minValue", range_.get("value"))
    own = node.get("identifier")
    kinds = node.get("employmentType")
    return {
        "title": plain(node.get("title") or node.get("name")),
        "company": _name(node.get("hiringOrganization")),
        "place": plain(parts.get("addressLocality") or parts.get("addressRegion")) or (_name(place) if isinstance(place, dict) else None),
        "country": _name(parts.get("addressCountry")),
        "posted": plain(node.get("datePosted")),
        "closes": plain(node.get("validThrough")),
        "employment": ", ".join(map(str, kinds)) if isinstance(kinds, list) else plain(kinds),
        "currency": plain(pay.get("currency") if isinstance(pay, dict) else node.get("salaryCurrency")),
        "low": plain(low),
        "high": plain(range_.get("maxValue", low)),
        "period": plain(range_.get("unitText")),
        "description": plain(node.get("description")),
        "requirements": plain(node.get("qualifications") or node.get("experienceRequirements") or node.get("skills")),
        "source_id": plain(own.get("value")) if isinstance(own, dict) else plain(_first(own)),
    }


def structured(_url: str, page: str) -> dict[str, str | None]:
    """The first JobPosting of any JSON-LD block that parses; further ones fill what it leaves open."""
    found: dict[str, str | None] = {}
    for block in _BLOCK.findall(page):
        try:
            data = json.loads(block.strip())
        except ValueError:
            # Line breaks inside of strings are the usual fault.
            try:
                data = json.loads(re.sub(r"[\x00-\x1f]+", " ", block).strip())
            except ValueError:
                continue
        for node in nodes_of(data, "JobPosting"):
            for k, v in posting_fields(node).items():
                if v is not None:
                    found.setdefault(k, v)
    return found


def _tag(page: str, name: str) -> str | None:
    m = re.search(rf"<{name}\b[^>]*>(.*?)</{name}\s*>", page, re.I | re.S)
    return plain(m[1]) if m else None


def _meta(page: str, key: str) -> str | None:
    for m in re.finditer(r"<meta\b([^>]*)>", page, re.I):
        attributes = {k.lower(): v for k, _, v in re.findall(r"([\w:-]+)\s*=\s*([\"'])(.*?)\2", m[1], re.S)}
        if key in (attributes.get("property", "").lower(), attributes.get("name", "").lower(), attributes.get("itemprop", "").lower()):
            return plain(attributes.get("content"))
    return None


_LABELS = {
    "company": r"company|employer|organi[sz]ation", "place": r"location|city|work location", "employment": r"job type|employment type|contract",
    "posted": r"posted(?: on)?|date posted", "closes": r"closing date|apply before|deadline", "requirements": r"requirements|qualifications",
}


def generic(_url: str, page: str) -> dict[str, str | None]:
    """Title from headings and meta data, labelled values from definition lists and tables, text without the page's frame."""
    found = {
        "title": _tag(page, "h1") or _meta(page, "og:title") or _tag(page, "title"),
        "description": _meta(page, "og:description") or _meta(page, "description"),
        "company": _meta(page, "og:site_name"),
    }
    pairs = re.findall(r"<(?:dt|th)\b[^>]*>(.*?)</(?:dt|th)\s*>\s*<(?:dd|td)\b[^>]*>(.*?)</(?:dd|td)\s*>", page, re.I | re.S)
    pairs += re.findall(r"<(?:b|strong)\b[^>]*>([^<]{2,40}?):?\s*</(?:b|strong)\s*>:?\s*([^<]{1,200})", page, re.I)
    for label, value in pairs:
        for field, words in _LABELS.items():
            if re.fullmatch(rf"(?:{words})\s*:?", plain(label) or "", re.I) and plain(value):
                if field != "company" or not found.get("_company"):
                    found[field] = found.get(field) if field not in ("company",) and found.get(field) else plain(value)
    body = plain(_DROP.sub(" ", page))
    if body and len(body) > len(found.get("description") or ""):
        found["description"] = body
    return found


@dataclass(frozen=True)
class PageExtractor:
    """A named way to read a page; ``handles`` says for which pages it is tried."""

    name: str
    read: Callable[[str, str], dict[str, str | None]]
    handles: Callable[[str, str], bool] = lambda url, page: True


def by_host(name: str, host: str, patterns: dict[str, str]) -> PageExtractor:
    """An adapter for one host and its subdomains: a pattern with one group for each field."""
    compiled = {f: re.compile(p, re.I | re.S) for f, p in patterns.items()}

    def read(_url: str, page: str) -> dict[str, str | None]:
        return {f: plain(m[1]) for f, p in compiled.items() if (m := p.search(page))}

    def handles(url: str, _page: str) -> bool:
        own = (urlsplit(url or "").hostname or "").lower()
        return own == host or own.endswith("." + host)

    return PageExtractor(name, read, handles)


STRUCTURED = PageExtractor("jsonld", structured, lambda url, page: "ld+json" in page)
GENERIC = PageExtractor("generic", generic)

_OUT = pa.struct([*((f, pa.string()) for f in FIELDS), ("extractor", pa.string())])


def read_page(url: str | None, page: str | None, registry: tuple[PageExtractor, ...]) -> dict[str, str | None] | None:
    """Fields by the first extractor of the registry that finds a title; later ones fill what is open. None for blank pages."""
    if not page or not page.strip():
        return None
    found: dict[str, str | None] = dict.fromkeys(FIELDS)
    found["extractor"] = None
    for e in registry:
        if not e.handles(url or "", page):
            continue
        got = e.read(url or "", page)
        if found["extractor"] is None and got.get("title"):
            found["extractor"] = e.name
        for f in FIELDS:
            if found[f] is None and got.get(f):
                found[f] = got[f]
    return found


def page_fields(url: Column, page: Column, registry: tuple[PageExtractor, ...] = (STRUCTURED, GENERIC)) -> Column:
    """Struct of :data:`FIELDS` and ``extractor``; null for null and blank pages. Adapters go between the two of the default."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, pages in batches:
            yield pa.array([read_page(u, p, registry) for u, p in zip(urls.to_pylist(), pages.to_pylist())], _OUT)

    return F.arrow_udf(run, ", ".join(f"{f} string" for f in (*FIELDS, "extractor"))).asNondeterministic()(url, page)


def with_page_fields(df: DataFrame, url: str, page: str, out: str = "fields", registry: tuple[PageExtractor, ...] = (STRUCTURED, GENERIC)) -> DataFrame:
    """``df`` with the fields of its pages in a struct column."""
    from adloom.functions.names import fresh

    return df.withColumn(fresh(df, out), page_fields(ref(url), ref(page), registry))
