"""Page boilerplate beside the main content, by tag-path ratios fused with what the pieces say.

1. Every page is cut into pieces, each with its root-to-leaf tag path.
2. Length and punctuation of the text are aggregated over the corpus for every
   path of every source; a path's ratio is smoothed with that of the same path
   at all sources. The meaning of its tags (``nav``, ``aside``, ``article`` ...)
   is added, and thresholds on the sum label the paths that are sure.
3. The wording of pieces (the whole text; numbers, names of places, titles and
   firms replaced by slots) takes the labels of its sure paths; tokens of all
   sentences carry over to wordings that are new.
4. Paths without a sure label take the mean of their wordings, and where a path
   is mixed, each piece follows its wording.

All statistics are over distinct wordings with weights, so the work after the
first aggregation follows the variety of the text, not the number of pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.session import stored

_TAG = re.compile(r"(<[^>]*>|[\r\n]+)")
_NAME = re.compile(r"<\s*(/?)\s*([A-Za-z][\w-]*)((?:.|\n)*?)(/?)>$")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*["']?([^"'>]*)""")
# Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements that do not change what a piece belongs to.
_INLINE = frozenset("b i em strong u font small mark sub sup".split())

# Words that end a firm's name.
_FIRM = (
    r"(?:(?:Pte|Pvt|\(Pvt\)) Ltd\.?|Sdn\.? Bhd\.?|GmbH|AG|Ltd\.?|Inc\.?|LLC|PLC|Group|Labs|Analytics|Networks|Digital|Studio|"
    r"Systems|Technologies|Software \(Pvt\) Ltd|Software|Consulting|Staffing|Solutions|Holdings)"
)
# A word is read once, from its start and without giving back, so that long texts cost no more than short ones.
_FIRM_NAME = re.compile(rf"(?<![^\W\d_])(?:(?>[^\W\d_]*?[A-ZÄÖÜ])[\w'’-]*+(?:\s+&\s+|\s+)){{1,4}}{_FIRM}(?!\w)")
_FIRM_WORD = re.compile(rf"\s(?=[ABCDGHILNPST(]){_FIRM}(?!\w)")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
_BULLET = re.compile(r"^[\-–—•*·▪●◦]+\s+")


@lru_cache(maxsize=1 << 16)
def _step(path: str, tag: str) -> str:
    """The path after a tag."""
    m = _NAME.match(tag)
    if not m:
        return path
    close, name, attributes, closed = m[1], m[2].lower(), m[3], m[4]
    if name in _VOID or name in _INLINE or closed:
        return path
    if close:
        nodes = path.split("/") if path else []
        for k in range(len(nodes) - 1, -1, -1):
            if nodes[k].partition("#")[0] == name:
                return "/".join(nodes[:k])
        return path
    marks = " ".join(_DIGITS.sub("9", v.lower().replace("/", " ")) for _, v in _ATTR.findall(attributes))
    node = f"{name}#{marks}" if marks else name
    return f"{path}/{node}" if path else node


#: Nodes of a path that are written out; what lies between these and the last ones stands as a hash.
SHOWN, LAST = 40, 4


def _short(nodes: list[str], hashes: list[int]) -> str:
    """The path of a stack of nodes: all of a usual one, a hash for the middle of a very deep one."""
    if len(nodes) <= SHOWN:
        return "/".join(nodes)
    return "/".join([*nodes[: SHOWN - LAST], f"~{hashes[len(nodes) - LAST - 1]:x}", *nodes[-LAST:]])


class _Deep:
    """The stack of nodes of a page that nests deeper than paths are written out; every step costs the same."""

    def __init__(self, path: str) -> None:
        self.nodes: list[str] = []
        self.names: list[str] = []
        self.hashes: list[int] = []
        self.open: dict[str, int] = {}
        for node in path.split("/"):
            self._push(node)

    def _push(self, node: str) -> None:
        name = node.partition("#")[0]
        self.nodes.append(node)
        self.names.append(name)
        self.hashes.append(xxhash.xxh3_64_intdigest(node, seed=self.hashes[-1] if self.hashes else 0))
        self.open[name] = self.open.get(name, 0) + 1

    def step(self, tag: str) -> None:
        after = _step("", tag)
        if after:
            self._push(after)
            return
        m = _NAME.match(tag)
        name = m[2].lower() if m and m[1] else ""
        if self.open.get(name):
            while True:
                gone = self.names.pop()
                self.nodes.pop()
                self.hashes.pop()
                self.open[gone] -= 1
                if gone == name:
                    break

    @property
    def path(self) -> str:
        return _short(self.nodes, self.hashes)


def pieces(page: str | None) -> list[tuple[int, str, str]]:
    """``(number, path, text)`` of a page: tags and line breaks separate, blank pieces do not count."""
    if not page:
        return []
    out, path, n = [], "", 0
    deep: _Deep | None = None
    for part in _TAG.split(page):
        if not part:
            continue
        first = part[0]
        if first == "<" and part[-1] == ">":
            if deep is None:
                path = _step(path, part)
                # A path of so many nodes has at least twice as many characters.
                if len(path) >= 2 * SHOWN - 1 and path.count("/") >= SHOWN:
                    deep = _Deep(path)
                    path = deep.path
            else:
                deep.step(part)
                path = deep.path
                if len(deep.nodes) <= SHOWN:
                    deep = None
        elif first not in "\r\n":
            text = part.strip()
            if text:
                n += 1
                out.append((n, path, text))
    return out


def any_of(words: list[str]) -> re.Pattern:
    """A pattern for whole words or phrases of a list, longest first; shared beginnings are read once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        if w:
            node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(c) + pattern(n) for c, n in node.items() if c]
        if not branches:
            return ""
        inner = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return inner + "?" if "" in node else inner

    if not tree:
        return re.compile("(?!)")
    first = "".join(sorted(re.escape(c) for c in tree))
    # Where no word can start, none is tried.
    return re.compile(rf"(?<!\w)(?=[{first}]){pattern(tree)}(?!\w)")


class Wording:
    """The wording of a piece: its whole text in slots."""

    def __init__(self, places: list[str], titles: list[str], skills: list[str]) -> None:
        self.slots = (
            (any_of(titles), "\x02"), (_FIRM_NAME, "\x03"), (any_of(skills), "\x04"), (any_of(places), "\x05"),
        )
        self._short = lru_cache(maxsize=1 << 15)(self.compute)

    def of(self, text: str, site: str, firm: str) -> str:
        # Long texts seldom come again and would fill the memory.
        return (self._short if len(text) <= 400 else self.compute)(text, site, firm)

    def compute(self, text: str, site: str, firm: str) -> str:
        t = _BULLET.sub("", html.unescape(text))
        if firm and firm in t:
            t = t.replace(firm, "\x03")
        if site and site in t:
            t = t.replace(site, "\x06")
        for pattern, slot in self.slots:
            if pattern is not _FIRM_NAME or _FIRM_WORD.search(t):
                t = pattern.sub(slot, t)
        return " ".join(_DIGITS.sub("9", t).lower().split())


@lru_cache(maxsize=4)
def _wording(places: tuple[str, ...], titles: tuple[str, ...], skills: tuple[str, ...]) -> Wording:
    return Wording(list(places), list(titles), list(skills))


_CUT = "job_id string, field string, seg_no long, k long, source string, path string, said long, wording string, n long, chars long, marks long"
_CUT_ARROW = pa.schema(
    [
        ("job_id", pa.string()), ("field", pa.string()), ("seg_no", pa.int64()), ("k", pa.int64()), ("source", pa.string()), ("path", pa.string()),
        ("said", pa.int64()), ("wording", pa.string()), ("n", pa.int64()), ("chars", pa.int64()), ("marks", pa.int64()),
    ]
)
#: Distinct pieces that a worker sums before it passes them on.
SUMMED = 100_000


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _rows(columns: list[list], names: tuple[str, ...]) -> pa.RecordBatch:
    n = len(columns[0])
    given = dict(zip(names, columns))
    return pa.RecordBatch.from_arrays(
        [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in _CUT_ARROW], schema=_CUT_ARROW
    )


def cut_pages(pages: DataFrame, vocabulary: tuple[tuple[str, ...], ...]) -> DataFrame:
    """One pass over all pages: a row for each piece, and rows that sum pieces of one kind.

    ``pages`` has ``(job_id, field, source, text, site, firm)``. A piece has
    ``(job_id, field, seg_no, k)``, ``k`` the key of its source, path and wording
    (8 bytes). A sum has ``k`` with ``(source, path, said, wording)`` in full, the
    number ``n`` of pieces, their characters and marks; workers give several sums
    of one ``k``. The path of text without markup is null. ``vocabulary`` is three
    bounded lists (places, titles, skills) whose words become slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wording = _wording(*vocabulary).of
        sums: dict[tuple[str, str, str], list[int]] = {}

        def summed() -> pa.RecordBatch:
            said = [_signed(xxhash.xxh3_64_intdigest(w)) for _, _, w in sums]
            source, path, words = zip(*sums) if sums else ((), (), ())
            k, n, chars, marks = zip(*sums.values()) if sums else ((), (), (), ())
            return _rows(
                [k, source, [p or None for p in path], said, words, n, chars, marks],
                ("k", "source", "path", "said", "wording", "n", "chars", "marks"),
            )

        for batch in batches:
            jobs, fields, numbers, keys = [], [], [], []
            for job, field, source, page, site, firm in zip(*(c.to_pylist() for c in batch.columns)):
                firm = firm if firm and len(firm) > 3 else ""
                for n, path, piece in pieces(page):
                    said = wording(piece, site or "", firm if firm and firm in piece else "")
                    same = (source, path, said)
                    own = sums.get(same)
                    if own is None:
                        own = sums[same] = [_signed(xxhash.xxh3_64_intdigest("\x00".join(same))), 0, 0, 0]
                    own[1] += 1
                    own[2] += len(piece)
                    own[3] += sum(map(piece.count, ".,!?;"))
                    jobs.append(job)
                    fields.append(field)
                    numbers.append(n)
                    keys.append(own[0])
            yield _rows([jobs, fields, numbers, keys], ("job_id", "field", "seg_no", "k"))
            if len(sums) >= SUMMED:
                yield summed()
                sums.clear()
        yield summed()

    return pages.select("job_id", "field", "source", "text", "site", "firm").mapInArrow(run, _CUT)


#: Weight of a label before any evidence, and how pure a path must be to decide for its pieces.
PRIOR, PURE = 1.0, 0.98
#: Log odds from which a wording that no path decides counts as boilerplate.
ODDS = 0.7
#: Smoothed ratios fused with tags: up to LOW a path is boilerplate, from HIGH it is content; between, wordings decide.
LOW, HIGH = 2.5, 5.5
#: What tags add to the ratio: those that tell outweigh any ratio, a heading is short without being boilerplate.
TELLS, HEADING = 100.0, 2.5
#: Pieces that a path needs before its ratio alone decides.
ENOUGH = 20


def _tag_label(path: Column) -> Column:
    """1 for paths whose tags say boilerplate, 0 for content, null where tags do not tell."""
    node = r"(?:^|/)(?:{})(?:#[^/]*)?(?:/|$)"
    off = (
        path.rlike(node.format("nav|aside|script|style|noscript|form|menu|button|select|iframe"))
        | path.rlike(r"(?:^|/)a(?:#[^/]*)?$")
        | path.rlike(r"#[^/]*\b(?:consent|cookies?|banner|breadcrumbs?|navbar|navigation)\b")
        | path.rlike(r"^footer(?:#[^/]*)?(?:/|$)")
    )
    body = path.rlike(r"(?:^|/)(?:main|article)(?:#[^/]*)?/(?:.*/)?(?:p|li|h[1-6])(?:#[^/]*)?$")
    bare = path.rlike(r"^(?:(?:ul|ol)/)?(?:p|li|h[1-6])$")
    return F.when(off, 1.0).when(body | bare, 0.0)


def path_ratios(wordings: DataFrame) -> DataFrame:
    """``(source, path, ratio, label, teaches)``: smoothed text ratio of each path of each source, and 1 or 0 for sure paths.

    The ratio is the mean length times one plus the mean punctuation of the
    path's pieces, averaged with that of the path at all sources (a quarter of
    the weight), in logarithms. The meaning of the tags is added to it, and the
    sum is held against two thresholds: ``label`` is 1 for boilerplate, 0 for
    content and null between them. ``teaches`` is true for sure paths that label
    wordings: those whose tags tell, and at sources without any such path those
    that the ratio decides.
    """
    own = wordings.groupBy("source", "path").agg(
        F.sum("n").alias("_n"), F.sum("chars").alias("_chars"), F.sum("marks").alias("_marks")
    )
    everywhere = own.groupBy("path").agg(
        F.sum("_n").alias("_an"), F.sum("_chars").alias("_ac"), F.sum("_marks").alias("_am")
    )

    def ratio(n: str, chars: str, marks: str) -> Column:
        return F.log1p(F.col(chars) / F.col(n) * (1 + F.col(marks) / F.col(n)))

    tag = _tag_label(F.col("path"))
    meaning = (
        F.when(tag == 1.0, -TELLS).when(tag == 0.0, TELLS).when(F.col("path").rlike(r"(?:^|/)h[1-6](?:#[^/]*)?$"), HEADING).otherwise(0.0)
    )
    sure = tag.isNotNull() | (F.col("_n") >= ENOUGH)
    return (
        own.join(everywhere, "path")
        .withColumn("ratio", ratio("_n", "_chars", "_marks") * 0.75 + ratio("_an", "_ac", "_am") * 0.25)
        .withColumn("_fused", F.col("ratio") + meaning)
        .select(
            "source",
            "path",
            "ratio",
            F.when(sure & (F.col("_fused") <= LOW), 1.0).when(sure & (F.col("_fused") >= HIGH), 0.0).alias("label"),
            (tag.isNotNull() | (F.count(tag).over(W.partitionBy("source")) == 0)).alias("teaches"),
        )
    )


#: Where a sentence of a wording ends and another begins.
_NEXT = r"(?<=[\p{L}\p{N}_)][.!?]) "


def sentences_of(texts: DataFrame) -> DataFrame:
    """``(said, sentence, later, part)`` of all sentences of ``(said, wording)``; ``part`` is a key of 8 bytes."""
    cut = texts.select("said", F.posexplode(F.split("wording", _NEXT)).alias("_at", "sentence"))
    later = F.col("_at") > 0
    return cut.select("said", "sentence", later.alias("later"), F.xxhash64("sentence", later).alias("part"))


def _with_tokens(sentences: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and a row for each ``token``: tokens and neighbouring pairs of a sentence, its ends included.

    The ends of later sentences are tokens of their own: the odds of the first
    ones are those of pieces, however many sentences a piece has.
    """
    start, end = (F.when(F.col("later"), x * 2).otherwise(x) for x in "^$")
    tokens = F.filter(
        F.concat(F.array(start), F.split(F.regexp_replace("sentence", r"([^\p{L}\p{N} ])", " $1 "), r" +"), F.array(end)),
        lambda x: x != "",
    )
    # Cut once per sentence: an expression used in a lambda would be worked out again for every token.
    cut = sentences.withColumn("_t", tokens)
    last = F.size("_t") - 1
    pairs = F.zip_with(F.slice("_t", 1, last), F.slice("_t", 2, last), lambda x, y: F.concat_ws(" ", x, y))
    return cut.select(*columns, F.explode(F.array_distinct(F.concat(pairs, F.col("_t")))).alias("token"))


def boilerplate_wordings(counts: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(k, source, path, said, off)`` of the distinct pieces in ``counts``, ``off`` true for boilerplate.

    ``counts`` has ``(k, source, path, said, n, chars, marks)``, ``said`` the key of
    a wording; the path of text without markup is null. ``sentences`` has those
    of every wording, as of :func:`sentences_of`.
    """
    marked = counts.filter(F.col("path").isNotNull())
    # A row for each path of a source; five branches read them.
    paths = stored(path_ratios(marked))
    labelled = marked.join(paths, ["source", "path"], "left")
    # What each wording is called where its path is sure.
    sure = (
        labelled.filter(F.col("label").isNotNull() & F.col("teaches"))
        .groupBy("said")
        .agg(F.sum(F.col("n") * F.col("label")).alias("off_n"), F.sum("n").alias("all_n"))
    )
    # Tokens carry the labels to new wordings; a sentence counts once, with little extra for its frequency.
    weight = F.log1p("all_n")
    called = (
        sentences.select("said", "part")
        .distinct()
        .join(sure, "said")
        .groupBy("part")
        .agg(F.sum("off_n").alias("off_n"), F.sum("all_n").alias("all_n"))
        .select(
            "part",
            (weight * F.col("off_n") / F.col("all_n")).alias("o"),
            (weight * (1 - F.col("off_n") / F.col("all_n"))).alias("c"),
        )
    )
    texts = sentences.select("part", "sentence", "later").distinct()
    tokens = (
        _with_tokens(texts.join(called, "part"), "o", "c")
        .groupBy("token")
        .agg(F.sum("o").alias("o"), F.sum("c").alias("c"))
        .select("token", F.log((F.col("o") + 0.5) / (F.col("c") + 0.5)).alias("odds"))
    )
    # Where the path is sure, nothing asks for the wording's score.
    asked = labelled.filter(F.col("label").isNull()).select("said")
    every = asked.unionByName(counts.filter(F.col("path").isNull()).select("said")).distinct()
    parts = sentences.select("said", "part").join(every, "said")
    # Every distinct sentence is scored once, then all of each wording are summed.
    of_part = (
        _with_tokens(texts.join(parts.select("part").distinct(), "part", "left_semi"), "part")
        .join(tokens, "token", "left")
        .groupBy("part")
        .agg(F.sum(F.coalesce("odds", F.lit(0.0))).alias("odds"), F.count("*").alias("m"))
    )
    scored = parts.join(of_part, "part").groupBy("said").agg((F.sum("odds") / F.sqrt(F.sum("m"))).alias("odds"))
    share = (F.col("off_n") + PRIOR * F.lit(0.5)) / (F.col("all_n") + PRIOR)
    said = (
        scored.join(sure, "said", "left")
        .withColumn("trust", F.coalesce(F.col("all_n") / (F.col("all_n") + 2.0), F.lit(0.0)))
        .select(
            "said",
            (
                F.col("trust") * F.coalesce(F.log(share / (1 - share)), F.lit(0.0))
                + (1 - F.col("trust")) * F.col("odds")
            ).alias("evidence"),
        )
    )
    # Only what no sure path decides is asked for its wording; text without markup has no path at all.
    open_ = labelled.filter(F.col("label").isNull()).select("k", "source", "path", "said", "n", "ratio")
    bare = counts.filter(F.col("path").isNull()).select("k", "source", "path", "said", "n", F.lit(None).cast("double").alias("ratio"))
    joined = open_.unionByName(bare).join(said, "said", "left")
    purity = (
        joined.filter(F.col("path").isNotNull())
        .groupBy("source", "path")
        .agg(
            (F.sum(F.when(F.col("evidence") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("pure"),
            F.sum("n").alias("pieces"),
        )
    )
    fused = joined.join(purity, ["source", "path"], "left")
    # A long, punctuated path leans to content, a short bare one to boilerplate.
    lean = F.coalesce(F.lit(4.0) - F.col("ratio"), F.lit(0.0)) * 0.25
    off = (
        F.when((F.col("pieces") >= ENOUGH) & (F.col("pure") >= PURE), True)
        .when((F.col("pieces") >= ENOUGH) & (F.col("pure") <= 1 - PURE), False)
        .otherwise(F.col("evidence") + lean > ODDS)
    )
    by_path = labelled.filter(F.col("label").isNotNull())
    return by_path.select("k", "source", "path", "said", (F.col("label") == 1.0).alias("off")).unionByName(
        fused.select("k", "source", "path", "said", off.alias("off"))
    )


#: Largest list of places, titles or skills that is turned into slots on every worker.
LIST_LIMIT = 100_000


def _bounded(df: DataFrame, *columns: str) -> tuple[str, ...]:
    """The distinct words of the columns of a dimension, whose size is checked."""
    words = df.select(F.explode(F.array(*map(F.col, columns))).alias("w")).filter(F.trim("w") != "").distinct()
    rows = words.limit(LIST_LIMIT + 1).collect()
    if len(rows) > LIST_LIMIT:
        raise ValueError(f"more than {LIST_LIMIT} words for slots; give a smaller list")
    return tuple(sorted(r.w for r in rows))


def pages_of(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """``(job_id, field, source, text, site, firm)`` of the texts of both tables that are not blank."""

    def side(df: DataFrame, field: str, firm: str) -> DataFrame:
        return df.select(
            "job_id",
            F.lit(field).alias("field"),
            F.coalesce("source_hostname", F.lit("")).alias("source"),
            F.col(field).alias("text"),
            F.col("source_platform").alias("site"),
            F.col(firm).alias("firm"),
        )

    both = side(jobs, "job_description", "company_name").unionByName(side(records, "job_description_raw", "company_raw"))
    return both.filter(F.trim("text") != "")


def boilerplate_pieces(
    jobs: DataFrame, records: DataFrame, locations: DataFrame, titles: DataFrame, skills: DataFrame
) -> DataFrame:
    """``(job_id, field, seg_no)`` of the pieces that do not belong to their advert, no row twice.

    Null, empty and blank texts have no pieces. Records delivered twice count
    once in the result.
    """
    vocabulary = (
        _bounded(locations, "city", "region", "country"),
        _bounded(titles, "title"),
        _bounded(skills, "canonical_name"),
    )
    cut = stored(cut_pages(pages_of(jobs, records), vocabulary))
    sums = cut.filter(F.col("n").isNotNull())
    # Counts and sentences feed several branches; they are as many as distinct wordings.
    counts = stored(
        sums.groupBy("k", "source", "path", "said").agg(
            F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("marks").alias("marks")
        )
    )
    sentences = stored(sentences_of(sums.select("said", "wording").distinct()))
    off = boilerplate_wordings(counts, sentences).filter("off").select("k").distinct()
    return cut.filter(F.col("n").isNull()).select("job_id", "field", "seg_no", "k").join(off, "k", "left_semi").drop("k").distinct()
