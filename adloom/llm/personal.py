"""Personal information in free text: found, and replaced by typed placeholders or surrogates.

:mod:`adloom.llm.finder` marks e-mail addresses, identity numbers, phone
numbers, postal addresses and names of persons; marks never overlap, the
earlier kind wins. A name once found in a text is found wherever it stands there.

Runs of capitalised words that a text alone leaves undecided are decided by the
corpus: the runs with a cue of their own (seeded by forms of address, greetings,
signatures, labels) tell how often each word and each neighbouring word goes
with a person, and the log odds of both are added up.

Every entity gets a surrogate that depends on a key, its kind and its text:
digits for digits and letters for letters in the same script and case, names by
token so that a first name or surname alone stays with its person, first names
by the gender that a form of address tells. Where two entities of a text would
share a surrogate, or a surrogate stands in the text already, the next one of
the keyed sequence is taken; the sequence has no end, as surrogates grow longer
when those of one length run out. Initials only differ from each other and from
their original, since letters stand in every text.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import fresh, ref
from adloom.llm.finder import _KINDS_AFTER, _SPACES, _UP, PART, Entity, Scan, find, found_text
from adloom.session import stored

_PART = PART
_KIND_OF_STREET = rf"(?:{_KINDS_AFTER})\b\.?"


class Surrogates:
    """Keyed, type-consistent replacements within one text."""

    _STARTS = ("Al", "Be", "Ca", "Da", "El", "Fa", "Ga", "Ha", "Il", "Jo", "Ka", "Le", "Ma", "Ne", "Or", "Pa", "Ro", "Sa", "Te", "Va")
    _MIDDLES = ("bri", "dor", "fen", "gal", "lin", "mar", "nor", "ren", "sil", "tor", "ven", "wyn")
    _ENDS = {"f": ("a", "ia", "elle", "ine"), "m": ("us", "an", "or", "ek"), "": ("is", "en", "er", "el"), "l": ("ton", "ham", "sey", "wick", "more")}

    #: Tries at one length.
    TURNS = 64

    def __init__(self, key: bytes, text: str) -> None:
        self.key, self.text = key, text.lower()
        self.given: dict[tuple[str, str], str] = {}
        self.used: set[str] = set()
        self.initials: set[str] = set()

    def _bytes(self, kind: str, text: str, turn: int) -> bytes:
        return hmac.new(self.key, f"{kind}\x00{text}\x00{turn}".encode(), hashlib.sha256).digest()

    def distinct(self, kind: str, text: str, make) -> str:
        """The first surrogate of the keyed sequence that is neither used nor in the text.

        ``make`` gets keyed bytes and by how much the surrogate grows, one more after every ``TURNS``.
        """
        same = (kind, text)
        if same not in self.given:
            for turn in itertools.count():
                got = make(self._bytes(kind, text, turn), turn // self.TURNS)
                if got.lower() not in self.used and got.lower() not in self.text:
                    break
            self.used.add(got.lower())
            self.given[same] = got
        return self.given[same]

    def initial(self, letter: str) -> str:
        """Another letter for an initial, the next unused one; more letters where all are used."""
        same = ("initial", letter)
        if same not in self.given:
            start = self._bytes("initial", letter, 0)[0] % 26
            turned = [chr(65 + (start + k) % 26) for k in range(26)]
            for size in itertools.count(1):
                free = ("".join(c) for c in itertools.product(turned, repeat=size))
                got = next((c for c in free if c != letter and c not in self.initials), None)
                if got:
                    break
            self.initials.add(got)
            self.given[same] = got
        return self.given[same]

    def part(self, word: str, first: bool, gender: str) -> str:
        """A name part by token, in the case of the original; letters of other scripts stay in their script."""
        if not word.isascii() and not any("LATIN" in _script(c) for c in word):
            return self.distinct("person", word, lambda b, more: self.shaped(word + word[-1] * more, b))

        def make(b: bytes, more: int) -> str:
            ends = self._ENDS[gender if first else "l"] if first else self._ENDS["l"]
            return self._STARTS[b[0] % 20] + self._MIDDLES[b[1] % 12] + further(b, more + (not first)) + ends[b[2] % len(ends)]

        def further(b: bytes, more: int) -> str:
            return "".join(self._MIDDLES[b[(3 + k) % len(b)] % 12] for k in range(more))

        got = self.distinct("person", word.lower(), make)
        return got.upper() if word.isupper() and len(word) > 1 else got

    @staticmethod
    def shaped(text: str, b: bytes) -> str:
        """Digits for digits and letters for letters, everything else as it is; a zero in front stays."""
        out, k = [], 0
        front = next((c for c in text if c.isdigit()), "") == "0"
        for c in text:
            v = b[k % len(b)] + 31 * (k // len(b))
            if c.isdigit():
                out.append("0" if front else str(v % 10))
                front = False
            elif c.isascii() and c.isalpha():
                base = 65 if c.isupper() else 97
                out.append(chr(base + v % 26))
            elif c.isalpha():
                lo = ord(c) & ~0xF
                other = chr(lo + v % 16)
                out.append(other if other.isalpha() else c)
            else:
                out.append(c)
                k -= 1
            k += 1
        return "".join(out)

    def of(self, e: Entity) -> str:
        """The surrogate of an entity."""
        if e.kind == "person_name":
            turned = "," in e.text
            words = re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", e.text)
            links = {"van", "der", "den", "de", "von", "la", "bin", "binti", "al", "el", "da", "di", "ter"}

            def swap(m: re.Match) -> str:
                w = m.group()
                if w.lower() in links:
                    return w
                if len(w) == 1:
                    return self.initial(w)
                spot = words.index(w)
                first = len(words) > 1 and (spot == len(words) - 1 if turned else spot == 0)
                return self.part(w, first, e.gender)

            return re.sub(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", swap, e.text)
        if e.kind == "email":
            m = re.match(r"([\w.+\-]+)(\W*(?:at|AT)?\W*)(.+)", e.text, re.S)
            local, sign, domain = (m[1], m[2], m[3]) if m else (e.text, "", "")

            def make(b: bytes, more: int) -> str:
                tail = re.sub(r"[A-Za-z][\w\-]*", "inbox", domain, count=1)
                return self.shaped(local + "x" * more, b) + sign + tail

            return self.distinct("email", e.text.lower(), make)
        if e.kind == "phone":
            head = re.match(r"(?:\+|00)\d{1,3}", e.text)
            keep = head.group() if head else ""
            return self.distinct("phone", e.text, lambda b, more: keep + self.shaped(e.text[len(keep) :] + "1" * more, b))
        if e.kind == "address":

            def street(b: bytes, more: int) -> str:
                name = self._STARTS[b[5] % 20] + self._MIDDLES[b[6] % 12]
                # The first number grows; one is added where there is none.
                longer = re.sub(r"\d+|\Z", lambda m: (m.group() or " ") + "1" * more, e.text, count=1) if more else e.text
                moved = re.sub(r"\d+", lambda m: self.shaped(m.group(), b), longer)
                return re.sub(rf"(?<=[\s,])[{_UP}][\w'’\-]*(?=\s{_KIND_OF_STREET})", name, moved, count=1)

            return self.distinct("address", _SPACES.sub(" ", e.text.lower()), street)
        return self.distinct(e.kind, e.text, lambda b, more: self.shaped(e.text + "1" * more, b))


def _script(c: str) -> str:
    import unicodedata

    return unicodedata.name(c, "")


def _people(entities: list[Entity]) -> dict[int, tuple[str, ...]]:
    """By position: which person each name means; one name alone goes to the one full name that holds it."""
    parts = {e.start: [p.lower() for p in re.findall(_PART, e.text) if len(p) > 2] for e in entities if e.kind == "person_name"}
    full = {tuple(sorted(p)) for p in parts.values() if len(p) > 1}
    out = {}
    for at, p in parts.items():
        key = tuple(sorted(p))
        holders = [f for f in full if len(p) == 1 and p[0] in f]
        out[at] = holders[0] if len(holders) == 1 else key
    return out


def replaced(text: str | None, key: bytes, people: frozenset[str] = frozenset()) -> tuple[str | None, str | None, list[tuple[str, str, str]]]:
    """The text with placeholders, the text with surrogates, and ``(kind, found_text, surrogate)`` rows."""
    if not text:
        return text, text, []
    entities = find(text, people)
    maker = Surrogates(key, text)
    people = _people(entities)
    numbers: dict[tuple[str, object], int] = {}
    per_kind: dict[str, int] = {}
    marked, faked, rows, at = [], [], [], 0
    for e in entities:
        same = (e.kind, people.get(e.start) or _SPACES.sub(" ", e.text).casefold())
        if same not in numbers:
            per_kind[e.kind] = per_kind.get(e.kind, 0) + 1
            numbers[same] = per_kind[e.kind]
        fake = maker.of(e)
        plain = text[at : e.start]
        marked += [plain, f"[{e.kind.upper()}_{numbers[same]}]"]
        faked += [plain, fake]
        rows.append((e.kind, found_text(e), fake))
        at = e.end
    return "".join(marked) + text[at:], "".join(faked) + text[at:], rows


_ROW = "array<struct<pii_kind: string, found_text: string>>"
_RUNS = "array<struct<said: string, label: int, before: string, after: string>>"
_SCANNED = pa.struct(
    [
        ("found", pa.list_(pa.struct([("pii_kind", pa.string()), ("found_text", pa.string())]))),
        ("runs", pa.list_(pa.struct([("said", pa.string()), ("label", pa.int32()), ("before", pa.string()), ("after", pa.string())]))),
    ]
)


def _lists(rows: list[tuple], ends: list[int], kind: pa.ListType) -> pa.ListArray:
    """An array of lists of structs, column by column."""
    fields = list(kind.value_type)
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind)


def scanned(text: Column) -> Column:
    """Struct of the distinct entities of a text by itself and of its runs of capitalised words with their labels."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, runs, f_at, r_at = [], [], [0], [0]
            for t in batch.to_pylist():
                scan = Scan(t)
                found += dict.fromkeys((e.kind, found_text(e)) for e in scan.entities)
                runs += dict.fromkeys((r.text, r.label, r.before, r.after) for r in scan.runs)
                f_at.append(len(found))
                r_at.append(len(runs))
            yield pa.StructArray.from_arrays(
                [_lists(found, f_at, _SCANNED.field("found").type), _lists(runs, r_at, _SCANNED.field("runs").type)], fields=list(_SCANNED)
            )

    # Searched once: the optimizer may not repeat it where parts of the result are asked for.
    return F.arrow_udf(run, f"struct<found: {_ROW}, runs: {_RUNS}>").asNondeterministic()(text)


#: Occurrences that every word and surrounding is given beforehand, at the rate of the corpus.
PRIOR = 0.5
#: Log odds from which an undecided run is a person's name.
NAME = 1.0


def corpus_names(runs: DataFrame) -> DataFrame:
    """``(doc, said)`` of the undecided runs that the corpus takes for persons' names.

    ``runs`` has ``(doc, said, label, before, after)``. Every word of a run, the
    words before it and the word after it are evidence: how much more often than
    on the whole they go with runs labelled as persons. Undecided runs stand for
    what is no person, so a surrounding with many known names among them speaks
    for the rest: words are weighed by labels, surroundings by the words known there.
    """
    undecided = F.col("label").isNull()
    # Same runs in the same surroundings count once with their number.
    kinds = stored(runs.groupBy("said", "label", "before", "after").agg(F.count("*").alias("n"))).withColumn("yes", F.coalesce("label", F.lit(0)))
    words = F.array_distinct(F.filter(F.split(F.lower("said"), r"[\s,]+"), lambda w: F.length(w) > 2))
    spoken = kinds.withColumn("word", F.explode(words))
    by_word = spoken.groupBy("word").agg(F.sum(F.col("n") * F.col("yes")).alias("y"), F.sum(F.col("n") * (1 - F.col("yes"))).alias("o"))
    # What is known of a run by its words alone; null where no word is known as a name's or as another's.
    odds = F.log((F.col("y") + PRIOR) / (F.col("o") + PRIOR))
    asked = kinds.filter(undecided).select("said").distinct()
    by_run = (
        asked.withColumn("word", F.explode(words))
        .join(by_word, "word")
        .groupBy("said")
        # An undecided run adds itself to the others; a word seen nowhere else says nothing.
        .agg(F.sum(F.when(F.col("y") + F.col("o") > 1, odds).otherwise(0.0)).alias("odds"))
    )
    judged = stored(
        kinds.filter(undecided)
        .join(by_run, "said", "left")
        .select("said", "before", "after", "n", F.coalesce("odds", F.lit(0.0)).alias("odds"))
    )
    # Surroundings of undecided runs: how many of them hold known names.
    sure_yes, sure_no = F.col("odds") > 1.0, F.col("odds") < -1.0
    side = judged.select(
        F.explode(F.array(F.concat(F.lit("<"), F.col("before")), F.concat(F.lit(">"), F.col("after")), F.concat_ws(" _ ", "before", "after"))).alias("side"),
        F.when(sure_yes, F.col("n")).otherwise(0).alias("y"),
        F.when(sure_no, F.col("n")).otherwise(0).alias("o"),
    )
    by_side = side.groupBy("side").agg(F.sum("y").alias("y"), F.sum("o").alias("o"))
    near = F.log((F.col("y") + PRIOR) / (F.col("o") + PRIOR))
    both = judged.withColumn("side", F.concat_ws(" _ ", "before", "after")).join(
        by_side.select("side", near.alias("near")), "side", "left"
    )
    left = by_side.select(F.col("side").alias("lead"), near.alias("ahead"))
    names = (
        both.withColumn("lead", F.concat(F.lit("<"), F.col("before")))
        .join(left, "lead", "left")
        .filter(F.col("odds") + (F.coalesce("near", F.lit(0.0)) + F.coalesce("ahead", F.lit(0.0))) / 2 > NAME)
        .select("said", "before", "after")
    )
    return runs.filter(undecided).join(names, ["said", "before", "after"], "left_semi").select("doc", "said").distinct()


def _with_people(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned documents ``(doc_id, found, runs)``, stored, and ``(doc_id, people)`` of those with names by the corpus."""
    own = stored(documents.select("doc_id", scanned(F.col("text")).alias("_s")).select("doc_id", "_s.found", "_s.runs"))
    runs = own.select(F.col("doc_id").alias("doc"), F.explode("runs").alias("_r")).select("doc", "_r.*")
    people = corpus_names(runs).groupBy("doc").agg(F.collect_set("said").alias("people"))
    return own, people.select(F.col("doc").alias("doc_id"), "people")


_SCHEMA = "redacted string, surrogate string, found array<struct<pii_kind: string, found_text: string, surrogate: string>>"
_ARROW = pa.struct(
    [
        ("redacted", pa.string()),
        ("surrogate", pa.string()),
        ("found", pa.list_(pa.struct([("pii_kind", pa.string()), ("found_text", pa.string()), ("surrogate", pa.string())]))),
    ]
)


def with_personal(df: DataFrame, key: str, text: str = "text", out: str = "personal", people: str | None = None) -> DataFrame:
    """Add ``out``: struct of the redacted text, the surrogate text and what was found.

    Placeholders are ``[KIND_n]``, numbered within the text; equal entities share
    a number, and so does a person named in full and by one name. Null and empty
    texts come out as they are with nothing found. Whole texts are searched,
    however long; extra columns are kept. ``key`` decides the surrogates and must
    be kept secret: who knows it can test guesses of the originals. ``people``
    names a column of full names known otherwise.
    """
    if not key:
        raise ValueError("surrogates need a key")
    secret = key.encode()

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, names in batches:
            rows = []
            for t, known in zip(texts.to_pylist(), names.to_pylist()):
                redacted, surrogate, found = replaced(t, secret, frozenset(known or ()))
                rows.append(
                    {
                        "redacted": redacted,
                        "surrogate": surrogate,
                        "found": [dict(zip(("pii_kind", "found_text", "surrogate"), r)) for r in found],
                    }
                )
            yield pa.array(rows, _ARROW)

    search = F.arrow_udf(run, _SCHEMA).asNondeterministic()
    known = ref(people) if people else F.array().cast("array<string>")
    return df.withColumn(fresh(df, out), search(ref(text), known))


def personal_found(documents: DataFrame) -> DataFrame:
    """``(doc_id, pii_kind, found_text)`` of every entity, no row twice."""
    own, people = _with_people(documents)
    alone = own.join(people, "doc_id", "left_anti").select("doc_id", "found")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, names in batches:
            yield pa.array(
                [
                    [{"pii_kind": e.kind, "found_text": found_text(e)} for e in find(t, frozenset(known))]
                    for t, known in zip(texts.to_pylist(), names.to_pylist())
                ],
                _SCANNED.field("found").type,
            )

    again = documents.select("doc_id", "text").join(people, "doc_id")
    told = again.select("doc_id", F.arrow_udf(run, _ROW).asNondeterministic()(F.col("text"), F.col("people")).alias("found"))
    return alone.unionByName(told).select("doc_id", F.explode("found").alias("_f")).select("doc_id", "_f.*").distinct()


def readable_texts(documents: DataFrame, key: str) -> DataFrame:
    """``(doc_id, redacted, surrogate, n_found)`` of every document."""
    _, people = _with_people(documents)
    asked = documents.select("doc_id", "text").join(people, "doc_id", "left")
    marked = with_personal(asked, key, people="people")
    return marked.select("doc_id", "personal.redacted", "personal.surrogate", F.size("personal.found").alias("n_found"))
