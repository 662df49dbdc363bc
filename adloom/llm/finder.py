"""Finds personal information in a text: patterns with checksums, an address grammar, and names by evidence.

Names are runs of capitalised words. What stands around a run says how sure it
is: a form of address, a greeting or closing, a label or noun for a person, a
verb of speaking, a way to reach somebody. Runs without such a cue come out as
undecided, with the words beside them; :mod:`adloom.llm.personal` decides them
by what the whole corpus knows of their words and surroundings.

A text is scanned once for capitalised runs and once for digits; everything
else looks only where one of those, an ``@`` or a street word stands.
"""

from __future__ import annotations

import re

KINDS = ("email", "id_number", "phone", "address", "person_name")

# ---------------------------------------------------------------- e-mail addresses

_AT = re.compile(r"\s?@\s?|\s?[\[(](?:at|AT)[\])]\s?")
_LOCAL = re.compile(r"[\w][\w.+\-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[\w\-]*\w)?(?:(?:\.|\s?[\[(](?:dot|DOT)[\])]\s?)[A-Za-z0-9](?:[\w\-]*\w)?)+(?![\w@])")
_NO_LOCAL = re.compile(r"[^\w.+\-]")

# ---------------------------------------------------------------- identity numbers

# Names of identity numbers.
_ID_LABEL = (
    r"(?:NRIC|FIN|NIC|IC|MyKad|[Pp]assport|[Pp]ass(?:nummer)?|[Pp]ersonalausweis|[Rr]eisepass|[Aa]usweis|[Nn]ational\s+ID|NI|NINO|SIN|SSN|TFN|PAN|"
    r"CPF|DNI|NIE|NIF|CURP|BSN|INSEE|NIR|[Aa]adhaar|[Ss]ocial\s+[Ss]ecurity|[Nn]ational\s+[Ii]nsurance|[Ii]dentity|ID|"
    r"[Dd]riving\s+licen[cs]e|[Dd]river(?:'s|s)?\s+licen[cs]e|[Tt]ax\s+(?:ID|file))"
)
_ID_REST = r"(?:[\s-]+(?:document|card|number|nummer|no|nr|num)\b\.?)*"
_ID_VALUE = re.compile(r"[A-Za-z0-9]+(?:[ .\-/]?[A-Za-z0-9]*\d[A-Za-z0-9]*)*(?: [A-Z](?![A-Za-z]))?")
_ID_LABELLED = re.compile(rf"\b{_ID_LABEL}{_ID_REST}(?:\s+(?:is|was|ist|lautet|adalah)\b)?\s*[:#]?\s*\Z")
_DIGITS = re.compile(r"\d+")
_LETTERS_BEFORE = re.compile(r"(?:(?<![\w.\-/+])[A-Za-z]{1,6}|(?<![\w.\-/+])[A-Z]{2} )\Z")
# A token or spaced group that may be an identity number without a label.
_ID_BARE = re.compile(
    r"(?<![\w.\-/+])(?:[STFGM]\d{7}[A-Z]|\d{9}[VXvx]|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{6}-\d{2}-\d{4}|\d{3}-\d{2}-\d{4}|[2-9]\d{3} \d{4} \d{4}"
    r"|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ\d]\d{7}[A-Z]|[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z])(?![\w-])"
)


def _nric(v: str) -> bool:
    total = sum(int(d) * w for d, w in zip(v[1:8], (2, 7, 6, 5, 4, 3, 2)))
    total += {"T": 4, "G": 4, "M": 3}.get(v[0], 0)
    letters = {"S": "JZIHGFEDCBA", "T": "JZIHGFEDCBA", "F": "XWUTRQPNMLK", "G": "XWUTRQPNMLK", "M": "KLJNPQRTUWX"}[v[0]]
    return v[8] == letters[total % 11]


def _cpf(v: str) -> bool:
    d = [int(c) for c in v if c.isdigit()]
    one = sum(x * w for x, w in zip(d, range(10, 1, -1))) * 10 % 11 % 10
    two = sum(x * w for x, w in zip(d, range(11, 1, -1))) * 10 % 11 % 10
    return len(set(d)) > 1 and d[9:] == [one, two]


def _verhoeff(v: str) -> bool:
    """The check digit of the dihedral group of the pentagon, from its multiplication rule."""

    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    turn = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    check = 0
    for k, c in enumerate(reversed(v.replace(" ", ""))):
        d = int(c)
        for _ in range(k % 8):
            d = turn[d]
        check = times(check, d)
    return check == 0


def _born(year: str, day: str) -> bool:
    return 1 <= int(day) % 500 <= 366


def _bare_id(v: str) -> bool:
    """A value without a label is an identity number only if its check digit or its date says so."""
    if re.fullmatch(r"[STFGM]\d{7}[A-Z]", v):
        return _nric(v)
    if re.fullmatch(r"\d{9}[VXvx]", v):
        return _born(v[:2], v[2:5])
    if "." in v:
        return _cpf(v)
    if re.fullmatch(r"\d{6}-\d{2}-\d{4}", v):
        return 1 <= int(v[2:4]) <= 12 and 1 <= int(v[4:6]) <= 31
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", v):
        return v[:3] not in ("000", "666") and v[:1] != "9" and v[4:6] != "00" and v[7:] != "0000"
    if re.fullmatch(r"\d{4} \d{4} \d{4}", v):
        return _verhoeff(v)
    if re.fullmatch(r"[XYZ\d]\d{7}[A-Z]", v):
        return v[8] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(str("XYZ".find(v[0]) if v[0] in "XYZ" else v[0]) + v[1:8]) % 23]
    # The layouts left have letters in places of their own.
    return True


# ---------------------------------------------------------------- phone numbers

_GAP = "[ \\t\xa0\u2009\u202f./\\-]?"
_PHONE = re.compile(
    rf"(?<![\w.@/\-+])(?:(?:\+|00)\d{{1,3}}{_GAP}(?:\(0?\d{{0,4}}\){_GAP})?\d(?:{_GAP}\d){{5,11}}"
    r"|\(\d{3}\)[ \t\xa0]?\d{3}[-. \xa0]\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}"
    "|\\(0\\d{1,4}\\)[ \\t\xa0\u2009\u202f/\\-]?\\d(?:[ \\t\xa0\u2009\u202f\\-]?\\d){5,8}"
    "|0\\d{1,4}[ \\t\xa0\u2009\u202f/\\-]\\d(?:[ \\t\xa0\u2009\u202f\\-]?\\d){5,8}|0\\d{9,10})(?![\\w\\-]|[./]\\d)"
)
_PHONE_LABEL = re.compile(
    r"(?:\b(?:tel(?:ephone|efon)?|phone|mobile|mob|cell|call|fax|handy|hp|whatsapp|ring|dial|t|m)\b\.?\s*(?:no\.?|number|me|us|on|at)?\s*[:.]?\s*|☎\s*|📞\s*)\Z", re.I
)
_LABELLED_PHONE = re.compile(rf"\(?\d(?:{_GAP}[()]?\d){{6,14}}(?![\w\-]|[./]\d)")
# Nouns for what other numbers count or name; they stand directly before the number.
_NO_PHONE = re.compile(
    r"(?:\b(?:rows?|tickets?|orders?|builds?|versions?|codes?|cent(?:re|er)|checksum|ref(?:erence)?|kennziffer|jobs?|invoices?|records?|accounts?|"
    r"page|line|id|serial|batch|case|item|sku|port|pid)\s*(?:no\.?|number|:|#)?\s*|#|[A-Z]{2}-)\Z",
    re.I,
)

# ---------------------------------------------------------------- words and names

_UP = "A-ZÀ-ÖØ-ÞŁŚŻŹŠŽČĆĐŃŐŰİŞĞŘŤĎŇĽĀĒĪŌŪ"
_B = r"[^\S\r\n]+"
#: One part of a name: starts with a capital, may hold hyphens and apostrophes.
PART = rf"[{_UP}](?:['’][{_UP}])?[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_INIT = rf"[{_UP}]\."
_LINK = r"(?:van der|van den|van de|van|von der|von|de la|de|da|di|dos|del|bin|binti|bte|al|el|ter|Van der|VAN DER|Ó|Ní|Mac)"
_WORD = re.compile(rf"(?<![\w@.\-_/])(?:{PART}|{_INIT})(?![\w@])")
# Words that link the parts of a name; in capitals they look like parts.
_LINK_WORDS = frozenset("van der den de von la da di dos del bin binti bte al el ter".split())
# A run is parts and initials joined by blanks and links; "Last, First" is one run as well.
_LINKED = re.compile(rf"{_B}(?:{_LINK}{_B})*|,{_B}")
_PART = re.compile(PART)
_LINK_BEFORE = re.compile(rf"(?<!\w)(?:{_LINK}{_B})+\Z")

# Forms of address, with the gender they tell.
FORMS = {
    "mr": "m", "herr": "m", "herrn": "m", "encik": "m", "tuan": "m", "sir": "m", "señor": "m", "monsieur": "m",
    "ms": "f", "mrs": "f", "miss": "f", "frau": "f", "puan": "f", "cik": "f", "madam": "f", "señora": "f", "madame": "f",
    "dr": "", "prof": "", "professor": "", "ir": "",
}
_GREETINGS = frozenset("dear hi hello hey hallo hai salam liebe lieber kepada hola bonjour selamat".split())
# Nouns for a person at work or at home; a name may follow them.
_PERSONS = frozenset(
    "candidate applicant interviewer interviewee recruiter manager colleague director supervisor referee mentor boss coordinator "
    "representative assistant secretary consultant officer contact employee worker trainee intern friend wife husband daughter son mother "
    "father sister brother cousin partner teacher professor nurse doctor author founder owner president chairman chairwoman spokesperson "
    "spokesman spokeswoman bewerber bewerberin kollege kollegin leiter leiterin ansprechpartner ansprechpartnerin calon penyelia rakan "
    "neighbour neighbor landlord tenant guest patient client customer attendee".split()
)
# Labels before a colon whose value is a person.
_LABELS = frozenset(
    "name names contact person interviewer interviewers candidate applicant recruiter manager from to cc bcc attn attention author "
    "owner referee reference signed by sender recipient supervisor reviewer approver assignee reporter organiser organizer host speaker "
    "ansprechpartner ansprechpartnerin bewerber hubungi nama colleague guest emergency".split()
)
# Words (one or two) after which a person is named.
_BEFORE = frozenset(
    "ask for,asked for,spoke to,spoke with,speak to,speak with,spoken to,talk to,talked to,talking to,talked with,interview with,"
    "interviewed by,interviewed,meeting with,met with,met,meet with,call with,screening call,referred by,recommended by,introduced by,"
    "introduced,signed by,written by,prepared by,reviewed by,approved by,reported by,managed by,led by,chaired by,hired,sent by,name is,"
    "i am,i'm,this is,called,contact,reach,write to,report to,reports to,reporting to,thanks to,thank,email,emailed,ring,phoned,invited,"
    "message,ping,told,gespräch mit,bewerbung von,ich bin,ich heiße,ist,frag,nama saya,saya,daripada,hubungi,chat with,working with,works with,worked with,lunch with,dinner with,wish,congratulate,"
    "greet,promoted,regards to,according to,on behalf of,behalf of,welcome,joined by,cover for,replace,replaced by,backup is".split(",")
)
# What persons do; a full name before one of these is a person's.
_AFTER = re.compile(
    r"(?:'s|’s)?,?\s+(?:\([^()\n]{0,40}\)\s+)?(?:has\s+|had\s+|also\s+|then\s+|just\s+|will\s+|would\s+|can\s+|may\s+|kindly\s+|and I\s+)?"
    r"(?:wrote|writes|write|said|says|joined|joins|join|leads|led|lead|leading|called|calls|asked|asks|ask|confirmed|confirms|replied|replies|"
    r"agreed|agrees|sent|sends|reviewed|reviews|presented|mentioned|told|tells|thinks|thought|knows|spoke|speaks|left|started|starts|resigned|"
    r"accepted|declined|rejected|interviewed|interviews|emailed|phoned|rang|met|meets|apply|applied|applies|reports|reported|introduced|attended|"
    r"chaired|signed|approved|suggested|recommended|explained|noted|added|moved|lives|lived|works|worked|studied|graduated|retired|manages|"
    r"managed|hosts|hosted|visited|travelled|married|born|himself|herself|schrieb|sagte|fragte|rief|hat|memohon|berkata)\b"
)
_AFTER_COMMA = re.compile(r",\s+(?:referred|our|my|your|the|his|her|their|an?|who|whom|whose|aged|born|head|chief|currently|formerly|based|[a-z]+ed by)\b")
_REACH_AFTER = re.compile(r"\s*[(<\[,–-]?\s*(?:(?:at|on|under|via|tel|phone|mobile|ext|aged?)\b\.?:?\s*)?(?:[+(]?\d[\d\s()./\-]{6,}|[\w.+\-]+\s?(?:@|[\[(]at[\])]))")
_CLOSING = re.compile(
    r"[\W\d]*(?:(?:kind(?:est)?|best|warm(?:est)?|with kind|with best)\s+(?:regards|wishes)|regards|many thanks|thanks(?: again)?|thank you(?: very much)?|cheers|(?:yours|best|all the best|"
    r"yours? (?:sincerely|faithfully|truly))|sincerely(?: yours)?|respectfully|cordially|viele grüße|beste grüße|liebe grüße|"
    r"mit freundlichen grüßen|freundliche grüße|mfg|lg|terima kasih|sekian(?:, terima kasih)?|salam hormat|yang benar|saludos|cordialement|atentamente)\s*[,.!]?\s*",
    re.I,
)
_REACH = re.compile(r"\s*(?:☎|📞|(?:T|Tel|Mobile|Mob|Phone|Handy|HP|M|P|E|Email|E-mail|Mail|Fax|Cell)\b\.?:?\s*[+(\d\w]|\+\d|\(\d|0\d{2,}|\d{3}[-.]\d{3}|\S+\s?(?:@|[\[(]at[\])])\s?\S+\.\S+)")
_WAYS = re.compile(rf"{_REACH.pattern}|\s*(?:(?:Blk|Block|Lot|Plot|Flat|Unit|No\.|Apt\.?|\d+[-/]?\d*,?\s[{_UP}])\s?\w|[{_UP}]\S+(?:straße|strasse|str\.|allee|weg|gasse|platz|ufer|ring|damm|markt|hof|steig)\s\d|(?:Am|An der|Im|Zum|Zur|Jalan|Lorong)\s)")

# Capitalised words that are no part of a person's name.
NOT_NAMES = frozenset(
    "yesterday today tomorrow now later recently finally meanwhile however although because therefore also only even both either other some "
    "the we our you your this that these those my his her its their i he she it they a an and or but if when while where who what which why how "
    "in on at to for from by of with without within after before between during since until about above below under over as so then than there "
    "here not no nor yes do does did is are was were be been has have had will would can could should may might must shall let please thanks "
    "thank you regards cheers best kind warm sincerely yours dear hello hi hey hallo friday monday tuesday wednesday thursday saturday sunday "
    "january february march april june july august september october november december mobile tel phone fax email mail address name sir madam "
    "all everyone colleagues team hiring candidate applicant interviews interview questions question keep write work support budget most some "
    "nobody every each last next first order ticket tax checked call ping install see meet ask send join apply own pair monitor build design "
    "extend profile document review answer join help learn use run test new old der die das den dem des ein eine und oder mit von zu im am um "
    "auf für bei nach aus über unter damen herren sie wir ich ihr du unser unsere saya kami anda dan atau untuk dengan yang ini itu kepada "
    "office street road avenue lane group department desk crew unit guild board grüße viele beste liebe bewerbung von ref parcels screening spoke between nobody benefits requirements "
    "responsibilities experience salary package remote hybrid full part time job role position location reference degree knowledge health "
    "learning meals note notes subject re fwd cc bcc date time page room row version build".split()
)
_FIRM = (
    r"(?:Pte|Pvt|\(Pvt\)|Sdn|GmbH|AG|Ltd|Limited|Inc|LLC|LLP|PLC|Plc|SARL|BV|Co|Corp|Corporation|Company|Group|Labs|Laboratories|Analytics|Networks|"
    r"Digital|Studios?|Systems|Technologies|Technology|Software|Consulting|Consultants|Staffing|Solutions|Holdings|Bank|Insurance|University|College|"
    r"School|Hospital|Hotel|Partners|Associates|Services|Industries|International|Recruitment|Agency|Institute|Foundation|Ministry|Council)"
)
_FIRM_AFTER = re.compile(rf"\s*(?:&\s+[{_UP}]|(?:[{_UP}][\w-]+\s+)?{_FIRM}\b)")
_FIRM_WORD = re.compile(rf"(?<=.)\b(?:{_FIRM}|Bhd)\b")
_SPACES = re.compile(r"\s+")

_LETTERS = re.compile(r"[^\W\d_]+(?=[^\w]*\Z)")
_GREETED = re.compile(r"\s*(?:[,!:.\r\n]|\Z|and\b|und\b|dan\b)")
_NAMED = re.compile(r"\s*(?:[,.;!?)(]|\Z|[\r\n])")
_NEXT = re.compile(r"\s*(\w+|[^\w\s])?")
_LINE_END = re.compile(r"[^\S\r\n]*(?:[\r\n]+|\Z)")
_ONLY_FORMS = re.compile(rf"[\W\d]*(?:(?:{'|'.join(FORMS)})\b\.?\s*)*", re.I)
_AGAIN = re.compile(rf"{_B}(?:{_INIT}{_B})*(?:{_LINK}{_B})?|,{_B}")
_LEAD_INIT = re.compile(rf"(?<!\w){_INIT}{_B}\Z")
_REACHED = frozenset("to reach contact with call see".split())
# A place or a thing stands after these words, not a person.
_PLACED = frozenset("in at near of the our your a an into using on every this that".split())

# ---------------------------------------------------------------- addresses, from parts

# Words for kinds of street, after and before the name, and endings of compound names.
_KINDS_AFTER = (
    "Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Close|Cl|Mawatha|Mw|Blvd|Boulevard|Drive|Dr|Parade|Pde|Crescent|Cres|Court|Ct|Way|"
    "Terrace|Tce|Place|Pl|Gardens|Square|Sq|Walk|Row|Grove|Rise|Highway|Hwy|Quay|Cross|Main|Layout|Nagar|Colony|Extension|Stage|Enclave|Marg"
)
_KINDS_BEFORE = (
    "Jalan|Jln|Lorong|Persiaran|Lebuh|Rue|rue|Avenue|Boulevard|Quai|Via|Viale|Piazza|Corso|Calle|Avenida|Av|Plaza|Paseo|Rua|Travessa|Praça|"
    "Am|An der|Im|Zum|Zur|Auf der|Unter den"
)
_ENDINGS = "straße|strasse|str\\.|allee|weg|gasse|platz|ufer|ring|damm|markt|hof|steig|straat|laan|gatan|vej"
_STREET_WORDS = frozenset(w.split()[0] for w in f"{_KINDS_AFTER}|{_KINDS_BEFORE}".split("|"))
_STREET_ENDS = tuple(_ENDINGS.replace("\\.", "").split("|"))
_N = rf"[{_UP}][\w'’\-]*"
_NUM = r"\d+(?:/\d+)?\s?[A-Za-z]?(?:[-/]\d+[A-Za-z]?)*(?!\w)"
_UNIT = r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Level|Floor|Block|Blk|Lot|Plot|Door|Site|House|H\.?\s?No\.?|No\.?|Nr\.?)\s+?(?:No\.?\s?)?#?\w[\w\-/]*|#\d+-\d+\w?|No\.?\s?\d[\w\-/]*)"
_STREET_A = rf"(?:(?:{_N}|\d+(?:st|nd|rd|th)){_B}){{1,4}}?(?:{_KINDS_AFTER})\b\.?(?!{_B}(?:{_KINDS_AFTER})\b)"
_STREET_B = rf"(?:{_KINDS_BEFORE})\b\.?{_B}(?:(?:de|da|do|la|le|du|des|del|della|dos|das|d'|l'|los|las)[^\S\r\n]?)*{_N}(?:{_B}(?:(?:de|da|do|la|du|des|del|della){_B})?{_N}){{0,3}}(?:{_B}\d+(?:/\d+)?[A-Z]?)?"
_STREET_C = rf"(?:[{_UP}][\wäöüß]*-)*[{_UP}][\wäöüß]*(?:{_ENDINGS})(?![a-zäöüß])"
_PRE = rf"(?:{_UNIT}(?:,\s+|{_B}))"
_LINE = (
    rf"(?:{_PRE}*{_NUM}(?:,\s+|{_B})(?:{_STREET_A}|{_STREET_B})|{_PRE}+(?:{_STREET_A}|{_STREET_B})|(?:{_STREET_B})(?:,\s+|{_B}){_NUM}|{_STREET_B}"
    rf"|(?:{_STREET_C}){_B}{_NUM})"
)
_TOWN = rf"(?:St\.\s)?[{_UP}][\w'’]+(?:[ \xa0-](?:(?:upon|on|am|an der|de|la|le|sur)[ -])?[{_UP}][\w'’]+){{0,2}}"
_STATE = r"(?:NSW|VIC|QLD|SA|WA|TAS|ACT|NT|ON|QC|BC|AB|MB|SK|NS|NB|NL|PE|[A-Z]{2})"
_POST = r"(?:\d{4}-\d{3}|[A-Z]\d[A-Z]\s?\d[A-Z]\d|[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}|\d{5}-\d{3,4}|\d{4,6}|\d{3}\s\d{2})(?!\w)"
_SURE_END = rf"{_POST}\s+{_TOWN}|{_TOWN},?\s+{_STATE}\s+{_POST}|{_TOWN},?\s+{_POST}"
# Without a comma a town counts only beside its postcode.
_END = rf"(?:,\s+(?:{_SURE_END}|{_TOWN}{_B}\d{{1,2}}(?!\d|[\w:/.]\w)|{_POST}|{_TOWN})|{_B}(?:{_SURE_END}))"
_ADDRESS = re.compile(
    rf"(?<![\w/#\-])(?P<v>{_LINE}(?:,?\s+#\d+-\d+\w?)?(?:,\s+(?:{_STREET_A}))?(?:,\s+(?:{_UNIT}))?(?P<t>{_END}))(?!\w)"
)
_ADDRESS_START = re.compile(rf"(?<![\w/#\-])(?:{_UNIT}|{_NUM}|(?:{_KINDS_BEFORE})\b|{_N})")
#: Characters that the part of an address before its first street word can take.
_LEAD = 64


class Entity:
    """A found piece of personal information."""

    __slots__ = ("end", "gender", "kind", "start", "text")

    def __init__(self, kind: str, start: int, end: int, text: str, gender: str = "") -> None:
        self.kind, self.start, self.end, self.text, self.gender = kind, start, end, text, gender


class Run:
    """Capitalised words that may name a person: ``label`` 1 yes, 0 no, None undecided."""

    __slots__ = ("after", "before", "end", "label", "start", "text")

    def __init__(self, start: int, end: int, text: str, label: int | None, before: str, after: str) -> None:
        self.start, self.end, self.text, self.label, self.before, self.after = start, end, text, label, before, after


def name_parts(text: str) -> list[str]:
    """The parts of a name in lower case, initials and links aside."""
    return [p for p in map(str.lower, _PART.findall(text)) if p not in _LINK_WORDS]


def _shaped_like_a_name(text: str) -> bool:
    parts = name_parts(text)
    if not parts or any(p in NOT_NAMES for p in parts):
        return False
    # No name is a run of one or two letters.
    return all(len(p) < 4 or len(set(p)) > 2 for p in parts)


class Scan:
    """All that one text says by itself: entities, and the runs with what is known of them."""

    def __init__(self, text: str | None, people: frozenset[str] | set[str] = frozenset()) -> None:
        self.text = text or ""
        self.entities: list[Entity] = []
        self.runs: list[Run] = []
        if not self.text:
            return
        self._taken = bytearray(len(self.text))
        self._emails()
        words = [m.span() for m in _WORD.finditer(self.text)]
        digits = [m.span() for m in _DIGITS.finditer(self.text)]
        if digits:
            self._identity_numbers(digits)
            self._addresses(words)
            self._phones(digits)
        self._names(words, people)
        self.entities.sort(key=lambda e: e.start)

    def _free(self, start: int, end: int) -> bool:
        return self._taken.find(1, start, end) < 0

    def _add(self, kind: str, start: int, end: int, gender: str = "") -> bool:
        while end > start and self.text[end - 1].isspace():
            end -= 1
        if end <= start or not self._free(start, end):
            return False
        self._taken[start:end] = b"\x01" * (end - start)
        self.entities.append(Entity(kind, start, end, self.text[start:end], gender))
        return True

    def _emails(self) -> None:
        t = self.text
        if "@" not in t and "[at]" not in t and "(at)" not in t and "[AT]" not in t and "(AT)" not in t:
            return
        for m in _AT.finditer(t):
            start = m.start()
            while start and (t[start - 1].isalnum() or t[start - 1] in "_.+-"):
                start -= 1
            # The local part begins with a letter, digit or line.
            while start < m.start() and not (t[start].isalnum() or t[start] == "_"):
                start += 1
            tail = _DOMAIN.match(t, m.end()) if start < m.start() and t[start - 1 : start] != "@" else None
            if tail:
                self._add("email", start, tail.end())

    def _line(self, at: int, most: int) -> str:
        """What stands before ``at`` on its line, ``most`` characters of it."""
        t = self.text
        return t[max(t.rfind("\n", 0, at) + 1, t.rfind("\r", 0, at) + 1, at - most) : at]

    def _identity_numbers(self, digits: list[tuple[int, int]]) -> None:
        t, done = self.text, 0
        for at, _ in digits:
            if at < done:
                continue
            lead = _LETTERS_BEFORE.search(t, max(0, at - 7), at)
            starts = [lead.start(), at] if lead else [at]
            for start in starts:
                if start and (t[start - 1].isalnum() or t[start - 1] in "_.-/+"):
                    continue
                if _ID_LABELLED.search(t, max(0, start - 40), start):
                    v = _ID_VALUE.match(t, start)
                    if v and len(v.group()) >= 6 and sum(c.isdigit() for c in v.group()) >= 4 and t[v.end() : v.end() + 1] != "-":
                        self._add("id_number", v.start(), v.end())
                        done = v.end()
                        break
                m = _ID_BARE.match(t, start)
                if m and _bare_id(m.group()):
                    self._add("id_number", m.start(), m.end())
                    done = m.end()
                    break

    def _addresses(self, words: list[tuple[int, int]]) -> None:
        t, done = self.text, 0
        for a, b in words:
            if a < done:
                continue
            w = t[a:b]
            if w not in _STREET_WORDS and not w.endswith(_STREET_ENDS):
                continue
            at = max(done, a - _LEAD, 0)
            while at <= a:
                s = _ADDRESS_START.search(t, at, b)
                if not s:
                    break
                m = _ADDRESS.match(t, s.start())
                # An address holds a number: of the house, the unit or the district.
                if m and m.end() > a:
                    start, end = m.span("v")
                    if any(c.isdigit() for c in t[start : m.start("t")]) or re.search(r"\d{4}", m["t"]):
                        self._add("address", start, end)
                        done = end
                        break
                at = s.start() + 1

    def _phones(self, digits: list[tuple[int, int]]) -> None:
        t, done = self.text, 0
        for at, _ in digits:
            if at < done:
                continue
            while at and t[at - 1] in "+(" and at - 1 >= done:
                at -= 1
            m = _PHONE.match(t, at)
            if not (m and 7 <= sum(map(str.isdigit, m.group())) <= 15 and not _NO_PHONE.search(self._line(at, 32))):
                before = self._line(at, 32)
                m = _LABELLED_PHONE.match(t, at) if before[-1:] not in "@./-+" or not before else None
                if not (m and 7 <= sum(map(str.isdigit, m.group())) <= 15 and _PHONE_LABEL.search(before)):
                    continue
            self._add("phone", m.start(), m.end())
            done = m.end()

    # ------------------------------------------------------------ names

    def _names(self, words: list[tuple[int, int]], people: frozenset[str] | set[str]) -> None:
        t = self.text
        known: dict[str, str] = {}
        pending: list[tuple[int, int]] = []
        run: list[tuple[int, int]] = []
        for word in words:
            if run:
                gap = t[run[-1][1] : word[0]]
                if gap == " " or (len(gap) < 16 and gap[:1] in " \t\xa0\u2009\u202f," and _LINKED.fullmatch(gap) and not (gap[0] == "," and t[run[-1][1] - 1] == ".")):
                    run.append(word)
                    continue
                pending.extend(self._of_run(run, known, people))
            run = [word]
        if run:
            pending.extend(self._of_run(run, known, people))
        if known:
            self._again(pending, known)

    def _of_run(self, words: list[tuple[int, int]], known: dict[str, str], people) -> list[tuple[int, int]]:
        """Judge a run of words; the places of words that are not taken come back."""
        t = self.text
        cue, form, k = "", "", 0
        lows = [t[a:b].lower() for a, b in words]
        # Words before the name: forms of address, greetings, persons, and words no name begins with.
        while k < len(words):
            low = lows[k]
            if low in FORMS:
                form, cue = form or FORMS[low] or low, "form"
            elif low in _GREETINGS:
                cue = "greeting"
            elif low in _PERSONS:
                cue = cue or "person"
            elif (low in NOT_NAMES or low in _BEFORE) and low not in _LINK_WORDS:
                cue = "before" if low in _BEFORE else ""
            else:
                break
            k += 1
        if k == len(words):
            return []
        words, lows = words[k:], lows[k:]
        if len(words) == 1:
            return [] if self._of_piece(words, cue, form, known, people) else words
        pieces: list[list[tuple[int, int]]] = [[]]
        # A comma joins "Last, First" only where nothing else follows; a word no name holds ends the name.
        for n, ((a, b), low) in enumerate(zip(words, lows)):
            if (low in NOT_NAMES and low not in _LINK_WORDS) or low in FORMS:
                pieces.append([])
                continue
            if pieces[-1] and "," in t[pieces[-1][-1][1] : a] and not (len(pieces[-1]) == 1 and len(words) - n <= 2):
                pieces.append([])
            pieces[-1].append((a, b))
        left: list[tuple[int, int]] = []
        for n, piece in enumerate(pieces):
            if piece and not self._of_piece(piece, cue if n == 0 else "", form if n == 0 else "", known, people):
                left.extend(piece)
        return left

    def _of_piece(self, piece, cue: str, form: str, known: dict[str, str], people) -> bool:
        t = self.text
        start, end = piece[0][0], piece[-1][1]
        # An initial that ends a name is its end only if more of the sentence follows.
        if t[end - 1] == "." and len(piece) > 1 and (t[end : end + 1] != " " or len(piece) == 2):
            piece = piece[:-1]
            end = piece[-1][1]
        many = len(piece) > 1
        head = max(t.rfind("\n", 0, start), t.rfind("\r", 0, start)) + 1
        after = t[end : end + 1]
        if not many and not cue and not t[head:start].strip() and after not in ("\n", "\r", "", " ", "\t"):
            return False
        before = t[max(head, start - 48) : start]
        stripped = before.rstrip()
        ends = stripped.split()[-2:]
        last = [m for m in map(_LETTERS.search, ends) if m]
        one = last[-1].group().lower() if last else ""
        two = f"{last[0].group().lower()} {one}" if len(last) == 2 else one
        plain_before = not stripped or stripped[-1].isalnum() or stripped[-1] in "'’"
        if not cue and one in FORMS and (plain_before or stripped[-1] == "."):
            cue, form = "form", FORMS[one] or one
        tail = t[end : end + 64]
        if not many and not cue and plain_before and stripped and one not in _GREETINGS and two not in _BEFORE and one not in _REACHED:
            return False
        said = t[start:end]
        parts = name_parts(said)
        if not parts or not self._free(start, end):
            return False
        firm = bool(_FIRM_WORD.search(said) or _FIRM_AFTER.match(t, end)) or stripped.endswith("&")
        shaped = _shaped_like_a_name(said)
        label: int | None = None
        if firm or not shaped:
            label = 0
        elif cue == "form":
            label = 1
        elif cue == "greeting" or (one in _GREETINGS and plain_before):
            label = 1 if many or _GREETED.match(tail) else None
        elif self._signs(head, start, end, many):
            label = 1
        elif stripped.endswith(":") and (one in _LABELS or one in _PERSONS):
            label = 1
        elif many and (
            cue in ("person", "before")
            or (plain_before and (one in _PERSONS or one in _BEFORE or two in _BEFORE))
            or (stripped.endswith(",") and (one in _PERSONS or two in _BEFORE))
        ):
            label = 1
        elif many and (_AFTER.match(tail) or _AFTER_COMMA.match(tail) or _REACH_AFTER.match(tail)) and not (plain_before and one in _PLACED):
            label = 1
        elif not many and plain_before and " " in two and two in _BEFORE and _NAMED.match(tail):
            label = 1
        elif not many and plain_before and one in _REACHED and tail.lstrip()[:1] == "(" and _REACH_AFTER.match(tail):
            label = 1
        if label is None and many and said in people:
            label = 1
        if label == 1 and (two == one or two not in _BEFORE):
            link = _LINK_BEFORE.search(t, max(head, start - 12), start)
            start = link.start() if link else start
        if label == 1 and not self._add("person_name", start, end, form if form in ("m", "f") else ""):
            return False
        if label == 1:
            for p in parts:
                if p not in NOT_NAMES:
                    known.setdefault(p, form if form in ("m", "f") else "")
        if many:
            right = _NEXT.match(tail)
            self.runs.append(
                Run(start, end, said, label, two or ("^" if not stripped else stripped[-1]), right[1].lower() if right and right[1] else "$")
            )
        return label == 1

    def _signs(self, head: int, start: int, end: int, many: bool) -> bool:
        """The run is a line of its own that signs: below a closing, above a way to reach somebody, or last."""
        t = self.text
        stop = _LINE_END.match(t, end)
        if not stop:
            return False
        lead = t[head:start]
        if lead and not _ONLY_FORMS.fullmatch(lead):
            return False
        below = t[stop.end() : stop.end() + 80]
        bare = not lead.strip(" \t\xa0")
        if bare and (_REACH.match(below) or (many and _WAYS.match(below))):
            return True
        above = t[max(0, head - 120) : head].rstrip("\r\n\t ").replace("\r", "\n").split("\n")
        lines = [x for x in above if x.strip()][-2:]
        if lines and _CLOSING.fullmatch(lines[-1]):
            return True
        # One line of something else between the two.
        if len(lines) == 2 and _CLOSING.fullmatch(lines[0]) and (many or _WAYS.match(below)):
            return True
        return bare and many and not below and head > 0

    def _again(self, pending: list[tuple[int, int]], known: dict[str, str]) -> None:
        """The people found, elsewhere in the text, in full or by one name."""
        t = self.text
        groups: list[list[int]] = []
        for a, b in sorted(pending):
            if t[a:b].lower() not in known:
                continue
            if groups and _AGAIN.fullmatch(t, groups[-1][1], a):
                groups[-1][1] = b
            else:
                lead = _LEAD_INIT.search(t, max(0, a - 5), a)
                groups.append([lead.start() if lead else a, b])
        for start, end in groups:
            if _FIRM_AFTER.match(t, end) or t[max(0, start - 2) : start] == "& " or t[end : end + 1] in ("@", "_"):
                continue
            self._add("person_name", start, end, known.get(t[start:end].split()[-1].lower(), ""))


def find(text: str | None, people: frozenset[str] | set[str] = frozenset()) -> list[Entity]:
    """All entities of a text in the order they stand; none for null and empty texts.

    ``people`` are full names that are known to be persons' besides what the text itself tells.
    """
    return Scan(text, people).entities


def found_text(e: Entity) -> str:
    """The entity as written, each run of white space as one blank, without a closing mark."""
    t = _SPACES.sub(" ", e.text).strip()
    return t.rstrip(",;:") if e.kind != "address" else t.rstrip(",;:.")
