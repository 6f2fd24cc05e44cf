"""Personal information inside free text: find it and put typed placeholders in its place.

Regular expressions propose spans with a base score; checksum validators and the words beside the span
raise or lower it; spans that reach the threshold are replaced, the better one where two overlap.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

THRESHOLD = 0.5
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity": "[ID]", "address": "[ADDRESS]", "name": "[NAME]", "bank_account": "[BANK_ACCOUNT]", "payment_card": "[CARD]"}
#: Kinds that TESTDATA.md asks for; the other two are replaced as well.
ASKED = ("email", "phone", "identity", "address", "name")
#: Gazetteers with more names than this are refused: they are sent to every task.
MAX_NAMES = 200_000
#: A task remembers so many texts of at most that length (some 30 MB) and what became of them.
REMEMBERED, SHORT = 50_000, 300


def digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(s: str) -> bool:
    d = [int(c) for c in digits(s)][::-1]
    return len(d) > 1 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def mod97_iban(s: str) -> bool:
    t = re.sub(r"[^A-Za-z0-9]", "", s).upper()
    return len(t) >= 15 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def mod97_national(s: str) -> bool:
    """Two check digits equal 97 minus the number before them modulo 97 (with a leading 2 for later births)."""
    d = digits(s)
    return len(d) in (11, 15) and any(97 - int(p + d[:-2]) % 97 == int(d[-2:]) for p in ("", "2"))


def nik_date(s: str) -> bool:
    """A 16-digit resident number holds a date of birth (day raised by 40 for women) at digits 7 to 12."""
    d = digits(s)
    return len(d) == 16 and 1 <= int(d[6:8]) % 40 <= 31 and 1 <= int(d[8:10]) <= 12


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    base: float
    check: Callable[[str], bool] | None = None
    bonus: float = 0.0
    near: re.Pattern | None = None
    group: int = 0


I = re.IGNORECASE
_NEAR = {
    "phone": re.compile(r"\b(?:call(?:ed|s)?|phone|tel|telp|telepon|ring|dial|number|nomor|hubungi|kontak|contact|reach|via|lewat|pager|sms|text|whatsapp|fax|mobile|cell|hp)\b", I),
    "identity": re.compile(r"\b(?:ssn|social security|identity|identitas|passport|paspor|nik|ktp|national id|tax id|sin|bsn|doc|document|dokumen|form|formulir|applicant|pemohon|verify|verified|verifikasi|badge|licen[cs]e|id)\b", I),
    "address": re.compile(r"\b(?:address|addr|alamat|ship(?:ped)?|sen[dt]|mail(?:ed)?|post(?:ed)?|kirim|moved|pindah|rumah|parcel|paket|office|kantor|lives?|invoice|tinggal|deliver(?:ed)?|visit|report)\b", I),
    "card": re.compile(r"\b(?:card|visa|mastercard|kartu|credit|debit)\b", I),
    "bank": re.compile(r"\b(?:iban|account|rekening|bank)\b", I),
}
#: Machine numbers: one of these words directly before, or a unit directly after, a number.
_MACHINE_BEFORE = re.compile(
    r"(?:\b(?:timeouts?|versions?|v|follows|builds?|seq|sequence|shards?|spans?|traces?|checksums?|commits?|runs?|ports?|releases?|rows?|columns?|dated|slots?|hash|step|offset|serial|tile|layer|item|exit|rows=|size=)(?: (?:set to|no\.?|number|is|was|of))?|@|0x|/)[ #:=]*$", I)
#: Units and counted things: a number before them counts something.
_MACHINE_AFTER = re.compile(r"^ ?(?:(?-i:[num]?s)|(?:milli|micro|nano)?seconds?|minutes?|hours?|days?|ticks?|hops?|cycles?|steps?|times?|rows?|lines?|columns?|items?|records?|files?|bytes?|[kmgt]i?b|tokens?|requests?|errors?|matched)\b", I)

_SEP = r"[ .\-\u2010\u2011\u2012\u2013]"
_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|nol|satu|dua|tiga|empat|lima|enam|tujuh|delapan|sembilan"
_AT = r"\s?(?:[@\uff20]|[\[({]\s?at\s?[\])}])\s?"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
_NOT_STREET = r"(?:of|the|a|an|in|to|on|at|and|or|for|is|was|with|from|by|after|before|fewer|more|rows?|minutes?|seconds?|hours?|days?|times?|percent|files|bytes|lines|column|steps?)"
_STREET = r"(?:Street|Str|St|Road|Rd|Avenue|Ave|Boulevard|Blvd)"
_STREET_WEAK = r"(?:Lane|Ln|Row|Close|Drive|Dr|Court|Ct|Way|Terrace|Place|Square|Crescent|Gardens|Hill|Mews)"
_TAIL = r"(?:,? (?:apt|flat|unit|suite|apartment)\b\.? ?\w{1,5})?(?:, [A-Z][\w\u00c0-\u024f'\u2019-]+(?: [A-Z][\w\u00c0-\u024f'\u2019-]+)?)?"


def _street(suffix: str) -> re.Pattern:
    name = rf"(?:(?!{_NOT_STREET}\b)[^\W\d_][\w'\u2019-]*\.? ){{1,3}}"
    return re.compile(rf"(?:\b(?:[Ff]lat|[Aa]pt\.?|[Uu]nit|[Ss]uite) \w{{1,5}}, ?)?(?<![\w.,:/-])\d{{1,5}}[A-Za-z]? (?i:{name}{suffix}\b\.?){_TAIL}")


RULES = [
    Rule("email", re.compile(r"(?:mailto:)?(?<![\w.+@/%-])[\w.+%-]{1,64}[@\uff20](?:[\w-]{1,63}\.){1,6}[^\W\d_]{2,24}\b(?!/)"), 0.9),
    Rule("email", re.compile(rf"(?:mailto:)?(?<![\w.+@/%-])[\w.+%-]{{1,64}}{_AT}(?:[\w-]{{1,63}}{_DOT}){{1,6}}[^\W\d_]{{2,24}}\b(?!/)", I), 0.8),
    Rule("phone", re.compile(r"\btel:\+?[\d().\-]{7,24}(?:;ext=\d{1,6})?", I), 1.4),
    Rule("phone", re.compile(rf"(?<![\w+])\+\d{{1,3}}(?:{_SEP}?\(?\d{{2,6}}\)?){{2,5}}(?!\d)"), 0.8, lambda s: 8 <= len(digits(s)) <= 15, 0.1),
    Rule("phone", re.compile(rf"(?<![\w.\-+(])(?:1{_SEP})?(?:\([2-9]\d\d\) ?|[2-9]\d\d{_SEP})[2-9]\d\d{_SEP}\d{{4}}(?![\w]|[.\-]\d)"), 0.55),
    Rule("phone", re.compile(r"(?<![\w.\-+])0\d{2,4}[ \-]\d{3,4}[ \-]\d{3,4}(?![\w]|[.\- ]\d)"), 0.55),
    Rule("phone", re.compile(r"(?<![\w.\-+])(?:1[2-9]\d\d[2-9]\d{6}|0[78]\d{8,10})(?![\w]|[.\-]\d)"), 0.5),
    Rule("phone", re.compile(rf"\b(?:(?:{_WORDS})[ ,\-]{{1,2}}){{6,14}}(?:{_WORDS})\b", I), 0.6),
    Rule("phone", re.compile(r"(?<![\w.\-+])\d{7,11}(?![\w]|[.\-]\d)"), 0.2),
    Rule("identity", re.compile(r"(?<![\w.\-])\d{3}([\- ])\d{2}\1\d{4}(?![\w]|[.\-]\d)"), 0.55),
    Rule("identity", re.compile(r"\b(?:ssn|social security(?: (?:number|no\.?))?)\W{0,3}\d{3}[ .\-]?\d{2}[ .\-]?\d{4}\b", I), 0.95),
    Rule("identity", re.compile(r"(?<![\w\-])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)|(?<![\w\-])QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"), 0.6),
    Rule("identity", re.compile(r"\b(?:passport|paspor)(?: (?:no|number|nomor))?\W{0,3}[A-Z]{0,2} ?\d{3,4} ?\d{3,5}\b", I), 0.95),
    Rule("identity", re.compile(r"\b(?:NIK|(?:no\.? ?)?KTP)\W{0,3}\d{4}([ .\-]?)\d{4}\1\d{4}\1\d{4}\b", I), 0.95, nik_date, 0.05),
    Rule("identity", re.compile(r"(?<![\w.\-])\d{4}[ .\-]?\d{4}[ .\-]?\d{4}[ .\-]?\d{4}(?![\w]|[.\-]\d)"), 0.15, nik_date, 0.1),
    Rule("identity", re.compile(r"(?<![\w.\-])\d{3}[ \-]?\d{3}[ \-]?\d{3}(?![\w]|[.\-]\d)"), 0.05, luhn, 0.2),
    Rule("identity", re.compile(r"(?<![\w.\-])(?:\d{2}[. ]?\d{2}[. ]?\d{2}[\- ]?\d{3}[. ]?\d{2}|[1278]\d{12} ?\d{2})(?![\w]|[.\-]\d)"), 0.0, mod97_national, 0.3),
    Rule("payment_card", re.compile(r"(?<![\w.\-])[3-6]\d{3}[ \-]?\d{4,6}[ \-]?\d{4,5}(?:[ \-]?\d{1,4})?(?![\w]|[.\-]\d)"), -0.1, lambda s: 13 <= len(digits(s)) <= 19 and luhn(s), 0.4, _NEAR["card"]),
    Rule("bank_account", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0.0, mod97_iban, 0.7, _NEAR["bank"]),
    Rule("address", _street(_STREET), 0.65),
    Rule("address", _street(_STREET_WEAK), 0.35),
    Rule("address", re.compile(r"\b(?:Jl|Jln|Jalan|Gang|Gg)\.? (?:[^\W\d_][\w'\u2019-]*\.? ){1,4}(?:(?:No|Nomor)\.? ?)?\d{1,4}[A-Za-z]?\b(?:,? (?:Blok|Kav)\.? \w{1,3}\b|,? RT\.? ?\d{1,3} ?/ ?RW\.? ?\d{1,3})*", I), 0.8),
]

SPOKEN = next(r for r in RULES if "zero|oh" in r.pattern.pattern)
RULES_BY_KIND = {k: [r for r in RULES if r.kind == k] for k in PLACEHOLDER}
NUMBER_RULES = [r for r in RULES if r.kind in ("phone", "identity", "payment_card", "bank_account") and r is not SPOKEN]

# Forms of address before a name, in English and Indonesian.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Pak", "Bapak", "Bu", "Ibu", "Mbak", "Mas", "Sdr", "Sdri", "Tuan", "Nyonya"]
# Wordings after which two capitalized words are a person: verbs of meeting and speaking, authorship and
# letters, keys of records, English and Indonesian.
INTRODUCTIONS = [
    "spoke with", "spoke to", "talked to", "talked with", "met with", "lunch with", "according to", "bertemu", "menurut", "greets", "reach", "kontak", "contact is",
    "opened by", "signed by", "written by", "reviewed by", "approved by", "ditulis oleh", "disetujui oleh", "the reviewer", "letter to", "letter for", "surat untuk", "surat kepada",
    "it's", "my name is", "nama saya",
    "name:", "nama:", "author:", "penulis:", "signer:", "applicant:", "data pemohon:", "pemohon:", "attn:", "cc:", "name=", "author=", "signer=", "applicant=", "pemohon=",
]


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def words(low: str) -> set[str]:
    return set(_LETTERS.findall(low))


def _any_of(xs: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(x) for x in sorted(xs, key=lambda x: (-len(x), x))) + ")"


_LETTERS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d")
_AT_WORD = re.compile(r"[\[({]\s?at\s?[\])}]")
_TITLE, _TITLE_WORDS = _any_of(TITLES) + r"\.?", {t.lower() for t in TITLES}
_INTRODUCED = rf"(?i:\b{_any_of(INTRODUCTIONS)})"
_CAP = r"[A-Z\u00c0-\u00de][\w\u00c0-\u024f'\u2019-]+"
_WORD, _END = r"(?<![\w@.-])", r"(?![\w@]|-\w|\.\w)"
TITLED = Rule("name", re.compile(rf"{_WORD}(?:{_TITLE} ){_CAP}(?: (?:[A-Z]\. )?{_CAP})?{_END}"), 0.6)
INTRODUCED = Rule("name", re.compile(rf"{_INTRODUCED} ?((?:[A-Z]\. |{_CAP} )(?:[A-Z]\. )?{_CAP}){_END}"), 0.6, group=1)
#: One of these words stands in every street address, and in every number that is spelled out.
_STREET_WORDS = {"street", "str", "st", "road", "rd", "avenue", "ave", "boulevard", "blvd", "lane", "ln", "row", "close", "drive", "dr", "court", "ct", "way", "terrace", "place", "square", "crescent",
                 "gardens", "hill", "mews", "jl", "jln", "jalan", "gang", "gg"}
_NUMBER_WORDS = set(_WORDS.split("|"))


class Names:
    """Rules for the given full names: every first word counts as a given, every last one as a family name, in any
    combination; names not listed are found by a title or an introduction before them. A text is only searched
    for the names whose words occur in it, so the number of names hardly matters for its cost."""

    def __init__(self, people: Iterable[str]):
        given, family = set(), set()
        for p in people:
            words = p.split()
            if len(words) > 1:
                given |= {words[0].lower(), fold(words[0]).lower()}
                family |= {words[-1].lower(), fold(words[-1]).lower()}
        if len(given) + len(family) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} names")
        self.given, self.family = self._by_word(given), self._by_word(family)
        self.listed = lru_cache(maxsize=4_096)(self._listed)

    @staticmethod
    def _by_word(names: set[str]) -> dict[str, list[str]]:
        """Names by the first word in them, as words() cuts them."""
        out: dict[str, list[str]] = {}
        for n in names:
            for w in sorted(words(n))[:1]:
                out.setdefault(w, []).append(n)
        return out

    @staticmethod
    def _listed(given: tuple[str, ...], family: tuple[str, ...]) -> list[Rule]:
        g, s = _any_of(given), _any_of(family)
        initials = r"(?:[A-Z]\. )"
        both = [Rule("name", re.compile(rf"{_WORD}(?:{_TITLE} )?{g} {initials}{{0,2}}{s}{_END}", I), 0.95), Rule("name", re.compile(rf"{_WORD}{s}, {g}{_END}", I), 0.95)] if given and family else []
        short = [Rule("name", re.compile(rf"{_WORD}{initials}{{1,2}}{s}{_END}", I), 0.9)] if family else []
        one = _any_of((*given, *family))
        return both + short + [Rule("name", re.compile(rf"{_WORD}{_TITLE} {one}{_END}", I), 0.9), Rule("name", re.compile(rf"{_INTRODUCED} ?((?i:{one})){_END}"), 0.55, group=1)]

    def rules(self, low: str, seen: set[str]) -> list[Rule]:
        """Rules worth trying on a text in lower case with these words."""
        out = []
        if not seen.isdisjoint(_TITLE_WORDS):
            out.append(TITLED)
        if any(i in low for i in INTRODUCTIONS):
            out.append(INTRODUCED)
        found = [tuple(sorted(n for w in seen & known.keys() for n in known[w] if n in low)) for known in (self.given, self.family)]
        return out + (self.listed(*found) if any(found) else [])


name_rules = Names


def score(rule: Rule, text: str, a: int, b: int) -> float:
    got = rule.base
    if rule.check is not None:
        got += rule.bonus if rule.check(text[a:b]) else -rule.bonus
    near = rule.near or _NEAR.get(rule.kind)
    before = text[max(0, a - 40) : a]
    if near is not None and near.search(before):
        got += 0.3
    if rule.kind == "address":
        got += 0.2 * bool(re.search(r"^[Ff]lat |,| [A-Z]\w+\.?$", text[a:b])) + 0.1 * any(c.isupper() for c in text[a:b])
    elif rule.kind in ("phone", "identity", "payment_card") and (_MACHINE_BEFORE.search(before) or _MACHINE_AFTER.match(text[b : b + 14])):
        got -= 0.6
    return got


def _worth_trying(text: str, names: Names) -> list[Rule]:
    """Rules that can match the text, told by the signs and words they need."""
    low = text.lower()
    seen = words(low)
    n_digits = len(_DIGIT.findall(text))
    out = []
    if "@" in text or "\uff20" in text or ("at" in low and _AT_WORD.search(low)):
        out += RULES_BY_KIND["email"]
    if n_digits >= 6:
        out += NUMBER_RULES
    if not seen.isdisjoint(_NUMBER_WORDS):
        out.append(SPOKEN)
    if n_digits and not seen.isdisjoint(_STREET_WORDS):
        out += RULES_BY_KIND["address"]
    return out + names.rules(low, seen)


def spans(text: str, names: Names, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) in order; of overlapping spans the higher score wins, then the
    longer, then the earlier one. Names inside e-mail addresses lose against the address."""
    proposed = []
    for rule in _worth_trying(text, names):
        for m in rule.pattern.finditer(text):
            s = score(rule, text, *m.span(rule.group))
            if s >= threshold:
                proposed.append((-s - (rule.kind == "email"), m.start(rule.group) - m.end(rule.group), m.start(rule.group), m.end(rule.group), rule.kind))
    if not proposed:
        return []
    proposed.sort()
    kept: list[tuple[int, int, str]] = []
    ends: list[int] = []  # of the spans kept, in order of place
    for _, _, a, b, kind in proposed:
        at = bisect_left(ends, a + 1)
        if at == len(kept) or kept[at][0] >= b:
            kept.insert(at, (a, b, kind))
            ends.insert(at, b)
    return kept


def redact(text: str | None, names: Names) -> tuple[str | None, list[str]]:
    """The text with placeholders and the sorted distinct kinds found. Null stays null."""
    if not text:
        return text, []
    found = spans(text, names)
    if not found:
        return text, []
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(parts) + text[at:], sorted({k for _, _, k in found})


def listed_people(personas: DataFrame) -> list[str]:
    """Names of persons (not agents) in the table of personas, which must have at most MAX_NAMES rows."""
    rows = personas.where("entity_type = 'user' and name is not null").select("name").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"personas has more than {MAX_NAMES} names")
    return sorted(r[0] for r in rows)


def redacted(df: DataFrame, text: str, people: list[str], clean: bool = True) -> DataFrame:
    """df with a column ``pii``: struct(clean string, kinds array<string>) of its column text; without ``clean`` the kinds
    only, the texts being left where they are. A column of that name is replaced.

    Null and empty texts come out unchanged with no kinds; texts of any length are processed whole."""
    kept = df.drop("pii")
    at = kept.columns.index(text)
    kinds = pa.list_(pa.string())
    out = StructType([*kept.schema.fields, StructField("pii", StructType([StructField("clean", StringType()), StructField("kinds", ArrayType(StringType()))]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(people)
        known: dict[str, tuple[str | None, list[str]]] = {}  # short texts met before

        def one(t: str | None) -> tuple[str | None, list[str]]:
            if t is None or len(t) > SHORT:
                return redact(t, names)
            got = known.get(t)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = known[t] = redact(t, names)
            return got

        for b in batches:
            done = [one(t) for t in b.column(at).to_pylist()]
            texts = pa.array([x[0] for x in done], pa.string()) if clean else pa.nulls(len(done), pa.string())
            pii = pa.StructArray.from_arrays([texts, pa.array([x[1] for x in done], kinds)], names=["clean", "kinds"])
            yield pa.RecordBatch.from_arrays([*b.columns, pii], names=[*b.schema.names, "pii"])

    return kept.mapInArrow(run, out)
