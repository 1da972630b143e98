"""Detectors as column functions: a text column becomes an array of typed spans in one projection.

Families are tried in a fixed order. A family may have a ledger of places already claimed; a later
match of the same ledger is dropped when one of its ends lies inside a claimed span (for two families
only its start counts). Patterns are read as Python reads them, with Unicode's classes of letters and digits.

The steps on one text are in `sweep`; here they are applied to Arrow batches, in the row of the text, so nothing is
shuffled (but for small tables, `session.spread`). A null text has no spans, nor has an empty one. Repeated rows are judged alike, once for each row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from veilspan import session
from veilspan.functions import expressions as E
from veilspan.functions import fixed
from veilspan.functions.text import normal_form
from veilspan.operators import sweep

Check = Callable[[str, int, int], bool]


@dataclass(frozen=True)
class Family:
    name: str
    label: str
    pattern: str
    confidence: float
    group: int = 0
    ledger: str | None = None  # claims and respects places of this ledger; "*" respects all
    holds: bool = True  # whether its spans are entered in the ledger
    start_only: bool = False
    valid: Check | None = None
    source: str = "regex"
    pack: str = "base_en"
    digits: int = 0  # a match is a numeric run (digits and what parts them) with so many digits at least
    words: tuple[tuple[str, ...], ...] = ()  # in lower case; of each tuple a text with a match holds one
    score: Callable[[str, str, int, int], float] | None = None


def _luhn(text: str, start: int, end: int) -> bool:
    number = re.sub("[ -]", "", text[start:end])
    return 13 <= len(number) <= 19 and sweep.luhn(number)


def _digits_at_least(n: int) -> Check:
    return lambda text, start, end: sum(map(str.isdecimal, text[start:end])) >= n


def _postal_near(text: str, start: int, end: int) -> bool:
    window = text[max(start - 60, 0) : end + 60]
    return bool(sweep.compiled(fixed.UAE_PO_BOX).search(window) or sweep.compiled(fixed.POSTAL_NUMBER).search(window))


_ORG_WORD, _FIELD_MARK = re.compile(rf"\b(?:{fixed.ORG_SUFFIXES})\b"), re.compile(r"\s{0,2}:")


def _plain_name(text: str, start: int, end: int) -> bool:
    name = text[start:end]
    return name.split(None, 1)[0].lower() not in fixed.NO_NAME_STARTS and not _ORG_WORD.search(name) and not _FIELD_MARK.match(text, end)


def _not_empty(text: str, start: int, end: int) -> bool:
    return end > start


_PREFIX = re.compile(rf"^(?:{'|'.join(fixed.CUE_PREFIXES)})(?=..)")


def cue_nearby(window: str) -> bool:
    """Whether a word of the window, less one prefix and one suffix, is an identity cue."""
    for word in sweep.compiled(fixed.ARABIC_WORD).findall(window):
        bare = _PREFIX.sub("", word)
        suffix = next((s for s in fixed.CUE_SUFFIXES if bare.endswith(s) and len(bare) > len(s) + 1), "")
        if bare.removesuffix(suffix) in fixed.ID_CUES:
            return True
    return False


def _gulf_score(checksum: str | None, base: float) -> Callable[[str, str, int, int], float]:
    """Base confidence, raised by a right checksum, lowered by a wrong one, raised by a cue nearby."""

    def score(ascii_digits: str, text: str, start: int, end: int) -> float:
        passed = sweep.CHECKSUMS[checksum](re.sub(r"[\s\-]", "", ascii_digits[start:end])) if checksum else None
        scored = base if passed is None else min(0.99, base + 0.4) if passed else max(0.15, base - 0.25)
        return min(0.99, scored + 0.15) if cue_nearby(text[max(start - 40, 0) : end + 40]) else scored

    return score


def _words_of(pattern: str) -> tuple[str, ...]:
    return tuple(sorted({w.casefold() for w in re.findall(r"[A-Za-z]{2,}", pattern)}))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME_CUES = ("name is", "i am", "i'm", "this is", "call me", "contact", "out to", "attn", "signed", "regards", "from", "mr", "ms", "dr", "prof", "sr", "jr")

#: In order of precedence.
FAMILIES = (
    Family("card", "CREDIT_CARD", fixed.CARD_CANDIDATE, 0.99, valid=_luhn, digits=13),
    Family("ssn-dashed", "GOV_ID", fixed.SSN_DASHED, 0.9, ledger="gov", digits=9),
    Family("ssn-spaced", "GOV_ID", fixed.SSN_SPACED, 0.9, ledger="gov", digits=9),
    Family("gov-id-grouped3", "GOV_ID", fixed.GOV_ID_GROUPED, 0.85, ledger="gov", digits=9),
    Family("gov-id-dotted", "GOV_ID", fixed.GOV_ID_DOTTED, 0.85, ledger="gov", digits=8),
    Family("ssn-plain", "GOV_ID", fixed.GOV_ID_PLAIN, 0.55, ledger="gov", holds=False, digits=9),
    Family("alnum-id-cued", "GOV_ID", fixed.ALNUM_ID_CUE, 0.8, group=1, ledger="gov", words=(("card", "passport", "licen", "identification", "national"),)),
    Family("phone", "PHONE", fixed.PHONE, 0.93, ledger="phone", valid=_digits_at_least(10), digits=10),
    Family("intl", "PHONE", fixed.PHONE_INTERNATIONAL, 0.85, ledger="phone", valid=_digits_at_least(8), digits=8),
    Family("email", "EMAIL", fixed.EMAIL, 0.98, words=(("@",),)),
    Family("ipv4", "IP_ADDRESS", fixed.IPV4, 0.9, ledger="ip", digits=4),
    Family("ipv6", "IP_ADDRESS", fixed.IPV6, 0.85, ledger="ip", start_only=True, words=((":",),)),
    Family("date-month-first", "DATE_TIME", fixed.DATE_MONTH_FIRST, 0.9, ledger="date", words=(_MONTHS,)),
    Family("date-day-first", "DATE_TIME", fixed.DATE_DAY_FIRST, 0.9, ledger="date", words=(_MONTHS,)),
    Family("date-numeric", "DATE_TIME", fixed.DATE_NUMERIC, 0.85, ledger="date", digits=4),
    Family("time", "DATE_TIME", fixed.TIME, 0.8, ledger="date", digits=3),
    Family("handle", "USERNAME", fixed.HANDLE, 0.85, ledger="user", words=(("@",),)),
    Family("cued", "USERNAME", fixed.USERNAME_CUE, 0.75, group=1, ledger="user", words=(("user", "handle", "login"),)),
    Family("geocoord", "ADDRESS", fixed.GEO, 0.85, words=(("[",),)),
    Family("field_cue_address", "ADDRESS", fixed.ADDRESS_FIELD, 0.8, group=1, valid=_not_empty, words=((":",), ("building", "street", "city", "state", "post", "country", "secondary"))),
    Family("field_cue_name", "PERSON", fixed.NAME_FIELD, 0.8, group=1, ledger="namefield", valid=_not_empty, words=((":",), ("name",))),
    Family("tag_cue", "PERSON", fixed.NAME_TAG, 0.8, group=1, ledger="namefield", valid=_not_empty, words=(("<name>",),)),
    Family("uae_emirates_id", "GOV_ID", fixed.EMIRATES_ID, 0.95, ledger="*", digits=15),
    Family("uae_mobile", "PHONE", fixed.UAE_MOBILE, 0.85, ledger="*", digits=9),
    Family("uae_landline", "PHONE", fixed.UAE_LANDLINE, 0.75, ledger="*", digits=9),
    Family("uae_po_box", "ADDRESS", fixed.UAE_PO_BOX, 0.85, ledger="*", words=(("box",),)),
    Family("uae_trade_license", "GOV_ID", fixed.UAE_TRADE_LICENCE, 0.85, ledger="*", words=(("cn",),)),
    Family("uae_emirate_name", "ADDRESS", fixed.EMIRATE_NAME, 0.65, ledger="*", valid=_postal_near, words=(("dubai", "abu dhabi", "sharjah", "ajman", "fujairah", "ras al khaimah", "umm al quwain"),)),
    *(Family(n, "GOV_ID", p, c, ledger="gulf", pack="gulf_ar", digits=8, score=_gulf_score(k, c)) for n, p, k, c in fixed.GULF_IDS),
    Family("access_key", "SECRET", fixed.SECRET_ACCESS_KEY, 0.95, group=1, ledger="secret", source="secrets", words=(("akia", "asia"),)),
    Family("secret_tag", "SECRET", fixed.SECRET_TAG, 0.9, group=1, ledger="secret", source="secrets", words=(("<password>", "<secret>", "<token>"),)),
    Family("secret_cued", "SECRET", fixed.SECRET_CUED, 0.9, group=1, ledger="secret", source="secrets", words=((":", "="), ("pass", "pwd", "token", "secret", "api"))),
    Family("name_cue", "PERSON", fixed.NAME_CUE, 0.88, group=1, ledger="name", source="ner", words=(_NAME_CUES,)),
    Family("capword_seq", "PERSON", fixed.CAPITALIZED_WORDS, 0.55, group=1, ledger="name", holds=False, start_only=True, valid=_plain_name, source="ner"),
    Family("street_pattern", "ADDRESS", fixed.STREET, 0.8, source="ner"),
    Family("org_suffix", "ORG", fixed.ORGANISATION, 0.75, source="ner", words=(("inc", "llc", "l.l.c.", "corp", "ltd", "co.", "company", "group", "technologies", "labs", "partners", "holdings", "industries"),)),
    Family("card_issuer_vocab", "ORG", fixed.CARD_ISSUER, 0.8, source="ner", words=(_words_of(fixed.CARD_ISSUER),)),
    Family("demographic_vocab", "DEMOGRAPHIC", fixed.DEMOGRAPHIC, 0.7, source="ner", words=(_words_of(fixed.DEMOGRAPHIC),)),
    Family("title_vocab", "TITLE", fixed.TITLE, 0.65, source="ner", words=(_words_of(fixed.TITLE),)),
)
BY_NAME = {f.name: f for f in FAMILIES}
SPAN = "struct<start:int,end:int,text:string,label:string,format:string,source:string,confidence:double>"
FOUND = "struct<start:int,end:int,label:string,confidence:double,format:string,source:string,negated:boolean,text:string>"


def named(*names: str) -> tuple[Family, ...]:
    return tuple(f for f in FAMILIES if f.name in names)


def of_packs(packs: Iterable[str], ner: bool = True) -> tuple[Family, ...]:
    """The families that a policy's packs switch on; without `ner` the rule-based entity families are left out."""
    packs = set(packs)
    return tuple(f for f in FAMILIES if (f.pack in packs or f.source == "secrets") and (ner or f.source != "ner"))


_KINDS = {"start": pa.int32(), "end": pa.int32(), "label": pa.string(), "confidence": pa.float64(), "format": pa.string(), "source": pa.string(), "negated": pa.bool_(), "text": pa.string(), "folded": pa.string()}
_PLACES = {c: i for i, c in enumerate(("start", "end", "label", "confidence", "format", "source", "negated"))}


def _found_in(find: Callable[[str], list[tuple]], fields: tuple[str, ...]) -> Callable[[Column], Column]:
    """A column function of a text: the spans that `find` gives for it, as an array of structs of the fields."""
    session.ship_package(SparkSession.active())
    kind = pa.list_(pa.struct([(c, _KINDS[c]) for c in fields]))

    @F.arrow_udf(from_arrow_type(kind))
    def found(texts: pa.Array) -> pa.Array:
        columns, ends = {c: [] for c in fields}, [0]
        for text in texts:
            text = text.as_py()
            spans = find(text) if text else []
            for c in fields:
                columns[c] += [text[s[0] : s[1]] for s in spans] if c == "text" else [E.folded(text[s[0] : s[1]]) for s in spans] if c == "folded" else [s[_PLACES[c]] for s in spans]
            ends.append(ends[-1] + len(spans))
        structs = pa.StructArray.from_arrays([pa.array(columns[c], _KINDS[c]) for c in fields], names=list(fields))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)

    return found


def _numbers(families: Iterable[Family]) -> list[int]:
    """Places in FAMILIES, which executors know; patterns need not be sent."""
    wanted = list(families)
    return [i for i, f in enumerate(FAMILIES) if f in wanted]


def spans_column(families: Iterable[Family], text: str | Column = "text") -> Column:
    """array of SPAN of a text column, in order of the families; null texts have none."""
    numbers = _numbers(families)
    find = _found_in(lambda t: sweep.spans_in(t, [FAMILIES[i] for i in numbers]), ("start", "end", "text", "label", "format", "source", "confidence"))
    return find(F.col(text) if isinstance(text, str) else text)


def detect(units: DataFrame, families: Iterable[Family], text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """One row for each span: the unit's `keep` columns, ord, start, end, text, label, format, source, confidence."""
    rows = session.spread(units.select(*keep, F.col(text).alias("whole")))
    spans = rows.select(*keep, F.posexplode(spans_column(families, "whole")).alias("ord", "s"))
    return spans.select(*keep, "ord", "s.start", "s.end", "s.text", "s.label", "s.format", "s.source", "s.confidence")


def locked_spans(sentences: DataFrame, text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """start, end, text, label, negated, confidence of the values that ownership anchors name in each sentence row
    ("my e-mail is ..."); negated anchors have confidence 0.9, others 0.95."""
    columns = ("start", "end", "text", "label", "negated", "confidence")
    found = sentences.select(*keep, F.explode(_found_in(sweep.locked_in, columns)(F.col(text))).alias("s"))
    return found.select(*keep, *[f"s.{c}" for c in columns])


def found_of(name: str, packs: Iterable[str] = ("base_en",), ner: bool = True, protect: str | None = None, families: Iterable[str] | None = None, folded: bool = False) -> Column:
    """The whole run on a text column: array of FOUND in order of start, with offsets in the text as it is (`sweep.whole`).
    With `folded` each has its value's folded form (NFKC) too.

    Spans that overlap a match of the pattern `protect` are left out. With `families` only those of these names run."""
    names = None if families is None else set(families)
    numbers = _numbers(f for f in of_packs(packs, ner) if names is None or f.name in names)

    def find(text: str) -> list[tuple]:
        found = sweep.whole(text, [FAMILIES[i] for i in numbers], normal_form)
        return sweep.free_of(found, (m.span() for m in sweep.compiled(protect).finditer(text))) if protect and found else found

    return _found_in(find, tuple(c for c in _KINDS if folded or c != "folded"))(F.col(name))


def run(units: DataFrame, packs: Iterable[str] = ("base_en",), *, ner: bool = True, text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """One row for each span of the whole run: `keep`, ord, start, end, text, label, confidence, format, source, negated.
    The spans are found in the row of their text."""
    rows = session.spread(units.select(*keep, F.col(text).alias("whole")))
    spans = rows.select(*keep, F.posexplode(found_of("whole", packs, ner)).alias("ord", "s"))
    return spans.select(*keep, "ord", *[f"s.{c}" for c in ("start", "end", "text", "label", "confidence", "format", "source", "negated")])
