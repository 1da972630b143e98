"""The steps of a detection run on one text, each a single ordered pass over the text's spans.

These are the functions that `detection` and `spans` apply to Arrow batches, row by row; Spark parts the rows.
Spans are tuples (start, end, label, confidence, format, source) with half-open offsets in code points.
Claimed places are kept as bytes, one for each character, so that asking for a place is one step however many spans
there are: the time of a text grows with its length and its number of spans.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

from veilspan.functions import fixed

compiled = cache(re.compile)

#: Ledgers that families reading all claimed places ("*") do not read.
_OWN_LEDGERS = ("gulf", "secret", "name")
#: A run of digits and what may stand between or before the digits of one number, date or time.
_NUMERIC = re.compile(r"[+(]*\d[\d\s.\-()/:+]*")
#: Characters after such a run that may still belong to a match ("p.m."), and one that shows a word's end.
_BEYOND = 6


class Claims:
    """Places of one text that spans of a ledger have claimed."""

    def __init__(self, length: int):
        self.length, self.taken = length, {}

    def add(self, ledger: str, start: int, end: int) -> None:
        self.taken.setdefault(ledger, bytearray(self.length))[start:end] = b"\1" * (end - start)

    def blocks(self, ledger: str, start: int, end: int, start_only: bool) -> bool:
        """Does one end of a span lie in a claimed span (of two families only the start counts)?"""
        taken = self.taken.get(ledger)
        return taken is not None and bool((start < self.length and taken[start]) or (not start_only and 0 < end and taken[end - 1]))


def _numeric(text: str) -> list[tuple[int, int, int]]:
    """start, end and number of digits of each numeric run."""
    return [(m.start(), m.end(), sum(map(str.isdecimal, m.group()))) for m in _NUMERIC.finditer(text)]


def _found(family, text: str, folded: str, runs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    pattern, group = compiled(family.pattern), family.group
    if family.digits:  # all that such a pattern matches lies in a numeric run
        for start, end, digits in runs:
            if digits >= family.digits:
                for m in pattern.finditer(text, start, min(end + _BEYOND, len(text))):
                    if m.start() < end:
                        yield m.span()
    elif _held(family.words, folded):
        for m in pattern.finditer(text):
            yield m.span(group)


def _held(groups: tuple[tuple[str, ...], ...], folded: str) -> bool:
    """Does a text hold a word of each group?"""
    for words in groups:
        for word in words:
            if word in folded:
                break
        else:
            return False
    return True


def spans_in(text: str, families: Iterable) -> list[tuple]:
    """Typed spans of the families in their order; one that meets a claimed place of its ledger is dropped."""
    folded, runs, claims, kept = text.casefold(), _numeric(text), Claims(len(text)), []
    ascii_digits = arabic_runs = None
    for family in families:
        read, found_runs = text, runs
        if family.pack == "gulf_ar":
            if ascii_digits is None:
                ascii_digits = text.translate(_ARABIC_DIGITS)
                arabic_runs = runs if ascii_digits == text else _numeric(ascii_digits)
            read, found_runs = ascii_digits, arabic_runs
        for start, end in _found(family, read, folded, found_runs):
            if family.valid is not None and not family.valid(text, start, end):
                continue
            if family.ledger is not None and claims.blocks(family.ledger, start, end, family.start_only):
                continue
            confidence = family.confidence if family.score is None else family.score(ascii_digits, text, start, end)
            kept.append((start, end, family.label, confidence, family.name, family.source))
            if family.ledger not in _OWN_LEDGERS:
                claims.add("*", start, end)
            if family.holds and family.ledger not in (None, "*"):
                claims.add(family.ledger, start, end)
    return kept


_ARABIC_DIGITS = str.maketrans(fixed.ARABIC_INDIC_DIGITS + fixed.EASTERN_ARABIC_DIGITS, "0123456789" * 2)

_DIGITS_ON, _WORD_ON = re.compile(r"(?:[\-.\s()]{0,2}\d)*"), re.compile(r"[A-Za-z0-9']*")
#: Characters before a span that are looked at first; longer runs are read to their end.
_BESIDE = 64


def _grown(text: str, label: str, start: int, end: int) -> tuple[int, int]:
    """Ends of a span repaired: number-like labels grow over adjoining digits (at most two separators apart),
    word-like labels to word boundaries."""
    on = _DIGITS_ON if label in fixed.DIGIT_LABELS else _WORD_ON if label in fixed.WORD_LABELS else None
    if on is None:
        return start, end
    near = _BESIDE
    while (back := on.match(text[max(start - near, 0) : start][::-1]).end()) > near - 3 and near < start:
        near *= 4
    return start - back, on.match(text, end).end()


def merged_gaps(text: str, spans: list[tuple]) -> list[tuple]:
    """Neighbours of one label with one to three blanks or commas between them, merged."""
    kept: list[tuple] = []
    for s in spans:
        if kept and s[2] == kept[-1][2] and 1 <= s[0] - kept[-1][1] <= 3 and re.fullmatch(r"[\s,]+", text[kept[-1][1] : s[0]]):
            p = kept[-1]
            kept[-1] = (p[0], s[1], p[2], max(p[3], s[3]), p[4], p[5])
        else:
            kept.append(s)
    return kept


def _score(span: tuple) -> float:
    return span[3] + fixed.PRIORITY.get(span[2], 0) * 1e-4


def resolved(spans: Iterable[tuple]) -> list[tuple]:
    """Overlaps of spans in order of start resolved: equal labels unite, a significant overlap (over 0.4 of the
    shorter) keeps the higher score, a slight one trims the later span. Each gets how it came about at its end."""
    kept: list[tuple] = []
    for s in spans:
        own = (*s, "kept")
        prev = kept[-1] if kept else None
        overlap = min(s[1], prev[1]) - max(s[0], prev[0]) if prev else 0
        shorter = min(s[1] - s[0], prev[1] - prev[0]) if prev else 0
        if overlap <= 0:
            kept.append(own)
        elif s[2] == prev[2]:
            kept[-1] = (min(prev[0], s[0]), max(prev[1], s[1]), prev[2], max(prev[3], s[3]), prev[4], prev[5], "united")
        elif overlap / shorter > 0.4:
            if _score(prev) < _score(s):
                kept[-1] = own
        elif s[1] > prev[1]:
            kept.append((prev[1], s[1], s[2], s[3], s[4], s[5], "trimmed"))
    return kept


def repaired(text: str, spans: Iterable[tuple]) -> list[tuple]:
    """Spans with ends repaired, gaps merged and overlaps resolved, as of `resolved`. Spans of one place keep their order."""
    grown = [(*_grown(text, s[2], s[0], s[1]), *s[2:]) for s in spans]
    return resolved(merged_gaps(text, sorted(grown, key=lambda s: (s[0], s[0] - s[1]))))


#: A sentence's end, unless the word before it is a known abbreviation.
_SHORT = "".join(rf"(?<!(?<![\w.])(?i:{re.escape(a)}))" for a in fixed.ABBREVIATIONS)
BOUNDARY = rf"(?<![.!?]){_SHORT}{fixed.SENTENCE_END}"
#: What every such end begins with: a mark, and what follows it at once.
_MARK = re.compile(r"[.!?](?=[.!?\"')\]\s]|$)")


def sentences_in(text: str) -> list[tuple[int, int]]:
    """Ends of the sentences that are not blank; following white space belongs to them."""
    ends, at, boundary = [], 0, compiled(BOUNDARY)
    while mark := _MARK.search(text, at):  # the words before are looked at behind marks only, and not at every character
        end = boundary.match(text, mark.start())
        at = end.end() if end else mark.end()
        if end:
            ends.append(at)
    return [(a, b) for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if text[a:b].strip()]


#: What every sentence with an ownership anchor holds.
ANCHORED = rf"(?i)\b{fixed.POSSESSIVE}\s+[^.!?\n]{{1,40}}?\s+{fixed.COPULA}\s|\b(?:live[sd]?|reside[sd]?)\s+at\s"


@cache
def _anchors() -> list[tuple[str, re.Pattern, re.Pattern]]:
    out = []
    for label, words, value in fixed.ANCHORS:
        if words is None:
            pattern = rf"(?i)\b({fixed.VERB_NEGATION}\s+)?(?:live[sd]?|reside[sd]?)()\s+at\s+()(.{{1,80}}?){fixed.ZONE_END}"
        else:
            pattern = rf"(?i)\b({fixed.NEGATION}\s+)?{fixed.POSSESSIVE}\s+(?:{words})\s+({fixed.COPULA})\s+((?:\w+\s+){{0,2}}not\s+)?(.{{1,80}}?){fixed.ZONE_END}"
        out.append((label, re.compile(pattern), value_pattern(value)))
    return out


def value_pattern(value: str) -> re.Pattern:
    """A pattern of alternatives that may each begin with a flag, which Python wants at the start of all."""
    insensitive = "(?i)" in value
    return re.compile(re.sub(r"\(\?i\)(.*?)(?=\||$)", r"\1", value).replace("(?i)", ""), re.IGNORECASE if insensitive else 0)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _saudi(number: str) -> bool:
    """Ten digits led by 1 or 2: doubling from the first digit, total divisible by ten."""
    return len(number) == 10 and number[0] in "12" and luhn(number)


def _kuwait(number: str) -> bool:
    """Twelve digits: eleven minus the weighted sum modulo eleven is the last digit."""
    wanted = 11 - sum(int(d) * w for d, w in zip(number[:11], fixed.KUWAIT_WEIGHTS, strict=True)) % 11 if len(number) == 12 else 10
    return wanted < 10 and wanted == int(number[11])


def _uae(number: str) -> bool | None:
    """Fifteen digits: Luhn's rule; None where the shape is another."""
    return luhn(number) if len(number) == 15 else None


CHECKSUMS = {"saudi": _saudi, "kuwait": _kuwait, "uae": _uae}


def locked_in(sentence: str) -> list[tuple]:
    """(start, end, label, confidence, format, source, negated) of the values that ownership anchors name ("my e-mail is ...").

    An anchor ends with a zone of at most 80 characters; the first value in it is the span. Negated anchors have
    confidence 0.9, others 0.95."""
    found = []
    if not compiled(ANCHORED).search(sentence):
        return found
    for label, anchor, value in _anchors():
        for m in anchor.finditer(sentence):
            hit = value.search(m.group(4))
            if not hit or (label == "CREDIT_CARD" and not luhn(re.sub("[ -]", "", hit.group()))):
                continue
            first = m.start(4) + hit.start()
            negated = bool(m.group(1) or m.group(3)) or "n't" in m.group(2).lower()
            found.append((first, first + len(hit.group()), label, 0.9 if negated else 0.95, "anchor", "locked", negated))
    return found


def locked_resolved(locked: Iterable[tuple]) -> list[tuple]:
    """Spans (start, end, ..., confidence at place 3) in order; the first accepted span that a later one
    overlaps is replaced by it only if its confidence is greater. Accepted spans that end before a later one starts are done with."""
    kept: list[tuple] = []
    open_: list[int] = []
    for s in sorted(locked):
        open_ = [i for i in open_ if kept[i][1] > s[0]]
        over = next((i for i in open_ if kept[i][0] < s[1]), None)
        if over is None:
            open_.append(len(kept))
            kept.append(s)
        elif s[3] > kept[over][3]:
            kept[over] = s
    return kept


def free_of(spans: Iterable[tuple], taken: Iterable[tuple]) -> list[tuple]:
    """The spans that none of the taken ones overlaps."""
    starts, reach = [], []
    for start, end in sorted((t[0], t[1]) for t in taken):
        starts.append(start)
        reach.append(max(end, reach[-1] if reach else end))
    return [s for s in spans if not (i := bisect.bisect_left(starts, s[1])) or reach[i - 1] <= s[0]]


def to_original(places: list[int] | None, start: int, end: int) -> tuple[int, int]:
    """Ends of a span of the normalized text in the original."""
    if places is None:
        return start, end
    first = places[start] if start < len(places) else start
    return first, places[end - 1] + 1 if end > 0 else first


def whole(text: str, families: Iterable, normalized: Callable[[str], tuple[str, list[int] | None]]) -> list[tuple]:
    """The whole run on a text: spans as of `locked_in`, with offsets in the text as it is.

    Detectors read the normalized text; their spans are mapped back and repaired on the original. Values that
    ownership anchors name, sentence by sentence, take the place of all detected spans they overlap."""
    read, places = normalized(text)
    mapped = ((*to_original(places, s[0], s[1]), *s[2:]) for s in spans_in(read, families))
    plain = [(*s[:6], False) for s in repaired(text, [s for s in mapped if s[0] < s[1]])]
    locked = []
    if compiled(ANCHORED).search(read):
        for a, b in sentences_in(read):
            for s in locked_in(read[a:b]):
                start, end = to_original(places, s[0] + a, s[1] + a)
                if start < end:
                    locked.append((start, end, *s[2:]))
    if not locked:
        return plain
    locked = locked_resolved(locked)
    return sorted(free_of(plain, locked) + locked)


def spliced(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """The text with edits applied from left to right; one that starts before the last one's end is skipped."""
    at, out = 0, []
    for start, end, new in sorted(edits):
        if start >= at:
            out += (text[at:start], new)
            at = end
    return "".join([*out, text[at:]])


def context(text: str, acted: Iterable[int]) -> list[tuple[int, int]]:
    """Sentences beside one in which an acted-on span starts, unless one starts in them too."""
    sentences = sentences_in(text)
    starts = [a for a, _ in sentences]
    hit = {i for s in acted if (i := bisect.bisect_right(starts, s) - 1) >= 0 and s < sentences[i][1]}
    return [sentences[i] for i in range(len(sentences)) if i not in hit and (i - 1 in hit or i + 1 in hit)]
