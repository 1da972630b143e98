"""Chunked replies rehydrated as a stream: a bounded held-back tail for each request.

Requests are dealt to GROUPS groups by their hash. What a batch brings of a group is taken in one call, and the state of
its open requests is one list, read and written at once: frames and calls to the store cost far more than the work on a
reply. A request leaves the state when its last chunk (numbered from 0) and all before it have come.

Text is released up to the last `<` that may still begin a token; a `<` whose following characters
cannot begin one holds nothing back, so at most one token's length waits. The released text of a
request is the same as that of the whole reply rehydrated at once.

With an output scan (`scan_stream`) the released text is that of `guard.scan_output` and then of the tokens being
opened, on the whole reply. What is found in a text can hang on its neighbourhood, so a reply is scanned up to places
that nothing crosses (`safe_cuts`): ends of sentences after a word of letters and before a letter. A part is released
once a further such place has come, since only then the next sentence, which may have to be blanked, is known, and
FAR characters after it, which a postal number may lie in; it is scanned together with as much of what was released
before. A reply without such places is held until its last chunk. A token is opened or kept closed by what was minted up to its part.
What a batch brings of a reply is scanned once; each chunk releases what it would have released had it come alone.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspan import session
from veilspan.functions import fixed
from veilspan.functions.text import normal_form
from veilspan.operators import detection, policy, sweep

_TOKEN = re.compile(fixed.TOKEN)
_PREFIX = re.compile(r"<(?:[A-Z_]*|[A-Z_]+_PII_[0-9a-f]{0,10})$")
OUTPUT = "request_id string, chunk_no int, released string, unresolved int"
#: Groups of requests; fixed, since the state of a stream hangs on it.
GROUPS = 4096
#: Rows of a frame of released text.
FRAME = 10_000


def held_from(text: str) -> int:
    """Where the tail begins that may still become a token."""
    at = text.rfind("<", max(0, len(text) - fixed.TOKEN_LENGTH + 1))
    return at if at >= 0 and _PREFIX.match(text, at) else len(text)


def resolved(text: str, values: dict[str, str], closed: Collection[str] = ()) -> tuple[str, int]:
    """The text with its tokens opened, and how many could not be. Tokens in `closed`, which the output scan
    minted, stay as they are."""
    missing = 0

    def value(match: re.Match) -> str:
        nonlocal missing
        if match.group(1) in closed:
            return match.group(0)
        found = values.get(match.group(1))
        missing += found is None
        return fixed.UNRESOLVED if found is None else found

    return _TOKEN.sub(value, text), missing


class Replies(StatefulProcessor):
    """Rows: part (the group), request_id, chunk_no, session_id, piece, last, entries (JSON of token_ids and values_ of the
    request's vault entries and of output_ids, or null). The entries come with any one chunk (the first is best) and are
    kept while the request is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "request_id string, held string")

    def step(self, held: dict, chunks: list[tuple], own: dict, closed: set) -> Iterator[tuple[str, int]]:
        """What each chunk (session_id, piece, last), in order, releases and how many tokens of it could not be opened; `own` are
        the request's values, `closed` the ids that stay closed, `held` what is kept until more comes."""
        raise NotImplementedError

    def _taken(self, held: dict, chunks: list[list]) -> Iterator[tuple]:
        chunks.sort(key=lambda c: c[0])
        own, closed = dict(held.get("own", ())), set(held.get("closed", ()))
        for no, _, _, last, entries in chunks:
            if isinstance(entries, str):
                new = json.loads(entries)
                own.update(zip(new.get("token_ids", ()), new.get("values_", ()), strict=True))
                closed.update(new.get("output_ids", ()))
            if last:
                held["end"] = no
        held["seen"] = held.get("seen", 0) + len(chunks)
        for chunk, done in zip(chunks, self.step(held, [c[1:4] for c in chunks], own, closed), strict=True):
            yield chunk[0], *done
        held.update(own=list(own.items()), closed=sorted(closed))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict = {}
        for frame in rows:
            for request, *chunk in zip(*(frame[c].tolist() for c in ("request_id", "chunk_no", "session_id", "piece", "last", "entries")), strict=True):
                fresh.setdefault(request, []).append(chunk)
        before = dict(self.open.get())
        after, out = dict(before), []
        for request, chunks in fresh.items():
            held = json.loads(before[request]) if request in before else {}
            out += [(request, *row) for row in self._taken(held, chunks)]
            if held["seen"] == held.get("end", -1) + 1:
                after.pop(request, None)
            else:
                after[request] = json.dumps(held)
            if len(out) >= FRAME:
                yield pd.DataFrame(out, columns=["request_id", "chunk_no", "released", "unresolved"])
                out = []
        if after:
            self.open.put(list(after.items()))
        elif before:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["request_id", "chunk_no", "released", "unresolved"])

    def close(self) -> None:
        pass


def _grouped(chunks: DataFrame, processor: Replies) -> DataFrame:
    session.ship_package(chunks.sparkSession)
    lists = [c for c in ("token_ids", "values_", "output_ids") if c in chunks.columns]
    some = F.greatest(*(F.size(c) for c in lists)) > 0
    rows = chunks.select(
        F.pmod(F.xxhash64("request_id"), F.lit(GROUPS)).alias("part"), "request_id", "chunk_no", F.col("session_id") if "session_id" in chunks.columns else F.lit("").alias("session_id"),
        F.coalesce("piece", F.lit("")).alias("piece"), F.coalesce("last", F.lit(False)).alias("last"), F.when(some, F.to_json(F.struct(*lists))).alias("entries"),
    )
    return rows.groupBy("part").transformWithStateInPandas(processor, OUTPUT, "Append", "None")


class Rehydrator(Replies):
    def step(self, held: dict, chunks: list[tuple], own: dict, closed: set) -> Iterator[tuple[str, int]]:
        tail = held.get("tail", "")
        for _, piece, last in chunks:
            text = tail + piece
            at = len(text) if last else held_from(text)
            tail = text[at:]
            yield resolved(text[:at], own, closed)
        held["tail"] = tail


#: Characters beside a span that decide on it at most.
FAR = 64
#: A sentence's end that no pattern, repair or spaced run reaches over: letters and one mark before it, a letter after it.
_SAFE = re.compile(rf"(?<=[A-Za-z]{{2}})(?=[.!?]\s)(?:{sweep.BOUNDARY})(?=[A-Za-z])")


def safe_cuts(text: str) -> list[int]:
    """Places at which a text can be scanned in parts. A field <name>...</name> that is still open holds them back."""
    out, tag, read = [], -1, 0
    for m in _SAFE.finditer(text):
        tag, read = max(tag, text.rfind("<", read, m.end())), m.end()
        if tag < 0 or text[tag : tag + 6].lower() != "<name>":
            out.append(m.end())
    return out


def token_id(session_id: str, secret: str, value: str) -> str:
    """The token of a value, as `expressions.token_id` mints it."""
    key = hashlib.sha256(f"{session_id}:{secret}".encode()).hexdigest()
    return hmac.new(bytes.fromhex(key), unicodedata.normalize("NFKC", value).encode(), hashlib.sha256).hexdigest()[:10]


class Scan:
    """What a policy makes of a reply: blocked values are marked, reversible ones become tokens."""

    def __init__(self, rules: dict[str, tuple], secret: str, packs: Iterable[str] = ("base_en",), negation_action: str | None = None, suppress_context: bool = False):
        self.rules, self.secret, self.packs, self.negation_action, self.suppress_context = rules, secret, tuple(packs), negation_action, suppress_context

    def edits(self, text: str, session_id: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, str]]]:
        """Edits of a text, and (place, id) of each token that they mint."""
        found = sweep.whole(text, detection.of_packs(self.packs, ner=False), normal_form)
        found = sweep.free_of(found, (m.span() for m in _TOKEN.finditer(text)))
        edits, minted, acted = [], [], []
        for start, end, label, confidence, _, _, negated in found:
            action = policy.decided(label, confidence, negated, self.rules, self.negation_action)
            new = text[start:end]
            if action == "BLOCK":
                new = f"[REDACTED_OUTPUT_{label}]"
            elif action == "REVERSIBLE":
                identity = token_id(session_id, self.secret, new)
                minted.append((start, identity))
                new = f"<{label}_PII_{identity}>"
            if action != "PRESERVE":
                acted.append(start)
            edits.append((start, end, new))
        if self.suppress_context and acted:
            edits += [(a, b, fixed.SUPPRESSED) for a, b in sweep.context(text, acted)]
        return edits, minted

    def part(self, before: str, text: str, upto: int, session_id: str) -> tuple[str, list[str]]:
        """`text` up to a place as it is shown, scanned with what was before it and what follows, and the ids minted in it."""
        return shown_part(text, 0, upto, len(before), *map(sorted, self.edits(before + text, session_id)))


def shown_part(text: str, first: int, last: int, offset: int, edits: list[tuple[int, int, str]], minted: list[tuple[int, str]]) -> tuple[str, list[str]]:
    """A part of a text as it is shown, and the ids minted in it, by the sorted edits of `offset` more characters and the text."""
    own = edits[bisect_left(edits, (first + offset,)) : bisect_left(edits, (last + offset,))]
    ids = minted[bisect_left(minted, (first + offset,)) : bisect_left(minted, (last + offset,))]
    skip = first + offset
    return sweep.spliced(text[first:last], [(a - skip, b - skip, new) for a, b, new in own]), [i for _, i in ids]


class Scanner(Replies):
    """Chunks carry their session_id."""

    def __init__(self, scan: Scan):
        self.scan = scan

    def step(self, held: dict, chunks: list[tuple], own: dict, closed: set) -> Iterator[tuple[str, int]]:
        before, waiting, at = held.get("before", ""), held.get("text", ""), 0
        text = waiting + "".join(piece for _, piece, _ in chunks)
        cuts, found = safe_cuts(text), {}
        for (session_id, _, last), end in zip(chunks, list(accumulate((len(piece) for _, piece, _ in chunks), initial=len(waiting)))[1:], strict=True):
            upto = end if last else releasable_at(cuts, at, end)
            if upto <= at:
                yield "", 0
                continue
            if session_id not in found:
                found[session_id] = tuple(map(sorted, self.scan.edits(before + text, session_id)))
            shown, fresh = shown_part(text, at, upto, len(before), *found[session_id])
            closed.update(fresh)
            at = upto
            yield resolved(shown, own, closed)
        held.update(before=kept_before(before + text[:at]), text=text[at:])


def releasable_at(cuts: list[int], at: int, end: int) -> int:
    """Up to where the text that is held from `at` to `end` can be released: the last safe place with a safe place and FAR
    characters after it. A place is seen as safe with the letter after it."""
    i = min(bisect_left(cuts, end) - 1, bisect_right(cuts, end - FAR))
    return max(cuts[i - 1], at) if i > 0 else at


def releasable(text: str) -> int:
    """Up to where held text can be released."""
    return releasable_at(safe_cuts(text), 0, len(text))


def kept_before(text: str) -> str:
    """The end of released text that a later scan needs: FAR characters and a sentence, from a safe place on."""
    cuts = [c for c in safe_cuts(text) if len(text) - c >= FAR]
    return text[cuts[-1] :] if cuts else text


def scan_stream(chunks: DataFrame, scan: Scan) -> DataFrame:
    """A streaming table of chunks to a streaming table of released text, scanned and with the input's tokens opened."""
    return _grouped(chunks, Scanner(scan))


def rehydrate_stream(chunks: DataFrame) -> DataFrame:
    """A streaming table of chunks to a streaming table of released text."""
    return _grouped(chunks, Rehydrator())


def dedupe_stream(records: DataFrame, key: str, time: str, watermark: str = "7 days") -> DataFrame:
    """At-least-once records to each record once, within the watermark."""
    return records.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])
