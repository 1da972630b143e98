"""What a policy makes of whole texts: sanitized messages, scanned replies, tool calls and files.

Each works in the row of its text: spans are found, decided and replaced as one array. What a request or a call has in
several rows is decided by a window over them, so that no text is scanned twice; of a file small columns are gathered.

A null text has no spans and stays null. Repeated rows are judged alike, once for each row.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from veilspan.functions import expressions as E
from veilspan.functions import fixed
from veilspan.operators import detection, policy, routing, spans, sweep
from veilspan.session import spread

Rules = dict[str, tuple]


def decisions_column(found: Column, rules: Rules, negation_action: str | None) -> Column:
    """array<struct<start,end,label,confidence,action,rule_id,value>> of a text's spans."""

    def decided(s: Column) -> Column:
        action, rule = policy.decide(s["label"], s["confidence"], s["negated"], rules, negation_action)
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "label", "confidence")], action.alias("action"), rule.alias("rule_id"), s["text"].alias("value"))

    return F.transform(found, decided)


def _decided(units: DataFrame, rules: Rules, text: str, packs: Iterable[str], ner: bool, negation_action: str | None, **run) -> DataFrame:
    """The units with `decisions`."""
    return spread(units).withColumn("found", detection.found_of(text, packs, ner, **run)).withColumn("decisions", decisions_column(F.col("found"), rules, negation_action)).drop("found")


def tokenized(units: DataFrame, rules: Rules, *, session: str, secret: str, text: str = "text", packs: Iterable[str] = ("base_en",), ner: bool = True, negation_action: str | None = "PRESERVE", **run) -> DataFrame:
    """The units with `decisions`: as of `decisions_column`, with token_id and token of each. `run` is handed to `detection.found_of`."""
    rows = spread(units).withColumn("found", detection.found_of(text, packs, ner, folded=True, **run)).withColumn("key_hex", E.session_key(F.col(session), secret))

    def minted(d: Column, s: Column) -> Column:
        identity = F.substring(E.hmac_sha256(F.col("key_hex"), s["folded"]), 1, 10)
        return F.struct(*[d[c].alias(c) for c in ("start", "end", "label", "confidence", "action", "rule_id", "value")], identity.alias("token_id"), E.token(d["label"], identity).alias("token"))

    decisions = F.zip_with(decisions_column(F.col("found"), rules, negation_action), "found", minted)
    return rows.withColumn("decisions", decisions).drop("found", "key_hex")


def _labels(decisions: Column, *actions: str) -> Column:
    return F.transform(F.filter(decisions, lambda d: d["action"].isin(*actions)), lambda d: d["label"])


def _edits(decisions: Column, new) -> Column:
    return F.transform(decisions, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), new(d).alias("new")))


_SANITIZED = ("injected", "decisions", "sanitized", "minted", "blocked", "notice")


def sanitize(messages: DataFrame, request: str, rules: Rules, *, session: str, secret: str, text: str = "text", injection: str | None = "FLAG", packs: Iterable[str] = ("base_en",), negation_action: str | None = "PRESERVE") -> DataFrame:
    """Messages with `sanitized` (values to be blocked or replaced as tokens), `injected`, `decisions`, `blocked`
    (sorted labels that refuse the request; PROMPT_INJECTION where `injection` is BLOCK), `minted` and the `notice`
    that goes before a request's messages when any token was minted and nothing is refused.

    Spans are found once a message: what its request decides is a window over its messages, and no join with a second run.
    A message refused for injection is not looked at further. With `injection` None none is looked for."""
    hit = F.lit(False)
    for c in routing.injection(F.col(text)).values():
        hit = hit | c
    hit = F.coalesce(hit, F.lit(False)) if injection else F.lit(False)
    refused = hit if injection == "BLOCK" else F.lit(False)
    rows = messages.withColumn("injected", hit).withColumn("looked_at", F.when(~refused, F.col(text)))
    rows = tokenized(rows, rules, session=session, secret=secret, text="looked_at", packs=packs, negation_action=negation_action)
    acted = F.filter("decisions", lambda d: d["action"].isin("REVERSIBLE", "BLOCK"))
    rows = rows.withColumn("sanitized", spans.splice(F.col("looked_at"), _edits(acted, lambda d: d["token"]))).withColumn("minted", F.size(acted)).drop("looked_at")
    own = F.concat(_labels(F.col("decisions"), "BLOCK"), F.when(refused, F.array(F.lit("PROMPT_INJECTION"))).otherwise(F.array().cast("array<string>")))
    of_request = Window.partitionBy(request)
    blocked = F.array_sort(F.array_distinct(F.flatten(F.collect_set("own_").over(of_request))))
    rows = rows.withColumn("own_", own).withColumn("any_", F.sum("minted").over(of_request) > 0).withColumn("blocked", blocked)
    return rows.withColumn("notice", F.when(F.col("any_") & (F.size("blocked") == 0), F.lit(fixed.TOKEN_NOTICE))).drop("own_", "any_").select(request, *[c for c in messages.columns if c != request], *_SANITIZED)


def vault_entries(rows: DataFrame, session: str) -> DataFrame:
    """session, token_id, value to be stored: of reversible decisions alone, each once."""
    kept = rows.select(session, F.explode(F.filter("decisions", lambda d: d["action"] == "REVERSIBLE")).alias("d"))
    return kept.select(session, "d.token_id", "d.value").distinct()


def scan_output(replies: DataFrame, rules: Rules, *, session: str, secret: str, text: str = "text", packs: Iterable[str] = ("base_en",), ner: bool = True, negation_action: str | None = None, suppress_context: bool = False, families: Iterable[str] | None = None) -> DataFrame:
    """Replies with `shown` (values to be blocked marked, reversible ones as tokens) and `output_ids` (tokens minted
    here, which stay closed). Tokens that a reply holds already are protected: no span over one counts. With
    `suppress_context` the sentences beside one with a replaced value are blanked, unless they hold one. With `families`
    only the families of these names are looked for."""
    rows = tokenized(replies, rules, session=session, secret=secret, text=text, packs=packs, ner=ner, negation_action=negation_action, protect=fixed.TOKEN, families=families)
    new = lambda d: F.when(d["action"] == "BLOCK", F.concat(F.lit("[REDACTED_OUTPUT_"), d["label"], F.lit("]"))).when(d["action"] == "REVERSIBLE", d["token"]).otherwise(d["value"])
    edits = _edits(F.col("decisions"), new)
    if suppress_context:
        acted = F.transform(F.filter("decisions", lambda d: d["action"].isin("BLOCK", "REVERSIBLE")), lambda d: d["start"])
        edits = F.concat(edits, F.transform(_context(F.col(text), acted), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(fixed.SUPPRESSED).alias("new"))))
    minted = F.array_distinct(F.transform(F.filter("decisions", lambda d: d["action"] == "REVERSIBLE"), lambda d: d["token_id"]))
    return rows.withColumn("shown", spans.splice(F.col(text), edits)).withColumn("output_ids", minted)


_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


@F.arrow_udf(from_arrow_type(_PLACES))
def _context(texts: pa.Array, acted: pa.Array) -> pa.Array:
    """Sentences beside one in which an acted-on span starts."""
    rows = [[] if t is None or not a else [{"start": s, "end": e} for s, e in sweep.context(t, a)] for t, a in zip(texts.to_pylist(), acted.to_pylist(), strict=True)]
    return pa.array(rows, _PLACES)


def scan_calls(args: DataFrame, call: str, tool_rules: DataFrame, *, session: str, secret: str, tool: str = "tool", arg: str = "arg", value: str = "value") -> DataFrame:
    """Tool calls, one row for each string argument, with `action` (PRESERVE where no rule names tool and
    argument), `hit`, `rewritten` (the argument as passed on; null for a refused call) and the call's `outcome`."""
    named = F.broadcast(tool_rules.select(F.col("tool").alias(tool), F.col("arg").alias(arg), F.col("rule").alias("action")))
    found = tokenized(args, {}, session=session, secret=secret, text=value).withColumn("hit", F.size("decisions") > 0)
    # Rules are joined last: the size that Spark takes a join to have is no measure for dealing rows to cores.
    rows = found.join(named, [tool, arg], "left").withColumn("action", F.coalesce("action", F.lit("PRESERVE")))
    marked = spans.splice(F.col(value), _edits(F.col("decisions"), lambda d: F.concat(F.lit(f"[{fixed.TOOL_TOKEN_PREFIX}"), d["token_id"], F.lit("]"))))
    rows = rows.withColumn("rewritten", F.when(F.col("hit") & (F.col("action") == "REVERSIBLE"), marked).otherwise(F.col(value)))
    of_call = Window.partitionBy(call)
    any_of = lambda action: F.bool_or(F.col("hit") & (F.col("action") == action)).over(of_call)
    judged = rows.withColumn("refused", any_of("BLOCK")).withColumn("changed", any_of("REVERSIBLE")).withColumn("outcome", F.when(F.col("refused"), "refused").when(F.col("changed"), "rewritten").otherwise("passed"))
    return judged.withColumn("rewritten", F.when(~F.col("refused"), F.col("rewritten"))).drop("refused", "changed")


def scan_units(units: DataFrame, rules: Rules, *, text: str = "text", packs: Iterable[str] = ("base_en",), negation_action: str | None = "PRESERVE") -> DataFrame:
    """Units of files with `decisions` and `masked`, the text with acted-on values as [REDACTED_label]."""
    decided = _decided(units, rules, text, packs, True, negation_action)
    new = lambda d: F.when(d["action"] == "PRESERVE", d["value"]).otherwise(F.concat(F.lit("[REDACTED_"), d["label"], F.lit("]")))
    return decided.withColumn("masked", spans.splice(F.col(text), _edits(F.col("decisions"), new)))


def findings(scanned: DataFrame, file: str, location: str) -> DataFrame:
    """file, location, label, action, start, end of each span."""
    rows = scanned.select(file, location, F.explode("decisions").alias("d"))
    return rows.select(file, location, *[f"d.{c}" for c in ("label", "action", "start", "end")])


def file_verdicts(scanned: DataFrame, file: str) -> DataFrame:
    """units, findings and blocked of each file."""
    own = scanned.groupBy(file).agg(F.count(F.lit(1)).alias("units"), F.sum(F.size("decisions")).alias("findings"), F.bool_or(F.size(_labels(F.col("decisions"), "BLOCK")) > 0).alias("blocked"))
    return own.withColumn("blocked", F.coalesce("blocked", F.lit(False)))
