"""Chat payloads of four wire formats as one table of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = "array<struct<type:string,text:string>>"
KNOWN = ("messages", "model", "system", "tools", "contents", "systemInstruction", "generationConfig", "max_tokens", "temperature", "stream", "format", "session_id")


def _is_string(payload: Column, path: str) -> Column:
    """Whether a top-level field is a JSON string (its raw form, read as a map of raw values, begins with a quote)."""
    raw = F.try_variant_get(F.try_parse_json(payload), path, "variant")
    return F.coalesce(F.schema_of_variant(raw) == "STRING", F.lit(False))


def wire_format(payload: Column) -> Column:
    """native (it says so), then gemini (`contents`), anthropic (a `system` that is a string), openai (`messages`), else error."""
    has = lambda path: F.get_json_object(payload, path).isNotNull()
    return F.when(F.get_json_object(payload, "$.format") == "native", "native").when(has("$.contents"), "gemini").when(_is_string(payload, "$.system"), "anthropic").when(has("$.messages"), "openai").otherwise("error")


def _flat(content: Column) -> Column:
    """A content's text: itself, or the text parts of a list joined by spaces; null where a list has none."""
    parts = F.from_json(content, _PART)
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])
    listed = content.startswith("[") & parts.isNotNull()
    return F.when(listed & (F.size(texts) > 0), F.array_join(texts, " ")).when(~F.coalesce(listed, F.lit(False)), content)


def messages(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """key, format, turn_index, role, content: a system prompt comes first, gemini's `model` is the
    assistant, list contents are flattened to their text."""
    raw = F.col(payload)
    kind = wire_format(raw)
    listed = F.from_json(F.get_json_object(raw, "$.messages"), "array<struct<role:string,content:string>>")
    plain = F.transform(listed, lambda m: F.struct(m["role"].alias("role"), _flat(m["content"]).alias("content")))
    contents = F.from_json(F.get_json_object(raw, "$.contents"), "array<struct<role:string,parts:array<struct<text:string>>>>")
    gemini = F.transform(contents, lambda c: F.struct(F.when(c["role"] == "model", "assistant").otherwise(F.coalesce(c["role"], F.lit("user"))).alias("role"), F.array_join(F.transform(c["parts"], lambda p: p["text"]), " ").alias("content")))
    instruction = F.array_join(F.transform(F.from_json(F.get_json_object(raw, "$.systemInstruction.parts"), "array<struct<text:string>>"), lambda p: p["text"]), " ")
    system = F.when(kind == "anthropic", F.get_json_object(raw, "$.system")).when((kind == "gemini") & (instruction != ""), instruction)
    first = F.when(system.isNotNull(), F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))).otherwise(F.expr("cast(array() as array<struct<role:string,content:string>>)"))
    body = F.when(kind == "gemini", gemini).otherwise(plain)
    rows = payloads.select(key, kind.alias("format"), F.concat(first, body).alias("all"))
    return rows.select(key, "format", F.posexplode("all").alias("turn_index", "m")).select(key, "format", "turn_index", "m.role", "m.content")


def tool_messages(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """key, turn_index, role, tool_call_id, name of native messages that answer a tool call or name their speaker."""
    raw = F.col(payload)
    listed = F.from_json(F.get_json_object(raw, "$.messages"), "array<struct<role:string,tool_call_id:string,name:string>>")
    rows = payloads.where(wire_format(raw) == "native").select(key, F.posexplode(listed).alias("turn_index", "m"))
    return rows.select(key, "turn_index", "m.role", "m.tool_call_id", "m.name").where("tool_call_id is not null or name is not null")


def parts(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """key, turn_index (of the payload's own messages), part, type, text, url: the parts of list contents, images as
    their URL, or as a data URL where a source holds base64."""
    listed = F.from_json(F.get_json_object(F.col(payload), "$.messages"), "array<struct<role:string,content:string>>")
    kinds = "array<struct<type:string,text:string,image_url:struct<url:string>,source:struct<type:string,media_type:string,data:string,url:string>>>"
    rows = payloads.select(key, F.posexplode(listed).alias("turn_index", "m")).where(F.col("m.content").startswith("["))
    each = rows.select(key, "turn_index", F.posexplode(F.from_json("m.content", kinds)).alias("part", "p"))
    source = F.col("p.source")
    inline = F.when(source["type"] == "base64", F.concat(F.lit("data:"), source["media_type"], F.lit(";base64,"), source["data"])).otherwise(source["url"])
    return each.select(key, "turn_index", "part", F.when(F.col("p.type").startswith("image"), "image").otherwise(F.col("p.type")).alias("type"), "p.text", F.coalesce("p.image_url.url", inline).alias("url"))


def settings(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """key, format, model, max_tokens, temperature, stream and tools (name, parameters as JSON) of each payload; anthropic's
    `input_schema` is a tool's parameters, and gemini's limits stand in its generationConfig."""
    raw = F.col(payload)
    get = lambda *paths: F.coalesce(*[F.get_json_object(raw, p) for p in paths])
    tools = F.from_json(F.get_json_object(raw, "$.tools"), "array<struct<name:string,input_schema:string,function:struct<name:string,parameters:string>>>")
    mapped = F.transform(tools, lambda t: F.struct(F.coalesce(t["name"], t["function"]["name"]).alias("name"), F.coalesce(t["input_schema"], t["function"]["parameters"]).alias("parameters")))
    return payloads.select(
        key, wire_format(raw).alias("format"), get("$.model").alias("model"), get("$.max_tokens", "$.generationConfig.maxOutputTokens").cast("int").alias("max_tokens"),
        get("$.temperature", "$.generationConfig.temperature").cast("double").alias("temperature"), F.coalesce(get("$.stream").cast("boolean"), F.lit(False)).alias("stream"), mapped.alias("tools"),
    )


def errors(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """The payloads of no known format, which `messages` leaves out."""
    return payloads.where(wire_format(F.col(payload)) == "error").select(key, F.col(payload).alias("payload"))


def extra(payload: Column) -> Column:
    """Top-level keys that no format knows, with their values as JSON text."""
    fields = F.from_json(payload, "map<string,string>")
    return F.map_filter(fields, lambda k, _: ~k.isin(*KNOWN))


def extra_keys(payload: Column) -> Column:
    """Top-level keys that no format knows, sorted."""
    return F.array_sort(F.array_except(F.json_object_keys(payload), F.array(*[F.lit(k) for k in KNOWN])))
