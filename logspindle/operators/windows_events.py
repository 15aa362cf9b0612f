"""Windows event XML: message routing, event splitting, field extraction, declarative definitions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import blank_null, level_name, rfc3339, xml_unescape

_EVENT = r"(?s)(<Event(?:\s[^>]*)?(?<!/)>.*?)</Event>"


def message_type(body: Column) -> Column:
    """Subscription, Events, Heartbeat or Unknown, by the first 2000 characters. A lone ``<Event xmlns=...>`` is Unknown."""
    head = F.left(body, F.lit(2000))
    has = lambda s: head.contains(s)
    return F.when(has("Subscribe") & has("SubscriptionId"), "Subscription").when(has("<Events>") | has("<Event>"), "Events").when(has("Heartbeat"), "Heartbeat").otherwise("Unknown")


def tag_text(xml: Column, tag: str) -> Column:
    """Text of the first element of that name; null if there is none."""
    pattern = rf"(?s)<{tag}(?:\s[^>]*)?(?<!/)>(.*?)</{tag}>"
    return F.when(xml.rlike(pattern), F.regexp_extract(xml, pattern, 1))


def split_events(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """A row for each ``<Event>``: raw_xml (without its end tag) and event_no, beside the columns of ``bodies``."""
    events = F.regexp_extract_all(F.col(body_col), F.lit(_EVENT), F.lit(1))
    return bodies.select("*", F.posexplode(events).alias("event_no", "raw_xml"))


def extract_fields(events: DataFrame, *, now: Column | None = None) -> DataFrame:
    """Adds provider, event_id, level, time_created, computer, message; a bad number is 0, a missing time ``now``."""
    xml = F.col("raw_xml")
    number = lambda t: F.coalesce(F.try_to_number(F.regexp_extract(F.trim(tag_text(xml, t)), r"^(\d{1,9})\z", 1), F.lit("999999999")).cast("int"), F.lit(0))
    text = lambda t: F.coalesce(xml_unescape(F.trim(tag_text(xml, t))), F.lit(""))
    stamp = F.coalesce(rfc3339(F.trim(tag_text(xml, "TimeCreated"))), rfc3339(F.regexp_extract(xml, r"""<TimeCreated\s+SystemTime\s*=\s*["']([^"']*)["'][^>]*/>""", 1)))
    data = xml_unescape(F.trim(tag_text(xml, "Data")))
    return events.withColumns(
        {
            "provider": text("Provider"), "event_id": number("EventID"), "level": level_name(number("Level")), "computer": text("Computer"),
            "time_created": F.coalesce(stamp, now if now is not None else F.current_timestamp()), "message": F.coalesce(blank_null(xml_unescape(F.trim(tag_text(xml, "Message")))), blank_null(data)),
        }
    )


def event_label(provider: Column, event_id: Column) -> Column:
    label = F.when(provider == "", F.concat(F.lit("EventID "), event_id.cast("string"))).otherwise(F.concat_ws(":", provider, event_id.cast("string")))
    return F.when(event_id.isNull(), "unknown").otherwise(label)


def subscription(body: Column, fresh: Column | None = None) -> Column:
    """subscription_id (a fresh one if missing), query, heartbeat_interval."""
    own = F.concat(F.lit("sub_"), F.uuid()) if fresh is None else fresh
    interval = F.regexp_extract(tag_text(body, "HeartbeatInterval"), r"^(\d{1,18})\z", 1)
    return F.struct(F.coalesce(tag_text(body, "SubscriptionId"), own).alias("subscription_id"), tag_text(body, "Query").alias("query"), blank_null(interval).cast("long").alias("heartbeat_interval"))


def heartbeat(body: Column) -> Column:
    return F.struct(F.coalesce(tag_text(body, "SubscriptionId"), F.lit("")).alias("subscription_id"))


def to_table(events: DataFrame) -> DataFrame:
    """The stored event table; event_data is JSON of the whole event. Rows without an event id are left out."""
    parsed = F.struct("provider", "event_id", "level", "time_created", "computer", "message")
    whole = F.to_json(F.struct("source_host", "subscription_id", "raw_xml", parsed.alias("parsed")))
    return events.where(F.col("event_id").isNotNull()).select(F.col("event_id").cast("long").alias("event_id"), F.col("time_created").alias("timestamp"), "source_host", "subscription_id", whole.alias("event_data"))


@dataclass
class EventField:
    name: str
    source: str = "eventdata"
    required: bool = False
    type: str = "string"


@dataclass
class EventDefinition:
    """How one event id is read: fields, lookups by field, and a message template."""

    event_id: int
    name: str = ""
    description: str = ""
    fields: list[EventField] = field(default_factory=list)
    enrichments: dict[str, dict[str, str]] = field(default_factory=dict)
    output_format: str | None = None

    @classmethod
    def of(cls, raw: dict) -> EventDefinition:
        """From a parsed YAML document. Sources and types are taken in any case."""
        fields = [EventField(f["name"], str(f.get("source", "eventdata")).lower().replace("_", ""), bool(f.get("required", False)), str(f.get("type", f.get("field_type", "string"))).lower()) for f in raw.get("fields") or []]
        lookups = {e["field"]: {str(k): str(v) for k, v in e["lookup_table"].items()} for e in raw.get("enrichments") or []}
        return cls(int(raw["event_id"]), raw.get("name", ""), raw.get("description", ""), fields, lookups, raw.get("output_format"))


def load_definitions(spark: SparkSession, path: str) -> dict[int, EventDefinition]:
    """A folder of YAML files (by name; of equal ids the last counts; none is an error), or one file with ``event_parsers``.

    Read by Spark, so the path may lie in any file system that it knows. Definitions are configuration: they come to the driver.
    """
    import yaml

    one = path.lower().endswith((".yml", ".yaml"))
    files = spark.read.option("pathGlobFilter", "*.{yml,yaml,YML,YAML}").text(path, wholetext=True)
    rows = sorted((r["path"], r["value"]) for r in files.select(F.col("_metadata.file_path").alias("path"), "value").collect())
    if not rows:
        raise ValueError(f"no event definitions in {path}")
    docs = [yaml.safe_load(text) or {} for _, text in rows]
    raw = list(docs[0].get("event_parsers", {}).values()) if one and "event_id" not in docs[0] else docs
    return {d.event_id: d for d in map(EventDefinition.of, raw)}


def field_value(xml: Column, f: EventField) -> Column:
    """The field's value with its type; null if it is missing or no such number."""
    if f.source in ("eventdata", "userdata"):
        name = f.name.replace("\\", "\\\\")
        opened = rf'(?s)<Data Name="\Q{name}\E"[^>]*?(?<!/)>(.*?)</Data>'
        value = F.when(xml.rlike(rf'<Data Name="\Q{name}\E"[^>]*/>'), F.lit("")).when(xml.rlike(opened), F.trim(F.regexp_extract(xml, opened, 1)))
    elif f.source == "renderinginfo":
        pattern = r"(?s)<Message>(.*?)</Message>"
        value = F.when(xml.rlike(pattern), F.trim(F.regexp_extract(xml, pattern, 1)))
    else:
        pattern = rf"(?s)<\Q{f.name}\E>(.*?)</\Q{f.name}\E>"
        value = F.when(xml.rlike(pattern), F.trim(F.regexp_extract(xml, pattern, 1)))
    if f.type == "integer":
        return F.when(value.rlike(r"^[+-]?\d{1,19}\z"), value.try_cast("bigint")).cast("string")
    if f.type == "boolean":
        return F.when(value.isNotNull(), ((F.lower(value) == "true") | (value == "1")).cast("string"))
    return value


def _template(text: str, values: dict[str, Column]) -> Column:
    """``text`` with {name} replaced where the value isn't null; other placeholders stay."""
    import re

    parts = []
    for piece in re.split(r"(\{[^{}]+\})", text):
        known = values.get(piece[1:-1]) if piece.startswith("{") else None
        if piece:
            parts.append(F.lit(piece) if known is None else F.coalesce(known, F.lit(piece)))
    return F.regexp_replace(F.concat(*parts), r"^\s+|\s+\z", "") if parts else F.lit("")


def apply_definitions(events: DataFrame, definitions: Iterable[EventDefinition]) -> DataFrame:
    """Adds parser_name, fields and enrichments (maps of text) and formatted_message; null where no definition fits or a required field is missing."""
    out = events
    parser = fields = extra = message = F.lit(None)
    empty = F.create_map().cast("map<string,string>")
    as_map = lambda pairs: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]), lambda x: x["value"].isNotNull())) if pairs else empty
    for d in definitions:
        values = {f.name: field_value(F.col("raw_xml"), f) for f in d.fields}
        whole = F.col("event_id") == d.event_id
        for f in d.fields:
            if f.required:
                whole = whole & values[f.name].isNotNull()
        named = {}
        for name, table in d.enrichments.items():
            if name in values:
                lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
                named[f"{name}_Name"] = F.try_element_at(lookup, values[name])
        parser = F.when(whole, d.name).otherwise(parser)
        fields = F.when(whole, as_map(values)).otherwise(fields)
        extra = F.when(whole, as_map(named)).otherwise(extra)
        if d.output_format:
            message = F.when(whole, _template(d.output_format, {**values, **named})).otherwise(message)
    return out.withColumns({"parser_name": parser.cast("string"), "fields": fields.cast("map<string,string>"), "enrichments": extra.cast("map<string,string>"), "formatted_message": message.cast("string")})


def supported_events(definitions: dict[int, EventDefinition]) -> list[int]:
    return sorted(definitions)


#: The logon definition, with the codes of logon types.
LOGON = EventDefinition.of(
    {
        "event_id": 4624, "name": "Successful Logon", "description": "An account was successfully logged on",
        "fields": [
            {"name": "TargetUserName", "required": True}, {"name": "TargetDomainName", "required": True}, {"name": "LogonType", "required": True, "type": "integer"},
            {"name": "IpAddress"}, {"name": "IpPort"},
        ],
        "enrichments": [{"field": "LogonType", "lookup_table": {
            "2": "Interactive", "3": "Network", "4": "Batch", "5": "Service", "7": "Unlock", "8": "NetworkCleartext", "9": "NewCredentials", "10": "RemoteInteractive", "11": "CachedInteractive",
        }}],
        "output_format": "User {TargetUserName} from {TargetDomainName} logged on via {LogonType_Name} from {IpAddress}:{IpPort}\n",
    }
)
