"""Driver-side settings: rule sets, modules, channels and model providers.

They are small frozen records. Their patterns become literals inside column expressions; nothing here touches data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from logquarry.functions.patterns import decode_escapes
from logquarry.schema import rank_of

GROUPINGS = {
    "whole_file": "whole_file",
    "marker": "marker",
    "marker_based": "marker",
    "separator": "separator",
    "separator_based": "separator",
}


@dataclass(frozen=True)
class Grouping:
    kind: str = "whole_file"
    start: str | None = None
    end: str | None = None
    separator: str | None = None
    only_last: bool = False


@dataclass(frozen=True)
class RuleSet:
    """One rule set: which files it reads, how it groups lines and which patterns it reports."""

    name: str
    filename_regex: str = ".*"
    classifier: str = "regex_counter"
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    ignores: tuple[str, ...] = ()
    grouping: Grouping = field(default_factory=Grouping)


@dataclass(frozen=True)
class ModelGate:
    """When a finding is worth a model call, and how much of its surroundings to quote."""

    enabled: bool = False
    min_severity: str = "WARNING"
    max_excerpt_lines: int = 20
    context_prefix_lines: int = 0
    context_suffix_lines: int = 0
    template: str | None = None
    provider: str | None = None
    max_output_tokens: int | None = None


@dataclass(frozen=True)
class AlertChannel:
    module: str
    channel: str
    target: str
    min_severity: str = "ERROR"
    enabled: bool = True


@dataclass(frozen=True)
class Module:
    name: str
    path: str
    mode: str = "batch"
    pipeline: str | None = None
    output_format: str = "text"
    min_print_severity: str = "WARNING"
    gate: ModelGate = field(default_factory=ModelGate)
    from_beginning: bool = False
    interval_seconds: float = 1.0
    stale_after_minutes: int | None = None
    enabled: bool = True
    channels: tuple[AlertChannel, ...] = ()


@dataclass(frozen=True)
class Provider:
    name: str
    api_base: str
    model: str
    max_output_tokens: int | None = None
    max_excerpt_lines: int = 20
    temperature: float = 0.0
    top_p: float = 1.0
    max_tokens_per_hour: int | None = None
    max_tokens_per_day: int | None = None


# Reading a configuration. Each record has a table of its fields: where the value stands, what it must be, and what
# holds without it. Alternatives for a place are separated by a bar.


def text(value) -> str:
    return str(value)


def flag(value) -> bool:
    return bool(value)


def integer(value) -> int:
    return int(value)


def natural(value) -> int:
    if int(value) < 0:
        raise ValueError
    return int(value)


def positive(value) -> int:
    if int(value) < 1:
        raise ValueError
    return int(value)


def number(value) -> float:
    return float(value)


def severity(value) -> str:
    rank_of(value)
    return value.upper()


def regex(value) -> str:
    re.compile(value)
    return value


def escaped_regex(value) -> str:
    return regex(decode_escapes(value))


def regexes(value) -> tuple[str, ...]:
    return tuple(escaped_regex(v) for v in value if v)


def one_of(*names: str):
    def choice(value) -> str:
        if str(value).lower() not in names:
            raise ValueError
        return str(value).lower()

    choice.__name__ = "one of " + ", ".join(names)
    return choice


def file_text(value) -> str:
    return Path(value).read_text(encoding="utf-8")


RULE_SET_FIELDS = {
    "filename_regex": ("match.filename_regex", regex, ".*"),
    "classifier": ("classifier.type", text, "regex_counter"),
    "errors": ("classifier.error_regexes", regexes, ()),
    "warnings": ("classifier.warning_regexes", regexes, ()),
    "ignores": ("classifier.ignore_regexes", regexes, ()),
}
GROUPING_FIELDS = {
    "kind": ("type", one_of(*GROUPINGS), "whole_file"),
    "start": ("start_regex", escaped_regex, None),
    "end": ("end_regex", escaped_regex, None),
    "separator": ("separator_regex", escaped_regex, None),
    "only_last": ("only_last", flag, False),
}
MODULE_FIELDS = {
    "path": ("path", text, None),
    "mode": ("mode", one_of("batch", "follow"), "batch"),
    "pipeline": ("pipeline", text, None),
    "output_format": ("output_format", one_of("text", "json"), "text"),
    "min_print_severity": ("min_print_severity", severity, "WARNING"),
    "from_beginning": ("stream.from_beginning", flag, False),
    "interval_seconds": ("stream.interval", number, 1.0),
    "stale_after_minutes": ("stale_after_minutes", positive, None),
    "enabled": ("enabled", flag, True),
}
GATE_FIELDS = {
    "enabled": ("own.enabled|all.enabled", flag, False),
    "min_severity": ("own.min_severity", severity, "WARNING"),
    "max_excerpt_lines": (
        "own.max_excerpt_lines|own.max_chunk_lines|provider.max_excerpt_lines|all.max_excerpt_lines|all.max_chunk_lines", integer, 20),
    "context_prefix_lines": ("own.context_prefix_lines|all.context_prefix_lines", natural, 0),
    "context_suffix_lines": ("own.context_suffix_lines|all.context_suffix_lines", natural, 0),
    "template": ("own.prompt_template", file_text, None),
    "provider": ("own.provider", text, None),
    "max_output_tokens": ("own.max_output_tokens|own.max_tokens", integer, None),
}
# Kind of channel, places that must all be set, and the one that is the target.
CHANNELS = (("webhook", ("url",), "url"), ("mqtt", ("host", "topic"), "topic"))


def standing(item: dict, places: str):
    """The first value that is set at one of the places."""
    for place in places.split("|"):
        value = item
        for step in place.split("."):
            value = value.get(step) if isinstance(value, dict) else None
        if value is not None and value != "":
            return value
    return None


def fields(label: str, item: dict, table: dict) -> dict:
    out = {}
    for name, (places, kind, otherwise) in table.items():
        value = standing(item, places)
        try:
            out[name] = otherwise if value is None else kind(value)
        except (ValueError, TypeError, AttributeError, KeyError, OSError, re.error) as exc:
            raise ValueError(f"{label}: {places.split('|')[0]} is {value!r}, which is not {kind.__name__}") from exc
    return out


def read_rule_set(item: dict) -> RuleSet:
    """One entry of the `pipelines` section."""
    label = f"rule set {item['name']}"
    grouping = item.get("grouping") or {}
    grouping = {"type": grouping} if isinstance(grouping, str) else grouping
    if not isinstance(grouping, dict):
        raise ValueError(f"{label}: grouping is {grouping!r}, which is neither a name nor a mapping")
    chosen = fields(label, grouping, GROUPING_FIELDS)
    return RuleSet(
        name=item["name"], grouping=Grouping(**chosen | {"kind": GROUPINGS[chosen["kind"]]}), **fields(label, item, RULE_SET_FIELDS))


def read_rule_sets(config: dict) -> list[RuleSet]:
    out = [read_rule_set(item) for item in config.get("pipelines") or []]
    if not out:
        raise ValueError("the configuration names no rule set under `pipelines`")
    return out


def read_module(item: dict, defaults: dict | None = None) -> Module:
    """One entry of the `modules` section; `defaults` is the `llm` section that holds for all modules."""
    label, every, own = f"module {item['name']}", defaults or {}, item.get("llm") or {}
    named = own.get("provider") or every.get("default_provider")
    provider = (every.get("providers") or {}).get(named) or {}
    channels = []
    for kind, needed, target in CHANNELS:
        channel = standing(item, f"alerts.{kind}") or {}
        if all(channel.get(key) for key in needed):
            channels.append(AlertChannel(
                item["name"], kind, channel[target], severity(channel.get("min_severity", "ERROR")), flag(channel.get("enabled", True))))
    return Module(
        name=item["name"], channels=tuple(channels),
        gate=ModelGate(**fields(label, {"own": own, "all": every, "provider": provider}, GATE_FIELDS)),
        **fields(label, item, MODULE_FIELDS))
