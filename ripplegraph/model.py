"""Schemas of facts and results, enumerations and options."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# Labels by code, in order of uncertainty where there is one.
CONFIDENCE = {0: "已确认", 1: "推断", 2: "待确认"}
RESOURCE_TYPES = {"MYSQL": "MySQL", "REDIS": "Redis", "RABBITMQ": "RabbitMQ", "KAFKA": "Kafka", "ROCKETMQ": "RocketMQ", "EXTERNAL_HTTP": "外围接口"}
OPERATIONS = {"READ": "只读", "WRITE": "写入", "PRODUCE": "生产", "CONSUME": "消费", "CALL": "调用", "UNKNOWN": "未知"}
EXTERNAL_OPERATIONS = {"READ": "查询", "CALL": "非查询"}
ROW_STATUS = {"SUCCESS": "成功", "SKIPPED": "跳过", "FAILED": "失败"}
EXCLUDED_PREFIXES = ("java.", "javax.", "jakarta.", "kotlin.", "org.springframework.")
QUEUE_TYPES = ("KAFKA", "RABBITMQ", "ROCKETMQ")
RANGES = {"max_depth": (1, 100), "max_cross_depth": (1, 10), "row_timeout_seconds": (0, 86_400)}

FACTS = {
    "project": "name STRING, base_path STRING, is_open BOOLEAN, is_indexing BOOLEAN",
    "src_class": "project STRING, class_fqn STRING, short_name STRING, kind STRING, is_abstract BOOLEAN, is_final BOOLEAN, type_params ARRAY<STRING>, is_project_source BOOLEAN",
    "supertype": "project STRING, class_fqn STRING, super_fqn STRING, type_args ARRAY<STRING>, ord INT",
    "method": "project STRING, method_key STRING, class_fqn STRING, name STRING, param_types ARRAY<STRING>, return_type STRING, modifiers ARRAY<STRING>, text STRING, stmts ARRAY<STRING>, is_project_source BOOLEAN, ord INT",
    "call_site": "project STRING, call_id STRING, caller_key STRING, ord INT, kind STRING, callee_key STRING, ref_name STRING, text STRING, qualifier_type STRING, qualifier_type_args ARRAY<STRING>, qualifier_symbol STRING",
    "call_arg": "call_id STRING, pos INT, expr_id STRING, type_fqn STRING, type_args ARRAY<STRING>",
    "expr": "expr_id STRING, kind STRING, text STRING, const_value STRING, ref_symbol STRING, operands ARRAY<STRING>",
    "variable": "symbol STRING, kind STRING, name STRING, owner_fqn STRING, type STRING, init_expr_id STRING, ord INT",
    "annotation": "project STRING, target_kind STRING, target_id STRING, ord INT, fqn STRING, short_name STRING, attrs MAP<STRING,ARRAY<STRING>>, declared_attrs MAP<STRING,ARRAY<STRING>>, attr_text MAP<STRING,STRING>",
    "override": "super_method_key STRING, impl_method_key STRING",
    "config_file": "project STRING, ext_rank INT, path STRING, text STRING",
    "method_span": "project STRING, path STRING, method_key STRING, start INT, end INT",
    "mapper_file": "project STRING, path STRING, text STRING",
}


@dataclass(frozen=True)
class Options:
    """What an analysis follows and how; see ``of`` for the ranges."""

    max_depth: int = 30
    depth_first: bool = False
    only_project_source: bool = False
    excluded_prefixes: tuple[str, ...] = EXCLUDED_PREFIXES
    follow_local_consumers: bool = True
    follow_overrides: bool = False
    follow_cross_project: bool = False
    max_cross_depth: int = 3
    merge_resources: bool = False
    hide_accessors: bool = True
    query_patterns: tuple[str, ...] = ()
    http_client_prefixes: tuple[str, ...] = ()
    producer_annotations: tuple[str, ...] = ()
    consumer_annotations: tuple[str, ...] = ()
    producer_classes: tuple[str, ...] = ()
    consumer_interfaces: tuple[str, ...] = ()
    service_mappings: dict[str, str] = field(default_factory=dict)
    row_timeout_seconds: int = 0

    @staticmethod
    def of(settings: dict) -> Options:
        """Options from settings as text: lists by comma or line, ``k=v`` lines, numbers within their ranges."""
        out = {}
        for f in fields(Options):
            if f.name not in settings:
                continue
            value = settings[f.name]
            if f.name == "service_mappings" and isinstance(value, str):
                value = parse_mappings(value)
            elif f.name == "query_patterns" and isinstance(value, str):
                value = split_list(value, "\r\n")  # a pattern may hold commas
            elif str(f.type).startswith("tuple") and isinstance(value, str):
                value = split_list(value)
            out[f.name] = value
        for name, (low, high) in RANGES.items():
            if name in out:
                out[name] = min(max(int(out[name]), low), high)
        return Options(**out)


def effective(project: dict, everywhere: dict) -> dict:
    """The settings that hold for a project: its own, unless they say that those of all projects do."""
    return everywhere if project.get("use_shared") else project


def changed(a: dict, b: dict) -> set[str]:
    """Names of the settings that differ, lists compared item by item without blanks and repeats."""
    plain = lambda v: split_list(v, distinct=True) if isinstance(v, str) else v
    return {k for k in a.keys() | b.keys() if plain(a.get(k)) != plain(b.get(k))}


def split_list(value: str, between: str = ",\r\n", distinct: bool = False) -> tuple[str, ...]:
    """Items between commas and line ends, trimmed, without blanks."""
    for c in between[1:]:
        value = value.replace(c, between[0])
    items = [x.strip() for x in value.split(between[0]) if x.strip()]
    return tuple(dict.fromkeys(items) if distinct else items)


def parse_mappings(lines: str) -> dict[str, str]:
    """``k=v`` lines; blank lines, comments and lines without both sides are left out, the last of a key holds."""
    out = {}
    for line in lines.splitlines():
        name, sign, value = line.strip().partition("=")
        if sign and not name.startswith("#") and name.strip() and value.strip():
            out[name.strip()] = value.strip()
    return out
