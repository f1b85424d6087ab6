"""Scalar functions: paths, names, topics, statements and escapes. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results must agree on.
VERB_PREFIXES = ("GET", "POST", "PUT", "DELETE", "PATCH")
UNDECLARED_VERB = "未声明"
DYNAMIC_DESTINATION = "动态 RocketMQ destination:"
NO_TABLE_NAMES = ("T", "E", "K", "V", "Object", "Any", "?", "")
READ_PREFIXES = ("select", "get", "list", "page", "count")
WRITE_PREFIXES = ("insert", "update", "delete", "remove", "save")


def blank_to_null(value: Column) -> Column:
    """Null for null and blank text, else the text as it is."""
    return F.when(value.rlike(r"\S"), value)


def normalize_path(*parts: Column, fixed: bool = False) -> Column:
    """One path from its parts: blank parts left out, spaces and slashes trimmed, one slash between, one before.

    ``fixed`` also gives the path of a lone ``/`` at either end no second slash.
    """
    some = F.array_compact(F.array(*[blank_to_null(p) for p in parts]))
    trimmed = F.transform(some, lambda p: F.regexp_replace(F.trim(p), "^/+|/+$", ""))
    if fixed:
        trimmed = F.filter(trimmed, lambda p: p != "")
    joined = F.regexp_replace(F.array_join(trimmed, "/"), "/+", "/")
    return F.when(F.trim(joined) == "", F.lit("/")).otherwise(F.concat(F.lit("/"), joined))


def camel_to_snake(name: Column) -> Column:
    step = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(step, "([a-z0-9])([A-Z])", "$1_$2"))


def table_from_class(name: Column) -> Column:
    """Table that a mapper class's name suggests; null for placeholders."""
    base = F.regexp_replace(F.regexp_replace(name, "Mapper$", ""), "Example$", "")
    return F.when(~F.trim(base).isin(*NO_TABLE_NAMES), camel_to_snake(base))


def entity_table(table_name: Column, table: Column, entity: Column, class_name: Column) -> Column:
    """struct(name, explicit): the first name that an annotation gives, else one made of the class name."""
    given = F.coalesce(*[blank_to_null(c) for c in (table_name, table, entity)])
    made = camel_to_snake(F.regexp_replace(class_name, "Example$", ""))
    return F.struct(F.coalesce(given, made).alias("name"), given.isNotNull().alias("explicit"))


def decapitalize(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def method_key(project: Column, owner: Column, name: Column, parameters: Column) -> Column:
    return F.concat(project, F.lit("::"), owner, F.lit("#"), name, F.lit("("), F.array_join(parameters, ","), F.lit(")"))


def http_verb(method_name: Column) -> Column:
    """Verb that a client method's name begins with."""
    low = F.lower(method_name)
    found = reduce(lambda w, v: w.when(low.startswith(v.lower()), F.lit(v)), VERB_PREFIXES[1:], F.when(low.startswith("get"), F.lit("GET")))
    return found.otherwise(F.lit(UNDECLARED_VERB))


def mapping_verb(short_name: Column, text: Column) -> Column:
    """Verb of a mapping annotation: by its name, or the first request method that its text names."""
    named = F.regexp_extract(short_name, "^(Get|Post|Put|Delete|Patch)Mapping$", 1)
    inside = F.regexp_extract(text, r"RequestMethod\.([A-Z]+)", 1)
    return F.when(named != "", F.upper(named)).when(inside != "", inside).otherwise(F.lit(UNDECLARED_VERB))


def redis_operation(name: Column) -> Column:
    return F.when(name.startswith("get") | name.startswith("has") | name.startswith("opsFor"), "READ").otherwise("WRITE")


def generic_mapper_operation(name: Column) -> Column:
    return F.when(name.startswith("select") | name.startswith("count") | name.startswith("exists"), "READ").otherwise("WRITE")


def orm_operation(name: Column) -> Column:
    """READ, WRITE, or null for a method that isn't one of the ORM's own."""
    any_of = lambda ps: reduce(lambda a, b: a | b, [name.startswith(p) for p in ps])
    return F.when(any_of(READ_PREFIXES), "READ").when(any_of(WRITE_PREFIXES), "WRITE")


def repository_operation(name: Column) -> Column:
    return F.when(name.startswith("save") | name.startswith("delete") | name.startswith("remove"), "WRITE").otherwise("READ")


def statement_operation(sql: Column) -> Column:
    low = F.lower(F.ltrim(sql))
    return F.when(low.startswith("select") | low.startswith("with"), "READ").otherwise("WRITE")


def clean_statement(sql: Column) -> Column:
    """A mapper's statement without tags, its parameters as NULL."""
    return F.regexp_replace(F.regexp_replace(sql, "<[^>]+>", " "), r"[#$]\{[^}]+\}", "NULL")


def is_dynamic(sql: Column) -> Column:
    return F.contains(sql, F.lit("${"))


def tables_by_keyword(sql: Column) -> Column:
    """Names that follow from, join, into or update, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:from|join|into|update)\s+([a-zA-Z_][\w.]*)"), F.lit(1)))


def is_placeholder(value: Column) -> Column:
    return value.startswith("${") & value.endswith("}")


def unwrap(value: Column) -> Column:
    """``x`` of ``${x}``, else the value."""
    return F.when(is_placeholder(value) & (F.length(value) >= 3), F.regexp_replace(value, r"^\$\{|\}$", "")).otherwise(value)


def topic_part(topic: Column) -> Column:
    """What stands before the tag."""
    return F.substring_index(topic, ":", 1)


def topic_key(topic: Column) -> Column:
    """Last dotted name of a topic, without ``${}``."""
    return F.element_at(F.split(unwrap(topic), r"\."), -1)


def match_key(topic: Column) -> Column:
    """Two topics meet if and only if their keys are equal: placeholders whole, others by the last dotted name."""
    part = topic_part(topic)
    return F.when(is_placeholder(part), F.concat(F.lit("p:"), part)).otherwise(F.concat(F.lit("k:"), topic_key(part)))


def destination(topic: Column, tag: Column) -> Column:
    """topic:tag; a blank tag and ``*`` add nothing."""
    return F.when(blank_to_null(tag).isNull() | (tag == "*"), topic).otherwise(F.concat(topic, F.lit(":"), tag))


def confidence_of_destination(name: Column) -> Column:
    """Certain unless the topic is only known as an expression."""
    return F.when(name.startswith(DYNAMIC_DESTINATION), 2).otherwise(0)


def markdown(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def csv_field(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def xml_escape(value: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), pairs, value)


def quote_label(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def node_id(key: Column) -> Column:
    """``n`` and the 31-polynomial hash of the characters as unsigned hex (characters of the basic plane)."""
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.concat(F.lit("n"), F.lower(F.hex(h)))


def column_letters(index: int) -> str:
    """Spreadsheet name of a column counted from 0."""
    name, n = "", index + 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def matches_rule(value: Column, rule: str) -> Column:
    """Case-insensitive substring, or a regular expression after ``regex:``; a broken expression matches nothing."""
    import re

    if not rule.startswith("regex:"):
        return F.contains(F.lower(value), F.lit(rule.lower()))
    try:
        re.compile(rule[6:])
    except re.error:
        return F.lit(False)
    return value.rlike("(?i)" + rule[6:])


def matches_any(value: Column, rules: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [matches_rule(value, r) for r in rules], F.lit(False))


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.startswith(p) for p in prefixes], F.lit(False))


def path_error(value: Column) -> Column:
    """The first rule of an input path that a value breaks, as a code; null if none."""
    return (
        F.when(~value.startswith("/"), "no_leading_slash")
        .when(value == "/", "root_only")
        .when(value.rlike(r"\s"), "white_space")
        .when(F.contains(value, F.lit("://")), "scheme_or_host")
        .when(value.rlike("[?#]"), "query_or_fragment")
    )


def display_path(path: Column, first: int = 1, last: int = 6, longest: int = 8) -> Column:
    """Evidence path; one of more than ``longest`` hops as its first and its last ``last``."""
    short = F.concat(F.slice(path, 1, first), F.array(F.lit("...")), F.slice(path, -last, last))
    return F.array_join(F.when(F.size(path) > longest, short).otherwise(path), " -> ")


def split_list(value: Column) -> Column:
    """Items between commas and new lines, trimmed, without blanks."""
    return F.filter(F.transform(F.split(value, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
