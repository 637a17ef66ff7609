"""What annotations say about a symbol, as column expressions over arrays of annotations.

An annotation is a struct (name, args) whose args are structs (name, value); a positional value has an
empty name. Names are simple names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Annotation names and what they stand for.
STEREOTYPES = {
    "RestController": "CONTROLLER",
    "Controller": "CONTROLLER",
    "Service": "SERVICE",
    "Repository": "REPOSITORY",
    "Configuration": "CONFIGURATION",
    "Bean": "CONFIGURATION",
    "Entity": "JPA_ENTITY",
    "Table": "JPA_ENTITY",
    "Component": "COMPONENT",
}
FIELD_INJECTION = ("Autowired", "Inject")
HTTP_VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": None}
MODULE_TYPES = ("AbstractModule", "PrivateModule")


def simple_name(text: Column) -> Column:
    """A type or annotation name without type arguments and package."""
    return F.substring_index(F.substring_index(F.trim(text), "<", 1), ".", -1)


def mapped(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def last_or(values: Column, default: str) -> Column:
    return F.when(F.size(values) > 0, F.element_at(values, -1)).otherwise(F.lit(default))


def has(names: Column, *wanted: str) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


def spring_stereotype(names: Column) -> Column:
    """The stereotype of the last annotation that has one, else NONE."""
    table = mapped(STEREOTYPES)
    return last_or(F.filter(F.transform(names, lambda n: table[n]), lambda x: x.isNotNull()), "NONE")


def argument(annotation: Column, *names: str) -> Column:
    """The value of the first argument with one of these names ("" for a positional one), or null."""
    return F.get(F.filter(annotation["args"], lambda a: a["name"].isin(*names)), F.lit(0))["value"]


def unquoted(value: Column, every: bool) -> Column:
    return F.replace(value, F.lit('"'), F.lit("")) if every else F.regexp_replace(value, '^"|"$', "")


def http_mapping(annotation: Column, kotlin: bool) -> Column:
    """(method, path) of a mapping annotation."""
    positional = argument(annotation, "")
    path = F.coalesce(argument(annotation, "path"), argument(annotation, "value"), positional) if kotlin else F.coalesce(argument(annotation, "value", "path", ""), F.lit(None))
    method = argument(annotation, "method")
    verb = F.upper(F.substring_index(method, ".", -1)) if kotlin else F.upper(F.replace(method, F.lit("RequestMethod."), F.lit("")))
    fixed = mapped({k: v for k, v in HTTP_VERBS.items() if v})[annotation["name"]]
    return F.struct(F.coalesce(fixed, verb, F.lit("ANY")).alias("method"), F.coalesce(unquoted(path, not kotlin), F.lit("")).alias("path"))


def http_mappings(annotations: Column, kotlin: bool) -> Column:
    return F.transform(F.filter(annotations, lambda a: a["name"].isin(*HTTP_VERBS)), lambda a: http_mapping(a, kotlin))


def spring(annotations: Column, kotlin: bool = False) -> Column:
    names = F.transform(annotations, lambda a: a["name"])
    return F.struct(
        spring_stereotype(names).alias("stereotype"),
        F.when(has(names, *FIELD_INJECTION), "FIELD").otherwise("NONE").alias("injection_type"),
        has(names, "Transactional").alias("transactional"),
        has(names, "Async").alias("async"),
        has(names, "Scheduled").alias("scheduled"),
        http_mappings(annotations, kotlin).alias("http_mappings"),
    )


def guice(annotations: Column, target: Column, supertypes: Column, kotlin: bool = False) -> Column:
    """`target` is the injection type that Inject means here; a supertype that makes a module overrides Provides."""
    names = F.transform(annotations, lambda a: a["name"])
    named = F.filter(annotations, lambda a: a["name"] == "Named")
    values = F.filter(F.transform(named, lambda a: unquoted(argument(a, "") if kotlin else F.coalesce(argument(a, ""), argument(a, "value")), not kotlin)), lambda v: v.isNotNull())
    return F.struct(
        F.when(has(supertypes, *MODULE_TYPES), "MODULE").when(has(names, "Provides"), "PROVIDES").otherwise("NONE").alias("stereotype"),
        F.when(has(names, "Inject"), target).otherwise("NONE").alias("injection_type"),
        has(names, "Singleton").alias("singleton"),
        has(names, "RequestScoped").alias("request_scoped"),
        has(names, "SessionScoped").alias("session_scoped"),
        last_or(values, "").alias("named"),
    )
