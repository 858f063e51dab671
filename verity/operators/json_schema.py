"""Responses checked against the JSON Schema that came with each request.

Schemas are data: each distinct schema text is read once into rules (path, type,
minimum, maximum, required names), and a request's response is laid out as facts
(path, place, type, number, names). A rule meets the facts of its path inside the
row, so responses are never shuffled by field.

Read are ``type``, ``required``, ``properties``, ``minimum``, ``maximum``, ``items``
of the fields and ``additionalProperties`` of an item's fields, down to
``$.users[].loans.*``; other keywords are ignored, as an unknown one is by a
validator. Defined results: a null schema and one that is not JSON have null
rules; an empty table stays empty; requests are returned as often as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from verity.functions.records import _let

_LIMITS = "type:string,minimum:double,maximum:double"
_FIELD = f"struct<{_LIMITS},additionalProperties:struct<{_LIMITS}>>"
_ITEM = f"struct<type:string,required:array<string>,properties:map<string,{_FIELD}>>"
_SCHEMA = f"struct<type:string,required:array<string>,properties:map<string,struct<{_LIMITS},items:{_ITEM}>>>"
SALTS = 16
_RULES = "array<struct<path:string,type:string,minimum:double,maximum:double,required:array<string>>>"
_FACTS = "array<struct<path:string,place:string,type:string,number:double,names:array<string>>>"
_NAMES = "array<string>"


def _rule(path: Column, node: Column, limits: bool = True, required: bool = False) -> Column:
    none = F.lit(None)
    return F.struct(path.alias("path"), node["type"].alias("type"),
                    (node["minimum"] if limits else none.cast("double")).alias("minimum"),
                    (node["maximum"] if limits else none.cast("double")).alias("maximum"),
                    (node["required"] if required else none.cast(_NAMES)).alias("required"))


def _entries(properties: Column, rules) -> Column:
    return F.coalesce(F.flatten(F.transform(F.map_entries(properties), rules)), F.array().cast(_RULES))


def rules_of(schema: Column) -> Column:
    """Rules of a schema text; null where it is null or not JSON."""
    root = F.from_json(schema, _SCHEMA)

    def item_field(at):
        def rules(e):
            path = F.concat(at, F.lit("[]."), e["key"])
            rest = e["value"]["additionalProperties"]
            return F.concat(F.array(_rule(path, e["value"])),
                            F.when(rest.isNotNull(), F.array(_rule(F.concat(path, F.lit(".*")), rest))).otherwise(F.array().cast(_RULES)))
        return rules

    def field(e):
        path, item = F.concat(F.lit("$."), e["key"]), e["value"]["items"]
        below = F.concat(F.array(_rule(F.concat(path, F.lit("[]")), item, limits=False, required=True)),
                         _entries(item["properties"], item_field(path)))
        return F.concat(F.array(_rule(path, e["value"])), F.when(item.isNotNull(), below).otherwise(F.array().cast(_RULES)))

    rules = F.concat(F.array(_rule(F.lit("$"), root, limits=False, required=True)), _entries(root["properties"], field))
    return F.when(F.try_parse_json(schema).isNotNull(), rules)


def with_rules(requests: DataFrame, schema: str, out: str = "rules", salts: int = SALTS) -> DataFrame:
    """Each request with the rules of its schema. The requests of one schema, which
    may be most of them, are dealt over ``salts`` keys; its rules are one row a key."""
    name = f"`{schema}`"
    distinct = requests.select(F.col(name).alias("_schema")).where("_schema is not null").distinct()
    rules = distinct.select("_schema", rules_of(F.col("_schema")).alias(out)).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    plain = [F.col(f"`{f.name}`") for f in requests.schema if isinstance(f.dataType, AtomicType)]
    rows = requests.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    return rows.join(rules, [rows["_salt"] == rules["_salt"], rows[name] == rules["_schema"]], "left").drop("_salt", "_schema")


def _fact(path: str | Column, place: Column, kind: str, number=None, names=None) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), place.alias("place"), F.lit(kind).alias("type"),
                    (F.lit(None) if number is None else number).cast("double").alias("number"),
                    (F.lit(None) if names is None else names).cast(_NAMES).alias("names"))


def _present(**fields: Column) -> Column:
    return F.filter(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())


def response_facts(date: Column, users: Column) -> Column:
    """Facts of the response ``{date, users}``; an absent value has none."""
    def of_user(u, i):
        return _let(F.concat(F.lit("$.users["), i.cast("string"), F.lit("]")), lambda at: of_place(u, at))

    def of_place(u, at):
        numbers, maps = ("salary", "expenses", "savings"), ("investments", "debts", "loans")
        facts = [F.array(_fact("$.users[]", at, "object", names=_present(**{n: u[n] for n in ("name", *numbers, *maps)})))]
        plain = [("name", "string"), *((n, "integer") for n in numbers), *((m, "object") for m in maps)]
        facts.append(F.filter(F.array(*[F.when(u[n].isNotNull(), _fact(f"$.users[].{n}", F.concat(at, F.lit(f".{n}")), kind,
                                                                     u[n] if n in numbers else None)) for n, kind in plain]),
                              lambda f: f.isNotNull()))
        def of_item(m):
            return lambda e: _fact(f"$.users[].{m}.*", F.concat(at, F.lit(f".{m}."), e["key"]), "integer", e["value"])

        for m in maps:
            facts.append(F.coalesce(F.transform(F.map_entries(u[m]), of_item(m)), F.array().cast(_FACTS)))
        return F.concat(*facts)

    top = F.array(_fact("$", F.lit("$"), "object", names=_present(date=date, users=users)))
    dated = F.when(date.isNotNull(), F.array(_fact("$.date", F.lit("$.date"), "string"))).otherwise(F.array().cast(_FACTS))
    listed = F.when(users.isNotNull(), F.array(_fact("$.users", F.lit("$.users"), "array"))).otherwise(F.array().cast(_FACTS))
    return F.concat(top, dated, listed, F.coalesce(F.flatten(F.transform(users, of_user)), F.array().cast(_FACTS)))


def violations(rules: str, facts: str) -> Column:
    """Sorted messages of every rule that a fact of its path breaks."""
    none = F.array().cast(_NAMES)

    def broken(rule):
        def lacking(f):
            return F.array_except(F.coalesce(rule["required"], none), F.coalesce(f["names"], none))

        def kind(f):
            return rule["type"].isNotNull() & (rule["type"] != f["type"]) & ~((rule["type"] == "number") & (f["type"] == "integer"))

        def breaks(f):
            return (f["path"] == rule["path"]) & (kind(f) | (f["number"] < rule["minimum"]) | (f["number"] > rule["maximum"]) | (
                rule["required"].isNotNull() & (F.size(lacking(f)) > 0)))

        def by(f):
            return F.concat(
                F.transform(lacking(f), lambda n: F.concat(f["place"], F.lit(": '"), n, F.lit("' is a required property"))),
                F.when(kind(f), F.array(F.concat(f["place"], F.lit(" is not of type "), rule["type"]))).otherwise(none),
                F.when(f["number"] < rule["minimum"], F.array(F.concat(f["place"], F.lit(" is below its minimum")))).otherwise(none),
                F.when(f["number"] > rule["maximum"], F.array(F.concat(f["place"], F.lit(" is above its maximum")))).otherwise(none))
        # Messages are made for the facts that break the rule, which are few.
        return F.flatten(F.transform(F.filter(F.col(facts), breaks), by))

    return F.array_sort(F.flatten(F.transform(F.col(rules), broken)))
