"""Document files whose properties change from load to load.

A container's columns are state: a small table with a row for each property, its kind and whether kinds
ever conflicted. A load infers the kinds of its own documents in one aggregation, joins them with that
state, and reads every document under the result: a new property becomes a new column, a missing one is
NULL, a wider number widens its column, and a value of another kind reads as NULL. Columns of the contract
keep their declared types, whatever a load brings.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tallyweir import model
from tallyweir.functions.lattice import ABSENT, KINDS, join_all, join_kinds, kind_of, read_as
from tallyweir.operators.merge import latest_documents
from tallyweir.sinks.tables import Lake, overwrite
from tallyweir.sources.documents import LOAD_ORDER, document_schema, load_position
from tallyweir.sources.tables import rows_frame

STATE_SUFFIX = "_properties"
# Beside a container's table: what its last load brought, one version a key.
BATCH_SUFFIX = "_batch"
# More different properties than this in one load are data in the keys: an error, not a wider table.
MAX_PROPERTIES = 10_000
_TEXT, _VALUES = "_text", "_values"

STATE_SCHEMA = T.StructType([
    T.StructField("property", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("conflicted", T.BooleanType()), T.StructField("place", T.IntegerType()),
])


class Property(NamedTuple):
    """A column beside the contract: its name as the documents spell it, its kind, and whether kinds ever conflicted."""

    name: str
    kind: str
    conflicted: bool


def document_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of document files as maps from property to variant, with where each lay; blank ones are skipped.

    A line that is no object, names a property twice or lacks a part of the document key stops the job and names
    its file. The check asks for the line's place, without which Spark would move it below the parsing and parse each
    line again for every mention of a key.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    values = F.try_parse_json("value").try_cast("map<string, variant>")
    found = lines.select(F.col("value").alias(_TEXT), values.alias(_VALUES), *load_position())
    keyed = F.col("_line") >= 0
    for column in model.DOCUMENT_KEY:
        keyed = keyed & (F.try_variant_get(F.col(_VALUES)[column], "$", "string") != "")
    complaint = F.concat(F.col("_file"), F.lit(": 'id' and 'customerId' are required: "), F.substring(_TEXT, 1, 200))
    # In a filter, not a column: column pruning cannot drop the check.
    checked = F.when(F.coalesce(keyed, F.lit(False)), F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
    return found.where(checked)


def inferred(lines: DataFrame, known: Iterable[str]) -> dict[str, set[str]]:
    """Kinds of the values of every property but the ``known``, in one aggregation folded map-side.

    Only the values of the others are looked into. The driver gets a row for each property and kind; more than
    ``MAX_PROPERTIES`` properties stop the job.
    """
    # Outer: before another explode Spark drops lines without properties, and with them those that the check is for.
    values = lines.select(F.explode_outer(_VALUES).alias("property", "value"))
    others = values.where(~F.col("property").isin(*known))
    pairs = others.select("property", kind_of(F.col("value")).alias("kind")).distinct()
    bound = MAX_PROPERTIES * (len(KINDS) + 1)
    found: dict[str, set[str]] = {}
    for row in pairs.limit(bound + 1).collect():
        found.setdefault(row["property"], set()).update({row["kind"]} - {ABSENT})
    if len(found) > MAX_PROPERTIES:
        raise ValueError(f"more than {MAX_PROPERTIES} different properties in one load")
    return found


def evolved(before: Iterable[Property], found: Mapping[str, set[str]]) -> list[Property]:
    """Properties after a load: the earlier ones in their order, then the new ones by name.

    A property that only ever was null has no kind yet, and no column until it has one.
    """
    after: dict[str, Property] = {}
    for own in before:
        kind, clash = join_all(found.get(own.name, set()))
        met, conflict = join_kinds(own.kind, kind)
        after[own.name] = Property(own.name, met, own.conflicted or clash or conflict)
    for name in sorted(found):
        kind, clash = join_all(found[name])
        if name not in after and kind is not None:
            after[name] = Property(name, kind, clash)
    return list(after.values())


def column_names(container: str, properties: Iterable[Property]) -> dict[str, str]:
    """Column of each property: its name, or one with a number where another differs in case only."""
    taken = {name.lower() for name in (*document_schema(container).names, *LOAD_ORDER)}
    columns = {}
    for own in properties:
        name, n = own.name, 1
        while name.lower() in taken:
            n += 1
            name = f"{own.name}_{n}"
        taken.add(name.lower())
        columns[own.name] = name
    return columns


def read_evolved(lines: DataFrame, container: str, properties: list[Property]) -> DataFrame:
    """The documents under the contract and the properties, with the columns of ``LOAD_ORDER``."""
    contract = document_schema(container)
    columns = column_names(container, properties)
    document = F.from_json(_TEXT, contract)
    return lines.select(
        document.alias("_document"), *LOAD_ORDER,
        *(read_as(F.col(_VALUES)[own.name], own.kind).alias(columns[own.name]) for own in properties),
    ).select(
        *(F.col("_document")[name].alias(name) for name in contract.names),
        *(F.col(f"`{columns[own.name]}`") for own in properties), *LOAD_ORDER,
    )


def widened(stored: DataFrame, container: str, properties: list[Property]) -> DataFrame:
    """Stored documents under the properties of a later load: numbers widen, new columns are NULL."""
    columns = column_names(container, properties)
    have = {name.lower() for name in stored.columns}
    return stored.select(
        *document_schema(container).names,
        *(
            (F.col(f"`{columns[own.name]}`") if columns[own.name].lower() in have else F.lit(None))
            .cast(KINDS[own.kind]).alias(columns[own.name])
            for own in properties
        ),
    )


def stored_properties(lake: Lake, container: str) -> list[Property]:
    """The container's properties as its last load left them."""
    if not lake.exists(container + STATE_SUFFIX):
        return []
    rows = lake.read(container + STATE_SUFFIX).orderBy("place").collect()
    return [Property(row["property"], row["kind"], row["conflicted"]) for row in rows]


class Load(NamedTuple):
    """Documents in the container after a load, and its properties."""

    documents: int
    properties: list[Property]


def load_evolving(lake: Lake, path: str | list[str], container: str) -> Load:
    """Upsert document files into the container's table, whose columns follow the documents.

    Of a key's versions the one loaded last stays, whole: a property it omits becomes NULL. The properties
    are published first: a load that is lost before the documents are is repeated under the same columns.
    Beside earlier documents the load's own are written by themselves, since the merge reads them twice and
    parsing is the larger part of the work.
    """
    lines = document_lines(lake.spark, path)
    after = evolved(stored_properties(lake, container), inferred(lines, document_schema(container).names))
    state = [(own.name, own.kind, own.conflicted, place) for place, own in enumerate(after)]
    overwrite(lake, rows_frame(lake.spark, state, STATE_SCHEMA).coalesce(1), container + STATE_SUFFIX)
    newest = latest_documents(read_evolved(lines, container, after), LOAD_ORDER)
    if lake.exists(container):
        overwrite(lake, newest, container + BATCH_SUFFIX)
        newest = lake.read(container + BATCH_SUFFIX)
        target = widened(lake.read(container), container, after)
        keys = list(model.DOCUMENT_KEY)
        newest = newest.unionByName(target.join(newest.select(*keys), keys, "left_anti"))
    return Load(overwrite(lake, newest, container)["rows"], after)
