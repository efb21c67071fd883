"""Report documents: one JSON text per report, built on the executors.

The JSON keeps null fields (a NULL sector name is written as ``null``) and
sorts each list, so a document is byte-stable for the same data.

``*_document`` gives the text as one row, which holds every sector. For a
document of any size there are *fragments*: a row per list entry, sorted by
range and written as text files whose contents, in order of their names, are
the same text byte for byte (``save_document``). No task holds a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import KINDS
from ..functions.filters import emitted_kinds
from ..functions.params import fine_report_params
from ..plans.statements import Source, run_statement
from ..schema import FINE_METRICS
from .fine_report import FINE_REPORT_SQL
from .master_report import DOCUMENT_KEYS, report_sql
from .metrics import Filters

_JSON_OPTIONS = "map('ignoreNullFields', 'false')"


def fine_report_document(source: Source) -> DataFrame:
    """One row ``document``: ``{"fineCounts": {key: {"value", "id"}, ...},
    "sectors": [{"name", "value"}, ...]}``."""
    counts = ", ".join(f"'{key}', {key}" for key, _ in FINE_METRICS)
    text = (
        f"SELECT to_json(named_struct('fineCounts', named_struct({counts}), 'sectors', sort_array(sectors)), "
        f"{_JSON_OPTIONS}) AS document\nFROM (\n{FINE_REPORT_SQL})"
    )
    return run_statement(source, text)


def master_report_document(source: Source, filters: Filters = None) -> DataFrame:
    """One row ``document`` with the eight master-report keys in order; the
    sector and reason lists sorted, the type list in report order."""
    report, args = report_sql(filters)
    sorted_lists = ("sectorsFineDistribution", "droppedTransactionDistribution")
    fields = ", ".join(f"'{key}', {f'sort_array({key})' if key in sorted_lists else key}" for key in DOCUMENT_KEYS)
    text = f"SELECT to_json(named_struct({fields}), {_JSON_OPTIONS}) AS document\nFROM (\n{report})"
    return run_statement(source, text, args)


# Every fragment ends with the brace that closes its last entry. The writer puts it there as the line end.
END = "}"

_ORDER = ["part", "text_name", "int_name", "value"]


def fine_document_fragments(rows: DataFrame) -> DataFrame:
    """The fine report's document as sorted fragments, from its rows (``fine_report_rows``)."""
    value = {key: _value_of("fineCounts", key) for key, _ in FINE_METRICS}
    counts = [F.concat(F.lit(f'"{key}":{{"value":'), value[key], F.lit(f',"id":{code}}}')) for key, code in FINE_METRICS]
    head = F.concat(F.lit('{"fineCounts":{'), F.concat_ws(",", *counts), F.lit('},"sectors":['))
    return _fragments(rows, [(head, "sectors", "string")], F.lit("]"))


def master_document_fragments(rows: DataFrame, filters: Filters = None) -> DataFrame:
    """The master report's document as sorted fragments, from its rows (``master_report_rows``) with the same filters."""
    kinds = emitted_kinds(filters, KINDS)

    def scalar(key: str) -> Column:
        return F.concat(F.lit(f'"{key}":'), _value_of(key))

    entries = [
        F.concat(F.lit(f'{{"name":"{name}","value":'), _value_of("transactionTypesDistribution", name), F.lit("}"))
        for name in KINDS
        if name in kinds
    ]
    fines, types, drops = DOCUMENT_KEYS[2:5]
    head = F.concat(F.lit("{"), F.concat_ws(",", *map(scalar, DOCUMENT_KEYS[:2])), F.lit(f',"{fines}":['))
    middle = F.concat(F.lit(f'],"{types}":['), F.concat_ws(",", *entries) if entries else F.lit(""), F.lit(f'],"{drops}":['))
    tail = F.concat(F.lit("],"), F.concat_ws(",", *map(scalar, DOCUMENT_KEYS[5:])))
    return _fragments(rows, [(head, fines, "string"), (middle, drops, "int")], tail)


def _value_of(section: str, name: str | None = None) -> Column:
    """A number of the report, as an aggregate over its rows."""
    own = F.col("section") == section
    if name is not None:
        own = own & (F.col("name") == name)
    return F.coalesce(F.max(F.when(own, F.col("value"))), F.lit(0)).cast("string")


def _fragments(rows: DataFrame, lists: list[tuple[Column, str, str]], tail: Column) -> DataFrame:
    """Rows (part, text_name, int_name, value, text) whose texts, each closed with ``END``, make the document
    in the order of the other columns. ``lists``: (text before the list, its section, type of its names)."""
    entries = None
    for part, (_, section, kind) in enumerate(lists):
        own = rows.where(F.col("section") == section)
        name = F.col("name").cast(kind)
        own = own.select(
            F.lit(part).alias("part"),
            (name if kind == "string" else F.lit(None).cast("string")).alias("text_name"),
            (name if kind == "int" else F.lit(None).cast("int")).alias("int_name"),
            "value",
            F.to_json(F.struct(name.alias("name"), "value"), {"ignoreNullFields": "false"}).alias("entry"),
        )
        entries = own if entries is None else entries.union(own)
    # equal entries (sectors that read alike and count alike) are one fragment
    entries = entries.groupBy(*_ORDER).agg(F.max("entry").alias("entry"), F.count("*").alias("times"))
    entries = entries.withColumn("text", F.array_join(F.array_repeat("entry", F.col("times").cast("int")), ","))
    # one row: the texts between the lists and each list's first entry
    firsts = entries.groupBy().agg(
        *(F.min(F.when(F.col("part") == i, F.struct(*_ORDER))).alias(f"first{i}") for i in range(len(lists)))
    )
    frame = rows.groupBy().agg(*(text.alias(f"text{i}") for i, (text, *_) in enumerate(lists)), tail.alias("tail"))
    frame = F.broadcast(frame.join(firsts))  # one row with one row
    # before a list's first entry stands its text, and those of empty lists before it
    opening, carried = [], F.lit("")
    for i in range(len(lists)):
        opening.append(F.concat(carried, F.col(f"text{i}")))
        carried = F.when(F.col(f"first{i}").isNull(), opening[-1]).otherwise("")
    before = F.lit(",")
    for i, text in enumerate(opening):
        same = [F.col(c).eqNullSafe(F.col(f"first{i}.{c}")) for c in _ORDER]
        before = F.when((F.col("part") == i) & same[1] & same[2] & same[3], text).otherwise(before)
    own = F.concat(before, F.expr("left(text, length(text) - 1)")).alias("text")
    body = entries.join(frame).select(*_ORDER, own)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("text_name", "string"), ("int_name", "int"), ("value", "bigint"))]
    end = frame.select(F.lit(len(lists)).alias("part"), *nothing, F.concat(carried, "tail").alias("text"))
    return body.union(end)


def save_document(fragments: DataFrame, path: str) -> None:
    """Write the fragments as text files below ``path``: joined in order of their names they are the document."""
    ordered = fragments.orderBy(*_ORDER).select("text")
    ordered.write.option("lineSep", END).text(path)


def saved_document(spark: SparkSession, path: str) -> DataFrame:
    """A saved document as one row ``document``, for those that fit one."""
    files = spark.read.option("wholetext", True).text(path).select(F.struct(F.input_file_name().alias("f"), "value").alias("p"))
    parts = F.transform(F.sort_array(F.collect_list("p")), lambda p: p["value"])
    return files.agg(F.array_join(parts, "").alias("document"))


def fine_report_response(
    source: Source,
    sector_name: str | None = None,
    start_date: int | None = None,
    end_date: int | None = None,
    fine_type: int | None = None,
) -> DataFrame:
    """The fine-report request: validate the parameters (``ValueError`` when
    out of bounds), then answer with the fine report document. As in the
    original service the parameters are accepted but do not narrow the
    report; compose ``apply_filters`` on the source to narrow it."""
    fine_report_params(sector_name, start_date, end_date, fine_type)
    return fine_report_document(source)
