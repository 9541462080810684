"""File types, extraction and archives over the page and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.plans.registry import Tables, query
from weftlake.sources.blobs import extract_column, sniff, type_of
from weftlake.sources.extract import PRESETS, Options


@query(
    "mime_by_name",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/markdown' WHEN 3 THEN 'application/zip' ELSE 'application/octet-stream' END AS mime FROM pages""",
)
def mime_by_name(t: Tables) -> DataFrame:
    name = F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ["HTML", "json", "md", "zip", "xyz"])), (F.col("page_id") % 5 + 1).cast("int")))
    return t.pages.select("page_id", type_of(name).alias("mime"))


@query("mime_by_bytes", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/rtf' END AS mime FROM pages")
def mime_by_bytes(t: Tables) -> DataFrame:
    body = F.concat(F.element_at(F.array(*map(F.lit, ["%PDF-1.7 ", "{\\rtf1 ", ""])), (F.col("page_id") % 3 + 1).cast("int")), F.col("html"))
    return t.pages.select("page_id", sniff(body.cast("binary")).alias("mime"))


def _extracted(t: Tables, o: Options) -> DataFrame:
    x = t.pages.select("page_id", extract_column(F.lit("text/html"), F.col("html").cast("binary"), o).alias("x"))
    return x.select("page_id", "x.text", "x.error")


for _name, _options in PRESETS.items():

    @query(f"extract_html_{_name}")
    def _html(t: Tables, o: Options = _options) -> DataFrame:
        return _extracted(t, o)


@query("extract_json", "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS text FROM events")
def extract_json(t: Tables) -> DataFrame:
    x = extract_column(F.lit("application/json"), F.col("props").cast("binary"), Options(formatting=True))
    return t.events.select("event_id", x.alias("x")).select("event_id", "x.text")


@query("extract_csv", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(nfc_normalize(text), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents")
def extract_csv(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", extract_column(F.lit("text/csv"), F.col("text").cast("binary")).alias("x")).select("doc_id", "x.text")


@query("extract_unsupported", "SELECT page_id, 'unsupported type application/x-tar' AS error FROM pages")
def extract_unsupported(t: Tables) -> DataFrame:
    return t.pages.select("page_id", extract_column(F.lit("application/x-tar"), F.col("html").cast("binary")).alias("x")).select("page_id", "x.error")
