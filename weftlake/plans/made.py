"""Extractors and chunkers over inputs that the query makes from table columns, so that SQL can tell what must come out."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.operators.chunkers import ChunkConfig, chunk_documents
from weftlake.operators.embed import HashingProvider
from weftlake.operators.ledger import redeliveries
from weftlake.operators.search import parse_point_id
from weftlake.plans.registry import Tables, query
from weftlake.session import spread
from weftlake.sources.blobs import extract_column
from weftlake.sources.extract import PRESETS, TYPES, ZIP_END, ZIP_ENTRY, ZIP_HEADER, Options

def _fill(template: str) -> Column:
    """A template with @n, @s and @k for a customer's name, segment and key."""
    out = F.lit(template)
    for mark, column in (("@n", "c_name"), ("@s", "c_mktsegment"), ("@k", "c_custkey")):
        out = F.replace(out, F.lit(mark), F.col(column).cast("string"))
    return out


def _sql(template: str) -> str:
    text = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"SELECT c_custkey, replace(replace(replace({text}, '@n', c_name), '@s', c_mktsegment), '@k', CAST(c_custkey AS VARCHAR)) AS text FROM customer"


def _customers(t: Tables) -> DataFrame:
    """What is filled in, dealt to many tasks: making and reading a file takes its time."""
    return spread(t.customer.select("c_custkey", "c_name", "c_mktsegment"))


#: Name, MIME type, options, input and text that it must give.
MADE = (
    ("markdown", "text/markdown", Options(), "# @n\n\n- @s\n1. key @k\n> quoted @n\n---\n```\nno\n```\nend", "@n\n@s\nkey @k\nquoted @n\nend"),
    ("ndjson", "application/x-ndjson", Options(), '{"a": "@n", "b": "@s"}\nbroken\n{"a": "z@k"}\n', "@n @s\nz@k"),
    ("xml", "application/xml", Options(), '<r><a> @n </a><b x="1">@s</b><!-- no --></r>', "@n@s"),
    ("json_nested", "application/json", Options(formatting=True), '{"a": {"b": ["@n", @k, true]}}', "a.b[0]: @n\na.b[1]: @k\na.b[2]: true"),
    ("mail", "message/rfc822", Options(), "Subject: @s\nFrom: A <a@x.org>\nTo: b@x.org\nContent-Type: text/plain\n\nbody @k\n", "Subject: @s\nFrom: a@x.org\nTo: b@x.org\nbody @k"),
    ("rtf", "application/rtf", Options(), "{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}@s\\par key @k}", "@s\nkey @k"),
    ("html_made", "text/html", Options(), "<html><head><title>no</title></head><body><h1>@n</h1><p>One <b>@s</b></p><script>no</script><div>key<br>@k</div></body></html>", "@n\nOne @s\nkey\n@k"),
    (
        "html_structure",
        "text/html",
        PRESETS["markdown"],
        "<body><h2>@n</h2><ol><li>@s<li>two</ol><table><tr><th>k</th><th>v</th></tr><tr><td>@k</td><td>@s</td></tr></table><pre>x = @k</pre></body>",
        "## @n\n1. @s\n2. two\n| k | v |\n| --- | --- |\n| @k | @s |\n```\nx = @k\n```",
    ),
)

for _name, _mime, _options, _input, _text in MADE:

    @query(f"extract_{_name}", _sql(_text))
    def _extracted(t: Tables, mime: str = _mime, options: Options = _options, made: str = _input) -> DataFrame:
        x = extract_column(F.lit(mime), _fill(made).cast("binary"), options)
        return _customers(t).select("c_custkey", x.alias("x")).select("c_custkey", "x.text")


def _deflated(body: bytes) -> bytes:
    """Compressed with no more memory than the text needs: a full window is hundreds of kilobytes to clear for each small file."""
    bits = min(15, max(9, len(body).bit_length()))
    z = zlib.compressobj(wbits=-bits, memLevel=bits - 6)
    return z.compress(body) + z.flush()


def zip_file(names: tuple[str, ...], texts: tuple[str, ...]) -> bytes:
    """An archive with a compressed member for each name, dated 1980-01-01."""
    files, entries, at = [], [], 0
    for name, text in zip(names, texts):
        path, body = name.encode("ascii"), text.encode()
        packed = _deflated(body)
        about = (20, 0, 8, 0, 33, zlib.crc32(body), len(packed), len(body), len(path), 0)
        entries += [ZIP_ENTRY.pack(b"PK\1\2", 3 << 8 | 20, *about, 0, 0, 0, 0o600 << 16, at), path]
        files += [ZIP_HEADER.pack(b"PK\3\4", *about), path, packed]
        at += ZIP_HEADER.size + len(path) + len(packed)
    directory = b"".join(entries)
    return b"".join([*files, directory, ZIP_END.pack(b"PK\5\6", 0, 0, len(names), len(names), len(directory), at, 0)])


def _zipped(*names: str):
    @F.arrow_udf("binary")
    def run(*bodies: pa.Array) -> pa.Array:
        return pa.array([None if None in texts else zip_file(names, texts) for texts in zip(*(b.to_pylist() for b in bodies))], pa.binary())

    return run


def _packed(t: Tables, mime: str, **files: str) -> DataFrame:
    data = _zipped(*[k.replace("__", "/").replace("_dot_", ".") for k in files])(*[_fill(v) for v in files.values()])
    return _customers(t).select("c_custkey", extract_column(F.lit(mime), data).alias("x")).select("c_custkey", "x.text")


@query("extract_zip", _sql('--- a.txt ---\n@n\n--- d/b.json ---\n@s'))
def extract_zip(t: Tables) -> DataFrame:
    return _packed(t, "application/zip", a_dot_txt="@n", p_dot_png="no", d__b_dot_json='{"k": "@s"}', bad_dot_json="{")


@query("extract_docx", _sql("@n\n@s"))
def extract_docx(t: Tables) -> DataFrame:
    return _packed(t, TYPES["docx"], word__document_dot_xml='<w:document xmlns:w="u"><w:p><w:t>@n</w:t></w:p><w:p><w:t>@s</w:t></w:p></w:document>')


@query("extract_xlsx", _sql("@n\n@s"))
def extract_xlsx(t: Tables) -> DataFrame:
    return _packed(t, TYPES["xlsx"], xl__sharedStrings_dot_xml='<sst xmlns="u"><si><t>@n</t></si><si><t>@s</t></si></sst>')


@query("extract_pptx", _sql("@s\n@n"))
def extract_pptx(t: Tables) -> DataFrame:
    page = '<p:sld xmlns:p="u" xmlns:a="v"><a:p><a:t>%s</a:t></a:p></p:sld>'
    return _packed(t, TYPES["pptx"], ppt__slides__slide10_dot_xml=page % "@n", ppt__slides__slide2_dot_xml=page % "@s")


@query("extract_odt", _sql("@n\n@s"))
def extract_odt(t: Tables) -> DataFrame:
    return _packed(t, TYPES["odt"], content_dot_xml='<o:document-content xmlns:o="u" xmlns:t="v"><o:body><t:p>@n</t:p><t:p>@s</t:p></o:body></o:document-content>')


@query("extract_epub", _sql("@s\n@n"))
def extract_epub(t: Tables) -> DataFrame:
    return _packed(
        t,
        "application/epub+zip",
        **{
            "META-INF__container_dot_xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
            "o__p_dot_opf": '<package xmlns="u"><manifest><item id="b" href="b.html"/><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
            "o__b_dot_html": "<body>@n</body>",
            "o__a_dot_html": "<body>@s</body>",
        },
    )


@query("extract_log_made", "SELECT c_custkey, CAST(c_custkey % 5 + 1 AS BIGINT) AS entries, CAST(c_custkey % 5 + 2 AS BIGINT) AS lines, CAST(c_custkey % 5 + 1 AS BIGINT) AS errors FROM customer")
def extract_log_made(t: Tables) -> DataFrame:
    body = F.concat(F.repeat(F.lit("2024-01-15 10:30:45 ERROR x\n"), (F.col("c_custkey") % 5 + 1).cast("int")), F.lit("tail"))
    x = _customers(t).select("c_custkey", extract_column(F.lit("text/x-log"), body.cast("binary"), Options(metadata=True)).alias("x"))
    got = [F.get_json_object("x.metadata", f"$.{path}").cast("long").alias(name) for name, path in (("entries", "entry_count"), ("lines", "line_count"), ("errors", "log_levels.ERROR"))]
    return x.select("c_custkey", *got)


def _texts(t: Tables, unit: str, glue: str, before: str = "") -> DataFrame:
    """(doc_id, text) of every supplier: key % 50 + 1 numbered units."""
    units = F.transform(F.sequence(F.lit(1), (F.col("s_suppkey") % 50 + 1).cast("int")), lambda i: F.replace(F.lit(unit), F.lit("@"), F.lpad(i.cast("string"), 5, "0")))
    return spread(t.supplier.select("s_suppkey")).select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit(before), F.array_join(units, glue)).alias("text"))


def _groups(unit: str, glue: str, per: int, before: str = "", first: int = 0) -> str:
    """SQL of (doc_id, chunk_index, content): units in groups, each after ``before``."""
    return f"""SELECT doc_id, CAST((i - 1) // {per} + {first} AS INT) AS chunk_index, '{before}' || string_agg(replace('{unit}', '@', lpad(CAST(i AS VARCHAR), 5, '0')), {glue} ORDER BY i) AS content
  FROM (SELECT s_suppkey AS doc_id, unnest(range(1, s_suppkey % 50 + 2)) AS i FROM supplier) GROUP BY doc_id, (i - 1) // {per}"""


def _chunked(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    return chunk_documents(docs, config).select("doc_id", "chunk_index", "content")


@query("chunk_recursive_made", _groups("@", "' '", 3))
def chunk_recursive_made(t: Tables) -> DataFrame:
    return _chunked(_texts(t, "@", " "), ChunkConfig("recursive_character", chunk_size=17))


@query("chunk_sentence_made", _groups("No @.", "' '", 3))
def chunk_sentence_made(t: Tables) -> DataFrame:
    return _chunked(_texts(t, "No @.", " "), ChunkConfig("sentence", chunk_size=30))


@query(
    "chunk_token_made",
    """SELECT doc_id, CAST(w AS INT) AS chunk_index, array_to_string(list_transform(range(w * 3 + 1, least(w * 3 + 4, n) + 1), lambda i: lpad(CAST(i AS VARCHAR), 5, '0')), ' ') AS content
  FROM (SELECT s_suppkey AS doc_id, s_suppkey % 50 + 1 AS n, unnest(range(0, CASE WHEN s_suppkey % 50 + 1 <= 4 THEN 1 ELSE CAST(ceil((s_suppkey % 50 - 3) / 3.0) AS BIGINT) + 1 END)) AS w FROM supplier)""",
)
def chunk_token_made(t: Tables) -> DataFrame:
    return _chunked(_texts(t, "@", " "), ChunkConfig("token_based", max_tokens=4, chunk_overlap=1, split_on_sentences=False))


@query("chunk_table_made", _groups("r@,x", "chr(10)", 5, "k,v' || chr(10) || '", 1) + " UNION ALL SELECT s_suppkey, 0, 'intro' FROM supplier")
def chunk_table_made(t: Tables) -> DataFrame:
    return _chunked(_texts(t, "r@,x", "\n", "intro\nk,v\n"), ChunkConfig("table_aware", max_rows=5, min_rows=2))


@query("chunk_markdown_made", _groups("# H@' || chr(10) || '" + "x" * 60, "chr(10)", 1))
def chunk_markdown_made(t: Tables) -> DataFrame:
    return _chunked(_texts(t, "# H@\n" + "x" * 60, "\n\n"), ChunkConfig("markdown_aware", chunk_size=500))


@query("chunk_code_made", _groups("def f@():' || chr(10) || '    return 1", "chr(10)", 1))
def chunk_code_made(t: Tables) -> DataFrame:
    return _chunked(_texts(t, "def f@():\n    return 1", "\n\n"), ChunkConfig("code_aware", chunk_size=2000, min_chunk_size=1, language="python"))


@query(
    "chunk_semantic_made",
    """SELECT s_suppkey AS doc_id, 0 AS chunk_index, rtrim(repeat('Alpha stone. ', CAST(s_suppkey % 9 + 1 AS INT))) AS content FROM supplier
  UNION ALL SELECT s_suppkey, 1, rtrim(repeat('River cloud. ', CAST(s_suppkey % 7 + 1 AS INT))) FROM supplier""",
)
def chunk_semantic_made(t: Tables) -> DataFrame:
    text = F.concat(F.repeat(F.lit("Alpha stone. "), (F.col("s_suppkey") % 9 + 1).cast("int")), F.repeat(F.lit("River cloud. "), (F.col("s_suppkey") % 7 + 1).cast("int")))
    return _chunked(spread(t.supplier.select("s_suppkey")).select(F.col("s_suppkey").alias("doc_id"), text.alias("text")), ChunkConfig("semantic", min_chunk_size=1, embedder=HashingProvider(64)))


@query(
    "point_ids",
    """WITH m AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), v AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN h
  WHEN 1 THEN upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21)) WHEN 2 THEN CAST(doc_id AS VARCHAR)
  WHEN 3 THEN '1844674407370955161' || CAST(doc_id % 10 AS VARCHAR) WHEN 4 THEN 'x' || h WHEN 5 THEN '-' || CAST(doc_id AS VARCHAR) ELSE substr(h, 2) || 'g' END AS s FROM m)
  SELECT doc_id, CAST(TRY_CAST(CASE WHEN length(s) >= 32 THEN s END AS UUID) AS VARCHAR) AS uuid, CAST(TRY_CAST(CASE WHEN length(s) < 32 THEN s END AS UBIGINT) AS VARCHAR) AS num FROM v""",
)
def point_ids(t: Tables) -> DataFrame:
    h, key = F.md5(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string")
    hyphens = F.upper(F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))
    kinds = [h, hyphens, key, F.concat(F.lit("1844674407370955161"), (F.col("doc_id") % 10).cast("string")), F.concat(F.lit("x"), h), F.concat(F.lit("-"), key), F.concat(F.substring(h, 2, 31), F.lit("g"))]
    s = kinds[-1]
    for k, kind in enumerate(kinds[:-1]):
        s = F.when(F.col("doc_id") % 7 == k, kind).otherwise(s)
    p = t.documents.select("doc_id", parse_point_id(s).alias("p"))
    return p.select("doc_id", "p.uuid", F.col("p.num").cast("string").alias("num"))


LAST = """SELECT user_id AS message_id, count(*) AS attempts, arg_max(event_id, epoch_us(ts) * 1000000000::HUGEINT + event_id) AS last_error, count(*) >= 5 AS dead,
  CASE WHEN count(*) < 5 THEN strftime(max(ts) + to_seconds([30, 60, 120, 300][least(count(*), 4)]), '%Y-%m-%d %H:%M:%S') END AS due_at FROM events WHERE event_type = 'error' AND user_id IS NOT NULL GROUP BY user_id"""


def _failures(events: DataFrame) -> DataFrame:
    return events.filter("user_id IS NOT NULL").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "error", F.col("event_id")).alias("error"))


def _verdicts(failed: DataFrame) -> DataFrame:
    return redeliveries(failed).withColumn("due_at", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss"))


@query("dead_letters", LAST)
def dead_letters(t: Tables) -> DataFrame:
    return _verdicts(_failures(t.events).filter("error IS NOT NULL"))


@query("stream_dead_letters", LAST)
def stream_dead_letters(t: Tables) -> DataFrame:
    from weftlake.session import shared_path
    from weftlake.streaming import jobs

    path = shared_path(t.spark, "letters")
    jobs.deliver(_failures(jobs.read_table(t.spark, t.folder, "events")), lambda df: df, path)
    return _verdicts(t.spark.read.parquet(f"{path}/failed"))
