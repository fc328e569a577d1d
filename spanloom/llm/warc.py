"""Derived records of web archives: for each response a metadata record and a plain-text conversion record that refer to it.

A response is a row of record_id, target_uri, date and the payload (HTML text); ``responses`` makes such rows from pages. Its HTTP headers
may stand in ``headers``, an array of name and value in their order; the metadata record copies each one. The metadata
record keeps the source's headers and payload digest and lists title, language and links; the conversion record holds the visible
text. Both carry WARC-Refers-To with the response's id, its URI and date, and digests of their own blocks. ``write`` stores the
records as gzip members, several files each complete or absent.

Everything up to the files is SQL expressions on one row, so nothing is shuffled. Ids follow from the response's id, so a repeated
task makes the same records. NULL html is an empty payload; NULL url and id are empty strings; blanks and control characters in a
URI become %20. Text is what remains without comments, scripts, styles, templates and tags, blocks on lines of their own, the
common entities decoded. A head ends at </head> or before the first text or element that cannot stand in one; comments, scripts
and styles without an end run to the end of the text, of a noscript or template without an end only the tag goes. The statement
ends a head, noscript or template at its end tag only, so it agrees where these are closed. Repeated rows give repeated records. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

DATE = "2024-01-01T00:00:00Z"  # capture time of tables that name none

# Elements without visible text, and elements that start a line.
HIDDEN = ["script", "style", "noscript", "template", "head"]
# What a head may hold: white space, titles, declarations, and the tags of these elements.
HEAD = r"\s++|<title\b[^>]*+>.*?</title\s*+>|<[!?][^>]*+>|</?(?:base|basefont|bgsound|html|link|meta|noframes|noscript|script|style|template|title)\b[^>]*+>"
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


class _Sql:
    """The few functions that the two dialects write differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, value: str) -> str:
        value = value.replace("'", "\\'" if self.spark else "''")
        return f"'{value}'"

    def sub(self, expr: str, pattern: str, to: str) -> str:
        if self.spark:
            return f"regexp_replace({expr}, r'{pattern}', '{to}')"
        return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')".replace("'\\n'", "chr(10)")

    def find(self, expr: str, pattern: str) -> str:
        return f"regexp_extract({expr}, {'r' if self.spark else ''}'{pattern}', 1)"

    def all(self, expr: str, pattern: str) -> str:
        return f"regexp_extract_all({expr}, {'r' if self.spark else ''}'{pattern}', 1)"

    def sha(self, expr: str) -> str:
        return f"sha2({expr}, 256)" if self.spark else f"sha256({expr})"

    def size(self, expr: str) -> str:
        return f"CAST({'octet_length' if self.spark else 'strlen'}({expr}) AS BIGINT)"

    def each(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})" if self.spark else f"list_transform({array}, lambda {var}: {body})"

    def joined(self, array: str) -> str:
        return f"array_join({array}, '')" if self.spark else f"coalesce(array_to_string({array}, ''), '')"


def _line(*parts: str) -> str:
    return "concat(" + ", ".join([*parts, "chr(13)", "chr(10)"]) + ")"


def _uuid(q: _Sql, kind: str, seed: str) -> str:
    h = f"md5(concat('{kind}|', {seed}))"
    cut = ", '-', ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat('<urn:uuid:', {cut}, '>')"


def _plain(q: _Sql, expr: str) -> str:
    for a, b in ENTITIES:
        expr = f"replace({expr}, {q.text(a)}, {q.text(b)})"
    return expr


def _shown(q: _Sql, expr: str) -> str:
    """The text without hidden elements. Spark's patterns take what starts first, so a comment's sign inside a script hides nothing else."""
    if q.spark:
        expr = q.sub(expr, r"(?is)<(?:!--.*?(?:-->|\z)|(script|style)\b.*?(?:</\1[ \t\n\r\f]*>|\z))", " ")
        expr = q.sub(expr, r"(?is)<(noscript|template)\b.*?(?:</\1[ \t\n\r\f]*>|(?=</head\b|<body\b))", " ")
        return q.sub(expr, rf"(?is)<head(?=[\s/>])[^>]*+>(?:{HEAD})*+(?:</head\s*+>)?", " ")
    expr = q.sub(expr, r"(?s)<!--.*?(?:-->|\z)", " ")
    for tag in HIDDEN:
        expr = q.sub(expr, rf"(?is)<{tag}\b.*?(?:</{tag}[ \t\n\r\f]*>|\z)", " ")
    return expr


def _visible(q: _Sql, expr: str) -> str:
    expr = _shown(q, expr)
    expr = q.sub(expr, r"[ \t\r\n\f]+", " ")
    expr = q.sub(expr, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", r"\n")
    expr = q.sub(expr, r"<[a-zA-Z/!?][^>]*>", "")
    expr = _plain(q, expr)
    expr = q.sub(expr, r"[ \t]+", " ")
    expr = q.sub(expr, r" ?\n[ \n]*", r"\n")
    return f"trim({q.sub(expr, r'^[ \n]+|[ \n]+$', '')})"


def _steps(q: _Sql, source: str, headers: bool = False) -> str:
    uri = q.sub("coalesce(target_uri, '')", r"[\x00-\x20\x7F]", "%20")
    title = f"trim({_plain(q, q.sub(q.find('html', '(?is)<title[^>]*>(.*?)</title'), '[ \\t\\r\\n\\f]+', ' '))})"
    lang = q.find("html", '(?i)<html[^>]*[ ]lang="?([A-Za-z-]+)')
    links = q.all("html", '(?i)<a[ \\t\\r\\n\\f][^>]*href="([^"]*)"')
    outlinks = q.joined(q.each(links, "u", _line("'outlink: '", q.sub(_plain(q, "u"), r"[\x00-\x20\x7F]", "%20"), "' L a/@href'")))
    clean = lambda field: q.sub(f"coalesce({field}, '')", r"[\x00-\x1F\x7F]+", " ")
    copied = [f"coalesce({q.joined(q.each('headers', 'h', _line(chr(39) + 'source-http-header: ' + chr(39), clean('h.name'), chr(39) + ': ' + chr(39), clean('h.value'))))}, '')"] if headers else []
    meta = "concat(" + ", ".join([
        _line("'source-record-id: '", "source_id"), _line("'source-content-type: '", "content_type"), _line("'source-payload-digest: '", "payload_digest"),
        _line("'source-payload-length: '", "CAST(payload_length AS STRING)"), *copied, _line("'title: '", "title"), _line("'language: '", "language"), "outlinks"]) + ")"
    head = lambda kind, extra, body: "concat(" + ", ".join([
        _line("'WARC/1.1'"), _line(f"'WARC-Type: {kind}'"), _line("'WARC-Record-ID: '", f"{kind}_id"), _line("'WARC-Refers-To: '", "source_id"), _line("'WARC-Target-URI: '", "target_uri"), _line("'WARC-Date: '", "date"),
        _line("'WARC-Source-Payload-Digest: '", "payload_digest"), _line("'WARC-Block-Digest: '", f"{kind}_digest"), _line(f"'Content-Type: {extra}'"), _line("'Content-Length: '", f"CAST({kind}_length AS STRING)"),
        "chr(13)", "chr(10)", body, "chr(13)", "chr(10)", "chr(13)", "chr(10)"]) + ")"
    return f"""
WITH source AS (
  SELECT page_id, record_id AS source_id, {uri} AS target_uri, date, content_type, {"headers, " if headers else ""}coalesce(html, '') AS html FROM {source}
), parts AS (
  SELECT *, concat('sha256:', {q.sha("html")}) AS payload_digest, {q.size("html")} AS payload_length, {title} AS title, {lang} AS language, {outlinks} AS outlinks, {_visible(q, "html")} AS conversion_block,
         {_uuid(q, "metadata", "source_id")} AS metadata_id, {_uuid(q, "conversion", "source_id")} AS conversion_id
  FROM source
), blocks AS (SELECT *, {meta} AS metadata_block FROM parts
), sized AS (
  SELECT *, concat('sha256:', {q.sha("metadata_block")}) AS metadata_digest, concat('sha256:', {q.sha("conversion_block")}) AS conversion_digest,
         {q.size("metadata_block")} AS metadata_length, {q.size("conversion_block")} AS conversion_length
  FROM blocks
)
SELECT page_id, 'metadata' AS record_type, metadata_id AS record_id, source_id AS refers_to, target_uri, payload_digest, metadata_digest AS block_digest, metadata_length AS content_length,
       {head("metadata", "application/warc-fields", "metadata_block")} AS record
FROM sized
UNION ALL
SELECT page_id, 'conversion', conversion_id, source_id, target_uri, payload_digest, conversion_digest, conversion_length, {head("conversion", "text/plain; charset=utf-8", "conversion_block")} FROM sized
"""


def _pages(q: _Sql, source: str, headers: bool = False) -> str:
    seed = "concat(coalesce(CAST(page_id AS STRING), ''), '|', coalesce(url, ''))"
    return f"SELECT page_id, {_uuid(q, 'response', seed)} AS record_id, url AS target_uri, '{DATE}' AS date, 'text/html; charset=utf-8' AS content_type, {'headers, ' if headers else ''}html FROM {source}"


def responses(pages: DataFrame) -> DataFrame:
    """Response rows of a table of pages: page_id, record_id, target_uri, date, content_type, headers where pages have them, and html."""
    return pages.sparkSession.sql(_pages(_Sql(True), "{pages}", "headers" in pages.columns), pages=pages)


def derived(rows: DataFrame) -> DataFrame:
    """Two records for each response, whole as text in ``record``, with their headers beside."""
    return rows.sparkSession.sql(_steps(_Sql(True), "{rows}", "headers" in rows.columns), rows=rows)


def write(records: DataFrame, folder: str) -> DataFrame:
    """The records as ``.warc.gz`` files below a folder, one file for each task; returns the files with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        from pyarrow import fs

        task = TaskContext.get()
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        draft, name, n = f"{path}/_draft-{task.partitionId()}-{task.taskAttemptId()}", f"derived-{task.partitionId():06d}.warc.gz", 0
        with files.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for value in batch.column(0):
                    out.write(gzip.compress(value.as_py().encode(), mtime=0))
                    n += 1
        files.move(draft, f"{path}/{name}")
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n"])

    return records.select("record").mapInArrow(run, "file string, n long")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, the record itself as its digest."""
    rows = derived(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return rows.selectExpr("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length", "sha2(record, 256) AS record_sha256")


QUERIES = {"op9_warc_derivatives": op9_warc_derivatives}
STATEMENTS = {
    "op9_warc_derivatives": "SELECT page_id, record_type, record_id, refers_to, target_uri, payload_digest, block_digest, content_length, sha256(record) AS record_sha256 "
    f"FROM ({_steps(_Sql(False), '(' + _pages(_Sql(False), 'pages') + ')')})",
}
