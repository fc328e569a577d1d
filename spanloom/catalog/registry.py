"""Query registry and the pieces the DuckDB statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            STATEMENTS[name] = sql
        return fn

    return wrap


def rnd(expr: str, digits: int = 4) -> str:
    """The statement form of ``half_even``: ties judged on the binary value."""
    s = f"1e{digits}"
    hi = "(v*1.34217729e8 - (v*1.34217729e8 - v))"
    off = f"(({hi}*{s} - (floor(v*{s}) + 0.5e0)) + (v - {hi})*{s})"
    return (
        f"list_transform([CAST({expr} AS DOUBLE)], lambda v: (floor(v*{s}) + CASE WHEN {off} > 0 OR ({off} = 0 AND "
        f"CAST(floor(v*{s}) AS BIGINT) % 2 <> 0) THEN 1e0 ELSE 0e0 END) / {s})[1]"
    )


# Whitespace as RE2 writes it, and as a list of characters for trim().
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TRIM = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)||chr(8232)||chr(8233)||chr(12288)"


def strip(expr: str) -> str:
    return f"trim({expr}, {TRIM})"


def collapse(expr: str) -> str:
    return strip(f"regexp_replace({expr}, '[{WS}]+', ' ', 'g')")


def shorten(expr: str, n: int) -> str:
    return (
        f"list_transform([{collapse(expr)}], lambda c: CASE WHEN length(c) <= {n} THEN c "
        f"ELSE rtrim(substr(c, 1, {n - 1}), {TRIM}) || '…' END)[1]"
    )


# Common table expressions; each may use earlier ones.
CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, body: str, uses: list[str] | None = None) -> None:
    CTES[name] = (body.strip(), uses or [])


def with_(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause holding the named expressions and all they use, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][1]:
            add(dep)
        order.append(n)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n"


cte("pieces", r"""
SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]') AS p FROM documents)
""")
cte("placed", """
SELECT doc_id, i, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS en FROM pieces
""", ["pieces"])
cte("words", r"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, lower(piece) AS tok, piece AS raw,
       en - length(piece) AS st, en
FROM placed WHERE regexp_matches(piece, '^[A-Za-z0-9_]+$|^[一-鿿]$')
""", ["placed"])
cte("samples", """
SELECT printf('s%08d', doc_id) AS id, doc_id, lang, source, text FROM documents
""")
cte("gold", """
SELECT printf('s%08d', doc_id) AS id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st) AS k, st, en, raw AS txt,
       CASE WHEN substr(md5(tok),1,1) < '8' THEN 'Term_A' WHEN substr(md5(tok),1,1) < 'c' THEN 'Term_B' ELSE 'Term_C' END AS label,
       false AS implicit
FROM words WHERE length(raw) >= 8
UNION ALL
SELECT printf('s%08d', doc_id), doc_id, 1000000000, -1, -1, 'implied', 'Term_I', true FROM documents
WHERE substr(md5('imp|' || doc_id), 1, 1) < '4'
""", ["words"])
cte("runs3", """
SELECT s.id AS sample_id, s.doc_id, r.run, printf('c%d', r.run) AS candidate_id, s.text,
       CASE WHEN substr(md5('none|' || s.doc_id || '|' || r.run),1,1) < '2' THEN NULL
            ELSE (10 + (('0x' || substr(md5('conf|' || s.doc_id || '|' || r.run),1,4))::BIGINT % 11)) / 20e0 END AS conf
FROM samples s, (SELECT unnest([1,2,3])::BIGINT AS run) r
""", ["samples"])
cte("cspans", """
SELECT g.id AS sample_id, g.doc_id, r.run, printf('c%d', r.run) AS candidate_id, g.k, g.st, g.en, g.txt, g.implicit,
       CASE WHEN substr(md5('fix|' || g.doc_id),1,1) >= '6' AND substr(md5(g.doc_id || '|' || r.run || '|' || g.st),1,1) = 'f'
            THEN 'Term_X' ELSE g.label END AS label
FROM gold g, (SELECT unnest([1,2,3])::BIGINT AS run) r
WHERE substr(md5('fix|' || g.doc_id),1,1) < '6' OR substr(md5(g.doc_id || '|' || r.run || '|' || g.st),1,1) >= '2'
""", ["gold"])
