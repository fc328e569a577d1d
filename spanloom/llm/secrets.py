"""Secrets in texts: wide patterns find candidates, a random forest takes the false positives out.

A candidate is a run of 16 or more characters that keys and tokens are made of and that has a digit, or any value of eight or
more assigned to a name such as ``token`` or ``password``, or in the user part of an address. A leading ``NAME=`` is no part of the value. The forest sees its length, make-up and entropy, how likely its
letter transitions are in ordinary words, how much of it ordinary words cover, whether it reads as a path, address or number, and
the words around it.

Training takes labelled findings (a table of value, before, after and label). ``labelled`` makes such a table from candidates where
no reviewed one is at hand: a value with a digit counts as one if it is in quotes and assigned to a secret's name, follows Bearer, or starts
as the keys of a known provider do, in any place it occurs. What the rule cannot decide is left out: other values assigned to such a name
(unquoted, without a digit), after Bearer, or in the user part of an address. All else counts as none. A corpus shows few forms, so
made-up findings of many forms join them (``examples``): keys, tokens and passwords in assignments, headers, addresses and prose, and against
them digests, commit ids, uuids, paths, versions, names and settings. The value and its surroundings count both: the same letters are a
secret after ``password:`` or alone and none after ``sha256:``. All labelled findings and the words of all texts are used for fitting, in Spark; so that the
``EXAMPLES`` of each form are not outnumbered, the findings of a label count together as ``SAMPLE`` of them at most.

NULL and empty texts have no candidates. A corpus without findings of both labels cannot train a forest: then what the labelling rule
says is returned. Repeated rows give repeated findings. Other columns are ignored by ``findings`` and kept by ``redacted``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest
from .shared import stored

SAMPLE, EXAMPLES = 2000, 60
FREQUENT, HELD = 3000, 100_000  # words kept as ordinary ones; different words a task holds before it hands them on
AROUND = 48
MARK = "[SECRET]"
NAMES = "token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?"
_RUN = re.compile(r"[A-Za-z0-9+/_=.~\-]{16,}")
_ASSIGNED = re.compile(rf"(?i)(?:{NAMES})[\"']?\s*[:=]\s*[\"']?([^\s\"'<>]{{8,}})")
_USER = re.compile(r"://[^\s/@:\"'<>]{1,64}:([^\s/@\"'<>]{8,})@")
_NAMED = re.compile(rf"(?i)(?:{NAMES})")
_DIGEST = re.compile(r"(?i)\b(?:sha\d*|md5|checksum|digest|commit|hash|uuid|rev(?:ision)?|etag|isbn)\b")
_DIGIT = re.compile(r"[0-9]")
_ORDINARY = re.compile(r"[^\W\d_]{3,}")
_LEAD = re.compile(r"(?:-{0,2}[A-Za-z_][A-Za-z0-9_.\-]*=)+(?=[^=])")
# What the labelling rule looks for, in forms that Spark and Python read alike: the first two are secrets, the others undecided.
QUOTED = rf"(?i)(?:{NAMES})[\"']?\s*[:=]\s*[\"']$"
PROVIDER = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[oprsu]_|github_pat_|glpat-|[prs]k_(?:live|test)_|sk-|xox[abeprs]-|AIza|ya29\.|SG\.|npm_|pypi-|hf_|dop_v1_|shp(?:at|ca|pa|ss)_|eyJ[A-Za-z0-9_\-]+\.)"
BEARER = r"(?i)\bbearer\s+[\"']?$"
OPEN = rf"(?i)(?:(?:{NAMES})(?:[_\-][\w\-]*)?[\"']?\]?\s*[:=]+>?\s*[\"'`]?|://[^\s/@]*:)$"
_OPEN, _BEARER, _PROVIDER = re.compile(OPEN), re.compile(BEARER), re.compile(PROVIDER)
_SUM = re.compile(r"(?i)\b(?:sha-?\d*|md5|blake\w*|checksum|digest|commit|hash|rev(?:ision)?|etag|fingerprint|tree|parent|build|isbn|uuid|guid|crc\d*)(?:sum)?[\"']?[\s:=#(\[]*(?:(?:is|to|at)\s+)?[\"'`]?$")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
FOUND = "doc_id long, start int, stop int, value string, before string, after string"


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of candidates, in order and without overlap; of two that overlap the longer stays."""
    found = set()
    for m in _RUN.finditer(text):
        cut = _LEAD.match(m.group())
        at = cut.end() if cut else 0
        # A value of eight stays if it is sixteen with its name; a name of sixteen is looked at by itself.
        for start, value, least in ((m.start(), m.group()[: at - 1] if at else "", 16), (m.start() + at, m.group()[at:], 8 if at else 16)):
            if _DIGIT.search(value):
                lead = len(value) - len(value.lstrip("-=."))
                core = value.strip("-=.") if not value.endswith("=") else value.lstrip("-=.")
                if len(core) >= least:
                    found.add((start + lead, start + lead + len(core)))
    lowered = text.lower()
    if any(n in lowered for n in ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential")):
        for m in _ASSIGNED.finditer(text):
            cut = _LEAD.match(m.group(1))
            if not cut or len(m.group(1)) - cut.end() >= 8:
                found.add((m.start(1) + (cut.end() if cut else 0), m.end(1)))
    if "://" in text:
        found.update((m.start(1), m.end(1)) for m in _USER.finditer(text))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found, key=lambda p: (p[0], -p[1])):
        if out and s < out[-1][1]:
            if e - s > out[-1][1] - out[-1][0]:
                out[-1] = (s, e)
            continue
        out.append((s, e))
    return out


def findings(docs: DataFrame) -> DataFrame:
    """All candidates with the characters around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                out += [(doc_id, s, e, text[s:e], text[max(0, s - AROUND) : s], text[e : e + AROUND]) for s, e in candidates(text)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 3])], names=["doc_id", "start", "stop", "value", "before", "after"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def labelled(found: DataFrame) -> DataFrame:
    """Distinct findings with a label by the rule.

    A value that is a secret in one place is one; a value that is undecided in one place, and a secret in none, is left out.
    """
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    sure = value.rlike("[0-9]") & (before.rlike(QUOTED) & after.rlike("^[\"']") | before.rlike(BEARER) | value.rlike(PROVIDER))
    place = F.when(sure, 0).when(before.rlike(OPEN) | before.rlike(BEARER) | value.rlike(PROVIDER), 1).otherwise(2)
    rows = found.select("value", F.struct(place.alias("place"), "before", "after").alias("r")).groupBy("value").agg(F.min("r").alias("r"))
    return rows.where("r.place <> 1").select("value", "r.before", "r.after", F.expr("CAST(r.place = 0 AS INT)").alias("label"))


def _walks(word: str) -> list[int]:
    codes = [ord(c) & 127 for c in word]
    return [a * 128 + b for a, b in zip(codes, codes[1:])]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all ordinary words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(_ORDINARY.findall((text.as_py() or "").lower()))
                if len(counts) >= HELD:
                    yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
                    counts = Counter()
        yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each letter follows each other, in counted words."""
    total = np.zeros(128 * 128, np.int64)
    for batch in batches:
        words = batch.column(0).to_pylist()
        codes = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        times = np.repeat(batch.column(1).to_numpy(), [len(w) + 1 for w in words])
        inside = np.flatnonzero((codes[:-1] != 10) & (codes[1:] != 10))
        np.add.at(total, (codes[inside] & 127) * 128 + (codes[inside + 1] & 127), times[inside])
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["pair", "n"])


def language(docs: DataFrame) -> dict:
    """Letter transitions and frequent words of ordinary text, over all documents."""
    words = stored(word_counts(docs))
    pairs = np.ones(128 * 128)
    for r in words.mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 128 * 128 rows at most
        pairs[r["pair"]] += r["n"]
    table = pairs.reshape(128, 128)
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return {"log": np.log(table / table.sum(axis=1, keepdims=True)), "words": frozenset(r["word"] for r in top if len(r["word"]) <= 16)}


def _covered(value: str, words: frozenset) -> float:
    """Share of the characters that known words cover, longest first from the left."""
    low, at, n = value.lower(), 0, 0
    while at < len(low):
        step = next((k for k in range(min(16, len(low) - at), 2, -1) if low[at : at + k] in words), 0)
        n += step
        at += step or 1
    return n / max(len(low), 1)


def features(value: str, before: str, after: str, known: dict) -> list[float]:
    n, counts = len(value), Counter(value)
    share = np.array(list(counts.values())) / n
    walks = _walks(value.lower())
    line = before.rsplit("\n", 1)[-1]
    return [
        n,
        sum(c.isdigit() for c in value) / n,
        sum(c.isupper() for c in value) / n,
        float(-(share * np.log2(share)).sum()),
        len(counts) / n,
        float(known["log"].reshape(-1)[walks].mean()) if walks else 0.0,
        _covered(value, known["words"]),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))),
        float(bool(re.fullmatch(r"[0-9.\-+/=~_]+", value))),
        sum(bool(a.isalpha()) != bool(b.isalpha()) for a, b in zip(value, value[1:])) / n,
        value.count("/") + (10 if "//" in before[-8:] + value else 0),
        value.count(".") + value.count("-"),
        float(before.endswith("@") or after.startswith("@")),
        float(bool(_NAMED.search(line[-32:]))),
        float(bool(_DIGEST.search(line[-32:]))),
        float(before.endswith(("'", '"')) and after.startswith(("'", '"'))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(bool(_PROVIDER.search(value))),
        float(bool(_OPEN.search(before))),
        float(bool(_BEARER.search(before))),
        float(bool(_SUM.search(line[-40:]))),
        float(bool(_UUID.fullmatch(value))),
        float(bool(re.search(r"[\w.]/[\w.]", value) or value.startswith(("./", "~/")) or before.endswith(("/", "://")))),
        max((len(x) for x in re.findall(r"[a-z]+|[A-Z]+|[0-9]+", value)), default=0) / n,
    ]


def examples(each: int = EXAMPLES, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Made-up findings (value, before, after, label) of the forms in which secrets and what looks like them are written."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    letters = lambda kind, low, high: "".join(pick(kind) for _ in range(int(rng.integers(low, high + 1))))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hex_, mixed = digits + "abcdef", digits + lower + upper
    word = lambda: pick(["river", "summer", "blue", "data", "user", "admin", "field", "name", "value", "file", "model", "report", "table", "winter", "green", "build", "index", "total"])
    key = lambda: pick([lambda: letters(hex_, 32, 64), lambda: letters(mixed, 20, 44), lambda: letters(mixed + "+/", 30, 60) + pick(["", "=", "=="])])()
    password = lambda: pick([lambda: word().title() + letters(digits, 2, 4) + letters(mixed + "!#%", 1, 4), lambda: letters(mixed, 9, 14) + pick(digits), lambda: word() + pick("-_.") + word().title() + letters(digits, 2, 5)])()
    provider = lambda: pick([
        lambda: pick(["AKIA", "ASIA"]) + letters(upper + digits, 16, 16), lambda: pick(["ghp_", "gho_", "ghs_"]) + letters(mixed, 36, 36), lambda: pick(["sk_live_", "sk_test_", "rk_live_"]) + letters(mixed, 24, 24),
        lambda: "AIza" + letters(mixed + "-_", 35, 35), lambda: pick(["xoxb-", "xoxp-"]) + letters(digits, 10, 12) + "-" + letters(mixed, 24, 24), lambda: "glpat-" + letters(mixed, 20, 20), lambda: "sk-" + letters(mixed, 40, 48)])()
    uuid = lambda: "-".join(letters(hex_, n, n) for n in (8, 4, 4, 4, 12))
    name = lambda: pick(["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "DB_PASSWORD", "API_KEY", "SECRET_KEY", "AWS_SECRET_ACCESS_KEY"])
    lead, rest = lambda: pick(["", "see ", "the ", "\n", "config ", "- ", "export ", "  "]), lambda: pick(["", "\n", " and more", ".", ", next", ";"])
    quote = lambda: pick("\"'")
    good = [
        lambda: (pick([key, password])(), f"{lead()}{name()}{pick([' = ', '=', ': '])}{(q := quote())}", q + rest()),
        lambda: (pick([key, password])(), f"{lead()}{name()}{pick([': ', '=', ' = '])}", pick(["\n", "", " "])),
        lambda: (pick([key, password])(), f'{{"{name()}": "', '"' + pick(["}", ", "])),
        lambda: (key(), f"{lead()}Authorization: Bearer ", rest()),
        lambda: (pick([key, password])(), f"{pick(['postgres', 'https', 'mysql'])}://{word()}:", f"@{word()}.example"),
        lambda: (provider(), lead(), rest()),
        lambda: (provider(), f"{lead()}{word()}{pick([' = ', ': ', ' '])}{(q := pick(['', chr(34)]))}", q + rest()),
        lambda: (provider(), f"{lead()}{name()}{pick(['=', ': '])}", rest()),
        lambda: (key(), f"{lead()}{word()} ", rest()),
    ]
    digest = lambda: letters(hex_, *pick([(32, 32), (40, 40), (64, 64)]))
    none = [
        lambda: (digest(), f"{lead()}{pick(['sha256', 'sha1', 'md5', 'checksum', 'digest', 'SHA-256'])}{pick([':', ': ', ' = ', ' '])}{(q := pick(['', chr(34)]))}", q + rest()),
        lambda: (digest(), f"{lead()}{pick(['commit', 'revision', 'rev', 'tree', 'parent', 'hash', 'etag'])}{pick([' ', ': ', '='])}", rest()),
        lambda: (letters(hex_, 40, 40), f"{pick(['fixed in', 'merged', 'see', 'at', 'from'])} commit ", rest()),
        lambda: (uuid(), f"{lead()}{pick(['id', 'uuid', 'request', 'user_id', ''])}{pick([': ', '=', ' '])}", rest()),
        lambda: ("/".join(word() for _ in range(int(rng.integers(2, 5)))) + "/" + word() + letters(digits, 1, 4) + pick([".html", ".py", "", ".tar.gz"]), f"{pick(['https://', 'http://', '/', './', ''])}{word()}.example/", rest()),
        lambda: ("_".join(word() for _ in range(int(rng.integers(2, 5)))) + pick(["_", "-", "."]) + letters(digits, 1, 4), f"{lead()}{pick(['def ', 'class ', 'the ', 'name: ', 'file ', ''])}", rest()),
        lambda: (pick([lambda: letters(digits, 16, 20), lambda: ".".join(letters(digits, 1, 4) for _ in range(6)), lambda: "20" + letters(digits, 2, 2) + "-12-01T10:" + letters(digits, 2, 2) + ":00.000"])(), f"{lead()}{pick(['at ', 'version ', 'number ', 'isbn ', 'id=', ''])}", rest()),
        lambda: (pick([word() + "_" + word(), word() + "-" + word() + "-" + word(), "required", "disabled", "changeme_in_production_please", "your-api-key-here", "config." + word() + "." + word()]), f"{lead()}{name()}{pick([': ', ' = ', '='])}{(q := pick(['', chr(34)]))}", q + rest()),
        lambda: (key() if rng.random() < 0.5 else digest(), f"{pick(['data:image/png;base64,', 'integrity=' + chr(34) + 'sha384-', 'blob '])}", rest()),
        lambda: (word().title() + word().title() + letters(digits, 1, 3) + word().title() + word().title(), f"{lead()}{pick(['new ', 'class ', 'call ', ''])}", pick(["()", rest()])),
    ]
    return [(*form(), label) for label, forms in ((1, good), (0, none)) for form in forms for _ in range(each)]


def scores(model: dict, rows: list[tuple[str, str, str]]) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    x = np.array([features(*r, model["known"]) for r in rows])
    if model["trees"] is None:  # one label only: the rule that would have labelled them
        return np.maximum(x[:, 13] * x[:, 15] * x[:, 16], [float(bool(_DIGIT.search(v) and (re.search(BEARER, b) or re.search(PROVIDER, v)))) for v, b, _ in rows])
    return forest.predict(model["trees"], x)


def trained(docs: DataFrame, found: DataFrame, labels: DataFrame | None = None) -> dict:
    """The forest and what its features need, from all labelled findings (by default those of ``labelled``), all texts and made-up findings of many forms."""
    known = language(docs)
    columns = ["value", "before", "after", "label"]
    rows = stored((labelled(found) if labels is None else labels).select(*columns))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        return {"known": known, "trees": None}
    made_up = examples()
    blank = F.lit("")
    shown = rows.unionByName(rows.where("label = 1").select("value", blank.alias("before"), blank.alias("after"), "label")).withColumn("kind", F.col("label").cast("int"))
    shown = shown.unionByName(docs.sparkSession.createDataFrame(made_up, "value string, before string, after string, label int").withColumn("kind", F.col("label") + 2))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(*r, known) for r in zip(*(batch.column(c).to_pylist() for c in ("value", "before", "after")))]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), *[batch.column(c) for c in ("kind", "key", "label")]], names=["x", "kind", "key", "label"])

    shown = stored(shown.select(*columns[:3], "kind", F.xxhash64(*columns, "kind").alias("key"), F.col("label").cast("int").alias("label")).mapInArrow(measure, "x array<double>, kind int, key long, label int"))
    made = Counter(r[3] for r in made_up)
    # Each label has half of the weight; its labelled findings count as SAMPLE at most, a secret with its surroundings and without.
    each = [min(1.0, SAMPLE / counts[y]) for y in (0, 1)]
    sums = [counts[0] * each[0] + made[0], 2 * counts[1] * each[1] + made[1]]
    weights = [w * sum(sums) / 2 / sums[y % 2] for y, w in enumerate([*each, 1.0, 1.0])]
    return {"known": known, "trees": forest.fit(shown, len(features("x", "", "", known)), weights)}


def judged(found: DataFrame, model: dict) -> DataFrame:
    """Findings with the forest's score and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(model, list(zip(*(batch.column(c).to_pylist() for c in ("value", "before", "after")))))
            yield batch.append_column("score", pa.array(s, pa.float64())).append_column("secret", pa.array(s >= 0.5, pa.bool_()))

    return found.mapInArrow(run, FOUND + ", score double, secret boolean")


def redact(text: str | None, model: dict) -> str | None:
    if not text:
        return text
    places = candidates(text)
    keep = scores(model, [(text[s:e], text[max(0, s - AROUND) : s], text[e : e + AROUND]) for s, e in places]) >= 0.5
    for (s, e), secret in reversed(list(zip(places, keep))):
        if secret:
            text = text[:s] + MARK + text[e:]
    return text


def redacted(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The documents with their secrets replaced by a mark; ``n_chars``, if there, follows the text. No text is shuffled."""
    model = trained(docs, stored(findings(docs)), labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(v.as_py(), model) for v in batch.column(names.index("text"))]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                sizes = [n if a.as_py() == b else len(b) for n, a, b in zip(batch.column(at).to_pylist(), batch.column(names.index("text")), texts)]
                columns[at] = pa.array(sizes, pa.int64())
            yield pa.record_batch(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = stored(findings(docs))
    return judged(found, trained(docs, found)).select("doc_id", "start", "stop", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


QUERIES = {"op3_secret_scan": op3_secret_scan}
