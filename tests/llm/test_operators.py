"""Each operator on the odd cases, on an empty table, and against a plain restatement."""

import gzip
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from spanloom.llm import binary, decontaminate, jaccard, langid, lyndon, packing, quality, secrets, suffix, toxicity, warc
from spanloom.llm.components import components
from spanloom.llm.shared import scratch

from .data import documents, frame, hits, links, measures, removed, sentence

SF = "/root/testdata/sf0.01"


def tokenizer() -> str:
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_quality_measures_and_limits(spark):
    rows = quality.rated(frame(spark)).collect()
    assert len(rows) == len(documents())
    want = sorted((r[0] or -1, *measures(r[1])) for r in documents())
    assert sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    kept = quality.keep_good(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.rated(frame(spark, [])).count() == 0 and quality.keep_good(frame(spark, [])).count() == 0


def test_quality_limits_follow_group(spark):
    rng = random.Random(1)
    plain = [(k, sentence(rng, 80), "en", "a", 0) for k in range(150)]
    noisy = [(1000 + k, " ".join(w + "$" for w in sentence(rng, 80).split()), "en", "b", 0) for k in range(150)]
    stray = [(5000, " ".join(w + "$" for w in sentence(rng, 80).split()), "en", "a", 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality.rated(frame(spark, plain + noisy + stray)).collect()}
    assert kept[0] and kept[1000] and not kept[5000]  # the same share of signs is common in one source and odd in the other


def test_jaccard_join(spark):
    rows = [(r[0], r[1]) for r in documents()]
    n, top = links(rows)
    got = jaccard.linked(frame(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["class_id"] is None and r["n_links"] == 0
        else:
            assert (r["n_links"], r["class_id"]) == (n[r["doc_id"]] // (2 if r["doc_id"] == documents()[5][0] else 1), top[r["doc_id"]]), r
    kept = jaccard.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in top if top[i] == i} | {None}
    assert jaccard.linked(frame(spark, [])).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    """A neighbourhood larger than a block loses no link."""
    rng = random.Random(9)
    base = sentence(rng, 120).split()
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        rows.append((k, " ".join(w), "en", "a", 0))
    n, top = links([r[:2] for r in rows])
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.linked(frame(spark, rows)).collect()}
    assert got == {k: (n[k], top[k]) for k in range(40)}


def test_matched_prefix():
    length = jaccard.matched_prefix()
    assert 1 - (1 - 0.8**length) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (length + 1)) ** jaccard.TREES


def test_components(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(100, 7), (200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, 100: 0, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_suffix_orders(letters):
    rng = np.random.default_rng(letters)
    sizes = rng.integers(1, 60, 30)
    table = np.zeros((30, 60), np.int16)
    for r, n in enumerate(sizes):
        table[r, :n] = rng.integers(1, letters + 1, n)
    orders = lyndon.suffix_orders(table, sizes)
    for r, n in enumerate(sizes):
        text = bytes(table[r, :n].astype(np.uint8))
        want = sorted(range(n), key=lambda i: text[i:])
        assert orders[r, 60 - n :].tolist() == want == lyndon.suffix_order(np.frombuffer(text, np.uint8)).tolist()


def test_suffix_dedup(spark):
    want = removed([(r[0], r[1]) for r in documents()])
    rows = suffix.repeated(frame(spark)).collect()
    assert len(rows) == len(documents())
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert suffix.repeated(frame(spark, [])).count() == 0


def test_suffix_dedup_small_parts(spark, monkeypatch):
    """Grams and segments that meet from many tasks and parts give the same result."""
    rng = random.Random(4)
    pool = [sentence(rng, 12, "ab") for _ in range(6)]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 4))), "en", "a", 0) for k in range(40)]
    monkeypatch.setattr(suffix, "BUCKET", 500)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.repeated(frame(spark, rows).repartition(7)).collect()}
    assert got == removed([r[:2] for r in rows])


ITEMS = [(1, "one two three"), (2, None), (3, ""), (None, "the end")]


def test_decontamination(spark):
    rng = random.Random(8)
    long = sentence(rng, 25)
    items = [*ITEMS, (4, long), (40, long.upper()), (5, documents()[3][1])]
    docs = [(r[0], r[1], *r[2:]) for r in documents()] + [(900, "zero one two three four", "en", "a", 0), (901, sentence(rng, 5) + ", " + " ".join(long.split()[3:16]) + "!", "en", "a", 0)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, docs), table).collect()
    want = sorted((r[0] or -1, *(lambda h: (h[0], h[1], sorted(str(i) for i in h[2] if i is not None)))(hits(r[1], items))) for r in docs)
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], list(r["items"])) for r in got) == want
    clean = decontaminate.clean_documents(frame(spark, docs), table)
    bad = {r[0] for r in docs if hits(r[1], items)[1]}
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in docs} - bad
    assert decontaminate.contamination(frame(spark, []), table).count() == 0
    assert decontaminate.contamination(frame(spark), table.limit(0)).where("n_hit > 0").count() == 0


def test_token_records(spark):
    from tokenizers import Tokenizer

    plain, folder = Tokenizer.from_file(tokenizer()), scratch(spark)
    odd = [*documents(), (700, "İstanbul K ſ <|endoftext|> it's IT'S 3²", None, None, 0), (701, "é x\x1cy z", None, None, 0)]
    index = binary.write(frame(spark, odd), folder, tokenizer(), 2)
    rows = binary.read(index, folder).collect()
    assert len(rows) == len(odd)
    at = 0
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: r["start"]), sorted(((r[0], r[1]) for r in odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (doc_id, at, ids)
        at += len(ids)
    some = binary.read(index.where("doc_id % 2 = 0").orderBy(index["length"].desc()), folder, sums=True).collect()
    whole = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in rows}
    assert some and all(whole[r["doc_id"], r["start"]] == r["ids_crc32"] for r in some)
    empty = scratch(spark)
    assert binary.read(binary.write(frame(spark, []), empty, tokenizer(), 2), empty).count() == 0


def test_record_frames():
    record = binary.frame(binary.serialize(None, np.array([1, 70000], "<u4")))
    assert binary.parse(binary.unframe(record))[0] is None and binary.parse(binary.unframe(record))[1].tolist() == [1, 70000]
    for k in range(len(record)):
        with pytest.raises(ValueError):
            binary.unframe(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    got = packing.packed_documents(frame(spark)).collect()
    want = sorted((r[0] or -1, k, ids[k * 2048 : k * 2048 + 2048]) for r in documents() for ids in [[*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]] for k in range(math.ceil(len(ids) / 2048)))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted((i, k, 2048 * k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, k, x in want)
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) == math.ceil(sum(fill.values()) / 2048)
    assert packing.packed_documents(frame(spark, [])).count() == 0


def test_swap_search_lowers_count():
    lengths = np.array([6, 6, 5, 5, 5, 4, 3, 3, 2, 1])
    first, better = packing.best_fit(lengths, 10), packing.packed(lengths, 10)
    assert sorted(i for b in better for i in b) == list(range(10)) and all(lengths[b].sum() <= 10 for b in better)
    assert len(better) == 4 <= len(first)
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 60, 80)
        first, better = packing.best_fit(lengths, 100), packing.packed(lengths, 100)
        assert len(better) <= len(first) and sorted(i for b in better for i in b) == list(range(80)) and all(lengths[b].sum() <= 100 for b in better)


def held_out(divisor, rest):
    rows = duckdb.sql(f"select doc_id, text, lang, toxic from '{SF}/documents.parquet' left join '{SF}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    inside = lambda r: zlib.crc32(str(r[0]).encode()) % divisor == rest
    return [r for r in rows if not inside(r)], [r for r in rows if inside(r)]


def test_language_accuracy(spark):
    learn, check = held_out(4, 2)
    model = langid.train([r[1] for r in learn], [r[2] for r in learn], steps=400)
    lang, score, accepted = langid.answers(model, [r[1] for r in check])
    right = np.array([a == r[2] for a, r in zip(lang, check)])
    assert right.mean() > 0.97 and right[accepted].mean() >= right.mean() and ((score >= 0) & (score <= 1)).all()
    rows = langid.identified(frame(spark), model).collect()
    assert len(rows) == len(documents())
    odd = [r for r in rows if r["lang_pred"] == "und"]
    assert len(odd) == sum(not any(map(str.isalpha, r[1] or "")) for r in documents()) and all(r["score"] == 0 and not r["accepted"] for r in odd)
    assert langid.identified(frame(spark, []), model).count() == 0
    assert langid.trained(frame(spark, []))["names"] == [] and set(langid.trained(frame(spark))["names"]) == {"de", "en"}
    assert [r["lang_pred"] for r in langid.identified(frame(spark, documents()[:2]), {"names": []}).collect()] == ["und", "und"]


def test_toxicity_accuracy(spark):
    rng = random.Random(2)
    clean = [sentence(rng, 60, "aeinrst") for _ in range(160)]
    bad = [" ".join((s := sentence(rng, 60, "aeinrst").split())[:30] + [rng.choice(["mugwump", "blackguard", "cloddish"])] + s[30:]) for _ in range(80)]
    model = toxicity.train(clean[:100] + bad[:50], np.array([0] * 100 + [1] * 50))
    p = toxicity.probabilities(model, [t.encode() for t in clean[100:] + bad[50:]])
    assert (p[:60] < 0.5).mean() >= 0.95 and (p[60:] >= 0.5).mean() >= 0.95
    disguised = toxicity.probabilities(model, [b"you m.u.g.w.u.m.p here", b"b l a c k g u a r d", b"such a clod-dish one", b"blackxguard"])
    assert (disguised >= 0.5).all()
    rows = toxicity.scored(frame(spark), model).collect()
    assert len(rows) == len(documents()) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (500, 501)}
    assert len(empty) == 1
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.trained(frame(spark), labels)["weights"] is not None
    none = toxicity.trained(frame(spark), labels.limit(0))
    assert {r["score"] for r in toxicity.scored(frame(spark), none).collect()} == {0.0}


def test_language_sample_of_a_large_language(spark, monkeypatch):
    """The bound of the sample holds beyond 2^23 texts of a language."""
    docs = spark.range(9_000_000, numPartitions=4).selectExpr("id AS doc_id", "'abc def' AS text", "'en' AS lang")
    monkeypatch.setattr(langid, "train", lambda texts, langs: len(texts))
    assert 20 <= langid.trained(docs, 60) <= 120


def test_toxicity_of_spaced_words_with_double_letters():
    parts = lambda text: [text[s:e] for s, e in zip(*(a.tolist() for a in toxicity.units(np.frombuffer(text.encode(), np.uint8))))]
    assert parts("such real c l o D d i s h one") == ["such", "real", "c l o D d i s h", "one"]
    assert parts("x x") == ["x x"] and parts("x x x") == ["x", "x", "x"] and parts("q x x x x p") == ["q x", "x", "x", "x p"] and parts("") == []
    rng = random.Random(2)
    clean = [sentence(rng, 60, "aeinrst") for _ in range(100)]
    bad = [" ".join((s := sentence(rng, 60, "aeinrst").split())[:30] + [rng.choice(["mugwump", "blackguard", "cloddish"])] + s[30:]) for _ in range(50)]
    model = toxicity.train(clean + bad, np.array([0] * 100 + [1] * 50))
    spaced, plain, half = toxicity.probabilities(model, [b"you c l o d d i s h here", b"you cloddish here", b"you clod dish here"])
    assert spaced == plain > half and spaced >= 0.5


def test_toxicity_parts(monkeypatch):
    """A text in several parts scores as in one."""
    rng = np.random.default_rng(1)
    weights = rng.normal(size=toxicity.SIDE**3).astype(np.float32)
    texts = [sentence(random.Random(k), 200).encode() for k in range(5)] + [b"", b" "]
    whole = toxicity.worst(texts, weights)
    monkeypatch.setattr(toxicity, "BLOCK", 128)
    assert np.allclose(toxicity.worst(texts, weights), whole)


def test_secret_scan(spark):
    rng = random.Random(6)
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(60)]
    rows = [(k, f'{sentence(rng, 40)} token = "{h}" {sentence(rng, 20)}', "en", "a", 0) for k, h in enumerate(hexes[:40])]
    rows += [(100 + k, f"{sentence(rng, 40)} mail user@mail{k}.example.com card 4{k:015d} {sentence(rng, 9)}", "en", "a", 0) for k in range(40)]
    docs = frame(spark, rows)
    found = secrets.findings(docs).cache()
    model = secrets.trained(docs, found)
    got = secrets.judged(found, model).collect()
    assert {r["value"] for r in got if r["secret"]} == set(hexes[:40]) and any(not r["secret"] for r in got)
    assert secrets.scores(model, [(hexes[50], "somewhere ", " else")])[0] >= 0.5  # without a name before it
    out = {r["doc_id"]: r for r in secrets.redacted(docs).collect()}
    assert hexes[0] not in out[0]["text"] and secrets.MARK in out[0]["text"] and out[0]["n_chars"] == len(out[0]["text"]) and out[0]["kept"] == "clash"
    assert out[100]["text"] == rows[40][1] and len(out) == len(rows)
    odd = secrets.redacted(frame(spark))
    assert odd.columns == frame(spark).columns and odd.count() == len(documents())
    assert secrets.redacted(frame(spark, [])).count() == 0 and secrets.findings(frame(spark, [])).count() == 0


def test_secrets_of_other_forms_are_no_negatives(spark):
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n - 1)) + "7"
    at = lambda text: [text[s:e] for s, e in secrets.candidates(text)]
    live = "sk_live_" + key(24)
    assert at(f"export API_KEY={live} x") == [live] and at(f"user_name=ab12cd34 --set=token={live}") == ["ab12cd34", live]
    assert at("c2VjcmV0IHZhbHVlIDE2Mw== and") == ["c2VjcmV0IHZhbHVlIDE2Mw=="] and at("auth: password=Hunter2abc") == ["Hunter2abc"]
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(60)]
    forms = ["password: {}\n", "API_KEY={} ", "https://h.example/?access_key={}&x=1 ", "Authorization: Bearer {} ", "db_secret_v: {} ", "https://u:{}@h.example/ "]
    hidden = [key(24) for _ in range(60)]
    rows = [(k, f'{sentence(rng, 30)} token = "{h}" {sentence(rng, 20)}', "en", "a", 0) for k, h in enumerate(hexes)]
    rows += [(100 + k, f"{sentence(rng, 30)} {forms[k % 6].format(h)}{sentence(rng, 20)}", "en", "a", 0) for k, h in enumerate(hidden)]
    rows += [(200 + k, f"{sentence(rng, 30)} mail user@mail{k}.example.com card 4{k:015d} file /usr/share/doc{k}/readme.txt {sentence(rng, 9)}", "en", "a", 0) for k in range(60)]
    both = key(30)
    rows += [(300, f"aaa {both} bbb", "en", "a", 0), (301, f'x token = "{both}" y', "en", "a", 0), (302, f"aaa {live} bbb", "en", "a", 0), (303, 'secret = "correcthorsebattery"', "en", "a", 0)]
    docs = frame(spark, rows)
    found = secrets.findings(docs).cache()
    labels = {r["value"]: r["label"] for r in secrets.labelled(found).collect()}
    real = {*hexes, *hidden, both, live, "correcthorsebattery"}
    assert not [v for v, y in labels.items() if y == 0 and any(r in v for r in real)] and labels[both] == labels[live] == 1
    assert sum(not y for y in labels.values()) >= 60
    got = {r["value"] for r in secrets.judged(found, secrets.trained(docs, found)).collect() if r["secret"]}
    missed = [v for v in (*hexes, *hidden, both, live) if not any(v in g for g in got)]
    assert not missed and not any("mail" in g or g.startswith("4000") or "readme" in g for g in got)


def test_secrets_are_learned_from_all_rows(spark):
    """More findings of a label and more texts than were sampled before: all count."""
    name = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:04d}")
    rows = [(k, f'{(name(k) + " ") * 4}card 4{k:015d} token = "{hashlib.sha1(str(k).encode()).hexdigest()}"', "en", "a", 0) for k in range(2600)]
    docs = frame(spark, rows, extra=False)
    found = secrets.findings(docs).cache()
    labels = [r["label"] for r in secrets.labelled(found).collect()]
    assert labels.count(0) == labels.count(1) == 2600
    model = secrets.trained(docs, found)
    assert {name(k) for k in range(2600)} <= model["known"]["words"]
    assert len(model["trees"]) == 40 and {r["secret"] for r in secrets.judged(found, model).where("value LIKE '400%'").collect()} == {False}


PAGES = [
    (1, "http://a.example/x y", '<html lang="fr"><head><title> A &amp; B </title><style>p{}</style></head><body><p>One<b>two</b></p><!-- no --><script>x<y</script><a href="/l?a&amp;b">link</a><br>end</body></html>'),
    (2, None, None), (3, "u", ""), (None, "u", "text < only &lt;p&gt;"), (4, "v", "<script>never closed"), (4, "v", "<script>never closed"),
]


def test_warc_records(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'clash' AS record", "'clash' AS title")
    records = warc.derived(warc.responses(pages)).collect()
    assert len(records) == 2 * len(PAGES)
    for r in records:
        head, _, block = r["record"].partition("\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        body = block.removesuffix("\r\n\r\n").encode()
        assert fields["WARC-Type"] == r["record_type"] and fields["WARC-Refers-To"] == r["refers_to"] != r["record_id"] == fields["WARC-Record-ID"]
        assert int(fields["Content-Length"]) == len(body) and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
    text = {(r["page_id"], r["record_type"]): r["record"].split("\r\n\r\n")[1] for r in records}
    assert text[1, "conversion"] == "Onetwo\nlink\nend" and text[None, "conversion"] == "text < only <p>" and text[4, "conversion"] == text[2, "conversion"] == ""
    assert "title: A & B\r\n" in text[1, "metadata"] and "language: fr\r\n" in text[1, "metadata"] and "outlink: /l?a&b L a/@href" in text[1, "metadata"]
    assert "http://a.example/x%20y" in next(r["target_uri"] for r in records if r["page_id"] == 1)
    folder = scratch(spark)
    files = warc.write(warc.derived(warc.responses(pages)), folder).collect()
    data = b"".join(gzip.decompress(open(f"{folder.removeprefix('file://')}/{f['file']}", "rb").read()) for f in files)
    assert sum(f["n"] for f in files) == len(records) == data.count(b"WARC/1.1\r\n")
    assert warc.derived(warc.responses(pages.limit(0))).count() == 0


def test_warc_text_of_pages_that_leave_out_end_tags(spark):
    long = "word " * 40000
    htmls = {
        1: "<head><title>A</title><body><p>text</p>", 2: "<html><head><meta charset=utf-8><title>A</title>\n<p>text</p>", 3: "<head><title>A < B</title>text",
        4: "<head><title>A</title><noscript><link href=x></head><body>text", 5: "<body>text<template><p>more", 6: "<head><title>A</title></head><header>top</header>text",
        7: "<head><style>p{}</style><noscript><img src=x>gone</noscript><body>text<noscript>gone</noscript>", 8: "<head><template><div>gone</div></template><title>A</title><div>text</div>",
        9: "<head><title>A</title><script>var a;", 10: "<head>" + "<meta a=b>" * 20000 + f"<body>{long}",
        11: "<body><script>x = '<!--'</script>text<style>a::after{content: '<script>'}</style>",
    }
    want = {k: "text" for k in htmls} | {5: "text\nmore", 6: "top\ntext", 9: "", 10: long.strip()}
    pages = spark.createDataFrame([(k, "u", h) for k, h in htmls.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["record"].split("\r\n\r\n")[1] for r in warc.derived(warc.responses(pages)).where("record_type = 'conversion'").collect()}
    assert got == want


def test_warc_source_headers(spark):
    rows = [(1, "u", "<p>a", [("Server", "x/1"), ("Set-Cookie", "a=1"), ("Set-Cookie", "b=\r\n 2"), ("Empty", None)]), (2, "u", "<p>a", []), (3, "u", "<p>a", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, headers array<struct<name: string, value: string>>")
    records = warc.derived(warc.responses(pages)).where("record_type = 'metadata'").collect()
    blocks = {r["page_id"]: r["record"].split("\r\n\r\n")[1] for r in records}
    copied = {k: [x.removeprefix("source-http-header: ") for x in b.split("\r\n") if x.startswith("source-http-header: ")] for k, b in blocks.items()}
    assert copied == {1: ["Server: x/1", "Set-Cookie: a=1", "Set-Cookie: b=  2", "Empty: "], 2: [], 3: []}
    assert all(r["content_length"] == len((blocks[r["page_id"]] + "\r\n").encode()) or r["content_length"] == len(blocks[r["page_id"]].encode()) for r in records)


def test_pairs_of_segments_are_settled_as_sorting_would():
    """Pairs with the gram once, twice, at an end, or with equal letters all over, against suffix sorting."""
    rng = random.Random(4)
    long, gram = 50, 24
    texts, docs, grams = [], [], []
    for k in range(300):
        g = bytes(rng.choice(b"ab") for _ in range(gram)) if k % 3 else bytes(rng.choice(b"abcdefgh") for _ in range(gram))
        left, right = (bytes(rng.choice(b"ab") for _ in range(26)) for _ in range(2))
        for side in range(2):
            a, b = rng.randint(13, 26), rng.randint(13, 26)
            x, y = bytearray(left[26 - a :]), bytearray(right[:b])
            if side and rng.random() < 0.7:
                x[rng.randrange(len(x))] = 99
            if side and rng.random() < 0.7:
                y[rng.randrange(len(y))] = 99
            texts.append(bytes(x) + g + bytes(y) + (g if k % 11 == 0 else b""))
            docs.append(rng.randint(1, 5))
        _, start, size, _ = suffix.runs(np.frombuffer(g, np.uint8), gram, gram)
        grams += [suffix.runs(np.frombuffer(g, np.uint8), gram, gram)[0][0]] * 2
    docs, grams = np.array(docs), np.array(grams, np.uint64)
    seg, place, first, ok = suffix._settled(texts, docs, grams, long, gram)
    assert 200 < ok.sum() < 300
    got = {(s, p): f for s, p, f in zip(seg.tolist(), place.tolist(), first.tolist()) if f < docs[s]}
    want = {}
    for k in np.flatnonzero(ok).tolist():
        for s, p, f in zip(*suffix._first_holder(texts[2 * k : 2 * k + 2], docs[2 * k : 2 * k + 2], np.zeros(2, np.int64), long)):
            if f < docs[2 * k + s] and grams[2 * k] in suffix.runs(np.frombuffer(texts[2 * k + s][p : p + long], np.uint8), gram, gram)[0]:
                want[2 * k + s, p] = f
    assert got == want and len(got) > 100


def test_quality_limits_differ_between_groups(spark):
    """Every rule has several limits over the groups of a table, and few of them rest on a constant."""
    from spanloom.llm.shared import stored

    measures = stored(quality.measure(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    table = stored(quality.limits(stored(quality.sketch(measures))))
    for name in quality.RULES:
        assert table.select(f"{name}_max").distinct().count() >= 4, name
    told = quality.bounded(table).first()
    assert told["groups"] == 80 and told["bounded_rules"] <= 0.1 * 4 * 80
    verdicts = quality.judge(measures, table).where("NOT base_failed").groupBy((F.col("symbol_rate") > 300).alias("junk")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["junk"]: r["kept"] for r in verdicts}
    assert kept[False] > 0.98 and kept[True] < 0.05


def test_quality_constant_where_values_are_few(spark):
    rng = random.Random(2)
    rows = [(k, sentence(rng, 80), "en", "a", 0) for k in range(120)]
    table = quality.limits(quality.sketch(quality.measure(frame(spark, rows))))
    assert quality.bounded(table).first()["bounded_rules"] >= 2 and table.first()["symbol_rate_max"] == 32
    assert quality.bounded(quality.limits(quality.sketch(quality.measure(frame(spark, []))))).first()["groups"] == 0


def test_secret_forms_held_out(spark):
    """Precision and recall per form, none of whose values was seen in training and some of whose forms were not: other providers, other names, other words before a digest."""
    rng = random.Random(31)
    any_ = lambda n, kind="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(rng.choice(kind) for _ in range(n))
    hex_ = lambda n: any_(n, "0123456789abcdef")
    good = {
        "provider, seen": lambda: f"key AKIA{any_(16, 'ABCDEFGHJKLMNPQRSTUVWXYZ234567')} here", "provider, new": lambda: f"use {rng.choice(['npm_', 'hf_', 'SG.', 'dop_v1_'])}{any_(34)}7 now",
        "unquoted": lambda: f"password: Hunter{rng.randint(10, 99)}{any_(5)}9\n", "environment": lambda: f"export DB_PASSWORD={any_(12)}7 ", "bearer": lambda: f"authorization: bearer {any_(30)}4 ",
        "json": lambda: f'{{"client_secret": "{any_(22)}3"}}', "address": lambda: f"amqp://guest:{any_(14)}5@queue.example/ ", "new name": lambda: f"smtp_credential = '{any_(18)}6'",
    }
    none = {
        "digest": lambda: f"image sha256:{hex_(64)} ", "new digest": lambda: f"blake2b={hex_(64)} ", "commit": lambda: f"fixed in commit {hex_(40)}.", "new commit": lambda: f"parent {hex_(40)}\n",
        "uuid": lambda: f"request {hex_(8)}-{hex_(4)}-{hex_(4)}-{hex_(4)}-{hex_(12)} ", "path": lambda: f"https://h.example/docs/guide/v{rng.randint(1, 9)}/install{rng.randint(1, 99)}.html ",
        "number": lambda: f"card 4{any_(15, '0123456789')} ", "name": lambda: f"def parse_report_table_{rng.randint(1, 99)}(x)",
    }
    docs = frame(spark, [(k, f'{sentence(rng, 30)} token = "{hex_(40)}" {sentence(rng, 9)}', "en", "a", 0) for k in range(60)]
                 + [(100 + k, f"{sentence(rng, 30)} mail user@mail{k}.example.com card 4{k:015d} {sentence(rng, 9)}", "en", "a", 0) for k in range(60)])
    model = secrets.trained(docs, secrets.findings(docs))

    def share(make):
        hits = 0
        for _ in range(50):
            text = f"{sentence(rng, 8)} {make()} {sentence(rng, 4)}"
            places = secrets.candidates(text)
            rows = [(text[s:e], text[max(0, s - secrets.AROUND) : s], text[e : e + secrets.AROUND]) for s, e in places]
            hits += bool((secrets.scores(model, rows) >= 0.5).any())
        return hits / 50

    found, flagged = {n: share(f) for n, f in good.items()}, {n: share(f) for n, f in none.items()}
    print("recall", found, "flagged", flagged)
    assert min(found.values()) >= 0.85 and sum(found.values()) / len(found) >= 0.95, found
    assert max(flagged.values()) <= 0.1, flagged
    assert sum(found.values()) / (sum(found.values()) + sum(flagged.values())) >= 0.95


def test_forest_recall_is_measured(spark):
    """Recall on all pairs that reach the threshold, at the length where shortening ended; longer prefixes find less. Most pairs lie close above 0.8."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = sentence(rng, 200).split()
        for _ in range(6):
            w = list(base)
            for at in rng.sample(range(5, 195, 10), 2):  # each changes five shingles
                w[at] = sentence(rng, 1) + "x"
            texts.append(" ".join(w))
    made = frame(spark, [(k, t, "en", "a", 0) for k, t in enumerate(texts)])
    for docs, some in ((made, 300), (spark.read.parquet(f"{SF}/documents.parquet"), 10)):
        rows = jaccard.signed(docs, sample=1000).cache()
        shared = jaccard.shared_prefixes(rows)
        length = jaccard.reached(shared)
        assert sum(shared.values()) > some and jaccard.recall_at(length, shared) >= jaccard.RECALL
        n, _ = links([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
        got = {r["doc_id"]: r["n_links"] for r in jaccard.linked(docs).collect()}
        print("recall", sum(got.values()) / sum(n.values()), "prefix", length, "pairs", shared)
        assert sum(got.values()) >= jaccard.RECALL * sum(n.values()) and all(got[i] <= n[i] for i in got)
        if docs is made:
            assert jaccard.recall_at(jaccard.FULL, shared) < 1


def test_prefixes_are_shortened_for_real_pairs():
    assert jaccard.reached({}) == jaccard.matched_prefix() == jaccard.reached({12: 5, 9: 3})
    assert jaccard.reached({12: 990, 4: 10}) == 4 and jaccard.reached({1: 1}) == 1
    assert jaccard.recall_at(5, {12: 3, 4: 1}) == 0.75
