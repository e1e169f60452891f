"""Secrets, lines, languages, quality, HTML, pieces and packing against plain versions and libraries."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from brute import dedup_lines
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import html, langid, lines, media, packing, pieces, quality, secrets
from factloom.llm.queries import byte_bpe_files

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, "a long line that repeats here\nx\n\nA LONG line that repeats here \n", "en"), (2, None, None), (3, "", "de"), (3, "", "de"), (None, "a long line that repeats here", "en")]


def odd(spark, extra=""):
    """Nulls, empty texts, repeated rows, a null id, and extra columns with clashing names."""
    rows = ODD + [(k, f"word{k}\na long line that Repeats here", "en") for k in range(4, 8)] + [(9, "y" * 30000 + "\n" + " z" * 20000, "fr")]
    return spark.createDataFrame([(*r, "s", 1, *[0] * extra.count(",")) for r in rows], f"doc_id long, text string, lang string, source string, n_lines int{extra}")


# secrets


def plain_spans(text):
    found = [("assign", m) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_against_patterns():
    r = random.Random(2)
    parts = ["password", "TOKEN", "api_key", "apikey", "ſecret", "toKen", " ", "=", ":", '"', "'", "abcdef", "secret", "AKIA", "ABCDEFGHIJKLMNOP12", "deadbeef" * 3, "0123", "é", "\n", "x", "a" * 30]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert secrets.scan(text)[0] == plain_spans(text), text
        assert set(secrets.scan(text)[0]) <= set(secrets.scan(text)[1])


def test_entropy_by_increments():
    r = random.Random(3)
    s = "".join(r.choice("abcdefg01") for _ in range(60))
    for i, e in enumerate(secrets.window_entropy(s, 20)):
        part = s[i : i + 20]
        assert e == pytest.approx(-sum(part.count(c) / 20 * math.log2(part.count(c) / 20) for c in set(part)))
    assert len(secrets.window_entropy("short", 20)) == 0


def test_added_spans_allow_list_and_redaction():
    key = "q9Zt3LmN0pQ2rS7uVxY1aBcD"
    assert [k for k, _, _ in secrets.scan(f"see {key} now")[1]] == ["entropy_base64"]
    for quiet in ("123e4567-e89b-12d3-a456-426614174000", "EXAMPLEq9Zt3LmN0pQ2rS7uVx", "thisisaverylongwordwithoutanydigits", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        assert secrets.scan(quiet)[1] == []
    assert secrets.redact(f"é {key} b password: hunter22!") == "é [SECRET] b [SECRET]!"


def test_random_keys_are_found_whole():
    r = random.Random(7)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for members, least in ((lower + upper + digit + "+/", 0.98), (lower + digit, 0.98), (upper + digit, 0.98), (upper + "234567", 0.95)):
        for n in (20, 24, 32, 40):
            keys = ["".join(r.choice(members) for _ in range(n)) for _ in range(500)]
            assert sum(secrets.redact(f"see {k} now") == "see [SECRET] now" for k in keys) >= least * len(keys)


def test_allow_list_clears_only_its_part():
    key, uuid = "q9Zt3LmN0pQ2rS7uVxY1aBcD", "123e4567-e89b-12d3-a456-426614174000"
    assert secrets.redact(f"{uuid}/{key}") == f"{uuid}[SECRET]"
    assert secrets.redact(f"dummy={key}==") == "dummy=[SECRET]"
    for quiet in (f"sha256-{key}{key[:19]}=", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "ThisIsSomeLongClassName", "Mai-2024-Zusammenfassung", "internationalisierung2024", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"):
        assert secrets.scan(quiet)[1] == []


def test_secret_digest(spark):
    df = spark.createDataFrame([(1, "é token=abcdef12 x", 1), (2, None, 1), (2, None, 1), (3, "", 1)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in secrets.secret_digest(df).collect()}
    assert got[1]["spans"] == "assign:2:16" and got[1]["base_sha256"] == hashlib.sha256(b"assign:2:16").hexdigest() and got[1]["n_assign"] == 1
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and secrets.secret_digest(df).count() == 4
    assert secrets.secret_digest(df.limit(0)).count() == 0


# lines


@pytest.mark.parametrize("small", [False, True])  # one shard and chunk, or many; with hot keys apart
def test_lines_against_plain(spark, monkeypatch, small):
    if small:
        for name, value in {"SHARD_BITS": 64, "MOST_BITS": 64, "CHUNK": 7, "HOT_DOCS": 4}.items():
            monkeypatch.setattr(lines, name, value)
    r = random.Random(4)
    pool = [f"  Line number {k} of the pool, long enough " for k in range(8)] + ["short", "", "ÄÖÜ äöü long enough for a key", "äöü ÄÖÜ long enough for a key"]
    docs = [(k % 25, "\n".join(r.choice(pool) for _ in range(r.randrange(6)))) for k in range(30)] + [(None, pool[0]), (50, None), (51, "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_dropped string").repartition(5)
    want = sorted(((i is None, i or 0, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in dedup_lines(docs)))
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in lines.line_digest(df).collect())
    assert got == want


def test_lines_edge_cases(spark):
    assert lines.line_digest(odd(spark)).count() == 10
    assert lines.line_digest(odd(spark).limit(0)).count() == 0
    docs = odd(spark, ", __n_lines int, __Drops int, __of int, __n_dropped int")
    kept, n_lines, n_dropped = lines.drop_repeated_lines(docs)
    assert kept.columns == [*docs.columns, n_lines, n_dropped] and n_lines not in docs.columns and kept.count() == 10


def line_documents(spark):
    """Each document has 20 lines of its own and one of 3 common ones."""
    rows = [(k, "\n".join([f"a line that only document {k} holds, number {j}" for j in range(20)] + [f"common line of kind {k % 3}, long enough"])) for k in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("bits", [1 << 11, 1 << 22])
def test_only_suspected_repeats_shuffle(spark, monkeypatch, bits):
    monkeypatch.setattr(lines, "SHARD_BITS", bits)
    monkeypatch.setattr(lines, "MOST_BITS", bits)
    docs = line_documents(spark)
    found = lines.suspects(docs, 20).toPandas()
    common = [hashlib.sha256(f"common line of kind {k}, long enough".encode()).digest() for k in range(3)]
    assert set(common) <= set(map(bytes, found.digest)) and sum(bytes(d) in common for d in found.digest) == 400
    assert len(found) < 400 + 0.05 * 8000  # of 8,000 lines without a repeat, few are suspected
    name = lines._line_table(docs, 20)
    shape = lines.Filter.of(8400)
    table = spark.table(name)
    plan = lines._suspected(table, lines.replies(lines.messages(table, shape), shape), shape)._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {name}")
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert sorted(moved) == ["chunk", "shard"]  # messages and answers move, lines don't
    assert "Bucketed: true" in plan and "Broadcast" not in plan


def test_filters_grow_with_the_lines():
    assert lines.Filter.of(0).shards == 1 and lines.Filter.of(1 << 20) == (4, 1 << 22)
    assert lines.Filter.of(1 << 32).bits == 1 << 24 and lines.Filter.of(1 << 40).bits == lines.MOST_BITS


# languages


def test_languages_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.held_out_identification(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 20 and (out.lang == out.lang_pred).mean() > 0.9 and out.score.between(0, 1).all()
    assert set(out.doc_id) == {i for i in docs.select("doc_id").toPandas().doc_id if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_edge_cases(spark):
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 3, "en" if k % 2 else "de") for k in range(200)]
    df = spark.createDataFrame([*rows, (300, None, "en"), (301, "123 !", "de"), (302, "", None), (303, "the dog", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.held_out_identification(df).collect()}
    assert [got[k]["lang_pred"] for k in (300, 301, 302)] == ["und"] * 3 and got[303]["lang_pred"] == "en" and len(got) == 204
    assert {r["lang_pred"] for r in langid.held_out_identification(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.held_out_identification(df.where("lang = 'en' or lang is null").select("doc_id", "text", "lang")).collect()} == {"und", "en"}
    assert langid.held_out_identification(df.limit(0)).count() == 0


def test_codewords_are_apart():
    for n in (2, 4, 6, 40):
        c = langid.codewords(n).astype(int)
        d = (c[:, None] != c[None]).sum(2) + np.eye(n, dtype=int) * 99
        assert d.min() >= (1 if n == 2 else 2 ** (n - 2) if n <= 6 else 8)
    margins = np.array([[1.0, -1.0, 1.0, -1.0, 1.0, 1.0, 1.0]])
    share = langid.decode(margins, langid.codewords(4))
    assert share.shape == (1, 4) and share.sum() == pytest.approx(1)


# quality


def test_quality_keeps_clean_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(docs, labels).join(labels, "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.97 and (~out[out.quality == 0].kept).mean() > 0.6
    assert quality.score(docs, labels).count() == docs.count()


def test_quality_edge_cases(spark):
    df = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(df, none).where("kept").count() == 10
    assert quality.score(df.limit(0), none).count() == 0
    same = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 0, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(df.withColumn("source", F.lit(None).cast("string")), same).where("kept").count() == 10


def test_posteriors_shrink(spark):
    rows = [("big", "big/a", 2.0)] * 400 + [("big", "big/b", -2.0)] * 400 + [("small", "small/x", -2.0)] + [("c", "c/y", 2.0)] * 300
    sums, prior = quality.posteriors(spark.createDataFrame(rows, "host string, path string, log_odds double"))
    own = 1 / (1 + math.exp(2.0))
    m = {r["path"]: r for r in sums.select("path", prior.means()[1].alias("path_mean"), prior.means(F.lit(own))[1].alias("others")).collect()}
    assert abs(m["small/x"]["others"] - prior.corpus) < 1e-9  # a document alone tells its site nothing
    assert own < m["small/x"]["path_mean"] < prior.corpus and abs(m["big/b"]["path_mean"] - own) < 0.05 and m["big/a"]["path_mean"] > 0.8


# HTML


def test_pages_give_their_articles(spark, sf):
    import html as library

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    out = html.main_text(pages).collect()
    for r in out:
        article = re.search("<article>(.*?)</article>", source[r["page_id"]], re.DOTALL)[1]
        blocks = re.sub("<[^>]*>", "\0", re.sub("</?(?:b|i|a)>", "", article)).split("\0")
        want = " ".join(t for b in blocks if (t := " ".join(library.unescape(b).split())))
        assert r["text"] == want and r["n_chars"] == len(want)
    assert len(out) == len(source)


PAGE = """<html><body class="has-sidebar comments-open"><header><h1>Site</h1></header><div id="menu"><ul><li><a href=x>One two</a></li></ul></div>
<div class="cookie-notice">We use cookies on this site to make it better</div><div id="content"><h2>My &eacute; title</h2>
<p>First <b>p</b>ara with <a href=q>link words</a> in it &amp; more.</p><ul><li>item one</li><li>item two</li></ul><div class="adSlot">Buy now</div>
<p>Second follows<br>with break. <script>var x="<p>no</p>"</script><style>p{}</style></p><form><input name=a><label>Name it</label></form></div>
<aside>Related posts are here, many words</aside><div class="comments"><p>Reader says a long comment about this thing that is longer than the article itself is, or nearly so</p></div>
<footer>&copy; 2020 all rights</footer></body></html>"""


def test_page_without_an_article():
    assert html.extract(PAGE, html.Weights()) == "My é title First para with link words in it & more. item one item two Second follows with break."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<", "<"), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<!-- x", ""), ("<script>x", ""), ("<div class=ad>x", ""), ("a&nbsp;&lt;b&#62;", "a <b>"), ("<p title='>'>a", "a"), ("</div></p>x", "x")])
def test_broken_pages(page, text):
    assert html.extract(page, html.Weights()) == text


WORDS, MORE, ADS = " ".join(f"w{k}" for k in range(20)), " ".join(f"v{k}" for k in range(20)), "ad " * 400
WHOLE = [
    (f"<p>{WORDS}</p><div class='advert'>{ADS}</div><p>{MORE}</p>", f"{WORDS} {MORE}"),
    (f"<article><p>{WORDS}</p><aside>{ADS}</aside><p>{MORE}</p></article>", f"{WORDS} {MORE}"),
    (f"<div><p>{WORDS}</p><div class=comments>{ADS}</div><p>{MORE}</p></div>", f"{WORDS} {MORE}"),
    (f"<div class='share-price related-work'><p>{WORDS}</p></div>", WORDS),
    (f"<section class=page-promotion-history><p>{WORDS}</p></section>", WORDS),
    (f"<div class=content-sidebar-wrap><div><p>{WORDS}</p></div><div class='widget-area sidebar'>{MORE}</div></div>", WORDS),
    (f"<article><p>{WORDS}</p><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></article>", f"{WORDS} one two"),
    (f"<p>{WORDS}<script>if (a<b) x='</p>'</script> {MORE}</p>", f"{WORDS} {MORE}"),
    (f"<p data-class=ad data-id=footer>{WORDS}</p>", WORDS),
    (f"<nav><ul><li><a href=x>home</a></li></ul></nav><p>{WORDS}</p><div class=site-footer>{MORE}</div>", WORDS),
]


@pytest.mark.parametrize("learned", [False, True])
def test_whole_articles(sf, learned):
    found = {}
    if learned:
        for page in pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist():
            for key, (a, b) in (html.evidence(page) or {}).items():
                found[key] = (found.get(key, (0, 0))[0] + a, found.get(key, (0, 0))[1] + b)
    weights = html.Weights(found)
    for page, text in WHOLE:
        assert html.extract(page, weights) == text, page


def test_pages_without_their_articles(sf):
    """Weights learned from pages with an article find the same text where the mark is gone."""
    pages = pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist()
    found = {}
    for page in pages[: len(pages) // 2]:
        for key, (a, b) in (html.evidence(page) or {}).items():
            found[key] = (found.get(key, (0, 0))[0] + a, found.get(key, (0, 0))[1] + b)
    weights = html.Weights(found)
    assert weights.word("word p") > 1.5 > -1 > weights.word("word li in a link") and weights.tag("p") > weights.tag("li")
    for page in pages[len(pages) // 2 :]:
        assert html.extract(page, weights) == html.extract(page.replace("<article>", "<div>").replace("</article>", "</div>"), weights)


@pytest.mark.parametrize(("page", "text"), [
    (f"<div id=content><p>{WORDS}</p><p>{MORE}</p></div><div class=menu><article>{ADS}</article></div>", f"{WORDS} {MORE}"),
    (f"<div id=content><p>{WORDS}</p><p>{MORE}</p></div><article>one short teaser</article>", f"{WORDS} {MORE} one short teaser"),
    (f"<article><p>{WORDS}</p></article><nav>{ADS}</nav><article><p>{MORE}</p></article>", f"{WORDS} {MORE}"),
    (f"<main><p>{WORDS}</p><ul><li><a href=x>one</a></li></ul></main><footer>{ADS}</footer>", f"{WORDS} one"),
    ("<div>" * 2000 + f"<p>{WORDS}</p><div class=comments>{ADS}</div>" + "</div>" * 2000, WORDS),
])
def test_an_article_is_evidence_only(page, text):
    assert html.extract(page, html.Weights()) == text


def test_learned_weights_and_the_scan_decide():
    """Weights that take paragraphs for boilerplate and list items for text turn the result round."""
    page = f"<article><p>{WORDS}</p></article><ul><li>{MORE}</li></ul>"
    assert html.extract(page, html.Weights()).startswith(WORDS)
    wrong = html.Weights({"word p": (0, 9000), "word li": (9000, 0), "article": (0, 9000)})
    assert html.extract(page, wrong) == MORE


def test_learned_names_override_the_lists():
    page = "<article><div class=banner><p>" + "word " * 300 + "</p></div></article><div class=zone><p>" + "other " * 300 + "</p></div>"
    found = html.evidence(page)
    assert found[".banner"] == [0, 300]  # the label itself leaves out what the lists call boilerplate
    weights = html.Weights({".zone": (0, 5000), ".banner": (5000, 0)})
    assert html.extract("<div class=zone>a b</div><div class=banner>c d</div>", weights) == "c d"


@pytest.mark.parametrize("page", ["<div>w " * 150_000, '<a "x ' * 160_000, '<a b="x ' * 120_000, "<a b=\"> <a b='> " * 60_000, "<" * 1_000_000, "<script>" * 100_000, "<!--" * 250_000, "<b>" * 1000 + "</i>" * 200_000, "<b>" * 500 + "<p></p>" * 100_000, "<a " + "class='x class=\"y " * 60_000 + ">", "&amp" * 200_000])
def test_a_megabyte_of_odd_markup_takes_linear_time(page):
    began = time.process_time()
    html.extract(page, html.Weights())
    assert time.process_time() - began < 8  # the square would take minutes


def test_best_region_against_all_stretches():
    r = random.Random(6)
    for _ in range(300):
        s = [r.choice([-3, -1, 1, 2]) for _ in range(r.randrange(12))]
        a, b = html.best_region(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)])


def test_html_edge_cases(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x", 2)], "page_id long, url string, html string, text int")
    assert sorted(r["text"] for r in html.main_text(df).collect()) == ["", "", "x"]
    assert html.main_text(df.limit(0)).count() == 0


# pieces


def library_agrees(m, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text, (ids, back) in zip(texts, m.encode_texts(texts), strict=True):
        ids = [int(i) for i in ids.split(",")] if ids else []
        assert ids == sp.encode(text) and back == sp.decode(ids) == m.decode_ids(ids)[1:], repr(text)


def test_pieces_against_the_library():
    r = random.Random(7)
    parts = ["a", "e", "n", "the", "ing", " ", "  ", "▁", "▁▁", "\n", " \n", "é", "日", "𝔘", "\0", ".", "\t", "<s>", "<0x0A>", "1", "�", "́", "A", "tion", "  " * 9]
    library_agrees(pieces.model(PIECES), ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(6000)])


def test_pieces_of_the_documents(sf):
    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    library_agrees(pieces.PieceModel.load(PIECES), texts)


def test_pieces_memory_and_long_words(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    monkeypatch.setattr(pieces, "MOVES", 5)
    monkeypatch.setattr(pieces, "TOGETHER", 4)
    texts = ["one two three four five six one two", "ab" * 3000, "z" * 5000, " " * 100 + "x", "one two", "", "seven one", "é日é" * 50, "two é日é"]
    m = pieces.PieceModel.load(PIECES)
    for _ in range(2):
        library_agrees(m, texts)
    assert all(len(u) <= 64 for u in m.memory)


def test_pieces_refuse_other_models(tmp_path):
    whole = open(PIECES, "rb").read()
    field = lambda number, data: bytes([number << 3 | 2, len(data)]) + data
    for extra in (field(2, b"\x18\x01"), field(3, b"\x18\x00"), field(3, b"\x20\x01"), field(3, b"\x12\x01x"), field(1, b"\x0a\x01q\x18\x04")):
        (tmp_path / "m.model").write_bytes(whole + extra)  # later fields of a part replace earlier ones
        with pytest.raises(ValueError):
            pieces.PieceModel.load(str(tmp_path / "m.model"))


def test_piece_digest(spark):
    got = {(r["doc_id"], r["n_tokens"]) for r in pieces.piece_digest(odd(spark), PIECES).collect()}
    assert (2, 0) in got and (3, 0) in got
    back = pieces.decode_column(pieces.encode_column(odd(spark), PIECES), PIECES)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in odd(spark).collect())
    assert pieces.piece_digest(odd(spark).limit(0), PIECES).count() == 0


# packing


def check_packing(rows, texts, room):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= room
    assert sorted(by) == list(range(len(by)))


def test_packing_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs.repartition(3), byte_bpe_files()).collect()
    check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
    used = sum(r["length"] for r in rows)
    assert used / (2048 * (1 + max(r["sequence_id"] for r in rows))) > 0.95


def test_packing_edge_cases(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b", 1), (2, None, 1), (3, "", 1), (4, "word " * 300, 1)], "doc_id long, text string, start int")
    check_packing(packing.pack(df, byte_bpe_files(), 64).collect(), {r["doc_id"]: r["text"] for r in df.collect()}, 64)
    twice = packing.pack(df.union(df), byte_bpe_files(), 64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice) == 2 * packing.pack(df, byte_bpe_files(), 64).count()
    assert packing.pack(df.limit(0), byte_bpe_files()).count() == 0


def test_shortest_pack_first_uses_every_piece():
    r = random.Random(8)
    for _ in range(50):
        h = {r.randrange(1, 65): r.randrange(1, 50) for _ in range(r.randrange(1, 30))}
        patterns = packing.shortest_pack_first(h, 64)
        got = {}
        for p, n in patterns:
            assert sum(p) <= 64
            for x in p:
                got[x] = got.get(x, 0) + n
        assert got == h
        for n, (ranks, _, _) in packing.slots(patterns).items():
            assert ranks[0] == 0 and (np.diff(ranks) > 0).all() and n in h
    with pytest.raises(ValueError):
        packing.shortest_pack_first({65: 1}, 64)


# identifiers


def test_ids_of_any_type(spark, tmp_path):
    docs = spark.createDataFrame([("a", "some words password = abcdef12"), (None, None), ("b", "x " * 3000)], "doc_id string, text string")
    model, bpe = PIECES, byte_bpe_files()
    for found in (media.media_features(docs), secrets.secret_spans(docs), pieces.piece_digest(docs, model), pieces.encode_column(docs, model), packing.pack(docs, bpe, 2048)):
        assert found.schema["doc_id"].dataType.simpleString() == "string"
        assert {r["doc_id"] for r in found.collect()} == {"a", "b", None}
    assert {r["doc_id"] for r in pieces.decode_column(pieces.encode_column(docs, model), model).collect()} == {"a", "b", None}
    assert packing.pack(docs.limit(0), bpe, 2048).isEmpty()
