"""The learned operators, the added secret spans and the thumbnails against plain versions of one row at a time."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from factloom.llm import langid, media, quality, secrets

# languages


def plain_bucket(gram):
    a, b, c = gram
    h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
    h ^= h >> 15
    h = h * 0x2C1B3C6D & 0xFFFFFFFF
    return h >> 17


def plain_grams(text):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (" " + text + " ").encode()).replace(b"\n", b" ")
    return Counter(plain_bucket(data[i : i + 3]) for i in range(len(data) - 2))


def plain_languages(rows):
    """rows (doc_id, text, lang): for each its prediction and score."""
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and text is not None and lang is not None:
            counts[lang] += plain_grams(text)
    langs = sorted(counts)
    p = {g: [(counts[g][k] + 0.5) / (sum(counts[g].values()) + 0.5 * langid.BUCKETS) for k in range(langid.BUCKETS)] for g in langs}
    splits = [[s >> k & 1 for k in range(len(langs))] for s in range(1, 1 << (len(langs) - 1))]
    weight = []
    for bits in splits:
        one, two = ([p[g] for g, b in zip(langs, bits, strict=True) if b == side] for side in (1, 0))
        weight.append([math.log(sum(x) / len(one)) - math.log(sum(y) / len(two)) for x, y in zip(zip(*one, strict=True), zip(*two, strict=True), strict=True)])
    out = []
    for _, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        grams = plain_grams(text)
        margins = [sum(w[g] * n for g, n in grams.items()) / (sum(grams.values()) + 2) for w in weight]
        loss = []
        for k in range(len(langs)):
            loss.append(sum((0.5 + min(abs(m), 1.0)) * math.log1p(math.exp(-langid.SCALE * m * (1 if bits[k] else -1))) for m, bits in zip(margins, splits, strict=True)))
        share = [math.exp(min(loss) - x) for x in loss]
        best = max(range(len(langs)), key=lambda k: share[k])
        out.append((langs[best], share[best] / sum(share)))
    return out


def test_languages_against_plain(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet").select(["doc_id", "text", "lang"]).to_pydict()
    rows = list(zip(t["doc_id"], t["text"], t["lang"], strict=True)) + [(10_001, None, "en"), (10_002, "12 34 !", "de"), (10_003, "", None), (10_004, "the one and the other", None)]
    got = {r["doc_id"]: r for r in langid.held_out_identification(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for (i, text, _), (lang, score) in zip(rows, plain_languages(rows), strict=True):
        assert abs(got[i]["score"] - score) < 1e-4, (i, text)
        assert got[i]["lang_pred"] == lang and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_parts_of_a_long_text_give_the_same(spark, monkeypatch):
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 9, "en" if k % 2 else "de") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    whole = [tuple(r) for r in langid.identify(df, model).orderBy("doc_id").collect()]
    monkeypatch.setattr(langid, "PART", 7)
    for got, want in zip([tuple(r) for r in langid.identify(df, model).orderBy("doc_id").collect()], whole, strict=True):
        assert got[:2] == want[:2] and abs(got[2] - want[2]) < 1e-6


# quality


def plain_statistics(text):
    data = text.encode()
    words, size = data.split(), max(len(data), 1)
    n = max(len(words), 1)
    of = lambda keep: sum(1 for b in data if keep(b))
    letter = lambda b: 65 <= b < 91 or 97 <= b < 123 or b >= 128
    plain = lambda b: letter(b) or 48 <= b < 58 or b in b"\t\n\x0b\x0c\r " or b in b".,;:'\"()-?"
    lines = data.split(b"\n")
    return [
        math.log1p(len(words)), (size - of(lambda b: b in b"\t\n\x0b\x0c\r ")) / n, len(set(words)) / n**0.9, sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n,
        of(lambda b: 65 <= b < 91) / size, of(lambda b: not plain(b)) / size, of(lambda b: 48 <= b < 58) / size, sum(1 for w in words if w.istitle()) / n,
        (len(zlib.compress(data, 1)) if data else size) / size**0.95, 1 - len(set(lines)) / len(lines),
        sum(1 for w in words if w[-1] < 128 and not w[-1:].isalnum() and w[-1:] not in (b".", b",")) / n, sum(1 for w in words if len(w) > 14) / n,
        sum(1 for w in words if len(w) == 1 and w[0] < 128 and not w.isalnum()) / n,
    ]


def plain_log_odds(text, c):
    total = c.weights[-1]
    for k, x in enumerate(plain_statistics(text)):
        total += c.weights[k * (c.edges.shape[1] + 1) + bisect.bisect_right(c.edges[k].tolist(), x)]
    return total


def plain_scores(rows, c):
    """rows (host, path, text): host, path and quality scores, by the formulas of empirical Bayes; a row's means leave it out."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    odds = [plain_log_odds(t or "", c) for _, _, t in rows]

    def sums(key):
        out = defaultdict(lambda: [0, 0.0, 0.0])
        for r, x in zip(rows, odds, strict=True):
            s, p = out[key(r)], sigmoid(x)
            s[0], s[1], s[2] = s[0] + 1, s[1] + p, s[2] + p * (1 - p)
        return out

    def strength(groups, mean):
        some = {k: v for k, v in groups.items() if v[0] >= 2}
        if not some:
            return 10.0
        n = sum(v[0] for v in some.values())
        noise = sum(v[2] for v in some.values()) / n
        between = max((sum(v[0] * (v[1] / v[0] - mean(k)) ** 2 for k, v in some.items()) - len(some) * noise) / n, 0.0)
        return min(max(noise / between if between > 0 else 1e4, 1.0), 1e4)

    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    corpus = (sum(map(sigmoid, odds)) + 0.5) / (len(rows) + 1)
    a = strength(hosts, lambda _: corpus)
    b = strength(paths, lambda key: (hosts[key[0]][1] + a * corpus) / (hosts[key[0]][0] + a))
    logit = lambda x: math.log(x / (1 - x))
    out = []
    for (h, q, _), x in zip(rows, odds, strict=True):
        p = sigmoid(x)
        host = (hosts[h][1] - p + a * corpus) / (hosts[h][0] - 1 + a)
        path = (paths[h, q][1] - p + b * host) / (paths[h, q][0] - 1 + b)
        out.append((host, path, sigmoid(x + quality.SITE_WEIGHT * (logit(min(max(path, 1e-3), 1 - 1e-3)) - logit(corpus)))))
    return out


def test_quality_against_plain(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    c = quality.learn(docs.select("doc_id", "text"), labels)
    rows = docs.select("doc_id", "source", "lang", "text").orderBy("doc_id").collect()
    for r in rows[:60]:
        assert np.allclose(quality.statistics(r["text"] or ""), plain_statistics(r["text"] or ""), atol=0.02)
    want = plain_scores([(r["source"], f"{r['source']}/{r['lang']}", r["text"]) for r in rows], c)
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    for r, (host, path, score) in zip(rows, want, strict=True):
        x = got[r["doc_id"]]
        assert abs(x["host_score"] - host) < 1e-6 and abs(x["path_score"] - path) < 1e-6 and abs(x["quality_score"] - score) < 1e-6
        assert x["kept"] == (x["quality_score"] >= quality.THRESHOLD)


def test_the_fit_is_the_best_one():
    """The penalised likelihood has one maximum; there its slope is zero, and steps to all sides go down."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=400) > 0).astype(float)
    c = quality.fit(x, y)
    d = np.zeros((400, len(c.weights)))
    for row, values in enumerate(x):
        for k, v in enumerate(values):
            d[row, k * (c.edges.shape[1] + 1) + bisect.bisect_right(c.edges[k].tolist(), v)] = 1
        d[row, -1] = 1
    penalty = np.full(len(c.weights), quality.RIDGE)
    penalty[-1] = 1e-6

    def value(w):
        z = d @ w
        return (y * z - np.logaddexp(0, z)).sum() - 0.5 * (penalty * w * w).sum()

    p = 1 / (1 + np.exp(-d @ c.weights))
    assert np.abs(d.T @ (y - p) - penalty * c.weights).max() < 1e-3
    assert all(value(c.weights) >= value(c.weights + step) for step in rng.normal(size=(50, len(c.weights))) * 0.01)


# secrets


def plain_entropy(window):
    n = len(window)
    return -sum(k / n * math.log2(k / n) for k in Counter(window).values())


def plain_added(text):
    """The added spans of a text: each class's runs in what candidates have besides their allowed parts."""
    base, out = secrets.scan(text)[0], []
    kind = lambda c: "lower" if c in secrets._LOWER else "upper" if c in secrets._UPPER else "digit" if c in secrets._DIGIT else ""
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        free = set(range(m.start(), m.end()))
        for a in secrets.ALLOWED.finditer(m[0]):
            free -= set(range(m.start() + a.start(), m.start() + a.end()))
        for i in range(m.start(), m.end()):
            j = i + 1
            while j < m.end() and (ord(text[j]) == ord(text[j - 1]) + 1 or text[j - 1] + text[j] == "90"):
                j += 1
            if j - i >= secrets.ALPHABET:
                free -= set(range(i, j))
        part_end = lambda i: next(j for j in range(i, m.end() + 1) if j not in free)
        i = m.start()
        while i < m.end():
            if i not in free:
                i += 1
                continue
            end, own = part_end(i), []
            for c in secrets.CLASSES:
                for r in re.finditer("[" + re.escape(c.members) + "]{%d,}" % c.width, text[i:end]):
                    a, b, run = i + r.start(), i + r.end(), r[0]
                    if any(s <= a and b <= e for _, s, e in own):
                        continue
                    has = [any(ch in g for ch in run) for g in c.groups]
                    camel = len(re.findall("(?=[A-Z][A-Z])", run)) >= 2 and len(re.findall("[a-z][A-Z]", run)) >= 4
                    if not all(has) and not (c.kind == "entropy_base64" and all(has[1:]) and camel):
                        continue
                    for k in range(len(run) - c.width + 1):
                        w = run[k : k + c.width]
                        changes = sum(1 for x, y in zip(w, w[1:], strict=False) if kind(x) and kind(y) and kind(x) != kind(y))
                        bits = plain_entropy(w) + 1e-12
                        if bits >= c.sure or bits >= c.bits and changes >= c.changes:
                            stop = b
                            while c.kind == "entropy_base64" and stop < min(end, b + 2) and text[stop] == "=":
                                stop += 1
                            own.append((c.kind, a, stop))
                            break
            out += [s for s in own if not any(x <= s[1] and s[2] <= y for _, x, y in base)]
            i = end
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


def odd_texts(n):
    r = random.Random(11)
    sets = [secrets._LOWER, secrets._UPPER + secrets._DIGIT, "0123456789abcdef", "0123456789abcdefABCDEF", secrets._LOWER + secrets._DIGIT, secrets._LOWER + secrets._UPPER + secrets._DIGIT + "+/", "ab1"]
    fixed = ["abcdefghijkl", "0123456789", "example", "token=", "123e4567-e89b-12d3-a456-426614174000", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", " ", "é", "==", "-", "password: "]
    for _ in range(n):
        yield "".join(r.choice(fixed) if r.random() < 0.4 else "".join(r.choice(s) for _ in range(r.choice([5, 19, 20, 24, 40]))) if (s := r.choice(sets)) else "" for _ in range(r.randrange(1, 7)))


def test_added_spans_against_plain(sf):
    texts = [*odd_texts(1500), *(t or "" for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist())]
    found = 0
    for text in texts:
        base, spans = secrets.scan(text)
        added = [s for s in spans if s[0].startswith("entropy")]
        assert added == plain_added(text), text
        assert sorted(base) == sorted(s for s in spans if not s[0].startswith("entropy"))
        found += len(added)
    assert found > 300


# thumbnails


def plain_feature(text):
    data = (text or "").encode()
    data += bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    n = len(data) // 64
    w = next(k for k in range(1, n + 1) if k * k >= n)
    h = -(-n // w)
    pixel = [min(255, max(0, (data[64 * k] - 128 if k < n else -128) * PLAIN_DC // 8 + 128)) for k in range(w * h)]
    rows, cols = [int(i * h / 8) for i in range(8)], [int(i * w / 9) for i in range(9)]
    bits = ""
    for y, top in enumerate(rows):
        bottom = max(rows[y + 1] if y < 7 else h, top + 1)
        cells = []
        for x, left in enumerate(cols):
            right = max(cols[x + 1] if x < 8 else w, left + 1)
            cell = [pixel[j * w + i] for j in range(top, bottom) for i in range(left, right)]
            cells.append(sum(cell) // len(cell))
        bits += "".join("1" if b > a else "0" for a, b in zip(cells, cells[1:], strict=False))
    return f"{w * 8}x{h * 8}:{int(bits, 2):016x}"


PLAIN_DC = media.parse(media.encode([bytes(64)])[0])["quant"][0]


def test_features_against_plain(spark, sf):
    texts = [None, "", "a", "é" * 31, "x" * 64, "x" * 65, *(bytes(random.Random(k).randrange(1, 128) for _ in range(700 * k)).decode() for k in range(1, 8))]
    texts += pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_features(df).collect():
        text = texts[r["doc_id"]]
        assert r["feature"] == plain_feature(text), r["doc_id"]
        back = (text or "").encode()
        back += bytes(r["payload_bytes"] - len(back))
        assert r["payload_sha256"] == hashlib.sha256(back).hexdigest() and r["tail_crc32"] == zlib.crc32(back[-64:])


@pytest.mark.parametrize("cut", [4, 8, 12])
def test_a_frame_header_that_breaks_off(cut):
    whole = media.encode([bytes(64)])[0]
    at = whole.index(b"\xff\xc0")
    broken = whole[:at] + b"\xff\xc0" + (cut).to_bytes(2, "big") + whole[at + 4 : at + 2 + cut]
    with pytest.raises(media.JpegError):
        media.decode([broken])


def test_the_classifier_is_fitted_on_all_labels(spark):
    """More labelled rows than the 8,000 that a sample took before: the weights are those of one fit on all of them."""
    n = 9000
    texts = [" ".join(["word", "Other", "x;", "12"][(i * k) % (1 + i % 4)] for k in range(1 + i % 37)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int((i * 7919) % 11 < 3 + i % 4)) for i in range(n)], "doc_id long, quality int")
    got = quality.learn(docs, labels)
    want = quality.fit(np.array([quality.statistics(t) for t in texts], float), np.array([(i * 7919) % 11 < 3 + i % 4 for i in range(n)], float))
    assert np.allclose(got.edges, want.edges, atol=1e-9) and np.allclose(got.weights, want.weights, atol=1e-4)
