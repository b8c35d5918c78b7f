"""Url cascades, language, shards and pseudonyms."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import feistel, langid, queries, slots, url_cascade

# Url cascades


def judged(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}"):
            fits.append((-len(rule), -len(h), rule, verdict))
    return (host, path, *(min(fits)[2:] if fits else (None, otherwise)))


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://EXAMPLE.Org/EN/1", "https://example.org/en/12?x#y", "http://a.b.example.org/es/", "http://example.org", "http://org/", "http://notexample.org/en/1", "http://com/fr/x", "http://x.com/fr", "http://x.com?q=/fr/", "http://x.com#/fr/", "http://x.com/de/a://b/c", "ftp://é.org/ü", "http://x.net/en/1", "http://.org/", "http://a..com/de/", "http://ÄB.com/fr/", "http://x.com/fr/\nnext"]


@pytest.mark.parametrize("rules", [queries.URL_RULES, [], [("a.com/x", "block"), ("com/xyz", "allow"), ("com/x", "allow")]])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(k, u, "mine", "h") for k, u in enumerate([*URLS, "http://a.com/xyz", *URLS])], "page_id long, url string, rule string, html string")
    got = url_cascade.judge_urls(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {k: judged(u, rules) for k, u in enumerate([*URLS, "http://a.com/xyz", *URLS])}
    assert got[0].html == "h"


def test_long_urls_and_lists_in_parts(spark, monkeypatch):
    """A host of a million characters costs no more than its shapes; a list cut into parts judges alike."""
    rules = [(f"h{k}.example{'.org' * (k % 3)}{'/' + 'p' * (k % 4) if k % 2 else ''}", ["allow", "block", "later"][k % 3]) for k in range(60)] + [("org/", "block")]
    urls = [f"http://{'x.' * (k % 3)}h{k}.example{'.org' * (k % 3)}/{'p' * (k % 5)}" for k in range(70)] + [f"http://{'a.' * 500_000}h3.example/ppp", "http://" + "." * 60_000 + "org/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([(r if "/" in r else f"{r}/", v) for r, v in rules], "rule string, verdict string")
    expected = {k: judged(u, [(r if "/" in r else f"{r}/", v) for r, v in rules]) for k, u in enumerate(urls)}
    for most in (2**28, 64):
        monkeypatch.setattr(url_cascade, "MOST_BITS", most)
        got = url_cascade.judge_urls(pages, listed).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == expected
    assert url_cascade.parts_needed(60, 10**6) > 1


def test_cascade_is_exact(spark):
    keys = spark.range(6000).select(*(c.alias(n) for c, n in zip(url_cascade.hashes(F.col("id").cast("string")), ("h1", "h2"), strict=True)), "id")
    listed = keys.filter("id % 7 = 0")
    cascade = url_cascade.build_cascade(listed.select("h1", "h2"), keys.select("h1", "h2"))
    assert len(cascade.levels) > 2
    rows = keys.toPandas()
    assert (cascade.has(rows.h1.to_numpy(), rows.h2.to_numpy()) == (rows.id % 7 == 0).to_numpy()).all()


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_cascade.judge_urls(pages, spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")).count() == 0


# Language


def test_held_out_accuracy(spark, sf):
    got = queries.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in own) > 0.97 * len(own)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) == 0


def grams(text):
    """Counts of hashed n-grams in plain Python: letters in lower case, other runs one blank, one at either end."""
    seq = [0]
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        x = ord(low) if c.isalpha() else 0
        if x or seq[-1]:
            seq.append(x)
    if seq[-1]:
        seq.append(0)
    out = {}
    for k in (2, 3):
        for i in range(len(seq) - k + 1):
            h = k
            for x in seq[i : i + k]:
                h = ((h ^ x) * 0x9E3779B97F4A7C15) % 2**64
                h ^= h >> 29
            out[(h >> 20) % langid.DIMENSIONS] = out.get((h >> 20) % langid.DIMENSIONS, 0) + 1
    return out


def test_scores_against_plain_python(spark, sf):
    """Document frequencies over all texts, weights, cosines, choice and floor, computed one by one."""
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows += [(-1, "αβγ Αθήνα", "el", "s", 1), (-2, "123", "en", "s", 1), (-3, None, "en", "s", 1), (-4, "no label here", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs, per_language=20, clusters=2)
    learned = [grams(r[1]) for r in rows if r[1] and r[2] and any(c.isalpha() for c in r[1])]
    df = {}
    for g in learned:
        for k in g:
            df[k] = df.get(k, 0) + 1
    idf = [np.log((1 + len(learned)) / (1 + df.get(k, 0))) + 1 for k in range(langid.DIMENSIONS)]
    assert np.allclose(model.idf, idf)
    assert np.allclose((model.centroids**2).sum(axis=1), 1, atol=1e-5) and set(model.langs) == {r[2] for r in rows if r[2]}
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    near = []
    for r in rows:
        if not r[1] or not any(c.isalpha() for c in r[1]):
            continue
        g = grams(r[1])
        w = {k: np.log1p(n) * idf[k] for k, n in g.items()}
        norm = np.sqrt(sum(x * x for x in w.values()))
        cosine = [sum(x * c[k] for k, x in w.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosine))
        if r[2]:
            near.append(max(c for c, owner in zip(cosine, model.lang_of, strict=True) if model.langs[owner] == r[2]))
        assert got[r[0]].lang_pred == model.langs[model.lang_of[best]] and got[r[0]].lang_score == pytest.approx(min(max(cosine[best], 0), 1))
        assert got[r[0]].lang_rejected == (cosine[best] < model.floor)
    assert model.floor == pytest.approx(langid.FLOOR * min(near), abs=1 / langid.BINS)


def test_many_labels_and_ties(spark):
    texts = [(f"l{k:02d}", f"{'abcdefghij'[k % 10] * 3} {'klmnopqrst'[k // 10] * 4} w{chr(97 + k % 26)} {chr(97 + j)}") for k in range(40) for j in range(6)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.langs) == 40
    got = langid.identify(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) == len(texts)
    few = langid.train(docs, most_languages=3)
    assert few.langs == ["l00", "l01", "l02"]
    same = spark.createDataFrame([(1, "one text", "x"), (2, "one text", "b"), (3, "one text", "a")], "doc_id long, text string, lang string")
    clash = same.selectExpr("doc_id", "text", "'k' as lang_score", "'k' as lang_rejected", "1 as order", "2 as lang")
    assert {(r.lang_pred, r.lang) for r in langid.identify(clash, langid.train(same)).collect()} == {("a", 2)}


def test_odd_texts_and_no_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, per_language=30)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "12 !? \n", 5), (4, "中文字符 日本語のテキスト" * 9, 5), (5, "The and of in " * 9000, 5), (None, "the of", 5)], "doc_id long, text string, lang_pred int")
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [(got[i].lang_pred, got[i].lang_score, got[i].lang_rejected) for i in (1, 2, 3)] == [("und", 0.0, True)] * 3
    assert got[4].lang_rejected and got[5].lang_pred == "en" and not got[5].lang_rejected and len(got) == 6
    none = langid.train(docs.filter("lang is null"))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_prediction_does_not_depend_on_neighbours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"), per_language=30)
    a = {r.doc_id: (r.lang_pred, round(r.lang_score, 9)) for r in langid.identify(docs, model).collect()}
    b = {r.doc_id: (r.lang_pred, round(r.lang_score, 9)) for r in langid.identify(docs.repartition(7, "doc_id"), model).collect()}
    assert a == b


# Shards


def test_shards(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no id"), (-1, None), (-2, ""), (-3, "é" * 500), (-3, "é" * 500)], "doc_id long, text string")
    docs = table.union(odd)
    placed, mapped = slots.shard_documents(docs, 8)
    got = placed.collect()
    rows = docs.collect()
    sizes = [len((r.text or "").encode()) + 1 for r in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, s, zlib.crc32((r.text or "").encode())) for r, s in zip(rows, sizes, strict=True))
    load = np.bincount([r.shard for r in got], [r["size"] for r in got], 8)
    assert load.max() - load.min() <= max(sizes) and all(mapped.shard_of[r.vslot] == r.shard for r in got)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert slots.shard_documents(odd.limit(0), 8)[0].count() == 0


def test_a_large_group_is_split_and_a_small_one_is_not(spark):
    rows = [(i, "same text") for i in range(300)] + [(1000 + i, f"text {i // 3}") for i in range(600)]
    got = slots.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8)[0].join(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id").collect()
    shards_of = {}
    for r in got:
        shards_of.setdefault(r.t, set()).add(r.shard)
    assert len(shards_of.pop("same text")) == 8 and all(len(s) == 1 for s in shards_of.values())
    load = np.bincount([r.shard for r in got], [r["size"] for r in got], 8)
    assert load.max() <= 1.05 * load.mean()


def test_placement_against_plain_python(spark):
    """Slots' bytes, the map and each row's shard, added up and dealt one by one; a group of just under a shard stays whole."""
    rows = [(i if i % 9 else None, "copy " * 20) for i in range(110)] + [(1000 + i, f"text number {i} " * (1 + i % 13)) for i in range(900)] + [(5, None), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, shard string, vslot int, row int")
    placed, mapped = slots.shard_documents(docs, 8, slots=64)
    got = placed.collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    size_of, load, shard_of = {}, [0] * 8, {}
    for r in got:
        size_of[r.vslot] = size_of.get(r.vslot, 0) + r["size"]
    for v in sorted(range(64), key=lambda v: (-size_of.get(v, 0), v)):
        shard_of[v] = load.index(min(load))
        load[shard_of[v]] += size_of.get(v, 0)
    assert all(r.shard == shard_of[r.vslot] for r in got) and mapped.shard_of == tuple(shard_of[v] for v in range(64))
    for k in range(8):
        assert [r.slot for r in sorted((r for r in got if r.shard == k), key=lambda r: r.slot)] == list(range(sum(r.shard == k for r in got)))
        own = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
        assert [r.vslot for r in own] == sorted(r.vslot for r in own)
    by_text = {}
    for r in got:
        by_text.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for x in by_text.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.lists(st.integers(0, 1000), min_size=60, max_size=60), st.integers(1, 6), st.integers(1, 7))
def test_maps(sizes, later, shards, more):
    first = slots.assign(sizes, shards)
    load = np.bincount(first.shard_of, sizes, shards)
    assert load.max() - load.min() <= max(sizes)
    new = slots.rebalance(first, later[: len(sizes)], more)
    load = np.bincount(new.shard_of, later[: len(sizes)], more)
    assert new.version == 2 and new.shards == more and set(new.shard_of) <= set(range(more))
    assert load.max() <= 1.02 * load.mean() or load.max() - load.min() <= max(later[: len(sizes)])


def test_map_versions(tmp_path):
    first = slots.assign([3, 2, 1], 2)
    folder = str(tmp_path / "map")
    first.save(folder)
    second = slots.rebalance(first, [3, 2, 1], 3)
    second.save(folder)
    assert slots.SlotMap.load(folder) == second and slots.SlotMap.load(folder, 1) == first


# Pseudonyms

KEY = b"k"
MADE, UNDONE = feistel.Pseudonyms(KEY), feistel.Pseudonyms(KEY, back=True)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**18), st.data())
def test_permutation_inverts(n, data):
    x = data.draw(st.integers(0, n - 1))
    y = feistel.permute(n, x, KEY, "t")
    assert 0 <= y < n and feistel.permute(n, y, KEY, "t", back=True) == x


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 256, 1000])
def test_permutation_is_one(n):
    assert sorted(feistel.permute(n, x, KEY, "t") for x in range(n)) == list(range(n))


VALUES = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "ssn": ["078-05-1120", "899-99-9999"],
    "phone": ["+1 (017) 555-7713", "+49 30 1234567", "+12025550123"],
    "ip": ["97.51.17.173", "1.2.3.4", "255.255.255.255"],
    "date": ["1987-02-28", "2024/02/29", "31.12.1999", "12/31/1999", "01/02/2003"],
    "email": ["Jane.Doe_7@mail7.example.com", "a@b.co"],
    "secret": ["b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"],
}
LEFT = ["4111111111111112", "DE89370400440532013001", "000-05-1120", "666-11-1111", "078-00-1120", "256.1.1.1", "1.2.3.4.5", "01.2.3.4", "2023-02-30", "32.13.1999", "1899-01-01", "version 1.2.3", "@", "a@b", "x @y.com", "12345678901234567890123456789012", "deadbeefdeadbeefdeadbeefdeadbeef00000000x", "+1", "0000000000000000", "3.14", "12-34"]


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_values_keep_their_format(kind, value):
    for before, after in (("", ""), ("see ", "!"), ("é(", ")"), ("x\n", ".")):
        text, n = MADE.text(before + value + after)
        assert n == {kind: 1} and text.startswith(before) and text.endswith(after)
        new = text[len(before) : len(text) - len(after)]
        shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
        if kind == "secret":
            assert len(new) == len(value) and re.fullmatch(r"[0-9a-fA-F]+", new)
        elif kind != "iban":
            assert shape(new) == shape(value)
        assert new != value and UNDONE.text(text)[0] == before + value + after
    assert MADE.text(value)[0] == feistel.Pseudonyms(KEY).text(value)[0] != feistel.Pseudonyms(b"other").text(value)[0]


@pytest.mark.parametrize("text", LEFT)
def test_what_fails_validation_stays(text):
    assert MADE.text(text) == (text, {})


BESIDE = [
    ["+1 (826) 555-4081", "190.137.223.204"],
    ["+1 (017) 555-7713", "97.51.17.173"],
    ["+1 017 555 7713", "97.51.17.173"],
    ["+49 30 1234567", "97.51.17.173"],
    ["+49 30 1234567", "2024-02-29"],
    ["+49 30 1234567", "4111 1111 1111 1111"],
    ["+1 (017) 555-7713", "4111 1111 1111 1111"],
    ["+1 (017) 555-7713", "078-05-1120", "31.12.1999"],
    ["4111 1111 1111 1111", "97.51.17.173"],
    ["4111 1111 1111 1111", "2024-02-29"],
    ["3782-822463-10005", "078-05-1120"],
    ["BE68 5390 0754 7034", "2024-02-29"],
    ["ES91 2100 0418 4502 0005 1332", "4111 1111 1111 1111"],
]


@pytest.mark.parametrize("values", BESIDE)
def test_values_beside_other_values(values):
    text = f"at {' '.join(values)} end"
    new, n = MADE.text(text)
    assert new == f"at {' '.join(MADE.text(v)[0] for v in values)} end" and sum(n.values()) == len(values)
    assert UNDONE.text(new)[0] == text and all(MADE.text(v)[0] != v for v in values)


@pytest.mark.parametrize("value", ["+1 (017) 555-7713", "+49 (030) 555-7713", "4111 1111 1111 1111", "4111111111111111", "3782-822463-10005", "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332"])
@pytest.mark.parametrize("number", [*(f"{n:02d}" for n in range(0, 100, 7)), "123", "2024", "12 34"])
def test_values_beside_numbers(value, number):
    for before, after in (("", f" {number} items"), ("no 7 ", f" {number}"), ("no 7 ", "")):
        new, n = MADE.text(before + value + after)
        assert new == before + MADE.text(value)[0] + after and sum(n.values()) == 1
        assert UNDONE.text(new)[0] == before + value + after


def test_a_card_of_nineteen_digits_is_undone():
    r, seen = random.Random(2), 0
    for _ in range(300):
        body = "".join(r.choice("0123456789") for _ in range(18))
        d = body + str(-feistel.luhn(body + "0") % 10)
        text = " ".join([d[:4], d[4:8], d[8:12], d[12:16], d[16:]])
        new, _ = MADE.text(text)
        seen += new[-3:] != text[-3:]
        assert UNDONE.text(new)[0] == text
    assert seen > 200


def test_sums_stay_valid():
    r = random.Random(1)
    for _ in range(200):
        body = "".join(r.choice("0123456789") for _ in range(15))
        card = body + str(-feistel.luhn(body + "0") % 10)
        assert feistel.luhn(MADE.text(card)[0]) == 0
        bban = "".join(r.choice("0123456789") for _ in range(18))
        iban = f"DE{98 - feistel._mod97('DE00' + bban):02d}{bban}"
        assert feistel._mod97(MADE.text(iban)[0]) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([v for vs in VALUES.values() for v in vs] + LEFT), st.text(alphabet="a1@.-+ ()é\n", max_size=12)), max_size=6))
def test_any_text_is_left_in_order(parts):
    text = " ".join(parts)
    new, n = MADE.text(text)
    spans = MADE.spans(text)
    assert sum(n.values()) <= len(spans) and (new == text or n)


def test_pseudonyms_operator(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "mail a.b@c.org or 1.2.3.4", 3), (None, "again 1.2.3.4", 3), (5, "w " * 50000 + "1.2.3.4", 3)], "doc_id long, text string, pii int")
    got = {r.doc_id: r for r in feistel.pseudonymise(docs, KEY).collect()}
    new = MADE.text("1.2.3.4")[0]
    assert got[1].text is None and got[2].text == "" and got[1].pii == {} and got[3].pii == {"email": 1, "ip": 1}
    assert all(got[i].text.endswith(new) for i in (3, None, 5))
    assert {r.doc_id: r.text for r in feistel.pseudonymise(feistel.pseudonymise(docs, KEY), KEY, back=True).collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert feistel.pseudonymise(docs.limit(0), KEY).count() == 0


def test_long_names_and_phones_in_any_grouping():
    made, back = feistel.Pseudonyms(b"k"), feistel.Pseudonyms(b"k", back=True)
    for name in ("a" * 70, "ab.C1" * 40, "x" * 64, "." + "y" * 65):
        text = f"write {name}@example.com now"
        new, n = made.text(text)
        own = new[6 : 6 + len(name)]
        assert n == {"email": 1} and all(a != b for a, b in zip(re.findall(r"[A-Za-z0-9]{30,}", own), re.findall(r"[A-Za-z0-9]{30,}", name), strict=True)) and own != name
        assert back.text(new)[0] == text
    same = ["+49 1512 3456789", "+4915123456789", "+49-1512-3456789", "+49 (1512) 345 6789"]
    assert len({re.sub(r"\D", "", made.text(f"call {p} today")[0]) for p in same}) == 1
    for p in [*same, "+1 826 555 4081", "+18265554081", "+351 912 345 678", "+351912345678", "+7 912 345 67 89"]:
        new, n = made.text(f"call {p} today")
        assert n == {"phone": 1} and back.text(new)[0] == f"call {p} today"
        code = next(c for c in ("49", "351", "1", "7") if re.sub(r"\D", "", p).startswith(c))
        assert re.sub(r"\D", "", new).startswith(code) and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"call {p} today")


def test_spans_are_those_planted():
    """Values written at known places among words, short numbers and punctuation are found there, and nothing else."""
    r = random.Random(5)

    def card():
        d = "".join(r.choice("123456789") for _ in range(15))
        return next(d + c for c in "0123456789" if sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d + c))) % 10 == 0)

    def iban():
        body = "".join(r.choice("0123456789") for _ in range(18))
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    kinds = {
        "email": lambda: f"{r.choice(['ann', 'bo.b', 'x_1+y'])}@{r.choice(['mail.example', 'a-b.org'])}",
        "card": lambda: re.sub(r"(\d{4})(?=\d)", r.choice(["\\1", "\\1 ", "\\1-"]), card()),
        "iban": iban,
        "ssn": lambda: f"{r.randrange(1, 600):03d}-{r.randrange(1, 99):02d}-{r.randrange(1, 9999):04d}",
        "phone": lambda: f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}",
        "ip": lambda: ".".join(str(r.randrange(1, 256)) for _ in range(4)),
        "date": lambda: f"{r.randrange(1950, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}",
        "secret": lambda: "a1" + "".join(r.choice("0123456789abcdef") for _ in range(38)),
    }
    fillers = ["the", "and,", "12", "Nr.", "7.5", "(x)", "é", "a@b", "2024", "12/3", "v1.2.3", "--", "\n", "@", "+5", "ABC"]
    made = feistel.Pseudonyms(b"k")
    for _ in range(400):
        text, planted = "", []
        for _ in range(r.randrange(1, 7)):
            text += " ".join(r.choices(fillers, k=r.randrange(0, 4))) + r.choice([" see ", " (", ": ", " to,"])
            kind = r.choice(list(kinds))
            value = kinds[kind]()
            planted.append((len(text), len(text) + len(value), kind))
            text += value + r.choice([" ok ", ". So ", ", ", ")"])
        assert [x[:3] for x in made.spans(text)] == planted, text
