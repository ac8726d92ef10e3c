"""Fingerprints, packing, language ID, quality, archives, pages, personal data and decontamination."""

import base64
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joinlens.llm import decontaminate, langid, lzprint, packing, pii, quality, warc, wrapper

# Fingerprints


def test_edited_texts_and_neighbours(make):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(0, 300))) for _ in range(30)] + ["", None, "abc", "abcd"]
    ids = random.Random(3).sample(range(1000), len(texts))
    out = {r["doc_id"]: r for r in lzprint.compare_with_next(make(list(zip(ids, texts)))).collect()}
    order = sorted(zip(ids, texts))
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = out[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == lzprint.written(lzprint.fingerprint(text))
        assert r["edited_fingerprint"] == lzprint.written(lzprint.fingerprint(edited))
        assert r["near_edited"] == lzprint.likeness(lzprint.fingerprint(text), lzprint.fingerprint(edited))
        assert r["near_next"] == lzprint.likeness(lzprint.fingerprint(text), lzprint.fingerprint(after))


@given(st.text(max_size=200))
@settings(max_examples=50, deadline=None)
def test_phrases_cover_the_text_once(text):
    ends, trie, node = lzprint.parse(text)
    parts = [text[a:b] for a, b in zip([0, *ends], ends)]
    left = text[ends[-1] if ends else 0 :]
    assert len(set(parts)) == len(parts) == len(trie) and all(p[:-1] in {"", *parts} for p in parts)
    assert (left in parts) == bool(node) and (not left or node)
    plain, phrase = [], ""  # the parse by its definition
    for c in text:
        phrase += c
        if phrase not in plain:
            plain.append(phrase)
            phrase = ""
    assert parts == plain and left == phrase


def test_rows_without_an_id_are_dealt_too(make, spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdef ", k=40)) for _ in range(300)]
    rows = [(None, t) for t in texts[:200]] + [(7, t) for t in texts[200:220]] + [(100 + i, t) for i, t in enumerate(texts[220:])]
    out = lzprint.compare_with_next(make(rows).repartition(5))
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    expected = sorted((r[0] or -1, lzprint.written(lzprint.fingerprint(r[1])), lzprint.likeness(lzprint.fingerprint(r[1]), lzprint.fingerprint(n[1]))) for r, n in zip(order, order[1:] + order[:1]))
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["near_next"]) for r in out.collect()) == expected


def test_repetitive_and_long_texts_take_seconds(make):
    began = time.perf_counter()
    r = lzprint.compare_with_next(make([(1, "a" * 3_000_000), (2, "ab" * 1_000_000), (3, None)])).collect()
    assert len(r) == 3 and time.perf_counter() - began < 60


def test_one_and_no_document_has_a_successor(make):
    r = lzprint.compare_with_next(make([(4, "abcdefgh" * 5)])).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0
    assert lzprint.compare_with_next(make([]).limit(0)).count() == 0
    rows = make([(1, "same"), (1, "same"), (None, "x"), (2, "y")]).selectExpr("*", "1 as k", "2 as bucket", "3 as h")
    assert lzprint.compare_with_next(rows).count() == 4


# Packing


def test_rank_ids_equal_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["", "Hello  world's don't\n\n x", "naïve Ünïcödé ßtraße 123,456!!", "\x00\x1f​日本語 🙂", "<|endoftext|> a", "a" * 3000] + ["".join(chr(rng.choice([32, 10, 97, 101, 233, 48, 39, 46, 0x4E00, 0x1F600])) for _ in range(200)) for _ in range(50)]
    for text in texts:
        assert packing.encoder(packing.default_vocabulary()).encode(text, allowed_special="all") == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text_are_the_tokenizers(make):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"x  {end}\n\n y's{end}", f"é{end}  ", "<|endoftext", f"<|endof{end}text|>", f"<{end}>", "plain  text ", "", f"\x00\r\n {end} 日本 🙂"]
    rng = random.Random(5)
    texts += ["".join(rng.choice([end, " ", "  ", "\n", "ab", "é", "'s", "12", "<|"]) for _ in range(60)) for _ in range(50)]
    out = {r["doc_id"]: r for r in packing.cut(make(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert (out[i]["doc_tokens"], out[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_best_fit_decreasing_equals_the_plain_form(histogram):
    runs, used = packing.place(histogram, 32)
    room = []  # plain best-fit decreasing
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in room if r >= length]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - length)
            else:
                room.append(32 - length)
    assert used == len(room)
    filled = {}
    for length, rank, n, first, offset in runs:
        for s in range(first, first + n):
            filled.setdefault(s, []).append((offset, length))
    assert len(filled) == used and sum(n for _, _, n, _, _ in runs) == sum(histogram.values())
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    assert sorted(32 - sum(length for _, length in p) for p in filled.values()) == sorted(room)


def test_every_id_lies_in_one_piece(make):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "x9", "é"]) for _ in range(rng.choice([0, 1, 5, 40, 700]))) for i in range(60)} | {60: None}
    rows = packing.pack(make(list(texts.items()))).collect()
    encode = packing.encoder(packing.default_vocabulary()).encode_ordinary
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts.items():
        ids, at = [*encode(text or ""), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(make([]).limit(0)).count() == 0


# Language ID


def test_languages_apart(make, spark):
    en, fr = "the quick brown fox and the lazy dog that was there ", "le renard brun et le chien paresseux qui était là "
    rng = random.Random(6)
    text = lambda base: " ".join(rng.sample(base.split(), 7))
    train = make([(i, text(en)) for i in range(60)]).unionByName(make([(100 + i, text(fr)) for i in range(60)], lang="fr"))
    model = langid.fit(train)
    rows = make([(1, text(en)), (2, text(fr)), (3, None), (4, ""), (5, "12 34 !!"), (6, "Привет мир как дела")])
    out = {r["doc_id"]: r for r in langid.predict(rows, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    assert [out[i]["rejected"] for i in (1, 2, 3, 4, 5, 6)] == [False, False, True, True, True, True]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert sorted(r["doc_id"] for r in langid.accepted(rows, model).collect()) == [1, 2]


def test_rejection_at_every_length(make, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null")
    model = langid.fit(docs.where(~langid.held_out()))
    rng = random.Random(9)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności bez względu na różnice rasy, koloru, płci, języka i wyznania. "
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    junk = [polish, polish * 40, finnish, finnish * 60]
    for n in (300, 3000, 30_000):
        junk += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), base64.b64encode(rng.randbytes(n)).decode(), "".join(chr(rng.randrange(0x4E00, 0x6000)) for _ in range(n))]
    assert langid.accepted(make(list(enumerate(junk))), model).count() == 0
    assert all(r["rejected"] for r in langid.predict(make(list(enumerate(junk))), model).collect())
    texts = [(r["text"], r["lang"]) for r in docs.where(langid.held_out()).collect()]
    for lang in sorted({name for _, name in texts}):
        own = [t for t, name in texts if name == lang]
        cuts = [t[:n] for t in own for n in (60, 200, 1000) if len(t) >= n] + own + [" ".join(own)]
        assert langid.accepted(make(list(enumerate(cuts))), model).count() >= 0.98 * len(cuts)


def test_every_language_is_learned(make, spark):
    """More languages than fit a list of the commonest; each has two words of its own."""
    rng = random.Random(15)
    words = {f"l{i}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(2)] for i in range(300)}
    rows = [(k * 400 + i, " ".join(rng.choices(words[f"l{i}"], k=12)), f"l{i}") for i in range(300) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as count", "2 as counts")
    model = langid.fit(docs)
    assert len(model.languages) == 300
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() == 600


def test_centroids_equal_the_plain_form(make, spark):
    """Predictions against an arrangement of the same steps with dictionaries."""
    rng = random.Random(16)
    base = {"en": "the quick brown fox and lazy dogs there were", "fr": "le renard brun et les chiens paresseux étaient", "de": "der schnelle braune Fuchs und die faulen Hunde"}
    train = [(i, " ".join(rng.choices(base[lang].split(), k=9)), lang) for i, lang in enumerate(list(base) * 20)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.fit(docs, centroids=1)

    def vector(text, idf):
        data = bytes(langid._FOLD[np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)])
        counts = {}
        for i in range(len(data) - 2):
            if data[i : i + 3] != b"   ":
                h = (int.from_bytes(data[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 20
                counts[h] = counts.get(h, 0) + 1
        v = {h: n**0.5 * idf.get(h, 0) for h, n in counts.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {h: x / norm for h, x in v.items()}

    n = len(train)
    one = {}
    for _, text, _ in train:
        for h in vector(text, {h: 1 for h in range(langid.BINS)}):
            one[h] = one.get(h, 0) + 1
    idf = {h: np.log((1 + n) / (1 + one.get(h, 0))) + 1 for h in range(langid.BINS)}
    centre = {}
    for lang in base:
        own = [vector(t, idf) for _, t, name in train if name == lang]
        mean = {h: sum(v.get(h, 0) for v in own) for h in set().union(*own)}
        norm = sum(x * x for x in mean.values()) ** 0.5
        centre[lang] = {h: x / norm for h, x in mean.items()}
    texts = [(i, " ".join(rng.choices(" ".join(base.values()).split(), k=6))) for i in range(60)]
    out = {r["doc_id"]: r for r in langid.predict(make(texts), model).collect()}
    for i, t in texts:
        v = vector(t, idf)
        cosine = {lang: sum(x * c.get(h, 0) for h, x in v.items()) for lang, c in centre.items()}
        best = max(cosine, key=cosine.get)
        assert out[i]["lang_pred"] == best and abs(out[i]["score"] - cosine[best]) < 1e-4


def test_very_long_texts_have_a_language(make, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    english = " ".join(r["text"] for r in docs.where("lang = 'en' and text is not null").limit(20).collect())
    out = langid.predict(make([(1, (english + " ") * (3_000_000 // len(english)))]), model).first()
    assert out["lang_pred"] == "en" and not out["rejected"]


def test_nothing_to_learn_from(make):
    rows = make([(1, "some text"), (2, None)], lang=None)
    model = langid.fit(rows)
    assert [r["lang_pred"] for r in langid.predict(rows, model).collect()] == ["und", "und"]
    assert langid.accepted(rows, model).count() == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.op9_language_id(spark, "/root/testdata/sf0.001").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count() > 0


# Quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classify(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([(r["p_quality"] >= 0.5) == bool(r["quality"]) for r in out]) >= 0.95


def test_without_labels_all_is_kept(make, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = make([(1, "a text"), (2, None), (None, "x"), (1, "a text")])
    out = quality.classify(rows, labels).collect()
    assert len(out) == 4 and all(r["kept"] for r in out)
    assert quality.classify(make([]).limit(0), labels).count() == 0


def test_sparse_groups_shrink(spark):
    rows = [(i, "big", "p", 2.0 if i % 2 else -2.0, -3.0) for i in range(200)] + [(1000, "tiny", "p", 4.0, -3.0)] + [(2000 + i, "bad", "p", -4.0, -3.0) for i in range(100)]
    out = {r["doc_id"]: r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, quality double, toxic double")).collect()}
    assert out[2000]["p_quality"] < 1 / (1 + np.exp(4)) + 1e-9  # a bad host's documents are judged lower
    assert abs(out[1000]["p_quality"] - 1 / (1 + np.exp(-4))) < 0.03


def test_posteriors_equal_the_plain_form(spark):
    """Shrinkage of paths to hosts and hosts to the whole, with numpy; nulls are groups of their own."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        h, p = rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y", None])
        base = {"a": 2.0, "b": -1.0, "c": 0.5, "d": -3.0, None: 0.0}[h]
        rows.append((i, h, p, float(base + rng.normal()), float(-base + rng.normal())))
    out = {r["doc_id"]: r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, quality double, toxic double").repartition(5)).collect()}
    sigmoid, logit = lambda x: 1 / (1 + np.exp(-x)), lambda p: np.log(p / (1 - p))
    for k, t in enumerate(quality.TARGETS):
        q = np.array([sigmoid(r[3 + k]) for r in rows])
        hosts, paths = [r[1] for r in rows], [(r[1], r[2]) for r in rows]
        prior = q.mean()

        def strength(groups, above):
            n = {g: groups.count(g) for g in set(groups)}
            mean = {g: q[[x == g for x in groups]].mean() for g in n}
            spread = sum(n[g] * (mean[g] - above[g]) ** 2 for g in n)
            level = np.mean([above[g] for g in n])
            noise = level * (1 - level)
            between = max(0.0, (spread - len(n) * noise) / sum(n.values()))
            return np.clip(noise / between - 1, 1.0, 1e6) if between > 0 else 1e6

        a = strength(hosts, dict.fromkeys(set(hosts), prior))
        at_host = {h: (q[[x == h for x in hosts]].sum() + a * prior) / (hosts.count(h) + a) for h in set(hosts)}
        b = strength(paths, {g: at_host[g[0]] for g in set(paths)})
        at_path = {g: (q[[x == g for x in paths]].sum() + b * at_host[g[0]]) / (paths.count(g) + b) for g in set(paths)}
        for r in rows:
            expected = sigmoid(r[3 + k] + logit(at_path[r[1], r[2]]) - logit(prior))
            assert abs(out[r[0]][f"p_{t}"] - expected) < 1e-9


def test_long_texts_are_judged(make, spark):
    model = quality.Model({"bad": 0}, np.array([[0.1] * quality.SHAPES + [-5.0], [-0.1] * quality.SHAPES + [5.0]]))
    rows = make([(1, "word " * 400_000 + "bad"), (2, "x" * 2_000_000)])
    got = {r["doc_id"]: r["toxic"] for r in quality.scores(rows, model, rows["source"], rows["lang"]).collect()}
    assert got[1] > got[2]


# Archives


def test_archive_round_trip(spark, tmp_path):
    long, other = "<p>" + "x" * 200, "<p>é" + "y" * 300
    rows = [(5, "http://a/1", long), (3, "http://a/2 b", long), (9, None, long), (1, "u", None), (2, "v", ""), (4, "w", "short"), (6, "w", "short"), (7, "http://b/\n", other), (7, "http://b/", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as file")
    index = warc.write(pages, str(tmp_path / "w"))
    assert index.count() == len(rows)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(index, str(tmp_path / "w")).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expected = sorted(((i, len((h or "").encode()), sha(h), "revisit" if h == long and i != 3 else "response", 3 if h == long and i != 3 else None) for i, _, h in rows), key=repr)
    assert got == expected
    some = warc.read(index.where("page_id = 7"), str(tmp_path / "w")).collect()
    assert [r["page_id"] for r in some] == [7, 7]
    assert warc.write(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_damage_is_noticed():
    member = warc.record(1, "u", b"payload" * 30, hashlib.sha256(b"payload" * 30).hexdigest(), None, False)
    assert warc.parse(member)[:4] == (1, 210, hashlib.sha256(b"payload" * 30).hexdigest(), "response")
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"payload" * 30, "0" * 64, None, False))


# Pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/a>Home</a><li>B</ul></nav>
<div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>First\n  text</b><br>more<p>Second&nbsp;one</p><form><input>Send</form><div class="comment-list comments">Nice!</div><aside>Side</aside><p hidden>no</p></article><div id=sidebar>Side</div><footer>&copy; x</footer>"""


def test_article_without_the_rest():
    assert wrapper.main_text(PAGE) == "A & B\nFirst text more\nSecond one"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<div>a<span>b</span> c</div>d", "ab c\nd"), ("<nav>x</nav>", ""), ("<div class='site-header'>x</div><div class='post header'>y</div><div id=main-menu>z</div>", "y"), ("a < b &lt; c", "a < b < c"), ("<!-- x", ""), ("<script>x", ""), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc")])
def test_broken_markup(page, text):
    assert wrapper.main_text(page) == text


@pytest.mark.parametrize("page", ["<body class='no-sidebar'><article><p>x</article>", "<body class='menu'><p>x", "<div class='content with-sidebar'><p>x</div>", "<article class='post has-comments'>x</article>", "<article class='post social-science'>x</article>", "<main class=search>x</main>", "<div id=menu class=banner><article>x</article></div>", "<div class=related><article>y</article></div><article>x</article>", "<html class=cookie><body role=search>x"])
def test_names_do_not_drop_the_article(page):
    assert wrapper.main_text(page) == "x"


@pytest.mark.parametrize("inner", ["<svg viewBox='0 0 1 1'/>", "<math/>", "<SVG />", "<svg><path d='M0'/><title>icon</title></svg>", "<svg><title/></svg>", "<svg><style/></svg>", "<svg><g>", "<math><mi>y</mi>", "<select><option>o", "<select><option>o</select>", "<template>t</template>", "<noscript>n</noscript>", "<svg><foreignObject><p>f</p></foreignObject></svg>"])
def test_embedded_elements_do_not_cut_the_page(inner):
    assert wrapper.main_text(f"<article><p>a</p>{inner}<p>b</p></article>") == "a\nb"
    assert wrapper.main_text(f"<div>{inner}</div><article><p>a</p><p>b</p></article>") == "a\nb"


def test_wrappers_tell_constants_from_slots(spark):
    page = "<body><div class=top>Welcome to our site</div><div class=body><p>story {0}<p>more {0} words</div><div class=low>All rights kept</div></body>"
    rows = [(i, f"http://h{i % 2}.org/{i}", page.format(i)) for i in range(20)] + [(99, None, page.format(99)), (100, "http://h1.org/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as host", "'y' as wrapper")
    out = {r["page_id"]: r["text"] for r in wrapper.main_texts(pages).collect()}
    assert out[3] == "story 3\nmore 3 words" and out[100] == ""
    assert out[99] == "Welcome to our site\nstory 99\nmore 99 words\nAll rights kept"  # too few pages to tell
    assert wrapper.main_texts(pages.limit(0)).count() == 0


def test_copies_of_one_article_keep_it(spark):
    pages = spark.createDataFrame([(i, "http://h/", "<article><h1>T</h1><p>same</article>") for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in wrapper.main_texts(pages).collect()} == {"T\nsame"}


def test_constants_after_many_varied_blocks_are_found(spark):
    rng = random.Random(7)
    rows = []
    for i in range(24):
        inner = "".join(f"<{tag}>{tag} {i} {k} {rng.random()}</{tag}>" for k, tag in enumerate(rng.choices(["h2", "p", "h3", "pre", "blockquote"], k=90)))
        rows.append((i, f"http://h/{i}", f"<body><div>Top line</div>{inner}<address>All rights kept</address></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = []
    for split in (1, 3, 8):
        dealt = pages.repartition(split)
        results.append({r["page_id"]: r["text"] for r in wrapper.main_texts(dealt).collect()})
    assert results[0] == results[1] == results[2] and len(results[0]) == 24
    for text in results[0].values():
        assert len(text.split("\n")) == 90 and "rights" not in text and "Top" not in text


def test_repeated_runs_can_be_template(spark):
    page = "<body><ul><li>Home<li>About<li>Contact</ul><div><h1>Title {0}</h1><p>story {0}<p>more {0}<ul><li>point {0}<li>end {0}</ul></div><div><p>Made by us<p>All rights kept</div>"
    rows = [(i, f"http://h/{i}", page.format(i % 12)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in wrapper.main_texts(pages).collect()}
    assert out == {i: "Title {0}\nstory {0}\nmore {0}\npoint {0}\nend {0}".format(i % 12) for i in range(30)}


def test_copies_beside_another_page_keep_their_text(spark):
    rows = [(i, "http://h/", "<div><p>one<p>two</div>") for i in range(99)] + [(99, "http://h/", "<div><p>three<p>four</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in wrapper.main_texts(pages).collect()} == {"one\ntwo", "three\nfour"}


def plain_match(a, b):
    """Simple tree matching by its definition, on (label, children) trees."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_match(x[i], y[j]))
    return 1 + best[-1][-1]


def folded_tree(page, node=0):
    return page.labels[node], [folded_tree(page, r[0]) for r in page.runs[node]]


def random_page(rng, depth=0):
    out = "".join(f"<{t}>{random_page(rng, depth + 1) if depth < 3 and rng.random() < 0.6 else 'x'}</{t}>" for t in rng.choices(["div", "section", "h2", "pre"], k=rng.randrange(1, 5)))
    return out + ("" if depth else "<div>end</div>")


def test_matching_equals_its_definition():
    rng = random.Random(12)
    for _ in range(300):
        a, b = wrapper.read(random_page(rng)), wrapper.read(random_page(rng))
        matcher = wrapper.Matcher(wrapper.Template.of(b))
        assert matcher.score(a, 0, 0) == plain_match(folded_tree(a), folded_tree(b))
        matched = matcher.keys(a)
        partners = {matched[r[0]] for x in range(len(a.labels)) for r in a.runs[x] if 0 < matched[r[0]] <= len(b.labels)}
        assert len(partners) + 1 == plain_match(folded_tree(a), folded_tree(b))


@pytest.mark.parametrize("page, text", [("<body class='has-sidebar'><article><p>Hello world", "Hello world"), ("<article class='post comments-open'><p>a</p></article>", "a"), ("<div class='entry share-enabled'><p>b</p></div>", "b"), ("The <a class='search'>engine</a> is", "The engine is"), ("<div class=search><h1>All</h1><p>of the text stands here</div>", "All\nof the text stands here"), ("<div class=search>a box</div><p>and a text beside it that is longer", "and a text beside it that is longer"), ("<ul><li><a href=/>Home</a><li><a href=/b>About</a></ul><p>text", "text"), ("<article><ul><li><a href=/>One</a><li><a href=/b>Two</a></ul></article>", "One\nTwo"), ("<div role=main><p>in</p></div><div>out</div>", "in")])
def test_names_are_no_last_word(spark, page, text):
    assert wrapper.main_text(page) == text
    pages = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    assert [r["text"] for r in wrapper.main_texts(pages).collect()] == [text]


def test_names_are_judged_over_the_host(spark):
    """One page of the host has a short text beside the named element; over all pages that element holds the text."""
    rows = [(i, f"http://h/{i}", f"<div class=related><h1>Title {i}</h1><p>{'words of story %d ' % i * 30}</div><div>{'by %d' % i}</div>") for i in range(8)]
    pages = spark.createDataFrame([*rows, (9, "http://h/9", f"<div class=related><h1>Short 9</h1></div><div>{'by 9 ' * 9}</div>")], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in wrapper.main_texts(pages).collect()}
    assert out[3].startswith("Title 3\nwords of story 3") and out[9].startswith("Short 9\nby 9")
    assert not wrapper.main_text(rows[0][2].replace("words of story 0 ", "")).startswith("Title")


def unmarked_host(rng, n):
    """Pages without telling names: a frame of plain elements around stories of different structure."""
    rows, texts = [], {}
    for i in range(n):
        story = [(rng.choice(["h2", "p", "p", "p", "blockquote", "pre"]), f"story {i} part {k} {rng.random()}") for k in range(rng.randrange(1, 12))]
        related = "".join(f"<li><a href=/{j}>Story number {j}</a>" for j in rng.sample(range(1000), 4))
        frame = "<div><p>Our paper</p><p>Since 1900</p></div>{0}<ul>{1}</ul><div><p>Read more</p><address>All rights kept</address></div>"
        body = "<section>" + "".join(f"<{t}>{x}</{t}>" for t, x in story) + ("<p>Read more</p>" if i == 0 else "") + "</section>"
        rows.append((i, f"http://h/{i}", frame.format(body, related)))
        texts[i] = "\n".join(x for _, x in story) + ("\nRead more" if i == 0 else "")
    return rows, texts


def test_the_wrapper_decides_on_unmarked_pages(spark):
    rows, texts = unmarked_host(random.Random(4), 30)
    results = []
    for split in (1, 7, 50):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(split)
        results.append({r["page_id"]: r["text"] for r in wrapper.main_texts(pages).collect()})
    assert results[0] == results[1] == results[2] == texts
    alone = {i: wrapper.main_text(html) for i, _, html in rows}
    assert all(alone[i] != texts[i] for i in texts)  # without the host's other pages the frame stays


def test_two_pages_tell_a_frame(spark):
    rows, texts = unmarked_host(random.Random(5), 2)
    rows = [(i, u, h.replace("<section>", f"<section><p>{'a long first paragraph %d ' % i * 20}</p>")) for i, u, h in rows]
    out = {r["page_id"]: r["text"] for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i].startswith("a long first") and out[i].endswith(texts[i]) for i in texts)
    near = [(i, "http://n/", f"<div><p>{'the same words ' * 30}</p><p>{i}</p></div>") for i in range(2)]  # copies with a change
    out = [r["text"] for r in wrapper.main_texts(spark.createDataFrame(near, "page_id long, url string, html string")).collect()]
    assert all(t.startswith("the same words") for t in out)


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 10_000 + "low" + "</div>" * 10_000
    other = "<div>" * 9_000 + "<p>a</p>" + "</div>" * 5_000 + "<p>high</p>"
    rng = random.Random(3)
    wide = ["".join(f"<{t}>w{k}</{t}>" for k, t in enumerate(rng.choices(["h2", "p", "pre"], k=10_000))) for _ in range(2)]
    inline = "<p>" + "<b>" * 20_000 + "x" + "<li>y" * 2_000
    rows = [(i, "http://h/", h) for i, h in enumerate([deep, other, *wide, inline])]
    out = {r["page_id"]: r["text"] for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == "low" and out[1] == "a\nhigh" and out[2].count("\n") == out[3].count("\n") == 9_999 and out[4].startswith("x\ny")



# Personal data


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@given(st.text(alphabet="01259.@+- ()aZé_%\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_labels_spread_over_the_document():
    text = "Call +1 (625) 555-7196 today. Later: 625 555 7196, or 1 625 555 7196. Not 999 888 7777. Write jo.doe7@x.org; jo.doe7 answers."
    base, spans = pii.find(text)
    added = {(k, text[a:b]) for k, a, b in set(spans) - set(base)}
    assert added == {("phone", "625 555 7196"), ("phone", "1 625 555 7196"), ("email", "jo.doe7")}
    assert base == plain_spans(text) and set(base) <= set(spans)


def test_beliefs_are_exact_on_trees():
    """Against the sum over all labellings, where the links form a tree."""
    texts = ["Call +1 (625) 555-7196 or 625 555 7196 now", "12 34567 89, 99 88 77 66 55", "a@b9.co x jo.doe7@x.org jo.doe7", "4111 1111 1111 1111 and 4111111111111111 by 10.0.0.1", "1 625 555 7196"]
    weights = pii.Weights({"11 4": {"phone": 0.7}, "16 4L": {"card": 1.2}, "10 3": {"phone": 0.4, "card": -0.3}}, skip=2.5, chain=0.6)
    for text in texts:
        nodes = pii._nodes(text, pii.base_spans(text))
        chain, skip = pii._links(text, nodes)
        assert len(chain) + len(skip) < len(nodes)
        k, n = len(pii.LABELS), len(nodes)
        unary = np.zeros((n, k))
        for i, (kind, a, b) in enumerate(nodes):
            if kind:
                unary[i, pii.LABELS.index(kind)] = pii.CERTAIN
            else:
                known = weights.forms.get(pii.form(text[a:b]), {}) if text[a].isdigit() else {}
                unary[i, 1:] = [known.get(x, pii.UNSEEN) for x in pii.KINDS]
        plain = np.zeros((n, k))
        for labels in itertools.product(range(k), repeat=n):
            p = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(weights.skip for i, j in skip if labels[i] == labels[j]) + sum(weights.chain for i, j in chain if labels[i] == labels[j]))
            for i, x in enumerate(labels):
                plain[i, x] += p
        got = np.exp(pii.beliefs(text, nodes, weights))
        assert np.allclose(got / got.sum(1, keepdims=True), plain / plain.sum(1, keepdims=True), atol=1e-4)


def test_learned_potentials_find_what_patterns_miss(make, spark):
    """Numbers written with their sign teach the form of numbers without it; forms outside of spans stay out."""
    rng = random.Random(11)
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    taught = make([(i, f"call +1 {number()} or ask for order {rng.randrange(10**9, 10**10)} today") for i in range(300)])
    weights = pii.learn(taught)
    plain, seen = pii.Weights(), "ring 1 (625) 555-7196 about order 1234567890 soon"
    assert pii.find(seen, plain)[1] == [] and [k for k, *_ in pii.find(seen, weights)[1]] == ["phone"]
    planted = make([(i, f"order {rng.randrange(10**9, 10**10)}, ring 1 {number()}") for i in range(40)])
    assert pii.detect(planted, weights).where("n_added = 1").count() == 40 and pii.detect(planted, plain).where("n_added = 0").count() == 40
    assert weights == pii.learn(taught.repartition(5)) and pii.learn(taught.limit(0)) == plain
    assert pii.find("0 1.2 3 1234567 999.1.1.1 12345.67890", weights)[1] == []


def test_a_text_of_addresses_takes_seconds():
    text = " ".join(f"user{i}.x@mail{i % 7}.com user{i}.x +1 (974) 555-{i % 10000:04d}, 1 974 555 {i % 10000:04d}" for i in range(16_000))
    began = time.perf_counter()
    base, spans = pii.find(text)
    assert len(text) > 1_000_000 and len(base) == 32_000 and len(spans) > 60_000 and time.perf_counter() - began < 20


def test_detect_and_redact(make):
    rows = [(1, "a@b.co and 10.0.0.1"), (2, None), (3, ""), (4, "plain"), (5, "4111 1111 1111 1111 " * 3), (5, "x" * 50_000 + "@" * 20_000 + "1" * 50_000)]
    out = pii.detect(make(rows).selectExpr("*", "1 as spans"), pii.Weights()).collect()
    assert len(out) == 6
    for r in out:
        if r["doc_id"] == 1:
            assert (r["n_email"], r["n_ip"], r["spans"]) == (1, 1, "email:0:6,ip:11:19") and r["base_sha256"] == hashlib.sha256(b"email:0:6,ip:11:19").hexdigest()
        if r["doc_id"] in (2, 3, 4):
            assert r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r for r in pii.redact(make(rows[:4]), pii.Weights()).collect()}
    assert clean[1]["text"] == "<EMAIL> and <IP>" and clean[1]["n_chars"] == 16 and clean[2]["text"] is None and clean[4]["text"] == "plain"
    assert pii.detect(make([]).limit(0), pii.Weights()).count() == 0


# Decontamination


def test_edited_passages_are_found(make, spark):
    rng = random.Random(8)
    passage = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    items = [(i, passage(40)) for i in range(20)] + [(20, None), (21, ""), (22, "tiny"), (23, passage(40))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as edits")

    def edited(text, share):
        out = list(text)
        for _ in range(int(len(text) * share)):
            at = rng.randrange(len(out))
            out[at : at + 1] = rng.choice([["q"], [], [out[at], "z"]])
        return "".join(out)

    rows, expected = [], set()
    for i in range(60):
        text = passage(60)
        if i % 3 == 0:
            j = rng.randrange(20)
            text = passage(10) + " " + edited(items[j][1].upper() if i % 2 else items[j][1].replace(" ", "\n "), 0.05) + " " + passage(10)
            expected.add((i, j))
        rows.append((i, text))
    rows += [(60, None), (61, ""), (62, "a tiny thing")]
    expected.add((62, 22))
    got = decontaminate.contaminated(make(rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected
    assert {r["doc_id"] for r in decontaminate.cleaned(make(rows), benchmark).collect()} == {i for i, _ in rows} - {i for i, _ in expected}
    assert decontaminate.contaminated(make(rows), benchmark.limit(0)).count() == 0


def sellers(pattern, text):
    """The least edits of the pattern over all regions of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_occurrences_equal_the_search_of_all_regions():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(2, 16)))) for i in range(25)]
    index = decontaminate.build(items, 0.1)
    hits = 0
    for _ in range(60):
        text = " ".join(word() for _ in range(rng.randrange(0, 30)))
        for _ in range(rng.randrange(3)):
            piece = list(rng.choice(items)[1])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(piece))
                piece[at : at + 1] = rng.choice([["q"], [], [piece[at], "z"]])
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "".join(piece) + text[at:]
        data = decontaminate.normalised(text)
        expected = {j: e for j, t in enumerate(index.texts) if (e := sellers(t, data)) <= (index.budget[j] if len(t) >= decontaminate.Q else 0)}
        assert {j: e for j, _, _, e in decontaminate.occurrences(data, index)} == expected
        hits += len(expected)
    assert hits > 30


def test_rows_without_an_id_and_long_texts(make, spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, "".join(rng.choices("abcdefghij ", k=80))) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, items[2][1]), (None, "clean"), (1, f"before {items[0][1]} after"), (1, "clean too"), (2, None), (3, "word " * 60_000 + items[5][1]), (4, "word " * 60_000)]
    docs = make(rows).selectExpr("*", "1 as item_id", "2 as start")
    for size in (2_000_000, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        left = decontaminate.cleaned(docs, benchmark)
        assert left.columns == docs.columns
        assert sorted((str(r["doc_id"]), (r["text"] or "")[:9]) for r in left.collect()) == [("1", "clean too"), ("2", ""), ("4", "word word"), ("None", "clean")]
        got = decontaminate.contaminated(docs, benchmark).collect()
        assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == [("1", 0), ("3", 5), ("None", 2)]


def test_banded_alignment_equals_the_full_table():
    rng = random.Random(3)
    for _ in range(60):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(8, 30)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 60)))
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            new = [i]
            for j in range(1, len(t) + 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
            row = new
        best = min(row)
        got = decontaminate.align(p, t, -len(p), len(t), len(p))
        assert got is not None and got[0] == best


def test_repetitive_texts_take_bounded_memory(monkeypatch):
    monkeypatch.setattr(decontaminate, "COUNTED", 1000)
    index = decontaminate.build([(1, "ab" * 100), (2, "xy" * 60)])
    text = ("ab" * 400 + " q " + "xy" * 59 + "y").encode()
    assert [o[0] for o in decontaminate.occurrences(text, index)] == [0, 1]


def test_small_blocks_give_the_same(make, spark, monkeypatch):
    items = [(i, f"passage number {i} with some words that are its own {i * 7919}") for i in range(6)]
    rows = make([(i, f"before {t} after") for i, t in items])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(rows, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(rows, benchmark).collect()} == whole
