"""Tokenizers, languages, packing, pages and sound, against the libraries or brute force."""

import hashlib
import html
import random
import wave

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelgrade.llm import chroma, htmltext, langid, packing, pieces, tokencount

PIECES = [
    " ", "  ", "\n", "\t", "▁", "s", "ing", "the", "É", "ß", "日", "1", "23", "²", "!", "...", "'s", "'re", "'ll", "'", "<|endoftext|>", "<s>", "<unk>",
    "\u00a0", "\u2003", "é", "😀", "\u200d", "A", "\x85", "aaaa", "====", "Ⅷ", "\r",
]
TEXTS = ["".join(random.Random(i).choice(PIECES) for _ in range(i % 41)) for i in range(3000)]
# Complementary strings: one polynomial hash modulo 2**64, whatever its base.
BITS = [bin(i).count("1") & 1 for i in range(2048)]
TWINS = ["".join(pair[b ^ flip] for b in BITS[:n]) for n in (1024, 2048) for pair in ("qe", "ab", "é日") for flip in (0, 1)]
TEXTS += TWINS
TEXTS += ["a" * 3000, "=" * 2000 + " " * 2000, "ab" * 20_000 + " x'll", "", " ", "▁", "<|endoftext|>"]


@pytest.fixture(scope="module")
def counter():
    return tokencount.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"), tokencount.character_classes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_equal_the_library(counter, library):
    want = [len(e.ids) for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert counter.counts(TEXTS).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_counts_of_any_text(counter, library, text):
    assert counter.counts([text])[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_chunk_maps_compose(counter):
    """Cuts don't depend on where chunks fall: the scan gives what one pass from the start gives."""
    kinds = np.random.default_rng(1).integers(0, 11, 1000).astype(np.uint8)
    whole = counter.cutter.cuts(kinds)
    state, out = tokencount.FRESH, np.zeros(1000, bool)
    for i, c in enumerate(kinds):
        at = int(c) * tokencount.STATES + state
        emitted, state = counter.cutter.out[at], counter.cutter.to[at]
        if emitted & tokencount.CUT_LAST:
            out[i - 1] = True
        if emitted & tokencount.UNCUT_LAST:
            out[i - 1] = False
        if emitted & tokencount.CUT:
            out[i] = True
    assert (whole == out).all()


def test_count_rows(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (None, "", "x"), (1, "hello world", "x"), (4, "a b " * 1024, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == [
        (0, 0, 0, False), (1, 11, 2, False), (1, 11, 2, False), (2, 0, 0, False), (4, 4096, 2049, True)
    ]
    assert tokencount.count_tokens(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pieces_equal_the_library(codec):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sp.encode(TEXTS)
    decoded = sp.decode(want)
    for text, ids, plain in zip(TEXTS, want, decoded, strict=True):
        got, covers, surface, origin = codec.encode(text)
        assert got.tolist() == ids and codec.strip(surface) == plain == codec.decode(ids)
        if len(got):
            ends = codec.spans(text, covers, origin)
            assert ends[-1] == len(text.encode()) and (np.diff(ends) >= 0).all()
            start = 0
            for i, end in zip(ids, ends.tolist(), strict=True):
                if i not in codec.bytes_of:
                    source = text.encode()[start:end].decode().replace("▁", " ")
                    assert codec.pieces[i].replace("▁", " ") in (source, " " + source)
                start = end


def test_words_are_cut_between_alphabets(codec, monkeypatch):
    """A word is merged once, whatever stands around it, and remembered while it is met; pieces stay the library's."""
    import sentencepiece

    made, merged = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model")), []
    merge = made._merge
    monkeypatch.setattr(made, "_merge", lambda word: merged.append(word) or merge(word))
    made.encode(" ".join(f"{a}rechvi{b}" for a in ("", ".", "\n", "[[") for b in ("", ",", "...", "\n***", "٣")))
    assert sorted(word for word in merged if "rechvi" in word) == ["rechvi", "▁rechvi"]
    rng = random.Random(5)
    signs = [*"!?.,;:'\"()[]{}^-\\/#$%&*~|\n\t·£²7٣ßжا数", "\u0300", "<0x0A>", "\U0001f600", "…", "▁", "ﬁ"]
    texts = [" ".join("".join(rng.choice(("rechvi", "Zeñor", "мир", "")) + "".join(rng.choices(signs, k=rng.randrange(4))) for _ in range(3)) for _ in range(40)) for _ in range(60)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = library.encode(texts)
    for text, ids, plain in zip(texts, want, library.decode(want), strict=True):
        got, _, surface, _ = made.encode(text)
        assert got.tolist() == ids and made.strip(surface) == plain

    monkeypatch.setattr(pieces, "MEMORY_WORDS", 8)
    made.forget()
    merged.clear()
    made.encode(" ".join(f"again new{chr(97 + i)}" for i in range(26)))
    assert merged.count("▁again") == 1 and len(made.known) + len(made.older) <= 8


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array: 'a' -> 'x', 'ab' -> 'yz'."""
    texts = b"x\0yz\0"
    units = [0] * 1024
    root, a, b = 256, 512, 768  # offsets of the nodes' children
    unit = lambda offset, label, leaf: (offset >> 8) << 10 | 1 << 9 | leaf << 8 | label
    units[0] = unit(root, 0, 0)
    at_a = root ^ ord("a")
    units[at_a] = unit(a, ord("a"), 1)
    units[at_a ^ a] = 0 | 1 << 31
    at_b = (at_a ^ a) ^ ord("b")
    units[at_b] = unit(b, ord("b"), 1)
    units[at_b ^ b] = 2 | 1 << 31
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + texts
    made = pieces.CharacterMap(blob)
    assert made.longest(b"abc", 0) == (2, b"yz") and made.longest(b"ac", 0) == (1, b"x") and made.longest(b"c", 0) == (0, None)


def test_piece_rows(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld", "x"), (2, None, "x"), (None, "", "x")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got[1]["decoded"] == "Hello  wörld" and got[1]["ends"][-1] == 13
    assert got[2]["ids"] == [] and got[None]["decoded"] == "" and got[2]["ends"] == []
    digest = {r["doc_id"]: r for r in pieces.piece_digests(pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))).collect()}
    assert digest[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, got[1]["ids"])).encode()).hexdigest()
    assert digest[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and digest[2]["source_bytes"] == 0


def naive_kneser_ney(words, order, alphabet):
    """The recursion itself, over dictionaries, for one language."""
    from collections import Counter

    raw = [Counter() for _ in range(order + 1)]
    for w, n in words.items():
        m = "^" + w + "$"
        for i in range(1, len(m)):
            for k in range(1, min(order, i + 1) + 1):
                raw[k][m[i + 1 - k : i + 1]] += n
    kept = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in raw[k].items():
            if k == order or g[0] == "^":
                kept[k][g] = n
        if k > 1:
            for g in raw[k]:
                if g[1:2] != "^":
                    kept[k - 1][g[1:]] += 1
    d = []
    for k in range(1, order + 1):
        n1, n2 = (sum(n == m for n in kept[k].values()) for m in (1, 2))
        d.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)

    def p(context, c):
        k = len(context) + 1
        low = p(context[1:], c) if context else 1 / (alphabet + 1)
        total = sum(n for g, n in kept[k].items() if g[:-1] == context)
        if not total:
            return low if context else low
        kinds = sum(1 for g in kept[k] if g[:-1] == context)
        return max(kept[k].get(context + c, 0) - d[k - 1], 0) / total * (context + c in kept[k]) + d[k - 1] * kinds / total * low

    def cost(word):
        m = "^" + word + "$"
        return -sum(np.log(p(m[max(0, i - order + 1) : i], m[i])) for i in range(1, len(m)))

    return cost


def test_language_model_equals_the_recursion():
    import pandas as pd

    words = {"aa": {"abab": 3, "abba": 2, "ba": 5, "cab": 1}, "bb": {"dodo": 2, "od": 1, "abd": 1}}
    model = langid.KneserNey.fit(pd.DataFrame([(k, w, n) for k, ws in words.items() for w, n in ws.items()], columns=["lang", "word", "n"]))
    alphabet = len({c for ws in words.values() for w in ws for c in w + "$"})
    texts = ["abab", "dod", "xyz", "a"]
    cost, size = model.costs([f"{t}, {t.upper()}!" for t in texts])
    for li, lang in enumerate(model.languages):
        naive = naive_kneser_ney(words[lang], langid.ORDER, alphabet)
        assert np.allclose(cost[:, li], [2 * naive(t) for t in texts], rtol=1e-5)
    assert size.tolist() == [10, 8, 8, 4]


def test_costs_of_words_do_not_depend_on_their_batch():
    import pandas as pd

    model = langid.KneserNey.fit(pd.DataFrame([("aa", "qeqe", 3), ("bb", "eeq", 2), ("bb", "abq", 2)], columns=["lang", "word", "n"]))
    cost, size = model.costs(TWINS)
    assert np.allclose(cost, np.concatenate([model.costs([t])[0] for t in TWINS])) and (size >= 1).all()


def test_languages_of_documents(spark):
    en, de = "the cat and the other thing with that ", "der hund und die katze ist schön über "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de", "z") for i in range(120)]
    rows += [(200, None, None, "z"), (201, "12 !?", "en", "z"), (202, "", None, "z"), (None, en, "en", "z"), (203, "qxzj wvkq zzqx jjkw " * 9, None, "z"), (203, en, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify_languages(docs, langid.fit_languages(docs)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["lang_pred"] == ("en" if i % 2 else "de") and not by[i][0]["rejected"] for i in range(120))
    for i in (200, 201, 202):
        assert (by[i][0]["lang_pred"], by[i][0]["score"], by[i][0]["rejected"]) == ("und", 0.0, True)
    assert by[None][0]["held_out"] is False and all(0 <= r["score"] <= 1 for r in got)
    assert any(r["rejected"] for r in by[203]) and any(not r["rejected"] for r in by[203])
    empty = docs.where("false")
    assert langid.identify_languages(empty, langid.fit_languages(empty)).count() == 0


def test_unlearned_languages_are_rejected(spark):
    words = {
        "de": "der hund und die katze ist schön über nicht wasser zwischen straße leben kinder".split(),
        "en": "the cat and other thing with that water between street living children would".split(),
        "fr": "le chat et les autres choses avec cette eau entre la rue vivre enfants voudrait".split(),
    }
    made = lambda k, i: " ".join(random.Random(f"{k}{i}").choices(words[k], k=40))
    few = [(1000 + i, made("fr", i), "fr") for i in range(12)]
    docs = [(i, made(k, i), k) for i in range(200) for k in ("de", "en")]
    asked = [(i, made(k, 5000 + i), k) for i in range(20) for k in words]
    form = "doc_id long, text string, lang string"
    asked = spark.createDataFrame(asked, form)
    model = langid.fit_languages(spark.createDataFrame(docs, form))
    got = asked.select("lang", langid.language_of(asked, model).alias("x")).select("lang", "x.rejected").collect()
    assert all(r["rejected"] == (r["lang"] == "fr") for r in got)
    model = langid.fit_languages(spark.createDataFrame(docs + few, form))
    assert "fr" in model.languages and np.isfinite(model.limits).all()


def test_best_fit_decreasing_against_a_scan():
    rng = random.Random(1)
    for capacity in (7, 16, 100):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
            got = packing.best_fit_decreasing(lengths, capacity)
            free: list[int] = []
            for n in sorted(lengths, reverse=True):
                fit = [i for i, f in enumerate(free) if f >= n]
                if fit:
                    free[min(fit, key=lambda i: free[i])] -= n
                else:
                    free.append(capacity - n)
            assert sorted(capacity - sum(lengths[i] for i in b) for b in got) == sorted(free)
            assert sorted(i for b in got for i in b) == list(range(len(lengths)))


def test_packing_is_lossless(spark):
    texts = {1: "it's a small text", 2: "long text, " * 300, 3: None, 4: "", 5: "日本 ünd  <|endoftext|>", **dict(enumerate(TWINS, 10))}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, parts string").repartition(2)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = packing.pack_tokens(docs, path, pattern, length=64, pad=7).collect()
    encoding = packing.token_ids(path, pattern, tokencount.character_classes()).encoding
    found: dict[int, dict[int, list[int]]] = {}
    assert len({r["row_id"] for r in rows}) == len(rows)
    for r in rows:
        ids, places = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == 7).all()
        for k, (doc, part) in enumerate(zip(r["doc_ids"], r["parts"], strict=True)):
            a, b = r["cu_seqlens"][k : k + 2]
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault(doc, {})[part] = ids[a:b].tolist()
    assert set(found) == {1, 2, 5, *range(10, 10 + len(TWINS))}
    for doc, parts in found.items():
        assert [i for p in sorted(parts) for i in parts[p]] == encoding.encode_ordinary(texts[doc])


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class=x><nav><ul><li><a href="/a">A</a></ul></nav>
<!-- <p>no</p> --><div class="cookie-notice">We use</div><div class="wrap w12"><article><h1>Head &amp; tail</h1><p><b>First
  part<br>two<p title="a>b">Second &lt;x&gt; <a href=#>link</a> text that is long enough to be the page's own.<ul><li>i<li>j</ul>
<section class="comments"><p>Reader says</p></section><aside>Side</aside></article></div><footer>F</footer>"""
TEXT = "Head & tail\nFirst part two\nSecond <x> link text that is long enough to be the page's own.\ni\nj"


def test_page_text(spark):
    assert htmltext.Page(PAGE).text([]) == TEXT and htmltext.Page(PAGE).best()[0] == "body/div.w#.wrap/article"
    bare = "<div class=wrap><article><p>Short.</p></article><div class=box>" + "<p>Elsewhere there is much more text. </p>" * 3 + "</div></div>"
    rows = [(i, f"https://h.org/{i}", PAGE, "z") for i in range(6)] + [(7, "https://h.org/7", bare, "z"), (8, None, None, "z"), (None, "x", "", "z"), (9, "https://h.org/9", "plain &eacute; text", "z"), (9, "https://h.org/9", "plain &eacute; text", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = htmltext.extract_text(pages).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r for r in got}
    assert texts[0]["text"] == TEXT and texts[0]["n_chars"] == len(TEXT)
    assert texts[8]["text"] == "" and texts[None]["n_chars"] == 0 and texts[9]["text"] == "plain é text"
    assert "Elsewhere" in texts[7]["text"]
    assert htmltext.extract_text(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "wrapper", ['body class="has-sidebar"', 'body class="search-results"', 'div id="main" class="with-sidebar no-comments"', 'article class="post no-related"',
                'article class="post related"', 'div class="search-results"']
)
def test_names_of_wrappers_set_no_article_apart(wrapper):
    own = "Own words of the article, which are most of the page."
    page = f'<{wrapper}><p>{own}</p><span class="share">Share</span><div class="comments"><p>Reader says</p></div></{wrapper.split()[0]}>'
    assert htmltext.Page(page).text([]) == own
    assert htmltext.Page('<div class="notice"><p>Alone</p></div>').text([]) == "Alone"
    assert htmltext.Page("<p>Before <span class=share>Share</span> and after").text([]) == "Before\nand after"


OWN_WORDS = "Own words of the article, which go on for quite a while."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body class="no-sidebar"><article><p>{OWN_WORDS}</p></article>', OWN_WORDS),
        (f'<article class="related-work"><p>{OWN_WORDS}</p></article>', OWN_WORDS),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me</p></header><p>{OWN_WORDS}</p></article>", f"Title\n{OWN_WORDS}"),
        ('<article><p>Main.</p></article><div class="disclaimer">We use cookies</div>', "Main."),
        (f"<div class=intro><p>{OWN_WORDS}</p></div><div class=content><p>{OWN_WORDS * 3}</p></div><div class=x>Few</div>", f"{OWN_WORDS}\n{OWN_WORDS * 3}"),
        (f"<div class=a><p>{OWN_WORDS * 5}</p></div><div class=b><p>{OWN_WORDS * 4}</p></div>", f"{OWN_WORDS * 5}\n{OWN_WORDS * 4}"),
        (f"<div class=w>{OWN_WORDS}<div class=b><p>{OWN_WORDS * 4}</p></div></div>", f"{OWN_WORDS}\n{OWN_WORDS * 4}"),
    ],
)
def test_articles_stay_whole(page, want):
    assert htmltext.Page(page).text([]) == want


def test_only_the_hosts_votes_find_the_article(spark):
    """Pages without telling elements or names: a long notice is the same on all, and the shorter article differs."""
    notice = "We tell everybody the same long story on each page of this site. " * 6
    page = lambda i: f"<div class=n><p>{notice}</p></div><div class=t{i}><h2>Item {i}</h2><p>{'Word ' * (5 + i % 7)}{i}.</p></div>"
    rows = [(i, f"https://{h}.org/{i}", page(i)) for h in "ab" for i in range(12)]
    rows += [(100, "https://c.org/", page(5))]  # alone on its host: nothing tells that the notice is one
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    for r in got:
        own = f"Item {r['page_id']}\n{'Word ' * (5 + r['page_id'] % 7)}{r['page_id']}."
        assert r["text"] == own if r["page_id"] < 100 else notice.strip() in r["text"]


def test_deep_and_very_long_pages():
    deep = "<div>" * 3000 + "<p>Down here</p>" + "</div>" * 3000
    assert htmltext.Page(deep).text([]) == "Down here"
    long = "".join(f"<p>Paragraph {i}</p>" for i in range(50_000))
    assert htmltext.Page(f"<article>{long}</article>").text([]).count("\n") == 49_999


def test_ends_of_scripts_are_found_after_letters_that_grow():
    page = f"<p>{'İ' * 20}</p><script>x</SCRIPT><p>First</p><p>Second</p>"
    assert htmltext.Page(page).text([]) == "İ" * 20 + "\nFirst\nSecond"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/=\"'&;!-pdiva ", max_size=60))
def test_any_markup_is_read(text):
    htmltext.Page(text).text([])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\0\r"), max_size=30), max_size=4))
def test_blocks_come_back(blocks):
    page = "<article>" + "".join(f"<p>{html.escape(b)}</p>" for b in blocks) + "</article>"
    assert htmltext.Page(page).text([]) == "\n".join(x for x in (" ".join(html.unescape(html.escape(b)).split()) for b in blocks) if x)


def test_wrong_votes_lose(spark):
    side = '<div class="q"><p>' + "Another block which is long. " * 40 + "</p></div>"
    rows = [(i, "https://s.org/", PAGE) for i in range(5)] + [(9, "https://s.org/", PAGE.replace("<footer>", side + "<footer>"))]
    paths = htmltext.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert paths["host"] == "s.org" and paths["paths"][0] == "body/div.w#.wrap/article"


def play(words):
    return np.concatenate([np.sin(2 * np.pi * 110 * 2 ** ((w % 36) / 12) * np.arange(256) / chroma.RATE) for w in words]).astype(np.float32)


def as_wav(sound, rate=chroma.RATE):
    import io

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((sound * 30_000).astype("<i2").tobytes())
    return out.getvalue()


def test_recordings_align(spark):
    rng = np.random.default_rng(4)
    tune, other = rng.integers(0, 36, 80), rng.integers(0, 36, 80)
    noisy = play(tune[20:]) + rng.normal(0, 0.02, 60 * 256).astype(np.float32)
    media = {20: as_wav(play(tune)), 21: as_wav(noisy / 2), 22: as_wav(play(other)), 23: as_wav(play(tune)), 24: None, 25: b"", 26: b"RIFF", 27: as_wav(play(tune[:1]))}
    rows = [(k, v, "x") for k, v in media.items()] + [(None, media[22], "x"), (23, media[23], "x")]
    got = chroma.align_recordings(spark.createDataFrame(rows, "id long, audio binary, class_id string"), lambda i: i % 20 == 0).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert by[20]["class_id"] == by[23]["class_id"] == 20 and by[20]["is_query"] and not by[21]["is_query"]
    assert [(m["class_id"], m["offset"]) for m in by[20]["matches"]] == [(21, -40)] and by[20]["matches"][0]["bit_errors"] < 0.1
    for k in (24, 25, 26, 27):
        assert by[k]["n_prints"] == 0 and by[k]["class_id"] is None and by[k]["matches"] == []
    assert by[None]["class_id"] == 22
    assert chroma.align_recordings(spark.createDataFrame([], "id long, audio binary"), lambda i: i % 20 == 0).count() == 0


def aligned_by_brute_force(a, b):
    """The offset with most equal bits (then the smallest) at which the rule holds, or None."""
    found = []
    for offset in range(chroma.OVERLAP - len(a), len(b) - chroma.OVERLAP + 1):
        low, high = max(0, -offset), min(len(a), len(b) - offset)
        errors = int(np.bitwise_count(a[low:high] ^ b[low + offset : high + offset]).sum())
        if high - low >= chroma.OVERLAP and errors / (32 * (high - low)) <= chroma.ERRORS:
            found.append((errors - 32 * (high - low), offset))
    return min(found)[1] if found else None


@pytest.mark.parametrize(("words", "noise", "every"), [(25, 0.1, 0), (60, 0.3, 0), (25, 0.5, 0), (25, 0, 15), (60, 0, 10)])
def test_noisy_and_edited_recordings_are_found(spark, words, noise, every):
    rng = np.random.default_rng(words + every)
    media, truth = {}, {}
    for i in range(60):
        tune = rng.integers(0, 36, words)
        other = tune.copy()
        if every:
            other[int(rng.integers(0, every)) :: every] = rng.integers(0, 36)
        pair = [play(tune), play(other) + rng.normal(0, noise, words * 256).astype(np.float32)]
        media[20 * i], media[20 * i + 1] = (as_wav(x / 4) for x in pair)
        a, b = (chroma.fingerprint(chroma.read_wav(media[20 * i + k])) for k in (0, 1))
        offset = aligned_by_brute_force(a, b)
        if offset is not None and a.tobytes() != b.tobytes():
            truth[20 * i] = (20 * i + 1, offset)
    rows = spark.createDataFrame(list(media.items()), "id long, audio binary").repartition(2)
    got = {r["id"]: [(m["class_id"], m["offset"]) for m in r["matches"]] for r in chroma.align_recordings(rows, lambda i: i % 20 == 0).collect()}
    assert len(truth) >= 20 and sum(v in got[k] for k, v in truth.items()) >= 0.9 * len(truth)


def test_silence_is_linear():
    """Long constant recordings propose a few offsets, and the same pairs are aligned as with all."""
    rng = np.random.default_rng(2)
    tune = play(rng.integers(0, 36, 40))
    still = lambda seconds: np.zeros(seconds * chroma.RATE, np.float32)
    sounds = [still(600), still(400), np.concatenate([still(5), tune, still(300)]), np.concatenate([tune, still(400)])]
    blobs = [chroma.fingerprint(x).astype("<u4").tobytes() for x in sounds]
    prints, owner, _, lengths = chroma._joined(blobs)
    assert np.bincount(owner[chroma._paired(prints, owner)])[:2].max() <= 2 and lengths[0] > 9000
    sounds = [still(30), still(20), np.concatenate([still(5), tune, still(9)]), np.concatenate([tune, still(14)]), np.concatenate([tune, still(2), tune])]
    blobs = [chroma.fingerprint(x).astype("<u4").tobytes() for x in sounds]
    a, b, offset, _, _ = chroma._Index([0, 1, 2, 3, 4], blobs).aligned(np.arange(5), blobs)
    got = dict(zip(zip(a.tolist(), b.tolist(), strict=True), offset.tolist(), strict=True))
    whole = [np.frombuffer(x, "<u4") for x in blobs]
    want = {(i, j): aligned_by_brute_force(whole[i], whole[j]) for i in range(5) for j in range(5) if i != j}
    assert set(got) == {k for k, v in want.items() if v is not None} and len(got) >= 8
    assert all(got[k] == want[k] for k in ((0, 1), (1, 0)))  # elsewhere, ends of runs meet where other offsets have more equal bits


def test_turns_are_played_alike(spark):
    turns = spark.createDataFrame([(1, 0, "The same words"), (2, 3, "the SAME words"), (3, 0, None)], "conv_id long, turn long, text string")
    got = {r["id"]: r["audio"] for r in chroma.render_turns(turns).collect()}
    assert got[1 << 20] == got[(2 << 20) + 3] and got[3 << 20] is None and len(chroma.read_wav(bytes(got[1 << 20]))) == 3 * 256
    assert F.col("x") is not None
