"""Main text, language, tokens and licences against plain versions, with nulls, blanks, repeats and clashing columns."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import htmltext, langid, licences, queries, token_counts, wavelet

DATA = "/root/testdata/sf0.001"
HARD = [
    None, "", " ", "a", "The cat. The CAT, the cat's hat!", "a  b   c\n\n d ", "x<|endoftext|> y <|endoftext|>z <|endo <|EndOfText|>", "it's  we're 'r 's 'LL", "日本語 テキスト é e\u0301 \u0301x J\u030c", "  lead", "trail  ",
    "a\x1cb \x1d c\x0bd\x85e\xa0f\u200bg", "1234567 89 12!!! ??? ... .., a.,b", "Z" * 300, " \n \n b", "ΑΣ ΣΑΣ İ ß ÿ Ÿ µ", "\t\ttab\r\nline\r", "👩‍👩‍👧 ok", "repeat", "repeat",
]
PAGES = [
    ("<body><nav><ul><li>a<li>b</ul></nav><article><h1>T &amp t</h1><p>one  &copy; &#8212; &unknown;\n<b>bo</b>ld<br>x<div class='ad'>buy</div></p><p>two</article><footer>f</footer>", "T & t\none © — &unknown; bold x\ntwo"),
    ("<div id=top-menu><a>x</a></div><div class='content has-sidebar'><h1>Title</h1><p>" + "word " * 60 + "</p><p>short</p></div><div class=comments><p>" + "c " * 300 + "</div><footer>f</footer>", "Title\n" + " ".join(["word"] * 60) + "\nshort"),
    ("<article><p>a</p><section class=comments><p>never</p></section><script>var x='</p>';</script><style>p{}</style><form>f<input></form><aside>s</aside><!-- <p>c</p> --><p>b</p></article><article class=comment>c</article>", "a\nb"),
    ("<header><nav>m</nav></header><main><p>in</p></main>", "in"), ("<nav>open<p>menu<article><p>text", "text"), ("<p>only <i>text", "only text"), ("<scr", ""), ("", ""), (None, ""), ("plain words", "plain words"),
]


def test_main_text(spark):
    for page, want in PAGES:
        assert htmltext.main_text(page) == want
    rows = [(i, f"u{i}", p, 1, "x") for i, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], 1, "x"), (None, "u", "<p>a", 1, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")
    got = htmltext.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {(r["page_id"], r["text"]) for r in got} == {(i, w) for i, (_, w) in enumerate(PAGES)} | {(None, "a")}
    assert htmltext.extract(df.limit(0)).collect() == []


def test_main_text_of_sample_pages(spark):
    import html
    import re

    for r in queries.op1_main_text(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(filter(None, blocks))


def test_main_text_split_by_boilerplate():
    long, closing, last = "word " * 1000, "close " * 160, "The end."
    for ad in ("<div class=ad>buy</div>", "<aside>x</aside>", "<form>f</form>", "<div class=share>s</div>"):
        page = f"<body><div class=top><a>Home</a></div>{ad}<div class=content><p>{long}</p>{ad}<p>{closing}</p>{ad}<p>{last}</p></div>{ad}<div><p>Imprint</p></div></body>"
        assert htmltext.main_text(page) == "\n".join((long.strip(), closing.strip(), last))
        apart = f"<body><div><p>{long}</p></div>{ad}<div><p>{closing}</p></div>{ad}<div><p>Imprint</p></div></body>"
        assert htmltext.main_text(apart) == "\n".join((long.strip(), closing.strip()))
    assert htmltext.main_text("<nav>m</nav>") == ""


def test_main_text_without_marks_or_class_names():
    words = lambda w, n: " ".join([w] * n)
    menu = "".join(f"<li><a href=x>Menu entry {i}</a></li>" for i in range(30))
    body = f"<div><ul>{menu}</ul></div><div><h1>Title</h1><p>{words('word', 60)}</p><p>short</p><p>see <a href=y>there</a></p></div><div><p>Imprint</p></div>"
    want = "\n".join(("Title", words("word", 60), "short", "see there"))
    assert htmltext.main_text(f"<body>{body}</body>") == want
    assert htmltext.main_text(f"<form action=x><div><ul>{menu}</ul></div>{body}</form>") == want
    # in the body itself: from surge to dive
    assert htmltext.main_text(f"<body><ul>{menu}</ul><h1>Title</h1><p>{words('word', 60)}</p><p>short</p><ul>{menu}</ul></body>") == "\n".join(("Title", words("word", 60), "short"))


def test_main_text_class_words_spare_paragraphs():
    page = "<article><p class=ad-hoc>a</p><p class=share-price>b</p><p class=notice>c</p><div class=ad-hoc>d</div><div class=ad-slot>e</div><footer>f</footer><div class='related links'>g</div><p>h</p></article>"
    assert htmltext.main_text(page) == "a\nb\nc\nd\nh"
    assert htmltext.main_text("<form><nav>m</nav><article><p>in a form</p></article><div class=ad>x</div></form>") == "in a form"
    assert htmltext.main_text("<p>one <svg><text>no</text></svg> two</p>") == "one two"


def test_main_text_weighs_marks():
    text = "text of the page " * 40
    assert htmltext.main_text(f"<main><p>Loading</p></main><div><p>{text}</p></div>") == text.strip()
    assert htmltext.main_text(f"<main><article><p>{text}</p></article><div><p>{'other part ' * 30}</p></div></main>") == text.strip()
    assert htmltext.main_text(f"<main><p>{text}</p><article><p>teaser</p></article></main>") == text.strip()


def test_main_text_of_very_long_pages():
    deep = "<div>" * 20_000 + "<b>" * 20_000 + "<p>" + "word " * 100 + "</p>" + "</i>" * 20_000 + "</b>" * 20_000
    assert htmltext.main_text(deep) == " ".join(["word"] * 100)
    many = "".join(f"<p>{'w' * 50} {i}</p>" for i in range(50_000))
    assert htmltext.main_text(many).count("\n") == 49_999 and len(htmltext.main_text("<p " + "a='" * 100_000)) == 0


def plain_spans(weights, window, surge):
    """Runs by looking at every line anew."""
    n, out, i = len(weights), [], 0
    block = lambda i: sum(weights[i : i + window])
    while i < n:
        if block(i) >= max(1, surge):
            run = []
            while i < n and (block(i) or weights[i]):
                run.append(i)
                i += 1
            heavy = [k for k in run if weights[k]]
            out.append((heavy[0], heavy[-1] + 1))
        else:
            i += 1
    return out


def test_surge_and_dive():
    assert htmltext.spans([5, 0, 0, 0, 90, 3, 100, 0, 0, 0, 4, 0, 30, 30, 30]) == [(4, 7), (12, 15)] and htmltext.spans([]) == []
    r = random.Random(9)
    for _ in range(3000):
        weights = [r.choice([0, 0, 0, 1, 10, 40, 90]) for _ in range(r.randint(0, 25))]
        for window, surge in ((3, 80), (1, 40), (4, 1)):
            assert htmltext.spans(weights, window, surge) == plain_spans(weights, window, surge), (weights, window, surge)


def test_token_counts_of_many_pieces():
    import public_tokenizers

    own = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    pieces = sorted({"".join(r.choice(a) for _ in range(r.randint(1, 12))).encode() for a in ("ab", "the ", "éñaß", " \n", "0.-") for _ in range(300)} | {b"a" * n for n in range(1, 90)} | {b"a" * 40 + bytes([x]) * 3 for x in b"bcd"} | {b" " * 200})
    assert own.totals(pieces) == [own.prefixes(p)[1][-1] for p in pieces]
    # a word is worked out once, whatever follows it
    asked, totals = [], own.totals
    own.totals = lambda ps: asked.extend(ps) or totals(ps)
    texts = ["The wordé, wordé. wordé", "wordé.", "x wordé! wordé,, ª. µ, don't, a.b ñ,\nñ"]
    assert own.counts(texts) == [len(own.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.counts([" wordé, wordé"]) == [len(own.library.encode(" wordé, wordé", add_special_tokens=False).ids)] and asked.count(" wordé".encode()) == 1


def test_parts_are_looked_up_once():
    import gc

    import public_tokenizers

    class Memory(dict):
        def __getitem__(self, key):
            raise AssertionError("a second look")

    own = wavelet.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    own.known = Memory()
    texts = ["One two, two. THREE three", "", "  one\tfour, naïve. яж яж", "one two three"] + [t for t in HARD if t]
    want = [own.raw(own.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.encode(texts) == want and own.encode(texts[::-1]) == want[::-1] and type(own.known) is Memory and gc.isenabled()


def test_words_of_letters_need_merges_only():
    import public_tokenizers

    own = wavelet.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    letters = "".join(c for c in map(chr, range(256)) if c.isalpha() and c.islower())
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(3000)] + list(letters) + ["a" * 3000]
    odd = ["it's", "ABC", "É", "<|endoftext|>", "<|ENDOFTEXT|>", "a\xa0b", "a\x85b", "a\x0bb\x0cc", "a\x1cb", "x1", "ﬁ", "e\u0301", "яж", "İ", "a\xadb", "s't", " ", "", "Σ,", "naïve.", "ª"]
    texts = [" ".join(r.choice(words if r.random() < 0.9 else odd) for _ in range(r.randint(0, 40))) for _ in range(400)] + odd + words
    want = [own.raw(own.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.encode(texts) == want and own.encode(texts[::-1]) == want[::-1]
    asked, library = [], own.library

    class Asked:
        def encode(self, text, **more):
            asked.append(text)
            return library.encode(text, **more)

    own.library, own.known, own.old = Asked(), {}, {}
    assert own.encode(words) == want[-len(words) :] and asked == []


def test_words_are_known_whatever_stands_beside_them():
    import public_tokenizers

    own = wavelet.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    r, library = random.Random(7), own.library
    signs = [chr(c) for c in range(256)] + list("''<|><|endoftext|>é") + ["’", "я", "İ", "\u0301", "\u3000", "ﬁ", "𝔸"]
    odd = ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    texts = odd + [" ".join(r.sample(odd, 20)) for _ in range(200)] + ["it's IT'S 's 'll''ve x'S", "<|endoftext|>a <|ENDOFTEXT|>", "½²³a1b2²", "ªºµ×÷ß"]
    want = [own.raw(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want and own.encode(texts[::-1]) == want[::-1]
    # plain parts share the ids of their words, and need neither normaliser nor patterns
    texts = ["wordé (wordé) wordé%%% wordé.!! wordé-7wordé; WORDÉ,, 14.49.253.103", "[wordé]"]
    want, asked, merge = [own.raw(library.encode(t, add_special_tokens=False).ids) for t in texts], [], own.merge
    own.library, own.known, own.old, own.merge = None, {}, {}, lambda words: asked.extend(words) or merge(words)
    assert own.encode(texts) == want and asked.count("wordé") == 1 and len(asked) == len(set(asked))


def test_memory_of_words_goes_by_generations(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(wavelet, "CACHE", 40)
    own = wavelet.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(8)
    words = ["".join(r.choice("abcé.5'я") for _ in range(r.randint(1, 4))) for _ in range(200)]
    for _ in range(60):
        texts = [" ".join(r.choices(words, k=12)) for _ in range(r.randint(0, 3))]
        assert own.encode(texts) == [own.raw(own.library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert len(own.known) <= 20 and len(own.table) == len(own.known)


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_hard_texts(spark):
    rows = [(i, t, None if i == 5 else "xx" if i % 2 else "yy", 0.5) for i, t in enumerate(HARD)] + [(None, "word", "xx", 0.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    got = langid.identify(df).collect()
    letters = {r[0]: bool(r[1]) and any(c.isalpha() for c in r[1]) for r in rows}  # isalpha is category L
    assert len(got) == len(rows) and all((r["lang_pred"] in ("xx", "yy")) == letters[r["doc_id"]] for r in got)
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).collect() == []


def test_language_keeps_words_of_rare_languages(spark):
    word = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(4))
    rows = [(i, " ".join(word(40 * i + j) for j in range(40)) * 2, "big") for i in range(700)] + [(1000 + i, "seldom spoken", "rare") for i in range(1)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), F.col("doc_id"))
    own = langid.Identifier(model)
    assert len(own.base) > 27_000 and {"seldom", "spoken"} < set(own.base)
    assert own.predict("spoken")[0] == "rare" and own.predict("qspokenq")[0] == "rare" and own.predict(rows[0][1])[0] == "big"


def test_language_model_is_held_in_arrays(spark):
    import pyarrow as pa

    words = sorted(["a", "b", "é", "ab", "яж", "abé", "z" * 5000, "zz"], key=lambda w: (len(w.encode()), w.encode()))
    held = langid.Words(pa.array([w.encode() for w in words], pa.binary()))
    assert [held.place(w) for w in words] == list(range(len(words))) and list(held) == words
    assert all(held.place(w) is None for w in ("c", "A", "ac", "яз", "z" * 4999, "q" * 77)) and langid.Words(pa.array([], pa.binary())).place("a") is None
    model = langid.fit(spark.createDataFrame([(1, "one two three", "aa"), (2, "eins zwei drei", "bb")], "doc_id bigint, text string, lang string"), F.lit(True), F.col("doc_id"))
    own = langid.Identifier(model)
    assert not own.index and len(own.base) == 6
    assert own.predict("two two unknown")[0] == "aa" and set(own.index) == {"two", "unknown"}


def plain_language(rows, text):
    """Scores a text by counting all words and n-grams of the labelled rows anew."""
    import unicodedata
    from collections import Counter, defaultdict

    letters = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()
    docs = Counter(lang for _, lang in rows)
    langs = sorted(docs, key=lambda x: (-docs[x], x))
    counts = defaultdict(lambda: defaultdict(Counter))
    for t, lang in rows:
        for w in letters(t):
            counts[0][w][lang] += 1
            m = f"^{w}$"
            for k in range(1, 6):
                for g in (m[i : i + k] for i in range(len(m) - k + 1)):
                    if g not in "^$":
                        counts[k][g][lang] += 1
    size = {(k, x): sum(c[x] + 0.5 for c in counts[k].values()) for k in counts for x in langs}
    log = lambda k, e, x: np.log((counts[k][e][x] + 0.5) / size[k, x])
    total, found = dict.fromkeys(langs, 0.0), letters(text or "")
    for w in found:
        m = f"^{w}$"
        for k in (0, 5, 4, 3, 2, 1):
            known = [e for e in ([w] if k == 0 else [m[i : i + k] for i in range(len(m) - k + 1)]) if e in counts[k]]
            if known:
                for x in langs:
                    total[x] += np.mean([log(k, e, x) for e in known])
                break
    if not found:
        return "und", 0.0
    best = max(langs, key=lambda x: total[x])
    return best, 1 / sum(np.exp((total[x] - total[best]) / len(found) ** 0.5) for x in langs)


def test_language_by_brute_force(spark):
    r = random.Random(4)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(1, 7)))
    alphabets = {"aa": "abcdeß", "bb": "defghé", "cc": "ghiaяж"}
    rows = [(" ".join(word(alphabets[x]) for _ in range(30)), x) for x in ("aa", "aa", "bb", "bb", "bb", "cc") for _ in range(4)] + [("½ Ⅷ x" + "z" * 9000 + "ab", "cc"), ("tie", "aa"), ("tie", "bb")]
    model = langid.fit(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id bigint, text string, lang string"), F.lit(True), F.col("doc_id"))
    own = langid.Identifier(model)
    asked = HARD + ["½", "² ①", "Ⅷ", "½a", "tie", "z" * 5000, "xzab", "QWV", "д"] + [" ".join(word("".join(alphabets.values())) for _ in range(r.randint(1, 40))) for _ in range(60)]
    for t in asked:
        (a, x), (b, y) = own.predict(t), plain_language(rows, t)
        assert a == b and abs(x - y) < 1e-9, (t, a, x, b, y)
    assert own.predict("½")[0] == own.predict("² ① Ⅷ")[0] == "und" and own.predict("word " * 300_000)[0] in alphabets


@pytest.fixture(scope="module")
def texts():
    return HARD + [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' LIMIT 40").fetchall()]


def test_token_counts(spark, texts):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    own = token_counts.PrefixCounter(path)
    plain = lambda t: len(own.library.encode(t or "", add_special_tokens=False).ids)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    for r in token_counts.token_counts(df, path, limit=20).collect():
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), plain(t), plain(t) > 20)
        assert r["fit_chars"] == (len(t) if plain(t) <= 20 else max(i for i in range(min(len(t), 400)) if plain(t[:i]) <= 20))
    r = random.Random(7)
    mixed = ["".join(r.choice(["a", "word", " ", "  ", "\n", "'", "'ll", "'re", "12", "!", "é", "日本", "<|endoftext|>", "<|endo", "\x1c", "\u0301", "\t "]) for _ in range(r.randint(1, 25))) for _ in range(150)]
    for t in [*filter(None, HARD), *mixed]:
        table = own.table(t)
        counts = [plain(t[:i]) for i in range(len(t) + 1)]
        assert [table.at(i) for i in range(len(t) + 1)] == counts, t
        for b in (0, 1, 3, 10):
            assert table.fit(b) == max(i for i, n in enumerate(counts) if n <= b)
            n, fit = own.fits([t], b)[0]
            assert n == counts[-1] and fit == table.fit(b), (t, b)
    assert token_counts.token_counts(df.limit(0), path).collect() == []


def test_wavelet_matrix():
    r = np.random.default_rng(4)
    for ids in (np.array([], int), np.array([0, 0]), np.array([5]), r.integers(0, 49408, 3000), r.integers(0, 3, 2000), r.integers(0, 1 << 20, 500)):
        w, lengths = wavelet.unpack(wavelet.pack(ids, np.array([len(ids)])))
        assert (w.ids() == ids).all() and lengths.tolist() == [len(ids)]
        for i in range(0, len(ids), 97):
            v = int(ids[i])
            assert w.access(i) == v and w.rank(v, i) == (ids[:i] == v).sum() and w.count(v) == (ids == v).sum() and w.select(v, w.rank(v, i)) == i
        assert w.count(1 << 21) == 0 and w.select(int(ids[0]) if len(ids) else 0, len(ids)) == -1


def test_wavelet_file_inflates_what_it_needs():
    r = np.random.default_rng(6)
    ids = r.integers(0, 1 << 12, 5 * wavelet.BLOCK + 77)
    w, _ = wavelet.unpack(wavelet.pack(ids, np.array([len(ids)])))
    inflated = []
    held = w.block
    w.block = lambda level, c: inflated.append((level, c)) or held(level, c)
    assert w.access(3 * wavelet.BLOCK + 5) == ids[3 * wavelet.BLOCK + 5] and len(set(inflated)) <= w.width
    v = int(ids[-1])
    assert w.count(v) == (ids == v).sum() and w.rank(v, len(ids) - 1) == (ids[:-1] == v).sum() and w.select(v, w.count(v) - 1) == len(ids) - 1
    for i in (0, wavelet.BLOCK - 1, wavelet.BLOCK, len(ids) - 1):
        assert w.access(i) == ids[i]
    assert (w.ids() == ids).all()


def test_token_output(spark, texts):
    path = queries.tokenizer_file("word_bpe_49k.json")
    library = wavelet.Encoder(path).library
    rows = [((i * 7) % 1000 if i else None, t, 3) for i, t in enumerate(texts)] + [(7, texts[1], 3)]
    got = wavelet.token_output(spark.createDataFrame(rows, "doc_id bigint, text string, start int"), path).collect()
    ids = sorted(((-1 if d is None else d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in rows))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    numbers = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert numbers == sorted(numbers)
    assert wavelet.token_output(spark.createDataFrame([], "doc_id bigint, text string"), path).collect() == []


def test_shards_split_at_documents(spark, tmp_path, texts):
    path = queries.tokenizer_file("word_bpe_49k.json")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    shards = wavelet.write_shards(df, path, f"file://{tmp_path}/w", shard_ids=50)
    assert shards.count() > 4
    once, split = wavelet.token_output(df, path), wavelet.read_documents(shards)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, split.collect()))


def test_licences(spark):
    mit = licences.KNOWN["MIT"]
    same = mit.upper().replace("Copyright (c) <year> <holder>", "").replace("COPYRIGHT (C) <YEAR> <HOLDER>", "Copyright 2020 Someone\n(c) 1999 Other")
    rows = [(1, mit), (2, same), (3, mit.replace("sublicense", "sub-license").replace("License", "Licence")), (4, mit + " but"), (5, None), (6, " .,"), (7, "Released under the MIT licence"), (7, "Released under the MIT licence"), (None, mit)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, digest string")
    got = sorted(((r["doc_id"] or 0, r["license_id"], r["is_license"]) for r in licences.lookup(df, licences.known_licences(spark)).collect()), key=str)
    assert got == sorted([(1, "MIT", True), (2, "MIT", True), (3, "MIT", True), (4, None, False), (5, None, False), (6, None, False), (7, "MIT-notice", True), (7, "MIT-notice", True), (0, "MIT", True)], key=str)
    assert licences.lookup(df.limit(0), licences.known_licences(spark)).collect() == []


def test_licences_of_whole_texts_and_titles(spark):
    mit, bsd = licences.KNOWN["MIT"], licences.KNOWN["BSD-2-Clause"]
    gpl, apache = ((licences.TEXTS / f"{n}.txt").read_text() for n in ("GPL-3.0", "Apache-2.0"))
    want = [
        (mit.removeprefix("MIT License"), "MIT"), ("The MIT License (MIT)" + mit.removeprefix("MIT License"), "MIT"), ("BSD 2-Clause License\n\n" + bsd, "BSD-2-Clause"), ("zlib License\n" + licences.KNOWN["Zlib"], "Zlib"),
        (gpl, "GPL-3.0"), (gpl.split("How to Apply These")[0], "GPL-3.0"), (apache, "Apache-2.0"), (apache.split("APPENDIX:")[0].upper(), "Apache-2.0"), (gpl[: len(gpl) // 2], None), ((licences.TEXTS / "Unlicense.txt").read_text(), "Unlicense"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["license_id"] for r in licences.lookup(df, licences.known_licences(spark)).collect()} == {i: w for i, (_, w) in enumerate(want)}


def test_random_wavelets_agree_with_lists():
    r = random.Random(1)
    ids = np.array([r.choice([3, 9, 70, 4000]) for _ in range(1500)])
    w = wavelet.WaveletMatrix.of(ids)
    for v in (3, 9, 70, 4000, 5):
        places = np.flatnonzero(ids == v)
        assert [w.select(v, k) for k in range(0, len(places), 50)] == places[::50].tolist()
