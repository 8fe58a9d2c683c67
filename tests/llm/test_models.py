import itertools
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import gbt, html_extract, quality, toxicity

DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def tables(spark, *names):
    return [spark.read.parquet(f"{DIR}/{n}.parquet") for n in names]


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = np.column_stack([r.normal(size=(2000, 4)), r.integers(0, 2, 2000)])
    y = ((x[:, 0] > 0) ^ (x[:, 4] > 0)).astype(float)
    forest = gbt.fit(x[:1500], y[:1500], trees=40, depth=3)
    assert ((forest.probability(x[1500:]) > 0.5) == (y[1500:] > 0.5)).mean() > 0.97
    slow = forest.base + np.zeros(50)
    for t in range(len(forest.feature)):
        for i in range(50):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + int(x[i, forest.feature[t, node]] > forest.threshold[t, node])
            slow[i] += forest.value[t, node - forest.feature.shape[1]]
    assert np.allclose(slow, forest.logit(x[:50]))
    for y in (np.zeros(10), np.ones(10)):
        p = gbt.fit(x[:10], y).probability(x[:5])
        assert (abs(p - y[:5]) < 0.1).all()
    assert gbt.fit(x[:0], y[:0]).probability(x[:2]).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = tables(spark, "documents", "labels")
    got = module.digest(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    known = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (known.predicted == known[label]).mean() >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_model_edges(spark, module):
    odd = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (3, "word " * 200_000), (3, "word"), (4, "퟿\U0001f600 1d10t")], DOCS).select("*", F.lit(1).alias("y"), F.lit(2).alias("score"), F.lit("z").alias("source"))
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in module.digest(odd, none).collect()} == {0.5}
    few = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 7, 7), (3, 1, 0)], LABELS)
    assert all(0 <= r["score"] <= 1 for r in module.digest(odd, few).collect())
    assert module.digest(odd.limit(0), few).collect() == []


def test_keep_good(spark):
    docs, labels = tables(spark, "documents", "labels")
    docs = docs.withColumn("y", F.lit(1))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    scores = quality.digest(docs, labels)
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in scores.where("predicted = 1").select("doc_id").collect()}


@pytest.fixture(scope="module")
def reader(spark):
    docs, labels = tables(spark, "documents", "labels")
    model = toxicity.char_model(toxicity.count_ngrams(docs))
    fitted = toxicity.fit(docs, labels, model)
    return toxicity.Reader(model, fitted.lexicon), fitted


def test_counts_cover_the_corpus(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "AB ab"), (3, None)], DOCS)
    n = toxicity.count_ngrams(docs).reshape((toxicity.SIZE,) * 4)
    assert n[0, 0, 1, 2] == 3 and n[0, 0, 0, 1] == 3 and n[0, 1, 2, 0] == 3
    assert np.allclose(np.exp(toxicity.char_model(n.reshape(-1))).sum(axis=-1), 1, atol=1e-3)


@pytest.mark.parametrize("disguise", ["1d10t", "i d i o t", "i.d.i.o.t", "i-d-i-o-t", "idiooot", "st*pid", "5tupid", "$cum", "l0$er", "trrraaash", "m0r0n", "cl0wn"])
def test_disguises_are_seen_through(reader, disguise):
    r, fitted = reader
    assert fitted.forest.probability(np.array([r.hits(f"and the {disguise} was there.")]))[0] > 0.5


@pytest.mark.parametrize("disguise", ['"$tupid"', "($tupid)", '"$cum".', "worthle$$.", "worthle$$!!", "(worthle$$)", "*diot", "idio*", "\u201c$tupid\u201d,", "[l0$er]!!", "tra$h?!"])
def test_signs_at_the_edges_are_letters(reader, disguise):
    r, fitted = reader
    assert fitted.forest.probability(np.array([r.hits(f"and the {disguise} was there.")]))[0] > 0.5


def test_restored_words_meet_beginnings():
    lexicon = toxicity.Lexicon({"worthles": 5.0})
    assert lexicon.best([""], ["worthles"]) == ("worthles", 5.0) and lexicon.best(["worthles"], []) is None


def test_plain_words_are_not_decoded():
    """They take a lookup alone and no place in the decoder; what is read is what the longer way gives."""
    lexicon = toxicity.Lexicon({"=idiot": 2.0, "idio": 1.0, "=ab": 3.0, "worthles": 5.0})
    reader = toxicity.Reader(np.full((toxicity.SIZE,) * 4, -3.0, np.float32), lexicon)
    decoder = reader.decoder
    decoder.known.clear()
    plain = ["idiot", "[idiot]", "idiots,", "idi", "ab", "a", "été.", "worthless;", "ii", "other", "„aab“", "aabbcc"]
    for token in plain:
        assert reader[token] == lexicon.best([toxicity.core_of(token)], []) and decoder.readings(token) == (toxicity.core_of(token),), token
        assert not toxicity.forms(token), token
    assert not decoder.known and dict(reader.words(" ".join(plain)))["idiot"] == 2
    odd = ["id1ot", "idiiiot.", "idiot***", "idiot!", "(idiot", "@", "12", "...", "", "x1", "i.d", "éé3", "idiot$,"]
    assert all((toxicity.plain_word(t) == "") == (bool(toxicity.forms(t)) or not toxicity.core_of(t).isalpha()) for t in plain + odd)
    assert [reader[t] for t in odd] == [lexicon.best([decoder.readings(t)[0]], list(decoder.readings(t)[1:])) for t in odd] and set(decoder.known) <= set(odd)
    spaced = ["a b c", "x a-b.c!", "a b cd", "i.d.i", "e f g, h", "no", "u *s *t", "a b  c", "k\nl m n"]
    for text in spaced:
        assert toxicity.SPACED_END.search(text) or not toxicity.SPACED.search(text), text


def test_ngrams_of_many_texts():
    """Counted at once as one by one, whatever ends or begins a text."""
    texts = ["The cat", " a  b ", "", None, "\n", "été ЖЖ x", "a", "İ\ud800b", "xyz " * 50]
    alone = sum(toxicity.ngrams_of([t]) for t in texts if t)
    for most in (1, 20, 1000):
        parts = list(toxicity.chunks(texts, most))
        assert [t for p in parts for t in p] == [t for t in texts if t]
        assert (sum(map(toxicity.ngrams_of, parts)) == alone).all()
    assert alone.sum() == sum(len(t.lower()) + 1 for t in texts if t) and not list(toxicity.chunks(["", None], 5))


def test_edges_reach_the_lattice(spark):
    words = "stupid scum trass worthless ass asshole fuck shit idiot cunt"
    decoder = toxicity.Decoder(toxicity.char_model(toxicity.count_ngrams(spark.createDataFrame([(1, f"{words} " * 300)], DOCS))))
    wanted = {'"$tupid"': "stupid", "($tupid)": "stupid", '"$cum".': "scum", "tra$$.": "trass", "worthle$$.": "worthless", "worthle$$!!": "worthless", "a$$.": "ass", "@$$hole": "asshole", "*diot": "idiot", "idio*": "idiot", "(unt": "cunt", "((unt)": "cunt"}
    for token, word in wanted.items():
        assert word in decoder.readings(token)[1:], token
    for token in ("f***", "sh***", '"f***!"', "(sh***)."):
        assert toxicity.disguised(token) == token.strip('"!().') and len(decoder.readings(token)) > 1, token
    for token in ("word", "word.", '"word"', "(word)", "word!", "word?!", "word(", "\u201cword\u201d,"):
        assert toxicity.disguised(token) == "" and toxicity.restore(token, decoder) == token, token


@pytest.mark.parametrize("disguise", ["m***n", "tr**h", "st**id", "idi**", "m*r*n", "cl**n"])
def test_many_masks_are_seen_through(reader, disguise):
    r, fitted = reader
    assert fitted.forest.probability(np.array([r.hits(f"and the {disguise} was there.")]))[0] > 0.5


def test_no_history_is_pruned(reader, monkeypatch):
    """Against a search of all readings: a letter for each mask, one for a run, or a break."""
    decoder = reader[0].decoder
    flat, letters = decoder.flat, toxicity.LETTERS[::3]
    monkeypatch.setattr(toxicity, "LETTERS", letters)

    def cost(text):
        s, k = 0.0, 0
        for ch in text + " ":
            code = k * toxicity.SIZE + toxicity.symbol(ch)
            s, k = s - flat[code], code % toxicity.SIZE**3 if ch != " " else 0
        return s

    def runs(raw):
        if not raw:
            yield "", 0.0
            return
        ch, n = raw[0], len(raw) - len(raw.lstrip(raw[0]))
        here = [(ch * n, 0.0)]
        if ch in toxicity.MASKS:
            here = [(" ", toxicity.DROP), *((a, toxicity.MASK * n) for a in letters), *(("".join(x), toxicity.MASK) for x in itertools.product(letters, repeat=n))]
        for text, c in runs(raw[n:]):
            yield from ((out + text, c + d) for out, d in here)

    for raw in ("m****n", "m*g*d*n", "s***d", "*#*#", "p**s", "g#*s*"):
        best = min(c + cost(text) for text, c in runs(raw))
        states = decoder.decode(raw)
        for few in (0, 10**9):
            decoder.FEW = few
            assert decoder.decode(raw) == states
        del decoder.FEW
        assert min(c + cost(text) for text, c in runs(raw) if text.strip() == states) <= best + 1e-6, (raw, states)


def test_spaced_words_of_two_letters(spark):
    decoder = toxicity.Decoder(toxicity.char_model(toxicity.count_ngrams(spark.createDataFrame([(1, "the ass and a mass " * 300)], DOCS))))
    assert "ass" in decoder.spaced("what an a s s he is") and "ass" in decoder.spaced("a.s.s") and decoder.spaced("a a a a") == []


def test_masks_that_end_a_word_read_as_step_by_step(reader):
    decoder = reader[0].decoder
    for raw in ("stup***", "id**", "w0rth***", "tr**h##", "***", "a" + "*" * 30):
        states, i = {0: (0.0, None)}, 0
        while i < len(raw):  # the same steps with no look-up of the end
            n = len(raw[i:]) - len(raw[i:].lstrip(raw[i]))
            ch = raw[i]
            options = [(a * m, toxicity.SIGN * n + (toxicity.PAIR if m < n == 2 else 0.0)) for a in toxicity.LEET[ch] for m in {1, min(n, 2)}] + [(" ", toxicity.DROP)] if ch in toxicity.LEET else [(ch * n, 0.0)] + [(ch * m, toxicity.RUN if n > 2 else toxicity.PAIR) for m in (1, 2) if m < n]
            states = decoder.masked(states, n) if ch in toxicity.MASKS else decoder.step(states, options)
            i += n
        wide = toxicity.Wide.of(decoder.step(states, [(" ", 0.0)]))
        assert decoder.decode(raw) == toxicity.spelled(*wide.linked(0)).strip(), raw


def test_plain_text_is_left_alone(reader):
    r, fitted = reader
    for text in ("a a a a a", "version 4.0 of 2.0, see 3.", "password=e3b3ed3cc8548923d6", "hello!!! $$$ *** ###", "a b c d e f g", ""):
        assert fitted.forest.probability(np.array([r.hits(text)]))[0] < 0.5, text
    assert toxicity.restore("plain words, as they stand.\n and spaces", r.decoder) == "plain words, as they stand.\n and spaces"
    assert toxicity.restore("the 1d10t  is here", r.decoder) == "the idiot  is here"


PAGE = '<html><body><header class="site-header"><a href="/">Home</a></header><div class="cookie-notice"><p>We use cookies.</p></div><div class="post-content"><h1>A&amp;B &lt;title&gt;</h1><p>First paragraph   of the\n article, with enough words.<div class="ad">Buy now, it is great.</div><p>Second paragraph, also with words.<script>var t = "</p>";</script></div><section id="comments"><div class="comment"><p>Nice article, I liked it very much.</p></div></section><form><label>Mail</label></form><footer>&copy; all rights'


@pytest.fixture(scope="module")
def extractor(spark):
    return html_extract.fit(tables(spark, "pages")[0])


def test_pages(spark):
    pages = tables(spark, "pages")[0]
    forest = html_extract.fit(pages)
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "just text"), (5, "u", "<p>" * 3000 + "deep and long, with words."), (5, "u", "<<<>>> </p> <a <b"), (6, "u", "<!-- open"), (7, "u", "<script>never closed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("n_chars"))
    got = html_extract.extract(df, forest).collect()
    assert len(got) == len(rows) and got[0]["text"] == "A&B <title>\nFirst paragraph of the article, with enough words.\nSecond paragraph, also with words."
    assert all(r["n_chars"] == len(r["text"]) for r in got) and got[1]["text"] == got[2]["text"] == got[7]["text"] == ""
    assert html_extract.extract(df.limit(0)).collect() == []


def test_article_of_every_page_is_exact(spark):
    source = pq.read_table(f"{DIR}/pages.parquet").to_pandas()
    forest = html_extract.fit(tables(spark, "pages")[0])
    for html, text in zip(source.html, html_extract.main_text(list(source.html), forest)):
        start = html.index("<article>")
        nodes, blocks = html_extract.parse(html)
        assert text == "\n".join(t for n, t in blocks if "article" in n.holders) and start > 0


def test_layouts_not_seen_in_fitting(spark):
    forest = html_extract.fit(tables(spark, "pages")[0])
    exact = 0
    for seed in range(50_000, 50_060):
        source, texts = html_extract.layout(seed)
        _, blocks = html_extract.parse(source)
        exact += html_extract.main_text([source], forest)[0].split("\n") == [t for _, t in blocks if t in texts]
    assert exact >= 54


def test_decoding_never_goes_back(spark):
    r = np.random.default_rng(1)
    for seed in range(30):
        nodes, _ = html_extract.parse(html_extract.layout(seed)[0])
        content = html_extract.decode(nodes, r.normal(size=len(nodes)) * 3)
        for n in nodes:
            path = []
            while n:
                path.append(id(n) in content)
                n = n.parent
            assert sum(a != b for a, b in zip(path, path[1:])) <= 2 and (not path[-1] or sum(a != b for a, b in zip(path, path[1:])) <= 1)


#: Pages written by hand: html and the text that is wanted.
WRITTEN = {
    "more": (
        '<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>First paragraph with enough words to count, it goes on.</p><p class="more text">A further paragraph, with words that matter, here.</p><p class="legal-case">The court held, in this case, that it was so.</p></article><footer>Copyright Acme</footer></body>',
        'Title of it\nFirst paragraph with enough words to count, it goes on.\nA further paragraph, with words that matter, here.\nThe court held, in this case, that it was so.',
    ),
    "cookie": (
        '<body><div class="x1"><p>We use cookies to improve this site.</p></div><div class="x2"><h1>The title here</h1><p>First paragraph with enough words to count, it goes on and on, for a while.</p><p>Second paragraph with enough words to count, it goes on and on, for a while.</p></div><div class="x3"><a href=/a>About</a> <a href=/b>Contact</a> Copyright Acme</div></body>',
        'The title here\nFirst paragraph with enough words to count, it goes on and on, for a while.\nSecond paragraph with enough words to count, it goes on and on, for a while.',
    ),
    "werbung": (
        '<body><article><h1>Der Titel</h1><p>Erster Absatz mit genug Worten, der weiter geht, und weiter.</p><div class="werbung">Jetzt kaufen und sparen</div><p>Zweiter Absatz mit genug Worten, der weiter geht, und weiter.</p></article></body>',
        'Der Titel\nErster Absatz mit genug Worten, der weiter geht, und weiter.\nZweiter Absatz mit genug Worten, der weiter geht, und weiter.',
    ),
    "script": (
        '<article><p>Alpha beta <script>x=1</script>gamma delta.</p><p>One <input name=q>two <svg><path d="M0"/><text>no</text></svg>three, and so on it goes.</p></article>',
        'Alpha beta gamma delta.\nOne two three, and so on it goes.',
    ),
    "math": (
        '<article><p>The formula <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is short, as we see.</p></article>',
        'The formula x+1 is short, as we see.',
    ),
    "comment": (
        '<body><article><h1>A story of old</h1><p>First paragraph with enough words to count, it goes on and on, for a while.</p><p>Second paragraph with enough words to count, it goes on and on, for a while.</p></article><section class="reader-comments"><h3>Anna Smith</h3><p>I liked this one, thanks.</p><h3>Bob</h3><p>Not me, sorry.</p></section></body>',
        'A story of old\nFirst paragraph with enough words to count, it goes on and on, for a while.\nSecond paragraph with enough words to count, it goes on and on, for a while.',
    ),
    "apostrophe": (
        "<div data-x=it's><p>Hello world one.</p></div><p>Second it's here.</p>",
        "Hello world one.\nSecond it's here.",
    ),
}


@pytest.mark.parametrize("name", WRITTEN)
def test_pages_written_by_hand(extractor, name):
    source, text = WRITTEN[name]
    assert html_extract.main_text([source], extractor) == [text]


def test_names_that_were_never_met(extractor):
    """Structure alone has to tell where no mark is known."""
    prose = [f"Paragraph {i} of the story goes on for a while, with commas, and it ends here." for i in range(6)]
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    page = f"<body><div class=qqx><ul>{links}</ul></div><div class=zzy>" + "".join(f'<p class="vv{i}">{x}</p>' for i, x in enumerate(prose)) + f"</div><div class=wwk><ul>{links}</ul></div></body>"
    assert html_extract.main_text([page], extractor) == ["\n".join(prose)]


def test_reading_is_linear_in_depth(extractor):
    for source in ("<section>" * 100_000 + "deep", "<ul>" + "<div>" * 50_000 + "<li>a</li>" * 50_000, "<a b='" * 20_000, "<p " + "x=' " * 50_000, "</b></i>" * 100_000):
        began = time.monotonic()
        html_extract.main_text([source], extractor)
        assert time.monotonic() - began < 20


def test_marks_of_leaves_are_learned_from_the_pages(extractor):
    assert extractor.scores["ad"] < -1 and "qqx" not in extractor.scores
