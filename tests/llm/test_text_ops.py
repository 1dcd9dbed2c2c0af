"""Operators on single texts: tokens, BPE, HTML, network, words."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from newslens.llm import bpe_replay, bytewords, html_text, quality_cnn, token_counts
from newslens.llm.queries import BPE_FILE, UNIGRAM_FILE

ODD = ["", " ", "a", "aa  bb\n\nc ", "don't 12 ٣ ½", "漢字🙂 x\x85\xa0y\x1c", "ab" * 700, "x" * 3000, "é" * 400 + "1" * 400]


def random_texts(n, seed=3):
    r = random.Random(seed)
    letters = "abcdeé ñ 漢🙂\t\n 'sT\x85\x1c12٣.,!aaa"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(n)] + ODD


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def bpe():
    with open(P.path(BPE_FILE), "rb") as f:
        data = f.read()
    ranks = bpe_replay.parse_ranks(data)
    return bpe_replay.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(bpe):
    codec, library = bpe
    texts = random_texts(1500)
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_where_a_merge_opens_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 256, b"ab": 301, b"cab": 257, b"aa": 302, b"aaa": 258}
    codec = bpe_replay.Codec(ranks, r"\S+")
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(500)]
    assert list(codec.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_bpe_frames(spark, bpe):
    texts = random_texts(30) + [None]
    df = frame(spark, texts)
    path = P.path(BPE_FILE)
    ids = bpe_replay.encode(df, path, P.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe_replay.decode(ids, path).collect()}
    rows = {r.doc_id: r for r in bpe_replay.digests(df, path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = bpe[1].encode_ordinary(t or "")
        assert back[i] == (t or "").encode()
        assert rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_replay.digests(df.limit(0), path, P.PATTERN).count() == 0


def test_token_counts_equal_a_unigram_encoder(spark):
    vocabulary = token_counts.load_vocabulary(P.path(UNIGRAM_FILE))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path(UNIGRAM_FILE))
    library = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Replace(" ", "▁"), normalizers.Prepend("▁")])
    texts = random_texts(400) + [None]
    rows = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts), vocabulary).collect()}
    for i, t in enumerate(texts):
        assert rows[i].n_tokens == (len(library.encode(t).ids) if t else 0), t
        assert rows[i].n_chars == len(t or "")


def test_token_counts_ties_and_unknown_runs():
    # two paths of equal score: the longest last piece wins; without byte pieces a run of unknown characters is one token
    tied = token_counts.Counter(token_counts.Vocabulary([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -3.0)], True, -3.0))
    assert tied.count("ab") == 1
    plain = token_counts.Counter(token_counts.Vocabulary([("▁", -1.0), ("a", -1.0)], False, -1.0))
    assert plain.count("axxxa") == 4


def test_words_are_split_and_hashed_alike():
    texts = ["A b\ta  c", None, "", "\x0b\x1c x", "ça Ça é", "a"]
    hashes, at = bytewords.hash_words(pa.array(["skip me", *texts]).slice(1))
    words = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies to give you the best of all experiences on this web site</div>
%s<h1>Head &amp; line</h1><p>A first paragraph that is long<br>enough to be content, by <b>any</b> measure.<p>Short.</p>
<div class="ad">Buy now, this is a long advert that talks and talks about many things</div>
<p>Another   long paragraph of text, with&nbsp;spaces and a <a href=x>link</a> in the middle of it.</p>%s
<section class="comments"><p>Great article, I have read it twice and then told all my friends about it</p></section>
<aside><p>A sidebar that is as long as an ordinary paragraph of the text</p></aside><form>Name <input></form>
<script>var t = "</p>";</script><footer>&copy; all of us</footer></body></html>"""
BLOCKS = ["Head & line", "A first paragraph that is long enough to be content, by any measure.", "Short.",
          "Another long paragraph of text, with spaces and a link in the middle of it."]


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div id=text>", "</div>"), ("", "")])
def test_html_main_text(around):
    assert html_text.main_text(PAGE % around).split("\n\n") == BLOCKS


@pytest.mark.parametrize("words", ["layout has-sidebar", "content nav-open", "page header-fixed", "story related-story"])
def test_html_wrapper_with_a_boilerplate_word(words):
    assert html_text.main_text(PAGE % (f"<div class='{words}'>", "</div>")).split("\n\n") == BLOCKS
    assert html_text.main_text(f"<body><div class='{words}'><p>All the text there is.</p></div></body>") == "All the text there is."


def test_html_article_in_two_elements():
    one, two = "The first part of the text is the longer one, and says much. " * 6, "The second part is shorter, but belongs to it. " * 5
    page = f"<body><div><article><p>{one}</p></article><article><p>{two}</p></article></div><footer>Us</footer></body>"
    assert html_text.main_text(page) == f"{one.strip()}\n\n{two.strip()}"


@pytest.mark.parametrize("opens, closes", [('<section id="privacy"><h2>Privacy in the archive</h2>', "</section>"), ('<section class="social-history"><h2>Social history</h2>', "</section>"),
                                           ('<div class="related-story">', "</div>")])
def test_html_words_inside_an_article_do_not_drop_its_text(opens, closes):
    said = "This is a long paragraph of the article which says quite a lot about the matter at hand, and it goes on for a while."
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{said}</p>{opens}<p>{said} Here.</p>{closes}<p>{said}</p><div class='advert'><p>Buy now!</p></div></article></body>"
    heading = re.findall("<h2>(.*)</h2>", opens)
    assert html_text.main_text(page).split("\n\n") == ["Title", said, *heading, f"{said} Here.", said]


def test_html_cases(spark):
    pages = [None, "", "<html><body></body></html>", "plain", "<div>" * 30000 + "deep", "<nav><a href=x>menu<article><p>Unclosed menu before the text.</p></article>"]
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate(pages)], "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in html_text.extract(df).collect()}
    assert [rows[i].text for i in range(6)] == ["", "", "", "plain", "deep", "Unclosed menu before the text."]
    assert rows[3].n_chars == 5 and html_text.extract(df.limit(0)).count() == 0


def test_network_gradient():
    rng = np.random.default_rng(0)
    p = {"tables": rng.normal(0, 0.3, (quality_cnn.WIDTH, 257, quality_cnn.FILTERS)), "bias": rng.normal(0, 0.3, quality_cnn.FILTERS),
         "weights": rng.normal(0, 0.5, (3, quality_cnn.FILTERS)), "offset": np.array([0.1])}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    texts, labels, weight = [b"abcabc" * 40, b"", b"xyz" * 70, b"q"], np.array([1.0, 0, 0, 1]), np.ones(4)

    def loss(q):
        x = np.array([(f * q["weights"]).sum() + q["offset"][0] for f in features(q)])
        return float(np.mean(np.log1p(np.exp(x)) - labels * x)) + 0.5e-4 * float((q["weights"] ** 2).sum())

    def features(q):
        scorer = quality_cnn.Scorer(quality_cnn.Network(q["tables"], q["bias"], q["weights"], 0.0))
        laid, halves = quality_cnn._laid_out(texts)
        chunks, first = quality_cnn._pooled(np.tanh(scorer._highest(laid) + q["bias"]), halves)
        return quality_cnn._features(chunks, first, halves)

    grad = quality_cnn._gradient(p, texts, labels, weight)
    for name, at in (("bias", (2,)), ("weights", (1, 3)), ("offset", (0,)), ("tables", (1, ord("b"), 4))):
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-2
        up = loss(moved)
        moved[name][at] -= 2e-2
        assert grad[name][at] == pytest.approx((up - loss(moved)) / 2e-2, abs=2e-3)


def test_network_learns_and_scores_whole_texts(spark):
    r = random.Random(5)
    good = ["".join(r.choice("abcdefgh ,.") for _ in range(r.randint(50, 900))) for _ in range(120)]
    bad = [t[: len(t) // 2] + "%%%" + t[len(t) // 2 :] for t in good]
    docs = frame(spark, [*good, *bad, None, "", good[0]]).withColumnRenamed("doc_id", "id")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(5, 0), (999, 1), (None, 1)], "id bigint, label int")
    texts, y = quality_cnn.labelled_sample(docs.where("id < 240"), labels.where("id <> 5"))
    net = quality_cnn.train(texts, y)
    rows = {x.id: x for x in quality_cnn.score(docs, net).collect()}
    right = sum(rows[i].predicted == int(i < 120) for i in range(240))
    assert right >= 230 and rows[242].score == rows[0].score and rows[240].score == rows[241].score
    long = ["ab, cd. " * 40000, "ab, cd. " * 40000 + "%%%"]  # the only sign of a bad text stands at its end
    scores = quality_cnn.Scorer(net).score([t.encode() for t in long])
    assert scores[1] < scores[0]
    assert quality_cnn.keep_good(docs, net).columns == docs.columns


def test_network_without_labels():
    assert quality_cnn.Scorer(quality_cnn.train([], np.zeros(0))).score([b"", b"abc"]).tolist() == pytest.approx([0.5, 0.5])
    assert quality_cnn.Scorer(quality_cnn.train([b"x"], np.ones(1))).score([b"abc"])[0] > 0.9
