"""Language ID, language model, tokenizer and quality classifier: held-out accuracy, brute force, round trips."""
import math
import re
import struct
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from cases import awkward, table
from pyspark.sql import functions as F

from srcgraph.llm import cotrain, langid, ngram_lm, sp_codec
from srcgraph.llm.common import fold
from srcgraph.llm.elias_fano import EliasFano
from srcgraph.llm.queries import op4_lm_scoring

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# language ID

def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, fold("doc_id", 3) != 1, [F.col("lang"), (fold("doc_id", 3) == 1).alias("held")]).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held]
    assert sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_awkward(spark):
    rows = [(i, t, l, "s", 1) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 8)]
    rows += [(50, None, "en", "s", 1), (51, "", "en", "s", 1), (52, "123 !! \n", "de", "s", 1), (None, "the cat", "en", "s", 1), (53, "die Katze", None, None, None)]
    rows += [(54, "the dog and the cat " * 40000, "en", "s", 1)] * 2
    df = table(spark, rows, clash=True)
    got = langid.identify(df, F.col("doc_id") < 50, [F.col("doc_id"), F.col("text")]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[50] == by[51] == by[52] == ("und", 0.0)
    assert by[53][0] == "de" and by[54][0] == "en" and by[None][0] == "en"
    empty = table(spark, [])
    assert langid.identify(empty, F.lit(True), [F.col("doc_id")]).count() == 0
    none = langid.identify(table(spark, rows[-1:]), F.lit(False), [F.col("doc_id")]).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


def test_pieces_hold_the_same_ngrams(monkeypatch):
    for text in ("the quick brown fox " * 300, "é" * 2500, "", "a", "word " * 199 + "x"):
        whole = np.bincount(np.concatenate(list(langid.ngram_ids(text))), minlength=langid.DIMS)
        for piece in (2, 1000):
            monkeypatch.setattr(langid, "PIECE", piece)
            parts = np.bincount(np.concatenate(list(langid.ngram_ids(text))), minlength=langid.DIMS)
            assert (whole == parts).all()
        monkeypatch.undo()


def test_frequencies_and_prediction_stated_plainly(spark):
    """Document frequencies, FTRL and a prediction against loops over dictionaries."""
    texts = [("der Hund", "de"), ("die Katze und der Hund", "de"), ("the cat and", "en"), ("the dog", "en"), ("the the", "en"), ("le chat", "fr")] * 3
    rows = [(i, t, l, "s", 1) for i, (t, l) in enumerate(texts)]
    gram = lambda t: [g for p in langid.ngram_ids(t) for g in p.tolist()]
    classes = ["de", "en", "fr"]
    df, n = langid.document_frequencies(table(spark, rows), "lang", "text", classes)
    want = Counter((g, l) for t, l in texts for g in set(gram(t)))
    assert {(int(g), classes[c]): int(df[g, c]) for g, c in zip(*np.nonzero(df))} == dict(want) and n.tolist() == [6, 9, 3]
    feats = [sorted(Counter(gram(t)).items()) for t, _ in texts]
    vec = [(np.array([f for f, _ in x]), np.array([c / 10 for _, c in x])) for x in feats]
    y = np.array([classes.index(l) for _, l in texts])
    w = langid.fit_ftrl(lambda i: vec[i], y, 3, langid.DIMS, epochs=2, seed=5)
    z, m = {}, {}
    weight = lambda f, c: 0.0 if abs(z.get((f, c), 0)) <= 1e-4 else -(z[f, c] - math.copysign(1e-4, z[f, c])) / ((1 + m[f, c] ** 0.5) / 0.5 + 1e-4)
    order = np.random.default_rng(5)
    for _ in range(2):
        for i in order.permutation(len(texts)):
            x = [(f, c / 10) for f, c in feats[i]]
            now = {(f, c): weight(f, c) for f, _ in x for c in range(3)}
            e = [math.exp(sum(v * now[f, c] for f, v in x)) for c in range(3)]
            for f, v in x:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (y[i] == c))
                    old = m.get((f, c), 0.0)
                    m[f, c] = old + g * g
                    z[f, c] = z.get((f, c), 0.0) + g - (m[f, c] ** 0.5 - old ** 0.5) / 0.5 * now[f, c]
    assert all(abs(w[f, c] - weight(f, c)) < 1e-9 for f, c in z)
    model = langid.train(table(spark, rows))
    one = gram("der Katze dog")
    logits = [float(model.bias[c] + np.mean([model.table[g, c] for g in one], dtype=np.float64)) / model.temperature for c in range(3)]
    p = [math.exp(v - max(logits)) for v in logits]
    got = model.predict("der Katze dog")
    assert got[0] == classes[int(np.argmax(p))] and abs(got[1] - max(p) / sum(p)) < 1e-6


def test_long_texts_many_labels_and_unknown_languages(spark):
    en, de = "the cat and dog with that for this ", "der Hund und die Katze mit dem das "
    rows = [(i, en, "en", "s", 1) for i in range(20)] + [(i, de * 2500, "de", "s", 1) for i in range(20, 40)]
    got = langid.identify(table(spark, [*rows, (90, de, None, "s", 1), (91, de * 2500, None, "s", 1)]), F.col("lang").isNotNull(), [F.col("doc_id")])
    by = {r.doc_id: r.lang_pred for r in got.collect()}
    assert by[90] == by[91] == "de" and by[3] == "en"
    word = lambda i, k: "".join(chr(97 + (i * 7 + k * 11 + j * (i % 23 + 1)) % 26) for j in range(5))
    many = [(i, " ".join(word(i % 300, k) for k in range(12)), f"l{i % 300}", "s", 1) for i in range(1200)]
    m = langid.train(table(spark, many))
    assert len(m.classes) == 300 and m.table.size <= langid.MAX_WEIGHTS
    assert sum(m.predict(t)[0] == l for _, t, l, _, _ in many[:300]) > 200
    for n in (2, 10):  # an unlearnt language is not known, a mixture of learnt ones is
        alphabet = lambda i: "".join(chr(0x400 + 20 * i + j) for j in range(18))  # noqa: E731, B023
        r = np.random.default_rng(n)
        lexicon = {i: ["".join(r.choice(list(alphabet(i)), 4)) for _ in range(30)] for i in range(n + 2)}
        text = lambda i, k=40: " ".join(r.choice(lexicon[i], k))  # noqa: E731, B023
        learn = [(j, text(j % n), f"l{j % n}", "s", 1) for j in range(40 * n)]
        m = langid.train(table(spark, learn))
        assert all(m.predict(text(i))[2] for i in range(n)) and m.predict(text(0) + " " + text(1))[2]
        assert not m.predict(text(n + 1, 400))[2] and not m.predict("xq zj " * 400)[2] and m.predict("12 !")[0] == "und"


def test_penalty_makes_weights_sparse():
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 200)
    rows = [(np.arange(30), np.where(np.arange(30) == 0, 2.0 * k - 1, r.normal(size=30) * 0.1)) for k in y]
    w = langid.fit_ftrl(lambda i: rows[i], y, 2, 30, l1=2.0)
    assert (w[1:] == 0).mean() > 0.5 and w[0, 1] > 0 > w[0, 0]


def test_temperature():
    z = np.array([[4.0, 0.0]] * 10)
    assert langid.fit_temperature(z, np.array([0] * 7 + [1] * 3)) > 3  # 70 % right, logits say 98 %
    assert langid.fit_temperature(z, np.zeros(10, int)) < 0.2


# language model

def test_elias_fano():
    r = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 0), (1, 9), (10, 10), (3000, 2000), (5000, 2**40), (2000, 2**63)):
        v = np.sort(r.integers(0, top + 1, n, dtype=np.uint64))
        e = EliasFano.build(v)
        assert (e.access(np.arange(n)) == v).all()
        x = np.concatenate([v, r.integers(0, top + 2, 500, dtype=np.uint64), v + np.uint64(1)])
        at, found = e.successor(x)
        assert (at == np.searchsorted(v, x)).all()
        assert found.tolist() == [bool(k < n and v[k] == q) for k, q in zip(at, x)]


DISCOUNTS = (0.75, 1.1, 1.4)


def lm_tokens(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class BruteLm:
    def __init__(self, texts, least=2):
        seqs = [["<s>", *lm_tokens(t)] for t in texts]
        self.c1 = Counter(w for s in seqs for w in s[1:])
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.ctx = self.c1 + Counter({"<s>": len(seqs)})
        c2 = Counter((a, b) for s in seqs for a, b in zip(s, s[1:]))
        c3 = Counter(t for s in seqs for t in zip(s, s[1:], s[2:]))
        less = lambda c: c - DISCOUNTS[min(c, 3) - 1]
        self.a2 = {k: less(c) / self.ctx[k[0]] for k, c in c2.items() if c >= least}
        self.a3 = {k: less(c) / c2[k[:2]] for k, c in c3.items() if c >= least}
        self.b2, self.b3 = Counter(), Counter()
        for k, a in self.a2.items():
            self.b2[k[0]] += a
        for k, a in self.a3.items():
            self.b3[k[:2]] += a

    def base(self, w):
        return (self.c1[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, x, y, w):
        p = self.a2.get((y, w), 0) + (1 - self.b2[y]) * self.base(w)
        return self.a3.get((x, y, w), 0) + (1 - self.b3[x, y]) * p


@pytest.mark.parametrize("small", [False, True])
def test_language_model(spark, small):
    rows = awkward(9)[:70] + awkward(9)[80:]
    df = table(spark, rows, clash=True)
    model = ngram_lm.train(df.where(F.coalesce(fold("doc_id", 4), F.lit(1)) != 0), **(dict(words_per_part=50, tokens_per_shard=3000) if small else {}))
    assert (model.shards > 5 and len(model.starts) > 5) == small
    import zlib
    lm = BruteLm([r[1] for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4])
    got = ngram_lm.score(df, model, [F.col("doc_id"), F.col("text").alias("x")]).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {lm.n}
    for r in got:
        s = ["<s>", *lm_tokens(r.x)]
        assert r.n_tokens == len(s) - 1 and r.n_known == sum(w in lm.c1 for w in s[1:])
        assert r.base_score == pytest.approx(sum(math.log10(lm.base(w)) for w in s[1:]))
        want = sum(math.log10(lm.p(s[i - 2] if i > 1 else None, s[i - 1], s[i])) for i in range(1, len(s)))
        assert r.score == pytest.approx(want, rel=2e-4, abs=2e-3)


def test_query_keeps_ngrams_seen_once(spark, tmp_path):
    """A held-out copy of a text that stands once in training has to get that text's word order back."""
    import zlib
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 31}" for k in range(25)), "en", "a", 1) for i in range(30)]
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    table(spark, [*rows, (held, train[3][1], "en", "a", 1)]).write.parquet(str(tmp_path / "documents.parquet"))
    lm = BruteLm([r[1] for r in train], least=1)
    got = {r.doc_id: r for r in op4_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[held].held_out and got[held].n_known == 26
    for i, text in [*[r[:2] for r in rows], (held, train[3][1])]:
        s = ["<s>", *lm_tokens(text)]
        want = sum(math.log10(lm.p(s[k - 2] if k > 1 else None, s[k - 1], s[k])) for k in range(1, len(s)))
        assert got[i].score == pytest.approx(want, rel=2e-4, abs=2e-3)


def test_probabilities_sum_to_one():
    lm = BruteLm([r[1] for r in awkward(10)[:60]])
    for x, y in [(None, "<s>"), *list(lm.b3)[:20]]:
        assert sum(lm.p(x, y, w) for w in [*lm.c1, "unseen"]) == pytest.approx(1)


def test_language_model_without_texts(spark):
    df = table(spark, [(1, "a b", None, None, 1), (2, None, None, None, 1)])
    model = ngram_lm.train(df.where("false"))
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score(df, model, [F.col("doc_id")]).orderBy("doc_id").collect()] \
        == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert ngram_lm.score(table(spark, []), model, [F.col("doc_id")]).count() == 0


# tokenizer

STRANGE = ["", " ", "  a", "a  b   c ", "▁x ▁", "日本語 emoji 😀\n\ttab", "é\u0000z", "<s> <unk> <0x41>", " " * 70 + "x", "a" * 5000, "ÀÉ ñ " * 300]


def test_tokens_equal_sentencepiece(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(STRANGE)] + awkward(11) + [(999, "long text of many words. " * 60000, "en", "a", 1)]
    df = table(spark, rows, clash=True)
    e = sp_codec.encode(df, MODEL, [F.col("doc_id"), F.col("text"), F.col("kept")])
    got = sp_codec.decode(e, MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == sp.encode(r.text or "") and r.parity and r.round_trip
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert sp_codec.encode(table(spark, []), MODEL, [F.col("doc_id")]).count() == 0


def _message(*fields):
    out = b""
    for number, v in fields:
        if isinstance(v, int):
            out += bytes([number << 3 & 127 | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([v])
        elif isinstance(v, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", v)
        else:
            n = len(v)
            out += bytes([number << 3 | 2]) + (bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])) + v
    return out


@pytest.mark.parametrize("trim", [0, 1])
def test_unigram_model_from_its_protobuf(trim):
    """A hand-made unigram model with byte fallback: scores, marker and fallback have to give sentencepiece's ids."""
    import sentencepiece
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -3.0, 1), ("▁the", -2.0, 1), ("he", -4.0, 1), ("t", -5.0, 1), ("h", -5.1, 1), ("e", -5.2, 1), ("▁t", -3.5, 1), ("cat", -4.5, 1),
               ("c", -6.0, 1), ("a", -6.1, 1), ("at", -5.5, 1), ("▁ca", -5.9, 1), ("s", -6.2, 1)]
    raw = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    raw += _message((2, _message((3, 1), (35, 1)))) + _message((3, _message((1, b"identity"), (3, 1), (4, trim), (5, 1))))
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    c = sp_codec.Codec(raw)
    texts = ["the cat", "the  cats hat", " the", "teach the cat é!", "", "x", "the cat " * 50]
    assert list(c.encode(texts)) == sp.encode(texts)
    assert c.decode(sp.encode(texts)) == sp.decode(sp.encode(texts))


def test_cut_keeps_text_and_ids(monkeypatch):
    text = "some  words   and more " * 50
    parts = sp_codec.cut(text, 64)
    assert len(parts) > 5 and "".join(parts) == text
    c = sp_codec.Codec(Path(MODEL).read_bytes())
    want = c.sp.encode(text)
    monkeypatch.setattr(sp_codec, "BATCH_CHARS", 64)
    assert list(c.encode([text, "a b"])) == [want, c.sp.encode("a b")]


# quality classifier

def test_quality_classifier(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = labels.where(fold("doc_id", 2) == 0)
    model = cotrain.train(docs, learn, pool_rows=300)
    got = cotrain.score(docs, model, [F.col("doc_id")])
    assert got.count() == docs.count()
    held = got.join(labels.where(fold("doc_id", 2) == 1), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in held) > 0.95 * len(held)
    good = [r.kept for r in held if r.quality == 1]
    assert sum(good) > 0.97 * len(good)


def test_views_exchange_labels():
    """The metadata view starts from few labels; the text view's pseudo-labels teach it what they never showed."""
    r = np.random.default_rng(3)
    y = np.arange(80) % 2
    make = lambda k, s: (cotrain.text_features(("good words here " if k else "# | # | ") * 20 + str(r.random())), cotrain.meta_features(s, "en", 10))
    rows = [make(k, "seen") for k in y]
    pool = [make(i % 2, "bad host" if i % 2 == 0 else "good host") for i in range(200)]
    v = cotrain.co_train(rows, y, pool)
    assert v.scores("good words here", "good host", "en", 10)[1] > v.scores("good words here", "bad host", "en", 10)[1] + 0.05
    alone = cotrain.co_train(rows, y, pool, rounds=0)
    assert abs(alone.scores("x", "good host", "en", 10)[1] - alone.scores("x", "bad host", "en", 10)[1]) < 1e-6


def test_pseudo_labels_from_the_whole_table(spark):
    """Few of many unlabelled rows are clear, and only they have the hosts: a small fixed draw does not meet them."""
    r = np.random.default_rng(4)
    text = lambda k: ("good words here " if k else "# | # | ") * 20 + str(r.random())
    rows = [(i, text(i % 2), "en", "seen", 10) for i in range(80)]
    rows += [(100 + i, "", "en", "seen", 10) for i in range(6000)]
    rows += [(9000 + i, text(i % 2), "en", "good host" if i % 2 else "bad host", 10) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    v = cotrain.train(table(spark, rows).repartition(4), labels, pool_rows=40)
    assert v.scores("", "good host", "en", 10)[1] > v.scores("", "bad host", "en", 10)[1] + 0.05


def test_quality_classifier_awkward(spark):
    df = table(spark, awkward(12), clash=True)
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (3, None), (5, 1), (777, 0)], "doc_id long, quality int")
    got = cotrain.score(df, cotrain.train(df, labels), [F.col("doc_id")]).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    none = cotrain.score(df, cotrain.train(df, labels.where("quality = 1")), [F.col("doc_id")]).collect()
    assert all(r.kept and r.score is None for r in none)
    empty = table(spark, [])
    assert cotrain.score(empty, cotrain.train(empty, labels.where("false")), [F.col("doc_id")]).count() == 0
