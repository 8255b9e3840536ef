"""The operators against brute force, libraries and the edge cases that their docstrings state."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from ledgerline.llm import bpe, chat, components, decontam, langid, licences, lm, neardup, pii, secrets, topk
from ledgerline.llm.common import NOT_SPACE, Words, hash_of, text_bytes, word_slices

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _row string"


def docs_of(spark, texts, langs=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i, t, (langs or {}).get(i), "s", len(t) if t is not None else None, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def rng():
    return random.Random(5)


def prose(rng, n, stock=None):
    stock = stock or ["the", "of", "and", "stone", "river", "light", "paper", "green", "house", "water", "north", "ember"]
    return " ".join(rng.choice(stock) + str(rng.randrange(40)) * (rng.random() < 0.7) for _ in range(n))


def test_words_and_grams_match_a_regex():
    import pyarrow as pa
    texts = ["Hello, WORLD 12", "", None, "é_x--Éa", "a b c d e f g", "..."]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    (_, _, w), = word_slices(pa.array(texts))
    for i, t in enumerate(texts):
        words = pattern.findall((t or "").translate(low))
        assert [w.text(k).decode() for k in range(w.first[i], w.first[i + 1])] == words
        assert (w.hash[w.first[i]:w.first[i + 1]] == hash_of(words)).all()
    g, first = w.grams(5)
    assert np.diff(first).tolist() == [1, 0, 0, 1, 3, 0]
    data, off = text_bytes(pa.array(texts[2:4]))
    assert off.tolist() == [0, 0, 9] and len(Words(data, off).hash) == 3


# --- 1 -------------------------------------------------------------------------------------
def naive_smith_waterman(a, b):
    h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i, y in enumerate(b, 1):
        for j, x in enumerate(a, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_smith_waterman_matches_the_plain_table():
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 15))] for _ in range(2))
        assert decontam.smith_waterman(np.array(a), np.array(b))[0] == naive_smith_waterman(a, b)


def test_contaminated_finds_verbatim_and_edited_passages(spark, rng):
    item = prose(rng, 40)
    words = item.split()
    edited = " ".join("changed" if i % 8 == 3 else w for i, w in enumerate(words))
    texts = [(1, prose(rng, 90) + " " + item + " " + prose(rng, 30)), (2, prose(rng, 50) + " " + edited),
             (3, prose(rng, 200)), (4, None), (5, ""), (1, prose(rng, 10)), (None, item)]
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (10, prose(rng, 30), 1)],
                                  "item_id long, text string, score long")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs_of(spark, texts), items).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[(1, 7)] == 1.0 and 0.5 <= got[(2, 7)] < 1
    kept = decontam.without_contaminated(docs_of(spark, texts), items)
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 5]
    assert decontam.contaminated(docs_of(spark, texts), items.limit(0)).count() == 0
    assert decontam.contaminated(docs_of(spark, []), items).count() == 0


def test_items_of_one_and_two_words(spark, rng):
    docs = docs_of(spark, [(1, prose(rng, 30) + " xylophone quartz " + prose(rng, 30)), (2, "Xylophone, quartz"), (3, "quartz xylophone"),
                           (4, prose(rng, 20) + " zeppelin"), (5, prose(rng, 40)), (6, "xylophone")])
    items = spark.createDataFrame([(10, "xylophone quartz"), (11, "Zeppelin!"), (12, "a longer item that no document holds at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.last_word) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 10, 31), (2, 10, 1), (4, 11, 20)}


# --- 2 -------------------------------------------------------------------------------------
def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_samples_agree_as_the_weighted_jaccard_similarity():
    import pyarrow as pa
    r = random.Random(3)
    a = [f"w{r.randrange(10 ** 6)}" for _ in range(400)]
    b = a[:330] + [f"v{i}" for i in range(70)]
    idf = np.ones(neardup.FEATURES, np.float32)
    (_, _, w), = word_slices(pa.array([" ".join(a), " ".join(b)]))
    key, tf, first = neardup.shingles(w)
    x, y = set((key[:first[1]] & np.uint64((1 << 44) - 1)).tolist()), set((key[first[1]:] & np.uint64((1 << 44) - 1)).tolist())
    true = len(x & y) / len(x | y)
    s = neardup.samples(key, neardup.weights(key, tf, idf), first)
    assert abs((s[0] == s[1]).mean() - true) < 0.3


def test_near_duplicate_classes(spark, rng):
    base = prose(rng, 200).split()
    def edit(k):
        w = list(base)
        w[k] = "edited" + str(k)
        return " ".join(w)
    hot = [(100 + i, edit(5 + i)) for i in range(40)]
    texts = [(1, " ".join(base)), (2, " ".join(base)), *hot, (3, prose(rng, 200)), (4, None), (5, ""), (6, "..."), (7, "one two"),
             (8, "One two!"), (None, " ".join(base)), (2, " ".join(base))]
    docs = docs_of(spark, texts)
    got = {}
    for r in neardup.classes(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert all(got[i] == {1} for i in [1, 2, *(i for i, _ in hot)])
    assert got[3] == {3} and got[4] == {4} and got[5] == {5} and got[6] == {6} and got[7] == got[8] == {7}
    kept = neardup.without_near_duplicates(docs)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7] and kept.columns == docs.columns
    assert neardup.classes(docs.limit(0)).count() == 0


def test_large_keys_lose_no_pairs(spark, monkeypatch):
    """Drifting edits under one key: a document's only partners are members that are no pivots."""
    signatures = neardup.signatures
    monkeypatch.setattr(neardup, "signatures", lambda *a: signatures(*a).withColumn(
        "bands", F.array(F.lit(1).cast("bigint"))))
    r = random.Random(8)
    texts = []
    for g in range(3):
        words = [f"g{g}w{r.randrange(10_000)}" for _ in range(300)]
        for i in range(16):
            texts.append((1000 * g + i, " ".join(words)))
            for k in r.sample(range(300), 4):
                words[k] = f"g{g}e{r.randrange(10_000)}"
    r.shuffle(texts)
    docs = docs_of(spark, [(7 * i % 3001, t) for i, t in texts])
    named = {}
    for small in (10 ** 6, 2):                 # all pairs of the key, then pivots first
        monkeypatch.setattr(neardup, "SMALL", small)
        named[small] = {(x.doc_id, x.class_id) for x in neardup.classes(docs).collect()}
    assert named[2] == named[10 ** 6] and len({c for _, c in named[2]}) == 3


def test_leaders_differences_settle_large_keys_exactly(spark, monkeypatch):
    """Everything under one key: variants of two sources around the threshold, some of which share
    their edits, and strangers; classes as from all pairs, with fewer pairs compared."""
    signatures, meeting = neardup.signatures, neardup._meeting
    monkeypatch.setattr(neardup, "signatures", lambda *a: signatures(*a).withColumn("bands", F.array(F.lit(1).cast("bigint"))))
    monkeypatch.setattr(neardup, "AGREE", 0)
    r = random.Random(12)
    texts = []
    for g in range(2):
        source = [f"g{g}w{r.randrange(10_000)}" for _ in range(200)]
        for i in range(45):
            words = list(source)
            for k in r.sample(range(200), r.choice([1, 3, 4, 5, 6, 7])):
                how = r.random()
                words[k] = "" if how < 0.2 else f"e{r.randrange(10_000)}" if how < 0.8 else words[k] + f" n{r.randrange(50)}"
            texts.append(" ".join(words))
            if i % 5 == 0:                       # a partner with the same edits and one more
                words[r.randrange(200)] = "more"
                texts.append(" ".join(words))
    texts += [" ".join(f"s{r.randrange(10_000)}" for _ in range(100)) for _ in range(6)]
    r.shuffle(texts)
    docs = docs_of(spark, list(enumerate(texts)))
    met = []

    def counted(told, last):
        pairs = neardup.written(meeting(told, last))
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "_meeting", counted)
    named = {}
    for small in (10 ** 6, 2):
        monkeypatch.setattr(neardup, "SMALL", small)
        named[small] = {(x.doc_id, x.class_id) for x in neardup.classes(docs).collect()}
    assert named[2] == named[10 ** 6] and 8 < len({c for _, c in named[2]}) < 100
    assert met and sum(met) < len(texts) ** 2 / 4          # of about len(texts) ** 2 / 2


def test_near_duplicate_ids_with_null_texts_and_long_pairs(spark, rng):
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(20_000))
    docs = spark.createDataFrame([(1, long), (1, None), (2, long + " more"), (3, "a few other words of no copy"), (4, "")],
                                 "doc_id long, text string")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.doc_id, r.class_id) for r in neardup.classes(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_long_texts_are_encoded_in_parts(monkeypatch):
    import pyarrow as pa

    with open(WORD_BPE, encoding="utf-8") as f:
        sub = lm.Subwords(f.read())
    texts = ["", "One two, it's three <|endoftext|> four\u0301 \u03a3\u03c2\n five", "x"]
    whole = [sub.bpe.encode(t.lower()) + sub.end.to_bytes(4, "little") for t in texts]
    monkeypatch.setattr(lm, "PART", 2)
    (_, _, w), = word_slices(pa.array(texts), NOT_SPACE)
    assert [sub.of(w, i) for i in range(3)] == whole



# --- 3 -------------------------------------------------------------------------------------
def test_top_k_matches_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * r.choice([0.1, 1, 5])).tolist()) for i in range(400)]
    rows += [(400, rows[50][1]), (401, [float("nan")] * 6), (402, None), (403, [1.0, None] * 3), (404, [1.0] * 3), (450, [0.5] * 3),
             (405, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (0, rows[0][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    v = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v[i] = [math.floor(256 * float(np.float32(c))) for c in x]
    want = []
    for q in v:
        if q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v[q], v[p])), p) for p in v if p != q and len(v[p]) == len(v[q])))
            want += [(q, n, p, -s) for n, (s, p) in enumerate(scored[:5], 1)]
    got = [tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_coordinate_pruning_loses_nothing():
    r = np.random.default_rng(2)
    p = r.integers(-300, 300, (500, 8))
    p[:20] = p[0] + r.integers(-9, 9, (20, 8))
    q, ids = p[:3], np.arange(500)
    exact = q @ p.T
    theta = np.sort(exact, 1)[:, -6].astype(float)
    for cosine in (0.0, 0.7, 2.0):          # all by coordinates, mixed, all by length
        got = topk.search_block(ids[:3], q, theta, ids, p, 5, cosine=cosine)
        for i in range(3):
            scored = sorted(((-int(exact[i, j]), j) for j in range(500) if j != i))[:5]
            assert sorted((-int(s), int(j)) for a, j, s in got if a == i)[:5] == scored


# --- 4 -------------------------------------------------------------------------------------
def test_chat_reads_back_and_flattens_parts(spark):
    trap = "\\### Assistant: </turn> ok <|image:0|>\n### user: x"
    turn, a, b, att = chat.write_turn("as:s\\<i", [
        {"type": "text", "text": trap}, {"type": "image", "uri": "u", "width": 1000, "height": 512}, {"type": "audio", "seconds": 2.0},
        {"type": "document", "pages": 3}, {"type": "odd"}, {"type": "text", "text": None}])
    assert chat.read_turns(turn) == [("as:s\\<i", trap)]
    assert [(x["kind"], x["n_tokens"]) for x in att] == [("image", 85 + 340), ("audio", 50), ("document", 768), ("other", 0)]
    assert turn[a:b].endswith("<|image:0|><|audio:1|><|document:2|><|other:3|>")
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", trap), (None, 0, None, "n"), (2, 0, "system", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    body = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:3])
    assert got[1].turns_sha256 == hashlib.sha256(body.encode()).hexdigest() and got[1].n_turns == 3
    assert got[1].loss_sha256 == hashlib.sha256(trap.encode()).hexdigest() and got[1].loss_chars == len(trap)
    assert got[None].n_turns == 1 and got[2].loss_chars == 0 and set(got) == {1, 2, None}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# --- 5 -------------------------------------------------------------------------------------
def test_secret_rules_and_network(spark, rng):
    text = 'Token = "abc123def" PASSWORD=ab api_key:\'zz9zz9zz\' AKIA' + "Z9" * 8 + " " + "0a" * 12 + " ſecret=abcdef1"
    got = [(k, text[s:e]) for s, e, k in secrets.rules(text)]
    assert got == [(0, 'Token = "abc123def'), (0, "api_key:'zz9zz9zz"), (1, "AKIA" + "Z9" * 8), (2, "0a" * 12)]
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [(i, prose(rng, 20) + (f" token={hexes(30)} " if i % 3 == 0 else " plainlongwordswithoutend" + "ab" * (i % 7) + " "))
             for i in range(120)] + [(500, None), (501, "")]
    rows = {r.doc_id: r for r in secrets.report(docs_of(spark, texts)).collect()}
    assert len(rows) == 122 and rows[500].spans == "" and rows[0].n_assign == 1 and rows[0].n_hex == 1
    assert all("model" not in rows[i].spans for i in range(120) if i % 3)      # plain words are left alone
    assert secrets.report(docs_of(spark, [])).count() == 0
    pos = [secrets.window(f"key {hexes(32)} end", 4, 36) for _ in range(200)]
    neg = [secrets.window(f"the {w} end", 4, 4 + len(w)) for w in ("thation" * 3 + chr(97 + i % 26) * (i % 9) for i in range(200))]
    net = secrets.fit([(w, True) for w in pos] + [(w, False) for w in neg])
    fresh = net.probability(net.codes([secrets.window(f"xyz {hexes(30)} q", 4, 34) for _ in range(50)]))
    assert (fresh >= net.threshold).mean() > 0.9
    assert secrets.fit([("a" * 64, True)]) is None


# --- 6 -------------------------------------------------------------------------------------
BASE = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_personal_data_rules_match_the_patterns():
    r = random.Random(8)
    pool = ["a", "Z", "@", ".", "-", "7", "12", "255", "256", "+", " ", "(", ")", "x.y", "4111111111111111", "١", "%", "01"]
    for _ in range(3000):
        t = "".join(r.choice(pool) for _ in range(r.randrange(30)))
        want = []
        for k, p in BASE.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split("."))
                        or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15):
                    want.append((m.start(), m.end(), k))
        assert pii.entities(t) == sorted(want, key=lambda x: (x[0], x[2])), t


def test_disclosing_terms_and_sanitising(spark, rng):
    known = [(i, prose(rng, 12) + " call Zorblatt at zor@mail.example.com now " + prose(rng, 12)) for i in range(6)]
    other = [(100 + i, prose(rng, 40)) for i in range(60)] + [(200, None), (201, "")]
    docs = docs_of(spark, known + other)
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    assert rows[0].n_email == 1 and "term" in rows[0].spans and rows[200].spans == "" and len(rows) == 68
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0].text and "Zorblatt" not in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert all(clean[i].text == t for i, t in other) and clean[200].n_chars is None
    assert pii.sanitise(docs).columns == docs.columns
    assert pii.report(docs.limit(0)).count() == 0


def brute_disclosure(texts):
    """Pairs (entity, term) over the threshold and the spans of every text, counted directly."""
    found = {i: pii.entities(t) for i, t in texts.items()}
    low = lambda w: w.translate({c: c + 32 for c in range(65, 91)})
    words = {i: [(m.start(), m.end(), low(m.group())) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)
                 if not any(s < m.end() and m.start() < e for s, e, _ in found[i])] for i, t in texts.items()}
    name = lambda i, x: (x[2], low(texts[i][x[0]:x[1]]))
    held, around, stand = {}, {}, {}
    for i in texts:
        for w in {w for _, _, w in words[i]}:
            stand.setdefault(w, set()).add(i)
        for x in found[i]:
            held.setdefault(name(i, x), set()).add(i)
            left = [w for s, e, w in words[i] if e <= x[0]][-pii.WINDOW:]
            around.setdefault((name(i, x), i), set()).add((*left, "|", *[w for s, e, w in words[i] if s >= x[1]][:pii.WINDOW]))
    n, telling = len(texts), {}
    for e, docs in held.items():
        for w in {w for i in docs for _, _, w in words[i]}:
            both = docs & stand[w]
            contexts = set().union(*(around[e, i] for i in both))
            ic, pmi = math.log2(n / len(docs)), math.log2(len(both) * n / (len(docs) * len(stand[w])))
            if len(contexts) >= pii.SUPPORT and ic > 0 and pmi >= ic / pii.ALPHA:
                telling[e, w] = len(both) / len(stand[w])
    everywhere = {w for (_, w), share in telling.items() if share >= pii.TELLING}
    out = {}
    for i in texts:
        own = {name(i, x) for x in found[i]}
        terms = [(s, e, 4) for s, e, w in words[i] if w in everywhere or any((x, w) in telling for x in own)]
        out[i] = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in sorted([*found[i], *terms], key=lambda x: (x[0], x[2])))
    return telling, out


def test_disclosure_over_whole_documents_matches_brute_force(spark, rng):
    texts = {}
    for i in range(240):
        t = prose(rng, rng.randrange(5, 60))
        if i % 40 < 5:                    # the name far from the address, and again at the end
            t = f"Zorblatt{i // 40} É {t} {prose(rng, 20)} zor{i // 40}@mail.example.com {prose(rng, 15)} zorblatt{i // 40} x"
        if i % 40 == 7:
            t += f" ZORBLATT{i // 40} alone"           # a document without the entity
        if i % 8 == 1:
            t += f" common{i // 40} word"
        if i % 40 in (0, 1, 2):
            t += f" common{i // 40} again 10.0.0.{i // 40}"
        texts[i] = t
    texts[300] = texts[0]                              # a copy
    texts[301] = "Zorblatt0 " + "long " * 30_000 + "zor0@mail.example.com zorblatt0"
    telling, want = brute_disclosure(texts)
    docs = docs_of(spark, list(texts.items()))
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got == want and len(telling) >= 6
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any(re.search(r"zorblatt\d", t, re.I) for t in clean.values())


def test_personal_data_edge_rows(spark):
    docs = docs_of(spark, [(None, "mail a@b.co"), (1, "mail a@b.co"), (1, "mail a@b.co"), (2, None), (3, "x" * 200_000 + " a@b.co")])
    rows = sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.report(docs).collect())
    assert rows == [(0, 1, "email:5:11"), (1, 1, "email:5:11"), (1, 1, "email:5:11"), (2, 0, ""), (3, 1, "email:200001:200007")]
    assert sorted(r.text or "" for r in pii.sanitise(docs).collect())[:4] == ["", "mail [EMAIL]", "mail [EMAIL]", "mail [EMAIL]"]


# --- 7 -------------------------------------------------------------------------------------
def test_licence_templates_and_phrases(spark):
    m = licences.Automaton("[[this is]] under the {{name:1-2}} licence [[v {{n:1-1}}]]")
    ok = lambda t: m.match([int(h) for h in hash_of(t.split())], 0, len(t.split())) > 0
    assert ok("under the x licence") and ok("this is under the x y licence v 3") and ok("under the licence licence")
    assert not ok("under the licence") and not ok("under the x y z licence") and not ok("this under the x licence")
    texts = [(1, "X. All rights reserved. Licensed under CC BY-NC 4.0; all rights reserved"), (2, None), (3, ""),
             (4, "cc. by"), (5, "by"), (6, "cc"), (7, "Released under the MIT License.")]
    got = {r.doc_id: r for r in licences.scan(docs_of(spark, texts)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == (3, 1, 11, 14)
    assert got[1].base_labels == "cc-by,reserved" and got[1].labels == "cc-by,cc-by-nc,reserved"
    assert got[2].n_words == 0 and got[2].labels == "" and got[2].first_word is None and got[2].score == 0
    assert got[4].base_labels == "cc-by" and got[5].n_base == got[6].n_base == 0 and got[7].labels == "mit"


# --- 8 -------------------------------------------------------------------------------------
def test_language_model_base_and_windows(spark, rng):
    first = np.array([0, 1, 33, 33 + 200])
    text, start, skip = lm.windows(first)
    seen = Counter()
    for t, s, k in zip(text, start, skip):
        for p in range(s + k, min(s + lm.LENGTH, first[t + 1])):
            seen[p] += 1
    assert seen == Counter(range(233))                   # every place exactly once
    texts = [(i, prose(rng, rng.randrange(60)) if i % 5 else "Same Words\there") for i in range(80)] + [(200, None), (201, ""), (None, "q w")]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.score_documents(docs_of(spark, texts), WORD_BPE).collect()}
    for i, t in texts:
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held(i))
        assert abs(g.base_score - base) < 1e-6 and g.score < 0
    assert lm.score_documents(docs_of(spark, []), WORD_BPE).count() == 0


def test_language_model_learns_from_whole_texts(spark, rng):
    """What follows the first 1,500 characters of the training texts is learned too."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    learn = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][:40]
    texts = [(i, prose(rng, 300) + " one two three" * 200) for i in learn]
    assert all(t.index(" one two") > 1500 for _, t in texts)
    texts += [(held[0], " one two three" * 60), (held[1], " three two one" * 60)]
    got = {r.doc_id: r for r in lm.score_documents(docs_of(spark, texts), WORD_BPE).collect()}
    assert abs(got[held[0]].base_score - got[held[1]].base_score) < 1e-6
    assert got[held[0]].score > got[held[1]].score + 30


def test_training_blocks_hold_every_place_once(spark, rng, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 2)
    monkeypatch.setattr(lm, "BLOCK", 5)
    with open(WORD_BPE, encoding="utf-8") as f:
        spec = f.read()
    texts = [(i, prose(rng, 1 + 23 * i)) for i in range(12)] + [(20, None), (21, ""), (3, prose(rng, 70))]
    scorer = lm.Scorer(spec, np.ones(lm.Subwords(spec).size, np.int64))

    def places(ids, first, lead=None):
        """Each place in use with its context class and its window's earlier classes."""
        _, cls, slot, target, use = scorer.batches(ids, first, lead)
        return Counter((tuple(cls[i, :j + 1]), int(slot[i, j]), int(target[i, j])) for i, j in zip(*np.nonzero(use)))

    want = Counter()
    for _, t in texts:
        for _, _, w in word_slices(pa.array([t or ""]), NOT_SPACE):
            want += places(*scorer.sequences(w))
    rows = lm.training_blocks(docs_of(spark, texts), spec).collect()
    got = sum((places(np.frombuffer(r.ids, "<u4").astype(np.int64), np.cumsum([0, *r["size"]]), np.array(r.lead))
               for r in rows), Counter())
    assert got == want and len(rows) > 3 and any(x for r in rows for x in r.lead)


def test_attention_gradients_and_probabilities():
    r = np.random.default_rng(0)
    net = lm.Attention(2 * lm.MEMBERS)
    cls, slot = r.integers(0, 32, (2, lm.LENGTH)), r.integers(0, 9, (2, lm.LENGTH))
    one = np.zeros((2, lm.LENGTH), bool)
    one[:, 7] = True
    total = sum(np.exp(net.log_probability(cls, slot, np.full_like(cls, t), one)) for t in range(32))
    assert np.allclose(total, 1, atol=1e-4)
    later = cls.copy()
    later[:, 9:] = 0                                      # causal: what follows doesn't matter
    assert np.allclose(net.log_probability(cls, slot, cls, one), net.log_probability(later, slot, cls, one), atol=1e-5)
    target = np.roll(cls, -1, 1)
    before = net.log_probability(cls, slot, target, np.ones_like(one)).sum()
    net.train(cls, slot, target, np.ones_like(one), epochs=60)
    assert net.log_probability(cls, slot, target, np.ones_like(one)).sum() > before + 20


# --- 9 -------------------------------------------------------------------------------------
def test_bpe_matches_the_library(spark, rng):
    from tokenizers import Tokenizer
    lib, own = Tokenizer.from_file(WORD_BPE), bpe.tokenizer(open(WORD_BPE, encoding="utf-8").read())
    pool = ["a", "B", "'s", " ", "\n", "Σ", "ς", "é", "é", "İ", "ß", "1", "²", "中",
            "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "​", "!", "??", "\U0001f600", "ﬁ", "Ⅷ", "the", "ing", "_"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["ab" * 3000, "x" * 500, ""]
    for t in texts:
        e = lib.encode(t, add_special_tokens=False)
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False), t
    rows = {r.doc_id: r for r in bpe.digests(bpe.encode_documents(docs_of(spark, [(1, "Hello  you"), (2, None), (None, "x")]), WORD_BPE)).collect()}
    e = lib.encode("Hello  you", add_special_tokens=False)
    assert rows[1].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest() and rows[1].n_tokens == len(e.ids)
    assert rows[2].n_tokens == 0 and rows[2].decoded_sha256 == hashlib.sha256(b"").hexdigest() and None in rows


# --- 10 ------------------------------------------------------------------------------------
def test_forward_backward_matches_enumeration():
    from itertools import product
    r = np.random.default_rng(1)
    e, trans, begin = r.normal(size=(5, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    got = langid.forward_backward(e, np.array([0, 2]), trans, begin)[0]
    for lo, hi in ((0, 2), (2, 5)):
        m = np.zeros((hi - lo, 3))
        for path in product(range(3), repeat=hi - lo):
            s = begin[path[0]] + sum(e[lo + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            for i, y in enumerate(path):
                m[i, y] += np.exp(s)
        assert np.allclose(got[lo:hi], m / m.sum(1, keepdims=True), atol=1e-6)


def test_language_id_learns_and_handles_odd_texts(spark):
    r = random.Random(2)
    stock = {"aa": ["tirel", "mofan", "tirum", "mofis"], "bb": ["quost", "verd", "quarn", "vusk"]}
    texts, langs = [], {}
    for i in range(200):
        lang = r.choice(["aa", "bb"])
        texts.append((i, " ".join(r.choice(stock[lang]) for _ in range(30))))
        langs[i] = lang
    texts += [(300, None), (301, ""), (302, "12 34 …"), (303, "tirel mofan tirum mofan " + "quost verd quarn vusk " * 6)]
    rows = {x.doc_id: x for x in langid.language_of_documents(docs_of(spark, texts, langs)).collect()}
    assert all(rows[i].lang_pred == langs[i] for i in range(200))
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (300, 301, 302)) and rows[303].lang_pred == "bb"
    model = langid.train([(t, langs[i]) for i, t in texts[:100]])
    run = langid.predict(docs_of(spark, texts[-1:]), model, runs=True).first().runs
    assert [x.lang for x in run] == ["aa", "bb"] and run[0].n_words == 4
    none = langid.language_of_documents(docs_of(spark, texts[:3])).collect()
    assert {x.lang_pred for x in none} == {"und"}
    assert langid.language_of_documents(docs_of(spark, [])).count() == 0
