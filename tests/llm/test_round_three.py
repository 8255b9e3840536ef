"""Prefix trie, SentencePiece and periodic runs against brute force, the library and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

import public_tokenizers
import sentencepiece
from ledgerline.llm import periodic, pieces, queries, trie
from tests.conftest import SF_SMALL
from tests.llm.test_operators import docs_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11: prefix trie ------------------------------------------------------------------------
def brute_trie(rows):
    """The contract's nodes from (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    below = defaultdict(list)
    for s in members:
        if s:
            below[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in below[s]) or 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1]) if s else 0) + sum(saved[k] for k in below[s])
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(below[s]), leaves[s], saved[s],
                   sha(",".join(map(str, sorted(ends[s]))))) for s, m in members.items())


def trie_rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


SHAPE = "conv_id bigint, turn bigint, role string, text string, k1 string, depth string, _h int"


def test_trie_of_odd_conversations(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, t, t, t]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "zzz", None, "héé"]))
            for c in [*range(230), -5, 1 << 40] for t in range(rng.choice([0, 1, 2, 3, 7, 12]))]
    rows += [(None, 1, "u", "x")] + rows[:40]                       # a null id, repeated rows
    rows += [(500, i, "u", f"t{i % 3}") for i in range(2000)]       # one long conversation
    rows += [(600 + i, 0, "u", "é" * 70_000) for i in range(3)]     # long texts, a hot first turn
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SHAPE)
    assert trie_rows(trie.trie_of_conversations(df)) == brute_trie(rows)
    assert trie.trie_of_conversations(df.limit(0)).count() == 0


def test_trie_with_a_root_that_is_no_heavy_node(spark):
    rows = [(7, i, "u", f"t{i}") for i in range(400)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SHAPE)
    assert trie_rows(trie.trie_of_conversations(df)) == brute_trie(rows)


def test_trie_keeps_real_names_and_totals(spark):
    """The operator's own columns, with turns given directly and a turnless conversation."""
    turns = spark.createDataFrame([(1, 0, "u", "hello"), (1, 1, "a", "yes"), (2, 0, "u", "hello"), (3, None, None, None)],
                                  "conv_id bigint, pos int, role string, text string")
    got = {(r.depth, r.conv_id): r for r in trie.prefix_trie(turns).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1)}
    assert (got[0, 1].n_convs, got[0, 1].n_leaves, got[0, 1].saved_tokens, got[0, 1].ends_sha256) == (3, 1, 5, sha("3"))
    assert (got[1, 1].p1, got[1, 1].p2) == (0, 0) and got[1, 1].ends_sha256 == sha("2")
    assert got[2, 1].parent_conv_id == 1 and got[2, 1].n_children == 0


def test_queue_spills_and_keeps_order():
    rng, queue, got = random.Random(1), trie.SpillingQueue(10), []
    items = sorted((rng.randrange(50), rng.randrange(50), k) for k in range(3000))
    for at in range(0, 3000, 300):                                  # pushed ahead of what is popped
        part = items[at:at + 300]
        rng.shuffle(part)
        for x in part:
            queue.push(x)
        got += [queue.pop() for _ in range(300)]
    assert got == items and queue.least() is None


def test_totals_do_not_depend_on_memory():
    rng = random.Random(2)
    parent = {n: rng.randrange(n) for n in range(1, 600)}
    depth = {0: 0}
    for n in range(1, 600):
        depth[n] = depth[parent[n]] + 1
    nodes = sorted(((depth[n], n, n, parent.get(n, 0), parent.get(n, 0), n > 0, n, 0, 0, 0) for n in range(600)),
                   key=lambda x: (-x[0], x[1], x[2]))
    want = list(trie.pass_forward(nodes))
    assert want == list(trie.pass_forward(nodes, limit=3))
    assert want[-1][4] == 600 - len(set(parent.values())) and want[-1][5] == sum(range(600))


# --- 12: SentencePiece ----------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def own_model():
    with open(PIECES, "rb") as f:
        return pieces.Model(f.read())


ODD = ["", "   ", " a", "  hello   world \n x\t", "▁a ▁", "ﬁ Å é 　  x", "<s> </s> <unk> <0x41>", "日本語 🤷‍♂️\x00z",
       "a▁▁b c▁", "\r\n\r\n", " " * 83 + "x", "x" * 5000, "ab" * 3000 + "日本" * 500]


def test_ids_spans_and_decoding_match_the_library(spark, library, own_model):
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("ab ▁  \n\té日本🤷1.,'Ωñthe") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    together = own_model.encode_all([t.encode() for t in texts])
    for t, (ids, bounds) in zip(texts, together):
        want = library.encode(t)
        assert ids.tolist() == want and own_model.encode(t.encode())[0].tolist() == want
        assert own_model.decode(want) == library.decode(want)
        spans = [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces] if t else []
        assert list(zip(bounds[:-1].tolist(), bounds[1:].tolist())) == spans


def test_decoding_of_broken_ids(library, own_model):
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.randrange(3), 259, 260]) for _ in range(rng.randint(0, 8))]
        assert own_model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_longest_prefixes_of_compiled_maps(rule):
    rng = random.Random(5)
    alpha = "ab \t\n　ﬁÅé½①ｱﾞｶﾞÁéΩЖ한한각日本​­﻿™…㍿x1️⃣\x00"
    texts = ["", "  ", "​", "  a  b ", "ﬁ", "㍿㍿"] + ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    for flags in range(8):
        theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=bool(flags & 1), escape_whitespaces=bool(flags & 2),
                                                       remove_extra_whitespaces=bool(flags & 4))
        mine = pieces.Normaliser(theirs.serialized_normalizer_spec())
        for t in texts:
            said, offsets = theirs.Normalize(t, with_offsets=True)
            got, note = mine.normalise(t.encode())
            ends = [0]
            for c in said:
                ends.append(ends[-1] + len(c.encode()))
            source = [0]
            for c in t:
                source.append(source[-1] + len(c.encode()))
            assert got.decode() == said and [int(note[e]) for e in ends] == [source[o] for o in offsets]


def test_heap_and_table_merge_alike(own_model):
    rng = random.Random(8)
    for _ in range(300):
        part = "▁" * rng.randrange(6) + "".join(rng.choice("theiranodsg") for _ in range(rng.randint(1, 60)))
        assert own_model._merge_symbols(part) == own_model._merge_short(part)


def test_piece_documents_edge_cases(spark, library):
    texts = [(1, None), (2, ""), (3, "plain words"), (3, "plain words"), (None, "é 日本"), (4, "long " * 60_000)]
    out = pieces.encode_documents(docs_of(spark, texts), PIECES).collect()
    assert len(out) == 6 and set(out[0].asDict()) == {"doc_id", "ids", "bounds", "decoded"}
    by = {r.doc_id: r for r in out}
    assert by[1].ids == by[2].ids == [2] and by[1].bounds == [0] and by[1].decoded == ""
    for doc, text in texts[2:]:
        assert by[doc].ids == library.encode(text, add_eos=True) and by[doc].decoded == text
        assert by[doc].bounds[-1] == len(text.encode()) and len(by[doc].bounds) == len(by[doc].ids)
    assert pieces.encode_documents(docs_of(spark, texts).limit(0), PIECES).count() == 0


def test_piece_query_on_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries.op12_aligned_sentencepiece(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


# --- 13: periodic runs ----------------------------------------------------------------------
def brute_runs(words, least, repeats):
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, repeats * q):
                x = words[i:i + size]
                if not any(x[p:] == x[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_a_search_over_all_periods():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 10)
            w = w[:a] + [w[min(a + i % p, n - 1)] for i in range(n - a)]
        for least, repeats in ((1, 2), (24, 3), (6, 3), (8, 2), (10, 4)):
            assert periodic.runs(w, least, repeats) == brute_runs(w, least, repeats)
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a                         # Fibonacci words are full of runs
    for least, repeats in ((2, 2), (24, 3)):
        assert periodic.runs(b, least, repeats) == brute_runs(b, least, repeats)


def test_collapsing_drops_a_word_that_any_run_repeats():
    rng = random.Random(6)
    for _ in range(300):
        w = [rng.randrange(2) for _ in range(rng.randint(0, 50))]
        found = brute_runs(w, 1, 2)
        want = [x for i, x in enumerate(w) if not any(s + q <= i < s + size for s, size, q in found)]
        assert periodic.collapsed(w, found) == want


def test_run_documents_edge_cases(spark):
    texts = [(1, None), (2, " \t\x0b\n"), (3, "a b c " * 10), (3, "a b c " * 10), (None, "x " * 30), (4, "word " * 40_000),
             (5, "a\u00a0b " * 24 + "tail"), (7, "a b " * 24 + "tail"), (6, "same " * 23)]
    out = periodic.find_runs(docs_of(spark, texts)).collect()
    by = {r.doc_id: r for r in out}
    as_rows = lambda d: [tuple(x) for x in by[d].runs]
    assert len(out) == 9 and set(out[0].asDict()) == {"doc_id", "n_words", "runs", "collapsed"}
    assert (by[1].n_words, by[1].runs, by[1].collapsed) == (by[2].n_words, by[2].runs, by[2].collapsed) == (0, [], "")
    assert as_rows(3) == [(0, 30, 3)] and by[3].collapsed == "a b c"
    assert as_rows(4) == [(0, 40_000, 1)] and by[4].collapsed == "word" and as_rows(None) == [(0, 30, 1)]
    assert as_rows(5) == [(0, 24, 1)] and by[5].collapsed == "a\u00a0b tail" and as_rows(6) == []   # one word for this rule
    assert as_rows(7) == [(0, 48, 2)] and by[7].collapsed == "a b tail"
    assert periodic.find_runs(docs_of(spark, texts).limit(0)).count() == 0


def test_run_query_on_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_link_cut_runs(spark, SF_SMALL).collect()}
    assert set(got) == set(texts)
    seen = 0
    for doc, text in texts.items():
        words, h = [w for w in re.split("[\x20\x09-\x0d]+", text) if w], zlib.crc32(str(doc).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 1500 and h % 10:
            continue                            # the search over all periods is quadratic
        found = brute_runs(words, 24, 3)
        seen += len(found)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in found)]
        r = got[doc]
        assert (r.n_runs, r.runs_sha256) == (len(found), sha("".join(f"{s},{size},{q}\n" for s, size, q in found)))
        assert r.collapsed_sha256 == sha(" ".join(kept))
        if found:
            best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert seen
