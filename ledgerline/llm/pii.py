"""Personal data: rules find protected entities, corpus co-occurrence finds the terms that
reveal them.

Rules give e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. For every
entity value e and every term t of the documents that hold e, document counts over the whole
corpus give IC(e) = -log2 p(e) and PMI(e; t) = log2(p(e, t) / (p(e) p(t))). A term discloses e if
both stand in documents with at least ``SUPPORT`` different surroundings of e (the words around it;
copies count once) and PMI(e; t) >= IC(e) / ``ALPHA``: knowing t then leaves next to nothing of e's
information. As PMI(e; t) is at most IC(t), only terms with IC(t) >= IC(e) / ALPHA for the rarest
supported entity can do so; such rare terms are chosen before entities and terms are paired.

A disclosing term is generalised at every place in every document that holds its entity, and, if
at least ``TELLING`` of the documents that hold the term hold the entity too, in all others.

Edge cases: null text has no spans and stays null when sanitised; empty table -> empty result;
repeated rows -> the same spans each; null ids keep their spans; extra columns pass through
``sanitise`` and are ignored elsewhere.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.sizing import attach_one_row
from ledgerline.llm.common import U, bitmap, fresh, hash_of, in_bitmap, keep, on_workers, spread, word_slices

KINDS = ("email", "ip", "card", "phone", "term")
SHOWN = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
WINDOW = 8               # words on each side that make an entity's surroundings
SUPPORT = 3
ALPHA = 1.25
TELLING = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the rules' matches, by start and kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:          # every match holds one @; its local part is the run before it
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            last = m.end()
            out.append((s, last, 0))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups()):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def surroundings(text: str, found: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """(hash of each entity, hash of the words around it, the text's distinct terms outside of
    entities)."""
    spans = sorted((s, e) for s, e, _ in found)
    words, at = [], 0
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if not any(s < m.end() and m.start() < e for s, e in spans[at:at + 4]):
            words.append(m.span())
    said = [text[a:b] for a, b in words]          # hashes don't tell A-Z from a-z
    starts = np.array([a for a, _ in words] + [1 << 62])
    near = []
    for s, e, _ in found:
        k, j = int(np.searchsorted(starts, s)), int(np.searchsorted(starts, e))
        near.append(f"near:{said[max(0, k - WINDOW):k] + said[j:j + WINDOW]}")
    hashes = hash_of([f"{KINDS[k]}:{text[s:e]}" for s, e, k in found] + near + said).view(np.int64)
    n = len(found)
    return hashes[:n].tolist(), hashes[n:2 * n].tolist(), np.unique(hashes[2 * n:]).tolist()


_PA_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
_PA_NEAR = pa.struct([("entity", pa.int64()), ("context", pa.int64())])


def _keyed(docs: DataFrame) -> DataFrame:
    """row (hash of id and text), doc_id, text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def find_entities(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (spans of the rules), near (each entity with its surroundings), terms (the
    distinct terms of a text with an entity)."""
    def run(batches):
        for batch in batches:
            base, near, terms = [], [], []
            for text in batch.column(2).to_pylist():
                found = entities(text) if text else []
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                own, around, every = surroundings(text, found) if found else ([], [], [])
                near.append([{"entity": x, "context": c} for x, c in zip(own, around)])
                terms.append(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(_PA_SPAN)),
                                              pa.array(near, pa.list_(_PA_NEAR)), pa.array(terms, pa.list_(pa.int64()))],
                                             ["row", "doc_id", "base", "near", "terms"])

    return spread(_keyed(docs), "row").mapInArrow(
        run, "row bigint, doc_id bigint, base array<struct<start:bigint,end:bigint,kind:int>>, "
             "near array<struct<entity:bigint,context:bigint>>, terms array<bigint>")


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): documents that hold each of the given terms, over all documents. A bitmap of
    fixed size saves most other words; the join keeps only the given terms."""
    bits = bitmap(terms, "term")

    def count(batches):
        for batch in batches:
            word, n = np.zeros(0, U), np.zeros(0, np.int64)
            for _, _, w in word_slices(batch.column(0)):
                hit = np.flatnonzero(in_bitmap(bits, w.hash))
                doc = np.searchsorted(w.first, hit, side="right") - 1
                order = np.lexsort((w.hash[hit], doc))
                h, d = w.hash[hit][order], doc[order]
                own, m = np.unique(h[np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][:len(h)]], return_counts=True)
                both, at = np.unique(np.concatenate([word, own]), return_inverse=True)
                word, n = both, np.bincount(at, np.concatenate([n, m]), len(both)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["term", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term bigint, n bigint")
    return got.groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")


def disclosing_terms(found: DataFrame, docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """entity, term, pmi, ic, share (of the documents with the term that hold the entity): pairs that
    exceed the disclosure threshold."""
    near = found.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.context")
    # tables kept as Parquet have their own sizes, so that joins with small ones shuffle nothing
    supported = keep(near.groupBy("entity").agg(F.count_distinct("row").alias("n_entity"), F.count_distinct("context").alias("contexts"))
                     .where(F.col("contexts") >= support).select("entity", "n_entity"), "supported")
    held = keep(near.join(supported, "entity").distinct(), "held")
    rows = held.select("row").distinct()
    of_rows = found.join(rows, "row", "left_semi").select("row", F.explode("terms").alias("term"))
    met = of_rows.groupBy("term").agg(F.count_distinct("row").alias("n")).where(F.col("n") >= support).select("term")
    n_term = document_counts(docs, keep(met, "met")).withColumnRenamed("n", "n_term")
    # a term of n_t documents can disclose an entity of n_e only if n_t / N <= (n_e / N) ** (1 / alpha)
    limits = attach_one_row(docs.agg(F.count(F.lit(1)).alias("n_docs")), supported.agg(F.max("n_entity").alias("most")))
    rare = attach_one_row(n_term, limits).where(
        F.col("n_term") <= F.col("n_docs") * F.pow(F.col("most") / F.col("n_docs"), F.lit(1 / alpha)) * (1 + 1e-9))
    rare = keep(rare.select("term", "n_term", "n_docs"), "rare")
    pairs = of_rows.join(rare.select("term"), "term").join(held.select("row", "entity", "context"), "row")
    together = (pairs.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("row").alias("n_both"))
                .where(F.col("contexts") >= support))
    scored = together.join(supported, "entity").join(rare, "term").select(
        "entity", "term", F.log2(F.col("n_docs") / F.col("n_entity")).alias("ic"),
        F.log2(F.least("n_both", "n_term", "n_entity") * F.col("n_docs")
               / (F.col("n_entity") * F.col("n_term"))).alias("pmi"),
        (F.col("n_both") / F.col("n_term")).alias("share"))
    return scored.where((F.col("ic") > 0) & (F.col("pmi") >= F.col("ic") / alpha))


def places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """row, term, start, end (code points) of every place where one of ``terms`` stands in a text."""
    bits = bitmap(terms, "term")

    def run(batches):
        for batch in batches:
            out = {"row": [], "term": [], "start": [], "end": []}
            texts = batch.column(1)
            rows = batch.column(0).to_numpy()
            for a, _, w in word_slices(texts):
                hit = np.flatnonzero(in_bitmap(bits, w.hash))
                if not len(hit):
                    continue
                before = np.concatenate(([0], np.cumsum(w.data & 0xC0 != 0x80)))     # code points up to a byte
                doc = np.searchsorted(w.first, hit, side="right") - 1
                zero = before[w.offsets[doc]]
                out["row"].append(rows[a + doc])
                out["term"].append(w.hash[hit].view(np.int64))
                out["start"].append(before[w.start[hit]] - zero)
                out["end"].append(before[w.end[hit]] - zero)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out.values()], list(out))

    found = _keyed(docs).select("row", "text").mapInArrow(run, "row bigint, term bigint, start bigint, end bigint")
    return found.join(terms, "term", "left_semi").distinct()


def spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, base, all (base and disclosing terms, by start and kind) for every row."""
    on_workers(docs.sparkSession)
    found = keep(find_entities(docs), "found")
    told = keep(disclosing_terms(found, docs).select("entity", "term", "share"), "told")
    at = keep(places(docs, told.select("term").distinct()), "places")
    holds = found.where(F.size("near") > 0).select("row", F.explode("near.entity").alias("entity")).distinct()
    concerned = at.join(told.select("entity", "term"), "term").join(holds, ["row", "entity"], "left_semi").select("row", "start", "end")
    elsewhere = at.join(told.where(F.col("share") >= TELLING).select("term").distinct(), "term", "left_semi").select("row", "start", "end")
    added = concerned.unionByName(elsewhere).groupBy("row").agg(F.collect_set(
        F.struct("start", "end", F.lit(len(KINDS) - 1).alias("kind"))).alias("added"))   # one document's own
    joined = found.select("row", "doc_id", "base").join(added, "row", "left")
    free = F.filter(F.coalesce("added", F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")),
                    lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return joined.select("row", "doc_id", "base", F.array_sort(F.concat("base", free),
        lambda x, y: F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .otherwise(x["kind"] - y["kind"])).alias("all"))


def _joined(col: str):
    return F.array_join(F.transform(col, lambda x: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"),
        x["end"].cast("string"))), ",")


def _number(col: str, kind: int) -> Column:
    """Spans of ``kind``. (Spark gives every further argument of a filter's function the place.)"""
    return F.size(F.filter(col, lambda x: x["kind"] == kind)).cast("bigint")


def report(docs: DataFrame) -> DataFrame:
    s = spans(docs)
    counts = [_number("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return s.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"),
                    _joined("all").alias("spans"))


def replace(text: str | None, found) -> str | None:
    """``text`` with each span generalised to its kind; spans that overlap become one."""
    if text is None or found is None or not len(found):
        return text
    out, at = [], 0
    for x in found:
        if x["start"] < at:
            if x["end"] > at:
                at = x["end"]
            continue
        out += [text[at:x["start"]], SHOWN[x["kind"]]]
        at = x["end"]
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data generalised in ``text`` (and ``n_chars`` counted anew)."""
    row, every = fresh("row", docs.columns), fresh("all", docs.columns)
    todo = spans(docs).where(F.size("all") > 0).select(
        F.col("row").alias(row), F.col("all").alias(every)).dropDuplicates([row])

    @F.arrow_udf("string")
    def cleaned(text: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([replace(t, f) for t, f in zip(text.to_pylist(), found.to_pylist())], pa.string())

    out = docs.join(todo, F.xxhash64(docs["doc_id"], docs["text"]) == F.col(row), "left")
    out = out.withColumn("text", F.when(F.col(every).isNotNull(), cleaned("text", every)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType),
                                                   F.col("n_chars")))
    return out.select(*docs.columns)
