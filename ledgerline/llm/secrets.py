"""Secret scans: rules, and a character convolutional network over every candidate.

Rules give assignments, access keys and hex strings. Candidates are the rules' matches and all
other unbroken runs of ``LEAST`` or more key characters. The network reads a candidate (its
first and last characters if it is long) with ``CONTEXT`` characters on both sides: character
embeddings and an inside mark, convolution of width 5, maximum over the place, one dense layer.
It is trained on all labelled findings of all documents (distinct windows: the rules' matches
against other runs; also with their context blanked, so that a secret without a keyword counts
too). They are dealt by hash into blocks of about ``BLOCK``; in each of ``EPOCHS`` passes every
block trains its own copy of the parameters in numpy, and the mean over the blocks, by their
windows, begins the next pass. A third of the findings, by hash, is kept from training to
calibrate the probability (a logistic fit, by Newton's method over their sums) and to set the
threshold: half way between the highest other run and the largest value with a recall of
``RECALL`` or more (that value where the two overlap), 0.5 at least. Candidates outside the
rules' matches that reach it become spans of kind ``model``; the rules' spans always stay.

Edge cases: null or empty text -> no spans; no findings of either label -> rules only; null
ids and repeated rows -> a row each; extra columns are ignored; empty table -> empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut_lineage, keep, on_workers, short_batches, spread
from ledgerline.operators.ranking import percentile_disc

KINDS = ("assign", "access", "hex", "model")
LEAST = 16
CONTEXT = 16
INSIDE = 32                   # characters of the candidate: 24 of its start, 8 of its end
BLOCK = 1 << 12               # findings that one copy of the parameters is trained on in a pass
BLOCKS = 4                    # blocks in one Arrow batch
UNIT = 1 << 40                # parts of one in the sums of parameters
RECALL = 0.95
EPOCHS = 12
NEWTON = 30                   # steps of the logistic fit at most

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")


def rules(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def window(text: str, start: int, end: int) -> str:
    """CONTEXT + INSIDE + CONTEXT characters, blanks where there are none."""
    body = text[start:end] if end - start <= INSIDE else text[start:start + INSIDE - 8] + text[end - 8:end]
    return (text[max(0, start - CONTEXT):start].rjust(CONTEXT) + body.ljust(INSIDE)
            + text[end:end + CONTEXT].ljust(CONTEXT))


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, str]]:
    """(start, end, is a rule's match, window) of every candidate."""
    out = [(s, e, True, window(text, s, e)) for s, e, _ in found]
    taken, i = sorted((s, e) for s, e, _ in found), 0
    for m in _RUN.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            out.append((m.start(), m.end(), False, window(text, *m.span())))
    return out


class Network:
    """Character convolution; ``scale`` and ``shift`` calibrate, ``threshold`` decides."""

    WIDTH, EMBED, FILTERS = 5, 8, 24

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        deep = self.EMBED + 1
        self.p = {"embed": rng.normal(0, 0.3, (128, self.EMBED)), "conv": rng.normal(0, 0.2, (self.WIDTH * deep, self.FILTERS)),
                  "bias": np.zeros(self.FILTERS), "out": rng.normal(0, 0.2, self.FILTERS), "last": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def codes(windows: list[str]) -> np.ndarray:
        raw = "".join(windows).encode("ascii", "replace")
        return np.frombuffer(raw, np.uint8).reshape(len(windows), -1).astype(np.int64) & 127

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        inside = np.zeros(length, np.float32)
        inside[CONTEXT:CONTEXT + INSIDE] = 1
        x = np.concatenate((self.p["embed"][codes], np.broadcast_to(inside[None, :, None], (n, length, 1))), 2)
        return np.concatenate([x[:, i:length - self.WIDTH + 1 + i] for i in range(self.WIDTH)], 2)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.float32)]
        for lo in range(0, len(codes), 512):
            h = self._columns(codes[lo:lo + 512]) @ self.p["conv"] + self.p["bias"]
            out.append(np.maximum(h.max(1), 0) @ self.p["out"] + self.p["last"])
        return np.concatenate(out)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(codes))

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits.astype(np.float64) + self.shift, -40, 40)))

    def train(self, codes: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = EPOCHS, positive: float | None = None) -> None:
        """``positive``: share of secrets that the labels are weighted by (of ``y`` if None)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        share = y.mean() if positive is None else positive
        weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                c, step = codes[at], step + 1
                cols = self._columns(c)
                h = cols @ self.p["conv"] + self.p["bias"]
                top = h.argmax(1)
                peak = np.take_along_axis(h, top[:, None, :], 1)[:, 0]
                z = np.maximum(peak, 0)
                d = ((1 / (1 + np.exp(-np.clip(z @ self.p["out"] + self.p["last"], -40, 40)))) - y[at]) * weight[at] / len(at)
                g = {"out": z.T @ d, "last": d.sum(keepdims=True)}
                dp = d[:, None] * self.p["out"][None] * (peak > 0)
                g["bias"] = dp.sum(0)
                picked = np.take_along_axis(cols, top[:, :, None], 1)            # (n, filters, width * deep)
                g["conv"] = np.einsum("nf,nfk->kf", dp, picked)
                back = np.einsum("nf,kf->nfk", dp, self.p["conv"]).reshape(len(at), self.FILTERS, self.WIDTH, -1)
                chars = np.take_along_axis(c, (top[:, :, None] + np.arange(self.WIDTH)).reshape(len(at), -1), 1)
                cell = chars.reshape(-1, 1) * self.EMBED + np.arange(self.EMBED)
                g["embed"] = np.bincount(cell.reshape(-1), back[..., :self.EMBED].reshape(-1), 128 * self.EMBED).astype(
                    np.float32).reshape(128, self.EMBED)
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v2[k] = 0.999 * v2[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - 0.01 * (m[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def learn(self, codes: np.ndarray, y: np.ndarray, **how) -> None:
        """Trains on the windows as they are and with their context blanked."""
        blank = codes.copy()
        blank[:, :CONTEXT] = blank[:, CONTEXT + INSIDE:] = 32
        self.train(np.concatenate((codes, blank)), np.concatenate((y, y)), **how)

    def decide(self, least: float, most: float) -> None:
        """Threshold from the highest other run and the largest value that finds enough secrets."""
        least = max(0.5, least)
        self.threshold = (least + most) / 2 if least < most else max(0.5, most)


def fit(findings: DataFrame | list[tuple[str, bool]]) -> Network | None:
    """Network from all rows (window, known); None without 10 distinct windows of each label.
    A list stands for a small table."""
    if not isinstance(findings, DataFrame):
        findings = SparkSession.active().createDataFrame(findings, "window string, known boolean")
    spark = findings.sparkSession
    held = F.pmod(F.xxhash64("window", F.lit("held")), F.lit(3)) == 0
    every = keep(findings.select("window", "known").distinct().withColumn("held", held), "findings")
    n = {(r["known"], r["held"]): r["n"] for r in every.groupBy("known", "held").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(sum(v for (k, _), v in n.items() if k == known) for known in (False, True)) < 10:
        return None
    net, total = Network(), sum(v for (_, h), v in n.items() if not h)
    n_blocks = max(1, -(-total // BLOCK))
    tasks = min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = keep(every.where(~F.col("held")).withColumn("block", F.pmod(F.xxhash64("window", F.lit("block")), F.lit(n_blocks)))
                  .repartition(tasks, "block").groupBy("block")
                  .agg(F.array_sort(F.collect_list(F.struct("window", "known"))).alias("rows"))    # about BLOCK
                  .select("rows.window", "rows.known"), "blocks")
    with short_batches(spark, BLOCKS):
        for step in range(EPOCHS if total else 0):
            got = _pass(blocks, net, total, n.get((True, False), 0) / total, step).toArrow()
            mean = np.zeros(sum(v.size for v in net.p.values()))
            mean[got["at"].to_numpy()] = got["value"].to_numpy() / UNIT
            cut = np.cumsum([v.size for v in net.p.values()])[:-1]
            net.p = {k: x.reshape(v.shape).astype(np.float32) for (k, v), x in zip(net.p.items(), np.split(mean, cut))}
    calibrate(net, every.where("held"))
    return net


def _pass(blocks: DataFrame, net: Network, total: int, positive: float, step: int) -> DataFrame:
    """(at, value): the mean of the blocks' trained parameters, in UNIT parts."""
    begin = net.p

    def learn(batches):
        mean = np.zeros(sum(v.size for v in begin.values()), np.int64)
        for batch in batches:
            for said, known in zip(*(c.to_pylist() for c in batch.columns)):
                one = Network()
                one.p = dict(begin)
                one.learn(one.codes(said), np.array(known, np.float32), seed=5 + step, epochs=1, positive=positive)
                flat = np.concatenate([v.reshape(-1) for v in one.p.values()]).astype(np.float64)
                mean += np.rint(flat * (len(said) / total * UNIT)).astype(np.int64)
        at = np.flatnonzero(mean)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mean[at])], ["at", "value"])

    return blocks.mapInArrow(learn, "at bigint, value bigint").groupBy("at").agg(F.sum("value").alias("value"))


def calibrate(net: Network, held: DataFrame, recall: float = RECALL) -> None:
    """Logistic fit of the label on the logit, then the recall-constrained threshold, over all of
    ``held`` (window, known)."""
    def run(batches):
        for batch in batches:
            x = net.logits(net.codes(batch.column(0).to_pylist())).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x)], ["known", "logit"])

    scored = keep(held.select("window", "known").mapInArrow(run, "known boolean, logit double"), "logits")
    n, mean, sd = scored.agg(F.count(F.lit(1)), F.avg("logit"), F.stddev_pop("logit")).first()
    if not n:
        return
    sd += 1e-9
    u, y = (F.col("logit") - mean) / sd, F.col("known").cast("double")
    at = np.array([1.0, 0.0])
    for _ in range(NEWTON):
        p = 1 / (1 + F.exp(-F.least(F.greatest(at[0] * u + at[1], F.lit(-40.0)), F.lit(40.0))))
        ga, gb, aa, ab, bb = scored.agg(F.avg((p - y) * u), F.avg(p - y), F.avg(p * (1 - p) * u * u),
                                        F.avg(p * (1 - p) * u), F.avg(p * (1 - p))).first()
        g = np.array([ga + 1e-3 * at[0], gb])
        move = np.linalg.solve(np.array([[aa + 1e-3, ab], [ab, bb + 1e-9]]), g)
        at = at - move / max(1.0, float(np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    net.scale, net.shift = float(at[0] / sd), float(at[1] - at[0] * mean / sd)
    down = F.when(F.lit(net.scale >= 0), -F.col("logit")).otherwise(F.col("logit"))      # most probable first
    secret = scored.where("known").select(down.alias("v"))
    worst = percentile_disc(secret, [], "v", {"most": recall}).first()
    if worst is None or worst["most"] is None:
        return
    other = scored.where(~F.col("known")).agg(F.min(down)).first()[0]
    chance = lambda v: float(net.calibrated(np.array([-v if net.scale >= 0 else v]))[0])
    net.decide(0.0 if other is None else chance(other), chance(worst["most"]))


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, base, all: the rules' spans and all spans of every row, (start, end, kind)."""
    on_workers(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("known", pa.bool_()), ("window", pa.string())]))

    def find(batches):
        for batch in batches:
            base, more = [], []
            for text in batch.column(2).to_pylist():
                found = rules(text) if text else []
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                more.append([{"start": s, "end": e, "known": k, "window": w}
                             for s, e, k, w in candidates(text, found)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, span),
                                              pa.array(more, cand)], ["row", "doc_id", "base", "candidates"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    found = cut_lineage(spread(keyed, "row").mapInArrow(
        find, "row bigint, doc_id bigint, base array<struct<start:bigint,end:bigint,kind:int>>, "
              "candidates array<struct<start:bigint,end:bigint,known:boolean,window:string>>"))
    each = found.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    net = fit(each.select("window", "known"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    if net is None:
        return found.select("row", "doc_id", "base", F.col("base").alias("all"))

    def judge(batches):
        for batch in batches:
            mask = pa.array(net.probability(net.codes(batch.column(3).to_pylist())) >= net.threshold
                            if batch.num_rows else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(3)], ["row", "start", "end"])

    added = (each.where(~F.col("known")).select("row", "start", "end", "window")
             .mapInArrow(judge, "row bigint, start bigint, end bigint").groupBy("row")
             .agg(F.collect_set(F.struct("start", "end", F.lit(3).alias("kind"))).alias("added")))   # of one text
    return found.join(added, "row", "left").select("row", "doc_id", "base", F.array_sort(
        F.concat("base", F.coalesce("added", empty)),
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
    s = scan(docs)
    counts = [_number("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return s.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"))
