"""License scans by template-markup matching.

A template is wording with ``[[optional regions]]`` and ``{{name:least-most}}`` replaceable
regions of so many words. It compiles into an automaton over words; a place in a text is
accepted if all mandatory wording stands there exactly, optional regions are there whole or
not at all, and replaceable regions have a permitted length. The longest acceptance counts.
Phrases (the base) are found beside, as consecutive words.

Words: A-Z in lower case, runs of digits, letters and characters outside ASCII, compared by
64-bit hashes. score: share of the template's own words that the best accepted place holds;
0.5 for a text with base phrases only; 0 for no licence.

Edge cases: null or empty text -> no words, no labels (empty string), null places, score 0;
null ids and repeated rows -> a row each; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import hash_of, on_workers, spread, word_slices

#: Phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The default templates; any other table of the same form can be given.
TEMPLATES = {
    "agpl": "licensed under the [[gnu]] affero general public license [[version {{n:1-2}}]] [[or any later version]]",
    "apache-2.0": "licensed under the apache license [[version]] 2 0 [[the license]]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": "licensed under [[a]] [[the]] [[creative commons attribution]] cc by {{version:0-2}} [[international license]]",
    "cc-by-nc": "licensed under [[a]] [[the]] cc by nc {{version:0-2}} [[international license]]",
    "cc-by-sa": "licensed under [[a]] [[the]] cc by sa {{version:0-2}} [[international license]]",
    "copyright": "copyright {{holder:1-8}} all rights reserved",
    "gpl": "[[this work is]] licensed under the [[gnu]] general public license [[version {{n:1-2}}]] [[or any later version]]",
    "lgpl": "licensed under the [[gnu]] lesser general public license [[version {{n:1-2}}]]",
    "mit": "[[this software is]] released under the mit license",
    "mpl": "subject to the terms of the mozilla public license [[v]] [[version]] {{n:1-2}}",
    "permissive": "permission is hereby granted free of charge to any person obtaining a copy of this software",
}

_MARK = re.compile(r"\[\[|\]\]|\{\{[a-z_]*:[0-9]+-[0-9]+\}\}|[^\s\[\]{}]+")


class Automaton:
    """States are numbers; ``step[s]`` maps a word's hash to the next state, ``free[s]`` is the
    next state on any word, ``skip[s]`` the states reachable without a word."""

    def __init__(self, markup: str):
        self.step: list[dict[int, int]] = [{}]
        self.free: list[int | None] = [None]
        self.skip: list[list[int]] = [[]]
        opened, at, self.words = [], 0, 0
        for mark in _MARK.findall(markup):
            if mark == "[[":
                opened.append(at)
            elif mark == "]]":
                end = self._state()
                self.skip[at].append(end)
                self.skip[opened.pop()].append(end)
                at = end
            elif mark.startswith("{{"):
                least, most = map(int, mark[mark.index(":") + 1:-2].split("-"))
                ways = []
                for k in range(most):
                    if k >= least:
                        ways.append(at)
                    new = self._state()
                    self.free[at] = new
                    at = new
                end = self._state()
                for s in [*ways, at]:
                    self.skip[s].append(end)
                at = end
            else:
                new = self._state()
                self.step[at][int(hash_of([mark.lower()])[0])] = new
                self.words += 1
                at = new
        if opened:
            raise ValueError(f"an optional region is not closed: {markup}")
        self.accept = at
        self.first = {h for s in self._closed({0: 0}) for h in self.step[s]}
        if any(self.free[s] is not None for s in self._closed({0: 0})) or self.accept in self._closed({0: 0}):
            raise ValueError(f"a template starts with wording of its own: {markup}")

    def _state(self) -> int:
        self.step.append({})
        self.free.append(None)
        self.skip.append([])
        return len(self.step) - 1

    def _closed(self, states: dict[int, int]) -> dict[int, int]:
        """With the states reachable without a word; values: most own words matched so far."""
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in self.skip[s]:
                if states.get(t, -1) < states[s]:
                    states[t] = states[s]
                    todo.append(t)
        return states

    def match(self, words: list[int], at: int, end: int) -> float:
        """Share of the template's own words in the best acceptance from ``at``; 0 if none."""
        states, best = self._closed({0: 0}), 0
        while states and at < end:
            word, new = words[at], {}
            for s, n in states.items():
                t = self.step[s].get(word)
                if t is not None and new.get(t, -1) < n + 1:
                    new[t] = n + 1
                t = self.free[s]
                if t is not None and new.get(t, -1) < n:
                    new[t] = n
            states = self._closed(new)
            best = max(best, states.get(self.accept, 0))
            at += 1
        return best / self.words


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    on_workers(docs.sparkSession)
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def run(batches):
        machines = {label: Automaton(m) for label, m in templates.items()}
        starts: dict[int, list[str]] = {}
        for label, m in machines.items():
            for h in m.first:
                starts.setdefault(h, []).append(label)
        begin = np.sort(np.array(list(starts), np.uint64))
        longest = max(len(m.step) for m in machines.values())      # states bound the words of a match
        said = [(hash_of(p.split()), label) for p, label in phrases.items()]
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for a, b, w in word_slices(batch.column(1)):
                n, h = b - a, w.hash
                n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base = [set() for _ in range(n)]
                for words, label in said:
                    hit = np.flatnonzero(h == words[0])
                    for k in range(1, len(words)):
                        hit = hit[hit + k < len(h)]
                        hit = hit[h[hit + k] == words[k]]
                    doc = np.searchsorted(w.first, hit, side="right") - 1
                    inside = hit + len(words) <= w.first[doc + 1]
                    hit, doc = hit[inside], doc[inside]
                    place = hit - w.first[doc]
                    np.add.at(n_base, doc, 1)
                    np.minimum.at(low, doc, place)
                    np.maximum.at(high, doc, place)
                    for d in np.unique(doc):
                        base[d].add(label)
                labels, score = [set(x) for x in base], np.where(n_base > 0, 0.5, 0.0)
                at = np.searchsorted(begin, h)
                at[at == len(begin)] = 0
                for i in np.flatnonzero(begin[at] == h).tolist() if len(h) else []:
                    d = int(np.searchsorted(w.first, i, side="right")) - 1
                    end = min(int(w.first[d + 1]), i + longest)
                    words = h[i:end].tolist()
                    for label in starts[words[0]]:
                        share = machines[label].match(words, 0, len(words))
                        if share:
                            labels[d].add(label)
                            score[d] = max(score[d], share)
                out["n_words"] += np.diff(w.first).tolist()
                out["n_base"] += n_base.tolist()
                out["first_word"] += [int(x) if c else None for x, c in zip(low, n_base)]
                out["last_word"] += [int(x) if c else None for x, c in zip(high, n_base)]
                out["base_labels"] += [",".join(sorted(x)) for x in base]
                out["labels"] += [",".join(sorted(x)) for x in labels]
                out["score"] += score.tolist()
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], ["doc_id", *out])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(d, "doc_id").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
             "base_labels string, labels string, score double")
