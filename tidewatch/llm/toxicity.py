"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers are composed.  The first is an automaton over letters that rewrites a text to symbols: insult (with a
weight), threat, target, negation, reported speech, other.  The second reads the symbols of one clause and keeps a state
(how long a negation still holds, whether speech is reported, whether somebody is addressed); every insult or threat it
passes puts out its weight, changed by the state.  The third adds the clauses of a document up and maps the sum to a
probability.  Only clauses with an insult or a threat are read symbol by symbol.

Insult words and stems, with their weights, and the last mapping are learned from labelled rows: a bounded sample, one
half for the lexicon and the other for the mapping.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import grams, held, only, slices, words_of

MAX_LABELLED = 24_000  # labelled rows that are learned from
MAX_LEXICON = 4_000  # words and stems kept
MIN_TEXTS = 4  # different toxic texts that must hold an entry
STEMS = (4, 5, 6, 7)

# The closed word classes of the grammar, in English, German, French and Spanish.
THREATS = frozenset("kill murder hurt destroy beat stab shoot strangle töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset(
    "you your yours he she him her they them their his du dich dir ihr euch sie er tu te toi vous il elle ils elles ti usted ustedes él ella ellos".split()
)
NEGATIONS = frozenset("not no never neither nor without isn aren wasn don doesn nicht kein keine keinen nie niemals pas jamais aucun aucune ni nunca jamás sin".split())
REPORTS = frozenset(
    "said says say told claimed called quoted wrote reported sagte sagt sagten nannte schrieb dit disait appelé écrit dijo dice decía llamó escribió".split()
)
NEGATION_REACH = 3  # words after a negation that it covers
NEGATED, REPORTED, TARGETED = 0.35, 0.6, 1.25
THREAT, BARE_THREAT = 3.0, 0.4

TOKEN = re.compile(r"[^\W\d_]+")
BREAK = ".!?;:\n"


def step(state: tuple[int, bool, bool], word: str) -> tuple[int, bool, bool]:
    """Transition of the clause transducer on a word that puts nothing out."""
    negated, reported, target = state
    return (
        NEGATION_REACH if word in NEGATIONS else max(0, negated - 1),
        reported or word in REPORTS,
        target or word in TARGETS,
    )


def clause_output(words: list[str], weights: list[float]) -> float:
    """Output of the clause transducer; ``weights`` has the insult weight of every word, 0 for other words."""
    addressed = any(w in TARGETS for w in words)
    state, total = (0, False, False), 0.0
    for word, weight in zip(words, weights, strict=True):
        if word in THREATS:
            weight = max(weight, THREAT if addressed else BARE_THREAT)
        if weight:
            factor = NEGATED if state[0] else 1.0
            factor *= REPORTED if state[1] else 1.0
            total += weight * factor * (TARGETED if addressed else 1.0)
        state = step(state, word)
    return total


@dataclass
class Model:
    lexicon: dict[str, float]  # "word$" is a whole word, others are stems
    bias: float = -4.0
    slope: float = 3.0
    spread: float = 1.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"lexicon": self.lexicon, "bias": self.bias, "slope": self.slope, "spread": self.spread, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry in [*self.lexicon, *(t + "$" for t in THREATS)]:
                a.add_word(entry.rstrip("$"), len(entry.rstrip("$")))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def weight(self, word: str) -> float:
        """Weight of a word: that of the word itself or of its heaviest stem."""
        best = self.lexicon.get(word + "$", 0.0)
        for n in STEMS:
            if n <= len(word):
                best = max(best, self.lexicon.get(word[:n], 0.0))
        return best

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Summed output of all clauses, and how many put something out."""
        if not text or not len(self.automaton()):
            return 0.0, 0
        low = text.lower()
        total, clauses, done = 0.0, 0, 0
        for last, size in self.automaton().iter(low):
            start = last + 1 - size
            if start < done or low[max(0, start - 1) : start].isalpha():
                continue
            begin = max(low.rfind(c, done, start) for c in BREAK) + 1 or done
            ends = [e for e in (low.find(c, last + 1) for c in BREAK) if e >= 0]
            done = min(ends, default=len(low))
            words = TOKEN.findall(low, begin, done)
            value = clause_output(words, [self.weight(w) for w in words])
            if value:
                total += value
                clauses += 1
        return total, clauses

    def score(self, evidence: float, clauses: int) -> float:
        z = self.bias + self.slope * math.log1p(evidence) + self.spread * math.log1p(clauses)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, text, toxic)`` of the rows that may teach: labelled, and the id's crc32 modulo 3 is not 1."""
    known = only(labels, id="doc_id", toxic="toxic").where("toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    return only(docs, id="doc_id", text="text").where(held("id", 3) != 1).join(known, "id").where("text is not null")


def _group_keys(batch: pa.RecordBatch) -> list[int]:
    """The smallest five-word shingle of each text: near copies mostly share it."""
    out: list[int] = []
    for _, data, offsets in slices(batch):
        hashes, _, _, bounds = words_of(data, offsets, lower=True)
        runs = grams(hashes, 5)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = runs[a : b - 4] if b - a >= 5 else hashes[a:b]
            out.append(int(own.min().view(np.int64)) if len(own) else 0)
    return out


def _entries(text: str) -> set[str]:
    out = set()
    for word in set(TOKEN.findall(text.lower())):
        if len(word) >= 3:
            out.add(word + "$")
        out.update(word[:n] for n in STEMS if n <= len(word))
    return out


def learn_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Words and stems that stand out in toxic texts, from ``(entry, toxic texts, clean texts)``."""
    kept: dict[str, tuple[float, int]] = {}
    for entry, a, b in counts:
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        chance = math.sqrt(max(1e-12, (a + b) * toxic / max(1, toxic + clean)))
        if a >= MIN_TEXTS and weight > 1.5 and a - (a + b) * toxic / max(1, toxic + clean) > 3.0 * chance and a > b:
            kept[entry] = (weight, a)
    # of a stem and its extension the longer stays if it covers nearly the same texts, else the shorter
    out: dict[str, float] = {}
    for entry, (weight, a) in kept.items():
        stems = [entry[:n] for n in STEMS if n < len(entry) and entry[:n] in kept]
        if any(kept[s][1] * 0.8 > a for s in stems):
            continue
        out[entry] = weight
    longer = {e[:n]: max(a, 0) for e in out for n in STEMS if n < len(e) for a in (kept[e][1],)}
    out = {e: w for e, w in out.items() if not (e in longer and longer[e] >= 0.8 * kept[e][1])}
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MAX_LEXICON])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Lexicon and mapping from at most about ``limit`` labelled rows; without any, a model that scores threats only."""
    rows = training_rows(docs, labels)
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, limit / max(1, n))))
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_group_keys(batch), pa.int64()), batch.column(0), batch.column(1)], names=["group", "text", "toxic"])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(bool(toxic))].update({"", *_entries(text)})
            names = list({**seen[0], **seen[1]})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())],
                names=["entry", "a", "b"],
            )

    texts = chosen.where(half).select("text", "toxic").mapInArrow(keyed, "group long, text string, toxic int")
    once = texts.groupBy("group", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    totals = once.mapInArrow(counted, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = [tuple(r) for r in totals.where((F.col("entry") == "") | ((F.col("a") >= MIN_TEXTS) & (F.col("a") > F.col("b")))).collect()]
    toxic, clean = next(((a, b) for e, a, b in found if e == ""), (0, 0))
    model = Model(learn_lexicon([x for x in found if x[0]], toxic, clean))

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [model.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in own], pa.float64()), pa.array([c for _, c in own], pa.int64()), batch.column(1)], names=["e", "c", "toxic"])

    sample = chosen.where(~half).select("text", "toxic").mapInArrow(measured, "e double, c long, toxic int").toPandas()
    if len(sample) and sample["toxic"].nunique() > 1:
        model.bias, model.slope, model.spread = _logistic(sample["e"].to_numpy(), sample["c"].to_numpy(), (sample["toxic"] > 0).to_numpy(dtype=np.float64))
    return model


def _logistic(evidence: np.ndarray, clauses: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression towards the default mapping, by Newton's method."""
    x = np.column_stack([np.ones(len(y)), np.log1p(evidence), np.log1p(clauses)])
    prior = np.array([-4.0, 3.0, 1.0])
    theta, ridge = prior.copy(), np.array([0.01, 0.5, 0.5])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (theta - prior)
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        theta -= np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-8:
            break
    return float(theta[0]), float(max(0.0, theta[1])), float(max(0.0, theta[2]))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, clauses, evidence)``, one row per input row.

    Null and empty texts get the score of a text without any hit.  Equal texts get equal scores whatever their id; rows
    without id are scored too.  Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [model.evidence(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([model.score(e, c) for e, c in own], pa.float64()), pa.array([c for _, c in own], pa.int64()),
                    pa.array([e for e, _ in own], pa.float64()),
                ],
                names=["doc_id", "score", "clauses", "evidence"],
            )

    rows = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, score double, clauses long, evidence double")
