"""Toxicity: Levenshtein automata over a lexicon trie, with context-window scores.

The lexicon is learned: words and word beginnings (written ``stem*``) that mark labelled toxic
texts. All terms stand in one trie. The trie and the Levenshtein automata of its terms are walked
together and made deterministic as words ask for it, so a word costs one look-up a letter until
no term can match. Terms of ``FUZZY`` letters and more may be one edit away; near-misses that
clean labelled texts use are excepted.

A hit's strength is its term's log-odds, halved for an edit. Hits between an opening quotation
mark and the one that closes it, at most ``QUOTED`` words on (straight and round ones, single and
double, angles turned either way; an apostrophe within a word is no mark), and hits right after a word of
reporting (with one other word between at most, which doesn't address anyone) count as quotation
and are summed apart from the rest. A logistic model weighs these sums.

Learning looks at about ``SAMPLE`` labelled rows (a share of the ids' hashes), none of the fold
crc32(doc_id as text) mod 4 = 2. Half of them choose the lexicon, half fit the logistic model.
Labels, language, source and id never enter a score. Scoring covers every whole text. What the
driver gets is bounded by the sample and the lexicon: ``TERMS`` terms at most, the sampled words
within an edit of one of them, and six numbers for each sampled row.

Cases: a null text counts as empty and is scored too; null labels are left out; a document with
several labels has the highest; with no usable label every score is 0; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, cut, hash_share

SAMPLE = 20_000
TERMS = 4_000
LEAST_TEXTS = 4
LEAST_ODDS = 3.0
STEMS = range(4, 8)
FUZZY = 5
QUOTED = 25
FOLDS = 4
HELD_OUT = 2
#: Distinct words whose match is kept per worker.
KEPT = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile("[\"“”„«»‹›'‘’‚]")
_SINGLE, _ANGLES = frozenset("'‘’‚"), frozenset("«»‹›")
# fixed values: words that report speech, and words that address someone
REPORTING = frozenset("said says quoted quote quotes wrote writes called calls word term dit dijo sagte citation cita zitat".split())

ADDRESSING = frozenset("you your youre u ya du dein deine ihr euch tu te ti tú vous toi votre usted ustedes vosotros".split())


def _turn(mark: str, before: str, after: str) -> int:
    """1 where the mark opens, -1 where it closes, 0 for an apostrophe. Which way one points is told
    by what stands beside it, for languages differ in that: a mark that clings to a word on one side
    alone opens before it and closes after it. Where that says nothing (as with blanks on both
    sides), the usual way of the mark holds."""
    ended = before.isalnum() or before in ".,!?;:…"
    if mark in "„‚":
        return 1
    if mark in _SINGLE:
        if ended or (before in "\"”“«»" and not after.isalnum()):
            return 0 if after.isalnum() else -1
        return 1 if mark != "’" and after.isalnum() else 0
    if mark in _ANGLES:
        if mark in "»›":
            return 1 if after.isalnum() and not ended else -1
        return -1 if ended and not after.isalnum() else 1
    return 1 if not before.isalnum() and not after.isspace() and before not in ".,!?;:" else -1


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each stretch between an opening quotation mark and the next closing one, in
    order of their ends; single marks pair among themselves, within or without other ones."""
    spans, opened = [], [None, None]
    for m in _MARK.finditer(text):
        at, mark = m.start(), m[0]
        turn = _turn(mark, text[at - 1] if at else " ", text[at + 1] if at + 1 < len(text) else " ")
        kind = mark in _SINGLE
        if turn > 0:
            opened[kind] = at
        elif turn < 0 and opened[kind] is not None:
            spans.append((opened[kind], at))
            opened[kind] = None
    return spans


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as stretches that don't meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Matcher:
    """Words to the strongest term within reach. terms: term or ``stem*`` to log-odds."""

    def __init__(self, terms: dict[str, float], excepted: frozenset[str] = frozenset()):
        self.excepted = excepted
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[float, bool, int]]] = [[]]
        self.reach = [0]
        for term, odds in sorted(terms.items()):
            stem, edits = term.rstrip("*"), int(len(term.rstrip("*")) >= FUZZY + term.endswith("*"))
            node = 0
            self.reach[0] = max(self.reach[0], edits)
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            self.ends[node].append((odds, term.endswith("*"), edits))
        # deterministic states, found as needed: their positions, moves, and what they accept
        self.states: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.positions: list[tuple[tuple[int, int], ...]] = []
        self.final: list[tuple[float, int]] = []
        self.open: list[tuple[float, int]] = []
        self.start = self._state({(0, 0)})
        self.memo: dict[str, tuple[float, int] | None] = {}

    def _state(self, positions: set[tuple[int, int]]) -> int:
        todo = list(positions)
        while todo:  # letters of the term that the word lacks
            node, edits = todo.pop()
            for child in self.children[node].values() if edits < self.reach[node] else ():
                if edits + 1 <= self.reach[child] and (child, edits + 1) not in positions:
                    positions.add((child, edits + 1))
                    todo.append((child, edits + 1))
        key = tuple(sorted(positions))
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.moves.append({})
            self.positions.append(key)
            reached = [(odds, -e, stem) for node, e in key for odds, stem, most in self.ends[node] if e <= most]
            best = max(((e == 0, o, e) for o, e, _ in reached), default=(False, 0.0, 0))
            stems = max(((e == 0, o, e) for o, e, stem in reached if stem), default=(False, 0.0, 0))
            self.final.append((best[1], -best[2]))
            self.open.append((stems[1], -stems[2]))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        found = set()
        for node, edits in self.positions[state]:
            if c in self.children[node]:
                found.add((self.children[node][c], edits))
            if edits < self.reach[node]:
                found.add((node, edits + 1))  # a letter too many
                found.update((child, edits + 1) for child in self.children[node].values() if self.reach[child] > edits)
        self.moves[state][c] = to = self._state(found) if found else -1
        return to

    def match(self, word: str) -> tuple[float, int] | None:
        """(log-odds, edits) of the best term, an exact one before any other."""
        if word in self.memo:
            return self.memo[word]
        state, stems = self.start, (0.0, 0)
        for c in word:
            state = self.moves[state].get(c) if c in self.moves[state] else self._move(state, c)
            if state < 0:
                break
            if self.open[state][0] and (not stems[0] or self.open[state][1] < stems[1]):
                stems = self.open[state]
        found = self.final[state] if state >= 0 else (0.0, 0)
        if not found[0] or (stems[0] and stems[1] < found[1]):
            found = stems
        hit = found if found[0] and not (found[1] and word in self.excepted) else None
        if len(self.memo) >= KEPT:
            self.memo.clear()
        self.memo[word] = hit
        return hit


def citation(lowered: str, words: list[str]) -> Callable[[int], bool]:
    """Whether word k of a text stands in quotation."""
    spans: list[tuple[int, int]] = []
    if _MARK.search(lowered):
        at = [m.start() for m in _WORD.finditer(lowered)]
        # stretches between marks, as words; one that goes on for long doesn't quote a word
        spans = _joined([(a, b) for a, b in (np.searchsorted(at, span).tolist() for span in quoted_spans(lowered)) if b - a <= QUOTED])
    ends = [b for _, b in spans]

    def cited(k: int) -> bool:
        s = bisect.bisect_right(ends, k)
        if s < len(spans) and spans[s][0] <= k:
            return True
        return k > 0 and (words[k - 1] in REPORTING or (k > 1 and words[k - 2] in REPORTING and words[k - 1] not in ADDRESSING))

    return cited


N_EVIDENCE = 6


def evidence(matcher: Matcher, text: str) -> list[float]:
    """What a text has of hits: abuse, exact or not, quotation, and how dense and how many."""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    known, match = matcher.memo, matcher.match
    hits = [(k, h) for k, w in enumerate(words) if (h := known[w] if w in known else match(w))]
    if not hits:
        return [0.0] * N_EVIDENCE
    cited = citation(lowered, words)
    abuse = quoted = strongest = edited = 0.0
    for k, (odds, edits) in hits:
        strength = odds * 0.5**edits
        if cited(k):
            quoted += strength
        else:
            abuse += strength
            strongest = max(strongest, strength)
            edited += strength if edits else 0.0
    return [float(abuse > 0), np.log1p(abuse), strongest, edited / (1 + abuse), 100 * abuse / max(20, len(words)), np.log1p(quoted)]


def _learning(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """_text, _y and _half (which one learns the lexicon) of the labelled rows that are learned from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), FOLDS) != HELD_OUT))
    known = known.groupBy(F.col(id_col).alias("_doc")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    known = cut(known)
    few = F.broadcast(cut(known.where(hash_share(F.col("_doc"), sample, known.count())).limit(2 * sample)))  # bounded
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(few, F.col("_id") == F.col("_doc"))
    return joined.select(F.coalesce("_text", F.lit("")).alias("_text"), "_y", (F.xxhash64("_id", F.lit(7)) % 2 == 0).alias("_half"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """term, toxic and clean: texts that have the word or word beginning outside of quotation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=["term", "toxic", "clean"])
            counts.clear()
            return batch

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lowered = text.lower()
                said = _WORD.findall(lowered)
                cited = citation(lowered, said)
                words = {w for k, w in enumerate(said) if not cited(k)}
                terms = words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}
                for term in terms:
                    counts.setdefault(term, [0, 0])[0 if y else 1] += 1
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    parts = rows.select("_text", "_y").mapInArrow(run, "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(found: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms with strong odds. A longer stem or a short word goes where a stem of it says as much."""
    odds = {t: float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))) for t, a, b in found}
    clean, chosen = {t: b for t, _, b in found}, {}
    for t, _, _ in sorted(found, key=lambda x: (len(x[0].rstrip("*")), x[0])):
        stem = t.rstrip("*")
        shorter = [f"{stem[:n]}*" for n in STEMS if n < len(stem) + (not t.endswith("*"))]
        whole = not t.endswith("*") and len(t) >= FUZZY  # stays, for a stem doesn't reach its misspellings
        if whole or not any(s in chosen and s != t and clean[s] <= clean[t] for s in shorter):
            chosen[t] = odds[t]
    return chosen


class Model:
    def __init__(self, matcher: Matcher | None = None, weights: np.ndarray | None = None):
        self.matcher, self.weights = matcher, weights

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        rows = np.array([[*evidence(self.matcher, t), 1.0] for t in texts]).reshape(len(texts), N_EVIDENCE + 1)
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))


def logistic(rows: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps; the last column is the constant and isn't shrunk."""
    weights, shrink = np.zeros(rows.shape[1]), np.full(rows.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        curve = rows.T @ (rows * (p * (1 - p))[:, None]) + np.diag(shrink)
        step = np.linalg.solve(curve, rows.T @ (p - y) + shrink * weights)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    rows = _learning(docs, labels, id_col, text_col, label_col, sample)
    counted = {y: n for y, n in rows.where("_half").groupBy("_y").count().collect()}
    if not counted.get(1):
        return Model()
    counts = cut(_word_counts(rows.where("_half")))
    n_toxic, n_clean = counted[1], counted.get(0, 0)
    rare = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    strong = counts.where((F.col("toxic") >= LEAST_TEXTS) & (rare >= LEAST_ODDS)).orderBy(F.desc("toxic"), "term").limit(TERMS)
    terms = choose_terms([tuple(r) for r in strong.select("term", "toxic", "clean").collect()], n_toxic, n_clean)
    if not terms:
        return Model()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if (h := matcher.match(w)) and h[1]]
            yield pa.RecordBatch.from_pydict({"term": pa.array(words, pa.string())})

    used = counts.where("clean > 0 AND term NOT LIKE '%*'").select("term").mapInArrow(near, "term string")
    matcher = Matcher(terms, frozenset(r[0] for r in used.collect()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(matcher, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    half = rows.where("NOT _half").select("_text", "_y").mapInArrow(measure, "x array<double>, y int").collect()
    if not any(r.y for r in half):
        return Model()
    x = np.array([[*r.x, 1.0] for r in half])
    matcher.memo.clear()
    return Model(matcher, logistic(x, np.array([float(r.y) for r in half])))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: its id, held_out, score and predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, score double")
    return scored.select(
        F.col("_id").alias(id_col), (crc_mod(F.col("_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
