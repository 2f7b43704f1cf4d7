"""Toxicity by a weighted finite-state grammar over clauses.

A lexer maps the words of a sentence to symbols: insult, threat, target,
negation, report, quote, speaker, halves of separable verbs, word, clause end,
sentence end. Five deterministic transducers read them in turn: *separable verbs*
puts threats of two words together, *reported speech* and *negation* mark insults and threats in their scope, *target* and *threat* decide at each
clause end what the clause says. They are composed once into one machine over
pairs of states, so a sentence is read in a single pass. A clause, not a word,
earns a score: the weight of its strongest insult times the weight of what the
clause says.

Insult words and stems are learnt from labelled rows with their log odds; the
weights of the clause kinds are fitted to the same rows, pulled towards the
values stated below. The word lists for the other symbols are fixed: threats are the
present, future and progressive forms listed, not learnt. A reporting verb behind the
clause it reports ("you idiot, he said") is not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import batches, labelled_sample

#: The lexicon and the weights are learnt from about this many labelled rows at most.
SAMPLE = 20_000
#: A learnt feature is in so many toxic rows at least, and in more toxic than clean ones.
LEAST_ROWS, LEAST_PRECISION, LEAST_G2 = 4, 0.6, 15.0
#: What a toxic row still counts once a chosen feature is in it.
DECAY = 0.4
STEM_LENGTHS = range(4, 9)

# Function words of the grammar in English, German, French and Spanish.
TARGETS = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros"
NEGATIONS = "not no never n't nor neither without nicht kein keine niemals nie pas jamais aucun ni nunca jamás ningún sin"
REPORTS = "said says say told tells wrote writes called calls quoted claimed sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó"
THREATS = (
    "kill kills killing hurt hurts hurting destroy destroys destroying murder murders murdering stab stabs stabbing shoot shoots shooting "
    "beat beats beating töten töte tötest tötet umbringen umbringe umbringst umbringt verletzen verletze verletzt tuer tue tuerai tuera "
    "frapper frappe frapperai frappera blesser blesse blesserai blessera matar mato mata mataré matará golpear golpeo golpearé golpeará "
    "herir hiero heriré herirá"
)
# German verbs that are threats with a later "um" in the same clause.
SEPARABLE = "bringen bringe bringst bringt"
SPEAKERS = "i we will gonna shall ich wir werde je nous vais yo nosotros voy"
# Weights of the clause kinds before any fit.
PRIOR = {
    "insult": 1.0, "insult at target": 1.5, "negated insult": 0.3, "reported insult": 0.3,
    "threat": 1.5, "negated threat": 0.1, "reported threat": 0.3,
}
KINDS = tuple(PRIOR)
NEGATION_SCOPE = 4
_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w+?(?=n't\b)|n't\b|\w+|[\"“”«»]|[,;:()]|[.!?\n]+")
SENTENCE_ENDS = ".!?\n"
_SENTENCE_END = re.compile(f"[{SENTENCE_ENDS}]")
_LEXEMES = {w: s for s, ws in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("T", THREATS), ("P", SPEAKERS), ("B", SEPARABLE), ("U", "um")) for w in ws.split()}

State = tuple
Machine = dict[tuple[State, str], tuple[State, str]]


def _separable(state: int, symbol: str) -> tuple[int, str]:
    """1: a verb of the clause waits for its other half, which makes it a threat."""
    if symbol == "B":
        return 1, "W"
    if symbol == "U":
        return 0, "T" if state else "W"
    return (0 if symbol in ("E", "S") else state), symbol


def _reported(state: int, symbol: str) -> tuple[int, str]:
    """0: plain, 1: after a reporting verb until the sentence ends, 2: inside quotes."""
    if symbol == "Q":
        return (0 if state == 2 else 2), "W"
    if symbol == "R":
        return (state or 1), "W"
    if symbol == "S":
        return 0, symbol
    return state, symbol + "r" if state and symbol in ("I", "T") else symbol


def _negated(state: int, symbol: str) -> tuple[int, str]:
    """The state counts the words that a negation still reaches."""
    if symbol == "N":
        return NEGATION_SCOPE, "W"
    if symbol in ("E", "S"):
        return 0, symbol
    return max(0, state - 1), symbol + "n" if state and symbol[0] in "IT" else symbol


#: How a clause is read: its strongest insult and threat so far, whether a target and a speaker are in it.
_RANK = {"": 0, "In": 1, "Irn": 1, "Ir": 2, "I": 3, "Tn": 4, "Trn": 4, "Tr": 5, "T": 6}


def _clause(state: tuple[str, bool, bool], symbol: str) -> tuple[tuple[str, bool, bool], str]:
    """Emits the kind of the clause at its end, and nothing before."""
    best, target, speaker = state
    if symbol in ("E", "S"):
        return ("", False, False), _kind(best, target, speaker)
    if symbol == "Y":
        target = True
    elif symbol == "P":
        speaker = True
    elif symbol[0] in "IT":
        held = {x[0]: x for x in best.split()}
        held[symbol[0]] = max(held.get(symbol[0], ""), symbol, key=_RANK.__getitem__)
        best = " ".join(sorted(held.values()))
    return (best, target, speaker), ""


def _kind(best: str, target: bool, speaker: bool) -> str:
    """A threat needs a target or a speaker, before or after it."""
    best = max((x for x in best.split() if x[0] == "I" or target or speaker), key=_RANK.__getitem__, default="")
    if not best:
        return ""
    name = "insult" if best[0] == "I" else "threat"
    if "n" in best:
        return f"negated {name}"
    if "r" in best:
        return f"reported {name}"
    if name == "threat":
        return "threat"
    return "insult at target" if target else "insult"


def compose() -> tuple[State, Machine]:
    """One machine over the states of all transducers, found by walking from the start."""
    start = (0, 0, 0, ("", False, False))
    machine: Machine = {}
    todo = [start]
    while todo:
        state = todo.pop()
        for symbol in "ITYNRQPWESBU":
            if (state, symbol) in machine:
                continue
            verb, out = _separable(state[0], symbol)
            a, out = _reported(state[1], out)
            b, out = _negated(state[2], out)
            c, out = _clause(state[3], out)
            machine[state, symbol] = ((verb, a, b, c), out)
            todo.append((verb, a, b, c))
    return start, machine


@dataclass
class Grammar:
    """The learnt part: weights of words and stems, weights of clause kinds, bias."""

    words: dict[str, float]
    stems: dict[str, float]
    kinds: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self._open()

    def _open(self) -> None:
        self.start, self.machine = compose()
        self.anchors = ahocorasick.Automaton()
        for stem in self.stems:
            self.anchors.add_word(stem, (len(stem), False))
        for word in [*self.words, *THREATS.split(), *SEPARABLE.split()]:
            self.anchors.add_word(word, (len(word), word not in self.stems))
        if len(self.anchors):
            self.anchors.make_automaton()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("words", "stems", "kinds", "bias")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def weight(self, word: str) -> float:
        """Log odds of a word as an insult; 0 if it is none."""
        best = self.words.get(word, 0.0)
        for n in STEM_LENGTHS:
            if n > len(word):
                break
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def sentences(self, text: str) -> list[tuple[int, int]]:
        """Spans of the sentences that hold an anchor, from one scan of the text."""
        spans: list[tuple[int, int]] = []
        if not len(self.anchors):
            return spans
        for end, (n, whole) in self.anchors.iter(text):
            first = end - n + 1
            if first and text[first - 1].isalnum() or whole and end + 1 < len(text) and text[end + 1].isalnum():
                continue
            if spans and first < spans[-1][1]:
                continue
            # From the last span on, so that no part of a text is searched twice.
            after = spans[-1][1] if spans else 0
            begin = max(after, *(text.rfind(c, after, first) + 1 for c in SENTENCE_ENDS))
            stop = _SENTENCE_END.search(text, end + 1)
            spans.append((begin, stop.end() if stop else len(text)))
        return spans

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """The matched clauses of a text: kind and the weight of the strongest insult."""
        text = text.lower().replace("’", "'")
        found = []
        for begin, stop in self.sentences(text):
            state, strongest = self.start, 0.0
            for token in [*_TOKEN.findall(text, begin, stop), "\n"]:
                weight = 0.0
                if token[0] in ".!?\n":
                    symbol = "S"
                elif token in ",;:()":
                    symbol = "E"
                elif token in "\"“”«»":
                    symbol = "Q"
                elif (symbol := _LEXEMES.get(token, "")) == "" or symbol != "T":
                    weight = self.weight(token)
                    symbol = "I" if weight else symbol or "W"
                state, kind = self.machine[state, symbol]
                strongest = max(strongest, weight)
                if symbol in ("E", "S"):
                    if kind:
                        found.append((kind, strongest if "insult" in kind else 3.0))
                    strongest = 0.0
        return found

    def features(self, text: str) -> list[float]:
        """Per clause kind the log of one plus the summed weights."""
        sums: dict[str, float] = defaultdict(float)
        for kind, weight in self.clauses(text):
            sums[kind] += weight
        return [math.log1p(sums[k]) for k in KINDS]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ np.array([self.kinds[k] for k in KINDS]), -30, 30)))


def _candidates(text: str) -> set[str]:
    """Whole words, and stems marked by a trailing ``*``."""
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in STEM_LENGTHS if n < len(w)}


def _counted(rows: DataFrame, among: set[str] | None) -> DataFrame:
    """(feature, n): rows that hold the feature; summed per task before the shuffle."""

    def count(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 4000, 32 << 20):
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = _candidates(text)
                seen.update(found if among is None else found & among)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return rows.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def chosen(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> set[str]:
    """Features that are in more toxic than clean rows, beyond chance."""
    return {
        f
        for f, a in toxic.items()
        if a >= LEAST_ROWS and a > (b := clean.get(f, 0)) and _g2(a, b, n_toxic, n_clean) >= LEAST_G2
    }


def _g2(a: float, b: float, n_toxic: int, n_clean: int) -> float:
    """Likelihood ratio of a feature in ``a`` toxic and ``b`` clean rows; 0 if it is not over its share."""
    ea, eb = (a + b) * n_toxic / (n_toxic + n_clean), (a + b) * n_clean / (n_toxic + n_clean)
    return 0.0 if a <= ea else 2 * (a * math.log(a / ea) + (b * math.log(b / eb) if b else 0))


def lexicon(rows: list[list[str]], clean: dict[str, int], n_toxic: int, n_clean: int) -> tuple[dict, dict]:
    """Weights of words and stems, from the chosen features of each toxic row.

    Greedy cover: the feature with the highest likelihood ratio is taken, and the
    rows it is in count less from then on. So a word that is only near real
    insults, or in a group of copies that they already explain, is left out.
    Of features in the same rows, words go before stems and long stems before short.
    """
    names = sorted({f for row in rows for f in row}, key=lambda f: (f.endswith("*"), -len(f), f))
    index = {f: i for i, f in enumerate(names)}
    of_row = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    flat = np.array([index[f] for row in rows for f in row], np.int64)
    b = np.array([clean.get(f, 0) for f in names], float)
    full = np.bincount(flat, minlength=len(names))
    weight, taken = np.ones(len(rows)), np.zeros(len(names), bool)
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    while len(names) > taken.sum():
        a = np.bincount(flat, weight[of_row], len(names))
        usable = ~taken & (a / (a + b + 1) >= LEAST_PRECISION) & (a >= 2)
        gain = np.array([_g2(x, y, n_toxic, n_clean) if ok else 0.0 for x, y, ok in zip(a, b, usable, strict=True)])
        best = int(gain.argmax())
        if gain[best] < LEAST_G2:
            break
        taken[best] = True
        here = of_row[flat == best]
        odds = math.log((len(here) + 0.5) / (n_toxic + 1)) - math.log((b[best] + 0.5) / (n_clean + 1))
        name = names[best].rstrip("*")
        (stems if names[best].endswith("*") else words)[name] = odds
        weight[here] *= DECAY
        sure = names[best].endswith("*") and b[best] <= 0.05 * len(here)
        for i, other in enumerate(names):
            # Shorter stems of the same rows say no more, and longer forms of a sure stem neither.
            shorter = other.endswith("*") and name.startswith(other[:-1]) and full[i] == len(here)
            taken[i] |= shorter or (sure and other.rstrip("*").startswith(name))
    return words, stems


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    sample: int = SAMPLE, seed: int = 29, pull: float = 0.02,
) -> Grammar:
    """Learn lexicon and weights from about ``sample`` labelled rows.

    Without toxic rows the lexicon is empty and only threats can score.
    """
    rows = labelled_sample(docs, labels, label, doc_id, text, sample, seed).checkpoint()
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    toxic = {r["feature"]: r["n"] for r in _counted(rows.filter("y = 1"), None).filter(F.col("n") >= LEAST_ROWS).collect()}
    clean = {r["feature"]: r["n"] for r in _counted(rows.filter("y = 0"), set(toxic)).collect()} if toxic else {}
    usable = chosen(toxic, clean, max(1, n_toxic), max(1, n_clean))

    def listed(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            found = [sorted(_candidates(t) & usable) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"found": pa.array(found, pa.list_(pa.string()))})

    # At most SAMPLE rows, the toxic ones among them.
    toxic_rows = sorted(r["found"] for r in rows.filter("y = 1").select("text").mapInArrow(listed, "found array<string>").collect())
    words, stems = lexicon(toxic_rows, clean, max(1, n_toxic), max(1, n_clean))
    grammar = Grammar(words, stems, dict(PRIOR), -3.0)
    shared = rows.sparkSession.sparkContext.broadcast(grammar)

    def read(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            x = [shared.value.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": batch.column(1)})

    # Rows with the same features are counted together: few patterns come to the driver.
    seen = rows.select("text", "y").mapInArrow(read, "x array<double>, y int").groupBy("x", "y").count().collect()
    if seen:
        x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float)
        weights, bias = _logistic(x, y, np.array([r["count"] for r in seen], float), np.array([PRIOR[k] for k in KINDS]), pull)
        grammar = Grammar(words, stems, dict(zip(KINDS, map(float, weights), strict=True)), bias)
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, pull: float) -> tuple[np.ndarray, float]:
    """Newton steps on the log loss, pulled to the prior; weights stay at zero or above."""
    z = np.hstack([x, np.ones((len(x), 1))])
    start = np.append(prior, -3.0)
    w, strength = start.copy(), pull * n.sum() * np.append(np.full(len(prior), 0.05), 1e-4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (n * (p - y)) + strength * (w - start)
        curve = (z * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(strength + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, matches) per document; ``matches`` counts the clauses of each kind.

    Whole texts are read. Null and empty texts match nothing and get the score of
    a text without a clause. Repeated rows give repeated results, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def scored(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            found = [shared.value.clauses(t) if t else [] for t in batch.column(1).to_pylist()]
            x = np.zeros((len(found), len(KINDS)))
            for i, clauses in enumerate(found):
                for kind, weight in clauses:
                    x[i, KINDS.index(kind)] += weight
            counts = [dict(Counter(k for k, _ in clauses)) for clauses in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.score(np.log1p(x))), pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64()))],
                ["_id", "score", "matches"],
            )

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(scored, f"_id {kind}, score double, matches map<string,bigint>").withColumnRenamed("_id", doc_id)
