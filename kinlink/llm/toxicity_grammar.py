"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read a text clause by clause, token by token. Negation weakens the insults and threats in its scope; the insult machine makes insult phrases of stems, the threat machine threat phrases of an intent and a verb; reported speech sets off what is quoted or mentioned; the target machine matches phrases with whom they are directed at, and untargeted ones with the abuse that came before. They are composed into one automaton. What it puts out are matches: a word of the lexicon that stands alone, with no target in its clause and no other abuse in the text, puts out nothing. A text is scored by how many of its clauses hold which matches.

The stems are those of a small fixed lexicon and those that labelled documents show to be toxic; the weights of the matches are fitted on the same labelled documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, staged, table

FIT_ROWS = 16_000  # labelled documents that arcs and weights are fitted on, at most
HELD_OUT = 2  # crc32(doc_id) mod FOLDS of documents whose labels are never read
FOLDS = 4
CUT = 0.3
STEMS = range(4, 9)  # letters in a learned stem
LEAST_G = 24.0  # evidence for a stem, as a log-likelihood ratio
STRONG, MILD = 0.8, 0.5  # share of toxic documents among those with the stem
MOST_STEMS = 20_000
_KEPT = 300_000  # tokens whose symbols a worker remembers

# The lexicon that holds without labels.
INSULTS = "idiot moron stupid scum trash pathetic loser worthless disgusting clown dumb imbecile bastard idiota imbécil estúpido basura escoria dummkopf idioten abschaum arschloch dreck connard imbécile ordure abruti minable".split()
THREATS = "kill hurt destroy beat strangle stab shoot matar golpear töten schlagen umbringen tuer frapper détruire".split()
INTENTS = "will i'll we'll gonna going shall must should werde werden soll sollte wollen vais allons dois doit voy vamos debe quiero".split()
TARGETS = "you your yours you're du dich dein deine euch tu te toi vous votre vosotros tus usted ustedes".split()
PERSONS = "they them their he him his she her er ihn sie ihr il elle ils elles lui él ella ellos ellas".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais nunca tampoco".split()
REPORTS = "said says say called claimed wrote reported quoted word words term phrase means sagte nannte behauptete schrieb wort begriff disait appelait écrivait mot terme dijo llamó escribió palabra".split()

# Input symbols: other, mild insult, strong insult, threat verb, intent, target, person, negation, report, clause end.
INPUT = "oiItmyhnrb"
# What the insult and threat machines put out: mild and full insult phrases, threat verbs alone and full threats.
PHRASES = "xXwW"
# Output symbols: mild and full insults at a target (d, D), at a person (e), threat verbs and full threats at a target (u, T), full threats at nobody (S), mild and full insults in a text that has insulted before (M, R), a target named after a phrase (Y), quoted phrases (q).
OUTPUT = "dDeuTSMRYq"
_END = 16  # flag of a token after which the clause ends
_STOPS = ".!?;…"


class Transducer:
    """arcs: (state, symbol) to (state, symbol put out). What has no arc is passed on and keeps the state. ends: the states after a clause end, 0 if not told."""

    def __init__(self, states: int, arcs: dict[tuple[int, str], tuple[int, str]], ends: dict[int, int] | None = None):
        self.states, self.arcs, self.ends = states, arcs, ends or {}

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        if symbol == "b":
            return self.ends.get(state, 0), "b"
        return self.arcs.get((state, symbol), (state, symbol))


def _within(scope: int, opens: str, changed: dict[str, str], alone: dict[str, str]) -> dict[tuple[int, str], tuple[int, str]]:
    """Arcs of a machine that counts down the symbols left in a scope that opens begins: changed says what becomes of symbols in it, alone of those outside."""
    arcs = {(s, opens): (scope, "o") for s in range(scope + 1)}
    for c in INPUT[:-1] + PHRASES:
        if c != opens:
            arcs |= {(s, c): (s - 1, changed.get(c, c)) for s in range(1, scope + 1)} | {(0, c): (0, alone.get(c, c))}
    return arcs


def negation(scope: int = 3) -> Transducer:
    """A negation weakens what follows within scope tokens: strong insults to mild ones, mild ones and threats to nothing."""
    return Transducer(scope + 1, _within(scope, "n", {"I": "i", "i": "o", "t": "o"}, {}))


def insult() -> Transducer:
    """A strong stem is an insult phrase; a mild one is one if another stem came before it in the clause."""
    return Transducer(2, {(0, "i"): (1, "x"), (1, "i"): (1, "X"), (0, "I"): (1, "X"), (1, "I"): (1, "X")})


def threat(scope: int = 4) -> Transducer:
    """A threat verb within scope tokens of an intent is a threat."""
    return Transducer(scope + 1, _within(scope, "m", {"t": "W"}, {"t": "w"}))


def reported() -> Transducer:
    """After a verb of report or a word for words, the phrases of the clause are quoted."""
    return Transducer(2, {(s, "r"): (1, "o") for s in (0, 1)} | {(1, c): (1, "q") for c in PHRASES})


def target() -> Transducer:
    """In a clause: 0 nothing yet, 1 a target named, 2 a person named, 3 a phrase stands without either. Over clauses: 0 no abuse so far, 1 a mild insult, 2 a full one or a threat. A phrase with a target is matched, and so is a target behind a phrase; a phrase without one is matched if there was abuse before."""
    arcs: dict[tuple[int, str], tuple[int, str]] = {}
    at = lambda here, past: 3 * here + past
    for past in range(3):
        for here in range(4):
            s = at(here, past)
            arcs[s, "y"] = (at(1, past), "Y" if here == 3 else "o")
            arcs[s, "h"] = (at(here if here in (1, 3) else 2, past), "o")
            bare = 3 if here == 0 else here
            for c, grade in (("x", 1), ("X", 2), ("w", 0), ("W", 2)):
                after = at(bare, max(past, grade))
                if here == 1:
                    put = {"x": "d", "X": "D", "w": "u", "W": "T"}[c]
                elif c == "W":
                    put = "S"
                elif c == "X":
                    put = "e" if here == 2 else "R" if past else "o"
                else:
                    put = "M" if c == "x" and past else "o"
                arcs[s, c] = (after, put)
    return Transducer(12, arcs, {at(here, past): past for here in range(4) for past in range(3)})


MACHINES = (negation, insult, threat, reported, target)


def compose(*machines: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """One automaton over the machines in turn: next state and output symbol (its place in OUTPUT, or -1) by state and input symbol. Its states are those combinations that can be reached."""
    states = [(0,) * len(machines)]
    number = {states[0]: 0}
    follow: list[list[int]] = []
    put: list[list[int]] = []
    for state in states:  # grows as states are found
        row, out = [], []
        for symbol in INPUT:
            after = []
            for m, s in zip(machines, state):
                s, symbol = m.step(s, symbol)
                after.append(s)
            if tuple(after) not in number:
                number[tuple(after)] = len(states)
                states.append(tuple(after))
            row.append(number[tuple(after)])
            out.append(OUTPUT.find(symbol))
        follow.append(row)
        put.append(out)
    return follow, put


_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»…¡¿–—‘’"


class Lexer(dict):
    """Token to symbol, with the flag of a clause end. stems: learned stem, or word and '$', to its symbol; the longest that fits counts."""

    def __init__(self, stems: dict[str, str]):
        lists = (("I", INSULTS), ("t", THREATS), ("m", INTENTS), ("y", TARGETS), ("h", PERSONS), ("n", NEGATIONS), ("r", REPORTS))
        self.words = {w: INPUT.index(c) for c, words in lists for w in words}
        self.stems = {k: INPUT.index(c) for k, c in stems.items()}

    def __missing__(self, token: str) -> int:
        if len(self) > _KEPT:
            self.clear()
        word = token.strip(_TRIM)
        end = _END if any(c in _STOPS for c in token[token.rfind(word) + len(word) :]) else 0
        code = self.words.get(word)
        if code is None and self.stems:
            code = self.stems.get(word + "$")
            for n in reversed(STEMS):
                if code is not None:
                    break
                if len(word) >= n:
                    code = self.stems.get(word[:n])
        self[token] = code = (code or 0) + end
        return code


_HITS = tuple(INPUT.index(c) + e for c in "iIt" for e in (0, _END))
FEATURES = (*(f"n_{c}" for c in OUTPUT), "clauses", "most", "words")


def matches(codes: Iterable[int]) -> Iterator[list[int]]:
    """For each clause of a text the places in OUTPUT of what it matches."""
    state, here = 0, []
    end = INPUT.index("b")
    for code in codes:
        out = PUT[state][code & (_END - 1)]
        state = FOLLOW[state][code & (_END - 1)]
        if out >= 0:
            here.append(out)
        if code & _END:
            state = FOLLOW[state][end]
            yield here
            here = []
    yield here


def features(text: str | None, lexer: Lexer) -> list[float]:
    """Log counts of the clauses that hold each match and of matched clauses, of the most matches in one clause, and of the words; all zero without a match."""
    tokens = (text or "").lower().split()
    codes = bytes(map(lexer.__getitem__, tokens))
    counts, clauses, most = [0] * len(OUTPUT), 0, 0
    if any(h in codes for h in _HITS):
        for found in matches(codes):
            for out in set(found):
                counts[out] += 1
            clauses += bool(found)
            most = max(most, len(found))
    return [*map(math.log1p, counts), math.log1p(clauses), math.log1p(most), math.log1p(len(tokens)) if clauses else 0.0]


FOLLOW, PUT = compose(*(m() for m in MACHINES))


def _words(text: str | None) -> set[str]:
    return {w for t in (text or "").lower().split() if len(w := t.strip(_TRIM)) >= 3 and w.isalpha()}


def _family(batches):
    """Adds two minimum hashes of the words, by which near copies meet."""
    for batch in slices(batches):
        keys = []
        for t in batch.column("text").to_pylist():
            words = _words(t) or {""}
            digests = [hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=14).digest() for w in words]
            keys.append((int.from_bytes(min(d[:7] for d in digests), "big"), int.from_bytes(min(d[7:] for d in digests), "big")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64())], ["doc_id", "text", "toxic", "k1", "k2"])


def _stem_counts(batches):
    """(stem, toxic, clean): in how many documents of this task, in parts of bounded size."""
    counts: dict[str, list[int]] = {}

    def out():
        rows = pa.RecordBatch.from_arrays([pa.array(counts), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["stem", "toxic", "clean"])
        counts.clear()
        return rows

    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = _words(text)
            for stem in {w[:n] for w in words for n in STEMS if len(w) >= n} | {w + "$" for w in words}:
                counts.setdefault(stem, [0, 0])[0 if toxic else 1] += 1
            if len(counts) > _KEPT:
                yield out()
    if counts:
        yield out()


def _evidence(toxic, clean, base: float):
    n = toxic + clean
    return 2 * (toxic * F.log(toxic / n / base) + clean * F.log(F.greatest(clean, F.lit(1e-9)) / n / (1 - base)))


def learn_stems(sample: DataFrame) -> dict[str, str]:
    """Stems that mark toxic documents of sample (text, toxic), each with its symbol; MOST_STEMS at most."""
    n, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not 0 < bad < n:
        return {}
    found = sample.select("text", "toxic").mapInArrow(_stem_counts, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    g, share = _evidence(F.col("toxic"), F.col("clean"), bad / n), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    best = found.filter(F.col("toxic") > 0).withColumn("g", g).withColumn("share", share).filter((F.col("g") >= LEAST_G) & (F.col("share") >= MILD))
    return {r.stem: "I" if r.share >= STRONG else "i" for r in best.orderBy(F.desc("g"), "stem").limit(MOST_STEMS).collect()}


def _featured(stems: dict[str, str]):
    def run(batches):
        lexer = Lexer(stems)
        for batch in slices(batches):
            rows = [features(t, lexer) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights, the last one for the constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Weights where there is nothing to fit: a full insult or threat at a target, or a second insult at nobody, lifts a document over the cut; one at a person or a mild one does not.
PRIOR = np.array([1.0, 4.0, 1.0, 1.0, 4.0, 1.0, 1.0, 3.5, 3.0, 0.0, 0.5, 0.5, 0.0, -3.0])


def scored(texts: list[str | None], lexer: Lexer, weights: np.ndarray) -> np.ndarray:
    x = np.array([features(t, lexer) for t in texts]).reshape(len(texts), len(FEATURES))
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def _scored(stems: dict[str, str], weights: np.ndarray):
    def run(batches):
        lexer = Lexer(stems)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scored(batch.column("text").to_pylist(), lexer, weights))], ["doc_id", "score"])

    return run


def _clean(stems: dict[str, str], weights: np.ndarray):
    def run(batches):
        lexer = Lexer(stems)
        for batch in slices(batches):
            yield batch.filter(pa.array(scored(batch.column("text").to_pylist(), lexer, weights) < CUT))

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, str], np.ndarray]:
    """Stems and weights from FIT_ROWS labelled documents at most, those of the smallest hash of doc_id among the folds that may be read. Of near copies one counts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic")).dropna().filter(~held_out(F.col("doc_id")))
    marks = staged(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")))
    share = 1.5 * FIT_ROWS / max(1, marks.count())
    if share < 1:  # hashes below this bound are more than enough, and few go to the task that ranks them
        marks = marks.filter(F.col("h") < F.lit(int((share - 0.5) * 2**64)))
    marks = marks.orderBy("h", "doc_id").limit(FIT_ROWS).drop("h")
    sample = staged(docs.join(F.broadcast(marks), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_family, "doc_id long, text string, toxic long, k1 long, k2 long"))
    for key in ("k1", "k2"):
        order = Window.partitionBy(key).orderBy("doc_id", F.xxhash64("text"))
        sample = sample.withColumn("at", F.row_number().over(order)).filter("at = 1").drop("at")
    sample = staged(sample)
    stems = learn_stems(sample)
    rows = sample.select("text", "toxic").mapInArrow(_featured(stems), "toxic long, x array<double>").toPandas()
    y = rows["toxic"].to_numpy(float) if len(rows) else np.empty(0)
    if not 0 < y.sum() < len(y):
        return stems, PRIOR
    return stems, fit(np.array(rows["x"].tolist()), y)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts are scored like any text without a match. Labels that are null, of no document or of the held-out fold are not read; without both labels, fixed weights score. Repeated rows are scored each; a repeated label counts as toxic if one row says so. Rows without doc_id are scored and not held out. Columns other than doc_id, text and toxic are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(_scored(*train(docs, labels)), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows scored toxic. Each row is judged by its own text, whatever its doc_id; null and empty texts match nothing and stay. No row is shuffled."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    return docs.mapInArrow(_clean(*model), docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity_grammar": op3}
ORACLES: dict[str, str] = {}
