"""Operator 6: toxicity by a weighted finite-state pattern grammar.

Five transducers, each a table over one alphabet of word classes, rewrite the words of a text in turn: `negation` marks insults and
threats within SCOPE words of a negation, `reported` those behind a word of reported speech, `target` tells the end of a clause
that aims at someone, `insult` and `threat` turn what is left into matches.  `compose` makes one deterministic machine of them,
which scoring runs once over a text; words outside the lexicon only count down the scope.  It matches clauses of eight
kinds, and a match weighs what its words weigh.  A text's score is logistic in the sums over its clauses, so a word counts by the
clause that it stands in.

Learned, from labelled rows only (at most `max_rows` of them, the least by a hash of the id): the words' weights (log odds of
distinct training texts that have the word; start words keep a prior of one text), further arcs of the insult transducer (every word
whose log odds are over MARGIN with a confidence of Z standard errors; there is no limit to their number), and the weights of the
kinds (logistic regression).  The lists below are where the lexicon starts.

Scoring is one scan without a shuffle; texts are read whole, and the model is at most the words of `max_rows` texts.

Defined results: a null or empty text has no clause, and the score of one.  Rows that repeat score alike.  A null doc_id counts
as the empty string for the held-out rule.  Without labelled rows of both kinds the start weights are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

# Where the lexicon starts, in English, German, French and Spanish.
INSULTS = "idiot moron stupid loser trash scum worthless pathetic disgusting clown fool jerk dumb idioten dumm dummkopf blöd abschaum versager imbécile stupide connard crétin ordure idiota estúpido imbécil basura inútil"
THREATS = "kill hurt destroy burn beat shoot stab strangle töten umbringen schlagen zerstören tuer frapper brûler détruire matar golpear quemar destruir"
TARGETS = "you your yours he him she her they them their those these people du dich dir euch ihr sie er tu toi vous ton votre il elle ils elles usted tú ti vosotros él ella ellos"
NEGATIONS = "not no never none nobody isn aren wasn don doesn without nicht nie kein keine niemals ohne pas jamais sans aucun nunca ningún sin"
REPORTS = "said says say told wrote writes quoted called claimed reported according sagte sagt schrieb nannte behauptete dit disait écrit affirme déclare dijo dice escribió llamó afirma"
KINDS = ("insult", "aimed_insult", "negated_insult", "reported_insult", "threat", "aimed_threat", "negated_threat", "reported_threat")
SCOPE = 4  # words that a negation reaches
#: The alphabet.  The first five are the classes of the lexicon; what follows `end` is written by transducers.
ALPHABET = ("insult", "threat", "target", "negation", "report", "other", "end", "negated insult", "negated threat", "reported insult", "reported threat", "aimed end")
_INSULT, _THREAT, _TARGET, _NEGATION, _REPORT, _OTHER, _END = range(7)
#: Learned words: log odds over MARGIN by Z standard errors.
Z, MARGIN = 1.96, 1.5
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalpha())
_CLAUSE_ENDS = b".!?;\n"
_WORD_SQL = r"[\x00-@\[-`{-\x7f]+"


@dataclass
class Grammar:
    weights: dict[str, tuple[int, float]] = field(default_factory=dict)  # word: (class, weight)
    kinds: list[float] = field(default_factory=lambda: [1.0, 1.2, 0.2, 0.5, 0.5, 1.0, 0.1, 0.3, 0.0, 0.0])
    bias: float = -2.0

    def compiled(self):
        words = list(self.weights)
        found = W.Words(pa.array(words, pa.string()), W.folded(), W.separators(_SEPARATORS)).hash
        order = np.argsort(found)
        return found[order], np.array([self.weights[words[i]][0] for i in order]), np.array([self.weights[words[i]][1] for i in order])


def start_grammar() -> Grammar:
    lists = ((_REPORT, REPORTS), (_NEGATION, NEGATIONS), (_TARGET, TARGETS), (_THREAT, THREATS), (_INSULT, INSULTS))
    return Grammar({w: (k, 3.0 if k == _INSULT else 1.0) for k, text in lists for w in text.split()})


@dataclass(frozen=True)
class Transducer:
    """to[state][symbol] and out[state][symbol]; state 0 is the first, and symbols are places in ALPHABET."""

    to: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]

    def run(self, symbols: list[int]) -> list[int]:
        state, written = 0, []
        for x in symbols:
            written.append(self.out[state][x])
            state = self.to[state][x]
        return written


def transducer(states: int, rule) -> Transducer:
    """rule(state, symbol's name) -> (state, symbol's name)."""
    rows = [[rule(s, x) for x in ALPHABET] for s in range(states)]
    return Transducer(tuple(tuple(t for t, _ in r) for r in rows), tuple(tuple(ALPHABET.index(o) for _, o in r) for r in rows))


def negation(scope: int = SCOPE) -> Transducer:
    """The state is how many words a negation still reaches."""

    def rule(left: int, x: str) -> tuple[int, str]:
        if x in ("end", "negation"):
            return (0, x) if x == "end" else (scope, "other")
        return max(0, left - 1), f"negated {x}" if left and x in ("insult", "threat") else x

    return transducer(scope + 1, rule)


def reported() -> Transducer:
    """State 1: the clause has a word of reported speech.  What is negated stays so."""

    def rule(state: int, x: str) -> tuple[int, str]:
        if x in ("end", "report"):
            return (0, x) if x == "end" else (1, "other")
        return state, f"reported {x}" if state and x in ("insult", "threat") else x

    return transducer(2, rule)


def target() -> Transducer:
    """State 1: the clause names someone; its end says so."""

    def rule(state: int, x: str) -> tuple[int, str]:
        if x in ("end", "target"):
            return (0, "aimed end" if state else "end") if x == "end" else (1, "other")
        return state, x

    return transducer(2, rule)


def insult() -> Transducer:
    """Lets insults through while it reads a clause, and clause ends; marks what it has no arc for."""
    return transducer(1, lambda s, x: (s, x if "insult" in x or "threat" in x or "end" in x else "other"))


def threat() -> Transducer:
    return transducer(1, lambda s, x: (s, x))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that writes what b writes when it reads what a writes; its states are pairs that can be reached."""
    names, pending, to, out = {(0, 0): 0}, [(0, 0)], [], []
    for s, t in pending:  # grows while it is read
        row_to, row_out = [], []
        for x in range(len(ALPHABET)):
            y = a.out[s][x]
            pair = (a.to[s][x], b.to[t][y])
            if pair not in names:
                names[pair] = len(names)
                pending.append(pair)
            row_to.append(names[pair])
            row_out.append(b.out[t][y])
        to.append(tuple(row_to))
        out.append(tuple(row_out))
    return Transducer(tuple(to), tuple(out))


def machine() -> tuple[Transducer, tuple[tuple[int, ...], ...]]:
    """All five as one, and where each of its states is after 0 to SCOPE words of no class (more change nothing)."""
    whole = reduce(compose, (negation(), reported(), target(), insult(), threat()))
    after = [tuple(range(len(whole.to)))]
    for _ in range(SCOPE):
        after.append(tuple(whole.to[s][_OTHER] for s in after[-1]))
    return whole, tuple(after)


#: Plain tables, which go to the executors with the functions that use them.
_TO, _OUT, _AFTER = (machine()[0].to, machine()[0].out, machine()[1])

#: Where a match's weight goes: kinds of clauses without an aim; those with one follow theirs.
_KIND_OF = {"insult": 0, "negated insult": 2, "reported insult": 3, "threat": 4, "negated threat": 6, "reported threat": 7}
_PLACE = tuple(_KIND_OF.get(x, -1) for x in ALPHABET)
_AIMED_END = ALPHABET.index("aimed end")


def run_clauses(kind: np.ndarray, weight: np.ndarray, place: np.ndarray, clause: np.ndarray) -> tuple[list[float], float, int]:
    """The composed machine over the words of a text that are in the lexicon: sums by kind, best clause, and how many
    insults and threats are neither negated nor reported."""
    to, out, after = _TO, _OUT, _AFTER
    sums, best, direct = [0.0] * len(KINDS), 0.0, 0
    state, at, last, insults, threats, held = 0, None, 0, 0.0, 0.0, 0
    for x, w, p, c in [*zip(kind.tolist(), weight.tolist(), place.tolist(), clause.tolist()), (_OTHER, 0.0, 0, -1)]:
        if c != at:
            if at is not None:
                aimed = out[state][_END] == _AIMED_END
                sums[aimed] += insults
                sums[4 + aimed] += threats
                best, direct = max(best, insults + threats), direct + held
                insults, threats, held, state = 0.0, 0.0, 0, to[state][_END]
            at, last = c, p - 1
        state = after[min(p - last - 1, SCOPE)][state]
        i = _PLACE[out[state][x]]
        if i == 0:
            insults, held = insults + w, held + 1
        elif i == 4:
            threats, held = threats + w, held + 1
        elif i > 0:
            sums[i] += w
        state, last = to[state][x], p
    return sums, best, direct


def _features(batches, grammar: Grammar, keep: list[str]):
    """Columns `keep`, and a feature row per text: the kinds' sums, the best clause, and unnegated, unreported matches per word (all as log(1 + x))."""
    names, kinds, weights = grammar.compiled()
    width = len(KINDS) + 2
    for batch in batches:
        for a, b in W.slices(batch["text"]):
            words = W.Words(batch["text"].slice(a, b - a), W.folded(), W.separators(_SEPARATORS))
            at = np.minimum(np.searchsorted(names, words.hash), len(names) - 1)
            hit = np.flatnonzero(names[at] == words.hash) if len(words.hash) else np.zeros(0, np.int64)
            kind, weight, text = kinds[at[hit]], weights[at[hit]], words.text[hit]
            ends = np.flatnonzero(W.separators(_CLAUSE_ENDS)[words.data])
            clause = np.searchsorted(ends, words.start[hit])
            bounds = np.searchsorted(text, np.arange(b - a + 1))
            strong = np.bincount(text[kind <= _THREAT], minlength=b - a)
            out = np.zeros((b - a, width))
            for i in np.flatnonzero(strong):
                s = slice(bounds[i], bounds[i + 1])
                sums, best, direct = run_clauses(kind[s], weight[s], hit[s], clause[s])
                out[i, :-2], out[i, -2], out[i, -1] = sums, best, 100 * direct / words.count[i]
            yield batch.slice(a, b - a).select(keep), np.log1p(np.maximum(out, 0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _score(batches, grammar: Grammar):
    for rows, features in _features(batches, grammar, ["doc_id", "held_out"]):
        score = _sigmoid(features @ np.array(grammar.kinds) + grammar.bias)
        yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def _training(batches, grammar: Grammar):
    for rows, features in _features(batches, grammar, ["toxic"]):
        yield pa.RecordBatch.from_arrays([rows["toxic"], pa.array(list(features), pa.list_(pa.float64()))], ["toxic", "features"])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge; the bias is free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> Grammar:
    """A grammar learned from labels (doc_id, toxic) and docs (doc_id, text).  labels: training rows only."""
    grammar = start_grammar()
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    texts = texts.persist()  # at most max_rows texts; lost blocks are computed again
    totals = texts.agg(F.sum("toxic"), F.count("*")).first()
    toxic, clean = float(totals[0] or 0), float(totals[1] - (totals[0] or 0))
    if toxic and clean:
        fold = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        words = texts.select("toxic", F.explode(F.array_distinct(F.split(fold, _WORD_SQL))).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
        error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
        known = [w for w, (k, _) in grammar.weights.items() if k <= _THREAT]
        shown = words.where(F.col("word") != "").withColumns({"odds": odds, "error": error}).where((F.col("odds") - Z * F.col("error") > MARGIN) | F.col("word").isin(known))
        for word, odds, error in shown.select("word", "odds", "error").collect():
            k, prior = grammar.weights.get(word, (_INSULT, None))
            if k <= _THREAT:
                sure = 1 / error**2
                grammar.weights[word] = (k, odds if prior is None else max(0.05, (odds * sure + prior) / (sure + 1)))
        data = texts.mapInArrow(lambda it: _training(it, grammar), "toxic int, features array<double>").collect()
        x, y = np.array([r[1] for r in data]), np.array([r[0] for r in data], float)
        kinds, bias = logistic(x, y)
        grammar.kinds, grammar.bias = kinds.tolist(), bias
    texts.unpersist()
    return grammar


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; rows where it is 0 are held out of learning."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    rows = docs.select("doc_id", (remainder() == 0).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _score(it, grammar), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> DataFrame:
    return score_documents(docs, fit(docs, labels.where(remainder() != 0), max_rows))


def keep_clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Rows of docs, with all columns, that the grammar does not predict toxic."""
    columns = docs.columns

    def keep(batches):
        for rows, features in _features(batches, grammar, columns):
            yield rows.filter(pa.array(_sigmoid(features @ np.array(grammar.kinds) + grammar.bias) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
