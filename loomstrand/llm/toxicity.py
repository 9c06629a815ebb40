"""Toxicity by a weighted finite-state pattern grammar.

A lexicon automaton maps words to the classes insult, threat, target, negation and report, with weights. Small
transducers rewrite the classes of a clause: one marks what a negation reaches, one what is reported speech, one what
insults a target before it, one a threat whose target follows (it holds the threat until the target or the clause's end
comes) and one an insult that its target follows. Their composition, built once as a product machine, reads each clause;
what it emits at the clause's end are the clause's matches: of each class, aimed or not, negated, reported or plain, the
heaviest. Words by themselves are not scored: a clause counts once for each kind of match. A document's score is a
logistic function of what its clauses match.

Words and word beginnings of the lexicon are learned from labelled rows beside a fixed core, as insults, or as threats if
targets follow them more often than they precede them; so are the weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field as attribute
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.llm.common import crc_mod, field, hash_sample, id_type, map_rows, table

# The fixed core of the lexicon.
INSULTS = "idiot idiots moron morons stupid dumb imbecile loser losers scum trash garbage pathetic worthless disgusting filth vermin clown bastard bitch asshole retard fuck fucking shit".split()
THREATS = "kill hurt destroy punch stab shoot strangle murder beat crush hang burn".split()
TARGETS = "you your yours yourself u ur they them their he him she her these those people tu te toi vous du dich dir ihr sie usted ustedes".split()
NEGATIONS = "not no never don't doesn't isn't aren't wasn't neither nor without nicht kein keine pas jamais ni nunca jamás".split()
REPORTS = "said says say called quoted quote wrote claimed reported told asked alleged dit sagte dijo".split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]|[\"“”«»]")
OTHER, TARGET, NEGATION, REPORT, QUOTE, END, INSULT, THREAT = range(8)
MARKS = {".": END, "!": END, "?": END, ";": END, "\n": END, '"': QUOTE, "“": QUOTE, "”": QUOTE, "«": QUOTE, "»": QUOTE}


class Transducer:
    """A deterministic transducer over the classes: step(state, class) -> (state, mark), from state 0."""

    def __init__(self, states: int, step):
        self.states, self.step = states, step


#: A negation reaches the next three tokens.
NEGATED = Transducer(4, lambda s, c: (3, 0) if c == NEGATION else (0, 0) if c == END else (max(0, s - 1), int(s > 0)))
#: A verb of report reaches to the end of its clause; a quotation to its closing mark.
REPORTED = Transducer(3, lambda s, c: (0, 0) if c == END else ((0, 1) if s == 2 else (2, 0)) if c == QUOTE else (max(s, 1), int(s > 0)) if c == REPORT else (s, int(s > 0)))
#: An insult is aimed by a target before it in its clause; the mark is on the insult.
INSULTED = Transducer(2, lambda s, c: (0, 0) if c == END else (1, 0) if c == TARGET else (s, int(s and c == INSULT)))
#: A threat, or an insult, is aimed by a target that follows in its clause; the mark is on that target.
THREATENED = Transducer(2, lambda s, c: (0, 0) if c == END else (1, 0) if c == THREAT else (0, s) if c == TARGET else (s, 0))
NAMED = Transducer(2, lambda s, c: (0, 0) if c == END else (1, 0) if c == INSULT else (0, s) if c == TARGET else (s, 0))


def compose(*parts: Transducer) -> list[list[tuple[int, int]]]:
    """The product machine: [state][class] -> (state, marks as a number with one bit for each part)."""
    states = list(product(*(range(p.states) for p in parts)))
    number = {s: k for k, s in enumerate(states)}
    table_ = []
    for s in states:
        row = []
        for c in range(8):
            made = [p.step(x, c) for p, x in zip(parts, s, strict=True)]
            row.append((number[tuple(x for x, _ in made)], sum(mark << k for k, (_, mark) in enumerate(made))))
        table_.append(row)
    return table_


MACHINE = compose(NEGATED, REPORTED, INSULTED, THREATENED, NAMED)
NEGATES, REPORTS_, INSULTS_, THREATENS, NAMES = (1 << k for k in range(5))
KINDS = 16  # (insult or threat) x 8 marks: negated, reported, aimed


@dataclass
class Grammar:
    """The lexicon (whole words, word beginnings) with weights, and the weights of a document's features."""

    words: dict[str, tuple[int, float]]
    starts: dict[str, tuple[int, float]]
    weights: list[float]
    cache: dict = attribute(default_factory=dict, repr=False)

    def __post_init__(self):
        self.cache = _Lexicon(self)
        self.lengths = sorted({len(s) for s in self.starts}, reverse=True)
        self.entries: list[tuple[int, float]] = [(c, 0.0) for c in range(INSULT)]
        self.numbers: dict[tuple[int, float], int] = {e: k for k, e in enumerate(self.entries)}

    def entry(self, word: str) -> int:
        """The number of a token's lexicon entry; below INSULT it is a class without a weight."""
        found = self.words.get(word) or next((self.starts[word[:n]] for n in self.lengths if word[:n] in self.starts), (OTHER, 0.0))
        if found not in self.numbers:
            self.numbers[found] = len(self.entries)
            self.entries.append(found)
        return self.numbers[found]


class _Lexicon(dict):
    def __init__(self, owner: Grammar, most: int = 300_000):
        super().__init__()
        self.owner, self.most = owner, most

    def __missing__(self, token: str) -> int:
        k = MARKS[token] if token in MARKS else self.owner.entry(token)
        if len(self) < self.most and len(token) < 64:
            self[token] = k
        return k


def core() -> dict[str, tuple[int, float]]:
    words = {w: (INSULT, 2.5) for w in INSULTS} | {w: (THREAT, 2.0) for w in THREATS}
    return words | {w: (TARGET, 0.0) for w in TARGETS} | {w: (NEGATION, 0.0) for w in NEGATIONS} | {w: (REPORT, 0.0) for w in REPORTS}


def matches(text: str | None, g: Grammar) -> tuple[int, list[tuple[int, int, int, float, int]]]:
    """The number of tokens, and the matched clauses' matches: (clause, class, marks, weight, lexicon entry), of each
    clause, class and marks the heaviest. Marks: 1 negated, 2 reported, 4 aimed."""
    tokens = TOKEN.findall((text or "").lower())
    numbers = list(map(g.cache.__getitem__, tokens))
    if not numbers or max(numbers) < INSULT:
        return len(numbers), []
    out: list[tuple[int, int, int, float, int]] = []
    held: list[list] = []  # the matches of the clause so far: class, marks, weight, entry
    state, clause = 0, 0
    for k in [*numbers, END]:
        kind, weight = g.entries[k]
        state, marks = MACHINE[state][kind]
        if kind >= INSULT:
            held.append([kind, marks & (NEGATES | REPORTS_) | (4 if marks & INSULTS_ else 0), weight, k])
        elif kind == TARGET and marks & (THREATENS | NAMES):
            for m in held:
                if marks & (THREATENS if m[0] == THREAT else NAMES):
                    m[1] |= 4
        elif kind == END:
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for c, by, w, entry in held:
                best[c, by] = max(best.get((c, by), (-1.0, 0)), (w, entry))
            out += [(clause, c, by, w, entry) for (c, by), (w, entry) in best.items()]
            held, clause = [], clause + 1
    return len(numbers), out


#: Features: weight by kind and marks, then the best clause, matches in 100 tokens, different entries, a constant.
N_FEATURES = KINDS + 4


def features(n: int, found: list[tuple[int, int, int, float, int]]) -> list[float]:
    x = [0.0] * N_FEATURES
    x[-1] = 1.0
    if not found:
        return x
    clauses: Counter = Counter()
    for clause, kind, marks, weight, _ in found:
        x[(kind - INSULT) * 8 + marks] += weight
        clauses[clause] += weight * (0.3 if marks & 3 else 1.5 if marks & 4 else 1.0)
    for k in range(KINDS):
        x[k] = math.log1p(x[k])
    x[KINDS] = math.log1p(max(clauses.values()))
    x[KINDS + 1] = math.log1p(100 * sum(w for *_, w, _ in found) / max(n, 20))
    x[KINDS + 2] = math.log1p(len({k for *_, k in found}))
    return x


#: Where the weights start from, and stay without examples: aimed counts most, negated and reported little.
PRIOR = [0.5, 0.1, 0.2, 0.1, 1.5, 0.2, 0.4, 0.1, 0.1, 0.0, 0.1, 0.0, 2.0, 0.1, 0.3, 0.0, 0.5, 0.5, 0.3, -3.0]


def fit(rows: list[tuple[str, int]], ridge: float = 1.0) -> Grammar:
    """A grammar from (text, 0 or 1) rows; without both classes, the core with its prior weights."""
    words = core()
    if len({y for _, y in rows}) < 2:
        return Grammar(words, {}, PRIOR)
    learned, starts = learn_terminals(rows, set(words))
    g = Grammar(words | learned, starts, PRIOR)
    x, y = np.array([features(*matches(t, g)) for t, _ in rows]), np.array([float(v) for _, v in rows])
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * (w - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Grammar(g.words, g.starts, w.tolist())


def learn_terminals(rows: list[tuple[str, int]], known: set[str], most: int = 80, shortest: int = 4, longest: int = 8) -> tuple[dict[str, tuple[int, float]], dict[str, tuple[int, float]]]:
    """Whole words and word beginnings that are much commoner in rows labelled 1, chosen one after another, each for
    the rows that the ones before it leave unexplained; the weight is the log of the ratio of the rates."""

    def patterns(word: str):
        yield f"{word}$"
        for n in range(shortest, min(longest, len(word)) + 1):
            yield word[:n]

    bags = [Counter(x for x in TOKEN.findall(t.lower()) if x not in MARKS) for t, _ in rows]
    totals = [sum(sum(b.values()) for b, (_, y) in zip(bags, rows, strict=True) if y == k) + 1 for k in (0, 1)]
    bad = [b for b, (_, y) in zip(bags, rows, strict=True) if y == 1]
    where: dict[str, set[int]] = {}
    for k, b in enumerate(bad):
        for p in {p for w in b if len(w) >= shortest for p in patterns(w)}:
            where.setdefault(p, set()).add(k)
    least = max(5, len(bad) // 50)
    where = {p: ks for p, ks in where.items() if len(ks) >= least}
    hits, clean = Counter(), Counter()
    for b, (_, y) in zip(bags, rows, strict=True):
        to = hits if y == 1 else clean
        for w, n in b.items():
            if len(w) >= shortest:
                for p in patterns(w):
                    if p in where:
                        to[p] += n
    ratio = {p: math.log((hits[p] + 0.5) / totals[1]) - math.log((clean[p] + 0.5) / totals[0]) for p in where}
    where = {p: ks for p, ks in where.items() if ratio[p] > math.log(8)}
    open_ = set(range(len(bad)))
    words: dict[str, tuple[int, float]] = {}
    starts: dict[str, tuple[int, float]] = {}
    per_doc: Counter = Counter()
    for _ in range(most):
        gain = {p: len(ks & open_) * ratio[p] for p, ks in where.items()}
        top = 0.9 * max(gain.values(), default=0)
        best = max((p for p in gain if gain[p] >= top), key=lambda p: (len(p), gain[p], p), default=None)  # the longest of about the best
        if best is None or len(where[best] & open_) < least:
            break
        entry = (INSULT, round(ratio[best], 4))
        words |= {best[:-1]: entry} if best.endswith("$") else {}
        starts |= {} if best.endswith("$") else {best: entry}
        per_doc.update(where.pop(best))
        bare = best.rstrip("$")
        where = {p: ks for p, ks in where.items() if not (p.startswith(bare) or bare.startswith(p.rstrip("$")))}
        open_ = {k for k in open_ if per_doc[k] < 3}
    words = {w: e for w, e in words.items() if w not in known or e[1] > 2.5}
    return as_threats(rows, words, starts)


def as_threats(rows: list[tuple[str, int]], words: dict, starts: dict, reach: int = 3) -> tuple[dict, dict]:
    """The learned entries, those as threats that targets follow within `reach` tokens at least twice as often as they
    precede them."""
    number = {p: float(k) for k, p in enumerate([*words, *starts])}
    apart = Grammar({w: (INSULT, number[w]) for w in words}, {w: (INSULT, number[w]) for w in starts}, PRIOR)  # an entry for each pattern
    targets, after, before = set(TARGETS), Counter(), Counter()
    for t, y in rows:
        tokens = TOKEN.findall(t.lower()) if y == 1 else []
        for k, token in enumerate(tokens):
            if token not in MARKS and (entry := apart.cache[token]) >= INSULT:
                p = apart.entries[entry][1]
                after[p] += not targets.isdisjoint(tokens[k + 1 : k + 1 + reach])
                before[p] += not targets.isdisjoint(tokens[max(0, k - reach) : k])
    kind = lambda p: THREAT if after[number[p]] >= max(5, 2 * before[number[p]]) else INSULT
    return {w: (kind(w), e[1]) for w, e in words.items()}, {w: (kind(w), e[1]) for w, e in starts.items()}


def judge(text: str | None, g: Grammar) -> tuple[float, int]:
    """(score, number of matched clauses)"""
    n, found = matches(text, g)
    z = sum(a * b for a, b in zip(features(n, found), g.weights, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len({m[0] for m in found})


def learn_grammar(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = 1500, train_chars: int = 20_000) -> Grammar:
    """A grammar from about rows_per_class labelled rows of each class, cut at train_chars characters for training
    only. Labels other than 0 and 1 and rows without text are left out; of a document labelled both ways, both count."""
    good = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("string").alias("k"), F.col(label_col).cast("int").alias("y"))
    chosen = [(r["k"], r["y"]) for r in hash_sample(good, ["k"], rows_per_class, "k", by="y") if r["k"] is not None]
    if not chosen:
        return fit([])
    wanted = docs.sparkSession.createDataFrame(chosen, "k string, y int")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("k"), F.substring(text_col, 1, train_chars).alias("t")).join(F.broadcast(wanted), "k")
    return fit(sorted((r["t"], r["y"]) for r in rows.limit(8 * rows_per_class).collect()))


def _scored(df: DataFrame, grammar: Grammar, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """_id, _text, _keep (a struct, so that no name can clash), score, predicted, clauses."""
    words, starts, weights = grammar.words, grammar.starts, grammar.weights
    rest = [df.schema[c] for c in keep] or [field("none", T.BooleanType())]
    schema = T.StructType([
        field("_id", id_type(df, id_col)), field("_text", T.StringType()), field("_keep", T.StructType(rest)),
        field("score", T.DoubleType()), field("predicted", T.IntegerType()), field("clauses", T.LongType()),
    ])
    state: dict[str, Grammar] = {}

    def each(ids: list, texts: list, others: list) -> list[list]:
        if "grammar" not in state:
            state["grammar"] = Grammar(words, starts, weights)
        made = [judge(t, state["grammar"]) for t in texts]
        return [ids, texts, others, [s for s, _ in made], [int(s >= 0.5) for s, _ in made], [c for _, c in made]]

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*(F.col(c) for c in keep) if keep else [F.lit(None).cast("boolean").alias("none")]).alias("_keep"))
    return map_rows(rows, ["_id", "_text", "_keep"], schema, each)


def score_toxicity(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text, score (0 to 1), predicted (1 if score >= 0.5) and clauses (the number of clauses
    that match).

    Null and empty texts match nothing and get the score of that. Repeated rows give repeated results; an empty table
    gives none; other columns are ignored. Texts are read whole.
    """
    return _scored(df, grammar, id_col, text_col).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "score", "predicted", "clauses")


def without_toxic(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that score under 0.5."""
    rest = tuple(c for c in df.columns if c not in (id_col, text_col))
    mild = _scored(df, grammar, id_col, text_col, rest).where("predicted = 0")
    source = {id_col: F.col("_id"), text_col: F.col("_text")}
    return mild.select(*(source.get(c, F.col(f"_keep.{c}")).alias(c) for c in df.columns))


def held_out():
    """Rows whose labels no grammar of the registered query or the pipeline learns from."""
    return F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = learn_grammar(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    return score_toxicity(docs, grammar).select("doc_id", held_out().alias("held_out"), "score", "predicted", "clauses")
