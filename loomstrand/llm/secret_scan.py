"""Secrets by fixed patterns and by a linear-chain conditional random field.

The field tags the tokens of a text as begin, inside or outside of a secret, from the token's shape, the shapes of its
neighbours, neighbouring words and a feature of the whole file, and the best tag sequence is decoded by Viterbi. It is
trained on a bounded sample of windows. Labels are the patterns' values and tokens that begin as issued keys do; so that
the field does not learn the patterns themselves, each labelled window also comes with the pattern's trigger hidden:
another name or none before the value, another sign between, a value of another alphabet; and with ordinary words in the
value's place, as examples of what is none.

Tokens become small numbers (shape signatures), so scoring is table look-up. Decoding is exact, and fast where text is
ordinary: `Field.cuts` derives from the trained weights how far from any unusual token the tag is surely `outside`.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as Window_

from loomstrand.llm.common import field, id_type, map_rows, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"""[^\s"'`,;:(){}\[\]<>=|]+|["'`,;:(){}\[\]<>=|]""")
KEYWORD = re.compile(r"pass(word|wd|phrase)?|pwd|secret|token|api_?key|key|credential|auth|bearer|private|access", re.I | re.A)
#: Well-known beginnings of issued keys.
PREFIX = re.compile(r"AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[abp]-|eyJ|AIza|glpat-|-----BEGIN")
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:gh[op]_|[sp]k[-_]|xox[abp]-|AIza|glpat-)[A-Za-z0-9_-]{16,}")
O, B, I = 0, 1, 2
#: Names and signs that stand in for a pattern's trigger in training.
OTHER_NAMES = "pwd passphrase credential credentials auth bearer authorization signature private_key access_key client_secret session_key signing_key".split()
OTHER_SIGNS = [["="], [":"], ["-", ">"], ["->"], ["is"], ["was"], [":", "'"], ["=", '"'], [], [], []]
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]
ISSUED_BY = "ghp_ gho_ sk_live_ sk-proj- pk_test_ xoxb- glpat- AIza".split()
#: Labelled windows and their copies together, about, where there are few; at least COPIES of each.
ENOUGH, COPIES = 1200, 5
#: Letters by which a token stands in a training window.
TOKEN_CHARS = 256


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' whole matches, by start, then kind as listed."""
    if not text:
        return []
    low = text.lower()
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(k in low for k in NAMES) else []
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secret values themselves, as labels for training: those of the patterns, and tokens that begin as issued keys."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16] + [m.span() for m in HEX.finditer(text)]
    return found + [m.span() for m in ISSUED.finditer(text)]


def shape(token: str, context: frozenset[str] = frozenset()) -> tuple[str, ...]:
    """The features of a token; a word of the context is a feature itself."""
    if len(token) == 1 and not token.isalnum():
        return ("punct", f"is {token}" if token in "\"'`,;:(){}[]<>=|" else "other mark")
    n, digits = len(token), sum(c.isdigit() for c in token)
    upper, lower = sum(c.isupper() for c in token), sum(c.islower() for c in token)
    size = next(k for k, most in enumerate((3, 7, 11, 15, 19, 31, 39, 63, 1 << 62)) if n <= most)
    found = [f"length {size}"]
    if digits:
        found.append(f"digits {min(4, 5 * digits // n)}")
    if digits and upper + lower:
        found.append("letters and digits")
    if digits and upper and lower:
        found.append("mixed")
    if n >= 8 and digits and re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        found.append("hexadecimal")
    if n >= 16 and digits and re.fullmatch(r"[A-Za-z0-9+/_.=-]+", token):
        found.append("base64")
    if n >= 12:
        found.append(f"spread {min(4, 8 * len(set(token)) // min(n, 64))}")
    if upper == n:
        found.append("capitals")
    if not digits and token.isalpha():
        found.append("word")
    if PREFIX.match(token):
        found.append("issued")
    if KEYWORD.search(token):
        found.append("keyword")
    if n < 24 and (low := token.lower()) in context:
        found.append(f"word {low}")
    return tuple(found)


#: Offsets of the neighbours whose shapes score a token.
NEAR = (0, -1, -2, -3, 1)


@dataclass
class Field:
    """Trained weights: features by offset and tag, file features by tag, tag pairs."""

    features: dict[str, int]
    near: np.ndarray  # offsets x features x tags
    file: np.ndarray  # file classes x tags
    pairs: np.ndarray  # tag before x tag
    context: frozenset[str] = frozenset()  # words that are features

    def __post_init__(self):
        self.signatures: dict[tuple[str, ...], int] = {}
        self.words: dict[tuple, int] = {}  # signatures of all-letter tokens by what their shape depends on
        self.tables = np.zeros((len(NEAR), 1, 3))
        self.cache: dict[str, int] = _Cache(self)
        gain = self.pairs - self.pairs[O, O]
        steps = gain[1:, 1:].max()
        visit = (gain[O, 1:][:, None] + gain[1:, O][None, :]).max()
        #: A token is ordinary if `outside` leads by this much; then no run of ordinary tokens gains by another tag.
        self.lead = max(2 * steps, 2 * visit, 2.0)
        reach = (self.pairs[:, 1:] - self.pairs[:, [O]]).max() + (self.pairs[1:, :] - self.pairs[[O], :]).max()
        #: Within so many ordinary tokens in a row, one surely is `outside`.
        self.cuts = int(np.ceil(2 * max(0.0, reach) / self.lead)) + 1

    def signature(self, token: str) -> int:
        if token.isalpha():
            n = len(token)
            low = token.lower() if n < 24 else ""
            key = (min(n, 64), token.isupper(), len(set(token)) if n >= 12 else 0, KEYWORD.search(token) is not None, low if low in self.context else "")
            if (k := self.words.get(key)) is None:
                k = self.words[key] = self.number(shape(token, self.context))
            return k
        return self.number(shape(token, self.context))

    def number(self, found: tuple[str, ...]) -> int:
        if (k := self.signatures.get(found)) is None:
            k = self.signatures[found] = len(self.signatures) + 1
            ids = [self.features[f] for f in found if f in self.features]
            row = self.near[:, ids, :].sum(axis=1)[:, None, :]
            self.tables = np.concatenate((self.tables, row), axis=1)
        return k

    def emissions(self, numbers: np.ndarray, files: np.ndarray) -> np.ndarray:
        """numbers: signatures with len(NEAR) zeros around each text; files: the file class of each."""
        out = self.file[files]
        for k, by in enumerate(NEAR):
            at = np.roll(numbers, -by)
            out = out + self.tables[k][at]
        return out


class _Cache(dict):
    def __init__(self, owner: Field, most: int = 300_000):
        super().__init__()
        self.owner, self.most = owner, most

    def __missing__(self, token: str) -> int:
        k = self.owner.signature(token)
        if len(self) < self.most and len(token) < 64:
            self[token] = k
        return k


def file_class(text: str, tokens: int) -> int:
    """Few, some or many marks of configuration or code among the tokens."""
    marks = 20 * (text.count("=") + text.count("{") + text.count(":"))
    return 0 if marks < tokens / 10 else 1 if marks < tokens else 2


def viterbi(scores: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best tags of sequences of one length: scores is sequences x tokens x tags."""
    count, length, _ = scores.shape
    back = np.zeros((length, count, 3), np.int8)
    best = scores[:, 0]
    for t in range(1, length):
        step = best[:, :, None] + pairs
        back[t] = step.argmax(axis=1)
        best = step.max(axis=1) + scores[:, t]
    tags = np.zeros((count, length), np.int8)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        tags[:, t - 1] = back[t, np.arange(count), tags[:, t]]
    return tags


def decode(scores: np.ndarray, inside: np.ndarray, model: Field) -> np.ndarray:
    """The best tags of all texts at once; inside is False between texts. Stretches that can hold a secret are decoded
    by Viterbi, grouped by length; everywhere else the best tag is `outside`."""
    n = len(scores)
    odd = np.flatnonzero(inside & (scores[:, O] - scores[:, 1:].max(axis=1) < model.lead))
    tags = np.zeros(n, np.int8)
    if not len(odd):
        return tags
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, np.maximum(odd - model.cuts, 0), 1)
    np.add.at(delta, np.minimum(odd + model.cuts + 1, n), -1)
    near = (np.cumsum(delta[:-1]) > 0) & inside
    edge = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).astype(np.int8)))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    for length in np.unique(size):
        at = start[size == length][:, None] + np.arange(length)
        tags[at] = viterbi(scores[at], model.pairs)
    return tags


def tagged_spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """Code points of the tokens tagged as secrets; an inside tag after none begins a secret."""
    found: list[list[int]] = []
    before = O
    for m, tag in zip(TOKEN.finditer(text), tags, strict=True):
        if tag == B or tag == I and before == O:
            found.append([m.start(), m.end()])
        elif tag == I:
            found[-1][1] = m.end()
        before = tag
    return [(s, e) for s, e in found]


def scan(texts: list[str | None], model: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text; a tagged span that meets a base span is left to that."""
    pad = max(map(abs, NEAR))
    numbers, files, starts, total = [np.zeros(pad, np.int32)], [np.zeros(pad, np.int8)], [], pad
    for text in texts:
        tokens = TOKEN.findall(text or "")
        n = len(tokens)
        starts.append((total, n))
        numbers += [np.fromiter(map(model.cache.__getitem__, tokens), np.int32, n), np.zeros(pad, np.int32)]
        files.append(np.full(n + pad, file_class(text or "", n), np.int8))
        total += n + pad
    flat = np.concatenate(numbers)
    tags = decode(model.emissions(flat, np.concatenate(files)), flat > 0, model)
    out = []
    for text, (at, n) in zip(texts, starts, strict=True):
        base = base_spans(text)
        spans = list(base)
        if tags[at : at + n].any():
            spans += [("crf", s, e) for s, e in tagged_spans(text, tags[at : at + n]) if not any(a < e and s < b for _, a, b in base)]
        out.append((base, sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))))
    return out


Window = tuple[list[str], list[int], int]  # tokens, tags, file class


def windows_of(text: str, radius: int = 16) -> list[Window]:
    """Around every labelled value of a text, and of one stretch, chosen by a hash, of a text without any."""
    tokens = list(TOKEN.finditer(text))
    tags, k = [O] * len(tokens), 0
    for s, e in sorted(value_spans(text)):
        while k < len(tokens) and tokens[k].end() <= s:
            k += 1
        j = k
        while j < len(tokens) and tokens[j].start() < e:
            tags[j] = B if j == k else I
            j += 1
    kind = file_class(text, len(tokens))
    centres = [i for i, t in enumerate(tags) if t == B]
    if tokens and not centres:
        centres = [zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(tokens)]
    spans = ((max(0, i - radius), i + radius) for i in centres)
    return [([m[0][:TOKEN_CHARS] for m in tokens[a:b]], tags[a:b], kind) for a, b in spans]


def hidden(window: Window, rng: random.Random, copies: int) -> list[Window]:
    """Copies of a labelled window whose value stands behind another name, or none, and another sign, in another
    alphabet; each fifth has a word of the window there instead, which is no value."""
    tokens, tags, kind = window
    if B not in tags:
        return []
    at = tags.index(B)
    end = next((k for k in range(at + 1, len(tags)) if tags[k] != I), len(tags))
    front = at
    while front and at - front < 4 and (not tokens[front - 1].isalnum() or KEYWORD.search(tokens[front - 1])):
        front -= 1
    words = [t for t, tag in zip(tokens, tags, strict=True) if tag == O and t.isalpha()] or ["word"]
    out = []
    for k in range(copies):
        plain = k % 5 == 4
        name = [rng.choice(OTHER_NAMES)] if rng.random() < 0.8 else [rng.choice(words)]
        sign = rng.choice(OTHER_SIGNS)
        name[0] = rng.choice([name[0], name[0].upper(), name[0].capitalize()])
        if rng.random() < 0.3:
            name = name[0].split("_")
        letters = rng.choice(ALPHABETS)
        value = "".join(rng.choice(letters) for _ in range(rng.randrange(16, 49)))
        value = rng.choice(words) if plain else rng.choice(ISSUED_BY) + value if rng.random() < 0.2 else value
        left, right = tokens[:front] + name + sign, tokens[end:]
        out.append(([*left, value, *right], [*tags[:front], *[O] * (len(left) - front), O if plain else B, *tags[end:]], kind))
    return out


def context_words(rows: list[Window], most: int = 64) -> frozenset[str]:
    """Words that stand before values much more often than elsewhere."""
    near, all_ = Counter(), Counter()
    for tokens, tags, _ in rows:
        low = [t.lower() for t in tokens]
        all_.update(low)
        for k in (k for k, t in enumerate(tags) if t == B):
            near.update(low[max(0, k - 3) : k])
    good = [w for w, n in near.items() if n >= 5 and w.isalpha() and len(w) < 24 and 2 * n > all_[w]]
    return frozenset(sorted(good, key=lambda w: (-near[w], w))[:most])


def train(rows: list[Window], rounds: int = 80, ridge: float = 0.02) -> Field:
    """Weights of largest penalised likelihood on the windows and their copies with hidden triggers (Lafferty et al.
    2001), by Adam."""
    rng = random.Random(1)
    copies = max(COPIES, ENOUGH // max(1, sum(B in r[1] for r in rows)))
    rows = rows + [w for r in rows for w in hidden(r, rng, copies)]
    context = context_words(rows)
    names = sorted({f for tokens, _, _ in rows for x in set(tokens) for f in shape(x, context)})
    features = {f: k for k, f in enumerate(names)}
    shapes: dict[tuple, int] = {}
    longest = max((len(r[0]) for r in rows), default=1)
    flat = np.zeros((len(rows), longest), np.int64)
    gold, mask, kind = np.zeros((len(rows), longest), np.int64), np.zeros((len(rows), longest), bool), np.zeros(len(rows), np.int64)
    for r, (tokens, tags, of) in enumerate(rows):
        flat[r, : len(tokens)] = [shapes.setdefault(shape(x, context), len(shapes) + 1) for x in tokens]
        gold[r, : len(tags)], mask[r, : len(tags)], kind[r] = tags, True, of
    design = np.zeros((len(shapes) + 1, len(names)))
    for found, k in shapes.items():
        design[k, [features[f] for f in found]] = 1
    weights = [np.zeros((len(NEAR), len(names), 3)), np.zeros((3, 3)), np.zeros((3, 3))]
    weights[1][:, O] = 1.0
    near_of = []
    for by in NEAR:
        moved = np.zeros_like(flat)
        if by == 0:
            moved = flat
        elif by < 0:
            moved[:, -by:] = flat[:, :by]
        else:
            moved[:, :-by] = flat[:, by:]
        near_of.append(moved)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    truth = np.eye(3)[gold] * mask[:, :, None]
    for step in range(1, rounds + 1 if rows else 1):
        near, file, pairs = weights
        score = np.repeat(file[kind][:, None, :], longest, axis=1)
        for k in range(len(NEAR)):
            score = score + (design @ near[k])[near_of[k]]
        score = score * mask[:, :, None]
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pairs, axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(pairs + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], new, behind[:, t + 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        left = truth - share
        slope = [np.zeros_like(w) for w in weights]
        for k in range(len(NEAR)):
            per_shape = np.stack([np.bincount(near_of[k].ravel(), left[:, :, tag].ravel(), len(design)) for tag in range(3)], axis=1)
            slope[0][k] = design.T @ per_shape
        np.add.at(slope[1], kind, left.sum(axis=1))
        for t in range(1, longest):
            both = mask[:, t]
            joint = np.exp(ahead[both, t - 1, :, None] + pairs + (score[both, t] + behind[both, t])[:, None, :] - total[both, None, None])
            slope[2] -= joint.sum(axis=0)
            np.add.at(slope[2], (gold[both, t - 1], gold[both, t]), 1.0)
        for k, w in enumerate(weights):
            g = slope[k] / max(1, len(rows)) - ridge * w / max(1, len(rows)) ** 0.5
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w += 0.15 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    near, file, pairs = weights
    return Field(features, near, file, pairs, context)


WINDOWS = T.StructType([field("h", T.LongType()), field("tokens", T.ArrayType(T.StringType())), field("tags", T.ArrayType(T.IntegerType())), field("kind", T.IntegerType()), field("labelled", T.BooleanType())])


def training_windows(df: DataFrame, text_col: str, texts: int, windows: int) -> list[Window]:
    """At most `windows` windows with a labelled value, and as many without, of about `texts` whole texts, all chosen by hashes."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    chosen = rows.withColumn("h", h).where(F.col("h") < int((1 << 40) * min(1.0, texts / max(1, rows.count()))))

    def each(hashes: list, found: list) -> list[list]:
        made = [(h, *w, B in w[1]) for h, t in zip(hashes, found, strict=True) for w in windows_of(t)]
        return [list(c) for c in zip(*made, strict=True)] or [[] for _ in WINDOWS.names]

    listed = map_rows(chosen, ["h", "text"], WINDOWS, each)
    place = F.row_number().over(Window_.partitionBy("labelled").orderBy("h", "tokens"))
    kept = listed.withColumn("place", place).where(F.col("place") <= windows).orderBy("labelled", "place").collect()
    return [(r["tokens"], r["tags"], r["kind"]) for r in kept]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_texts: int = 20_000, train_windows: int = 300) -> DataFrame:
    """One row per input row: id and spans (array of kind, start, end; code points, end exclusive; kinds in KINDS).

    The field is trained on at most train_windows windows with a labelled value and as many without, of about train_texts
    whole texts; every text is scanned whole. Null and empty texts have no spans; repeated rows give repeated results; an
    empty table none (and an untrained field adds no spans). A tagged span that meets a pattern's span is left to that.
    """
    trained = train(training_windows(df, text_col, train_texts, train_windows))
    features, near, file, pairs, context = trained.features, trained.near, trained.file, trained.pairs, trained.context
    schema = T.StructType([field(id_col, id_type(df, id_col)), field("spans", T.ArrayType(T.StructType([field("kind", T.StringType()), field("start", T.LongType()), field("end", T.LongType())])))])
    state: dict[str, Field] = {}

    def each(ids: list, texts: list) -> list[list]:
        if "model" not in state:
            state["model"] = Field(features, near, file, pairs, context)
        return [ids, [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for _, spans in scan(texts, state["model"])]]

    return map_rows(df, [id_col, text_col], schema, each)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
