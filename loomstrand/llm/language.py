"""Language identification by cross-parsing entropy.

For each labelled language a suffix automaton is built from a bounded sample of its text. A text is parsed greedily into
the longest phrases that occur in that sample (each phrase one walk of the automaton from its start state); a language
explains a text well if few phrases are needed. Counts are normalised by the text's length and the sample's size, and the
language with the lowest entropy wins.

The automata become transition tables over the letters of their own samples, all of them, so that thousands of texts take
each step together; tables that would be large are kept as sorted transitions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.llm.common import crc_mod, field, hash_sample, id_type, map_rows, table

#: The bits above hold the number of phrases that a step completes.
ENDS = np.int32(1 << 29)
SPACE, OTHER, PAD = 0, 1, 2
#: Places of full tables, of all languages together.
DENSE = 1 << 25


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the minimal automaton of all factors of the sequence (Blumer et al. 1985)."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return go


class Languages:
    """The automata of the languages as tables, each over all letters of its sample; other letters are OTHER to it."""

    def __init__(self, samples: tuple[tuple[str, str], ...], dense: int = DENSE):
        self.names = [name for name, _ in samples]
        symbols = sorted({ch for _, text in samples for ch in text.lower() if ch.isalpha()})
        self.codes = np.where(letters(), OTHER, SPACE).astype(np.uint16 if len(symbols) + 3 < 1 << 16 else np.uint32)
        for k, ch in enumerate(symbols):
            self.codes[ord(ch)] = k + 3
        self.own, self.tables, self.bits = [], [], []
        for _, text in samples:
            sample = self.encode(text)
            known = np.unique(sample[sample > PAD])
            own = np.full(len(symbols) + 3, OTHER, np.int64)
            own[[SPACE, PAD]] = SPACE, PAD
            own[known] = np.arange(len(known)) + 3
            width = len(known) + 3
            go = suffix_automaton(own[sample].tolist())
            # where a phrase cannot go on, it ends and the letter begins the next; a letter the sample lacks is one itself
            root = np.array([go[0][c] * width + ENDS if c in go[0] else 2 * ENDS for c in range(width)], np.int64)
            first = np.where(root == 2 * ENDS, ENDS, root)
            edges = sorted((state * width + c, to * width) for state, edges in enumerate(go) for c, to in edges.items())
            at, to = np.array(edges, np.int64).reshape(-1, 2).T
            if len(go) * width <= dense:
                dense -= len(go) * width
                step = np.tile(root, (len(go), 1)).astype(np.int32)
                step[0] = first
                step = step.ravel()
                step[at] = to
                self.tables.append(step)
            else:
                self.tables.append((at.copy(), to.copy(), root, first))
            self.own.append(own)
            self.bits.append(np.log2(max(2, len(sample))))

    @staticmethod
    def step(table: np.ndarray | tuple[np.ndarray, ...], state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states, with the phrases that end in the bits above."""
        if isinstance(table, np.ndarray):
            return table.take(state + codes)
        at, to, root, first = table
        place = state + codes
        k = np.minimum(np.searchsorted(at, place), len(at) - 1)
        return np.where(at[k] == place, to[k], np.where(state == 0, first[codes], root[codes]))

    def encode(self, text: str) -> np.ndarray:
        return self.codes[code_points(text.lower())]

    def phrases(self, texts: list[np.ndarray], piece: int = 512) -> np.ndarray:
        """The phrases that each language (column) needs for each text (row).

        Texts are parsed whole, in pieces side by side: first each piece as if a phrase began there, then again from the
        state in which the piece before it really ended, up to the place where both parses are in one state, which most
        reach soon; what lies beyond stays. A piece that never does hands its new end to the next one.
        """
        owner, parts, before = [], [], []
        for k, codes in enumerate(texts):
            for at in range(0, len(codes), piece):
                before.append(len(parts) - 1 if at else -1)
                owner.append(k)
                parts.append(codes[at : at + piece])
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        if not parts:
            return out
        order = np.argsort([-len(p) for p in parts], kind="stable")
        column = np.empty(len(parts), np.int64)
        column[order] = np.arange(len(parts))
        sizes = np.array([len(parts[k]) for k in order])
        grid = np.full((piece, len(parts)), PAD, self.codes.dtype)
        for c, k in enumerate(order):
            grid[: sizes[c], c] = parts[k]
        owner_of, prior = np.array(owner)[order], np.array(before)[order]
        prior = np.where(prior >= 0, column[prior], -1)
        closes = np.ones(len(parts), bool)  # the last piece of a text
        closes[prior[prior >= 0]] = False
        active = [int(np.count_nonzero(sizes > t)) for t in range(int(sizes[0]))]
        states, counts = (np.zeros((len(active), len(parts)), np.int32) for _ in range(2))
        last = (sizes - 1, np.arange(len(parts)))
        for lang, (table, own) in enumerate(zip(self.tables, self.own, strict=True)):
            state = np.zeros(len(parts), np.int64)
            count = np.zeros(len(parts), np.int64)
            for t, n in enumerate(active):
                made = self.step(table, state[:n], own[grid[t, :n]])
                count[:n] += made >> 29
                state[:n] = made & (ENDS - 1)
                states[t, :n], counts[t, :n] = state[:n], count[:n]
            begun = np.zeros(len(parts), np.int64)
            while True:
                entry = np.where(prior >= 0, states[last][prior], 0)
                todo = np.flatnonzero(entry != begun)
                if not len(todo):
                    break
                begun[todo] = entry[todo]
                state, count = entry[todo], np.zeros(len(todo), np.int64)
                for t in range(len(active)):
                    stay = sizes[todo] > t
                    todo, state, count = todo[stay], state[stay], count[stay]
                    if not len(todo):
                        break
                    made = self.step(table, state, own[grid[t, todo]])
                    count, state = count + (made >> 29), made & (ENDS - 1)
                    met = states[t, todo] == state
                    counts[t:, todo[met]] += (count[met] - counts[t, todo[met]]).astype(np.int32)
                    todo, state, count = todo[~met], state[~met], count[~met]
                    states[t, todo], counts[t, todo] = state, count
            out[:, lang] = np.bincount(owner_of, counts[last] + (closes & (states[last] > 0)), len(texts))
        return out


@lru_cache(maxsize=2)
def languages(samples: tuple[tuple[str, str], ...]) -> Languages:
    return Languages(samples)


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, sample_chars: int, max_langs: int | None) -> tuple[tuple[str, str], ...]:
    """(language, text) samples: of each language about sample_docs texts chosen by a hash, cut at sample_chars
    characters in all. The model grows with the number of languages (all, if max_langs is None), not with the corpus."""
    rows = labelled.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    chosen = hash_sample(rows.withColumn("text", F.substring("text", 1, sample_chars)), ["id", "text"], sample_docs, "id", by="lang", most_groups=max_langs)
    by: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["id"] or "", r["text"])):
        by.setdefault(r["lang"], []).append(r["text"])
    out = []
    for lang, texts in sorted(by.items()):
        left, sample = sample_chars, []
        for k, t in enumerate(sorted(texts, key=len)):  # short texts leave their share to longer ones
            sample.append(t[: max(1, left // (len(texts) - k))])
            left -= len(sample[-1])
        joined = " ".join(sample)
        if any(ch.isalpha() for ch in joined):
            out.append((lang, joined))
    return tuple(out)


def identify_language(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 48, sample_chars: int = 24_000, max_langs: int | None = None) -> DataFrame:
    """One row per row of df: id, lang_pred, score, phrases (per learned language).

    `labelled` has the training rows. Null texts and texts without a letter get 'und' and score 0, as does everything if
    nothing could be learned. Ties go to the first language in alphabetical order. Repeated rows give repeated results;
    an empty table gives none. The score is the winner's share of the languages' inverse entropies. Texts are read whole.
    """
    samples = learn(labelled, id_col, text_col, lang_col, sample_docs, sample_chars, max_langs)
    schema = T.StructType([field(id_col, id_type(df, id_col)), field("lang_pred", T.StringType()), field("score", T.DoubleType()), field("phrases", T.ArrayType(T.LongType()))])

    def each(ids: list, texts: list) -> list[list]:
        model = languages(samples)
        lowered = [(t or "").lower() for t in texts]
        points = [code_points(t) for t in lowered]
        some = [bool(letters()[p].any()) for p in points]
        counts = model.phrases([model.codes[p] for p in points])
        pred, score = ["und"] * len(ids), [0.0] * len(ids)
        if model.names:
            inverse = 1 / (counts * np.array(model.bits) + 1e-9)
            best = inverse.argmax(axis=1)
            share = inverse[np.arange(len(ids)), best] / inverse.sum(axis=1)
            for k, ok in enumerate(some):
                if ok:
                    pred[k], score[k] = model.names[best[k]], float(share[k])
        return [ids, pred, score, counts.tolist()]

    return map_rows(df, [id_col, text_col], schema, each, rows=1024)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, docs.where(crc_mod("doc_id", 3) != 1))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
