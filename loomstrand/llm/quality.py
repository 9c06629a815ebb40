"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a bounded sample; rules then run in falling order of rejections
per second, and a document that one rule rejects skips the rest. The order changes the time, never the verdict: a
document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomstrand.llm.common import SPACES, field, hash_sample, id_type, map_rows, table

SYMBOLS = "#*$%&|<>"


@dataclass
class Text:
    """A text, its words (UTF-8 bytes) and its base counts."""

    text: str
    words: list[bytes]
    lines: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _upper(d: Text) -> bool:
    up = sum(map(d.text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    low = sum(map(d.text.count, "abcdefghijklmnopqrstuvwxyz"))
    return 2 * up > up + low


#: Thresholds follow published web-corpus filters, loosened for languages with long words.
RULES = (
    Rule("symbols", lambda d: 5 * d.n_symbols > len(d.words)),
    Rule("mean_word_length", lambda d: not 2 * len(d.words) <= d.word_chars <= 20 * len(d.words)),
    Rule("duplicate_lines", lambda d: 10 * d.n_dup_lines > 3 * d.lines),
    Rule("shouting", lambda d: 10 * d.text.count("!") > 3 * len(d.words)),
    Rule("upper_case", _upper),
    Rule("digits", lambda d: 10 * sum(map(d.text.count, "0123456789")) > 3 * d.word_chars),
    Rule("ellipsis", lambda d: 10 * (d.text.count("...\n") + d.text.count("…\n")) > 3 * d.lines),
    Rule("no_letters", lambda d: 10 * sum(w.isalpha() or not w.isascii() or any(97 <= b <= 122 or 65 <= b <= 90 for b in w) for w in d.words) < 6 * len(d.words)),
    Rule("one_word", lambda d: len(d.words) >= 20 and 10 * max(Counter(d.words).values()) > 4 * len(d.words)),
)


def repeat_words(words: list, n: int = 5) -> int:
    """Words covered by n-word windows whose words occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, k in Counter(windows).items() if k > 1}
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + n - max(i, upto)
            upto = i + n
    return covered


def measure(text: str | None) -> Text:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return Text(text, words, len(lines), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


def base_failed(d: Text) -> bool:
    return len(d.words) < 10 or 100 * d.n_repeat_words > 20 * len(d.words)


def plan_cascade(sample: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[dict]:
    """Rules in falling order of rejections per second, each measured on the texts that the rules before it leave."""
    left, rest, plan = [d for d in map(measure, sample) if not base_failed(d)], list(rules), []
    while rest:
        found = []
        for k, rule in enumerate(rest):
            began = time.perf_counter()
            verdicts = [rule.rejects(d) for d in left]
            cost = (time.perf_counter() - began) / max(1, len(left)) + 1e-9
            found.append((sum(verdicts) / max(1, len(left)) / cost, -cost, -k, verdicts))
        rate, cost, k, verdicts = max(found, key=lambda x: x[:3])
        rule = rest.pop(-k)
        plan.append({"rule": rule, "cost_s": -cost, "selectivity": sum(verdicts) / max(1, len(left)), "rate": rate})
        left = [d for d, bad in zip(left, verdicts, strict=True) if not bad]
    return plan


def quality_cascade(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """One row per input row: id, base counts, base_failed, kept, rejected_by (null if kept; 'base' for the base rule).

    The sample is about sample_rows rows chosen by a hash, never over four times as many; it only orders the rules. Null and empty texts have no word, so they fail the base rule. Repeated rows give repeated results; an
    empty table gives none; other columns are ignored. Texts are measured whole, a few hundred rows at a time.
    """
    sample = sorted(r[0] or "" for r in hash_sample(df, [text_col], sample_rows, id_col))
    order = [p["rule"] for p in plan_cascade(sample, rules)]
    schema = T.StructType([
        field(id_col, id_type(df, id_col)), *(field(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        field("base_failed", T.BooleanType()), field("kept", T.BooleanType()), field("rejected_by", T.StringType()),
    ])

    def each(ids: list, texts: list) -> list[list]:
        out: list[list] = [[] for _ in schema.names]
        for i, text in zip(ids, texts, strict=True):
            d = measure(text)
            failed = base_failed(d)
            by = "base" if failed else next((r.name for r in order if r.rejects(d)), None)
            for column, v in zip(out, (i, len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, by is None, by), strict=True):
                column.append(v)
        return out

    return map_rows(df, [id_col, text_col], schema, each)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


#: The verdict is the conjunction of all rules, so SQL needs no order.
OP1_SQL = r"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select doc_id, u.i, list_slice(ws, u.i, u.i + 4) g from (select doc_id, ws from w where len(ws) >= 5) q, unnest(range(1, len(ws) - 3)) u(i)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i + k.j) n from r, unnest(range(0, 5)) k(j) group by doc_id),
m as (select w.doc_id, t, ws, ls, len(ws) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(c.n, 0) n_repeat_words from w left join c using (doc_id)),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) up, length(regexp_replace(t, '[^a-z]', '', 'g')) low from m)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
  cast(n_repeat_words as bigint) n_repeat_words, base_failed,
  not base_failed and 5 * n_symbols <= n_words and word_chars between 2 * n_words and 20 * n_words and 10 * n_dup_lines <= 3 * len(ls)
  and 10 * length(regexp_replace(t, '[^!]', '', 'g')) <= 3 * n_words and 2 * up <= up + low
  and 10 * length(regexp_replace(t, '[^0-9]', '', 'g')) <= 3 * word_chars
  and 10 * (len(string_split(t, '...' || chr(10))) - 1 + len(string_split(t, '…' || chr(10))) - 1) <= 3 * len(ls)
  and 10 * len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) >= 6 * n_words
  and (n_words < 20 or 10 * coalesce(list_max(map_values(list_histogram(ws))), 0) <= 4 * n_words) kept
from v
"""
