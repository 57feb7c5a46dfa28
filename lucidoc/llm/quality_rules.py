"""Quality rules as a short-circuit cascade.

Each rule has a predicate that rejects a text. On a random sample, `plan` measures what each rule costs and which
texts it rejects, and puts the rules in order of rejection per cost, given the rules before: the texts they let pass and the
measures they made already. A text goes
through the rules in that order up to the first that rejects it, so most of the costly rules see
only what the cheap ones let pass. The verdict doesn't depend on the order, so neither a changed
sample nor a slow machine changes a result. `decide` and `filtered` stop at the first rejection; `measure`
reports measures of rejected texts as well, so it saves only what no column shows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORDS, per_document, prepare, released

SYMBOLS = "#*$%&|<>"


class TextView:
    """A text's measures, each computed at its first use. A null text has none of anything."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORDS.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_bangs(self) -> int:
        return self.text.count("!") + self.text.count("?")

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur twice or more, the first occurrence included."""
        n = len(self.words)
        if n < 4:
            return 0
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        base = len(number)
        _, pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        _, back, counts = np.unique(pairs[:-1] * base + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        return int(hit.sum())


#: Rules by name; each says whether a text is rejected. The first two are the base rules.
RULES: dict[str, Callable[[TextView], bool]] = {
    "few_words": lambda v: v.n_words < 50,
    "repeated_words": lambda v: 100 * v.n_repeat_words > 50 * v.n_words,
    "symbols": lambda v: 10 * v.n_symbols > 3 * v.n_words,
    "shouting": lambda v: 10 * v.n_bangs > 3 * v.n_words,
    # One or two repeats in a text of few lines, such as a licence line, are no junk.
    "repeated_lines": lambda v: v.n_dup_lines >= 3 and 100 * v.n_dup_lines > 30 * len(v.lines),
    "long_words": lambda v: v.word_chars > 25 * v.n_words,
    "short_words": lambda v: v.word_chars < 2 * v.n_words,
}
BASE = ("few_words", "repeated_words")


def trial(text: str | None, rules: dict) -> dict:
    """What each rule does with a text: whether it rejects it, the measures it uses, and its seconds; and the seconds of each measure.

    A rule's own seconds are what its measures don't account for."""
    out: dict = {"rejected": [], "uses": [], "own": [], "measures": {}}
    for rule in rules.values():
        view = TextView(text)
        began = time.perf_counter()
        out["rejected"].append(bool(rule(view)))
        spent = time.perf_counter() - began
        used = [m for m in vars(view) if m != "text"]  # inner measures come first, so each is timed alone
        again = TextView(text)
        for name in used:
            began = time.perf_counter()
            getattr(again, name)
            out["measures"][name] = seconds = time.perf_counter() - began
            spent -= seconds
        out["uses"].append(used)
        out["own"].append(max(spent, 0.0))
    return out


def ordered(trials: list[dict], rules: dict) -> list[str]:
    """Names of the rules, each time the one that rejects most per second of what is left: of the texts that those before it let
    pass, and at the cost of measures that those before it haven't made. Equal ones stay in the order of `rules`."""
    names, out, made, left = list(rules), [], set(), trials
    while len(out) < len(names):
        def gain(name: str) -> tuple[float, float]:
            k = names.index(name)
            cost = sum(t["own"][k] + sum(t["measures"][m] for m in t["uses"][k] if m not in made) for t in left) + 1e-9
            return sum(t["rejected"][k] for t in left) / cost, -cost

        best = max((n for n in names if n not in out), key=gain)
        k = names.index(best)
        out.append(best)
        made.update(m for t in trials for m in t["uses"][k])
        left = [t for t in left if not t["rejected"][k]]
    return out


def plan(docs: DataFrame, rules: dict = RULES, sample_rows: int = 512, seed: int = 9) -> list[str]:
    """Names of the rules in the order of the cascade, from a random sample of at most `sample_rows` rows, whole texts.

    The trials run where the rows are; the driver gets a few numbers for each. The order bears on speed alone. With no rows
    it is that of `rules`.
    """
    n = docs.count()
    sample = docs.select(F.col("text").cast("string").alias("text"))
    if n > sample_rows:
        sample = sample.sample(False, min(1.0, 1.5 * sample_rows / n), seed)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(trial(t, rules)) for t in batch.column(0).to_pylist()], pa.string())], names=["trial"])

    prepare(docs.sparkSession)
    return ordered([json.loads(r[0]) for r in sample.mapInArrow(run, "trial string").limit(sample_rows).collect()], rules)


def verdict(view: TextView, order: list[str], rules: dict = RULES) -> bool:
    """Whether every rule lets the text pass; stops at the first that doesn't."""
    return not any(rules[name](view) for name in order)


def _decide(order: list[str], rules: dict, texts: list) -> dict:
    return {"kept": [verdict(TextView(t), order, rules) for t in texts]}


def _measure(order: list[str], rules: dict, texts: list) -> dict:
    out: dict[str, list] = {k: [] for k in MEASURES}
    for text in texts:
        view = TextView(text)
        out["kept"].append(verdict(view, order, rules))
        out["base_failed"].append(any(rules[name](view) for name in BASE))
        for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            out[k].append(getattr(view, k))
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def decide(docs: DataFrame, rules: dict = RULES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and `kept`, with short circuit. Null and empty texts are rejected (few words);
    repeated rows are judged each; an empty table gives no rows; other columns are ignored."""
    return per_document(docs, partial(_decide, plan(docs, rules), rules), "kept boolean", keys)


def measure(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """`decide` with the measures that the base rules use, which are then computed for rejected texts too. A null text has
    none of anything."""
    return per_document(docs, partial(_measure, plan(docs, rules), rules), SCHEMA)


def filtered(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """The rows of documents that no rule rejects, with all their columns, whatever they are called.

    Null and empty texts go (few words); repeated rows are judged each; an empty table gives no rows."""
    prepare(docs.sparkSession)
    order = plan(docs, rules)
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches):
        for batch in batches:
            keep = [verdict(TextView(t), order, rules) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(run), schema)
