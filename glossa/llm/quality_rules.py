"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a bounded sample; rules then run in the order of rejections per
second, and a document meets no further rule after one rejects it. Each next rule is rated on the texts of the
sample that the rules before it leave, and measures that those have taken cost it nothing. The order changes the
work, never the verdict: a document is kept when no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from copy import copy
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WS_CHARS

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
#: From a word's first letter to its end; all that isn't ASCII counts as a letter.
LETTER_ON = re.compile(rb"[A-Za-z\x80-\xff][^\x20\t-\r]*")


class Measures:
    """A text's measures, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # of bytes: splits at space and \t to \r only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WS_CHARS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, LOWER))

    @cached_property
    def n_digits(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, DIGITS))

    @cached_property
    def n_letter_words(self) -> int:
        return len(LETTER_ON.findall(self.raw))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(WS_CHARS)]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        found, end, n = Counter(windows), 0, 0  # end: behind the last word counted
        for i, x in enumerate(windows):
            if found[x] > 1:
                n += i + 3 - max(i, end)
                end = i + 3
        return n


Rule = Callable[[Measures], bool]
#: A rule is true for a text that it rejects. The first two are the base rules.
RULES: dict[str, Rule] = {
    "few_words": lambda m: m.n_words < 50,
    "repetition": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "capitals": lambda m: m.n_upper > m.n_lower,
    "repeated_lines": lambda m: m.n_dup_lines >= 4 and 10 * m.n_dup_lines > 3 * m.n_lines,
    "word_length": lambda m: 2 * m.word_chars < 5 * m.n_words or m.word_chars > 12 * m.n_words,
    "digits": lambda m: 10 * m.n_digits > 3 * m.word_chars,
    "few_letters": lambda m: 10 * m.n_letter_words < 6 * m.n_words,
}
BASE = ("few_words", "repetition")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade_order(docs: DataFrame, text_col: str = "text", sample_rows: int = 400, rules: dict[str, Rule] = RULES, given: Sequence[str] = ()) -> list[str]:
    """Rule names in their order, by a bounded sample of at most ``sample_rows`` texts.

    Next comes the rule with the most rejections per second of the texts that are left; where none rejects any,
    the cheapest. given: measures that are taken of every text anyway. take() stops after the few partitions it needs.
    """
    texts = docs.select(text_col).sample(0.02, seed=5).take(sample_rows) or docs.select(text_col).take(sample_rows)
    left, order = [Measures(x[0]) for x in texts], []
    for m in left:
        for c in given:
            getattr(m, c)
    while len(order) < len(rules):
        tried = {}
        for name in rules:
            if name not in order:
                own = [copy(m) for m in left]  # with the measures taken so far
                began = time.perf_counter()
                hits = [rules[name](m) for m in own]
                tried[name] = (sum(hits), time.perf_counter() - began + 1e-9, [m for m, hit in zip(own, hits, strict=True) if not hit])
        best = min(tried, key=lambda name: (-tried[name][0] / tried[name][1], tried[name][1]))
        order.append(best)
        left = tried[best][2]
    return order


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400) -> DataFrame:
    """One row per input row: id, the measures, base_failed and kept.

    The measures are columns, so all of them are taken; the rules beyond the base run in their order and short-circuit,
    and what only they measure is taken where one of them asks for it. Null texts have no words and fail. Ids pass through, null or repeated; an empty table gives an empty
    result. Whole texts are read, however long; other columns aren't.
    """
    order = cascade_order(docs, text_col, sample_rows, {k: r for k, r in RULES.items() if k not in BASE}, COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in (*COLUMNS, "base_failed", "kept")}
            for text in b.column(1).to_pylist():
                m = Measures(text)
                for c in COLUMNS:
                    out[c].append(getattr(m, c))
                failed = any(RULES[x](m) for x in BASE)
                out["base_failed"].append(failed)
                out["kept"].append(not failed and not any(RULES[x](m) for x in order))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[c], pa.int64()) for c in COLUMNS), pa.array(out["base_failed"], pa.bool_()), pa.array(out["kept"], pa.bool_())], names=[id_col, *out])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in COLUMNS)}, base_failed boolean, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def quality_filter(docs: DataFrame, text_col: str = "text", sample_rows: int = 400) -> DataFrame:
    """The rows that no rule rejects, with all their columns; rules run short-circuit in the estimated order."""
    order = cascade_order(docs, text_col, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for text in b.column(at).to_pylist():
                m = Measures(text)
                keep.append(not any(RULES[x](m) for x in order))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
