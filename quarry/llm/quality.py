"""Quality classification by a sparse rule ensemble.

Small trees are boosted over text statistics; every path from a root to a node
is a conjunctive rule; an L1-penalised logistic regression keeps a few of the
rules; the kept ones become one Spark column over the statistics.  Labels come
from at most ``max_labelled`` rows, chosen by a hash of their id; the statistics
of every whole text are computed once and kept as a narrow table.

Defined cases: null and empty texts have all statistics 0 and are scored like
any other; without both labels the score is the mean label (0.5 without any);
ties in split gain go to the first statistic and lowest cut; repeated rows are
scored alike; a text of any length is read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._cluster import small_batches
from quarry.llm._text import Words, chunks, lean

STATISTICS = [
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "punctuation", "symbol", "bar_or_bang", "line_break",
    "non_ascii", "distinct_words", "top_word", "words_per_line", "bare_words", "repeated_pairs",
]

_KIND = np.zeros((256, 6), np.int64)  # upper, digit, punctuation, symbol, bar or exclamation mark, line break
for _i, _chars in enumerate((range(0x41, 0x5B), range(0x30, 0x3A), b".,;:?'\"()-", b"#$%&*+<=>@[]^_`{}~\\/", b"|!", b"\n\r")):
    _KIND[list(_chars), _i] = 1


def _per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, 0, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _repeats(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the distinct values and the count of the commonest."""
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(r))))
    return np.bincount(r[at], minlength=n), top


def statistics_of(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows by STATISTICS."""
    n = len(offs) - 1
    w = Words(data, offs)
    h, row = w.hashes(), w.rows()
    words, size = np.diff(w.first), np.diff(offs) - 1
    kinds = np.stack([_per_row(_KIND[:, i].astype(np.int8)[data], offs) for i in range(6)], 1)
    length = w.ends - w.starts
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, length)
    distinct, top = _repeats(row, h, n)
    pair = np.flatnonzero(row[1:] == row[:-1])
    pairs, _ = _repeats(row[pair], h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1], n)
    last = data[np.maximum(w.ends - 1, 0)]
    bare = _per_row(((last >= 0x61) & (last <= 0x7A) | (last >= 0x80)).astype(np.int8), w.first)
    share = lambda x, of: x / np.maximum(of, 1)
    return np.stack(
        [np.log1p(size), np.log1p(words), share(_per_row(length, w.first), words), np.log1p(longest), *(share(kinds[:, i], size) for i in range(6)),
         share(_per_row((data >= 0x80).astype(np.int8), offs), size), share(distinct, words), share(top, words), np.log1p(share(words, kinds[:, 5] + 1)),
         share(bare, words), 1 - share(pairs, np.maximum(words - 1, 1)) * (words > 1) - (words <= 1)], 1,
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one double a statistic) of every whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                x = statistics_of(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c) for c in np.ascontiguousarray(x.T))], ["id", *STATISTICS])

    out = docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, " + ", ".join(f"{c} double" for c in STATISTICS))
    return out.withColumnRenamed("id", id_col)


@dataclass
class Rules:
    """sigmoid(bias + sum of weights of the rules that hold); a rule is a tuple of (statistic, "<=" or ">", cut)."""

    bias: float = 0.0
    rules: list[tuple[float, tuple[tuple[str, str, float], ...]]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(float(self.bias))
        for weight, rule in self.rules:
            holds = F.lit(True)
            for name, op, cut in rule:
                holds = holds & (F.col(name) <= cut if op == "<=" else F.col(name) > cut)
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(bins: np.ndarray, r: np.ndarray, rows: np.ndarray, path: tuple, depth: int, step: float, f: np.ndarray, out: list, least: int = 10) -> None:
    """Grows one regression tree on the residual r, adds its leaves' means to f and its paths to out."""
    best = (1e-9, 0, 0)
    if depth and len(rows) >= 2 * least:
        for j in range(bins.shape[1]):
            n = np.bincount(bins[rows, j], minlength=64).cumsum()
            s = np.bincount(bins[rows, j], r[rows], minlength=64).cumsum()
            ok = (n >= least) & (n <= len(rows) - least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (s[-1] - s) ** 2 / np.maximum(n[-1] - n, 1) - s[-1] ** 2 / n[-1], 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[0] <= 1e-9:
        f[rows] += step * r[rows].mean()
        return
    _, j, k = best
    left = bins[rows, j] <= k
    for side, op in ((left, "<="), (~left, ">")):
        rule = (*path, (j, op, k))
        out.append(rule)
        _paths(bins, r, rows[side], rule, depth - 1, step, f, out, least)


def _lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the bias is not penalised."""
    n = len(y)
    a = np.concatenate([np.ones((n, 1)), x], 1)
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(a @ v) ** 2)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y) / n
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


def fit(labelled: DataFrame, id_col: str = "doc_id", label_col: str = "label", max_labelled: int = 20_000, trees: int = 40, depth: int = 3, penalty: float = 0.0005) -> Rules:
    """Rules from rows of statistics with a 0/1 label; rows with a null label teach nothing."""
    rows = labelled.where(F.col(label_col).isin(0, 1))
    n = rows.count()
    if n > max_labelled:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 32)) < max_labelled * (1 << 32) // n)
    found = rows.select(*STATISTICS, F.col(label_col).cast("double").alias("y"), F.col(id_col).cast("string").alias("id")).toArrow().sort_by("id")
    y = found["y"].to_numpy()
    if not 0 < y.sum() < len(y):
        mean = float(y.mean()) if len(y) else 0.5
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return Rules(float(np.log(mean / (1 - mean))))
    x = np.stack([found[c].to_numpy() for c in STATISTICS], 1)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 64)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    rng, f, paths = np.random.default_rng(0), np.full(len(y), y.mean()), []
    for _ in range(trees):
        own = np.flatnonzero(rng.random(len(y)) < 0.5)
        if len(own):
            _paths(bins, y - f, own, (), depth, 0.3, f, paths)
    paths = list(dict.fromkeys(paths))
    holds = np.ones((len(y), len(paths)), bool)
    for i, rule in enumerate(paths):
        for j, op, k in rule:
            holds[:, i] &= bins[:, j] <= k if op == "<=" else bins[:, j] > k
    _, first = np.unique(holds, axis=1, return_index=True)
    first = np.sort(first)
    bias, w = _lasso_logistic(holds[:, first].astype(float), y, penalty)
    kept = [(float(w[a]), tuple((STATISTICS[j], op, float(cuts[j][k])) for j, op, k in paths[i])) for a, i in enumerate(first) if abs(w[a]) > 1e-6]
    return Rules(bias, kept)
