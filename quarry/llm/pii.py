"""Personal data by bootstrapped contextual extraction.

Identifiers of a strict form (e-mail and IPv4 addresses, card and phone numbers)
are the seeds.  The one and two words before an identifier are a lexical pattern
of its kind.  Looser forms (a host without a dot, "[at]", numbers without a plus
sign or that fail their check sum, IPv6) are candidates; patterns and instances
make a bipartite graph, whose edges are counted occurrences.  A pattern's
confidence is the share of all places of its words in the corpus that a reliable
instance of its kind follows, each weighed by its own reliability; candidates that
fail no check and aren't reliable yet tell little and count as a tenth of a place
only.  A pattern is trusted from a least confidence and a least number of
different reliable instances on.
A candidate is as reliable as the best trusted pattern that it follows, seeds are
reliable without one, and so is a candidate that is a seed in another dress.
Rounds of this, each two joins over stored tables, run until nothing new is
found; every occurrence of a reliable candidate is a span.

The texts are read twice: for identifiers, and for the number of places of the
patterns that enough instances support.  The second reading knows those patterns
by a bit set of fixed size; what passes it is counted and joined exactly.

Defined cases: null and empty texts have no spans; a word of more than 64
characters is no cue, and what lies behind it isn't either; a cue that touches
its identifier, but for an opening bracket or quote, is a pattern of its own that
is counted by identifiers only; of a candidate's kinds the more reliable one
counts, on ties the one listed first; rows are told apart by their place, so
null and repeated ids are documents like any other; an empty table gives none;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._cluster import dropped, release, small_batches, stored
from quarry.llm._packed import groups
from quarry.llm._text import SECOND, Words, chunks, lean, signed

Span = tuple[int, int]

# The kinds in the order of the results, and their forms.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
DIALLED = re.compile(r"[\x20().0-9-]*+")

# The forms of candidates.
AT = re.compile(r"@|\x20?[\[({]\x20?at\x20?[\])}]\x20?", re.I)
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]++)*+", re.I)
DOT = re.compile(r"\x20?[\[({]\x20?dot\x20?[\])}]\x20?", re.I)
HEXED = re.compile(r"[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+)++")
NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])*+")

SPACES, OPENING, CUE = frozenset("\x20\t\n\v\f\r"), frozenset("([{<\"'"), 64
LOWER = {c: c + 32 for c in range(65, 91)}
BITS = 1 << 25
HELD = 1 << 20  # counts that a task holds back


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def fours(text: str) -> list[Span]:
    """Runs of four numbers joined by dots, whatever the numbers are."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            n = sum(map(len, parts[i : i + 4])) + 3
            out.append((at, at + n))
            at += n + 1
    return out


def ips(text: str) -> list[Span]:
    small = lambda p: len(x := p.lstrip("0")) < 4 and int(x or "0") < 256
    return [(a, b) for a, b in fours(text) if all(map(small, text[a:b].split(".")))]


def cards(text: str) -> list[Span]:
    out = []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    out, plus = [], text.find("+")
    while plus >= 0:
        after = plus + 1
        if "0" <= text[after : after + 1] <= "9":
            last = DIALLED.match(text, plus + 2).end() - 1
            while last > plus + 2 and not "0" <= text[last] <= "9":
                last -= 1
            if last > plus + 2:
                after = last + 1
                if 10 <= sum("0" <= c <= "9" for c in text[plus:after]) <= 15:
                    out.append((plus, after))
        plus = text.find("+", after)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the strict forms, in the order of the results."""
    found = [(a, b, k) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _apart(text: str, a: int, b: int) -> bool:
    """Nothing of a word or number goes on at either side."""
    return not (a and (text[a - 1].isalnum() or text[a - 1] in "_@")) and not (b < len(text) and (text[b].isalnum() or text[b] in "_@"))


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(start, end, possible kinds) of candidates that meet neither a base span nor each other, in order."""
    found: list[tuple[int, int, tuple[int, ...]]] = []
    held, reach = sorted((a, b) for a, b, _ in taken), []
    for _, b in held:
        reach.append(max(b, reach[-1] if reach else 0))

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(held, (b, 0))
        return not i or reach[i - 1] <= a

    def take(spans: list[tuple[int, int, tuple[int, ...]]]) -> None:
        new = [s for s in spans if free(s[0], s[1])]
        found.extend(new)
        held.extend((a, b) for a, b, _ in new)
        held.sort()
        reach.clear()
        for _, b in held:
            reach.append(max(b, reach[-1] if reach else 0))

    spans, end = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, m.end()) if start < m.start() else None
        if host and _apart(text, start, host.end()):
            end = host.end()
            spans.append((start, end, (0,)))
    take(spans)
    spans = [(a, b, (1,)) for a, b in fours(text) if _apart(text, a, b)]
    if ":" in text:
        spans += [(m.start(), m.end(), (1,)) for m in HEXED.finditer(text) if 2 <= m.group().count(":") <= 7 and m.end() - m.start() <= 39 and _apart(text, *m.span())]
    clear, end = [], 0
    for s in sorted(spans):
        if s[0] >= end:
            clear.append(s)
            end = s[1]
    take(clear)
    spans = []
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 7 and _apart(text, *m.span()):
            n = sum("0" <= c <= "9" for c in m.group())
            kinds = tuple(k for k, lo, hi in ((2, 12, 19), (3, 7, 15)) if lo <= n <= hi)
            if kinds:
                spans.append((m.start(), m.end(), kinds))
    take(spans)
    return sorted(found)


def instance(kind: int, form: str) -> str:
    """What an identifier is, whatever its dress."""
    if kind == 0:
        return DOT.sub(".", AT.sub("@", form)).translate(LOWER)
    return form.translate(LOWER) if kind == 1 else re.sub(r"[^0-9]", "", form)


def cues(text: str, start: int) -> list[str]:
    """The patterns before a span: its last word and its last two, in lower case; a closing space tells that the cue doesn't touch it."""
    words, at, close = [], start, ""
    while len(words) < 2:
        end = at
        while at and end - at <= CUE and text[at - 1] not in SPACES:
            at -= 1
        if end - at > CUE:
            break
        word = text[at:end].translate(LOWER)
        if at == end or (end == start and OPENING.issuperset(word)):
            close = " " if end == start else close
            if not at:
                break
        elif end:
            words.insert(0, word)
        while at and text[at - 1] in SPACES:  # a run of spaces is crossed once a span; spans lie apart
            at -= 1
        if not at:
            break
    return [" ".join(words[i:]) + close for i in range(len(words))][::-1]


STRUCT = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("inst", pa.string()), ("cues", pa.list_(pa.string()))])
SPANS = "array<struct<kind:int,start:int,end:int,inst:string,cues:array<string>>>"


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, base, loose): each document's strict spans and its candidates, with what they are and the cues before them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            base, loose = [], []
            for text in b.column(1):
                text = text.as_py() or ""
                own = base_spans(text)
                wide = loose_spans(text, own)
                tell = lambda k, s, e, t=text: {"kind": k, "start": s, "end": e, "inst": instance(k, t[s:e]), "cues": cues(t, s)}
                base.append([tell(k, s, e) for s, e, k in own])
                loose.append([tell(k, s, e) for s, e, ks in wide for k in ks])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), b.column(0), pa.array(base, pa.list_(STRUCT)), pa.array(loose, pa.list_(STRUCT))], ["row", "id", "base", "loose"])
            row += b.num_rows

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"row long, id {kind}, base {SPANS}, loose {SPANS}")


def _cue_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, of pairs of neighbours in a row, and which words have a neighbour after them."""
    rows, own = words.rows(), words.hashes()
    near = np.flatnonzero(rows[1:] == rows[:-1])
    return own, SECOND.grams(own, 2)[near] if len(own) > 1 else own[:0], near


def _hashed(patterns: DataFrame) -> DataFrame:
    """patterns (pattern) of one or two words with their hash h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for lo, _, data, offs in chunks(b.column(0)):
                words = Words(data, offs, lower=True)
                own, pairs, near = _cue_hashes(words)
                out[lo + words.rows()] = own
                out[lo + words.rows()[near]] = pairs
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed(out))], ["pattern", "h"])

    return patterns.select("pattern").mapInArrow(lean(run), "pattern string, h long")


def places(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, places): how often the words of each pattern stand in the texts."""
    spark = docs.sparkSession
    known = stored(_hashed(patterns), "patterns")
    at = F.pmod("h", F.lit(BITS)) + 1  # bitmaps count from 1
    rows = known.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # BITS bits at most
    bits = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shipped = spark.sparkContext.broadcast(bits)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        line, _, which = groups(np.concatenate([h for h, _ in parts]))
        return line, np.bincount(which, np.concatenate([n for _, n in parts]), len(line)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a task, added up before they leave it as far as HELD of them go."""
        has, parts = shipped.value, []

        def told(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], ["h", "n"])

        for b in batches:
            for _, _, data, offs in chunks(b.column(0)):
                own, pairs, _ = _cue_hashes(Words(data, offs, lower=True))
                h = np.concatenate([own, pairs])
                p = (h & np.uint64(BITS - 1)).astype(np.int64)
                parts.append(summed([(h := h[(has[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1], np.ones(len(h)))]))
                if sum(len(x) for x, _ in parts) > HELD:
                    parts = [summed(parts)]
                    if len(parts[0][0]) > HELD // 2:
                        yield told(*parts.pop())
        if parts:
            yield told(*summed(parts))

    counted = docs.select(text_col).mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("places"))
    return known.join(counted, "h").select("pattern", "places")


def bootstrap(found: DataFrame, docs: DataFrame, confidence: float = 0.5, support: int = 3, rounds: int = 5, doubt: float = 0.1, text_col: str = "text") -> DataFrame:
    """(kind, inst, reliability) of the candidates that trusted patterns, or seeds of another dress, make reliable."""
    seen = found.select(F.explode("base").alias("s"), F.lit(True).alias("seed")).union(found.select(F.explode("loose").alias("s"), F.lit(False).alias("seed")))
    nodes = stored(seen.groupBy("s.kind", "s.inst").agg(F.max("seed").alias("seed")), "instances")
    edges = seen.select("s.kind", "s.inst", F.explode("s.cues").alias("pattern")).groupBy("kind", "pattern", "inst").agg(F.count("*").alias("n"))
    edges = stored(edges.join(nodes, ["kind", "inst"]), "edges")
    wide = edges.groupBy("pattern").agg(F.sum("n").alias("identified"), F.count_if("seed").alias("seeds"), F.count("*").alias("all")).where((F.col("seeds") > 0) & (F.col("all") >= support))
    wide = stored(wide.select("pattern", "identified"), "wide")
    free = wide.where(F.endswith("pattern", F.lit(" ")))
    if free.isEmpty():
        counted = wide.select("pattern", F.lit(None).cast("long").alias("places"))
    else:
        counted = places(docs, free, text_col)
    total = wide.join(counted, "pattern", "left").select("pattern", F.greatest("identified", F.coalesce("places", F.lit(0))).alias("total"))
    edges2 = stored(edges.join(total, "pattern"), "edges")
    reliable = nodes.where("seed").select("kind", "inst", F.lit(1.0).alias("reliability"))
    known, old = -1, []
    for _ in range(rounds):
        doubtful = F.col("reliability").isNull() & (F.col("kind").isin(0, 3) | F.contains("inst", F.lit(":")))  # addresses, numbers to dial and IPv6 have failed no check
        sums = [F.sum(F.col("n") * F.col("reliability")).alias("good"), F.sum(F.when(doubtful, F.col("n")).otherwise(0)).alias("open"), F.count("reliability").alias("instances"), F.max("total").alias("total")]
        scored = edges2.join(reliable, ["kind", "inst"], "left").groupBy("kind", "pattern").agg(*sums).withColumn("trust", F.col("good") / (F.col("total") - (1 - doubt) * F.col("open")))
        trusted = scored.where((F.col("trust") >= confidence) & (F.col("instances") >= support)).select("kind", "pattern", "trust")
        told = edges2.where("not seed").join(trusted, ["kind", "pattern"]).groupBy("kind", "inst").agg(F.max("trust").alias("reliability"))
        fresh = stored(nodes.where("seed").select("kind", "inst", F.lit(1.0).alias("reliability")).union(told), "reliable")
        old.append(fresh)
        reliable, before, known = fresh, known, fresh.count()
        if known == before:
            break
    dropped(edges, wide, edges2, nodes, *old[:-1])
    return reliable


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(row, id, base, all): arrays of (kind, start, end) by start and kind, kind being a place in KINDS and row the document's own number."""
    small_batches(docs.sparkSession)
    found = stored(identifiers(docs, id_col, text_col), "identifiers")
    reliable = bootstrap(found, docs, text_col=text_col, **how)
    loose = found.select("row", F.explode("loose").alias("s")).select("row", "s.kind", "s.start", "s.end", "s.inst").join(reliable, ["kind", "inst"])
    one = loose.groupBy("row", "start", "end").agg(F.min(F.struct((-F.col("reliability")).alias("r"), "kind")).alias("best"))
    more = one.groupBy("row").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("more"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = found.select("row", "id", plain.alias("base")).join(more, "row", "left")
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    out = stored(every.select("row", "id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"), order)).alias("all")), "spans")
    dropped(found, reliable)
    release(docs.sparkSession)
    return out


def report(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): counts and digest of the strict forms, all spans, and how many were discovered."""
    names = F.array(*map(F.lit, KINDS))
    tell = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select(F.col("id").alias(id_col), *counts, F.sha2(tell("base"), 256).alias("base_sha256"), tell("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_found"))


def masked(text: str, spans) -> str:
    """The text with each span as its kind's name in angle brackets; of spans that meet, the first stands for both."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with all spans masked in their texts."""
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = extract(numbered, "__row", text_col, **how).where(F.size("all") > 0).select(F.col("id").alias("__row"), F.col("all").alias("__spans"))
    both = numbered.join(found, "__row", "left").drop("__row")
    at = both.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(b.num_columns - 1)
            texts = [t if s is None or t is None else masked(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(b.column(at).to_pylist(), spans.to_pylist(), strict=True)]
            cols = [*b.columns[:-1]]
            cols[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return both.mapInArrow(lean(run), docs.schema)
