"""Personal data: forms against the contract's expressions, discovery against a graph in plain Python."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checked(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, form) in enumerate(FORMS.items()) for m in re.finditer(form, text) if checked(kind, m.group())]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def ours(text):
    return [(a, b, pii.KINDS[k]) for a, b, k in pii.base_spans(text)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1..@@-+ ()0%é_", max_size=40))
def test_forms(text):
    assert ours(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-0100", "10.0.0.1", "999.1.1.1", "a.b@c.de", "@", "+", "-", ".", " ", "x", "00", "Ж"]), max_size=12).map("".join))
def test_forms_side_by_side(text):
    assert ours(text) == plain(text)
    held = [(a, b) for a, b, _ in pii.base_spans(text)]
    loose = pii.loose_spans(text, pii.base_spans(text))
    every = sorted(held + [(a, b) for a, b, _ in loose])
    assert all(b <= c or (a, b) in held and (c, _) in held for (a, b), (c, _) in zip(every, every[1:], strict=False))


@pytest.mark.parametrize("text", ["a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "+1" + " -" * 100_000, ":" * 200_000, "[at]" * 50_000, "(" * 200_000, "a" * 200_000 + "@" + "b" * 200_000, "1 (" * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.time()
    pii.loose_spans(text, pii.base_spans(text))
    assert time.time() - began < 5


def test_cues():
    t = "Call  Me at\t+1 555 tel:+1 (x@y.z <q@y.z>"
    assert pii.cues(t, t.index("+1")) == ["me at ", "at "][::-1]
    assert pii.cues(t, t.rindex("+1")) == ["tel:", "555 tel:"]
    assert pii.cues(t, t.index("x@")) == ["tel:+1 ", "555 tel:+1 "]
    assert pii.cues(t, t.index("q@")) == ["(x@y.z ", "tel:+1 (x@y.z "]
    assert pii.cues("a@b.c", 0) == [] and pii.cues("x" * 65 + " 5", 66) == [] and pii.cues("y " + "x" * 64 + " 5", 67) == ["x" * 64 + " ", "y " + "x" * 64 + " "]
    assert pii.instance(0, "Jo [at] X (dot) org") == "jo@x.org" and pii.instance(3, "+1 (5)-6") == "156"


def graph(texts, confidence=0.5, support=3, rounds=5, doubt=0.1):
    """All spans of each text, by loops over dictionaries."""
    words = [[w.translate(pii.LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    places = {}
    for w in words:
        for k in (1, 2):
            for i in range(len(w) - k + 1):
                places[" ".join(w[i : i + k]) + " "] = places.get(" ".join(w[i : i + k]) + " ", 0) + 1
    base = [pii.base_spans(t or "") for t in texts]
    loose = [[(a, b, k) for a, b, ks in pii.loose_spans(t or "", own) for k in ks] for t, own in zip(texts, base, strict=True)]
    seeds = {(k, pii.instance(k, t[a:b])) for t, own in zip(texts, base, strict=True) for a, b, k in own}
    edges = {}
    for t, own, wide in zip(texts, base, loose, strict=True):
        for a, b, k in [*own, *wide]:
            for c in pii.cues(t, a):
                key = (k, c, pii.instance(k, t[a:b]))
                edges[key] = edges.get(key, 0) + 1
    by = {}
    for (k, c, i), n in edges.items():
        by.setdefault(c, []).append(((k, i), n))
    wide = {c: max(sum(n for _, n in e), places.get(c, 0)) for c, e in by.items() if len(e) >= support and any(x in seeds for x, _ in e)}
    reliable = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        trust = {}
        for (k, c, i), n in edges.items():
            if c in wide:
                s = trust.setdefault((k, c), [0, 0, wide[c]])
                if (k, i) in reliable:
                    s[0] += n * reliable[k, i]
                    s[1] += 1
                elif k in (0, 3) or ":" in i:
                    s[2] -= (1 - doubt) * n
        trust = {p: s / total for p, (s, m, total) in trust.items() if m >= support and s / total >= confidence}
        new = dict.fromkeys(seeds, 1.0)
        for (k, c, i), _n in edges.items():
            if (k, c) in trust and (k, i) not in seeds:
                new[k, i] = max(new.get((k, i), 0), trust[k, c])
        done, reliable = len(new) == len(reliable), new
        if done:
            break
    out = []
    for t, own, wide_ in zip(texts, base, loose, strict=True):
        best = {}
        for a, b, k in wide_:
            r = reliable.get((k, pii.instance(k, t[a:b])))
            if r is not None:
                best[a, b] = min(best.get((a, b), (0, 9)), (-r, k))
        spans = own + [(a, b, k) for (a, b), (_, k) in best.items()]
        out.append(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))))
    return out


DOC = "doc_id long, text string, row long, base string, kind int"
PLANTED = (
    [f"You may reach Ann at phone: +1 (555) 555-01{i:02d} or later" for i in range(8)]
    + [f"Words here. phone: (555) 555-02{i:02d}, and card no. 4111 1111 1111 {i:04d}" for i in range(30)]
    + ["hot line (555) 555-0201 again", "hot line (555) 555-9999 alone", "write to <ann@site.example> or ann [at] site [dot] example today"]
    + ["server 10.0.0.1 up", "server 10.0.0.2 up", "server 10.0.0.3 up", "server fe80::1:2 up", "server 10.0.0.999 up", "server room of the farm", "at 12:30:45 the of version 2.0.1.4"]
    + ["Phone: " * 2, "no. 5 of the 1234567 of the 2345678", "of the +15555550199 of the +15555550198 of the +15555550197", None, "", "the of the of the of the of the of the of the of the of the of the of the of"]
    + ["x" * 100 + " 7654321 " + "y " * 3000 + "phone: 7654321"]
)


def run(spark, texts, **how):
    rows = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in enumerate(texts)], DOC).repartition(3)
    return sorted((r.asDict() for r in pii.report(pii.extract(rows, **how)).collect()), key=lambda r: r["doc_id"])


@pytest.mark.parametrize("how", [{}, {"confidence": 0.2, "support": 2}, {"rounds": 1}])
def test_discovery(spark, how):
    got = run(spark, PLANTED, **how)
    assert [r["spans"] for r in got] == graph(PLANTED, **how)
    for r, t in zip(got, PLANTED, strict=True):
        own = plain(t or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in own).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in own) for k in pii.KINDS]
        assert r["n_found"] == len(r["spans"].split(",")) * bool(r["spans"]) - len(own)


def test_what_is_found_and_what_is_left_alone(spark):
    by = {t: r["spans"] for t, r in zip(PLANTED, run(spark, PLANTED), strict=True)}
    assert by["hot line (555) 555-0201 again"] == "phone:10:23" and by["hot line (555) 555-9999 alone"] == ""
    assert by["write to <ann@site.example> or ann [at] site [dot] example today"] == "email:10:26,email:31:58"
    assert by["server fe80::1:2 up"] == "ip:7:16" and by["server 10.0.0.999 up"] == "ip:7:17"
    assert by["at 12:30:45 the of version 2.0.1.4"].split(",")[-1] == "ip:27:34" and by["no. 5 of the 1234567 of the 2345678"] == ""


def test_no_rows_no_spans_and_ids(spark):
    assert run(spark, []) == [] and [r["spans"] for r in run(spark, ["nothing here", None])] == ["", ""]
    rows = spark.createDataFrame([(None, "a@b.cd"), (3, "+1 555 555 0100"), (3, None), (None, "x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["spans"]) for r in pii.report(pii.extract(rows)).collect())
    assert got == [("3", ""), ("3", "phone:0:15"), ("None", ""), ("None", "email:0:6")]


def test_redaction(spark):
    rows = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in enumerate(PLANTED)], DOC)
    got = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    assert got[0] == "You may reach Ann at phone: <phone> or later" and got[PLANTED.index(None)] is None and len(got) == len(PLANTED)
    assert got[8] == "Words here. phone: (<phone>, and card no. 4111 1111 1111 0000" or "<phone>" in got[8]
