import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import _text
from quarry.llm._text import ALNUM_ENDS, FIRST, SECOND, Words, chunks, joined


def words(texts, **how):
    out = []
    for _, _, data, offs in chunks(pa.array(texts, pa.string())):
        w = Words(data, offs, **how)
        out += [[w.of(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x1f\xa0.9日", max_size=12)), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    assert words(texts) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert words(texts, kind=ALNUM_ENDS, lower=True) == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)) for t in texts]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 8))
def test_equal_grams_have_equal_hashes(values, k):
    v = np.array(values, np.uint64)
    for poly in (FIRST, SECOND):
        g = poly.grams(v, k).tolist()
        runs = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
        assert len(g) == len(runs)
        seen = dict(zip(runs, g, strict=True))
        assert all(seen[r] == h for r, h in zip(runs, g, strict=True)) and len(set(seen.values())) == len(seen)


def test_long_texts_hash_as_short_ones(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000))
    ((_, _, data, offs),) = chunks(pa.array([text]))
    w = Words(data, offs)
    whole = w.hashes()
    monkeypatch.setattr(_text, "CHUNK_BYTES", 100)
    assert (w.hashes() == whole).all()
    assert len(np.unique(whole)) == 977


def test_joined():
    ((_, _, data, offs),) = chunks(pa.array(["a  b\tc", None, "d", ""]))
    w = Words(data, offs)
    text, ends = joined(w, np.array([True, False, True, True]))
    assert [text[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [b"a c", b"", b"d", b""]
    assert list(chunks(pa.array([], pa.string()))) == []


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_regular_words_do_not_collide():
    from quarry.llm._text import WIDEST

    texts = [thue_morse(n) for n in (8, 16, 32, 64, 128, 1024, 2048, 4096)]
    texts += [t.translate(str.maketrans("ab", "ba")) for t in texts] + ["a" * n for n in range(1, 3 * WIDEST)] + ["b" + "a" * n for n in range(1, 3 * WIDEST)]
    ((_, _, data, offs),) = chunks(pa.array(texts))
    w = Words(data, offs)
    one, two = w.hashes(), w.hashes(SECOND)
    assert len(np.unique(one)) == len(np.unique(two)) == len(texts) and not (one == two).any()
    alone = [Words(*x[2:]).hashes()[0] for t in texts for x in chunks(pa.array([t]))]
    assert (one == np.array(alone)).all()


def test_keys_are_sorted_grouped_and_found_without_sorting_places(monkeypatch):
    import numpy as np

    from quarry.llm import _packed

    r = np.random.default_rng(0)
    close = r.integers(0, 5, 5000).astype(np.uint64) << np.uint64(60) | r.integers(0, 9, 5000).astype(np.uint64)  # the high bits don't tell them apart
    for keys in (close, close[:1], close[:0]):
        assert (keys[_packed.sorting(keys)] == np.sort(keys)).all()
    monkeypatch.setattr(np, "argsort", None)
    for most in (2, 1 << 40, (1 << 64) - 1):
        keys = np.repeat(r.integers(0, most, 1000, dtype=np.uint64, endpoint=True), 3)
        distinct, at, which = _packed.groups(keys)
        assert (distinct == sorted(set(keys.tolist()))).all() and (keys[at] == distinct).all() and (distinct[which] == keys).all()
        place, there = _packed.find(distinct[::2], keys)
        assert (there == np.isin(keys, distinct[::2])).all() and (distinct[::2][place[there]] == keys[there]).all()
