"""Benchmark decontamination against all windows of all documents and items, in plain Python."""

import math
import random

import pytest

decontaminate = pytest.importorskip("helixloom.llm.decontaminate")

BIG = (1 << 53) + 1
MARKS = (decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT)


def readings(text, width):
    """(place, second, window, slots) of each window of a text in its one or two readings."""
    tokens, surface, either = decontaminate.template(text or "")
    named = [decontaminate.NAME if k in either else t for k, t in enumerate(tokens)]
    out = []
    for k in range(len(tokens) - width + 1):
        here = range(k, k + width)
        words = tuple(tokens[k : k + width])
        if all(t in MARKS for t in words):
            out.append((k, False, ("values", *surface[k : k + width]), [surface[j] for j in here if tokens[j] in MARKS]))
        else:
            out.append((k, False, words, [surface[j] for j in here if tokens[j] in MARKS]))
        if any(j in either for j in here) and any(named[j] not in MARKS for j in here):
            out.append((k, True, tuple(named[k : k + width]), [surface[j] for j in here if named[j] in MARKS]))
    return out


def twice(pairs, side):
    """Values of a side that stand for more than one of the other."""
    other = {}
    for p in pairs:
        other.setdefault(p[side], set()).add(p[1 - side])
    return {v for v, o in other.items() if len(o) > 1}


def covers(doc, item, coverage=0.8):
    """The share of the item's windows that a document covers; None below the coverage."""
    tokens = decontaminate.template(item or "")[0]
    width = min(decontaminate.WINDOW, len(tokens))
    if not width:
        return None
    lines = {}
    for ipos, second_i, a, islots in readings(item, width):
        for dpos, second_d, b, dslots in readings(doc, width):
            if a == b and (width == decontaminate.WINDOW or islots == dslots):
                hit = (second_i or second_d, "\x02".join(islots), "\x02".join(dslots))
                windows = lines.setdefault(dpos - ipos, {})
                windows[ipos] = min(windows.get(ipos, hit), hit)
    found = set()
    for windows in lines.values():
        split = lambda h: [p for p in zip(h[1].split("\x02"), h[2].split("\x02")) if h[1] or h[2]]
        first = {p for h in windows.values() if not h[0] for p in split(h)}
        every = {p for h in windows.values() for p in split(h)}
        if twice(first, 0) or twice(first, 1):
            continue
        bad_i, bad_d = twice(every, 0), twice(every, 1)
        found |= {k for k, h in windows.items() if not h[0] or not any(i in bad_i or d in bad_d for i, d in split(h))}
    share = len(found) / (len(tokens) - width + 1)
    return share if len(found) >= math.ceil(coverage * (len(tokens) - width + 1)) else None


def made(seed):
    """Items and documents that have items in them: as they are, with other values, with mixed ones, cut and repeated."""
    r = random.Random(seed)
    names, units = ["Tom", "Bob", "Mary", "Jane", "NASA"], ["kg", "km", "hours"]
    plain = "has gives buys rice stone house every day of the long week and then more".split()

    def sentence():
        out = []
        for _ in range(r.randint(2, 16)):
            x = r.random()
            out += [r.choice(names)] if x < 0.15 else [str(r.randint(1, 9)), r.choice(units)] if x < 0.25 else [r.choice(plain).title()] if x < 0.3 else [r.choice(plain)]
        return out + r.choice([["."], ["?"], []])

    items = [sentence() + (sentence() if r.random() < 0.3 else []) for _ in range(12)]
    docs = []
    for _ in range(70):
        parts = []
        for _ in range(r.randint(0, 3)):
            x = list(r.choice(items)) if r.random() < 0.7 else sentence()
            kind = r.random()
            if kind < 0.3:
                swap = dict(zip(names, r.sample(names, len(names))))
                x = [swap.get(t, t) for t in x]
            elif kind < 0.5:
                x = [str(r.randint(1, 9)) if t.isdigit() else r.choice(names) if t in names else t for t in x]
            elif kind < 0.6:
                x = x[r.randint(0, 2) : len(x) - r.randint(0, 2)]
            parts += x
        docs.append(" ".join(parts))
    return [" ".join(x) for x in items], docs


@pytest.mark.parametrize("seed", range(3))
def test_flags_equal_all_windows_of_all_items(spark, seed):
    items, texts = made(seed)
    items += [None, "", items[0], "Tom", "7 kg"]
    ids = [k // 2 if k % 3 else None for k in range(len(items))]
    docs = [(None if k % 9 == 4 else BIG + k, t, "x", 1, 2.0, k) for k, t in enumerate([*texts, None, ""])]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string, item_id int, coverage double, k int").repartition(3)
    bench = spark.createDataFrame(list(zip(ids, items)), "item_id long, text string")
    got = sorted((tuple(x) for x in decontaminate.flag_documents(df, bench).select("doc_id", "contaminated", "n_items", "item_ids", "coverage").collect()), key=str)
    want, kept = [], []
    for i, t, *_, k in docs:
        hits = [(j, c) for j, item in enumerate(items) if (c := covers(t, item)) is not None]
        some = sorted({ids[j] for j, _ in hits if ids[j] is not None})
        want.append((i, bool(hits), len(hits), ",".join(map(str, some)), max((c for _, c in hits), default=0.0)))
        kept += [k] * (not hits)
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=str)]
    assert all(abs((g[4] or 0) - w[4]) < 1e-12 for g, w in zip(got, sorted(want, key=str)))
    assert 5 < sum(w[1] for w in want) < len(want) - 5
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns and sorted(x.k for x in left.collect()) == sorted(kept)


def test_items_are_rows_whatever_their_ids(spark):
    item = "So Tom has 12 kg of rice and Tom gives 3 kg to Mary every day of the long week"
    mixed = item.replace("Tom has", "Bob has")  # two names for one
    one, two = "the red house by the river stands on a hill of old grey stone", "many small boats lie in the harbour under the first morning light now"
    halves = " ".join([*one.split()[:9], *two.split()[:9]])  # half of each of two items
    df = spark.createDataFrame([(1, mixed), (2, halves), (3, one), (4, item)], "doc_id long, text string")
    for ids in ([None, None, None], [5, 5, 5], [1, 2, 3]):
        bench = spark.createDataFrame(list(zip(ids, [item, one, two])), "item_id long, text string")
        assert {x.doc_id: x.contaminated for x in decontaminate.flag_documents(df, bench).collect()} == {1: False, 2: False, 3: True, 4: True}
    bench = spark.createDataFrame([("b", item), ("a", item), ("a", item), (None, one)], "item_id string, text string")
    named = df.selectExpr("concat('d', doc_id) as doc_id", "text")
    got = {x.doc_id: (x.n_items, x.item_ids) for x in decontaminate.flag_documents(named, bench).collect()}
    assert got == {"d1": (0, ""), "d2": (0, ""), "d3": (1, ""), "d4": (3, "a,b")}
