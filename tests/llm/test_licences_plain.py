"""Licence scans against every run of lines and sentences, without anchors, prefixes or early ends."""

import random
import re

import pytest

license_scan = pytest.importorskip("helixloom.llm.license_scan")


def words(s):
    return " ".join(re.findall(r"[^\W_]+", s.lower()))


KNOWN = {words(s): name for name, many in license_scan.SENTENCES.items() for s in many}
LONGEST = max(len(s.split()) for s in KNOWN)


def plain(text):
    spans, at = [], 0
    for m in [*re.finditer(r"\n|(?<=[.;:!?])\s+", text or ""), None]:
        a, b = m.span() if m else (len(text or ""), 0)
        if a > at and words(text[at:a]):
            spans.append((at, a))
        at = b
    known, k = [], 0
    while k < len(spans):
        runs = [(j, words(" ".join(text[a:b] for a, b in spans[k : j + 1]))) for j in range(k, min(len(spans), k + LONGEST))]
        hits = [(j, KNOWN[w]) for j, w in runs if w in KNOWN]
        if hits:
            j, name = hits[-1]
            known.append((name, spans[k][0], spans[j][1]))
            k = j + 1
        else:
            k += 1
    found, rest, k = [], [], 0
    while k < len(known):
        fits = [(name, len(ids)) for name, ids in license_scan.RULES if [x[0] for x in known[k : k + len(ids)]] == list(ids)]
        if fits:
            found.append((fits[0][0], known[k][1], known[k + fits[0][1] - 1][2]))
            k += fits[0][1]
        else:
            rest.append(known[k][0])
            k += 1
    return found, rest, len(known)


def made(seed):
    """Licence texts as they are, wrapped, in capitals, cut, out of order, between other words."""
    r = random.Random(seed)
    sentences = [s for many in license_scan.SENTENCES.values() for s in many]
    by_id = {name: many for name, many in license_scan.SENTENCES.items()}
    out = []
    for _ in range(r.randint(1, 6)):
        x = r.random()
        if x < 0.4:
            parts = [r.choice(by_id[i]) for i in r.choice(license_scan.RULES)[1]]
        elif x < 0.7:
            parts = [r.choice(sentences)]
        else:
            parts = [" ".join(r.choice("license the of this permission file house copyright Tom".split()) for _ in range(r.randint(1, 9)))]
        for p in parts:
            how = r.random()
            p = re.sub(" ", lambda m: r.choice([" ", " ", "\n", "\n# ", "  "]), p) if how < 0.4 else p.upper() if how < 0.5 else p[: r.randint(1, len(p))] if how < 0.6 else p
            out.append(p + r.choice([".", ".", "", ";", "!"]))
    return r.choice(["\n", " ", "\n\n"]).join(out)


@pytest.mark.parametrize("seed", range(2))
def test_scan_equals_the_plain_search(seed):
    scanner = license_scan.Scanner()
    texts = [made(1000 * seed + k) for k in range(150)]
    texts.append("\n".join(texts) * 3)  # a very long one
    some = 0
    for text in [*texts, None, "", "license"]:
        got = scanner.scan(text)
        assert got == plain(text), text
        some += len(got[0])
    assert some > 60
