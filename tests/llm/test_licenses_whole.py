"""Licence windows by brute force: every window of every template, best first."""

import random

from larkspur.llm import licenses


def brute(text):
    known, hits = licenses.templates(), []
    words = licenses.normal_words(text)
    for t, (name, own) in enumerate(known):
        q = set(licenses.bigrams(own))
        for start in range(2 - len(own), len(words) - 1):
            begin, end = max(start, 0), start + len(own)
            p = set(licenses.bigrams(words[begin:end]))
            dice = 2.0 * len(p & q) / (len(p) + len(q))
            if dice >= licenses.THRESHOLD:
                hits.append((-dice, t, begin, end, name))
    kept = []
    for h in sorted(hits):
        if not any(g[2] < h[3] and h[2] < g[3] for g in kept):
            kept.append(h)
    best = {}
    for less, _, begin, _, name in kept:
        best[name] = min(best.get(name, (0, 0)), (less, begin))
    return {name: (round(-less, 6), begin) for name, (less, begin) in best.items()}


def test_op9_loses_no_window(spark):
    rng = random.Random(9)
    bsd, mit, isc, gpl = (licenses.TEXTS[x][0] for x in ("BSD-3-Clause", "MIT", "ISC", "GPL-3.0"))
    stems = ("licen", "permission", "redistribut", "warrant", "copyright", "domain", "liab")
    half = len(mit.split()) // 2
    noisy = lambda text, share: " ".join(rng.choice(["of the", "x", ""]) if rng.random() < share else w for w in text.split())
    texts = [
        " ".join("x" if any(s in w.lower() for s in stems) else w for w in bsd.split()),
        " ".join([*mit.split()[half:], *mit.split()[:half]]),
        f"{isc} {noisy(gpl, 0.04)} {isc}",
        f"{bsd} {licenses.TEXTS['BSD-2-Clause'][0]}",
        "Before CC0 1.0 universal public",
        mit[200:] + " " + mit[:700],
        *(f"of the {noisy(t, 0.05)} to use, copy" for t in (mit, isc, gpl, licenses.TEXTS["Zlib"][0], licenses.TEXTS["MPL-2.0"][0])),
        "word", "", None,
    ]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {}).update({r.license: (r.dice, r.place)} if r.license else {})
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}
    assert "BSD-3-Clause" in got[0] and "MIT" in got[1] and set(got[3]) == {"BSD-3-Clause", "BSD-2-Clause"}
