import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marketlens.llm import licenses


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def smith_waterman(template, text):
    """Best local alignment of word lists, without a band: (score, matched, begin, end)."""
    best, row = (0, 0, 0, 0), [(0, 0, 0)] * (len(text) + 1)
    for x in template:
        new = [(0, 0, 0)]
        for j, y in enumerate(text):
            score, hits, begin = row[j] if row[j][0] else (0, 0, j)
            cells = [(score + 2, hits + 1, begin) if x == y else (score - 1, hits, begin)]
            cells += [(s - 1, h, b) for s, h, b in (row[j + 1], new[j])]
            top = max(cells)
            new.append(top if top[0] > 0 else (0, 0, 0))
            if new[-1] > best[:3]:
                best = (*new[-1], j + 1)
        row = new
    return best


def found_in(texts, notices, least=0.6):
    """The scan without Spark: per text a list of matches."""
    w, first = licenses._words(pa.array([t for _, t in notices]))
    index = licenses.TemplateIndex([n for n, _ in notices], w, first, least)
    return licenses._scanned(pa.array(texts, pa.string()), index)[1].to_pylist()


def edited(base, draw, share):
    out = []
    for w in base:
        change = draw.random() < share
        kind = draw.choice(["other", "none", "more", "other"])
        out += [w] if not change else {"other": [f"x{draw.randrange(99)}"], "none": [], "more": [w, f"x{draw.randrange(99)}"]}[kind]
    return out


@pytest.mark.parametrize("least", [0.5, 0.6, 0.8])
def test_every_span_of_a_full_alignment_is_found(least):
    draw = random.Random(11)
    reached = 0
    for round_ in range(260):
        n = draw.choice([1, 2, 3, 4, 5, 6, 8, 11, 14, 18, 23, 24, 30, 45, 80])
        base = [f"w{draw.randrange(max(3, n))}" for _ in range(n)]
        text = [f"y{draw.randrange(40)}" for _ in range(draw.randrange(60))] + edited(base, draw, draw.choice([0, 0.1, 0.25, 0.4]))
        text += [draw.choice(base) if draw.random() < 0.1 else f"z{draw.randrange(40)}" for _ in range(draw.randrange(60))]
        score, hits, begin, end = smith_waterman(base, text)
        found = found_in(["w0 other", " ".join(text), None], [("T", " ".join(base))], least)
        assert found[2] == []
        for m in found[1]:
            assert m["coverage"] == m["matched"] / n >= least - 1e-9 and 0 <= m["begin"] < m["end"] <= len(text)
        if hits >= least * n:
            reached += 1
            assert max((m["matched"] for m in found[1]), default=0) >= hits, (n, base, text)
    assert reached > 120


def names(text):
    rows = sorted(licenses.TEMPLATES.items())
    w, first = licenses._words(pa.array([t for _, t in rows]))
    key, key_first = licenses._words(pa.array([licenses.KEYS.get(n) for n, _ in rows], pa.string()))
    index = licenses.TemplateIndex([n for n, _ in rows], w, first, 0.6, key, key_first)
    return [m["license"] for m in licenses._scanned(pa.array([text]), index)[1].to_pylist()[0]]


@pytest.mark.parametrize("text,want", [
    ("Our code. Licensed under the MIT License. And more", ["MIT"]),
    ("it ends so: Licensed under the MIT License.", ["MIT"]),
    ("released under an MIT License", ["MIT"]),
    ("Released under the MIT License. Released under the MIT License.", ["MIT", "MIT"]),
    ("released under the new license", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU Affero General Public License, version 3", ["AGPL-3.0"]),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0-long"]),
    ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]),
    ("Licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
    ("Licensed under the Eclipse License, Version 2.0.", []),
    ("the terms of the work in the hope of a later version under the law", []),
])
def test_notices_get_the_right_name(text, want):
    assert names(text) == want


def test_of_equal_matches_one_stays():
    found = found_in(["aa bb cc dd and aa bb cc"], [("Y", "aa bb cc"), ("X", "aa bb cc"), ("Z", "aa bb cc dd")])[0]
    assert [(m["license"], m["begin"], m["end"]) for m in found] == [("Z", 0, 4), ("X", 5, 8)]


NOTICES = [("A", "the quick brown fox jumps over the lazy dog and runs into the dark wood"), ("B", "released under terms"), ("C", "one two"), ("D", "")]


def make_texts():
    draw = random.Random(8)
    texts = [None, "", "...", "RELEASED under (terms)!", "one two three", "released under"]
    for _ in range(80):
        base = words(NOTICES[draw.choice([0, 0, 1, 2])][1])
        for _ in range(draw.randrange(4)):
            i = draw.randrange(len(base) + 1)
            base[i : i + draw.randrange(2)] = [f"x{draw.randrange(50)}"] * draw.randrange(2)
        texts.append(" ".join([f"y{draw.randrange(90)}" for _ in range(draw.randrange(30))] + base + [f"z{draw.randrange(90)}" for _ in range(draw.randrange(30))]))
    return texts + [" ".join([NOTICES[0][1], "gap " * 9, NOTICES[0][1]]), "filler " * 80_000 + NOTICES[0][1]]


def test_spans_agree_with_full_alignment(spark, docs):
    notices = spark.createDataFrame(NOTICES + [(None, "no name"), ("E", None)], "license string, text string")
    texts = make_texts()
    rows = {r.doc_id: r for r in licenses.scan(docs(*texts), notices, least=0.5).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts[:-2]):
        w = words(text)
        assert rows[i].n_words == len(w)
        for m in rows[i].licenses:
            template = words(dict(NOTICES)[m.license])
            assert m.coverage == m.matched / len(template) >= 0.5 and m.matched <= m.end - m.begin
            assert smith_waterman(template, w[m.begin : m.end])[1] >= m.matched
        for name, t in NOTICES[:3]:
            score, hits, begin, end = smith_waterman(words(t), w)
            if hits >= 0.5 * len(words(t)):  # itself, or one that explains more of the span
                assert any(m.begin < end and begin < m.end for m in rows[i].licenses), (name, text)
    twice, late = rows[len(texts) - 2].licenses, rows[len(texts) - 1].licenses
    assert [(m.begin, m.end, m.coverage) for m in twice if m.license == "A"] == [(0, 15, 1.0), (24, 39, 1.0)]
    assert [(m.begin, m.coverage) for m in late] == [(80_000, 1.0)]


def test_banded_score_equals_full_score():
    draw = np.random.default_rng(5)
    for _ in range(40):
        template = [f"w{x}" for x in draw.integers(0, 30, 20)]
        text = list(template)
        for _ in range(draw.integers(0, 5)):
            text[int(draw.integers(len(text)))] = "zz"
        a, fa = licenses._words(pa.array([" ".join(template)]))
        b, fb = licenses._words(pa.array([" ".join(["pre"] * 5 + text + ["post"] * 5)]))
        index = licenses.TemplateIndex(["T"], a, fa)
        got = index.align(b, fb[:1], fb[1:], np.array([0]), np.array([5 // licenses.BAND * licenses.BAND]))
        assert tuple(int(x[0]) for x in got) == smith_waterman(template, ["pre"] * 5 + text + ["post"] * 5)[1:]


def test_empty_tables_and_published_notices(spark, docs):
    none = spark.createDataFrame([], "license string, text string")
    assert [r.licenses for r in licenses.scan(docs("Released under the MIT License."), none).collect()] == [[]]
    assert licenses.scan(docs(), licenses.templates(spark)).count() == 0
    found = licenses.scan(docs(*["so. " + " ".join(t.split()) + " end" for _, t in sorted(licenses.TEMPLATES.items())]), licenses.templates(spark))
    assert found.columns == ["doc_id", "word", "c0", "n_words", "licenses"]
    for r in found.collect():
        assert any(m.license == sorted(licenses.TEMPLATES)[r.doc_id] and m.coverage == 1.0 for m in r.licenses)
